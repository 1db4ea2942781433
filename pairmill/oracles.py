"""The named queries as DuckDB SQL over the same tables, for checking results."""

from __future__ import annotations

# Unicode whitespace plus U+001C..U+001F as the inside of a character class.
WS = (
    r"\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
)


def _strip(e: str) -> str:
    return f"regexp_replace({e}, '^[{WS}]+|[{WS}]+$', '', 'g')"


def _words(e: str) -> str:
    return f"len(regexp_extract_all({e}, '[^{WS}]+'))"


def _clean(e: str) -> str:
    e = f"regexp_replace({e}, '<[^>]+>', '', 'g')"
    e = f"regexp_replace({e}, '&[a-z]+;', ' ', 'g')"
    e = f"regexp_replace({e}, 'https?://[^{WS}]+', '', 'g')"
    return f"trim(regexp_replace({e}, '[{WS}]+', ' ', 'g'))"


def _lead_sentences(e: str, n: int = 3) -> str:
    marked = f"regexp_replace({_strip(e)}, '([.!?»])[{WS}]+', '\\1' || chr(1), 'g')"
    kept = f"list_filter(string_split({marked}, chr(1)), lambda s: {_words('s')} >= 5)"
    return f"array_to_string(({kept})[1:{n}], ' ')"


def _lead_budget(e: str, budget: int = 300) -> str:
    pieces = f"string_split(translate({e}, '!?', '..'), '.')"
    states = f"list_transform({pieces}, lambda p: {{'s': p, 'full': false}})"
    fits = f"NOT a.full AND length(a.s) + length(p.s) < {budget}"
    step = f"{{'s': CASE WHEN {fits} THEN a.s || {_strip('p.s')} || '. ' ELSE a.s END, 'full': NOT ({fits})}}"
    start = "{'s': '', 'full': false}"
    return _strip(f"(list_reduce({states}, lambda a, p: {step}, {start})).s")


DERIVED = f"""
cleaned AS (SELECT doc_id, source, {_clean('text')} AS text_clean FROM documents),
led AS (SELECT *, {_lead_sentences('text_clean')} AS summary FROM cleaned),
derived AS (
  SELECT *, text_words / greatest(summary_words, 1) AS compression
  FROM (SELECT *, {_words('text_clean')} AS text_words, {_words('summary')} AS summary_words FROM led)
),
passed AS (
  SELECT * FROM derived
  WHERE text_words >= 200 AND summary_words >= 20 AND compression >= 3.0 AND summary <> '' AND text_clean <> ''
),
pairs AS (
  SELECT * FROM passed QUALIFY row_number() OVER (PARTITION BY text_clean ORDER BY doc_id) = 1
)"""

# The wrapped texts of the markup query, cleaned step by step.
_WRAPPED = (
    "'__NOTOC__{{box|' || source || '}}{| class=x' || chr(10) || '| cell' || chr(10) || '|}[[' || lang || '|' || source"
    " || ']] [https://a.example/b label] [https://c.example/d] == Head ==' || chr(10) || '| row' || chr(10) || '*#'"
    " || chr(10) || '<b>' || text || '</b>&nbsp;&#39; https://e.example/f' || chr(10) || 'end'"
)


def _unwiki(e: str) -> str:
    for pattern, replacement, flags in (
        ("__[A-Z]+__", "", "g"),
        (r"\{\{[^}]*\}\}", "", "g"),
        (r"(?s)\{\|.*?\|\}", "", "g"),
        (r"\[\[(?:[^|\]]*\|)?([^\]]+)\]\]", r"\1", "g"),
        (rf"\[https?://[^{WS}]+[{WS}]+([^\]]+)\]", r"\1", "g"),
        (rf"\[https?://[^{WS}]+\]", "", "g"),
        ("={2,}[^=]+=+", "", "g"),
        (r"(?m)^\|[^\n]*$", "", "g"),
        (rf"(?m)^[*#:;]+[{WS}]*$", "", "g"),
    ):
        e = f"regexp_replace({e}, '{pattern}', '{replacement}', '{flags}')"
    return e


TFIDF = f"""
split AS (
  SELECT doc_id, list_filter(
    list_transform(string_split(translate(text, '!?', '..'), '.'), lambda s: {_strip('s')}), lambda s: length(s) > 20
  ) AS sents FROM documents
),
sent AS (SELECT doc_id, len(sents) AS n, unnest(sents) AS s, unnest(range(1, len(sents) + 1)) AS pos FROM split),
tok AS (SELECT doc_id, n, pos, unnest(regexp_extract_all(lower(s), '[\\p{{L}}\\p{{N}}_]{{2,}}')) AS term FROM sent),
tf AS (SELECT doc_id, n, pos, term, count(*) AS tf FROM tok GROUP BY ALL),
w AS (
  SELECT doc_id, pos, tf * (ln((1 + n) / (1 + count(*) OVER (PARTITION BY doc_id, term))) + 1) AS w FROM tf
),
score AS (SELECT doc_id, pos, sum(w) / sqrt(sum(w * w)) AS score FROM w GROUP BY ALL),
place AS (
  SELECT sent.doc_id, sent.pos, sent.s,
    row_number() OVER (PARTITION BY doc_id ORDER BY round(coalesce(score, 0), 9) DESC, sent.pos DESC) AS place,
    max(coalesce(score, 0)) OVER (PARTITION BY doc_id) AS top
  FROM sent LEFT JOIN score USING (doc_id, pos)
),
best AS (
  SELECT doc_id, CASE WHEN max(top) > 0 THEN string_agg(s, '. ' ORDER BY pos) ELSE '' END AS summary
  FROM place WHERE place <= 3 GROUP BY doc_id
),
tfidf AS (
  SELECT split.doc_id,
    CASE WHEN len(sents) <= 3 THEN array_to_string(sents, ' ') ELSE coalesce(best.summary, '') END AS summary
  FROM split LEFT JOIN best USING (doc_id)
)"""

LEADS = f"lead AS (SELECT doc_id, {_lead_budget('text')} AS summary FROM documents)"

# One line per system, pair and side.
ALL_OUTPUTS = """
outputs AS (
  SELECT s.system, s.doc_id AS pair_id, s.cand, lead.summary AS ref
  FROM (
    SELECT 'identity' AS system, doc_id, summary AS cand FROM lead
    UNION ALL SELECT 'lead', doc_id, summary FROM lead
    UNION ALL SELECT 'tfidf', doc_id, summary FROM tfidf
  ) s JOIN lead USING (doc_id)
  WHERE s.cand <> '' AND lead.summary <> ''
),
sides AS (
  SELECT system, pair_id, 'c' AS side, cand AS t FROM outputs
  UNION ALL SELECT system, pair_id, 'r', ref FROM outputs
)"""
TFIDF_OUTPUTS = ALL_OUTPUTS.replace(
    """    SELECT 'identity' AS system, doc_id, summary AS cand FROM lead
    UNION ALL SELECT 'lead', doc_id, summary FROM lead
    UNION ALL SELECT 'tfidf', doc_id, summary FROM tfidf
""",
    "    SELECT 'tfidf' AS system, doc_id, summary AS cand FROM tfidf\n",
)


def _grams(name: str, tokens: str, orders: range, joiner: str) -> str:
    """CTEs counting grams of each order: ``<name>_o`` has (system, pair_id, n, m, c, r) per pair and order."""
    if joiner:
        grams = f"list_transform(range(1, len(tk) - n + 2), lambda i: array_to_string(tk[i:i + n - 1], '{joiner}'))"
    else:
        grams = "list_transform(range(1, length(tk) - n + 2), lambda i: substring(tk, i, n))"
    values = ", ".join(f"({n})" for n in orders)
    return f"""
{name}_t AS (SELECT system, pair_id, side, {tokens} AS tk FROM sides),
{name}_g AS (
  SELECT system, pair_id, side, n, unnest({grams}) AS g FROM {name}_t, (VALUES {values}) AS orders(n)
),
{name}_k AS (
  SELECT system, pair_id, n, g, count(*) FILTER (side = 'c') AS c, count(*) FILTER (side = 'r') AS r
  FROM {name}_g GROUP BY ALL
),
{name}_o AS (
  SELECT outputs.system, outputs.pair_id, orders.n, coalesce(m, 0) AS m, coalesce(c, 0) AS c, coalesce(r, 0) AS r
  FROM outputs CROSS JOIN (VALUES {values}) AS orders(n) LEFT JOIN (
    SELECT system, pair_id, n, sum(least(c, r)) AS m, sum(c) AS c, sum(r) AS r FROM {name}_k GROUP BY ALL
  ) k ON k.system = outputs.system AND k.pair_id = outputs.pair_id AND k.n = orders.n
)"""


def _rouge(pattern: str) -> str:
    return _grams("rouge", f"regexp_extract_all(lower(t), '{pattern}')", range(1, 3), " ") + """,
rouge AS (
  SELECT system, pair_id,
    max(CASE WHEN n = 1 THEN f END) AS rouge1, max(CASE WHEN n = 2 THEN f END) AS rouge2
  FROM (SELECT *, CASE WHEN m > 0 THEN 2.0 * (m / c) * (m / r) / (m / c + m / r) ELSE 0 END AS f FROM rouge_o)
  GROUP BY ALL
)"""


def _bleu_tokens() -> str:
    e = f"regexp_replace(t, '[{WS}]+$', '')"
    e = f"replace(replace(replace({e}, '<skipped>', ''), '-' || chr(10), ''), chr(10), ' ')"
    for entity, char in (("&quot;", '"'), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">")):
        e = f"replace({e}, '{entity}', '{char}')"
    e = f"' ' || {e} || ' '"
    for pattern, replacement in (
        (r"([\{-\~\[-\` -\&\(-\+\:-\@\/])", r" \1 "),
        (r"([^0-9])([\.,])", r"\1 \2 "),
        (r"([\.,])([^0-9])", r" \1 \2"),
        (r"([0-9])(-)", r"\1 \2 "),
    ):
        e = f"regexp_replace({e}, '{pattern}', '{replacement}', 'g')"
    return f"regexp_extract_all({e}, '[^{WS}]+')"


BLEU = _grams("bleu", _bleu_tokens(), range(1, 5), " ") + """,
bleu_p AS (
  SELECT *, count(*) FILTER (c > 0 AND m = 0) OVER (PARTITION BY system, pair_id ORDER BY n) AS misses FROM bleu_o
),
bleu AS (
  SELECT system, pair_id, CASE WHEN sum(m) = 0 THEN 0 ELSE
    (CASE WHEN max(CASE WHEN n = 1 THEN c END) < max(CASE WHEN n = 1 THEN r END)
      THEN exp(1 - max(CASE WHEN n = 1 THEN r END) / max(CASE WHEN n = 1 THEN c END)) ELSE 1 END)
    * exp(avg(ln(CASE WHEN m = 0 THEN 100.0 / (pow(2, misses) * c) ELSE 100.0 * m / c END)) FILTER (c > 0)) END AS bleu
  FROM bleu_p GROUP BY ALL
)"""

CHRF = _grams("chrf", f"regexp_replace(t, '[{WS}]+', '', 'g')", range(1, 7), "") + """,
chrf AS (
  SELECT system, pair_id, CASE WHEN coalesce(p + r, 0) = 0 THEN 0 ELSE 100.0 * 5 * p * r / (4 * p + r) END AS chrf
  FROM (
    SELECT system, pair_id, avg(m / c) FILTER (c > 0 AND r > 0) AS p, avg(m / r) FILTER (c > 0 AND r > 0) AS r
    FROM chrf_o GROUP BY ALL
  )
)"""

# Longest common subsequence of ROUGE tokens: one line of the table per candidate token, built cell by cell.
LCS = """
lcs_in AS (
  SELECT system, pair_id, regexp_extract_all(lower(cand), '[a-z0-9]+') AS c, regexp_extract_all(lower(ref), '[a-z0-9]+') AS r
  FROM outputs
),
lcs_len AS (
  SELECT system, pair_id, len(c) AS c, len(r) AS r, coalesce(list_reduce(
    list_transform(c, lambda x: list_transform(r, lambda y: (x = y)::INTEGER)),
    lambda line, hit: list_reduce(
      list_transform(range(1, len(hit) + 1), lambda j: [j::INTEGER]),
      lambda built, j: list_append(built, greatest(built[-1], line[j[1]], coalesce(line[j[1] - 1], 0) + hit[j[1]])),
      []::INTEGER[]),
    list_transform(r, lambda y: 0))[-1], 0) AS m
  FROM lcs_in
),
lcs AS (SELECT system, pair_id, CASE WHEN m > 0 THEN 2.0 * m / (c + r) ELSE 0 END AS rougeL FROM lcs_len)"""

# Best right vector of each left vector.
COSINES = """
vec AS (
  SELECT vec_id, embedding::DOUBLE[] AS v, sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) AS len
  FROM embeddings
),
cosines AS (
  SELECT a.vec_id AS left_id, b.vec_id AS right_id, list_dot_product(a.v, b.v) / (a.len * b.len) AS cosine
  FROM vec a, vec b WHERE a.vec_id % 2 = 0 AND b.vec_id % 2 = 1
),
nearest AS (
  SELECT left_id, right_id, cosine FROM cosines
  QUALIFY row_number() OVER (PARTITION BY left_id ORDER BY round(cosine, 9) DESC, right_id) = 1
)"""

ALIGNED = f"WITH {COSINES} SELECT left_id, right_id, round(cosine, 3) AS score FROM nearest WHERE cosine >= 0.4"

BERTSCORE = """
vec AS (
  SELECT vec_id // 10 AS pair_id, vec_id, embedding::DOUBLE[] AS v,
    sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) AS len
  FROM embeddings
),
met AS (
  SELECT a.pair_id, a.vec_id AS c, b.vec_id AS r, list_dot_product(a.v, b.v) / (a.len * b.len) AS cosine
  FROM vec a JOIN vec b USING (pair_id) WHERE a.vec_id % 2 = 0 AND b.vec_id % 2 = 1
),
p AS (SELECT pair_id, avg(best) AS precision FROM (SELECT pair_id, c, max(cosine) AS best FROM met GROUP BY ALL) GROUP BY ALL),
r AS (SELECT pair_id, avg(best) AS recall FROM (SELECT pair_id, r, max(cosine) AS best FROM met GROUP BY ALL) GROUP BY ALL),
pr AS (SELECT *, 2 * precision * recall / (precision + recall) AS f1 FROM p JOIN r USING (pair_id))"""


def _gram_places(e: str) -> str:
    """Hashed places of the character grams of a text, one for each gram."""
    padded = f"' ' || lower({e}) || ' '"
    grams = f"list_transform(range(1, greatest(length({padded}) - 2, 1) + 1), lambda i: substring({padded}, i, 3))"
    return f"list_transform({grams}, lambda g: ('0x' || substr(md5(g), 1, 7))::BIGINT % 256)"


# Weights of the places of each text: its share of the length is w.
def _gram_weights(table: str, e: str) -> str:
    return f"""
placed AS (SELECT doc_id, unnest({_gram_places(e)}) AS place FROM {table}),
counted AS (SELECT doc_id, place, count(*) AS n FROM placed GROUP BY ALL),
weights AS (SELECT doc_id, place, n / sqrt(sum(n * n) OVER (PARTITION BY doc_id)) AS w FROM counted)"""


SAMPLE_KEY = "md5('42' || doc_id::VARCHAR)"

ORACLES: dict[str, str] = {
    # --- preparation ---
    "clean_pairs": f"""WITH {DERIVED} SELECT doc_id, source, summary, text_words, summary_words,
        md5(text_clean) AS text_md5, round(compression, 6) AS compression FROM pairs""",
    "source_report": f"""WITH {DERIVED} SELECT source, count(*) AS n, round(avg(text_words), 0) AS mean_text_words,
        round(avg(compression), 1) AS mean_compression FROM pairs GROUP BY source""",
    "attrition_report": f"""WITH {DERIVED}, t AS (
          SELECT (SELECT count(*) FROM documents) AS before, (SELECT count(*) FROM pairs) AS after)
        SELECT before, after, before - after AS dropped, round((before - after) * 100.0 / before, 1) AS dropped_pct FROM t""",
    "quality_filter_exempt": f"""WITH {DERIVED} SELECT doc_id, text_words, summary_words FROM derived
        WHERE summary <> '' AND text_clean <> ''
          AND ((text_words >= 200 AND summary_words >= 20 AND compression >= 3.0) OR source = 'src1')""",
    "strip_wiki_markup": f"""SELECT doc_id, {_clean(
        "CASE WHEN regexp_matches(source, '[02468]$') THEN " + _unwiki(_WRAPPED) + " ELSE " + _WRAPPED + " END"
    )} AS text_clean FROM documents""",
    "derived_columns": f"""WITH {DERIVED}
        SELECT doc_id, text_words, summary_words, round(compression, 6) AS compression FROM derived""",
    "drop_duplicates": "SELECT min(doc_id) AS doc_id FROM documents GROUP BY text",
    "first_copies": """SELECT doc_id, lang, md5(text) AS text_md5 FROM documents
        QUALIFY row_number() OVER (PARTITION BY text ORDER BY doc_id) = 1""",
    "publish_corpus": f"""WITH {DERIVED},
        pairs_l AS (SELECT pairs.doc_id, text_words, lang AS source FROM pairs JOIN documents USING (doc_id)),
        cls AS (SELECT source, count(*) AS n FROM pairs_l GROUP BY source),
        tot AS (SELECT sum(n)::BIGINT AS total, sum(n)::BIGINT - 20 AS train FROM cls),
        share AS (SELECT source, n, n * train // total AS base, n * train % total AS rest, train FROM cls, tot),
        quota AS (
          SELECT source, n - base - CASE WHEN row_number() OVER (ORDER BY rest DESC, source)
            <= train - sum(base) OVER () THEN 1 ELSE 0 END AS quota FROM share
        ),
        split AS (
          SELECT doc_id, text_words,
            row_number() OVER (PARTITION BY source ORDER BY {SAMPLE_KEY}, doc_id) <= quota AS is_test
          FROM pairs_l JOIN quota USING (source)
        ),
        train AS (
          SELECT text_words, row_number() OVER (ORDER BY {SAMPLE_KEY}, doc_id) AS k FROM split WHERE NOT is_test
        ),
        parts AS (
          SELECT 'pairs' AS part, text_words FROM pairs
          UNION ALL SELECT 'test', text_words FROM split WHERE is_test
          UNION ALL SELECT 'train_10', text_words FROM train WHERE k <= 10
          UNION ALL SELECT 'train_30', text_words FROM train WHERE k <= 30
          UNION ALL SELECT 'train_full', text_words FROM train
        )
        SELECT part, count(*) AS n, sum(text_words)::BIGINT AS words FROM parts GROUP BY part""",
    # --- summaries ---
    "extract_lead": f"WITH {DERIVED} SELECT doc_id, summary FROM led",
    "get_lead": f"WITH {LEADS} SELECT doc_id, summary FROM lead",
    "tfidf_summaries": f"WITH {TFIDF} SELECT doc_id, summary FROM tfidf",
    # --- profiles ---
    "row_count": "SELECT count(*) AS n FROM documents",
    "counts_by_source": "SELECT source, count(*) AS n FROM documents WHERE source IS NOT NULL GROUP BY source",
    "means_by_source": f"""SELECT source, round(avg({_words('text')}), 0) AS mean_words,
        round(avg(length(text)), 1) AS mean_chars FROM documents GROUP BY source""",
    "length_profile": f"""WITH m AS (SELECT lang, length(text) AS c, {_words('text')} AS w,
          length(string_split(text, chr(10))[1]) AS t FROM documents)
        SELECT lang, count(*) AS n,
          min(c) AS char_min, max(c) AS char_max, trunc(avg(c))::BIGINT AS char_mean,
          trunc(median(c))::BIGINT AS char_median, trunc(stddev_samp(c))::BIGINT AS char_std,
          min(w) AS word_min, max(w) AS word_max, trunc(avg(w))::BIGINT AS word_mean,
          trunc(median(w))::BIGINT AS word_median, trunc(stddev_samp(w))::BIGINT AS word_std,
          min(t) AS title_min, max(t) AS title_max, trunc(avg(t))::BIGINT AS title_mean
        FROM m GROUP BY lang""",
    "length_buckets": """SELECT lang, count(*) FILTER (length(text) < 500) AS short,
          count(*) FILTER (length(text) >= 500 AND length(text) < 2000) AS medium,
          count(*) FILTER (length(text) >= 2000 AND length(text) < 5000) AS long,
          count(*) FILTER (length(text) >= 5000) AS very_long
        FROM documents GROUP BY lang""",
    "top_categories": """SELECT lang, source AS category, count(*) AS n,
          row_number() OVER (PARTITION BY lang ORDER BY count(*) DESC, source) AS place
        FROM documents GROUP BY lang, source QUALIFY place <= 10""",
    "optional_category": """SELECT lang, source AS category, count(*) AS n, 1 AS n_reports FROM documents GROUP BY lang, source
        QUALIFY row_number() OVER (PARTITION BY lang ORDER BY count(*) DESC, source) <= 10""",
    "alignment_profile": f"""WITH {COSINES}, s AS (SELECT round(cosine, 3) AS score FROM nearest WHERE cosine >= 0.3)
        SELECT count(*) AS n_pairs, round(avg(score), 3) AS mean_score, round(median(score), 3) AS median_score,
          count(*) FILTER (score >= 0.40) AS ge_40, count(*) FILTER (score >= 0.35) AS ge_35,
          count(*) FILTER (score >= 0.30) AS ge_30 FROM s""",
    # --- order, splits, samples ---
    "stratified_split": f"""WITH {DERIVED},
        pairs_l AS (SELECT pairs.doc_id, lang FROM pairs JOIN documents USING (doc_id)),
        cls AS (SELECT lang, count(*) AS n FROM pairs_l GROUP BY lang),
        tot AS (SELECT sum(n)::BIGINT AS total, sum(n)::BIGINT - 60 AS train FROM cls),
        share AS (SELECT lang, n, n * train // total AS base, n * train % total AS rest, train FROM cls, tot),
        quota AS (
          SELECT lang, n - base - CASE WHEN row_number() OVER (ORDER BY rest DESC, lang)
            <= train - sum(base) OVER () THEN 1 ELSE 0 END AS quota FROM share
        )
        SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY {SAMPLE_KEY}, doc_id) <= quota AS is_test
        FROM pairs_l JOIN quota USING (lang)""",
    "nested_samples": f"""WITH {DERIVED}, r AS (SELECT doc_id, row_number() OVER (ORDER BY {SAMPLE_KEY}, doc_id) AS k FROM pairs)
        SELECT doc_id, CASE WHEN k <= 20 THEN 20 WHEN k <= 50 THEN 50 WHEN k <= 100 THEN 100 WHEN k <= 200 THEN 200 END
          AS smallest_sample FROM r""",
    "random_split": f"""WITH {DERIVED}, r AS (
          SELECT doc_id, row_number() OVER (ORDER BY {SAMPLE_KEY}, doc_id) AS k, count(*) OVER () AS n FROM pairs)
        SELECT doc_id, CASE WHEN k <= n * 8 // 10 THEN 'train' WHEN k <= n * 9 // 10 THEN 'val' ELSE 'test' END AS split
        FROM r""",
    "split_sizes_any_ids": """WITH cls AS (SELECT source, count(*) AS n FROM documents GROUP BY source),
        tot AS (SELECT sum(n)::BIGINT AS total, sum(n)::BIGINT - 60 AS train FROM cls),
        share AS (SELECT source, n, n * train // total AS base, n * train % total AS rest, train FROM cls, tot),
        quota AS (
          SELECT source, n - base - CASE WHEN row_number() OVER (ORDER BY rest DESC, source)
            <= train - sum(base) OVER () THEN 1 ELSE 0 END AS quota FROM share
        )
        SELECT 'train' AS split, total * 8 // 10 AS n FROM tot
        UNION ALL SELECT 'val', total * 9 // 10 - total * 8 // 10 FROM tot
        UNION ALL SELECT 'test', total - total * 9 // 10 FROM tot
        UNION ALL SELECT '50', 50 UNION ALL SELECT '120', 70 UNION ALL SELECT 'rest', total - 120 FROM tot
        UNION ALL SELECT 'test of ' || source, quota::BIGINT FROM quota WHERE quota > 0""",
    "row_ids_of_files": "SELECT doc_id, lang, row_number() OVER (ORDER BY doc_id) AS row_number FROM documents",
    "with_batch": "SELECT doc_id, (row_number() OVER (ORDER BY doc_id) - 1) // 40 AS batch FROM documents",
    "batch_requests": """WITH b AS (SELECT doc_id, (row_number() OVER (ORDER BY doc_id) - 1) // 50 AS batch FROM documents)
        SELECT batch, string_agg(doc_id::VARCHAR, '|' ORDER BY doc_id) AS request, count(*) AS n_ids FROM b GROUP BY batch""",
    "head_rows": "SELECT doc_id, lang, n_chars FROM documents ORDER BY doc_id LIMIT 50",
    "cap_rows": "SELECT doc_id, lang, n_chars FROM documents ORDER BY doc_id LIMIT 500",
    "crawl_tally": f"""WITH b AS (SELECT (row_number() OVER (ORDER BY doc_id) - 1) // 40 AS batch,
          {_words('text')} >= 150 AS ok FROM documents),
        t AS (SELECT batch, count(*) FILTER (ok) AS accepted, count(*) FILTER (NOT ok) AS skipped FROM b GROUP BY batch)
        SELECT *, (sum(accepted) OVER (ORDER BY batch))::BIGINT AS accepted_total FROM t""",
    # --- joins and sets ---
    "align_best": ALIGNED,
    "align_best_rings": ALIGNED,
    "align_buckets": """WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS x,
          list_transform(list_zip(embedding, list_reverse(embedding)), lambda p: p[1]::DOUBLE + p[2]::DOUBLE * 0.35) AS y
        FROM embeddings),
        s AS (SELECT a.vec_id AS left_id, b.vec_id AS right_id, list_cosine_similarity(a.x, b.y) AS cosine FROM v a, v b)
        SELECT left_id, right_id, round(cosine, 3) AS score FROM s WHERE cosine >= 0.85
        QUALIFY row_number() OVER (PARTITION BY left_id ORDER BY round(cosine, 9) DESC, right_id) = 1""",
    "align_buckets_recall": f"SELECT count(*) AS n_exact, true AS recall_reached FROM ({ALIGNED})",
    "attach_matches": f"""WITH {COSINES} SELECT left_id, right_id, 'label ' || a.label AS title_kk,
          'label ' || b.label AS title_ru, a.label AS text_kk, b.label AS text_ru, round(cosine, 3) AS score
        FROM nearest JOIN embeddings a ON a.vec_id = left_id JOIN embeddings b ON b.vec_id = right_id WHERE cosine >= 0.4""",
    "align_corpora": f"""WITH titles AS (SELECT doc_id, string_split(text, chr(10))[1] AS title FROM documents),
        {_gram_weights("titles", "title")},
        met AS (
          SELECT a.doc_id, b.doc_id AS other, sum(a.w * b.w) AS cosine FROM weights a JOIN weights b USING (place)
          WHERE a.doc_id % 2 = 0 AND b.doc_id % 2 = 1 GROUP BY ALL
        ),
        best AS (SELECT doc_id, max(cosine) AS cosine FROM met GROUP BY doc_id)
        SELECT title AS title_kk, round(cosine, 3) AS score FROM best JOIN titles USING (doc_id) WHERE cosine >= 0.4321""",
    "remaining_documents": "SELECT doc_id, lang FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)",
    "grow_done": "SELECT doc_id FROM labels UNION SELECT doc_id FROM documents WHERE n_chars > 2000",
    "attach_replies": """SELECT q.conv_id, q.turn, q.text AS cand, a.text AS ref FROM conversations q
        LEFT JOIN conversations a ON a.conv_id = q.conv_id AND a.turn = q.turn + 1 AND a.role = 'assistant'
        WHERE q.role = 'user'""",
    # --- predicates and projections ---
    "drop_null": "SELECT doc_id, lang, n_chars, quality, toxic FROM documents JOIN labels USING (doc_id) WHERE quality IS NOT NULL",
    "drop_empty": """SELECT conv_id, turn, CASE WHEN role = 'assistant' THEN role END AS mark FROM conversations
        WHERE role <> 'user'""",
    "min_words": f"SELECT doc_id FROM documents WHERE {_words('text')} >= 150",
    "select_existing": "SELECT doc_id, source, n_chars AS chars FROM documents",
    "url_filter": "SELECT page_id, url FROM pages WHERE contains(url, '/en/')",
    "valid_pairs": f"""WITH b AS (SELECT doc_id, {_lead_budget('text', 60)} AS cand, {_lead_sentences('text')} AS ref
        FROM documents) SELECT * FROM b WHERE cand <> '' AND ref <> ''""",
    "text_stats": f"SELECT doc_id, {_words('text')} AS word_count, length(text) AS char_count FROM documents",
    "classify_status": """WITH s AS (
          SELECT page_id, [200, 204, 301, 403, 404, 410, 429, 500, 503, NULL][page_id % 10 + 1] AS status FROM pages)
        SELECT page_id, status, CASE WHEN status IN (403, 404, 410) THEN 'drop' WHEN status BETWEEN 200 AND 399 THEN 'ok'
          ELSE 'retry' END AS route FROM s""",
    # --- sources and sinks ---
    "articles_jsonl": """SELECT doc_id::VARCHAR AS url, NULL::VARCHAR AS title, NULL::VARCHAR AS date, lang, source,
        md5(text) AS text_md5 FROM documents""",
    "pairs_csv": """SELECT doc_id, nullif(lang, 'fr') AS lang, NULL::VARCHAR AS note,
        md5('"' || text || '", \\') AS text_md5 FROM documents""",
    "write_bucketed": "SELECT doc_id AS id, lang, doc_id // 100 * 100 AS bucket FROM documents",
    "url_list": "SELECT url FROM pages",
    "sitemap_urls": """SELECT page_id // 50 AS seq, url FROM pages, range(CASE WHEN page_id = 50 THEN 2 ELSE 1 END)
        WHERE page_id // 50 < 3 AND contains(url, '/en/')""",
    "explode_pages": """SELECT doc_id AS id, CASE WHEN doc_id % 7 <> 0 THEN source ELSE '' END AS title,
          'https://x.example/?id=' || doc_id AS url, md5(text) AS text_md5
        FROM documents WHERE doc_id % 11 <> 0 AND length(text) >= 400""",
    "list_pages": """SELECT doc_id AS pageid, source AS title FROM documents
        WHERE doc_id % 3 = 0 AND lang <> 'fr' AND n_chars >= 500""",
    "harmonize": """SELECT 'web' AS source, NULL::VARCHAR AS title, url, NULL::VARCHAR AS date, NULL::VARCHAR AS category,
          'kk' AS lang, length(html) AS chars FROM pages
        UNION ALL SELECT source, NULL, doc_id::VARCHAR, NULL, NULL, lang, length(text) FROM documents""",
    "languages": "SELECT doc_id, lang, length(text) AS chars FROM documents",
    "stack_systems": f"""WITH {LEADS} SELECT doc_id, summary AS cand, 'lead' AS system FROM lead
        UNION ALL SELECT doc_id, {_lead_sentences('text', 1)}, 'first' FROM documents""",
    # --- metrics ---
    "rouge_n": f"""WITH {TFIDF}, {LEADS}, {TFIDF_OUTPUTS}, {_rouge('[a-z0-9]+')}
        SELECT pair_id, round(rouge1, 6) AS rouge1, round(rouge2, 6) AS rouge2 FROM rouge""",
    "rouge_n_unicode": f"""WITH {TFIDF}, {LEADS}, {TFIDF_OUTPUTS}, {_rouge('[\\p{L}\\p{N}]+')}
        SELECT pair_id, round(rouge1, 6) AS rouge1, round(rouge2, 6) AS rouge2 FROM rouge""",
    "rouge_l": f"""WITH {TFIDF}, {LEADS}, {TFIDF_OUTPUTS}, {LCS}
        SELECT pair_id, round(rougeL, 6) AS "rougeL" FROM lcs""",
    "sentence_bleu": f"""WITH {TFIDF}, {LEADS}, {TFIDF_OUTPUTS}, {BLEU} SELECT pair_id, round(bleu, 6) AS bleu FROM bleu""",
    "sentence_chrf": f"""WITH {TFIDF}, {LEADS}, {TFIDF_OUTPUTS}, {CHRF} SELECT pair_id, round(chrf, 6) AS chrf FROM chrf""",
    "leaderboard": f"""WITH {TFIDF}, {LEADS}, {ALL_OUTPUTS}, {_rouge('[a-z0-9]+')}, {BLEU}, {CHRF}
        SELECT system, round(avg(rouge1), 3) AS rouge1, round(avg(rouge2), 3) AS rouge2, round(avg(bleu), 1) AS bleu,
          round(avg(chrf), 1) AS chrf, count(*) AS n_pairs
        FROM rouge JOIN bleu USING (system, pair_id) JOIN chrf USING (system, pair_id) GROUP BY system""",
    "evaluate_systems": f"""WITH {TFIDF}, {LEADS}, {ALL_OUTPUTS}, {_rouge('[a-z0-9]+')}, {LCS}, {BLEU}, {CHRF}, {BERTSCORE}
        SELECT system, round(avg(rouge1), 3) AS rouge1, round(avg(rouge2), 3) AS rouge2, round(avg(rougeL), 3) AS "rougeL",
          round(avg(bleu), 1) AS bleu, round(avg(chrf), 1) AS chrf, round(avg(f1), 3) AS bertscore, count(*) AS n_pairs
        FROM rouge JOIN lcs USING (system, pair_id) JOIN bleu USING (system, pair_id) JOIN chrf USING (system, pair_id)
        LEFT JOIN (SELECT s.system, pr.pair_id, pr.f1 FROM pr, (VALUES ('lead'), ('tfidf')) AS s(system)) b
          USING (system, pair_id)
        GROUP BY system""",
    "bertscore_match": f"""WITH {BERTSCORE} SELECT pair_id, round(precision, 6) AS precision, round(recall, 6) AS recall,
        round(f1, 6) AS f1 FROM pr""",
    "bertscore_means": f"""WITH {BERTSCORE} SELECT round(avg(precision), 6) AS precision, round(avg(recall), 6) AS recall,
        round(avg(f1), 6) AS f1 FROM pr""",
    # --- pages ---
    "extract_news": f"""WITH a AS (
          SELECT url, regexp_extract(html, '<h1>(.*?)</h1>', 1, 's') AS h1,
            regexp_replace(regexp_extract(html, '<article>(.*?)</article>', 1, 's'), '<h1>.*?</h1>', '', 's') AS inner_html
          FROM pages WHERE contains(url, '/en/')),
        b AS (
          SELECT url, array_to_string(list_filter(list_transform(
              string_split(regexp_replace(h1, '<[^>]+>', chr(1), 'g'), chr(1)),
              lambda s: {_strip("replace(replace(s, '&quot;', '\"'), '&amp;', '&')")}), lambda s: s <> ''), '') AS title,
            array_to_string(list_filter(list_transform(
              string_split(regexp_replace(inner_html, '<[^>]+>', chr(1), 'g'), chr(1)),
              lambda s: {_strip("replace(replace(s, '&quot;', '\"'), '&amp;', '&')")}), lambda s: s <> ''), chr(10)) AS body
          FROM a)
        SELECT url, title, '' AS date, '' AS author, '' AS category, body, {_words('body')} AS word_count,
          length(body) AS char_count, 'web' AS source, 'xx' AS language
        FROM b WHERE title <> '' AND {_words('body')} >= 150""",
    "extract_news_fields": f"""WITH a AS (
          SELECT page_id AS n, url, regexp_extract(html, '<h1>(.*?)</h1>', 1, 's') AS h1,
            regexp_replace(regexp_extract(html, '<article>(.*?)</article>', 1, 's'), '<h1>.*?</h1>', '', 's') AS inner_html
          FROM pages WHERE contains(url, '/en/')),
        b AS (
          SELECT n, url, array_to_string(list_filter(list_transform(
              string_split(regexp_replace(h1, '<[^>]+>', chr(1), 'g'), chr(1)),
              lambda s: {_strip("replace(replace(s, '&quot;', '\"'), '&amp;', '&')")}), lambda s: s <> ''), '') AS title,
            array_to_string(list_filter(list_transform(
              string_split(regexp_replace(inner_html, '<[^>]+>', chr(1), 'g'), chr(1)),
              lambda s: {_strip("replace(replace(s, '&quot;', '\"'), '&amp;', '&')")}), lambda s: s <> ''), chr(10)) AS body
          FROM a)
        SELECT url, CASE WHEN n % 4 = 0 THEN 'Og <' || n ELSE title END AS title,
          CASE WHEN n % 3 = 0 THEN '5May' || n WHEN n % 2 = 0 THEN '2024-01-' || (n % 28 + 1) ELSE '' END AS date,
          'A&' || n AS author, 'c' || (n % 7) AS category, {_words('body')} AS word_count
        FROM b WHERE (n % 4 = 0 OR title <> '') AND {_words('body')} >= 150""",
    "extract_body": f"""WITH t AS (SELECT page_id, regexp_extract(html, '<div class="ad">(.*?)</div>', 1, 's') AS text,
          contains(html, '<div class="ad">') AS found FROM pages)
        SELECT page_id, {_strip("replace(replace(text, '&quot;', '\"'), '&amp;', '&')")} AS text FROM t WHERE found""",
    "crawl_round": f"""WITH s AS (
          SELECT url, page_id, html, [200, 204, 301, 403, 404, 410, 429, 500, 503, NULL][page_id % 10 + 1] AS status FROM pages),
        before AS (SELECT url FROM s WHERE page_id % 5 = 0),
        f AS (SELECT * FROM s WHERE contains(url, '/en/') AND url NOT IN (SELECT url FROM before)),
        a AS (
          SELECT url, regexp_extract(html, '<h1>(.*?)</h1>', 1, 's') AS h1,
            regexp_replace(regexp_extract(html, '<article>(.*?)</article>', 1, 's'), '<h1>.*?</h1>', '', 's') AS inner_html
          FROM f WHERE status BETWEEN 200 AND 399),
        b AS (
          SELECT url, array_to_string(list_filter(list_transform(
              string_split(regexp_replace(h1, '<[^>]+>', chr(1), 'g'), chr(1)), lambda s: {_strip("s")}),
              lambda s: s <> ''), '') AS title,
            array_to_string(list_filter(list_transform(
              string_split(regexp_replace(inner_html, '<[^>]+>', chr(1), 'g'), chr(1)), lambda s: {_strip("s")}),
              lambda s: s <> ''), chr(10)) AS body
          FROM a)
        SELECT 'article' AS kind, url FROM b WHERE title <> '' AND {_words('body')} >= 150
        UNION ALL SELECT 'done', url FROM (
          SELECT url FROM before UNION SELECT url FROM f WHERE status BETWEEN 200 AND 399 OR status IN (403, 404, 410))
        UNION ALL SELECT 'retry', url FROM f
          WHERE status IS NULL OR NOT (status BETWEEN 200 AND 399 OR status IN (403, 404, 410))""",
    # --- inference ---
    "generate": """SELECT doc_id, md5(CASE WHEN contains(text, '|') THEN ''
        ELSE array_to_string(list_reverse(string_split(text, ' ')), ' ') END) AS generated_md5 FROM documents""",
    "generate_prefixed": """SELECT doc_id, md5(CASE WHEN contains(text, '|') THEN ''
        ELSE array_to_string(list_reverse(string_split('summarize: ' || text, ' ')), ' ') END) AS generated_md5
        FROM documents""",
    "encode_texts": """SELECT doc_id, length(text)::DOUBLE AS v0, (length(text) - length(replace(text, ' ', '')))::DOUBLE AS v1,
        (length(text) - length(replace(text, chr(10), '')))::DOUBLE AS v2 FROM documents""",
    "encode_default": f"""WITH {_gram_weights("documents", "text")}
        SELECT doc_id, count(*) AS n_places, round(sum((place + 1) * w * w), 2) AS centre FROM weights GROUP BY doc_id""",
    "system_outputs": f"""WITH {TFIDF}, {LEADS}, fed AS (
          SELECT 'identity' AS system, doc_id, summary AS cand FROM lead
          UNION ALL SELECT 'lead_reversed', doc_id, CASE WHEN contains(summary, '|') THEN ''
            ELSE array_to_string(list_reverse(string_split(summary, ' ')), ' ') END FROM lead
          UNION ALL SELECT 'tfidf_reversed', doc_id, CASE WHEN contains(summary, '|') THEN ''
            ELSE array_to_string(list_reverse(string_split(summary, ' ')), ' ') END FROM tfidf)
        SELECT fed.doc_id AS pair_id, system, cand, lead.summary AS ref FROM fed JOIN lead USING (doc_id)""",
    # --- streaming ---
    "ingest_stream": f"""WITH won AS (
          SELECT * FROM documents QUALIFY row_number() OVER (PARTITION BY n_chars ORDER BY doc_id % 3, doc_id) = 1),
        c AS (SELECT doc_id, lang, {_clean('text')} AS t FROM won)
        SELECT doc_id, lang, length(t) AS chars FROM c WHERE {_words('t')} >= 150""",
    "snapshot_stream": "SELECT doc_id, quality::VARCHAR AS text FROM labels WHERE quality IS NOT NULL",
}
