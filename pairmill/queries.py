"""Named queries: each operator over whole tables of the given data folder.

Where the given tables lack an input (markup, sitemaps, interface answers), it is packed from them inside the query.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairmill.functions import text as tx
from pairmill.functions.html import Element
from pairmill.operators import align as al
from pairmill.operators import bertscore as bs
from pairmill.operators import columns as co
from pairmill.operators import infer as nf
from pairmill.operators import metrics as me
from pairmill.operators import ordering as od
from pairmill.operators import pages as pg
from pairmill.operators import pairs as pr
from pairmill.operators import profile as pf
from pairmill.operators import sampling as sp
from pairmill.operators.summarize import tfidf_summary
from pairmill.plans import align as pl
from pairmill.plans import crawl as cr
from pairmill.plans import evaluate as ev
from pairmill.plans import prepare as pp
from pairmill.plans import publish as pb
from pairmill.session import freeze, scratch
from pairmill.sources import files as fl
from pairmill.sources import web
from pairmill.streaming import ingest as st

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

# The pages of the given data keep their text in <article>; the addresses have no /article/ part.
PAGE_CONTAINER = Element(tag="article")
PAGE_NOISE = (Element(tag="script"), Element(tag="style"), Element(tag="h1"), Element(cls="ad"))
# The given vectors lie far apart, so the alignment thresholds are lower than for title embeddings.
ALIGN_THRESHOLD = 0.4
PROFILE_THRESHOLD = 0.3


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str, *cols: str) -> DataFrame:
    return co.spread(table(spark, sf_dir, "documents").select(*(cols or ("doc_id", "text", "lang", "source"))))


def kept_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs after filter and deduplication, written once because splits read them several times."""
    return freeze(pp.clean_pairs(documents(spark, sf_dir)).select("doc_id", "lang"))


# --- preparation ------------------------------------------------------------------------------


@query
def clean_pairs(spark, sf):
    pairs = pp.clean_pairs(documents(spark, sf, "doc_id", "text", "source"))
    return pairs.select(
        "doc_id", "source", "summary", "text_words", "summary_words",
        F.md5(F.col("text_clean").cast("binary")).alias("text_md5"),
        F.round("compression", 6).alias("compression"),
    )


@query
def source_report(spark, sf):
    return pp.source_report(pp.clean_pairs(documents(spark, sf, "doc_id", "text", "source")))


@query
def attrition_report(spark, sf):
    return pr.quality_report(pr.derive_pairs(documents(spark, sf, "doc_id", "text", "source")))


@query
def quality_filter_exempt(spark, sf):
    derived = pr.derive_pairs(documents(spark, sf, "doc_id", "text", "source"))
    return pr.quality_filter(derived, exempt_sources=("src1",)).select("doc_id", "text_words", "summary_words")


@query
def strip_wiki_markup(spark, sf):
    """Documents wrapped in every kind of markup, one half of the sources named as markup sources."""
    wrapped = F.concat(
        F.lit("__NOTOC__{{box|"), F.col("source"), F.lit("}}{| class=x\n| cell\n|}[["), F.col("lang"), F.lit("|"),
        F.col("source"), F.lit("]] [https://a.example/b label] [https://c.example/d] == Head ==\n| row\n*#\n<b>"),
        F.col("text"), F.lit("</b>&nbsp;&#39; https://e.example/f\nend"),
    )
    docs = documents(spark, sf)
    cleaned = tx.clean_text(wrapped, F.col("source"), tuple(f"src{i}" for i in range(0, 20, 2)))
    return docs.select("doc_id", cleaned.alias("text_clean"))


@query
def derived_columns(spark, sf):
    derived = pr.derive_pairs(documents(spark, sf, "doc_id", "text", "source"))
    return derived.select("doc_id", "text_words", "summary_words", F.round("compression", 6).alias("compression"))


@query
def drop_duplicates(spark, sf):
    return pr.drop_duplicates(documents(spark, sf, "doc_id", "text"), "text", "doc_id").select("doc_id")


@query
def first_copies(spark, sf):
    firsts = pr.first_copies(documents(spark, sf, "doc_id", "text", "lang"), "text", "doc_id")
    return firsts.select("doc_id", "lang", F.md5(F.col("text").cast("binary")).alias("text_md5"))


@query
def publish_corpus(spark, sf):
    """The whole preparation with languages as sources, run twice; rows and words of each output of the version that counts."""
    out = scratch(spark, "corpus")
    articles = table(spark, sf, "documents").select("doc_id", "text", F.col("lang").alias("source"))
    for _ in range(2):
        pb.publish_corpus(articles, out, test_size=20, sizes=(10, 30))
    folder = pb.current(spark, out)
    columns = "text string, summary string, source string, text_words long, summary_words long"
    parts = {"pairs": spark.read.parquet(f"{folder}/pairs")}
    parts |= {name: fl.read_pairs_csv(spark, f"{folder}/{name}", columns) for name in ("test", "train_10", "train_30", "train_full")}
    counts = [
        part.agg(F.count("*").alias("n"), F.sum("text_words").cast("long").alias("words")).withColumn("part", F.lit(name))
        for name, part in parts.items()
    ]
    return reduce(DataFrame.union, counts)


# --- summaries --------------------------------------------------------------------------------


@query
def extract_lead(spark, sf):
    docs = documents(spark, sf, "doc_id", "text")
    return docs.select("doc_id", tx.extract_lead(tx.clean_text("text")).alias("summary"))


@query
def get_lead(spark, sf):
    return documents(spark, sf, "doc_id", "text").select("doc_id", tx.get_lead("text").alias("summary"))


@query
def tfidf_summaries(spark, sf):
    return tfidf_summary(documents(spark, sf, "doc_id", "text")).select("doc_id", "summary")


# --- profiles ---------------------------------------------------------------------------------


def titled(spark: SparkSession, sf: str) -> DataFrame:
    """Documents with the first line as title and the source as category."""
    return documents(spark, sf).select(
        "doc_id", "lang", "text", F.substring_index("text", "\n", 1).alias("title"), F.col("source").alias("category")
    )


@query
def row_count(spark, sf):
    return pf.row_count(table(spark, sf, "documents"))


@query
def counts_by_source(spark, sf):
    return pf.counts_by(table(spark, sf, "documents"), "source")


@query
def means_by_source(spark, sf):
    docs = documents(spark, sf, "source", "text")
    measured = docs.select("source", tx.word_count("text").alias("words"), F.length("text").alias("chars"))
    return pf.means_by(measured, "source", {"words": 0, "chars": 1})


@query
def length_profile(spark, sf):
    return pf.length_profile(titled(spark, sf))


@query
def length_buckets(spark, sf):
    return pf.length_buckets(table(spark, sf, "documents"))


@query
def top_categories(spark, sf):
    return pf.top_categories(titled(spark, sf))


@query
def optional_category(spark, sf):
    """The category report for tables with and without that column."""
    docs = table(spark, sf, "documents")
    reports = (pf.top_categories(docs), pf.top_categories(docs.withColumnRenamed("source", "category")))
    present = [r for r in reports if r is not None]
    return present[0].select("lang", "category", "n").withColumn("n_reports", F.lit(len(present)))


@query
def alignment_profile(spark, sf):
    matches = al.align_best(*vectors(spark, sf), threshold=PROFILE_THRESHOLD)
    return pf.alignment_profile(matches, cuts=(0.40, 0.35, 0.30))


# --- order, splits, samples -------------------------------------------------------------------


@query
def stratified_split(spark, sf):
    return sp.stratified_split(kept_pairs(spark, sf), "lang", "doc_id", test_size=60)


@query
def nested_samples(spark, sf):
    return sp.nested_samples(kept_pairs(spark, sf), "doc_id", sizes=(20, 50, 100, 200, 10**9)).drop("lang")


@query
def random_split(spark, sf):
    return sp.random_split(kept_pairs(spark, sf), "doc_id").drop("lang")


@query
def split_sizes_any_ids(spark, sf):
    """Parts of documents under an id that is NULL in a third of the rows and repeats in the others."""
    unsure = F.when(F.col("doc_id") % 3 != 0, F.col("doc_id") % 50)
    docs = table(spark, sf, "documents").select("doc_id", "source", unsure.alias("url"))
    parts = sp.random_split(docs, "url").groupBy("split").agg(F.count("*").alias("n"))
    sample = sp.nested_samples(docs, "url", [50, 120]).groupBy("smallest_sample").agg(F.count("*").alias("n"))
    test = sp.stratified_split(docs, "source", "url", 60).filter("is_test").groupBy("source").agg(F.count("*").alias("n"))
    sample = sample.select(F.coalesce(F.col("smallest_sample").cast("string"), F.lit("rest")).alias("split"), "n")
    return parts.union(sample).union(test.select(F.concat(F.lit("test of "), "source").alias("split"), "n"))


@query
def row_ids_of_files(spark, sf):
    """Documents written as ordered JSON lines and numbered by their place in the files."""
    path = scratch(spark, "rows")
    table(spark, sf, "documents").select("doc_id", "lang").orderBy("doc_id").write.json(path)
    lines = od.file_order(fl.read_articles_jsonl(spark, path, "doc_id long, lang string"))
    return od.global_row_number(lines, ["file_order"]).select("doc_id", "lang", "row_number")


@query
def with_batch(spark, sf):
    return od.with_batch(table(spark, sf, "documents").select("doc_id"), 40, ["doc_id"])


@query
def batch_requests(spark, sf):
    return od.batch_requests(table(spark, sf, "documents"), "doc_id", 50)


@query
def head_rows(spark, sf):
    return co.head(table(spark, sf, "documents").select("doc_id", "lang", "n_chars"), 50, "doc_id")


@query
def cap_rows(spark, sf):
    return co.cap(table(spark, sf, "documents").select("doc_id", "lang", "n_chars"), 500, "doc_id")


@query
def crawl_tally(spark, sf):
    docs = documents(spark, sf, "doc_id", "text")
    return od.crawl_tally(docs, tx.word_count("text") >= 150, ["doc_id"], 40)


# --- joins and sets ---------------------------------------------------------------------------


def vectors(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Even vectors as the left corpus, odd ones as the right corpus."""
    vecs = table(spark, sf, "embeddings").withColumnRenamed("vec_id", "id")
    return vecs.filter("id % 2 = 0"), vecs.filter("id % 2 = 1")


@query
def align_best(spark, sf):
    return al.align_best(*vectors(spark, sf), threshold=ALIGN_THRESHOLD)


@query
def align_best_rings(spark, sf):
    """The same alignment in the form for right sides that are too large to broadcast: a grid of blocks."""
    return al.align_best(*vectors(spark, sf), threshold=ALIGN_THRESHOLD, max_broadcast_bytes=0, block_bytes=1 << 16)


def turned(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """All vectors, and as the other corpus each of them turned by about twenty degrees."""
    left = table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    mixed = F.zip_with("embedding", F.reverse("embedding"), lambda x, y: x.cast("double") + y.cast("double") * 0.35)
    return left, left.select("id", mixed.alias("embedding"))


@query
def align_buckets(spark, sf):
    """Buckets at the threshold of titles; a pair at 0.85 is missed once in 50 times, one at 0.94 once in 100,000."""
    return al.align_buckets(*turned(spark, sf), recall=0.98)


@query
def align_buckets_recall(spark, sf):
    """How many matches of the exact form the buckets find among vectors that lie far apart."""
    sides = vectors(spark, sf)
    found = al.align_buckets(*sides, threshold=ALIGN_THRESHOLD, bits=4)
    measured = al.alignment_recall(found, al.align_best(*sides, threshold=ALIGN_THRESHOLD))
    return measured.select("n_exact", (F.col("recall") >= 0.9).alias("recall_reached"))


@query
def attach_matches(spark, sf):
    left, right = (
        v.select("id", "embedding", F.concat(F.lit("label "), F.col("label")).alias("title"), F.col("label").alias("text"))
        for v in vectors(spark, sf)
    )
    return al.attach_matches(al.align_best(left, right, threshold=ALIGN_THRESHOLD), left, right)


def headed(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Even documents as one corpus, odd ones as the other, with the first line as title."""
    docs = documents(spark, sf, "doc_id", "text")
    docs = docs.select(F.col("doc_id").alias("id"), F.substring_index("text", "\n", 1).alias("title"), "text")
    return docs.filter("id % 2 = 0"), docs.filter("id % 2 = 1")


@query
def align_corpora(spark, sf):
    """Titles of two corpora matched by the encoder that needs no model."""
    return pl.align_corpora(*headed(spark, sf), threshold=0.4321).select("title_kk", "score")


@query
def remaining_documents(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "lang")
    return co.remaining(docs, table(spark, sf, "labels"), "doc_id")


@query
def grow_done(spark, sf):
    long_docs = table(spark, sf, "documents").filter("n_chars > 2000")
    return co.grow_done(table(spark, sf, "labels"), long_docs, "doc_id")


@query
def attach_replies(spark, sf):
    """User turns with the assistant turn that follows, joined by key."""
    turns = table(spark, sf, "conversations")
    key = F.concat_ws("/", "conv_id", F.col("turn") + 1).alias("key")
    asked = turns.filter("role = 'user'").select(key, "conv_id", "turn", F.col("text").alias("cand"))
    replies = turns.filter("role = 'assistant'").select(
        F.concat_ws("/", "conv_id", "turn").alias("key"), F.col("text").alias("ref")
    )
    return co.attach(asked, replies, "key", "left").drop("key")


# --- predicates and projections ---------------------------------------------------------------


def labelled(spark: SparkSession, sf: str) -> DataFrame:
    return co.attach(
        table(spark, sf, "documents").select("doc_id", "lang", "n_chars"), table(spark, sf, "labels"), "doc_id"
    )


@query
def drop_null(spark, sf):
    return co.drop_null(labelled(spark, sf), ["quality"])


@query
def drop_empty(spark, sf):
    """Roles as text, '' for user turns: '' goes, NULL stays."""
    turns = table(spark, sf, "conversations")
    marked = F.when(F.col("role") == "user", "").when(F.col("role") == "assistant", F.col("role"))
    return co.drop_empty(turns.select("conv_id", "turn", marked.alias("mark")), ["mark"])


@query
def min_words(spark, sf):
    return pr.min_words(documents(spark, sf, "doc_id", "text"), "text", 150).select("doc_id")


@query
def select_existing(spark, sf):
    docs = table(spark, sf, "documents").withColumnRenamed("n_chars", "chars")
    return co.select_existing(docs, ["doc_id", "source", "title", "chars", "text_words"])


@query
def url_filter(spark, sf):
    return pg.url_filter(table(spark, sf, "pages").select("page_id", "url"), "url", "/en/")


@query
def valid_pairs(spark, sf):
    docs = documents(spark, sf, "doc_id", "text")
    both = docs.select("doc_id", tx.get_lead("text", 60).alias("cand"), tx.extract_lead("text").alias("ref"))
    both = co.compute_once(both, cand=F.col("cand"), ref=F.col("ref"))
    return pr.valid_pairs(both)


@query
def text_stats(spark, sf):
    return pg.text_stats(documents(spark, sf, "doc_id", "text")).select("doc_id", "word_count", "char_count")


@query
def classify_status(spark, sf):
    """Statuses derived from page ids."""
    codes = F.array(*(F.lit(c) for c in (200, 204, 301, 403, 404, 410, 429, 500, 503)), F.lit(None).cast("int"))
    pages = table(spark, sf, "pages").select("page_id", codes[(F.col("page_id") % 10).cast("int")].alias("status"))
    return pg.classify_status(pages)


# --- sources and sinks ------------------------------------------------------------------------


@query
def articles_jsonl(spark, sf):
    """Documents appended to JSON lines in two runs, read back with the fixed schema."""
    path = scratch(spark, "jsonl")
    docs = table(spark, sf, "documents").select(
        "source", F.lit(None).cast("string").alias("title"), F.col("doc_id").cast("string").alias("url"), "text", "lang"
    )
    fl.append_articles_jsonl(docs.filter("lang = 'en'"), path)
    fl.append_articles_jsonl(docs.filter("lang <> 'en'"), path)
    back = fl.read_articles_jsonl(spark, path)
    return back.select("url", "title", "date", "lang", "source", F.md5(F.col("text").cast("binary")).alias("text_md5"))


@query
def pairs_csv(spark, sf):
    """Multi-line texts through CSV and back; '' comes back as NULL."""
    path = scratch(spark, "csv")
    quoted = F.concat(F.lit('"'), F.col("text"), F.lit('", \\'))
    docs = table(spark, sf, "documents").select("doc_id", "lang", quoted.alias("text"), F.lit("").alias("note"))
    fl.write_csv(docs, path)
    back = fl.read_pairs_csv(spark, path, docs.schema, na_values=("fr",))
    return back.select("doc_id", "lang", "note", F.md5(F.col("text").cast("binary")).alias("text_md5"))


@query
def write_bucketed(spark, sf):
    path = scratch(spark, "buckets")
    fl.write_bucketed(table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "lang"), path, width=100)
    return spark.read.schema("id long, lang string, bucket long").json(path)


@query
def url_list(spark, sf):
    path = scratch(spark, "urls")
    pages = table(spark, sf, "pages").select(F.concat(F.lit("  "), F.col("url"), F.lit("\t\n \n")).alias("url"))
    fl.write_url_list(pages, path)
    return fl.read_url_list(spark, path)


@query
def sitemap_urls(spark, sf):
    """Sitemaps of 50 pages each (by page id), the fourth one missing; the second one holds bare ampersands and a tag that
    is not closed, and names its first page twice."""
    pages = table(spark, sf, "pages")
    escaped = F.when(F.col("page_id").between(50, 99), F.col("url")).otherwise(F.replace("url", F.lit("&"), F.lit("&amp;")))
    loc = F.concat(F.lit("<url><loc> "), escaped, F.lit(" </loc>"), F.when(F.col("page_id") == 50, "<b>").otherwise("</url>"))
    loc = F.when(F.col("page_id") == 50, F.concat(loc, loc)).otherwise(loc)
    maps = pages.groupBy(F.floor(F.col("page_id") / 50).alias("seq")).agg(F.array_join(F.collect_list(loc), "").alias("locs"))
    xml = F.concat(F.lit('<urlset xmlns="http://www.sitemaps.org/schemas/sitemap/0.9">'), F.col("locs"), F.lit("</urlset>"))
    maps = maps.select("seq", F.when(F.col("seq") != 3, xml).alias("xml"))
    return web.sitemap_urls(maps, "/en/")


@query
def explode_pages(spark, sf):
    """Interface answers of 50 documents each: some pages marked missing, some without title."""
    docs = table(spark, sf, "documents")
    page = F.struct(
        F.when(F.col("doc_id") % 7 != 0, F.col("source")).alias("title"),
        F.concat(F.lit("https://x.example/?id="), F.col("doc_id")).alias("fullurl"),
        F.col("text").alias("extract"),
        F.when(F.col("doc_id") % 11 == 0, "").alias("missing"),
    )
    entry = F.struct(F.col("doc_id").cast("string").alias("key"), page.alias("value"))
    answers = docs.groupBy(F.floor(F.col("doc_id") / 50)).agg(F.map_from_entries(F.collect_list(entry)).alias("pages"))
    response = F.to_json(F.struct(F.struct("pages").alias("query")))
    articles = web.explode_pages(answers.select(response.alias("response")), min_chars=400)
    return articles.select("id", "title", "url", F.md5(F.col("text").cast("binary")).alias("text_md5"))


@query
def list_pages(spark, sf):
    listing = table(spark, sf, "documents").select(
        F.col("doc_id").alias("pageid"), F.col("source").alias("title"), (F.col("doc_id") % 3).alias("ns"),
        (F.col("lang") == "fr").alias("redirect"), F.col("n_chars").alias("size"),
    )
    return web.list_pages(listing)


@query
def harmonize(spark, sf):
    """Pages as a news crawl, documents as a corpus with other column names."""
    news = table(spark, sf, "pages").select("url", F.col("html").alias("body"), F.lit("kk").alias("language"))
    docs = table(spark, sf, "documents").select("doc_id", "text", "source", "lang")
    corpus = fl.harmonize(
        (news, {"body": "text", "language": "lang"}, {"source": "web"}),
        (docs, {"doc_id": "url"}, {}),
    )
    return corpus.select("source", "title", "url", "date", "category", "lang", F.length("text").alias("chars"))


@query
def languages(spark, sf):
    """One CSV folder per language, read back with the language from the folder name."""
    path = scratch(spark, "langs")
    docs = table(spark, sf, "documents").select("doc_id", "text", "lang")
    fl.write_languages(docs, path)
    back = fl.read_languages(spark, f"{path}/lang={{lang}}", ("de", "en", "es", "fr"), "doc_id long, text string")
    return back.select("doc_id", "lang", F.length("text").alias("chars"))


@query
def stack_systems(spark, sf):
    docs = documents(spark, sf, "doc_id", "text")
    return co.stack_systems(
        lead=docs.select("doc_id", tx.get_lead("text").alias("cand")),
        first=docs.select("doc_id", tx.extract_lead("text", n=1).alias("cand")),
    )


# --- metrics ----------------------------------------------------------------------------------


def outputs(spark: SparkSession, sf: str) -> DataFrame:
    """Lead, TF-IDF and identity as systems, against the lead of the text as reference."""
    systems = {"identity": ("identity", None, {}), "lead": ("lead", None, {}), "tfidf": ("tfidf", None, {})}
    return ev.system_outputs(documents(spark, sf, "doc_id", "text"), "doc_id", "text", "text", systems)


def tfidf_outputs(spark: SparkSession, sf: str) -> DataFrame:
    systems = {"tfidf": ("tfidf", None, {})}
    return ev.system_outputs(documents(spark, sf, "doc_id", "text"), "doc_id", "text", "text", systems)


def scores(spark: SparkSession, sf: str, *metrics: str, tokenizer: str = "ascii") -> DataFrame:
    scored = me.pair_scores(tfidf_outputs(spark, sf), metrics, tokenizer=tokenizer)
    return scored.select("pair_id", *(F.round(m, 6).alias(m) for m in metrics))


@query
def rouge_n(spark, sf):
    return scores(spark, sf, "rouge1", "rouge2")


@query
def rouge_n_unicode(spark, sf):
    return scores(spark, sf, "rouge1", "rouge2", tokenizer="unicode")


@query
def rouge_l(spark, sf):
    return scores(spark, sf, "rougeL")


@query
def sentence_bleu(spark, sf):
    return scores(spark, sf, "bleu")


@query
def sentence_chrf(spark, sf):
    return scores(spark, sf, "chrf")


@query
def leaderboard(spark, sf):
    scored = me.pair_scores(outputs(spark, sf), ("rouge1", "rouge2", "bleu", "chrf"))
    return me.leaderboard(scored)


@query
def evaluate_systems(spark, sf):
    """All metrics of all systems, with token vectors from the embeddings table for two of them."""
    tokens = token_vectors(spark, sf).withColumn("system", F.explode(F.array(F.lit("lead"), F.lit("tfidf"))))
    return ev.evaluate(outputs(spark, sf), tokens)


def token_vectors(spark: SparkSession, sf: str) -> DataFrame:
    """Ten vectors per pair: even ones are candidate tokens, odd ones reference tokens."""
    return table(spark, sf, "embeddings").select(
        F.floor(F.col("vec_id") / 10).alias("pair_id"),
        F.when(F.col("vec_id") % 2 == 0, "cand").otherwise("ref").alias("side"),
        F.col("vec_id").alias("pos"),
        F.col("embedding").alias("vec"),
    )


def _rounded(df: DataFrame) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in ("precision", "recall", "f1")})


@query
def bertscore_match(spark, sf):
    return _rounded(bs.bertscore_match(token_vectors(spark, sf)))


@query
def bertscore_means(spark, sf):
    return _rounded(bs.bertscore_means(bs.bertscore_match(token_vectors(spark, sf))))


# --- pages ------------------------------------------------------------------------------------


@query
def extract_news(spark, sf):
    pages = co.spread(table(spark, sf, "pages"))
    return pg.extract_news(
        pages, source="web", language="xx", url_part="/en/", container=PAGE_CONTAINER, noise=PAGE_NOISE
    )


@query
def extract_news_fields(spark, sf):
    """News whose pages carry every field: each page gets an author, a section, a title in its head and, some of them, one
    of the two kinds of date; every fourth loses its heading, so that its title comes from the head."""
    page, n = F.col("html"), F.col("page_id")
    head = F.concat(
        F.lit('<head><meta name="author" content=" A&amp;'), n, F.lit(' "><META content=c'), n % 7,
        F.lit(' property=article:section><meta property="og:title" content="Og &lt;'), n, F.lit('">'),
        F.when(n % 2 == 0, F.concat(F.lit("<meta content='2024-01-"), n % 28 + 1, F.lit("' property='article:published_time'>")))
        .otherwise(""),
    )
    body = F.concat(F.lit("<body>"), F.when(n % 3 == 0, F.concat(F.lit('<i class="x news-date"> 5 <b>May</b> '), n, F.lit("</i>"))).otherwise(""))
    headless = F.when(n % 4 == 0, F.regexp_replace(page, "(?s)<h1>.*?</h1>", "<h1> <b></b></h1>")).otherwise(page)
    marked = F.replace(F.replace(headless, F.lit("<head>"), head), F.lit("<body>"), body)
    pages = co.spread(table(spark, sf, "pages")).withColumn("html", marked)
    news = pg.extract_news(pages, "web", "xx", url_part="/en/", container=PAGE_CONTAINER, noise=PAGE_NOISE)
    return news.select("url", "title", "date", "author", "category", "word_count")


@query
def extract_body(spark, sf):
    pages = co.spread(table(spark, sf, "pages"))
    texts = pg.extract_body(pages, container=Element(tag="div", cls="ad"))
    return co.drop_null(texts.select("page_id", "text"), ["text"])


@query
def crawl_round(spark, sf):
    """A round over pages of one section, a fifth of them done before, with statuses derived from page ids."""
    codes = F.array(*(F.lit(c) for c in (200, 204, 301, 403, 404, 410, 429, 500, 503)), F.lit(None).cast("int"))
    pages = co.spread(table(spark, sf, "pages")).withColumn("status", codes[(F.col("page_id") % 10).cast("int")])
    done = pages.filter("page_id % 5 = 0").select("url")
    queue = cr.crawl_queue(pages, done, "/en/")
    fetched = pages.select("url", "status", "html")
    made = cr.crawl_round(queue, fetched, done, "web", "xx", url_part="/en/", container=PAGE_CONTAINER, noise=PAGE_NOISE)
    kinds = {"article": made.articles, "done": made.done, "retry": made.retry}
    return reduce(DataFrame.union, (df.select(F.lit(kind).alias("kind"), "url") for kind, df in kinds.items()))


# --- inference --------------------------------------------------------------------------------


def reverser(fail_on: str):
    """A stand-in for a model: words in reverse order, an error on texts with a marker."""

    def call(text: str) -> str:
        if fail_on in text:
            raise ValueError("marked text")
        return " ".join(reversed(text.split(" ")))

    return call


def counter():
    """A stand-in for an encoder: three simple counts as a vector."""
    return lambda texts: [[len(t), t.count(" "), t.count("\n")] for t in texts]


@query
def generate(spark, sf):
    docs = documents(spark, sf, "doc_id", "text")
    made = nf.generate(docs, "text", "generated", reverser, options={"fail_on": "|"})
    return made.select("doc_id", F.md5(F.col("generated").cast("binary")).alias("generated_md5"))


@query
def generate_prefixed(spark, sf):
    docs = documents(spark, sf, "doc_id", "text")
    made = nf.generate(docs, "text", "generated", reverser, "summarize: ", {"fail_on": "|"})
    return made.select("doc_id", F.md5(F.col("generated").cast("binary")).alias("generated_md5"))


@query
def encode_texts(spark, sf):
    docs = nf.encode(documents(spark, sf, "doc_id", "text"), "text", "vector", counter)
    return docs.select("doc_id", *(F.col("vector")[i].cast("double").alias(f"v{i}") for i in range(3)))


@query
def encode_default(spark, sf):
    """The encoder without a model: used places of each vector, and where its weight lies."""
    docs = nf.encode(documents(spark, sf, "doc_id", "text"), "text", "vector", nf.hashed_grams)
    centre = F.aggregate(
        F.transform("vector", lambda x, i: (i + 1) * x.cast("double") * x), F.lit(0.0), lambda total, x: total + x
    )
    return docs.select("doc_id", F.size(F.filter("vector", lambda x: x > 0)).alias("n_places"), F.round(centre, 2).alias("centre"))


@query
def system_outputs(spark, sf):
    """Lead and TF-IDF summaries fed to a callable, and the identity system."""
    systems = {
        "identity": ("identity", None, {}),
        "lead_reversed": ("lead", reverser, {"fail_on": "|"}),
        "tfidf_reversed": ("tfidf", reverser, {"fail_on": "|"}),
    }
    return ev.system_outputs(documents(spark, sf, "doc_id", "text"), "doc_id", "text", "text", systems)


# --- streaming --------------------------------------------------------------------------------


@query
def ingest_stream(spark, sf):
    """Documents as a stream under keys that many of them share, in three runs, each begun anew with the same folders.

    The length is the key: it is repeated inside the files of a run and in those of later runs. The first run that has a
    key writes it, and there the row with the smallest id."""
    source, out, progress = scratch(spark, "arrivals"), scratch(spark, "stream"), scratch(spark, "stream-progress")
    docs = table(spark, sf, "documents").select("doc_id", "lang", "text", F.col("n_chars").alias("key"))

    def prepared(df: DataFrame) -> DataFrame:
        df = co.compute_once(df.select("doc_id", "lang", "text"), text=tx.clean_text("text"))
        return pr.min_words(df, "text", 150)

    for run in range(3):
        docs.filter(F.col("doc_id") % 3 == run).write.mode("append").parquet(source)
        stream = st.read_article_stream(spark, source, docs.schema, "parquet")
        st.ingest_stream(stream, out, progress, "key", prepared, order=["doc_id"], compact_every=2).awaitTermination()
    back = spark.read.schema("doc_id long, lang string, text string").json(out)
    return back.select("doc_id", "lang", F.length("text").alias("chars"))


@query
def snapshot_stream(spark, sf):
    """Labelled documents as the non-null rows of a stream, one snapshot folder per batch."""
    source = scratch(spark, "labelled")
    labelled(spark, sf).select("doc_id", F.col("quality").cast("string").alias("text")).write.json(source)
    stream = st.read_article_stream(spark, source, "doc_id long, text string", files_per_batch=2)
    out = scratch(spark, "snapshots")
    st.snapshot_stream(stream, out, scratch(spark, "snapshot-progress")).awaitTermination()
    return spark.read.schema("doc_id long, text string, batch int").json(out).select("doc_id", "text")
