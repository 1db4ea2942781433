"""Text functions against plain Python."""

import math
import random
import re
from collections import Counter

from pyspark.sql import functions as F

from pairmill.functions import text as tx
from pairmill.operators.summarize import tfidf_summary


def run(spark, values, *cols):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, t string")
    return [tuple(r)[1:] for r in df.select("i", *cols).orderBy("i").collect()]


def python_clean(text, wiki):
    """The rule tables applied with Python's re."""
    for pattern, replacement in (*(tx.WIKI_MARKUP if wiki else ()), *tx.COMMON_MARKUP):
        flags = re.DOTALL if "(?s)" in pattern else re.MULTILINE if "(?md" in pattern else 0
        pattern = re.sub(r"^\(\?[smdU]+\)", "", pattern)
        text = re.sub(pattern, replacement.replace("$1", r"\1"), text, flags=flags)
    return text.strip()


def test_whitespace_is_pythons(spark):
    chars = [chr(c) for c in range(1, 0x10000) if not 0xD800 <= c < 0xE000]
    got = run(spark, [f"a{c}b" for c in chars], tx.word_count("t"), tx.strip(F.substring("t", 2, 1)))
    assert got == [(len(f"a{c}b".split()), c.strip()) for c in chars]


def test_word_counts(spark):
    values = ["", " ", "a", " a ", "a  b", " a b\n", "Бір екі. Үш төрт!  Бес» алты\u001cжеті", None]
    got = [r[0] for r in run(spark, values, tx.word_count("t"))]
    assert got == [None if v is None else len(v.split()) for v in values]
    assert [r[0] for r in run(spark, ["", "a b", "a"], tx.spaced_word_count("t"))] == [0, 2, 1]


def test_clean_fixture(spark):
    text = "{{a {{b}} c}} x == H ==\ny [[F|g]] [https://q.z w] &nbsp; &#39; &frac12; a<br>b"
    assert run(spark, [text, None, " \n"], tx.clean_text("t", F.lit("kk_wikipedia"))) == [
        ("c}} x y g w &#39; &frac12; ab",), ("",), ("",)
    ]
    assert run(spark, ["a<b>c [[d]]"], tx.clean_text("t", F.lit("other"))) == [("ac [[d]]",)]


def test_clean_random_markup(spark):
    rng = random.Random(7)
    parts = [
        "__TOC__", "{{", "}}", "{|", "|}", "[[", "]]", "[https://a.b/c", "]", "|", "==", "=", "\n", "\n|", "\n*#", " ",
        " ", " ", "\r", "<b>", "</", ">", "&amp;", "&#39;", "http://x.y", "Қаз", "word", ".", "&", ";", "*", ":",
    ]
    values = ["".join(rng.choices(parts, k=rng.randint(1, 30))) for _ in range(4000)]
    got = run(spark, values, tx.clean_text("t", F.lit("kk_wikipedia")), tx.clean_text("t"))
    assert got == [(python_clean(v, True), python_clean(v, False)) for v in values]


def test_extract_lead(spark):
    text = "One two. One two three four five. A b c d e f! G h i j k? L m n o p."
    want = "One two three four five. A b c d e f! G h i j k?"
    assert run(spark, [text, "", None], tx.extract_lead("t")) == [(want,), ("",), ("",)]
    assert run(spark, ["Ол айтты: «бір екі үш төрт» Содан кейін не болды."], tx.extract_lead("t", 1)) == [
        ("Ол айтты: «бір екі үш төрт»",)
    ]


def python_budget_lead(text, budget):
    lead = ""
    for piece in re.split("[.!?]", text):
        if len(lead) + len(piece) >= budget:
            break
        lead += piece.strip() + ". "
    return lead.strip()


def test_get_lead(spark):
    rng = random.Random(3)
    values = ["A. B.", "", "x" * 301, "." * 700, " . ! ? " * 200, "a. b!"]
    values += ["".join(rng.choices("ab .!?\n ", k=rng.randint(0, 900))) for _ in range(500)]
    got = [r[0] for r in run(spark, values, tx.get_lead("t"))]
    assert got == [python_budget_lead(v, 300) for v in values]
    assert got[:3] == ["A. B. .", ".", ""]


def python_tfidf(text, n=3):
    sents = [s.strip() for s in re.split("[.!?]", text)]
    sents = [s for s in sents if len(s) > 20]
    if len(sents) <= n:
        return " ".join(sents)
    bags = [Counter(re.findall(r"\w{2,}", s.lower())) for s in sents]
    spread = Counter(t for b in bags for t in b)
    if not spread:
        return ""
    scores = []
    for bag in bags:
        w = [c * (math.log((1 + len(sents)) / (1 + spread[t])) + 1) for t, c in bag.items()]
        scores.append(round(sum(w) / math.sqrt(sum(x * x for x in w)), 9) if w else 0.0)
    best = sorted(range(len(sents)), key=lambda i: (scores[i], i))[-n:]
    return ". ".join(sents[i] for i in sorted(best))


def test_tfidf_summary(spark):
    rng = random.Random(5)
    vocabulary = ["сөз", "мәтін", "ab", "cd_e", "x", "2024", "жаңа", "longer", "word", "қала"]
    values = [
        ". ".join(" ".join(rng.choices(vocabulary, k=rng.randint(1, 12))) for _ in range(rng.randint(0, 12)))
        for _ in range(200)
    ]
    values += ["", None, ". ".join(["- - - - - - - - - - - - -"] * 5), "one two three four five six. one two three four five six"]
    df = spark.createDataFrame(list(enumerate(values)), "doc_id long, text string")
    got = {r.doc_id: r.summary for r in tfidf_summary(df).collect()}
    assert got == {i: python_tfidf(v or "") for i, v in enumerate(values)}


def test_tfidf_summary_stays_in_its_row(spark):
    """No exchange; other columns, rows without an id and repeated rows pass through, in Arrow batches of any size."""
    values = ["one two three four five six. seven eight nine ten eleven. ab cd ab cd ab cd ab cd. zz zz zz zz zz zz zz zz"]
    values += ["short", None, "", *values] * 7
    rows = [(None if i % 5 == 0 else i % 3, v, "clash") for i, v in enumerate(values)]
    df = spark.createDataFrame(rows, "doc_id long, text string, id string").repartition(3)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "4")
    try:
        got = tfidf_summary(df, n=2)
        assert "Exchange" not in tfidf_summary(spark.range(3).selectExpr("id", "'a. b' AS text"))._jdf.queryExecution().executedPlan().toString()
        assert got.columns == ["doc_id", "text", "id", "summary"]
        want = sorted((str(i), str(t), c, python_tfidf(t or "", 2)) for i, t, c in rows)
        assert sorted((str(r.doc_id), str(r.text), r.id, r.summary) for r in got.collect()) == want
        assert tfidf_summary(df.limit(0)).count() == 0
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
