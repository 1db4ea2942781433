"""Files and streams."""

import hashlib
import os
import sys

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from pairmill.operators import infer as nf
from pairmill.operators import ordering as od
from pairmill.operators import pairs as pr
from pairmill.sources import files as fl
from pairmill.sources import schemas
from pairmill.streaming import ingest as st


cloudpickle.register_pickle_by_value(sys.modules[__name__])


def test_jsonl(spark, tmp_path):
    good = tmp_path / "a.jsonl"
    good.write_text('{"source": "s", "text": "қазақ"}\n\n   \n{"lang": "kk"}\n', encoding="utf-8")
    rows = fl.read_articles_jsonl(spark, str(good)).collect()
    assert [(r.source, r.text, r.lang) for r in rows] == [("s", "қазақ", None), (None, None, "kk")]
    bad = tmp_path / "b.jsonl"
    bad.write_text('{"source": "s"}\n{"source": \n')
    with pytest.raises(Exception):
        fl.read_articles_jsonl(spark, str(bad)).collect()


def test_csv_round_trip(spark, tmp_path):
    rows = [('a\n"b"\\', "x"), ("p,q", "NA"), ("", None), ("\\", "\\n")]
    df = spark.createDataFrame(rows, schemas.SYSTEM_OUTPUT)
    fl.write_csv(df, str(tmp_path / "c"))
    back = {tuple(r) for r in fl.read_pairs_csv(spark, str(tmp_path / "c"), schemas.SYSTEM_OUTPUT).collect()}
    assert back == {('a\n"b"\\', "x"), ("p,q", "NA"), (None, None), ("\\", "\\n")}
    with_na = fl.read_pairs_csv(spark, str(tmp_path / "c"), schemas.SYSTEM_OUTPUT, fl.NA_VALUES)
    assert ("p,q", None) in {tuple(r) for r in with_na.collect()}


def test_buckets_and_urls(spark, tmp_path):
    df = spark.createDataFrame([(9_999, "a"), (10_000, "b"), (25_001, "c")], "id long, title string")
    fl.write_bucketed(df, str(tmp_path / "b"))
    assert sorted(p.name for p in (tmp_path / "b").glob("bucket=*")) == ["bucket=0", "bucket=10000", "bucket=20000"]
    urls = tmp_path / "urls.txt"
    urls.write_text(" https://a \n\n\t\nhttps://b\n")
    assert [r.url for r in fl.read_url_list(spark, str(urls)).collect()] == ["https://a", "https://b"]


def test_harmonize(spark):
    news = spark.createDataFrame([("u", "b", "kk")], "url string, body string, language string")
    wiki = spark.createDataFrame([(7, "t", "x")], "id long, title string, text string")
    corpus = fl.harmonize(
        (news, {"body": "text", "language": "lang"}, {"source": "n"}), (wiki, {}, {"source": "w", "lang": "kk"})
    )
    assert ", ".join(corpus.columns) == "source, title, url, text, date, category, lang"
    assert {(r.source, r.text, r.lang) for r in corpus.collect()} == {("n", "b", "kk"), ("w", "x", "kk")}


def test_file_order(spark, tmp_path):
    for name, lines in (("b.json", [3, 4]), ("a.json", [1, 2])):
        (tmp_path / name).write_text("".join(f'{{"n": {n}}}\n' for n in lines))
    df = od.file_order(spark.read.schema("n int").json(str(tmp_path)))
    assert [r.n for r in df.orderBy("file_order").collect()] == [1, 2, 3, 4]


def shout(suffix):
    def call(text):
        if "bad" in text:
            raise RuntimeError("no")
        return text.upper() + suffix

    return call


def test_generate(spark):
    df = spark.createDataFrame([("a",), ("bad",), (None,)], "t string")
    rows = nf.generate(df, "t", "o", shout, "x: ", {"suffix": "!"}).collect()
    assert [r.o for r in rows] == ["X: A!", "", ""]


def article(path, name, rows):
    path.mkdir(exist_ok=True)
    (path / name).write_text("".join(f'{{"url": "{u}", "text": "{t}"}}\n' for u, t in rows))


def test_ingest_resumes_and_writes_once(spark, tmp_path):
    source, out, progress = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "progress")
    schema = "url string, text string"

    def run():
        stream = st.read_article_stream(spark, str(source), schema, files_per_batch=1)
        query = st.ingest_stream(stream, out, progress, "url", lambda df: pr.min_words(df, "text", 2), compact_every=2)
        query.awaitTermination()
        return sorted((r.url, r.text) for r in spark.read.schema(schema).json(out).collect())

    article(source, "1.json", [("u1", "a b"), ("u2", "short"), ("u3", "c d")])
    article(source, "2.json", [("u1", "a b"), ("u4", "e f")])
    first = run()
    assert first == [("u1", "a b"), ("u3", "c d"), ("u4", "e f")]
    assert run() == first
    # u2 was done, though too short to be written; u6 comes twice in one batch, and the smaller content wins.
    article(source, "3.json", [("u3", "c d"), ("u5", "g h"), ("u2", "long enough"), ("u6", "z z"), ("u6", "b b"), ("u6", "z z")])
    chosen = min((hashlib.sha256(f'{{"url":"u6","text":"{t}"}}'.encode()).hexdigest(), t) for t in ("z z", "b b"))[1]
    assert run() == [*first, ("u5", "g h"), ("u6", chosen)]
    for n in range(4, 10):
        article(source, f"{n}.json", [("u6", "no no"), (f"v{n}", "x y"), (f"v{n - 1}", "no no")])
        os.utime(source / f"{n}.json", (2e9 + n, 2e9 + n))  # batches follow the files' times
    last = run()
    assert [t for u, t in last if u.startswith("v")] == ["no no"] + ["x y"] * 6 and ("u6", "no no") not in last
    # Folders of finished keys are merged every second batch.
    assert len([p for p in os.listdir(f"{out}-done") if "=" in p]) <= 3


def test_batch_that_failed_is_repeated_alike(spark, tmp_path):
    """A batch that stops after its keys are written, or after its rows are, gives the same rows when it comes again."""
    failing = {"on": False}

    def transform(df):
        if failing["on"]:
            raise RuntimeError("lost")
        return df

    sink = st.KeyedSink(str(tmp_path / "out"), str(tmp_path / "done"), "k", transform, order=["n"], compact_every=2)

    def batch(*rows):
        return spark.createDataFrame(rows, "k string, n int, ok boolean")

    def rows():
        return sorted((r.batch, r.k, r.n) for r in spark.read.schema("k string, n int, batch int").json(str(tmp_path / "out")).collect())

    sink(batch(("a", 2, True), ("a", 1, True), ("b", 5, True), (None, 0, True)), 0)
    want = [(0, "a", 1), (0, "b", 5)]
    assert rows() == want
    failing["on"] = True
    second = batch(("a", 0, True), ("c", 7, True), ("c", 8, True))
    with pytest.raises(RuntimeError):
        sink(second, 1)
    failing["on"] = False
    sink(second, 1)
    sink(second, 1)
    want += [(1, "c", 7)]
    assert rows() == want
    for _ in range(2):
        sink(batch(("b", 0, True), ("d", 1, True)), 2)
    assert rows() == [*want, (2, "d", 1)]
    sink(batch(), 3)
    sink(batch(("e", 1, True)), 4)
    sink(batch(("e", 0, True), ("d", 0, True)), 5)
    assert rows() == [*want, (2, "d", 1), (4, "e", 1)]


def test_unfinished_rows_come_again(spark, tmp_path):
    sink = st.KeyedSink(str(tmp_path / "o"), str(tmp_path / "d"), "k", lambda df: df, finished=F.col("ok"))
    schema = "k string, ok boolean"
    sink(spark.createDataFrame([("a", False), ("b", True), ("c", None)], schema), 0)
    sink(spark.createDataFrame([("a", True), ("b", True), ("c", True)], schema), 1)
    back = spark.read.schema("k string, batch int").json(str(tmp_path / "o")).collect()
    assert sorted((r.batch, r.k) for r in back) == [(0, "b"), (1, "a"), (1, "c")]


def test_hot_key_leaves_each_task_once(spark, tmp_path):
    """A key that fills a batch: the limit on row numbers stands before the exchange, and no state is kept."""
    df = spark.range(0, 5000, numPartitions=8).selectExpr("'hot' AS k", "id AS n")
    sink = st.KeyedSink(str(tmp_path / "o"), str(tmp_path / "d"), "k", lambda df: df, order=["n"])
    sink(df, 0)
    assert [r.n for r in spark.read.json(str(tmp_path / "o")).collect()] == [0]


def test_snapshots(spark, tmp_path):
    source = tmp_path / "in"
    article(source, "1.json", [("u1", "a")])
    (source / "2.json").write_text('{"url": "u2"}\n{"url": "u3", "text": "c"}\n')
    stream = st.read_article_stream(spark, str(source), "url string, text string", files_per_batch=1)
    st.snapshot_stream(stream, str(tmp_path / "out"), str(tmp_path / "progress")).awaitTermination()
    back = spark.read.schema("url string, text string, batch int").json(str(tmp_path / "out"))
    assert sorted((r.batch, r.url) for r in back.collect()) == [(0, "u1"), (1, "u3")]


def test_buckets_of_large_ids(spark):
    from pairmill.sources.files import with_bucket

    df = spark.createDataFrame([(9007199254740993,), (-1,), (0,)], "id long")
    assert [r.bucket for r in with_bucket(df, "id", 1).collect()] == [9007199254740993, -1, 0]
    assert [r.bucket for r in with_bucket(df, "id", 10).collect()] == [9007199254740990, -10, 0]


def test_from_records(spark):
    """Records follow the schema: order of keys does not matter, absent ones are NULL, others are left out."""
    rows = [{"b": 1, "a": "x"}, {"a": "y", "c": 9}, {}]
    for schema in ("a string, b int", spark.createDataFrame([], "a string, b int").schema):
        df = fl.from_records(spark, rows, schema)
        assert df.dtypes == [("a", "string"), ("b", "int")]
        assert [tuple(r) for r in df.collect()] == [("x", 1), ("y", None), (None, None)]
    assert fl.from_records(spark, [], "a string").count() == 0
