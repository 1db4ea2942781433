"""Corpus files."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from pairmill.functions.text import strip
from pairmill.sources import schemas

# --- Fixed values ---
# Values that a CSV file written by a data-frame tool uses for "missing", besides the empty field.
NA_VALUES = (
    "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA",
    "NULL", "NaN", "None", "n/a", "nan", "null",
)


def read_articles_jsonl(spark: SparkSession, path: str, schema: str | StructType = schemas.ARTICLE) -> DataFrame:
    """JSON lines with a fixed schema; blank lines are skipped, a malformed line fails the job."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def read_pairs_csv(
    spark: SparkSession, path: str, schema: str | StructType, na_values: Sequence[str] = ()
) -> DataFrame:
    """CSV with a header and quoted multi-line text. ``na_values`` (for example ``NA_VALUES``) become NULL."""
    df = (
        spark.read.schema(schema)
        .option("header", True)
        .option("multiLine", True)
        .option("quote", '"')
        .option("escape", '"')
        .option("mode", "FAILFAST")
        .csv(path)
    )
    if na_values:
        texts = [f.name for f in df.schema.fields if f.dataType.simpleString() == "string"]
        df = df.withColumns({c: F.when(~F.col(c).isin(*na_values), F.col(c)) for c in texts})
    return df


def write_csv(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """CSV with a header that :func:`read_pairs_csv` reads back ('' comes back as NULL)."""
    df.write.mode(mode).option("header", True).option("quote", '"').option("escape", '"').csv(path)


def append_articles_jsonl(df: DataFrame, path: str) -> None:
    """Append one JSON object per article; NULL fields are written as null."""
    df.write.mode("append").option("ignoreNullFields", False).json(path)


def with_bucket(df: DataFrame, id_col: str = "id", width: int = 10_000) -> DataFrame:
    """Add the first id of the row's bucket of ``width`` ids."""
    # Whole-number arithmetic: ids beyond 2^53 would not survive a division.
    return df.withColumn("bucket", F.col(id_col) - F.pmod(F.col(id_col), F.lit(width)))


def write_bucketed(df: DataFrame, path: str, id_col: str = "id", width: int = 10_000) -> None:
    """One folder per id bucket. Rows of a bucket meet first, so a folder gets few files; a bucket has at most
    ``width`` distinct ids, which bounds every group."""
    with_bucket(df, id_col, width).repartition("bucket").write.partitionBy("bucket").json(path)


def read_url_list(spark: SparkSession, path: str) -> DataFrame:
    """One address per line; whitespace around it and blank lines are dropped."""
    return spark.read.text(path).select(strip("value").alias("url")).filter("url != ''")


def write_url_list(df: DataFrame, path: str, url: str = "url") -> None:
    df.select(F.col(url).alias("value")).write.text(path)


def read_languages(
    spark: SparkSession, pattern: str, langs: Sequence[str], schema: str | StructType, col: str = "lang"
) -> DataFrame:
    """The same table in one CSV per language; ``{lang}`` in the pattern names the file. Adds the language."""
    parts = (read_pairs_csv(spark, pattern.format(lang=v), schema).withColumn(col, F.lit(v)) for v in langs)
    return reduce(DataFrame.unionByName, parts)


def write_languages(df: DataFrame, path: str, col: str = "lang") -> None:
    """One folder per language."""
    df.write.partitionBy(col).option("header", True).option("escape", '"').csv(path)


def harmonize(
    *sources: tuple[DataFrame, Mapping[str, str], Mapping[str, str]], schema: str = schemas.ARTICLE
) -> DataFrame:
    """Crawl outputs with differing columns as one corpus table.

    Each source is (table, renames, constants): columns are renamed, constant columns added, everything outside the
    corpus schema dropped and missing columns filled with NULL.
    """
    target = StructType.fromDDL(schema)

    def fit(df: DataFrame, renames: Mapping[str, str], constants: Mapping[str, str]) -> DataFrame:
        df = df.withColumnsRenamed(dict(renames)).withColumns({c: F.lit(v) for c, v in constants.items()})
        return df.select(
            *(
                (F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name)
                for f in target.fields
            )
        )

    return reduce(DataFrame.unionByName, (fit(*s) for s in sources))


def from_records(spark: SparkSession, rows: Sequence[Mapping], schema: str | StructType) -> DataFrame:
    """A small table from records at hand (settings, fixtures)."""
    names = StructType.fromDDL(schema).names if isinstance(schema, str) else schema.names
    return spark.createDataFrame([tuple(r.get(n) for n in names) for r in rows], schema)
