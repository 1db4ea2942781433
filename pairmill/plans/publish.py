"""Outputs of a job that become visible together."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairmill.plans.prepare import prepare_corpus

MANIFEST = "version long, folder string"


def publish(spark: SparkSession, out_dir: str, write: Callable[[str], object]) -> str:
    """Run ``write`` on a fresh folder under ``out_dir`` and make it the current version; return the folder.

    The version is one line of a manifest, written after all outputs, and Spark shows a written line only when its job is
    complete. A run that fails before leaves the current version as it was, and may simply be repeated: it takes a folder
    of its own. Of two runs at the same time that take one number, the later one to write its line fails.
    """
    folder = f"{out_dir}/data/{uuid.uuid4().hex}"
    write(folder)
    number = 1 + (versions(spark, out_dir).agg(F.max("version")).first()[0] or 0)
    line = spark.createDataFrame([(number, folder)], MANIFEST)
    line.coalesce(1).write.mode("errorifexists").json(f"{out_dir}/manifest/{number:08d}")
    return folder


def versions(spark: SparkSession, out_dir: str) -> DataFrame:
    """(version, folder): the complete versions under ``out_dir``; empty where there is none."""
    place = spark._jvm.org.apache.hadoop.fs.Path(f"{out_dir}/manifest")
    if not place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place):
        return spark.createDataFrame([], MANIFEST)
    return spark.read.schema(MANIFEST).option("recursiveFileLookup", True).json(f"{out_dir}/manifest")


def current(spark: SparkSession, out_dir: str) -> str | None:
    """The folder of the latest complete version."""
    last = versions(spark, out_dir).agg(F.max_by("folder", "version")).first()
    return last[0]


def publish_corpus(articles: DataFrame, out_dir: str, **options) -> str:
    """:func:`prepare_corpus` with all its outputs committed together."""
    return publish(articles.sparkSession, out_dir, lambda folder: prepare_corpus(articles, folder, **options))
