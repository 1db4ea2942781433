"""Session helpers: builder defaults for local runs and the checkpoint folder."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

# Spark's setting by which the shuffle files of a job go when it ends, not when the driver happens to collect its garbage.
SHUFFLES_GO = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def local_session(cores: int | str = "*", app: str = "pairmill", **conf: str) -> SparkSession:
    """A local session for tests and benches; a cluster brings its own session."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", "8g")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    Only when nothing is configured (tests, laptops) and the master is local is a temporary folder
    used; on a cluster a missing setting is an error, because a machine-local folder dies with its
    machine.
    """
    context = spark.sparkContext
    current = context.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", "") or context.getConf().get("spark.checkpoint.dir", "")
    if not configured:
        if not re.match(r"local(\[|$)", context.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        configured = tempfile.mkdtemp(prefix="pairmill-ckpt-")
    context.setCheckpointDir(configured)
    return configured


@contextmanager
def _shuffles_go(spark: SparkSession) -> Iterator[None]:
    """Inside, jobs leave no shuffle files. For plans of which only what they write is read again."""
    before = spark.conf.get(SHUFFLES_GO, None)
    spark.conf.set(SHUFFLES_GO, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(SHUFFLES_GO)
        else:
            spark.conf.set(SHUFFLES_GO, before)


def freeze(df: DataFrame) -> DataFrame:
    """Write ``df`` to the checkpoint folder and cut its lineage there.

    Used where one result feeds several actions or where two plans must see the very same rows: the
    written copy survives lost executors and is not computed again. Shuffle files of the job do not outlive it.
    """
    checkpoint_dir(df.sparkSession)
    with _shuffles_go(df.sparkSession):
        # A plan of its own: that of ``df`` may have run already, or run again.
        return df.select("*").checkpoint(eager=True)


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh folder next to the checkpoints, on storage that all executors share."""
    return f"{checkpoint_dir(spark).rstrip('/')}/scratch-{name}-{uuid.uuid4().hex}"


def discard(spark: SparkSession, *paths: str) -> None:
    """Delete folders made by :func:`scratch` that no result reads any more."""
    for path in paths:
        if "/scratch-" not in path:
            raise ValueError(f"not a scratch folder: {path}")
        place = spark._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def stage(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """Write ``df`` to a scratch folder and return it as read from there, with the folder.

    Like :func:`freeze`, but later reads load only the columns they need, and the folder can be discarded.
    """
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path
