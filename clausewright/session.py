"""Session settings that the library assumes, and table reading."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def session(master: str | None = None, **settings: str) -> SparkSession:
    builder = SparkSession.builder
    if master:
        builder = builder.master(master)
    for key, value in {**SETTINGS, **settings}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def small(df: DataFrame, most: int = 100_000) -> DataFrame | None:
    """``df`` marked for a broadcast where it has ``most`` rows at most, counted first; else None."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else None


def dealt_by(df: DataFrame, *columns: str) -> DataFrame:
    """``df`` in tasks by ``columns``, for work that costs much more than its rows' bytes: never merged, as small shuffles are, into about as many tasks as cores of which some have twice the work."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *columns)


def settled(df: DataFrame) -> DataFrame:
    """``df`` worked out once and kept in the shared checkpoint folder, so that what follows starts from files that survive lost executors."""
    sc = df.sparkSession.sparkContext
    if not sc.getCheckpointDir():
        root = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not root and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        sc.setCheckpointDir(root or "file://" + tempfile.mkdtemp(prefix="clausewright-"))
    return df.checkpoint()
