"""New documents as a stream: joined with what is known of their sources, copies dropped by content."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def document_stream(spark: SparkSession, folder: str, schema: str, files_per_trigger: int = 16) -> DataFrame:
    """Parquet files of documents as they arrive."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def new_documents(documents: DataFrame, sources: DataFrame, known: DataFrame, text: str = "text", source: str = "source", arrived: str | None = None, within: str = "30 days") -> DataFrame:
    """Documents whose content is new, with their source's columns and content_hash; for a stream and for a table.

    ``sources`` (source, ...) and ``known`` (content_hash) are tables, read anew with each micro-batch. Of equal
    contents one document stays, and the state holds a hash each, not texts; with ``arrived``, a time column, hashes are
    kept for ``within`` only, so that the state is bounded. Null texts count as empty; a document of an unknown source has nulls.
    """
    hashed = documents.withColumn("content_hash", F.sha2(F.coalesce(F.col(text), F.lit("")), 256))
    fresh = hashed.join(known.select("content_hash"), "content_hash", "left_anti")
    if arrived is not None and documents.isStreaming:
        once = fresh.withWatermark(arrived, within).dropDuplicatesWithinWatermark(["content_hash"])
    else:
        once = fresh.dropDuplicates(["content_hash"])
    return once.join(sources, source, "left")
