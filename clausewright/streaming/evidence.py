"""Evidence as a stream: batches of log files, windowed exception rates, and changes of result."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.evidence import with_result


def log_stream(spark: SparkSession, folder: str, schema: str, files_per_trigger: int = 16) -> DataFrame:
    """Parquet logs as they arrive; ts is given a time zone, which a watermark needs."""
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)
    return rows.withColumn("ts", F.col("ts").cast("timestamp"))


def windowed_rates(rows: DataFrame, by: list[str], exception: Column, width: str = "7 days", late: str = "1 day", tolerance: float = 0.05) -> DataFrame:
    """Exceptions, total, rate and result of each window and group; also for a table that isn't a stream."""
    marked = rows.withWatermark("ts", late) if rows.isStreaming else rows
    counted = marked.groupBy(F.window("ts", width).alias("w"), *by).agg(F.count_if(exception).alias("exceptions"), F.count("*").alias("total"))
    return with_result(counted.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), *by, "exceptions", "total"), tolerance)


def changes(results: DataFrame, key: str) -> DataFrame:
    """Rows (key, window_start, previous, result, transition) as results (key, window_start, result) arrive; the last result of each key is state."""

    def follow(name: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else None
        out = []
        for row in pd.concat(list(batches)).sort_values("window_start").itertuples():
            if row.result == "cannot_assess":
                turn = "cannot_assess"
            elif row.result == "ineffective":
                turn = "still_failing" if last == "ineffective" else "newly_failing"
            else:
                turn = "recovered" if last == "ineffective" else "healthy"
            out.append((name[0], row.window_start, last, row.result, turn))
            last = row.result
        state.update((last,))
        yield pd.DataFrame(out, columns=[key, "window_start", "previous", "result", "transition"])

    schema = f"{key} string, window_start timestamp, previous string, result string, transition string"
    return results.groupBy(key).applyInPandasWithState(follow, schema, "result string", "append", GroupStateTimeout.NoTimeout)


def append_batches(stream: DataFrame, target: str, checkpoint: str):
    """Writes each micro-batch once: a batch that runs again replaces what it wrote before."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{target}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
