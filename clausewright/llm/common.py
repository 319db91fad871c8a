"""What the training-data operators share: the shared folder, written tables, connected components."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are maximal runs of other characters than these, in every operator.
SPACE = "\\x20\\x09-\\x0D"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where that is unset, a local master gets a folder of its own, any other an error."""
    sc = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not root:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = "file://" + tempfile.mkdtemp(prefix="clausewright-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(root)
    return root


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder, deleted when the application ends."""
    path = f"{shared_dir(spark)}/clausewright/{name}-{uuid.uuid4().hex}"
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(target)
    return path


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once to the shared folder and read back: later reads survive lost executors and don't recompute it."""
    spark, path = df.sparkSession, new_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def forget(df: DataFrame) -> None:
    """Deletes the tables that ``df`` reads and ``written`` or ``components`` made, once nothing needs them any more."""
    spark = df.sparkSession
    root = f"{shared_dir(spark)}/clausewright/"
    jvm = spark.sparkContext._jvm
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if folder.replace("file:///", "file:/").startswith(root.replace("file:///", "file:/")):
            target = jvm.org.apache.hadoop.fs.Path(folder)
            target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def small_batches(spark: SparkSession, size: str = "8m") -> None:
    """Arrow batches of ``size`` bytes, so that a task's JVM and Python worker hold little text at once; a size that the user has set stays."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key, "64m") in ("67108864b", "64m"):
        spark.conf.set(key, size)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is evaluated once however often the body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def running(values: Column, zero: Column, merge: Callable[[Column, Column], Column]) -> Column:
    """For each element, ``zero`` merged with all elements before it; ``merge`` is associative.

    An array that grows by one element a step is copied at each; here blocks of about the root of the size
    are worked out apart, so that n elements cost n ** 1.5 at most.
    """
    def steps(start: Column, some: Column) -> Column:
        grown = F.aggregate(some, F.struct(start.alias("now"), F.slice(F.array(start), 1, 0).alias("all")), lambda state, x: F.struct(merge(state["now"], x).alias("now"), F.array_append(state["all"], state["now"]).alias("all")))
        return grown["all"]

    def in_blocks(v: Column) -> Column:
        size = F.ceil(F.sqrt(F.size(v))).cast("int")
        cut = F.transform(F.sequence(F.lit(0), F.ceil(F.size(v) / size).cast("int") - 1), lambda i: F.slice(v, i * size + 1, size))

        def joined(blocks: Column) -> Column:
            totals = F.transform(blocks, lambda b: F.aggregate(F.slice(b, F.lit(2), F.size(b)), F.get(b, 0), lambda x, y: merge(x, y)))
            starts = steps(zero, totals)
            return F.flatten(F.zip_with(blocks, starts, lambda b, start: steps(start, b)))

        return let(cut, joined)

    return F.when(F.size(values) == 0, values).otherwise(let(values, in_blocks))


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z only; texts of one byte a character take the faster built-in."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(F.translate(text, upper, lower))


def words_of(text: Column) -> Column:
    """The words of a text column as an array; null has none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), f"[{SPACE}]+"), "")


def components(edges: DataFrame) -> DataFrame:
    """Smallest node reachable from each node of ``edges`` (a, b): rows (node, component).

    Large-star and small-star rounds over the edge table, which is written after each round; no node's
    neighbours are gathered, since a round only needs their minimum. Loops and repeats are harmless; an
    empty table gives an empty result.
    """
    def star(pairs: DataFrame, large: bool) -> DataFrame:
        both = pairs.select(F.col("a").alias("u"), F.col("b").alias("v"))
        both = both.union(both.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else both
        # one minimum for each node, itself included; written, so that adaptive execution can split a hub's rows in the join back
        least = written(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "least")
        linked = both.join(least, "u")
        if large:
            out = linked.where(F.col("v") > F.col("u")).select(F.col("v").alias("a"), F.col("m").alias("b"))
        else:
            out = linked.select(F.col("v").alias("a"), F.col("m").alias("b")).union(least.select(F.col("u").alias("a"), F.col("m").alias("b")))
        # what this round was made of can go, once it stands
        table = written(out.where("a <> b").distinct(), "edges")
        forget(least)
        forget(pairs)
        return table

    now = written(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "edges")
    before = None
    while True:
        # large: u's larger neighbours point to u's least; small: each node's smaller neighbours point to the least of them
        now = star(star(now, large=True), large=False)
        mark = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("s")).first()
        if mark == before:
            break
        before = mark
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
