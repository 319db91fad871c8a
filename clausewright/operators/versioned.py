"""Bitemporal tables without updates: versions and closures are appended, and a manifest says which events count.

Valid time is [effective_from, effective_to), recorded time [recorded_at, superseded_at); null is open.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def current(versions: DataFrame) -> DataFrame:
    return versions.where("superseded_at IS NULL")


def in_force(when: Column) -> Column:
    return (F.col("effective_from") <= when) & (F.col("effective_to").isNull() | (F.col("effective_to") > when))


def as_of_current_belief(versions: DataFrame, when: Column) -> DataFrame:
    """What is in force at ``when`` by what is now believed: superseded rows are not read."""
    return current(versions).where(in_force(when))


def as_of(versions: DataFrame, when: Column, known_at: Column) -> DataFrame:
    """What was in force at ``when`` as known at ``known_at``."""
    known = (F.col("recorded_at") <= known_at) & (F.col("superseded_at").isNull() | (F.col("superseded_at") > known_at))
    return versions.where(known & in_force(when))


def history(rows: DataFrame, key: str, start: str, tie: str) -> DataFrame:
    """Rows of one key as versions: each is in force until the next begins."""
    order = W.partitionBy(key).orderBy(start, tie)
    return rows.withColumns({"effective_from": F.col(start), "effective_to": F.lead(start).over(order), "version": F.row_number().over(order)})


def upsert_changes(old: DataFrame, new: DataFrame, key: str, values: list[str]) -> DataFrame:
    """Rows (key, action): insert, close or skip, by a null-safe comparison of ``values``; changed rows are both closed and inserted."""
    a = old.select(F.col(key).alias("k"), F.struct(*values).alias("was"))
    b = new.select(F.col(key).alias("k"), F.struct(*values).alias("now"))
    both = a.join(b, "k", "full_outer")
    action = F.when(F.col("was").isNull(), F.array(F.lit("insert"))).when(F.col("now").isNull(), F.array(F.lit("keep"))).when(F.col("was").eqNullSafe(F.col("now")), F.array(F.lit("skip"))).otherwise(F.array(F.lit("close"), F.lit("insert")))
    return both.select(F.col("k").alias(key), F.explode(action).alias("action"))


def insert_new(table: DataFrame, rows: DataFrame, key: list[str]) -> DataFrame:
    """The rows of ``rows`` whose key the table doesn't have; of repeated keys one."""
    return rows.dropDuplicates(key).join(table.select(*key).distinct(), key, "left_anti")


def latest(rows: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    rank = W.partitionBy(*key).orderBy(*order)
    return rows.withColumn("__n", F.row_number().over(rank)).where("__n = 1").drop("__n")


class VersionStore:
    """An append-only store in a folder: ``versions`` and ``closures`` with an event id each, and a table of committed events.

    A commit writes both, then the event; readers take rows of committed events only, so that a commit is
    seen whole or not at all.
    """

    def __init__(self, spark: SparkSession, path: str, schema: str, read_only: bool = False) -> None:
        self.spark, self.path, self.schema, self.read_only = spark, path, schema, read_only

    def _read(self, name: str, schema: str) -> DataFrame:
        jvm = self.spark.sparkContext._jvm
        at = jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        there = at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(at)
        return self.spark.read.schema(schema).parquet(f"{self.path}/{name}") if there else self.spark.createDataFrame([], schema)

    def events(self) -> DataFrame:
        """The committed events, of several attempts at one the first."""
        rows = self._read("events", "event_id string, attempt string, recorded_at timestamp, note string")
        return rows.groupBy("event_id").agg(F.min(F.struct("recorded_at", "attempt", "note")).alias("x")).select("event_id", "x.attempt", "x.recorded_at", "x.note")

    def view(self) -> DataFrame:
        """All versions with effective_to and superseded_at from their closures; of several closures of a version the first holds, since only open versions are closed."""
        done = self.events().select("attempt", "event_id", "recorded_at")
        rows = self._read("versions", f"{self.schema}, effective_from timestamp, attempt string").join(done, "attempt").drop("attempt")
        return rows.join(self._closed(done), "id", "left")

    def _closed(self, done: DataFrame) -> DataFrame:
        rows = self._read("closures", "id string, effective_to timestamp, attempt string")
        known = rows.join(done.select("attempt", F.col("recorded_at").alias("superseded_at")), "attempt")
        return known.groupBy("id").agg(F.min(F.struct("superseded_at", "effective_to")).alias("x")).select("id", "x.effective_to", "x.superseded_at")

    def simulated(self, event_id: str, recorded_at: Column, rows: DataFrame | None = None, closures: DataFrame | None = None) -> DataFrame:
        """What ``view`` would give after this commit; nothing is written."""
        now = self.view()
        at = recorded_at.cast("timestamp")
        if closures is not None:
            new = closures.groupBy("id").agg(F.min("effective_to").alias("__to")).withColumn("__at", at)
            now = now.join(new, "id", "left").withColumns({"effective_to": F.coalesce("effective_to", "__to"), "superseded_at": F.coalesce("superseded_at", "__at")}).drop("__to", "__at")
        if rows is not None:
            now = now.unionByName(rows.withColumns({"event_id": F.lit(event_id), "recorded_at": at}), allowMissingColumns=True)
        return now

    def before_and_after(self, event_id: str, key: str) -> DataFrame:
        """Rows (key, before, after): the ids that were believed of each key just before an event was recorded and from it on, where they differ."""
        view = self.view()
        at = self.events().where(F.col("event_id") == event_id).agg(F.min("recorded_at").alias("__at"))  # one row
        both = view.join(F.broadcast(at))
        open_at = lambda started, ended: started & (F.col("superseded_at").isNull() | ended)
        was = open_at(F.col("recorded_at") < F.col("__at"), F.col("superseded_at") >= F.col("__at"))
        now = open_at(F.col("recorded_at") <= F.col("__at"), F.col("superseded_at") > F.col("__at"))
        ids = lambda which: F.array_sort(F.collect_set(F.when(which, F.col("id"))))
        return both.groupBy(key).agg(ids(was).alias("before"), ids(now).alias("after")).where("before <> after")

    def commit(self, event_id: str, recorded_at: Column, rows: DataFrame | None = None, closures: DataFrame | None = None, note: str = "") -> None:
        """Appends ``rows`` (schema, effective_from) and ``closures`` (id, effective_to); an event is committed once.

        Rows carry the id of the attempt that wrote them, and the event names its attempt: what an attempt that
        failed halfway has left is never read, even when the event is tried again.
        """
        if self.read_only:
            raise PermissionError("the store is open for reading only")
        if not self.events().where(F.col("event_id") == event_id).isEmpty():
            raise ValueError(f"event {event_id} is already committed")
        attempt = uuid.uuid4().hex
        for name, part in (("versions", rows), ("closures", closures)):
            if part is not None:
                part.withColumn("attempt", F.lit(attempt)).write.mode("append").parquet(f"{self.path}/{name}")
        event = self.spark.range(1).select(F.lit(event_id).alias("event_id"), F.lit(attempt).alias("attempt"), recorded_at.cast("timestamp").alias("recorded_at"), F.lit(note).alias("note"))
        event.write.mode("append").parquet(f"{self.path}/events")


def event_id(**what: str) -> str:
    """An id made of what the event says."""
    return str(uuid.uuid5(uuid.NAMESPACE_OID, json.dumps(what, sort_keys=True)))


# snapshots


def multiset_difference(before: DataFrame, after: DataFrame) -> DataFrame:
    """Rows with their side: those that ``after`` lacks and those it adds, counts not collapsed."""
    return before.exceptAll(after).withColumn("side", F.lit("removed")).unionByName(after.exceptAll(before).withColumn("side", F.lit("added")))


def digest(rows: DataFrame, columns: list[str]) -> DataFrame:
    """One row (n, digest) that depends on the rows and how often each occurs, not on their order: sums over parts of the rows' SHA-256."""
    text = F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("\\N")) for c in columns])
    hashed = rows.select(F.sha2(text, 256).alias("h"))
    part = lambda i: F.coalesce(F.sum(F.conv(F.substring("h", 1 + 13 * i, 13), 16, 10).cast("decimal(38,0)")), F.lit(0)).cast("string")
    return hashed.agg(F.count("*").alias("n"), F.concat_ws("-", *[part(i) for i in range(4)]).alias("digest"))
