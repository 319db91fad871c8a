"""Work on a delta: what a change touches is extracted and mapped again, all else stands."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .spans import deepest_at, overlap_join
from .versioned import VersionStore

#: Makes rows of clauses or units, or maps rows; what it returns for a row depends on that row alone.
Step = Callable[[DataFrame], DataFrame]


def touched(units: DataFrame, changed: DataFrame) -> DataFrame:
    """The ``units`` (doc, start, text, ...) that share a character with a ``changed`` span (doc, s, e)."""
    spans = units.withColumns({"s": F.col("start").cast("bigint"), "e": F.col("start").cast("bigint") + F.length("text")})
    met = overlap_join(spans, changed.select("doc", "s", "e"), ["doc"])
    return met.drop("r_doc", "r_s", "r_e", "s", "e").dropDuplicates(["doc", "start", "text"])


def stated_inside(found: DataFrame, changed: DataFrame) -> DataFrame:
    """The rows of ``found`` (doc, at, ...) that begin inside a ``changed`` span (doc, s, e), each once."""
    points = found.withColumns({"s": F.col("at"), "e": F.col("at") + 1})
    spans = changed.select("doc", "s", "e").distinct()
    inside = overlap_join(points.select("doc", "at", "s", "e").distinct(), spans, ["doc"]).select("doc", "at").distinct()
    return found.join(inside, ["doc", "at"], "left_semi")


def re_extracted(units: DataFrame, clauses: DataFrame, changed: DataFrame, extract: Step) -> DataFrame:
    """What ``extract`` (units to rows (doc, at, ...)) finds inside the changed clauses, with the deepest clause that holds it as ref.

    ``changed`` (doc, ref) names clauses of the new version; only units that overlap one of them are extracted.
    """
    spans = clauses.join(changed.select("doc", "ref").distinct(), ["doc", "ref"], "left_semi").select("doc", "s", "e")
    found = stated_inside(extract(touched(units, spans)), spans)
    where = deepest_at(found.select("doc", "at").distinct(), clauses, ["doc"], "at", "at").select("doc", "at", "ref")
    return found.drop("ref").join(where, ["doc", "at"])


def affected(changes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of aligned clauses (doc, change, old_ref, new_ref): those of the new version to be worked on again (doc, ref), and those of the old one that no longer hold (doc, ref)."""
    redo = changes.where("change IN ('new', 'modified')").select("doc", F.col("new_ref").alias("ref"))
    gone = changes.where("change IN ('repealed', 'modified')").select("doc", F.col("old_ref").alias("ref"))
    return redo, gone


def carried_over(mapped: DataFrame, changes: DataFrame) -> DataFrame:
    """The rows of ``mapped`` (doc, ref, ...) whose clause stands, under the clause's new reference."""
    stands = changes.where("change IN ('unchanged', 'cosmetic')").select("doc", F.col("old_ref").alias("ref"), F.col("new_ref").alias("__ref"))
    return mapped.join(stands, ["doc", "ref"]).withColumn("ref", F.col("__ref")).drop("__ref")


def re_mapped(mapped: DataFrame, changes: DataFrame, clauses: DataFrame, extract: Step, map_to: Step) -> DataFrame:
    """Mappings of the new version, with ``fresh``: those of standing clauses are carried over, the rest is extracted and mapped anew.

    ``mapped``: rows (doc, ref, ...) of the old version, as ``map_to(extract(clauses))`` makes them from clauses
    (doc, ref, text). ``changes``: the alignment of both versions. Equals the same steps on all clauses of the new
    version where the steps look at one clause at a time; the work grows with the changed clauses alone.
    """
    redo, _ = affected(changes)
    fresh = map_to(extract(clauses.join(redo, ["doc", "ref"], "left_semi")))
    return carried_over(mapped, changes).withColumn("fresh", F.lit(False)).unionByName(fresh.withColumn("fresh", F.lit(True)))


def re_mapped_beside(versions: DataFrame, extract: Step, map_to: Step) -> DataFrame:
    """As ``re_mapped``, where both versions of a clause stand in one row (doc, ref, old_text, new_text): nothing has to be joined.

    A null text is a clause that the version doesn't have. Standing clauses take their old mapping, the rest is
    extracted and mapped anew; each clause goes through the steps once.
    """
    of = lambda rows, text: map_to(extract(rows.select("doc", "ref", F.col(text).alias("text"))))
    stands = versions.where("old_text = new_text")
    redo = versions.where("new_text IS NOT NULL AND NOT old_text <=> new_text")
    return of(stands, "old_text").withColumn("fresh", F.lit(False)).unionByName(of(redo, "new_text").withColumn("fresh", F.lit(True)))


def committed(store: VersionStore, event: str, at: Column, mapped: DataFrame, changes: DataFrame, direct: DataFrame, note: str = "") -> None:
    """Appends the fresh rows of ``mapped`` to the store and closes what the changed clauses held, as one event.

    The store's rows are (id, doc, ref, ...) with effective_from. Only clauses that changes reach directly
    (``direct``: doc, ref) are closed; what only uses a changed term stays for review. An event comes in once.
    """
    _, gone = affected(changes)
    hit = gone.join(direct.select("doc", "ref").distinct(), ["doc", "ref"], "left_semi")
    open_rows = store.view().where("superseded_at IS NULL")
    closures = open_rows.join(hit, ["doc", "ref"], "left_semi").select("id", at.cast("timestamp").alias("effective_to"))
    fresh = mapped.where("fresh").drop("fresh").withColumn("effective_from", at.cast("timestamp"))
    store.commit(event, at, fresh, closures, note)
