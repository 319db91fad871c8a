"""SimHash near-duplicates by deletion-variant signatures.

A 64-bit fingerprint is cut into two 32-bit segments: of two fingerprints that differ in at most two bits,
one segment differs in at most one. Each segment is indexed under its 32 variants with one bit as wildcard,
so such pairs meet in an equality join, and the whole fingerprint is then verified. Equal fingerprints are
one entry. Where more than ``DENSE`` distinct fingerprints share a variant, theirs are indexed once more
under all variants of the whole fingerprint with two bits as wildcards: such a bucket holds four at most.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import components, let, small_batches, written

#: Distinct fingerprints of one variant that are compared with each other; more of them take the two-wildcard index.
DENSE = 32
#: Shingles whose bits are counted at once.
BLOCK = 1 << 16


def fingerprint(text: str | None, width: int = 3) -> int:
    """SimHash of the text's shingles of ``width`` words, with repeats, as an unsigned number.

    Words are split at ASCII white space after lower-casing A-Z; fewer words than ``width`` make one shingle,
    no words give 0. A bit is set where over half the shingles' XXH64 (seed 42) have it.
    """
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    joined, ends = b" ".join(words), np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1]).tolist()
    ends = ends.tolist()
    hashes = np.array([xxhash.xxh64_intdigest(joined[a:b], 42) for a, b in zip(starts, ends[min(width, len(words)) - 1 :])], "<u8")
    # a bit takes a byte here, so long texts are counted block by block
    bits = sum(np.unpackbits(hashes[at : at + BLOCK].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0) for at in range(0, len(hashes), BLOCK))
    return sum(1 << i for i in np.flatnonzero(2 * bits > len(hashes)).tolist())


def fingerprints(docs: DataFrame, width: int = 3, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Rows (doc_id, text_hash, fp long) for each row of ``docs``, the fingerprint's bits as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.array([fingerprint(t, width) for t in batch["text"].to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["text_hash"], pa.array(fps)], ["doc_id", "text_hash", "fp"])

    small_batches(docs.sparkSession)
    rows = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.xxhash64(text).alias("text_hash"), F.col(text).alias("text"))
    return rows.mapInArrow(run, "doc_id bigint, text_hash bigint, fp bigint")


def _without(fp: Column, *bits: Column) -> Column:
    for b in bits:
        fp = fp.bitwiseAND(F.bitwise_not(F.call_function("shiftleft", F.lit(1).cast("bigint"), b.cast("int"))))
    return fp


def one_wildcard(fps: DataFrame) -> DataFrame:
    """Rows (bit, rest, fp): 64 for each fingerprint; ``rest`` is the segment that holds ``bit``, without it."""
    bit = F.explode(F.sequence(F.lit(0), F.lit(63))).alias("bit")
    segment = F.when(F.col("bit") < 32, F.lit(0xFFFFFFFF).cast("bigint")).otherwise(F.bitwise_not(F.lit(0xFFFFFFFF).cast("bigint")))
    return fps.select("fp", bit).select(F.col("bit").cast("tinyint").alias("bit"), _without(F.col("fp").bitwiseAND(segment), F.col("bit")).alias("rest"), "fp")


def two_wildcards(fps: DataFrame) -> DataFrame:
    """Rows (i, j, rest, fp): 2,016 for each fingerprint, which is kept but for bits i < j."""
    i = fps.select("fp", F.explode(F.sequence(F.lit(0), F.lit(62))).alias("i"))
    both = i.select("fp", "i", F.explode(F.sequence(F.col("i") + 1, F.lit(63))).alias("j"))
    return both.select(F.col("i").cast("tinyint").alias("i"), F.col("j").cast("tinyint").alias("j"), _without(F.col("fp"), F.col("i"), F.col("j")).alias("rest"), "fp")


def links(fps: DataFrame, distance: int = 2, dense: int = DENSE) -> DataFrame:
    """Pairs (a, b) of distinct fingerprints at ``distance`` (at most 2) or fewer bits, enough to reach every linked one.

    ``fps`` holds distinct values. Within a dense variant a pair may come as a path through a third
    fingerprint only where all three are within two bits of each other.
    """
    keyed = one_wildcard(fps)
    counts = keyed.groupBy("bit", "rest").agg(F.count("*").alias("n")).where("n > 1")
    counts = written(counts, "simhash-variants")
    # a shuffle whatever the size: shared variants grow with the documents, so that a broadcast would only serve small tables
    shared = written(keyed.join(counts.hint("merge"), ["bit", "rest"]), "simhash-shared")
    near = lambda x, y: F.bit_count(x.bitwiseXOR(y)) <= distance
    # at most ``dense`` in a group here
    groups = shared.where(F.col("n") <= dense).groupBy("bit", "rest").agg(F.array_sort(F.collect_list("fp")).alias("all"))
    pairs = groups.select(F.explode(let(F.col("all"), lambda all_: F.flatten(F.transform(all_, lambda x: F.transform(F.filter(all_, lambda y: (y > x) & near(x, y)), lambda y: F.struct(x.alias("a"), y.alias("b"))))))).alias("p"))
    few = pairs.select("p.a", "p.b")
    # every two of a dense variant are here with all their variants of two wildcards, each bucket of which holds four at most
    many = two_wildcards(shared.where(F.col("n") > dense).select("fp").distinct())
    least = many.groupBy("i", "j", "rest").agg(F.array_sort(F.collect_list("fp")).alias("all")).where(F.size("all") > 1)
    pairs = least.select(F.explode(let(F.col("all"), lambda all_: F.flatten(F.transform(all_, lambda x: F.transform(F.filter(all_, lambda y: (y > x) & near(x, y)), lambda y: F.struct(x.alias("a"), y.alias("b"))))))).alias("p"))
    return few.union(pairs.select("p.a", "p.b")).distinct()


def grouped(docs: DataFrame, width: int = 3, distance: int = 2, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """The rows of ``fingerprints`` with component_id."""
    table = written(fingerprints(docs, width, text, doc_id), "fingerprints")
    # copies are combined before the shuffle
    owner = written(table.groupBy("fp").agg(F.min("doc_id").alias("least")), "fingerprint-owners")
    found = components(links(owner.select("fp"), distance))
    # a component of fingerprints takes the least document of any of them
    member = owner.join(found, owner["fp"] == found["node"]).select("fp", "least", "component")
    least = written(member.groupBy("component").agg(F.min("least").alias("component_least")), "component-least")
    merged = member.join(least, "component").select(F.col("fp").alias("linked_fp"), "component_least")
    final = written(owner.join(merged, owner["fp"] == merged["linked_fp"], "left").select("fp", F.coalesce("component_least", "least").alias("component_id")), "fingerprint-components")
    return table.join(final, "fp", "left")


def near_groups(docs: DataFrame, width: int = 3, distance: int = 2, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row for each row of ``docs``: doc_id, fingerprint (16 hex digits), component_id.

    Documents link when their fingerprints differ in ``distance`` bits or fewer; component_id is the smallest
    doc_id reachable over links, itself included. Null and empty texts have fingerprint zero and link like any
    other; a null doc_id is passed over for component_id unless its component has no other. No rows give no
    rows; repeated rows are repeated; other columns are ignored.
    """
    out = grouped(docs, width, distance, text, doc_id)
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def drop_near_copies(docs: DataFrame, width: int = 3, distance: int = 2, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """``docs`` with the document of the smallest doc_id of each component only, columns as they were.

    Rows are told apart by doc_id and text: rows that share a doc_id go each by its own component.
    """
    groups = grouped(docs, width, distance, text, doc_id)
    gone = groups.where("not (doc_id <=> component_id)").select(F.col("doc_id").alias("__gone_id"), F.col("text_hash").alias("__gone_text")).distinct()
    return docs.join(gone, docs[doc_id].eqNullSafe(gone["__gone_id"]) & (F.xxhash64(docs[text]) == gone["__gone_text"]), "left_anti")
