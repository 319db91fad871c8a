"""Substring dedup by Rabin-Karp hashes of every window of ``width`` words.

Documents are dealt into slices of bounded size, whatever the corpus and the number of partitions. A slice
hashes all its windows and sends each distinct hash once, however often it holds it, so that a passage which a
third of the documents share costs no more than one row a slice. Spark counts the hashes and orders each
one's rows: all but the earliest document's slice hear that their window occurs before. Marked windows merge
into maximal removal intervals.

Before that, windows that can't repeat are left out of the shuffle, without loss: equal windows have equal
least hashes of ``inner`` words within them, so a window repeats only where its least inner hash does. One
position in seven is such a least; Spark counts these first. ``inner`` = 0 sends every window.

Windows are equal where two independent 64-bit hashes are. Words themselves aren't compared: of 10**13
windows (some 100 TB of text), the odds that any two different ones agree in 128 bits are 1.5 in 10**13.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import words
from .common import partitions

#: The bases of the polynomials, odd numbers below 2**64.
BASES = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)
#: Bytes of text of a slice on average; a longer document stands alone.
SLICE_BYTES = 8 << 20


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijection that spreads every bit over all (the finalizer of MurmurHash3)."""
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def sliding(values: np.ndarray, n: int, pick: np.ufunc) -> np.ndarray:
    """``pick`` (minimum or maximum) of every ``n`` neighbouring values."""
    done = 1
    while done < n:
        step = min(done, n - done)
        values, done = pick(values[:-step], values[step:]), done + step
    return values


class Slice:
    """A slice's documents in order (doc_id with null last, then the text's hash) and its windows."""

    def __init__(self, table: pa.Table, width: int, inner: int) -> None:
        self.table = table.combine_chunks().sort_by([("doc_id", "ascending"), ("text_hash", "ascending")])
        self.codes, self.at, self.distinct = words.split(self.table["text"].combine_chunks())
        self.width, self.inner = width, inner
        self.names = self.distinct.cast(pa.binary()).to_pylist()
        n, own = len(self.codes), self.at[:-1]
        # no window runs into the next document
        ends = np.zeros(n + 1, np.int64)
        np.add.at(ends, np.maximum(self.at[1:] - width + 1, own), 1)
        np.add.at(ends, self.at[1:], -1)
        self.starts = np.flatnonzero(np.cumsum(ends[:-1]) == 0)
        if inner and len(self.starts):
            g = self.rolled(0, inner)
            self.least = sliding(g, width - inner + 1, np.minimum)[self.starts]
            # an inner window is chosen where a window around it has it as its least
            chosen = np.zeros(len(g), np.uint64)
            covered = np.zeros(n + 1, np.int64)
            covered[self.starts] += 1
            covered[self.starts + width - inner + 1] -= 1
            most = np.zeros(n - width + 1, np.uint64)
            most[self.starts] = self.least
            pad = np.zeros(width - inner, np.uint64)
            chosen = sliding(np.concatenate([pad, most, pad]), width - inner + 1, np.maximum)
            picked = g[(chosen == g) & (np.cumsum(covered[: len(g)]) > 0)]
            self.anchors, counts = np.unique(picked, return_counts=True)
            self.twice = self.anchors[counts > 1]

    def rolled(self, seed: int, size: int) -> np.ndarray:
        """Rabin-Karp hashes of all runs of ``size`` words, those across documents included."""
        each = np.fromiter((xxhash.xxh64_intdigest(w, seed) for w in self.names), np.uint64, len(self.names))[self.codes] if len(self.codes) else np.zeros(0, np.uint64)
        h = np.zeros(max(0, len(each) - size + 1), np.uint64)
        for j in range(size):
            h = h * np.uint64(BASES[seed]) + each[j : j + len(h)]
        return mixed(h)

    def able(self, anchors: np.ndarray | None) -> np.ndarray:
        """Windows that may repeat: within the slice, and with ``anchors`` in others too."""
        if not len(self.starts):
            return np.zeros(0, np.int64)
        if not self.inner:
            return np.arange(len(self.starts))
        known = self.twice if anchors is None else np.union1d(self.twice, anchors)
        at = np.searchsorted(known, self.least)
        return np.flatnonzero(known[np.minimum(at, len(known) - 1)] == self.least) if len(known) else np.zeros(0, np.int64)

    def firsts(self, found: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of the windows ``found``: the first of each distinct one, its two hashes, and the other windows."""
        at = self.starts[found]
        a, b = (self.rolled(seed, self.width)[at] for seed in (0, 1)) if len(at) else (np.zeros(0, np.uint64),) * 2
        order = np.lexsort((found, b, a))
        new = np.ones(len(order), bool)
        new[1:] = (a[order][1:] != a[order][:-1]) | (b[order][1:] != b[order][:-1])
        first = order[new]
        return found[first], a[first], b[first], found[order[~new]]


def _long(x: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(x).view(np.int64))


def remove_repeats(docs: DataFrame, width: int = 20, text: str = "text", doc_id: str = "doc_id", inner: int = 8, slice_bytes: int = SLICE_BYTES) -> DataFrame:
    """One row for each row of ``docs``: doc_id, n_words, n_removed, removed (maximal intervals of word positions, end exclusive), kept (text of the kept words joined by a space).

    A word goes where it lies in a window of ``width`` words of its document whose word sequence also starts
    earlier: in a smaller doc_id, or earlier in the same document. Windows are judged on the input. Null texts
    have no words. Of rows with one doc_id, that with the smaller XXH64 of the text counts as earlier, and of
    equal rows one does; null doc_ids come after all others. No rows give no rows; other columns are ignored.
    """
    inner = min(inner, width)
    spark = docs.sparkSession
    parts = partitions(spark)
    rows = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text"))
    total = rows.agg(F.sum(F.octet_length("text").cast("bigint"))).first()[0] or 0
    slices = max(2 * parts, math.ceil(total / slice_bytes))
    # rows of one id and text are dealt out by where they lie, so that no slice holds all of them
    keyed = rows.withColumn("text_hash", F.xxhash64("text"))
    keyed = keyed.withColumn("slice", F.pmod(F.xxhash64("doc_id", "text_hash", F.spark_partition_id()), F.lit(slices)).cast("int"))
    # one shuffle of the texts, read by each of the steps below
    dealt = keyed.repartition(parts, "slice")

    def chosen(key: tuple, table: pa.Table) -> pa.Table:
        own = Slice(table, width, inner)
        anchors = own.anchors if len(own.starts) else np.zeros(0, np.uint64)
        return pa.table({"slice": pa.array(np.full(len(anchors), key[0].as_py(), np.int32)), "anchor": _long(anchors)})

    def hashed(key: tuple, table: pa.Table, shared: pa.Table) -> pa.Table:
        own = Slice(table, width, inner)
        first, a, b, _ = own.firsts(own.able(np.asarray(shared["anchor"]).astype(np.int64).view(np.uint64)))
        doc = np.searchsorted(own.at, own.starts[first], side="right") - 1 if len(first) else np.zeros(0, np.int64)
        ids, hashes = (own.table[k].combine_chunks().take(pa.array(doc)) for k in ("doc_id", "text_hash"))
        return pa.table({"slice": pa.array(np.full(len(first), key[0].as_py(), np.int32)), "one": _long(a), "two": _long(b), "doc_id": ids, "text_hash": hashes, "at": pa.array(own.starts[first].astype(np.int32) if len(first) else np.zeros(0, np.int32))})

    def cut(key: tuple, table: pa.Table, later: pa.Table) -> pa.Table:
        own = Slice(table, width, inner)
        _, _, _, again = own.firsts(own.able(None))
        gone_at = np.concatenate([own.starts[again], np.asarray(later["at"]).astype(np.int64)]).astype(np.int64)
        marks = np.zeros(len(own.codes) + 1, np.int64)
        marks[gone_at] += 1  # each place once
        marks[gone_at + width] -= 1
        gone = np.cumsum(marks[:-1]) > 0
        names = own.distinct.to_pylist()
        out: dict[str, list] = {"n_words": [], "n_removed": [], "removed": [], "kept": []}
        for i, j in zip(own.at[:-1].tolist(), own.at[1:].tolist()):
            g = gone[i:j]
            turns = np.flatnonzero(np.diff(g.astype(np.int8), prepend=0, append=0)).tolist()
            out["n_words"].append(j - i)
            out["n_removed"].append(int(g.sum()))
            out["removed"].append([{"first": x, "end": y} for x, y in zip(turns[::2], turns[1::2])])
            out["kept"].append(" ".join([names[c] for c in own.codes[i:j][~g].tolist()]))
        spans = pa.list_(pa.struct([("first", pa.int32()), ("end", pa.int32())]))
        return pa.table([own.table["doc_id"], pa.array(out["n_words"], pa.int64()), pa.array(out["n_removed"], pa.int64()), pa.array(out["removed"], spans), pa.array(out["kept"], pa.string())], ["doc_id", "n_words", "n_removed", "removed", "kept"])

    by_slice = dealt.groupBy("slice")
    if inner:
        anchors = by_slice.applyInArrow(chosen, "slice int, anchor bigint")
        # a hash has one row a slice at most, a vanishing share of all rows
        shared = anchors.withColumn("n", F.count("*").over(W.partitionBy("anchor"))).where("n > 1").select("slice", "anchor")
    else:
        shared = spark.createDataFrame([], "slice int, anchor bigint")
    windows = by_slice.cogroup(shared.groupBy("slice")).applyInArrow(hashed, "slice int, one bigint, two bigint, doc_id bigint, text_hash bigint, at int")
    earlier = W.partitionBy("one", "two").orderBy(F.col("doc_id").asc_nulls_last(), "text_hash", "slice")
    later = windows.withColumn("nth", F.row_number().over(earlier)).where("nth > 1").select("slice", "at")
    return by_slice.cogroup(later.groupBy("slice")).applyInArrow(cut, "doc_id bigint, n_words bigint, n_removed bigint, removed array<struct<first:int,end:int>>, kept string")
