"""Near copies: documents whose sets of five-word shingles have a Jaccard similarity of 0.8 or more, or whose SimHashes op5 links.

A SimHash of sets at similarity 0.8 differs in about 15 % of its bits, so that segments with one wildcard
would need hundreds of rows a document. Candidates are found by MinHash instead: ``BANDS`` bands of ``ROWS``
least values each. Two sets at similarity s share a band with probability s ** ROWS, at 0.8 all but 3 in a
million pairs share one.

Links are needed for components only, so a bucket's sets are held against one of them first, and in large
buckets in some rounds against a few others drawn by hash, of other components as found so far: a large group
of copies grows together from as many pairs as it has sets. What that leaves in different components is held
against each other: all pairs of a small bucket, and of the sets in larger ones all that can be similar by an
exact join on rare shingles (``prefix_pairs``), however many share a bucket. Pairs that their signatures rule out are dropped, all others are verified on the whole sets, which
are worked out again for the documents concerned alone. The links of ``simhash`` are added.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import simhash
from .common import components, forget, let, small_batches, written

BANDS, ROWS = 32, 5
#: Sets of one bucket that are compared with each other; more of them take the join on rare shingles.
DENSE = 32
#: Least number of equal bytes of two signatures. At similarity 0.8 each of the 160 is equal with probability 0.8 or
#: more, so that fewer come in one of 10 ** 9 pairs (binomial tail).
LEAST_EQUAL = 96
#: Rounds in which the sets of large buckets are held against others drawn by hash, and in how many of its buckets a set is drawn for.
ROUNDS, DRAWN = 2, 4
#: Sets of a large bucket among which partners are drawn.
GROUP = 1000
#: Sizes are dealt into classes, each 2 % wider than the one before.
STEP = 1.02
_RNG = np.random.default_rng(42)
_XOR = _RNG.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64)
_ODD = _RNG.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingles(text: str | None, width: int = 5) -> np.ndarray:
    """Sorted distinct hashes of the text's shingles; words and hashes are those of ``simhash.fingerprint``."""
    words = (text or "").encode().lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    joined, ends = b" ".join(words), np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1]).tolist()
    ends = ends.tolist()
    return np.unique(np.array([xxhash.xxh64_intdigest(joined[a:b], 42) for a, b in zip(starts, ends[min(width, len(words)) - 1 :])], np.uint64))


def least_values(hashes: np.ndarray) -> np.ndarray:
    """The least value of each of BANDS * ROWS mixes of the hashes."""
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(hashes), 1024):
        part = hashes[at : at + 1024]
        for i in range(0, BANDS * ROWS, 32):
            mixed = (part[None, :] ^ _XOR[i : i + 32, None]) * _ODD[i : i + 32, None]
            least[i : i + 32] = np.minimum(least[i : i + 32], mixed.min(axis=1))
    return least


def band_keys(hashes: np.ndarray) -> list[int]:
    """A key for each band, its number hashed along; an empty set has none."""
    return [xxhash.xxh64_intdigest(row.tobytes(), b) for b, row in enumerate(least_values(hashes).reshape(BANDS, ROWS))] if len(hashes) else []


def _signed(x: list | np.ndarray) -> pa.Array:
    return pa.array(np.asarray(x, np.uint64).view(np.int64))


def _lists(rows: list) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum([len(r) for r in rows])]).astype(np.int32)
    flat = np.concatenate([np.asarray(r, np.uint64) for r in rows]) if rows else np.zeros(0, np.uint64)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat.view(np.int64)))


def signatures(docs: DataFrame, width: int = 5, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Rows (doc_id, text_hash, fp, node, size, keys, signature) for each row of ``docs``.

    fp is op5's fingerprint, node one number for equal sets, size the set's; signature holds a byte of each least value.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 1000):
                batch, rows = whole.slice(at, 1000), []
                for t in batch["text"].to_pylist():
                    own = shingles(t, width)
                    least = least_values(own)
                    keys = [xxhash.xxh64_intdigest(row.tobytes(), b) for b, row in enumerate(least.reshape(BANDS, ROWS))] if len(own) else []
                    rows.append((simhash.fingerprint(t), xxhash.xxh64_intdigest(own.tobytes(), 7), len(own), keys, (least >> np.uint64(40)).astype(np.uint8).tobytes()))
                fp, node, size, keys, signature = zip(*rows)
                columns = [batch["doc_id"], batch["text_hash"], _signed(fp), _signed(node), pa.array(size, pa.int32()), _lists(keys), pa.array(signature, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "text_hash", "fp", "node", "size", "keys", "signature"])

    small_batches(docs.sparkSession)
    rows = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.xxhash64(text).alias("text_hash"), F.col(text).alias("text"))
    return rows.mapInArrow(run, "doc_id bigint, text_hash bigint, fp bigint, node bigint, size int, keys array<bigint>, signature binary")


def sets(docs: DataFrame, nodes: DataFrame, width: int = 5, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Rows (node, hashes) of ``nodes`` (node, text_hash, doc_id), from the document that each names; a document's repeats may give a node again."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                some = batch.slice(at, 500)
                yield pa.RecordBatch.from_arrays([some["node"], _lists([shingles(t, width) for t in some["text"].to_pylist()])], ["node", "hashes"])

    small_batches(docs.sparkSession)
    texts = docs.select(F.xxhash64(text).alias("text_hash"), F.col(doc_id).cast("bigint").alias("own_id"), F.col(text).alias("text"))
    # a shuffle at every size: the nodes grow with the documents
    named = texts.join(nodes.select("node", "text_hash", "doc_id").hint("merge"), "text_hash").where(F.col("own_id").eqNullSafe(F.col("doc_id")))
    return named.select("node", "text").mapInArrow(run, "node bigint, hashes array<bigint>")


def _sizes_fit(m: Column, n: Column) -> Column:
    return (5 * m >= 4 * n) & (5 * n >= 4 * m)


def likely(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """The ``pairs`` (a, b) whose sizes and signatures allow a similarity of 0.8."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = (np.frombuffer(b"".join(batch[k].to_pylist()), np.uint8).reshape(-1, BANDS * ROWS) for k in ("x", "y"))
            yield batch.filter(pa.array((x == y).sum(axis=1) >= LEAST_EQUAL)).select(["a", "b"])

    side = lambda node, size, signature: nodes.select(F.col("node").alias(node), F.col("size").alias(size), F.col("signature").alias(signature)).hint("merge")
    both = pairs.join(side("a", "m", "x"), "a").join(side("b", "n", "y"), "b").where(_sizes_fit(F.col("m"), F.col("n")))
    return both.select("a", "b", "x", "y").mapInArrow(run, "a bigint, b bigint")


def verified(pairs: DataFrame, own: DataFrame) -> DataFrame:
    """The ``pairs`` (a, b) whose sets, in ``own`` (node, hashes), have a Jaccard similarity of 0.8 or more."""
    left, right = own.select(F.col("node").alias("a"), F.col("hashes").alias("x")), own.select(F.col("node").alias("b"), F.col("hashes").alias("y"))
    both = pairs.join(right.hint("merge"), "b").join(left.hint("merge"), "a")
    common = both.select("a", "b", (F.size("x") + F.size("y")).alias("n"), F.size(F.array_intersect("x", "y")).alias("k"))
    return common.where(9 * F.col("k") >= 4 * F.col("n")).select("a", "b")


def bucket_pairs(shared: DataFrame) -> DataFrame:
    """All pairs (a, b), a < b, of the sets of a bucket, from rows (key, node) of buckets of bounded size."""
    groups = shared.groupBy("key").agg(F.array_sort(F.collect_list("node")).alias("all"))
    pairs = let(F.col("all"), lambda all_: F.flatten(F.transform(all_, lambda x: F.transform(F.filter(all_, lambda y: y > x), lambda y: F.struct(x.alias("a"), y.alias("b"))))))
    return groups.select(F.explode(pairs).alias("p")).select("p.a", "p.b").distinct()


def crowd_stars(shared: DataFrame) -> DataFrame:
    """Each set with the least of all its buckets: rows (a, b)."""
    return shared.where(F.col("node") != F.col("least")).groupBy(F.col("node").alias("b")).agg(F.min("least").alias("a")).select("a", "b")


def drawn_pairs(crowd: DataFrame, component: DataFrame, turn: int) -> DataFrame:
    """Rows (a, b): each set of a large bucket with one of another component among those just before it, in an order by hash, in ``DRAWN`` of its buckets.

    ``crowd``: key, node, n. The buckets are those of the least hashes, so that sets which share many draw in the same ones;
    a bucket is dealt into groups of about ``GROUP`` sets, so that none meets whole in one task.
    """
    held = crowd.join(component.hint("merge"), "node")
    mixed = _across(held, ["key"])
    seeded = lambda *c: F.xxhash64(F.lit(turn), *c)
    mine = mixed.groupBy("node", "component").agg(F.slice(F.array_sort(F.collect_list(F.struct(seeded("key").alias("h"), "key", "n"))), 1, DRAWN).alias("some"))
    rows = mine.select("node", "component", F.explode("some").alias("x")).select("node", "component", "x.key", F.pmod(seeded("node"), F.ceil(F.col("x.n") / GROUP)).alias("part"))
    order = W.partitionBy("key", "part").orderBy(seeded("node", "key"), "node")
    earlier = F.array(*[F.lag(F.struct("node", "component"), i).over(order) for i in range(1, 7)])
    other = F.get(F.filter("earlier", lambda x: x.isNotNull() & (x["component"] != F.col("component"))), 0)
    pairs = rows.withColumn("earlier", earlier).select("node", other.alias("x")).where("x IS NOT NULL")
    return pairs.select(F.least("node", "x.node").alias("a"), F.greatest("node", "x.node").alias("b")).distinct()


def _across(named: DataFrame, by: list[str]) -> DataFrame:
    """The rows (by..., node, component) of groups that more than one component has."""
    mixed = named.groupBy(*by).agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo <> hi").select(*by)
    return named.join(written(mixed, "near-mixed").hint("merge"), by)


def prefix_pairs(own: DataFrame, component: DataFrame) -> DataFrame:
    """All pairs (a, b) of different components whose sets, in ``own`` (node, hashes), can have a similarity of 0.8: an exact join on rare shingles.

    Shingles are ordered, the rarest first. Two similar sets share one so early in both that what is left
    behind it can still make up 4/9 of their sizes together, which is what 0.8 needs. Sets meet by such a
    shingle and their classes of size, so that each knows about how large the other is when it asks whether
    its place is early enough. Groups of one component aren't joined.
    """
    each = own.dropDuplicates(["node"]).select("node", F.size("hashes").alias("size"), F.explode("hashes").alias("h"))
    count = written(each.groupBy("h").agg(F.count("*").alias("df")).where("df > 1"), "near-shingle-counts")
    # shingles of one set alone come first: only their number matters
    order = F.row_number().over(W.partitionBy("node").orderBy("df", "h"))
    shared = each.join(count.hint("merge"), "h").select("node", "size", "h", order.alias("nth"), F.count("*").over(W.partitionBy("node")).alias("n"))
    left = (F.col("n") - F.col("nth") + 1).alias("left")  # this one and all behind it
    early = written(shared.select("node", "size", "h", left).where(5 * F.col("left") >= 4 * F.col("size")), "near-prefixes")
    cls = lambda s: F.floor(F.log(s) / F.log(F.lit(STEP))).cast("int")
    low = lambda c: F.pow(F.lit(STEP), c)
    wide = early.withColumn("own", cls(F.col("size")))
    # classes of smaller sets down to 0.8, of larger ones up to 1.25; one more on either side for rounding
    as_large = wide.withColumn("other", F.explode(F.sequence(F.col("own") - 12, F.col("own") + 1))).where(9 * F.col("left") >= 4 * (F.col("size") + low(F.col("other") - 1)) - 1)
    as_small = wide.withColumn("other", F.explode(F.sequence(F.col("own") - 1, F.col("own") + 12))).where(9 * F.col("left") >= 4 * (F.col("size") + low(F.col("other") - 1)) - 1)
    # key: shingle, class of the larger, class of the smaller
    rows = as_large.select("h", F.col("own").alias("p"), F.col("other").alias("q"), "node", "size", "left", F.lit(1).alias("large")).unionByName(as_small.select("h", F.col("other").alias("p"), F.col("own").alias("q"), "node", "size", "left", F.lit(0).alias("large")))
    named = _across(rows.join(component.hint("merge"), "node"), ["h", "p", "q"])
    kept = written(named, "near-mixed-prefixes")
    a = kept.where("large = 1").select("h", "p", "q", F.col("node").alias("u"), F.col("component").alias("cu"), F.col("size").alias("m"), F.col("left").alias("x"))
    b = kept.where("large = 0").select("h", "p", "q", F.col("node").alias("v"), F.col("component").alias("cv"), F.col("size").alias("n"), F.col("left").alias("y"))
    # both know of each other now; of one class each pair meets twice
    fits = (9 * F.least("x", "y") >= 4 * (F.col("m") + F.col("n"))) & _sizes_fit(F.col("m"), F.col("n")) & ((F.col("p") != F.col("q")) | (F.col("u") < F.col("v")))
    pairs = a.hint("merge").join(b, ["h", "p", "q"]).where((F.col("cu") != F.col("cv")) & fits)
    return pairs.select(F.least("u", "v").alias("a"), F.greatest("u", "v").alias("b")).distinct()


def links(docs: DataFrame, table: DataFrame, dense: int = DENSE, width: int = 5, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Pairs (a, b) of nodes at a Jaccard similarity of 0.8 or more, enough to reach every linked one; ``table`` holds the written rows of ``signatures``."""
    kept: list[DataFrame] = []

    def held(df: DataFrame, name: str) -> DataFrame:
        kept.append(written(df, "near-" + name))
        return kept[-1]

    some = F.min(F.struct("text_hash", "doc_id", "size", "signature", "keys")).alias("x")
    nodes = held(table.where("size > 0").groupBy("node").agg(some).select("node", "x.*"), "nodes")
    counts = held(nodes.select("node", F.explode("keys").alias("key")).groupBy("key").agg(F.count("*").alias("n"), F.min("node").alias("least")).where("n > 1"), "buckets")
    shared = held(nodes.select("node", F.explode("keys").alias("key")).join(counts.hint("merge"), "key"), "shared")
    crowd = shared.where(F.col("n") > dense)
    few = held(likely(bucket_pairs(shared.where(F.col("n") <= dense)), nodes), "few")
    # each set is held against one other of its small buckets and one of its large ones first
    star = held(few.groupBy("b").agg(F.min("a").alias("a")).select("a", "b").union(likely(crowd_stars(crowd), nodes)).distinct(), "star")
    named = crowd.select("node").union(few.select("a")).union(few.select("b")).union(star.select("a")).union(star.select("b")).distinct()
    own = held(sets(docs, nodes.select("node", "text_hash", "doc_id").join(named.hint("merge"), "node", "left_semi"), width, text, doc_id), "sets")
    first, tried = held(verified(star, own), "first"), star

    def joined(found: DataFrame) -> DataFrame:
        """Components of the sets in question by the links found so far."""
        by_link = components(found)
        kept.append(by_link)
        return held(named.join(by_link.hint("merge"), "node", "left").select("node", F.coalesce("component", "node").alias("component")), "joined")

    component = joined(first)
    for turn in range(ROUNDS):
        drawn = held(likely(drawn_pairs(crowd.select("key", "node", "n"), component, turn).join(tried.hint("merge"), ["a", "b"], "left_anti"), nodes), "drawn")
        if drawn.isEmpty():
            break
        more = held(verified(drawn, own), "more")
        tried = tried.union(drawn)
        if not more.isEmpty():
            first = first.union(more)
            component = joined(first)
    side = lambda k: component.select(F.col("node").alias(k), F.col("component").alias("c" + k)).hint("merge")
    apart = few.join(side("a"), "a").join(side("b"), "b").where("ca <> cb").select("a", "b")
    mixed = _across(crowd.select("key", "node").join(component.hint("merge"), "node"), ["key"]).select("node").distinct()
    rare = likely(prefix_pairs(own.join(mixed.hint("merge"), "node", "left_semi"), component), nodes)
    asked = held(apart.union(rare).distinct().join(tried.hint("merge"), ["a", "b"], "left_anti"), "asked")
    out = written(first.union(verified(asked, own)), "near-links")
    for table_ in kept:
        forget(table_)
    return out


def simhash_links(table: DataFrame) -> DataFrame:
    """Pairs (a, b) of nodes that join the sets whose fingerprints are equal or op5 links."""
    owner = written(table.groupBy("fp").agg(F.min("node").alias("owner")), "near-fingerprints")
    equal = table.select("fp", "node").distinct().join(owner, "fp").select(F.col("owner").alias("a"), F.col("node").alias("b")).where("a <> b")
    side = lambda name, node: owner.select(F.col("fp").alias(name), F.col("owner").alias(node))
    linked = simhash.links(owner.select("fp")).toDF("p", "q").join(side("p", "a"), "p").join(side("q", "b"), "q").select("a", "b")
    return equal.union(linked)


def drop_near_copies(docs: DataFrame, width: int = 5, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """``docs`` with the document of the smallest doc_id of each component only, columns as they were.

    Documents link when their shingles have a Jaccard similarity of 0.8 or more, and where op5 links them. Texts
    without words are equal. Rows are told apart by doc_id and text; a null doc_id stays only in a component without others.
    """
    table = written(signatures(docs, width, text, doc_id), "near-signatures")
    near = links(docs, table, DENSE, width, text, doc_id)
    found = components(near.union(simhash_links(table)))
    owner = written(table.groupBy("node").agg(F.min("doc_id").alias("least")), "near-owners")
    named = written(owner.join(found, "node", "left").select("node", "least", F.coalesce("component", "node").alias("component")), "near-components")
    first = written(named.groupBy("component").agg(F.min("least").alias("keep")), "near-keep")
    final = written(named.join(first, "component").select("node", "keep"), "near-final")
    gone = table.select("doc_id", "text_hash", "node").join(final, "node").where("not (doc_id <=> keep)")
    gone = written(gone.select(F.col("doc_id").alias("__gone_id"), F.col("text_hash").alias("__gone_text")).distinct(), "near-gone")
    for table_ in (table, near, found, owner, named, first, final):
        forget(table_)
    return docs.join(gone, docs[doc_id].eqNullSafe(gone["__gone_id"]) & (F.xxhash64(docs[text]) == gone["__gone_text"]), "left_anti")
