"""Retrieval by vectors and by shared wording."""

from __future__ import annotations

from collections.abc import Iterator
from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import body, content_words, once, sentences, word_pairs
from ..session import small


def nearest(queries: DataFrame, items: DataFrame, k: int, block: int = 8192) -> DataFrame:
    """The ``k`` nearest items of each query by cosine distance: rows (q_id, i_id, distance, rank); both have id (a whole number) and vec.

    Exact, and every pair is computed. Items and queries go in packed blocks of vectors, ``block`` at most, and a
    task multiplies each block of its share of the items with each of its share of the queries as matrices. It keeps
    each query's best ``k`` so far, so that later blocks are only looked through for what may beat them. What the
    product in single precision lets through is worked out again in double precision. Equal distances rank by id.
    A task holds the queries of its share, whose size is bounded, and streams the items; queries are dealt to more
    tasks before items are, since each share of the items returns ``k`` rows a query.
    """
    def good(rows: DataFrame) -> DataFrame:
        """Rows that are near something: no null, some length."""
        return rows.select(F.col("id").cast("bigint").alias("id"), F.col("vec").cast("array<double>").alias("vec")).where("id IS NOT NULL AND size(vec) > 0 AND NOT exists(vec, x -> x IS NULL)")

    def blocks(rows: DataFrame, size: int, parts: int) -> DataFrame:
        return good(rows).mapInArrow(lambda batches: packed(batches, size), "block bigint, dim int, ids binary, vecs binary").repartition(parts)

    kinds = dict(queries.dtypes)["id"], dict(items.dtypes)["id"]
    sizes = F.count("*").alias("n"), F.coalesce(F.max(F.size("vec")), F.lit(1)).alias("dim")
    (n, dim), (n_q, dim_q) = (good(x).agg(*sizes).first() for x in (items, queries))
    most = max(1, min(block, (1 << 20) // max(dim, dim_q)))
    tasks = 2 * queries.sparkSession.sparkContext.defaultParallelism
    q_parts = max(1, min(tasks, n_q // 256), -(-held(n_q, dim_q, k) * 2 // HELD))
    i_parts = max(1, min(-(-tasks // q_parts), n // 256), n * dim * 8 >> 27)
    q = blocks(queries, min(max(1, most // 4), max(256, n_q // (4 * q_parts))), q_parts)
    i = blocks(items, min(most, max(256, n // (4 * i_parts))), i_parts)
    pairs = i.crossJoin(q.select(*[F.col(c).alias(f"q_{c}") for c in q.columns]).hint("shuffle_replicate_nl"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for found in best_of_blocks(batches, k):
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in found], names=["q_id", "i_id", "distance"])

    rows = pairs.mapInArrow(run, "q_id bigint, i_id bigint, distance double")
    named = rows.select(F.col("q_id").cast(kinds[0]).alias("q_id"), F.col("i_id").cast(kinds[1]).alias("i_id"), F.round("distance", 6).alias("distance"))
    rank = F.row_number().over(W.partitionBy("q_id").orderBy("distance", "i_id"))
    return named.withColumn("rank", rank).where(F.col("rank") <= k)


NO_KEY = np.iinfo(np.int64).max
#: Numbers that a task holds of its queries at most.
HELD = 16_000_000


def held(n: int, dim: int, k: int) -> int:
    """Numbers held for ``n`` queries: vectors in double and single precision, and their best ``k``."""
    return n * (2 * dim + 3 * k)


def packed(batches: Iterator[pa.RecordBatch], size: int, most: int = 1 << 22) -> Iterator[pa.RecordBatch]:
    """Blocks (block, dim, ids, vecs) of ``size`` vectors of one length at most, from rows (id, vec); numbers go as bytes, which are cheap to move."""
    waiting: dict[int, list] = {}
    n, part = 0, TaskContext.get().partitionId() << 32

    def block(dim: int) -> pa.RecordBatch:
        nonlocal n
        ids, vecs = (np.concatenate(x) for x in zip(*waiting.pop(dim)))
        n += 1
        return pa.RecordBatch.from_arrays([pa.array([part + n], pa.int64()), pa.array([dim], pa.int32()), pa.array([ids.tobytes()]), pa.array([vecs.tobytes()])], names=["block", "dim", "ids", "vecs"])

    for batch in batches:
        dims = pc.list_value_length(batch.column(1)).to_numpy()
        for dim in map(int, np.unique(dims)):
            of = batch.filter(pa.array(dims == dim))
            ids, vecs = of.column(0).to_numpy(), pc.list_flatten(of.column(1)).to_numpy().reshape(-1, dim)
            at = 0
            while at < len(ids):
                mine = waiting.setdefault(dim, [])
                take = size - sum(len(x) for x, _ in mine)
                mine.append((ids[at : at + take], vecs[at : at + take]))
                at += take
                if at <= len(ids):  # the block is whole
                    yield block(dim)
        # of many lengths, none may have a whole block
        if sum(v.size for x in waiting.values() for _, v in x) > most:
            yield from [block(dim) for dim in list(waiting)]
    yield from [block(dim) for dim in list(waiting)]


def in_turn(n: int, term) -> np.ndarray:
    """``term(0) + term(1) + ...``, added in this order as a fold does."""
    total = 0.0
    for d in range(n):
        total = total + term(d)
    return total


def millionths(distance: np.ndarray) -> np.ndarray:
    """Distances rounded half up to 6 places, as whole numbers; NaN is greater than all numbers."""
    x = np.nan_to_num(distance, nan=1e12, posinf=1e11, neginf=-1e11) * 1e6
    key = np.floor(x + 0.5).astype(np.int64)
    for j in np.flatnonzero(np.abs(x - np.floor(x) - 0.5) < 1e-3):  # where doubles can't tell
        key[j] = int((Decimal(repr(float(distance[j]))) * 1000000).to_integral_value(ROUND_HALF_UP))
    return key


class Block:
    """Vectors of one block by id, with their lengths and as unit vectors in single precision; ``copies`` of equal vectors stay at most."""

    def __init__(self, ids: np.ndarray, vecs: np.ndarray, dim: int, copies: int | None = None):
        order = np.argsort(ids, kind="stable")
        ids, vecs = ids[order], vecs.reshape(-1, dim)[order]
        if copies is not None:
            same = np.unique(np.ascontiguousarray(vecs).view(np.dtype((np.void, 8 * dim))).ravel(), return_inverse=True)[1].ravel()
            by = np.argsort(same, kind="stable")
            first = np.flatnonzero(np.r_[True, same[by][1:] != same[by][:-1]])
            nth = np.arange(len(by)) - np.repeat(first, np.diff(np.r_[first, len(by)]))
            stay = np.sort(by[nth < copies])
            ids, vecs = ids[stay], vecs[stay]
        self.ids, self.t = ids, np.ascontiguousarray(vecs.T)
        with np.errstate(all="ignore"):
            self.square = in_turn(dim, lambda d: self.t[d] * self.t[d])
            # lengths that single precision can't be trusted with
            self.odd = ~((self.square > 1e-100) & (self.square < 1e100))
            self.unit = np.where(self.odd[:, None], 0, vecs / np.sqrt(self.square)[:, None]).astype(np.float32)


class Best:
    """The best ``k`` of each query of a block so far."""

    def __init__(self, q: Block, k: int):
        n = len(q.ids)
        self.q, self.key, self.id, self.distance = q, np.full((n, k), NO_KEY), np.zeros((n, k), np.int64), np.zeros((n, k))

    def look(self, items: Block, a: int, b: int) -> None:
        """Looks for better ones of queries ``a`` to ``b`` among the items."""
        q, k, dim = self.q, self.key.shape[1], len(self.q.t)
        near = q.unit[a:b] @ items.unit.T
        slack = 2 * (dim + 8) * 1.2e-7 + 2e-6
        last = self.key[a:b, -1]
        least = np.where(last < NO_KEY, 1 - last * 1e-6, -np.inf)
        odd = bool(items.odd.any() or q.odd[a:b].any())
        if odd:
            near[:, items.odd] = -np.inf
        if (last == NO_KEY).any() and near.shape[1] > k + 1:
            # the query itself may be one of them
            least = np.maximum(least, np.partition(near, near.shape[1] - k - 1, axis=1)[:, near.shape[1] - k - 1])
        least = least - slack
        if odd:
            hit = near >= least[:, None]
            hit[:, items.odd] = True
            hit[q.odd[a:b]] = True
            row, col = np.nonzero(hit)
        else:
            # few queries have better ones in a block, once they have met some
            some = np.flatnonzero(near.max(axis=1) >= least)
            row, col = np.divmod(np.flatnonzero(near[some] >= least[some, None]), near.shape[1])
            row = some[row]
        for s in range(0, len(row), 50_000):
            self.add(items, row[s : s + 50_000] + a, col[s : s + 50_000])

    def add(self, items: Block, row: np.ndarray, col: np.ndarray) -> None:
        with np.errstate(all="ignore"):
            size = np.sqrt(self.q.square[row] * items.square[col])
            distance = 1 - in_turn(len(self.q.t), lambda d: self.q.t[d][row] * items.t[d][col]) / size
        key, id_ = millionths(distance), items.ids[col]
        last_key, last_id = self.key[row, -1], self.id[row, -1]
        # a NaN size comes after all numbers, as in Spark
        stay = ~(size <= 0) & (id_ != self.q.ids[row]) & ((key < last_key) | ((key == last_key) & (id_ < last_id)))
        if not stay.any():
            return
        row, key, id_, distance = row[stay], key[stay], id_[stay], distance[stay]
        k = self.key.shape[1]
        some = np.unique(row)
        held = [x[some].ravel() for x in (self.key, self.id, self.distance)]
        row = np.r_[np.repeat(some, k), row]
        key, id_, distance = (np.r_[x, y] for x, y in zip(held, (key, id_, distance)))
        order = np.lexsort((id_, key, row))
        first = np.searchsorted(row[order], some)
        take = order[first[:, None] + np.arange(k)]
        self.key[some], self.id[some], self.distance[some] = key[take], id_[take], distance[take]

    def rows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        there = self.key < NO_KEY
        return np.repeat(self.q.ids, there.sum(axis=1)), self.id[there], self.distance[there]


def best_of_blocks(batches: Iterator[pa.RecordBatch], k: int, most: int = HELD) -> Iterator[tuple]:
    """Arrays (q_id, i_id, distance): each query's best ``k`` among the items it met; given out early where more than ``most`` numbers would be held."""
    best: dict[tuple, Best] = {}
    at, items = None, None
    for batch in batches:
        for r in range(batch.num_rows):
            block, dim, q_block, q_dim = (batch.column(i)[r].as_py() for i in (0, 1, 4, 5))
            if dim != q_dim:
                continue
            ids, vecs, q_ids, q_vecs = (np.frombuffer(batch.column(i)[r].as_buffer(), kind) for i, kind in ((2, np.int64), (3, float), (6, np.int64), (7, float)))
            if at != (block, dim):
                at, items = (block, dim), Block(ids, vecs, dim, k + 1)
            mine = best.get((q_block, dim))
            if mine is None:
                if sum(held(len(b.q.ids), len(b.q.t), k) for b in best.values()) + held(len(q_ids), dim, k) > most:
                    yield from (b.rows() for b in best.values())
                    best = {}
                mine = best[q_block, dim] = Best(Block(q_ids, q_vecs, dim), k)
            for a in range(0, len(q_ids), 256):
                mine.look(items, a, min(a + 256, len(q_ids)))
    yield from (b.rows() for b in best.values())


def greedy_distinct(ranked: DataFrame, group: list[str], order: list[str], keep: int, clash) -> DataFrame:
    """Of each group's ranked items, those that don't clash with one kept before, ``keep`` at most.

    ``clash`` tells from two structs of the item's columns whether they clash. Groups are short ranked lists.
    """
    columns = [c for c in ranked.columns if c not in group]
    item = F.struct(*order, *[c for c in columns if c not in order])
    lists = ranked.groupBy(*group).agg(F.array_sort(F.collect_list(item)).alias("all"))
    kind = lists.schema["all"].dataType.simpleString()
    fold = F.aggregate("all", F.array().cast(kind), lambda done, x: F.when(F.exists(done, lambda y: clash(x, y)), done).otherwise(F.array_append(done, x)))
    out = lists.select(*group, F.posexplode(F.slice(fold, 1, keep)).alias("kept_rank", "x"))
    return out.select(*group, (F.col("kept_rank") + 1).alias("kept_rank"), "x.*")


def windows(documents: DataFrame, key: str, text: str) -> DataFrame:
    """Sentence windows: every sentence, then every two neighbours; rows (key, ordinal, window)."""
    return documents.select(key, F.posexplode(with_neighbours(sentences(F.col(text)), lambda a, b: F.concat_ws(" ", a, b))).alias("ordinal", "window"))


def with_neighbours(items: Column, joined) -> Column:
    """The items, then every two neighbours ``joined``."""
    def of(s: Column) -> Column:
        last = F.greatest(F.size(s) - 1, F.lit(0))
        return F.concat(s, F.zip_with(F.slice(s, 1, last), F.slice(s, 2, last), joined))

    return F.element_at(F.transform(F.array(items), of), 1)


def wording_matches(queries: DataFrame, documents: DataFrame, query_id: str, query_text: str, key: str, text: str, k: int, stop: list[str] | None = None, least: int = 3) -> DataFrame:
    """The ``k`` windows of ``documents`` that share most word pairs with each query: rows (query_id, key, ordinal, shared, share, rank).

    Pairs are joined by equality; a query of fewer than ``least`` pairs matches nothing. Ties go to the
    earlier window. A sentence's pairs, and the one where it meets the next, are held against the queries' once;
    only those found are dealt to the windows that hold them. Where the queries have few pairs, counted first,
    these go to the documents, so that no other pair is shuffled.
    """
    wanted = queries.select(query_id, word_pairs(content_words(body(F.col(query_text)), stop)).alias("pairs")).where(F.size("pairs") >= least)
    q = wanted.select(query_id, F.size("pairs").alias("n"), F.explode("pairs").alias("pair"))
    cut = F.transform(sentences(F.col(text)), lambda s: content_words(s, stop))
    # each sentence with the first word of the next
    beside = once(cut, lambda all_: F.transform(all_, lambda w, i: F.struct(w.alias("__w"), F.get(F.get(all_, i + 1), 0).alias("__next"), F.size(all_).alias("__of"))))
    each = documents.select(key, F.posexplode(beside).alias("__i", "__x")).select(key, "__i", "__x.*")
    last = F.get("__w", F.size("__w") - 1)
    seam = F.when(last.isNotNull() & F.col("__next").isNotNull(), F.array(F.struct(F.concat_ws(" ", last, "__next").alias("pair"), F.lit(True).alias("__seam")))).otherwise(F.array().cast("array<struct<pair:string,__seam:boolean>>"))
    own = F.transform(word_pairs(F.col("__w")), lambda p: F.struct(p.alias("pair"), F.lit(False).alias("__seam")))
    pairs = each.select(key, "__i", "__of", F.explode(F.concat(own, seam)).alias("__p")).select(key, "__i", "__of", "__p.*")
    few = small(q)
    hits = pairs.join(few, "pair") if few is not None else q.join(pairs, "pair")
    # a sentence alone, with the one before it and with the one behind it
    i, of = F.col("__i"), F.col("__of")
    both = F.array_compact(F.array(F.when(~F.col("__seam"), i), F.when(~F.col("__seam") & (i > 0), of + i - 1), F.when(i < of - 1, of + i)))
    shared = hits.select(query_id, "n", key, "pair", F.explode(both).alias("ordinal")).distinct().groupBy(query_id, "n", key, "ordinal").agg(F.count("*").alias("shared"))
    rank = F.row_number().over(W.partitionBy(query_id).orderBy(F.desc("shared"), key, "ordinal"))
    return shared.withColumn("rank", rank).where(F.col("rank") <= k).select(query_id, key, "ordinal", "shared", (F.col("shared") / F.col("n")).alias("share"), "rank")


def lexical_outside(queries: DataFrame, items: DataFrame, taken: DataFrame, k: int = 3, stop: list[str] | None = None) -> DataFrame:
    """The ``k`` items that share most content words with each query and aren't ``taken`` (q_id, i_id): rows (q_id, i_id, shared, rank); both have id and text.

    Numbers don't count; ties go to the smaller id.
    """
    own = lambda rows, name: rows.select(F.col("id").alias(name), F.explode(F.array_distinct(F.filter(content_words(F.col("text"), stop), lambda w: w != "#"))).alias("word"))
    q, i = own(queries, "q_id"), own(items, "i_id")
    few = small(q)
    shared = (i.join(few, "word") if few is not None else q.join(i, "word")).groupBy("q_id", "i_id").agg(F.count("*").alias("shared"))
    left = shared.join(taken.select("q_id", "i_id"), ["q_id", "i_id"], "left_anti")
    rank = F.row_number().over(W.partitionBy("q_id").orderBy(F.desc("shared"), "i_id"))
    return left.withColumn("rank", rank).where(F.col("rank") <= k)


def rank_of(chosen: Column, ranked: Column) -> Column:
    """Place of the chosen id in a ranked list, null where it is absent."""
    at = F.array_position(ranked, chosen)
    return F.when(at > 0, at)


def reranked(ranked: DataFrame, group: list[str], score: Column, order: list[str], keep: int) -> DataFrame:
    """The ``keep`` rows of each group with the highest score; a null score, of a scorer that failed, counts as 0, and equal ones keep their order."""
    rank = F.row_number().over(W.partitionBy(*group).orderBy(F.desc(F.coalesce(score, F.lit(0.0))), *order))
    return ranked.withColumn("new_rank", rank).where(F.col("new_rank") <= keep)


def coverage_candidates(lexical: DataFrame, semantic: DataFrame, edited: DataFrame, k: int = 5) -> DataFrame:
    """Rows (q_id, i_id, lexical_rank, semantic_rank, edited): what may still state a query's matter somewhere else.

    ``lexical`` and ``semantic``: q_id, i_id, rank. Of the semantic list the first ``k`` that aren't ``edited``
    (q_id, i_id) for the query count, ranked anew; wording hits all stay, with a mark where they are edited.
    """
    marks = edited.select("q_id", "i_id").distinct().withColumn("edited", F.lit(True))
    fresh = semantic.select("q_id", "i_id", "rank").join(marks, ["q_id", "i_id"], "left_anti")
    again = F.row_number().over(W.partitionBy("q_id").orderBy("rank", "i_id"))
    near = fresh.withColumn("semantic_rank", again).where(F.col("semantic_rank") <= k).select("q_id", "i_id", "semantic_rank")
    words = lexical.select("q_id", "i_id", F.col("rank").alias("lexical_rank"))
    both = words.join(near, ["q_id", "i_id"], "full_outer").join(marks, ["q_id", "i_id"], "left")
    return both.withColumn("edited", F.coalesce("edited", F.lit(False))).select("q_id", "i_id", "lexical_rank", "semantic_rank", "edited")


def unsupported(queries: DataFrame, candidates: DataFrame, least: int = 1) -> DataFrame:
    """The queries (q_id) for which fewer than ``least`` unedited candidates were found: nothing else covers them."""
    left = candidates.where(~F.col("edited")).groupBy("q_id").agg(F.countDistinct("i_id").alias("n"))
    return queries.select("q_id").distinct().join(left, "q_id", "left").na.fill(0, ["n"]).where(F.col("n") < least)
