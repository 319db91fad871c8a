"""Phrase collocations, counted exactly in counting quotient filters that are merged across shards.

Texts are dealt into slices of one language, with a dictionary of their own. A phrase can be frequent only
where the two phrases without its last and its first word are, so phrases grow word by word: at each length a
slice packs the number of the frequent phrase at a place and the number of the word behind it into one key,
and counts its keys in one filter for each share of the permuted keys. A share's filters are merged as they
stream by in order; what reaches the least count gets a number and goes back to the slices that hold it.
Words get theirs in the same way, by shares of their hashes.
Numbers stand for words without loss; nothing is broadcast, and no dictionary leaves its slice whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import words
from .common import forget, small_batches, written
from .quotient_filter import Filter, merged, permuted, restored

#: Bytes of text of a slice; a longer text is a slice of its own.
SLICE_BYTES = 8 << 20
#: Keys of a share, on average, before equal ones are merged; words of a share, likewise.
SHARE_KEYS, SHARE_WORDS = 1 << 19, 1 << 17
#: Between phrases; no word's number.
NONE = np.uint32(0xFFFFFFFF)
#: Groups of a language whose best are ranked apart first.
SALTS = 64
#: Bytes as they count: A-Z lower-cased, what ends a piece as \n, other white space between words as a space.
_TABLE = np.arange(256, dtype=np.uint8)
_TABLE[65:91] += 32
_TABLE[[*b".,;:!?", *range(0x0A, 0x0E)]] = 10
_TABLE[[0x09, 0x20]] = 32


def tokens(raw: bytes) -> tuple[np.ndarray, pa.Array]:
    """Codes of the words of a text, -1 between its pieces, and the distinct words."""
    text = _TABLE[np.frombuffer(raw, np.uint8)]
    inside = (text != 32) & (text != 10)
    edges = np.flatnonzero(np.diff(inside, prepend=False, append=False))
    starts, ends = edges[::2], edges[1::2]
    breaks = np.cumsum(text == 10, dtype=np.int32)
    apart = np.flatnonzero(breaks[ends[:-1] - 1] != breaks[starts[1:]]) + 1
    del breaks
    offsets = np.zeros(len(starts) + 1, np.int64)
    np.cumsum(ends - starts, out=offsets[1:])
    flat = text[inside]
    del text, inside, edges, starts, ends
    coded = pa.Array.from_buffers(pa.large_string(), len(offsets) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(flat)]).dictionary_encode()
    return np.insert(np.asarray(coded.indices).astype(np.int32), apart, -1), coded.dictionary


def sliced(docs: DataFrame, text: str = "text", lang: str = "lang") -> DataFrame:
    """Rows (slice, lang, total, n_words, n_bytes, words, counts, n, tokens): texts of one language, their distinct words with counts, and all words as places in that list, NONE between pieces."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[bytes]] = {}
        size: dict[str, int] = {}
        part, made = TaskContext.get().partitionId(), 0

        def out(name: str) -> Iterator[pa.RecordBatch]:
            nonlocal made
            codes, distinct = tokens(b"\n".join(held.pop(name)))
            del size[name]
            if len(distinct):
                counts = np.bincount(codes[codes >= 0], minlength=len(distinct))
                flat = b"\n".join(distinct.cast(pa.large_binary()).to_pylist())
                values = [part << 32 | made, name, int(counts.sum()), len(distinct), len(flat), _squeezed(flat), _packed(counts), len(codes), _packed(codes.view(np.uint32))]
                yield pa.RecordBatch.from_arrays([pa.array([v]) for v in values], [f.split()[0] for f in SLICE.split(", ")])
                made += 1

        for batch in batches:
            for some in words.slices(batch):
                for name, raw in zip(some["lang"].to_pylist(), some["text"].cast(pa.binary()).to_pylist()):
                    held.setdefault(name, []).append(raw)
                    size[name] = size.get(name, 0) + len(raw) + 1
                    if size[name] >= SLICE_BYTES:
                        yield from out(name)
        for name in list(held):
            yield from out(name)

    small_batches(docs.sparkSession)
    rows = docs.where(F.col(text) != "").select(F.coalesce(F.col(lang), F.lit("und")).alias("lang"), F.col(text).alias("text"))
    return rows.mapInArrow(run, SLICE)


SLICE = "slice bigint, lang string, total bigint, n_words bigint, n_bytes bigint, words binary, counts binary, n bigint, tokens binary"


def _squeezed(raw: bytes) -> bytes:
    return pa.Codec("zstd").compress(raw, asbytes=True)


def _lines(raw: bytes, size: int) -> list[bytes]:
    """The words of a slice; none holds a line end."""
    return pa.Codec("zstd").decompress(raw, size, asbytes=True).split(b"\n")


def _packed(numbers: np.ndarray) -> bytes:
    """Numbers of 32 bits, compressed byte by byte of all of them: small and repeated ones take little."""
    return pa.Codec("zstd").compress(np.frombuffer(numbers.astype("<u4").tobytes(), np.uint8).reshape(-1, 4).T.tobytes(), asbytes=True) if len(numbers) else b""


def _numbers(raw: bytes, n: int) -> np.ndarray:
    return np.frombuffer(np.frombuffer(pa.Codec("zstd").decompress(raw, 4 * n, asbytes=True), np.uint8).reshape(4, n).T.tobytes(), "<u4") if n else np.zeros(0, "<u4")


def _bits(top: int | None) -> int:
    return max(1, int(top or 0).bit_length())


def word_parts(slices: DataFrame, share_bits: int) -> DataFrame:
    """Rows (share, lang, slice, n, n_bytes, words, counts, local): each slice's words dealt out by their hash, with their places in the slice's list."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, lang, n, size, raw, counts in zip(*(batch[k].to_pylist() for k in ("slice", "lang", "n_words", "n_bytes", "words", "counts"))):
                own, number = _lines(raw, size), _numbers(counts, n)
                share = np.array([xxhash.xxh64_intdigest(w) for w in own], np.uint64) >> np.uint64(64 - share_bits)
                order = np.argsort(share, kind="stable")
                cuts = np.searchsorted(share[order], np.arange((1 << share_bits) + 1, dtype=np.uint64))
                for k in np.flatnonzero(np.diff(cuts)).tolist():
                    at = order[cuts[k] : cuts[k + 1]]
                    flat = b"\n".join([own[i] for i in at.tolist()])
                    values = [k, lang, name, len(at), len(flat), _squeezed(flat), _packed(number[at]), _packed(at)]
                    yield pa.RecordBatch.from_arrays([pa.array([v]) for v in values], [f.split()[0] for f in PART.split(", ")])

    return slices.select("slice", "lang", "n_words", "n_bytes", "words", "counts").mapInArrow(run, PART)


PART = "share bigint, lang string, slice bigint, n bigint, n_bytes bigint, words binary, counts binary, local binary"


def frequent_words(parts: DataFrame, least: int) -> DataFrame:
    """Rows (share, lang, start, words, counts): what a language has ``least`` times or more of each share's words, and how many of the share came before. Parts arrive share by share."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, count, start = None, {}, 0

        def out() -> Iterator[pa.RecordBatch]:
            nonlocal start
            kept = [(w, c) for w, c in count.items() if c >= least]
            if kept:
                values = [[now[0]], [now[1]], [start], [[w.decode() for w, _ in kept]], [[c for _, c in kept]]]
                kinds = [pa.int64(), pa.string(), pa.int64(), pa.list_(pa.string()), pa.list_(pa.int64())]
                yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(values, kinds)], ["share", "lang", "start", "words", "counts"])
                start += len(kept)

        for batch in batches:
            for share, lang, n, size, raw, counts in zip(*(batch[k].to_pylist() for k in ("share", "lang", "n", "n_bytes", "words", "counts"))):
                if (share, lang) != now:
                    yield from out()
                    start = start if now and now[0] == share else 0
                    now, count = (share, lang), {}
                get = count.get
                for w, c in zip(_lines(raw, size), _numbers(counts, n).tolist()):
                    count[w] = get(w, 0) + c
        yield from out()

    dealt = parts.repartition("share").sortWithinPartitions("share", "lang").select("share", "lang", "n", "n_bytes", "words", "counts")
    return dealt.mapInArrow(run, "share bigint, lang string, start bigint, words array<string>, counts array<bigint>")


def word_numbers(parts: DataFrame, frequent: DataFrame, place_bits: int) -> DataFrame:
    """Rows (slice, n, local, ids): of each part's words the frequent ones, with their numbers. A share's frequent words come before its parts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, number = None, {}
        for batch in batches:
            for share, lang, name, n, size, raw, local, known, start in zip(*(batch[k].to_pylist() for k in ("share", "lang", "slice", "n", "n_bytes", "words", "local", "known", "start"))):
                if name is None:
                    now, number = (share, lang), {w.encode(): share << place_bits | start + i for i, w in enumerate(known)}
                elif (share, lang) == now:
                    get = number.get
                    ids = np.array([get(w, -1) for w in _lines(raw, size)], np.int64)
                    own = ids >= 0
                    if own.any():
                        yield pa.RecordBatch.from_arrays([pa.array([v]) for v in (name, int(own.sum()), _packed(_numbers(local, n)[own]), _packed(ids[own]))], ["slice", "n", "local", "ids"])

    none = lambda kind: F.lit(None).cast(kind)
    first = frequent.select("share", "lang", none("bigint").alias("slice"), none("bigint").alias("n"), none("bigint").alias("n_bytes"), none("binary").alias("words"), none("binary").alias("local"), F.col("words").alias("known"), "start")
    both = first.union(parts.select("share", "lang", "slice", "n", "n_bytes", "words", "local", none("array<string>").alias("known"), none("bigint").alias("start")))
    # nulls come first
    return both.repartition("share").sortWithinPartitions("share", "lang", "slice").mapInArrow(run, "slice bigint, n bigint, local binary, ids binary")


def first_state(slices: DataFrame, numbers: DataFrame) -> DataFrame:
    """Rows (slice, n, gap, id, last): where the slice's frequent words stand, and their numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, n_words, n, raw, known in zip(*(batch[k].to_pylist() for k in ("slice", "n_words", "n", "tokens", "known"))):
                number = np.full(n_words + 1, NONE, np.uint32)
                for x in known:
                    number[_numbers(x["local"], x["n"])] = _numbers(x["ids"], x["n"])
                # between pieces stands NONE, which takes the last place
                ids = number[np.minimum(_numbers(raw, n), np.uint32(n_words))]
                at = np.flatnonzero(ids != NONE)
                yield _state(name, at, ids[at], None)

    # a slice's answers are as many as its distinct words at most
    known = numbers.groupBy("slice").agg(F.collect_list(F.struct("n", "local", "ids")).alias("known"))
    return slices.select("slice", "n_words", "n", "tokens").join(known, "slice").mapInArrow(run, STATE)


STATE = "slice bigint, n bigint, gap binary, id binary, last binary"


def _state(name: int, at: np.ndarray, ids: np.ndarray, last: np.ndarray | None) -> pa.RecordBatch:
    gap = np.diff(at, prepend=0)
    columns = [pa.array([name], pa.int64()), pa.array([len(at)], pa.int64()), *(pa.array([x], pa.binary()) for x in (_packed(gap), _packed(ids), b"" if last is None else _packed(last)))]
    return pa.RecordBatch.from_arrays(columns, ["slice", "n", "gap", "id", "last"])


def _grown(row: pa.RecordBatch, word_bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places whose phrase goes on with a frequent one at the next place, their keys, and the last word of the longer phrase."""
    n = row["n"][0].as_py()
    gap, ids, last = (_numbers(raw, n) if (raw := row[k][0].as_py()) or not n else None for k in ("gap", "id", "last"))
    last = ids if last is None else last  # of one word
    go = np.flatnonzero(gap[1:] == 1)
    at = np.cumsum(gap, dtype=np.int64)[go]
    return at, ids[go].astype(np.uint64) << np.uint64(word_bits) | last[go + 1], last[go + 1]


def counted(state: DataFrame, width: int, word_bits: int, share_bits: int) -> DataFrame:
    """Rows (share, slice, filter): the counts of each slice's keys, one filter for each share that has any."""
    low = width - share_bits

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                some = batch.slice(row, 1)
                keys, counts = Filter.counting(_grown(some, word_bits)[1], width).entries()
                share = (keys >> np.uint64(low)).astype(np.int64)
                cuts = np.searchsorted(share, np.arange((1 << share_bits) + 1))
                own = np.flatnonzero(np.diff(cuts))
                filters = [Filter.of(keys[a:b] & np.uint64((1 << low) - 1), counts[a:b], low).to_bytes() for a, b in zip(cuts[own], cuts[own + 1])]
                yield pa.RecordBatch.from_arrays([pa.array(own, pa.int64()), pa.array([some["slice"][0].as_py()] * len(own), pa.int64()), pa.array(filters, pa.binary())], ["share", "slice", "filter"])

    return state.mapInArrow(run, "share bigint, slice bigint, filter binary")


def frequent_keys(parts: DataFrame, least: int, low: int) -> DataFrame:
    """Rows (share, n, keys, counts): the entries of each share's merged filter that count ``least`` or more.

    Filters arrive share by share and are merged whenever ``SHARE_KEYS`` entries have come together.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, size = None, [], 0

        def out() -> Iterator[pa.RecordBatch]:
            if now is not None:
                keys, counts = merged(held).entries()
                keys, counts = keys[counts >= least], counts[counts >= least]
                if len(keys):
                    yield pa.RecordBatch.from_arrays([pa.array([now], pa.int64()), pa.array([len(keys)], pa.int64()), pa.array([keys.tobytes()], pa.binary()), pa.array([counts.tobytes()], pa.binary())], ["share", "n", "keys", "counts"])

        for batch in batches:
            for share, raw in zip(batch["share"].to_pylist(), batch["filter"].to_pylist()):
                if share != now:
                    yield from out()
                    now, held, size = share, [], 0
                held.append(Filter.from_bytes(raw))
                size += len(held[-1].slots)
                if len(held) > 1 and size > 2 * SHARE_KEYS + 2 * len(held[0].slots):
                    held = [merged(held)]
                    size = len(held[0].slots)
        yield from out()

    return parts.repartition("share").sortWithinPartitions("share", "slice").select("share", "filter").mapInArrow(run, "share bigint, n bigint, keys binary, counts binary")


def returned(parts: DataFrame, frequent: DataFrame, low: int, place_bits: int) -> DataFrame:
    """Rows (slice, keys, ids): of each part's keys the frequent ones, whole, with their numbers. A share's frequent keys come before its parts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, known = None, np.zeros(0, np.uint64)
        for batch in batches:
            rows = []
            for share, name, raw in zip(batch["share"].to_pylist(), batch["slice"].to_pylist(), batch["raw"].to_pylist()):
                if name is None:
                    now, known = share, np.frombuffer(raw, np.uint64)
                elif share == now:
                    keys = Filter.from_bytes(raw).entries()[0]
                    at = np.minimum(np.searchsorted(known, keys), len(known) - 1)
                    own = known[at] == keys
                    if own.any():
                        rows.append((name, (keys[own] | np.uint64(share << low)).tobytes(), (at[own] | share << place_bits).astype("<u4").tobytes()))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), (pa.int64(), pa.binary(), pa.binary()))], ["slice", "keys", "ids"])

    both = parts.select("share", "slice", F.col("filter").alias("raw")).union(frequent.select("share", F.lit(None).cast("bigint").alias("slice"), F.col("keys").alias("raw")))
    # nulls come first
    return both.repartition("share").sortWithinPartitions("share", "slice").mapInArrow(run, "slice bigint, keys binary, ids binary")


def next_state(state: DataFrame, answers: DataFrame, width: int, word_bits: int) -> DataFrame:
    """The places of each slice whose phrase with the next word is frequent; slices without any are gone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                some = batch.slice(row, 1)
                at, keys, last = _grown(some, word_bits)
                pairs = some["answers"].flatten()
                known, ids = (np.concatenate([np.frombuffer(x.as_buffer(), kind) for x in pairs.field(k)]) for k, kind in (("keys", np.uint64), ("ids", "<u4")))
                order = np.argsort(known)
                known, ids = known[order], ids[order]
                mixed = permuted(keys, width)
                place = np.minimum(np.searchsorted(known, mixed), len(known) - 1)
                own = known[place] == mixed
                yield _state(some["slice"][0].as_py(), at[own], ids[place[own]], last[own])

    # a slice's answers are as many as its distinct keys at most
    lists = answers.groupBy("slice").agg(F.collect_list(F.struct("keys", "ids")).alias("answers"))
    return state.join(lists, "slice").mapInArrow(run, STATE)


def named(frequent: DataFrame, shorter: DataFrame, single: DataFrame, width: int, word_bits: int, low: int, place_bits: int) -> DataFrame:
    """Rows (id, lang, phrase, a) of the frequent keys, their words joined by a space."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for share, raw, n in zip(batch["share"].to_pylist(), batch["keys"].to_pylist(), batch["counts"].to_pylist()):
                mixed, counts = np.frombuffer(raw, np.uint64), np.frombuffer(n, np.uint64)
                keys = restored(mixed | np.uint64(share << low), width)
                columns = [np.arange(len(keys)) | share << place_bits, keys >> np.uint64(word_bits), keys & np.uint64((1 << word_bits) - 1), counts]
                yield pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64)) for c in columns], ["id", "start", "last", "a"])

    rows = frequent.select("share", "keys", "counts").mapInArrow(run, "id bigint, start bigint, last bigint, a bigint")
    start = shorter.select(F.col("id").alias("start"), "lang", F.col("phrase").alias("before"))
    end = single.select(F.col("id").alias("last"), F.col("phrase").alias("word"))
    return rows.join(start, "start").join(end, "last").select("id", "lang", F.concat_ws(" ", "before", "word").alias("phrase"), "a")


def frequent_phrases(docs: DataFrame, least: int = 100, longest: int = 5, text: str = "text", lang: str = "lang") -> tuple[DataFrame, DataFrame]:
    """Rows (lang, size, phrase, a) of all phrases of one to ``longest`` words that a language has ``least`` times or more, and rows (lang, n) of its words.

    Numbers of words and phrases are of 32 bits, a key of 64 at most: more frequent phrases than that raise an error.
    """
    slices = written(sliced(docs, text, lang), "phrase-slices")
    totals = written(slices.groupBy("lang").agg(F.sum("total").alias("n")), "phrase-totals")
    share_bits = max(4, _bits((slices.agg(F.sum("n_words")).first()[0] or 0) // SHARE_WORDS))
    parts = written(word_parts(slices, share_bits), "phrase-word-parts")
    frequent = written(frequent_words(parts, least), "phrase-frequent-words")
    place_bits = _bits(frequent.agg(F.max(F.col("start") + F.size("words"))).first()[0])
    word_bits = share_bits + place_bits
    if word_bits > 31:
        raise ValueError("more frequent words than 31-bit numbers hold")
    each = frequent.select("share", "lang", "start", F.posexplode(F.arrays_zip("words", "counts")).alias("i", "w"))
    single = written(each.select((F.col("share") * (1 << place_bits) + F.col("start") + F.col("i")).alias("id"), "lang", F.col("w.words").alias("phrase"), F.col("w.counts").alias("a")), "phrase-words")
    state = written(first_state(slices, word_numbers(parts, frequent, place_bits)), "phrase-places")
    for done in (slices, parts, frequent):
        forget(done)
    found, shorter, id_bits = [single], single, word_bits
    for size in range(2, longest + 1):
        width, total = id_bits + word_bits, state.agg(F.sum("n")).first()[0]
        if not total:
            break
        if width > 64 or id_bits > 32:
            raise ValueError("more frequent phrases than 64-bit keys hold")
        share_bits = min(max(4, _bits(total // SHARE_KEYS)), width - 1)
        low = width - share_bits
        parts = written(counted(state, width, word_bits, share_bits), "phrase-filters")
        frequent = written(frequent_keys(parts, least, low), "phrase-frequent")
        most = frequent.agg(F.max("n")).first()[0]
        if not most:
            break
        place_bits = _bits(most - 1)
        shorter = written(named(frequent, shorter, single, width, word_bits, low, place_bits), "phrases")
        found.append(shorter)
        if size < longest:
            before, state = state, written(next_state(state, returned(parts, frequent, low, place_bits), width, word_bits), "phrase-places")
            id_bits = share_bits + place_bits
            for done in (before, parts, frequent):
                forget(done)
    out = None
    for size, table in enumerate(found, 1):
        table = table.select("lang", F.lit(size).alias("size"), "phrase", "a")
        out = table if out is None else out.union(table)
    return out, totals


def scored(phrases: DataFrame, totals: DataFrame) -> DataFrame:
    """Rows (lang, size, phrase, a, l, r, n, score) of the phrases of two words or more, at the cut with the lowest score, the first of equal ones."""
    part = lambda start, length: F.array_join(F.slice(F.split("phrase", " "), start, length), " ")
    cuts = phrases.where("size > 1").select("lang", "size", "phrase", "a", F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("k"))
    cuts = cuts.withColumns({"first": part(F.lit(1), F.col("k")), "rest": part(F.col("k") + 1, F.col("size") - F.col("k"))})
    count = lambda name, f: phrases.select("lang", F.col("phrase").alias(name), F.col("a").alias(f))
    both = cuts.join(count("first", "l"), ["lang", "first"]).join(count("rest", "r"), ["lang", "rest"]).join(totals, "lang")
    score = F.expr("(cast(1000 as decimal(4,0)) * cast(a as decimal(17,0)) * cast(n as decimal(17,0))) div (cast(l as decimal(19,0)) * cast(r as decimal(19,0)))")
    best = F.min(F.struct(score.cast("bigint").alias("score"), "k", "l", "r", "n")).alias("best")
    return both.groupBy("lang", "size", "phrase", "a").agg(best).select("lang", "size", "phrase", "a", "best.l", "best.r", "best.n", "best.score")


def standing(candidates: DataFrame, share: int = 100) -> DataFrame:
    """``candidates`` without those whose words lie within a longer one that has at least ``share`` in a hundred of their occurrences."""
    w = F.split("phrase", " ")
    within = F.flatten(F.transform(F.sequence(F.lit(2), F.col("size") - 1), lambda m: F.transform(F.sequence(F.lit(1), F.col("size") - m + 1), lambda i: F.array_join(F.slice(w, i, m), " "))))
    inner = candidates.where("size > 2").select("lang", F.explode(within).alias("phrase"), F.col("a").alias("longer")).groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))
    joined = candidates.join(inner, ["lang", "phrase"], "left")
    return joined.where(F.col("longer").isNull() | (100 * F.col("longer") < share * F.col("a"))).drop("longer")


def best(rows: DataFrame, top: int) -> DataFrame:
    """The first ``top`` rows of each language with ``rank``; a language's rows are ranked in ``SALTS`` groups first, so that none meets whole in one task."""
    order: list[Column] = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    salt = F.pmod(F.xxhash64("phrase"), F.lit(SALTS))
    few = rows.withColumn("salt", salt).withColumn("rank", F.row_number().over(W.partitionBy("lang", "salt").orderBy(*order))).where(F.col("rank") <= top).drop("salt")
    return few.withColumn("rank", F.row_number().over(W.partitionBy("lang").orderBy(*order)).cast("bigint")).where(F.col("rank") <= top)


def collocations(docs: DataFrame, least: int = 100, longest: int = 5, top: int = 2000, share: int = 100, text: str = "text", lang: str = "lang") -> DataFrame:
    """Rows (lang, rank, phrase, a, l, r, n, score): each language's ``top`` phrases of two to ``longest`` words by score.

    A-Z are lower-cased; words of one piece between ``.,;:!?`` and line ends make phrases. a, l, r are the
    occurrences of the phrase and of its parts before and behind the cut, n the language's words, the score
    floor(1000 a n / (l r)) at its lowest cut. Phrases that a longer one holds in ``share`` per cent of their
    occurrences go. Null texts count as empty, a null language as ``und``; no rows give no rows; other columns are ignored.
    """
    phrases, totals = frequent_phrases(docs, least, longest, text, lang)
    candidates = written(scored(phrases, totals), "phrase-scores")
    return best(standing(candidates, share), top).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
