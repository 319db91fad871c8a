"""Byte-level BPE encoding and decoding with a segment tree over adjacent pair ranks.

Each leaf holds the rank of the pair that starts at its symbol, with its place as tie-breaker; the root is the
leftmost pair of the lowest rank. Merging it changes three leaves, each a logarithmic walk to the root, until
no pair can merge. Short strings run through the same tree side by side in numpy, one merge of each at a time.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words
from .common import small_batches

#: The pattern of byte-level BPE, with white space as Unicode has it.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
WHITE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
#: White space with the word after it: the pattern's matches never cross these.
UNIT = re.compile(f"[{WHITE}]*[^{WHITE}]+|[{WHITE}]+")
#: Strings of more bytes take a tree of their own.
SIDE_BY_SIDE = 64
#: Distinct units whose ids a Python worker keeps; beyond that it starts anew.
KEPT_UNITS = 300_000
NONE = np.iinfo(np.int64).max


def byte_chars() -> list[str]:
    """The character that stands for each byte: itself where printable, else the next one from U+0100."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spare = iter(range(256, 512))
    return [chr(b) if b in set(plain) else chr(next(spare)) for b in range(256)]


class SegmentTree:
    """Minimum of a list of numbers under point updates."""

    def __init__(self, leaves: list[int]) -> None:
        self.size = 1 << max(0, len(leaves) - 1).bit_length()
        self.node = [NONE] * self.size + leaves + [NONE] * (self.size - len(leaves))
        for i in range(self.size - 1, 0, -1):
            self.node[i] = min(self.node[2 * i], self.node[2 * i + 1])

    def root(self) -> int:
        return self.node[1]

    def put(self, i: int, value: int) -> None:
        node, i = self.node, i + self.size
        node[i] = value
        while i > 1:
            i >>= 1
            low = min(node[2 * i], node[2 * i + 1])
            if node[i] == low:
                break
            node[i] = low


class Bpe:
    """Merges, vocabulary and special tokens of a tokenizers JSON file with byte-level BPE."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, merges = spec["model"]["vocab"], spec["model"]["merges"]
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in merges]
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        chars = byte_chars()
        self.of_byte = np.array([vocab[c] for c in chars], np.int64)
        self.left, self.right, self.merged = (np.array([vocab[x] for x in col], np.int64) for col in ([a for a, _ in pairs], [b for _, b in pairs], [a + b for a, b in pairs]))
        self.n_ids = max(max(vocab.values()), *self.special.values(), 0) + 1
        back = {c: b for b, c in enumerate(chars)}
        texts: list[bytes] = [b""] * self.n_ids
        for token, i in [*vocab.items(), *self.special.items()]:
            texts[i] = bytes(back[c] for c in token)
        self.token_length = np.array([len(x) for x in texts], np.int64)
        self.token_start, self.token_bytes = np.cumsum(self.token_length) - self.token_length, np.frombuffer(b"".join(texts), np.uint8)
        self.pre = regex.compile(PATTERN)
        self.cut = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self._hash()
        self.units = words.Ragged()

    # ranks of pairs

    def _hash(self) -> None:
        """Open addressing with linear probing, filled in numpy."""
        self.bits = max(4, int(np.ceil(np.log2(max(1, 4 * len(self.merged))))))
        self.key = self.left * self.n_ids + self.right
        self.table = np.full(1 << self.bits, -1, np.int64)
        todo, at = np.arange(len(self.key)), self._slot(self.key)
        while len(todo):
            free = self.table[at] < 0
            self.table[at[free]] = todo[free]  # of several, the last stays
            lost = self.table[at] != todo
            todo, at = todo[lost], (at[lost] + 1) & ((1 << self.bits) - 1)

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair, NONE where it can't merge."""
        key = left * self.n_ids + right
        at = self._slot(key)
        rank = self.table[at]
        off = np.flatnonzero((rank >= 0) & (self.key[rank] != key))
        while len(off):
            at[off] = (at[off] + 1) & ((1 << self.bits) - 1)
            rank[off] = self.table[at[off]]
            off = off[(rank[off] >= 0) & (self.key[rank[off]] != key[off])]
        return np.where(rank < 0, NONE, rank)

    @cached_property
    def rank_of(self) -> dict[int, int]:
        return dict(zip(self.key.tolist(), range(len(self.key))))

    # one string

    def encode_bytes(self, raw: bytes) -> list[int]:
        """Ids of one string between the pattern's cuts, by one tree."""
        sym, n = self.of_byte[np.frombuffer(raw, np.uint8)].tolist(), len(raw)
        if n < 2:
            return sym
        rank_of, width = self.rank_of, self.n_ids
        after, before = [*range(1, n), -1], list(range(-1, n - 1))

        def leaf(i: int) -> int:
            j = after[i]
            rank = rank_of.get(sym[i] * width + sym[j]) if j >= 0 else None
            return NONE if rank is None else rank * n + i

        tree = SegmentTree([leaf(i) for i in range(n)])
        while (low := tree.root()) != NONE:
            i = low % n
            j = after[i]
            sym[i], after[i], sym[j] = int(self.merged[low // n]), after[j], -1
            if after[i] >= 0:
                before[after[i]] = i
            tree.put(j, NONE)
            tree.put(i, leaf(i))
            if before[i] >= 0:
                tree.put(before[i], leaf(before[i]))
        return [s for s in sym if s >= 0]

    # many short strings

    def encode_many(self, raws: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all strings one after another, and the number of each."""
        length = np.fromiter(map(len, raws), np.int64, len(raws))
        counts, parts = np.zeros(len(raws), np.int64), []
        size, done = 1, 0
        while done < len(raws):
            own = np.flatnonzero((length <= size) & (length > size // 2 if size > 1 else length <= 1)) if size <= SIDE_BY_SIDE else np.flatnonzero(length > SIDE_BY_SIDE)
            if len(own) and size <= SIDE_BY_SIDE:
                ids, n = self._side_by_side([raws[i] for i in own.tolist()], length[own], size)
            else:
                lists = [self.encode_bytes(raws[i]) for i in own.tolist()]
                ids, n = np.array([x for y in lists for x in y], np.int64), np.array([len(x) for x in lists], np.int64)
            counts[own] = n
            parts.append((own, ids, n))
            done += len(own)
            size *= 2
        flat, start = np.zeros(int(counts.sum()), np.int64), np.cumsum(counts) - counts
        for own, ids, n in parts:
            flat[np.repeat(start[own] - (np.cumsum(n) - n), n) + np.arange(len(ids))] = ids
        return flat, counts

    def _side_by_side(self, raws: list[bytes], length: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
        m, place = len(raws), np.arange(size)
        sym = np.full((m, size), -1, np.int64)
        inside = place < length[:, None]
        sym[inside] = self.of_byte[np.frombuffer(b"".join(raws), np.uint8)]
        after = np.where(place + 1 < length[:, None], place + 1, -1)
        before = np.broadcast_to(place - 1, (m, size)).copy()
        tree = np.full((m, 2 * size), NONE, np.int64)
        pair = after >= 0
        row, col = np.nonzero(pair)
        rank = self.ranks(sym[row, col], sym[row, col + 1])
        tree[row, size + col] = np.where(rank == NONE, NONE, rank * size + col)
        for i in range(size - 1, 0, -1):
            tree[:, i] = np.minimum(tree[:, 2 * i], tree[:, 2 * i + 1])

        def put(rows: np.ndarray, at: np.ndarray, values: np.ndarray) -> None:
            at = at + size
            tree[rows, at] = values
            while at[0] > 1:  # all leaves are equally deep
                at = at >> 1
                tree[rows, at] = np.minimum(tree[rows, 2 * at], tree[rows, 2 * at + 1])

        def leaf(rows: np.ndarray, at: np.ndarray) -> np.ndarray:
            nxt = after[rows, at]
            rank = self.ranks(sym[rows, at], np.where(nxt >= 0, sym[rows, nxt], 0))
            return np.where((nxt < 0) | (rank == NONE), NONE, rank * size + at)

        live = np.flatnonzero(tree[:, 1] != NONE) if size > 1 else np.zeros(0, np.int64)
        while len(live):
            low = tree[live, 1]
            i = low % size
            j = after[live, i]
            nxt = after[live, j]
            sym[live, i], sym[live, j], after[live, i] = self.merged[low // size], -1, nxt
            has = nxt >= 0
            before[live[has], nxt[has]] = i[has]
            put(live, j, np.full(len(live), NONE))
            put(live, i, leaf(live, i))
            prev = before[live, i]
            has = prev >= 0
            if has.any():
                put(live[has], prev[has], leaf(live[has], prev[has]))
            live = live[tree[live, 1] != NONE]
        left = sym >= 0
        return sym[left], left.sum(axis=1)

    # texts

    def add(self, units: list[str]) -> None:
        lists = [self.pre.findall(u) for u in units]
        place: dict[str, int] = {}
        order = np.array([place.setdefault(p, len(place)) for x in lists for p in x], np.int64)
        flat, counts = self.encode_many([p.encode() for p in place])
        start = np.cumsum(counts) - counts
        ends = np.concatenate([[0], np.cumsum(counts[order])])[np.cumsum([0, *map(len, lists)])]
        self.units.store(units, words.gather(flat, start[order], counts[order]), np.diff(ends))

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after another, and the number of each."""
        units: list[str] = []
        at = [0]
        for text in texts:
            if text and self.cut and any(s in text for s in self.special):
                for part in self.cut.split(text):
                    units += [part] if part in self.special else UNIT.findall(part)
            elif text:
                units += UNIT.findall(text)
            at.append(len(units))
        distinct, known = set(units), self.units.slot
        if len(known) + len(distinct) > KEPT_UNITS:
            self.units.clear()
            known = self.units.slot
        new = [u for u in distinct if u not in known]
        for u in [u for u in new if u in self.special]:
            self.units.store([u], np.array([self.special[u]]), np.array([1]))
        if new := [u for u in new if u not in self.special]:
            self.add(new)
        ids, ends = self.units.lists(self.units.slots(units))
        return ids, np.diff(ends[np.array(at)])

    def decode(self, ids: np.ndarray, counts: np.ndarray) -> list[str]:
        """The texts of the ids; bytes that aren't UTF-8 become replacement characters."""
        lengths = self.token_length[ids]
        raw = words.gather(self.token_bytes, self.token_start[ids], lengths).tobytes()
        ends = np.concatenate([[0], np.cumsum(lengths)])[np.concatenate([[0], np.cumsum(counts)])].tolist()
        return [raw[a:b].decode("utf-8", "replace") for a, b in zip(ends, ends[1:])]


_workers: dict[str, Bpe] = {}


def bpe(path: str) -> Bpe:
    """The worker's tables for a tokenizer file, kept from task to task."""
    if path not in _workers:
        _workers[path] = Bpe(path)
    return _workers[path]


def encode_decode(docs: DataFrame, tokenizer: str, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row for each row of ``docs``: doc_id, ids (little-endian unsigned 32-bit numbers), decoded (their text).

    Special tokens in a text are their own ids, as the library has them by default. Null and empty texts have
    no ids; repeated rows are repeated; no rows give no rows; other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = bpe(tokenizer)
        for batch in batches:
            for some in words.slices(batch):
                ids, counts = coder.encode(some["text"].to_pylist())
                ends = np.concatenate([[0], np.cumsum(counts)]) * 4
                blob = pa.Array.from_buffers(pa.binary(), len(counts), [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(ids.astype("<u4").tobytes())])
                yield pa.RecordBatch.from_arrays([some["doc_id"], blob, pa.array(coder.decode(ids, counts), pa.string())], ["doc_id", "ids", "decoded"])

    small_batches(docs.sparkSession)
    rows = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(run, "doc_id bigint, ids binary, decoded string")
