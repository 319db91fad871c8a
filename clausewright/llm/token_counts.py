"""Exact token counts of every prefix, by dynamic programming over prefixes.

The encoding of a string's prefix ends in one token, and what comes before is the encoding of a shorter
prefix. Of all tokens that end at a place exactly one may follow the last token of the prefix before it: the
pair's bytes must encode to that pair, which is told by undoing the two tokens' merges from the latest on.
So each place needs the last token and the count of the places before, and no text is encoded twice.
A text's count at any place answers budgets and truncation; ``stored`` keeps them all in blocks.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words
from .bpe import UNIT, WHITE, Bpe
from .common import small_batches

#: Pairs of tokens whose verdict a Python worker keeps, and distinct strings, and their counts; beyond that it starts anew.
KEPT_PAIRS, KEPT, KEPT_COUNTS = 2_000_000, 800_000, 1 << 24
#: Characters of a block of stored counts.
BLOCK = 1 << 16
LEAD = re.compile(f"[{WHITE}]*")
#: The pattern's strings of an apostrophe and two letters.
CONTRACTION = re.compile("'(re|ve|ll)$")


class PrefixCounts:
    """Counts for a byte-level BPE vocabulary whose merges come after those of their parts."""

    def __init__(self, path: str) -> None:
        self.coder = coder = Bpe(path)
        self.width, self.rank_of = coder.n_ids, coder.rank_of
        self.made = {m: (r, a, b) for r, (m, a, b) in enumerate(zip(coder.merged.tolist(), coder.left.tolist(), coder.right.tolist()))}
        if len(self.made) < len(coder.merged) or any(r <= self.made.get(x, (-1,))[0] for r, *parts in self.made.values() for x in parts):
            raise ValueError("merges must make a token once each, after its parts")
        self.byte_id = coder.of_byte.tolist()
        self.pairs: dict[int, bool] = {}
        self.tree: dict = {}
        ends = (coder.token_start + coder.token_length).tolist()
        raw = coder.token_bytes.tobytes()
        for token in [*self.byte_id, *self.made]:
            if token not in self.made or self._canonical(token):
                node = self.tree
                for b in reversed(raw[int(coder.token_start[token]) : ends[token]]):
                    node = node.setdefault(b, {})
                node[-1] = token
        #: Counts of distinct strings between the pattern's cuts, one for each character, and of whole units.
        self.pieces: dict[str, array] = {}
        self.units: dict[str, int] = {}
        self.held = 0

    def _fits(self, x: int, y: int, limit: int = 1 << 62, right: bool = False) -> bool:
        """Whether tokens x, y stay apart: at no time does a merge of the two parts at their border come before what becomes of either.

        ``limit`` is the rank at which one of the parts is merged on; of equal ranks the pair further left is merged first.
        """
        while True:
            rank = self.rank_of.get(x * self.width + y)
            if rank is not None and (rank < limit or rank == limit and right):
                return False
            a, b = self.made.get(x), self.made.get(y)
            if a is None and b is None:
                return True
            if b is None or a is not None and a[0] > b[0]:
                limit, right, x = a[0], False, a[2]
            else:
                limit, right, y = b[0], True, b[1]

    def _canonical(self, token: int) -> bool:
        """Whether the token's bytes encode to it alone: its halves do, and meet before anything else happens at their border."""
        rank, x, y = self.made[token]
        for half in (x, y):
            if half in self.made and not self._canonical(half):
                return False
        return self._fits(x, y, rank, False)

    def fits(self, x: int, y: int) -> bool:
        key = x * self.width + y
        known = self.pairs.get(key)
        if known is None:
            if len(self.pairs) >= KEPT_PAIRS:
                self.pairs.clear()
            known = self.pairs[key] = self._fits(x, y)
        return known

    def of_bytes(self, raw: bytes) -> list[int] | array:
        """Counts of the prefixes of 1, 2, ... bytes of one string between the pattern's cuts."""
        n, tree, pairs, width = len(raw), self.tree, self.pairs, self.width
        last, count = ([0] * (n + 1), [0] * (n + 1)) if n < 4096 else (array("i", bytes(4 * n + 4)), array("i", bytes(4 * n + 4)))
        for end in range(1, n + 1):
            node, at = tree, end
            while at:
                at -= 1
                node = node.get(raw[at])
                if node is None:
                    raise ValueError("the vocabulary has no encoding of a byte string")
                token = node.get(-1)
                if token is None:
                    continue
                if at:
                    x = last[at]
                    fits = pairs.get(x * width + token)
                    if fits is None:
                        fits = self.fits(x, token)
                    if not fits:
                        continue
                last[end], count[end] = token, count[at] + 1
                break
        return count[1:]

    def _of_piece(self, piece: str) -> array:
        counts = self.of_bytes(raw := piece.encode())
        if len(raw) > len(piece):
            inner = (np.frombuffer(raw, np.uint8) & 0xC0) != 0x80
            last = np.append(inner[1:], True)  # the bytes that end a character
            counts = np.asarray(counts, np.int32)[last].tobytes()
        counts = array("i", counts)
        if len(piece) == 3 and CONTRACTION.match(piece):
            counts[1] = 2  # one string only when whole; before, its letter is another
        return counts

    def of_unit(self, unit: str) -> np.ndarray:
        """Counts after each character of white space with the word after it, each as if the text ended there."""
        lead, out, base, at = LEAD.match(unit).end(), array("i"), 0, 0
        if lead:  # white space at the end of a text is one string
            out.extend(self.of_piece(unit[:lead]))
        for piece in self.coder.pre.findall(unit):
            counts = self.of_piece(piece)
            at += len(piece)
            if at > lead:
                out.extend(base + c for c in counts[max(0, len(piece) - (at - lead)) :])
            base += counts[-1]
        return np.frombuffer(out, np.int32)

    def of_piece(self, piece: str) -> array:
        """Counts after each character of one string between the pattern's cuts, kept for the next time."""
        known = self.pieces.get(piece)
        if known is None:
            if len(self.pieces) >= KEPT or self.held > KEPT_COUNTS:
                self.pieces.clear()
                self.held = 0
            known = self.pieces[piece] = self._of_piece(piece)
            self.held += len(known)
        return known

    def total(self, unit: str) -> int:
        """The count of a whole unit."""
        return sum([self.of_piece(p)[-1] for p in self.coder.pre.findall(unit)])

    def totals(self, texts: list[str | None]) -> np.ndarray:
        """The count of each whole text."""
        known, out = self.units, np.zeros(len(texts), np.int64)
        for i, text in enumerate(texts):
            if not text:
                continue
            parts = [text]
            if self.coder.cut and any(s in text for s in self.coder.special):
                parts = self.coder.cut.split(text)
                out[i] = len(parts) // 2  # every second one is a special token
                parts = parts[::2]
            for part in parts:
                units = UNIT.findall(part)
                if len(known) > KEPT:
                    known.clear()
                try:
                    out[i] += sum(map(known.__getitem__, units))
                except KeyError:
                    for u in set(units).difference(known):
                        known[u] = self.total(u)
                    out[i] += sum(map(known.__getitem__, units))
        return out

    def prefixes(self, text: str) -> np.ndarray:
        """The count of each prefix of 1, 2, ... characters."""
        parts = self.coder.cut.split(text) if self.coder.cut else [text]
        out, base = [], 0
        for i in range(0, len(parts), 2):
            counts = self._plain(parts[i])
            out.append(counts + base)
            if i + 1 < len(parts):
                # within a special token the text before it goes on as plain text
                token = parts[i + 1]
                unit = UNIT.findall(parts[i])[-1] if parts[i] else ""
                start = base + (int(counts[-1]) - self.total(unit) if unit else 0)
                base += int(counts[-1]) if len(counts) else 0
                out.append(np.append(self._plain(unit + token[:-1])[len(unit) :] + start, base + 1))
                base += 1
        return np.concatenate(out)

    def _plain(self, text: str) -> np.ndarray:
        out, base = [], 0
        for unit in UNIT.findall(text):
            counts = self.of_unit(unit)
            out.append(counts + base)
            base += int(counts[-1])
        return np.concatenate(out) if out else np.zeros(0, np.int64)


_workers: dict[str, PrefixCounts] = {}


def prefix_counts(path: str) -> PrefixCounts:
    """The worker's tables for a tokenizer file, kept from task to task."""
    if path not in _workers:
        _workers[path] = PrefixCounts(path)
    return _workers[path]


def count_tokens(docs: DataFrame, tokenizer: str, limit: int = 512, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row for each row of ``docs``: doc_id, n_bytes, n_tokens, over_limit (more than ``limit`` tokens).

    The count is that of the whole text's prefix. Special tokens in a text count one each. Null and empty
    texts have none; repeated rows are repeated; no rows give no rows; other columns are ignored. Nothing is shuffled.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = prefix_counts(tokenizer)
        for batch in batches:
            for some in words.slices(batch):
                size = pc.fill_null(pc.binary_length(some["text"]), 0).cast(pa.int64())
                yield pa.RecordBatch.from_arrays([some["doc_id"], size, pa.array(counter.totals(some["text"].to_pylist()))], ["doc_id", "n_bytes", "n_tokens"])

    small_batches(docs.sparkSession)
    rows = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(run, "doc_id bigint, n_bytes bigint, n_tokens bigint").withColumn("over_limit", F.col("n_tokens") > limit)


def stored(docs: DataFrame, tokenizer: str, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Rows (doc_id, block, counts array<int>): the count of every prefix; block b has those of BLOCK * b + 1 characters and on.

    A text's counts are worked out at once and leave in blocks. Null and empty texts have no block; ``docs``
    should have one row for each doc_id.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = prefix_counts(tokenizer)
        for batch in batches:
            for i, t in zip(batch["doc_id"].to_pylist(), batch["text"].to_pylist()):
                counts = counter.prefixes(t or "")
                for b in range(0, len(counts), BLOCK):
                    yield pa.RecordBatch.from_arrays([pa.array([i], pa.int64()), pa.array([b // BLOCK], pa.int64()), pa.array([counts[b : b + BLOCK]], pa.list_(pa.int32()))], ["doc_id", "block", "counts"])

    small_batches(docs.sparkSession)
    rows = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(run, "doc_id bigint, block bigint, counts array<int>")


def counts_at(store: DataFrame, questions: DataFrame) -> DataFrame:
    """``questions`` (doc_id, chars and others) with ``tokens``: the count of the document's first ``chars`` characters; null beyond its end, 0 at 0."""
    asked = questions.withColumn("__block", F.floor((F.col("chars") - 1) / BLOCK).cast("bigint"))
    own = store.select(F.col("doc_id").alias("__doc"), F.col("block").alias("__own"), "counts")
    found = asked.join(own, (F.col("doc_id") == F.col("__doc")) & (F.col("__block") == F.col("__own")), "left")
    tokens = F.when(F.col("chars") == 0, F.lit(0)).otherwise(F.get("counts", (F.col("chars") - 1 - F.col("__block") * BLOCK).cast("int")))
    return found.withColumn("tokens", tokens.cast("bigint")).drop("__block", "__doc", "__own", "counts")


def truncation(store: DataFrame, budget: int) -> DataFrame:
    """Rows (doc_id, chars, tokens): the longest prefix of at most ``budget`` tokens, of each document with text.

    A longer prefix may have fewer tokens than a shorter one, so the last place within the budget counts.
    """
    last = F.array_max(F.transform("counts", lambda c, i: F.when(c <= budget, i + 1)))
    block = store.select("doc_id", (F.col("block") * BLOCK + last).alias("chars"), F.get("counts", last - 1).alias("tokens"))
    best = F.max(F.when(F.col("chars").isNotNull(), F.struct("chars", "tokens")))
    return block.groupBy("doc_id").agg(best.alias("best")).select("doc_id", F.coalesce("best.chars", F.lit(0)).cast("bigint").alias("chars"), F.coalesce("best.tokens", F.lit(0)).cast("bigint").alias("tokens"))
