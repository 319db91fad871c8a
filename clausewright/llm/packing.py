"""Packing of tokenized documents by concatenation and cutting.

First pass: each task tokenizes its rows and notes where each starts among the task's tokens. The tasks'
token totals, summed before each task, then give every document its offset in the whole. Second pass: fixed
windows cut the documents at their global offsets; a document that crosses a window's edge leaves a record
on either side. No token is shuffled.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import words
from .common import small_batches, written

#: Distinct words, and parts of words, whose ids a Python worker keeps; beyond that it starts anew.
KEPT = 1_000_000
#: Bytes of text that are tokenized at once: the more, the fewer times a word is looked up.
SLICE_BYTES = 8 << 20
#: Stands between strings that are tokenized together; a token of its own.
BETWEEN = "\x01"
#: Words of these characters have one normal form, so that lower-casing and the tokenizer's own pattern cut them as it does.
PLAIN = "^[!-~\xa1-\u012f\u0131-\u024f]+$"


class WordIds:
    """Token ids of words by the tokenizers library; a word, and a part of a word, is tokenized once while it is kept.

    Holds for tokenizers that drop white space, so that a text's ids are its words' ids in order.
    """

    def __init__(self, path: str, kept: int = KEPT) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.kept = Tokenizer.from_file(path), kept
        between = self.tokenizer.encode(BETWEEN, add_special_tokens=False).ids
        self.between = between[0] if len(between) == 1 else None
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.special = [t["content"] for t in spec["added_tokens"]]
        steps = (spec.get("pre_tokenizer") or {}).get("pretokenizers", [{}])
        kinds = [x["type"] for x in (spec.get("normalizer") or {}).get("normalizers", [])]
        pattern = steps[0].get("pattern", {}).get("Regex") if steps[0].get("behavior") == "Removed" and steps[0].get("invert") else None
        #: cuts a word into the parts that the tokenizer merges on their own; None where it isn't of this kind
        self.parts_of = regex.compile(pattern + r"|\n").findall if pattern and kinds == ["NFC", "Replace", "Lowercase"] else None
        self.words, self.parts = words.Ragged(), words.Ragged()

    def tokenize(self, table: words.Ragged, new: list[str]) -> None:
        """Stores the ids of ``new``; strings go in together with BETWEEN around them, which no merge crosses."""
        plain = [w for w in new if BETWEEN not in w] if self.between is not None else []
        rest = [w for w in new if BETWEEN in w] if self.between is not None else new
        for i in range(0, len(plain), 4000):
            names = plain[i : i + 4000]
            ids = np.array(self.tokenizer.encode_batch_fast([f" {BETWEEN} ".join(names)], add_special_tokens=False)[0].ids, np.int64)
            cuts = np.flatnonzero(ids == self.between)
            if len(cuts) == len(names) - 1:
                table.store(names, ids[ids != self.between], np.diff(np.concatenate([[-1], cuts, [len(ids)]])) - 1)
            else:  # a string's own ids hold BETWEEN's
                rest += names
        for w in rest:
            ids = np.array(self.tokenizer.encode(w, add_special_tokens=False).ids, np.int64)
            table.store([w], ids, np.array([len(ids)]))

    def by_parts(self, names: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of plain words one after another, and the number of each."""
        lines = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(names)], pa.int32()), names), "\n")[0].as_py()
        flat = self.parts_of(lines.lower())
        distinct = dict.fromkeys(flat)
        if len(self.parts.slot) + len(distinct) > self.kept:
            self.parts.clear()
        known = self.parts.slot
        if "\n" not in known:  # stands between words and has no ids
            self.parts.store(["\n"], np.zeros(0, np.int64), np.zeros(1, np.int64))
        self.tokenize(self.parts, [p for p in distinct if p not in known])
        slots = self.parts.slots(flat)
        ids, ends = self.parts.lists(slots)
        return ids, np.diff(ends[np.concatenate([[0], np.flatnonzero(slots == known["\n"]), [len(slots)]])])

    def whole(self, words_: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of other words."""
        names = words_.to_pylist()
        if len(self.words.slot) + len(names) > self.kept:
            self.words.clear()
        known = self.words.slot
        self.tokenize(self.words, [w for w in names if w not in known])
        ids, ends = self.words.lists(self.words.slots(names))
        return ids, np.diff(ends)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of ``texts`` and the number of each text."""
        codes, at, distinct = words.split(texts)
        plain = np.zeros(len(distinct), bool)
        if self.parts_of and len(distinct):
            plain = np.asarray(pc.match_substring_regex(distinct, PLAIN))
            if self.special:
                plain = plain & ~np.asarray(pc.match_substring_regex(distinct, "|".join(map(re.escape, self.special))))
        start, length, flat, done = np.zeros(len(distinct), np.int32), np.zeros(len(distinct), np.int32), [], 0
        for mask, work in ((plain, self.by_parts), (~plain, self.whole)):
            if mask.any():
                ids, counts = work(distinct.filter(pa.array(mask)))
                start[mask], length[mask] = done + np.cumsum(counts) - counts, counts
                flat.append(ids)
                done += len(ids)
        lengths = length[codes]
        ids = words.gather(np.concatenate(flat), start[codes], lengths) if flat else np.zeros(0, np.int64)
        return ids, np.diff(np.concatenate([[0], np.cumsum(lengths)])[at])


_workers: dict[str, WordIds] = {}


def word_ids(path: str) -> WordIds:
    """The worker's table for a tokenizer file, kept from task to task."""
    if path not in _workers:
        _workers[path] = WordIds(path)
    return _workers[path]


def tokenized(docs: DataFrame, tokenizer: str, end_id: int = 1, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Rows (doc_id, part, part_start, tokens, ids): each document's ids with ``end_id`` after them, as little-endian 16- or 32-bit numbers; part_start counts the task's tokens before it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, part, done = word_ids(tokenizer), TaskContext.get().partitionId(), 0
        kind = "<u2" if table.tokenizer.get_vocab_size() <= 1 << 16 else "<u4"
        for batch in batches:
            for some in words.slices(batch, limit=SLICE_BYTES):
                ids, counts = table.encode(some["text"])
                ids = np.insert(ids, np.cumsum(counts), end_id).astype(kind)
                counts = counts + 1
                ends = np.cumsum(counts)
                offsets = np.concatenate([[0], ends]) * ids.itemsize
                blob = pa.Array.from_buffers(pa.binary(), len(counts), [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(ids.tobytes())])
                columns = [some["doc_id"], pa.array(np.full(len(counts), part, np.int32)), pa.array(done + ends - counts), pa.array(counts), blob]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "part", "part_start", "tokens", "ids"])
                done += int(ends[-1])

    small_batches(docs.sparkSession)
    rows = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(run, "doc_id bigint, part int, part_start bigint, tokens bigint, ids binary")


def cut(rows: DataFrame, length: int) -> DataFrame:
    """Pieces of ``rows`` (doc_id, first, tokens, ids) in windows of ``length`` tokens; a piece's ids are little-endian 32-bit numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[] for _ in range(7)]
            for doc, first, n, raw in zip(*(batch[k].to_pylist() for k in ("doc_id", "first", "tokens", "ids"))):
                ids = np.frombuffer(raw, f"<u{len(raw) // n}").astype("<u4")
                edges = [0, *range(length - first % length, n, length), n]
                for a, b in zip(edges, edges[1:]):
                    for column, x in zip(out, (doc, a, b - a, n, (first + a) // length, (first + a) % length, ids[a:b].tobytes())):
                        column.append(x)
            kinds = [*[pa.int64()] * 6, pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(out, kinds)], ["doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "ids"])

    return rows.mapInArrow(run, "doc_id bigint, start bigint, length bigint, doc_tokens bigint, sequence_id bigint, offset bigint, ids binary")


def pack(docs: DataFrame, tokenizer: str, length: int = 2048, end_id: int = 1, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Pieces (doc_id, start, length, doc_tokens, sequence_id, offset, ids binary) that fill sequences of ``length`` tokens.

    Every sequence but the last is full, so at most ``length`` - 1 places are padded in all. Each id of each
    row, ``end_id`` included, lies in exactly one piece. Null and empty texts have ``end_id`` alone; a null
    doc_id stays null; repeated rows are packed each; no rows give no pieces; other columns are ignored.
    """
    table = written(tokenized(docs, tokenizer, end_id, text, doc_id), "tokens")
    totals = table.groupBy("part").agg(F.sum("tokens").alias("total"))
    # one row for each task of the first pass, whatever its data: small enough for one task here, and to broadcast
    before = totals.select("part", (F.sum("total").over(W.orderBy("part")) - F.col("total")).alias("before"))
    placed = table.join(F.broadcast(before), "part").select("doc_id", (F.col("before") + F.col("part_start")).alias("first"), "tokens", "ids")
    return cut(placed, length)


def sequences(pieces: DataFrame) -> DataFrame:
    """Rows (sequence_id, tokens, doc_ids, ids binary): each sequence's pieces joined; a group has ``length`` tokens at most."""
    item = F.struct("offset", "doc_id", "length", "ids")
    whole = pieces.groupBy("sequence_id").agg(F.array_sort(F.collect_list(item)).alias("all"))
    ids = F.aggregate("all", F.lit(b""), lambda done, x: F.concat(done, x["ids"]))
    tokens = F.aggregate("all", F.lit(0).cast("bigint"), lambda done, x: done + x["length"])
    return whole.select("sequence_id", tokens.alias("tokens"), F.transform("all", lambda x: x["doc_id"]).alias("doc_ids"), ids.alias("ids"))
