"""Fill-in-middle transformation with piece tables.

A document is a list of descriptors (buffer, start, length) over two buffers that never change: its text and
the sentinels. Cutting splits a descriptor, an arrangement permutes descriptors and puts sentinels between
them, the inverse permutation restores the text, and hashes are fed descriptor by descriptor. Bytes are copied
only where an output text is asked for.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words
from .common import small_batches

#: The buffer of sentinels, and where each of them stands in it.
SENTINELS = b"<P><S><M>"
PREFIX, SUFFIX, MIDDLE = (0, 3), (3, 3), (6, 3)
#: Sentinel and part (0 prefix, 1 middle, 2 suffix) in the order of each form's output.
FORMS = {"psm": ((PREFIX, 0), (SUFFIX, 2), (MIDDLE, 1)), "spm": ((SUFFIX, 2), (PREFIX, 0), (MIDDLE, 1))}
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True


class Piece(NamedTuple):
    buffer: int  # 0: the text, 1: the sentinels
    start: int
    length: int


class PieceTable:
    """Descriptors over an immutable text and the sentinels."""

    def __init__(self, text: bytes | memoryview, pieces: list[Piece] | None = None) -> None:
        self.buffers = (memoryview(text), memoryview(SENTINELS))
        self.pieces = [Piece(0, 0, len(text))] if pieces is None else pieces

    def cut(self, *places: int) -> PieceTable:
        """The descriptors split at byte offsets of what they spell, in ascending order; empty parts stay, so that n cuts of one piece give n + 1."""
        out, done, at = [], 0, list(places)
        for buffer, start, length in self.pieces:
            edges = [0]
            while at and at[0] <= done + length:
                edges.append(at.pop(0) - done)
            edges.append(length)
            out += [Piece(buffer, start + a, b - a) for a, b in zip(edges, edges[1:])]
            done += length
        return PieceTable(self.buffers[0], out)

    def arranged(self, form: str) -> PieceTable:
        """Prefix, middle and suffix in the order of ``form``, each behind its sentinel."""
        return PieceTable(self.buffers[0], [p for mark, part in FORMS[form] for p in (Piece(1, *mark), self.pieces[part])])

    def restored(self, form: str) -> PieceTable:
        """The inverse of ``arranged``: sentinels go, parts return to their order."""
        parts = self.pieces[1::2]
        back = np.argsort([part for _, part in FORMS[form]]).tolist()
        return PieceTable(self.buffers[0], [parts[i] for i in back])

    def found(self, form: str) -> PieceTable:
        """The descriptors of an arranged output that is given as a text alone. A part holds no sentinel, so the first of each is the one that was put there."""
        text, places, at = bytes(self.buffers[0]), [], 0
        for (start, length), _ in FORMS[form]:
            at = text.index(SENTINELS[start : start + length], at)
            places += [at, at + length]
            at += length
        return PieceTable(text, self.cut(*places[1:]).pieces)

    def stream(self) -> Iterator[memoryview]:
        for buffer, start, length in self.pieces:
            yield self.buffers[buffer][start : start + length]

    def sha256(self) -> str:
        h = hashlib.sha256()
        for part in self.stream():
            h.update(part)
        return h.hexdigest()

    def spelled(self) -> bytes:
        return b"".join(self.stream())


def token_ends(raw: np.ndarray) -> np.ndarray:
    """Byte offsets behind each token of a text: a word with the white space before it; what trails is a token too."""
    if not len(raw):
        return np.zeros(0, np.int64)
    space = SPACE[raw]
    return np.append(np.flatnonzero(~space[:-1] & space[1:]) + 1, len(raw))


def draws(doc_id: int | None, seed: int = 42) -> tuple[int, int, int, int]:
    """Four 32-bit numbers of the document; a null id counts as the word null."""
    digest = hashlib.sha256(f"{seed}:{'null' if doc_id is None else doc_id}".encode()).hexdigest()
    return tuple(int(digest[i : i + 8], 16) for i in (0, 8, 16, 24))


def planned(text: bytes, doc_id: int | None, rate: int = 50, spm: int = 80, seed: int = 42) -> tuple[PieceTable, str, int, int | None, int | None]:
    """Table of the output, form, number of tokens, code points of prefix and of middle."""
    raw = np.frombuffer(text, np.uint8)
    ends = token_ends(raw)
    n, (h1, h2, h3, h4) = len(ends), draws(doc_id, seed)
    whole = PieceTable(text)
    if not n or any(SENTINELS[a : a + k] in text for a, k in (PREFIX, SUFFIX, MIDDLE)) or h3 % 100 >= rate:
        return whole, "plain", n, None, None
    form = "spm" if h4 % 100 < spm else "psm"
    first, second = (int(ends[k - 1]) if k else 0 for k in sorted((h1 % (n + 1), h2 % (n + 1))))
    chars = lambda a, b: int(np.count_nonzero((raw[a:b] & 0xC0) != 0x80))
    return whole.cut(first, second).arranged(form), form, n, chars(0, first), chars(first, second)


def transform(docs: DataFrame, rate: int = 50, spm: int = 80, seed: int = 42, text: str = "text", doc_id: str = "doc_id", outputs: bool = True) -> DataFrame:
    """One row for each row of ``docs``: doc_id, n, form, prefix_chars, middle_chars, pieces, output, output_sha256, restored_sha256.

    Of texts with tokens and without a sentinel, ``rate`` in a hundred are arranged, ``spm`` in a hundred of
    them suffix first; which ones, and where they are cut, follows from ``seed`` and doc_id alone, so that
    repeated rows are arranged alike. ``pieces`` are the output's descriptors in bytes: buffer 0 is the text,
    1 the sentinels. ``restored_sha256`` is of the text rebuilt from output and form alone. Null texts count
    as empty and are plain, a null doc_id draws as one document; no rows give no rows; other columns are
    ignored. With ``outputs`` false no output is returned. Nothing is shuffled.
    """
    fields = "doc_id bigint, n bigint, form string, prefix_chars bigint, middle_chars bigint, pieces array<struct<buffer:int,start:bigint,length:bigint>>, output string, output_sha256 string, restored_sha256 string"
    piece = pa.struct([("buffer", pa.int32()), ("start", pa.int64()), ("length", pa.int64())])
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.list_(piece), pa.string(), pa.string(), pa.string()]
    names = [f.split()[0] for f in fields.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some in words.slices(batch):
                rows = []
                for i, raw in zip(some["doc_id"].to_pylist(), some["text"].cast(pa.binary()).to_pylist()):
                    table, form, n, prefix, middle = planned(raw or b"", i, rate, spm, seed)
                    output = table.spelled() if outputs or form != "plain" else b""
                    back = table if form == "plain" else PieceTable(output).found(form).restored(form)
                    rows.append((i, n, form, prefix, middle, [p._asdict() for p in table.pieces], output.decode() if outputs else None, table.sha256(), back.sha256()))
                yield pa.RecordBatch.from_arrays([pa.array(column, kind) for column, kind in zip(zip(*rows), kinds)], names)

    small_batches(docs.sparkSession)
    rows = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(run, fields)


def restore(outputs: DataFrame, output: str = "output", form: str = "form") -> DataFrame:
    """The rows of ``outputs`` with column ``restored``: the text that each was made of; null for a null output."""
    fields = [f for f in outputs.schema.fields if f.name != "restored"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for raw, kind in zip(batch[output].cast(pa.binary()).to_pylist(), batch[form].to_pylist()):
                texts.append(raw if raw is None or kind == "plain" else PieceTable(raw).found(kind).restored(kind).spelled())
            yield pa.RecordBatch.from_arrays([*(batch[f.name] for f in fields), pa.array(texts, pa.binary()).cast(pa.string())], [*(f.name for f in fields), "restored"])

    small_batches(outputs.sparkSession)
    schema = outputs.select(*(F.col(f"`{f.name}`") for f in fields), F.lit("").alias("restored")).schema
    return outputs.select(*(F.col(f"`{f.name}`") for f in fields)).mapInArrow(run, schema)
