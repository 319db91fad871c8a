"""Word splitting of Arrow batches, for the operators that work in Python tasks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that a task handles at once; a longer text stands alone.
SLICE_BYTES = 4 << 20


def slices(batch: pa.RecordBatch, column: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Parts of ``batch`` whose texts have at most ``limit`` bytes together."""
    size = np.asarray(pc.fill_null(pc.binary_length(batch[column]), 0)).astype(np.int64)
    group = np.cumsum(size) // limit
    cuts = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), batch.num_rows]
    for a, b in zip(cuts, cuts[1:]):
        if b > a:
            yield batch.slice(a, b - a)


def split(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Codes of all words, offsets of each text's words among them, and the distinct words; null texts have none."""
    lists = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
    flat, at = lists.flatten(), np.asarray(lists.offsets).astype(np.int64)
    at = at - at[0]
    full = np.asarray(pc.binary_length(flat)) > 0
    if not full.all():
        flat = flat.filter(pa.array(full))
        at = np.concatenate([[0], np.cumsum(full)])[at]
    coded = flat.dictionary_encode()
    return np.asarray(coded.indices), at, coded.dictionary


def gather(flat: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The pieces ``flat[start:start+length]`` one after another."""
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    kind = np.int32 if max(total, len(flat)) < 1 << 31 else np.int64
    shift = (starts - (ends - lengths)).astype(kind)
    return flat[np.repeat(shift, lengths) + np.arange(total, dtype=kind)]


class Ragged:
    """Lists of numbers under names: what a Python worker has worked out and keeps from task to task."""

    def __init__(self) -> None:
        self.clear()

    def clear(self) -> None:
        self.slot: dict[str, int] = {}
        self.flat, self.used = np.zeros(1 << 16, np.int32), 0
        self.start, self.length = np.zeros(1 << 14, np.int32), np.zeros(1 << 14, np.int32)

    def store(self, names: list[str], numbers: np.ndarray, lengths: np.ndarray) -> None:
        """``numbers`` holds the new names' lists one after another."""
        n, m = len(self.slot), len(names)
        while n + m > len(self.start):
            self.start, self.length = np.resize(self.start, 2 * len(self.start)), np.resize(self.length, 2 * len(self.length))
        while self.used + len(numbers) > len(self.flat):
            self.flat = np.resize(self.flat, 2 * len(self.flat))
        self.flat[self.used : self.used + len(numbers)] = numbers
        self.start[n : n + m], self.length[n : n + m] = self.used + np.cumsum(lengths) - lengths, lengths
        self.slot.update(zip(names, range(n, n + m)))
        self.used += len(numbers)

    def slots(self, names: list[str]) -> np.ndarray:
        return np.fromiter(map(self.slot.__getitem__, names), np.int64, len(names))

    def lists(self, slots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The lists of ``slots`` one after another, and where each begins and the last ends."""
        lengths = self.length[slots]
        return gather(self.flat, self.start[slots], lengths), np.concatenate([[0], np.cumsum(lengths)])
