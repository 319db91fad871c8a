"""Counting quotient filters without loss: exact counters of integer keys as sorted runs of remainders.

A key of ``width`` bits is permuted by an invertible mix, so that any set of keys spreads evenly. The upper
bits of the result are the quotient, the rest is the remainder, which is kept whole: no two keys share an
entry. The entries stand in ascending order without gaps. One bit a quotient says whether it has a run, one
bit a slot whether it ends its run, one whether it holds a digit of the count of the entry before it rather
than a remainder; an entry without digits counts once. A key is found by rank and select on these bits.
Filters of one width are merged by merging their sorted entries.
"""

from __future__ import annotations

import struct
from collections.abc import Iterable
from dataclasses import dataclass

import numpy as np

HEAD = struct.Struct("<BBBxQ")
_ODD = 0x9E3779B97F4A7C15


def permuted(keys: np.ndarray, width: int) -> np.ndarray:
    """An invertible mix of numbers of ``width`` bits: multiplication by an odd number and a shift onto itself, twice."""
    mask, shift = np.uint64((1 << width) - 1), np.uint64((width + 1) // 2)
    x = keys.astype(np.uint64)
    for _ in range(2):  # in place: there are millions of keys
        x *= np.uint64(_ODD)
        x &= mask
        x ^= x >> shift
    return x


def restored(mixed: np.ndarray, width: int) -> np.ndarray:
    """The inverse of ``permuted``; a shift by half the width or more is its own inverse."""
    mask, shift, back = np.uint64((1 << width) - 1), np.uint64((width + 1) // 2), np.uint64(pow(_ODD, -1, 1 << 64))
    x = mixed.astype(np.uint64)
    for _ in range(2):
        x = x ^ (x >> shift)
        x = (x * back) & mask
    return x


def summed(mixed: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values in ascending order with the sums of their counts."""
    if not len(mixed):
        return mixed.astype(np.uint64), counts.astype(np.uint64)
    order = np.argsort(mixed, kind="stable")
    mixed, counts = mixed[order], counts[order]
    first = np.flatnonzero(np.concatenate([[True], mixed[1:] != mixed[:-1]]))
    return mixed[first], np.add.reduceat(counts.astype(np.uint64), first)


@dataclass
class Filter:
    """Entries (mixed key of ``width`` bits, count); read only."""

    width: int
    quotient_bits: int
    occupied: np.ndarray  # packed bits, one a quotient
    run_end: np.ndarray  # packed bits, one a slot
    digit: np.ndarray  # packed bits, one a slot
    slots: np.ndarray  # uint8 (slots, bytes of a remainder)

    @classmethod
    def of(cls, mixed: np.ndarray, counts: np.ndarray, width: int) -> Filter:
        """From distinct ascending values below 2 ** ``width`` and their counts, each 1 or more."""
        mixed, counts, n = mixed.astype(np.uint64), counts.astype(np.uint64), len(mixed)
        # whole bytes for remainders, and about as many quotients as entries or fewer
        size = min(8, max(1, -(-(width - max(0, n.bit_length() - 1)) // 8)))
        q = max(0, width - 8 * size)
        low = 8 * size
        quotient = mixed >> np.uint64(low) if low < 64 else np.zeros(n, np.uint64)
        remainder = mixed & np.uint64((1 << low) - 1)
        # counts above 1 take digits of a slot's size behind the remainder, least first
        digits, rest = np.zeros(n, np.int64), counts - np.uint64(1)
        while rest.any():
            digits += rest > 0
            rest = rest >> np.uint64(low) if low < 64 else np.zeros(n, np.uint64)
        at = np.cumsum(digits + 1) - (digits + 1)
        total = int(n + digits.sum())
        values, is_digit = np.zeros(total, np.uint64), np.ones(total, bool)
        values[at], is_digit[at] = remainder, False
        rest = counts - np.uint64(1)
        for k in range(int(digits.max(initial=0))):
            has = digits > k
            values[at[has] + 1 + k] = rest[has] & np.uint64((1 << low) - 1)
            rest = rest >> np.uint64(low) if low < 64 else np.zeros(n, np.uint64)
        last, occupied = np.zeros(total, bool), np.zeros(1 << q, bool)
        if n:
            ends = np.append(quotient[1:] != quotient[:-1], True)
            last[(at + digits)[ends]] = True
            occupied[quotient.astype(np.int64)] = True
        slots = values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :size].copy()
        return cls(width, q, np.packbits(occupied, bitorder="little"), np.packbits(last, bitorder="little"), np.packbits(is_digit, bitorder="little"), slots)

    @classmethod
    def counting(cls, keys: np.ndarray, width: int) -> Filter:
        """Counts of ``keys`` of ``width`` bits."""
        mixed = permuted(keys, width)
        mixed.sort()
        first = np.flatnonzero(np.append(True, mixed[1:] != mixed[:-1])) if len(mixed) else np.zeros(0, np.int64)
        return cls.of(mixed[first], np.diff(np.append(first, len(mixed))), width)

    def _bits(self, packed: np.ndarray, n: int) -> np.ndarray:
        return np.unpackbits(packed, count=n, bitorder="little").view(bool)

    def _values(self, rows: slice | np.ndarray = slice(None)) -> np.ndarray:
        part = self.slots[rows]
        wide = np.zeros((len(part), 8), np.uint8)
        wide[:, : part.shape[1]] = part
        return wide.view("<u8").reshape(-1).astype(np.uint64)

    def entries(self) -> tuple[np.ndarray, np.ndarray]:
        """Ascending mixed keys and their counts."""
        n, low = len(self.slots), 8 * self.slots.shape[1]
        values, is_digit, last = self._values(), self._bits(self.digit, n), self._bits(self.run_end, n)
        at = np.flatnonzero(~is_digit)
        run = np.cumsum(last) - last
        quotient = np.flatnonzero(self._bits(self.occupied, 1 << self.quotient_bits)).astype(np.uint64)
        high = quotient[run[at]] << np.uint64(low) if low < 64 else np.zeros(len(at), np.uint64)
        counts = np.ones(len(at), np.uint64)
        own, place = np.cumsum(~is_digit) - 1, np.arange(n)
        which = np.flatnonzero(is_digit)
        shift = (place[which] - at[own[which]] - 1).astype(np.uint64) * np.uint64(low % 64)
        np.add.at(counts, own[which], values[which] << shift)
        return high | values[at], counts

    def count(self, mixed: int) -> int:
        """The count of one mixed key, by rank and select."""
        n, low = len(self.slots), 8 * self.slots.shape[1]
        quotient, remainder = (mixed >> low, mixed & ((1 << low) - 1)) if low < 64 else (0, mixed)
        if not n or not self.occupied[quotient >> 3] >> (quotient & 7) & 1:
            return 0
        rank = int(np.count_nonzero(self._bits(self.occupied, quotient)))
        ends = np.flatnonzero(self._bits(self.run_end, n))
        start, end = int(ends[rank - 1]) + 1 if rank else 0, int(ends[rank]) + 1
        values, is_digit = self._values(slice(start, end)).tolist(), self._bits(self.digit, n)[start:end].tolist()
        for i, value in enumerate(values):
            if not is_digit[i] and value == remainder:
                found, k = 1, i + 1
                while k < len(values) and is_digit[k]:
                    found += values[k] << low * (k - i - 1)
                    k += 1
                return found
        return 0

    def to_bytes(self) -> bytes:
        head = HEAD.pack(self.width, self.quotient_bits, self.slots.shape[1], len(self.slots))
        return b"".join([head, self.occupied.tobytes(), self.run_end.tobytes(), self.digit.tobytes(), self.slots.tobytes()])

    @classmethod
    def from_bytes(cls, raw: bytes) -> Filter:
        width, q, size, n = HEAD.unpack_from(raw)
        at, parts = HEAD.size, []
        for length in (((1 << q) + 7) // 8, (n + 7) // 8, (n + 7) // 8, n * size):
            parts.append(np.frombuffer(raw, np.uint8, length, at))
            at += length
        return cls(width, q, *parts[:3], parts[3].reshape(n, size))


def merged(filters: Iterable[Filter]) -> Filter:
    """One filter of all entries of ``filters``, which have one width; there must be one at least."""
    filters = list(filters)
    parts = [f.entries() for f in filters]
    return Filter.of(*summed(np.concatenate([k for k, _ in parts]), np.concatenate([c for _, c in parts])), filters[0].width)
