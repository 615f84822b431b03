"""Vectorised word scanning over Arrow text columns.

A word is a maximal run of bytes outside ``0x20`` and ``0x09-0x0D``.  Those
separators are ASCII, so scanning the UTF-8 bytes finds the same words as
scanning code points.  Everything here works on bounded chunks of a batch, so
that the memory needed does not follow the batch's size: a chunk closes at
about :data:`CHUNK_BYTES`, and only a single longer text makes it larger.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK_BYTES = 1 << 20

_SEPARATOR = np.zeros(256, bool)
_SEPARATOR[[0x20, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_LEAD = (np.arange(256) & 0xC0) != 0x80

_BASE = 0x9E3779B97F4A7C15 | 1
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}


def _power_table(base: int, size: int) -> np.ndarray:
    have = _powers.get(base)
    if have is None or len(have) < size:
        have = np.full(max(size, CHUNK_BYTES + 1), base, np.uint64)
        have[0] = 1
        have = np.cumprod(have, dtype=np.uint64)
        if size <= CHUNK_BYTES + 1:
            _powers[base] = have
    return have[:size]


def mix64(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit finalizer: every input bit reaches every output bit."""
    x = x ^ np.uint64(seed * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@dataclass
class Chunk:
    """Texts laid end to end. ``offsets`` has one more entry than there are texts."""

    data: np.ndarray
    offsets: np.ndarray
    lower: bool

    @property
    def n(self) -> int:
        return len(self.offsets) - 1

    @cached_property
    def bytes(self) -> np.ndarray:
        return _LOWER[self.data] if self.lower else self.data

    @cached_property
    def spans(self) -> tuple[np.ndarray, np.ndarray]:
        """Byte starts and ends of the words."""
        n = len(self.data)
        inside = np.zeros(n + 1, bool)
        np.logical_not(_SEPARATOR[self.data], out=inside[:n])
        cut = np.zeros(n + 1, bool)
        cut[self.offsets] = True
        before = np.zeros(n + 1, bool)
        before[1:] = inside[:-1]
        starts = np.flatnonzero(inside & (~before | cut))
        ends = np.flatnonzero(before & (~inside | cut))
        return starts, ends

    @cached_property
    def counts(self) -> np.ndarray:
        """Words in each text."""
        return np.diff(np.searchsorted(self.spans[0], self.offsets))

    @cached_property
    def first(self) -> np.ndarray:
        """Index of each text's first word; one more entry than texts."""
        return np.concatenate(([0], np.cumsum(self.counts)))

    @cached_property
    def _running(self) -> np.ndarray:
        n = len(self.data)
        total = np.zeros(n + 1, np.uint64)
        np.cumsum((self.bytes.astype(np.uint64) + np.uint64(1)) * _power_table(_BASE, n), out=total[1:])
        return total

    def hash_spans(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """64 bits for each span, from all its bytes."""
        return mix64((self._running[ends] - self._running[starts]) * _power_table(_BASE_INVERSE, len(self.data) + 1)[starts])

    @cached_property
    def hashes(self) -> np.ndarray:
        """64 bits for each word."""
        return self.hash_spans(*self.spans)

    def sums(self, per_byte: np.ndarray) -> np.ndarray:
        """Per-text totals of a per-byte mask."""
        total = np.zeros(len(self.data) + 1, np.int64)
        np.cumsum(per_byte, out=total[1:])
        return np.diff(total[self.offsets])

    def word_chars(self) -> np.ndarray:
        """Code points inside words, per text."""
        return self.sums(_LEAD[self.data] & ~_SEPARATOR[self.data])

    def text(self, i: int) -> bytes:
        return self.data[self.offsets[i] : self.offsets[i + 1]].tobytes()

    def shingles(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all windows of ``k`` words, and each window's text.

        A text with fewer words, but at least one, has its whole sequence as
        its only window.
        """
        h, owner = self.hashes, np.repeat(np.arange(self.n), self.counts)
        acc = np.zeros(len(h), np.uint64)
        for j in range(k):
            part = h[j:] if j else h
            acc[: len(part)] = acc[: len(part)] * np.uint64(0xD6E8FEB86659FD93) + part
        inside = np.arange(len(h)) + k <= self.first[1:][owner] if len(h) else np.zeros(0, bool)
        windows, owners = mix64(acc[inside], k), owner[inside]
        short = np.flatnonzero((self.counts > 0) & (self.counts < k))
        if len(short):
            extra = np.empty(len(short), np.uint64)
            for x, i in enumerate(short):
                value = int(self.counts[i])
                for w in h[self.first[i] : self.first[i + 1]].tolist():
                    value = (value * 0xD6E8FEB86659FD93 + w) & 0xFFFFFFFFFFFFFFFF
                extra[x] = value
            windows, owners = np.concatenate([windows, mix64(extra, 101)]), np.concatenate([owners, short])
        return windows, owners


def chunks(column: pa.Array, lower: bool = False) -> Iterator[tuple[int, Chunk]]:
    """Bounded chunks of a string column (null reads as empty) with each one's first row."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    _, at, data = column.buffers()
    offsets = np.frombuffer(at, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    row = 0
    while row < len(column):
        stop = int(np.searchsorted(offsets, offsets[row] + CHUNK_BYTES, "right")) - 1
        stop = min(max(stop, row + 1), len(column))
        lo, hi = offsets[row], offsets[stop]
        yield row, Chunk(raw[lo:hi], (offsets[row : stop + 1] - lo).astype(np.int64), lower)
        row = stop
