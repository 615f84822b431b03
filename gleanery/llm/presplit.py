"""Byte-level BPE over whole Arrow columns: texts are split by array operations, and each distinct word is encoded once.

Splitting follows the published rule :data:`SPLIT`.  A code point is a letter,
a number, a space or other; words begin where the class changes, but for two
exceptions.  A run of spaces before other text gives its last one away: U+0020
joins the word that follows, any other space is a word of its own.  And a lone
apostrophe takes one of the listed endings with it.

Words of at most :data:`LONGEST_HASHED` bytes are looked up by 64-bit hash in
a table whose size is bounded (it forgets all when full); longer ones are
encoded wherever they occur, since long strings with equal hashes can be built.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Sequence
from functools import cache

import numpy as np
import pyarrow as pa
import regex

from .textkernel import Chunk, chunks

#: The published pre-splitting rule of byte-level BPE.
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
LONGEST_HASHED = 64
#: Places of the word table (a power of two), how many words it holds, and how many ids those may have.
PLACES = 1 << 21
REMEMBERED_WORDS = 1_000_000
REMEMBERED_IDS = 4_000_000
_PROBES = 16

LETTER, NUMBER, SPACE, OTHER = range(4)


def check_tokenizer(spec_json: str) -> dict:
    """The parsed tokenizer file; an error unless it splits and spells as this module does."""
    spec = json.loads(spec_json)
    pre = spec.get("pre_tokenizer") or {}
    if pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex", True):
        raise ValueError("the tokenizer's pre_tokenizer must be ByteLevel, without a prefix space and with its own pattern")
    if spec.get("normalizer"):
        raise ValueError("the tokenizer must not normalize texts")
    model = spec["model"]
    if model.get("type", "BPE") != "BPE" or model.get("dropout") or model.get("continuing_subword_prefix") or model.get("end_of_word_suffix") or model.get("byte_fallback") or model.get("ignore_merges"):
        raise ValueError("the tokenizer's model must be plain byte-level BPE")
    if any(a.get("lstrip") or a.get("rstrip") or a.get("single_word") for a in spec["added_tokens"]):
        raise ValueError("added tokens must match literally")
    return spec


@cache
def classes() -> np.ndarray:
    """The class of each code point."""
    points = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    all_text = "".join(map(chr, points))
    out = np.full(0x110000, OTHER, np.uint8)
    place = np.array(points)
    for number, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (SPACE, r"\s+")):
        for m in regex.finditer(pattern, all_text):
            out[place[m.start() : m.end()]] = number
    return out


def word_starts(chunk: Chunk) -> np.ndarray:
    """Byte places where words begin; each word ends where the next one begins."""
    data = chunk.data
    if not len(data):
        return np.zeros(0, np.int64)
    at = np.flatnonzero((data & 0xC0) != 0x80)  # of each code point
    points = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
    kind = classes()[points]
    n = len(points)
    begin = np.ones(n, bool)
    begin[1:] = kind[1:] != kind[:-1]
    edge = np.searchsorted(at, chunk.offsets)
    own = np.zeros(n + 1, bool)  # first code point of a text
    own[edge] = True
    begin |= own[:n]
    run = begin.copy()
    # Where text follows a space.
    after = np.flatnonzero(run & (kind != SPACE) & ~own[:n])
    after = after[kind[after - 1] == SPACE]
    begin[after - 1] = True
    begin[after] = points[after - 1] != 32
    quote = np.flatnonzero(run & begin & (points == 39))
    quote = quote[quote + 1 < n]
    quote = quote[~own[quote + 1]]
    if len(quote):
        one = points[quote + 1]
        there = quote + 2 < n
        two = np.where(there & ~own[np.minimum(quote + 2, n)], points[np.minimum(quote + 2, n - 1)], 0)
        short = np.isin(one, [ord(c) for c in "stmd"])
        long = ((one == ord("r")) & (two == ord("e"))) | ((one == ord("v")) & (two == ord("e"))) | ((one == ord("l")) & (two == ord("l")))
        for hit, size in ((quote[short], 2), (quote[long & ~short], 3)):
            begin[hit + 1] = False
            over = hit + size
            begin[over[over < n]] = True
    return at[begin]


class WordEncoder:
    """Encodes chunks of texts; ``encode`` turns distinct words into lists of ids."""

    def __init__(self, encode: Callable[[list[bytes]], Sequence[Sequence[int]]]):
        self.encode = encode
        self.clear()

    def clear(self) -> None:
        self.keys = np.zeros(PLACES, np.uint64)
        self.values = np.full(PLACES, -1, np.int32)
        self.first, self.count = np.zeros(1024, np.int64), np.zeros(1024, np.int64)
        self.pool = np.zeros(1 << 16, np.uint32)
        self.words = self.ids = 0

    def _add(self, words: list[bytes]) -> np.ndarray:
        """The numbers of new words."""
        found = self.encode(words)
        sizes = np.fromiter(map(len, found), np.int64, len(found))
        n, total = len(words), int(sizes.sum())
        while self.words + n > len(self.first):
            self.first, self.count = (np.concatenate([x, np.zeros_like(x)]) for x in (self.first, self.count))
        if self.ids + total > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros(max(total, len(self.pool)), np.uint32)])
        new = slice(self.words, self.words + n)
        self.count[new] = sizes
        self.first[new] = self.ids + np.cumsum(sizes) - sizes
        self.pool[self.ids : self.ids + total] = np.fromiter((i for f in found for i in f), np.uint32, total)
        self.words += n
        self.ids += total
        return np.arange(new.start, new.stop, dtype=np.int32)

    def _look_up(self, h: np.ndarray) -> np.ndarray:
        """Numbers of words by hash; -1 for words that are not there."""
        at = (h & np.uint64(PLACES - 1)).astype(np.int64)
        out = np.where(self.keys[at] == h, self.values[at], -1)
        left = np.flatnonzero((out < 0) & (self.values[at] >= 0))
        for k in range(1, _PROBES):
            if not len(left):
                break
            place = (at[left] + k) & (PLACES - 1)
            hit = (self.keys[place] == h[left]) & (self.values[place] >= 0)
            out[left[hit]] = self.values[place[hit]]
            left = left[~hit & (self.values[place] >= 0)]
        return out

    def _insert(self, h: np.ndarray, numbers: np.ndarray) -> None:
        """Words that find no place within the probes are not remembered."""
        at = (h & np.uint64(PLACES - 1)).astype(np.int64)
        left = np.arange(len(h))
        for k in range(_PROBES):
            place = (at[left] + k) & (PLACES - 1)
            free = self.values[place] < 0
            taken, where = np.unique(place[free], return_index=True)
            mine = left[free][where]
            self.keys[taken], self.values[taken] = h[mine], numbers[mine]
            left = np.setdiff1d(left, mine, assume_unique=True)
            if not len(left):
                return

    def numbers(self, chunk: Chunk, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The number of each word."""
        h = chunk.hash_spans(starts, ends)
        out = self._look_up(h)
        long = ends - starts > LONGEST_HASHED
        out[long] = -1
        miss = np.flatnonzero((out < 0) & ~long)
        raw = chunk.data.tobytes()
        if len(miss):
            new, where, back = np.unique(h[miss], return_index=True, return_inverse=True)
            some = miss[where]
            numbers = self._add([raw[a:b] for a, b in zip(starts[some].tolist(), ends[some].tolist(), strict=True)])
            self._insert(new, numbers)
            out[miss] = numbers[back]
        some = np.flatnonzero(long)
        if len(some):
            out[some] = self._add([raw[a:b] for a, b in zip(starts[some].tolist(), ends[some].tolist(), strict=True)])
        return out

    def chunk(self, chunk: Chunk) -> tuple[np.ndarray, np.ndarray]:
        """All ids of a chunk, and where each text's begin; one more entry than texts."""
        if self.words > REMEMBERED_WORDS or self.ids > REMEMBERED_IDS:
            self.clear()
        starts = word_starts(chunk)
        if not len(starts):
            return np.zeros(0, np.uint32), np.zeros(chunk.n + 1, np.int64)
        number = self.numbers(chunk, starts, np.append(starts[1:], len(chunk.data)))
        sizes = self.count[number]
        ends = np.cumsum(sizes)
        ids = self.pool[np.repeat(self.first[number] - ends + sizes, sizes) + np.arange(ends[-1])]
        return ids, np.concatenate(([0], ends))[np.searchsorted(starts, chunk.offsets)]


def spliced(ids: np.ndarray, ends: np.ndarray, other: dict[int, Sequence[int]]) -> tuple[np.ndarray, np.ndarray]:
    """``ids`` with the texts in ``other`` replaced by what is there."""
    if not other:
        return ids, ends
    parts = [np.asarray(other[i], np.uint32) if i in other else ids[ends[i] : ends[i + 1]] for i in range(len(ends) - 1)]
    return np.concatenate(parts), np.concatenate(([0], np.cumsum([len(p) for p in parts])))


class TextEncoder:
    """Whole texts to ids: words by ``encode``, and texts that hold an added token's content by ``encode_whole``."""

    def __init__(self, encode: Callable[[list[bytes]], Sequence[Sequence[int]]], added: Sequence[str], encode_whole: Callable[[str], Sequence[int]]):
        self.words, self.added, self.encode_whole = WordEncoder(encode), [a.encode() for a in added], encode_whole

    def batches(self, column: pa.Array):
        """``(row, chunk, ids, ends)`` for bounded parts of a column."""
        for row, chunk in chunks(column):
            ids, ends = self.words.chunk(chunk)
            raw = chunk.data.tobytes()
            other = {}
            if any(a in raw for a in self.added):
                texts = ((i, chunk.text(i)) for i in range(chunk.n))
                other = {i: self.encode_whole(t.decode()) for i, t in texts if any(a in t for a in self.added)}
            yield row, chunk, *spliced(ids, ends, other)
