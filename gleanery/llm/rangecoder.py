"""Token ids in files, by an adaptive context-mixing range coder.

Documents go to files in ascending id order.  A file's row is a segment:
whole documents, with their ids' numbers, and the ids of all of them cut into
blocks.  A block's coder starts from nothing, so blocks can be read on their
own, and carries a CRC-32 of its ids.

A block begins with its alphabet, the distinct ids in it, as gaps in
variable-length bytes.  Three orders then predict each next id.  Order 0 is
an adaptive distribution over the alphabet, from how often each id came so
far.  Order 1 predicts the id that followed the last id when that last came;
order 2 does so for the last two.  The three are mixed: the ids that orders 2
and 1 predict each get a weight of the whole, and order 0's distribution the
rest.  The weights adapt too; they are how often each order was right while
both were as sure of themselves as they are now (how often in a row each was
right, and whether they agree).  Order 2's and 1's predictions change with
every id; order 0's distribution and the weights are brought up to date at
steps that grow by half, from the 16th id on.

What the mixture gives an id drives a 64-bit range coder with carries, which
gives out 32 bits at a time.  A segment's blocks are coded in step, one vector
lane each.  All arithmetic is in integers or single IEEE operations, so that
every machine decodes alike.

Edge cases: null and empty texts have no ids but the appended one.  Rows that
repeat an id are documents of their own, in the order of a hash of their
texts, so that an id that a third of all rows share is spread over ranges.
Null ids come first, as they do in Spark's order.  Ids up to 2**32 - 1 are
possible.  An empty table gives files without segments.  A damaged block
raises an error.  Other columns are ignored.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._shared import Scratch
from .bpe_automaton import byte_letters
from .presplit import TextEncoder, check_tokenizer

#: The most ids in a block, and the largest that is allowed.
BLOCK = 4096
LARGEST_BLOCK = 1 << 14
#: A segment is closed at so many ids; it is what a task holds at once.
SEGMENT = 1 << 23

#: Bits of the weights' total, and the least bits of order 0's total.
_WEIGHT_BITS = 12
_LEAST_BITS = 12
#: Places for order 2's predictions in a block.
_PAIRS = 1024
#: Counts that the weights start from: order 2 right, order 1 right, order 0.
_PRIOR = (1, 1, 6)
_FULL = np.uint64(0xFFFFFFFF)
_32 = np.uint64(32)


def _epochs(steps: int) -> Iterator[tuple[int, int]]:
    """Spans of steps between which the distributions are brought up to date."""
    a, b = 0, 16
    while a < steps:
        yield a, min(b, steps)
        a, b = b, b + (b + 1) // 2


def _shape(n: int, block: int) -> tuple[int, int]:
    """Blocks of a segment, and ids in each (the last one may lack a few)."""
    if not 0 < block <= LARGEST_BLOCK:
        raise ValueError(f"a block holds 1 to {LARGEST_BLOCK} ids")
    lanes = -(-n // block)
    return lanes, -(-n // lanes)


class _Mixture:
    """The distributions of a segment's blocks; ``sizes`` are the alphabets'."""

    def __init__(self, sizes: np.ndarray):
        self.lanes, self.width = len(sizes), int(sizes.max())
        self.bits = max(_LEAST_BITS, int(self.width - 1).bit_length() + 1)
        self.shift = np.uint64(_WEIGHT_BITS + self.bits)
        lane = np.arange(self.lanes)
        self.sizes, self.row, self.own = sizes, lane * self.width, lane * 32
        self.counts = np.zeros((self.lanes, self.width), np.int32)
        self.events = np.tile(np.array(_PRIOR, np.int64), (self.lanes * 32, 1))
        # What orders 1 and 2 predict, one after the other: id << 2 | how sure (0: no prediction yet).
        self.told = np.zeros(self.lanes * (self.width + _PAIRS), np.uint16)
        self.pairs = lane * _PAIRS + self.lanes * self.width
        used = np.arange(1, self.width)[None, :] < sizes[:, None]
        self.used = np.flatnonzero(np.concatenate([np.zeros((self.lanes, 1), bool), used], axis=1))
        self.renew(False)

    def renew(self, look_up: bool) -> None:
        """Order 0's distribution and the weights, from the counts."""
        slots = 1 << self.bits
        before = np.cumsum(self.counts, axis=1, dtype=np.int64)
        total = before[:, -1:].copy()
        before -= self.counts
        if not total.any():  # every id of the alphabet alike
            before[:], total[:] = np.arange(self.width), self.sizes[:, None]
        places = before * ((slots - self.sizes[:, None]) / total)
        start = np.floor(places).astype(np.int32) + np.arange(self.width, dtype=np.int32)
        end = np.append(start[:, 1:], np.full((self.lanes, 1), slots, np.int32), axis=1)
        end[np.arange(self.lanes), self.sizes - 1] = slots
        start, size = start.reshape(-1), (end - start).reshape(-1)
        #: By lane and id: start << 16 | size.
        self.spans = (start.astype(np.uint32) << np.uint32(16)) | size.astype(np.uint32)
        seen = self.events.sum(axis=1)
        scale = (1 << _WEIGHT_BITS) - 3
        end2 = 1 + self.events[:, 0] * scale // seen
        #: By lane and state: where order 2's weight ends << 16 | where order 1's does; order 0 has the rest.
        self.ends = (end2 << 16 | end2 + 1 + self.events[:, 1] * scale // seen).astype(np.uint32)
        if look_up:
            marks = np.zeros(self.lanes * slots, np.uint16)
            marks[(self.used // self.width) * slots + start[self.used]] = 1
            #: By lane and place: the id.
            self.at = np.cumsum(marks.reshape(self.lanes, slots), axis=1, dtype=np.uint16).reshape(-1)

    def learn(self, symbols: np.ndarray, state: np.ndarray, event: np.ndarray) -> None:
        """Counts a span of steps: (steps, lanes) of ids, weight states (with the lane's) and events."""
        self.counts += np.bincount((self.row + symbols).reshape(-1), minlength=self.counts.size).reshape(self.counts.shape).astype(np.int32)
        self.events += np.bincount((state * 3 + event).reshape(-1), minlength=self.events.size).reshape(self.events.shape)


def _states(told: tuple[np.ndarray, np.ndarray], own: np.ndarray) -> np.ndarray:
    """Which weights hold, from what orders 1 and 2 predict: how sure both are, and whether they agree."""
    one, two = told
    return ((two & 3) << 3 | (one & 3) << 1 | ((two ^ one) < 4)) + own


def _alphabets(ids: np.ndarray, lanes: int, steps: int) -> tuple[list[np.ndarray], np.ndarray]:
    """Each block's distinct ids, ascending, and all ids as their numbers, a column a block."""
    top = int(ids.max()) + 1
    small = top <= 1 << 20
    seen, rank = (np.zeros(top, bool), np.zeros(top, np.uint16)) if small else (None, None)
    found, symbols = [], np.zeros((lanes, steps), np.uint16)
    for k in range(lanes):
        own = ids[k * steps : (k + 1) * steps]
        if small:
            seen[own] = True
            each = np.flatnonzero(seen)
            seen[each] = False
            rank[each] = np.arange(len(each), dtype=np.uint16)
            symbols[k, : len(own)] = rank[own]
        else:
            each, back = np.unique(own, return_inverse=True)
            symbols[k, : len(own)] = back
        found.append(each)
    return found, np.ascontiguousarray(symbols.T)


def _pack(numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers below 2**35 in bytes of 7 bits, the lowest first, and how many bytes each takes."""
    size = np.ones(len(numbers), np.int64)
    for k in range(1, 5):
        size += numbers >= 1 << 7 * k
    first = np.cumsum(size) - size
    nth = np.arange(int(size.sum())) - np.repeat(first, size)
    part = np.repeat(numbers, size) >> 7 * nth & 127
    return (part | np.where(nth + 1 < np.repeat(size, size), 128, 0)).astype(np.uint8), size


def _unpack(packed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The numbers, and where each one's bytes end."""
    ends = np.flatnonzero(packed < 128) + 1
    first = np.concatenate(([0], ends[:-1])) if len(ends) else ends
    nth = np.minimum(np.arange(ends[-1] if len(ends) else 0) - np.repeat(first, ends - first), 4)
    parts = (packed[: len(nth)].astype(np.int64) & 127) << 7 * nth
    return np.add.reduceat(parts, first) if len(ends) else ends, ends


def encode_blocks(ids: np.ndarray, block: int = BLOCK) -> list[bytes]:
    """The coded blocks of ``ids``: CRC-32 of its ids, alphabet's bytes and their number, and words."""
    n = len(ids)
    if not n:
        return []
    ids = np.asarray(ids).astype("<u4", copy=False)
    lanes, steps = _shape(n, block)
    alphabets, symbols = _alphabets(ids, lanes, steps)
    m = _Mixture(np.array([len(a) for a in alphabets]))
    room = (steps * (int(m.shift) + 1)) // 32 + 8
    words = np.zeros(lanes * room, np.uint32)
    put = np.arange(lanes) * room
    low, size = np.zeros(lanes, np.uint64), np.full(lanes, 0xFFFFFFFFFFFFFFFF, np.uint64)
    last, before = np.zeros(lanes, np.int64), np.zeros(lanes, np.int64)
    weight_total, bits = np.int64(1 << _WEIGHT_BITS), m.bits

    def carry(at: np.ndarray) -> None:
        while len(at):
            words[at] += np.uint32(1)
            at = at[words[at] == 0] - 1

    for a, b in _epochs(steps):
        if a:
            m.renew(False)
        s = symbols[a:b].astype(np.int64)
        previous = np.concatenate([last[None], s[:-1]])
        older = np.concatenate([before[None], previous[:-1]])
        at = np.concatenate([previous + m.row, _pair(previous, older) + m.pairs], axis=1)
        told = np.empty(at.shape, np.uint16)
        bare = symbols[a:b] << np.uint16(2)
        twice = np.concatenate([bare, bare], axis=1)
        for t in range(b - a):
            where = at[t]
            told[t] = now = m.told.take(where)
            m.told[where] = _next(now, twice[t])
        last, before = s[-1], previous[-1]
        told = told[:, :lanes], told[:, lanes:]
        state = _states(told, m.own)
        right = [((x ^ bare) < 4) & (x & 3 > 0) for x in told]
        event = np.where(right[1], 0, np.where(right[0], 1, 2))
        ends, span = m.ends[state].astype(np.int64), m.spans[m.row + s].astype(np.int64)
        end2, end1 = ends >> 16, ends & 0xFFFF
        rest = weight_total - end1
        start = np.where(event == 0, 0, np.where(event == 1, end2 << bits, (end1 << bits) + rest * (span >> 16))).astype(np.uint64)
        share = np.where(event == 0, end2 << bits, np.where(event == 1, (end1 - end2) << bits, rest * (span & 0xFFFF))).astype(np.uint64)
        m.learn(s, state, event)
        for t in range(b - a):
            unit = size >> m.shift
            moved = low + unit * start[t]
            wrapped = moved < low
            if wrapped.any():
                carry(put[wrapped] - 1)
            size = unit * share[t]
            words[put] = moved >> _32  # written over unless it is due
            due = size <= _FULL
            put += due
            due = due * _32
            low = moved << due
            size <<= due
    words[put] = low >> _32
    words[put + 1] = low & _FULL
    words, used = words.astype("<u4", copy=False).reshape(lanes, room), put - np.arange(lanes) * room
    gaps = np.concatenate([np.diff(a.astype(np.int64), prepend=0) for a in alphabets])
    packed, sizes = _pack(gaps)
    ends = np.concatenate(([0], np.cumsum(np.add.reduceat(sizes, np.cumsum(m.sizes) - m.sizes))))
    out = []
    for k in range(lanes):
        crc = zlib.crc32(ids[k * steps : (k + 1) * steps].tobytes())
        out.append(crc.to_bytes(4, "little") + int(ends[k + 1] - ends[k]).to_bytes(4, "little") + packed[ends[k] : ends[k + 1]].tobytes() + words[k, : used[k] + 2].tobytes())
    return out


def _pair(last: np.ndarray, before: np.ndarray) -> np.ndarray:
    return (last * 40503 + before * 60493 >> 5) & (_PAIRS - 1)


def _next(told: np.ndarray, bare: np.ndarray) -> np.ndarray:
    """The prediction after the id came: one surer if it was right, up to 3."""
    return bare + np.minimum(told & 3, 2) * ((told ^ bare) < 4) + np.uint16(1)


def decode_blocks(blocks: list[bytes], n: int, block: int = BLOCK) -> np.ndarray:
    """The ``n`` ids of coded blocks; an error if a checksum differs."""
    if not n:
        return np.zeros(0, np.uint32)
    lanes, steps = _shape(n, block)
    if lanes != len(blocks):
        raise ValueError("the number of blocks does not fit the number of ids")
    alphabets, parts = [], []
    for k, b in enumerate(blocks):
        stop = 8 + int.from_bytes(b[4:8], "little")
        gaps, _ = _unpack(np.frombuffer(b[8:stop], np.uint8))
        if not 0 < len(gaps) <= steps or (len(b) - stop) % 4:
            raise ValueError(f"block {k} is damaged")
        alphabets.append(np.cumsum(gaps))
        parts.append(b[stop:])
    m = _Mixture(np.array([len(a) for a in alphabets]))
    words = np.frombuffer(b"".join(parts) + bytes(8), "<u4").astype(np.uint64)
    at = np.concatenate(([0], np.cumsum([len(p) // 4 for p in parts])))[:-1]
    code = words[at] << _32 | words.take(at + 1, mode="clip")
    at = at + 2
    size = np.full(lanes, 0xFFFFFFFFFFFFFFFF, np.uint64)
    last, before = np.zeros(lanes, np.int64), np.zeros(lanes, np.int64)
    grid = np.zeros((steps, lanes), np.uint16)
    top, weight_total, bits = np.int64((1 << int(m.shift)) - 1), np.int64(1 << _WEIGHT_BITS), m.bits
    place, where = np.arange(lanes) << bits, np.empty(2 * lanes, np.int64)
    to1, to2, twice = where[:lanes], where[lanes:], np.empty(2 * lanes, np.uint16)
    for a, b in _epochs(steps):
        m.renew(True)
        state, right = np.empty((b - a, lanes), np.int64), np.empty((b - a, lanes), np.uint8)
        for t in range(b - a):
            np.add(last, m.row, out=to1)
            np.add(_pair(last, before), m.pairs, out=to2)
            told = m.told.take(where)
            one, two = told[:lanes], told[lanes:]
            now = state[t] = _states((one, two), m.own)
            unit = size >> m.shift
            value = np.minimum((code // unit).view(np.int64), top)
            ends = m.ends.take(now).astype(np.int64)
            end1 = ends & 0xFFFF
            begin, rest = end1 << bits, weight_total - end1
            # Exact: both are far below 2**53, and a quotient's distance from the next integer is above its rounding.
            slot = (np.maximum(value - begin, 0) / rest).astype(np.int64)
            s = m.at.take(slot + place)
            span = m.spans.take(m.row + s).astype(np.int64)
            start, share = begin + rest * (span >> 16), rest * (span & 0xFFFF)
            guessed = value < begin
            few = np.flatnonzero(guessed)  # where order 2 or 1 was right
            if len(few):
                mine, end2 = begin[few], (ends[few] >> 16) << bits
                first = value[few] < end2
                s[few] = np.where(first, two[few], one[few]) >> 2
                start[few] = np.where(first, 0, end2)
                share[few] = np.where(first, end2, mine - end2)
                guessed.view(np.uint8)[few] += first
            right[t] = guessed.view(np.uint8)
            code -= unit * start.view(np.uint64)
            size = unit * share.view(np.uint64)
            due = size <= _FULL
            coming = words.take(at, mode="clip")
            at += due
            coming *= due
            due = due * _32
            code = code << due | coming
            size <<= due
            twice[:lanes] = twice[lanes:] = s << np.uint16(2)
            m.told[where] = _next(told, twice)
            grid[a + t] = s
            before, last = last, s.astype(np.int64)
        m.learn(grid[a:b].astype(np.int64), state, 2 - right.astype(np.int64))
    symbols = np.ascontiguousarray(grid.T)
    ids = np.zeros(lanes * steps, "<u4")
    for k, each in enumerate(alphabets):
        own = ids[k * steps : (k + 1) * steps]
        own[:] = each[np.minimum(symbols[k], len(each) - 1)]
        if zlib.crc32(own[: n - k * steps].tobytes()) != int.from_bytes(blocks[k][:4], "little"):
            raise ValueError(f"block {k} is damaged")
    return ids[:n]


class LibraryEncoder:
    """The tokenizers library's encoding of whole texts; words that come again are looked up."""

    def __init__(self, spec: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        check_tokenizer(spec)
        self.tokenizer = Tokenizer.from_str(spec)
        self.tokenizer.no_padding()
        self.tokenizer.no_truncation()
        self.model, self.letters = self.tokenizer.model, {b: c for c, b in byte_letters().items()}
        added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.batches = TextEncoder(self.words, added, self.whole).batches

    def words(self, words: list[bytes]) -> list[list[int]]:
        """Ids of pre-split words, which are given to the library's model in its letters for bytes."""
        tokenize, letters = self.model.tokenize, self.letters
        return [[t.id for t in tokenize(w.decode("latin-1").translate(letters))] for w in words]

    def whole(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids


_encoders: dict[str, LibraryEncoder] = {}


def _encoder(shared) -> LibraryEncoder:
    name, spec = shared.value
    if name not in _encoders:
        _encoders.clear()
        _encoders[name] = LibraryEncoder(spec)
    return _encoders[name]


@dataclass(frozen=True)
class CodeConfig:
    #: Appended to each document.
    end_id: int = 2
    block: int = BLOCK
    segment: int = SEGMENT


SEGMENTS = "shard int, segment int, doc_ids array<long>, lengths array<long>, blocks array<binary>"
#: Bytes of stored input that make up a shard, about.
SHARD_BYTES = 32 << 20


def shards_for(docs: DataFrame) -> int:
    """As many as the optimizer's estimate of the input's size asks for, and at least the session's shuffle partitions."""
    size = int(str(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), min(-(-size // SHARD_BYTES), 1 << 20))


def appended(ids: np.ndarray, ends: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """``ids`` of texts with ``end_id`` after each text's, and the texts' lengths."""
    sizes = np.diff(ends)
    out = np.full(len(ids) + len(sizes), end_id, np.uint32)
    out[np.arange(len(ids)) + np.repeat(np.arange(len(sizes)), sizes)] = ids
    return out, sizes + 1


def write_ids(docs: DataFrame, tokenizer: str, path: str, config: CodeConfig = CodeConfig()) -> None:
    """Encodes all texts and writes the files to ``path``, ascending by document id from shard to shard."""
    spark = docs.sparkSession
    with open(tokenizer, encoding="utf-8") as f:
        spec = f.read()
    check_tokenizer(spec)
    shared = spark.sparkContext.broadcast((tokenizer, spec))  # as large as the vocabulary
    end, block, limit = config.end_id, config.block, config.segment
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    # What is sampled for the ranges, and goes to the driver, is ids and hashes alone.
    keyed = rows.withColumn("h", F.xxhash64("text"))
    ordered = keyed.repartitionByRange(shards_for(docs), "doc_id", "h").sortWithinPartitions("doc_id", "h", "text").select("doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, shard, segment = _encoder(shared), TaskContext.get().partitionId(), 0
        names: list[pa.Array] = []
        parts: list[np.ndarray] = []
        lengths: list[np.ndarray] = []
        held = 0

        def close() -> pa.RecordBatch:
            blocks = encode_blocks(np.concatenate(parts), block)
            row = [[shard], [segment], [pa.concat_arrays(names).to_pylist()], [np.concatenate(lengths).tolist()], [blocks]]
            kinds = [pa.int32(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.binary())]
            return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(row, kinds, strict=True)], names=["shard", "segment", "doc_ids", "lengths", "blocks"])

        for b in batches:
            for row, chunk, ids, ends in encoder.batches(b.column(1)):
                coded, sizes = appended(ids, ends, end)
                names.append(b.column(0).slice(row, chunk.n))
                parts.append(coded)
                lengths.append(sizes)
                held += len(coded)
                if held >= limit:
                    yield close()
                    names, parts, lengths, held, segment = [], [], [], 0, segment + 1
        if parts:
            yield close()

    ordered.mapInArrow(run, SEGMENTS).write.mode("overwrite").parquet(path)


def _documents(files: DataFrame, kind: str, values, config: CodeConfig) -> DataFrame:
    """``(shard, segment, row, doc_id, ...)`` of segments, whose last columns (of the types ``kind``) are ``values`` of some documents' ids."""
    block = config.block

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                shard, segment, names, lengths, blocks = (b.column(k)[i].as_py() for k in range(5))
                raw = decode_blocks(blocks, sum(lengths), block).tobytes()
                ends = (np.concatenate(([0], np.cumsum(lengths))) * 4).tolist()
                for at in range(0, len(names), 1000):
                    some = range(at, min(at + 1000, len(names)))
                    own = values([raw[ends[j] : ends[j + 1]] for j in some])
                    columns = [pa.array([shard] * len(some), pa.int32()), pa.array([segment] * len(some), pa.int32()), pa.array(list(some), pa.int32()), pa.array(names[at : at + 1000], pa.int64()), *own.values()]
                    yield pa.RecordBatch.from_arrays(columns, names=["shard", "segment", "row", "doc_id", *own])

    return files.mapInArrow(run, f"shard int, segment int, row int, doc_id long, {kind}")


def read_segments(spark: SparkSession, path: str, config: CodeConfig = CodeConfig()) -> DataFrame:
    """``(shard, segment, row, doc_id, ids)`` from the files, ids as little-endian unsigned 32-bit integers."""
    return _documents(spark.read.schema(SEGMENTS).parquet(path), "ids binary", lambda ids: {"ids": pa.array(ids, pa.binary())}, config)


def read_sums(spark: SparkSession, path: str, config: CodeConfig = CodeConfig()) -> DataFrame:
    """``(shard, segment, row, doc_id, n_tokens, ids_crc32)`` from the files: what is left of the ids that they hold."""
    sums = lambda ids: {"n_tokens": pa.array([len(x) // 4 for x in ids], pa.int64()), "ids_crc32": pa.array([zlib.crc32(x) for x in ids], pa.int64())}
    return _documents(spark.read.schema(SEGMENTS).parquet(path), "n_tokens long, ids_crc32 long", sums, config)


def document_starts(spark: SparkSession, path: str) -> DataFrame:
    """``(shard, segment, base)``: how many ids the files hold before each segment. Lengths alone are read."""
    from pyspark.sql.window import Window

    lengths = F.aggregate("lengths", F.lit(0).cast("long"), lambda a, x: a + x)
    sums = spark.read.schema(SEGMENTS).parquet(path).select("shard", "segment", lengths.alias("n"))
    # A row for each segment of millions of ids, then one for each shard.
    inside = sums.withColumn("inside", F.coalesce(F.sum("n").over(Window.partitionBy("shard").orderBy("segment").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    shards = sums.groupBy("shard").agg(F.sum("n").alias("total"))
    before = shards.select("shard", F.coalesce(F.sum("total").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("outside"))
    return inside.join(before, "shard").select("shard", "segment", (F.col("inside") + F.col("outside")).alias("base"))


def digests(spark: SparkSession, path: str, config: CodeConfig = CodeConfig()) -> DataFrame:
    """The contract's columns, from the files."""
    from pyspark.sql.window import Window

    found = read_sums(spark, path, config)
    ahead = Window.partitionBy("shard", "segment").orderBy("row").rowsBetween(Window.unboundedPreceding, -1)
    placed = found.withColumn("inside", F.coalesce(F.sum("n_tokens").over(ahead), F.lit(0)))
    return placed.join(document_starts(spark, path), ["shard", "segment"]).select("doc_id", (F.col("base") + F.col("inside")).alias("start"), "n_tokens", "ids_crc32")


def round_trip(docs: DataFrame, tokenizer: str, config: CodeConfig = CodeConfig()) -> DataFrame:
    """Writes ``docs`` to files and returns the digests of what the files hold."""
    spark = docs.sparkSession
    path = f"{Scratch(spark).root}/ids"
    write_ids(docs, tokenizer, path, config)
    return digests(spark, path, config)
