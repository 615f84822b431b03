"""BPE encoding and decoding by a tokenization automaton.

The automaton reads and writes token arcs.  It starts as one state with a loop
for every byte, whose paths spell every byte string.  The merges then act on
it one after another, each by one gadget: for the merge of ``u`` and ``v``
into ``w``, the state ``t`` that the arcs of ``u`` lead to gets a copy without
its ``v`` arc, the ``u`` arcs move over to that copy, and beside every ``u``
arc a ``w`` arc is laid that leads to where ``t``'s ``v`` arc led.  After the
last merge exactly one path spells each byte string, and its arcs are the
tokens that merging gives.

All arcs of one token lead to one state throughout, and a copy differs from
its source by the one arc that it lacks.  So a state is stored as the token
whose arcs lead to it, and the table holds, for (token, lacking arc), the
merge at which the arc went.  Two things are read off the table: a copy has
its source's lacking arcs up to the merge that made it (the source belongs to
the token's right part), and arcs that a merge laid beside an arc before that
arc went remain (the arc beside which ``w`` was laid is its left part).  Where
``u`` is ``v``, the copy has lost the very arc beside which ``w`` would lie.

Encoding follows the one path through a pre-split word, longer arcs first.
Since each prefix has one path, no position is left twice, and a word takes
time linear in its length.  Decoding emits the arcs' labels.

Edge cases: null and empty texts have no ids and decode to the empty text.
Text equal to an added token's content becomes that token's id, as in the
library.  Repeated rows are encoded alike.  Very long texts and words need
memory in proportion to one text.  Unpaired surrogates cannot occur in Spark
strings.  Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .presplit import SPLIT, TextEncoder, check_tokenizer

END = 1 << 60
#: Answers about arcs that a worker remembers at once.
REMEMBERED_ARCS = 1_000_000


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte: itself if it prints, else one from 256 on."""
    prints = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(prints)]
    return {chr(b): b for b in prints} | {chr(256 + k): b for k, b in enumerate(rest)}


@dataclass
class Automaton:
    labels: list[bytes]
    added: dict[str, int]
    #: For each token: its parts and the merge that laid its arcs (-1: from the start).
    left: list[int]
    right: list[int]
    since: list[int]
    #: token * 2**20 + arc -> the merge at which the state behind the token lost the arc.
    lacks: dict[int, int]
    trie: dict[int, int] = field(default_factory=dict)
    accepts: list[int] = field(default_factory=list)
    #: For each token: the longest other token that it starts with (-1: none), and its bytes.
    shorter: list[int] = field(default_factory=list)
    sizes: list[int] = field(default_factory=list)
    #: Merges whose arc was gone already.
    idle: int = 0

    def has_arc(self, state: int, arc: int) -> bool:
        left, right, since, lacks = self.left, self.right, self.since, self.lacks
        copied = END
        while state >= 0:
            part, laid = arc, END
            while part >= 0:
                gone = lacks.get(state << 20 | part)
                if gone is not None and gone < copied and gone <= laid:
                    return False
                laid = since[part]
                part = left[part]
            copied = since[state]
            state = right[state]
        return True

    def word(self, text: bytes, arcs: dict[int, bool]) -> list[int]:
        """The tokens of the one path that spells ``text``.

        Longer arcs are tried first.  No position has two paths, so one from
        which the end cannot be reached is never entered again.
        """
        n, trie, accepts, shorter, sizes = len(text), self.trie, self.accepts, self.shorter, self.sizes
        out: list[int] = []
        closed: set[int] = set()
        at, state = 0, -1
        while at < n:
            arc, node = -1, 0
            for j in range(at, n):
                node = trie.get(node << 8 | text[j])
                if node is None:
                    break
                if accepts[node] >= 0:
                    arc = accepts[node]
            while True:
                if arc < 0:  # nothing leads on from here: step back
                    closed.add(at)
                    arc = out.pop()
                    at -= sizes[arc]
                    state = out[-1] if out else -1
                    arc = shorter[arc]
                    continue
                if at + sizes[arc] not in closed:
                    if state < 0:
                        break
                    key = state << 20 | arc
                    there = arcs.get(key)
                    if there is None:
                        there = arcs[key] = self.has_arc(state, arc)
                    if there:
                        break
                arc = shorter[arc]
            out.append(arc)
            at += sizes[arc]
            state = arc
        return out


def compile_merges(tokenizer_json: str) -> Automaton:
    """The automaton of a byte-level BPE tokenizer file's contents."""
    spec = check_tokenizer(tokenizer_json)
    model, letters = spec["model"], byte_letters()
    vocab: dict[str, int] = model["vocab"]
    size = 1 + max([*vocab.values(), *(a["id"] for a in spec["added_tokens"])])
    labels = [b""] * size
    for text, i in vocab.items():
        labels[i] = bytes(letters[c] for c in text)
    added = {a["content"]: a["id"] for a in spec["added_tokens"]}
    for text, i in added.items():
        labels[i] = text.encode()
    a = Automaton(labels, added, [-1] * size, [-1] * size, [-1] * size, {})
    live = {vocab[c] for c in letters if c in vocab}
    for step, pair in enumerate(model["merges"]):
        u, v = (vocab[x] for x in (pair.split(" ") if isinstance(pair, str) else pair))
        w = vocab["".join(pair.split(" ") if isinstance(pair, str) else pair)]
        if u not in live or v not in live or w in live or not a.has_arc(u, v):
            a.idle += 1
            continue
        a.lacks[u << 20 | v] = step
        a.left[w], a.right[w], a.since[w] = u, v, step
        live.add(w)
    a.accepts.append(-1)
    for i in sorted(live):
        node = 0
        for b in labels[i]:
            nxt = a.trie.get(node << 8 | b)
            if nxt is None:
                nxt = a.trie[node << 8 | b] = len(a.accepts)
                a.accepts.append(-1)
            node = nxt
        a.accepts[node] = i
    a.sizes = [len(x) for x in labels]
    a.shorter = [-1] * size
    for i in live:
        node = 0
        for b in labels[i][:-1]:
            node = a.trie[node << 8 | b]
            if a.accepts[node] >= 0:
                a.shorter[i] = a.accepts[node]
    return a


class Codec:
    """Encodes and decodes with one automaton; keep one a worker."""

    def __init__(self, automaton: Automaton):
        self.automaton, self.arcs = automaton, {}
        self.special = regex.compile("(" + "|".join(map(regex.escape, sorted(automaton.added, key=len, reverse=True))) + ")") if automaton.added else None
        self.find = regex.compile(SPLIT).findall
        self.batches = TextEncoder(self.words, list(automaton.added), self.encode).batches
        sizes = np.array(automaton.sizes, np.int64)
        #: All labels' bytes, where each one's begin, and how many they are.
        self.letters, self.sizes = np.frombuffer(b"".join(automaton.labels), np.uint8), sizes
        self.begins = np.cumsum(sizes) - sizes

    def words(self, words: list[bytes]) -> list[list[int]]:
        if len(self.arcs) > REMEMBERED_ARCS:
            self.arcs.clear()
        word, arcs = self.automaton.word, self.arcs
        return [word(w, arcs) for w in words]

    def encode(self, text: str) -> list[int]:
        """The ids of one text."""
        out: list[int] = []
        for k, part in enumerate(self.special.split(text) if self.special else [text]):
            out += [self.automaton.added[part]] if k % 2 else [i for ids in self.words([w.encode() for w in self.find(part)]) for i in ids]
        return out

    def spell(self, ids: np.ndarray) -> np.ndarray:
        """The bytes of the ids' labels, one after the other."""
        sizes = self.sizes[ids]
        ends = np.cumsum(sizes)
        return self.letters[np.repeat(self.begins[ids] - ends + sizes, sizes) + np.arange(ends[-1])] if len(ids) else self.letters[:0]

    def decode(self, ids) -> str:
        return self.spell(np.asarray(ids, np.int64)).tobytes().decode("utf-8", "replace")


_codecs: dict[str, Codec] = {}


def codec_for(shared) -> Codec:
    """This worker's codec for a broadcast ``(name, automaton)``."""
    name, automaton = shared.value
    if name not in _codecs:
        _codecs.clear()
        _codecs[name] = Codec(automaton)
    return _codecs[name]


def share(spark: SparkSession, path: str):
    """Broadcasts the automaton; its size is the vocabulary's, not the data's."""
    with open(path, encoding="utf-8") as f:
        return spark.sparkContext.broadcast((path, compile_merges(f.read())))


def encode_texts(docs: DataFrame, path: str, decode: bool = True) -> DataFrame:
    """``doc_id``, ``ids`` (array of int) and, if asked for, ``decoded``: the text that the ids spell."""
    shared = share(docs.sparkSession, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = codec_for(shared)
        for b in batches:
            for row, chunk, ids, ends in codec.batches(b.column(1)):
                columns, names = [b.column(0).slice(row, chunk.n), pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(ids.astype(np.int32)))], ["doc_id", "ids"]
                if decode:
                    spelt = codec.spell(ids.astype(np.int64))
                    places = np.concatenate(([0], np.cumsum(codec.sizes[ids])))[ends].astype(np.int32)
                    texts = pa.Array.from_buffers(pa.binary(), chunk.n, [None, pa.py_buffer(places), pa.py_buffer(spelt.tobytes())])
                    columns.append(pa.array([t.decode("utf-8", "replace") for t in texts.to_pylist()], pa.string()))
                    names.append("decoded")
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, ids array<int>" + ", decoded string" * decode)


def encoded_lengths(docs: DataFrame, path: str) -> DataFrame:
    """``doc_id`` and ``n_tokens``, the length of each text's encoding."""
    shared = share(docs.sparkSession, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = codec_for(shared)
        for b in batches:
            for row, chunk, _, ends in codec.batches(b.column(1)):
                yield pa.RecordBatch.from_arrays([b.column(0).slice(row, chunk.n), pa.array(np.diff(ends), pa.int64())], names=["doc_id", "n_tokens"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_tokens long")


def digests(encoded: DataFrame) -> DataFrame:
    """The contract's columns, from ids and decoded texts."""
    return encoded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
