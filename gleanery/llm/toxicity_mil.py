"""Toxicity by multiple-instance learning.

A document is a bag of sentences.  A sentence's score is a logistic function
of its words; the document's is their noisy-or, ``1 - prod(1 - s)``: one
offending sentence suffices.  Only documents have labels, so the loss is the
documents' likelihood, and its gradient tells the sentences apart: those that
explain toxic documents and occur in no clean one.  After training, the
sentence scores locate what offends.

What a sentence without evidence scores, the bias alone, is a chance of the
training texts' lengths and would flag any text of some thousand sentences.
Scoring therefore divides it out of each factor, so that such a sentence
counts as 0, and of all sentences of a text below ``weak`` only the highest
enters the noisy-or: no number of them makes a text toxic.

Features are hashed: each word without the punctuation around it, ASCII
letters lower-cased, and its first four and five bytes.  Labels, language,
source and ids are never features.  Training reads a bounded sample of
labelled rows outside the held-out fold (:class:`ToxicityConfig` states the
bounds), chosen by a hash of the id, and weighs both classes as the labels
have them.  A text in the sample is read whole, however long.  Scoring reads
every whole text.

Edge cases: a null or empty text has no sentence and scores the noisy-or of
none, 0.  Rows that repeat score alike, and a null id is never held out and
never trained on.  If the labels outside the held-out fold hold one class only,
nothing tells texts apart, and every score is the smoothed share of toxic ones,
``toxic / (labels + 1)``: 0 without labels or toxic ones.  An id with differing labels counts as toxic.  Other
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textkernel import _LEAD, Chunk, chunks


@dataclass(frozen=True)
class ToxicityConfig:
    #: Cells of the hashed weights: what is broadcast is as many floats.
    cells: int = 1 << 18
    #: The most labelled rows of each class that training reads.
    toxic_rows: int = 2500
    clean_rows: int = 3500
    #: Training takes whole texts of each class until they have so many words; the last may pass it.
    toxic_words: int = 1_500_000
    clean_words: int = 2_000_000
    #: A feature counts if so many training texts have it.
    least_texts: int = 2
    steps: int = 250
    rate: float = 0.1
    #: What a feature's weight costs, in toxic texts: one that explains less than so many stays 0.
    cost: float = 1.0
    #: Log-odds of a sentence without features that count, before training.
    bias: float = -4.0
    #: Of a text's sentences below this score, only the highest counts.
    weak: float = 0.05
    #: Sentences with at least this score are located.
    locate: float = 0.5


_EDGE = np.zeros(256, bool)
_EDGE[list(b"""!"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~""")] = True
_STOP = np.zeros(256, bool)
_STOP[list(b".!?")] = True


def _bare(chunk: Chunk) -> tuple[np.ndarray, np.ndarray]:
    """Word spans without the punctuation around them (a word of nothing else stays whole)."""
    starts, ends = (x.copy() for x in chunk.spans)
    for _ in range(4):
        ends -= (ends - starts > 1) & _EDGE[chunk.data[ends - 1]]
        starts += (ends - starts > 1) & _EDGE[chunk.data[np.minimum(starts, len(chunk.data) - 1)]]
    return starts, ends


def sentences(chunk: Chunk) -> tuple[np.ndarray, np.ndarray]:
    """Each sentence's first word, and each word's sentence.

    A sentence ends with a word that ends in ``.``, ``!`` or ``?``, before a
    line break, and with the text.
    """
    starts, ends = chunk.spans
    last = _STOP[chunk.data[ends - 1]]
    breaks = np.concatenate(([0], np.cumsum(chunk.data == 10)))
    last[:-1] |= breaks[starts[1:]] > breaks[ends[:-1]]
    begins = np.ones(len(starts), bool)
    begins[1:] = last[:-1]
    begins[chunk.first[:-1][chunk.counts > 0]] = True
    return np.flatnonzero(begins), np.cumsum(begins) - 1


def features(chunk: Chunk, cells: int) -> np.ndarray:
    """Three cells for each word."""
    starts, ends = _bare(chunk)
    parts = [chunk.hash_spans(starts, ends)] + [chunk.hash_spans(starts, np.minimum(starts + k, ends)) ^ np.uint64(k << 40) for k in (4, 5)]
    return (np.stack(parts, axis=1) % np.uint64(cells)).astype(np.int32)


@dataclass
class Bags:
    """Training texts: ``cells`` of all words, three each, with their sentences, and sentences with their texts."""

    cells: np.ndarray
    sentence: np.ndarray
    text: np.ndarray
    toxic: np.ndarray
    weight: np.ndarray


#: Features whose products are held at once in training.
BLOCK = 1 << 20


def softplus(z: np.ndarray) -> np.ndarray:
    return np.logaddexp(0.0, z)


def train(bags: Bags, config: ToxicityConfig) -> np.ndarray:
    """Weights of all cells, and the bias last; full-batch Adam, the same for the same bags."""
    n, m = len(bags.toxic), len(bags.text)
    owner = bags.text[bags.sentence]
    texts, cut = np.zeros(config.cells, np.int64), np.searchsorted(owner, np.arange(n + 1))
    for a, b in zip(cut[:-1], cut[1:], strict=True):
        texts[np.unique(bags.cells[a:b])] += 1
    counts = np.flatnonzero(texts >= config.least_texts)
    place = np.full(config.cells, len(counts), np.int32)
    place[counts] = np.arange(len(counts))
    at, of = place[bags.cells.reshape(-1)], np.repeat(bags.sentence.astype(np.int32), 3)
    there = at < len(counts)
    at, of = at[there], of[there]
    del owner, there
    blocks = [slice(a, a + BLOCK) for a in range(0, len(at), BLOCK)]
    w, first, second = np.zeros(len(counts) + 1), np.zeros(len(counts) + 1), np.zeros(len(counts) + 1)
    w[-1] = config.bias
    share = bags.weight / bags.weight.sum()
    cost = config.cost * share[bags.toxic].mean()
    for step in range(1, config.steps + 1):
        z = np.full(m, w[-1])
        for b in blocks:
            z += np.bincount(of[b], w[at[b]], minlength=m)
        soft = softplus(z)
        total = np.bincount(bags.text, soft, minlength=n)
        # d loss / d z: towards 0 for clean texts, towards explaining toxic ones.
        pull = np.where(bags.toxic, -1.0 / np.maximum(np.expm1(np.minimum(total, 500.0)), 1e-9), 1.0) * share
        dz = pull[bags.text] * np.exp(z - soft)
        grad = np.append(np.zeros(len(counts)), dz.sum())
        for b in blocks:
            grad[:-1] += np.bincount(at[b], dz[of[b]], minlength=len(counts))
        rest = np.sign(grad[:-1]) * np.maximum(np.abs(grad[:-1]) - cost, 0)
        grad[:-1] = np.where(w[:-1] == 0, rest, grad[:-1] + cost * np.sign(w[:-1]))
        before = w.copy()
        first += 0.1 * (grad - first)
        second += 0.001 * (grad * grad - second)
        w -= config.rate * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-9)
        w[:-1][before[:-1] * w[:-1] < 0] = 0
    out = np.zeros(config.cells + 1)
    out[counts], out[-1] = w[:-1], w[-1]
    return out


def fold(doc_id) -> F.Column:
    """0 for the held-out fifth of the ids."""
    return F.crc32(F.col(doc_id).cast("string")) % 5


def training_sample(labels: DataFrame, config: ToxicityConfig) -> tuple[DataFrame, dict[bool, int]]:
    """At most ``toxic_rows + clean_rows`` ids with their labels, and how many of each class there are."""
    each = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & (fold("doc_id") != 0)).groupBy("doc_id").agg((F.max("toxic") > 0).alias("toxic"))
    totals = {r.toxic: r["count"] for r in each.groupBy("toxic").count().collect()}
    pick = lambda toxic, n: each.where(F.col("toxic") == toxic).orderBy(F.xxhash64("doc_id"), "doc_id").limit(n)
    return pick(True, config.toxic_rows).union(pick(False, config.clean_rows)), totals


def within_words(docs: DataFrame, sample: DataFrame, config: ToxicityConfig) -> DataFrame:
    """The sample's ids in its order, of each class until their texts have the words that the bounds allow."""
    n_words = F.size(F.split(F.coalesce("text", F.lit("")), r"[ \t-\r]+")).cast("long")
    sizes = docs.select("doc_id", n_words.alias("n")).join(F.broadcast(sample), "doc_id").groupBy("doc_id", "toxic").agg(F.sum("n").alias("n"))
    left, taken = {True: config.toxic_words, False: config.clean_words}, []
    for r in sizes.orderBy(F.xxhash64("doc_id"), "doc_id").collect():  # at most as many rows as the sample
        if left[r.toxic] > 0:
            left[r.toxic] -= r.n
            taken.append((r.doc_id, r.toxic))
    return docs.sparkSession.createDataFrame(taken, sample.schema)


def gather(docs: DataFrame, sample: DataFrame, totals: dict[bool, int], config: ToxicityConfig) -> Bags | None:
    """The training sample's features, on the driver; none if a class is missing."""
    if len(totals) < 2:
        return None
    cells = config.cells

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row, chunk in chunks(b.column(0), lower=True):
                codes, (begins, of) = features(chunk, cells), sentences(chunk)
                out = []
                for i in np.flatnonzero(chunk.counts > 0):
                    lo, hi = chunk.first[i], chunk.first[i + 1]
                    out.append((int(row + i), codes[lo:hi].tobytes(), (of[lo:hi] - of[lo]).astype(np.int32).tobytes()))
                if out:
                    at, x, y = zip(*out, strict=True)
                    yield pa.RecordBatch.from_arrays([b.column(1).take(pa.array(at)), pa.array(x, pa.binary()), pa.array(y, pa.binary())], names=["toxic", "cells", "sentence"])

    chosen = docs.select("doc_id", "text").join(F.broadcast(within_words(docs, sample, config)), "doc_id").select("text", "toxic")  # as many rows as the bounds allow
    rows = chosen.mapInArrow(run, "toxic boolean, cells binary, sentence binary").collect()
    toxic = np.array([r.toxic for r in rows], bool)
    if not toxic.any() or toxic.all():
        return None
    parts = [np.frombuffer(r.sentence, np.int32) for r in rows]
    sizes = np.array([p[-1] + 1 for p in parts])
    base = np.concatenate(([0], np.cumsum(sizes)[:-1]))
    weight = np.where(toxic, totals[True] / toxic.sum(), totals[False] / (~toxic).sum())
    return Bags(
        np.concatenate([np.frombuffer(r.cells, np.int32).reshape(-1, 3) for r in rows]),
        np.concatenate([p.astype(np.int64) + b for p, b in zip(parts, base, strict=True)]),
        np.repeat(np.arange(len(rows)), sizes),
        toxic,
        weight,
    )


def _chars(chunk: Chunk, at: np.ndarray, text: np.ndarray) -> np.ndarray:
    """Byte places as code points of their texts."""
    points = np.concatenate(([0], np.cumsum(_LEAD[chunk.data])))
    return points[at] - points[chunk.offsets[text]]


def noisy_or(z: np.ndarray, bias: float, text: np.ndarray, n: int, weak: float) -> np.ndarray:
    """Each text's score: its sentences' excess over ``bias``, and the highest alone of those below ``weak``."""
    excess = np.maximum(softplus(z) - softplus(bias), 0.0)
    strong = excess >= -np.log1p(-weak)
    most = np.zeros(n)
    np.maximum.at(most, text[~strong], excess[~strong])
    return -np.expm1(-(np.bincount(text[strong], excess[strong], minlength=n) + most))


def score_texts(docs: DataFrame, weights: np.ndarray | None, config: ToxicityConfig, prior: float = 0.0) -> DataFrame:
    """``doc_id, score, offending``: the latter as (start, end, score) of sentences, in code points; ``prior`` is the score without weights."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(None if weights is None else weights.astype(np.float32))  # one float a cell
    cells, locate, weak = config.cells, config.locate, config.weak
    span = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = shared.value
        for b in batches:
            for row, chunk in chunks(b.column(1), lower=True):
                n = chunk.n
                score, found = np.full(n, 0.0 if w is not None else prior), np.zeros(n, np.int64)
                starts = ends = np.zeros(0, np.int64)
                scores = np.zeros(0)
                if w is not None and len(chunk.spans[0]):
                    begins, of = sentences(chunk)
                    z = np.bincount(of, w[features(chunk, cells)].sum(axis=1), minlength=len(begins)) + float(w[-1])
                    text = np.searchsorted(chunk.first, begins, "right") - 1
                    score = noisy_or(z, float(w[-1]), text, n, weak)
                    s = np.exp(z - softplus(z))
                    bad = np.flatnonzero(s >= locate)
                    final = np.append(begins[1:], len(of)) - 1
                    starts, ends = _chars(chunk, chunk.spans[0][begins[bad]], text[bad]), _chars(chunk, chunk.spans[1][final[bad]], text[bad])
                    scores, found = s[bad], np.bincount(text[bad], minlength=n)
                spans = pa.StructArray.from_arrays([pa.array(starts, pa.int64()), pa.array(ends, pa.int64()), pa.array(scores, pa.float64())], fields=list(span))
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(found))).astype(np.int32)), spans)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(row, n), pa.array(score, pa.float64()), lists], names=["doc_id", "score", "offending"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, score double, offending array<struct<start:long,end:long,score:double>>")


def toxicity(docs: DataFrame, labels: DataFrame, config: ToxicityConfig = ToxicityConfig()) -> DataFrame:
    """``doc_id, held_out, score, predicted, offending``, one row for each row of ``docs``."""
    sample, totals = training_sample(labels, config)
    bags = gather(docs, sample, totals, config)
    prior = totals.get(True, 0) / (sum(totals.values()) + 1)
    scored = score_texts(docs, None if bags is None else train(bags, config), config, prior if len(totals) < 2 else 0.0)
    return scored.select("doc_id", F.coalesce(fold("doc_id") == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "offending")
