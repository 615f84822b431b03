"""Quality rules: hashed n-gram log-likelihood ratio.

Word unigrams and bigrams (ASCII letters lower-cased) are hashed into
``buckets`` cells.  One multinomial over the cells is counted from the trusted
target (the labelled rows of good quality), one from the whole raw corpus.  A
document's score is the mean, over its n-grams, of
``log p_target(cell) - log p_raw(cell)``: length does not move it.  The target
is smoothed towards the raw multinomial, so that cells it has never seen count
less in a small corpus.

A document is kept if no base rule fails and its score is at least a threshold
that the trusted documents set: the score that all but a hundredth of them
reach, each scored as if it were not in the target itself.  So the threshold
follows the corpus's size and the cells, and the same corpus always gives the
same one.

Edge cases: a null or empty text has no words, fails the base rules, scores 0
and is not kept.  Repeated rows are scored alike, one result row each.  Rows
with a null id are scored too, and never belong to the target.  With no trusted
document, both multinomials are equal, every score is 0, and only the base
rules decide.  Extra columns of any name are ignored by :func:`quality_rules`
and passed through by :func:`keep_good`.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._shared import BROADCAST_IDS, Scratch, append_struct, fresh
from .textkernel import Chunk, chunks, mix64


@dataclass(frozen=True)
class QualityConfig:
    #: Cells of the hashed multinomials; the counts that reach the driver are as many rows.
    buckets: int = 8192
    #: Pseudo-counts a cell, dealt in proportion to the raw corpus.
    prior: float = 4.0
    #: Share of the trusted documents (those that pass the base rules) whose scores are below the threshold.
    refused: float = 0.01
    min_words: int = 50
    #: Largest share, in per cent, of words in repeated three-word windows.
    max_repeat_percent: int = 50


FIELDS = T.StructType(
    [T.StructField(n, T.LongType()) for n in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]
    + [T.StructField("llr", T.DoubleType()), T.StructField("base_failed", T.BooleanType()), T.StructField("kept", T.BooleanType())]
)
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True


def _cells(chunk: Chunk, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """The n-grams' cells and the text each one belongs to."""
    h = chunk.hashes
    owner = np.repeat(np.arange(chunk.n), chunk.counts)
    pair = owner[:-1] == owner[1:]
    two = mix64(h[:-1] * np.uint64(0xD6E8FEB86659FD93) + h[1:], 2)[pair]
    cells = np.concatenate([mix64(h, 1), two]) % np.uint64(buckets)
    return cells.astype(np.int64), np.concatenate([owner, owner[:-1][pair]])


def marked(docs: DataFrame, labels: DataFrame, scratch: Scratch) -> DataFrame:
    """``(text, trusted)`` of all documents.

    The trusted ids are counted first: few are broadcast, more are hashed and
    shuffled with the texts, where null ids are spread by their texts.
    """
    ids = scratch.put(labels.where("quality = 1 and doc_id is not null").select(F.col("doc_id").alias("_good")).distinct(), "trusted").withColumn("_salt0", F.lit(0).cast("long"))
    few = ids.count() <= BROADCAST_IDS
    salt = F.when(F.col("doc_id").isNull(), F.xxhash64("text")).otherwise(0).alias("_salt")
    rows = docs.select("doc_id", "text", salt)
    told = rows.join(F.broadcast(ids) if few else ids.hint("shuffle_hash"), (F.col("doc_id") == F.col("_good")) & (F.col("_salt") == F.col("_salt0")), "left")
    return told.select("text", F.col("_good").isNotNull().alias("trusted"))


def ngram_counts(texts: DataFrame, config: QualityConfig) -> DataFrame:
    """``(cell, raw, target)`` from ``(text, trusted)``: n-grams of all documents, and of the trusted ones."""
    buckets = config.buckets

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw, target = np.zeros(buckets, np.int64), np.zeros(buckets, np.int64)
        for b in batches:
            trusted = b.column(1).to_numpy(zero_copy_only=False).astype(bool)
            for row, chunk in chunks(b.column(0), lower=True):
                cells, owner = _cells(chunk, buckets)
                raw += np.bincount(cells, minlength=buckets)
                target += np.bincount(cells[trusted[row + owner]], minlength=buckets)
        seen = np.flatnonzero(raw)
        yield pa.RecordBatch.from_arrays([pa.array(seen, pa.int64()), pa.array(raw[seen]), pa.array(target[seen])], names=["cell", "raw", "target"])

    return texts.mapInArrow(run, "cell long, raw long, target long").groupBy("cell").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target"))


@dataclass
class Model:
    """Smoothed counts of the cells, and the threshold on scores."""

    p_raw: np.ndarray
    #: The target's counts and its pseudo-counts together.
    target: np.ndarray
    total: float
    threshold: float = -np.inf

    @property
    def weights(self) -> np.ndarray:
        """``log p_target - log p_raw`` of each cell."""
        return np.log(self.target / self.total) - np.log(self.p_raw)

    def without_own(self, cells: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
        """Scores of ``n`` trusted texts, each against the target without it."""
        size = len(self.p_raw)
        _, back, times = np.unique(owner * size + cells, return_inverse=True, return_counts=True)
        grams = np.bincount(owner, minlength=n)
        ratio = np.log((self.target[cells] - times[back]) / (self.total - grams[owner])) - np.log(self.p_raw[cells])
        return np.bincount(owner, ratio, minlength=n) / np.maximum(grams, 1)


def smoothed(raw: np.ndarray, target: np.ndarray, config: QualityConfig) -> Model:
    p_raw = (raw + 1.0) / (raw.sum() + len(raw))
    mass = config.prior * len(raw)
    return Model(p_raw, target + mass * p_raw, target.sum() + mass)


#: Scores are counted in thousandths for the threshold.
STEPS = 1000


def trusted_scores(texts: DataFrame, model: Model, config: QualityConfig) -> DataFrame:
    """``(step, n)``: how many trusted documents that pass the base rules score so many thousandths, without their own counts."""
    shared = texts.sparkSession.sparkContext.broadcast(model)  # a few doubles a cell

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in batches:
            found = []
            for _, chunk in chunks(b.column(0), lower=True):
                cells, owner = _cells(chunk, config.buckets)
                score = m.without_own(cells, owner, chunk.n)
                found.append(np.floor(score[~base_failed(chunk, _repeats(chunk), config)] * STEPS).astype(np.int64))
            steps, n = np.unique(np.concatenate(found), return_counts=True) if found else (np.zeros(0, np.int64),) * 2
            yield pa.RecordBatch.from_arrays([pa.array(steps, pa.int64()), pa.array(n, pa.int64())], names=["step", "n"])

    return texts.where("trusted").select("text").mapInArrow(run, "step long, n long").groupBy("step").agg(F.sum("n").alias("n"))


def fit(docs: DataFrame, labels: DataFrame, config: QualityConfig) -> Model:
    scratch = Scratch(docs.sparkSession)
    texts = marked(docs, labels, scratch)
    raw, target = np.zeros(config.buckets), np.zeros(config.buckets)
    for r in ngram_counts(texts, config).collect():  # at most one row a cell
        raw[r.cell], target[r.cell] = r.raw, r.target
    model = smoothed(raw, target, config)
    if target.any():
        counts = sorted((r.step, r.n) for r in trusted_scores(texts, model, config).collect())  # as many as scores have thousandths
        upto = np.cumsum([n for _, n in counts])
        if len(upto):
            model.threshold = counts[int(np.searchsorted(upto, config.refused * upto[-1], "right"))][0] / STEPS
    return model


def _duplicate_lines(text: bytes) -> int:
    lines = text.split(b"\n")
    if len(set(lines)) == len(lines):
        return 0
    return sum(n - 1 for line, n in Counter(lines).items() if n > 1 and line.strip())


def _repeated_words(text: bytes) -> int:
    """Words inside three-word windows that the text has twice or more."""
    words = text.split()
    windows = list(zip(words, words[1:], words[2:], strict=False))
    count = Counter(windows)
    inside = np.zeros(len(words), bool)
    for i, w in enumerate(windows):
        if count[w] > 1:
            inside[i : i + 3] = True
    return int(inside.sum())


def _repeats(chunk: Chunk) -> np.ndarray:
    """Words in repeated windows, for each text."""
    out = np.zeros(chunk.n, np.int64)
    windows, of = chunk.shingles(3)
    order = np.lexsort((windows, of))
    windows, of = windows[order], of[order]
    again = (windows[1:] == windows[:-1]) & (of[1:] == of[:-1])
    # Windows differ wherever their hashes do; texts with equal ones are looked at word by word.
    for i in np.unique(of[1:][again]):
        out[i] = _repeated_words(chunk.text(i))
    return out


def base_failed(chunk: Chunk, repeats: np.ndarray, config: QualityConfig) -> np.ndarray:
    return (chunk.counts < config.min_words) | (100 * repeats > config.max_repeat_percent * chunk.counts)


def measure(column: pa.Array, weights: np.ndarray, threshold: float, config: QualityConfig) -> pa.StructArray:
    parts: list[list[np.ndarray]] = []
    for _, chunk in chunks(column, lower=True):
        cells, owner = _cells(chunk, config.buckets)
        n = chunk.n
        score = np.bincount(owner, weights[cells], minlength=n) / np.maximum(np.bincount(owner, minlength=n), 1)
        lines, repeats = np.zeros(n, np.int64), _repeats(chunk)
        breaks = chunk.sums(chunk.data == 10)
        for i in np.flatnonzero(breaks):
            lines[i] = _duplicate_lines(chunk.text(i))
        failed = base_failed(chunk, repeats, config)
        parts.append([chunk.counts.astype(np.int64), chunk.word_chars(), chunk.sums(_SYMBOL[chunk.data]), lines, repeats, score, failed, ~failed & (score >= threshold)])
    kinds = [pa.int64()] * 5 + [pa.float64(), pa.bool_(), pa.bool_()]
    columns = [pa.array(np.concatenate(c), k) for c, k in zip(zip(*parts, strict=True), kinds, strict=True)] if parts else [pa.array([], k) for k in kinds]
    return pa.StructArray.from_arrays(columns, names=FIELDS.fieldNames())


def _measured(docs: DataFrame, labels: DataFrame, config: QualityConfig) -> tuple[DataFrame, str]:
    model = fit(docs, labels, config)
    shared = docs.sparkSession.sparkContext.broadcast((model.weights, model.threshold))  # one double a cell
    name = fresh(docs, "_quality")
    return append_struct(docs, "text", name, FIELDS, lambda column: measure(column, *shared.value, config)), name


def quality_rules(docs: DataFrame, labels: DataFrame, config: QualityConfig = QualityConfig()) -> DataFrame:
    """``doc_id`` and the rules' measures and verdict, one row for each row of ``docs``."""
    out, name = _measured(docs.select("doc_id", "text"), labels, config)
    return out.select("doc_id", f"{name}.*")


def keep_good(docs: DataFrame, labels: DataFrame, config: QualityConfig = QualityConfig()) -> DataFrame:
    """The rows of ``docs`` that the rules keep, with their columns."""
    out, name = _measured(docs, labels, config)
    return out.where(F.col(f"{name}.kept")).drop(name)
