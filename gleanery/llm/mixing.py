"""Mixing to target weights with soft domain membership, in DataFrame operations only.

The labelled table defines domains (:data:`DOMAINS`, from its quality and
toxicity).  A naive Bayes classifier over hashed words, fitted on a bounded
sample of labelled rows, gives every document a posterior over the domains.
Its log-likelihood is taken as the mean over the words times at most
``evidence`` words, so that long documents keep a soft membership.

Document ``d`` with ``t`` tokens (words) and posterior ``p`` contributes ``r t
p_k`` expected tokens of domain ``k`` at rate ``r``.  Rates start at 1 and
minimise the squared distance of the domains' totals from the targets, under
``0 <= r`` (and ``r <= most``, if given), by accelerated projected gradient
steps.  In the metric weighted by tokens a step moves ``r`` by ``p . e``,
where ``e`` are the totals' relative errors: a number a domain, computed by
one distributed aggregation.  The steps' errors determine every document's
rate, so no state per document is kept, and documents with equal posteriors
(rounded to three decimals) share one row while steps run.

Edge cases: null, empty and word-less texts have 0 tokens, the domains' priors
as posterior, and a rate like any other.  Rows that repeat an id get a row
each.  A null id is kept.  Without labelled rows the priors are even.  An empty
table gives no rows.  Labels that are null in what a domain asks for are not
used.  Other columns are ignored by :func:`document_rates` and passed through by
:func:`mix`.
"""

from __future__ import annotations

import warnings
from collections.abc import Mapping
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._shared import Scratch, without_ids

#: Domains and the condition on ``labels``; the first that holds counts.
DOMAINS = {"toxic": "toxic = 1", "clean": "quality = 1", "low": "quality = 0"}


@dataclass(frozen=True)
class MixConfig:
    #: Target token totals: shares of ``budget`` times the corpus's tokens, or multiples of the domains' own totals.
    targets: Mapping[str, float] = field(default_factory=lambda: {"clean": 0.90, "low": 0.08, "toxic": 0.02})
    multiples: bool = False
    budget: float = 1.0
    most: float | None = None
    #: Cells of hashed words: the broadcast table has as many rows.
    buckets: int = 1 << 14
    #: The most labelled rows that the classifier reads.
    labelled_rows: int = 20_000
    #: The most words' worth of evidence.
    evidence: float = 40.0
    steps: int = 60
    #: Steps end when no total is further from its target than this share of all tokens.
    close: float = 1e-6
    seed: int = 23


def _words(text: str) -> Column:
    return F.split(F.coalesce(F.col(text), F.lit("")), r"[ \t-\r]+", -1)


def _cell(word: str, config: MixConfig) -> Column:
    return F.pmod(F.xxhash64(word), F.lit(config.buckets)).cast("int")


def labelled_sample(labels: DataFrame, config: MixConfig) -> DataFrame:
    """``(id, domain)`` of at most ``labelled_rows`` labelled ids, by a hash of the id."""
    number = F.coalesce(*[F.when(F.expr(rule), F.lit(k)) for k, rule in enumerate(DOMAINS.values())])
    each = labels.where("doc_id is not null").select(F.col("doc_id").alias("id"), number.alias("domain")).where("domain is not null")
    return each.groupBy("id").agg(F.min("domain").alias("domain")).orderBy(F.xxhash64("id"), "id").limit(config.labelled_rows)


def classifier(docs: DataFrame, labels: DataFrame, config: MixConfig, scratch: Scratch) -> tuple[DataFrame, list[float]]:
    """``(cell, l0, l1, ...)``, a cell's log-likelihood in each domain, and the domains' log priors."""
    n = len(DOMAINS)
    sample = scratch.put(labelled_sample(labels, config), "sample")
    chosen = docs.select("doc_id", "text").join(F.broadcast(sample), F.col("doc_id") == F.col("id"))  # at most labelled_rows
    counts = scratch.put(chosen.select("domain", F.explode(_words("text")).alias("word")).where("word <> ''").groupBy(_cell("word", config).alias("cell"), "domain").agg(F.count("*").alias("c")), "counts")
    totals = {r.domain: r.c for r in counts.groupBy("domain").agg(F.sum("c").alias("c")).collect()}
    sizes = {r.domain: r.c for r in sample.groupBy("domain").agg(F.count("*").alias("c")).collect()}
    wide = counts.groupBy("cell").agg(*[F.sum(F.when(F.col("domain") == k, F.col("c")).otherwise(0)).alias(f"c{k}") for k in range(n)])
    cells = docs.sparkSession.range(config.buckets).select(F.col("id").cast("int").alias("cell")).join(wide, "cell", "left")
    logs = [F.log((F.coalesce(F.col(f"c{k}"), F.lit(0)) + 0.5) / F.lit(totals.get(k, 0) + 0.5 * config.buckets)).alias(f"l{k}") for k in range(n)]
    rows = sum(sizes.values())
    return cells.select("cell", *logs), [float(np.log((sizes.get(k, 0) + 1) / (rows + n))) for k in range(n)]


def posteriors(docs: DataFrame, labels: DataFrame, config: MixConfig, scratch: Scratch) -> DataFrame:
    """``(doc_id, n_tokens, copies, p0, p1, ...)``; ``copies`` are rows with the same id and text."""
    table, priors = classifier(docs, labels, config, scratch)
    n = len(DOMAINS)
    # The text's hash is taken below the explode, once a text.
    texts = docs.select("doc_id", F.xxhash64("text").alias("h"), F.concat(_words("text"), F.array(F.lit(None).cast("string"))).alias("words"))
    each = texts.select("doc_id", "h", F.explode("words").alias("word")).where("word is null or word <> ''")
    keyed = each.select("doc_id", "h", F.when(F.col("word").isNotNull(), _cell("word", config)).alias("cell"))
    joined = keyed.join(F.broadcast(scratch.put(table, "likelihoods")), "cell", "left")  # one row a cell
    sums = joined.groupBy("doc_id", "h").agg(F.count("cell").alias("words"), F.sum(F.when(F.col("cell").isNull(), 1).otherwise(0)).alias("copies"), *[F.sum(f"l{k}").alias(f"s{k}") for k in range(n)])
    weight = F.least(F.col("words"), F.lit(config.evidence)) / F.greatest(F.col("words"), F.lit(1))
    scores = sums.select("doc_id", "copies", (F.col("words") / F.col("copies")).cast("long").alias("n_tokens"), *[(F.lit(priors[k]) + weight * F.coalesce(f"s{k}", F.lit(0.0))).alias(f"z{k}") for k in range(n)])
    top = F.greatest(*[F.col(f"z{k}") for k in range(n)])
    exps = [F.exp(F.col(f"z{k}") - top) for k in range(n)]
    return scratch.put(scores.select("doc_id", "n_tokens", "copies", *[F.round(e / sum(exps[1:], exps[0]), 3).alias(f"p{k}") for k, e in enumerate(exps)]), "posteriors")


def rate_after(history: list[tuple[float, list[float]]], step: float, most: float | None) -> tuple[Column, Column]:
    """The rate after the steps so far, and the point at which the next error is taken."""
    one = F.struct(F.lit(1.0).alias("r"), F.lit(1.0).alias("y"))
    if not history:
        return F.lit(1.0), F.lit(1.0)
    n = len(history[0][1])
    told = F.array(*[F.struct(F.lit(beta).alias("beta"), *[F.lit(x).alias(f"e{k}") for k, x in enumerate(e)]) for beta, e in history])

    def go(acc: Column, h: Column) -> Column:
        pull = sum((F.col(f"p{k}") * h[f"e{k}"] for k in range(1, n)), F.col("p0") * h["e0"])
        r = F.greatest(F.lit(0.0), acc["y"] - F.lit(step) * pull)
        r = r if most is None else F.least(F.lit(most), r)
        return F.struct(r.alias("r"), (r + h["beta"] * (r - acc["r"])).alias("y"))

    out = F.aggregate(told, one, go)
    return out["r"], out["y"]


def fit_rates(found: DataFrame, config: MixConfig, scratch: Scratch) -> Column:
    """The rate of a row of ``found``, as an expression over its posterior."""
    n = len(DOMAINS)
    p = [f"p{k}" for k in range(n)]
    # At most half a million rows, however large the corpus: as many as three posteriors in thousandths can be. In one
    # part, so that a step is one task; written, so that a lost executor's part is read again.
    cells = scratch.put(found.groupBy(*p).agg(F.sum(F.col("n_tokens") * F.col("copies")).cast("double").alias("t")).repartition(1), "cells").persist()
    gram = [F.sum(F.col("t") * F.col(a) * F.col(b)).alias(f"{a}{b}") for a in p for b in p]
    first = cells.agg(F.sum("t").alias("t"), *[F.sum(F.col("t") * F.col(a)).alias(a) for a in p], *gram).first()  # one row
    total = first.t or 0.0
    if not total:
        cells.unpersist()
        return F.lit(1.0)
    own = np.array([first[a] for a in p])
    wanted = np.array([config.targets.get(d, 0.0) for d in DOMAINS])
    target = wanted * own if config.multiples else wanted / wanted.sum() * config.budget * total
    # Squared distances count in units of a domain's own total: no small domain lags behind.
    unit = total / np.maximum(own, 1e-3 * total)
    gram_matrix = np.array([[first[f"{a}{b}"] for b in p] for a in p]) / total
    step = float(1.0 / max(np.linalg.eigvalsh(np.sqrt(unit)[:, None] * gram_matrix * np.sqrt(unit)[None, :]).max(), 1e-9))
    history: list[tuple[float, list[float]]] = []
    pace = 1.0
    for _ in range(config.steps):
        _, y = rate_after(history, step, config.most)
        sums = cells.select("t", *p, y.alias("y")).agg(*[F.sum(F.col("t") * F.col("y") * F.col(a)).alias(a) for a in p]).first()  # one row
        # Rounded, so that the order of summing leaves no trace.
        error = np.round((np.array([sums[a] for a in p]) - target) / total, 12)
        if np.abs(error).max() < config.close:
            break
        faster = (1 + (1 + 4 * pace * pace) ** 0.5) / 2
        history.append(((pace - 1) / faster, [float(x) for x in np.round(unit * error, 12)]))
        pace = faster
    else:
        warnings.warn(f"after {config.steps} steps a domain's total is {np.abs(error).max():.2g} of all tokens away from its target, which the rates' bounds may put out of reach", stacklevel=2)
    cells.unpersist()
    return rate_after(history, step, config.most)[0]


def document_rates(docs: DataFrame, labels: DataFrame, config: MixConfig = MixConfig()) -> DataFrame:
    """``(doc_id, n_tokens, p_<domain>..., rate)``, one row for each row of ``docs``."""
    scratch = Scratch(docs.sparkSession)
    found = posteriors(docs, labels, config, scratch)
    rate = fit_rates(found, config, scratch)
    out = found.select("doc_id", "n_tokens", *[F.col(f"p{k}").alias(f"p_{d}") for k, d in enumerate(DOMAINS)], rate.alias("rate"), F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("copy"))
    return out.drop("copy")


def domain_totals(rates: DataFrame) -> DataFrame:
    """``(domain, tokens, expected)``: each domain's tokens now and at the rates."""
    one = rates.agg(*[F.sum(F.col("n_tokens") * F.col(f"p_{d}") * w).alias(f"{x}_{d}") for d in DOMAINS for x, w in (("t", F.lit(1.0)), ("e", F.col("rate")))])
    return one.select(F.inline(F.array(*[F.struct(F.lit(d).alias("domain"), F.col(f"t_{d}").alias("tokens"), F.col(f"e_{d}").alias("expected")) for d in DOMAINS])))


def draw(doc_id: str, seed: int) -> Column:
    """A fixed number in [0, 1) for each id."""
    return F.shiftrightunsigned(F.xxhash64(F.col(doc_id), F.lit(seed)), 11) / float(1 << 53)


def mix(docs: DataFrame, labels: DataFrame, config: MixConfig) -> DataFrame:
    """The rows of ``docs`` that the rates keep: a document stays if its fixed draw is below its rate.

    A rate of 1 or more keeps the document, once.  Rows with a null id stay.
    """
    rates = document_rates(docs, labels, config)
    gone = rates.where((F.col("rate") < 1) & (draw("doc_id", config.seed) >= F.col("rate"))).select("doc_id")
    return without_ids(docs, "doc_id", gone, Scratch(docs.sparkSession))
