"""Token counts from an exact histogram of encoded lengths.

Documents are aggregated by the length of their encoding; the histogram has a
row for each length that occurs, however many documents there are.  Suffix
sums over it give, for every length L: how many documents and tokens are in
documents of L tokens or more, the total that is left when every document is
cut to L tokens, and the share of documents that are no longer than L.  The
suffix sums run in two levels (blocks of lengths, then lengths in a block), so
that no task holds the whole histogram.

Edge cases: null and empty texts have length 0 and are counted.  Repeated rows
are counted each.  An empty table gives no rows (and zeros from
:func:`truncated_totals`, nulls from :func:`quantiles`).  Other columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ._shared import Scratch
from .bpe_automaton import encoded_lengths

#: Lengths in a block of the suffix sums.
BLOCK = 1024


def length_histogram(docs: DataFrame, tokenizer: str) -> DataFrame:
    """``(length, n_docs)``, exact, of the documents' encodings."""
    return encoded_lengths(docs, tokenizer).groupBy(F.col("n_tokens").alias("length")).agg(F.count("*").alias("n_docs"))


def suffix_sums(histogram: DataFrame, block: int = BLOCK) -> DataFrame:
    """The histogram with its running totals from the longest length down."""
    h = histogram.withColumn("block", F.floor(F.col("length") / block))
    tokens = F.col("n_docs") * F.col("length")
    sums = h.groupBy("block").agg(F.sum("n_docs").alias("d"), F.sum(tokens).alias("t"))
    # One row a block: as many as the longest text has thousands of tokens.
    later = Window.orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    blocks = sums.select(
        "block",
        F.coalesce(F.sum("d").over(later), F.lit(0)).alias("later_docs"),
        F.coalesce(F.sum("t").over(later), F.lit(0)).alias("later_tokens"),
        F.sum("d").over(everything).alias("all_docs"),
        F.sum("t").over(everything).alias("all_tokens"),
    )
    down = Window.partitionBy("block").orderBy(F.desc("length")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    docs_least, tokens_least = F.col("later_docs") + F.sum("n_docs").over(down), F.col("later_tokens") + F.sum(tokens).over(down)
    return h.join(blocks, "block").select(
        "length",
        "n_docs",
        docs_least.alias("docs_at_least"),
        tokens_least.alias("tokens_at_least"),
        (F.col("all_tokens") - tokens_least + F.col("length") * docs_least).alias("truncated_total"),
        ((F.col("all_docs") - docs_least + F.col("n_docs")) / F.col("all_docs")).alias("share_no_longer"),
    )


def truncated_totals(histogram: DataFrame, limits: Sequence[int]) -> DataFrame:
    """``(context_limit, n_cut, total)`` for any limits: documents that are cut, and the tokens left."""
    parts = []
    for k, limit in enumerate(limits):
        parts += [F.sum(F.when(F.col("length") > limit, F.col("n_docs")).otherwise(0)).alias(f"n{k}"), F.sum(F.least(F.col("length"), F.lit(limit)) * F.col("n_docs")).alias(f"t{k}")]
    one = histogram.agg(*parts)
    rows = F.array(*[F.struct(F.lit(limit).cast("long").alias("context_limit"), F.coalesce(f"n{k}", F.lit(0)).alias("n_cut"), F.coalesce(f"t{k}", F.lit(0)).alias("total")) for k, limit in enumerate(limits)])
    return one.select(F.inline(rows))


def quantiles(histogram: DataFrame, shares: Sequence[float]) -> DataFrame:
    """``(share, length)``: the least length that so large a share of documents does not exceed."""
    sums = suffix_sums(histogram)
    one = sums.agg(*[F.min(F.when(F.col("share_no_longer") >= s, F.col("length"))).alias(f"q{k}") for k, s in enumerate(shares)])
    return one.select(F.inline(F.array(*[F.struct(F.lit(float(s)).alias("share"), F.col(f"q{k}").alias("length")) for k, s in enumerate(shares)])))


def token_counts(docs: DataFrame, tokenizer: str) -> DataFrame:
    """Suffix sums for every length that occurs in ``docs``."""
    scratch = Scratch(docs.sparkSession)
    return suffix_sums(scratch.put(length_histogram(docs, tokenizer), "histogram"))
