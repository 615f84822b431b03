"""Document fingerprints by consistent weighted sampling, in DataFrame operations only.

A text is a weighted set: its words (ASCII letters lower-cased) with their
numbers of occurrences.  For each term and each of :data:`SAMPLES` samples
there are fixed draws ``r, c ~ Gamma(2, 1)`` and ``b ~ Uniform(0, 1)``.  A term
of weight ``w`` gets ``t = floor(ln w / r + b)`` and the rank ``ln c - r (t -
b + 1)``; the sample is the pair (term, t) of the least rank.  Two texts agree
in a sample with a probability of their generalised Jaccard similarity, the
sum of the lesser weights over the sum of the greater.

A term is its 64-bit hash.  Draws come from two tables of fixed size that are
broadcast, so that no logarithm is taken per word and sample: one part of the
hash picks the row of the ``r``, another that of the ``b`` and ``c``.  Two terms
share all their draws only if both parts are equal, one pair in ``buckets ** 2``
(2**28); then they count as one term.  A rank is a function of (term, t) with a
continuous distribution, so the least rank itself stands for the pair, and a
document's fingerprint is the column-wise minimum over its terms.

The table's one large shuffle brings neighbours in id order together: ids are
cut into ranges of about equal numbers, each range holds its documents and the
first one of the next range, and what follows (neighbouring texts, words,
counts, minima) stays within the ranges.

Edge cases: null and empty texts, and texts without words, have the
fingerprint of the empty set; two of those are alike (1), and one is unlike
any other text (0).  Rows that repeat an id are rows of their own, ordered by
their texts.  Null ids come last.  A table of one row is its own neighbour.  An
empty table gives no rows.  Other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ._shared import Scratch


@dataclass(frozen=True)
class SamplingConfig:
    samples: int = 64
    #: Rows of each of the broadcast tables, of 1 and 2 floats a sample; a power of two.
    buckets: int = 1 << 14
    #: Documents in a range of neighbours, about.
    range_rows: int = 2000
    #: The most ranges; beyond that, ranges hold more documents.
    most_ranges: int = 10_000
    seed: int = 17


def uniform(*parts: Column) -> Column:
    """A fixed draw from (0, 1), open on both sides."""
    return (F.shiftrightunsigned(F.xxhash64(*parts), 12).cast("double") + 0.5) / float(1 << 52)


def draws(spark: SparkSession, config: SamplingConfig) -> tuple[DataFrame, DataFrame]:
    """``(row1, r)`` and ``(row2, bc)``: for each sample, in turn, ``r``, and ``b`` and ``ln c``."""
    one = spark.range(config.buckets * config.samples).select(F.floor(F.col("id") / config.samples).cast("int").alias("row"), (F.col("id") % config.samples).cast("int").alias("i"))
    draw = lambda which: uniform(F.lit(config.seed), F.col("row"), F.col("i"), F.lit(which))
    gamma2 = lambda which: -F.ln(draw(which) * draw(which + 1))  # noqa: E731  the sum of two exponential draws
    listed = lambda *v: F.array_sort(F.collect_list(F.struct("i", F.array(*[x.cast("float") for x in v]).alias("v"))))
    flat = lambda column: F.flatten(F.transform(column, lambda x: x["v"]))
    first = one.groupBy(F.col("row").alias("row1")).agg(listed(gamma2(0)).alias("v")).select("row1", flat("v").alias("r"))
    second = one.groupBy(F.col("row").alias("row2")).agg(listed(draw(2), F.ln(gamma2(3))).alias("v")).select("row2", flat("v").alias("bc"))
    return first, second


def words(text: Column) -> Column:
    r"""Words, and empty strings where a text begins or ends with a separator."""
    lowered = F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.split(lowered, r"[ \t-\r]+", -1)


#: Numbers that a text's rows can carry along.
NOTES = 6


def fingerprints(terms: DataFrame, keys: list[str], config: SamplingConfig) -> DataFrame:
    """From the rows of :func:`weighted_terms` to ``(keys..., s, note1, ...)``.

    ``s`` holds, per sample, the least rank, and nulls for the empty set.
    """
    first, second = draws(terms.sparkSession, config)
    mask, bits = F.lit(config.buckets - 1).cast("long"), config.buckets.bit_length() - 1
    term = F.when(F.col("note") == 0, F.col("term"))
    row1, row2 = term.bitwiseAND(mask).cast("int").alias("row1"), F.shiftrightunsigned(term, bits).bitwiseAND(mask).cast("int").alias("row2")
    joined = terms.select(*keys, "note", "term", row1, row2, F.ln(F.col("w").cast("double")).alias("log")).join(F.broadcast(first), "row1", "left").join(F.broadcast(second), "row2", "left")
    columns = [F.max(F.when(F.col("note") == k, F.col("term"))).alias(f"note{k}") for k in range(1, NOTES + 1)]
    for i in range(config.samples):
        r, b, c = F.get("r", F.lit(i)), F.get("bc", F.lit(2 * i)), F.get("bc", F.lit(2 * i + 1))
        columns.append(F.min(c - r * (F.floor(F.col("log") / r + b) - b + 1)).alias(f"s{i}"))
    mins = joined.groupBy(*keys).agg(*columns)
    return mins.select(*keys, F.array(*[F.col(f"s{i}") for i in range(config.samples)]).alias("s"), *[f"note{k}" for k in range(1, NOTES + 1)])


def likeness(x: str, y: str, samples: int) -> Column:
    """The share of equal samples; two empty sets are alike."""
    same = F.aggregate(F.zip_with(x, y, lambda a, b: a.eqNullSafe(b).cast("int")), F.lit(0), lambda acc, v: acc + v)
    return same / float(samples)


def as_text(s: str) -> Column:
    """Four hexadecimal digits a sample; the empty set's are dashes."""
    return F.array_join(F.transform(s, lambda v: F.coalesce(F.lpad(F.lower(F.hex(F.pmod(F.xxhash64(v), F.lit(65536)))), 4, "0"), F.lit("----"))), "")


def noted(*numbers: Column) -> Column:
    """Numbers as strings that no word can be, since they begin with a space; nulls are left out."""
    return F.array_compact(F.array(F.lit(" 0 0"), *[F.concat(F.lit(f" {k} "), n.cast("string")) for k, n in enumerate(numbers, 1)]))


def weighted_terms(texts: DataFrame, keys: list[str], text: str, notes: Column) -> DataFrame:
    """``(keys..., note, term, w)``: each text's terms by hash with their numbers, as note 0, and what :func:`noted` it carries, as terms of other notes.

    What is carried rides along as rows of its own, a few a text, so that the
    rows of its words stay narrow while they are counted.
    """
    each = texts.select(*keys, F.explode(F.concat(words(F.col(text)), notes)).alias("word")).where("word <> ''")
    carried = F.startswith("word", F.lit(" "))
    note = F.when(carried, F.when(F.substring("word", 2, 1) == "0", -1).otherwise(F.substring("word", 2, 1).cast("int"))).otherwise(0)
    term = F.when(carried, F.substring("word", 4, 20).cast("long")).otherwise(F.xxhash64("word"))
    return each.select(*keys, note.alias("note"), term.alias("term")).groupBy(*keys, "note", "term").agg(F.count("*").alias("w"))


def fingerprint_texts(docs: DataFrame, config: SamplingConfig = SamplingConfig()) -> DataFrame:
    """``(doc_id, s, fingerprint)``, for texts on their own; rows that repeat an id must not occur."""
    split = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    terms = weighted_terms(split.repartition("doc_id"), ["doc_id"], "text", noted())
    return fingerprints(terms, ["doc_id"], config).select("doc_id", "s", as_text("s").alias("fingerprint"))


def _cuts_from(value: Column, cuts: list[int]) -> Column:
    """How many of the descending ``cuts`` are no less than ``value``, looked up in two steps."""
    if not cuts:
        return F.lit(0)
    step = max(1, round(len(cuts) ** 0.5))
    reaches = lambda c: c >= value
    array = lambda xs: F.lit(list(xs)).cast("array<long>")
    coarse = F.size(F.filter(array(cuts[::step]), reaches))
    fine = F.size(F.filter(F.slice(array(cuts), (coarse - 1) * step + 1, step), reaches))
    return F.when(coarse == 0, F.lit(0)).otherwise((coarse - 1) * step + fine)


def neighbours(docs: DataFrame, config: SamplingConfig, scratch: Scratch) -> DataFrame:
    """``(g, rn, doc_id, text, next_text, ghost)``: each document and the next in descending id order.

    ``g`` is the range; ghosts stand for a following range's first document.
    """
    ids = docs.select("doc_id")
    total = ids.count()
    n = min(config.most_ranges, max(1, -(-total // config.range_rows)))
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    cuts = ids.agg(F.percentile_approx("doc_id", [k / n for k in range(1, n)], 10_000).alias("q")).first().q if n > 1 else []
    cuts = sorted(set(cuts or []), reverse=True)
    # Range 0 has the largest ids; nulls, the last ones, share the last range.
    place = F.when(F.col("doc_id").isNull(), F.lit(len(cuts))).otherwise(_cuts_from(F.col("doc_id"), cuts)).cast("int")
    order = [F.desc_nulls_last("doc_id"), F.asc("text")]
    # The first document of each range, by id alone unless ids repeat.
    heads = scratch.put(ids.select("doc_id", place.alias("g")).groupBy("g").agg(F.max("doc_id").alias("head"), F.count("*").alias("c")), "heads")
    present = sorted((r.g, r.head) for r in heads.collect())  # at most most_ranges rows
    # By range: the one before it (the first one follows the last), and its first id.
    before, first = [0] * (len(cuts) + 1), [None] * (len(cuts) + 1)
    for k, (g, head) in enumerate(present):
        before[g], first[g] = present[k - 1][0], head
    to = F.get(F.lit(before), F.col("g"))
    placed = rows.withColumn("g", place)
    is_head = F.col("doc_id").eqNullSafe(F.get(F.array(*[F.lit(h).cast("long") for h in first]), F.col("g")))
    both = placed.select(
        "doc_id", "text", F.explode(F.when(is_head, F.array(F.struct("g", F.lit(False).alias("ghost")), F.struct(to.alias("g"), F.lit(True).alias("ghost")))).otherwise(F.array(F.struct("g", F.lit(False).alias("ghost"))))).alias("at")
    ).select("at.g", "at.ghost", "doc_id", "text")
    w = Window.partitionBy("g").orderBy("ghost", *order)
    return both.select("g", "ghost", "doc_id", "text", F.row_number().over(w).alias("rn"), F.lead("text").over(w).alias("next_text"))


def edited(text: Column, other: Column) -> Column:
    """``text`` with its last half replaced by as much, or all, of the beginning of ``other``."""
    half = F.floor(F.char_length(text) / 2).cast("int")
    return F.concat(text.substr(F.lit(1), F.char_length(text) - half), other.substr(F.lit(1), half))


def fingerprint_edits(docs: DataFrame, config: SamplingConfig = SamplingConfig()) -> DataFrame:
    """Each document, its edited text and the next one, and how alike their fingerprints are."""
    scratch = Scratch(docs.sparkSession)
    near = neighbours(docs, config, scratch)
    own, change = F.col("text"), F.coalesce(edited(F.col("text"), F.col("next_text")), F.col("text"))
    digest = F.sha2(change, 256)
    quarters = [F.conv(F.substring(digest, 16 * k + 1, 16), 16, -10).cast("long") for k in range(4)]
    # A place in the range: its row number, whether the text is the edited one, and whether the row is a ghost.
    at = lambda role: (F.col("rn").cast("long") * 4 + 2 * role + F.col("ghost").cast("int")).alias("at")
    role = lambda k, text, notes: F.struct(at(k), text.alias("text"), notes.alias("notes"))
    carried = F.when(F.col("ghost"), noted()).otherwise(noted(F.col("doc_id"), F.char_length(own).cast("long"), *quarters))
    both = near.select("g", "ghost", F.explode(F.array(role(0, own, carried), role(1, change, noted()))).alias("v"))
    two = both.where("not ghost or v.at % 4 < 2").select("g", "v.at", "v.text", "v.notes")
    prints = fingerprints(weighted_terms(two, ["g", "at"], "text", F.col("notes")), ["g", "at"], config)
    by_place = Window.partitionBy("g").orderBy("at")
    # Rows come as (own, edited) pairs by place: the next row is the edited text's, the one after it the next document's.
    kept = prints.select("at", "s", *[f"note{k}" for k in range(1, NOTES + 1)], F.lead("s", 1).over(by_place).alias("e"), F.lead("s", 2).over(by_place).alias("x")).where("at % 4 = 0")
    sha = F.concat(*[F.lpad(F.lower(F.hex(f"note{k}")), 16, "0") for k in range(3, 7)])
    return kept.select(
        F.col("note1").alias("doc_id"), F.col("note2").alias("n_chars"), sha.alias("edited_sha256"), as_text("s").alias("fingerprint"), as_text("e").alias("edited_fingerprint"),
        likeness("s", "e", config.samples).alias("near_edited"), likeness("s", "x", config.samples).alias("near_next"),
    )
