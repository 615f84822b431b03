"""Planting, scoring and sweeping: how the audit itself is judged."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.names import base_name
from ..functions.vectors import mirrored
from .pairs import nearest

EDITS = ("exact", "negated_tail", "mirror", "darker")


def edited(v: Column, kind: Column, width: int = 8) -> Column:
    """A vector's planted copy."""
    n = F.size(v)
    tail = F.transform(v, lambda x, i: F.when(i >= n - 3, -x).otherwise(x))
    return F.when(kind == "negated_tail", tail).when(kind == "mirror", mirrored(v, width)).when(kind == "darker", F.transform(v, lambda x: x * 0.5)).otherwise(v)


def plant(vectors: DataFrame, every: int, offset: int) -> DataFrame:
    """``(id, origin, kind, v)``: copies of every so-many-th vector, the edits in turn."""
    k = F.floor(F.col("id") / every) % len(EDITS)
    kind = F.element_at(F.array(*[F.lit(e) for e in EDITS]), (k + 1).cast("int"))
    chosen = vectors.where(F.col("id") % every == 0)
    return chosen.select((F.col("id") + offset).alias("id"), F.col("id").alias("origin"), kind.alias("kind"), edited(F.col("v"), kind).alias("v"))


def recall_by_kind(planted: DataFrame, found: DataFrame) -> DataFrame:
    """``(kind, planted, found, recall)`` of planted copies among found pairs."""
    hit = found.select(F.col("a").alias("origin"), F.col("b").alias("id")).distinct().withColumn("hit", F.lit(1))
    told = planted.join(hit, ["origin", "id"], "left")
    n, got = F.count("*"), F.sum(F.coalesce("hit", F.lit(0)))
    return told.groupBy("kind").agg(n.alias("planted"), got.alias("found"), F.round(got / n, 4).alias("recall"))


def confusion(scored: DataFrame) -> DataFrame:
    """One row: hits, misses, false flags and the rest of ``scored(truth, flagged)``."""
    t, f = F.col("truth"), F.col("flagged")
    return scored.agg(F.count_if(t & f).alias("tp"), F.count_if(t & ~f).alias("fn"), F.count_if(~t & f).alias("fp"), F.count_if(~t & ~f).alias("tn"))


def threshold_sweep(scored: DataFrame, bars: Sequence[float]) -> DataFrame:
    """``(bar, hits, others)``: how many of ``scored(score, truth)`` reach each bar; one pass."""
    rows = scored.select("truth", F.explode(F.filter(F.array(*[F.lit(float(b)) for b in bars]), lambda b: b <= F.col("score"))).alias("bar"))
    found = rows.groupBy("bar").agg(F.count_if("truth").alias("hits"), F.count_if(~F.col("truth")).alias("others"))
    every = scored.sparkSession.createDataFrame([(float(b),) for b in bars], "bar double")
    return every.join(found, "bar", "left").select("bar", F.coalesce("hits", F.lit(0)).alias("hits"), F.coalesce("others", F.lit(0)).alias("others"))


def gate_grid(scored: DataFrame, inliers: Sequence[int], coverages: Sequence[float | None]) -> DataFrame:
    """``(max_inliers, max_coverage, reviewed, false_reviewed)`` of review gates; a null coverage gates nothing more."""
    gates = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(c).cast("double").alias("c")) for i in inliers for c in coverages])
    passed = F.filter(gates, lambda g: (F.col("inliers") < g["i"]) | F.coalesce(F.col("coverage") < g["c"], F.lit(False)))
    rows = scored.select("truth", F.explode(passed).alias("g"))
    return rows.groupBy(F.col("g.i").alias("max_inliers"), F.col("g.c").alias("max_coverage")).agg(F.count("*").alias("reviewed"), F.count_if(~F.col("truth")).alias("false_reviewed"))


def _upto(values: DataFrame, column: str) -> DataFrame:
    """``(x, n, upto)``: each value, how many there are in all, and how many up to it.

    Ranks come from a histogram's running sums, in two levels, so no task sorts all rows.
    """
    c = values.groupBy(F.col(column).cast("double").alias("x")).agg(F.count("*").alias("c")).where("x is not null")
    part = c.withColumn("p", F.floor(F.col("x") * 16))
    sums = part.groupBy("p").agg(F.sum("c").alias("s"))
    ahead = sums.select("p", F.coalesce(F.sum("s").over(Window.orderBy("p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("ahead"), F.sum("s").over(Window.partitionBy()).alias("n"))
    upto = F.col("ahead") + F.sum("c").over(Window.partitionBy("p").orderBy("x").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return part.join(ahead, "p").select("x", "n", upto.alias("upto"))


def index_quartiles(values: DataFrame, column: str) -> DataFrame:
    """One row: the values at a quarter, a half and three quarters of the sorted order, not interpolated."""
    at = lambda q: F.min(F.when(F.col("upto") > F.floor(F.col("n") * q / 4), F.col("x")))
    return _upto(values, column).agg(at(1).alias("q1"), at(2).alias("q2"), at(3).alias("q3"))


def spread(values: DataFrame, column: str) -> DataFrame:
    """One row: least, median, 99th percentile (between neighbours in proportion) and greatest."""
    place = lambda q: (F.col("n") - 1) * q
    at = lambda rank: F.min(F.when(F.col("upto") > rank, F.col("x")))
    both = {q: (at(F.floor(place(q))), at(F.ceil(place(q))), F.max(place(q) - F.floor(place(q)))) for q in (0.5, 0.99)}
    between = {q: lo + (hi - lo) * share for q, (lo, hi, share) in both.items()}
    return _upto(values, column).agg(F.min("x").alias("least"), between[0.5].alias("median"), between[0.99].alias("p99"), F.max("x").alias("greatest"))


def greatest(values: DataFrame, column: str, n: int) -> DataFrame:
    """One row: the ``n`` greatest values, descending."""
    top = values.select(F.col(column).alias("x")).where("x is not null").orderBy(F.desc("x")).limit(n)
    return top.agg(F.sort_array(F.collect_list("x"), asc=False).alias("greatest"))


def cap_share(counts: DataFrame, cap: int) -> DataFrame:
    """One row: how many photos of ``(photo, n)`` have more keypoints than a cap lets through, and what share of all they are."""
    over = F.count_if(F.col("n") > cap)
    return counts.agg(F.count("*").alias("photos"), over.alias("over"), F.round(over / F.count("*"), 4).alias("share"))


def scaled_bar(bar: int, capped: DataFrame, uncapped: DataFrame) -> DataFrame:
    """One row, ``(ratio, bar)``: a bar set for capped keypoints ``(photo, n)``, scaled by how many more there are uncapped (half to even)."""
    means = capped.agg(F.avg("n").alias("c")).join(uncapped.agg(F.avg("n").alias("u")))  # one row each
    return means.select(F.round(F.col("u") / F.col("c"), 4).alias("ratio"), F.bround(bar * F.col("u") / F.col("c"), 0).cast("long").alias("bar"))


def cross_split(found: DataFrame, prefix: str = "train__") -> DataFrame:
    """Pairs ``(a, b, ...)`` of which just one file's name begins as the training split's do."""
    own = lambda c: F.startswith(base_name(F.col(c)), F.lit(prefix))
    return found.where(own("a") != own("b"))


def sharing_names(found: DataFrame, cards: DataFrame) -> DataFrame:
    """Pairs ``(a, b)`` of a training and a test page that show a card of one name, from ``cards(split, page, name)``."""
    named = cards.select("split", "page", F.lower(F.trim("name")).alias("name")).where("name <> ''").distinct()
    x, y = (named.where(F.col("split") == s).select(F.col("page").alias(c), "name") for s, c in (("train", "a"), ("val", "b")))
    return found.join(x, "a").join(y, ["b", "name"]).select("a", "b").distinct()


def audit_summary(flagged: DataFrame, tests: DataFrame) -> DataFrame:
    """One row of ``flagged(a, b, method, same_class)`` and ``tests(id)``: pairs by method, test photos with a match and their share, pairs across classes."""
    told = flagged.agg(F.count("*").alias("pairs"), F.count_if(F.col("method") == "hash").alias("by_hash"), F.count_if(F.col("method") == "keypoints").alias("by_keypoints"), F.countDistinct("b").alias("matched"), F.count_if(~F.col("same_class")).alias("across"))
    return told.join(tests.agg(F.countDistinct("id").alias("tests"))).withColumn("share", F.round(F.col("matched") / F.col("tests"), 4))  # one row each


def drawn_pairs(left: DataFrame, right: DataFrame, taken: DataFrame, n: int, draws: int, salt: str) -> DataFrame:
    """``(grp, a, b)``: at most ``n`` pairs of ``(id, grp)`` rows of one group that are not among ``taken(a, b)``.

    Both sides' members are numbered within their group by hash.  A draw picks
    a group, and a number on each side, by hashes of its own number: equi-joins
    of as many rows as there are draws.  Pairs drawn twice count once.
    """

    def numbered(df: DataFrame, name: str) -> tuple[DataFrame, DataFrame]:
        w = Window.partitionBy("grp").orderBy(F.md5(F.col("id").cast("string")), "id")
        rows = df.select("grp", F.col("id").alias(name), (F.row_number().over(w) - 1).alias(f"n{name}"))
        return rows, rows.groupBy("grp").agg(F.count("*").alias(f"c{name}"))

    (a, ca), (b, cb) = numbered(left, "a"), numbered(right, "b")
    groups = ca.join(cb, "grp").withColumn("g", F.row_number().over(Window.orderBy("grp")) - 1)  # a row a group
    total = groups.agg(F.count("*").alias("groups"))
    h = lambda what: F.conv(F.substring(F.md5(F.concat_ws("#", F.lit(salt), F.lit(what), F.col("k").cast("string"))), 1, 12), 16, 10).cast("long")
    spark = left.sparkSession
    picked = spark.range(draws).withColumnRenamed("id", "k").join(F.broadcast(total)).select("k", (h("g") % F.col("groups")).alias("g"), h("a").alias("ha"), h("b").alias("hb"))
    placed = picked.join(groups, "g").select("k", "grp", (F.col("ha") % F.col("ca")).alias("na"), (F.col("hb") % F.col("cb")).alias("nb"))
    found = placed.join(a, ["grp", "na"]).join(b, ["grp", "nb"]).groupBy("grp", "a", "b").agg(F.min("k").alias("k"))
    return found.join(taken.select("a", "b"), ["a", "b"], "left_anti").orderBy("k").limit(n).select("grp", "a", "b")


def inlier_table(train: DataFrame, test: DataFrame, features: DataFrame, block: int = 256) -> DataFrame:
    """``(a, b, inliers, fixed_camera)`` of every training photo with every test photo ``(name)``, block by block: the exhaustive table that bars are calibrated on."""
    from .verify import verified

    sides = [df.select(F.col("name").alias(c), F.pmod(F.xxhash64("name"), F.lit(max(1, -(-df.count() // block)))).cast("int").alias(f"k{c}")) for df, c in ((train, "a"), (test, "b"))]
    packs = [df.groupBy(f"k{c}").agg(F.collect_list(c).alias(f"all{c}")) for df, c in zip(sides, "ab", strict=True)]
    blocks = [int(df.agg(F.max(f"k{c}")).first()[0] or 0) for df, c in zip(sides, "ab", strict=True)]
    x = packs[0].select("ka", "alla", F.explode(F.sequence(F.lit(0), F.lit(blocks[1]))).alias("kb"))
    meet = x.join(packs[1], "kb").select(F.explode("alla").alias("a"), "allb").select("a", F.explode("allb").alias("b"))
    return verified(meet, features).select("a", "b", "inliers", "fixed_camera")


def one_nn_accuracy(train: DataFrame, test: DataFrame) -> DataFrame:
    """One row: the share of ``test(id, v, label)`` whose nearest training vector has their label."""
    found = nearest(test.select("id", "v"), train.select("id", "v"), 1)
    told = found.join(train.select("id", F.col("label").alias("guess")), "id").join(test.select(F.col("id").alias("q"), "label"), "q")
    return told.agg(F.round(F.avg((F.col("guess") == F.col("label")).cast("double")), 4).alias("accuracy"))


def most_common(rows: DataFrame, column: str, n: int) -> DataFrame:
    return rows.groupBy(column).agg(F.count("*").alias("n")).orderBy(F.desc("n"), column).limit(n)


def points_in_boxes(points: DataFrame, boxes: DataFrame) -> DataFrame:
    """``(photo, box_no, inside)``: keypoints of ``(photo, x, y)`` within each box of ``(photo, box_no, x1..y2)``."""
    on = boxes.join(points, "photo", "left")
    inside = (F.col("x") >= F.col("x1")) & (F.col("x") <= F.col("x2")) & (F.col("y") >= F.col("y1")) & (F.col("y") <= F.col("y2"))
    return on.groupBy("photo", "box_no").agg(F.count_if(F.coalesce(inside, F.lit(False))).alias("inside"))


def cost(calls: DataFrame, price_in: float, price_out: float) -> DataFrame:
    """One row: tokens and their price of ``calls(tokens_in, tokens_out)``."""
    return calls.agg(F.sum("tokens_in").alias("tokens_in"), F.sum("tokens_out").alias("tokens_out"), F.round((F.sum("tokens_in") * price_in + F.sum("tokens_out") * price_out) / 1e6, 6).alias("cost"))


def contained_passages(docs: DataFrame, items: DataFrame) -> DataFrame:
    """``(doc_id, item_id)`` of documents that contain an item's whole text.

    A passage's second to fourth words stand between separators wherever it
    occurs, so an equi-join on three words in a row finds all candidates; whole
    texts are looked at for those alone.  Items of fewer than five words have
    no such key and are refused.
    """
    split = lambda text: F.filter(F.split(text, r"[ \t-\r]+", -1), lambda w: w != "")
    own = items.select("item_id", F.col("text").alias("passage"), split("text").alias("w"))
    if not own.where(F.size("w") < 5).isEmpty():
        raise ValueError("a passage of fewer than five words has no key")
    keyed = own.select("item_id", F.concat_ws(" ", F.slice("w", 2, 3)).alias("key"))
    lists = docs.select("doc_id", split("text").alias("w")).where(F.size("w") >= 3)
    windows = F.zip_with(F.zip_with(F.slice("w", 1, F.size("w") - 2), F.slice("w", 2, F.size("w") - 2), lambda a, b: F.concat(a, F.lit(" "), b)), F.slice("w", 3, F.size("w") - 2), lambda a, b: F.concat(a, F.lit(" "), b))
    found = lists.select("doc_id", F.explode(F.array_distinct(windows)).alias("key")).join(keyed, "key").select("doc_id", "item_id").distinct()
    texts = found.join(docs.select("doc_id", "text"), "doc_id").join(own.select("item_id", "passage"), "item_id")
    return texts.where(F.contains("text", F.col("passage"))).select("doc_id", "item_id")
