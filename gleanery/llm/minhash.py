"""Near-duplicate groups by fast similarity sketching, banding and exact checks.

A text's set holds the hashes (64 bits) of its windows of ``shingle`` words,
ASCII letters lower-cased.  Its sketch has ``bands * rows`` coordinates.  In
round ``i`` every element falls into a bin by a hash of its own for that
round, and bins that no earlier round filled take the least value; from round
``t`` on every element falls into bin ``i - t``, so that after ``2 t`` rounds
every coordinate is filled, whatever the set's size, and two sets agree in a
coordinate with a probability of their Jaccard similarity.  ``bands`` and
``rows`` follow from the threshold: a pair that just reaches it shares no band
with a probability below :data:`MISS`.

Equal sets form one class.  Within the buckets of equal bands, classes are
compared with one pivot first, their links joined into components, and what
the components leave open is compared with other pivots.  What then remains
open, members outside their bucket's largest component, is compared with every
member of the bucket in another component.  So no pair that could join two
components goes unchecked, though a group of copies costs about as many
comparisons as it has members.  Every link is confirmed on the full sets.

Edge cases: null, empty and word-less texts have an empty set, are linked with
nothing and are kept.  Rows with a null id are linked with nothing, have a null
component and are kept.  Rows that repeat an id are kept or dropped together,
by the components of their texts.  An empty table gives no rows.  Other
columns are ignored by :func:`near_duplicates` and passed through by
:func:`drop_near_duplicates`.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import Scratch, without_ids
from .components import connected_components
from .textkernel import Chunk, chunks, mix64

#: Largest probability that a pair at the threshold shares no band.
MISS = 1e-6
#: Bands that are enough where a threshold leaves a choice; low thresholds take more.
BANDS = 36
#: Rounds with other pivots before members are compared one by one.
PIVOT_ROUNDS = 2
#: Texts and elements in one part of a large group.
PART_TEXTS = 128
PART_ELEMENTS = 20_000


@dataclass(frozen=True)
class NearConfig:
    shingle: int = 5
    #: Least Jaccard similarity of a link, in per cent.
    percent: int = 80

    @property
    def shape(self) -> tuple[int, int]:
        """Bands and rows: the most rows that need no more than :data:`BANDS`, or one row and the bands it takes."""
        if not 0 < self.percent <= 100:
            raise ValueError("a link's least similarity must be above 0 and at most 100 per cent")
        need = lambda r: 1 if self.percent == 100 else math.ceil(math.log(MISS) / math.log1p(-((self.percent / 100) ** r)))
        rows = max((r for r in range(1, 13) if need(r) <= BANDS), default=1)
        return need(rows), rows


def element_sets(chunk: Chunk, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes and their texts, sorted by text and hash."""
    windows, owner = chunk.shingles(k)
    order = np.lexsort((windows, owner))
    windows, owner = windows[order], owner[order]
    new = np.ones(len(windows), bool)
    new[1:] = (windows[1:] != windows[:-1]) | (owner[1:] != owner[:-1])
    return windows[new], owner[new]


def fast_similarity_sketch(elements: np.ndarray, owner: np.ndarray, n: int, t: int) -> np.ndarray:
    """``n`` rows of ``t`` coordinates; rows without elements hold the largest value."""
    if t > 500:
        raise ValueError("a coordinate holds the number of its round in ten bits: thresholds below 3 per cent need more")
    top = np.uint64(0xFFFFFFFFFFFFFFFF)
    values = np.full(n * t, top, np.uint64)
    fraction = np.uint64((1 << 54) - 1)
    x, of = elements, owner.astype(np.int64)
    for i in range(2 * t):
        if not len(x):
            break
        z = mix64(x, i + 1)
        place = (mix64(z, 7) % np.uint64(t)).astype(np.int64) if i < t else np.int64(i - t)
        at = of * t + place
        open_ = values[at] == top
        at, z = at[open_], z[open_]
        np.minimum.at(values, at, np.uint64(i << 54) | (z & fraction))
        unfilled = (values.reshape(n, t) == top).any(axis=1)
        stay = unfilled[of]
        x, of = x[stay], of[stay]
    return values.reshape(n, t)


def band_keys(sketch: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One 64-bit key for each row and band."""
    parts = sketch.reshape(len(sketch), bands, rows)
    acc = np.full((len(sketch), bands), 0, np.uint64) + np.arange(1, bands + 1, dtype=np.uint64)
    for r in range(rows):
        acc = mix64(acc * np.uint64(0xD6E8FEB86659FD93) + parts[:, :, r], 3)
    return acc.view(np.int64)


def _per_text(values: np.ndarray, owner: np.ndarray, n: int, seed: int) -> np.ndarray:
    """Sums of mixed hashes, modulo 2**64, per text."""
    total = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(mix64(values, seed), out=total[1:])
    ends = np.searchsorted(owner, np.arange(n + 1))
    return (total[ends[1:]] - total[ends[:-1]]).view(np.int64)


def sketches(docs: DataFrame, config: NearConfig) -> DataFrame:
    """``doc_id``, ``n`` (set size), ``d1, d2`` (128-bit digest of the set), ``bands``."""
    bands, rows = config.shape
    k = config.shingle

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row, chunk in chunks(b.column(1), lower=True):
                n = chunk.n
                elements, owner = element_sets(chunk, k)
                sizes = np.bincount(owner, minlength=n)
                keys = band_keys(fast_similarity_sketch(elements, owner, n, bands * rows), bands, rows)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * bands), pa.array(keys.reshape(-1)))
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(row, n), pa.array(sizes, pa.int64()), pa.array(_per_text(elements, owner, n, 11)), pa.array(_per_text(elements, owner, n, 12)), lists],
                    names=["doc_id", "n", "d1", "d2", "bands"],
                )

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n long, d1 long, d2 long, bands array<long>")


def full_sets(docs: DataFrame, ids: DataFrame, config: NearConfig) -> DataFrame:
    """``(id, elements)``: the full sets of the documents whose ``id`` is in ``ids``."""
    k = config.shingle
    texts = docs.select("doc_id", "text").join(ids.hint("shuffle_hash"), docs.doc_id == ids.id, "left_semi")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row, chunk in chunks(b.column(1), lower=True):
                elements, owner = element_sets(chunk, k)
                ends = np.concatenate(([0], np.cumsum(np.bincount(owner, minlength=chunk.n)))).astype(np.int32)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(row, chunk.n), pa.ListArray.from_arrays(pa.array(ends), pa.array(elements.view(np.int64)))], names=["id", "elements"])

    return texts.mapInArrow(run, "id long, elements array<long>")


class _Part:
    """Members of a group, from an Arrow list of (rep, component, minor, codes)."""

    def __init__(self, rows: pa.StructArray):
        self.rep = rows.field("rep").to_numpy(zero_copy_only=False)
        self.component = rows.field("component").to_numpy(zero_copy_only=False)
        self.minor = rows.field("minor").to_numpy(zero_copy_only=False).astype(bool)
        codes = rows.field("codes")
        self.sizes = codes.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        self.codes = codes.flatten().to_numpy(zero_copy_only=False)
        self.owner = np.repeat(np.arange(len(self.rep)), self.sizes)
        distinct = np.unique((self.owner << 32) + (self.codes.astype(np.int64) + (1 << 31))) >> 32
        #: Elements of each set that share their code with another of it.
        self.collapsed = self.sizes - np.bincount(distinct, minlength=len(self.rep))


def shared_counts(x: _Part, y: _Part) -> np.ndarray:
    """Sizes of all intersections between two parts' sets."""
    both = np.intersect1d(x.codes, y.codes)
    out = np.zeros((len(x.rep), len(y.rep)), np.float32)
    for at in range(0, len(both), 8192):
        some = both[at : at + 8192]
        grids = []
        for p in (x, y):
            place = np.minimum(np.searchsorted(some, p.codes), len(some) - 1)
            hit = some[place] == p.codes
            grid = np.zeros((len(p.rep), len(some)), np.float32)
            grid[p.owner[hit], place[hit]] = 1
            grids.append(grid)
        out += grids[0] @ grids[1].T
    return out


def compare_parts(x: _Part, y: _Part, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs that reach the threshold, across components; two outside the largest one come up once."""
    both = shared_counts(x, y) + np.minimum(x.collapsed[:, None], y.collapsed[None, :])  # no less than the sets share
    reach = 100 * both >= percent * (x.sizes[:, None] + y.sizes[None, :] - both)
    reach &= x.component[:, None] != y.component[None, :]
    reach &= ~y.minor[None, :] | (x.rep[:, None] < y.rep[None, :])
    i, j = np.nonzero(reach)
    return x.rep[i], y.rep[j]


class _Linker:
    """Finds the links among classes that share a bucket."""

    def __init__(self, docs: DataFrame, config: NearConfig, scratch: Scratch):
        self.config, self.scratch = config, scratch
        sketched = scratch.put(sketches(docs, config), "sketches")
        self.rows = scratch.put(sketched.drop("bands"), "rows")
        own = sketched.where("n > 0 and doc_id is not null")
        banded = scratch.put(own.groupBy("d1", "d2", "n").agg(F.min("doc_id").alias("rep"), F.first("bands").alias("bands")), "banded")
        self.classes = scratch.put(banded.drop("bands"), "classes")
        scratch.drop("sketches")
        each = banded.select("rep", "n", F.explode("bands").alias("key"))
        # In a bucket, the least id is the first pivot: mostly the same one in all buckets of a group.
        shared = each.groupBy("key").agg(F.count("*").alias("c"), F.min("rep").alias("pivot"), F.min_by("n", "rep").alias("pivot_n")).where("c > 1").drop("c")
        self.members = scratch.put(each.join(shared, "key"), "members")
        scratch.drop("banded")
        self.sets = scratch.put(full_sets(docs, self.members.select(F.col("rep").alias("id")).distinct(), config), "sets")
        self.checked: DataFrame | None = None
        self.components: DataFrame | None = None

    def sizes_fit(self, x: str, y: str) -> F.Column:
        return 100 * F.least(x, y) >= self.config.percent * F.greatest(x, y)

    def confirm(self, pairs: DataFrame, name: str) -> DataFrame:
        """``(a, b, linked)`` for the distinct ones of ``pairs(a, b)`` that were not checked before."""
        pairs = pairs.distinct()
        if self.checked is not None:
            pairs = pairs.join(self.checked.select("a", "b"), ["a", "b"], "left_anti")
        left, right = self.sets.toDF("a", "left"), self.sets.toDF("b", "right")
        both = F.size(F.array_intersect("left", "right"))
        linked = 100 * both >= self.config.percent * (F.size("left") + F.size("right") - both)
        out = pairs.join(left, "a").join(right, "b").select("a", "b", linked.alias("linked"))
        out = self.scratch.put(out, f"checked-{name}")
        self.checked = out if self.checked is None else self.checked.union(out)
        return out.where("linked")

    def merge(self, links: DataFrame, name: str) -> None:
        """Takes ``links`` into the components."""
        if self.components is None:
            self.components = connected_components(links, self.scratch, f"components-{name}")
            return
        c = self.components
        a, b = c.toDF("a", "ca"), c.toDF("b", "cb")
        between = links.join(a, "a", "left").join(b, "b", "left").select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b"))
        between = self.scratch.put(between.where("a <> b").distinct(), f"between-{name}")
        if between.isEmpty():
            return
        over = connected_components(between, self.scratch, f"components-{name}").toDF("component", "over")
        known = c.join(over, "component", "left").select("id", F.coalesce("over", "component").alias("component"))
        alone = over.join(c.select(F.col("id").alias("component")), "component", "left_anti").select(F.col("component").alias("id"), F.col("over").alias("component"))
        self.components = self.scratch.put(known.union(alone), f"merged-{name}")

    def named(self, group: str, name: str) -> DataFrame | None:
        """Members of the groups that hold several components: ``(g, rep, n, component, largest, texts, elements)``.

        A group is a bucket (``group`` is "key"), or what shares a bucket with one pivot ("pivot").
        """
        rows = self.members.select(F.col(group).alias("g"), "rep", "n").distinct()
        rows = rows.join(self.components.withColumnRenamed("id", "rep"), "rep", "left").withColumn("component", F.coalesce("component", "rep"))
        rows = self.scratch.put(rows, f"named-{name}")
        counts = rows.groupBy("g", "component").agg(F.count("*").alias("c"), F.sum("n").alias("e"))
        groups = counts.groupBy("g").agg(F.count("*").alias("several"), F.max_by("component", F.struct("c", F.negative("component"))).alias("largest"), F.sum("c").alias("texts"), F.sum("e").alias("elements"))
        # Written, so that the join reads both sides from exchanges and can split a large group.
        groups = self.scratch.put(groups.where("several > 1").drop("several"), f"groups-{name}")
        return None if groups.isEmpty() else rows.join(groups, "g")

    def other_pivots(self, name: str) -> bool:
        """Compares members outside their bucket's largest component with another of its members."""
        found = self.named("key", name)
        if found is None:
            return False
        members = self.scratch.put(found.select("g", "rep", "n", "component", "largest"), f"open-{name}")
        order = F.xxhash64("rep", "g", F.lit(name))
        pivots = members.where("component = largest").groupBy("g").agg(F.min_by("rep", order).alias("pivot"), F.min_by("n", order).alias("pivot_n"))
        pivots = self.scratch.put(pivots, f"others-{name}")
        pairs = members.where("component <> largest").join(pivots, "g").where(self.sizes_fit("n", "pivot_n")).select(F.least("rep", "pivot").alias("a"), F.greatest("rep", "pivot").alias("b"))
        links = self.confirm(pairs, name)
        if links.isEmpty():
            return False
        self.merge(links, name)
        return True

    def the_rest(self) -> None:
        """Compares every member outside its group's largest component with the group's members in other components.

        The members of a group are packed into parts of bounded size, and the
        parts compared two by two: a row for two parts, and one for each link,
        are all that comes of a group, and no task holds more than two parts.
        Elements are cut to 32 bits there, and what that takes from a set is
        added to what it shares, which is then never less than the truth; what
        passes is confirmed on the full sets.
        """
        found = self.named("pivot", "rest")
        if found is None:
            return
        codes = self.sets.select(F.col("id").alias("rep"), F.transform("elements", lambda e: (e % 2147483647).cast("int")).alias("codes"))
        parts = lambda t, e: F.greatest(F.ceil(t / PART_TEXTS), F.ceil(e / PART_ELEMENTS)).cast("int")
        # A group of two was compared when its pivot was.
        rows = found.where("texts > 2").withColumn("parts", parts(F.col("texts"), F.col("elements")))
        rows = rows.withColumn("part", F.pmod(F.xxhash64("rep"), "parts").cast("int")).withColumn("minor", F.col("component") != F.col("largest"))
        rows = rows.join(codes, "rep").select("g", "part", "parts", "minor", F.struct("rep", "component", "minor", "codes").alias("one"))
        pack = lambda df: df.groupBy("g", "part", "parts").agg(F.collect_list("one").alias("all"))
        every = F.sequence(F.lit(0), F.col("parts") - 1)
        x = pack(rows.where("minor")).select("g", F.col("part").alias("i"), F.explode(every).alias("j"), F.col("all").alias("x"))
        y = pack(rows).select("g", F.col("part").alias("j"), F.explode(every).alias("i"), F.col("all").alias("y"))
        percent = self.config.percent

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for k in range(b.num_rows):
                    left, right = compare_parts(_Part(b.column(0)[k].values), _Part(b.column(1)[k].values), percent)
                    if len(left):
                        yield pa.RecordBatch.from_arrays([pa.array(np.minimum(left, right)), pa.array(np.maximum(left, right))], names=["a", "b"])

        self.merge(self.confirm(x.join(y, ["g", "i", "j"]).select("x", "y").mapInArrow(run, "a long, b long"), "rest"), "rest")

    def run(self) -> DataFrame:
        """``(id, component)`` of the classes with links."""
        fit = self.members.where(F.col("rep") != F.col("pivot")).where(self.sizes_fit("n", "pivot_n"))
        self.merge(self.confirm(fit.select(F.col("pivot").alias("a"), F.col("rep").alias("b")), "first"), "first")
        for k in range(PIVOT_ROUNDS):
            if not self.other_pivots(f"pivots{k}"):
                break
        self.the_rest()
        self.scratch.drop("members", "sets")
        return self.components


def near_duplicates(docs: DataFrame, config: NearConfig = NearConfig()) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept``, one row for each row of ``docs``."""
    return _near_duplicates(docs, config, Scratch(docs.sparkSession))


def _near_duplicates(docs: DataFrame, config: NearConfig, scratch: Scratch) -> DataFrame:
    linker = _Linker(docs, config, scratch)
    components = linker.run().withColumnRenamed("id", "rep")
    named = linker.classes.select("d1", "d2", "n", "rep").join(components, "rep", "left").select("d1", "d2", F.col("n").alias("cn"), F.coalesce("component", "rep").alias("component"))
    rows = linker.rows.select("doc_id", "n", "d1", "d2")
    own = F.when(F.col("doc_id").isNull(), F.lit(None)).otherwise(F.coalesce("component", "doc_id"))
    out = rows.join(named, (rows.d1 == named.d1) & (rows.d2 == named.d2) & (rows.n == named.cn), "left").select("doc_id", F.col("n").alias("n_shingles"), own.alias("component_id"))
    return out.withColumn("kept", F.col("component_id").isNull() | (F.col("doc_id") == F.col("component_id")))


def drop_near_duplicates(docs: DataFrame, config: NearConfig = NearConfig()) -> DataFrame:
    """The rows of ``docs``, with their columns, but for those that are near copies of a kept one."""
    working, kept = Scratch(docs.sparkSession), Scratch(docs.sparkSession)
    gone = kept.put(_near_duplicates(docs, config, working).where("not kept").select("doc_id"), "dropped")
    working.drop()
    return without_ids(docs, "doc_id", gone, kept)
