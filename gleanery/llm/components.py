"""Connected components of a link table, without collecting it anywhere."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import Scratch


def connected_components(links: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """``(id, component)`` of every id in ``links(a, b)``; a component's name is its least id.

    Each round takes the least name among an id and its neighbours, then the
    name's own name, so that names travel in leaps.  Every round is written to
    the shared folder, where lineage ends.
    """
    both = scratch.put(links.select("a", "b").union(links.select("b", "a")).distinct(), f"{name}-both")
    now = scratch.put(both.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("m")).select("id", F.least("id", "m").alias("component")), f"{name}-0")
    step = 0
    while True:
        near = both.join(now, both.b == now.id).groupBy("a").agg(F.min("component").alias("near"))
        nearer = scratch.put(now.join(near, now.id == near.a).select("id", F.least("component", "near").alias("component"), F.col("component").alias("was")), f"{name}-near")
        above = nearer.select(F.col("id").alias("component"), F.col("component").alias("above"))
        step += 1
        new = scratch.put(nearer.join(above, "component").select("id", F.col("above").alias("component"), (F.col("above") != F.col("was")).alias("moved")), f"{name}-{step}")
        done = new.where("moved").isEmpty()
        for old in (f"{name}-{step - 1}", f"{name}-near", *([f"{name}-both"] if done else [])):
            scratch.drop(old)
        if done:
            return new.select("id", "component")
        now = new.select("id", "component")
