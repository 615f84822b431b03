"""Shard placement by a permutation-filled lookup table.

Every shard prefers the table's slots in an order of its own: ``offset + k *
skip`` modulo the table's size, which is a prime, so that the order is a
permutation.  The shards take turns; each claims the first slot in its order
that is free, until none is.  A weight of ``w`` is ``w`` turns a round.
Shards so get equal shares but for one slot, and adding or removing a shard
moves few slots besides those that must move.  A key's slot is its hash modulo
the table's size, and the slot's shard is read from the broadcast table, whose
size is a parameter.

Only the table itself, which no data enters, is filled on the driver.

Edge cases: a null key hashes as the empty string.  Equal keys go to one
shard.  With no shards there is nowhere to place and an error is raised.  An
empty table gives no rows.  Other columns, of any name, are passed through; the
new columns replace any of the same name but the key, beside which they are
called ``slot_`` or ``shard_``.
"""

from __future__ import annotations

import hashlib
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._shared import fresh


def _is_prime(n: int) -> bool:
    return n > 1 and all(n % d for d in range(2, int(n**0.5) + 1))


def prime_from(n: int) -> int:
    """The least prime of at least ``n``."""
    while not _is_prime(n):
        n += 1
    return n


def _number(text: str) -> int:
    """The first 60 bits of the text's MD5."""
    return int(hashlib.md5(text.encode()).hexdigest()[:15], 16)


@dataclass(frozen=True)
class ShardConfig:
    shards: Sequence[str] = tuple(f"shard-{k:03d}" for k in range(64))
    #: Slots; a prime, and a hundred times the shards or more, for shares within a per cent.
    slots: int = 6421
    #: Turns a round of shards that take more than one.
    weights: Mapping[str, int] = field(default_factory=dict)


def fill(config: ShardConfig) -> list[int]:
    """The shard's number for each slot."""
    m, names = config.slots, sorted(set(config.shards))
    if not names:
        raise ValueError("there are no shards")
    if not _is_prime(m) or m < len(names):
        raise ValueError("the number of slots must be a prime and no less than the shards'")
    at = [_number(f"{n}#offset") % m for n in names]
    skip = [_number(f"{n}#skip") % (m - 1) + 1 for n in names]
    table, free = [-1] * m, m
    while True:
        for k, name in enumerate(names):
            for _ in range(max(1, config.weights.get(name, 1))):
                while table[at[k]] >= 0:
                    at[k] = (at[k] + skip[k]) % m
                table[at[k]] = k
                free -= 1
                if not free:
                    return table


def lookup_table(spark: SparkSession, config: ShardConfig) -> DataFrame:
    """``(slot, shard)``, one row a slot."""
    names = sorted(set(config.shards))
    return spark.createDataFrame([(slot, names[k]) for slot, k in enumerate(fill(config))], "slot int, shard string")


def slot_of(key: Column, slots: int) -> Column:
    """A key's slot: the first 60 bits of its MD5, modulo the number of slots."""
    return (F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit("")).cast("binary")), 1, 15), 16, 10).cast("long") % slots).cast("int")


def place(rows: DataFrame, key: str, config: ShardConfig = ShardConfig()) -> DataFrame:
    """``rows`` with ``slot`` and ``shard``; no shuffle, the table is broadcast."""
    at, to, own = fresh(rows, "_at"), fresh(rows, "_to"), fresh(rows, "_slot")
    table = lookup_table(rows.sparkSession, config).toDF(at, to)  # a row a slot
    placed = rows.withColumn(own, slot_of(F.col(key), config.slots)).join(F.broadcast(table), F.col(own) == F.col(at), "left")
    keep = [F.col(c) for c in rows.columns if c.lower() not in ("slot", "shard") or c == key]
    named = {own: "slot", to: "shard"}
    return placed.select(*keep, *[F.col(c).alias(fresh_for(key, n)) for c, n in named.items()])


def fresh_for(key: str, name: str) -> str:
    """``name``, or with an underscore where the key column has that name."""
    return name + "_" if key.lower() == name else name


def shard_sizes(placed: DataFrame, size: Column) -> DataFrame:
    """``(shard, n_rows, total)``: rows and the sum of ``size`` in each shard."""
    return placed.groupBy("shard").agg(F.count("*").alias("n_rows"), F.sum(size).alias("total"))
