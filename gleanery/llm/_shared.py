"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(df: DataFrame, base: str) -> str:
    """A column name that ``df`` does not have, whatever the case."""
    taken = {c.lower() for c in df.columns}
    while base.lower() in taken:
        base += "_"
    return base


def shared_folder(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: the cluster's ``spark.checkpoint.dir``.

    Only in local mode, where one machine runs everything, may it be unset; a
    folder of that machine then takes its place.
    """
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if at:
        return at
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return f"file://{tempfile.gettempdir()}/gleanery-checkpoints"


def _remove(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    if jvm is None:
        return
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


class Scratch:
    """Intermediate tables, written to the shared folder so that lineage ends there.

    Losing executors loses nothing that was put here.  Tables go when
    :meth:`drop` is called or when the application ends.
    """

    def __init__(self, spark: SparkSession):
        self.spark, self.root = spark, f"{shared_folder(spark)}/gleanery-{uuid.uuid4().hex}"
        atexit.register(self._close)

    def put(self, df: DataFrame, name: str) -> DataFrame:
        """``df`` as a table.  Spark deletes the shuffle files behind it once the driver finds
        that nothing holds their plan, so the driver's heap is collected here; otherwise a chain
        of tables keeps the files of all its links."""
        path = f"{self.root}/{name}"
        df.write.mode("overwrite").parquet(path)
        self.spark.sparkContext._jvm.System.gc()
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        """Removes tables; all of them if none is named."""
        for path in [f"{self.root}/{n}" for n in names] or [self.root]:
            _remove(self.spark, path)

    def _close(self) -> None:
        try:
            _remove(self.spark, self.root)
        except Exception:  # the JVM may be gone by then
            pass


def append_struct(docs: DataFrame, text: str, name: str, fields: T.StructType, kernel: Callable[[pa.Array], pa.StructArray]) -> DataFrame:
    """All columns of ``docs`` and a struct column, computed from ``text`` by batches."""
    where = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, kernel(b.column(where))], names=[*b.schema.names, name])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(name, fields)]))


#: The most ids that are broadcast: 16 MB of them, some 140 MB as the hash table that a join builds.
BROADCAST_IDS = 2_000_000


def without_ids(docs: DataFrame, key: str, gone: DataFrame, scratch: Scratch) -> DataFrame:
    """The rows of ``docs`` whose ``key`` is not among the single column of ``gone``.

    The ids are counted first: few are broadcast, more are hashed and shuffled with the rows.
    """
    name = fresh(docs, "_gone")
    ids = scratch.put(gone.toDF(name).where(F.col(name).isNotNull()).distinct(), "gone")
    few = ids.count() <= BROADCAST_IDS
    return docs.join(F.broadcast(ids) if few else ids.hint("shuffle_hash"), F.col(key) == F.col(name), "left_anti")
