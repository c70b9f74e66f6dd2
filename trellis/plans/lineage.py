"""Lineage cuts that survive a lost executor."""

from __future__ import annotations

import re
import tempfile
import uuid
import weakref
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

_WRITTEN: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()


def shared_dir(spark: SparkSession) -> str:
    """Folder that the driver and all executors share.

    The cluster names it in ``spark.checkpoint.dir``.  Only where that is unset and all runs in one
    process (local tests) a temporary folder is made, and remembered in the session.
    """
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("trellis.scratch.dir", None)
    if path is None:
        if not re.match(r"local(\[|$)", spark.conf.get("spark.master", "local")):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="trellis-")
        spark.conf.set("trellis.scratch.dir", path)
    return path.rstrip("/")


#: Whether Spark deletes a run's shuffle files as it ends, which are otherwise kept until the driver collects garbage.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def _own_shuffles(spark: SparkSession) -> Iterator[None]:
    """What runs inside leaves no shuffle files: for writes, whose plans nothing else uses."""
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_CLEANUP)
        else:
            spark.conf.set(_CLEANUP, before)


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back.

    The result has no lineage beyond the written files, and claims no partitioning, so that a
    later join shuffles it afresh and adaptive execution can split its large partitions.
    Shuffle files of the write are deleted as it ends.
    """
    path = f"{shared_dir(df.sparkSession)}/cut-{uuid.uuid4().hex}"
    with _own_shuffles(df.sparkSession):
        df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    _WRITTEN[out] = path
    return out


def written(df: DataFrame) -> DataFrame:
    """``df`` if it is a written table already, else as ``cut``: for what is read several times."""
    return df if df in _WRITTEN else cut(df)


def cut_counted(df: DataFrame, *measures: Column) -> tuple[DataFrame, tuple]:
    """As ``cut``, and the values of aggregates over ``df``, which are taken while it is written."""
    seen = Observation()
    named = [m.alias(f"m{i}") for i, m in enumerate(measures)]
    out = cut(df.observe(seen, *named))
    values = seen.get
    return out, tuple(values[f"m{i}"] for i in range(len(named)))


def discard(*tables: DataFrame) -> None:
    """Delete what ``cut`` wrote for tables that nothing will read again."""
    for table in tables:
        path = _WRITTEN.pop(table, None)
        if path is not None:
            spark = table.sparkSession
            place = spark._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


class Pile:
    """A table in the shared folder that grows by parts, each written once."""

    def __init__(self, first: DataFrame):
        self.path, self.parts, self.schema, self.spark = f"{shared_dir(first.sparkSession)}/pile-{uuid.uuid4().hex}", 0, first.schema, first.sparkSession
        self.count = 0
        self.last = self.add(first)

    def add(self, more: DataFrame) -> DataFrame:
        """Write ``more``; the part as a table.  ``count`` is then its number of rows."""
        path, seen = f"{self.path}/part-{self.parts:06d}", Observation()
        with _own_shuffles(self.spark):
            more.select(*self.schema.names).observe(seen, F.count(F.lit(1)).alias("n")).write.parquet(path)
        self.parts, self.count = self.parts + 1, seen.get["n"]
        self.last = self.spark.read.schema(self.schema).parquet(path)
        return self.last

    def all(self) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(f"{self.path}/part-*")
