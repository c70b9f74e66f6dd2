"""Tables of keyed rows in hash buckets, kept by versions: a batch reads and writes the buckets it touches, and no others.

A folder holds ``data``, where each change writes the touched buckets anew under a name of its own, and ``versions``, one small file for
each version that says where every bucket lies.  A version exists once its file does, which is created only where there is none:
so a writer that loses a race fails, a writer that dies leaves nothing that is read, and earlier versions stay readable.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trellis.operators.symmetry import canonical
from trellis.plans.lineage import cut, discard


@dataclass
class Version:
    number: int = -1
    #: Folder and number of rows of every bucket that has any.
    buckets: dict[int, tuple[str, int]] = field(default_factory=dict)
    #: The last batch that each writer has brought in.
    batches: dict[str, int] = field(default_factory=dict)


class Store:
    """Rows with a key, of which the first one stays, in ``buckets`` folders by a hash of the columns ``by``.

    Keys hold no nulls; rows whose key has one are an error.
    """

    def __init__(self, spark: SparkSession, path: str, schema: str, key: list[str], by: list[str] | None = None, buckets: int = 64):
        self.spark, self.path, self.key, self.by, self.buckets = spark, path.rstrip("/"), key, by or key, buckets
        self.schema = T.StructType.fromDDL(schema)
        self._place = spark._jvm.org.apache.hadoop.fs.Path
        self._files = self._place(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    def _version_path(self, number: int):
        return self._place(f"{self.path}/versions/{number:09d}.json")

    def numbers(self) -> list[int]:
        """Versions that can be read, in order."""
        folder = self._place(f"{self.path}/versions")
        found = self._files.listStatus(folder) if self._files.exists(folder) else []
        return sorted(int(f.getPath().getName()[:-5]) for f in found if f.getPath().getName().endswith(".json"))

    def version(self, number: int | None = None) -> Version:
        """The version of a number, or the last one; that of an empty store has the number -1."""
        numbers = self.numbers()
        if number is None:
            number = numbers[-1] if numbers else -1
        if number == -1:
            return Version()
        if number not in numbers:
            raise ValueError(f"{self.path} has no version {number}")
        stream = self._files.open(self._version_path(number))
        try:
            said = json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()
        return Version(number, {int(b): (folder, rows) for b, (folder, rows) in said["buckets"].items()}, said["batches"])

    def _publish(self, version: Version) -> None:
        stream = self._files.create(self._version_path(version.number), False)  # an error where another writer was first
        try:
            stream.write(bytearray(json.dumps({"buckets": version.buckets, "batches": version.batches}).encode()))
        finally:
            stream.close()

    def _read(self, version: Version, some: list[int] | None = None) -> DataFrame:
        folders = [f"{self.path}/data/{folder}/bucket={b}" for b, (folder, _) in sorted(version.buckets.items()) if some is None or b in some]
        return self.spark.read.schema(self.schema).parquet(*folders) if folders else self.spark.createDataFrame([], self.schema)

    def read(self, number: int | None = None) -> DataFrame:
        return self._read(self.version(number))

    def _bucketed(self, rows: DataFrame) -> DataFrame:
        checked = [F.when(F.col(c).isNotNull(), F.col(c)).otherwise(F.raise_error(F.lit(f"a null {c}")).cast(rows.schema[c].dataType)).alias(c) if c in self.key else F.col(c) for c in self.schema.names]
        return rows.select(*checked).withColumn("bucket", F.pmod(F.xxhash64(*self.by), F.lit(self.buckets)).cast("int"))

    def probe(self, rows: DataFrame) -> DataFrame:
        """The stored rows whose keys ``rows`` has; only their buckets are read."""
        wanted = cut(self._bucketed_keys(rows))
        some = [r[0] for r in wanted.select("bucket").distinct().collect()]  # one number a bucket at most
        return self._read(self.version(), some).join(wanted.drop("bucket"), self.key, "left_semi")

    def _bucketed_keys(self, rows: DataFrame) -> DataFrame:
        return rows.select(*self.key).distinct().withColumn("bucket", F.pmod(F.xxhash64(*self.by), F.lit(self.buckets)).cast("int"))

    def apply(self, added: DataFrame, removed: DataFrame | None = None, batch: tuple[str, int] | None = None) -> Version:
        """Take out the keys of ``removed``, then bring in rows of ``added`` whose keys are not there.

        Of added rows with one key the smallest stays.  ``batch`` names a writer and its batch's number: one that this writer has brought in already changes
        nothing, so a batch may be replayed.  A batch that changes nothing makes no version, unless it has to be remembered.
        """
        now = self.version()
        if batch is not None and now.batches.get(batch[0], -1) >= batch[1]:
            return now
        rest = [c for c in self.schema.names if c not in self.key]
        fresh = cut(self._bucketed(added))
        gone = cut(self._bucketed_keys(removed)) if removed is not None else None
        met = fresh.select("bucket") if gone is None else fresh.select("bucket").union(gone.select("bucket"))
        touched = [r[0] for r in met.distinct().collect()]  # one number a bucket at most
        every = self._bucketed(self._read(now, touched)).withColumn("_rank", F.lit(0)).unionByName(fresh.withColumn("_rank", F.lit(1)))
        if gone is not None:
            every = every.unionByName(gone.withColumn("_rank", F.lit(-1)), allowMissingColumns=True)
        folder = uuid.uuid4().hex
        # All that has a key meets once, in one of the many shares of its bucket: so no task holds a large bucket whole.
        least = lambda rank: F.min(F.when(F.col("_rank") == rank, F.struct(F.lit(0), *rest) if rest else F.lit(0)))
        per = every.groupBy("bucket", *self.key).agg(F.min("_rank").alias("_first"), least(0).alias("_old"), least(1).alias("_new"))
        whole = per.withColumn("_row", F.when((F.col("_first") >= 0) & F.col("_old").isNotNull(), F.col("_old")).otherwise(F.col("_new"))).where("_row is not null")
        whole.select(*(c if c in self.key else F.col(f"_row.{c}") for c in self.schema.names), "bucket").write.partitionBy("bucket").parquet(f"{self.path}/data/{folder}")
        written = self.spark.read.schema(T.StructType([*self.schema.fields, T.StructField("bucket", T.IntegerType())])).parquet(f"{self.path}/data/{folder}")
        counts = {r[0]: r[1] for r in written.groupBy("bucket").count().collect()}
        discard(fresh, *([gone] if gone is not None else []))
        before = {b: now.buckets[b][1] for b in touched if b in now.buckets}
        if counts == before and gone is None and batch is None:
            return now  # nothing was new
        buckets = {b: place for b, place in now.buckets.items() if b not in touched} | {b: (folder, n) for b, n in counts.items()}
        made = Version(now.number + 1, buckets, now.batches | ({batch[0]: batch[1]} if batch else {}))
        self._publish(made)
        return made

    def changes(self, since: int, until: int | None = None) -> tuple[DataFrame, DataFrame]:
        """Rows that were added and removed between two versions; only buckets that lie elsewhere are read."""
        old, new = self.version(since), self.version(until)
        moved = [b for b in {*old.buckets, *new.buckets} if old.buckets.get(b) != new.buckets.get(b)]
        before, after = self._read(old, moved), self._read(new, moved)
        if not {*moved} & {*old.buckets}:
            return after, before
        # Keys, and so rows, are different within a version: what is left of both sides together is on one alone.
        sides = before.withColumn("_side", F.lit(-1)).unionByName(after.withColumn("_side", F.lit(1))).groupBy(*self.schema.names).agg(F.sum("_side").alias("_side"))
        changed = cut(sides.where("_side <> 0"))
        return changed.where("_side > 0").drop("_side"), changed.where("_side < 0").drop("_side")

    def vacuum(self, keep: int = 2) -> list[int]:
        """Forget all but the last ``keep`` versions, with the folders that no other version names; the forgotten numbers."""
        numbers = self.numbers()
        old, left = numbers[:-keep], numbers[-keep:]
        used = {folder for n in left for folder, _ in self.version(n).buckets.values()}
        named = {folder for n in old for folder, _ in self.version(n).buckets.values()}
        for n in old:
            self._files.delete(self._version_path(n), False)
        for folder in named - used:
            self._files.delete(self._place(f"{self.path}/data/{folder}"), True)
        return old


def relation_store(spark: SparkSession, path: str, buckets: int = 64, by: str = "elem", schema: str = "elem long, node long") -> Store:
    """A stored relation of ``elem, node``, in buckets of whole elements (or, by ``node``, of whole nodes)."""
    return Store(spark, path, schema, ["elem", "node"], [by], buckets)


def refresh_transpose(relation: Store, transposed: Store) -> Version:
    """Bring ``transposed``, the same pairs by node, up to the relation's version; buckets of nodes that did not change stay."""
    now = relation.version().number
    have = transposed.version().batches.get("relation", -1)
    if have >= now:
        return transposed.version()
    added, removed = relation.changes(have, now)
    return transposed.apply(added, removed, ("relation", now))


class CanonicalIndex:
    """Which element first had a row, up to a group of symmetries; the index is probed and appended to, never built again."""

    def __init__(self, spark: SparkSession, path: str, group: list[tuple[int, ...]], buckets: int = 64):
        self.group = group
        self.store = Store(spark, path, "nodes array<long>, elem long", ["nodes"], None, buckets)

    def _canonical(self, rows: DataFrame) -> DataFrame:
        return rows.select("elem", canonical("nodes", self.group).alias("nodes"))

    def find(self, rows: DataFrame) -> DataFrame:
        """``elem, first``: the stored element of each row's class, null where there is none."""
        probes = cut(self._canonical(rows))
        known = self.store.probe(probes).select("nodes", F.col("elem").alias("first"))
        return probes.join(known, "nodes", "left").select("elem", "first")

    def add(self, rows: DataFrame, batch: tuple[str, int] | None = None) -> DataFrame:
        """Bring in the classes that are not there, each by its smallest element; ``elem, first`` of all ``rows`` after that."""
        self.store.apply(self._canonical(rows), batch=batch)
        return self.find(rows)
