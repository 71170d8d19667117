"""Versioned table output.

A new version of a table goes to folders of its own and becomes current when its file is created in the small version
list, so readers never see half a table and a failed job leaves the old version in place. The file is created by an
exclusive call of the file system: of two writers of one version the second fails there.

:class:`VersionedTable` writes whole tables. :class:`KeyedTable` keeps the rows of a key in one of many buckets; a change
reads and writes the buckets of its keys alone, and a version lists which folder holds each bucket.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def existing(spark: SparkSession, paths: Sequence[str]) -> list[str]:
    """Those of the paths that there are, in whatever store they lie."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    found = []
    for name in paths:
        path = jvm.org.apache.hadoop.fs.Path(name)
        if path.getFileSystem(conf).exists(path):
            found.append(name)
    return found


class ConstraintError(ValueError):
    """Rows that a table may not hold; nothing was published."""


class VersionList:
    """The versions of a table: one small file each, named by its number."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def _path(self, name: str = ""):
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}" if name else self.folder)
        return path, path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def numbers(self) -> list[int]:
        path, fs = self._path()
        if not fs.exists(path):
            return []
        names = (s.getPath().getName() for s in fs.listStatus(path))
        return sorted(int(n) for n in names if n.isdigit())

    def read(self, number: int) -> list[dict]:
        path, _ = self._path(str(number))
        return [json.loads(r.value) for r in self.spark.read.text(path.toString()).collect()]

    def latest(self) -> tuple[int, list[dict]] | None:
        """The newest version whose file is complete; one that is claimed but not written yet is no version."""
        for number in reversed(self.numbers()):
            rows = self.read(number)
            if rows and "end" in rows[-1]:
                return number, rows[:-1]
        return None

    def claim(self, number: int, rows: list[dict]) -> None:
        """Create the version's file; fails if there is one."""
        path, fs = self._path(str(number))
        out = fs.create(path, False)
        try:
            out.write("".join(json.dumps(r) + "\n" for r in [*rows, {"end": True}]).encode())
        finally:
            out.close()


def checked(df: DataFrame, unique: Sequence[str] = (), not_null: Sequence[str] = ()) -> tuple[DataFrame, Callable[[], None]]:
    """``df`` with its constraints counted while it is written, and a call that raises what the write has found.

    Rows of one key are numbered where they lie together anyway, in the partition that writes them; nothing is scanned a
    second time. NULL keys are no duplicates of each other.
    """
    if not unique and not not_null:
        return df, lambda: None
    seen = Observation(f"constraints-{uuid.uuid4().hex}")
    repeated: Column = F.lit(False)
    if unique:
        number = F.row_number().over(Window.partitionBy(*unique).orderBy(*unique))
        df = df.withColumn("_number", number)
        repeated = (F.col("_number") > 1) & F.concat(*[F.col(c).cast("string") for c in unique]).isNotNull()
    counts = [F.count_if(repeated).alias("repeated"), *[F.count_if(F.col(c).isNull()).alias(f"null {c}") for c in not_null]]
    watched = df.observe(seen, *counts).drop("_number")

    def test() -> None:
        wrong = {k: v for k, v in seen.get.items() if v}
        if wrong:
            raise ConstraintError(f"{wrong} (unique: {', '.join(unique) or 'none'})")

    return watched, test


class VersionedTable:
    """A table of which every version is written whole."""

    def __init__(self, spark: SparkSession, root: str, schema: StructType | str | None = None):
        self.spark, self.root, self.schema = spark, root.rstrip("/"), schema
        self.versions = VersionList(spark, f"{self.root}/versions")

    def latest(self) -> tuple[int, str] | None:
        found = self.versions.latest()
        return (found[0], found[1][0]["folder"]) if found else None

    def read(self) -> DataFrame:
        """The current version; an empty table of the given schema before the first one."""
        latest = self.latest()
        if latest is None:
            if self.schema is None:
                raise ValueError(f"no version of {self.root} yet, and no schema given")
            return self.spark.createDataFrame([], self.schema)
        reader = self.spark.read.schema(self.schema) if self.schema is not None else self.spark.read
        return reader.parquet(f"{self.root}/{latest[1]}")

    def publish(self, df: DataFrame, partition_by: Sequence[str] = (), unique: Sequence[str] = (), not_null: Sequence[str] = ()) -> int:
        """Write the next version, then make it current.

        Rows that repeat ``unique`` or lack a column of ``not_null`` are counted in the same pass; if there are any, a
        ConstraintError is raised and the old version stays. The folder of a version that failed stays unused.
        """
        latest = self.latest()
        version = (latest[0] if latest else 0) + 1
        folder = f"v{version}-{uuid.uuid4().hex[:8]}"
        rows, test = checked(df, unique, not_null)
        rows.write.partitionBy(*partition_by).parquet(f"{self.root}/{folder}")
        test()
        self.versions.claim(version, [{"folder": folder}])
        return version


class KeyedTable:
    """A table in ``buckets`` by a hash of its key columns, of which a change rewrites only the buckets it touches.

    A version is a list of (bucket, folder), at most one per bucket. Where a key lies follows from the key, so a change
    of n keys reads and writes n buckets at most, whatever the table holds, and readers of the version before keep its
    files. Choose ``buckets`` so that one fits a task.
    """

    def __init__(self, spark: SparkSession, root: str, schema: StructType | str, keys: Sequence[str], buckets: int = 64, unique: bool = True):
        self.spark, self.root, self.keys, self.buckets, self.unique = spark, root.rstrip("/"), list(keys), buckets, unique
        self.schema = spark.createDataFrame([], schema).schema
        self.versions = VersionList(spark, f"{self.root}/versions")

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")

    def _read(self, manifest: dict[int, str], wanted: Sequence[int] | None = None) -> DataFrame:
        kept = [f"{self.root}/{folder}/_bucket={b}" for b, folder in sorted(manifest.items()) if wanted is None or b in wanted]
        if not kept:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*kept)

    def latest(self) -> tuple[int, dict[int, str]]:
        found = self.versions.latest()
        return (found[0], {r["bucket"]: r["folder"] for r in found[1]}) if found else (0, {})

    def read(self, version: int | None = None) -> DataFrame:
        """The current version, or an older one; an empty table before the first."""
        if version is None:
            return self._read(self.latest()[1])
        return self._read({r["bucket"]: r["folder"] for r in self.versions.read(version) if "bucket" in r})

    def buckets_of(self, keys: DataFrame) -> list[int]:
        """The buckets that hold the given keys, at most as many as there are."""
        return sorted(r[0] for r in keys.select(self._bucket().alias("b")).distinct().collect())

    def lookup(self, keys: DataFrame) -> DataFrame:
        """The rows of some keys, from their buckets alone."""
        return self._read(self.latest()[1], self.buckets_of(keys)).join(keys.select(*self.keys).distinct(), self.keys, "left_semi")

    def change(self, changes: DataFrame, apply: Callable[[DataFrame, DataFrame], DataFrame], not_null: Sequence[str] = ()) -> int:
        """Publish ``apply(rows, changes)`` in place of the buckets that the keys of ``changes`` lie in.

        ``apply`` is a function of :mod:`papyrine.operators.upsert` or of its kind: it gets the current rows of those
        buckets and returns what they become. It must neither move a row to another key's bucket nor (in a table of
        unique keys) repeat a key; both are counted during the write, and nothing is published if it does.
        """
        version, manifest = self.latest()
        touched = self.buckets_of(changes)
        if not touched:
            return version
        after = apply(self._read(manifest, touched), changes).select(*self.schema.names)
        folder = f"v{version + 1}-{uuid.uuid4().hex[:8]}"
        dealt = after.withColumn("_bucket", self._bucket()).repartition(F.col("_bucket"))
        rows, test = checked(dealt, ["_bucket", *self.keys] if self.unique else [], not_null)
        strayed = Observation(f"buckets-{uuid.uuid4().hex}")
        rows = rows.observe(strayed, F.count_if(~F.col("_bucket").isin(*touched)).alias("strayed"), F.sort_array(F.collect_set("_bucket")).alias("written"))
        rows.write.partitionBy("_bucket").parquet(f"{self.root}/{folder}")
        test()
        if strayed.get["strayed"]:
            raise ConstraintError(f"{strayed.get['strayed']} rows left the buckets of the changed keys")
        written = set(strayed.get["written"] or [])
        kept = {b: f for b, f in manifest.items() if b not in touched} | {b: folder for b in touched if b in written}
        self.versions.claim(version + 1, [{"bucket": b, "folder": f} for b, f in sorted(kept.items())])
        return version + 1
