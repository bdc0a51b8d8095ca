"""Tables in buckets whose changes rewrite only the buckets they touch, committed by versioned manifests.

A folder holds ``data/version__=N/<bucket>=B`` with the rows that version N wrote, and ``manifests/v=N``: for every bucket that has rows
the version that wrote it, its row count and further statistics.  A version counts once its manifest is complete, so a
run that was cut short leaves the table as it was.  Untouched buckets keep their files; older versions stay readable until
``vacuum``.  One writer at a time.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parlance.operators.index import snapshot_changes


class BucketTable:
    """``stats`` are aggregates that the manifest keeps per bucket.  The number of buckets is the caller's choice and
    bounds what the driver reads of a manifest."""

    def __init__(self, spark: SparkSession, folder: str, bucket: str = "bucket", stats: dict[str, Column] | None = None):
        self.spark, self.folder, self.bucket, self.stats = spark, folder.rstrip("/"), bucket, stats or {}

    def _glob(self, pattern: str) -> list[str]:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{pattern}")
        found = path.getFileSystem(self.spark._jsc.hadoopConfiguration()).globStatus(path)
        return [f.getPath().toString() for f in found or []]

    def versions(self) -> list[int]:
        """Numbers of the committed versions, ascending."""
        return sorted(int(p.rsplit("/", 2)[1].removeprefix("v=")) for p in self._glob("manifests/v=*/_SUCCESS"))

    def version(self) -> int | None:
        return max(self.versions(), default=None)

    def manifest(self, version: int | None = None) -> list[T.Row]:
        """Rows (bucket, v, n, statistics) of a version, the latest by default."""
        version = self.version() if version is None else version
        return [] if version is None else self.spark.read.parquet(f"{self.folder}/manifests/v={version}").collect()

    def _schema(self, version: int) -> T.StructType:
        plain = T.StructType.fromJson(json.loads(self.spark.read.text(f"{self.folder}/schemas/v={version}").first()[0]))
        return plain.add("version__", T.IntegerType()).add(self.bucket, T.IntegerType())

    def read(self, version: int | None = None, buckets: list[int] | None = None) -> DataFrame | None:
        """The rows of a version, of some buckets only if they are named; None before the first version.

        Buckets are a partition filter, so the files of others are not opened.
        """
        version = self.version() if version is None else version
        if version is None:
            return None
        rows = [r for r in self.manifest(version) if buckets is None or r[self.bucket] in set(buckets)]
        schema = self._schema(version)
        if not rows:
            return self.spark.createDataFrame([], schema).drop("version__")
        by_version: dict[int, list[int]] = {}
        for r in rows:
            by_version.setdefault(r["v"], []).append(r[self.bucket])
        wanted = F.lit(False)
        for v, own in sorted(by_version.items()):
            wanted = wanted | ((F.col("version__") == v) & F.col(self.bucket).isin(own))
        paths = [f"{self.folder}/data/version__={v}" for v in sorted(by_version)]
        return self.spark.read.schema(schema).option("basePath", f"{self.folder}/data").parquet(*paths).where(wanted).drop("version__")

    def replace(self, rows: DataFrame, touched: list[int] | None = None, before_commit: Callable[[DataFrame], None] | None = None) -> int:
        """Commits a version in which the ``touched`` buckets (all by default) hold exactly ``rows``; returns its number.

        ``rows`` may read this table.  A bucket of very many rows is written by several tasks.  ``before_commit`` is given the rows
        as they were written; the version does not count before it is done.
        """
        before = self.manifest()
        version = (self.version() or 0) + 1
        path = f"{self.folder}/data/version__={version}"
        rows.hint("rebalance", F.col(self.bucket)).write.mode("overwrite").partitionBy(self.bucket).parquet(path)
        plain = T.StructType([f for f in rows.schema.fields if f.name != self.bucket])
        self.spark.createDataFrame([(json.dumps(plain.jsonValue()),)], "value string").coalesce(1).write.mode("overwrite").text(
            f"{self.folder}/schemas/v={version}")
        written = self.spark.read.schema(T.StructType(list(plain.fields)).add(self.bucket, T.IntegerType())).option("basePath", path).parquet(path)
        if before_commit is not None:
            before_commit(written)
        made = written.groupBy(self.bucket).agg(F.lit(version).alias("v"), F.count("*").alias("n"), *[c.alias(n) for n, c in self.stats.items()])
        gone = None if touched is None else set(touched)
        kept = [] if gone is None else [r for r in before if r[self.bucket] not in gone]
        if kept:
            made = made.unionByName(self.spark.createDataFrame(kept, made.schema))
        made.coalesce(1).write.mode("overwrite").parquet(f"{self.folder}/manifests/v={version}")
        return version

    def changed_buckets(self, old: int, new: int) -> list[int]:
        """Buckets that were written between two versions."""
        sides = [{r[self.bucket]: r["v"] for r in self.manifest(v)} for v in (old, new)]
        return sorted(b for b in sides[0].keys() | sides[1].keys() if sides[0].get(b) != sides[1].get(b))

    def changes_between(self, old: int, new: int, key: str, hash_col: str = "content_hash") -> DataFrame:
        """key and change (``insert``, ``update``, ``delete``) from one version to another; only buckets that were written are read."""
        touched = self.changed_buckets(old, new)
        sides = [self.read(v, touched).select(key, F.col(hash_col).alias("content_hash")) for v in (old, new)]
        return snapshot_changes(*sides, key)

    def vacuum(self, keep: int = 1) -> list[str]:
        """Deletes what the last ``keep`` versions do not need; returns the deleted folders."""
        versions = self.versions()
        live = {(r["v"], r[self.bucket]) for v in versions[-keep:] for r in self.manifest(v)}
        gone = []
        for path in self._glob(f"data/version__=*/{self.bucket}=*"):
            v, b = (int(part.split("=")[1]) for part in path.rsplit("/", 2)[1:])
            if (v, b) not in live:
                gone.append(path)
        gone += [f"{self.folder}/{kind}/v={v}" for v in versions[:-keep] for kind in ("manifests", "schemas")]
        for path in gone:
            where = self.spark._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(where, True)
        return gone


def bucket_of(key: Column, buckets: int) -> Column:
    """Bucket by key hash; NULL keys have one too."""
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


def merge(table: BucketTable, incoming: DataFrame, key: str, order: list[Column], buckets: int) -> int:
    """Rows of ``incoming`` replace those of their key, or are added; only buckets of incoming keys are rewritten.

    Several incoming rows of one key count as one, the first in the given order.  A NULL key is a key like any other.
    """
    rest = [c for c in incoming.columns if c not in (key, table.bucket)]
    latest = incoming.groupBy(key).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("__row")).select(
        key, "__row.*", bucket_of(F.col(key), buckets).alias(table.bucket)).checkpoint()
    if table.version() is None:
        return table.replace(latest)
    touched = [r[0] for r in latest.select(table.bucket).distinct().collect()]  # at most ``buckets`` numbers
    known = latest.select(F.col(key).alias("__key"), F.col(table.bucket).alias("__bucket"))
    same = (F.col(table.bucket) == F.col("__bucket")) & F.col(key).eqNullSafe(F.col("__key"))
    return table.replace(table.read(buckets=touched).join(known, same, "left_anti").unionByName(latest), touched)
