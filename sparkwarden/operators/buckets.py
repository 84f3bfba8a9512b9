"""A keyed table in hash buckets: an upsert rewrites the buckets it touches and leaves the files of all others.

Buckets are written as new versions under ``data``; a commit is one small table under ``commits`` that says which version of
every bucket counts.  Until that is written readers see the old state, so a run that fails or is repeated changes
nothing it has not committed; two writers can't commit the same number, the later one fails and starts again.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BUCKETS = 64


class BucketTable:
    """``keys`` decide a row's bucket; ``schema`` is that of the rows.  The number of buckets is fixed when the table is made."""

    def __init__(self, spark: SparkSession, target: str, keys: list[str], schema: str, buckets: int = BUCKETS):
        self.spark, self.target, self.keys, self.schema, self.buckets = spark, target.rstrip("/"), keys, schema, buckets

    def _exists(self, path: str) -> bool:
        at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return at.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(at)

    def _bucketed(self, rows: DataFrame) -> DataFrame:
        return rows.withColumn("bucket", F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int"))

    def state(self) -> tuple[int, dict[int, str]]:
        """Number of the last commit (0 before the first) and the version of each bucket: at most a row per bucket."""
        if not self._exists(f"{self.target}/commits"):
            return 0, {}
        commits = self.spark.read.schema("bucket int, version string, seq int").parquet(f"{self.target}/commits")
        last = commits.agg(F.max("seq")).first()[0]
        if last is None:
            return 0, {}
        return last, {r["bucket"]: r["version"] for r in commits.where((F.col("seq") == last) & (F.col("bucket") >= 0)).collect()}

    def read(self, only: set[int] | None = None) -> DataFrame:
        """The rows as last committed, of all buckets or some."""
        return self._read(self.state()[1], only)

    def _read(self, versions: dict[int, str], only: set[int] | None = None) -> DataFrame:
        paths = [f"{self.target}/data/version={v}/bucket={b}" for b, v in sorted(versions.items()) if only is None or b in only]
        return self.spark.read.schema(self.schema).parquet(*paths) if paths else self.spark.createDataFrame([], self.schema)

    def upsert(self, rows: DataFrame, merge: Callable[[DataFrame, DataFrame], DataFrame]) -> int:
        """Commit ``merge(old rows of the touched buckets, rows)``: the number of buckets rewritten.  ``merge`` must keep keys apart."""
        seq, versions = self.state()
        touched = {r["bucket"] for r in self._bucketed(rows).select("bucket").distinct().collect()}
        if not touched:
            return 0
        version = uuid.uuid4().hex
        merged = self._bucketed(merge(self._read(versions, touched), rows))
        merged.repartition("bucket").write.partitionBy("bucket").parquet(f"{self.target}/data/version={version}")
        # A bucket whose rows are all gone has no folder.
        left = {b for b in touched if self._exists(f"{self.target}/data/version={version}/bucket={b}")}
        now = {b: v for b, v in versions.items() if b not in touched} | dict.fromkeys(left, version)
        # Bucket -1 stands for the commit itself, which may hold no bucket.
        rows_now = self.spark.createDataFrame([(-1, version), *sorted(now.items())], "bucket int, version string")
        rows_now.coalesce(1).write.parquet(f"{self.target}/commits/seq={seq + 1}")
        return len(touched)
