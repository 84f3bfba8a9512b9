"""Helpers shared by the training-data operators."""

from __future__ import annotations

import atexit
import sys
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparkwarden.functions.joins import many

#: Characters that separate words, as SQL escapes see them, and the class of all others.
SPACES = " \t\n\x0b\f\r"
SPACE_RUN = r"[\x20\x09-\x0D]+"


def scratch_root(spark: SparkSession) -> str:
    """The shared folder that all executors see: ``spark.checkpoint.dir``; a temporary one in local mode only."""
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if root:
        return root
    sc = spark.sparkContext
    current = sc._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get()
    if not sc.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    sc.setCheckpointDir(tempfile.mkdtemp(prefix="sparkwarden-"))
    return sc._jsc.sc().getCheckpointDir().get()


#: Paths made inside the innermost :func:`scope`, if there is one.
_SCOPES: list[list[str]] = []


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder; removed when the application ends normally, or by the owner of its scope."""
    path = f"{scratch_root(spark)}/llm/{name}-{uuid.uuid4().hex}"
    if _SCOPES:
        _SCOPES[-1].append(path)
    atexit.register(discard, spark, path)
    return path


@contextmanager
def scope() -> Iterator[list[str]]:
    """The list of scratch paths made inside, for whoever knows when they are no longer read."""
    _SCOPES.append([])
    try:
        yield _SCOPES[-1]
    finally:
        _SCOPES.pop()


def discard(spark: SparkSession, path: str) -> None:
    """Remove a scratch path through the file system that holds it."""
    try:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
    except Exception:  # noqa: BLE001  the session may be gone already
        return


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read back: lineage ends here, and lost executors cost nothing."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def process_cache(name: str, make: Callable[[], Any]) -> Any:
    """An object kept for the life of a Python worker, so that tasks that follow each other share it."""
    kept = sys.__dict__.setdefault("_sparkwarden_kept", {})
    if name not in kept:
        kept[name] = make()
    return kept[name]


def words(text: Column) -> Column:
    """Words of a text as an array, empty for a null or blank text."""
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACES))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, SPACE_RUN))


def numbered(df: DataFrame, keys: list[str], order: list[str], out: str, name: str) -> DataFrame:
    """Row number (from 0) per ``keys`` in ``order``, without one task per key.

    Rows are range-partitioned by (keys, order) and stored with their partition's number; a window
    numbers them inside (partition, keys), and one count per (partition, keys) carries over.
    Rows that tie in ``order`` are interchangeable; equal rows always meet in one partition.
    """
    spark = df.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = stored(df.repartitionByRange(n, *keys, *order).withColumn("_part", F.spark_partition_id()), name)
    counts = ranged.groupBy("_part", *keys).agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_part", *keys, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    inside = Window.partitionBy("_part", *keys).orderBy(*order)
    local = ranged.withColumn("_local", F.row_number().over(inside) - 1)
    same = local["_part"] == offsets["_part"]
    for k in keys:
        same = same & local[k].eqNullSafe(offsets[k])
    return local.join(offsets, same).select(
        *[local[c] for c in df.columns], (F.col("_local") + F.col("_before")).cast("long").alias(out)
    )


def sums_before(df: DataFrame, order: str, values: list[str], name: str) -> DataFrame:
    """``df`` with ``before_<value>``: the sum of each value (double) over all rows of a lower ``order`` (different per row).

    Sums run inside ranges of the order, and one total per range carries over: no task sees all rows.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = stored(df.repartitionByRange(n, order).withColumn("_part", F.spark_partition_id()), name)
    running = lambda value, w: F.coalesce(F.sum(value).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    totals = ranged.groupBy("_part").agg(*[F.sum(v).alias(f"_{v}") for v in values])
    carried = totals.select("_part", *[running(f"_{v}", Window.orderBy("_part")).alias(f"_carried_{v}") for v in values])
    inside = Window.partitionBy("_part").orderBy(order)
    local = ranged.withColumns({f"before_{v}": running(v, inside) for v in values}).join(carried, "_part")
    return local.select(*df.columns, *[(F.col(f"before_{v}") + F.col(f"_carried_{v}")).alias(f"before_{v}") for v in values])


def components(edges: DataFrame, most: int = 60) -> DataFrame:
    """Connected components of ``edges`` (a, b long): node, component (its smallest node).

    Alternating stars: every node hands its larger neighbours to its smallest one, then its smaller
    ones too, until each node hangs on its component's smallest node.  Each round is two equi-joins
    (which adaptive execution may split; no side is broadcast) over a stored table; rounds grow with the logarithm of the
    longest chain.  Nodes without an edge to another node have no row.
    """
    now = stored(
        edges.where("a <> b").select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("u")).distinct(), "stars"
    )
    mark = _mark(now)
    for _ in range(most):
        if mark[0] == 0:
            break
        both = now.select("u", "v").unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(many(least), "u").select("v", F.col("m").alias("u")).distinct()
        lowest = large.groupBy("v").agg(F.min("u").alias("m"))
        joined = large.join(many(lowest), "v")
        small = joined.select(F.explode(F.array(F.struct("v", F.col("m").alias("u")), F.struct(F.col("u").alias("v"), F.col("m").alias("u")))).alias("e"))
        now = stored(small.select("e.v", "e.u").where("v <> u").distinct(), "stars")
        last, mark = mark, _mark(now)
        if mark == last:
            break
    else:
        raise RuntimeError("components did not settle")
    roots = now.select(F.col("u").alias("node"), F.col("u").alias("component")).distinct()
    return now.select(F.col("v").alias("node"), F.col("u").alias("component")).unionByName(roots)


def _mark(edges: DataFrame) -> tuple:
    row = edges.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0))).first()
    return tuple(row)
