"""Running a streaming query over the data at hand."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

#: Micro-batches a table is streamed in, at least, and rows that one of them may hold: more rows mean more of them.
BATCHES = 4
BATCH_ROWS = 2_000_000
#: Files that the rows of one micro-batch are dealt to, about.
FILES = 16
#: Tasks of a micro-batch that has state, at most: its rows have a bound, and each task costs a fixed time in every one of them.
STATE_TASKS = 32
#: State with timers and times to live needs this store.
STATE_STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def shared_folder(spark: SparkSession) -> str:
    """A new folder below the cluster's checkpoint directory, removed when the application ends normally.

    Only a local session without that setting, as in tests, falls back to a temporary folder.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
        root = tempfile.mkdtemp(prefix="run-")
    folder = f"{root.rstrip('/')}/{uuid.uuid4().hex}"
    atexit.register(discard, spark, folder)
    return folder


def discard(spark: SparkSession, folder: str) -> None:
    """Remove a folder through the file system that holds it."""
    try:
        at = spark._jvm.org.apache.hadoop.fs.Path(folder)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
    except Exception:  # noqa: BLE001  the session may be gone already
        return


def stateful(stream: DataFrame) -> DataFrame:
    """``stream``, whose session is told to keep state in the store that timers and times to live need."""
    stream.sparkSession.conf.set(*STATE_STORE)
    return stream


def finished(spark: SparkSession, job: DataStreamWriter) -> None:
    """Run a streaming query over what has arrived; the number of its tasks with state is set by its first start."""
    parts = "spark.sql.shuffle.partitions"
    before = spark.conf.get(parts)
    spark.conf.set(parts, str(min(int(before), STATE_TASKS)))
    try:
        query = job.trigger(availableNow=True).start()
    finally:
        spark.conf.set(parts, before)
    query.awaitTermination()


def written(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder and read back, for a result that several branches of a plan need."""
    folder = shared_folder(df.sparkSession)
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def n_slices(source: DataFrame, batches: int) -> int:
    """As many slices as keep a micro-batch within ``BATCH_ROWS``, so that what one of them holds has a bound at any size."""
    return max(batches, -(-source.count() // BATCH_ROWS))


def slices(source: DataFrame, order: str, batches: int) -> Iterator[DataFrame]:
    """``source`` in ranges of ``order``, lowest first: what arrives in turn.  A null counts as the lowest value.

    The plan of ``source`` runs once and its rows are written by range, so that a range reads its own files and not the whole table.
    """
    spark, names = source.sparkSession, source.columns
    whole, ranged = shared_folder(spark), shared_folder(spark)
    source.write.parquet(whole)
    rows = spark.read.schema(source.schema).parquet(whole)
    batches = n_slices(rows, batches)
    cuts = sorted(set(rows.approxQuantile(order, [i / batches for i in range(1, batches)], min(0.01, 0.1 / batches))))
    at = F.coalesce(F.col(order).cast("double"), F.lit(float("-inf")))
    nth = F.size(F.filter(F.array(*map(F.lit, cuts)).cast("array<double>"), lambda cut: cut < at))
    placed = rows.withColumn("_slice", nth).repartition(FILES * (len(cuts) + 1), "_slice", F.pmod(F.xxhash64(order), F.lit(FILES)))
    placed.write.partitionBy("_slice").parquet(ranged)
    discard(spark, whole)
    placed = spark.read.schema(placed.schema).parquet(ranged)
    for i in range(len(cuts) + 1):
        yield placed.filter(F.col("_slice") == i).select(*names)


def run_available(
    spark: SparkSession, source: DataFrame, transform: Callable[[DataFrame], DataFrame], order: str, batches: int = BATCHES
) -> DataFrame:
    """Stream a table through ``transform`` and return the written result.

    The table arrives in ranges of ``order``; the query is stopped and started again from its
    checkpoint between them, so what a later range needs of an earlier one is in the state.
    """
    folder = shared_folder(spark)
    for part in slices(source, order, batches):
        part.write.mode("append").parquet(f"{folder}/in")
        out = transform(spark.readStream.schema(source.schema).parquet(f"{folder}/in"))
        job = (
            out.writeStream.format("parquet")
            .option("path", f"{folder}/out")
            .option("checkpointLocation", f"{folder}/state")
        )
        finished(spark, job)
    return spark.read.schema(out.schema).parquet(f"{folder}/out")


def run_updates(
    spark: SparkSession,
    source: DataFrame,
    transform: Callable[[DataFrame], DataFrame],
    keys: list[str],
    order: str,
    batches: int = BATCHES,
) -> DataFrame:
    """Like :func:`run_available` for results that change: the last update of every key.

    Each micro-batch appends its updates under its number, so a batch that is retried after a
    failure replaces what it wrote before.
    """
    folder = shared_folder(spark)

    def store(updates: DataFrame, batch: int) -> None:
        updates.write.mode("overwrite").parquet(f"{folder}/out/batch={batch}")

    for part in slices(source, order, batches):
        part.write.mode("append").parquet(f"{folder}/in")
        out = transform(spark.readStream.schema(source.schema).parquet(f"{folder}/in"))
        job = (
            out.writeStream.outputMode("update")
            .option("checkpointLocation", f"{folder}/state")
            .foreachBatch(store)
        )
        finished(spark, job)
    updates = spark.read.parquet(f"{folder}/out")
    columns = [c for c in out.columns if c not in keys]
    latest = updates.groupBy(*keys).agg(F.max_by(F.struct(*columns), F.struct("batch", *[c for c in columns if c == "closed"])).alias("_u"))
    return latest.select(*keys, "_u.*")
