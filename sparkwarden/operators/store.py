"""Stores of verdicts and of published sources."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkwarden import values as V
from sparkwarden.functions.joins import many
from sparkwarden.operators.buckets import BucketTable
from sparkwarden.operators.files import admit_files, tree_hash


def store_key(ecosystem: Column, name: Column, version: Column, last: Column) -> Column:
    """First 16 hex digits of the SHA-256 of ``ecosystem:name:version:last``."""
    return F.substring(F.sha2(F.concat_ws(":", ecosystem, name, version, last), 256), 1, 16)


def verdict_store(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """Latest report per key; among equal times the incoming one."""
    both = existing.select("key", "cached_at", "report", F.lit(0).alias("_new")).unionByName(
        incoming.select("key", "cached_at", "report", F.lit(1).alias("_new"))
    )
    latest = F.max_by(F.struct("cached_at", "report"), F.struct("cached_at", "_new"))
    return both.groupBy("key").agg(latest.alias("_r")).select("key", "_r.cached_at", "_r.report")


def source_ttl(source: Column) -> Column:
    hours = F.create_map(*[F.lit(x) for pair in V.SOURCE_TTL_HOURS.items() for x in pair])
    return hours[source]


def store_lookup(wanted: DataFrame, store: DataFrame, as_of: int, ttl_hours: Column) -> DataFrame:
    """Every wanted key with its stored report, null when missing or older than its time to live."""
    fresh = store.filter(F.lit(as_of) - F.col("cached_at") <= ttl_hours * 3600)
    return wanted.join(fresh.select("key", "source", "report"), "key", "left")


def source_index(index: DataFrame, fetched: DataFrame) -> DataFrame:
    """Index with the fetched entries merged in by (name, version, registry)."""
    keys = ["name", "version", "registry"]
    new = fetched.select(*keys, F.col("path").alias("_path"), F.col("fetched_at").alias("_fetched"))
    return index.join(new, keys, "full_outer").select(
        *keys, F.coalesce("_path", "path").alias("path"), F.coalesce("_fetched", "fetched_at").alias("fetched_at")
    )


def store_inventory(published: DataFrame) -> DataFrame:
    """Published directories by origin, with the last write of each."""
    return published.groupBy("origin").agg(F.count("*").alias("n_packages"), F.max("fetched_at").alias("last_write"))


def publish_gate(reports: DataFrame, enabled: bool = True, flag: bool | None = None) -> DataFrame:
    """Whether a package may be published, and the reason.

    ``reports``: ``package_id, verdict (null without consensus), source_unavailable, signals``.
    An explicit flag overrides the setting.
    """
    unavailable = F.col("source_unavailable") | F.exists("signals", lambda s: F.contains(s, F.lit("source_unavailable")))
    reason = (
        F.when(F.lit(flag is False), "flag_off")
        .when(F.lit(flag is not True and not enabled), "disabled")
        .when(F.col("verdict") == "malicious", "verdict_malicious")
        .when(F.col("verdict") == "error", "verdict_error")
        .when(unavailable, "source_unavailable")
        .when(F.col("verdict").isNull(), "ai_consensus_skipped")
        .otherwise("ok")
    )
    return reports.select("package_id", reason.alias("reason")).withColumn("publish", F.col("reason") == "ok")


def collision_policy(incoming: DataFrame, published: DataFrame, policy: str = "refuse") -> DataFrame:
    """What to do with a package whose path may be taken.

    ``incoming``: ``package_id, path, sha256, verdict``; ``published``: ``path, sha256``, the hash
    null where the directory carries no provenance of ours.
    """
    taken = published.select("path", F.col("sha256").alias("_sha"), F.lit(True).alias("_taken"))
    joined = incoming.join(many(taken), "path", "left")
    action = (
        F.when(F.col("verdict") == "malicious", "verdict_malicious")
        .when(F.col("_taken").isNull(), "fresh_directory")
        .when(F.col("_sha").isNull() & F.lit(policy == "overwrite"), "overwrite_forced")
        .when(F.col("_sha").isNull(), "collision_unknown_origin")
        .when(F.col("_sha") == F.col("sha256"), "idempotent_same_sha")
        .otherwise("reemit")
    )
    return joined.select("package_id", "path", "sha256", "verdict", action.alias("reason")).withColumn(
        "write", F.col("reason").isin("fresh_directory", "overwrite_forced", "reemit")
    ).withColumn("touch", F.col("reason") == "idempotent_same_sha")


def publish_plan(
    reports: DataFrame, paths: DataFrame, files: DataFrame, published: DataFrame, policy: str = "refuse"
) -> DataFrame:
    """Decision of the gate and the collision policy for every package that has files."""
    allowed = publish_gate(reports).filter("publish").select("package_id")
    verdicts = reports.select("package_id", "verdict")
    hashes = tree_hash(files).withColumnRenamed("tree_sha256", "sha256")
    incoming = hashes.join(many(allowed), "package_id", "left_semi").join(many(paths), "package_id").join(many(verdicts), "package_id")
    return collision_policy(incoming, published, policy)


def published_files(plan: DataFrame, files: DataFrame) -> DataFrame:
    """Files to write, each under the storage path of its package."""
    writes = plan.filter("write").select("package_id", F.col("path").alias("storage_path"))
    return admit_files(files).filter("refused IS NULL").join(writes, "package_id").select(
        "package_id", "storage_path", F.concat_ws("/", "storage_path", "path").alias("file_path"), "content"
    )


def provenance_rows(plan: DataFrame, urls: DataFrame) -> DataFrame:
    """One provenance record per written package."""
    return plan.filter("write").join(many(urls), "package_id", "left").select(
        "package_id", "path", "sha256", F.coalesce("verdict", F.lit("unanalyzed")).alias("scan_verdict"), "url"
    )


#: Tables below a published folder.
PROVENANCE = "path string, package_id string, sha256 string, scan_verdict string, url string, publish string"
ENTRIES = "name string, version string, registry string, path string, fetched_at bigint"


def provenance_table(spark: SparkSession, target: str) -> BucketTable:
    """The last provenance of every published path, and which publish wrote its files."""
    return BucketTable(spark, f"{target}/provenance", ["path"], PROVENANCE)


def entry_table(spark: SparkSession, target: str) -> BucketTable:
    """The index of published sources."""
    return BucketTable(spark, f"{target}/index", ["name", "version", "registry"], ENTRIES)


def publish_files(plan: DataFrame, files: DataFrame, urls: DataFrame, packages: DataFrame, target: str, now: int) -> None:
    """Publish in two steps: files are staged under a name of their own, then the commit of the provenance makes them count.

    ``packages``: package_id, name, version, registry.  A run that fails before the commit leaves what readers see as it was.  The
    index is refreshed for all packages of the plan that are written, and for those whose published files have the same hash.
    Files lie under a shard of their storage path's hash, so the number of folders does not grow with the packages.
    """
    spark = plan.sparkSession
    publish = uuid.uuid4().hex
    written = provenance_rows(plan, urls).withColumn("publish", F.lit(publish))
    staged = published_files(plan, files).select("*", F.substring(F.sha2("storage_path", 256), 1, 2).alias("shard"))
    staged.write.partitionBy("shard").parquet(f"{target}/files/publish={publish}")
    latest = lambda old, new: old.join(new.select("path"), "path", "left_anti").unionByName(new.select(*old.columns))
    provenance_table(spark, target).upsert(written, latest)
    seen = plan.filter(F.col("write") | F.col("touch")).select("package_id", "path").join(many(packages), "package_id")
    fetched = seen.groupBy("name", "version", "registry").agg(F.max("path").alias("path")).withColumn("fetched_at", F.lit(now).cast("bigint"))
    entry_table(spark, target).upsert(fetched, source_index)


def read_published(spark: SparkSession, target: str) -> DataFrame:
    """Files that count: those that the publish named by their path's provenance wrote, with that provenance."""
    schema = "package_id string, storage_path string, file_path string, content string, shard string, publish string"
    where = provenance_table(spark, target).read()
    files = spark.read.schema(schema).parquet(f"{target}/files")
    return files.drop("package_id").join(where.withColumnRenamed("path", "storage_path"), ["storage_path", "publish"])
