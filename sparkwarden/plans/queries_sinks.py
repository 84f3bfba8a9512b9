"""Queries that write and read back: documents of scans, stores in buckets, published sources."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparkwarden.functions.joins import many
from sparkwarden.operators import decisions as DC
from sparkwarden.operators import documents as DO
from sparkwarden.operators import names as N
from sparkwarden.operators import store as S
from sparkwarden.operators.buckets import BucketTable
from sparkwarden.plans.queries import query
from sparkwarden.plans.queries_decisions import chain_reports, scans_of
from sparkwarden.plans.queries_evidence import publish_inputs
from sparkwarden.plans.views import AS_OF, spark_view
from sparkwarden.streaming.runs import shared_folder, written

#: Few items a part, so that the scans of 50 packages have several.
WIDTH = 16


def _scan_documents(spark, sf):
    """Scans, half of them without packages, and their packages with the decisions of the whole chain."""
    rows = written(chain_reports(spark, sf))
    scans = scans_of(spark_view(spark, sf, "v_packages"))
    decisions = rows.select("scan_id", "ord", "outcome", "reason")
    counts = DC.scan_summary(decisions)
    found = scans.join(many(counts), "scan_id", "left").fillna(0).join(many(DC.scan_decisions(scans, decisions)), "scan_id")
    return found.withColumn("lockfile", F.concat(F.lit("scan-"), F.col("scan_id").cast("string"))).withColumn("ecosystem", F.lit("mixed")), rows


@query
def scan_payload(spark, sf):
    scans, rows = _scan_documents(spark, sf)
    return DO.numbered_parts(DO.payload_parts(scans, rows, WIDTH))


@query
def sarif_document(spark, sf):
    scans, rows = _scan_documents(spark, sf)
    results = DC.sarif_result(DC.report_sarif(rows)).join(many(rows.select("package_id", "scan_id", "ord")), "package_id")
    parts = DO.sarif_parts(scans, results, "sparkwarden", "1.0", "https://example.org/sparkwarden", "supply-chain-risk", "Supply chain risk detection", WIDTH)
    return DO.numbered_parts(parts)


@query
def verdict_upsert(spark, sf):
    """All reports stored, then all of them again with times before, at and after the stored ones."""
    rows = spark_view(spark, sf, "v_store")
    latest = rows.groupBy("key").agg(F.max_by(F.struct("cached_at", "report"), "k").alias("_r"), F.max("k").alias("k")).select("key", "_r.*", "k")
    table = BucketTable(spark, shared_folder(spark), ["key"], "key string, cached_at bigint, report string")
    table.upsert(latest.drop("k"), S.verdict_store)
    later = latest.select("key", (F.col("cached_at") + F.col("k") % 3 - 1).alias("cached_at"), F.concat(F.lit("new "), F.col("report")).alias("report"))
    table.upsert(later, S.verdict_store)
    return table.read()


@query
def source_upsert(spark, sf):
    """All sources indexed; then those of one registry fetched again."""
    rows = spark_view(spark, sf, "v_packages")
    path = N.storage_path(rows.name, rows.version, rows.ecosystem, rows.repository)
    index = rows.groupBy("name", "version", F.col("ecosystem").alias("registry")).agg(F.max(path).alias("path"), F.max((F.lit(AS_OF) - F.col("k")).cast("bigint")).alias("fetched_at"))
    table = BucketTable(spark, shared_folder(spark), ["name", "version", "registry"], S.ENTRIES)
    table.upsert(index, S.source_index)
    again = index.filter("registry = 'npm'").select("name", "version", "registry", F.concat(F.col("path"), F.lit("/v2")).alias("path"), F.lit(AS_OF).cast("bigint").alias("fetched_at"))
    table.upsert(again, S.source_index)
    return table.read()


@query
def publish_roundtrip(spark, sf):
    """Sources of all packages published, published again unchanged, and read back with their provenance and index."""
    reports, paths, files, urls, packages = publish_inputs(spark, sf)
    target = shared_folder(spark)
    for now in (AS_OF - 100, AS_OF):
        known = S.provenance_table(spark, target).read().select("path", "sha256")
        S.publish_files(S.publish_plan(reports, paths, files, known), files, urls, packages, target, now)
    found = S.read_published(spark, target).select("package_id", F.col("storage_path").alias("path"), "file_path", F.sha2("content", 256).alias("digest"), "sha256", "scan_verdict", "url")
    index = S.entry_table(spark, target).read().groupBy("path").agg(F.max("fetched_at").alias("fetched_at"))
    return found.join(index, "path")
