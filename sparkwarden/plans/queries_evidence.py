"""Queries over external evidence and the stores."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparkwarden.operators import evidence as E
from sparkwarden.operators import names as N
from sparkwarden.operators import store as S
from sparkwarden.plans.queries import query
from sparkwarden.plans.views import AS_OF, spark_view


def _packages(spark, sf):
    return spark_view(spark, sf, "v_packages")


@query
def advisory_join(spark, sf):
    return E.advisory_join(_packages(spark, sf), spark_view(spark, sf, "v_advisories"))


@query
def cvss_band(spark, sf):
    vectors = _packages(spark, sf).select(
        "package_id",
        F.concat(
            F.lit("CVSS:3.1/AV:"), F.when(F.col("k") % 2 == 0, "N").otherwise("L"), F.lit("/AC:"),
            F.when(F.col("k") % 3 == 0, "L").otherwise("H"), F.lit("/PR:"), F.when(F.col("k") % 5 == 0, "N").otherwise("L"),
            F.lit("/UI:"), F.when(F.col("k") % 7 == 0, "n").otherwise("R"),
        ).alias("vector"),
    )
    return vectors.select("package_id", "vector", E.cvss_band(F.col("vector")).alias("severity"))


@query
def deps_links(spark, sf):
    links = E.deps_links(spark_view(spark, sf, "v_enrichment"))
    return links.withColumn("advisory_ids", F.array_join("advisory_ids", ","))


@query
def provenance_status(spark, sf):
    return E.provenance_status(_packages(spark, sf), spark_view(spark, sf, "v_enrichment"))


def _enriched(spark, sf):
    return E.enrich_packages(_packages(spark, sf), spark_view(spark, sf, "v_enrichment"))


@query
def enrich_packages(spark, sf):
    df = _enriched(spark, sf)
    for c in ("advisory_ids", "expected_capabilities", "doc_snippets", "critical_findings", "errors"):
        df = df.withColumn(c, F.array_join(c, ","))
    return df


@query
def evidence_text(spark, sf):
    packages = _packages(spark, sf)
    advisories = (
        E.advisory_join(packages, spark_view(spark, sf, "v_advisories"))
        .groupBy("package_id")
        .agg(F.array_sort(F.collect_list(F.struct("pos", "id", "summary", "severity", "fixed_version"))).alias("advisories"))
    )
    mentions = (
        E.top_mentions(spark_view(spark, sf, "v_mentions"))
        .select("package_id", F.struct("rank", F.lit("google").alias("source"), "title", F.col("relevance").cast("string").alias("snippet")).alias("m"))
        .groupBy("package_id")
        .agg(F.array_sort(F.collect_list("m")).alias("mentions"))
    )
    author = E.author_mentions(spark_view(spark, sf, "v_mentions"))
    rows = (
        _enriched(spark, sf).join(advisories, "package_id", "left").join(mentions, "package_id", "left").join(author, "package_id", "left")
        .withColumn("sources", F.array(F.lit("osv"), F.lit("web_search")))
        .withColumn("author_info", F.coalesce("author_info", F.lit("")))
    )
    return E.evidence_text(rows)


@query
def mention_relevance(spark, sf):
    return E.mention_relevance(spark_view(spark, sf, "v_mentions"))


@query
def top_mentions(spark, sf):
    return E.top_mentions(spark_view(spark, sf, "v_mentions"))


@query
def author_mentions(spark, sf):
    return E.author_mentions(spark_view(spark, sf, "v_mentions"))


@query
def capabilities(spark, sf):
    found = E.capabilities(spark_view(spark, sf, "v_docs"))
    return found.withColumn("capabilities", F.array_join("capabilities", ";"))


# -- stores -----------------------------------------------------------------------------
@query
def verdict_store(spark, sf):
    old = spark_view(spark, sf, "v_store")
    new = old.filter("k % 2 = 0").select("key", (F.col("cached_at") + F.when(F.col("k") % 4 == 0, 10).otherwise(-10)).alias("cached_at"),
                                         F.concat(F.lit("new "), F.col("report")).alias("report"))
    latest = old.groupBy("key").agg(F.max_by(F.struct("cached_at", "report"), "k").alias("_r")).select("key", "_r.*")
    return S.verdict_store(latest, new.groupBy("key").agg(F.max("cached_at").alias("cached_at"), F.max("report").alias("report")))


@query
def store_lookup(spark, sf):
    p = _packages(spark, sf)
    wanted = p.select("package_id", S.store_key(p.ecosystem, p.name, p.version, F.lit("registry")).alias("key"))
    return S.store_lookup(wanted, spark_view(spark, sf, "v_store"), AS_OF, S.source_ttl(F.col("source")))


def _index(spark, sf):
    p = _packages(spark, sf)
    path = N.storage_path(p.name, p.version, p.ecosystem, p.repository)
    return p.groupBy("name", "version", F.col("ecosystem").alias("registry")).agg(
        F.max(path).alias("path"), F.max((F.lit(AS_OF) - F.col("k")).cast("bigint")).alias("fetched_at"), F.max("k").alias("k")
    )


@query
def source_index(spark, sf):
    rows = _index(spark, sf)
    fetched = rows.filter("k % 3 <> 0").select("name", "version", "registry", F.concat(F.col("path"), F.lit("/v2")).alias("path"), F.lit(AS_OF).cast("bigint").alias("fetched_at"))
    return S.source_index(rows.filter("k % 2 = 0").drop("k"), fetched)


@query
def store_inventory(spark, sf):
    rows = _index(spark, sf).withColumn("origin", F.when(F.col("k") % 3 == 0, "own").otherwise("other"))
    return S.store_inventory(rows)


def _publish_reports(spark, sf):
    k = F.col("k")
    return _packages(spark, sf).select(
        "package_id",
        F.when(k % 5 == 0, "malicious").when(k % 7 == 0, "error").when(k % 3 > 0, "safe").alias("verdict"),
        (k % 11 == 0).alias("source_unavailable"),
        F.array(F.when(k % 13 == 0, "source_unavailable(HIGH): 404").otherwise("no_author")).alias("signals"),
    )


@query
def publish_gate(spark, sf):
    return S.publish_gate(_publish_reports(spark, sf))


@query
def collision_policy(spark, sf):
    p = _packages(spark, sf)
    key = F.col("k").cast("string")
    incoming = p.select("package_id", F.concat(F.lit("repos/"), "package_id").alias("path"), F.sha2(key, 256).alias("sha256"),
                        F.when(F.col("k") % 5 == 0, "malicious").otherwise("safe").alias("verdict"))
    published = p.filter("k % 2 = 0").select(
        F.concat(F.lit("repos/"), "package_id").alias("path"),
        F.when(F.col("k") % 3 == 0, F.sha2(key, 256)).when(F.col("k") % 3 == 1, "0").alias("sha256"))
    return S.collision_policy(incoming, published)


@query
def publish_files(spark, sf):
    p = _packages(spark, sf)
    paths = p.select("package_id", N.storage_path(p.name, p.version, p.ecosystem, p.repository).alias("path"))
    published = paths.filter(F.length("path") % 2 == 0).select("path", F.lit(None).cast("string").alias("sha256")).distinct()
    files = spark_view(spark, sf, "v_files")
    reports = _publish_reports(spark, sf).withColumn("signals", F.array().cast("array<string>"))
    plan = S.publish_plan(reports, paths, files, published)
    return S.published_files(plan, files).select("package_id", "file_path", F.sha2("content", 256).alias("digest"))


def publish_inputs(spark, sf):
    """Reports, storage paths, files, URLs and names of all packages: what publishing takes."""
    p = _packages(spark, sf)
    # One package a path: the first of those that share a repository and version.
    path = N.storage_path(p.name, p.version, p.ecosystem, p.repository)
    paths = p.select("package_id", "k", path.alias("path")).groupBy("path").agg(F.min_by("package_id", "k").alias("package_id"))
    files = spark_view(spark, sf, "v_files")
    reports = _publish_reports(spark, sf).withColumn("signals", F.array().cast("array<string>"))
    urls = p.select("package_id", F.col("homepage").alias("url"))
    packages = p.select("package_id", "name", "version", F.col("ecosystem").alias("registry"))
    return reports, paths, files, urls, packages
