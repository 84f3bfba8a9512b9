"""Queries over reviewer votes, decisions and reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparkwarden.functions.joins import many
from sparkwarden.operators import decisions as DC
from sparkwarden.operators import evidence as E
from sparkwarden.operators import files as FL
from sparkwarden.operators import prefilter as PF
from sparkwarden.operators import traces as T
from sparkwarden.operators import votes as VT
from sparkwarden.plans.queries import query
from sparkwarden.plans.queries_files import BUDGET, MAX_FILE, prefiltered
from sparkwarden.plans.views import spark_view


def _votes(spark, sf):
    return spark_view(spark, sf, "v_votes").withColumn("signals", F.array("signal"))


# One reviewer (m3) is not configured and so weighs 1.
WEIGHTS = {"m0": 1.0, "m1": 0.9, "m2": 0.8}


def _consensus(spark, sf):
    return VT.consensus(_votes(spark, sf), WEIGHTS)


@query
def normalise_votes(spark, sf):
    votes = VT.normalise_votes(spark_view(spark, sf, "v_replies"))
    return votes.withColumn("signals", F.array_join("signals", ";"))


@query
def contradicted_votes(spark, sf):
    votes = spark_view(spark, sf, "v_votes").select(
        "package_id", "model", "pos", "verdict", F.array("signal").alias("signals"),
        F.when(F.col("k") % 5 == 0, F.concat(F.lit("It Steals data, a Backdoor "), F.col("signal")))
        .when(F.col("k") % 5 == 1, F.lit("Reads SSH key and sends data to a host")).otherwise("nothing wrong").alias("reasoning"),
    )
    return VT.contradicted_votes(votes).withColumn("signals", F.array_join("signals", ";"))


@query
def consensus_vote(spark, sf):
    return _consensus(spark, sf).withColumn("confidence", F.round("confidence", 6))


@query
def signal_union(spark, sf):
    return VT.signal_union(_votes(spark, sf))


@query
def decide_consensus(spark, sf):
    return DC.decide_consensus(_consensus(spark, sf))


# -- the chain: prefilter, votes, evidence and traces of every package -------------------
def _package_consensus(spark, sf):
    """Consensus of the votes on all orders that belong to a package."""
    return VT.consensus(spark_view(spark, sf, "v_package_votes").withColumn("signals", F.array("signal")), WEIGHTS)


def _enrichment_decisions(spark, sf):
    """Decisions from the merged evidence and the advisories of severity HIGH or CRITICAL."""
    packages = spark_view(spark, sf, "v_packages")
    evidence = E.enrich_packages(packages, spark_view(spark, sf, "v_enrichment"))
    advisories = E.advisory_join(packages, spark_view(spark, sf, "v_advisories")).filter(F.col("severity").isin("HIGH", "CRITICAL"))
    return DC.decide_enrichment(E.with_high_advisories(evidence, advisories))


@query
def decide_enrichment(spark, sf):
    return _enrichment_decisions(spark, sf)


def _trace_decisions(spark, sf):
    """Decisions on all runs of a package."""
    runs = T.decide_trace(spark_view(spark, sf, "v_trace_events"), spark_view(spark, sf, "v_runs"))
    return runs.join(many(spark_view(spark, sf, "v_package_runs")), "run_id").select("package_id", "outcome", "reason", "ord")


def _flags(spark, sf):
    """Packages with files that the size limits refuse."""
    files = spark_view(spark, sf, "v_files").select("package_id", "path", "size", "ord")
    return FL.oversized_flags(FL.admit_files(files, max_file=MAX_FILE, budget=BUDGET))


def _chain(spark, sf):
    """Overridden prefilter rows, the consensus and the final decision of every package."""
    rows = PF.uninspected_override(prefiltered(spark, sf), _flags(spark, sf), decide=True)
    voted = _package_consensus(spark, sf)
    final = DC.decide_packages(rows, DC.decide_consensus(voted), _enrichment_decisions(spark, sf), _trace_decisions(spark, sf))
    return rows, voted, final


@query
def decide_report(spark, sf):
    return _chain(spark, sf)[2]


def scans_of(packages):
    """Scans of 50 packages each, and as many empty ones."""
    scans = packages.select(F.floor(F.col("k") / 50).alias("scan_id")).distinct()
    return scans.union(scans.select(-1 - F.col("scan_id")))


def _scan_rows(spark, sf):
    packages = spark_view(spark, sf, "v_packages").select("package_id", F.floor(F.col("k") / 50).alias("scan_id"), F.col("k").alias("ord"))
    return _chain(spark, sf)[2].join(many(packages), "package_id")


@query
def scan_summary(spark, sf):
    return DC.scan_summary(_scan_rows(spark, sf))


@query
def scan_decisions(spark, sf):
    return DC.scan_decisions(scans_of(spark_view(spark, sf, "v_packages")), _scan_rows(spark, sf))


def chain_reports(spark, sf):
    """All packages with their prefilter rows, consensus and final decision."""
    rows, voted, final = _chain(spark, sf)
    packages = spark_view(spark, sf, "v_packages").select("package_id", "name", "version", "ecosystem", F.floor(F.col("k") / 50).alias("scan_id"), F.col("k").alias("ord"))
    meta = PF.metadata_anomalies(spark_view(spark, sf, "v_packages")).groupBy("package_id").agg(F.array_sort(F.collect_set("category")).alias("signals"))
    scanned = rows.select("package_id", "level", "passed", F.col("reason").alias("prefilter_reason"), "source_unavailable")
    joined = packages.join(many(scanned), "package_id").join(many(voted.select("package_id", "verdict", F.round("confidence", 3).alias("confidence"))), "package_id", "left")
    joined = joined.join(many(final), "package_id").join(many(meta), "package_id", "left")
    error = F.when(F.col("outcome") == "error", F.col("reason"))
    return joined.withColumn("signals", F.coalesce("signals", F.array().cast("array<string>"))).withColumn("error", error)


@query
def report_json(spark, sf):
    return DC.report_json(chain_reports(spark, sf))


@query
def report_sarif(spark, sf):
    return DC.report_sarif(chain_reports(spark, sf))


@query
def sarif_result(spark, sf):
    return DC.sarif_result(DC.report_sarif(chain_reports(spark, sf)))
