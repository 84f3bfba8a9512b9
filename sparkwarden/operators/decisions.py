"""Decisions and reports: one outcome per package and per scan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkwarden.functions import patterns as P
from sparkwarden.functions.joins import many

DECISION = ["package_id", "outcome", "reason"]


def with_exit(decisions: DataFrame) -> DataFrame:
    rank = P.outcome_rank(F.col("outcome"))
    return decisions.withColumn("exit_code", rank).withColumn("should_block_install", F.col("outcome") == "malicious")


def verdict_outcome(verdict: Column) -> Column:
    return (
        F.when(verdict.isin("suspicious", "needs_human_review"), "needs_review")
        .when(verdict == "safe", "safe")
        .when(verdict == "malicious", "malicious")
        .otherwise("error")
    )


def decide_consensus(consensus: DataFrame) -> DataFrame:
    """Outcome of a verdict; a consensus that failed needs a reason of its own."""
    summary = F.concat(F.lit("Consensus: "), F.col("verdict"))
    reason = F.when(F.col("verdict") == "error", "All models returned errors").otherwise(summary)
    return with_exit(consensus.select("package_id", verdict_outcome(F.col("verdict")).alias("outcome"), reason.alias("reason")))


def decide_enrichment(enriched: DataFrame) -> DataFrame:
    """Review when evidence speaks against a package; the first applicable reason is given.

    ``enriched``: ``package_id, high_advisories ARRAY (first five ids), score,
    provenance_status, provenance_verified, provenance_details, errors ARRAY``.
    """
    advisories = F.when(
        F.size("high_advisories") > 0,
        F.concat(F.lit("Known vulnerabilities detected: "), F.array_join(F.slice("high_advisories", 1, 5), ", ")),
    )
    score = F.when(F.col("score") < 5.0, F.concat(F.lit("OpenSSF Scorecard is low ("), F.format_string("%.1f", "score"), F.lit("/10)")))
    bad = (F.col("provenance_status") == "invalid") | ~F.col("provenance_verified")
    details = F.when(F.length("provenance_details") > 0, F.col("provenance_details")).otherwise("Invalid provenance metadata")
    reason = F.coalesce(advisories, score, F.when(bad, details), F.get("errors", 0))
    return with_exit(
        enriched.select("package_id", F.lit("needs_review").alias("outcome"), reason.alias("reason")).filter("reason IS NOT NULL")
    )


def strongest(decisions: DataFrame, key: str, order: str) -> DataFrame:
    """The decision of highest rank per key; the earliest one among equals."""
    ranked = F.struct(P.outcome_rank(F.col("outcome")).alias("rank"), (-F.col(order)).alias("earlier"), "outcome", "reason")
    best = decisions.groupBy(key).agg(F.max(ranked).alias("_best"))
    return with_exit(best.select(key, "_best.outcome", "_best.reason"))


def decide_report(
    prefiltered: DataFrame, decided: DataFrame, consensus: DataFrame, enrichment: DataFrame, traces: DataFrame
) -> DataFrame:
    """Final decision per package.

    ``prefiltered`` carries ``reason`` and ``source_unavailable``; bytes nobody inspected never
    end up safe.  A consensus replaces the prefilter decision; enrichment and trace decisions
    compete with whichever of the two stands.
    """
    own = decided.select("package_id", "outcome", F.col("reason").alias("outcome_reason"))
    return decide_packages(prefiltered.join(many(own), "package_id"), consensus, enrichment, traces)


def decide_packages(rows: DataFrame, consensus: DataFrame, enrichment: DataFrame, traces: DataFrame) -> DataFrame:
    """The same from rows that hold the prefilter's ``outcome, outcome_reason`` beside ``reason, source_unavailable``.

    The other decisions are ``package_id, outcome, reason``; a package may have many of them (``ord`` says in which order).
    """
    voted = consensus.select("package_id", F.col("outcome").alias("_voted"), F.col("reason").alias("_summary"))
    base = rows.join(many(voted), "package_id", "left")
    unseen = F.when(F.length("reason") > 0, F.col("reason")).otherwise("Source bytes unavailable; manual review required")
    first = base.select(
        "package_id",
        F.when(F.col("source_unavailable"), "needs_review").otherwise(F.coalesce("_voted", "outcome")).alias("outcome"),
        F.when(F.col("source_unavailable"), unseen).otherwise(F.coalesce("_summary", "outcome_reason")).alias("reason"),
        F.lit(0).cast("bigint").alias("ord"),
        F.lit(True).alias("_known"),
    )
    order = lambda d: F.col("ord") if "ord" in d.columns else F.lit(0)
    rest = [
        strongest(d.select(*DECISION, order(d).cast("bigint").alias("ord")), "package_id", "ord").select(
            *DECISION, F.lit(i).cast("bigint").alias("ord"), F.lit(False).alias("_known")
        )
        for i, d in ((1, enrichment), (2, traces))
    ]
    every = first.unionByName(rest[0]).unionByName(rest[1])
    # One grouping decides and drops decisions on packages nobody listed, so contents are scanned once.
    ranked = F.struct(P.outcome_rank(F.col("outcome")).alias("rank"), (-F.col("ord")).alias("earlier"), "outcome", "reason")
    best = every.groupBy("package_id").agg(F.max(ranked).alias("_best"), F.bool_or("_known").alias("_known")).filter("_known")
    return with_exit(best.select("package_id", "_best.outcome", "_best.reason"))


def scan_summary(decisions: DataFrame, key: str = "scan_id") -> DataFrame:
    """Counts of outcomes per scan."""
    n = lambda outcome: F.count_if(F.col("outcome") == outcome)
    return decisions.groupBy(key).agg(
        F.count("outcome").alias("total"),
        n("safe").alias("safe"),
        n("needs_review").alias("suspicious"),
        n("malicious").alias("malicious"),
        n("error").alias("errors"),
    )


def scan_decisions(scans: DataFrame, decisions: DataFrame) -> DataFrame:
    """Strongest decision per scan; a scan without packages is safe."""
    best = strongest(decisions, "scan_id", "ord")
    joined = scans.select("scan_id").join(many(best), "scan_id", "left")
    empty = F.col("outcome").isNull()
    return joined.select(
        "scan_id",
        F.when(empty, "safe").otherwise(F.col("outcome")).alias("outcome"),
        F.when(empty, "No packages scanned").otherwise(F.col("reason")).alias("reason"),
        F.coalesce("exit_code", F.lit(0)).alias("exit_code"),
        F.coalesce("should_block_install", F.lit(False)).alias("should_block_install"),
    )


# -- reports ----------------------------------------------------------------------------
def report_json(reports: DataFrame) -> DataFrame:
    """One JSON document per package: package, prefilter, consensus and the decision."""
    document = F.struct(
        F.struct("name", "version", "ecosystem").alias("package"),
        F.struct("level", "passed", F.col("prefilter_reason").alias("reason"), "source_unavailable").alias("prefilter"),
        F.when(F.col("verdict").isNotNull(), F.struct("verdict", "confidence")).alias("consensus"),
        F.col("outcome").alias("decision"),
        "exit_code",
        "should_block_install",
    )
    return reports.select("package_id", F.to_json(document).alias("document"))


def sarif_level(verdict: Column) -> Column:
    return (
        F.when(verdict == "malicious", "error")
        .when(verdict.isin("suspicious", "needs_human_review"), "warning")
        .when(verdict == "safe", "note")
        .otherwise("none")
    )


def report_sarif(reports: DataFrame, rule_id: str = "supply-chain-risk") -> DataFrame:
    """SARIF result columns per package; without consensus the verdict counts as safe."""
    verdict = F.coalesce("verdict", F.lit("safe"))
    listed = F.when(F.size("signals") > 0, F.array_join("signals", ", ")).otherwise("none")
    text = F.concat(
        F.lit("Package "), F.col("name"), F.lit("@"), F.col("version"), F.lit(" ("), F.col("ecosystem"), F.lit("): "),
        F.col("reason"), F.lit(". Risk signals: "), listed,
    )
    return reports.select(
        "package_id",
        F.lit(rule_id).alias("rule_id"),
        sarif_level(verdict).alias("level"),
        text.alias("message"),
        verdict.alias("verdict"),
        F.coalesce("confidence", F.lit(0.0)).alias("confidence"),
        "ecosystem",
    )


def sarif_result(results: DataFrame) -> DataFrame:
    """SARIF result objects, one JSON text per package."""
    result = F.struct(
        F.col("rule_id").alias("ruleId"),
        "level",
        F.struct(F.col("message").alias("text")).alias("message"),
        F.struct("verdict", "confidence", "ecosystem").alias("properties"),
    )
    return results.select("package_id", F.to_json(result).alias("result"))
