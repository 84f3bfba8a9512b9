"""Package prefilter: every static signal of a package, its risk level and its first decision."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkwarden import values as V
from sparkwarden.functions import patterns as P
from sparkwarden.functions.joins import many
from sparkwarden.operators import evasion as EV
from sparkwarden.operators import files as FL
from sparkwarden.operators import scan as SC
from sparkwarden.rules import Rule, select_rules

SIGNAL_COLUMNS = ["package_id", "category", "severity", "key", "text", "evasion"]


# -- lists and metadata -----------------------------------------------------------------
def allow_block(packages: DataFrame, lists: DataFrame) -> DataFrame:
    """Block wins over allow; packages on neither list keep a null level and go on to scanning."""
    listed = lists.groupBy("name").agg(
        F.bool_or(F.col("list") == "block").alias("blocked"), F.bool_or(F.col("list") == "allow").alias("allowed")
    )
    named = packages.join(many(listed), "name", "left")
    return named.select(
        "package_id",
        "name",
        F.when(F.col("blocked"), "CRITICAL").when(F.col("allowed"), "NONE").alias("level"),
        F.when(F.col("blocked"), False).when(F.col("allowed"), True).alias("passed"),
        F.when(F.col("blocked"), F.concat(F.lit("Package '"), F.col("name"), F.lit("' is in the blocklist")))
        .when(F.col("allowed"), F.concat(F.lit("Package '"), F.col("name"), F.lit("' is whitelisted")))
        .alias("reason"),
    )


def metadata_signals_of() -> Column:
    def blank(name: str) -> Column:
        return F.coalesce(F.length(name), F.lit(0)) == 0

    downloads = F.col("download_count")
    low = F.concat(F.lit("low_downloads: only "), downloads.cast("string"), F.lit(" downloads"))
    return SC.gather(
        [
            F.when(blank("author"), SC.signal("no_author", "LOW", F.lit("no_author: package has no author information"))),
            F.when(
                blank("repository") & blank("homepage"),
                SC.signal("no_repo", "LOW", F.lit("no_repo: no repository or homepage URL")),
            ),
            F.when((downloads > 0) & (downloads < 100), SC.signal("low_downloads", "LOW", low)),
            F.when(
                F.col("has_install_scripts"),
                SC.signal("has_install_scripts", "LOW", F.lit("has_install_scripts: package has install-time scripts")),
            ),
        ]
    )


def metadata_anomalies(packages: DataFrame) -> DataFrame:
    return SC.exploded(packages, metadata_signals_of()).select("package_id", "category", "severity", "text")


# -- signals ----------------------------------------------------------------------------
def file_signals(
    files: DataFrame, as_of: int, rules: list[Rule] | None = None, entropy_threshold: float = SC.ENTROPY_THRESHOLD
) -> DataFrame:
    """Every signal of every file from one pass over the contents."""
    rules = select_rules() if rules is None else rules
    staged = SC.with_literals(files, SC.rule_tests(rules) + SC.BEHAVIOUR_TESTS, EV.ANCHORS)
    facts = F.struct(
        SC.hits_of(rules, "ecosystem" in files.columns).alias("hits"),
        SC.behaviours_of().alias("behaviours"),
        FL.content_type(F.col("content")).alias("detected"),
    )
    staged = staged.select("*", P.once(facts).alias("_facts")).select("*", "_facts.*").drop("_facts")
    tagged = SC.tag_hits()
    signals = F.concat(
        SC.rule_signals(rules),
        EV.evasion_signals_of(as_of),
        SC.crate_signals_of(),
        SC.pod_signals_of(),
        SC.mismatch_signals_of(F.col("detected")),
        SC.compound_signals_of(F.size(tagged), SC.hit_tags(rules, tagged)),
        SC.chain_signals_of(F.col("behaviours")),
        SC.entropy_signals_of(F.col("content"), entropy_threshold),
    )
    return SC.exploded(staged, signals)


def risk_rank(n_high: Column, n_medium: Column, n_typosquat: Column, n_signals: Column) -> Column:
    """NONE..CRITICAL as 0..4 from the signal counts of a package."""
    escalating = n_medium + n_typosquat
    return (
        F.when(n_signals == 0, 0)
        .when(n_high >= 2, 4)
        .when(n_high >= 1, 3)
        .when((n_medium >= 3) | (escalating >= 4), 3)
        .when(escalating >= 1, 2)
        .otherwise(1)
    )


def signal_counts(signals: DataFrame, collapse: bool = True) -> DataFrame:
    """Per package: the counts behind its level and its evasion gate.

    Aggregates (package, category, key), then (package, category), then package, so a package
    with very many signals is reduced on the map side at every step.  Clusters of LOW/MEDIUM
    evasion signals count as one signal, as :func:`evasion.collapse_signals` would make them.
    """
    rank = P.severity_rank(F.col("severity"))
    typed = signals.select("package_id", "category", "evasion", "key", rank.alias("rank"))
    high = (F.col("rank") >= 3) & ~F.col("evasion")
    medium = (F.col("rank") == 2) | (F.col("evasion") & (F.col("rank") >= 3))
    keys = typed.groupBy("package_id", "category", "evasion", "key").agg(
        F.count("*").alias("n"),
        F.count_if(high).alias("n_high"),
        F.count_if(F.col("evasion") & (F.col("rank") >= 3)).alias("n_evasion_high"),
        F.max(medium.cast("int")).alias("is_medium"),
        F.max("rank").alias("rank"),
    )
    categories = keys.groupBy("package_id", "category", "evasion").agg(
        F.sum("n").alias("n"),
        F.sum("n_high").alias("n_high"),
        F.sum("n_evasion_high").alias("n_evasion_high"),
        F.sum("is_medium").alias("n_medium"),
        F.max("rank").alias("rank"),
    )
    clustered = F.lit(collapse) & F.col("evasion") & (F.col("n_evasion_high") == 0) & (F.col("n") >= V.COLLAPSE_THRESHOLD)
    settled = categories.select(
        "package_id",
        "category",
        "evasion",
        "rank",
        F.when(clustered, 1).otherwise(F.col("n")).alias("n"),
        "n_high",
        F.when(clustered, (F.col("rank") == 2).cast("int")).otherwise(F.col("n_medium")).alias("n_medium"),
    )
    is_evasion = F.col("evasion")
    return settled.groupBy("package_id").agg(
        F.sum("n").alias("n_signals"),
        F.sum("n_high").alias("n_high"),
        F.sum("n_medium").alias("n_medium"),
        F.sum(F.when(F.col("category") == "typosquat_candidate", F.col("n")).otherwise(0)).alias("n_typosquat"),
        F.count_if(is_evasion & (F.col("rank") >= 3)).alias("n_evasion_high"),
        F.count_if(is_evasion & (F.col("rank") >= 2)).alias("n_evasion_medium"),
        F.count_if(is_evasion).alias("n_evasion"),
        F.count_if(is_evasion & (F.col("category") == "direct_xpc")).alias("n_xpc"),
    )


def package_counts(packages: DataFrame, signals: DataFrame, collapse: bool = True) -> DataFrame:
    """:func:`signal_counts` of every package, zero where nothing was signalled."""
    return packages.select("package_id").distinct().join(many(signal_counts(signals, collapse)), "package_id", "left").fillna(0)


def risk_levels(packages: DataFrame, signals: DataFrame, collapse: bool = True) -> DataFrame:
    """Level of every package; NONE without signals."""
    counts = package_counts(packages, signals, collapse)
    rank = risk_rank(F.col("n_high"), F.col("n_medium"), F.col("n_typosquat"), F.col("n_signals"))
    return counts.select("package_id", "n_signals", "n_high", "n_medium", P.severity_name(rank).alias("level"))


def needs_review(level: Column) -> Column:
    return level.isin("MEDIUM", "HIGH", "CRITICAL")


def level_gate(prefilter: DataFrame) -> DataFrame:
    """Only packages whose level asks for a review."""
    return prefilter.filter(needs_review(F.col("level")))


def decide_level(level: Column) -> Column:
    return F.when(level.isin("HIGH", "CRITICAL"), 2).when(level == "MEDIUM", 1).otherwise(0)


def prefilter(
    packages: DataFrame,
    files: DataFrame,
    lists: DataFrame,
    as_of: int,
    typosquats: DataFrame | None = None,
    rules: list[Rule] | None = None,
    entropy_threshold: float = SC.ENTROPY_THRESHOLD,
) -> DataFrame:
    """Level, pass flag, reason and decision inputs of every package.

    ``files.ecosystem`` is that of the package.  Contents are scanned where they lie; only the
    counts of the narrow signals meet the package table, and those of listed packages fall away there.
    """
    listed = allow_block(packages, lists)
    settled = listed.filter("level IS NOT NULL")
    open_packages = packages.join(many(settled.select("package_id")), "package_id", "left_anti")
    signals = file_signals(files, as_of, rules, entropy_threshold).select(*SIGNAL_COLUMNS)
    signals = signals.unionByName(SC.exploded(open_packages, metadata_signals_of()).select(*SIGNAL_COLUMNS))
    if typosquats is not None:
        signals = signals.unionByName(
            typosquats.select(
                "package_id",
                F.lit("typosquat_candidate").alias("category"),
                F.lit("MEDIUM").alias("severity"),
                F.col("text").alias("key"),
                "text",
                F.lit(False).alias("evasion"),
            )
        )
    counts = open_packages.select("package_id").join(many(signal_counts(signals)), "package_id", "left")
    counts = counts.fillna(0)
    rank = risk_rank(F.col("n_high"), F.col("n_medium"), F.col("n_typosquat"), F.col("n_signals"))
    level = P.severity_name(rank)
    scored = counts.select(
        "package_id",
        level.alias("level"),
        F.when(F.col("n_signals") == 0, "No risk signals detected")
        .otherwise(F.concat(F.lit("Found "), F.col("n_signals").cast("string"), F.lit(" risk signal(s)")))
        .alias("reason"),
        "n_signals",
        "n_evasion_high",
        "n_evasion_medium",
        "n_evasion",
        "n_xpc",
    )
    early = settled.select(
        "package_id",
        "level",
        "reason",
        F.when(F.col("level") == "CRITICAL", 1).otherwise(0).cast("bigint").alias("n_signals"),
        *[F.lit(0).cast("bigint").alias(c) for c in ("n_evasion_high", "n_evasion_medium", "n_evasion", "n_xpc")],
    )
    both = scored.unionByName(early)
    # A blocked package never passes although it goes to no review.
    return both.withColumn("needs_review", needs_review(F.col("level")) & ~F.col("reason").endswith("is in the blocklist")).withColumn(
        "passed", ~needs_review(F.col("level"))
    )


def static_rank(darwin: bool = False) -> Column:
    """Rank of the outcome from the level and the static evasion gate."""
    return EV.gate(
        decide_level(F.col("level")),
        F.col("n_evasion_high"),
        F.lit(0),
        F.col("n_evasion_medium"),
        (F.col("n_evasion") == 1) & (F.col("n_xpc") == 1),
        F.lit(darwin),
    )


def decide_prefilter(prefiltered: DataFrame, darwin: bool = False) -> DataFrame:
    """Outcome, exit code and block flag from the level and the static evasion gate."""
    return prefiltered.withColumn("_rank", static_rank(darwin)).select(
        "package_id",
        "level",
        "reason",
        P.outcome_name(F.col("_rank")).alias("outcome"),
        F.col("_rank").cast("int").alias("exit_code"),
        (F.col("_rank") == 2).alias("should_block_install"),
    )


def uninspected_override(prefiltered: DataFrame, flags: DataFrame, decide: bool = False, darwin: bool = False) -> DataFrame:
    """Packages whose bytes were not inspected: level MEDIUM, not passed, no automatic review.

    With ``decide`` the prefilter's own ``outcome`` and ``outcome_reason`` stand in the same row, so contents are scanned once for both.

    ``flags`` has ``package_id, oversized, unavailable`` (messages or null); an unavailable
    source is applied after an oversized archive and so decides the reason.
    """
    joined = prefiltered.join(many(flags), "package_id", "left")
    hit = F.col("oversized").isNotNull() | F.col("unavailable").isNotNull()
    added = F.array_compact(
        F.array(
            F.when(F.col("oversized").isNotNull(), F.concat(F.lit("archive_oversized(HIGH): "), F.col("oversized"))),
            F.when(F.col("unavailable").isNotNull(), F.concat(F.lit("source_unavailable(HIGH): "), F.col("unavailable"))),
        )
    )
    seen = [
        "package_id",
        F.when(hit, "MEDIUM").otherwise(F.col("level")).alias("level"),
        F.when(hit, False).otherwise(F.col("passed")).alias("passed"),
        F.when(hit, False).otherwise(F.col("needs_review")).alias("needs_review"),
        F.when(F.col("unavailable").isNotNull(), "Source bytes unavailable; manual review required")
        .when(F.col("oversized").isNotNull(), "Archive exceeds size cap; manual review required")
        .otherwise(F.col("reason"))
        .alias("reason"),
        F.array_join(added, "; ").alias("added_signals"),
        hit.alias("source_unavailable"),
    ]
    if not decide:
        return joined.select(*seen)
    return joined.withColumn("_rank", static_rank(darwin)).select(*seen, P.outcome_name(F.col("_rank")).alias("outcome"), F.col("reason").alias("outcome_reason"))
