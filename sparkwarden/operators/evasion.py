"""Static evasion detectors and the rules that weigh their signals.

A detector is a pair of column builders: signals of one file, and (in ``operators.traces``) a
test over the events of one run.  ``DETECTORS`` is the extension point.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkwarden import values as V
from sparkwarden.functions import patterns as P
from sparkwarden.operators import files as FL
from sparkwarden.operators.scan import SIGNAL_TYPE, exploded, gather, no_signals, signal


def evasion(category: str, severity: str, description: Column) -> Column:
    text = F.concat(F.lit(f"{category}({severity}): "), description)
    return signal(category, severity, text, evasion=True)


ANCHORS = [x for group in V.EVASION_ANCHORS.values() for x in group]


def present(detector: str) -> Column:
    """Whether the staged file holds a literal the detector needs (column ``found``)."""
    return F.arrays_overlap(F.col("found"), P.strings(V.EVASION_ANCHORS[detector]))


def env_mutation(as_of: int) -> Column:
    """Assignments to sensitive environment variables, one signal per match."""
    matches = F.when(
        present("env_mutation"), P.every(F.col("content"), V.ENV_MUTATION, ignore_case=True)
    ).otherwise(F.array().cast("array<string>"))
    return F.transform(
        matches,
        lambda m: evasion(
            "env_mutation", "HIGH", F.concat(F.lit("sensitive env mutation in "), F.col("path"), F.lit(": "), F.substring(m, 1, 80))
        ),
    ).cast(SIGNAL_TYPE)


def time_bomb(as_of: int) -> Column:
    """Clock comparisons with an epoch after ``as_of`` or a year after the last plain one."""
    empty = F.array().cast("array<string>")
    epochs = F.when(present("future_epoch"), P.every(F.col("content"), V.FUTURE_EPOCH, 1)).otherwise(empty)
    years = F.when(present("future_year"), P.every(F.col("content"), V.FUTURE_YEAR, 1)).otherwise(empty)
    # Past 38 digits the number cannot be held, but it is certainly in the future.
    later = F.filter(epochs, lambda e: F.coalesce(e.try_cast("decimal(38,0)") > as_of, F.lit(True)))
    gated = F.transform(
        later, lambda e: evasion("time_bomb", "HIGH", F.concat(F.lit("time.time() gate in "), F.col("path"), F.lit(": future epoch "), e))
    )
    dated = F.transform(
        F.filter(years, lambda y: y.cast("int") > V.LAST_PLAIN_YEAR),
        lambda y: evasion("time_bomb", "HIGH", F.concat(F.lit("datetime gate in "), F.col("path"), F.lit(": future year "), y.cast("int").cast("string"))),
    )
    return F.concat(gated.cast(SIGNAL_TYPE), dated.cast(SIGNAL_TYPE))


def build_hooks(as_of: int) -> Column:
    """Lifecycle scripts of package.json, setup.py that spawns processes, Rust build scripts."""
    path, content = F.col("path"), F.col("content")
    manifest = path.endswith("package.json") & P.is_json(content)
    scripts = F.from_json(content, "scripts map<string,string>")["scripts"]
    parts = []
    for key in V.LIFECYCLE_KEYS:
        command = F.element_at(scripts, key)
        text = F.concat(F.lit("npm lifecycle hook in "), path, F.lit(f": {key}="), F.substring(command, 1, 60))
        parts.append(F.when(manifest & command.isNotNull(), evasion("build_hooks", "MEDIUM", text)))
    spawns = path.endswith("setup.py") & present("setup_exec") & P.found(content, V.SETUP_EXEC)
    parts.append(F.when(spawns, evasion("build_hooks", "MEDIUM", F.concat(F.lit("setup.py invokes subprocess: "), path))))
    parts.append(
        F.when(path.endswith("build.rs"), evasion("build_hooks", "MEDIUM", F.concat(F.lit("Rust build script present: "), path)))
    )
    return gather(parts)


def derived_exfil(as_of: int) -> Column:
    """Content that is encoded next to a network call, outside bundles."""
    path, content = F.col("path"), F.col("content")
    hit = present("derived_exfil") & (P.found(content, V.ENCODE_THEN_SEND, dotall=True) | P.found(content, V.READ_THEN_ENCODE, dotall=True))
    text = F.concat(F.lit("derived exfil pattern in "), path, F.lit(" (encode+send)"))
    return gather([F.when(~P.contains_any(path, V.BUNDLE_PATH_PARTS) & hit, evasion("derived_exfil", "HIGH", text))])


def direct_xpc(as_of: int) -> Column:
    """Direct system IPC: XPC or Mach ports, and raw D-Bus."""
    path, content = F.col("path"), F.col("content")
    xpc = present("xpc") & P.found(content, V.XPC_TOKENS)
    dbus = present("dbus") & P.found(content, V.DBUS_TOKENS)
    return gather(
        [
            F.when(xpc, evasion("direct_xpc", "MEDIUM", F.concat(F.lit("macOS XPC bypass tokens in "), path))),
            F.when(dbus, evasion("direct_xpc", "MEDIUM", F.concat(F.lit("Linux D-Bus bypass tokens in "), path))),
        ]
    )


def anti_debug(as_of: int) -> Column:
    """Checks for a debugger or a tracer."""
    path, content = F.col("path"), F.col("content")
    hit = present("anti_debug") & P.found(content, V.ANTI_DEBUG)
    text = F.concat(F.lit("anti-debug/anti-trace pattern in "), path)
    return gather([F.when(hit, evasion("anti_debug", "HIGH", text))])


DETECTORS: list[Callable[[int], Column]] = [env_mutation, time_bomb, build_hooks, derived_exfil, direct_xpc, anti_debug]


def evasion_signals_of(as_of: int, detectors: list[Callable[[int], Column]] | None = None) -> Column:
    """Signals of every detector for a staged file (needs ``path, content, found``)."""
    arrays = [d(as_of) for d in (DETECTORS if detectors is None else detectors)]
    return F.concat(*arrays) if arrays else no_signals()


def evasion_static(files: DataFrame, as_of: int, detectors: list[Callable[[int], Column]] | None = None) -> DataFrame:
    """One row per static evasion signal of every file; ``as_of`` is the epoch that counts as now."""
    found = P.once(P.literals_in(F.col("content"), ANCHORS)).alias("found")
    staged = files.select("package_id", "path", "content", found)
    return exploded(staged, evasion_signals_of(as_of, detectors)).drop("evasion")


def collapse_signals(signals: DataFrame, threshold: int = V.COLLAPSE_THRESHOLD) -> DataFrame:
    """Replace clusters of LOW/MEDIUM signals of one category by one row of their top severity.

    A category that also holds HIGH or CRITICAL keeps every row.  Cluster sizes come from a
    partial aggregation; kept rows meet them in a join, which a hot key cannot overload.
    """
    rank = P.severity_rank(F.col("severity"))
    sizes = signals.groupBy("package_id", "category").agg(
        F.count_if(rank >= 3).alias("_high"), F.count("*").alias("_n"), F.max(rank).alias("_rank")
    )
    clusters = sizes.filter((F.col("_high") == 0) & (F.col("_n") >= threshold))
    kept = signals.join(clusters.select("package_id", "category"), ["package_id", "category"], "left_anti")
    collapsed = clusters.select(
        "package_id",
        "category",
        P.severity_name(F.col("_rank")).alias("severity"),
        collapsed_text(F.col("category"), F.col("_rank"), F.col("_n")).alias("text"),
    )
    return kept.select("package_id", "category", "severity", "text").unionByName(collapsed)


def collapsed_text(category: Column, rank: Column, n: Column) -> Column:
    return F.concat(
        category, F.lit("("), P.severity_name(rank), F.lit("): multi_evasion_pattern: "), n.cast("string"), F.lit(" signals aggregated")
    )


def category_severity(static: DataFrame, dynamic: DataFrame, key: str = "package_id") -> DataFrame:
    """Highest severity per category, at least LOW; an observed category counts as MEDIUM."""
    ranked = static.select(key, "category", P.severity_rank(F.col("severity")).alias("_rank"), F.lit(False).alias("_seen"))
    seen = dynamic.select(key, "category", F.lit(2).alias("_rank"), F.lit(True).alias("_seen"))
    return (
        ranked.unionByName(seen)
        .groupBy(key, "category")
        .agg(F.greatest(F.max("_rank"), F.lit(1)).alias("rank"), F.bool_or("_seen").alias("confirmed"))
        .select(key, "category", P.severity_name(F.col("rank")).alias("severity"), "confirmed")
    )


def gate(verdict_rank: Column, n_high: Column, n_confirmed_high: Column, n_medium: Column, only_xpc: Column, darwin: Column) -> Column:
    """Rank of the outcome after the multi-evasion gate; never lower than before."""
    review = F.greatest(verdict_rank, F.lit(1))
    return (
        F.when(darwin & only_xpc, review)
        .when((n_high >= 2) & (n_confirmed_high >= 1), 2)
        .when(n_medium >= 2, review)
        .otherwise(verdict_rank)
    )


def gate_counts(categories: DataFrame, key: str = "package_id") -> DataFrame:
    """Per key: categories at HIGH or above, confirmed ones among them, at MEDIUM or above, XPC alone."""
    rank = P.severity_rank(F.col("severity"))
    return categories.groupBy(key).agg(
        F.count_if(rank >= 3).alias("n_high"),
        F.count_if((rank >= 3) & F.col("confirmed")).alias("n_confirmed_high"),
        F.count_if(rank >= 2).alias("n_medium"),
        F.bool_and(F.col("category") == "direct_xpc").alias("only_xpc"),
    )


def evasion_gate(verdicts: DataFrame, categories: DataFrame, key: str = "package_id") -> DataFrame:
    """Outcome of every verdict row (``key, outcome, platform``) after the gate."""
    counted = verdicts.join(gate_counts(categories, key), key, "left").fillna(
        0, ["n_high", "n_confirmed_high", "n_medium"]
    ).fillna(False, ["only_xpc"])
    rank = gate(
        P.outcome_rank(F.col("outcome")),
        F.col("n_high"),
        F.col("n_confirmed_high"),
        F.col("n_medium"),
        F.col("only_xpc"),
        F.coalesce(F.col("platform") == "Darwin", F.lit(False)),
    )
    return counted.select(key, F.col("outcome").alias("outcome_before"), P.outcome_name(rank).alias("outcome"))
