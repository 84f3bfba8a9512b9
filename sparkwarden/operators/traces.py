"""Sandbox traces: parsing, stitching, correlation, health and decisions.

All parsers are column expressions, so the same functions serve batch and streaming frames.
Runs can be skewed: per-run results come from partial aggregations, and the two rules that
depend on line order use the range-wise helpers of ``functions.ordered``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkwarden import values as V
from sparkwarden.functions import patterns as P
from sparkwarden.functions.joins import many
from sparkwarden.functions.ordered import previous
from sparkwarden.operators import detectors as DT
from sparkwarden.operators import evasion as EV

CANARY_MARKER = "/observer-canary"


# -- JSON traces ------------------------------------------------------------------------
def json_event(line: Column) -> Column:
    """An event from a JSON line, null for anything else.

    Missing, null and empty numbers count as 0, fractions are cut off, true is 1; text must be a whole
    number; other values drop the line.
    """
    text = P.strip(line)

    def event(t: Column, e: Column) -> Column:
        # Only a value that is no whole number is read again, as a JSON number and as a JSON boolean.
        typed = lambda name, kind: F.from_json(t, f"{name} {kind}")[name].try_cast("bigint")
        number = lambda name: F.coalesce(
            F.coalesce(F.nullif(e[name], F.lit("")), F.lit("0")).try_cast("bigint"), typed(name, "double"), typed(name, "boolean")
        )
        fields = F.struct(
            e["kind"].alias("kind"),
            number("ts_ms").alias("ts_ms"),
            number("pid").alias("pid"),
            F.coalesce(e["process"], F.lit("")).alias("process"),
            F.coalesce(e["target"], F.lit("")).alias("target"),
            t.alias("raw"),
        )
        return F.when((F.length(e["kind"]) > 0) & number("ts_ms").isNotNull() & number("pid").isNotNull(), fields)

    schema = "kind string, ts_ms string, pid string, process string, target string"
    object_ = lambda t: F.from_json(F.when(t.startswith("{") & P.is_json(t), t), schema)
    return P.let(text, lambda t: P.let(object_(t), lambda e: event(t, e)))


def trace_json_events(lines: DataFrame) -> DataFrame:
    """Events of JSON-line traces (``run_id, line_no, line``)."""
    parsed = F.filter(F.array(json_event(F.col("line"))), lambda e: e.isNotNull())
    return lines.select("run_id", "line_no", F.explode(parsed).alias("_e")).select("run_id", "line_no", "_e.*")


def scrub_tokens(events: DataFrame, tokens: DataFrame, placeholder: str = "[REDACTED]") -> DataFrame:
    """Replace the secret of a run wherever it shows in ``target``, ``raw`` or a word of ``argv``."""
    joined = events.join(tokens.select("run_id", "token"), "run_id", "left")
    for name in ("target", "raw"):
        clean = F.replace(F.col(name), F.col("token"), F.lit(placeholder))
        joined = joined.withColumn(name, F.when(F.length("token") > 0, clean).otherwise(F.col(name)))
    if "argv" in events.columns:
        words = F.transform("argv", lambda w: F.replace(w, F.col("token"), F.lit(placeholder)))
        joined = joined.withColumn("argv", F.when(F.length("token") > 0, words).otherwise(F.col("argv")))
    return joined.drop("token")


# -- system-call traces -----------------------------------------------------------------
def syscall_lines(lines: DataFrame) -> DataFrame:
    """Lines of a traced process split into ``pid``, ``tail`` and their form; others are dropped."""
    line = F.regexp_replace("line", "\r+$", "")
    pid = F.concat(P.first(line, V.TRACE_PID, 1), P.first(line, V.TRACE_PID, 2))
    tail = F.regexp_replace(line, P.java(V.TRACE_PID), "")
    form = (
        F.when(P.found(F.col("tail"), V.TRACE_RESUMED, dotall=True), "resumed")
        .when(P.found(F.col("tail"), V.TRACE_UNFINISHED, dotall=True), "unfinished")
        .when(P.found(F.col("tail"), V.TRACE_CALL, dotall=True), "complete")
    )
    parts = P.once(F.struct(pid.alias("pid"), tail.alias("tail"))).alias("_p")
    split = lines.select("run_id", "line_no", parts).select("run_id", "line_no", "_p.*")
    row = {"pid": F.col("pid").try_cast("bigint"), "tail": F.col("tail"), "form": form}
    kept = P.kept(row, lambda r: r["pid"].isNotNull() & r["form"].isNotNull())
    return split.select("run_id", "line_no", kept.alias("_l")).select("run_id", "line_no", "_l.*")


def unfinished_args(tail: Column) -> Column:
    return P.first(tail, V.TRACE_UNFINISHED, 2, dotall=True)


def resumed_text(tail: Column, args: Column) -> Column:
    """Whole call text from a resumed line and the arguments seen before it."""
    call, rest = P.first(tail, V.TRACE_RESUMED, 1, dotall=True), P.first(tail, V.TRACE_RESUMED, 2, dotall=True)
    return F.concat(call, F.lit("("), args, F.lit(" "), rest)


def stitch_syscalls(split: DataFrame) -> DataFrame:
    """Resumed calls joined with the unfinished line right before them in the same process.

    An unfinished line that another one follows is overwritten, a resumed line uses it up; so a
    resumed line is matched exactly when the preceding marker of its process is unfinished.
    """
    marks = split.filter("form <> 'complete'")
    marks = previous(marks, ["run_id", "pid"], "line_no", F.struct("form", "tail"), "_before")
    matched = marks.filter((F.col("form") == "resumed") & (F.col("_before.form") == "unfinished"))
    text = resumed_text(F.col("tail"), unfinished_args(F.col("_before.tail")))
    whole = P.kept({"tail": text}, lambda r: P.found(r["tail"], V.TRACE_CALL, dotall=True))
    return matched.select("run_id", "line_no", "pid", whole.alias("_t")).select("run_id", "line_no", "pid", "_t.tail")


def events_of_calls(calls: DataFrame, marker: str = CANARY_MARKER) -> DataFrame:
    """Events from the texts of complete calls; calls of other kinds and failed clones yield none."""
    ids = ["run_id", "line_no", "pid"]
    row = {
        "call": P.first(F.col("tail"), V.TRACE_CALL, 1, dotall=True),
        "args": P.first(F.col("tail"), V.TRACE_CALL, 2, dotall=True),
        "ret": P.strip(P.first(F.col("tail"), V.TRACE_CALL, 3, dotall=True)),
    }
    wanted = lambda r: r["call"].isin("connect", "openat", "execve", "write", "clone", "clone3")
    parts = calls.select(*ids, P.kept(row, wanted).alias("_c")).select(*ids, "_c.*")
    c, a = F.col("call"), F.col("args")
    only = lambda call, value: F.when(c == call, value).otherwise("")
    found = F.struct(
        only("connect", P.first(a, V.TRACE_INET4, 1)).alias("port4"),
        only("connect", P.first(a, V.TRACE_INET4, 2)).alias("ip4"),
        only("connect", P.first(a, V.TRACE_INET6, 1)).alias("port6"),
        only("connect", P.first(a, V.TRACE_UNIX, 1)).alias("unix"),
        only("openat", P.first(a, V.TRACE_OPENAT, 1)).alias("opened"),
        only("openat", P.first(a, V.TRACE_OPENAT, 2)).alias("flags"),
        only("execve", P.first(a, r'^\s*"([^"]+)"')).alias("program"),
        only("execve", P.first(a, r"^[^\[]*\[(.*)\]", 1, dotall=True)).alias("listed"),
        only("write", P.first(a, r"^\s*(\d+),")).alias("fd"),
        P.first(F.col("ret"), r"^(-?\d+)").try_cast("bigint").alias("child"),
    )
    fields = parts.select(*ids, "call", "args", P.once(found).alias("_f")).select(*ids, "call", "args", "_f.*")
    port = F.coalesce(*[F.when(F.col(p) != "", F.col(p)) for p in ("port4", "port6")]).try_cast("bigint")
    address = F.when(F.col("port4") != "", F.col("ip4")).otherwise("[ipv6]")
    connect = (
        F.when(port == 53, F.concat(F.lit("resolver="), address))
        .when(port.isNotNull(), F.concat(address, F.lit(":"), port.cast("string")))
        .when(F.col("unix") != "", F.concat(F.lit("unix:"), F.col("unix")))
        .otherwise(F.substring(a, 1, 80))
    )
    canary = F.col("opened") == marker
    writes = F.arrays_overlap(F.split("flags", r"\|"), P.strings(V.WRITE_FLAGS))
    kind = (
        F.when(c == "connect", F.when(port == 53, "dns").otherwise("connect"))
        .when((c == "openat") & (F.col("opened") != ""), F.when(canary, "observer_canary").when(writes, "write").otherwise("open"))
        .when((c == "execve") & (F.col("program") != ""), "exec")
        .when(c == "write", "write")
        .when(c.isin("clone", "clone3") & (F.col("child") > 0), "clone")
    )
    target = (
        F.when(c == "connect", connect)
        .when(c == "openat", F.col("opened"))
        .when(c == "execve", F.col("program"))
        .when(c == "write", F.concat(F.lit("fd="), F.when(F.col("fd") == "", "?").otherwise(F.col("fd"))))
        .otherwise(F.concat(F.lit("child_pid="), F.col("child").cast("string")))
    )
    kept = F.when(c == "execve", F.substring(a, 1, 120)).when(c.isin("write", "clone", "clone3"), F.substring(a, 1, 80)).otherwise(a)
    event = {
        "kind": kind,
        "target": target,
        "argv": F.regexp_extract_all("listed", F.lit(V.TRACE_QUOTED), F.lit(1)),
        "source": F.when((c == "openat") & canary, "observer_canary"),
        "raw": F.concat(F.when(c == "clone3", "clone").otherwise(c), F.lit("("), kept, F.lit(")")),
    }
    events = fields.select(*ids, P.kept(event, lambda e: e["kind"].isNotNull()).alias("_e"))
    return events.select(*ids, "_e.*")


def trace_syscall_events(lines: DataFrame, marker: str = CANARY_MARKER) -> DataFrame:
    """Events of system-call traces, from complete lines and from stitched pairs."""
    split = syscall_lines(lines)
    complete = split.filter("form = 'complete'").select("run_id", "line_no", "pid", "tail")
    return events_of_calls(complete.unionByName(stitch_syscalls(split)), marker)


# -- filters and joins ------------------------------------------------------------------
def is_real(source: Column) -> Column:
    return ~F.coalesce(source, F.lit("")).isin(V.SYNTHETIC_SOURCES)


def real_events(events: DataFrame) -> DataFrame:
    """Events the traced package caused, without those of the sandbox itself."""
    return events.filter(is_real(F.col("source")))


def touches_decoy(target: Column) -> Column:
    """Exactly a decoy file, or a decoy autostart directory or anything inside it."""
    inside = P.starts_with_any(target, [d.rstrip("/") + "/" for d in V.DECOY_AUTOSTART_DIRS])
    return target.isin(V.DECOY_PATHS + V.DECOY_AUTOSTART_DIRS) | inside


def canary_hits(events: DataFrame) -> DataFrame:
    return events.filter(touches_decoy(F.col("target"))).select("run_id", "seq", "kind", "target")


def orphan_clones(events: DataFrame) -> DataFrame:
    """Cloned processes of a run that never executed anything."""
    child = F.regexp_extract("target", r"child_pid=(\d+)", 1).try_cast("bigint")
    clones = events.filter("kind = 'clone'").select("run_id", "seq", child.alias("pid")).filter("pid IS NOT NULL")
    ran = events.filter(F.col("kind").isin("exec", "execve")).select("run_id", "pid").distinct()
    return clones.join(ran, ["run_id", "pid"], "left_anti").select(
        "run_id",
        "seq",
        "pid",
        F.lit("floor_violation").alias("kind"),
        F.lit("MEDIUM").alias("severity"),
        F.concat(F.lit("orphan_clone child_pid="), F.col("pid").cast("string")).alias("target"),
    )


# -- runs -------------------------------------------------------------------------------
def kind_aggregates(detectors: list[DT.Detector]) -> list[Column]:
    """What the events of a kind add to a run: runs are first reduced to one row per kind, then to one."""
    rank = P.severity_rank(F.col("severity"))
    return [
        F.count_if(is_real(F.col("source"))).alias("n_real"),
        F.max(F.struct(rank.alias("rank"), (-F.col("seq")).alias("earlier"), "kind")).alias("worst"),
        *DT.mark_tests(detectors),
    ]


def run_aggregates(detectors: list[DT.Detector]) -> list[Column]:
    """The run-level facts from the rows per kind; however many kinds a trace makes up, none is collected."""
    kind, real = F.col("kind"), F.col("n_real") > 0
    some = lambda test: F.coalesce(F.bool_or(test), F.lit(False))
    return [
        F.sum("n_real").alias("n_real"),
        F.count_if(real & kind.isNotNull()).alias("n_kinds"),
        some(real & kind.isin(*V.NETWORK_KINDS)).alias("has_net"),
        some(real & kind.isin(*V.WRITE_KINDS)).alias("has_write"),
        F.coalesce(F.sum(F.when(kind == "exec", F.col("n_real"))), F.lit(0)).alias("n_exec"),
        F.max("worst").alias("worst"),
        *DT.mark_sums(detectors),
    ]


def run_facts(events: DataFrame, runs: DataFrame, detectors: list[DT.Detector] = DT.PAIRS) -> DataFrame:
    """Runs with their aggregates and observed categories; runs without any event stay."""
    per_kind = events.groupBy("run_id", "kind").agg(*kind_aggregates(detectors))
    facts = runs.join(many(per_kind.groupBy("run_id").agg(*run_aggregates(detectors))), "run_id", "left")
    facts = facts.fillna(0, ["n_real", "n_kinds", "n_exec"]).fillna(False, ["has_net", "has_write", *DT.mark_names(detectors)])
    drift = F.contains("skipped_unexpected", F.lit("parser_partial_drift"))
    return facts.withColumn("drift", drift).withColumn("categories", DT.observed(detectors)).drop("drift")


def trace_correlation(events: DataFrame, runs: DataFrame, detectors: list[DT.Detector] = DT.PAIRS) -> DataFrame:
    """Evasion categories confirmed at run time."""
    return run_facts(events, runs, detectors).select("run_id", F.explode("categories").alias("category"))


def observation_failed() -> Column:
    below = (F.col("n_kinds") < V.FLOOR_MIN_KINDS) & (F.col("n_real") < V.FLOOR_MIN_EVENTS)
    return (
        F.col("timeout")
        | (F.length("skipped_unexpected") > 0)
        | F.col("error").isNotNull()
        | (F.col("ran") & (F.col("duration_ms") >= V.FLOOR_MIN_DURATION_MS) & below)
    )


def trace_floor(events: DataFrame, runs: DataFrame) -> DataFrame:
    """Runs whose observation failed or stayed below the floor of events."""
    return run_facts(events, runs).select("run_id", "n_real", F.col("n_kinds").cast("bigint").alias("n_kinds"), observation_failed().alias("failed"))


def is_quiet() -> Column:
    return F.col("ran") & ~(F.col("has_net") | F.col("has_write") | (F.col("n_exec") > 1))


def quiet_runs(events: DataFrame, runs: DataFrame) -> DataFrame:
    """Runs without network, writes or more than one program start."""
    return run_facts(events, runs).filter(is_quiet()).select("run_id", "n_exec")


def parse_quality(lines: DataFrame) -> DataFrame:
    """Share of the non-blank lines of a JSON trace that parsed, and whether the format drifted."""
    counts = lines.groupBy("run_id").agg(
        F.count_if(F.length(P.strip(F.col("line"))) > 0).alias("n_lines"),
        F.count_if(json_event(F.col("line")).isNotNull()).alias("n_events"),
    )
    message = drift_message(F.col("n_lines"), F.col("n_events"))
    return counts.select("run_id", "n_lines", "n_events", message.alias("error"), message.isNotNull().alias("drift"))


def drift_message(n: Column, ok: Column) -> Column:
    """What is wrong if few of a run's non-blank lines parsed, else null."""
    shown = F.concat(ok.cast("string"), F.lit("/"), n.cast("string"))
    return F.when((n > 0) & (ok == 0), F.concat(F.lit("parser matched "), shown, F.lit(" lines — full schema drift or wrong channel"))).when(
        (n >= 4) & (ok / n < V.PARSE_RATIO_FLOOR),
        F.concat(
            F.lit("parser matched "), shown, F.lit(" lines ("), F.rint(ok / n * 100).cast("bigint").cast("string"),
            F.lit("%) — likely partial schema drift"),
        ),
    )


def with_health(facts: DataFrame) -> DataFrame:
    """Runs' counts and settings with the three verdicts on the observation: failed, quiet, drift."""
    drift = drift_message(F.col("n_lines"), F.col("n_events")).isNotNull()
    return facts.withColumns({"failed": observation_failed(), "quiet": is_quiet(), "drift": drift})


def run_health(events: DataFrame, lines: DataFrame, runs: DataFrame) -> DataFrame:
    """The same per run in batch, from its events and raw lines."""
    counts = parse_quality(lines).select("run_id", "n_lines", "n_events")
    facts = run_facts(events, runs).join(counts, "run_id", "left").fillna(0, ["n_lines", "n_events"])
    kinds = F.least("n_kinds", F.lit(V.FLOOR_MIN_KINDS)).alias("n_kinds")
    return with_health(facts).select("run_id", "n_real", kinds, "n_exec", "n_lines", "n_events", "failed", "quiet", "drift")


def coverage(runs: DataFrame) -> DataFrame:
    """Observed and missing surfaces of a run, failing closed on every doubt about the observer.

    ``runs``: ``run_id, platform, observer, timeout, rc, stuck, n_real, drift``.
    """
    crashed = F.col("observer").isNotNull() & (F.col("rc") != 0) & (F.col("n_real") == 0)
    problem = (
        F.when(F.col("observer").isNull(), "No Linux connect-observer available (install strace)")
        .when(F.col("timeout"), "wall-clock timeout")
        .when(crashed, F.concat(F.lit("observer_crash: "), F.col("observer"), F.lit(" rc="), F.col("rc").cast("string")))
        .when(F.col("stuck"), "stuck_observer: drift-aware watchdog tripped")
        .when(F.col("n_real") == 0, "observer_silent: no real events observed (canary missing)")
    )
    linux = F.col("platform") == "Linux"
    seen = F.concat(
        F.array(F.lit("fs_writes")),
        F.when(linux & problem.isNull(), P.strings(["network_capture", "dns", "process_tree"])).otherwise(P.strings([])),
    )
    missed = F.array_compact(
        F.array(F.when(F.col("drift"), "parser_partial_drift"), F.when(linux & problem.isNotNull(), "network_capture"))
    )
    return runs.select("run_id", seen.alias("observed"), missed.alias("skipped_unexpected"), F.when(linux, problem).alias("error"))


def coverage_split(runs: DataFrame) -> DataFrame:
    """Attempted but unobserved surfaces, split by whether the tier is known to lack them."""
    missing = F.array_except("attempted", "observed")
    floor = F.when(F.col("mode") == "light", P.strings(V.LIGHT_TIER_FLOOR)).otherwise(P.strings([]))
    return runs.select(
        "run_id", F.array_intersect(missing, floor).alias("expected"), F.array_except(missing, floor).alias("unexpected")
    )


# -- stuck observers --------------------------------------------------------------------
def stuck_runs(ticks: DataFrame, runs: DataFrame, timeout_s: int = V.STUCK_SECONDS) -> DataFrame:
    """Runs whose observer fell silent, or kept printing lines that never parsed.

    ``ticks``: one row per raw line (``run_id, ts_ms, is_event``); ``runs``: ``run_id, start_ms,
    end_ms``.  A watcher looks once a second: ``timeout_s`` seconds after the first silent look
    it gives up, likewise five seconds after the first look with lines but no events.  Over
    one-second buckets that is a gap of ``timeout_s + 2`` between active seconds, or six
    drifting seconds in a row.
    """
    low, high = V.STUCK_SECONDS_RANGE
    limit = max(low, min(timeout_s, high))
    second = F.floor(F.col("ts_ms") / 1000)
    active = ticks.groupBy("run_id", second.alias("sec")).agg(F.count_if("is_event").alias("n_events"))
    bounds = runs.select("run_id", F.explode(F.array(F.floor(F.col("start_ms") / 1000) - 1, F.floor(F.col("end_ms") / 1000) + 1)).alias("sec"))
    seconds = active.select("run_id", "sec").union(bounds).distinct()
    gaps = previous(seconds, ["run_id"], "sec", F.col("sec"), "_last").groupBy("run_id").agg(
        F.coalesce(F.max(F.col("sec") - F.col("_last")), F.lit(0)).alias("longest_gap")
    )
    # A drifting second counts towards the six windows it lies in; a full window holds six.
    span = V.DRIFT_SECONDS + 1
    windows = active.filter("n_events = 0").select("run_id", F.explode(F.sequence("sec", F.col("sec") + span - 1)).alias("w"))
    drifting = windows.groupBy("run_id", "w").agg(F.count("*").alias("n")).filter(F.col("n") == span).select("run_id").distinct()
    joined = gaps.join(drifting.withColumn("_drift", F.lit(True)), "run_id", "left")
    silent, drift = F.col("longest_gap") >= limit + 2, F.coalesce("_drift", F.lit(False))
    return joined.select("run_id", "longest_gap", silent.alias("silent"), drift.alias("drifting"), (silent | drift).alias("stuck"))


# -- decision ---------------------------------------------------------------------------
def first_touches(events: DataFrame, keep: int = 3) -> DataFrame:
    """The first decoy touches of a run, comma-separated."""
    order = Window.partitionBy("run_id").orderBy("seq")
    touches = events.filter(touches_decoy(F.col("target"))).select("run_id", "seq", "target")
    first = touches.withColumn("_n", F.row_number().over(order)).filter(F.col("_n") <= keep)
    # At most `keep` rows per run remain here.
    names = F.transform(F.array_sort(F.collect_list(F.struct("seq", "target"))), lambda t: t["target"])
    return first.groupBy("run_id").agg(F.array_join(names, ", ").alias("touches"))


def decide_trace(
    events: DataFrame, runs: DataFrame, static: DataFrame | None = None, detectors: list[DT.Detector] = DT.PAIRS
) -> DataFrame:
    """Outcome per run, in order of precedence; runs without opinion are left out.

    ``static`` may add ``run_id, category, severity`` from the sources of the traced package.
    """
    facts = run_facts(events, runs, detectors)
    if static is None:
        counted = facts.withColumn("n_high", F.lit(0)).withColumn("n_confirmed_high", F.lit(0)).withColumn(
            "n_medium", F.size("categories")
        ).withColumn("only_xpc", (F.size("categories") == 1) & F.array_contains("categories", "direct_xpc"))
    else:
        seen = facts.select("run_id", F.explode("categories").alias("category"))
        counts = EV.gate_counts(EV.category_severity(static, seen, "run_id"), "run_id")
        counted = facts.join(counts, "run_id", "left").fillna(0, ["n_high", "n_confirmed_high", "n_medium"]).fillna(False, ["only_xpc"])
    gate = EV.gate(
        F.lit(0), F.col("n_high"), F.col("n_confirmed_high"), F.col("n_medium"), F.col("only_xpc"),
        F.coalesce(F.col("platform") == "Darwin", F.lit(False)),
    )
    worst = F.coalesce(F.col("worst.rank"), F.lit(0))
    signatures = F.col("signatures") if "signatures" in runs.columns else P.strings([])
    seen_text = F.when(
        worst > 0,
        F.concat(F.lit("Sandbox observed "), F.col("worst.kind"), F.lit(" event with severity "), F.lower(P.severity_name(worst))),
    )
    touched = F.col("touches").isNotNull()
    rules = [
        (observation_failed(), "needs_review", F.coalesce("error", F.lit("Sandbox observation incomplete; manual review required"))),
        (gate == 2, "malicious", F.lit("Multi-evasion gate: ≥2 HIGH evasion tactics with dynamic confirmation")),
        (touched, "malicious", F.concat(F.lit("Sandbox canary file(s) read during install: "), F.col("touches"))),
        (worst >= 3, "malicious", seen_text),
        (
            (worst == 2) | (F.size(signatures) > 0),
            "needs_review",
            F.coalesce(seen_text, F.concat(F.lit("Sandbox surfaced signatures: "), F.array_join(F.slice(signatures, 1, 3), ", "))),
        ),
        (is_quiet(), "needs_review", F.lit("Sandbox run was suspiciously quiet (no network, no external writes, no exec)")),
        (gate == 1, "needs_review", F.lit("Multi-evasion gate: ≥2 evasion tactics detected")),
    ]
    decision = F.lit(None).cast("struct<outcome:string,reason:string>")
    for test, outcome, reason in reversed(rules):
        decision = F.when(test, F.struct(F.lit(outcome).alias("outcome"), reason.alias("reason"))).otherwise(decision)
    judged = counted.join(many(first_touches(events)), "run_id", "left").select("run_id", decision.alias("_d")).filter("_d IS NOT NULL")
    rank = P.outcome_rank(F.col("_d.outcome"))
    return judged.select(
        "run_id", "_d.outcome", "_d.reason", rank.alias("exit_code"), (F.col("_d.outcome") == "malicious").alias("should_block_install")
    )
