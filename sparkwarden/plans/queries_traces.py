"""Queries over sandbox traces and install commands, in batch and as streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparkwarden.functions import patterns as P
from sparkwarden.functions.joins import many
from sparkwarden.operators import commands as C
from sparkwarden.operators import traces as T
from sparkwarden.plans.queries import query
from sparkwarden.plans.views import spark_view
from sparkwarden.streaming import commands as SC
from sparkwarden.streaming import traces as ST
from sparkwarden.streaming.runs import run_available, run_updates, written


def _events(spark, sf):
    return spark_view(spark, sf, "v_trace_events")


def _runs(spark, sf):
    return spark_view(spark, sf, "v_runs")


@query
def trace_json_events(spark, sf):
    return T.trace_json_events(spark_view(spark, sf, "v_trace_json"))


def _rendered(df):
    return df.withColumn("argv", F.array_join("argv", " "))


@query
def trace_syscall_events(spark, sf):
    return _rendered(T.trace_syscall_events(spark_view(spark, sf, "v_syscalls")))


@query
def stitch_syscalls(spark, sf):
    return T.stitch_syscalls(T.syscall_lines(spark_view(spark, sf, "v_syscalls")))


@query
def scrub_tokens(spark, sf):
    events = T.trace_json_events(spark_view(spark, sf, "v_trace_json"))
    tokens = _runs(spark, sf).select("run_id", F.when(F.col("platform") == "Linux", "/app/").otherwise("").alias("token"))
    return T.scrub_tokens(events, tokens).select("run_id", "line_no", "target", "raw")


@query
def real_events(spark, sf):
    return T.real_events(_events(spark, sf)).select("run_id", "seq", "kind", "source")


@query
def canary_hits(spark, sf):
    return T.canary_hits(_events(spark, sf))


@query
def orphan_clones(spark, sf):
    return T.orphan_clones(_events(spark, sf))


@query
def trace_correlation(spark, sf):
    return T.trace_correlation(_events(spark, sf), _runs(spark, sf))


@query
def trace_floor(spark, sf):
    return T.trace_floor(_events(spark, sf), _runs(spark, sf))


@query
def quiet_runs(spark, sf):
    return T.quiet_runs(_events(spark, sf), _runs(spark, sf))


@query
def parse_quality(spark, sf):
    return T.parse_quality(spark_view(spark, sf, "v_trace_json"))


def _coverage_runs(spark, sf):
    n_real = _events(spark, sf).groupBy("run_id").agg(F.count_if(T.is_real(F.col("source"))).alias("n_real"))
    runs = _runs(spark, sf).join(n_real, "run_id", "left")
    return runs.select(
        "run_id", "platform",
        F.when(F.length("run_id") % 2 == 0, "strace").alias("observer"),
        "timeout",
        F.when(F.col("error").isNotNull(), 1).otherwise(0).alias("rc"),
        (F.col("duration_ms") % 7 == 0).alias("stuck"),
        F.when(F.col("duration_ms") % 5 == 0, 0).otherwise(F.col("n_real")).alias("n_real"),
        (F.length("skipped_unexpected") > 0).alias("drift"),
    )


@query
def coverage(spark, sf):
    rows = T.coverage(_coverage_runs(spark, sf))
    return rows.withColumn("observed", F.array_join("observed", ",")).withColumn("skipped_unexpected", F.array_join("skipped_unexpected", ","))


@query
def coverage_split(spark, sf):
    seen = T.coverage(_coverage_runs(spark, sf)).select("run_id", "observed")
    runs = seen.select(
        "run_id", "observed",
        P.strings(["syscall_trace", "network_capture", "fs_writes", "process_tree", "dns", "env_reads"]).alias("attempted"),
        F.when(F.length("run_id") % 3 == 0, "strict").otherwise("light").alias("mode"),
    )
    rows = T.coverage_split(runs)
    return rows.withColumn("expected", F.array_join("expected", ",")).withColumn("unexpected", F.array_join("unexpected", ","))


def _ticks(spark, sf):
    """Raw lines of every run; two thirds of the runs of some users print lines that do not parse."""
    return _events(spark, sf).select("run_id", "ts_ms", (~((F.col("user_id") % 3 == 0) & (F.col("seq") % 4 < 3))).alias("is_event"))


def _dense_ticks(spark, sf):
    """The same lines on a clock eight times faster, so that seconds follow each other."""
    return _ticks(spark, sf).withColumn("ts_ms", F.floor(F.col("ts_ms") / 8).cast("bigint"))


def _bounds(ticks):
    return ticks.groupBy("run_id").agg(F.min("ts_ms").alias("start_ms"), F.max("ts_ms").alias("end_ms"))


@query
def stuck_runs(spark, sf):
    ticks = _dense_ticks(spark, sf)
    return T.stuck_runs(ticks, _bounds(ticks), timeout_s=2)


@query
def decide_trace(spark, sf):
    return T.decide_trace(_events(spark, sf), _runs(spark, sf))


@query
def decide_trace_static(spark, sf):
    static = _runs(spark, sf).select(
        "run_id", F.explode(F.array(F.lit("anti_debug"), F.lit("build_hooks"))).alias("category"), F.lit("HIGH").alias("severity")
    ).filter(F.length("run_id") % 2 == 0)
    return T.decide_trace(_events(spark, sf), _runs(spark, sf), static)


# -- commands ---------------------------------------------------------------------------
def _commands(spark, sf):
    return spark_view(spark, sf, "v_commands")


def _verdicts(spark, sf):
    packages = spark_view(spark, sf, "v_packages")
    return packages.groupBy("ecosystem", "name").agg((F.min("k") % 3 == 0).alias("should_block_install"))


@query
def install_commands(spark, sf):
    return C.install_commands(_commands(spark, sf))


@query
def risky_commands(spark, sf):
    return C.risky_commands(_commands(spark, sf))


@query
def judged_commands(spark, sf):
    return C.judged_commands(_commands(spark, sf), _verdicts(spark, sf))


# -- streams ----------------------------------------------------------------------------
@query
def stream_trace_parse(spark, sf):
    return run_available(spark, spark_view(spark, sf, "v_trace_json"), ST.stream_trace_json, "line_no")


@query
def stream_stitch(spark, sf):
    return run_available(spark, spark_view(spark, sf, "v_syscalls"), ST.stream_stitch, "line_no")


@query
def stream_stuck(spark, sf):
    return run_available(spark, _dense_ticks(spark, sf), lambda t: ST.stream_stuck(t, timeout_s=2), "ts_ms").select("run_id").distinct()


@query
def stream_commands(spark, sf):
    verdicts = _verdicts(spark, sf)
    return run_available(spark, _commands(spark, sf), lambda c: SC.stream_commands(c, verdicts), "ts_ms")


@query
def stream_warnings(spark, sf):
    return run_available(spark, _commands(spark, sf), SC.stream_warnings, "ts_ms")


@query
def stream_complete_calls(spark, sf):
    return run_available(spark, spark_view(spark, sf, "v_syscalls"), ST.stream_complete_calls, "line_no").withColumn("argv", F.array_join("argv", " "))


def _arrivals(spark, sf):
    """Events and raw lines of all runs in one table, each at its time."""
    events = _events(spark, sf).select("run_id", "ts_ms", "seq", "kind", "source")
    none = F.lit(None).cast("string")
    lines = spark_view(spark, sf, "v_trace_json").withColumnRenamed("line_no", "seq").join(many(events.select("run_id", "seq", "ts_ms")), ["run_id", "seq"])
    both = events.withColumn("line", none).unionByName(lines.withColumn("kind", none).withColumn("source", none))
    return both.select("run_id", "ts_ms", F.timestamp_millis("ts_ms").alias("event_time"), "kind", "source", "line")


@query
def run_health(spark, sf):
    return T.run_health(_events(spark, sf), spark_view(spark, sf, "v_trace_json"), _runs(spark, sf))


@query
def stream_run_health(spark, sf):
    runs = written(_runs(spark, sf))  # every micro-batch reads them
    return run_updates(spark, _arrivals(spark, sf), lambda rows: ST.stream_run_health(rows, runs), ["run_id"], "ts_ms").drop("closed")
