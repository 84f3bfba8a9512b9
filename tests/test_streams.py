"""State with times to live and timers, across restarts of a query, and run health as a stream against batch."""

import random
import time
from collections import Counter
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from sparkwarden import values as V
from sparkwarden.operators import traces as T
from sparkwarden.streaming import runs as R
from sparkwarden.streaming import traces as ST

LINES = "run_id string, line_no bigint, line string"


class Restarted:
    """A stream that is fed, run until it has read all and stopped, then fed and started again from its state.

    Timers of wall-clock time call for ever more batches, so ``live`` queries are stopped once their input is read.
    """

    def __init__(self, spark, schema, transform, live=False):
        self.spark, self.schema, self.transform, self.live, self.folder = spark, schema, transform, live, R.shared_folder(spark)

    def feed(self, rows):
        self.spark.createDataFrame(rows, self.schema).coalesce(1).write.mode("append").parquet(f"{self.folder}/in")
        path = f"{self.folder}/out"

        def keep(df, batch):
            df.withColumn("_batch", F.lit(batch)).write.mode("overwrite").parquet(f"{path}/n={batch}")

        out = self.transform(self.spark.readStream.schema(self.schema).parquet(f"{self.folder}/in"))
        start = out.writeStream.outputMode("update").option("checkpointLocation", f"{self.folder}/state").foreachBatch(keep)
        if self.live:
            job = start.trigger(processingTime="200 milliseconds").start()
            end = time.time() + 60
            while sum(p["numInputRows"] for p in job.recentProgress) < len(rows) and time.time() < end:
                assert job.exception() is None
                time.sleep(0.2)
            job.stop()
            assert time.time() < end
        else:
            job = start.trigger(availableNow=True).start()
            assert job.awaitTermination(120)
        return self.spark.read.parquet(path).collect()


def unfinished(run, n, arg):
    return (run, n, f'7 openat(AT_FDCWD, "{arg}", O_RDONLY <unfinished ...>')


def resumed(run, n):
    return (run, n, "7 <... openat resumed> ) = 3")


@pytest.mark.parametrize("ttl_ms, wait, stitched", [(None, 0, 1), (60_000, 0, 1), (1_000, 3, 0)])
def test_orphans_expire_across_a_restart(spark, ttl_ms, wait, stitched):
    stream = Restarted(spark, LINES, lambda lines: ST.stream_stitch(lines, ttl_ms), live=ttl_ms is not None)
    assert stream.feed([unfinished("r", 1, "/a"), unfinished("r", 2, "/b")]) == []
    time.sleep(wait)
    rows = stream.feed([resumed("r", 4), unfinished("other", 3, "/c")])
    assert [(r["run_id"], r["line_no"], r["pid"]) for r in rows] == [("r", 4, 7)] * stitched
    if stitched:
        assert "/b" in rows[0]["tail"] and "/a" not in rows[0]["tail"]
        assert len(stream.feed([resumed("r", 5)])) == 1  # what was used up is gone


def test_silent_run_is_reported_by_its_timer(spark):
    """A run that says nothing more is reported when its timer ends, in a later start of the query, once."""
    stream = Restarted(spark, "run_id string, ts_ms bigint, is_event boolean", lambda t: ST.stream_stuck(t, timeout_s=2, live=True), live=True)
    assert stream.feed([("quiet", 1000, True), ("busy", 1000, True)]) == []
    time.sleep(4.5)
    rows = stream.feed([("late", 5000, True)])
    assert {(r["run_id"], r["reason"]) for r in rows} == {("quiet", "silent"), ("busy", "silent")}
    again = stream.feed([("busy", 2000, True)])  # a new life after the end
    assert len([r for r in again if r["run_id"] == "busy"]) == 1


def test_timer_is_put_off_by_new_lines(spark):
    stream = Restarted(spark, "run_id string, ts_ms bigint, is_event boolean", lambda t: ST.stream_stuck(t, timeout_s=20, live=True), live=True)
    for second in range(3):
        assert stream.feed([("r", 1000 + 1000 * second, True)]) == []


ARRIVALS = "run_id string, ts_ms bigint, event_time timestamp, kind string, source string, line string"


def arrivals(spark, rows):
    return spark.createDataFrame([(r, ms, k, s, x) for r, ms, k, s, x in rows], "run_id string, ts_ms bigint, kind string, source string, line string").select(
        "run_id", "ts_ms", F.timestamp_millis("ts_ms").alias("event_time"), "kind", "source", "line"
    )


def test_run_health_equals_batch(spark):
    """All three verdicts, over four batches, with more kinds than the state keeps."""
    ok = '{"kind": "open", "ts_ms": 1, "pid": 1, "process": "p", "target": "t"}'
    rows = []
    for i in range(40):
        t = 1000 + i * 250
        rows += [("kinds", t, f"made-up-{i}", None, None), ("few", t, ["open", "exec", None][i % 3], "resource_probe" if i % 2 else None, None)]
        rows += [("net", t, ["connect", "write", "exec"][i % 3], None, None)]
        rows += [("drift", t, None, None, ok if i % 4 == 0 else "broken"), ("fine", t, None, None, ok), ("blank", t, None, None, "  ")]
        if i < 2:
            rows += [("quiet", t, "exec" if i == 0 else "open", None, None)]
    names = sorted({r[0] for r in rows})
    runs = spark.createDataFrame([(n, True, 5000, n == "kinds", None, "") for n in names], "run_id string, ran boolean, duration_ms bigint, timeout boolean, error string, skipped_unexpected string")
    table = arrivals(spark, rows)
    stream = R.run_updates(spark, table, lambda a: ST.stream_run_health(a, runs), ["run_id"], "ts_ms").drop("closed")
    lines = table.where("line IS NOT NULL").selectExpr("run_id", "ts_ms AS line_no", "line")
    events = table.where("line IS NULL").selectExpr("run_id", "ts_ms AS seq", "kind", "source", "'NONE' AS severity", "'x' AS target")
    batch = T.run_health(events, lines, runs).select(stream.columns)
    got = {r["run_id"]: r for r in stream.collect()}
    assert Counter(map(tuple, got.values())) == Counter(map(tuple, batch.collect()))
    assert got["kinds"]["n_kinds"] == 3 and got["kinds"]["failed"] and got["drift"]["drift"] and not got["fine"]["drift"] and got["quiet"]["quiet"] and not got["net"]["quiet"]
    assert got["few"]["failed"] is False or got["few"]["n_real"] < 10


def test_run_health_closes_idle_runs(spark):
    runs = spark.createDataFrame([(n, True, 0, False, None, "") for n in "ab"], "run_id string, ran boolean, duration_ms bigint, timeout boolean, error string, skipped_unexpected string")
    stream = Restarted(spark, ARRIVALS, lambda a: ST.stream_run_health(a, runs, idle_ms=10_000, delay="1 second"))
    row = lambda run, ms, kind: tuple(arrivals(spark, [(run, ms, kind, None, None)]).first())
    first = stream.feed([row("a", 1000, "exec"), row("a", 2000, "open")])
    assert [(r["run_id"], r["n_real"], r["closed"]) for r in first] == [("a", 2, False)]
    second = stream.feed([row("b", 50_000, "connect")])  # the watermark passes a's last event by more than the idle time
    assert sorted((r["run_id"], r["n_real"], r["closed"]) for r in second) == [("a", 2, False), ("a", 2, True), ("b", 1, False)]
    third = stream.feed([row("a", 3000, "open"), row("a", 51_000, "dns")])  # the first is too late, the second starts anew
    last = max((r for r in third if r["run_id"] == "a"), key=lambda r: r["_batch"])
    assert (last["n_real"], last["quiet"], last["closed"]) == (1, False, False)


def test_slices_bound_a_micro_batch(spark, monkeypatch):
    monkeypatch.setattr(R, "BATCH_ROWS", 50)
    parts = [p.count() for p in R.slices(spark.range(1000).withColumnRenamed("id", "k"), "k", 4)]
    assert len(parts) >= 20 and sum(parts) == 1000 and max(parts) <= 60


def test_slices_run_the_plan_once(spark):
    """What a table is made from is worked out once, however many ranges it arrives in; nulls come first and no row is lost."""
    made = spark.sparkContext.accumulator(0)

    def seen(x):
        made.add(1)
        return None if x == 7 else x

    source = spark.range(200).select(F.udf(seen, "bigint")("id").alias("k"))
    parts = [sorted(r["k"] if r["k"] is not None else -1 for r in p.collect()) for p in R.slices(source, "k", 4)]
    assert made.value == 200
    assert sum(parts, []) == sorted([-1, *(k for k in range(200) if k != 7)]) and len(parts) >= 4


def test_run_health_takes_rows_without_a_time(spark):
    """A row without a time counts for its run and leaves the run's last time as it is."""
    runs = spark.createDataFrame([("r", True, 5000, False, None, "")], "run_id string, ran boolean, duration_ms bigint, timeout boolean, error string, skipped_unexpected string")
    rows = [("r", 1000, "exec", None, None), ("r", None, "open", None, None), ("r", 2000, "connect", None, None)]
    stream = R.run_updates(spark, arrivals(spark, rows), lambda a: ST.stream_run_health(a, runs), ["run_id"], "ts_ms")
    assert [(r["n_real"], r["n_exec"]) for r in stream.collect()] == [(3, 1)]


def test_stitching_keeps_state_by_group(spark):
    """Far more processes than groups are a state row per group, and each process still finds its own line, in the next start too; nulls fail nothing."""
    n = 3 * ST.GROUPS
    folder = R.shared_folder(spark)
    begun = spark.range(n).selectExpr("concat('r', id) AS run_id", "id AS line_no", """concat('7 openat(AT_FDCWD, "/f', id, '", O_RDONLY <unfinished ...>') AS line""")
    ended = spark.range(n).selectExpr("concat('r', id) AS run_id", f"id + {n} AS line_no", "'7 <... openat resumed> ) = 3' AS line")
    odd = spark.createDataFrame([(None, None, "7 <... openat resumed> ) = 3"), (None, None, "7 openat(AT_FDCWD <unfinished ...>"), (None, 5, "7 <... openat resumed> ) = 3")], LINES)
    kept = []
    for part in (begun, ended.unionByName(odd.filter("line_no IS NOT NULL")).unionByName(odd.filter("line_no IS NULL"))):
        part.coalesce(1).write.mode("append").parquet(f"{folder}/in")
        out = ST.stream_stitch(spark.readStream.schema(LINES).parquet(f"{folder}/in"))
        job = out.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
        assert job.awaitTermination(120)
        kept.append(job.recentProgress[-1]["stateOperators"][0]["numRowsTotal"])
    assert 0 < kept[0] <= ST.GROUPS and kept[1] == 0
    rows = spark.read.schema(ST.STITCHED).parquet(f"{folder}/out").collect()
    assert {(r["run_id"], r["line_no"]) for r in rows if r["run_id"]} == {(f"r{i}", n + i) for i in range(n)} and len(rows) == n + 1
    assert all(f'"/f{r["run_id"][1:]}"' in r["tail"] for r in rows if r["run_id"])


class Grouped:
    """A stream without timers of wall-clock time, restarted from its state for each part; what it returns and the rows of its state."""

    def __init__(self, spark, schema, transform):
        self.spark, self.schema, self.transform, self.folder, self.n = spark, schema, transform, R.shared_folder(spark), 0

    def feed(self, rows):
        self.spark.createDataFrame(rows, self.schema).coalesce(1).write.mode("append").parquet(f"{self.folder}/in")
        self.n, got = self.n + 1, []
        out = self.transform(self.spark.readStream.schema(self.schema).parquet(f"{self.folder}/in"))
        start = out.writeStream.outputMode("update").option("checkpointLocation", f"{self.folder}/state")
        job = start.foreachBatch(lambda df, batch: got.extend(df.withColumn("_batch", F.lit(batch)).collect())).trigger(availableNow=True).start()
        assert job.awaitTermination(120)
        return got, job.recentProgress[-1]["stateOperators"][0]["numRowsTotal"]


def stuck_truth(parts, limit):
    """Run by run and second by second: what each part newly reports."""
    kept, found = {}, []
    for part in parts:
        new = set()
        for run in {r for r, _, _ in part}:
            last, streak, sec, events, stuck = kept.get(run, (None, 0, None, 0, False))
            counts, reason = Counter(), None
            for r, ms, is_event in part:
                if r == run and ms is not None:
                    counts[ms // 1000] += bool(is_event)
            for s, n in sorted(counts.items()):
                if sec is not None and s <= sec:
                    events += n if s == sec else 0
                    continue
                if sec is not None:
                    streak = (streak + 1 if last == sec - 1 and streak else 1) if events == 0 else 0
                    reason = reason or ("drifting" if streak > 5 else "silent" if s - sec >= limit + 2 else None)
                    last = sec
                sec, events = s, n
            if reason and not stuck:
                new.add((run, reason))
            kept[run] = last, streak, sec, events, stuck or bool(reason)
        found.append(new)
    return found


def test_stuck_runs_keep_state_by_group(spark):
    """Far more runs than groups are a state row per group, and each run is judged by its own seconds, in the next starts too; late rows and nulls as well."""
    rng = random.Random(4)
    names = [None, *(f"r{i}" for i in range(3 * ST.GROUPS))]
    parts, second = [], dict.fromkeys(names, 0)
    for _ in range(3):
        part = []
        for run in names:
            for _ in range(rng.randrange(9)):
                second[run] += rng.choice([0, 1, 1, 1, 1, 1, rng.randrange(6)])
                part.append((run, rng.choice([second[run], second[run], second[run] - 1]) * 1000 + rng.randrange(1000) if rng.random() > 0.02 else None, rng.choice([True, False, False, False, False, None])))
        rng.shuffle(part)
        parts.append(part)
    stream = Grouped(spark, "run_id string, ts_ms bigint, is_event boolean", lambda t: ST.stream_stuck(t, timeout_s=3))
    want = stuck_truth(parts, max(V.STUCK_SECONDS_RANGE[0], 3))
    assert sum(reason == "drifting" for part in want for _, reason in part) > 20 < sum(reason == "silent" for part in want for _, reason in part)
    for part, new in zip(parts, want, strict=True):
        rows, kept = stream.feed(part)
        assert Counter((r["run_id"], r["reason"]) for r in rows) == Counter(new)
        assert kept <= ST.GROUPS


def test_run_health_keeps_state_by_group(spark):
    """Far more runs than groups are a few state rows per group, and each run is counted and closed by itself; runs without times stay."""
    n = 3 * ST.GROUPS
    runs = spark.range(n).selectExpr("concat('r', id) AS run_id", "true AS ran", "5000L AS duration_ms", "false AS timeout", "cast(null AS string) AS error", "'' AS skipped_unexpected")
    stream = Grouped(spark, ARRIVALS, lambda a: ST.stream_run_health(a, runs, idle_ms=10_000, delay="1 second"))
    at = lambda run, ms, kind, source=None, line=None: (f"r{run}", ms, None if ms is None else datetime.fromtimestamp(ms / 1000), kind, source, line)
    first = [at(i, None if i % 5 == 0 else 1000, k, s) for i in range(n) for k, s in (("exec", None), (f"k{i % 4}", None), (f"k{i % 3}", None), ("x", "resource_probe"))]
    first += [at(i, 1000 + i % 2, None, None, "broken") for i in range(0, n, 5) if i % 2]
    rows, kept = stream.feed([*first, (None, 1000, datetime.fromtimestamp(1), "exec", None, None)])
    assert {(r["run_id"], r["n_real"], r["n_kinds"], r["n_exec"], r["n_lines"], r["closed"]) for r in rows} == {(f"r{i}", 3, 2 + (i % 4 != i % 3), 1, int(i % 10 == 5), False) for i in range(n)}
    assert len(rows) == n and kept <= ST.GROUPS
    second, _ = stream.feed([at(1, 50_000, "connect")])  # the watermark passes all others that have a time
    assert {(r["run_id"], r["n_real"]) for r in second if not r["closed"]} == {("r1", 4)}
    assert {(r["run_id"], r["n_kinds"]) for r in second if r["closed"]} == {(f"r{i}", 2 + (i % 4 != i % 3)) for i in range(n) if i != 1 and (i % 5 or i % 2)}
    third, _ = stream.feed([at(i, 50_500, "open") for i in (0, 1, 2, 7)])
    assert {(r["run_id"], r["n_real"], r["closed"]) for r in third} == {("r0", 4, False), ("r1", 5, False), ("r2", 1, False), ("r7", 1, False)}


def test_micro_batches_have_a_bounded_number_of_state_tasks(spark):
    """A session's many shuffle partitions are not so many tasks in every micro-batch, and are as before afterwards."""
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "300")
    try:

        def transform(ticks):
            return ST.stream_stuck(ticks.withColumn("is_event", F.lit(True)), timeout_s=3).withColumn("part", F.spark_partition_id())

        source = spark.range(4000).selectExpr("concat('r', id % 2000) AS run_id", "id DIV 2000 * 60000 AS ts_ms")
        seen = R.run_available(spark, source, transform, "ts_ms", 2).select("run_id", "part").collect()
        assert len({r["run_id"] for r in seen}) == len(seen) == 2000 and max(r["part"] for r in seen) < R.STATE_TASKS
        assert spark.conf.get("spark.sql.shuffle.partitions") == "300"
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
