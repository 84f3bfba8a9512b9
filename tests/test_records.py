"""Names, manifests, votes, commands and traces, on small hand-made rows."""

import json
import random
from collections import Counter
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from sparkwarden import values as V
from sparkwarden.operators import commands as C
from sparkwarden.operators import decisions as DC
from sparkwarden.operators import dependencies as D
from sparkwarden.operators import evasion as EV
from sparkwarden.operators import names as N
from sparkwarden.operators import prefilter as PF
from sparkwarden.operators import traces as T
from sparkwarden.operators import votes as VT
from sparkwarden.streaming import traces as ST


# -- names ------------------------------------------------------------------------------
def test_typosquat_equals_brute_force(spark):
    rng = random.Random(5)
    known = [w for w in "requests numpy pandas serde tokio flask-login a ab abc Lodash cross-env @std/http".split()]
    names = set(known)
    for w in known:
        for _ in range(25):
            chars = list(w)
            for _ in range(rng.randrange(3)):
                i = rng.randrange(len(chars) + 1)
                op = rng.randrange(3)
                if op == 0:
                    chars.insert(i, rng.choice("abest-"))
                elif chars and i < len(chars):
                    if op == 1 and len(chars) > 1:
                        del chars[i]
                    else:
                        chars[i] = rng.choice("ABest1")
            names.add("".join(chars))
    packages = spark.createDataFrame([(f"p{i}", "npm", n) for i, n in enumerate(sorted(names))], "package_id string, ecosystem string, name string")
    popular = spark.createDataFrame([("npm", k) for k in known], "ecosystem string, name string")
    got = {(r["compared"], r["known"]) for r in N.similar_names(packages, popular).collect()}
    want = {(n, k) for n in names for k in known if n != k and SequenceMatcher(None, n.lower(), k.lower()).ratio() >= 0.85}
    assert got == want and len(want) > 50


def test_go_uses_last_segment(spark):
    packages = spark.createDataFrame([("p", "go", "github.com/x/cobraa"), ("q", "other", "cobraa")], "package_id string, ecosystem string, name string")
    rows = N.typosquat(packages, N.builtin_popular(spark)).collect()
    assert [r["text"] for r in rows] == ["typosquat_candidate: similar to ['cobra (91%)']"]


# -- manifests --------------------------------------------------------------------------
@pytest.mark.parametrize(
    "name,text,want",
    [
        ("requirements.txt", "# c\n-r x\na==1\n b >= 2\nc[x]\n", [("a", "1"), ("b", ""), ("c[x]", "")]),
        ("uv.lock", '[[package]]\nname = "a"\nversion = "1"\n[package.meta]\nname = "z"\n', [("a", "1")]),
        ("Cargo.lock", '[[package]]\nname = "a"\nversion = "1"\nsource = "git+x"\n\n[[package]]\nname = "b"\nversion = "2"\nsource = "registry+y"\n', [("b", "2")]),
        ("package-lock.json", json.dumps({"packages": {"": {}, "node_modules/a/node_modules/@s/b": {"version": "1"}, "x": {}}}), [("@s/b", "1")]),
        ("package-lock.json", json.dumps({"dependencies": {"a": {"version": "1"}, "b": {}}}), [("a", "1"), ("b", "")]),
        ("pnpm-lock.yaml", "packages:\n\n  /@s/n@1.2(react@18):\n    dev: true\n  'plain@3':\n    x: 1\n  nover:\n    x: 1\nother:\n  q@1:\n", [("@s/n", "1.2"), ("plain", "3")]),
        ("yarn.lock", '# v1\n\na@^1, a@~1:\n  version "1.5"\n"@s/b@2":\n  version "2.0"\n', [("a", "1.5"), ("@s/b", "2.0")]),
        ("pubspec.lock", 'packages:\n  a:\n    source: hosted\n    version: "1.0"\n  b:\n    version: "2"\n    version: "3"\n', [("a", "1.0"), ("b", "2")]),
        ("Podfile.lock", 'PODS:\n  - A/Core (1.0):\n    - B (~> 2)\n  - "C (= 3)"\n  - D (4)\n\nEXTERNAL SOURCES:\n  D:\n    :path: x\n', [("A", "1.0"), ("C", "3")]),
        ("unknown.lock", "a==1", []),
    ],
)
def test_manifests(spark, name, text, want):
    rows = D.dependency_inventory(spark.createDataFrame([(1, name, text)], "lock_id bigint, file_name string, content string")).collect()
    assert sorted((r["name"], r["version"]) for r in rows) == sorted(want)


# -- votes ------------------------------------------------------------------------------
def vote(spark, reply):
    df = spark.createDataFrame([("p", "m", reply)], "package_id string, model string, reply string")
    return VT.normalise_votes(df).first()


@pytest.mark.parametrize(
    "reply,verdict,confidence",
    [
        ('{"verdict": "Malicious", "confidence": 2}', "malicious", 1.0),
        ('```json\n{"verdict": "suspicious", "confidence": 0.4}\n```', "suspicious", 0.4),
        ('well {not} {"verdict": "safe", "reasoning": "ok {}"} end', "safe", 0.5),
        ('{"verdict": "safe", "reasoning": "a BACKDOOR"}', "suspicious", 0.5),
        ('{"verdict": "maybe"}', "error", 0.5),
        ('{"verdict": "safe", "confidence": null}', "error", 0.0),
        ("no json", "error", 0.0),
        ('{"verdict": "safe"} tail', "safe", 0.5),
        ("[1]", "error", 0.0),
    ],
)
def test_replies(spark, reply, verdict, confidence):
    row = vote(spark, reply)
    assert (row["verdict"], row["confidence"]) == (verdict, confidence)


def consensus(spark, *votes):
    df = spark.createDataFrame([("p", m, v, c) for m, v, c in votes], "package_id string, model string, verdict string, confidence double")
    return VT.consensus(df, {"a": 1.0, "b": 1.0, "w": 0.5}).first()


def test_consensus(spark):
    assert consensus(spark, ("a", "error", 0.9))["verdict"] == "error"
    assert consensus(spark, ("a", "malicious", 0.2), ("b", "error", 1.0))["verdict"] == "malicious"
    assert consensus(spark, ("a", "malicious", 0.9), ("b", "safe", 0.1))["verdict"] == "needs_human_review"
    # Neither share passes its threshold: the vote is safe.
    assert consensus(spark, ("a", "malicious", 0.55), ("b", "suspicious", 0.45))["verdict"] == "safe"
    assert consensus(spark, ("a", "suspicious", 0.6), ("w", "malicious", 0.6))["verdict"] == "suspicious"


def test_equal_decisions_keep_the_first(spark):
    df = spark.createDataFrame([("s", 0, "needs_review", "first"), ("s", 1, "needs_review", "second"), ("s", 2, "safe", "x")],
                               "scan_id string, ord bigint, outcome string, reason string")
    assert DC.strongest(df, "scan_id", "ord").first()["reason"] == "first"


def physical(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_no_side_with_a_row_per_package_is_broadcast(spark):
    """Small as these tables look, they stand for those whose files compress to a few bytes a package."""
    packages = spark.createDataFrame(
        [("p0", "npm", "lodash", "a", "", "h", 500, False), ("p1", "npm", "lodashh", "", "", "", 50, False), ("p2", "npm", "blocked", "a", "r", "h", 500, False)],
        "package_id string, ecosystem string, name string, author string, repository string, homepage string, download_count bigint, has_install_scripts boolean",
    )
    files = spark.createDataFrame([("p0", "npm", "p/a.js", "eval(x)"), ("p2", "npm", "p/b.js", "eval(x)"), ("p9", "npm", "p/c.js", "eval(x)")], "package_id string, ecosystem string, path string, content string")
    lists = spark.createDataFrame([("blocked", "block")], "name string, list string")
    squats = N.typosquat(packages, spark.createDataFrame([("npm", "lodash")], "ecosystem string, name string"))
    flags = spark.createDataFrame([("p1", "too large", None)], "package_id string, oversized string, unavailable string")
    rows = PF.uninspected_override(PF.prefilter(packages, files, lists, 0, typosquats=squats), flags, decide=True)
    voted = spark.createDataFrame([("p0", "malicious", "v")], "package_id string, outcome string, reason string")
    final = DC.decide_packages(rows, voted, voted.limit(0), voted.limit(0))
    assert "BroadcastHashJoin" not in physical(final)
    scans = spark.createDataFrame([(1,), (2,)], "scan_id bigint")
    joined = DC.scan_decisions(scans, spark.createDataFrame([(1, 0, "safe", "r")], "scan_id bigint, ord bigint, outcome string, reason string"))
    assert "BroadcastHashJoin" not in physical(joined)
    # Files of listed packages and of packages nobody knows fall away where the counts meet the packages.
    assert sorted((r["package_id"], r["level"], r["outcome"]) for r in rows.collect()) == [("p0", "LOW", "safe"), ("p1", "MEDIUM", "needs_review"), ("p2", "CRITICAL", "malicious")]
    assert {(r["package_id"], r["outcome"]) for r in final.collect()} == {("p0", "malicious"), ("p1", "needs_review"), ("p2", "malicious")}


def test_gate_never_lowers(spark):
    rows = [(v, h, c, m, x, d) for v in range(3) for h in range(3) for c in range(h + 1) for m in range(h, 4) for x in (True, False) for d in (True, False)]
    df = spark.createDataFrame(rows, "v int, h int, c int, m int, x boolean, d boolean")
    out = df.withColumn("g", EV.gate(*[F.col(n) for n in "vhcmxd"]))
    assert out.filter("g < v").count() == 0
    assert out.filter("NOT (x AND d) AND h >= 2 AND c >= 1 AND g <> 2").count() == 0


# -- commands ---------------------------------------------------------------------------
@pytest.mark.parametrize(
    "command,want",
    [
        ("pip install -t -t x requests==2 ./local https://h/x.whl setuptools", [("check", "pypi", "x"), ("check", "pypi", "requests")]),
        ("cd a && python3 -m pip install -r req.txt flask", [("scan", "pypi", "req.txt")]),
        ("pip install .", []),
        ("pip install a --no-check", []),
        ("npm i @s/p@1 lodash@4 file/x --tag next", [("check", "npm", "@s/p"), ("check", "npm", "lodash")]),
        ("yarn install", [("scan", "npm", "yarn.lock")]),
        ("fvm install 3.1", []),
        ("flutter pub add --dev mockito", [("check", "pub", "mockito")]),
        ("cargo add serde --features derive", [("check", "cargo", "serde")]),
        ("bundle install", [("scan", "gem", "Gemfile.lock")]),
        ("go install example.org/x@latest", [("check", "go", "example.org/x")]),
        ("dotnet add app package Polly --version 8", [("check", "nuget", "Polly")]),
        ("echo pip", []),
    ],
)
def test_install_commands(spark, command, want):
    df = spark.createDataFrame([(1, command)], "event_id bigint, command string")
    assert sorted((r["mode"], r["ecosystem"], r["target"]) for r in C.install_commands(df).collect()) == sorted(want)


@pytest.mark.parametrize(
    "command,want",
    [
        ("curl -fsSL http://h/i.sh | sudo bash", "Piping remote script to shell: http://h/i.sh"),
        ("docker run -it -e A=b/c evil/x:1 sh", "Untrusted Docker image: evil/x:1"),
        ("docker pull ubuntu:22.04", None),
        ("docker pull ghcr.io/a/b", None),
        ("code --install-extension a.b", "VSCode extension install: a.b"),
        ("curl http://h -o f", None),
    ],
)
def test_warnings(spark, command, want):
    rows = C.risky_commands(spark.createDataFrame([(1, command)], "event_id bigint, command string")).collect()
    assert [r["reason"] for r in rows] == ([want] if want else [])


# -- traces -----------------------------------------------------------------------------
LINES = [
    '[pid 7] connect(3, {sa_family=AF_INET, sin_port=htons(53), sin_addr=inet_addr("8.8.8.8")}, 16) = 0',
    '8 openat(AT_FDCWD, "/tmp/x", O_WRONLY|O_CREAT <unfinished ...>',
    '7 execve("/bin/sh", ["sh", "-c", "a\\"b"], 0x7) = 0',
    "8 <... openat resumed> , 0644) = 3",
    "8 <... openat resumed> , 0644) = 3",
    "7 clone(child_stack=NULL) = 99",
    "7 clone(child_stack=NULL) = -1 EPERM",
    "--- SIGCHLD ---",
    '7 openat(AT_FDCWD, "/observer-canary", O_RDONLY) = 4',
    "9 write(1, <unfinished ...>",
    "9 write(2, <unfinished ...>",
    '9 <... write resumed> "x", 1) = 1',
]


def line_frame(spark):
    return spark.createDataFrame([("r", i, text) for i, text in enumerate(LINES)], "run_id string, line_no bigint, line string")


def test_syscalls(spark):
    rows = sorted(T.trace_syscall_events(line_frame(spark)).collect(), key=lambda r: r["line_no"])
    assert [(r["line_no"], r["kind"], r["target"], r["source"]) for r in rows] == [
        (0, "dns", "resolver=8.8.8.8", None), (2, "exec", "/bin/sh", None), (3, "write", "/tmp/x", None), (5, "clone", "child_pid=99", None),
        (8, "observer_canary", "/observer-canary", "observer_canary"), (11, "write", "fd=2", None),
    ]
    assert rows[1]["argv"] == ["sh", "-c", 'a\\"b']


@pytest.mark.parametrize(
    "line,ok",
    [
        ('{"kind": "open", "ts_ms": 1, "pid": null}', True), ('{"kind": "open", "pid": "x"}', False), ('{"kind": ""}', False),
        ('{"kind": "open"} tail', False), ("[1]", False), ('  {"kind": "open", "ts_ms": "7"}', True),
    ],
)
def test_json_lines(spark, line, ok):
    df = spark.createDataFrame([("r", 1, line)], "run_id string, line_no bigint, line string")
    assert T.trace_json_events(df).count() == ok


def stuck(spark, ticks, **kw):
    df = spark.createDataFrame([("r", t, e) for t, e in ticks], "run_id string, ts_ms bigint, is_event boolean")
    bounds = df.groupBy("run_id").agg(F.min("ts_ms").alias("start_ms"), F.max("ts_ms").alias("end_ms"))
    return T.stuck_runs(df, bounds, **kw).first()["stuck"]


def test_stuck(spark):
    assert stuck(spark, [(0, True), (12_000, True)])
    assert not stuck(spark, [(0, True), (11_900, True)])
    assert stuck(spark, [(s * 1000, False) for s in range(6)])
    assert not stuck(spark, [(s * 1000, s == 3) for s in range(9)])


def stream(spark, tmp_path, batches, schema, transform):
    """Feed batches as files in order, one per micro-batch."""
    source = tmp_path / "in"
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(source))
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(source))
    job = (
        transform(reader).writeStream.format("parquet").option("path", str(tmp_path / "out"))
        .option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    )
    assert job.awaitTermination(120)
    return spark.read.parquet(str(tmp_path / "out")).collect()


def test_stitching_survives_batch_borders(spark, tmp_path):
    rows = [("r", i, text) for i, text in enumerate(LINES)]
    batches = [rows[i : i + 2] for i in range(0, len(rows), 2)]
    got = stream(spark, tmp_path, batches, "run_id string, line_no bigint, line string", ST.stream_stitch)
    want = T.stitch_syscalls(T.syscall_lines(line_frame(spark))).collect()
    assert sorted((r["line_no"], r["tail"]) for r in got) == sorted((r["line_no"], r["tail"]) for r in want)


def test_stream_reports_stuck_runs_once(spark, tmp_path):
    ticks = [("silent", 0, True), ("drift", 0, False), ("fine", 0, True)] + [("drift", s * 1000, False) for s in range(1, 9)]
    ticks += [("silent", 12_000, True), ("silent", 30_000, True), ("fine", 5_000, True)]
    got = stream(spark, tmp_path, [ticks[:5], ticks[5:9], ticks[9:]], "run_id string, ts_ms bigint, is_event boolean", ST.stream_stuck)
    assert sorted((r["run_id"], r["reason"]) for r in got) == [("drift", "drifting"), ("silent", "silent")]


def test_trace_numbers(spark):
    """Whole numbers as text, JSON numbers cut to whole ones, booleans; other text drops the line."""
    values = {"7": 7, '"8"': 8, "9.9": 9, "1e3": 1000, "true": 1, "false": 0, "null": 0, '""': 0, '"7.5"': None, '"x"': None, '"true"': None, "[1]": None}
    lines = [("r", i, f'{{"kind": "open", "ts_ms": 5, "pid": {v}}}') for i, v in enumerate(values)]
    rows = T.trace_json_events(spark.createDataFrame(lines, "run_id string, line_no int, line string")).collect()
    assert {r["line_no"]: r["pid"] for r in rows} == {i: n for i, n in enumerate(values.values()) if n is not None}


def test_deeply_nested_reply_is_no_json(spark):
    deep = "see " + '{"a":' * 50_000 + "1" + "}" * 50_000
    rows = VT.reply_json(spark.createDataFrame([(0, deep), (1, 'so {"verdict": "safe"} it is')], "i int, reply string")).collect()
    assert {r["i"]: r["doc"] for r in rows} == {0: None, 1: '{"verdict": "safe"}'}


def test_secrets_leave_every_field(spark):
    events = spark.createDataFrame([("r", "a/s3cret", "x s3cret", ["--key", "k=s3cret"]), ("q", "s3cret", "s3cret", ["s3cret"])], "run_id string, target string, raw string, argv array<string>")
    tokens = spark.createDataFrame([("r", "s3cret"), ("q", "")], "run_id string, token string")
    rows = {r["run_id"]: r for r in T.scrub_tokens(events, tokens).collect()}
    assert (rows["r"]["target"], rows["r"]["raw"], rows["r"]["argv"]) == ("a/[REDACTED]", "x [REDACTED]", ["--key", "k=[REDACTED]"])
    assert rows["q"]["argv"] == ["s3cret"]


def test_names_under_a_frequent_token_are_dealt_to_tasks(spark):
    """Names that all hold the same marks: the pairs are those of all against all, and no side of names is sorted by token."""
    popular = [f"{a}-{b}" for a in ("left", "right", "lodash") for b in ("pad", "core")]
    own = popular + [p + "s" for p in popular] + [p.replace("-", "_") for p in popular] + [f"left-pad-{i}" for i in range(40)]
    df = spark.createDataFrame([("npm", n) for n in own], "ecosystem string, name string")
    known = spark.createDataFrame([("npm", n) for n in popular], "ecosystem string, name string")
    pairs = N.typosquat_candidates(df, known)
    got = {(r["compared"], r["known"]) for r in pairs.collect()}

    def close(a, b):
        shared = sum((Counter(a) & Counter(b)).values())
        return a != b and 2 * min(len(a), len(b)) / (len(a) + len(b)) >= V.TYPO_SIMILARITY and 2 * shared / (len(a) + len(b)) >= V.TYPO_SIMILARITY

    assert got == {(a, b) for a in own for b in popular if close(a, b)}
    plan = pairs._jdf.queryExecution().executedPlan().toString()
    assert "ShuffledHashJoin" in plan and "_part" in plan


def test_registry_rows_are_dealt_to_all_tasks(spark):
    """One file of parts is not one task; the rows are those of the view."""
    from sparkwarden.plans.queries_names import registry_packages
    from sparkwarden.plans.views import spark_view

    folder = "/root/testdata/sf0.001"
    assert "RoundRobinPartitioning" in registry_packages(spark, folder)._jdf.queryExecution().executedPlan().toString()
    plain, dealt = spark_view(spark, folder, "v_registry"), spark_view(spark, folder, "v_registry", dealt="part")
    assert Counter(plain.collect()) == Counter(dealt.collect())
