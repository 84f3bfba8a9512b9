"""Oracles of the trace and command queries."""

from __future__ import annotations

from oracle import lit, lits, orank, rank
from sparkwarden import values as V
from sparkwarden.plans.views import with_views

REAL = "coalesce(source, '') NOT IN ('resource_probe', 'observer_canary')"


def x(path: str, doc: str = "j") -> str:
    return f"json_extract_string({doc}, '{path}')"


def whole(name: str) -> str:
    text = x(f"$.{name}")
    return (
        f"CASE json_type(j, '$.{name}') WHEN 'DOUBLE' THEN trunc({text}::DOUBLE)::BIGINT WHEN 'BOOLEAN' THEN CASE {text} WHEN 'true' THEN 1 ELSE 0 END "
        f"WHEN 'VARCHAR' THEN CASE WHEN {text} = '' THEN 0 WHEN regexp_full_match({text}, '[+-]?[0-9]+') THEN try_cast({text} AS BIGINT) END "
        f"ELSE try_cast(coalesce({text}, '0') AS BIGINT) END"
    )


JSON = f"""o_json AS (SELECT run_id, line_no, {x('$.kind')} AS kind, ts_ms, pid, {x('$.process')} AS process, {x('$.target')} AS target, t AS raw FROM (
    SELECT *, {whole('ts_ms')} AS ts_ms, {whole('pid')} AS pid FROM (
      SELECT *, CASE WHEN t LIKE '{{%' AND json_valid(t) THEN t END AS j FROM (SELECT run_id, line_no, trim(line) AS t FROM v_trace_json) a) b WHERE j IS NOT NULL) c
  WHERE {x('$.kind')} <> '' AND ts_ms IS NOT NULL AND pid IS NOT NULL)"""

SPLIT = """o_split AS (SELECT *, CASE WHEN tail LIKE '<... % resumed>%' THEN 'resumed' WHEN tail LIKE '%<unfinished ...>' THEN 'unfinished' WHEN regexp_matches(tail, '(?s)^(\\w+)\\((.*)\\)\\s*=\\s*(.+)$') THEN 'complete' END AS form FROM (
    SELECT run_id, line_no, regexp_extract(line, '^(?:\\[pid )?(\\d+)', 1)::BIGINT AS pid, regexp_replace(line, '^(?:\\[pid \\d+\\]|\\d+) ', '') AS tail FROM v_syscalls WHERE regexp_matches(line, '^(?:\\[pid \\d+\\]|\\d+) ')) a),
  o_marks AS (SELECT *, lag(form) OVER w AS bform, lag(tail) OVER w AS btail FROM o_split WHERE form IN ('resumed', 'unfinished') WINDOW w AS (PARTITION BY run_id, pid ORDER BY line_no)),
  o_stitched AS (SELECT * FROM (SELECT run_id, line_no, pid, regexp_extract(tail, '^<\\.\\.\\. (\\w+)', 1) || '(' || regexp_replace(regexp_replace(btail, '^\\w+\\(', ''), '\\s*<unfinished \\.\\.\\.>$', '') || ' ' || regexp_replace(tail, '^<\\.\\.\\. \\w+ resumed>\\s*', '') AS tail
    FROM o_marks WHERE form = 'resumed' AND bform = 'unfinished') s WHERE regexp_matches(tail, '(?s)^(\\w+)\\((.*)\\)\\s*=\\s*(.+)$'))"""

CALLS = SPLIT + """, o_calls AS (SELECT run_id, line_no, pid, regexp_extract(tail, '(?s)^(\\w+)\\((.*)\\)\\s*=\\s*(.+)$', 1) AS c, regexp_extract(tail, '(?s)^(\\w+)\\((.*)\\)\\s*=\\s*(.+)$', 2) AS a, trim(regexp_extract(tail, '(?s)^(\\w+)\\((.*)\\)\\s*=\\s*(.+)$', 3)) AS r
    FROM (SELECT run_id, line_no, pid, tail FROM o_split WHERE form = 'complete' UNION ALL SELECT * FROM o_stitched) u),
  o_sys AS (
    SELECT run_id, line_no, pid, CASE WHEN port = '53' THEN 'dns' ELSE 'connect' END AS kind, CASE WHEN port = '53' THEN 'resolver=' || ip WHEN port <> '' THEN ip || ':' || port WHEN contains(a, 'AF_INET6') THEN '[ipv6]:' || regexp_extract(a, 'htons\\((\\d+)\\)', 1)
        WHEN contains(a, 'AF_UNIX') THEN 'unix:' || regexp_extract(a, 'sun_path="([^"]+)"', 1) ELSE substring(a, 1, 80) END AS target, '' AS argv, NULL::VARCHAR AS source, 'connect(' || a || ')' AS raw
      FROM (SELECT *, CASE WHEN contains(a, 'sa_family=AF_INET,') THEN regexp_extract(a, 'sin_port=htons\\((\\d+)\\)', 1) ELSE '' END AS port, regexp_extract(a, 'inet_addr\\("([^"]+)"\\)', 1) AS ip FROM o_calls WHERE c = 'connect') k
    UNION ALL SELECT run_id, line_no, pid, CASE WHEN contains(a, 'O_WRONLY') THEN 'write' ELSE 'open' END, regexp_extract(a, '"([^"]+)"', 1), '', NULL, 'openat(' || a || ')' FROM o_calls WHERE c = 'openat'
    UNION ALL SELECT run_id, line_no, pid, 'exec', regexp_extract(a, '^"([^"]+)"', 1), array_to_string(regexp_extract_all(regexp_extract(a, '\\[(.*)\\]', 1), '"([^"]*)"', 1), ' '), NULL, 'execve(' || substring(a, 1, 120) || ')' FROM o_calls WHERE c = 'execve'
    UNION ALL SELECT run_id, line_no, pid, 'write', 'fd=' || coalesce(nullif(regexp_extract(a, '^(\\d+),', 1), ''), '?'), '', NULL, 'write(' || substring(a, 1, 80) || ')' FROM o_calls WHERE c = 'write'
    UNION ALL SELECT run_id, line_no, pid, 'clone', 'child_pid=' || regexp_extract(r, '^(\\d+)', 1), '', NULL, 'clone(' || substring(a, 1, 80) || ')' FROM o_calls WHERE c = 'clone' AND regexp_matches(r, '^\\d'))"""

TOUCH = f"(target IN ({lits(V.DECOY_PATHS + V.DECOY_AUTOSTART_DIRS)}) OR " + " OR ".join(f"starts_with(target, {lit(d + '/')})" for d in V.DECOY_AUTOSTART_DIRS) + ")"

FACTS = f"""o_facts AS (SELECT r.*, count(e.seq) FILTER (WHERE {REAL}) AS n_real, count(DISTINCT kind) FILTER (WHERE {REAL}) AS n_kinds, coalesce(bool_or({REAL} AND kind IN ('connect', 'dns')), false) AS has_net,
    coalesce(bool_or({REAL} AND kind IN ('write', 'persist_write')), false) AS has_write, count(*) FILTER (WHERE {REAL} AND kind = 'exec') AS n_exec, coalesce(max({rank('severity')}), 0) AS worst,
    arg_min(kind, seq) FILTER (WHERE severity = 'HIGH') AS khigh, arg_min(kind, seq) FILTER (WHERE severity = 'MEDIUM') AS kmed,
    bool_or(kind = 'exec' AND contains(lower(target), 'postinstall')) AND bool_or(kind = 'connect') AS c_build_hooks, bool_or(kind = 'write' AND target LIKE '/tmp%') AND bool_or(kind = 'connect') AS c_derived_exfil,
    bool_or(kind = 'connect' AND contains(target, 'dbus')) AS c_direct_xpc, bool_or(kind = 'exec' AND contains(target, 'ptrace')) AS c_anti_debug, bool_or(kind = 'sleep' AND try_cast(target AS BIGINT) > 30) AS c_time_bomb, contains(any_value(r.skipped_unexpected), 'drift') AS c_parser_partial_drift
  FROM v_runs r LEFT JOIN v_trace_events e ON e.run_id = r.run_id GROUP BY ALL),
  o_f AS (SELECT *, timeout OR skipped_unexpected <> '' OR error IS NOT NULL OR (ran AND duration_ms >= 2000 AND n_kinds < 3 AND n_real < 10) AS failed, ran AND NOT (has_net OR has_write OR n_exec > 1) AS quiet FROM o_facts),
  o_cats AS ({' UNION ALL '.join(f"SELECT run_id, '{c}' AS category FROM o_f WHERE c_{c}" for c in V.EVASION_CATEGORIES if c != 'env_mutation')}),
  o_touch AS (SELECT run_id, string_agg(target, ', ' ORDER BY seq) AS touches FROM (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY seq) AS n FROM v_trace_events WHERE {TOUCH}) t WHERE n <= 3 GROUP BY run_id)"""


def decide(high: str, medium: str, only: str, source: str) -> str:
    sev = "'Sandbox observed ' || CASE WHEN worst = 3 THEN khigh ELSE kmed END || ' event with severity ' || CASE WHEN worst = 3 THEN 'high' ELSE 'medium' END"
    gate = f"CASE WHEN platform = 'Darwin' AND {only} THEN 1 WHEN {high} THEN 2 WHEN {medium} >= 2 THEN 1 ELSE 0 END"
    return f"""SELECT run_id, outcome, reason, {orank('outcome')} AS exit_code, outcome = 'malicious' AS should_block_install FROM (
      SELECT run_id, CASE WHEN failed THEN 'needs_review' WHEN g = 2 OR touches IS NOT NULL OR worst >= 3 THEN 'malicious' WHEN worst = 2 OR quiet OR g = 1 THEN 'needs_review' END AS outcome,
        CASE WHEN failed THEN coalesce(error, 'Sandbox observation incomplete; manual review required') WHEN g = 2 THEN 'Multi-evasion gate: ≥2 HIGH evasion tactics with dynamic confirmation' WHEN touches IS NOT NULL THEN 'Sandbox canary file(s) read during install: ' || touches
          WHEN worst >= 2 THEN {sev} WHEN quiet THEN 'Sandbox run was suspiciously quiet (no network, no external writes, no exec)' WHEN g = 1 THEN 'Multi-evasion gate: ≥2 evasion tactics detected' END AS reason
      FROM (SELECT f.*, t.touches, {gate} AS g FROM {source} f LEFT JOIN o_touch t USING (run_id)) a) b WHERE outcome IS NOT NULL"""


COVER = f"""o_cov AS (SELECT run_id, platform, skipped_unexpected <> '' AS drift, CASE WHEN platform = 'Linux' THEN CASE WHEN len(run_id) % 2 = 1 THEN 'No Linux connect-observer available (install strace)' WHEN timeout THEN 'wall-clock timeout'
    WHEN error IS NOT NULL AND nr = 0 THEN 'observer_crash: strace rc=1' WHEN duration_ms % 7 = 0 THEN 'stuck_observer: drift-aware watchdog tripped' WHEN nr = 0 THEN 'observer_silent: no real events observed (canary missing)' END END AS error
  FROM (SELECT r.*, CASE WHEN duration_ms % 5 = 0 THEN 0 ELSE (SELECT count(*) FROM v_trace_events e WHERE e.run_id = r.run_id AND {REAL}) END AS nr FROM v_runs r) t),
  o_seen AS (SELECT *, CASE WHEN platform = 'Linux' AND error IS NULL THEN ['fs_writes', 'network_capture', 'dns', 'process_tree'] ELSE ['fs_writes'] END AS observed FROM o_cov)"""

DENSE = """o_ticks AS (SELECT run_id, floor(ts_ms / 8)::BIGINT AS ts, NOT (user_id % 3 = 0 AND seq % 4 < 3) AS ev FROM v_trace_events),
  o_act AS (SELECT run_id, ts // 1000 AS sec, count(*) FILTER (WHERE ev) AS n FROM o_ticks GROUP BY ALL),
  o_secs AS (SELECT run_id, sec FROM o_act UNION SELECT run_id, min(ts) // 1000 - 1 FROM o_ticks GROUP BY run_id UNION SELECT run_id, max(ts) // 1000 + 1 FROM o_ticks GROUP BY run_id),
  o_gap AS (SELECT run_id, coalesce(max(sec - prev), 0) AS gap FROM (SELECT *, lag(sec) OVER (PARTITION BY run_id ORDER BY sec) AS prev FROM o_secs) t GROUP BY run_id),
  o_isl AS (SELECT run_id, sec - row_number() OVER (PARTITION BY run_id ORDER BY sec) AS isl FROM o_act WHERE n = 0),
  o_drift AS (SELECT DISTINCT run_id FROM (SELECT run_id FROM o_isl GROUP BY run_id, isl HAVING count(*) >= 6) t)"""


def commands() -> str:
    """Templates are known here, so what each installs is written out by hand."""
    rows = [
        (0, "check", "pypi", "{n}"), (1, "scan", "pypi", "requirements.txt"), (2, "check", "pypi", "{n}"),
        (3, "check", "npm", "{n}"), (3, "check", "npm", "@scope/{n}"), (4, "check", "npm", "{n}"), (5, "check", "npm", "{n}"),
        (6, "scan", "npm", "package-lock.json"), (7, "check", "pub", "{n}"), (8, "scan", "cocoapods", "Podfile.lock"),
        (9, "check", "cargo", "{n}"), (10, "check", "gem", "{n}"), (11, "check", "composer", "{n}/core"),
        (12, "check", "go", "example.org/{n}"), (13, "check", "nuget", "{n}"), (22, "check", "gem", "{n}"), (22, "check", "gem", "rake"),
    ]
    values = ", ".join(f"({k}, {lit(a)}, {lit(b)}, {lit(c)})" for k, a, b, c in rows)
    return f"""o_tpl(k, mode, ecosystem, target) AS (VALUES {values}),
      o_cmd AS (SELECT e.event_id, t.mode, t.ecosystem, replace(t.target, '{{n}}', p.name) AS target FROM events e JOIN v_packages p ON p.k = e.event_id % (SELECT count(*) FROM part) JOIN o_tpl t ON t.k = e.event_id % 24)"""


JUDGED = """SELECT event_id, c.ecosystem, target AS name, CASE WHEN v.b THEN 'block' ELSE 'allow' END AS decision FROM o_cmd c
  LEFT JOIN (SELECT ecosystem, name, min(k) % 3 = 0 AS b FROM v_packages GROUP BY ALL) v ON v.ecosystem = c.ecosystem AND v.name = c.target WHERE mode = 'check'"""


def sql() -> dict[str, str]:
    q: dict[str, str] = {}
    q["trace_json_events"] = with_views("SELECT * FROM o_json", JSON)
    q["stream_trace_parse"] = q["trace_json_events"]
    q["trace_syscall_events"] = with_views("SELECT * FROM o_sys", CALLS)
    q["stitch_syscalls"] = with_views("SELECT * FROM o_stitched", SPLIT)
    q["stream_stitch"] = q["stitch_syscalls"]
    q["scrub_tokens"] = with_views(
        "SELECT e.run_id, line_no, CASE WHEN platform = 'Linux' THEN replace(target, '/app/', '[REDACTED]') ELSE target END AS target, CASE WHEN platform = 'Linux' THEN replace(raw, '/app/', '[REDACTED]') ELSE raw END AS raw FROM o_json e JOIN v_runs USING (run_id)",
        JSON,
    )
    q["real_events"] = with_views(f"SELECT run_id, seq, kind, source FROM v_trace_events WHERE {REAL}")
    q["canary_hits"] = with_views(f"SELECT run_id, seq, kind, target FROM v_trace_events WHERE {TOUCH}")
    q["orphan_clones"] = with_views(
        """SELECT run_id, seq, child AS pid, 'floor_violation' AS kind, 'MEDIUM' AS severity, 'orphan_clone child_pid=' || child AS target FROM (SELECT *, replace(target, 'child_pid=', '')::BIGINT AS child FROM v_trace_events WHERE kind = 'clone') c
        WHERE NOT EXISTS (SELECT 1 FROM v_trace_events e WHERE e.kind = 'exec' AND e.run_id = c.run_id AND e.pid = c.child)"""
    )
    q["trace_correlation"] = with_views("SELECT run_id, category FROM o_cats", FACTS)
    q["trace_floor"] = with_views("SELECT run_id, n_real, n_kinds, failed FROM o_f", FACTS)
    q["quiet_runs"] = with_views("SELECT run_id, n_exec FROM o_f WHERE quiet", FACTS)
    q["parse_quality"] = with_views(
        """SELECT run_id, n_lines, n_events, error, error IS NOT NULL AS drift FROM (SELECT *, CASE WHEN n_lines > 0 AND n_events = 0 THEN 'parser matched 0/' || n_lines || ' lines — full schema drift or wrong channel'
          WHEN n_lines >= 4 AND n_events / n_lines < 0.5 THEN 'parser matched ' || n_events || '/' || n_lines || ' lines (' || round_even(n_events / n_lines * 100, 0)::BIGINT || '%) — likely partial schema drift' END AS error
          FROM (SELECT l.run_id, count(*) FILTER (WHERE trim(line) <> '') AS n_lines, count(j.line_no) AS n_events FROM v_trace_json l LEFT JOIN o_json j USING (run_id, line_no) GROUP BY l.run_id) a) b""",
        JSON,
    )
    q["coverage"] = with_views(
        "SELECT run_id, array_to_string(observed, ',') AS observed, concat_ws(',', CASE WHEN drift THEN 'parser_partial_drift' END, CASE WHEN error IS NOT NULL THEN 'network_capture' END) AS skipped_unexpected, error FROM o_seen", COVER
    )
    q["coverage_split"] = with_views(
        """SELECT run_id, array_to_string(list_filter(miss, lambda s: list_contains(fl, s)), ',') AS expected, array_to_string(list_filter(miss, lambda s: NOT list_contains(fl, s)), ',') AS unexpected FROM (
          SELECT run_id, list_filter(['syscall_trace', 'network_capture', 'fs_writes', 'process_tree', 'dns', 'env_reads'], lambda s: NOT list_contains(observed, s)) AS miss, CASE WHEN len(run_id) % 3 = 0 THEN [] ELSE ['syscall_trace', 'process_tree', 'env_reads'] END AS fl FROM o_seen) t""",
        COVER,
    )
    q["stuck_runs"] = with_views(
        "SELECT g.run_id, gap AS longest_gap, gap >= 4 AS silent, d.run_id IS NOT NULL AS drifting, gap >= 4 OR d.run_id IS NOT NULL AS stuck FROM o_gap g LEFT JOIN o_drift d ON d.run_id = g.run_id", DENSE
    )
    only = "(coalesce(c_direct_xpc, false) AND NOT coalesce(c_build_hooks OR c_derived_exfil OR c_anti_debug OR c_time_bomb OR c_parser_partial_drift, false))"
    n_medium = "(SELECT count(*) FROM o_cats c WHERE c.run_id = f.run_id)"
    q["decide_trace"] = with_views(decide("false", n_medium, only, "o_f"), FACTS)
    with_static = "(SELECT *, len(run_id) % 2 = 0 AS st FROM o_f)"
    high = "(st AND coalesce(c_anti_debug OR c_build_hooks, false))"
    medium = "(SELECT count(DISTINCT category) FROM (SELECT run_id, category FROM o_cats UNION ALL SELECT run_id, unnest(['anti_debug', 'build_hooks']) FROM o_f WHERE len(run_id) % 2 = 0) c WHERE c.run_id = f.run_id)"
    q["decide_trace_static"] = with_views(decide(high, medium, f"({only} AND NOT st)", with_static), FACTS)
    q["install_commands"] = with_views("SELECT event_id, mode, ecosystem, target FROM o_cmd", commands())
    q["risky_commands"] = with_views(
        """SELECT event_id, CASE WHEN t IN (14, 18) THEN 'HIGH' ELSE 'MEDIUM' END AS risk, CASE t WHEN 14 THEN 'Piping remote script to shell: http://example.org/' || name || '.sh' WHEN 18 THEN 'Piping remote script to shell: http://h/' || name
          WHEN 15 THEN 'Untrusted Docker image: evil/' || name || ':1' ELSE 'VSCode extension install: pub.' || name END AS reason FROM (SELECT event_id, event_id % 24 AS t, p.name FROM events JOIN v_packages p ON p.k = event_id % (SELECT count(*) FROM part)) e WHERE t IN (14, 15, 16, 18)"""
    )
    q["judged_commands"] = with_views(JUDGED, commands())
    q["stream_commands"] = q["judged_commands"]
    q["stream_warnings"] = q["risky_commands"]
    q["stream_complete_calls"] = with_views("SELECT * FROM o_sys", CALLS.replace(" UNION ALL SELECT * FROM o_stitched", ""))
    q["stream_stuck"] = f"SELECT run_id FROM ({q['stuck_runs']}) s WHERE stuck"
    q["run_health"] = with_views(
        f"""SELECT f.run_id, n_real, least(n_kinds, 3) AS n_kinds, n_exec, n_lines, n_events, failed, quiet, drift FROM o_f f JOIN ({q["parse_quality"][q["parse_quality"].rindex("SELECT run_id, n_lines, n_events, error"):]}) p USING (run_id)""",
        f"{FACTS}, {JSON}",
    )
    q["stream_run_health"] = q["run_health"]
    return q
