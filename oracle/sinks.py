"""Oracles of the queries that write and read back."""

from __future__ import annotations

from oracle import orank
from oracle.decisions import SARIF_RESULT, rows
from oracle.evidence import GATE, INDEX, PATH
from sparkwarden.plans.views import AS_OF, with_views

WIDTH = 16


def parts(head: str, item: str, foot: str) -> str:
    return f""", o_items AS (SELECT scan_id, ord // {WIDTH} AS at_, string_agg({item}, ',' ORDER BY ord) AS t FROM o_entries GROUP BY ALL),
  o_parts AS (
    SELECT scan_id, 0 AS kind, NULL AS at_, {head} AS text FROM o_scans
    UNION ALL SELECT scan_id, 1, at_, CASE WHEN at_ > min(at_) OVER (PARTITION BY scan_id) THEN ',' ELSE '' END || t FROM o_items
    UNION ALL SELECT scan_id, 2, NULL, {foot} FROM o_scans)"""


def scans() -> str:
    return rows() + f""", o_scans AS (
    SELECT s.scan_id, coalesce(r.total, 0) AS total, coalesce(r.safe, 0) AS safe, coalesce(r.suspicious, 0) AS suspicious, coalesce(r.malicious, 0) AS malicious, coalesce(r.errors, 0) AS errors,
      CASE coalesce(r.worst, 0) WHEN 0 THEN 'safe' WHEN 1 THEN 'needs_review' WHEN 2 THEN 'malicious' ELSE 'error' END AS outcome, coalesce(r.worst, 0) AS exit_code
    FROM (SELECT DISTINCT k // 50 AS scan_id FROM v_packages UNION SELECT DISTINCT -1 - k // 50 FROM v_packages) s
    LEFT JOIN (SELECT scan_id, count(*) AS total, count(*) FILTER (WHERE outcome = 'safe') AS safe, count(*) FILTER (WHERE outcome = 'needs_review') AS suspicious,
      count(*) FILTER (WHERE outcome = 'malicious') AS malicious, count(*) FILTER (WHERE outcome = 'error') AS errors, max({orank('outcome')}) AS worst FROM o_rows GROUP BY scan_id) r USING (scan_id))"""


NUMBERED = "SELECT scan_id, row_number() OVER (PARTITION BY scan_id ORDER BY kind, at_) - 1 AS part, text FROM o_parts"


def sql() -> dict[str, str]:
    q: dict[str, str] = {}
    entry = f"""'{{"package":{{"name":"' || name || '","version":"' || version || '","ecosystem":"' || ecosystem || '"}},"prefilter":{{"level":"' || level || '","reason":' || to_json(prefilter_reason) || ',"source_unavailable":' || source_unavailable || '}},"consensus":'
      || CASE WHEN verdict IS NULL THEN 'null' ELSE '{{"verdict":"' || verdict || '","confidence":' || confidence || '}}' END || ',"decision":"' || outcome || '","exit_code":' || {orank('outcome')} || ',"error":' || CASE WHEN outcome = 'error' THEN to_json(reason)::VARCHAR ELSE 'null' END || '}}'"""
    head = """'{"lockfile":"scan-' || scan_id || '","ecosystem":"mixed","packages":['"""
    foot = """'],"summary":{"total":' || total || ',"safe":' || safe || ',"suspicious":' || suspicious || ',"malicious":' || malicious || ',"errors":' || errors || '},"decision":"' || outcome || '","exit_code":' || exit_code || '}'"""
    q["scan_payload"] = with_views(NUMBERED, scans() + ", o_entries AS (SELECT * FROM o_rows)" + parts(head, entry, foot))
    tool = '{"driver":{"name":"sparkwarden","version":"1.0","informationUri":"https://example.org/sparkwarden","rules":[{"id":"supply-chain-risk","shortDescription":{"text":"Supply chain risk detection"}}]}}'
    start = '{"$schema":"https://json.schemastore.org/sarif-2.1.0.json","version":"2.1.0","runs":[{"tool":' + tool + ',"results":['
    entries = f", o_entries AS (SELECT r.scan_id, r.ord, {SARIF_RESULT} AS result FROM o_sarif s JOIN o_rows r USING (package_id))"
    q["sarif_document"] = with_views(NUMBERED, scans() + entries + parts(f"'{start}'", "result", "']}]}'"))
    q["verdict_upsert"] = with_views(
        """SELECT key, greatest(t, t + k % 3 - 1) AS cached_at, CASE WHEN k % 3 >= 1 THEN 'new ' || r ELSE r END AS report
        FROM (SELECT key, arg_max(cached_at, k) AS t, arg_max(report, k) AS r, max(k) AS k FROM v_store GROUP BY key) o"""
    )
    q["source_upsert"] = with_views(
        f"SELECT name, version, registry, CASE WHEN registry = 'npm' THEN path || '/v2' ELSE path END AS path, CASE WHEN registry = 'npm' THEN {AS_OF}::BIGINT ELSE fetched_at END AS fetched_at FROM o_index", INDEX
    )
    q["publish_roundtrip"] = with_views(
        f"""SELECT f.package_id, p.path, p.path || '/' || f.path AS file_path, sha256(f.content) AS digest, t.tree AS sha256, 'safe' AS scan_verdict, k.homepage AS url, {AS_OF}::BIGINT AS fetched_at
        FROM v_files f JOIN (SELECT {PATH} AS path, arg_min(package_id, k) AS package_id FROM v_packages GROUP BY 1) p USING (package_id) JOIN v_packages k USING (package_id)
        JOIN (SELECT package_id, sha256(string_agg(path || chr(0) || content || chr(10), '' ORDER BY path)) AS tree FROM v_files GROUP BY package_id) t USING (package_id)
        WHERE ({GATE.format(extra='')}) = 'ok'"""
    )
    return q
