"""Oracles of the vote, decision and report queries."""

from __future__ import annotations

from oracle import lit, lst, oname, orank, traces
from oracle.evidence import ADV, ENR
from oracle.files import META, decide, prefiltered
from sparkwarden import values as V
from sparkwarden.plans.views import with_views

CONSENSUS = f"""o_w AS (SELECT *, CASE WHEN model = 'm3' THEN 1.0 ELSE weight END * confidence AS pull FROM v_votes),
  o_s AS (SELECT package_id, count(*) FILTER (WHERE verdict <> 'error') AS n_votes, coalesce(sum(pull) FILTER (WHERE verdict <> 'error'), 0) AS total,
      coalesce(sum(pull) FILTER (WHERE verdict = 'malicious'), 0) AS m, coalesce(sum(pull) FILTER (WHERE verdict = 'suspicious'), 0) AS s, coalesce(sum(pull) FILTER (WHERE verdict = 'safe'), 0) AS f,
      bool_or(verdict = 'malicious') AND bool_or(verdict = 'safe') AS has_disagreement, avg(confidence) FILTER (WHERE verdict <> 'error') AS mean, any_value(verdict) FILTER (WHERE verdict <> 'error') AS single FROM o_w GROUP BY package_id),
  o_r AS (SELECT *, CASE WHEN total > 0 THEN round(m / total, 9) ELSE 0 END AS ms, CASE WHEN total > 0 THEN round(s / total, 9) ELSE 0 END AS ss, CASE WHEN total > 0 THEN round(f / total, 9) ELSE 0 END AS fs FROM o_s),
  o_v AS (SELECT *, CASE WHEN n_votes = 0 THEN 'error' WHEN n_votes = 1 THEN single WHEN has_disagreement THEN 'needs_human_review' WHEN ms > {V.MALICIOUS_SHARE} THEN 'malicious' WHEN ss > {V.SUSPICIOUS_SHARE} THEN 'suspicious' ELSE 'safe' END AS verdict FROM o_r),
  o_cons AS (SELECT package_id, verdict, has_disagreement, n_votes, CASE WHEN n_votes = 0 THEN 0.0 WHEN n_votes = 1 OR has_disagreement THEN mean WHEN verdict = 'malicious' THEN ms WHEN verdict = 'suspicious' THEN ss ELSE fs END AS confidence FROM o_v),
  o_dc AS (SELECT package_id, CASE verdict WHEN 'safe' THEN 'safe' WHEN 'malicious' THEN 'malicious' WHEN 'error' THEN 'error' ELSE 'needs_review' END AS outcome,
      CASE WHEN verdict = 'error' THEN 'All models returned errors' ELSE 'Consensus: ' || verdict END AS reason FROM o_cons)"""

EXIT = f"{orank('outcome')} AS exit_code, outcome = 'malicious' AS should_block_install"

PACKAGE_CONSENSUS = CONSENSUS.replace("v_votes", "v_package_votes")

# Evidence and traces are taken from their own oracles.
ENRICH = f"""{ENR}, {ADV},
  o_hi AS (SELECT package_id, string_agg(id, ', ' ORDER BY pos) AS ids FROM (
    SELECT p.package_id, a.pos, a.id, row_number() OVER (PARTITION BY p.package_id ORDER BY a.pos) AS n FROM v_packages p JOIN o_adv a USING (ecosystem, name) WHERE a.severity IN ('HIGH', 'CRITICAL')) t WHERE n <= 5 GROUP BY package_id),
  o_de0 AS (SELECT package_id, CASE WHEN ids IS NOT NULL THEN 'Known vulnerabilities detected: ' || ids WHEN score < 5.0 THEN 'OpenSSF Scorecard is low (' || printf('%.1f', score) || '/10)'
    WHEN provenance_status = 'invalid' OR NOT provenance_verified THEN coalesce(nullif(provenance_details, ''), 'Invalid provenance metadata') WHEN errors <> '' THEN split_part(errors, ',', 1) END AS reason
    FROM o_enr LEFT JOIN o_hi USING (package_id)),
  o_de AS (SELECT package_id, 'needs_review' AS outcome, reason FROM o_de0 WHERE reason IS NOT NULL)"""


def report() -> str:
    runs = traces.sql()["decide_trace"]
    return ", ".join(
        [
            prefiltered(), PACKAGE_CONSENSUS, ENRICH,
            f"o_dp AS ({decide('o_pref')})",
            f"""o_big AS (SELECT DISTINCT package_id FROM (SELECT *, sum(CASE WHEN size <= 30000 THEN size ELSE 0 END) OVER (PARTITION BY package_id ORDER BY ord) AS r FROM v_files) t WHERE size > 30000 OR r > 60000),
            o_flagged AS (SELECT d.*, b.package_id IS NOT NULL AS o FROM o_dp d LEFT JOIN o_big b USING (package_id)),
            o_first AS (SELECT d.package_id, CASE WHEN o THEN 'needs_review' ELSE coalesce(c.outcome, d.outcome) END AS outcome,
                CASE WHEN o THEN 'Archive exceeds size cap; manual review required' ELSE coalesce(c.reason, d.reason) END AS reason, 0 AS ord FROM o_flagged d LEFT JOIN o_dc c USING (package_id)),
            o_runs AS (SELECT package_id, outcome, reason, row_number() OVER (PARTITION BY package_id ORDER BY {orank('outcome')} DESC, ord) AS n FROM ({runs}) t JOIN v_package_runs USING (run_id)),
            o_union AS (SELECT * FROM o_first UNION ALL SELECT package_id, outcome, reason, 1 FROM o_de UNION ALL SELECT package_id, outcome, reason, 2 FROM o_runs WHERE n = 1),
            o_rep AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY package_id ORDER BY {orank('outcome')} DESC, ord) AS rn FROM o_union WHERE package_id IN (SELECT package_id FROM o_first)) t WHERE rn = 1)""",
        ]
    )


def scan() -> str:
    return report() + ", o_scan AS (SELECT p.k // 50 AS scan_id, p.k AS ord, c.outcome, c.reason FROM o_rep c JOIN v_packages p USING (package_id))"


def rows() -> str:
    return (
        report()
        + """, o_sig AS (SELECT package_id, list_sort(list(DISTINCT category)) AS signals FROM o_meta GROUP BY package_id),
  o_rows AS (SELECT p.*, p.k // 50 AS scan_id, p.k AS ord, c.verdict, round(c.confidence, 3) AS confidence, d.outcome, d.reason, coalesce(s.signals, []) AS signals, f.o AS source_unavailable,
      CASE WHEN f.o THEN 'MEDIUM' ELSE f.level END AS level, NOT f.o AND f.level NOT IN ('MEDIUM', 'HIGH', 'CRITICAL') AS passed, CASE WHEN f.o THEN 'Archive exceeds size cap; manual review required' ELSE f.reason END AS prefilter_reason
    FROM v_packages p JOIN o_flagged f USING (package_id) LEFT JOIN o_cons c USING (package_id) JOIN o_rep d USING (package_id) LEFT JOIN o_sig s USING (package_id)),
  o_sarif AS (SELECT package_id, 'supply-chain-risk' AS rule_id, CASE coalesce(verdict, 'safe') WHEN 'malicious' THEN 'error' WHEN 'safe' THEN 'note' WHEN 'error' THEN 'none' ELSE 'warning' END AS level,
      'Package ' || name || '@' || version || ' (' || ecosystem || '): ' || reason || '. Risk signals: ' || CASE WHEN len(signals) > 0 THEN array_to_string(signals, ', ') ELSE 'none' END AS message,
      coalesce(verdict, 'safe') AS verdict, coalesce(confidence, 0.0) AS confidence, ecosystem FROM o_rows)"""
    )


SARIF_RESULT = """'{"ruleId":"' || s.rule_id || '","level":"' || s.level || '","message":{"text":' || to_json(s.message) || '},"properties":{"verdict":"' || s.verdict || '","confidence":' || s.confidence || ',"ecosystem":"' || s.ecosystem || '"}}'"""


def first_word(text: str) -> str:
    return f"list_filter({lst(V.CONTRADICTION_WORDS)}, lambda w: contains(lower({text}), w))[1]"


def sql() -> dict[str, str]:
    q: dict[str, str] = {}
    note = "'output_validation(HIGH): verdict ''safe'' contradicts reasoning containing ''' || w || ''''"
    # Built from the votes behind the replies, so the parsing itself is not repeated here.
    q["normalise_votes"] = with_views(
        f"""SELECT package_id, model, pos, CASE WHEN junk OR odd THEN 'error' WHEN v = 'safe' AND w IS NOT NULL THEN 'suspicious' ELSE v END AS verdict, CASE WHEN junk THEN 0.0 ELSE c END AS confidence,
          CASE WHEN junk THEN '' ELSE reasoning END AS reasoning, CASE WHEN junk THEN '' WHEN NOT odd AND v = 'safe' AND w IS NOT NULL THEN signal || ';' || {note} ELSE signal END AS signals
        FROM (SELECT *, {first_word('reasoning')} AS w FROM (SELECT package_id, model, pos, signal, k % 17 = 0 AS junk, k % 19 = 0 AS odd, CASE WHEN verdict = 'error' THEN 'safe' ELSE verdict END AS v,
          CASE WHEN k % 7 = 0 THEN 1.0 ELSE least(round(confidence * 100)::INT / 100.0, 1.0) END AS c, CASE WHEN k % 11 = 0 THEN 'it Steals and uploads sensitive files' ELSE 'fine' END AS reasoning FROM v_votes) a) b"""
    )
    q["contradicted_votes"] = with_views(
        f"""SELECT package_id, model, pos, CASE WHEN verdict = 'safe' AND w IS NOT NULL THEN 'suspicious' ELSE verdict END AS verdict, CASE WHEN verdict = 'safe' AND w IS NOT NULL THEN signal || ';' || {note} ELSE signal END AS signals, reasoning
        FROM (SELECT *, {first_word('reasoning')} AS w FROM (SELECT *, CASE WHEN k % 5 = 0 THEN 'It Steals data, a Backdoor ' || signal WHEN k % 5 = 1 THEN 'Reads SSH key and sends data to a host' ELSE 'nothing wrong' END AS reasoning FROM v_votes) a) b"""
    )
    advice = " ".join(f"WHEN {lit(k)} THEN {lit(v)}" for k, v in V.RECOMMENDATIONS.items())
    q["consensus_vote"] = with_views(
        f"SELECT package_id, verdict, round(confidence, 6) AS confidence, has_disagreement, n_votes, CASE verdict {advice} ELSE '' END AS recommendation FROM o_cons", CONSENSUS
    )
    q["signal_union"] = with_views("SELECT package_id, signal, min(pos) AS first_pos FROM v_votes WHERE verdict <> 'error' GROUP BY ALL")
    q["decide_consensus"] = with_views(f"SELECT package_id, outcome, reason, {EXIT} FROM o_dc", CONSENSUS)
    q["decide_enrichment"] = with_views(f"SELECT package_id, outcome, reason, {EXIT} FROM o_de", ENRICH)
    q["decide_report"] = with_views(f"SELECT package_id, outcome, reason, {EXIT} FROM o_rep", report())
    q["scan_summary"] = with_views(
        "SELECT scan_id, count(*) AS total, count(*) FILTER (WHERE outcome = 'safe') AS safe, count(*) FILTER (WHERE outcome = 'needs_review') AS suspicious, "
        "count(*) FILTER (WHERE outcome = 'malicious') AS malicious, count(*) FILTER (WHERE outcome = 'error') AS errors FROM o_scan GROUP BY scan_id",
        scan(),
    )
    q["scan_decisions"] = with_views(
        f"""SELECT scan_id, outcome, reason, {EXIT} FROM (
          SELECT s.scan_id, coalesce(b.outcome, 'safe') AS outcome, coalesce(b.reason, 'No packages scanned') AS reason FROM (SELECT DISTINCT k // 50 AS scan_id FROM v_packages UNION SELECT DISTINCT -1 - k // 50 FROM v_packages) s
          LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY scan_id ORDER BY {orank('outcome')} DESC, ord) AS rn FROM o_scan) b ON b.scan_id = s.scan_id AND b.rn = 1) t""",
        scan(),
    )
    q["report_json"] = with_views(
        f"""SELECT package_id, '{{"package":{{"name":"' || name || '","version":"' || version || '","ecosystem":"' || ecosystem || '"}},"prefilter":{{"level":"' || level || '","passed":' || passed || ',"reason":' || to_json(prefilter_reason) || ',"source_unavailable":' || source_unavailable || '}}'
          || CASE WHEN verdict IS NULL THEN '' ELSE ',"consensus":{{"verdict":"' || verdict || '","confidence":' || confidence || '}}' END || ',"decision":"' || outcome || '","exit_code":' || {orank('outcome')} || ',"should_block_install":' || (outcome = 'malicious') || '}}' AS document FROM o_rows""",
        rows(),
    )
    q["report_sarif"] = with_views("SELECT * FROM o_sarif", rows())
    q["sarif_result"] = with_views(f"SELECT package_id, {SARIF_RESULT} AS result FROM o_sarif s", rows())
    return q
