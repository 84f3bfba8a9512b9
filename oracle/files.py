"""Oracles of the file queries."""

from __future__ import annotations

from oracle import lit, lits, lst, m, name, oname, orank, rank, rx
from oracle.names import typos
from sparkwarden import values as V
from sparkwarden.plans.views import AS_OF, with_views

ENTROPY = 4.5


def rules_values() -> str:
    rows = []
    for id_, severity, description, tags, _, pattern in V.RULES:
        flag = "" if id_ in V.CASE_SENSITIVE_RULES else "(?i)"
        rows.append(
            f"({lit(id_)}, {lit(pattern)}, {lit(severity)}, 'any', '*', {lit(description)}, {lst(tags)}, "
            f"{'true' if not flag else 'false'}, {lit(flag + pattern)})"
        )
    return (
        "o_rules(id, pattern, severity, scope, ecosystem, description, tags, case_sensitive, rx) AS (VALUES "
        + ", ".join(rows)
        + ")"
    )


CLS = f"""o_cls AS (SELECT f.*, list_last(string_split(path, '/')) AS name, len(string_split(path, '/')) - 1 AS depth,
  list_last(string_split(path, '/')) IN ({lits(V.INSTALL_NAMES)}) OR path LIKE '%.pth'
    OR (list_last(string_split(path, '/')) IN ({lits(V.ROOT_INSTALL_NAMES)}) AND len(string_split(path, '/')) <= 2) AS is_install,
  list_has_any(string_split(path, '/'), {lst(V.SKIP_DIRS)}) AS skip_dir,
  CASE WHEN contains(list_last(string_split(path, '/')), '.') THEN lower('.' || list_last(string_split(list_last(string_split(path, '/')), '.'))) ELSE '' END AS suffix,
  CASE WHEN contains(list_last(string_split(path, '/')), '.') THEN lower('.' || list_last(string_split(list_last(string_split(path, '/')), '.'))) ELSE '' END IN ({lits(V.SKIP_SUFFIXES)}) AS skip_ext
  FROM v_files f)"""

HITS = f"""{rules_values()}, o_hits AS (
  SELECT c.package_id, c.path, c.is_install, c.skip_ext, r.id, r.pattern, r.tags, r.severity
  FROM o_cls c JOIN o_rules r ON regexp_matches(c.content, r.rx) WHERE NOT c.skip_dir AND (NOT c.skip_ext OR c.is_install))"""

RULE_SIGNALS = """o_rule_signals AS (
  SELECT package_id, path, 'dangerous_pattern' AS category, CASE WHEN NOT is_install THEN 'LOW' WHEN severity = 'critical' THEN 'CRITICAL' ELSE 'HIGH' END AS severity,
    pattern AS key, 'dangerous_pattern(' || CASE WHEN NOT is_install THEN 'LOW' WHEN severity = 'critical' THEN 'CRITICAL' ELSE 'HIGH' END || '): ''' || pattern || ''' in '
      || CASE WHEN is_install THEN 'install_script' ELSE 'source' END || ':' || path AS text, false AS evasion FROM o_hits
  UNION ALL SELECT package_id, path, 'dangerous_pattern', 'HIGH', '.pth file', 'dangerous_pattern(HIGH): ''.pth file'' in install_script:' || path, false
  FROM o_cls WHERE path LIKE '%.pth')"""

TAGS = """o_tags AS (SELECT package_id, path, count(*) AS n_hits, list_sort(list(id)) AS rule_ids,
  list_sort(list_distinct(flatten(list(tags)))) AS tags FROM o_hits WHERE is_install AND NOT skip_ext GROUP BY ALL)"""


def compound() -> str:
    rows = ", ".join(f"({lit(i)}, {lst(req)}, {n}, {lit(sev)}, {lit(d)})" for i, req, n, sev, d in V.COMPOUND_RULES)
    return f"""o_comp(id, req, n, sev, descr) AS (VALUES {rows}),
    o_fired AS (SELECT t.package_id, t.path, c.* FROM o_tags t JOIN o_comp c ON list_has_all(t.tags, c.req) AND t.n_hits >= c.n AND t.n_hits >= 2),
    o_compound AS (SELECT a.package_id, a.path, 'compound' AS category, a.sev AS severity,
      'compound(' || a.sev || '): ''' || a.id || ''' in ' || a.path || ' — ' || a.descr AS text FROM o_fired a
      WHERE NOT EXISTS (SELECT 1 FROM o_fired b WHERE b.package_id = a.package_id AND b.path = a.path AND len(b.req) > len(a.req) AND list_has_all(b.req, a.req)))"""


def behaviours() -> str:
    rows = ", ".join(f"({lit(b)}, {lit('(?i)' + p)})" for b, tests in V.BEHAVIOURS.items() for _, p in tests)
    chains = ", ".join(f"({lit(i)}, {lst(req)}, {lit(sev)}, {lit(d)})" for i, req, sev, d in V.ATTACK_CHAINS)
    return f"""o_beh_rx(b, rx) AS (VALUES {rows}),
    o_beh AS (SELECT c.package_id, c.path, list_sort(list(DISTINCT b.b)) AS behaviours FROM o_cls c JOIN o_beh_rx b ON regexp_matches(c.content, b.rx)
      WHERE c.is_install AND NOT c.skip_dir AND NOT c.skip_ext GROUP BY ALL),
    o_chain_defs(id, req, sev, descr) AS (VALUES {chains}),
    o_chains AS (SELECT o.package_id, o.path, 'behavior_chain' AS category, c.sev AS severity,
      'behavior_chain(' || c.sev || '): ''' || c.id || ''' in ' || o.path || ' -- ' || c.descr || ' [behaviors: ' || array_to_string(list_sort(c.req), ', ') || ']' AS text
      FROM o_beh o JOIN o_chain_defs c ON list_has_all(o.behaviours, c.req) WHERE len(o.behaviours) >= 2)"""


def content_type(column: str) -> str:
    shebang = " ".join(f"WHEN {m(column, '^#!.*' + p)} THEN {lit(k)}" for k, p in V.SHEBANGS)
    return f"""CASE WHEN coalesce(length({column}), 0) = 0 THEN NULL
      WHEN (length({column}) - length(regexp_replace({column}, '[\\x00-\\x08\\x0e-\\x1f]', '', 'g'))) * 10 > length({column}) THEN NULL
      {shebang}
      WHEN {m(column, '^[ \t\n\r]*[\\[{]')} AND json_valid({column}) THEN 'json'
      WHEN {m(column, V.PYTHON_PROBE, 'm')} THEN 'python' WHEN {m(column, V.JS_PROBE, 'm')} THEN 'javascript' END"""


def typed(column: str = "content", cte: str = "o_typed") -> str:
    kinds = " ".join(f"WHEN {lit(s)} THEN {lit(t)}" for s, t in V.SUFFIX_TYPES.items())
    return f"""{cte}0 AS (SELECT package_id, path, list_last(string_split(path, '/')) AS fname, lower(regexp_extract(list_last(string_split(path, '/')), '^.+(\\.[^.]+)$', 1)) AS psuffix,
      {content_type(column)} AS content_type FROM v_files),
    {cte} AS (SELECT *, CASE psuffix {kinds} END AS expected, CASE WHEN content_type NOT IN ({lits(V.CODE_TYPES)}) OR content_type IS NULL THEN NULL
      WHEN psuffix = '' THEN 'extensionless file ''' || fname || ''' contains ' || content_type || ' code'
      WHEN (CASE psuffix {kinds} END) IS NULL THEN 'extension ''' || psuffix || ''' but content is ' || content_type
      WHEN (CASE psuffix {kinds} END) <> content_type THEN 'extension ''' || psuffix || ''' (expected ' || (CASE psuffix {kinds} END) || ') but content is ' || content_type END AS mismatch FROM {cte}0)"""


def crates() -> str:
    def text(key: str, note: str) -> str:
        return f"{lit(f'dangerous_pattern(HIGH): ' + chr(39) + key + chr(39) + ' in install_script:')} || path || {lit(f' ({note})')}"

    parts = [
        f"SELECT package_id, path, 'build.rs' AS key, {text('build.rs', 'executes arbitrary code at cargo build time')} AS text FROM o_cls WHERE ecosystem = 'crates' AND name = 'build.rs'"
    ]
    for label, p in V.BUILD_SCRIPT_PATTERNS:
        parts.append(
            f"SELECT package_id, path, {lit('build.rs:' + label)}, {text('build.rs:' + label, 'network or subprocess from build script')} FROM o_cls "
            f"WHERE ecosystem = 'crates' AND name = 'build.rs' AND {m('content', p)}"
        )
    parts.append(
        f"SELECT package_id, path, 'proc-macro=true', {text('proc-macro=true', 'proc-macro crate — executes arbitrary code at compile time')} FROM o_cls "
        f"WHERE ecosystem = 'crates' AND name = 'Cargo.toml' AND {m('content', V.PROC_MACRO, 'i')}"
    )
    return f"o_crates AS ({' UNION ALL '.join(parts)})"


PODS = """o_pods AS (SELECT package_id, path, 'suspicious_pattern' AS category, 'HIGH' AS severity,
  'suspicious_pattern(HIGH): ''.gitattributes export-ignore'' in install_script:' || path || ' (can hide files from git archive, may differ from git checkout)' AS text
  FROM o_cls WHERE ecosystem = 'cocoapods' AND path LIKE '%.gitattributes' AND contains(content, 'export-ignore'))"""


def evasion() -> str:
    hooks = " UNION ALL ".join(
        f"SELECT package_id, path, 'build_hooks', 'MEDIUM', 'npm lifecycle hook in ' || path || ': {k}=' || substring(json_extract_string(content, '$.scripts.{k}'), 1, 60) "
        f"FROM v_files WHERE path LIKE '%package.json' AND json_valid(content) AND json_extract_string(CASE WHEN json_valid(content) THEN content ELSE '{{}}' END, '$.scripts.{k}') IS NOT NULL"
        for k in V.LIFECYCLE_KEYS
    ).replace("substring(json_extract_string(content,", "substring(json_extract_string(CASE WHEN json_valid(content) THEN content ELSE '{}' END,")
    bundle = " OR ".join(f"contains(path, {lit(b)})" for b in V.BUNDLE_PATH_PARTS)
    return f"""o_ev0(package_id, path, category, severity, description) AS (
      SELECT package_id, path, 'env_mutation', 'HIGH', 'sensitive env mutation in ' || path || ': ' || substring(unnest(regexp_extract_all(content, {rx(V.ENV_MUTATION, 'i')})), 1, 80) FROM v_files
      UNION ALL SELECT * FROM (SELECT package_id, path, 'time_bomb', 'HIGH', 'time.time() gate in ' || path || ': future epoch ' || e FROM (SELECT package_id, path, unnest(regexp_extract_all(content, {rx(V.FUTURE_EPOCH)}, 1)) AS e FROM v_files) t WHERE try_cast(e AS HUGEINT) > {AS_OF})
      UNION ALL SELECT * FROM (SELECT package_id, path, 'time_bomb', 'HIGH', 'datetime gate in ' || path || ': future year ' || e FROM (SELECT package_id, path, unnest(regexp_extract_all(content, {rx(V.FUTURE_YEAR)}, 1)) AS e FROM v_files) t WHERE e::int > {V.LAST_PLAIN_YEAR})
      UNION ALL {hooks}
      UNION ALL SELECT package_id, path, 'build_hooks', 'MEDIUM', 'setup.py invokes subprocess: ' || path FROM v_files WHERE path LIKE '%setup.py' AND {m('content', V.SETUP_EXEC)}
      UNION ALL SELECT package_id, path, 'build_hooks', 'MEDIUM', 'Rust build script present: ' || path FROM v_files WHERE path LIKE '%build.rs'
      UNION ALL SELECT package_id, path, 'derived_exfil', 'HIGH', 'derived exfil pattern in ' || path || ' (encode+send)' FROM v_files WHERE NOT ({bundle}) AND ({m('content', V.ENCODE_THEN_SEND, 's')} OR {m('content', V.READ_THEN_ENCODE, 's')})
      UNION ALL SELECT package_id, path, 'direct_xpc', 'MEDIUM', 'macOS XPC bypass tokens in ' || path FROM v_files WHERE {m('content', V.XPC_TOKENS)}
      UNION ALL SELECT package_id, path, 'direct_xpc', 'MEDIUM', 'Linux D-Bus bypass tokens in ' || path FROM v_files WHERE {m('content', V.DBUS_TOKENS)}
      UNION ALL SELECT package_id, path, 'anti_debug', 'HIGH', 'anti-debug/anti-trace pattern in ' || path FROM v_files WHERE {m('content', V.ANTI_DEBUG)}),
    o_ev AS (SELECT package_id, path, category, severity, category || '(' || severity || '): ' || description AS text FROM o_ev0)"""


ENTROPY_CTE = """{out}_lines AS (SELECT {keys}, unnest(generate_series(1, len(parts))) AS line, trim(unnest(parts)) AS txt FROM (SELECT {keys}, string_split({text}, chr(10)) AS parts FROM {src}) s),
  {out}_chars AS (SELECT {keys}, line, length(txt) AS n, unnest(list_distinct(string_split(txt, ''))) AS ch, txt FROM {out}_lines WHERE length(txt) >= 80),
  {out} AS (SELECT {keys}, line, -sum((n - length(replace(txt, ch, ''))) / n * log2((n - length(replace(txt, ch, ''))) / n)) AS entropy FROM {out}_chars WHERE ch <> '' GROUP BY {keys}, line)"""


def entropy_cte(out: str, src: str, keys: str, text: str) -> str:
    return ENTROPY_CTE.format(out=out, src=src, keys=keys, text=text)


def signals() -> str:
    """All file signals of all packages."""
    return ", ".join(
        [
            CLS, HITS, RULE_SIGNALS, TAGS, compound(), behaviours(), typed(), crates(), PODS, evasion(),
            entropy_cte("o_ent", "v_files", "package_id, path", "content"),
            f"""o_signals(package_id, category, severity, key, evasion) AS (
              SELECT package_id, category, severity, key, false FROM o_rule_signals
              UNION ALL SELECT package_id, category, severity, text, true FROM o_ev
              UNION ALL SELECT package_id, 'dangerous_pattern', 'HIGH', key, false FROM o_crates
              UNION ALL SELECT package_id, category, severity, text, false FROM o_pods
              UNION ALL SELECT package_id, 'extension_mismatch', 'HIGH', mismatch, false FROM o_typed WHERE mismatch IS NOT NULL
              UNION ALL SELECT package_id, category, severity, text, false FROM o_compound
              UNION ALL SELECT package_id, category, severity, text, false FROM o_chains
              UNION ALL SELECT package_id, 'high_entropy', 'LOW', path || line, false FROM o_ent WHERE entropy > {ENTROPY})""",
        ]
    )


def counted(src: str = "o_signals") -> str:
    """Collapse evasion clusters, then count per package."""
    return f"""o_sizes AS (SELECT package_id, category, count(*) AS n, count(*) FILTER (WHERE severity IN ('HIGH', 'CRITICAL')) AS hi FROM {src} WHERE evasion GROUP BY ALL),
    o_kept AS (SELECT s.* FROM {src} s LEFT JOIN o_sizes z ON z.package_id = s.package_id AND z.category = s.category AND s.evasion
        WHERE z.n IS NULL OR z.hi > 0 OR z.n < {V.COLLAPSE_THRESHOLD}
      UNION ALL SELECT s.package_id, s.category, {name('max(' + rank('s.severity') + ')')}, 'collapsed ' || s.category, true FROM {src} s JOIN o_sizes z ON z.package_id = s.package_id AND z.category = s.category AND s.evasion
        WHERE z.hi = 0 AND z.n >= {V.COLLAPSE_THRESHOLD} GROUP BY s.package_id, s.category),
    o_counts AS (SELECT package_id, count(*) AS n_signals, count(*) FILTER (WHERE NOT evasion AND severity IN ('HIGH', 'CRITICAL')) AS n_high,
        count(DISTINCT key) FILTER (WHERE severity = 'MEDIUM' OR (evasion AND severity IN ('HIGH', 'CRITICAL'))) AS n_medium,
        count(DISTINCT category) FILTER (WHERE evasion AND severity IN ('MEDIUM', 'HIGH', 'CRITICAL')) AS ev_medium,
        count(*) FILTER (WHERE category = 'typosquat_candidate') AS n_typo FROM o_kept GROUP BY package_id),
    o_levels AS (SELECT *, CASE WHEN n_high >= 2 THEN 'CRITICAL' WHEN n_high = 1 THEN 'HIGH' WHEN n_medium >= 3 OR n_medium + n_typo >= 4 THEN 'HIGH' WHEN n_medium + n_typo >= 1 THEN 'MEDIUM' ELSE 'LOW' END AS level FROM o_counts)"""


DECIDE = """SELECT package_id, level, reason, {oname} AS outcome, o AS exit_code, o = 2 AS should_block_install FROM (
  SELECT *, CASE WHEN level IN ('HIGH', 'CRITICAL') THEN 2 WHEN level = 'MEDIUM' OR ev_medium >= 2 THEN 1 ELSE 0 END AS o FROM {src}) t"""


def decide(src: str) -> str:
    return DECIDE.format(oname=oname("o"), src=src)


LISTED = """o_listed AS (SELECT p.package_id, p.name,
    CASE WHEN exists(SELECT 1 FROM v_lists l WHERE l.name = p.name AND l.list = 'block') THEN 'CRITICAL'
      WHEN exists(SELECT 1 FROM v_lists l WHERE l.name = p.name AND l.list = 'allow') THEN 'NONE' END AS level FROM v_packages p)"""
META = """o_meta(package_id, category, severity, text) AS (
  SELECT package_id, 'no_author', 'LOW', 'no_author: package has no author information' FROM v_packages WHERE author = ''
  UNION ALL SELECT package_id, 'no_repo', 'LOW', 'no_repo: no repository or homepage URL' FROM v_packages WHERE repository = '' AND homepage = ''
  UNION ALL SELECT package_id, 'low_downloads', 'LOW', 'low_downloads: only ' || download_count || ' downloads' FROM v_packages WHERE download_count > 0 AND download_count < 100
  UNION ALL SELECT package_id, 'has_install_scripts', 'LOW', 'has_install_scripts: package has install-time scripts' FROM v_packages WHERE has_install_scripts)"""


def prefiltered() -> str:
    return ", ".join(
        [
            signals(), LISTED, META, typos(),
            """o_all AS (SELECT s.* FROM (SELECT * FROM o_signals UNION ALL SELECT package_id, category, severity, text, false FROM o_meta
                UNION ALL SELECT package_id, 'typosquat_candidate', 'MEDIUM', text, false FROM o_typos) s
              WHERE s.package_id IN (SELECT package_id FROM o_listed WHERE level IS NULL))""",
            counted("o_all"),
            """o_pre AS (SELECT l.package_id, coalesce(l.level, v.level, 'NONE') AS level,
              CASE WHEN l.level = 'CRITICAL' THEN 'Package ''' || l.name || ''' is in the blocklist' WHEN l.level = 'NONE' THEN 'Package ''' || l.name || ''' is whitelisted'
                WHEN v.n_signals IS NULL THEN 'No risk signals detected' ELSE 'Found ' || v.n_signals || ' risk signal(s)' END AS reason,
              coalesce(v.ev_medium, 0) AS ev_medium, l.level IS NOT NULL AS listed FROM o_listed l LEFT JOIN o_levels v USING (package_id)),
            o_pref AS (SELECT *, level NOT IN ('MEDIUM', 'HIGH', 'CRITICAL') AS passed, level IN ('MEDIUM', 'HIGH', 'CRITICAL') AND NOT listed AS needs_review FROM o_pre)""",
        ]
    )


OBSERVED = """o_obs AS (SELECT package_id, CASE k % 3 WHEN 0 THEN 'anti_debug' WHEN 1 THEN 'env_mutation' ELSE 'direct_xpc' END AS category FROM v_packages),
  o_cat AS (SELECT package_id, category, max(r) AS r, bool_or(seen) AS confirmed FROM (
    SELECT package_id, category, CASE severity WHEN 'HIGH' THEN 3 ELSE 2 END AS r, false AS seen FROM o_ev UNION ALL SELECT package_id, category, 2, true FROM o_obs) t GROUP BY ALL)"""

USER_RULES = f"""{rules_values()}, o_user AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY ord DESC) AS rn FROM v_user_rules WHERE pattern IS NOT NULL),
  o_merged AS (SELECT id, pattern, severity, scope, coalesce(ecosystem, '*') AS ecosystem, description, {{tags}} AS tags, case_sensitive FROM o_user WHERE rn = 1
    UNION ALL SELECT id, pattern, severity, scope, ecosystem, description, tags, case_sensitive FROM o_rules WHERE id NOT IN (SELECT id FROM o_user))"""


def suspicious(src: str, keys: str, text: str) -> str:
    parts = [
        f"SELECT {keys}, {lit(d)} AS description, len(regexp_extract_all({text}, {rx(p, 'i')})) AS n FROM {src}"
        for d, _, p in V.SUSPICIOUS_TEXT
    ]
    return f"o_susp AS (SELECT * FROM ({' UNION ALL '.join(parts)}) t WHERE n > 0)"


def sql() -> dict[str, str]:
    q: dict[str, str] = {}
    cols = "package_id, path, category, severity, text"
    q["package_risk"] = with_views(
        decide("(SELECT p.package_id, coalesce(l.level, 'NONE') AS level, coalesce(l.ev_medium, 0) AS ev_medium, CASE WHEN l.n_signals IS NULL THEN 'No risk signals detected' ELSE 'Found ' || l.n_signals || ' risk signal(s)' END AS reason FROM v_packages p LEFT JOIN o_levels l USING (package_id))"), signals() + ", " + counted()
    )
    q["classify_files"] = with_views(
        "SELECT package_id, path, name, suffix, depth::INT AS depth, is_install, skip_dir, skip_ext FROM o_cls", CLS
    )
    q["admit_files"] = with_views(
        "SELECT package_id, path, size, ord, CASE WHEN size > 30000 THEN 'oversized' WHEN r > 60000 THEN 'over budget' END AS refused "
        "FROM (SELECT *, sum(CASE WHEN size <= 30000 THEN size ELSE 0 END) OVER (PARTITION BY package_id ORDER BY ord) AS r FROM v_files) t"
    )
    q["size_budget"] = with_views(
        "SELECT package_id, ord, size, sum(size) OVER (PARTITION BY package_id ORDER BY ord)::BIGINT AS running_bytes FROM v_files"
    )
    q["rules_dim"] = with_views(
        "SELECT * REPLACE (array_to_string(tags, ',') AS tags) FROM o_merged WHERE id <> 'site-3'", USER_RULES.replace("{tags}", "['site', severity]")
    )
    q["rules_override"] = with_views(
        "SELECT id, pattern, severity FROM o_merged WHERE ecosystem IN ('*', 'npm')", USER_RULES.replace("{tags}", "['site']")
    )
    q["rule_listing"] = with_views(
        "SELECT id, severity, scope, array_to_string(tags, ', ') AS tags, description FROM o_merged WHERE list_contains(tags, 'execution') ORDER BY id",
        USER_RULES.replace("{tags}", "['site', 'execution']"),
    )
    q["rule_stats"] = with_views(
        "SELECT 'severity' AS facet, severity AS value, count(*) AS n FROM o_merged GROUP BY severity UNION ALL SELECT 'scope', scope, count(*) FROM o_merged GROUP BY scope "
        "UNION ALL SELECT * FROM (SELECT 'tag', t, count(*) AS n FROM (SELECT unnest(tags) AS t FROM o_merged) u GROUP BY t ORDER BY n DESC, t LIMIT 15)",
        USER_RULES.replace("{tags}", "['site', severity]"),
    )
    q["rule_scan"] = with_views(f"SELECT {cols} FROM o_rule_signals", ", ".join([CLS, HITS, RULE_SIGNALS]))
    merged = HITS.replace("JOIN o_rules r", "JOIN (SELECT *, CASE WHEN case_sensitive THEN '' ELSE '(?i)' END || pattern AS rx FROM o_merged) r")
    user = USER_RULES.replace("{tags}", "['site']")
    q["rule_scan_user"] = with_views(f"SELECT {cols} FROM o_rule_signals", ", ".join([CLS, user, merged.removeprefix(rules_values() + ", "), RULE_SIGNALS]))
    q["file_tags"] = with_views(
        "SELECT package_id, path, n_hits::INT AS n_hits, array_to_string(rule_ids, ',') AS rule_ids, array_to_string(tags, ',') AS tags FROM o_tags",
        ", ".join([CLS, HITS, TAGS]),
    )
    q["compound_signals"] = with_views(f"SELECT {cols} FROM o_compound", ", ".join([CLS, HITS, TAGS, compound()]))
    q["behaviour_sets"] = with_views(
        "SELECT package_id, path, array_to_string(behaviours, ',') AS behaviours FROM o_beh", ", ".join([CLS, behaviours()])
    )
    q["attack_chains"] = with_views(f"SELECT {cols} FROM o_chains", ", ".join([CLS, behaviours()]))
    q["entropy_lines"] = with_views(
        f"SELECT doc_id, line::INT AS line, round(entropy, 6) AS entropy FROM o_ent WHERE entropy > {ENTROPY}",
        entropy_cte("o_ent", "documents", "doc_id", "text"),
    )
    q["crate_risks"] = with_views(
        "SELECT package_id, path, 'dangerous_pattern' AS category, 'HIGH' AS severity, text FROM o_crates", ", ".join([CLS, crates()])
    )
    q["pod_risks"] = with_views(f"SELECT {cols} FROM o_pods", ", ".join([CLS, PODS]))
    q["content_type"] = with_views(f"SELECT package_id, path, {content_type('content')} AS content_type FROM v_files")
    q["extension_mismatch"] = with_views("SELECT package_id, path, content_type, mismatch FROM o_typed WHERE mismatch IS NOT NULL", typed())
    q["disguised_files"] = with_views(
        "SELECT package_id, path, 'disguised file: ' || path || ' — ' || mismatch AS finding FROM o_typed WHERE mismatch IS NOT NULL "
        f"AND NOT list_has_any(string_split(path, '/'), {lst(V.TREE_PRUNED_DIRS)})",
        typed(),
    )
    q["version_diff"] = with_views(
        "SELECT n.package_id, n.p AS path, CASE WHEN o.p IS NULL THEN 'added' ELSE 'changed' END AS status FROM "
        "(SELECT package_id, substring(path, position('/' IN path) + 1) AS p, content FROM v_versions WHERE side = 'new') n LEFT JOIN "
        "(SELECT package_id, substring(path, position('/' IN path) + 1) AS p, content FROM v_versions WHERE side = 'old') o "
        "ON o.package_id = n.package_id AND o.p = n.p WHERE o.p IS NULL OR o.content <> n.content"
    )
    q["tree_hash"] = with_views(
        "SELECT package_id, sha256(string_agg(path || chr(0) || content || chr(10), '' ORDER BY path)) AS tree_sha256 FROM v_files GROUP BY package_id"
    )
    prio = " OR ".join(f"contains(path, {lit(p)})" for p in V.CONTEXT_PRIORITY)
    q["review_context"] = with_views(
        "SELECT package_id, CASE WHEN length(t) > 64000 THEN substring(t, 1, 64000) || chr(10) || chr(10) || '... [truncated at 64000 chars for l3_expert analysis]' ELSE t END AS context FROM ("
        f"SELECT package_id, string_agg('### ' || path || chr(10) || '```' || chr(10) || content || chr(10) || '```' || chr(10), chr(10) ORDER BY CASE WHEN {prio} THEN 0 ELSE 1 END, ord) AS t "
        "FROM v_files GROUP BY package_id) x"
    )
    q["truncate_context"] = (
        "SELECT doc_id, CASE WHEN length(text) > 4000 THEN substring(text, 1, 4000) || chr(10) || chr(10) || '... [truncated at 4000 chars for l1_quick analysis]' ELSE text END AS content FROM documents"
    )
    q["podspec_divergence"] = with_views(
        "SELECT package_id, 'podspec-vs-tarball path divergence: podspec advertises source_files paths [' || string_agg('''' || top || '''', ', ' ORDER BY pos) || '] that are missing from the GitHub tarball' AS divergence "
        "FROM (SELECT package_id, unnest(['src', 'Classes', 'lib']) AS top, unnest([1, 2, 4]) AS pos FROM v_packages WHERE ecosystem = 'cocoapods') a "
        "WHERE NOT EXISTS (SELECT 1 FROM v_files f WHERE f.package_id = a.package_id AND string_split(f.path, '/')[2] = a.top) "
        "AND NOT EXISTS (SELECT 1 FROM v_files f WHERE f.package_id = a.package_id AND f.path LIKE '%.gitattributes' AND contains(f.content, 'export-ignore')) GROUP BY package_id"
    )
    q["evasion_static"] = with_views(f"SELECT {cols} FROM o_ev", evasion())
    q["collapse_signals"] = with_views(
        "SELECT e.package_id, e.category, e.severity, e.text FROM o_ev e JOIN o_n USING (package_id, category) WHERE hi > 0 OR n < 3 UNION ALL "
        "SELECT package_id, category, 'MEDIUM', category || '(MEDIUM): multi_evasion_pattern: ' || n || ' signals aggregated' FROM o_n WHERE hi = 0 AND n >= 3",
        evasion() + ", o_n AS (SELECT package_id, category, count(*) AS n, count(*) FILTER (WHERE severity = 'HIGH') AS hi FROM o_ev GROUP BY ALL)",
    )
    q["category_severity"] = with_views(
        f"SELECT package_id, category, {name('r')} AS severity, confirmed FROM o_cat", evasion() + ", " + OBSERVED
    )
    q["evasion_gate"] = with_views(
        f"""SELECT package_id, {oname('v')} AS outcome_before, {oname('''CASE WHEN darwin AND xpc THEN greatest(v, 1) WHEN nh >= 2 AND nc >= 1 THEN 2 WHEN nm >= 2 THEN greatest(v, 1) ELSE v END''')} AS outcome FROM (
          SELECT p.package_id, CASE WHEN p.k % 5 = 0 THEN 2 WHEN p.k % 2 = 0 THEN 1 ELSE 0 END AS v, p.k % 3 = 0 AS darwin,
            coalesce(bool_and(c.category = 'direct_xpc'), false) AS xpc, count(*) FILTER (WHERE r >= 3) AS nh, count(*) FILTER (WHERE r >= 3 AND confirmed) AS nc, count(*) FILTER (WHERE r >= 2) AS nm
          FROM v_packages p LEFT JOIN o_cat c USING (package_id) GROUP BY p.package_id, p.k) t""",
        evasion() + ", " + OBSERVED,
    )
    q["risk_level"] = with_views(
        "SELECT p.package_id, coalesce(n_signals, 0) AS n_signals, coalesce(n_high, 0) AS n_high, coalesce(n_medium, 0) AS n_medium, coalesce(level, 'NONE') AS level FROM v_packages p LEFT JOIN o_levels USING (package_id)",
        signals() + ", " + counted(),
    )
    q["allow_block"] = with_views(
        "SELECT package_id, name, level, CASE level WHEN 'CRITICAL' THEN false WHEN 'NONE' THEN true END AS passed, "
        "CASE level WHEN 'CRITICAL' THEN 'Package ''' || name || ''' is in the blocklist' WHEN 'NONE' THEN 'Package ''' || name || ''' is whitelisted' END AS reason FROM o_listed",
        LISTED,
    )
    q["metadata_anomalies"] = with_views("SELECT * FROM o_meta", META)
    pre = prefiltered()
    q["prefilter"] = with_views("SELECT package_id, level, passed, needs_review, reason FROM o_pref", pre)
    q["level_gate"] = with_views("SELECT package_id, level FROM o_pref WHERE level IN ('MEDIUM', 'HIGH', 'CRITICAL')", pre)
    q["decide_prefilter"] = with_views(decide("o_pref"), pre)
    q["uninspected_override"] = with_views(
        """SELECT package_id, CASE WHEN o OR u THEN 'MEDIUM' ELSE level END AS level, CASE WHEN o OR u THEN false ELSE passed END AS passed,
          CASE WHEN o OR u THEN false ELSE needs_review END AS needs_review, CASE WHEN u THEN 'Source bytes unavailable; manual review required' WHEN o THEN 'Archive exceeds size cap; manual review required' ELSE reason END AS reason,
          concat_ws('; ', CASE WHEN o THEN 'archive_oversized(HIGH): too large: ' || name END, CASE WHEN u THEN 'source_unavailable(HIGH): 404: ' || name END) AS added_signals, o OR u AS source_unavailable
        FROM (SELECT p.*, k.name, k.k % 23 = 0 AS o, k.k % 19 = 0 AS u FROM o_pref p JOIN v_packages k USING (package_id)) t""",
        pre,
    )
    words = "array_to_string(list_transform(json_extract(value, '$.args[*]'), lambda a: CASE json_type(a) WHEN 'VARCHAR' THEN a->>'$' WHEN 'BOOLEAN' THEN CASE a::VARCHAR WHEN 'true' THEN 'True' ELSE 'False' END WHEN 'NULL' THEN 'None' ELSE a::VARCHAR END), ' ')"
    hits = " UNION ALL ".join(
        f"SELECT config_id, 'MCP server ' || path || ': ' || {lit(d)} || ' in command: ' || command AS finding FROM o_commands WHERE {m('command', p, 'i')}" for d, _, p in V.SUSPICIOUS_TEXT
    )
    q["command_findings"] = with_views(
        hits,
        f"""o_commands AS (SELECT config_id, CASE WHEN fullkey = '$' THEN 'root' ELSE replace(substr(fullkey, 3), '"', '') END AS path,
          (value->>'$.command') || CASE WHEN json_type(value, '$.args') IS NULL THEN ' ' WHEN json_type(value, '$.args') = 'ARRAY' THEN ' ' || {words} ELSE '' END AS command
          FROM (SELECT config_id, t.value, t.fullkey FROM v_configs, json_tree(CASE WHEN json_valid(content) THEN content ELSE '[]' END) t WHERE t.type = 'OBJECT') x
          WHERE json_type(value, '$.command') = 'VARCHAR' AND value->>'$.command' <> '')""",
    )
    q["suspicious_text"] = with_views("SELECT package_id, path, description, n FROM o_susp", suspicious("v_files", "package_id, path", "content"))
    hidden = "[\\x{200b}\\x{200c}\\x{200d}\\x{200e}\\x{200f}\\x{202a}-\\x{202e}\\x{feff}]"
    q["hidden_text"] = with_views(
        f"""SELECT * FROM (SELECT doc_id AS id, coalesce(s.n, 0)::BIGINT AS n_suspicious, len(regexp_extract_all(text, '{hidden}'))::BIGINT AS n_hidden, len(regexp_extract_all(text, {lit(V.BASE64_RUN)}))::BIGINT AS n_base64
          FROM documents LEFT JOIN (SELECT doc_id, sum(n) AS n FROM o_susp GROUP BY doc_id) s USING (doc_id)) t WHERE n_suspicious > 0 OR n_hidden > 0 OR n_base64 > 0""",
        suspicious("documents", "doc_id", "text"),
    )
    q["encoded_runs"] = (
        f"SELECT id, 'possible base64-encoded payload: ' || substring(unnest(regexp_extract_all(t, {lit(V.BASE64_RUN)})), 1, 50) || '...' AS finding "
        "FROM (SELECT doc_id AS id, text AS t FROM documents UNION ALL SELECT page_id, html FROM pages) x"
    )
    q["file_findings"] = with_views(
        "SELECT package_id, path, CASE WHEN mismatch IS NOT NULL THEN 'HIGH' ELSE 'MEDIUM' END AS severity, mismatch, suspicious FROM o_find WHERE mismatch IS NOT NULL OR suspicious",
        typed() + ", " + suspicious("v_files", "package_id, path", "content") + FIND,
    )
    q["scan_exit_code"] = with_views(
        "SELECT count(*) AS n_findings, CASE WHEN count(*) FILTER (WHERE mismatch IS NOT NULL) > 0 THEN 2 WHEN count(*) > 0 THEN 1 ELSE 0 END AS exit_code FROM o_find WHERE mismatch IS NOT NULL OR suspicious",
        typed() + ", " + suspicious("v_files", "package_id, path", "content") + FIND,
    )
    listed = f"psuffix IN ({lits(V.ARCHIVE_TEXT_SUFFIXES)}) OR fname IN ({lits(V.ARCHIVE_TEXT_BASENAMES)})"
    q["archive_files"] = with_views(
        f"SELECT f.package_id || '.tgz' AS archive, f.path, strlen(f.content) AS size, sha256(f.content) AS digest FROM v_files f JOIN o_typed t ON t.path = f.path "
        f"WHERE strlen(f.content) <= {V.MAX_FILE_BYTES} AND ({listed} OR content_type IN ({lits(V.CODE_TYPES)}))",
        typed(),
    )
    q["archive_manifest"] = with_views(
        f"SELECT package_id || '.tgz' AS archive, path, strlen(content) AS size, length(content)::INT AS head_chars FROM v_files WHERE strlen(content) <= {V.MANIFEST_HEAD_BYTES}"
        f" UNION ALL SELECT package_id || '.tgz', path, strlen(content), length(decode(encode(content)[1:{V.MANIFEST_HEAD_BYTES}]))::INT FROM v_files WHERE strlen(content) > {V.MANIFEST_HEAD_BYTES}"
    )
    # Top-down order: names of files sort before directories on every level.
    q["tree_files"] = with_views(
        f"""SELECT package_id, path, size, CASE WHEN r > 60000 THEN 'over budget' END AS refused FROM (SELECT *, sum(size) OVER (PARTITION BY package_id ORDER BY ord_key) AS r FROM (
          SELECT f.package_id, f.path, strlen(f.content) AS size, list_transform(string_split(f.path, '/'), lambda p, i: CASE WHEN i = len(string_split(f.path, '/')) THEN '0' ELSE '1' END || p) AS ord_key
          FROM v_files f JOIN o_typed t ON t.path = f.path WHERE NOT (regexp_extract(t.fname, '^.+(\\.[^.]+)$', 1) IN ('', {lits(V.TREE_SNIFF_SUFFIXES)})) OR content_type IN ({lits(V.CODE_TYPES)})) a) b""",
        typed(),
    )
    return q


FIND = ", o_find AS (SELECT t.package_id, t.path, t.mismatch, t.path IN (SELECT path FROM o_susp) AS suspicious FROM o_typed t)"
