"""Oracles of the name, manifest and registry queries."""

from __future__ import annotations

from oracle import lit
from sparkwarden import values as V
from sparkwarden.plans.views import AS_OF, with_views


def popular() -> str:
    pairs = [(e, n) for e, names in V.POPULAR_NAMES.items() for n in names]
    pairs += [(a, n) for a, e in V.ECOSYSTEM_ALIASES.items() for n in V.POPULAR_NAMES[e]]
    rows = ", ".join(f"({lit(e)}, {lit(n)})" for e, n in pairs)
    return f"""o_builtin(ecosystem, name) AS (VALUES {rows}),
    o_popular AS (SELECT * FROM o_builtin UNION SELECT ecosystem, name FROM v_popular
      WHERE updated_at >= {AS_OF} - 7 * 86400 AND ecosystem IN (SELECT ecosystem FROM o_builtin))"""


def candidates() -> str:
    """Pairs of a package's name and a popular one whose lengths and shared characters allow the similarity."""
    t = V.TYPO_SIMILARITY
    return f"""{popular()}, o_cand AS (SELECT ecosystem, compared, known FROM (
          SELECT p.ecosystem, p.name AS compared, k.name AS known, list_reduce([0] || list_transform(list_distinct(string_split(lower(p.name), '')),
            lambda c: least(length(p.name) - length(replace(lower(p.name), c, '')), length(k.name) - length(replace(lower(k.name), c, '')))::INT), lambda a, b: a + b) AS overlap
          FROM (SELECT DISTINCT ecosystem, name FROM v_packages) p JOIN o_popular k USING (ecosystem)
          WHERE p.name <> k.name AND 2.0 * least(length(p.name), length(k.name)) / (length(p.name) + length(k.name)) >= {t}) z
        WHERE 2.0 * overlap / (length(compared) + length(known)) >= {t})"""


def typos() -> str:
    """Packages with look-alike names.

    Matching characters of two names: those of the longest common run (the earliest one in the first name, then in the
    second), and those of what is left and right of it, level by level.  ``best`` holds a run's length and place in one number.
    """
    best = """list_max(list_transform(range(1, length(a) + 1), lambda i: coalesce(list_max(list_filter(range(1, length(a) - i + 2),
            lambda n: contains(b, substr(a, i, n)))), 0) * 1000 - i))"""
    return f"""{candidates()}, o_matched AS (WITH RECURSIVE o_cut AS (
          SELECT ecosystem, compared, known, lower(compared) AS a, lower(known) AS b, 0 AS matched FROM o_cand
          UNION ALL SELECT ecosystem, compared, known, CASE s WHEN 1 THEN substr(a, 1, i - 1) ELSE substr(a, i + run) END,
            CASE s WHEN 1 THEN substr(b, 1, j - 1) ELSE substr(b, j + run) END, CASE s WHEN 1 THEN run ELSE 0 END
          FROM (SELECT *, strpos(b, substr(a, i, run)) AS j FROM (SELECT *, (best + 999) // 1000 AS run, (best + 999) // 1000 * 1000 - best AS i FROM (
            SELECT *, {best} AS best FROM o_cut WHERE a <> '' AND b <> '') x) y WHERE run > 0) z, (VALUES (1), (2)) v(s))
        SELECT ecosystem, compared, known, 2.0 * sum(matched) / (length(compared) + length(known)) AS similarity FROM o_cut GROUP BY ecosystem, compared, known),
      o_typos AS (SELECT package_id, name, n_matches, 'typosquat_candidate: similar to [''' || names || ''']' AS text FROM v_packages JOIN (
        SELECT ecosystem, compared AS name, count(*) AS n_matches, array_to_string(list_sort(list(known || ' (' || round_even(similarity * 100, 0)::INT || '%)')), ''', ''') AS names
        FROM o_matched WHERE similarity >= {V.TYPO_SIMILARITY} GROUP BY ALL) l USING (ecosystem, name))"""


def numbered(file_name: str) -> str:
    """Lines of one kind of manifest with their numbers."""
    return f"""o_lines AS (SELECT lock_id, unnest(generate_series(1, len(p))) AS n, unnest(p) AS l FROM (
      SELECT lock_id, string_split(content, chr(10)) AS p FROM v_locks WHERE file_name = '{file_name}') s)"""


def positioned(body: str) -> str:
    """Number the entries of every manifest in line order."""
    return f"SELECT lock_id, (row_number() OVER (PARTITION BY lock_id ORDER BY n, sub) - 1)::INT AS pos, name, version FROM ({body}) z"


REQ = positioned(
    """SELECT lock_id, n, 0 AS sub, CASE WHEN t LIKE '%==%' THEN trim(split_part(t, '==', 1)) WHEN t LIKE '%>=%' THEN trim(split_part(t, '>=', 1)) ELSE t END AS name,
      CASE WHEN t LIKE '%==%' THEN trim(split_part(t, '==', 2)) ELSE '' END AS version FROM (SELECT *, trim(l) AS t FROM o_lines) y WHERE t <> '' AND NOT t LIKE '#%' AND NOT t LIKE '-%'"""
)


def toml(file_name: str) -> str:
    # A table header opens a section; only keys of [[package]] sections count.
    return f"""SELECT lock_id, min(n) AS n, 0 AS sub, max(CASE WHEN k = 'name' THEN v END) AS name, coalesce(max(CASE WHEN k = 'version' THEN v END), '') AS version,
        coalesce(max(CASE WHEN k = 'source' THEN v END), '') AS source
      FROM (SELECT *, trim(split_part(l, ' = ', 1)) AS k, trim(split_part(l, ' = ', 2), '"') AS v,
          last_value(CASE WHEN l LIKE '[%' THEN l END IGNORE NULLS) OVER (PARTITION BY lock_id ORDER BY n) AS head,
          sum(CASE WHEN l = '[[package]]' THEN 1 ELSE 0 END) OVER (PARTITION BY lock_id ORDER BY n) AS block FROM ({SPLIT.format(f=file_name)}) l0) t
      WHERE head = '[[package]]' AND block > 0 AND k IN ('name', 'version', 'source') GROUP BY lock_id, block"""


SPLIT = (
    "SELECT lock_id, unnest(generate_series(1, len(p))) AS n, unnest(p) AS l FROM (SELECT lock_id, string_split(content, chr(10)) AS p FROM v_locks WHERE file_name = '{f}') s"
)
UV = toml("uv.lock")
CARGO = f"SELECT * FROM ({toml('Cargo.lock')}) c WHERE name <> '' AND version <> '' AND source LIKE 'registry+%'"

NPM = """SELECT lock_id, list_last(string_split(key, 'node_modules/')) AS name, coalesce(json_extract_string(value, '$.version'), '') AS version
  FROM (SELECT lock_id, j.key, j.value FROM v_locks l, json_each(CASE WHEN file_name = 'package-lock.json' THEN content ELSE '{}' END, '$.packages') j WHERE file_name = 'package-lock.json') t WHERE contains(key, 'node_modules/')"""

PNPM = positioned(
    """SELECT lock_id, n, 0 AS sub, regexp_extract(k, '^(.+)@([^@]+)$', 1) AS name, regexp_extract(k, '^(.+)@([^@]+)$', 2) AS version FROM (
      SELECT *, split_part(ltrim(trim(trim(rtrim(l, ':')), ''''), '/'), '(', 1) AS k FROM o_lines WHERE regexp_matches(l, '^  [^ ].*:$')) y WHERE regexp_matches(k, '^.+@[^@]+$')"""
)

YARN_ROWS = (
    """SELECT lock_id, n, unnest(generate_series(1, len(names))) AS sub, unnest(names) AS name, version FROM (
      SELECT lock_id, n, regexp_extract(l, '"([^"]*)"', 1) AS version, list_transform(string_split(rtrim(head, ':'), ','), lambda x:
        CASE WHEN trim(trim(x), '"') LIKE '@%' THEN regexp_replace(trim(trim(x), '"'), '@[^@]*$', '') ELSE split_part(trim(trim(x), '"'), '@', 1) END) AS names
      FROM (SELECT *, last_value(CASE WHEN l <> '' AND l NOT LIKE ' %' THEN l END IGNORE NULLS) OVER (PARTITION BY lock_id ORDER BY n) AS head FROM o_lines) t
      WHERE l LIKE '  version "%') y"""
)

PUB_ROWS = (
    """SELECT lock_id, min(n) AS n, 0 AS sub, rtrim(trim(any_value(head)), ':') AS name, arg_min(trim(trim(split_part(l, 'version:', 2)), '"'), n) AS version FROM (
      SELECT *, last_value(CASE WHEN regexp_matches(l, '^  [^ ].*:$') THEN l END IGNORE NULLS) OVER (PARTITION BY lock_id ORDER BY n) AS head,
        sum(CASE WHEN regexp_matches(l, '^  [^ ].*:$') THEN 1 ELSE 0 END) OVER (PARTITION BY lock_id ORDER BY n) AS block FROM o_lines) t
      WHERE contains(l, 'version:') AND block > 0 GROUP BY lock_id, block"""
)

YARN, PUB = positioned(YARN_ROWS), positioned(PUB_ROWS)

POD = positioned(
    """SELECT lock_id, n, 0 AS sub, split_part(name, '/', 1) AS name, version FROM (
      SELECT lock_id, n, regexp_extract(l, '^  - ([^ ()]+) \\((?:= )?([^ ()]+)\\):?$', 1) AS name, regexp_extract(l, '^  - ([^ ()]+) \\((?:= )?([^ ()]+)\\):?$', 2) AS version,
        max(CASE WHEN l = 'EXTERNAL SOURCES:' THEN n END) OVER (PARTITION BY lock_id) AS cut FROM o_lines) t
      WHERE name <> '' AND n < cut AND NOT EXISTS (SELECT 1 FROM o_lines e WHERE e.lock_id = t.lock_id AND e.n > t.cut AND e.l = '  ' || split_part(t.name, '/', 1) || ':')"""
)


def inventory() -> str:
    parts = []
    for body, file_name, eco in (
        (REQ, "requirements.txt", "pypi"), (PNPM, "pnpm-lock.yaml", "npm"), (YARN, "yarn.lock", "npm"),
        (PUB, "pubspec.lock", "pub"), (POD, "Podfile.lock", "cocoapods"),
    ):
        parts.append(f"SELECT lock_id, '{eco}' AS ecosystem, name, version FROM ({body.replace('o_lines', '(' + SPLIT.format(f=file_name) + ')')}) q")
    parts.append(f"SELECT lock_id, 'pypi', name, version FROM ({UV}) q")
    parts.append(f"SELECT lock_id, 'crates', name, version FROM ({CARGO}) q")
    parts.append(f"SELECT lock_id, 'npm', name, version FROM ({NPM}) q")
    return "SELECT DISTINCT lock_id, ecosystem, trim(name) AS name, trim(version) AS version FROM (" + " UNION ALL ".join(parts) + ") a WHERE trim(name) <> ''"


def x(path: str, doc: str = "doc") -> str:
    return f"json_extract_string({doc}, '{path}')"


CRATE_VERSION = f"""CASE WHEN version <> '' THEN version WHEN list_contains(json_extract_string(doc, '$.versions[*].num'), {x('$.crate.max_stable_version')}) THEN {x('$.crate.max_stable_version')}
  ELSE coalesce((SELECT arg_min(json_extract_string(value, '$.num'), key::INT) FROM json_each(doc, '$.versions') WHERE json_extract_string(value, '$.yanked') = 'false'), {x('$.crate.max_stable_version')}, '') END"""

REGISTRY = f"""SELECT ecosystem, name, ver AS version,
    CASE ecosystem WHEN 'pypi' THEN coalesce(nullif({x('$.info.author')}, ''), {x('$.info.author_email')}) WHEN 'pub' THEN {x('$.pubspec.publisher', 'rel')}
      WHEN 'crates' THEN coalesce(array_to_string(CASE WHEN json_type(rel, '$.authors') = 'ARRAY' THEN json_extract_string(rel, '$.authors[*]') END, ', '), nullif({x('$.published_by.name', 'rel')}, ''), {x('$.published_by.login', 'rel')}, '')
      WHEN 'cocoapods' THEN CASE WHEN json_type(doc, '$.authors') = 'OBJECT' THEN array_to_string(json_keys(doc, '$.authors'), ', ') ELSE {x('$.authors')} END
      ELSE coalesce({x('$.author.name', 'rel')}, {x('$.author', 'rel')}) END AS author,
    CASE ecosystem WHEN 'pypi' THEN coalesce(nullif({x('$.info.home_page')}, ''), {x('$.info.project_url')}) WHEN 'pub' THEN coalesce(nullif({x('$.pubspec.homepage', 'rel')}, ''), {x('$.pubspec.repository', 'rel')})
      WHEN 'crates' THEN {x('$.crate.homepage')} WHEN 'cocoapods' THEN {x('$.homepage')} ELSE {x('$.homepage', 'rel')} END AS homepage,
    CASE ecosystem WHEN 'pypi' THEN CASE WHEN {x('$.info.project_urls.Source')} LIKE '%github.com%' THEN {x('$.info.project_urls.Source')} WHEN {x('$.info.project_urls.Homepage')} LIKE '%github.com%' THEN {x('$.info.project_urls.Homepage')} ELSE '' END
      WHEN 'pub' THEN {x('$.pubspec.repository', 'rel')} WHEN 'crates' THEN coalesce({x('$.repository', 'rel')}, {x('$.crate.repository')}) WHEN 'cocoapods' THEN {x('$.source.git')}
      ELSE coalesce({x('$.repository.url', 'rel')}, {x('$.repository', 'rel')}) END AS repository,
    CASE ecosystem WHEN 'pypi' THEN {x('$.urls[0].packagetype')} = 'sdist' WHEN 'cocoapods' THEN {x('$.prepare_command')} IS NOT NULL OR json_array_length(doc, '$.script_phases') > 0
      WHEN 'pub' THEN false WHEN 'crates' THEN false ELSE {x('$.scripts.postinstall', 'rel')} IS NOT NULL END AS has_install_scripts,
    coalesce(array_to_string(list_sort(CASE ecosystem WHEN 'pypi' THEN CASE WHEN json_type(doc, '$.info.requires_dist') = 'ARRAY' THEN json_extract_string(doc, '$.info.requires_dist[*]') END WHEN 'crates' THEN NULL WHEN 'pub' THEN json_keys(rel, '$.pubspec.dependencies')
      WHEN 'cocoapods' THEN json_keys(doc, '$.dependencies') ELSE json_keys(rel, '$.dependencies') END), ','), '') AS dependencies
  FROM (SELECT *, CASE ecosystem WHEN 'pub' THEN CASE WHEN version = '' THEN doc->'$.latest' ELSE doc::JSON END
      WHEN 'crates' THEN CASE WHEN version <> '' THEN doc->'$.version' ELSE (SELECT any_value(value) FROM json_each(doc, '$.versions') WHERE json_extract_string(value, '$.num') = ver) END
      WHEN 'npm' THEN json_extract(doc, '$.versions."' || ver || '"') WHEN 'jsr' THEN json_extract(doc, '$.versions."' || ver || '"') END AS rel
    FROM (SELECT *, CASE ecosystem WHEN 'pypi' THEN {x('$.info.version')} WHEN 'pub' THEN coalesce(nullif(version, ''), {x('$.latest.version')}) WHEN 'crates' THEN {CRATE_VERSION}
      WHEN 'cocoapods' THEN version ELSE {x('$."dist-tags".latest')} END AS ver FROM v_registry) a) b"""


def sql() -> dict[str, str]:
    q: dict[str, str] = {}
    q["popular_dim"] = with_views("SELECT ecosystem, name FROM o_popular", popular())
    q["popular_union"] = with_views("SELECT ecosystem, count(*) AS n_names FROM o_popular GROUP BY ecosystem", popular())
    q["typosquat_candidates"] = with_views("SELECT ecosystem, compared, known FROM o_cand", candidates())
    q["typosquat"] = with_views("SELECT package_id, name, n_matches, text FROM o_typos", typos())
    q["normalise_refs"] = with_views(
        """SELECT package_id, CASE WHEN name LIKE '@%' THEN '@jsr/' || replace(substring(name, 2), '/', '__') ELSE name END AS npm_name,
          CASE kind WHEN 0 THEN 'github.com/acme/' || base WHEN 1 THEN 'gitlab.com/g/' || base WHEN 2 THEN '' ELSE CASE WHEN repository = '' THEN '' ELSE 'github.com/acme/' || repo END END AS archive_repo,
          CASE kind WHEN 0 THEN 'github.com/acme/' || base WHEN 1 THEN 'gitlab.com/g/' || base WHEN 2 THEN 'codeberg.org/c/' || base ELSE CASE WHEN repository = '' THEN '' ELSE 'github.com/acme/' || repo END END AS store_repo,
          CASE WHEN kind < 3 OR repository = '' THEN '' ELSE 'acme/' || repo || '.git' END AS owner_repo,
          substring(md5(name), 1, 1) || '/' || substring(md5(name), 2, 1) || '/' || substring(md5(name), 3, 1) AS shard,
          'repos/' || CASE kind WHEN 0 THEN 'github.com/acme/' || base WHEN 1 THEN 'gitlab.com/g/' || base WHEN 2 THEN 'codeberg.org/c/' || base ELSE CASE WHEN repository = '' THEN 'registry.' || ecosystem || '/' || name ELSE 'github.com/acme/' || repo END END || '/' || version AS storage_path
        FROM (SELECT package_id, ecosystem, version, repository, name AS base, CASE WHEN k % 3 = 0 THEN '@std/' || name ELSE name END AS name, replace(replace(repository, 'https://github.com/acme/', ''), '.git', '') AS repo, k % 5 AS kind FROM v_packages) t"""
    )
    q["lock_requirements"] = with_views(REQ, numbered("requirements.txt"))
    q["lock_toml"] = with_views(f"{positioned(UV)} UNION ALL {positioned(CARGO)}")
    q["lock_npm"] = with_views(NPM)
    q["lock_pnpm"] = with_views(PNPM, numbered("pnpm-lock.yaml"))
    q["lock_yarn"] = with_views(YARN, numbered("yarn.lock"))
    q["lock_pubspec"] = with_views(PUB, numbered("pubspec.lock"))
    q["lock_podfile"] = with_views(POD, numbered("Podfile.lock"))
    opens = "CASE WHEN file_name = 'yarn.lock' THEN l <> '' AND l[1] NOT IN (' ', chr(9)) ELSE regexp_matches(l, '^  [^ ].*:$') END"
    q["block_fill"] = with_views(
        f"""SELECT lock_id, file_name, n AS line_no, last_value(CASE WHEN {opens} THEN n END IGNORE NULLS) OVER w AS block, last_value(CASE WHEN {opens} THEN l END IGNORE NULLS) OVER w AS header
        FROM (SELECT lock_id, file_name, unnest(generate_series(1, len(p))) AS n, unnest(p) AS l FROM (SELECT lock_id, file_name, string_split(content, chr(10)) AS p FROM v_locks WHERE file_name IN ('yarn.lock', 'pubspec.lock')) s) t
        WINDOW w AS (PARTITION BY file_name, lock_id ORDER BY n)"""
    )
    entries = [
        f"SELECT lock_id, '{f}' AS file_name, n AS line_no, name, version FROM ({body.replace('o_lines', '(' + SPLIT.format(f=f) + ')')}) q"
        for body, f in ((YARN_ROWS, "yarn.lock"), (PUB_ROWS, "pubspec.lock"))
    ]
    q["block_entries"] = with_views(" UNION ALL ".join(entries))
    q["dependency_inventory"] = with_views(inventory())
    q["registry_packages"] = with_views(REGISTRY)
    q["latest_version"] = with_views(f"SELECT ecosystem, name, {CRATE_VERSION} AS version FROM v_registry WHERE ecosystem = 'crates'")
    return q
