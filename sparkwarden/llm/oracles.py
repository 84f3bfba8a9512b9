"""DuckDB SQL for the training-data queries that SQL can express."""

from __future__ import annotations

from sparkwarden.llm import embeddings, manifest, mixing, quality, substrings

_WORD = r"[^\x20\x09-\x0D]+"


def _quality() -> str:
    votes = ", ".join(f"CASE WHEN {bad or 'false'} THEN -1 WHEN {good or 'false'} THEN 1 ELSE 0 END" for bad, good in quality.RULES.values())
    n = len(quality.RULES)
    prior = f"ln({quality.PRIOR_GOOD} / (1 - {quality.PRIOR_GOOD}))"
    odds = lambda w, v: f"({prior} + list_sum(list_transform(range(1, {n + 1}), lambda j: {w}[j] * {v}[j])))"
    good = f"(1 / (1 + exp(-{odds('w', 'x.votes')})))"
    right = f"list_sum(list_transform(patterns, lambda x: x.n * CASE x.votes[r] WHEN 1 THEN {good} WHEN -1 THEN 1 - {good} ELSE 0 END))"
    wrong = f"list_sum(list_transform(patterns, lambda x: x.n * CASE x.votes[r] WHEN 1 THEN 1 - {good} WHEN -1 THEN {good} ELSE 0 END))"
    start = f"list_transform(range(1, {n + 1}), lambda r: ln({quality.START_ACCURACY} / (1 - {quality.START_ACCURACY})))"
    kept_right, kept_wrong = quality.START_VOTES * quality.START_ACCURACY, quality.START_VOTES * (1 - quality.START_ACCURACY)
    return rf"""
WITH RECURSIVE d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, t, regexp_extract_all(t, '{_WORD}') AS ws FROM d),
p AS (SELECT doc_id, unnest(ws) AS a, generate_subscripts(ws, 1) AS i FROM w),
five AS (SELECT doc_id, i, a, lead(a, 1) OVER o AS b, lead(a, 2) OVER o AS c, lead(a, 3) OVER o AS e, lead(a, 4) OVER o AS f FROM p WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
twice AS (SELECT doc_id, i, CASE WHEN f IS NOT NULL AND count(*) OVER (PARTITION BY doc_id, a, b, c, e, f) > 1 THEN 1 ELSE 0 END AS r FROM five),
covered AS (SELECT doc_id, max(r) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS r FROM twice),
repeats AS (SELECT doc_id, sum(r)::BIGINT AS n FROM covered GROUP BY doc_id),
l AS (SELECT doc_id, unnest(string_split(t, chr(10))) AS line FROM d),
lines AS (SELECT doc_id, count(*) AS n, count(DISTINCT line) AS u FROM l WHERE regexp_matches(line, '{_WORD}') GROUP BY doc_id),
m AS (
  SELECT w.doc_id, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars, len(regexp_extract_all(t, '[#*$%&|<>]'))::BIGINT AS n_symbols,
    coalesce(lines.n - lines.u, 0)::BIGINT AS n_dup_lines, coalesce(repeats.n, 0)::BIGINT AS n_repeat_words, coalesce(lines.n, 0)::BIGINT AS n_lines,
    len(list_distinct(ws))::BIGINT AS n_distinct, len(regexp_extract_all(t, '\p{{Lu}}'))::BIGINT AS n_capitals, len(regexp_extract_all(t, '!'))::BIGINT AS n_shouts
  FROM w LEFT JOIN lines USING (doc_id) LEFT JOIN repeats USING (doc_id)),
v AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed, [{votes}] AS votes FROM m),
pats AS (SELECT list({{'votes': votes, 'n': n}}) AS patterns FROM (SELECT votes, count(*)::DOUBLE AS n FROM v GROUP BY votes)),
em AS (
  SELECT 0 AS i, {start} AS w
  UNION ALL
  SELECT i + 1, list_transform(range(1, {n + 1}), lambda r: ln(({right} + {kept_right}) / ({wrong} + {kept_wrong}))) FROM em, pats WHERE i < {quality.ROUNDS}),
fitted AS (SELECT w FROM em WHERE i = {quality.ROUNDS})
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND 1 / (1 + exp(-{odds('fitted.w', 'v.votes')})) >= 0.5 AS kept
FROM v, fitted"""


def _embeddings() -> str:
    return f"""
WITH RECURSIVE v AS (
  SELECT vec_id, embedding::DOUBLE[] AS e,
    embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0 AS fine
  FROM embeddings),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND a.fine AND b.fine AND len(a.e) = len(b.e) WHERE list_cosine_similarity(a.e, b.e) >= {embeddings.COSINE}),
reach AS (SELECT vec_id AS a, vec_id AS b FROM v UNION SELECT reach.a, links.b FROM reach JOIN links ON links.a = reach.b),
low AS (SELECT a AS vec_id, min(b) AS component_id FROM reach GROUP BY a),
degree AS (SELECT a AS vec_id, count(*) AS n FROM links GROUP BY a)
SELECT vec_id, coalesce(degree.n, 0)::BIGINT AS n_links, component_id, vec_id = component_id AS kept
FROM v JOIN low USING (vec_id) LEFT JOIN degree USING (vec_id)"""


def _mixing(seed: int = 0) -> str:
    weights = "[" + ", ".join(f"{float(w)}" for w in mixing.WEIGHTS) + "]"
    return rf"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '{_WORD}'))::BIGINT AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source IS NULL, source COLLATE "C") - 1 AS k FROM d GROUP BY source),
r AS (SELECT *, {weights}[(k % {len(mixing.WEIGHTS)}) + 1] AS weight, {float(mixing.MOST)} * source_size AS cap FROM s),
ladder AS (SELECT cap / weight AS ratio, sum(cap) AS cap, sum(weight) AS weight FROM r GROUP BY 1),
steps AS (
  SELECT ratio, coalesce(sum(cap) OVER o, 0.0) AS filled, coalesce(sum(weight) OVER o, 0.0) AS gone
  FROM ladder WINDOW o AS (ORDER BY ratio ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
sums AS (SELECT sum(source_size)::DOUBLE AS all_words, sum(weight) AS weights FROM r),
levels AS (SELECT ratio, ({mixing.SHARE} * all_words - filled) / (weights - gone) AS level FROM steps, sums),
chosen AS (SELECT min_by(level, ratio) AS level FROM levels WHERE level <= ratio),
t AS (
  SELECT source, source_size, CASE WHEN cap <= level * weight THEN cap ELSE level * weight END AS target,
    ('0x' || substr(md5('{seed}:' || coalesce(source, chr(0) || 'null')), 1, 8))::BIGINT / {float(1 << 32)} AS start
  FROM r, chosen),
n AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY size, doc_id) - 1 AS k FROM d WHERE size > 0),
taken AS (
  SELECT n.doc_id, n.size, t.source_size, t.target, (floor((n.k + 1) * (t.target / t.source_size) + t.start) - floor(n.k * (t.target / t.source_size) + t.start))::BIGINT * n.size AS taken
  FROM n JOIN t ON n.source IS NOT DISTINCT FROM t.source)
SELECT * FROM taken
UNION ALL
SELECT d.doc_id, d.size, t.source_size, coalesce(t.target, 0.0), 0 FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source WHERE d.size = 0"""


def _substrings() -> str:
    n = substrings.LENGTH
    return f"""
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
s AS (SELECT doc_id, h, unnest(range(0, greatest(length(h) // 2 - {n - 1}, 0))) AS s FROM d),
k AS (SELECT doc_id, s, md5(substr(h, 2 * s + 1, {2 * n})) AS k FROM s),
again AS (SELECT doc_id, s FROM (SELECT doc_id, s, row_number() OVER (PARTITION BY k ORDER BY doc_id, s) AS r FROM k) WHERE r > 1),
marked AS (SELECT doc_id, s, CASE WHEN s - lag(s) OVER (PARTITION BY doc_id ORDER BY s) <= {n} THEN 0 ELSE 1 END AS new FROM again),
numbered AS (SELECT doc_id, s, sum(new) OVER (PARTITION BY doc_id ORDER BY s) AS g FROM marked),
gone AS (SELECT doc_id, g, min(s) AS a, max(s) + {n} AS b FROM numbered GROUP BY doc_id, g),
totals AS (SELECT doc_id, sum(b - a)::BIGINT AS n_removed, count(*) AS n_spans FROM gone GROUP BY doc_id),
pieces AS (
  SELECT doc_id, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS a, a AS b FROM gone
  UNION ALL
  SELECT d.doc_id, coalesce(max(gone.b), 0), any_value(length(h) // 2) FROM d LEFT JOIN gone USING (doc_id) GROUP BY d.doc_id),
kept AS (SELECT doc_id, string_agg(substr(h, (2 * a + 1)::BIGINT, (2 * (b - a))::BIGINT), '' ORDER BY a) AS h FROM pieces JOIN d USING (doc_id) GROUP BY doc_id)
SELECT d.doc_id, (length(d.h) // 2)::BIGINT AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(kept.h)) AS kept_sha256
FROM d JOIN kept USING (doc_id) LEFT JOIN totals USING (doc_id)"""


def crc32(text: str) -> str:
    """SQL for the unsigned CRC-32 of an ASCII text: the reflected polynomial, bit by bit; -1 stands for a shift."""
    bits = f"flatten(list_transform(string_split({text}, ''), lambda c: [ascii(c)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))"
    step = "CASE WHEN x >= 0 THEN xor(a, x) WHEN a % 2 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, {bits}), lambda a, x: {step}), 4294967295)"


def _manifest() -> str:
    n = manifest.ARITY
    field = lambda c: f"coalesce(octet_length(encode({c}::VARCHAR)) || ':' || {c}, '-')"
    leaf = lambda text: "sha256(" + " || ".join(map(field, ("doc_id", "source", "lang", "n_chars", text))) + ")"
    climb = f"list_transform(range(1, len(nodes) + 1, {n}), lambda i: sha256(array_to_string(list_slice(nodes, i, i + {n - 1}), '')))"
    run = f"range(idx - idx % {n} + 1, least(idx - idx % {n} + {n}, len(nodes)) + 1)"
    folded = f"sha256(array_to_string(list_transform({run}, lambda i: CASE WHEN i = idx + 1 THEN folded ELSE nodes[i] END), ''))"
    beside = f"siblings || array_to_string(list_transform(list_filter({run}, lambda i: i <> idx + 1), lambda i: nodes[i]), '')"
    return f"""
WITH RECURSIVE f AS (
  SELECT doc_id, source, {leaf("text")} AS leaf,
    CASE WHEN {crc32("doc_id::VARCHAR")} % 2 = 0 THEN {leaf("replace(text, chr(10), '')")} ELSE {leaf("text")} END AS other FROM documents),
p AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf, other) - 1 AS pos FROM f),
trees AS (
  SELECT source, 0 AS level, list(leaf ORDER BY pos) AS nodes FROM p GROUP BY source
  UNION ALL
  SELECT source, level + 1, {climb} FROM trees WHERE len(nodes) > 1),
subroots AS (SELECT source, level, nodes[1] AS subroot, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS pos FROM trees WHERE len(nodes) = 1),
top AS (
  SELECT 0 AS level, list(subroot ORDER BY pos) AS nodes FROM subroots
  UNION ALL
  SELECT level + 1, {climb} FROM top WHERE len(nodes) > 1),
low AS (
  SELECT source, pos, pos AS idx, 0 AS level, other AS folded, '' AS siblings FROM p
  UNION ALL
  SELECT low.source, pos, idx // {n}, low.level + 1, {folded}, {beside}
  FROM low JOIN trees ON trees.source IS NOT DISTINCT FROM low.source AND trees.level = low.level WHERE len(nodes) > 1),
high AS (
  SELECT low.source, low.pos, subroots.pos AS idx, 0 AS level, folded, siblings
  FROM low JOIN subroots ON low.source IS NOT DISTINCT FROM subroots.source AND low.level = subroots.level
  UNION ALL
  SELECT source, pos, idx // {n}, level + 1, {folded}, {beside} FROM high JOIN top USING (level) WHERE len(nodes) > 1)
SELECT doc_id, leaf, subroot, top.nodes[1] AS root, sha256(siblings) AS proof_sha256, folded AS folded_root, folded = top.nodes[1] AS verified
FROM p JOIN high ON p.source IS NOT DISTINCT FROM high.source AND p.pos = high.pos
  JOIN top ON top.level = high.level AND len(top.nodes) = 1 JOIN subroots ON p.source IS NOT DISTINCT FROM subroots.source"""


ORACLES: dict[str, str] = {
    "op4_quality_rules": _quality(),
    "op5_embeddings": _embeddings(),
    "op6_mixing": _mixing(),
    "op7_substrings": _substrings(),
    "op12_manifest": _manifest(),
}
