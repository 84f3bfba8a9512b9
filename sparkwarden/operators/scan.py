"""One-pass file scan: rules, tags, compound rules, behaviours, attack chains, entropy, file risks.

Everything about a single file is computed inside its row.  The detectors build arrays of
small signal structs; they are concatenated and exploded once, so a corpus is read once and
file contents never reach a shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkwarden import values as V
from sparkwarden.functions import patterns as P
from sparkwarden.operators import files as FL
from sparkwarden.rules import Rule, select_rules

SIGNAL_TYPE = "array<struct<category:string,severity:string,key:string,text:string,evasion:boolean>>"
ENTROPY_THRESHOLD = 5.5
ENTROPY_MIN_CHARS = 80


def signal(category: str, severity: Column | str, text: Column, key: Column | None = None, evasion: bool = False) -> Column:
    """One signal.  ``key`` is what de-duplicates it across files; by default its text."""
    level = F.lit(severity) if isinstance(severity, str) else severity
    return F.struct(
        F.lit(category).alias("category"),
        level.alias("severity"),
        (text if key is None else key).alias("key"),
        text.alias("text"),
        F.lit(evasion).alias("evasion"),
    )


def gather(parts: list[Column]) -> Column:
    """Array of the non-null parts, typed as signals."""
    return F.array_compact(F.array(*parts)).cast(SIGNAL_TYPE)


def no_signals() -> Column:
    return F.array().cast(SIGNAL_TYPE)


# -- rules ------------------------------------------------------------------------------
def rule_tests(rules: list[Rule]) -> list[tuple[list, str]]:
    return [(r.anchors, P.java(r.pattern, ignore_case=not r.case_sensitive)) for r in rules]


BEHAVIOUR_TESTS = [(anchors, P.java(p, ignore_case=True)) for tests in V.BEHAVIOURS.values() for anchors, p in tests]
BEHAVIOUR_NAMES = [name for name, tests in V.BEHAVIOURS.items() for _ in tests]


def rule_hits(rules: list[Rule], ecosystem: Column, is_install: Column, content: Column, found: Column) -> Column:
    """Indices of the rules that match and that apply to the file's scope and ecosystem."""
    hits = P.matching(content, rule_tests(rules), found)
    if any(r.scope != "any" for r in rules):
        scopes = P.strings([r.scope for r in rules])
        other = F.when(is_install, "source").otherwise("install_script")
        hits = F.filter(hits, lambda i: pick(scopes, i) != other)
    if any(r.ecosystem != "*" for r in rules):
        ecosystems = P.strings([r.ecosystem for r in rules])
        hits = F.filter(hits, lambda i: pick(ecosystems, i).isin("*") | (pick(ecosystems, i) == ecosystem))
    return hits


def pick(constants: Column, index: Column) -> Column:
    return F.element_at(constants, index + 1)


def with_literals(files: DataFrame, tests: list[tuple[list, str]], extra: list[str] | None = None) -> DataFrame:
    """Files with their path classes and ``found``, the anchor literals their text contains."""
    path, content = F.col("path"), F.col("content")
    literals = sorted(set(P.literals_of(tests)) | set(extra or []))
    return files.select(
        *[c for c in ("package_id", "ecosystem", "path", "content", "ord") if c in files.columns],
        FL.is_install_path(path).alias("is_install"),
        FL.in_skipped_dir(path).alias("skip_dir"),
        FL.has_skipped_suffix(path).alias("skip_ext"),
        P.once(P.literals_in(content, literals)).alias("found"),
    )


def hits_of(rules: list[Rule], has_ecosystem: bool) -> Column:
    """Rule hits of a staged file; skipped directories and suffixes have none."""
    ecosystem = F.col("ecosystem") if has_ecosystem else F.lit("*")
    scanned = ~F.col("skip_dir") & (~F.col("skip_ext") | F.col("is_install"))
    hits = rule_hits(rules, ecosystem, F.col("is_install"), F.col("content"), F.col("found"))
    return F.when(scanned, hits).otherwise(F.array().cast("array<int>"))


def prepared(files: DataFrame, rules: list[Rule]) -> DataFrame:
    """Files with their path classes and rule hits, without their contents."""
    staged = with_literals(files, rule_tests(rules))
    return staged.select(
        "package_id", "path", "is_install", "skip_dir", "skip_ext", P.once(hits_of(rules, "ecosystem" in files.columns)).alias("hits")
    )


def rule_signals(rules: list[Rule]) -> Column:
    """Signals of the rule hits, plus one for every ``.pth`` file wherever it lies."""
    install = F.col("is_install")
    label = F.when(install, "install_script").otherwise("source")
    ids = P.strings([r.pattern for r in rules])
    raised = P.strings(["CRITICAL" if r.severity == "critical" else "HIGH" for r in rules])

    def build(i: Column) -> Column:
        severity = F.when(install, pick(raised, i)).otherwise("LOW")
        pattern = pick(ids, i)
        text = F.concat(
            F.lit("dangerous_pattern("), severity, F.lit("): '"), pattern, F.lit("' in "), label, F.lit(":"), F.col("path")
        )
        return signal("dangerous_pattern", severity, text, pattern)

    pth_text = F.concat(F.lit("dangerous_pattern(HIGH): '.pth file' in install_script:"), F.col("path"))
    pth = F.when(F.col("path").endswith(".pth"), signal("dangerous_pattern", "HIGH", pth_text, F.lit(".pth file")))
    return F.concat(gather([pth]), F.transform("hits", build).cast(SIGNAL_TYPE))


def rule_scan(files: DataFrame, rules: list[Rule] | None = None) -> DataFrame:
    """One signal per matching (file, rule); HIGH or more in install files, LOW elsewhere."""
    rules = select_rules() if rules is None else rules
    return exploded(prepared(files, rules), rule_signals(rules))


def exploded(staged: DataFrame, signals: Column) -> DataFrame:
    keys = [c for c in ("package_id", "path") if c in staged.columns]
    return staged.select(*keys, F.explode(signals).alias("_s")).select(
        *keys, "_s.category", "_s.severity", "_s.key", "_s.text", "_s.evasion"
    )


# -- tags and compound rules ------------------------------------------------------------
def tag_hits() -> Column:
    """Rule hits that count for tags: install files only, and never a skipped suffix.

    Tag collection knows no scope, but the built-in scope is ``any``; user rules limited to
    ``source`` would be the only difference and they cannot describe an install file.
    """
    return F.when(F.col("is_install") & ~F.col("skip_ext"), F.col("hits")).otherwise(F.array().cast("array<int>"))


def hit_tags(rules: list[Rule], hits: Column) -> Column:
    tags = P.constant([list(r.tags) for r in rules], "array<array<string>>")
    return F.array_sort(F.array_distinct(F.flatten(F.transform(hits, lambda i: pick(tags, i)))))


def file_tags(files: DataFrame, rules: list[Rule] | None = None) -> DataFrame:
    """Matched rule ids and their tags of every install-time file with a hit."""
    rules = select_rules() if rules is None else rules
    ids = P.strings([r.id for r in rules])
    hits = F.col("_t")
    tagged = prepared(files, rules).select("package_id", "path", P.once(tag_hits()).alias("_t")).filter(F.size("_t") > 0)
    return tagged.select(
        "package_id",
        "path",
        F.size(hits).alias("n_hits"),
        F.array_sort(F.transform(hits, lambda i: pick(ids, i))).alias("rule_ids"),
        hit_tags(rules, hits).alias("tags"),
    )


def compound_signals_of(n_hits: Column, tags: Column) -> Column:
    """Compound rules whose tags are all present; a less specific rule yields to a superset."""
    ordered = sorted(V.COMPOUND_RULES, key=lambda r: len(r[1]), reverse=True)
    fires = {r[0]: (F.size(F.array_except(P.strings(r[1]), tags)) == 0) & (n_hits >= r[2]) for r in ordered}
    parts = []
    for id_, required, _, severity, description in ordered:
        test = fires[id_]
        for other, other_required, *_rest in ordered:
            if set(other_required) > set(required):
                test = test & ~fires[other]
        text = F.concat(F.lit(f"compound({severity}): '{id_}' in "), F.col("path"), F.lit(f" — {description}"))
        parts.append(F.when(test, signal("compound", severity, text)))
    return F.when(n_hits >= 2, gather(parts)).otherwise(no_signals())


def compound_signals(files: DataFrame, rules: list[Rule] | None = None) -> DataFrame:
    tagged = file_tags(files, rules)
    return exploded(tagged, compound_signals_of(F.col("n_hits"), F.col("tags")))


# -- behaviours and chains --------------------------------------------------------------
def behaviours_of() -> Column:
    """Behaviours of a staged install-time file; one matching pattern is enough for each."""
    chained = F.col("is_install") & ~F.col("skip_dir") & ~F.col("skip_ext")
    names = P.strings(BEHAVIOUR_NAMES)
    hits = P.matching(F.col("content"), BEHAVIOUR_TESTS, F.col("found"))
    found = F.array_distinct(F.transform(hits, lambda i: pick(names, i)))
    return F.when(chained, found).otherwise(F.array().cast("array<string>"))


def with_behaviours(files: DataFrame) -> DataFrame:
    staged = with_literals(files, BEHAVIOUR_TESTS)
    return staged.select("package_id", "path", P.once(F.array_sort(behaviours_of())).alias("behaviours"))


def behaviour_sets(files: DataFrame) -> DataFrame:
    """Behaviours of every install-time file that shows any."""
    return with_behaviours(files).filter(F.size("behaviours") > 0)


def chain_signals_of(behaviours: Column) -> Column:
    """Every chain contained in the behaviours of a file; sub-chains stay."""
    parts = []
    for id_, required, severity, description in V.ATTACK_CHAINS:
        shown = ", ".join(sorted(required))
        text = F.concat(
            F.lit(f"behavior_chain({severity}): '{id_}' in "), F.col("path"), F.lit(f" -- {description} [behaviors: {shown}]")
        )
        present = F.size(F.array_except(P.strings(required), behaviours)) == 0
        parts.append(F.when(present, signal("behavior_chain", severity, text)))
    return F.when(F.size(behaviours) >= 2, gather(parts)).otherwise(no_signals())


def attack_chains(files: DataFrame) -> DataFrame:
    return exploded(with_behaviours(files), chain_signals_of(F.col("behaviours")))


# -- entropy ----------------------------------------------------------------------------
def characters(text: Column) -> Column:
    """Distinct characters of a text."""
    return F.filter(F.array_distinct(F.split(text, "")), lambda c: F.length(c) > 0)


def shannon(text: Column, symbols: Column) -> Column:
    """Shannon entropy of the characters of a text, in bits; one pass per distinct character."""
    counts = F.transform(symbols, lambda c: F.length(text) - F.length(F.replace(text, c, F.lit(""))))
    shares = F.transform(counts, lambda n: n / F.length(text))
    return -F.aggregate(shares, F.lit(0.0), lambda acc, p: acc + p * F.log2(p))


def entropy_lines_of(content: Column, threshold: float = ENTROPY_THRESHOLD) -> Column:
    """Long lines above the threshold, as ``(line, entropy)``.

    A text has at most the logarithm of its distinct characters in bits per character; that
    bound is tested first, so most lines never reach the sum.
    """
    numbered = F.transform(P.lines(content), lambda line, i: F.struct((i + 1).alias("line"), line.alias("text")))
    candidates = F.filter(numbered, lambda x: F.length(x["text"]) >= ENTROPY_MIN_CHARS)

    def spelled(x: Column) -> Column:
        return P.let(
            P.strip(x["text"]), lambda t: F.struct(x["line"].alias("line"), t.alias("text"), characters(t).alias("symbols"))
        )

    long = F.filter(
        F.transform(candidates, spelled),
        lambda x: (F.length(x["text"]) >= ENTROPY_MIN_CHARS) & (F.size(x["symbols"]) > int(2**threshold)),
    )
    scored = F.transform(long, lambda x: F.struct(x["line"].alias("line"), shannon(x["text"], x["symbols"]).alias("entropy")))
    return F.filter(scored, lambda x: x["entropy"] > threshold)


def entropy_lines(files: DataFrame, threshold: float = ENTROPY_THRESHOLD) -> DataFrame:
    keys = [c for c in files.columns if c != "content"]
    return files.select(*keys, F.explode(entropy_lines_of(F.col("content"), threshold)).alias("_e")).select(
        *keys, F.col("_e.line").alias("line"), F.col("_e.entropy").alias("entropy")
    )


def entropy_signals_of(content: Column, threshold: float) -> Column:
    def build(e: Column) -> Column:
        text = F.concat(
            F.format_string("high_entropy(%.2f): ", e["entropy"]),
            F.col("path"),
            F.lit(":"),
            e["line"].cast("string"),
            F.lit(f" (possible obfuscation, threshold={threshold})"),
        )
        return signal("high_entropy", "LOW", text)

    return F.transform(entropy_lines_of(content, threshold), build).cast(SIGNAL_TYPE)


# -- ecosystem-specific files -----------------------------------------------------------
def crate_signals_of() -> Column:
    """Build scripts, network use inside them, and compile-time macros of Rust packages."""
    path, content = F.col("path"), F.col("content")
    name = FL.basename(path)

    def risk(key: str, note: str) -> Column:
        text = F.concat(F.lit(f"dangerous_pattern(HIGH): '{key}' in install_script:"), path, F.lit(f" ({note})"))
        return signal("dangerous_pattern", "HIGH", text, F.lit(key))

    script = name == "build.rs"
    parts = [F.when(script, risk("build.rs", "executes arbitrary code at cargo build time"))]
    for label, pattern in V.BUILD_SCRIPT_PATTERNS:
        parts.append(
            F.when(script & P.found(content, pattern), risk(f"build.rs:{label}", "network or subprocess from build script"))
        )
    macro = (name == "Cargo.toml") & P.found(content, V.PROC_MACRO, ignore_case=True)
    parts.append(F.when(macro, risk("proc-macro=true", "proc-macro crate — executes arbitrary code at compile time")))
    return F.when(F.col("ecosystem").isin("crates", "cargo"), gather(parts)).otherwise(no_signals())


def crate_risks(files: DataFrame) -> DataFrame:
    return exploded(files, crate_signals_of())


def pod_signals_of(marker: str = "__risk__/cocoapods-divergence.txt") -> Column:
    """Divergence marker files and ``export-ignore`` attributes of pods."""
    path, content = F.col("path"), F.col("content")
    diverged = F.concat(
        F.lit("suspicious_pattern(HIGH): podspec-vs-tarball path divergence ("), P.strip(content), F.lit(")")
    )
    hidden = F.concat(
        F.lit("suspicious_pattern(HIGH): '.gitattributes export-ignore' in install_script:"),
        path,
        F.lit(" (can hide files from git archive, may differ from git checkout)"),
    )
    parts = [
        F.when(path == marker, signal("suspicious_pattern", "HIGH", diverged)),
        F.when(
            path.endswith(".gitattributes") & F.contains(content, F.lit("export-ignore")),
            signal("suspicious_pattern", "HIGH", hidden),
        ),
    ]
    return F.when(F.col("ecosystem").isin("cocoapods", "pods"), gather(parts)).otherwise(no_signals())


def pod_risks(files: DataFrame) -> DataFrame:
    return exploded(files, pod_signals_of())


def mismatch_signals_of(detected: Column) -> Column:
    hidden = FL.mismatch(F.col("path"), detected)
    text = F.concat(F.lit("extension_mismatch(HIGH): "), hidden, F.lit(" in "), F.col("path"))
    return gather([F.when(hidden.isNotNull(), signal("extension_mismatch", "HIGH", text))])
