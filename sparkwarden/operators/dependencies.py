"""Dependency manifests and registry documents.

A manifest is one row, so every format is parsed inside its row into an array of
``(name, version)``; nothing is shuffled and a manifest of any length stays one record.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkwarden import values as V
from sparkwarden.functions import patterns as P
from sparkwarden.functions.ordered import WIDTH, carried
from sparkwarden.operators.files import basename, path_suffix

PACKAGES = "array<struct<name:string,version:string>>"


def entry(name: Column, version: Column) -> Column:
    return F.struct(name.alias("name"), F.coalesce(version, F.lit("")).alias("version"))


def after(text: Column, mark: str) -> Column:
    """Text after the first occurrence of a mark."""
    return F.substring(text, F.instr(text, mark) + len(mark), F.length(text))


def parse_requirements(content: Column) -> Column:
    stripped = F.transform(P.lines(content), P.strip)
    wanted = F.filter(stripped, lambda s: (F.length(s) > 0) & ~s.startswith("#") & ~s.startswith("-"))
    return F.transform(
        wanted,
        lambda s: F.when(s.contains("=="), entry(P.strip(F.substring_index(s, "==", 1)), P.strip(after(s, "=="))))
        .when(s.contains(">="), entry(P.strip(F.substring_index(s, ">=", 1)), F.lit("")))
        .otherwise(entry(s, F.lit(""))),
    )


def toml_blocks(content: Column) -> Column:
    """Bodies of the ``[[package]]`` tables, without their sub-tables."""
    blocks = F.split(content, r"(?m)^\[\[package\]\][ \t]*$")
    return F.transform(F.slice(blocks, 2, F.greatest(F.size(blocks) - 1, F.lit(0))), lambda b: F.split(b, r"(?m)^\[", 2)[0])


def toml_value(block: Column, key: str) -> Column:
    return P.strip(F.regexp_extract(block, rf'(?m)^{key}[ \t]*=[ \t]*"([^"]*)"', 1))


def parse_toml(content: Column, registry_only: bool = False) -> Column:
    """Packages of a uv (all) or Cargo (registry sources with name and version) lock."""
    rows = F.transform(
        toml_blocks(content),
        lambda b: F.struct(
            toml_value(b, "name").alias("name"), toml_value(b, "version").alias("version"), toml_value(b, "source").alias("source")
        ),
    )
    if registry_only:
        rows = F.filter(rows, lambda r: (r["name"] != "") & (r["version"] != "") & r["source"].startswith("registry+"))
    return F.transform(F.filter(rows, lambda r: r["name"] != ""), lambda r: entry(r["name"], r["version"]))


def parse_npm(content: Column) -> Column:
    doc = F.from_json(
        content, "packages map<string,struct<version:string>>, dependencies map<string,struct<version:string>>"
    )
    modules = F.filter(F.map_entries(doc["packages"]), lambda e: e["key"].contains("node_modules/"))
    nested = F.transform(
        modules, lambda e: entry(F.element_at(F.split(e["key"], "node_modules/"), -1), e["value"]["version"])
    )
    flat = F.transform(F.map_entries(doc["dependencies"]), lambda e: entry(e["key"], e["value"]["version"]))
    empty = F.array().cast(PACKAGES)
    return F.when(F.coalesce(F.size(doc["packages"]), F.lit(0)) > 0, F.coalesce(nested, empty)).otherwise(F.coalesce(flat, empty))


def pnpm_key(key: Column) -> Column:
    """``/@s/n@1.2(peer)`` as (name, version), null when no version follows the last ``@``."""
    quoted = F.regexp_replace(F.regexp_replace(P.strip(key), r"^'+|'+$", ""), r'^"+|"+$', "")
    bare = F.split(F.regexp_replace(quoted, "^/+", ""), r"\(", 2)[0]
    return F.when(
        P.found(bare, r"(?s)^.+@[^@]+$"),
        entry(F.regexp_extract(bare, r"(?s)^(.+)@([^@]+)$", 1), F.regexp_extract(bare, r"(?s)^(.+)@([^@]+)$", 2)),
    )


def yaml_section(content: Column, title: str) -> Column:
    """Lines under a top-level key up to the next one."""
    return F.regexp_extract(content, rf"(?m)^{title}:[ \t]*\n((?:[ \t].*\n?|\n)*)", 1)


def parse_pnpm(content: Column) -> Column:
    section = yaml_section(content, "packages")
    keys = F.regexp_extract_all(section, F.lit(r"(?m)^  ([^ \n].*?):(?:[ \t]*\{.*\})?[ \t]*$"), F.lit(1))
    return F.filter(F.transform(keys, pnpm_key), lambda p: p.isNotNull())


def yarn_names(selectors: Column) -> Column:
    """Names in a comma list of selectors; scoped names keep their leading ``@``."""
    specs = F.transform(
        F.split(F.regexp_replace(selectors, ":+$", ""), ","),
        lambda s: F.regexp_replace(F.regexp_replace(P.strip(s), r'^"+|"+$', ""), r"^'+|'+$", ""),
    )
    names = F.transform(
        F.filter(specs, lambda s: s != ""),
        lambda s: F.when(s.startswith("@"), F.regexp_replace(s, r"(?s)@[^@]*$", "")).otherwise(F.substring_index(s, "@", 1)),
    )
    return F.filter(names, lambda n: n != "")


def parse_yarn(content: Column) -> Column:
    """Blocks open at unindented lines; every indented ``version "x"`` names all selectors."""
    blocks = F.split(content, r"(?m)(?:^|\n)(?=[^ \t\n])")
    return F.flatten(
        F.transform(
            blocks,
            lambda b: F.flatten(
                F.transform(
                    F.regexp_extract_all(b, F.lit(r'(?m)^[ \t]+version [^"\n]*"([^"\n]*)"'), F.lit(1)),
                    lambda v: F.transform(yarn_names(F.regexp_extract(b, r"^([^\n]*)", 1)), lambda n: entry(n, v)),
                )
            ),
        )
    )


def parse_pubspec(content: Column) -> Column:
    """A name line indented by two, then the first line with a version."""
    blocks = F.split(content, r"(?m)^(?=  (?!  ).*:[ \t]*$)")
    rows = F.transform(
        F.slice(blocks, 2, F.greatest(F.size(blocks) - 1, F.lit(0))),
        lambda b: F.struct(
            F.regexp_replace(P.strip(F.regexp_extract(b, r"^([^\n]*)", 1)), ":+$", "").alias("name"),
            F.regexp_extract(b, r"\n[^\n]*?version:([^\n]*)", 1).alias("rest"),
            F.regexp_extract(b, r"\n[^\n]*?version:", 0).alias("seen"),
        ),
    )
    return F.transform(
        F.filter(rows, lambda r: (r["seen"] != "") & (r["name"] != "")),
        lambda r: entry(
            r["name"], F.regexp_replace(P.strip(F.substring_index(r["rest"], "version:", 1)), r'^"+|"+$', "")
        ),
    )


def parse_podfile(content: Column) -> Column:
    """Top-level pods by parent name, without those from external sources."""
    unquote = lambda s: F.regexp_replace(P.strip(s), r"^[\"']|[\"']$", "")
    entries = F.regexp_extract_all(yaml_section(content, "PODS"), F.lit(r"(?m)^  - (.*?):?[ \t]*$"), F.lit(1))
    external = F.transform(
        F.regexp_extract_all(yaml_section(content, "EXTERNAL SOURCES"), F.lit(r"(?m)^  ([^ \n].*?):[ \t]*$"), F.lit(1)), unquote
    )
    rows = F.transform(
        entries,
        lambda e: entry(F.substring_index(F.regexp_extract(unquote(e), V.POD_LINE, 1), "/", 1), F.regexp_extract(unquote(e), V.POD_LINE, 2)),
    )
    return F.filter(rows, lambda r: (r["name"] != "") & (r["version"] != "") & ~F.array_contains(external, r["name"]))


def lock_ecosystem(file_name: Column) -> Column:
    name = F.lower(basename(file_name))
    return (
        F.when(name.isin("package-lock.json", "yarn.lock", "pnpm-lock.yaml"), "npm")
        .when(name == "pubspec.lock", "pub")
        .when(name == "cargo.lock", "crates")
        .when(name == "podfile.lock", "cocoapods")
        .otherwise("pypi")
    )


def parse_lock(file_name: Column, content: Column) -> Column:
    """Packages of a manifest, by its file name; unknown names yield none."""
    name = basename(file_name)
    lower = F.lower(name)
    return (
        F.when((name == "requirements.txt") | (path_suffix(name) == ".txt"), parse_requirements(content).cast(PACKAGES))
        .when(name == "uv.lock", parse_toml(content).cast(PACKAGES))
        .when(name == "package-lock.json", parse_npm(content).cast(PACKAGES))
        .when(name == "pnpm-lock.yaml", parse_pnpm(content).cast(PACKAGES))
        .when(name == "yarn.lock", parse_yarn(content).cast(PACKAGES))
        .when(name == "pubspec.lock", parse_pubspec(content).cast(PACKAGES))
        .when(lower == "cargo.lock", parse_toml(content, registry_only=True).cast(PACKAGES))
        .when(lower == "podfile.lock", parse_podfile(content).cast(PACKAGES))
        .otherwise(F.array().cast(PACKAGES))
    )


def dependency_inventory(locks: DataFrame) -> DataFrame:
    """Distinct named packages of every manifest with the ecosystem its file name implies."""
    trimmed = F.transform(
        parse_lock(F.col("file_name"), F.col("content")), lambda p: entry(P.strip(p["name"]), P.strip(p["version"]))
    )
    named = F.array_distinct(F.filter(trimmed, lambda p: p["name"] != ""))
    return locks.select("lock_id", lock_ecosystem(F.col("file_name")).alias("ecosystem"), F.explode(named).alias("_p")).select(
        "lock_id", "ecosystem", "_p.name", "_p.version"
    )


def parsed(locks: DataFrame, packages: Column) -> DataFrame:
    """Raw entries of one format, in file order and with repeats."""
    return locks.select("lock_id", F.posexplode(packages.cast(PACKAGES)).alias("pos", "_p")).select("lock_id", "pos", "_p.*")


# -- manifests line by line ---------------------------------------------------------------
#: Lines that open a block, by format: any unindented one; a key indented by two.
BLOCK_HEADERS = {"yarn.lock": r"^[^ \t\n]", "pubspec.lock": r"^  (?!  ).*:[ \t]*$"}


def manifest_lines(locks: DataFrame) -> DataFrame:
    """``lock_id, file_name, line_no`` (from 1) and ``line`` of manifests held whole; a reader of lines gives the same rows."""
    rows = locks.select("lock_id", "file_name", F.posexplode(F.split("content", "\n")).alias("n", "line"))
    return rows.select("lock_id", "file_name", (F.col("n") + 1).cast("bigint").alias("line_no"), "line")


def block_fill(lines: DataFrame, width: int = WIDTH) -> DataFrame:
    """Lines with ``block`` and ``header``: number and text of the last line that opened a block, null before the first.

    A manifest may have any number of lines: it is filled in ranges of ``width``, and one header a range carries over.
    """
    opens = F.lit(False)
    for name, pattern in BLOCK_HEADERS.items():
        opens = opens | ((F.col("file_name") == name) & F.col("line").rlike(pattern))
    header = F.when(opens, F.struct(F.col("line_no").alias("block"), F.col("line").alias("header")))
    filled = carried(lines, ["file_name", "lock_id"], "line_no", header, "_h", width)
    return filled.select("lock_id", "file_name", "line_no", "line", "_h.block", "_h.header")


def block_entries(lines: DataFrame, width: int = WIDTH) -> DataFrame:
    """Packages of yarn and pubspec manifests given line by line: what the parsers of whole manifests find, in lines of any number.

    Every indented version line of a yarn block names all its selectors; a pubspec block has the version of its first such line.
    """
    filled = block_fill(lines, width)
    yarn = filled.filter("file_name = 'yarn.lock'").select(
        "lock_id", "file_name", "line_no", F.explode(yarn_names(F.col("header"))).alias("name"),
        F.regexp_extract("line", r'^[ \t]+version [^"\n]*"([^"\n]*)"', 1).alias("version"),
        F.col("line").rlike(r'^[ \t]+version [^"\n]*"([^"\n]*)"').alias("_hit"),
    ).filter("_hit").drop("_hit")
    seen = filled.filter(F.contains("line", F.lit("version:")) & (F.col("line_no") > F.col("block")) & (F.col("file_name") == "pubspec.lock"))
    first = seen.groupBy("lock_id", "file_name", "block").agg(F.min(F.struct("line_no", "line", "header")).alias("_f"))
    rest = P.strip(after(F.col("_f.line"), "version:"))
    pubspec = first.select(
        "lock_id", "file_name", F.col("_f.line_no").alias("line_no"), F.regexp_replace(P.strip(F.col("_f.header")), ":+$", "").alias("name"),
        F.regexp_replace(rest, r'^"+|"+$', "").alias("version"),
    ).filter("name <> ''")
    return yarn.unionByName(pubspec)


# -- registry documents -----------------------------------------------------------------
def text_or_empty(*columns: Column) -> Column:
    """First non-empty text."""
    return F.coalesce(*[F.when(F.length(c) > 0, c) for c in columns], F.lit(""))


def pypi_repo_url(urls: Column) -> Column:
    """First of the well-known link labels, if it points to GitHub or GitLab."""
    usable = [
        F.when(P.contains_any(urls[k], ["github.com", "gitlab.com"]), urls[k]) for k in V.REPO_URL_KEYS
    ]
    return F.coalesce(*usable, F.lit(""))


def json_keys(doc: Column, path: str) -> Column:
    return F.coalesce(F.json_object_keys(F.get_json_object(doc, path)), F.array().cast("array<string>"))


def text_or_object(doc: Column, path: str, field: str) -> Column:
    """A JSON member that is either text or an object with a text field."""
    value = F.get_json_object(doc, path)
    return F.coalesce(F.when(value.startswith("{"), F.get_json_object(value, f"$.{field}")).otherwise(value), F.lit(""))


def truthy(doc: Column, path: str) -> Column:
    return F.coalesce(~F.get_json_object(doc, path).isin("", "[]", "{}", "false", "0", "null"), F.lit(False))


def latest_crate_version(doc: Column, version: Column) -> Column:
    """Requested version, else the stable maximum, the maximum, or the first not yanked."""
    numbers = F.from_json(F.get_json_object(doc, "$.versions"), "array<struct<num:string,yanked:boolean>>")
    wanted = text_or_empty(F.get_json_object(doc, "$.crate.max_stable_version"), F.get_json_object(doc, "$.crate.max_version"))
    listed = F.exists(F.coalesce(numbers, F.array().cast("array<struct<num:string,yanked:boolean>>")), lambda v: v["num"] == wanted)
    first_live = F.get(F.filter(numbers, lambda v: ~F.coalesce(v["yanked"], F.lit(False))), 0)["num"]
    return text_or_empty(version, F.when(listed, wanted), first_live, wanted)


def registry_packages(documents: DataFrame) -> DataFrame:
    """Recorded registry answers (``ecosystem, name, version, doc``) as package rows.

    ``version`` is the requested one, '' for the latest.
    """
    doc, eco, version = F.col("doc"), F.col("ecosystem"), F.col("version")
    at = lambda path: F.get_json_object(doc, path)
    npm_version = text_or_empty(version, at("$['dist-tags'].latest"))
    # A version holds dots, so its object is taken from a map rather than by path.
    releases = F.from_json(at("$.versions"), "map<string,string>")
    staged = documents.withColumn(
        "_release",
        F.when(eco.isin("npm", "jsr"), F.coalesce(releases[npm_version], F.lit("{}"))).when(
            eco == "pub", F.when(version == "", F.coalesce(at("$.latest"), F.lit("{}"))).otherwise(doc)
        ),
    )
    # Columns of their own, so that each is worked out once a row and not for every field taken from it.
    staged = staged.withColumn("_number", F.when(eco == "crates", latest_crate_version(doc, version)))
    number = F.col("_number")
    entries = F.from_json(at("$.versions"), "array<string>")
    found = F.get(F.filter(entries, lambda e: F.get_json_object(e, "$.num") == number), 0)
    staged = staged.withColumn("_entry", F.when(eco == "crates", F.when(version != "", at("$.version")).otherwise(found)))
    crate_entry = F.col("_entry")
    release = F.col("_release")
    r = lambda path: F.get_json_object(release, path)
    c = lambda path: F.get_json_object(crate_entry, path)
    crate_authors = F.array_join(F.from_json(c("$.authors"), "array<string>"), ", ")
    pypi_urls = F.from_json(at("$.info.project_urls"), "map<string,string>")
    sdist = F.exists(
        F.coalesce(F.from_json(at("$.urls"), "array<struct<packagetype:string>>"), F.array().cast("array<struct<packagetype:string>>")),
        lambda u: u["packagetype"] == "sdist",
    )
    npm_scripts = truthy(release, "$.scripts.preinstall") | truthy(release, "$.scripts.postinstall") | truthy(release, "$.scripts.install")
    authors = at("$.authors")
    pod_author = F.when(authors.startswith("{"), F.array_join(F.json_object_keys(authors), ", ")).when(
        authors.startswith("["), F.array_join(F.from_json(authors, "array<string>"), ", ")
    ).otherwise(F.coalesce(authors, F.lit("")))
    none = F.array().cast("array<string>")

    def per(pypi: Column, npm: Column, pub: Column, crates: Column, pods: Column) -> Column:
        return (
            F.when(eco == "pypi", pypi).when(eco.isin("npm", "jsr"), npm).when(eco == "pub", pub)
            .when(eco == "crates", crates).when(eco == "cocoapods", pods)
        )

    return staged.select(
        "ecosystem",
        "name",
        per(
            text_or_empty(version, at("$.info.version")), npm_version,
            text_or_empty(version, r("$.version"), r("$.pubspec.version")), number, version,
        ).alias("version"),
        per(
            text_or_empty(at("$.info.author"), at("$.info.author_email")), text_or_object(release, "$.author", "name"),
            F.coalesce(r("$.pubspec.publisher"), F.lit("")),
            F.coalesce(crate_authors, text_or_empty(c("$.published_by.name"), c("$.published_by.login"))), pod_author,
        ).alias("author"),
        per(
            text_or_empty(at("$.info.home_page"), at("$.info.project_url")), text_or_empty(r("$.homepage")),
            text_or_empty(r("$.pubspec.homepage"), r("$.pubspec.repository")), text_or_empty(at("$.crate.homepage")),
            text_or_empty(at("$.homepage")),
        ).alias("homepage"),
        per(
            pypi_repo_url(pypi_urls), text_or_object(release, "$.repository", "url"), text_or_empty(r("$.pubspec.repository")),
            text_or_empty(c("$.repository"), at("$.crate.repository")), text_or_empty(at("$.source.git")),
        ).alias("repository"),
        per(
            sdist, npm_scripts, F.lit(False), F.lit(False), truthy(doc, "$.prepare_command") | truthy(doc, "$.script_phases")
        ).alias("has_install_scripts"),
        per(
            F.coalesce(F.from_json(at("$.info.requires_dist"), "array<string>"), none), json_keys(release, "$.dependencies"),
            json_keys(release, "$.pubspec.dependencies"), none, json_keys(doc, "$.dependencies"),
        ).alias("dependencies"),
    )


def latest_version(documents: DataFrame) -> DataFrame:
    """Version of every recorded crate document."""
    return documents.select("ecosystem", "name", latest_crate_version(F.col("doc"), F.col("version")).alias("version"))
