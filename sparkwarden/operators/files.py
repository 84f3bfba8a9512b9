"""Source files: path classes, admission, content sniffing, version differences, tree hashes.

A file table has ``package_id, ecosystem, path, content, size, ord``; ``ord`` is the position
of the file in its package.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkwarden import values as V
from sparkwarden.functions.ordered import running_total
from sparkwarden.functions.patterns import all_of, constant, contains_any, found, is_json, java, let, strings


# -- paths ------------------------------------------------------------------------------
def basename(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def last_suffix(name: Column) -> Column:
    """Lower-case text from the last dot of a file name, '' without a dot."""
    return F.when(F.contains(name, F.lit(".")), F.lower(F.concat(F.lit("."), F.element_at(F.split(name, r"\."), -1)))).otherwise("")


def path_suffix(name: Column) -> Column:
    """Like :func:`last_suffix`, but a leading or a trailing dot is no suffix."""
    return F.lower(F.regexp_extract(name, r"(?s)^.+(\.[^.]+)$", 1))


def path_depth(path: Column) -> Column:
    return F.size(F.split(path, "/")) - 1


def is_install_path(path: Column) -> Column:
    """Files that run by themselves when a package is installed or first imported."""
    name = basename(path)
    return (
        name.isin(V.INSTALL_NAMES)
        | path.endswith(".pth")
        | (name.isin(V.ROOT_INSTALL_NAMES) & (path_depth(path) <= 1))
    )


def in_skipped_dir(path: Column) -> Column:
    return F.arrays_overlap(F.split(path, "/"), strings(V.SKIP_DIRS))


def has_skipped_suffix(path: Column) -> Column:
    return last_suffix(basename(path)).isin(V.SKIP_SUFFIXES)


def classify_files(files: DataFrame) -> DataFrame:
    """Path classes of every file; reads no content."""
    path = F.col("path")
    return files.select(
        "package_id",
        "path",
        basename(path).alias("name"),
        last_suffix(basename(path)).alias("suffix"),
        path_depth(path).alias("depth"),
        is_install_path(path).alias("is_install"),
        in_skipped_dir(path).alias("skip_dir"),
        has_skipped_suffix(path).alias("skip_ext"),
    )


# -- admission --------------------------------------------------------------------------
def is_safe_path(path: Column) -> Column:
    return (F.length(path) > 0) & ~path.startswith("/") & ~F.array_contains(F.split(path, "/"), "..")


def admit_files(files: DataFrame, max_file: int | None = None, budget: int | None = None, key: str = "package_id") -> DataFrame:
    """Every file with ``refused``: why it would stay out, null for an admitted one.

    Without limits only unsafe paths are refused.  ``max_file`` refuses larger files, ``budget`` all files from where a
    package's running total of the others passes it.  Only packages whose total exceeds the budget need the
    running total, and it is computed on ``(key, ord, size)`` alone, so file contents are never shuffled by the window.
    """
    refused = F.when(~is_safe_path(F.col("path")), "unsafe path")
    if max_file is not None:
        refused = refused.when(F.col("size") > max_file, "oversized")
    marked = files.withColumn("refused", refused)
    if budget is None:
        return marked
    sizes = marked.filter("refused IS NULL").select(key, "ord", "size")
    over = sizes.groupBy(key).agg(F.sum("size").alias("_total")).filter(F.col("_total") > budget).select(key)
    running = running_total(sizes.join(over, key, "left_semi"), [key], "ord", "size", "_running")
    cuts = running.filter(F.col("_running") > budget).groupBy(key).agg(F.min("ord").alias("_cut"))
    late = F.when(F.col("ord") >= F.col("_cut"), "over budget")
    return marked.join(cuts, key, "left").withColumn("refused", F.coalesce("refused", late)).drop("_cut")


def oversized_flags(admission: DataFrame, key: str = "package_id") -> DataFrame:
    """``key, oversized, unavailable`` of packages with files that a limit refused: what :func:`prefilter.uninspected_override` takes."""
    hit = admission.filter(F.col("refused").isin("oversized", "over budget")).groupBy(key).agg(F.count("*").alias("_n"))
    message = F.concat(F.col("_n").cast("string"), F.lit(" file(s) above the size limits"))
    return hit.select(key, message.alias("oversized"), F.lit(None).cast("string").alias("unavailable"))


def size_budget(files: DataFrame, key: str = "package_id") -> DataFrame:
    """Running byte total of every package in file order."""
    return running_total(files.select(key, "ord", "size"), [key], "ord", "size", "running_bytes")


# -- content sniffing -------------------------------------------------------------------
def is_binary(content: Column) -> Column:
    """More than a tenth of the characters are control characters."""
    controls = F.regexp_count(content, F.lit(r"[\x00-\x08\x0e-\x1f]"))
    return (F.length(content) > 0) & (controls * 10 > F.length(content))


def content_type(content: Column) -> Column:
    """Language or format of a text, null when unknown or binary."""

    def sniff(t: Column) -> Column:
        languages = F.array(*[F.struct(F.lit(k).alias("k"), F.lit(java(r"^#!.*" + p)).alias("p")) for k, p in V.SHEBANGS])
        shebang = let(
            F.regexp_extract(t, r"(?d)^#!.*", 0),
            lambda head: F.get(F.filter(languages, lambda x: F.rlike(head, x["p"])), 0)["k"],
        )
        python = contains_any(t, ["import", "def", "class", "__name__"]) & found(t, V.PYTHON_PROBE, multiline=True)
        javascript = contains_any(t, ["require", "module.exports", "import", "export"]) & found(t, V.JS_PROBE, multiline=True)
        probed = (
            F.when(t.rlike(r"(?U)^[\s\x1c-\x1f]*[\[{]") & is_json(t), "json")
            .when(python, "python")
            .when(javascript, "javascript")
        )
        return F.when((F.length(t) == 0) | is_binary(t), None).otherwise(F.coalesce(F.when(t.startswith("#!"), shebang), probed))

    return let(content, sniff)


def suffix_type(suffix: Column) -> Column:
    """Type a known suffix stands for, else null."""
    return constant(V.SUFFIX_TYPES, "map<string,string>")[suffix]


def mismatch(path: Column, detected: Column) -> Column:
    """Description of code that hides behind another (or no) extension, else null."""

    def describe(f: Column) -> Column:
        found_, suffix, expected = f["detected"], f["suffix"], suffix_type(f["suffix"])
        return (
            F.when(suffix == "", F.concat(F.lit("extensionless file '"), f["name"], F.lit("' contains "), found_, F.lit(" code")))
            .when(expected.isNull(), F.concat(F.lit("extension '"), suffix, F.lit("' but content is "), found_))
            .when(
                expected != found_,
                F.concat(F.lit("extension '"), suffix, F.lit("' (expected "), expected, F.lit(") but content is "), found_),
            )
        )

    name = basename(path)
    facts = F.struct(name.alias("name"), path_suffix(name).alias("suffix"), detected.alias("detected"))
    return let(facts, lambda f: F.when(f["detected"].isin(V.CODE_TYPES), describe(f)))


def content_types(files: DataFrame) -> DataFrame:
    return files.select("package_id", "path", content_type(F.col("content")).alias("content_type"))


def extension_mismatch(files: DataFrame) -> DataFrame:
    """Files whose content is code of another kind than their extension says."""
    detected = content_type(F.col("content"))
    row = let(detected, lambda d: F.struct(d.alias("content_type"), mismatch(F.col("path"), d).alias("mismatch")))
    found_ = F.explode(F.filter(F.array(row), lambda r: r["mismatch"].isNotNull()))
    return files.select("package_id", "path", found_.alias("_f")).select("package_id", "path", "_f.*")


def disguised_files(files: DataFrame) -> DataFrame:
    """Mismatches judged by whole contents, outside pruned directories."""
    kept = files.filter(~F.arrays_overlap(F.split("path", "/"), strings(V.TREE_PRUNED_DIRS)))
    found_ = extension_mismatch(kept)
    return found_.select(
        "package_id",
        "path",
        F.concat(F.lit("disguised file: "), F.col("path"), F.lit(" — "), F.col("mismatch")).alias("finding"),
    )


# -- versions ---------------------------------------------------------------------------
def without_version_prefix(path: Column) -> Column:
    """Path without its first segment (``name-version/``)."""
    return F.regexp_replace(path, r"^[^/]*/", "")


def version_diff(files: DataFrame) -> DataFrame:
    """Added and changed files between the ``old`` and the ``new`` side of each package.

    Sides meet as digests, so the shuffle carries 32 bytes per file instead of its content.
    """
    digests = files.select(
        "package_id",
        "side",
        without_version_prefix(F.col("path")).alias("path"),
        F.unhex(F.sha2("content", 256)).alias("digest"),
    )
    new = digests.filter("side = 'new'").select("package_id", "path", F.col("digest").alias("new_digest"))
    old = digests.filter("side = 'old'").select("package_id", "path", F.col("digest").alias("old_digest"))
    status = F.when(F.col("old_digest").isNull(), "added").when(F.col("old_digest") != F.col("new_digest"), "changed")
    return new.join(old, ["package_id", "path"], "left").select("package_id", "path", status.alias("status")).filter(
        "status IS NOT NULL"
    )


# -- whole-package values ---------------------------------------------------------------
def _tree_digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One digest per package from rows sorted by package and path: nothing but the running digest is held."""
    package, digest = None, None
    for batch in batches:
        done: list[tuple[str, str]] = []
        for name, path, content in zip(*(batch.column(i) for i in range(3)), strict=True):
            if digest is None or name.as_py() != package:
                if digest is not None:
                    done.append((package, digest.hexdigest()))
                package, digest = name.as_py(), hashlib.sha256()
            digest.update((path.as_py() or "").encode() + b"\0" + (content.as_py() or "").encode() + b"\n")
        yield _digest_rows(done)
    if digest is not None:
        yield _digest_rows([(package, digest.hexdigest())])


def _digest_rows(rows: list[tuple[str, str]]) -> pa.RecordBatch:
    columns = [pa.array([r[i] for r in rows], pa.string()) for i in range(2)]
    return pa.RecordBatch.from_arrays(columns, ["package_id", "tree_sha256"])


def tree_hash(files: DataFrame) -> DataFrame:
    """SHA-256 over all files of a package in path order, whatever their size.

    A digest is one sequential pass; files are shuffled once by package, sorted (Spark spills), and fed to it as they come.
    """
    ordered = files.select("package_id", "path", "content").repartition("package_id").sortWithinPartitions("package_id", "path", "content")
    return ordered.mapInArrow(_tree_digests, "package_id string, tree_sha256 string")


def review_context(files: DataFrame, level: str = "l1_quick") -> DataFrame:
    """Source text of a package for a reviewer: risky files first, cut at the level's limit.

    Only files that start before the limit are gathered: a running total over lengths picks
    them, so the text assembled per package stays within the limit plus one admitted file.
    """
    limit = V.CONTEXT_LIMITS.get(level, V.CONTEXT_LIMITS["l1_quick"])
    priority = F.when(contains_any(F.col("path"), V.CONTEXT_PRIORITY), 0).otherwise(1)
    block = F.concat(F.lit("### "), F.col("path"), F.lit("\n```\n"), F.col("content"), F.lit("\n```\n"))
    blocks = files.select("package_id", "ord", "path", "content", priority.alias("_prio"), F.length(block).alias("_len"))
    lengths = blocks.select("package_id", "ord", "_prio", "_len")
    firsts = running_total(lengths.filter("_prio = 0"), ["package_id"], "ord", "_len", "_end")
    rest = running_total(lengths.filter("_prio = 1"), ["package_id"], "ord", "_len", "_end")
    prior = lengths.filter("_prio = 0").groupBy("package_id").agg(F.sum("_len").alias("_shift"))
    rest = rest.join(prior, "package_id", "left").withColumn("_end", F.col("_end") + F.coalesce("_shift", F.lit(0)))
    cols = ["package_id", "ord", (F.col("_end") - F.col("_len")).alias("_start")]
    wanted = firsts.select(*cols).unionByName(rest.select(*cols)).filter(F.col("_start") <= limit)
    # Blocks are joined by one newline each; ignoring it in _start only gathers a little more.
    total = F.sum(F.col("_len")) + F.count("*") - 1
    totals = lengths.groupBy("package_id").agg(total.alias("_total"))
    texts = (
        blocks.join(wanted, ["package_id", "ord"])
        .groupBy("package_id")
        .agg(F.array_sort(F.collect_list(F.struct("_prio", "ord", F.substring(block, 1, limit + 1).alias("text")))).alias("_blocks"))
    )
    text = F.array_join(F.transform("_blocks", lambda b: b["text"]), "\n")
    marker = f"\n\n... [truncated at {limit} chars for {level} analysis]"
    return texts.join(totals, "package_id").select(
        "package_id",
        F.when(F.col("_total") > limit, F.concat(F.substring(text, 1, limit), F.lit(marker))).otherwise(text).alias("context"),
    )


def truncate(text: Column, level: str = "l1_quick") -> Column:
    """Text cut at a level's limit, with a marker when something was cut."""
    limit = V.CONTEXT_LIMITS.get(level, V.CONTEXT_LIMITS["l1_quick"])
    marker = f"\n\n... [truncated at {limit} chars for {level} analysis]"
    return F.when(F.length(text) > limit, F.concat(F.substring(text, 1, limit), F.lit(marker))).otherwise(text)


def truncate_context(texts: DataFrame, level: str = "l1_quick") -> DataFrame:
    return texts.withColumn("content", truncate(F.col("content"), level))


def podspec_divergence(files: DataFrame, podspecs: DataFrame, own_prefix: str = "__risk__/") -> DataFrame:
    """Advertised source directories that the archive of a pod does not contain.

    ``podspecs`` has ``package_id, source_files ARRAY<STRING>``.  Segments are distinct per
    package before anything is joined; an ``export-ignore`` attribute silences a package.
    """
    real = files.filter(~F.col("path").startswith(own_prefix))
    segments = (
        real.filter(path_depth(F.col("path")) >= 1)
        .select("package_id", F.split("path", "/")[1].alias("top"))
        .distinct()
    )
    silenced = real.filter(F.col("path").endswith(".gitattributes") & F.contains("content", F.lit("export-ignore"))).select(
        "package_id"
    )
    top = F.trim(F.rtrim(F.split("glob", "/")[0], F.lit("*")))
    advertised = (
        podspecs.select("package_id", F.posexplode("source_files").alias("pos", "glob"))
        .select("package_id", "pos", top.alias("top"))
        .filter(all_of([F.length("top") > 0, F.col("top") != "."]))
    )
    missing = advertised.join(segments, ["package_id", "top"], "left_anti").join(silenced, "package_id", "left_anti")
    # One podspec row is the bound of this group: the list it advertised.
    names = F.transform(F.array_sort(F.collect_list(F.struct("pos", "top"))), lambda m: F.concat(F.lit("'"), m["top"], F.lit("'")))
    return missing.groupBy("package_id").agg(
        F.concat(
            F.lit("podspec-vs-tarball path divergence: podspec advertises source_files paths ["),
            F.array_join(names, ", "),
            F.lit("] that are missing from the GitHub tarball"),
        ).alias("divergence")
    )
