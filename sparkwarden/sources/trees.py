"""Source trees on a file system."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparkwarden import values as V
from sparkwarden.functions.ordered import running_total
from sparkwarden.functions.patterns import strings
from sparkwarden.operators.files import basename, content_type


def read_tree(spark: SparkSession, root: str) -> DataFrame:
    """Files below a root as ``package_id, path, content``; the first directory names the package."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    relative = F.regexp_replace(F.substring_index("path", root.rstrip("/") + "/", -1), "^/+", "")
    return files.select(
        F.substring_index(relative, "/", 1).alias("package_id"),
        F.regexp_replace(relative, "^[^/]*/", "").alias("path"),
        F.make_valid_utf8(F.col("content").cast("string")).alias("content"),
    )


def exact_suffix(name: Column) -> Column:
    """Suffix in its own case; a leading or trailing dot is no suffix."""
    return F.regexp_extract(name, r"(?s)^.+(\.[^.]+)$", 1)


def walk_order(path: Column) -> Column:
    """Sort key of a top-down walk: the files of a directory before its subdirectories."""
    parts = F.split(path, "/")
    last = F.size(parts) - 1
    return F.transform(parts, lambda p, i: F.concat(F.when(i == last, "0").otherwise("1"), p))


def tree_files(files: DataFrame, budget: int | None = None) -> DataFrame:
    """Files of source trees worth scanning (``package_id, path, content, size, refused``).

    Documents, data and files without suffix stay only if they read as code.  With a byte budget, files beyond it
    are marked in ``refused``; just the trees beyond the budget are ordered, and that on their sizes alone.
    """
    parts = F.split("path", "/")
    parents = F.slice(parts, 1, F.size(parts) - 1)
    open_dirs = files.filter(~F.arrays_overlap(parents, strings(V.TREE_PRUNED_DIRS)))
    suffix = exact_suffix(basename(F.col("path")))
    doubtful = (suffix == "") | suffix.isin(V.TREE_SNIFF_SUFFIXES)
    code = content_type(F.col("content")).isin(V.CODE_TYPES)
    kept = open_dirs.filter(~doubtful | F.coalesce(code, F.lit(False))).withColumn("size", F.octet_length("content").cast("bigint"))
    if budget is None:
        return kept.withColumn("refused", F.lit(None).cast("string"))
    sizes = kept.select("package_id", "path", "size")
    over = sizes.groupBy("package_id").agg(F.sum("size").alias("_t")).filter(F.col("_t") > budget).select("package_id")
    place = Window.partitionBy("package_id").orderBy(walk_order(F.col("path")))
    placed = sizes.join(over, "package_id", "left_semi").withColumn("ord", F.row_number().over(place).cast("bigint"))
    running = running_total(placed, ["package_id"], "ord", "size", "_running")
    beyond = running.filter(F.col("_running") > budget).select("package_id", "path", F.lit("over budget").alias("refused"))
    return kept.join(beyond, ["package_id", "path"], "left")
