"""One valid JSON document per scan, of any length, as ordered parts that are never collected.

A document is a head, its items in order with commas between, and a foot.  Items are joined in ranges of their order, so a
part has a bounded number of them, and only a row per range decides where a comma goes.  The parts of a scan in turn are the
document; :func:`write_documents` stores them so that a scan's files, one after the other, are it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Items that one part may hold.
WIDTH = 1024


def document_parts(scans: DataFrame, items: DataFrame, head: Column, foot: Column, width: int = WIDTH) -> DataFrame:
    """``scan_id, part, text``: ``items`` are scan_id, ord (different per scan) and item, a JSON text; ``head`` and ``foot`` are of ``scans``.

    A scan without items has a head and a foot.
    """
    ranged = items.groupBy("scan_id", F.floor(F.col("ord") / width).alias("range")).agg(F.array_sort(F.collect_list(F.struct("ord", "item"))).alias("items"))
    before = F.lag(F.lit(True)).over(Window.partitionBy("scan_id").orderBy("range"))  # a row per range
    listed = ranged.select("scan_id", F.col("range").alias("at"), F.when(before, ",").otherwise("").alias("comma"), F.array_join(F.transform("items", lambda i: i["item"]), ",").alias("text"))
    middle = listed.select("scan_id", F.lit(1).alias("kind"), "at", F.concat("comma", "text").alias("text"))
    none = F.lit(None).cast("bigint").alias("at")
    ends = scans.select("scan_id", F.lit(0).alias("kind"), none, head.alias("text")).unionByName(scans.select("scan_id", F.lit(2).alias("kind"), none, foot.alias("text")))
    return ends.unionByName(middle)


def numbered_parts(parts: DataFrame) -> DataFrame:
    """Parts with their number from 0; a row per range of items is numbered, not the items."""
    n = F.row_number().over(Window.partitionBy("scan_id").orderBy("kind", "at")) - 1
    return parts.select("scan_id", n.cast("bigint").alias("part"), "text")


def write_documents(parts: DataFrame, target: str) -> None:
    """A folder per scan below ``target``; its files in order of their names are the scan's document."""
    ordered = parts.repartitionByRange("scan_id", "kind", "at").sortWithinPartitions("scan_id", "kind", "at")
    ordered.select("scan_id", "text").write.partitionBy("scan_id").text(target)


def payload_parts(scans: DataFrame, packages: DataFrame, width: int = WIDTH) -> DataFrame:
    """Scan payloads: packages with their decisions, counts of outcomes and the scan's own decision.

    ``scans``: scan_id, lockfile, ecosystem, total, safe, suspicious, malicious, errors, outcome, exit_code; ``packages``: scan_id, ord,
    name, version, ecosystem, level, prefilter_reason, source_unavailable, verdict, confidence, outcome, exit_code, error.
    """
    entry = F.struct(
        F.struct("name", "version", "ecosystem").alias("package"),
        F.struct("level", F.col("prefilter_reason").alias("reason"), "source_unavailable").alias("prefilter"),
        F.when(F.col("verdict").isNotNull(), F.struct("verdict", "confidence")).alias("consensus"),
        F.col("outcome").alias("decision"), "exit_code", "error",
    )
    items = packages.select("scan_id", "ord", F.to_json(entry, {"ignoreNullFields": "false"}).alias("item"))
    head = F.concat(F.regexp_replace(F.to_json(F.struct("lockfile", "ecosystem")), r"\}$", ""), F.lit(',"packages":['))
    counts = F.to_json(F.struct(F.struct("total", "safe", "suspicious", "malicious", "errors").alias("summary"), F.col("outcome").alias("decision"), "exit_code"))
    return document_parts(scans, items, head, F.concat(F.lit("],"), F.substring(counts, 2, F.length(counts))), width)


#: Fixed values of the format.
SARIF_SCHEMA, SARIF_VERSION = "https://json.schemastore.org/sarif-2.1.0.json", "2.1.0"


def sarif_parts(scans: DataFrame, results: DataFrame, tool: str, tool_version: str, url: str, rule_id: str, description: str, width: int = WIDTH) -> DataFrame:
    """SARIF documents: the results of a scan (scan_id, ord, result as JSON) in one run of a tool with one rule."""
    rule = F.array(F.struct(F.lit(rule_id).alias("id"), F.struct(F.lit(description).alias("text")).alias("shortDescription")))
    driver = F.struct(F.lit(tool).alias("name"), F.lit(tool_version).alias("version"), F.lit(url).alias("informationUri"), rule.alias("rules"))
    start = F.to_json(F.struct(F.lit(SARIF_SCHEMA).alias("$schema"), F.lit(SARIF_VERSION).alias("version")))
    head = F.concat(
        F.regexp_replace(start, r"\}$", ""), F.lit(',"runs":[{"tool":'), F.to_json(F.struct(driver.alias("driver"))), F.lit(',"results":[')
    )
    return document_parts(scans, results.select("scan_id", "ord", F.col("result").alias("item")), head, F.lit("]}]}"), width)
