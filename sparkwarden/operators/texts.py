"""Suspicious and hidden text in prompts, rules, configs and any other file."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkwarden import values as V
from sparkwarden.functions import patterns as P
from sparkwarden.operators import files as FL

CONTEXT_CHARS = 40


# -- suspicious patterns ----------------------------------------------------------------
TESTS = [([anchor], P.java(pattern, ignore_case=True)) for _, anchor, pattern in V.SUSPICIOUS_TEXT]


def match_counts_of(content: Column) -> Column:
    """Array of (description, n) over the patterns that occur at all."""
    descriptions = P.strings([d for d, _, _ in V.SUSPICIOUS_TEXT])
    patterns = P.strings([p for _, p in TESTS])
    return F.transform(
        P.matching(content, TESTS),
        lambda i: F.struct(
            F.element_at(descriptions, i + 1).alias("description"),
            F.size(F.regexp_extract_all(content, F.element_at(patterns, i + 1), F.lit(0))).cast("bigint").alias("n"),
        ),
    )


def suspicious_counts(files: DataFrame) -> DataFrame:
    """Matches of every suspicious pattern per text."""
    keys = [c for c in files.columns if c != "content"]
    return files.select(*keys, F.explode(match_counts_of(F.col("content"))).alias("_m")).select(*keys, "_m.*")


def any_suspicious(content: Column) -> Column:
    """Whether a text matches at all: native, so that only such texts reach Python."""
    return F.size(P.matching(content, TESTS)) > 0


def _findings(contents: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Matches with their surroundings; match positions are not available natively."""
    compiled = [(re.compile(p, re.IGNORECASE), d) for d, _, p in V.SUSPICIOUS_TEXT]

    def contexts(text: str) -> list[str]:
        return [
            f"{label}: ...{_around(text, m.start(), m.end())}..."
            for pattern, label in compiled
            for m in pattern.finditer(text)
        ]

    for batch in contents:
        yield batch.map(contexts)


def _around(text: str, start: int, end: int) -> str:
    return text[max(0, start - CONTEXT_CHARS) : end + CONTEXT_CHARS].replace("\n", " ").strip()


def suspicious_findings(files: DataFrame) -> DataFrame:
    """Every suspicious match with 40 characters of context on both sides."""
    keys = [c for c in files.columns if c != "content"]
    hits = files.filter(any_suspicious(F.col("content")))
    return hits.select(*keys, F.explode(F.pandas_udf(_findings, "array<string>")("content")).alias("finding"))


# -- hidden text ------------------------------------------------------------------------
def hidden_text(texts: DataFrame) -> DataFrame:
    """Counts of suspicious matches, hidden Unicode characters and long base64-like runs."""
    keys = [c for c in texts.columns if c != "content"]

    def counts(t: Column) -> dict[str, Column]:
        return {
            "n_suspicious": F.aggregate(match_counts_of(t), F.lit(0).cast("bigint"), lambda acc, m: acc + m["n"]),
            "n_hidden": (F.length(t) - F.length(F.translate(t, V.HIDDEN_UNICODE, ""))).cast("bigint"),
            "n_base64": F.size(base64_runs(t)).cast("bigint"),
        }

    row = P.kept(counts(F.col("content")), lambda r: (r["n_suspicious"] > 0) | (r["n_hidden"] > 0) | (r["n_base64"] > 0))
    return texts.select(*keys, row.alias("_n")).select(*keys, "_n.*")


def base64_runs(content: Column) -> Column:
    return F.regexp_extract_all(content, F.lit(V.BASE64_RUN), F.lit(0))


def encoded_runs(texts: DataFrame) -> DataFrame:
    """The first 50 characters of every base64-like run."""
    keys = [c for c in texts.columns if c != "content"]
    return texts.select(*keys, F.explode(base64_runs(F.col("content"))).alias("_run")).select(
        *keys, F.concat(F.lit("possible base64-encoded payload: "), F.substring("_run", 1, 50), F.lit("...")).alias("finding")
    )


# -- configs ----------------------------------------------------------------------------
def _commands(value: object, path: str, out: list[dict]) -> None:
    """Commands in a JSON document, in walking order."""
    if isinstance(value, dict):
        command, args = value.get("command", ""), value.get("args", [])
        if isinstance(command, str) and command:
            words = [str(a) for a in args] if isinstance(args, list) else None
            out.append({"path": path or "root", "command": command if words is None else command + " " + " ".join(words)})
        for key, child in value.items():
            _commands(child, f"{path}.{key}" if path else key, out)
    elif isinstance(value, list):
        for i, child in enumerate(value):
            _commands(child, f"{path}[{i}]", out)


def _config_walk(contents: Iterator[pd.Series]) -> Iterator[pd.Series]:
    def walk(text: str | None) -> list[dict]:
        out: list[dict] = []
        if text is None:
            return out
        try:
            _commands(json.loads(text), "", out)
        except (ValueError, RecursionError):  # not JSON, or nested beyond what can be walked: no commands
            return []
        return out

    for batch in contents:
        yield batch.map(walk)


def config_commands(configs: DataFrame, limit: int | None = None) -> DataFrame:
    """Findings in agent configs: commands first, then raw text whose prefix is new.

    Command findings all start with the server name, so a raw finding, which starts with its
    pattern description, is new exactly when no such server name exists.
    """
    return command_findings(configs, limit).unionByName(suspicious_findings(configs))


def command_findings(configs: DataFrame, limit: int | None = None) -> DataFrame:
    """Suspicious commands of agent configs: whole, or their first ``limit`` characters and how many are left out."""
    keys = [c for c in configs.columns if c != "content"]
    walked = configs.select(*keys, "content", F.pandas_udf(_config_walk, "array<struct<path:string,command:string>>")("content").alias("commands"))
    def shown(command: Column) -> Column:
        if limit is None:
            return command
        more = F.concat(F.substring(command, 1, limit), F.lit("... ["), (F.length(command) - limit).cast("string"), F.lit(" more characters]"))
        return F.when(F.length(command) > limit, more).otherwise(command)

    tests = lambda c: F.array_compact(
        F.array(*[
            F.when(
                P.found(c["command"], p, ignore_case=True),
                F.concat(F.lit("MCP server "), c["path"], F.lit(f": {d} in command: "), shown(c["command"])),
            )
            for d, _, p in V.SUSPICIOUS_TEXT
        ])
    )
    return walked.select(*keys, F.explode(F.flatten(F.transform("commands", tests))).alias("finding"))


# -- files ------------------------------------------------------------------------------
def file_findings(files: DataFrame) -> DataFrame:
    """Severity of every suspicious file: HIGH for disguised code, else MEDIUM for text hits."""
    content = F.col("content")
    found = {
        "mismatch": FL.mismatch(F.col("path"), FL.content_type(content)),
        "suspicious": any_suspicious(content),
    }
    row = P.kept(found, lambda r: r["mismatch"].isNotNull() | r["suspicious"])
    judged = files.select("package_id", "path", row.alias("_f")).select("package_id", "path", "_f.*")
    return judged.withColumn("severity", F.when(F.col("mismatch").isNotNull(), "HIGH").otherwise("MEDIUM"))


def scan_exit_code(findings: DataFrame) -> DataFrame:
    """2 with any HIGH finding, 1 with any finding, 0 without."""
    return findings.agg(
        F.count("*").alias("n_findings"),
        F.when(F.count_if(F.col("severity") == "HIGH") > 0, 2).when(F.count("*") > 0, 1).otherwise(0).alias("exit_code"),
    )
