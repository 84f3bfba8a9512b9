"""Reviewer replies and votes: parsing, contradiction check, weighted consensus."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkwarden import values as V
from sparkwarden.functions import patterns as P

_FENCED = r"```(?:json)?\s*(\{[^`]*\})\s*```"


def _embedded_objects(replies: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """The first JSON object inside each text, or None.

    A JSON object that starts at a given brace ends at one place only, so decoding from each
    opening brace finds what trying every closing brace would.  A brace without a key or its closing brace
    after it starts no object and is passed over, so a run of open braces costs one search.
    """
    decoder = json.JSONDecoder()
    start = re.compile(r'\{(?=[ \t\n\r]*["}])')

    def find(text: str | None) -> str | None:
        for brace in start.finditer(text or ""):
            try:
                _, end = decoder.raw_decode(text, brace.start())
                return text[brace.start() : end]
            except RecursionError:  # nested beyond what a reply may be: no object
                return None
            except ValueError:
                continue
        return None

    for batch in replies:
        yield batch.map(find)


def reply_json(replies: DataFrame) -> DataFrame:
    """Adds ``doc``: the JSON of a reply that is JSON, fences JSON, or holds it in prose.

    The first two cases are native; only the remaining replies with a brace reach Python.
    """
    raw = F.col("reply")
    whole = F.when(P.is_json(P.strip(raw)), P.strip(raw))
    fenced = P.let(P.first(raw, _FENCED, dotall=True), lambda t: F.when((t != "") & P.is_json(t), t))
    native = replies.select("*", P.once(F.coalesce(whole, fenced)).alias("doc"))
    left = F.when(F.col("doc").isNull() & raw.contains("{"), raw)
    return native.withColumn("doc", F.coalesce("doc", F.pandas_udf(_embedded_objects, "string")(left)))


def contradiction(reasoning: Column) -> Column:
    """The first word of malice in a reasoning, null without one."""
    return F.get(F.filter(P.strings(V.CONTRADICTION_WORDS), lambda k: F.contains(F.lower(reasoning), k)), 0)


def contradicted_votes(votes: DataFrame) -> DataFrame:
    """Safe votes whose reasoning names malice become suspicious and gain a signal."""
    word = contradiction(F.col("reasoning"))
    judged = votes.withColumn("_word", F.when(F.col("verdict") == "safe", word))
    note = F.concat(F.lit("output_validation(HIGH): verdict 'safe' contradicts reasoning containing '"), F.col("_word"), F.lit("'"))
    changed = F.col("_word").isNotNull()
    return (
        judged.withColumn("verdict", F.when(changed, "suspicious").otherwise(F.col("verdict")))
        .withColumn("signals", F.when(changed, F.concat("signals", F.array(note))).otherwise(F.col("signals")))
        .drop("_word")
    )


def normalise_votes(replies: DataFrame) -> DataFrame:
    """Votes from raw replies: verdict, confidence in 0..1, reasoning and signals."""
    doc = F.when(F.col("doc").startswith("{"), F.col("doc"))
    fields = F.from_json(doc, "verdict string, confidence string, reasoning string, risk_signals array<string>")
    keys = [c for c in replies.columns if c != "reply"]
    rows = reply_json(replies).select(*keys, "doc", P.once(fields).alias("_f"))
    # A missing confidence counts as a half, an unusable one spoils the vote.
    stated = F.contains("doc", F.lit('"confidence"'))
    given = F.when(F.col("_f.confidence").isNotNull() | stated, F.col("_f.confidence").try_cast("double")).otherwise(0.5)
    valid = F.col("_f").isNotNull() & given.isNotNull()
    verdict = F.lower("_f.verdict")
    none = F.array().cast("array<string>")
    parsed = rows.select(
        *keys,
        F.when(valid & verdict.isin("safe", "suspicious", "malicious"), verdict).otherwise("error").alias("verdict"),
        F.when(valid, F.least(F.greatest(given, F.lit(0.0)), F.lit(1.0))).otherwise(0.0).alias("confidence"),
        F.coalesce("_f.reasoning", F.lit("")).alias("reasoning"),
        F.coalesce("_f.risk_signals", none).alias("signals"),
    )
    return contradicted_votes(parsed)


def consensus(
    votes: DataFrame,
    weights: dict[str, float],
    malicious: float = V.MALICIOUS_SHARE,
    suspicious: float = V.SUSPICIOUS_SHARE,
) -> DataFrame:
    """Weighted verdict per package; ``weights`` are configured per reviewer, others weigh 1.

    Shares are compared after rounding to nine places, so that the order in which partial sums
    meet cannot move a verdict across a threshold.
    """
    cast = votes.select("package_id", "model", "verdict", "confidence")
    valid = F.col("verdict") != "error"
    table = F.create_map(*[F.lit(x) for m, w in weights.items() for x in (m, float(w))]) if weights else None
    weight = F.lit(1.0) if table is None else F.coalesce(table[F.col("model")], F.lit(1.0))
    pull = weight * F.col("confidence")

    def pulled(verdict: str) -> Column:
        return F.sum(F.when(F.col("verdict") == verdict, pull).otherwise(0.0))

    sums = cast.groupBy("package_id").agg(
        F.count_if(valid).alias("n_votes"),
        F.sum(F.when(valid, pull).otherwise(0.0)).alias("_total"),
        pulled("malicious").alias("_malicious"),
        pulled("suspicious").alias("_suspicious"),
        pulled("safe").alias("_safe"),
        (F.max(F.col("verdict") == "malicious") & F.max(F.col("verdict") == "safe")).alias("has_disagreement"),
        F.avg(F.when(valid, F.col("confidence"))).alias("_mean"),
        F.max(F.when(valid, F.col("verdict"))).alias("_only"),
    )
    share = lambda c: F.when(F.col("_total") > 0, F.round(F.col(c) / F.col("_total"), 9)).otherwise(0.0)
    verdict = (
        F.when(F.col("n_votes") == 0, "error")
        .when(F.col("n_votes") == 1, F.col("_only"))
        .when(F.col("has_disagreement"), "needs_human_review")
        .when(share("_malicious") > malicious, "malicious")
        .when(share("_suspicious") > suspicious, "suspicious")
        .otherwise("safe")
    )
    confidence = (
        F.when(F.col("n_votes") == 0, 0.0)
        .when((F.col("n_votes") == 1) | F.col("has_disagreement"), F.col("_mean"))
        .when(F.col("verdict") == "malicious", share("_malicious"))
        .when(F.col("verdict") == "suspicious", share("_suspicious"))
        .otherwise(share("_safe"))
    )
    advice = F.create_map(*[F.lit(x) for pair in V.RECOMMENDATIONS.items() for x in pair])
    return sums.withColumn("verdict", verdict).select(
        "package_id",
        "verdict",
        confidence.alias("confidence"),
        "has_disagreement",
        "n_votes",
        F.coalesce(advice[F.col("verdict")], F.lit("")).alias("recommendation"),
    )


def signal_union(votes: DataFrame) -> DataFrame:
    """Distinct signals of the valid votes of a package with the position of their first use."""
    return (
        votes.filter("verdict <> 'error'")
        .select("package_id", "pos", F.explode("signals").alias("signal"))
        .groupBy("package_id", "signal")
        .agg(F.min("pos").alias("first_pos"))
    )
