"""Detection rules as data: built-in rows, user rows, overrides and filters."""

from __future__ import annotations

import re
from dataclasses import dataclass, field, fields, replace

from pyspark.errors import IllegalArgumentException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkwarden import values as V

RULE_SCHEMA = (
    "id string, pattern string, severity string, scope string, ecosystem string, description string, "
    "tags array<string>, case_sensitive boolean"
)


@dataclass(frozen=True)
class Rule:
    """One detection rule.  ``anchors`` are optional literals every match contains (lower case)."""

    id: str
    pattern: str
    severity: str
    scope: str = "any"
    ecosystem: str = "*"
    description: str = ""
    tags: tuple[str, ...] = ()
    case_sensitive: bool = False
    anchors: list = field(default_factory=list, compare=False)


def builtin_rules() -> list[Rule]:
    return [
        Rule(
            id=id_,
            pattern=pattern,
            severity=severity,
            description=description,
            tags=tuple(tags),
            case_sensitive=id_ in V.CASE_SENSITIVE_RULES,
            anchors=anchors,
        )
        for id_, severity, description, tags, anchors, pattern in V.RULES
    ]


def select_rules(
    user: list[Rule] | None = None, ecosystem: str | None = None, disabled: list[str] | tuple[str, ...] = ()
) -> list[Rule]:
    """Built-in rules with user rules laid over them by id; rules whose pattern can't run are dropped."""
    chosen = {r.id: r for r in builtin_rules()}
    for rule in user or []:
        pattern = runnable(rule.pattern)
        if pattern is not None:
            chosen[rule.id] = replace(rule, pattern=pattern)
    return [
        r for r in chosen.values() if r.id not in disabled and (ecosystem is None or r.ecosystem in ("*", ecosystem))
    ]


def runnable(pattern: str | None) -> str | None:
    """A pattern as Spark's engine takes it, null if it doesn't.

    Named groups may be written either way.  The engine of the active session has the last word; without a session
    only the form is looked at.
    """
    if not isinstance(pattern, str):
        return None
    pattern = re.sub(r"\(\?P<(\w+)>", r"(?<\1>", pattern)
    spark = SparkSession.getActiveSession()
    try:
        if spark is not None:
            spark._jvm.java.util.regex.Pattern.compile(pattern)
        else:
            re.compile(re.sub(r"\(\?<(\w+)>", r"(?P<\1>", pattern))
    except (re.error, IllegalArgumentException):
        return None
    return pattern


def rule_list(rules: DataFrame) -> list[Rule]:
    """The rows of a rule table (configuration: a row per rule) as rules that a scan takes."""
    names = [f.name for f in fields(Rule)]
    rows = rules.select(*[c for c in rules.columns if c in names]).collect()
    return [Rule(**{k: tuple(v) if isinstance(v, list) else v for k, v in r.asDict().items()}) for r in rows]


def builtin_frame(spark: SparkSession) -> DataFrame:
    rows = [
        (r.id, r.pattern, r.severity, r.scope, r.ecosystem, r.description, list(r.tags), r.case_sensitive)
        for r in builtin_rules()
    ]
    return spark.createDataFrame(rows, RULE_SCHEMA)


def rules_dim(
    builtin: DataFrame, user: DataFrame, ecosystem: str | None = None, disabled: list[str] | tuple[str, ...] = ()
) -> DataFrame:
    """Rule table: user rows (in ``ord``) replace earlier rows of the same id.

    Rows without id, pattern, severity or scope are dropped before they can replace anything.
    """
    columns = [f.name for f in builtin.schema.fields]
    ranked = builtin.withColumn("_priority", F.lit(-1).cast("bigint")).unionByName(
        user.select(*columns, F.col("ord").cast("bigint").alias("_priority"))
    )
    valid = ranked.dropna(subset=["id", "pattern", "severity", "scope"])
    latest = valid.groupBy("id").agg(F.max_by(F.struct(*[c for c in columns if c != "id"]), "_priority").alias("_rule"))
    merged = latest.select("id", "_rule.*").withColumn("ecosystem", F.coalesce("ecosystem", F.lit("*")))
    if ecosystem is not None:
        merged = merged.filter(F.col("ecosystem").isin("*", ecosystem))
    if disabled:
        merged = merged.filter(~F.col("id").isin(list(disabled)))
    return merged.select(*columns)


def rule_listing(rules: DataFrame, tag: str | None = None) -> DataFrame:
    """Rules in id order, optionally only those that carry a tag."""
    chosen = rules if tag is None else rules.filter(F.array_contains("tags", tag))
    return chosen.select("id", "severity", "scope", F.array_join("tags", ", ").alias("tags"), "description").orderBy("id")


def rule_stats(rules: DataFrame, top_tags: int = 15) -> DataFrame:
    """Counts by severity and scope, and of the most common tags."""
    def counts(facet: str, column) -> DataFrame:
        return rules.select(F.lit(facet).alias("facet"), column.alias("value")).groupBy("facet", "value").agg(
            F.count("*").alias("n")
        )

    common = counts("tag", F.explode("tags")).orderBy(F.desc("n"), "value").limit(top_tags)
    return counts("severity", F.col("severity")).unionByName(counts("scope", F.col("scope"))).unionByName(common)
