"""A corpus pipeline: each stage works on all that the one before it kept."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkwarden.llm import copies, mixing, packing, quality, substrings
from sparkwarden.llm.common import discard, scope, stored
from sparkwarden.llm.queries import tokenizer_path

#: The columns that documents keep from stage to stage.
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules' posterior keeps; a document without a text fails."""
    return quality.judged(docs.select(*COLUMNS)).where("kept").select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: the one with the smallest doc_id.

    Near copies share 0.8 or more of their word shingles of five words; op8's few differing bits are no measure of that.
    Rows that repeat a doc_id, or have none, are documents of their own, in order of text.
    """
    rows = substrings.sequenced(docs.select(*COLUMNS))
    groups = copies.groups(rows.select(F.col("_seq").alias("doc_id"), "text"), width=5, similarity=0.8)
    first = groups.where("first = component_id").select(F.col("first").alias("_seq"))
    return rows.join(first, "_seq").select(*COLUMNS)


def repeated_substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the strings of 100 bytes that an earlier document, or an earlier place, has too; n_chars follows.

    A document of which nothing is left stays, with an empty text.
    """
    left = substrings.remaining(docs.select(*COLUMNS))
    return left.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def mixed_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    return mixing.mixed(docs.select(*COLUMNS))


def packed_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Place of every piece of every document of the mix."""
    return packing.packed(docs, tokenizer_path())


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

#: Scratch paths of the stages that have run, by place in the pipeline.
_scratch: dict[int, list[str]] = {}


def tidy(place: int, stage: Stage) -> Stage:
    """``stage``, whose docs are the written result of the stage before it: scratch of all stages before goes when it starts."""

    @wraps(stage)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        for earlier in [p for p in _scratch if p < place]:
            for path in _scratch.pop(earlier):
                discard(spark, path)
        with scope() as paths:
            out = stage(spark, docs, sf_dir)
        _scratch.setdefault(place, []).extend(paths)
        return out

    return run_stage


STAGES: list[tuple[str, Stage]] = [
    (stage.__name__, tidy(place, stage))
    for place, stage in enumerate((quality_rules, near_duplicates, repeated_substrings, mixed_sources, packed_sequences))
]

#: Exact substring removal and tokenizer ids are beyond SQL; tests hold each stage against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again before the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
