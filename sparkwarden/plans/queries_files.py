"""Queries over source files: rules, behaviours, evasion, prefilter."""

from __future__ import annotations

import io
import tarfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkwarden import rules as R
from sparkwarden.operators import evasion as EV
from sparkwarden.operators import files as FL
from sparkwarden.operators import names as N
from sparkwarden.operators import prefilter as PF
from sparkwarden.operators import scan as SC
from sparkwarden.operators import texts as TX
from sparkwarden.sources import archives as AR
from sparkwarden.sources import trees as TR
from sparkwarden.plans.queries import query
from sparkwarden.plans.queries_names import popular_names
from sparkwarden.plans.views import AS_OF, spark_view, tables

# Prose lines stay below the default of 5.5 bits; 4.5 makes the query say something.
QUERY_ENTROPY = 4.5


def joined(df: DataFrame, *columns: str) -> DataFrame:
    """Render array columns as text, so that every engine can compare them."""
    for c in columns:
        df = df.withColumn(c, F.array_join(c, ","))
    return df


def shown(df: DataFrame) -> DataFrame:
    return df.select("package_id", "path", "category", "severity", "text")


@query
def package_risk(spark: SparkSession, sf: str) -> DataFrame:
    """Flagship: every file signal of every package, its level and its decision."""
    signals = PF.file_signals(spark_view(spark, sf, "v_files"), AS_OF, entropy_threshold=QUERY_ENTROPY)
    counts = PF.package_counts(spark_view(spark, sf, "v_packages"), signals)
    rank = PF.risk_rank(F.col("n_high"), F.col("n_medium"), F.col("n_typosquat"), F.col("n_signals"))
    levels = counts.withColumn("level", PF.P.severity_name(rank)).withColumn(
        "reason",
        F.when(F.col("n_signals") == 0, "No risk signals detected").otherwise(F.concat(F.lit("Found "), F.col("n_signals").cast("string"), F.lit(" risk signal(s)"))),
    )
    return PF.decide_prefilter(levels)


@query
def classify_files(spark, sf):
    return FL.classify_files(spark_view(spark, sf, "v_files"))


#: Size limits of a file and of a package that the queries set.
MAX_FILE, BUDGET = 30_000, 60_000


@query
def admit_files(spark, sf):
    admitted = FL.admit_files(spark_view(spark, sf, "v_files"), max_file=MAX_FILE, budget=BUDGET)
    return admitted.select("package_id", "path", "size", "ord", "refused")


@query
def size_budget(spark, sf):
    return FL.size_budget(spark_view(spark, sf, "v_files"))


@query
def rules_dim(spark, sf):
    user = spark_view(spark, sf, "v_user_rules").withColumn("tags", F.array(F.lit("site"), F.col("severity")))
    return joined(R.rules_dim(R.builtin_frame(spark), user, disabled=["site-3"]), "tags")


@query
def rules_override(spark, sf):
    user = spark_view(spark, sf, "v_user_rules").withColumn("tags", F.array(F.lit("site")))
    return R.rules_dim(R.builtin_frame(spark), user, ecosystem="npm").select("id", "pattern", "severity")


@query
def rule_listing(spark, sf):
    user = spark_view(spark, sf, "v_user_rules").withColumn("tags", F.array(F.lit("site"), F.lit("execution")))
    return R.rule_listing(R.rules_dim(R.builtin_frame(spark), user), tag="execution")


@query
def rule_stats(spark, sf):
    user = spark_view(spark, sf, "v_user_rules").withColumn("tags", F.array(F.lit("site"), F.col("severity")))
    return R.rule_stats(R.rules_dim(R.builtin_frame(spark), user))


@query
def rule_scan(spark, sf):
    return shown(SC.rule_scan(spark_view(spark, sf, "v_files")))


@query
def rule_scan_user(spark, sf):
    """The scan with a rule table laid over the built-in rules."""
    user = spark_view(spark, sf, "v_user_rules").withColumn("tags", F.array(F.lit("site")))
    merged = R.rule_list(R.rules_dim(R.builtin_frame(spark), user))
    return shown(SC.rule_scan(spark_view(spark, sf, "v_files"), R.select_rules(merged)))


@query
def file_tags(spark, sf):
    return joined(SC.file_tags(spark_view(spark, sf, "v_files")), "rule_ids", "tags")


@query
def compound_signals(spark, sf):
    return shown(SC.compound_signals(spark_view(spark, sf, "v_files")))


@query
def behaviour_sets(spark, sf):
    return joined(SC.behaviour_sets(spark_view(spark, sf, "v_files")), "behaviours")


@query
def attack_chains(spark, sf):
    return shown(SC.attack_chains(spark_view(spark, sf, "v_files")))


@query
def entropy_lines(spark, sf):
    docs = tables(spark, sf, "documents").select("doc_id", F.col("text").alias("content"))
    return SC.entropy_lines(docs, QUERY_ENTROPY).withColumn("entropy", F.round("entropy", 6))


@query
def crate_risks(spark, sf):
    return shown(SC.crate_risks(spark_view(spark, sf, "v_files")))


@query
def pod_risks(spark, sf):
    return shown(SC.pod_risks(spark_view(spark, sf, "v_files")))


@query
def content_type(spark, sf):
    return FL.content_types(spark_view(spark, sf, "v_files"))


@query
def extension_mismatch(spark, sf):
    return FL.extension_mismatch(spark_view(spark, sf, "v_files"))


@query
def disguised_files(spark, sf):
    return FL.disguised_files(spark_view(spark, sf, "v_files"))


@query
def version_diff(spark, sf):
    return FL.version_diff(spark_view(spark, sf, "v_versions"))


@query
def tree_hash(spark, sf):
    return FL.tree_hash(spark_view(spark, sf, "v_files"))


@query
def review_context(spark, sf):
    return FL.review_context(spark_view(spark, sf, "v_files"), "l3_expert")


@query
def truncate_context(spark, sf):
    docs = tables(spark, sf, "documents").select("doc_id", F.col("text").alias("content"))
    return FL.truncate_context(docs)


@query
def podspec_divergence(spark, sf):
    files = spark_view(spark, sf, "v_files")
    specs = (
        spark_view(spark, sf, "v_packages")
        .filter("ecosystem = 'cocoapods'")
        .select("package_id", F.array(F.lit("src/**/*.m"), F.lit("Classes*/x"), F.lit("./y"), F.lit("lib")).alias("source_files"))
    )
    return FL.podspec_divergence(files, specs)


@query
def evasion_static(spark, sf):
    return EV.evasion_static(spark_view(spark, sf, "v_files"), AS_OF).drop("key")


@query
def collapse_signals(spark, sf):
    signals = EV.evasion_static(spark_view(spark, sf, "v_files"), AS_OF)
    return EV.collapse_signals(signals, threshold=3)


@query
def category_severity(spark, sf):
    static = EV.evasion_static(spark_view(spark, sf, "v_files"), AS_OF)
    return EV.category_severity(static, _observed(spark, sf))


@query
def evasion_gate(spark, sf):
    static = EV.evasion_static(spark_view(spark, sf, "v_files"), AS_OF)
    categories = EV.category_severity(static, _observed(spark, sf))
    verdicts = spark_view(spark, sf, "v_packages").select(
        "package_id",
        F.when(F.col("k") % 5 == 0, "malicious").when(F.col("k") % 2 == 0, "needs_review").otherwise("safe").alias("outcome"),
        F.when(F.col("k") % 3 == 0, "Darwin").otherwise("Linux").alias("platform"),
    )
    return EV.evasion_gate(verdicts, categories)


def _observed(spark, sf):
    """Categories seen at run time, for packages chosen by number."""
    packages = spark_view(spark, sf, "v_packages")
    return packages.select(
        "package_id", F.when(F.col("k") % 3 == 0, "anti_debug").when(F.col("k") % 3 == 1, "env_mutation").otherwise("direct_xpc").alias("category")
    )


@query
def risk_level(spark, sf):
    signals = PF.file_signals(spark_view(spark, sf, "v_files"), AS_OF, entropy_threshold=QUERY_ENTROPY)
    return PF.risk_levels(spark_view(spark, sf, "v_packages"), signals)


@query
def allow_block(spark, sf):
    return PF.allow_block(spark_view(spark, sf, "v_packages"), spark_view(spark, sf, "v_lists"))


@query
def metadata_anomalies(spark, sf):
    return PF.metadata_anomalies(spark_view(spark, sf, "v_packages"))


def prefiltered(spark: SparkSession, sf: str) -> DataFrame:
    """Prefilter rows of every package: files, metadata, lists and look-alike names."""
    packages = spark_view(spark, sf, "v_packages")
    return PF.prefilter(
        packages,
        spark_view(spark, sf, "v_files"),
        spark_view(spark, sf, "v_lists"),
        AS_OF,
        typosquats=N.typosquat(packages, popular_names(spark, sf)),
        entropy_threshold=QUERY_ENTROPY,
    )


@query
def prefilter(spark, sf):
    return prefiltered(spark, sf).select("package_id", "level", "passed", "needs_review", "reason")


@query
def level_gate(spark, sf):
    return PF.level_gate(prefiltered(spark, sf)).select("package_id", "level")


@query
def decide_prefilter(spark, sf):
    return PF.decide_prefilter(prefiltered(spark, sf))


def source_flags(spark: SparkSession, sf: str) -> DataFrame:
    packages = spark_view(spark, sf, "v_packages")
    return packages.select(
        "package_id",
        F.when(F.col("k") % 23 == 0, F.concat(F.lit("too large: "), F.col("name"))).alias("oversized"),
        F.when(F.col("k") % 19 == 0, F.concat(F.lit("404: "), F.col("name"))).alias("unavailable"),
    )


@query
def uninspected_override(spark, sf):
    return PF.uninspected_override(prefiltered(spark, sf), source_flags(spark, sf))


# -- text -------------------------------------------------------------------------------
@query
def suspicious_text(spark, sf):
    return TX.suspicious_counts(spark_view(spark, sf, "v_files").select("package_id", "path", "content"))


@query
def suspicious_findings(spark, sf):
    return TX.suspicious_findings(spark_view(spark, sf, "v_files").select("package_id", "path", "content"))


@query
def hidden_text(spark, sf):
    docs = tables(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("content"))
    return TX.hidden_text(docs)


@query
def encoded_runs(spark, sf):
    pages = tables(spark, sf, "pages").select(F.col("page_id").alias("id"), F.col("html").alias("content"))
    docs = tables(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("content"))
    return TX.encoded_runs(docs.unionByName(pages))


@query
def command_findings(spark, sf):
    return TX.command_findings(spark_view(spark, sf, "v_configs"))


@query
def config_commands(spark, sf):
    return TX.config_commands(spark_view(spark, sf, "v_configs"))


@query
def file_findings(spark, sf):
    return TX.file_findings(spark_view(spark, sf, "v_files"))


@query
def scan_exit_code(spark, sf):
    return TX.scan_exit_code(TX.file_findings(spark_view(spark, sf, "v_files")))


# -- sources ----------------------------------------------------------------------------
def _tarballs(spark, sf):
    """The files of every package packed into one archive (at most 26 files each)."""
    files = spark_view(spark, sf, "v_files").select("package_id", F.struct("ord", "path", "content").alias("f"))
    packed = files.groupBy("package_id").agg(F.array_sort(F.collect_list("f")).alias("files"))
    return packed.select(F.concat("package_id", F.lit(".tgz")).alias("archive"), "files").mapInArrow(_packed, "archive string, content binary")


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def pack(files) -> bytes:
        out = io.BytesIO()
        with tarfile.open(fileobj=out, mode="w:gz") as tar:
            for f in files:
                f = f.as_py()
                data = f["content"].encode()
                info = tarfile.TarInfo(f["path"])
                info.size = len(data)
                tar.addfile(info, io.BytesIO(data))
        return out.getvalue()

    rows = ((archive.as_py(), pack(files)) for batch in batches for archive, files in zip(batch.column(0), batch.column(1), strict=True))
    yield from AR.batched(rows, pa.schema([("archive", pa.string()), ("content", pa.binary())]))


@query
def archive_files(spark, sf):
    rows = AR.archive_files(AR.unpack_archives(_tarballs(spark, sf)))
    return rows.select("archive", "path", "size", F.sha2("content", 256).alias("digest"))


@query
def archive_manifest(spark, sf):
    rows = AR.archive_manifest(_tarballs(spark, sf))
    return rows.select("archive", "path", "size", F.length("content").alias("head_chars"))


@query
def tree_files(spark, sf):
    rows = TR.tree_files(spark_view(spark, sf, "v_files").select("package_id", "path", "content"), budget=60_000)
    return rows.select("package_id", "path", "size", "refused")
