"""Queries over package names, manifests and registry documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparkwarden.operators import dependencies as D
from sparkwarden.operators import names as N
from sparkwarden.plans.queries import query
from sparkwarden.plans.views import AS_OF, spark_view


def popular_names(spark, sf):
    """Built-in and fresh popular names."""
    return N.popular_dim(N.builtin_popular(spark), spark_view(spark, sf, "v_popular"), AS_OF)


@query
def popular_dim(spark, sf):
    return popular_names(spark, sf)


@query
def popular_union(spark, sf):
    return popular_names(spark, sf).groupBy("ecosystem").agg(F.count("*").alias("n_names"))


@query
def typosquat_candidates(spark, sf):
    return N.typosquat_candidates(spark_view(spark, sf, "v_packages"), popular_names(spark, sf))


@query
def typosquat(spark, sf):
    return N.typosquat(spark_view(spark, sf, "v_packages"), popular_names(spark, sf))


@query
def normalise_refs(spark, sf):
    packages = spark_view(spark, sf, "v_packages")
    url = (
        F.when(F.col("k") % 5 == 0, F.concat(F.lit("git@github.com:acme/"), F.col("name"), F.lit(".git")))
        .when(F.col("k") % 5 == 1, F.concat(F.lit("git+https://gitlab.com/g/"), F.col("name"), F.lit("#main")))
        .when(F.col("k") % 5 == 2, F.concat(F.lit("git://codeberg.org/c/"), F.col("name")))
        .otherwise(F.col("repository"))
    )
    name = F.when(F.col("k") % 3 == 0, F.concat(F.lit("@std/"), F.col("name"))).otherwise(F.col("name"))
    return N.normalise_refs(packages.withColumn("repository", url).withColumn("name", name))


def _locks(spark, sf, name):
    return spark_view(spark, sf, "v_locks").filter(F.col("file_name") == name)


@query
def lock_requirements(spark, sf):
    return D.parsed(_locks(spark, sf, "requirements.txt"), D.parse_requirements(F.col("content")))


@query
def lock_toml(spark, sf):
    uv = D.parsed(_locks(spark, sf, "uv.lock"), D.parse_toml(F.col("content")))
    return uv.unionByName(D.parsed(_locks(spark, sf, "Cargo.lock"), D.parse_toml(F.col("content"), registry_only=True)))


@query
def lock_npm(spark, sf):
    return D.parsed(_locks(spark, sf, "package-lock.json"), D.parse_npm(F.col("content"))).drop("pos")


@query
def lock_pnpm(spark, sf):
    return D.parsed(_locks(spark, sf, "pnpm-lock.yaml"), D.parse_pnpm(F.col("content")))


@query
def lock_yarn(spark, sf):
    return D.parsed(_locks(spark, sf, "yarn.lock"), D.parse_yarn(F.col("content")))


@query
def lock_pubspec(spark, sf):
    return D.parsed(_locks(spark, sf, "pubspec.lock"), D.parse_pubspec(F.col("content")))


@query
def lock_podfile(spark, sf):
    return D.parsed(_locks(spark, sf, "Podfile.lock"), D.parse_podfile(F.col("content")))


@query
def block_fill(spark, sf):
    """Header of every line of the formats that have blocks."""
    lines = D.manifest_lines(spark_view(spark, sf, "v_locks").filter(F.col("file_name").isin(*D.BLOCK_HEADERS)))
    return D.block_fill(lines).drop("line")


@query
def block_entries(spark, sf):
    return D.block_entries(D.manifest_lines(spark_view(spark, sf, "v_locks")))


@query
def dependency_inventory(spark, sf):
    return D.dependency_inventory(spark_view(spark, sf, "v_locks"))


@query
def registry_packages(spark, sf):
    rows = D.registry_packages(spark_view(spark, sf, "v_registry", dealt="part"))
    return rows.withColumn("dependencies", F.array_join(F.array_sort("dependencies"), ","))


@query
def latest_version(spark, sf):
    return D.latest_version(spark_view(spark, sf, "v_registry").filter("ecosystem = 'crates'"))
