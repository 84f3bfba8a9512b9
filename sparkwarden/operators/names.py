"""Package names and references: look-alikes, popular lists, repository and storage paths."""

from __future__ import annotations

from collections.abc import Iterator
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkwarden import values as V
from sparkwarden.functions import patterns as P
from sparkwarden.functions.joins import many

DAY = 86400
#: Tasks that the names under one token are dealt to.
TOKEN_PARTS = 16
# Fixed order of characters, frequent last; it only decides which tokens a name is filed under.
_FREQUENT_LAST = "_./@0123456789zqxjkvbpygfwmucldrhsnioate-"
_CODES = "".join(chr(0x21 + i) for i in range(len(_FREQUENT_LAST)))


# -- popular names ----------------------------------------------------------------------
def builtin_popular(spark: SparkSession) -> DataFrame:
    rows = [(eco, n) for eco, names in V.POPULAR_NAMES.items() for n in names]
    rows += [(alias, n) for alias, eco in V.ECOSYSTEM_ALIASES.items() for n in V.POPULAR_NAMES[eco]]
    return spark.createDataFrame(rows, "ecosystem string, name string")


def popular_dim(builtin: DataFrame, refreshed: DataFrame, as_of: int) -> DataFrame:
    """Built-in names and refreshed ones younger than a week; unknown ecosystems stay out."""
    fresh = refreshed.filter((F.lit(as_of) - F.col("updated_at")) / DAY <= V.POPULAR_TTL_DAYS)
    known = fresh.join(builtin.select("ecosystem").distinct(), "ecosystem", "left_semi")
    return builtin.select("ecosystem", "name").union(known.select("ecosystem", "name")).distinct()


# -- look-alikes ------------------------------------------------------------------------
def compared_name() -> Column:
    """Go modules are compared by their last path segment."""
    return F.when(F.col("ecosystem") == "go", F.element_at(F.split("name", "/"), -1)).otherwise(F.col("name"))


def tokens(name: Column) -> Column:
    """The characters of a name as distinct tokens (character and occurrence), rare ones first."""
    chars = F.split(F.lower(name), "")

    def token(c: Column, i: Column) -> Column:
        nth = F.size(F.filter(F.slice(chars, 1, i + 1), lambda x: x == c))
        return F.concat(F.lpad((F.lit(1000) - nth).cast("string"), 4, "0"), F.translate(c, _FREQUENT_LAST, _CODES), c)

    return F.array_sort(F.transform(F.filter(chars, lambda c: F.length(c) > 0), token))


def filed(names: DataFrame, column: str, threshold: float) -> DataFrame:
    """Names under the tokens that any sufficiently similar name must share one of.

    Similar names have ``overlap >= threshold / 2 * (la + lb)`` and ``lb >= la * t / (2 - t)``, so
    at least ``need`` tokens of a name are shared and one of its first ``la - need + 1`` is.
    """
    length = F.length(column)
    shortest = F.ceil(length * (threshold / (2 - threshold)) - F.lit(1e-9))
    need = F.ceil((length + shortest) * (threshold / 2) - F.lit(1e-9))
    all_tokens = tokens(F.col(column))
    prefix = F.slice(F.col("_tokens"), 1, (length - need + 1).cast("int"))
    return names.withColumn("_tokens", all_tokens).select("ecosystem", column, "_tokens", F.explode(prefix).alias("_token"))


def typosquat_candidates(packages: DataFrame, popular: DataFrame, threshold: float = V.TYPO_SIMILARITY) -> DataFrame:
    """Pairs of names that could reach the threshold: both exact upper bounds allow it.

    Only pairs that share a rare token meet, in an equi-join that Spark can split on skew.
    """
    names = packages.select("ecosystem", compared_name().alias("compared")).distinct()
    known = popular.select("ecosystem", F.col("name").alias("known")).distinct()
    # A frequent token's names are dealt to several tasks; each meets all known names of the token.  The names are streamed past the known ones unsorted.
    left = filed(names, "compared", threshold).withColumn("_part", F.pmod(F.xxhash64("compared"), F.lit(TOKEN_PARTS)))
    right = filed(known, "known", threshold).withColumnRenamed("_tokens", "_known_tokens")
    right = right.withColumn("_part", F.explode(F.sequence(F.lit(0), F.lit(TOKEN_PARTS - 1)).cast("array<bigint>")))
    total = F.length("compared") + F.length("known")
    shortest = F.least(F.length("compared"), F.length("known"))
    pairs = (
        left.join(right.hint("shuffle_hash"), ["ecosystem", "_token", "_part"])
        .filter((F.col("compared") != F.col("known")) & (2 * shortest / total >= threshold))
        .filter(2 * F.size(F.array_intersect("_tokens", "_known_tokens")) / total >= threshold)
    )
    return pairs.select("ecosystem", "compared", "known").distinct()


def _ratios(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    """Ratcliff-Obershelp similarity, which depends on the argument order."""
    for left, right in batches:
        yield pd.Series(
            [SequenceMatcher(None, a.lower(), b.lower()).ratio() for a, b in zip(left, right)], dtype="float64"
        )


def similar_names(packages: DataFrame, popular: DataFrame, threshold: float = V.TYPO_SIMILARITY) -> DataFrame:
    """Look-alike pairs with their similarity; Python only sees pairs past the bounds."""
    ratio = F.pandas_udf(_ratios, "double")
    scored = typosquat_candidates(packages, popular, threshold).withColumn("similarity", ratio("compared", "known"))
    return scored.filter(F.col("similarity") >= threshold)


def percent(share: Column) -> Column:
    return F.concat(F.rint(share * 100).cast("bigint").cast("string"), F.lit("%"))


def typosquat(packages: DataFrame, popular: DataFrame, threshold: float = V.TYPO_SIMILARITY) -> DataFrame:
    """One row per package whose name resembles popular names of its ecosystem.

    Matches are listed per distinct name before packages join, so a name that many packages
    carry is compared and listed once.
    """
    shown = F.concat("known", F.lit(" ("), percent(F.col("similarity")), F.lit(")"))
    listed = similar_names(packages, popular, threshold).groupBy("ecosystem", "compared").agg(
        F.count("*").alias("n_matches"), F.array_join(F.array_sort(F.collect_list(shown)), "', '").alias("_names")
    )
    named = packages.select("package_id", "ecosystem", "name", compared_name().alias("compared"))
    return named.join(many(listed), ["ecosystem", "compared"]).select(
        "package_id",
        "name",
        "n_matches",
        F.concat(F.lit("typosquat_candidate: similar to ['"), F.col("_names"), F.lit("']")).alias("text"),
    )


# -- references -------------------------------------------------------------------------
_ARCHIVE_SSH = r"^git@(github\.com|gitlab\.com)[:/]([^/]+)/([^/\s#?]+?)(?:\.git)?$"
_ARCHIVE_HTTPS = r"^https?://(github\.com|gitlab\.com)/([^/]+)/([^/\s#?]+?)(?:\.git)?(?:[/?#].*)?$"
_STORE_GIT = (
    r"(?:git\+)?(?:https?://|git@)(github\.com|gitlab\.com|bitbucket\.org|codeberg\.org)[/:]([^/]+)/([^/\s#?]+?)"
    r"(?:\.git)?(?:[/#?].*)?$"
)


def scoped_npm_name(name: Column) -> Column:
    """``@scope/pkg`` as ``@jsr/scope__pkg``; anything else unchanged."""
    raw = P.strip(name)
    scoped = raw.startswith("@") & F.contains(raw, F.lit("/")) & ~raw.startswith("@jsr/")
    return F.when(scoped, F.regexp_replace(raw, r"(?s)^@([^/]*)/(.*)$", r"@jsr/$1__$2")).otherwise(raw)


def archive_repo(url: Column) -> Column:
    """``host/owner/repo`` of a GitHub or GitLab URL, '' otherwise."""
    plain = F.regexp_replace(P.strip(url), r"^git\+", "")

    def parts(pattern: str) -> Column:
        return F.when(P.found(plain, pattern), F.concat_ws("/", *[P.first(plain, pattern, g) for g in (1, 2, 3)]))

    return F.coalesce(parts(_ARCHIVE_SSH), parts(_ARCHIVE_HTTPS), F.lit(""))


def store_repo(url: Column) -> Column:
    """``host/owner/repo`` of a URL on a known git host anywhere in the text, '' otherwise."""
    plain = F.regexp_replace(P.strip(url), r"^git://", "https://")
    return F.when(P.found(plain, _STORE_GIT), F.concat_ws("/", *[P.first(plain, _STORE_GIT, g) for g in (1, 2, 3)])).otherwise("")


def github_owner_repo(url: Column) -> Column:
    """``owner/repo`` of a URL whose host is exactly github.com, '' otherwise."""
    return F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://github\.com/+([^/?#]+/[^/?#]+)", 1)


def spec_shard(name: Column) -> Column:
    """First three MD5 hex digits as nested directories."""
    return F.regexp_replace(F.substring(F.md5(name), 1, 3), "^(.)(.)(.)$", "$1/$2/$3")


def storage_path(name: Column, version: Column, ecosystem: Column, repository: Column) -> Column:
    """Where a package version is published: by repository, else by registry."""
    shown = F.when(F.coalesce(F.length(version), F.lit(0)) == 0, "latest").otherwise(version)
    repo = store_repo(F.coalesce(repository, F.lit("")))
    eco = F.lower(P.strip(ecosystem))
    registry = F.when(F.coalesce(F.length(eco), F.lit(0)) == 0, "unknown").otherwise(eco)
    safe = F.regexp_replace(F.replace(P.strip(name), F.lit(".."), F.lit("")), "^/+", "")
    return F.when(repo != "", F.concat_ws("/", F.lit("repos"), repo, shown)).otherwise(
        F.concat(F.lit("repos/registry."), registry, F.lit("/"), safe, F.lit("/"), shown)
    )


def normalise_refs(packages: DataFrame) -> DataFrame:
    repository = F.coalesce("repository", F.lit(""))
    return packages.select(
        "package_id",
        scoped_npm_name(F.col("name")).alias("npm_name"),
        archive_repo(repository).alias("archive_repo"),
        store_repo(repository).alias("store_repo"),
        github_owner_repo(repository).alias("owner_repo"),
        spec_shard(F.col("name")).alias("shard"),
        storage_path(F.col("name"), F.col("version"), F.col("ecosystem"), repository).alias("storage_path"),
    )
