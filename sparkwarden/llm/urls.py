"""URL filters: rules by host and path, and gradient-boosted trees where no rule fits; DataFrame functions only.

The trees see lexical features (length, depth, digit ratio, entropy, parameter counts, statistics of host suffixes) and
learn from labelled URLs: those that a rule judges.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkwarden.llm.common import stored


@dataclass(frozen=True)
class Rule:
    """A verdict for a host, its subdomains and paths that start with ``path``."""

    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path

    def fits(self) -> Column:
        at_host = (F.col("host") == self.host) | F.col("host").endswith("." + self.host)
        return at_host & F.col("path").startswith(self.path)


#: The rules of the registered query.
RULES = [
    Rule("allow", "org", "/"), Rule("block", "example.org", "/es/"), Rule("block", "example.org", "/en/1"),
    Rule("allow", "com", "/fr/"), Rule("block", "com", "/de/"),
]

#: Different labelled URLs that the trees are fitted on, about so many at most (by hash of the URL), each weighing as often as it occurs; suffix
#: statistics cover all.
TRAINING_ROWS = 50_000
TREES, DEPTH, SEED = 20, 4, 1
#: Labelled URLs' worth of the overall share that a suffix starts with.
SUFFIX_PRIOR = 5.0

FEATURES = [
    "url_length", "host_length", "path_length", "depth", "labels", "digit_ratio", "host_digit_ratio", "symbol_ratio", "hyphens", "entropy", "host_entropy",
    "parameters", "query_length", "fragment_length", "suffix_share", "suffix_seen", "domain_share", "domain_seen",
]


def parsed(pages: DataFrame) -> DataFrame:
    """page_id, url, host (A-Z lower-cased), path; both empty for a null url or one without ``://``."""
    url = F.coalesce(F.col("url"), F.lit(""))
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), upper, lower)
    return pages.select("page_id", url.alias("url"), host.alias("host"), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1).alias("path"))


def matched(urls: DataFrame, rules: list[Rule]) -> DataFrame:
    """``rule`` and ``ruled`` (its verdict) of the longest rule that fits, null if none does; of two equally long ones, the first by name."""
    found, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: (len(r.name), [-ord(c) for c in r.name])):  # the longest is asked first
        found = F.when(r.fits(), F.lit(r.name)).otherwise(found)
        verdict = F.when(r.fits(), F.lit(r.verdict)).otherwise(verdict)
    return urls.withColumn("rule", found).withColumn("ruled", verdict)


def entropy(text: Column) -> Column:
    """Bits per character of a text; 0 for an empty one."""
    size = F.length(text)
    often = F.transform(F.array_distinct(F.split(text, "")), lambda c: (size - F.length(F.replace(text, c, F.lit("")))) / size)
    return F.when(size > 0, F.aggregate(often, F.lit(0.0), lambda s, p: s - F.when(p > 0, p * F.log2(p)).otherwise(0.0))).otherwise(0.0)


def lexical(urls: DataFrame) -> DataFrame:
    """Features of a URL by itself, and its suffixes: the last label of the host and the last two."""
    url, host, path = F.col("url"), F.col("host"), F.col("path")
    ratio = lambda what, of: F.when(F.length(of) > 0, F.regexp_count(of, F.lit(what)) / F.length(of)).otherwise(0.0)
    query = F.regexp_extract(url, r"\?([^#]*)", 1)
    numbers = {
        "url_length": F.length(url), "host_length": F.length(host), "path_length": F.length(path), "depth": F.regexp_count(path, F.lit("/[^/]")),
        "labels": F.regexp_count(host, F.lit(r"[^.]+")), "digit_ratio": ratio("[0-9]", url), "host_digit_ratio": ratio("[0-9]", host),
        "symbol_ratio": ratio("[^A-Za-z0-9/.:]", url), "hyphens": F.regexp_count(host, F.lit("-")), "entropy": entropy(url), "host_entropy": entropy(host),
        "parameters": F.regexp_count(query, F.lit("[^&]+")), "query_length": F.length(query), "fragment_length": F.length(F.regexp_extract(url, r"#(.*)", 1)),
    }
    suffixes = {"suffix": F.substring_index(host, ".", -1), "domain": F.substring_index(host, ".", -2)}
    return urls.withColumns({k: v.cast("double") for k, v in numbers.items()} | suffixes)


def with_suffixes(features: DataFrame, labelled: DataFrame) -> DataFrame:
    """Share of blocked URLs and number of labelled ones (log) of each suffix, over all labelled URLs."""
    share = labelled.agg(F.coalesce(F.avg("label"), F.lit(0.0)).alias("all"))
    out = features.crossJoin(F.broadcast(share))  # one number
    for name in ("suffix", "domain"):
        sums = labelled.groupBy(name).agg(F.sum("label").alias("_bad"), F.count(F.lit(1)).alias("_n"))
        out = out.join(sums, name, "left")
        bad, n = F.coalesce("_bad", F.lit(0.0)), F.coalesce("_n", F.lit(0))
        out = out.withColumn(f"{name}_share", (bad + SUFFIX_PRIOR * F.col("all")) / (n + SUFFIX_PRIOR)).withColumn(f"{name}_seen", F.log1p(n.cast("double"))).drop("_bad", "_n")
    return out.drop("all")


def training(features: DataFrame, labelled: DataFrame, rows: int = TRAINING_ROWS) -> DataFrame:
    """FEATURES, label and weight: a share of the different labelled URLs by hash, about ``rows`` at most, equal ones in one row with their number."""
    drawn = F.xxhash64("url")
    different = labelled.agg(F.count_distinct(drawn)).first()[0]
    share = 1_000_000 * min(1.0, rows / max(1, different))
    return features.where("label is not null").where(F.pmod(drawn, F.lit(1_000_000)) < share).groupBy(*FEATURES, "label").agg(F.count(F.lit(1)).cast("double").alias("weight"))


def judged(pages: DataFrame, rules: list[Rule] | None = None, rows: int = TRAINING_ROWS) -> DataFrame:
    """page_id, host, path, rule, verdict of every row of ``pages``: the rule's verdict, else the trees'.

    With labelled URLs of one verdict only, that is every verdict; without any, all URLs are allowed.  A null url is judged as an
    empty one.  Equal rows get equal results; other columns are ignored.
    """
    rules = RULES if rules is None else rules
    urls = stored(lexical(matched(parsed(pages.select("page_id", "url")), rules)).withColumn("label", F.when(F.col("ruled") == "block", 1.0).when(F.col("ruled") == "allow", 0.0)), "urls")
    labelled = urls.where("label is not null")
    count = labelled.agg(F.count(F.lit(1)).alias("n"), F.min("label").alias("low"), F.max("label").alias("high")).first()
    if not count["n"] or count["low"] == count["high"]:
        only = F.lit("block" if count["n"] and count["low"] == 1.0 else "allow")
        return urls.select("page_id", "host", "path", "rule", F.coalesce("ruled", only).alias("verdict"))
    assembler = VectorAssembler(inputCols=FEATURES, outputCol="features")
    features = with_suffixes(urls, labelled)
    # The sample has a bound, so a few files hold it at any size of the input.
    sample = stored(assembler.transform(training(features, labelled, rows)).select("features", "label", "weight").coalesce(8), "labelled-urls")
    trees = GBTClassifier(maxIter=TREES, maxDepth=DEPTH, seed=SEED, weightCol="weight").fit(sample)
    verdict = F.coalesce("ruled", F.when(F.col("prediction") == 1.0, "block").otherwise("allow"))
    return trees.transform(assembler.transform(features)).select("page_id", "host", "path", "rule", verdict.alias("verdict"))
