"""The range-wise helpers equal plain windows, also when one key holds most rows."""

import random

from pyspark.sql import Window
from pyspark.sql import functions as F

from sparkwarden.functions.ordered import carried, previous, running_total
from sparkwarden.operators import dependencies as D


def rows():
    rng = random.Random(3)
    return [("hot" if i % 3 else f"k{i % 5}", i * 7 % 1009, rng.randrange(50)) for i in range(600)]


def test_running_total(spark):
    df = spark.createDataFrame(rows(), "k string, o bigint, v bigint")
    plain = df.withColumn("t", F.sum("v").over(Window.partitionBy("k").orderBy("o")))
    ranged = running_total(df, ["k"], "o", "v", "t", width=16).select(plain.columns)
    assert sorted(map(tuple, ranged.collect())) == sorted(map(tuple, plain.collect()))


def test_previous(spark):
    df = spark.createDataFrame(rows(), "k string, o bigint, v bigint").dropDuplicates(["k", "o"])
    plain = df.withColumn("p", F.lag("v").over(Window.partitionBy("k").orderBy("o")))
    ranged = previous(df, ["k"], "o", F.col("v"), "p", width=16).select(plain.columns)
    key = lambda r: tuple(-1 if x is None else x for x in r)
    assert sorted((key(r) for r in ranged.collect())) == sorted((key(r) for r in plain.collect()))


def test_carried(spark):
    df = spark.createDataFrame(rows(), "k string, o bigint, v bigint").dropDuplicates(["k", "o"]).withColumn("v", F.when(F.col("v") % 7 == 0, F.col("v")))
    over = Window.partitionBy("k").orderBy("o").rowsBetween(Window.unboundedPreceding, 0)
    plain = df.withColumn("c", F.last("v", ignorenulls=True).over(over))
    key = lambda r: tuple(-1 if x is None else x for x in r)
    for width in (1, 16, 5000):
        ranged = carried(df, ["k"], "o", F.col("v"), "c", width=width).select(plain.columns)
        assert sorted((key(r) for r in ranged.collect())) == sorted((key(r) for r in plain.collect()))


def test_manifest_of_any_length(spark):
    """Entries line by line equal those of whole manifests, in one range or many, and with one manifest of thousands of blocks."""
    yarn = "# yarn lockfile v1\n\n" + "".join(f'"@s/p{i}@^1", q{i}@2:\n  version "1.{i}"\n  dependencies:\n    x "3"\n\n' for i in range(1500))
    pub = "packages:\n" + "".join(f'  p{i}:\n    dependency: transitive\n    version: "2.{i}"\n    version: "9"\n' for i in range(300)) + "  last:\n"
    locks = spark.createDataFrame([(1, "yarn.lock", yarn), (2, "pubspec.lock", pub), (3, "yarn.lock", '  version "1"\n'), (4, "pubspec.lock", ""), (5, "yarn.lock", None)], "lock_id bigint, file_name string, content string")
    whole = D.parsed(locks.filter("file_name = 'yarn.lock' AND lock_id = 1"), D.parse_yarn(F.col("content"))).unionByName(D.parsed(locks.filter("file_name = 'pubspec.lock'"), D.parse_pubspec(F.col("content"))))
    want = sorted((r["lock_id"], r["name"], r["version"]) for r in whole.collect())
    assert len(want) == 3300
    for width in (7, 4096):
        got = sorted((r["lock_id"], r["name"], r["version"]) for r in D.block_entries(D.manifest_lines(locks), width).collect())
        assert got == want
