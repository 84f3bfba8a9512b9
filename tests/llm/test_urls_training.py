"""The rows that the URL trees learn from, where URLs repeat."""

from pyspark.sql import functions as F

from sparkwarden.llm import urls


def test_bound_holds_and_weights_keep_repeats(spark):
    single = [f"http://site{i}.org/{'x' * (i % 37)}?a={i}" for i in range(2000)]
    data = single + [f"http://often{i}.com/de/{i}" for i in range(20) for _ in range(300)]
    pages = spark.createDataFrame(list(enumerate(data)), "page_id long, url string")
    found = urls.lexical(urls.matched(urls.parsed(pages), urls.RULES))
    found = found.withColumn("label", F.when(F.col("ruled") == "block", 1.0).when(F.col("ruled") == "allow", 0.0))
    features = urls.with_suffixes(found, found)
    all_rows = urls.training(features, found, 100_000).agg(F.count(F.lit(1)).alias("n"), F.sum("weight").alias("w")).first()
    assert all_rows["n"] <= 2020 and all_rows["w"] == len(data)
    rows = urls.training(features, found, 500).collect()
    drawn = found.where(F.pmod(F.xxhash64("url"), F.lit(1_000_000)) < 1_000_000 * 500 / 2020)
    assert 350 < drawn.select("url").distinct().count() < 650 and len(rows) <= drawn.select("url").distinct().count()
    assert sum(r["weight"] for r in rows) == drawn.count() > 650  # repeated rows alone would pass the bound
    assert {r["verdict"] for r in urls.judged(pages, rows=500).collect()} == {"allow", "block"}
