"""Documents of scans parse, upserts leave other buckets alone, publishing counts only once it is committed."""

import json
from collections import Counter
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from sparkwarden.operators import documents as DO
from sparkwarden.operators import store as S
from sparkwarden.operators.buckets import BucketTable

ROWS = 'scan_id bigint, ord bigint, name string, version string, ecosystem string, level string, prefilter_reason string, source_unavailable boolean, verdict string, confidence double, outcome string, exit_code int, error string'


def scan_tables(spark):
    packages = [(1, i, f'p"{i}\n', "1", "npm", "LOW", "say \\ \"so\"", i % 2 == 0, None if i % 3 else "safe", 0.5, "safe", 0, None if i else "boom, [x]") for i in range(25)]
    packages += [(2, 7, "only", "2", "pypi", "HIGH", "r", False, None, None, "error", 3, "é{")]
    scans = [(1, "a.lock", "npm", 25, 25, 0, 0, 0, "safe", 0), (2, 'b".lock', "pypi", 1, 0, 0, 0, 1, "error", 3), (3, "none.lock", "npm", 0, 0, 0, 0, 0, "safe", 0)]
    return spark.createDataFrame(scans, "scan_id bigint, lockfile string, ecosystem string, total bigint, safe bigint, suspicious bigint, malicious bigint, errors bigint, outcome string, exit_code int"), spark.createDataFrame(packages, ROWS)


def documents(parts, folder):
    """Each scan's files, one after the other."""
    DO.write_documents(parts, str(folder))
    return {int(d.name.split("=")[1]): json.loads("".join(f.read_text() for f in sorted(d.glob("part-*")))) for d in Path(folder).glob("scan_id=*")}


@pytest.mark.parametrize("width", [1, 4, 1000])
def test_scan_payload_parses(spark, tmp_path, width):
    scans, packages = scan_tables(spark)
    parts = DO.payload_parts(scans, packages, width)
    found = documents(parts, tmp_path / "out")
    assert set(found) == {1, 2, 3} and found[3]["packages"] == []
    assert [p["package"]["name"] for p in found[1]["packages"]] == [f'p"{i}\n' for i in range(25)]  # in order
    assert found[1]["packages"][0]["error"] == "boom, [x]" and found[1]["packages"][1]["error"] is None and found[1]["packages"][1]["consensus"] is None
    assert found[2]["summary"] == {"total": 1, "safe": 0, "suspicious": 0, "malicious": 0, "errors": 1} and found[2]["decision"] == "error" and found[2]["lockfile"] == 'b".lock'
    texts = DO.numbered_parts(parts).where("scan_id = 1").orderBy("part").collect()
    assert json.loads("".join(r["text"] for r in texts)) == found[1] and [r["part"] for r in texts] == list(range(len(texts)))
    assert max(len(r["text"]) for r in texts) < 400 * max(2, width)


def test_sarif_document_parses(spark, tmp_path):
    scans, packages = scan_tables(spark)
    results = packages.select("scan_id", "ord", F.to_json(F.struct(F.col("name").alias("ruleId"), "level")).alias("result"))
    found = documents(DO.sarif_parts(scans, results, "tool", "1", "https://example.org", "rule", 'a "rule"', 4), tmp_path / "out")
    assert {k: len(d["runs"][0]["results"]) for k, d in found.items()} == {1: 25, 2: 1, 3: 0}
    assert all(d["version"] == "2.1.0" and d["runs"][0]["tool"]["driver"]["rules"][0]["shortDescription"]["text"] == 'a "rule"' for d in found.values())


def last(old, new):
    return old.join(new.select("k"), "k", "left_anti").unionByName(new)


def files_below(folder):
    return {str(f): f.stat().st_mtime_ns for f in Path(folder).rglob("*.parquet")}


def test_upsert_touches_only_its_buckets(spark, tmp_path):
    table = BucketTable(spark, str(tmp_path / "t"), ["k"], "k bigint, v string", buckets=8)
    assert table.read().count() == 0
    assert table.upsert(spark.range(200).selectExpr("id AS k", "'old' AS v"), last) == 8
    before, (seq, versions) = files_below(tmp_path / "t/data"), table.state()
    assert table.upsert(spark.createDataFrame([(3, "new"), (1000, "new")], "k bigint, v string"), last) <= 2
    now, (after, changed) = files_below(tmp_path / "t/data"), table.state()
    assert after == seq + 1 and before.items() <= now.items()  # nothing that was there was written again
    assert 1 <= sum(versions[b] != changed[b] for b in versions) <= 2
    assert Counter(r["v"] for r in table.read().collect()) == {"old": 199, "new": 2}
    assert table.upsert(spark.createDataFrame([], "k bigint, v string"), last) == 0


def test_failed_upsert_changes_nothing(spark, tmp_path):
    table = BucketTable(spark, str(tmp_path / "t"), ["k"], "k bigint, v string", buckets=4)
    table.upsert(spark.range(20).selectExpr("id AS k", "'old' AS v"), last)

    def broken(old, new):
        return last(old, new).withColumn("v", F.when(F.col("k") == 5, F.raise_error(F.lit("lost"))).otherwise(F.col("v")))

    with pytest.raises(Exception, match="lost"):
        table.upsert(spark.range(20).selectExpr("id AS k", "'new' AS v"), broken)
    assert Counter(r["v"] for r in table.read().collect()) == {"old": 20}
    # A second writer that began from the same state can't commit over the first.
    real = table.state
    stale = (real()[0] - 1, {})
    table.state = lambda: stale
    with pytest.raises(Exception, match="(?i)exist"):
        table.upsert(spark.range(3).selectExpr("id AS k", "'other' AS v"), last)
    table.state = real
    assert Counter(r["v"] for r in table.read().collect()) == {"old": 20}


def test_delete_by_merge(spark, tmp_path):
    table = BucketTable(spark, str(tmp_path / "t"), ["k"], "k bigint, v string", buckets=4)
    table.upsert(spark.range(20).selectExpr("id AS k", "'old' AS v"), last)
    table.upsert(spark.range(20).selectExpr("id AS k", "'gone' AS v"), lambda old, new: old.join(new.select("k"), "k", "left_anti"))
    assert table.read().count() == 0
    table.upsert(spark.range(2).selectExpr("id AS k", "'back' AS v"), last)
    assert table.read().count() == 2


def publish_tables(spark, content="x"):
    files = spark.createDataFrame([("a", "m/f1", content, 1, 0), ("a", "m/f2", "y", 1, 1), ("b", "n/f1", "z", 1, 0), ("c", "bad", "w", 1, 0)], "package_id string, path string, content string, size bigint, ord bigint")
    reports = spark.createDataFrame([("a", "safe", False, []), ("b", "suspicious", False, []), ("c", "malicious", False, [])], "package_id string, verdict string, source_unavailable boolean, signals array<string>")
    paths = spark.createDataFrame([(k, f"repos/{k}") for k in "abc"], "package_id string, path string")
    urls = spark.createDataFrame([("a", "https://a")], "package_id string, url string")
    packages = spark.createDataFrame([(k, k, "1", "npm") for k in "abc"], "package_id string, name string, version string, registry string")
    return files, reports, paths, urls, packages


def publish(spark, target, now, content="x", **kw):
    files, reports, paths, urls, packages = publish_tables(spark, content)
    known = S.provenance_table(spark, target).read().select("path", "sha256")
    S.publish_files(S.publish_plan(reports, paths, files, known, **kw), files, urls, packages, target, now)


def published(spark, target):
    return sorted((r["file_path"], r["content"], r["scan_verdict"], r["url"]) for r in S.read_published(spark, target).collect())


def test_publish_and_publish_again(spark, tmp_path):
    target = str(tmp_path / "store")
    publish(spark, target, 1)
    first = published(spark, target)
    assert [r[0] for r in first] == ["repos/a/m/f1", "repos/a/m/f2", "repos/b/n/f1"] and first[0][2:] == ("safe", "https://a") and first[2][2:] == ("suspicious", None)
    data = files_below(tmp_path / "store/files")
    publish(spark, target, 2)  # the same hash: the index is refreshed, nothing else
    assert published(spark, target) == first
    assert {k for k in files_below(tmp_path / "store/files") if Path(k).stat().st_size and spark.read.parquet(k).count()} == set(data)
    assert {(r["name"], r["fetched_at"]) for r in S.entry_table(spark, target).read().collect()} == {("a", 2), ("b", 2)}
    publish(spark, target, 3, content="changed")
    now = published(spark, target)
    assert now[0][:2] == ("repos/a/m/f1", "changed") and now[1:] == first[1:]  # only the last publish of a path counts


def test_publishing_broadcasts_no_side_with_a_row_per_package(spark):
    files, reports, paths, urls, packages = publish_tables(spark)
    plan = S.publish_plan(reports, paths, files, spark.createDataFrame([("repos/a", "0")], "path string, sha256 string"))
    for df in (plan, S.provenance_rows(plan, urls)):
        assert "BroadcastHashJoin" not in df._jdf.queryExecution().executedPlan().toString()
    assert sorted((r["package_id"], r["reason"]) for r in plan.collect()) == [("a", "reemit"), ("b", "fresh_directory")]


def test_failed_publish_leaves_the_old_state(spark, tmp_path, monkeypatch):
    target = str(tmp_path / "store")
    publish(spark, target, 1)
    first = published(spark, target)

    def fail(*_):
        raise RuntimeError("lost before the commit")

    monkeypatch.setattr(BucketTable, "upsert", fail)
    with pytest.raises(RuntimeError):
        publish(spark, target, 2, content="half")
    monkeypatch.undo()
    assert published(spark, target) == first
    publish(spark, target, 3, content="whole")
    assert published(spark, target)[0][1] == "whole"
