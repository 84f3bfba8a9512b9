"""Operators on URLs, vectors and sources, and the pipeline, against brute force and on hard cases."""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from cases import COLUMNS, PLAIN, documents, rows

import corpus_pipeline
from sparkwarden.llm import common, embeddings, mixing, packing, quality, simhash, substrings, urls

SF = "/root/testdata/sf0.001"


def url_truth(url):
    if not url or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host), re.match(r"[^?#]*", rest[len(host) :])[0]


@pytest.mark.parametrize("table", ["odd", "small"])
def test_urls(spark, table):
    odd = [None, "", "no scheme", "http://", "http://ORG", "http://org/", "http://a.org", "http://a.org/x://y", "x://example.org/es/1?a=b&c=d#e", "ftp://a.example.org/en/1",
           "http://notexample.org/es/1", "http://É.com/de/", "http://a.com/fr/\n2", "http://com/fr/" + "x" * 20_000, "http://a.net/?q", "http://a.net#f", "http://a.org/"]
    pages = spark.read.parquet(f"{SF}/pages.parquet") if table == "small" else spark.createDataFrame([(i, u, 1, "x") for i, u in enumerate(odd + odd[:3])], "page_id long, url string, label int, host string")
    got = {r["page_id"]: r for r in urls.judged(pages).collect()}
    assert len(got) == pages.count()
    for r in pages.collect():
        host, path = url_truth(r["url"])
        fits = [x for x in urls.RULES if (host == x.host or host.endswith("." + x.host)) and path.startswith(x.path)]
        best = max(fits, key=lambda x: len(x.name), default=None)
        out = got[r["page_id"]]
        assert (out["host"], out["path"], out["rule"]) == (host, path, best and best.name), r["url"]
        assert out["verdict"] in ("allow", "block") and (best is None or out["verdict"] == best.verdict)


def test_urls_without_labels(spark):
    pages = spark.createDataFrame([(1, "http://a.net/x"), (2, None)], "page_id long, url string")
    assert {r["verdict"] for r in urls.judged(pages).collect()} == {"allow"}
    assert urls.judged(pages.where("false")).count() == 0
    assert {r["verdict"] for r in urls.judged(pages, [urls.Rule("block", "net", "/")]).collect()} == {"block"}


def test_trees_learn(spark):
    """Unseen URLs of a kind that rules block are blocked."""
    data = [(i, f"http://spam{i}{i * 7}.bad.com/a?x=1&y=2&z={i}") for i in range(200)] + [(1000 + i, f"https://site.good.org/page/{chr(97 + i % 26)}") for i in range(200)]
    data += [(5000, "http://spam99123.else.net/a?x=1&y=2&z=17"), (5001, "https://site.other.net/page/q")]
    pages = spark.createDataFrame(data, "page_id long, url string")
    got = {r["page_id"]: r["verdict"] for r in urls.judged(pages, [urls.Rule("block", "bad.com", "/"), urls.Rule("allow", "good.org", "/")]).collect()}
    assert got[5000] == "block" and got[5001] == "allow"


def vector_truth(data):
    fine = [v is not None and len(v) > 0 and all(x is not None and np.isfinite(x) for x in v) and any(x != 0 for x in v) for _, v in data]
    unit = [np.array(v, float) / np.linalg.norm(np.array(v, float)) if f else None for (_, v), f in zip(data, fine, strict=True)]
    near = np.array([[i != j and fine[i] and fine[j] and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= 0.95 for j in range(len(data))] for i in range(len(data))]).reshape(len(data), len(data))
    label = np.arange(len(data))
    for _ in data:
        label = np.minimum(label, np.where(near, label[None, :], len(data)).min(axis=1))
    low = {k: min((data[i][0] for i in np.flatnonzero(label == k) if data[i][0] is not None), default=None) for k in set(label.tolist())}
    return Counter((v, int(near[i].sum()), low[label[i]], v == low[label[i]]) for i, (v, _) in enumerate(data))


def test_vectors_hard_cases(spark):
    rng = np.random.default_rng(5)
    base = rng.normal(size=8)
    data = [(i, rng.normal(size=8).round(3).tolist()) for i in range(30)] + [(100 + i, (base + 0.05 * rng.normal(size=8)).round(3).tolist()) for i in range(20)]
    data += [(200, [1.0] * 8), (201, [2.0] * 8), (202, [1.0] * 8), (203, None), (204, []), (205, [0.0] * 8), (206, [None, 1.0]), (207, [float("nan"), 1.0]), (208, [float("inf"), 1.0])]
    data += [(209, [1.0, 1.0]), (210, [3.0, 3.0]), (None, [1.0] * 8), (200, [1.0] * 8), (201, [-1.0] * 8), (211, [1e-30] * 8)]
    df = spark.createDataFrame([(i, v, 1, 2) for i, v in data], "vec_id long, embedding array<float>, label int, n_links int")
    got = Counter((r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in embeddings.near_duplicates(df).collect())
    want = vector_truth([(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v]) for i, v in data])
    assert got == want
    assert embeddings.near_duplicates(df.where("false")).count() == 0


def test_vector_recall_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(embeddings, "BLOCK", 50)
    rng = np.random.default_rng(6)
    centres = rng.normal(size=(40, 32))
    x = np.concatenate([centres[i % 40] + 0.12 * rng.normal(size=32) * (i % 3) for i in range(400)] + [centres[0] + 0.1 * rng.normal(size=32) for _ in range(200)]).reshape(-1, 32)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    unit = embeddings.unit(x.tolist())
    want = (unit @ unit.T >= 0.95).sum(axis=1) - 1
    got = np.array([r["n_links"] for r in embeddings.near_duplicates(df).orderBy("vec_id").collect()])
    assert (got <= want).all() and got.sum() >= 0.9 * want.sum()


def test_vectors_broadcast_no_side_with_a_row_per_vector(spark, monkeypatch):
    """Small as the tables are here, no side that grows with the vectors goes through the driver; the rows per range of ``numbered`` may."""
    plans = []
    plan = lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString()) or df
    for module in (embeddings, common):
        monkeypatch.setattr(module, "stored", lambda df, name, f=module.stored: f(plan(df), name))
    rng = np.random.default_rng(8)
    centres = rng.normal(size=(10, 8))
    data = [(i, (centres[i % 10] + 0.05 * rng.normal(size=8)).tolist()) for i in range(60)]
    out = plan(embeddings.near_duplicates(spark.createDataFrame(data, "vec_id long, embedding array<double>")))
    assert out.where("n_links > 0").count() > 30
    kinds = [set(re.findall(r"(BroadcastHashJoin|BroadcastNestedLoopJoin|SortMergeJoin|ShuffledHashJoin) (\[\w+)", p)) for p in plans]
    met = set().union(*kinds)
    assert {("SortMergeJoin", k) for k in ("[rid", "[k", "[u", "[v", "[component", "[h1")} <= met, met
    assert {k for kind, k in met if kind.startswith("Broadcast")} <= {"[_part"}


def test_mixing_hard_cases(spark):
    docs = documents(spark)
    got = mixing.copies(docs).collect()
    assert len(got) == docs.count()
    again = mixing.copies(docs).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))
    sizes = Counter()
    for r in docs.collect():
        sizes[r["source"]] += len(re.findall(r"[^\x20\x09-\x0D]+", r["text"] or ""))
    assert {r["source"]: r["source_size"] for r in got} == dict(sizes)
    targets = {r["source"]: r["target"] for r in got}
    assert sum(targets.values()) == pytest.approx(1.5 * sum(sizes.values()))
    assert all(t <= 2 * sizes[s] + 1e-9 for s, t in targets.items()) and all(0 <= r["copies"] <= 2 for r in got)
    names = [*sorted(s for s in sizes if s is not None), *([None] if None in sizes else [])]
    open_ = [s for s in names if targets[s] < 2 * sizes[s] - 1e-9]
    weights = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    assert len({round(targets[s] / weights[s], 6) for s in open_}) <= 1
    mix = mixing.mixed(docs)
    assert mix.columns == docs.columns
    assert mix.count() == sum(r["copies"] for r in got)
    assert mixing.copies(docs.where("false")).count() == 0 and mixing.mixed(docs.where("false")).count() == 0


def test_mixing_comes_near_targets(spark):
    data = [(i, "w " * (1 + i * 37 % 100), "en", f"s{i % 4}", 1, 1, 5, None, -1) for i in range(2000)]
    taken, target = Counter(), {}
    for r in mixing.copies(documents(spark, data)).collect():
        taken[r["source"]] += r["copies"] * r["size"]
        target[r["source"]] = r["target"]
    assert all(abs(taken[s] - t) <= 0.01 * t for s, t in target.items())


def test_pipeline_stages(spark):
    """Each stage against what its decision should leave."""
    docs = documents(spark).select(*COLUMNS)
    kept = corpus_pipeline.quality_rules(spark, docs, SF)
    assert kept.columns == COLUMNS
    assert Counter(r["text"] for r in kept.collect()) == Counter(r["text"] for r in quality.judged(docs).where("kept").collect())
    single = corpus_pipeline.near_duplicates(spark, docs, SF)
    groups = simhash.near_duplicates(substrings.sequenced(docs).selectExpr("_seq as doc_id", "text")).select("component_id").distinct().count()
    assert single.columns == COLUMNS and single.count() == groups
    assert Counter(r["text"] for r in single.collect())[PLAIN] == 1
    left = corpus_pipeline.repeated_substrings(spark, docs, SF).collect()
    assert len(left) == len(rows()) and all(r["n_chars"] == (None if r["text"] is None else len(r["text"])) for r in left)
    removed = substrings.deduplicated(docs).collect()
    assert sum(len((r["text"] or "").encode()) for r in left) == sum(r["n_bytes"] - r["n_removed"] for r in removed)
    mix = corpus_pipeline.mixed_sources(spark, docs, SF)
    assert mix.columns == COLUMNS
    packed = corpus_pipeline.packed_sequences(spark, docs, SF)
    assert packed.count() == packing.packed(docs, public_tokenizers.path("word_bpe_49k.json")).count()
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.where("false"), SF).count() == 0


def test_pipeline_runs(spark):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "near_duplicates", "repeated_substrings", "mixed_sources", "packed_sequences"]
    out = corpus_pipeline.run(spark, SF)
    assert out.count() > 0 and out.groupBy("sequence_id").agg({"length": "sum"}).where("`sum(length)` > 4096").count() == 0
