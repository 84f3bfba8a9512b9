"""Near copies against brute force over planted copies of known similarity."""

import random

import corpus_pipeline
from cases import COLUMNS, documents
from pyspark.sql import functions as F

from sparkwarden.llm import copies


def word_sets(texts):
    out = []
    for t in texts:
        w = t.lower().split()
        out.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    return out


def planted(seed=5):
    """Originals, and copies with words replaced so that similarities spread from about 0.6 to 1."""
    rng = random.Random(seed)
    word = lambda: f"w{rng.randrange(4000)}"
    texts = []
    for i in range(150):
        base = [word() for _ in range(rng.randrange(100, 400))]
        texts.append(" ".join(base))
        for _ in range(2):
            copy = list(base)
            for at in rng.sample(range(len(copy)), max(1, int(len(copy) * (i % 10) / 200))):
                copy[at] = word()
            texts.append(" ".join(copy))
    return texts


def similar(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def test_stage_drops_planted_copies_and_no_others(spark):
    texts = planted()
    found = word_sets(texts)
    pairs = {(i, j): s for i in range(len(texts)) for j in range(i) if (s := similar(found[i], found[j])) >= 0.8}
    assert sum(s < 0.9 for s in pairs.values()) > 50 and sum(0.6 < similar(found[i], found[i - 1]) < 0.8 for i in range(1, len(texts))) > 20
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(3)
    group = {r["first"]: r["component_id"] for r in copies.groups(docs).collect()}
    linked = sum(group.get(i, i) == group.get(j, j) for i, j in pairs)
    assert linked >= 0.95 * len(pairs)
    true = list(range(len(texts)))  # brute force: the smallest document that similar pairs reach
    for _ in texts:
        for i, j in pairs:
            true[i] = true[j] = min(true[i], true[j])
    assert all(true[i] == true[c] for i, c in group.items())
    kept = corpus_pipeline.near_duplicates(spark, documents(spark, [(i, t, "en", "a", len(t), 1, 5, None, -1) for i, t in enumerate(texts)]).select(*COLUMNS), "")
    assert {r["doc_id"] for r in kept.collect()} == {c for c in group.values()}


def test_only_verified_pairs_link(spark):
    """Proposed pairs below the similarity stay apart; texts of one set of shingles are one."""
    a = "one two three four five six seven eight nine ten"
    docs = spark.createDataFrame([(0, a), (1, a.replace("ten", "x")), (2, a.upper()), (3, ""), (4, None), (5, "one")], "doc_id long, text string")
    pairs = spark.createDataFrame([(0, 1), (0, 5)], "a long, b long")
    whole = copies.hashed(docs, docs.select("doc_id"), 5)
    assert copies.verified(whole, pairs, 0.8).count() == 0 and copies.verified(whole, pairs, 0.7).count() == 1
    group = {r["first"]: r["component_id"] for r in copies.groups(docs).collect()}
    assert group == {0: 0, 1: 1, 3: 3, 5: 5}


def edited(n, seed=2):
    """A text of 400 words, and n copies of it with one word replaced."""
    rng = random.Random(seed)
    base = [f"w{rng.randrange(4000)}" for _ in range(400)]
    texts = [" ".join(base)]
    for i in range(n):
        copy = list(base)
        copy[rng.randrange(400)] = f"new{i}"
        texts.append(" ".join(copy))
    return texts


def own_classes(spark, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = copies.sets(docs, 5).groupBy("set").agg(F.min("doc_id").alias("first"), *[F.first(w).alias(w) for w in copies.WORD_NAMES])
    return docs, found.withColumn("part", F.col("first"))


def test_large_keys_meet_in_blocks(spark, monkeypatch):
    radius, tables = copies.plan(0.8)
    docs, own = own_classes(spark, edited(250))
    expected = {tuple(r) for r in copies.between(own, (tables, 16, radius)).collect()}
    assert len(expected) == 251 * 250 / 2
    monkeypatch.setattr(copies, "BLOCK", 40)
    monkeypatch.setattr(copies, "AT_ONCE", 100)
    assert {tuple(r) for r in copies.between(own, (tables, 16, radius)).collect()} == expected
    near = copies.nearest(own, (tables, 16, radius)).collect()
    assert len(near) == 251 and [r["first"] for r in near if r["near"] is None] == [0]
    assert {r["component_id"] for r in copies.groups(docs).collect()} == {0}


def test_close_pairs_against_brute_force(spark):
    """Groups of all sizes, parts respected: the pairs under a shared key and within the radius, and each one's nearest earlier."""
    docs, own = own_classes(spark, planted(7)[:240] + edited(60))
    radius, tables = copies.plan(0.8)
    own = own.withColumn("part", F.when(F.col("first") % 3 == 0, 0).otherwise(F.col("first")))
    rows = own.select("first", "part", *copies.WORD_NAMES).collect()
    keys = copies._keys(copies.np.array([r[2:] for r in rows], copies.np.int64).view(copies.np.uint64), tables, 16)
    bits = lambda r: sum((w & ((1 << 64) - 1)) << (64 * i) for i, w in enumerate(r[2:]))
    close, least = set(), {}
    for i, x in enumerate(rows):
        for j in range(i):
            y = rows[j]
            d = (bits(x) ^ bits(y)).bit_count()
            if x[1] != y[1] and d <= radius and (keys[i] == keys[j]).any():
                a, b = sorted((x[0], y[0]))
                close.add((a, b))
                least[b] = min(least.get(b, (d, a)), (d, a))
    assert len(close) > 1000
    assert {tuple(r) for r in copies.between(own, (tables, 16, radius)).collect()} == close
    assert {r["first"]: r["near"] for r in copies.nearest(own, (tables, 16, radius)).collect()} == {x: least[x][1] if x in least else None for p in close for x in p}


def test_a_large_group_proposes_few_pairs(spark, monkeypatch):
    """A thousand near copies: one pair each, none left between parts."""
    tried = []
    real = copies.verified
    monkeypatch.setattr(copies, "verified", lambda whole, pairs, s: (tried.append(pairs.count()), real(whole, pairs, s))[1])
    docs, _ = own_classes(spark, edited(1000))
    assert {r["component_id"] for r in copies.groups(docs).collect()} == {0}
    assert tried == [1000, 0]


def apart(n, words, seed=3):
    """n copies of a text of 400 words that isn't among them, each with some words replaced."""
    rng = random.Random(seed)
    base = [f"w{rng.randrange(4000)}" for _ in range(400)]
    texts = []
    for i in range(n):
        copy = list(base)
        for at in rng.sample(range(400), words[i % len(words)]):
            copy[at] = f"new{i}-{at}"
        texts.append(" ".join(copy))
    return texts


def test_a_large_group_just_too_different_proposes_few_pairs(spark, monkeypatch):
    """Close sketches of texts a bit less similar than asked for are compared but not handed on, and no pair twice."""
    texts = apart(150, [6])
    found = word_sets(texts)
    links = [(i, j) for i in range(150) for j in range(i + 1, 150) if similar(found[i], found[j]) >= 0.8]
    docs, own = own_classes(spark, texts)
    radius, tables = copies.plan(0.8)
    close = [tuple(r) for r in copies.between(own, (tables, 16, radius)).collect()]
    assert len(close) == len(set(close)) > 5000
    tried = []
    real = copies.verified
    monkeypatch.setattr(copies, "verified", lambda whole, pairs, s: (tried.append(pairs.count()), real(whole, pairs, s))[1])
    group = {r["first"]: r["component_id"] for r in copies.groups(docs).collect()}
    assert all(group[i] == group[j] for i, j in set(links) & set(close)) and len(set(group.values())) >= 150 - len(links) > 50
    assert tried[1] < 1000


def test_the_bound_loses_no_similar_pair(spark):
    """Around the similarity, with sets of any size: each similar close pair is among those that may link, at every similarity."""
    texts = apart(60, [1, 3, 4, 5]) + planted(11)[:120] + ["", "one", "one two", "one two three four five six"]
    found = word_sets(texts)
    docs, own = own_classes(spark, texts)
    whole = copies.hashed(docs, docs.select("doc_id"), 5)
    own = own.join(copies.marked(whole).withColumnRenamed("doc_id", "first"), "first")
    radius, tables = copies.plan(0.8)
    close = {tuple(r) for r in copies.between(own, (tables, 16, radius)).collect()}
    for similarity in (0.8, 0.9):
        kept = {tuple(r) for r in copies.between(own, (tables, 16, radius), similarity).collect()}
        true = {(a, b) for a, b in close if similar(found[a], found[b]) >= similarity}
        assert len(true) > 100 and true <= kept < close


def test_second_pass_loses_no_link(spark, monkeypatch):
    """Where no nearest link verifies, the second pass alone gives the same groups."""
    docs = spark.createDataFrame(list(enumerate(planted(9)[:150] + edited(30))), "doc_id long, text string")
    expected = {r["first"]: r["component_id"] for r in copies.groups(docs).collect()}
    real = copies.nearest
    monkeypatch.setattr(copies, "nearest", lambda *a: real(*a).withColumn("near", F.lit(None).cast("long")))
    assert {r["first"]: r["component_id"] for r in copies.groups(docs).collect()} == expected


def test_no_documents(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert copies.groups(docs).count() == 0


def test_plan():
    radius, tables = copies.plan(0.8)
    assert 40 < radius < 64 and 30 < tables < 80 and copies.plan(0.9)[1] < tables
    assert copies.key_bits(0) == copies.key_bits(4 << 16) == 16 and copies.key_bits(4 << 20) == 20
    assert copies.plan(0.8, 20)[0] == radius and tables < copies.plan(0.8, 20)[1] < 2.5 * tables
