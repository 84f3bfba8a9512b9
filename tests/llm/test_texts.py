"""Operators on texts against brute force, on hard cases and on the small documents table."""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from cases import PLAIN, documents
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from sparkwarden.llm import languages, packing, quality, scoring, simhash, substrings, token_store
from sparkwarden.llm.common import components, scratch_path
from sparkwarden.llm.tokens import Encoder

PATH = public_tokenizers.path("word_bpe_49k.json")
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    return documents(spark)


@pytest.fixture(scope="module")
def small(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def empty(docs):
    return docs.where("false")


def crc(ids) -> int:
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_encoder_is_the_tokenizer():
    tokenizer, encoder = Tokenizer.from_file(PATH), Encoder(PATH)
    odd = ["a\x0bb c\x1cd", "don't it's'll. x", "Áb  é é. ÉCOLE ÀÇ", "hi<|endoftext|>. x<|endoftext|>", "word.#, 12.5% ...", "İstanbul ΣΑΣ ς", "漢字。 かな",
           "a\u00a0b\u3000c\u2003d\x85e", "x;\u0338 y", "ﬁ ǅ ß ªº", "😀!!", "\u200bzero\u200dwidth", "a.\u0301 b", "1½²", "", " ", PLAIN]
    for text in odd:
        assert encoder.ids(text).tolist() == tokenizer.encode(text, add_special_tokens=False).ids, text


@pytest.mark.parametrize("table", ["docs", "small"])
def test_token_store(spark, request, table):
    df = request.getfixturevalue(table)
    tokenizer = Tokenizer.from_file(PATH)
    path = scratch_path(spark, "test-store")
    token_store.write(df, path, PATH, shard_ids=500)
    got = sorted((r["start"], r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in token_store.read(spark, path).collect())
    pairs = [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]
    pairs.sort(key=lambda p: (p[0] is not None, p[0] or 0, p[1] is not None, (p[1] or "").encode()))
    want, start = [], 0
    for doc_id, text in pairs:
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 2]
        want.append((start, doc_id, len(ids), crc(ids)))
        start += len(ids)
    assert got == want
    found = token_store.lookup(spark, path, [7, 11, 10**9]).collect()
    assert sorted(r["doc_id"] for r in found) == sorted(i for i, _ in pairs if i in (7, 11))
    texts = defaultdict(list)
    for i, t in pairs:
        texts[i].append([*tokenizer.encode(t or "", add_special_tokens=False).ids, 2])
    assert all(list(r["ids"]) in texts[r["doc_id"]] for r in found)


def test_perfect_hash_is_minimal_and_refuses_strangers():
    hashes = token_store.mixed_bits(np.arange(5000), 9)
    function = token_store.PerfectHash.build(hashes)
    assert sorted(function.slots(hashes).tolist()) == list(range(5000))
    row = token_store._shard(0, 0, [3, None, 9], [0, 0, 0], [np.array([1, 2], "<u2"), np.array([2], "<u2"), np.array([7, 8, 2], "<u2")])
    shard = token_store.Shard(row)
    slots = shard.find(np.array([9, 3, 4]), np.ones(3, bool), np.zeros(3, np.int64))
    assert shard.ids(slots[0]).tolist() == [7, 8, 2] and shard.ids(slots[1]).tolist() == [1, 2] and slots[2] == -1


def test_empty_tables(spark, empty):
    assert token_store.stored_ids(empty, PATH).count() == 0
    assert packing.packed(empty, PATH).count() == 0
    assert languages.predicted(empty).count() == 0
    assert quality.judged(empty).count() == 0
    assert simhash.near_duplicates(empty).count() == 0
    assert substrings.deduplicated(empty).count() == 0
    assert scoring.scored(empty.withColumn("held_out", F.lit(False))).count() == 0


@pytest.mark.parametrize("table", ["docs", "small"])
def test_packing(request, table):
    df = request.getfixturevalue(table)
    tokenizer = Tokenizer.from_file(PATH)
    got = packing.packed(df, PATH).toPandas()
    want = Counter()
    for r in df.select("doc_id", "text").collect():
        ids = [*tokenizer.encode(r["text"] or "", add_special_tokens=False).ids, 1]
        for piece, start in enumerate(range(0, len(ids), 4096)):
            want[(r["doc_id"], piece, start, len(ids[start : start + 4096]), crc(ids[start : start + 4096]))] += 1
    key = [None if np.isnan(x) else int(x) for x in got["doc_id"].astype(float)]
    assert Counter(zip(key, *(got[c].tolist() for c in ("piece", "start", "length", "ids_crc32")), strict=True)) == want
    for _, group in got.sort_values("offset").groupby("sequence_id"):
        assert (group["length"].cumsum() - group["length"] == group["offset"]).all() and group["length"].sum() <= 4096
    assert got["sequence_id"].nunique() <= -(-int(got["length"].sum()) // 4096) + 1


def test_plan_fills_bins():
    assert packing.fullest(10, [0, 0, 0, 2, 1, 0, 0, 1, 0, 0, 0]) == {3: 2, 4: 1} or packing.fullest(10, [0, 0, 0, 2, 1, 0, 0, 1, 0, 0, 0]) == {7: 1, 3: 1}
    rows = packing.plan({6: 2, 5: 1, 4: 2, 3: 1, 2: 1}, 10)
    assert max(r[3] for r in rows) + 1 == 3  # 6+4, 6+4, 5+3+2


def language_truth(text):
    return any(c.isalpha() for c in text or "")


def test_number_characters_are_no_letters():
    for text in ("½ ②", "²", "Ⅷ", "12 ٣", "_", ""):
        assert languages._WORD.findall(text) == []
    assert languages._WORD.findall("x²y 漢字 é½") == ["x", "y", "漢字", "é"]


def test_plain_words_skip_the_slow_set(monkeypatch):
    """The set with the number characters only splits runs that hold one; results are those of the set alone."""
    texts = ["Mixed ÉCOLE, 漢字 x_y 12a", "x²y 漢字 é½ plain", "ⅷ ² a", "", None]
    strict = languages._WORD
    assert [languages.letters_of(t) for t in texts] == [strict.findall((t or "").lower()) for t in texts]
    monkeypatch.setattr(languages, "_WORD", None)
    assert languages.letters_of(texts[0]) == ["mixed", "école", "漢字", "x", "y", "a"]


def test_languages(docs, small):
    got = languages.predicted(small).join(small.select("doc_id", "lang"), "doc_id").toPandas()
    held = got[got["held_out"]]
    assert (held["lang"] == held["lang_pred"]).mean() > 0.9
    assert set(got["held_out"] == [zlib.crc32(str(i).encode()) % 4 == 2 for i in got["doc_id"]]) == {True}
    mixed = languages.predicted(docs).collect()
    texts = {(r["doc_id"], r["text"]): r for r in docs.collect()}
    assert len(mixed) == len(texts) + 1  # one row is there twice
    for r in mixed:
        assert 0 <= r["score"] <= 1
    und = {r["doc_id"] for r in mixed if r["lang_pred"] == "und"}
    assert und == {i for i, t in texts if not language_truth(t)}
    assert {r["lang_pred"] for r in mixed if r["doc_id"] == 15} == {"ru"} or zlib.crc32(b"15") % 4 == 2


def test_paths_are_best_paths():
    rng = np.random.default_rng(0)
    scores, offsets = rng.normal(size=(300, 3)) * 5, np.array([0, 7, 7, 8, 90, 300])
    got = languages.paths(scores, offsets, 4.0)
    value = lambda path, s: sum(s[i, x] for i, x in enumerate(path)) - 4.0 * sum(a != b for a, b in zip(path, path[1:], strict=False))
    for a, b in zip(offsets, offsets[1:], strict=False):
        best = {x: scores[a, x] for x in range(3)} if b > a else {}
        for row in scores[a + 1 : b]:
            best = {x: max(best[y] - 4.0 * (x != y) for y in best) + row[x] for x in range(3)}
        if best:
            assert value(got[a:b], scores[a:b]) == pytest.approx(max(best.values()))


def test_quality_on_hard_cases(docs):
    rows = quality.judged(docs).collect()
    assert len(rows) == docs.count()
    for r in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", r["text"] or "")
        lines = [x for x in (r["text"] or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
        often = Counter(windows)
        covered = {p for i, w in enumerate(windows) if often[w] > 1 for p in range(i, i + 5)}
        assert (r["n_words"], r["word_chars"], r["n_dup_lines"], r["n_repeat_words"]) == (len(words), sum(map(len, words)), len(lines) - len(set(lines)), len(covered))
        assert r["n_symbols"] == len(re.findall(r"[#*$%&|<>]", r["text"] or ""))
        assert r["base_failed"] == (len(words) < 10 or 100 * len(covered) > 20 * len(words))
    assert all(r["kept"] for r in rows if r["text"] == PLAIN)


def simhash_truth(rows):
    import xxhash

    fps = []
    for _, text in rows:
        words = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())
        shingles = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
        ones = [sum(xxhash.xxh64_intdigest(s, 42) >> b & 1 for s in shingles) for b in range(64)]
        fps.append(sum(1 << b for b in range(64) if 2 * ones[b] > len(shingles)))
    fp = np.array(fps, np.uint64)
    near = np.bitwise_count(fp[:, None] ^ fp[None, :]) <= 4
    label = np.arange(len(fps))
    for _ in fps:
        new = np.where(near, label[None, :], len(fps)).min(axis=1)
        if (new == label).all():
            break
        label = new
    groups = defaultdict(list)
    for i, (doc_id, _) in enumerate(rows):
        groups[label[i]].append(doc_id)
    low = {k: min((x for x in v if x is not None), default=None) for k, v in groups.items()}
    return Counter((doc_id, f"{f:016x}", low[label[i]]) for i, ((doc_id, _), f) in enumerate(zip(rows, fps, strict=True)))


@pytest.mark.parametrize("table", ["docs", "small"])
def test_simhash(request, table):
    df = request.getfixturevalue(table)
    rows = [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]
    assert Counter(tuple(r) for r in simhash.near_duplicates(df).collect()) == simhash_truth(rows)


def test_simhash_links_of_large_keys(spark, monkeypatch):
    """One large group of near fingerprints: blocks meet in pairs, and few links connect all."""
    monkeypatch.setattr(simhash, "BLOCK", 40)
    rng = np.random.default_rng(3)
    base = int(rng.integers(1 << 62))
    fps = {base} | {base ^ sum(1 << int(b) for b in rng.choice(64, 2, replace=False)) for _ in range(300)} | {int(x) for x in rng.integers(1 << 62, size=50)}
    df = spark.createDataFrame([(x - (1 << 64) if x >> 63 else x,) for x in fps], "fp long")
    found = simhash.links(df, 4).distinct()
    assert found.count() < 20 * len(fps)  # all pairs are 45,000
    parts = {r["node"]: r["component"] for r in components(found).collect()}
    group = {parts.get(x if x < 1 << 63 else x - (1 << 64)) for x in fps if bin(x ^ base).count("1") <= 4}
    assert len(group) == 1 and sum(v in group for v in parts.values()) == sum(bin(x ^ base).count("1") <= 4 for x in fps)


def substrings_truth(rows):
    seen, out = set(), []
    for doc_id, text in rows:
        data = (text or "").encode()
        gone = bytearray(len(data))
        for s in range(len(data) - 99):
            window = data[s : s + 100]
            if window in seen:
                gone[s : s + 100] = b"\1" * 100
            seen.add(window)
        left = bytes(b for b, g in zip(data, gone, strict=True) if not g)
        spans = sum(1 for i, g in enumerate(gone) if g and (not i or not gone[i - 1]))
        out.append((doc_id, len(data), sum(gone), spans, hashlib.sha256(left).hexdigest()))
    return Counter(out)


@pytest.mark.parametrize(("table", "batches"), [("docs", 2), ("docs", 5), ("small", 2), ("small", 4)])
def test_substrings(request, table, batches):
    df = request.getfixturevalue(table)
    rows = [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]
    rows.sort(key=lambda p: (p[0] is not None, p[0] or 0, p[1] is not None, (p[1] or "").encode()))
    got = substrings.deduplicated(df, batches=batches).collect()
    assert Counter(tuple(r[c] for c in ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")) for r in got) == substrings_truth(rows)


def test_substring_levels_merge(spark, small):
    index = substrings.SuffixIndex(spark)
    docs = substrings.sequenced(small).select("_seq", "text")
    for i in range(5):
        index.add(docs.where(F.col("_seq").between(40 * i, 40 * i + 39)))
        sizes = [n for n, _ in index.levels]
        assert sum(sizes) == i + 1
    assert sizes == [4, 1]


def test_scoring(small):
    df = small.select("doc_id", languages.held_out(F.col("doc_id"), 10, 0).alias("held_out"), "text")
    rows = {r["doc_id"]: r for r in scoring.scored(df).collect()}
    texts = {r["doc_id"]: re.findall(rb"[^\x20\x09-\x0D]+", (r["text"] or "").encode().lower()) + [b""] for r in small.collect()}
    counts = Counter(t for i, ts in texts.items() if zlib.crc32(str(i).encode()) % 10 for t in ts)
    n, v = sum(counts.values()), len(counts)
    for i, ts in texts.items():
        r = rows[i]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (zlib.crc32(str(i).encode()) % 10 == 0, len(ts), sum(t in counts for t in ts), n)
        assert r["base_score"] == pytest.approx(sum(math.log10((counts[t] + 0.1) / (n + 0.1 * (v + 1))) for t in ts))
    learned = [r for r in rows.values() if not r["held_out"]]
    assert sum(r["score"] for r in learned) > sum(r["base_score"] for r in learned)


def test_scoring_hard_cases_and_normalised_classes(docs):
    rows = scoring.scored(docs.select("doc_id", F.lit(False).alias("held_out"), "text")).collect()
    assert len(rows) == docs.count() and all(r["score"] < 0 and r["n_tokens"] >= 1 for r in rows)
    pairs = np.random.default_rng(1).integers(0, 50, (20, 20)).astype(float)
    assert np.allclose((10 ** scoring.trained(pairs)).sum(axis=1), 1)


def test_components(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 102), (102, 101), (7, 7), (200, 100)], "a long, b long")
    got = {r["node"]: r["component"] for r in components(edges).collect()}
    assert {got[i] for i in range(61)} == {0} and {got[i] for i in (100, 101, 102, 200)} == {100}
    assert components(edges.where("false")).count() == 0
