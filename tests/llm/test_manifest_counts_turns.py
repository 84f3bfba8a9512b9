"""Token cache, Merkle manifest and conversation repair against brute force and on hard cases."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter

import public_tokenizers
import pytest
from cases import documents, rows
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from sparkwarden.llm import conversations, hot, manifest, queries, token_counts
from sparkwarden.llm.common import scratch_path, stored

SF = "/root/testdata/sf0.001"
WORDS, BYTES, PIECES = (public_tokenizers.path(n) for n in ("word_bpe_49k.json", "byte_bpe_50k.json", "piece_bpe_32k.model"))
ODD = ["<|endoftext|> a", "<|ENDOFTEXT|> a", "A  B\n\tc", "a b c", "T̈ Ä", "x y", "x\x0by", "DON'T  stop", "don't stop", "\n", "İ I i"]


@pytest.fixture(scope="module")
def docs(spark):
    return documents(spark)


# -- token counts -----------------------------------------------------------------------
def library_count(path):
    if path.endswith(".model"):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        return lambda t: len(model.encode(t))
    tokenizer = Tokenizer.from_file(path)
    return lambda t: len(tokenizer.encode(t, add_special_tokens=False).ids)


def count_truth(data, path, limit=2048):
    count = library_count(path)
    return Counter((i, len((t or "").encode()), n := count(t or ""), n > limit) for i, t in data)


def as_counts(df):
    return Counter((r["doc_id"], r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in df.collect())


@pytest.mark.parametrize("path", [WORDS, BYTES, PIECES])
def test_counts_are_the_library_s(spark, path):
    data = [(r[0], r[1]) for r in rows()] + [(100 + i, t) for i, t in enumerate(ODD)]
    df = documents(spark, rows() + [(100 + i, t, None, None, None, 1, 1, None, 1) for i, t in enumerate(ODD)])
    assert as_counts(token_counts.counted(df, path, scratch_path(spark, "cache"))) == count_truth(data, path)


def test_normal_form_keeps_counts_and_joins_texts(spark):
    rng = random.Random(7)
    alphabet = "aAbBzZ  \n\t\x0b\x0c\r.,'sS1½́̈éÉßİΣ漢<|endoftext|>😀  "
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randrange(30))) for _ in range(400)] + ODD
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    count = library_count(WORDS)
    for r in df.select("text", token_counts.normal_form(F.col("text"), WORDS).alias("n")).collect():
        assert count(r["text"]) == count(r["n"]), (r["text"], r["n"])
    same = spark.createDataFrame([("A  b\n",), (" a B",)], "text string").select(token_counts.normal_form(F.col("text"), WORDS)).distinct()
    assert same.count() == 1
    assert [r[0] for r in spark.createDataFrame([("A  b\n",)], "text string").select(token_counts.normal_form(F.col("text"), BYTES)).collect()] == ["A  b\n"]


def test_cache_encodes_only_what_it_lacks(spark, docs):
    cache = scratch_path(spark, "cache")
    first = as_counts(token_counts.counted(docs, WORDS, cache, limit=50))
    assert first == count_truth([(r[0], r[1]) for r in rows()], WORDS, 50)
    size = spark.read.parquet(cache).count()
    form = token_counts.normal_form(F.col("text"), WORDS)
    assert size == docs.select(form).distinct().count()
    assert as_counts(token_counts.counted(docs, WORDS, cache, limit=50)) == first
    assert spark.read.parquet(cache).count() == size  # nothing was missing, nothing was added
    wrong = token_counts.cached(spark, cache, WORDS).select("digest", F.lit(7).cast("long").alias("n_tokens"))
    stored(wrong, "wrong").write.mode("overwrite").parquet(f"{cache}/version={token_counts.version(WORDS)}")
    assert {r["n_tokens"] for r in token_counts.counted(docs, WORDS, cache).collect()} == {7}  # counts come from the cache
    more = documents(spark, [*rows(), (50, "a text that is new here", None, None, 1, 1, 1, None, 1)])
    token_counts.counted(more, WORDS, cache).count()
    assert spark.read.parquet(cache).count() == size + 1
    token_counts.counted(docs, BYTES, cache).count()  # another version has counts of its own
    assert as_counts(token_counts.counted(docs, BYTES, cache)) == count_truth([(r[0], r[1]) for r in rows()], BYTES)


def test_many_misses_meet_by_a_shuffle(spark, docs, monkeypatch):
    monkeypatch.setattr(token_counts, "BROADCAST_MISSES", 0)
    assert as_counts(token_counts.counted(docs, WORDS, scratch_path(spark, "cache"))) == count_truth([(r[0], r[1]) for r in rows()], WORDS)


def test_counts_of_an_empty_table(spark, docs):
    assert token_counts.counted(docs.where("false"), WORDS, scratch_path(spark, "cache")).count() == 0
    with pytest.raises(ValueError):
        token_counts.Counter("x.tiktoken")


def test_spread_join(spark, monkeypatch):
    left = stored(spark.createDataFrame([("hot" if i % 3 else f"k{i % 7}", i) for i in range(300)] + [(None, -1), ("none", -2)], "k string, v long"), "left")
    right = stored(spark.createDataFrame([("hot", 1, 200), *[(f"k{i}", 2, 14) for i in range(7)]], "k string, w long, n long"), "right")
    want = Counter((r["k"], r["v"], r["w"]) for r in left.join(right, "k").collect())
    for share in (1000, 10, 1):
        monkeypatch.setattr(hot, "HOT_SHARE", share)
        assert Counter((r["k"], r["v"], r["w"]) for r in hot.spread_join(left, right, "k", "n").collect()) == want


# -- Merkle manifest ----------------------------------------------------------------------
def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_of(row):
    return H(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in row])


def climb(level):
    out = [level]
    while len(level) > 1:
        level = [H(*level[i : i + 3]) for i in range(0, len(level), 3)]
        out.append(level)
    return out


def walk(levels, pos, value):
    """Siblings of a leaf and the root that ``value`` gives in its place."""
    siblings = []
    for level in levels[:-1]:
        run = list(range(pos - pos % 3, min(pos - pos % 3 + 3, len(level))))
        siblings += [level[i] for i in run if i != pos]
        value = H(*[value if i == pos else level[i] for i in run])
        pos //= 3
    return siblings, value


def manifest_truth(data):
    """data: (doc_id, source, lang, n_chars, text)"""
    by_source = {}
    for row in data:
        by_source.setdefault(row[1], []).append(row)
    names = sorted(by_source, key=lambda s: (s is not None, (s or "").encode()))
    trees, order = {}, {}
    for s in names:
        order[s] = sorted(by_source[s], key=lambda r: (r[0] is not None, r[0] or 0, leaf_of(r)))
        trees[s] = climb([leaf_of(r) for r in order[s]])
    top = climb([trees[s][-1][0] for s in names])
    out = Counter()
    for k, s in enumerate(names):
        for pos, r in enumerate(order[s]):
            text = r[4]
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0 and text is not None:
                text = text.replace("\n", "")
            low, value = walk(trees[s], pos, leaf_of((*r[:4], text)))
            high, value = walk(top, k, value)
            out[r[0], leaf_of(r), trees[s][-1][0], top[-1][0], H(*low, *high), value, value == top[-1][0]] += 1
    return out


def as_manifest(df):
    return Counter((r["doc_id"], r["leaf"], r["subroot"], r["root"], r["proof_sha256"], r["folded_root"], r["verified"]) for r in df.collect())


def manifest_rows(n=0):
    """The hard cases, and ``n`` more in one source."""
    base = [(i, source, lang, chars, text) for i, text, lang, source, chars, *_ in rows()]
    return base + [(1000 + i, "hot", None if i % 5 else "en", i, f"line {i}\nand {i * i}" if i % 4 else None) for i in range(n)]


def frame(spark, data):
    return stored(spark.createDataFrame([(*r, 9, "x") for r in data], "doc_id long, source string, lang string, n_chars long, text string, level int, digest string").repartition(3), "manifest-cases")


@pytest.mark.parametrize("levels", [1, 2, 6])
def test_manifest(spark, levels, monkeypatch):
    monkeypatch.setattr(manifest, "LEVELS", levels)
    monkeypatch.setattr(manifest, "BLOCK", 3**levels)
    data = manifest_rows(40)
    df = frame(spark, data)
    assert as_manifest(manifest.verified(df, manifest.even(F.col("doc_id")))) == manifest_truth(data)


def test_manifest_small_tables(spark):
    one = manifest_rows()[:1]
    df = frame(spark, one)
    got = manifest.verified(df, manifest.even(F.col("doc_id"))).collect()
    assert Counter(tuple(r) for r in got) == manifest_truth(one)
    assert got[0]["root"] == got[0]["leaf"] and got[0]["proof_sha256"] == hashlib.sha256(b"").hexdigest()
    assert manifest.verified(df.where("false")).count() == 0
    assert all(r["verified"] for r in manifest.verified(frame(spark, manifest_rows())).collect())  # nobody tampers


def test_octopus_is_minimal():
    """The union is enough to derive the root, and no part of it can be left out."""
    rng = random.Random(3)
    for n in (1, 2, 3, 4, 10, 28, 82):
        levels = climb([H(str(i)) for i in range(n)])
        for _ in range(5):
            wanted = rng.sample(range(n), rng.randint(1, n))
            need = manifest.missing(wanted, n)
            derived = manifest.interiors({p: bytes.fromhex(levels[0][p]) for p in wanted}, {(at, i): bytes.fromhex(levels[at][i]) for at, i in need}, n)
            assert derived[-1][0].hex() == levels[-1][0]
            known = {(0, p) for p in wanted}
            for at, i in need:  # not derivable from wanted leaves
                assert not any(p // 3**at == i for p in wanted) and (at, i) not in known
            for p in wanted:
                siblings, _ = walk(levels, p, "")
                found = b"".join(bytes.fromhex(x) for x in siblings)
                assert manifest.fold(bytes.fromhex(levels[0][p]), p, n, found).hex() == levels[-1][0]


def test_proofs_of_some_leaves(spark):
    """A part of the leaves is proved with nodes fetched from the stored tree."""
    data = [(i, "s", "en", i, f"text {i}") for i in range(100)]
    leaves = manifest.placed(stored(frame(spark, data).select(
        F.col("doc_id").alias("id"), manifest.tree_name(F.col("source")).alias("tree"),
        manifest.leaf_digest(*[F.col(c) for c in ("doc_id", "source", "lang", "n_chars", "text")]).alias("digest")).withColumn("other", F.col("digest")), "leaves"))
    found = manifest.proofs(leaves.where("id IN (3, 4, 77)"), manifest.nodes(leaves)).collect()
    levels = climb([leaf_of(r) for r in data])
    assert {r["id"]: (r["siblings"].hex(), r["root"].hex()) for r in found} == {p: ("".join(walk(levels, p, "")[0]), levels[-1][0]) for p in (3, 4, 77)}


def test_unchanged_leaves_are_folded_too(spark):
    """A root that the tree does not have is found out by proofs of leaves that nobody changed."""
    data = [(i, "s", "en", i, f"text {i}") for i in range(20)]
    leaves = manifest.placed(stored(frame(spark, data).select(
        F.col("doc_id").alias("id"), manifest.tree_name(F.col("source")).alias("tree"),
        manifest.leaf_digest(*[F.col(c) for c in ("doc_id", "source", "lang", "n_chars", "text")]).alias("digest")).withColumn("other", F.col("digest")), "leaves"))
    up, forged = hashlib.sha256(b"beside").digest(), hashlib.sha256(b"forged").digest()
    upper = spark.createDataFrame([("=s", 0, 2, up, forged)], "tree string, pos long, n long, siblings binary, root binary")
    found = manifest.proofs(leaves, manifest.nodes(leaves), upper).collect()
    subroot = climb([leaf_of(r) for r in data])[-1][0]
    assert len(found) == 20
    assert {(r["root"].hex(), r["folded"].hex()) for r in found} == {(forged.hex(), H(subroot, up.hex()))}


# -- conversations --------------------------------------------------------------------------
def damage_truth(data):
    out = []
    for conv, turn, role, text in data:
        h = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if h == 0:
            continue
        text = "" if h == 1 else re.sub("[.!?]", "", text) if h == 2 else text
        out += [(conv, turn, "user" if h == 4 else role, text)] * (2 if h == 3 else 1)
    return out


def repair_truth(data, everyone):
    """Faults by their definition; the cheapest audits by keeping all of them."""
    out = Counter()
    for conv in everyone:
        mine = sorted((r for r in data if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0, r[2], hashlib.sha256(r[3].encode()).digest()))
        faults, seen = [], set()
        for _, _, role, text in mine:
            body = re.findall(r"[^\x20\x09-\x0D]", text)
            faults.append("blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else None)
            seen.add((role, text))
        turns = [r[1] for r in mine if r[1] is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in zip(mine, mine[1:]))
        best = {}  # roles' initials so far, audit, texts -> by (row, state): cheapest cost and every way

        def put(i, state, cost, ways):
            now = best.setdefault((i, state), [cost, set()])
            if cost < now[0]:
                now[0], now[1] = cost, set()
            if cost == now[0]:
                now[1] |= ways

        step = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}
        put(0, "", 0, {("", ())})
        for i in range(len(mine) + 1):
            for _ in range(5):
                for state in ("", "s", "u", "a"):
                    if (i, state) in best:
                        for role in ("user", "assistant"):
                            if (to := step.get((state, role[0]))) is not None:
                                cost, ways = best[i, state]
                                put(i, to, cost + 5, {(a + "I", t + (f"{role}:",)) for a, t in ways})
            if i == len(mine):
                break
            _, _, role, text = mine[i]
            for state in ("", "s", "u", "a"):
                if (i, state) not in best:
                    continue
                cost, ways = best[i, state]
                put(i + 1, state, cost + 2, {(a + "D", t) for a, t in ways})
                if faults[i] in ("blank", "duplicate"):
                    continue
                more = 5 if faults[i] == "truncated" else 0
                if (to := step.get((state, role[:1]))) is not None:
                    put(i + 1, to, cost + more, {(a + "K", t + (f"{role}:{text}",)) for a, t in ways})
                for other in ("user", "assistant"):
                    if (to := step.get((state, other[0]))) is not None:
                        put(i + 1, to, cost + 1 + more, {(a + "R", t + (f"{other}:{text}",)) for a, t in ways})
        ends = [best[len(mine), s] for s in ("", "a") if (len(mine), s) in best]
        cost = min(e[0] for e in ends)
        audit, texts = min(w for e in ends if e[0] == cost for w in e[1])
        n = Counter(faults)
        out[conv, gaps, n["blank"], n["duplicate"], n["truncated"], illegal, cost, audit, hashlib.sha256("\n".join(texts).encode()).hexdigest()] += 1
    return out


def turns(seed=1):
    rng = random.Random(seed)
    data = [(c, t, rng.choice(["user", "assistant", "system", "user", "assistant", "tool", "s", "", None]), rng.choice(["Fine.", "cut", " \n", "", None, "Yes! ", "same.", "é?\t", "no"]))
            for c in range(60) for t in rng.sample(range(12), rng.randrange(1, 8))]
    data += [(None, 1, "user", "Hi."), (None, 2, "assistant", "Ho."), (None, None, "user", "first."), (100, None, "user", "a."), (100, None, "user", "a."), (101, None, None, None)]
    data += [(102, 5, "user", "x."), (102, 5, "assistant", "y."), (102, -3, "system", "z."), (103, 1, "Ünser", "w."), (104, 1, "user", "long. " * 20_000), (104, 2, "assistant", "ok.")]
    return data


def talks(spark, data):
    return stored(spark.createDataFrame([(*r, 1, "k") for r in data], "conv_id long, turn long, role string, text string, pos int, symbol string").repartition(3), "talks")


def as_repairs(df):
    cols = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    return Counter(tuple(r[c] for c in cols) for r in df.collect())


@pytest.mark.parametrize("segment", [1, 3, 512])
def test_conversations(spark, segment, monkeypatch):
    monkeypatch.setattr(conversations, "SEGMENT", segment)
    data = turns()
    df = talks(spark, data)
    broken = conversations.damaged(df)
    truth = damage_truth(data)
    assert Counter(map(tuple, broken.collect())) == Counter(truth)
    assert as_repairs(conversations.assessed(broken, df)) == repair_truth(truth, {r[0] for r in data})


def test_conversations_of_the_table(spark):
    df = spark.read.parquet(f"{SF}/conversations.parquet")
    data = [tuple(r) for r in df.select("conv_id", "turn", "role", "text").collect()]
    assert as_repairs(queries.op13_conversations(spark, SF)) == repair_truth(damage_truth(data), {r[0] for r in data})


def test_no_conversations(spark):
    df = talks(spark, turns()).where("false")
    assert conversations.assessed(conversations.damaged(df), df).count() == 0
    empty = conversations.assessed(df, talks(spark, [(7, 1, "user", "x")])).collect()
    assert [tuple(r) for r in empty] == [(7, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]


def test_repaired_rows_fit_the_grammar(spark):
    found = {}
    for r in conversations.repaired(talks(spark, turns(2))).orderBy("conv_id", "step").collect():
        found.setdefault(r["conv_id"], []).append(r)
    assert found
    for steps in found.values():
        assert [r["step"] for r in steps] == list(range(len(steps)))
        assert re.fullmatch("(s?(ua)+)?", "".join(r["role"][:1] for r in steps if r["edit"] != "D"))


def test_suffixes_are_shared(monkeypatch):
    """A node is made once, however many segments end in it."""
    made = []
    real = conversations.node
    monkeypatch.setattr(conversations, "node", lambda symbol, behind: made.append(symbol) or real(symbol, behind))
    segments = sorted(["sua", "xua", "ua", "uaua", "Uaua", "x", "sx"], key=lambda s: s[::-1])
    automaton = conversations.Automaton()
    tables = [automaton.table(s) for s in segments]
    assert len(made) == len({s[i:] for s in segments for i in range(len(s))})
    for s, table in zip(segments, tables):
        alone = conversations.END
        for symbol in reversed(s):
            alone = real(symbol, alone)
        assert table == alone
