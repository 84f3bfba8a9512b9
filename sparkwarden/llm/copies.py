"""Near copies by similarity: documents whose sets of word shingles overlap by a share, found through SimHash and verified.

Two texts are near copies when the Jaccard similarity of their sets of shingles is ``similarity`` or more.  Pairs are proposed
by SimHash: a sketch is WORDS fingerprints of 64 bits over the set, each of its own hash of the shingles.  At a similarity of
0.8 a bit differs with probability 0.15, so no field of a few bits agrees for sure; sketches meet under keys of KEY_BITS drawn
bits, as many keys as give RECALL (an estimate over independent bits) for a pair that is just similar enough.  Tables of pivot
distances, one per fingerprint, discard pairs before sketches are compared: the largest coordinate differences of the
fingerprints add up to a bound of the differing bits.  Survivors are proposals only; each is verified over the whole sets, and
only verified pairs link.

A group of n near copies has some n * n / 2 pairs, but n - 1 links connect it.  So a first pass over the keys hands each
sketch only its nearest earlier one: at most one pair a sketch, verified, and contracted to parts.  A second pass compares
all remaining pairs of sketches in different parts, under the same keys, so that no link between parts is lost.  There a pair
is proposed once, under the first key it shares, and only if it may be similar enough: MARKS bits of a set say whether an odd or
even number of its hashes falls to each bit's place, and each bit in which two sets differ is a hash that only one of them has.
That bound is exact, so it drops pairs that can't link and no others; a group of texts that are all a bit too different to link
is still compared all with all, but hands on few rows.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkwarden.llm.common import components, stored
from sparkwarden.llm.simhash import BITS, SEED, majority, pivots

#: Fingerprints of a sketch; bits of a key at least, and sketches that would share a key of random bits at most.
WORDS, KEY_BITS, SHARE = 4, 16, 4
#: Share of pairs of just the similarity asked for that meet under a key, and that lie within the radius.
RECALL, WITHIN = 0.95, 0.99
#: Bits of a set's parities.
MARKS = 1024
#: Rows of a key that are compared in one place; larger keys are cut into blocks, and blocks meet in pairs.
BLOCK = 2048
#: Pairs that are compared at a time; groups of up to SMALL rows go through the comparison side by side.
AT_ONCE, SMALL = 1 << 17, 16


def shingles(text: str | None, width: int) -> np.ndarray:
    """Different hashes of a text's word shingles, in order; all words are one shingle where there are fewer, none gives none."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    joined, width = b" ".join(words), min(width, len(words))
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-width] + 1)).tolist()
    digest = xxhash.xxh64_intdigest
    return np.unique(np.array([digest(joined[a:b], SEED) for a, b in zip(starts, ends[width - 1 :].tolist(), strict=True)], np.uint64))


def sketch(hashes: np.ndarray) -> list[int]:
    """The fingerprints of a set of hashes."""
    out = []
    for i in range(WORDS):
        x = hashes + np.uint64((i * 0x9E3779B97F4A7C15) & ((1 << 64) - 1))
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        out.append(majority(x ^ (x >> np.uint64(31))))
    return out


def key_bits(n: int) -> int:
    """Bits of a key for ``n`` sketches: they grow with the logarithm, so that keys don't fill up."""
    return max(KEY_BITS, math.ceil(math.log2(max(1, n / SHARE))))


def plan(similarity: float, width: int = KEY_BITS) -> tuple[int, int]:
    """Radius in bits, and number of keys of ``width`` bits, for pairs of this similarity."""
    bits = WORDS * BITS
    p = math.acos(2 * similarity / (1 + similarity)) / math.pi
    share = [math.comb(bits, d) * p**d * (1 - p) ** (bits - d) for d in range(bits + 1)]
    radius = next(r for r in range(bits + 1) if sum(share[: r + 1]) >= WITHIN)
    agree = [math.comb(bits - d, width) / math.comb(bits, width) for d in range(bits + 1)]
    tables = 1
    while sum(s * (1 - (1 - a) ** tables) for s, a in zip(share, agree, strict=True)) < RECALL:
        tables += 1
    return radius, tables


WORD_NAMES = [f"w{i}" for i in range(WORDS)]
MARK_NAMES = ["n_hashes", *[f"m{i}" for i in range(MARKS // 64)]]
SKETCH = ", ".join(f"{w} long" for w in WORD_NAMES)


def sets(docs: DataFrame, width: int) -> DataFrame:
    """doc_id, set (a hash of all shingles, 16 bytes) and the sketch of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, words = [], np.zeros((batch.num_rows, WORDS), np.uint64)
            for i, text in enumerate(batch.column(1)):
                hashes = shingles(text.as_py(), width)
                names.append(xxhash.xxh3_128_digest(hashes.tobytes(), SEED))
                if len(hashes):
                    words[i] = sketch(hashes)
            columns = [pa.array(np.ascontiguousarray(words[:, i]).view(np.int64)) for i in range(WORDS)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names, pa.binary()), *columns], ["doc_id", "set", *WORD_NAMES])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id long, set binary, {SKETCH}")


def marked(whole: DataFrame) -> DataFrame:
    """doc_id, n_hashes and the parities of every set of ``whole`` (doc_id, hashes)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            marks = np.zeros((batch.num_rows, MARKS // 64), np.int64)
            sizes = np.zeros(batch.num_rows, np.int64)
            for i, found in enumerate(batch.column(1)):
                hashes = found.values.to_numpy()
                sizes[i] = len(hashes)
                odd = (np.bincount(hashes & (MARKS - 1), minlength=MARKS) & 1).astype(np.uint8)
                marks[i] = np.packbits(odd).view(np.int64)
            columns = [pa.array(sizes), *[pa.array(np.ascontiguousarray(m)) for m in marks.T]]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], ["doc_id", *MARK_NAMES])

    return whole.select("doc_id", "hashes").mapInArrow(run, "doc_id long, " + ", ".join(f"{m} long" for m in MARK_NAMES))


def _may_link(marks: np.ndarray, i: np.ndarray, j: np.ndarray, similarity: float) -> np.ndarray:
    """Which pairs (i, j) of columns of ``marks`` (n_hashes, parities) can have the similarity: hashes of one set only are at least the bits that differ."""
    apart = np.bitwise_count((marks[1:, i] ^ marks[1:, j]).view(np.uint64)).sum(axis=0, dtype=np.int64)
    apart = np.maximum(apart, np.abs(marks[0, i] - marks[0, j]))
    both = marks[0, i] + marks[0, j]
    return both - apart + 1e-6 >= similarity * (both + apart)


def _drawn(tables: int, width: int) -> list[np.ndarray]:
    """The bits of each key."""
    rng = np.random.default_rng(SEED)
    return [rng.choice(WORDS * BITS, width, replace=False) for _ in range(tables)]


def _keys(words: np.ndarray, tables: int, width: int) -> np.ndarray:
    """The keys (columns) of each sketch (rows)."""
    bits = np.unpackbits(words.astype(">u8").view(np.uint8).reshape(len(words), -1), axis=1)
    weights = 1 << np.arange(width, dtype=np.int64)
    return np.stack([(t << width) + bits[:, drawn] @ weights for t, drawn in enumerate(_drawn(tables, width))], axis=1)


def _met_first(words: np.ndarray, i: np.ndarray, j: np.ndarray, table: np.ndarray, tables: int, width: int) -> np.ndarray:
    """Which pairs (i, j) of sketches share no key before that of ``table``."""
    differ, alone = words[i] ^ words[j], np.ones(len(i), bool)
    for t, drawn in enumerate(_drawn(tables, width)):
        bits = np.zeros(WORDS * BITS, np.uint8)
        bits[drawn] = 1
        mask = np.packbits(bits).view(">u8").astype(np.uint64)
        alone &= (table <= t) | (differ & mask).any(axis=1)
    return alone


def _words(batch: pa.RecordBatch) -> np.ndarray:
    return np.stack([batch.column(w).to_numpy().view(np.uint64) for w in WORD_NAMES], axis=1)


def keyed(classes: DataFrame, tables: int, width: int, marks: list[str]) -> DataFrame:
    """k, block, other, side, first, part, the sketch and ``marks``: every class under each of its keys; blocks as in :func:`simhash.link_keys`."""
    carried = ["first", "part", *WORD_NAMES, *marks]

    def sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            k, n = np.unique(_keys(_words(batch), tables, width), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(k, pa.int64()), pa.array(n, pa.int64())], ["k", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 1000):
                batch = whole.slice(at, 1000)
                again = np.repeat(np.arange(batch.num_rows), tables)
                columns = [batch.column(c).take(pa.array(again)) for c in carried]
                yield pa.RecordBatch.from_arrays([pa.array(_keys(_words(batch), tables, width).ravel(), pa.int64()), *columns], ["k", *carried])

    heavy = stored(classes.select(*WORD_NAMES).mapInArrow(sizes, "k long, n long").groupBy("k").agg(F.sum("n").alias("n")).where(F.col("n") > BLOCK), "heavy-keys")
    rows = classes.select(*carried).mapInArrow(run, "k long, " + ", ".join(f"{c} long" for c in carried)).join(heavy, "k", "left")
    count = F.ceil(F.col("n") / BLOCK).cast("int")
    block = F.pmod(F.xxhash64("first"), count).cast("int")
    met = F.when(F.col("n").isNull(), F.array(F.struct(F.lit(-1).alias("b"), F.lit(-1).alias("o"), F.lit(0).alias("s")))).otherwise(
        F.transform(
            F.sequence(F.lit(0), count - 1),
            lambda o: F.struct(F.least(block, o).alias("b"), F.greatest(block, o).alias("o"), F.when(block <= o, 0).otherwise(1).alias("s")),
        )
    )
    return rows.select("k", F.explode(met).alias("m"), *carried).select("k", F.col("m.b").alias("block"), F.col("m.o").alias("other"), F.col("m.s").alias("side"), *carried)


def _tables(words: np.ndarray) -> np.ndarray:
    """Distances of each fingerprint to the pivots."""
    return np.bitwise_count(words[:, :, None] ^ pivots()[None, None, :]).astype(np.int8)


def _close(words: np.ndarray, tables: np.ndarray, i: np.ndarray, j: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Those pairs (i, j) within ``radius`` bits, and their distances: first by the tables, then bit by bit."""
    near = np.zeros(len(i), np.int64)
    for w in range(WORDS):
        near += np.abs(tables[i, w] - tables[j, w]).max(axis=1)
    i, j = i[near <= radius], j[near <= radius]
    distance = np.bitwise_count(words[i] ^ words[j]).sum(axis=1, dtype=np.int64)
    keep = distance <= radius
    return i[keep], j[keep], distance[keep]


def _sketches(rows: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(rows[6 : 6 + WORDS].T).view(np.uint64)


def _met(rows: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Close pairs (i, j, distance) of columns of ``rows`` (k, block, other, side, first, part, sketch), sorted by group; of different parts."""
    if not rows.shape[1]:
        return
    part, words = rows[5], _sketches(rows)
    tables = _tables(words)
    starts = np.flatnonzero(np.concatenate(([True], (rows[:3, 1:] != rows[:3, :-1]).any(axis=0))))
    sizes = np.diff(np.concatenate((starts, [rows.shape[1]])))
    apart = rows[1, starts] != rows[2, starts]
    group = np.repeat(np.arange(len(starts)), sizes)
    small = (sizes <= SMALL) & ~apart
    index = np.flatnonzero(np.repeat(small & (sizes > 1), sizes))
    for shift in range(1, SMALL):  # the small groups, side by side
        at = np.flatnonzero(group[index[:-shift]] == group[index[shift:]])
        if not len(at):
            break
        for x in range(0, len(at), AT_ONCE):
            i, j = index[at[x : x + AT_ONCE]], index[at[x : x + AT_ONCE] + shift]
            other = part[i] != part[j]
            yield _close(words, tables, i[other], j[other], radius)
    for s, size, two in zip(starts[~small].tolist(), sizes[~small].tolist(), apart[~small].tolist(), strict=True):
        at = np.arange(s, s + size)
        left, right = (at[rows[3, at] == 0], at[rows[3, at] == 1]) if two else (at, at)
        if not len(left) or not len(right):
            continue
        step = max(1, AT_ONCE // len(right))
        for x in range(0, len(left), step):
            some = left[x : x + step]
            differ = part[some][:, None] != part[right][None, :]
            if not two:
                differ &= some[:, None] < right[None, :]
            i, j = np.nonzero(differ)
            yield _close(words, tables, some[i], right[j], radius)


def _passed(classes: DataFrame, bits: tuple[int, int, int], found: Callable[[np.ndarray], Iterator[pa.RecordBatch]], schema: str, marks: list[str]) -> DataFrame:
    """``found`` over the sorted rows of whole keys (or blocks of them); ``bits`` are the keys, their width and the radius."""
    tables, width, _ = bits
    n = int(classes.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros((6 + WORDS + len(marks), 0), np.int64)
        for batch in batches:
            rows = np.concatenate([held, np.stack([c.to_numpy(zero_copy_only=False).astype(np.int64) for c in batch.columns])], axis=1)
            # The last group may go on in the next batch.
            changes = np.flatnonzero((rows[:3, 1:] != rows[:3, :-1]).any(axis=0))
            cut = int(changes[-1]) + 1 if len(changes) else 0
            yield from found(rows[:, :cut])
            held = rows[:, cut:]
        yield from found(held)

    order = ["k", "block", "other"]
    return keyed(classes, tables, width, marks).repartition(n, *order).sortWithinPartitions(*order).mapInArrow(run, schema)


def nearest(classes: DataFrame, bits: tuple[int, int, int]) -> DataFrame:
    """first, near: every class (first, part, sketch) with another close one, and the nearest of these with a smaller ``first``, or null."""
    radius = bits[2]

    def found(rows: np.ndarray) -> Iterator[pa.RecordBatch]:
        first = rows[4]
        best: list[np.ndarray] = []  # first, distance, near; radius + 1 and itself where there is only a later one
        for i, j, distance in _met(rows, radius):
            a, b = np.minimum(first[i], first[j]), np.maximum(first[i], first[j])
            some = np.concatenate((np.stack((b, distance, a)), np.stack((a, np.full(len(a), radius + 1), a))), axis=1)
            best.append(_lowest(some))
            if sum(x.shape[1] for x in best) > 4 * AT_ONCE:
                best = [_lowest(np.concatenate(best, axis=1))]
        if best:
            out = _lowest(np.concatenate(best, axis=1))
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in out], ["first", "distance", "near"])

    rows = _passed(classes, bits, found, "first long, distance long, near long", [])
    least = rows.groupBy("first").agg(F.min(F.struct("distance", "near")).alias("m"))
    return least.select("first", F.when(F.col("m.near") < F.col("first"), F.col("m.near")).alias("near"))


def _lowest(rows: np.ndarray) -> np.ndarray:
    """The smallest (distance, near) of each first."""
    rows = rows[:, np.lexsort(rows[::-1])]
    return rows[:, np.concatenate(([True], rows[0, 1:] != rows[0, :-1]))] if rows.shape[1] else rows


def between(classes: DataFrame, bits: tuple[int, int, int], similarity: float | None = None) -> DataFrame:
    """Pairs (a < b) of close classes (first, part, sketch) in different parts, each once.

    With a ``similarity`` the classes have the columns of :func:`marked` too, and pairs that can't have it are left out.
    """
    tables, width, radius = bits

    def found(rows: np.ndarray) -> Iterator[pa.RecordBatch]:
        first, words = rows[4], _sketches(rows)
        for i, j, _ in _met(rows, radius):
            if similarity is not None:
                kept = _may_link(rows[6 + WORDS :], i, j, similarity)
                i, j = i[kept], j[kept]
            alone = _met_first(words, i, j, rows[0, i] >> width, tables, width)
            i, j = i[alone], j[alone]
            if len(i):
                pairs = [np.minimum(first[i], first[j]), np.maximum(first[i], first[j])]
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in pairs], ["a", "b"])

    return _passed(classes, bits, found, "a long, b long", [] if similarity is None else MARK_NAMES)


def hashed(docs: DataFrame, ids: DataFrame, width: int) -> DataFrame:
    """doc_id, hashes: the set of shingles of those documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [shingles(t.as_py(), width).view(np.int64) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(pa.int64()))], ["doc_id", "hashes"])

    return docs.select("doc_id", "text").join(ids, "doc_id", "left_semi").mapInArrow(run, "doc_id long, hashes array<long>")


def verified(whole: DataFrame, pairs: DataFrame, similarity: float) -> DataFrame:
    """Those pairs (a, b) of doc_ids whose sets of shingles (``whole``: doc_id, hashes) have the similarity."""
    sides = [whole.select(F.col("doc_id").alias(c), F.col("hashes").alias(f"_{c}")) for c in ("a", "b")]
    both = pairs.join(sides[0], "a").join(sides[1], "b")
    shared = F.size(F.array_intersect("_a", "_b"))
    return both.where(shared + 1e-9 >= similarity * (F.size("_a") + F.size("_b") - shared)).select("a", "b")


def groups(docs: DataFrame, width: int = 5, similarity: float = 0.8) -> DataFrame:
    """first, component_id: the smallest doc_id of each set of shingles, and the smallest one that verified links reach from it.

    ``docs`` has a doc_id of its own for each row; a null text is empty, and texts without a word are one set.
    """
    classes = stored(sets(docs, width).groupBy("set").agg(F.min("doc_id").alias("first"), *[F.first(w).alias(w) for w in WORD_NAMES]), "sets")
    own = classes.select("first", F.col("first").alias("part"), *WORD_NAMES)
    bits = key_bits(classes.count())
    radius, tables = plan(similarity, bits)
    near = stored(nearest(own, (tables, bits, radius)), "nearest")
    whole = stored(hashed(docs, near.select(F.col("first").alias("doc_id")), width), "shingles")
    links = stored(verified(whole, near.where("near is not null").select(F.col("near").alias("a"), F.col("first").alias("b")), similarity), "links")
    parts = components(links).select(F.col("node").alias("first"), F.col("component").alias("_part"))
    met = own.join(marked(whole).withColumnRenamed("doc_id", "first"), "first").join(parts, "first", "left")
    met = stored(met.select("first", F.coalesce("_part", "part").alias("part"), *WORD_NAMES, *MARK_NAMES), "parts")
    rest = stored(between(met, (tables, bits, radius), similarity), "candidates")
    joined = components(links.unionByName(verified(whole, rest, similarity)))
    return classes.select("first").join(joined.withColumnRenamed("node", "first"), "first", "left").select("first", F.coalesce("component", "first").alias("component_id"))
