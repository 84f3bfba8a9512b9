"""SimHash near-duplicates: fingerprints of word shingles, linked through tables of pivot distances.

Fingerprints are 64 bits; the table of a fingerprint holds its Hamming distances to a fixed list of
reference fingerprints (pivots).  Two fingerprints that differ in ``most`` bits differ by at most
``most`` in every coordinate of their tables, so a larger coordinate difference discards a pair, and
only survivors are compared bit by bit.

One coordinate keeps about half of all random pairs, so the table alone is no source of pairs: pairs
come from keys.  The bits are cut into ``most + 2`` fields; two fingerprints within ``most`` bits agree
in two fields at least, and meet under that pair of fields.  Each key's rows are sorted side by side and
compared there; no pair is written but links that are needed to connect a key's fingerprints.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkwarden.llm.common import components, stored

BITS = 64
SEED = 42
PIVOTS = 16
#: Rows of a key that are compared in one place; larger keys are cut into blocks, and blocks meet in pairs.
BLOCK = 4096


def pivots(n: int = PIVOTS) -> np.ndarray:
    """The reference fingerprints."""
    return np.array([xxhash.xxh64_intdigest(f"pivot {i}".encode(), SEED) for i in range(n)], np.uint64)


def fingerprint(text: str | None, width: int = 4) -> int:
    """SimHash of a text: A-Z lower-cased, word shingles with repeats, a bit set in over half the hashes."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    if len(words) <= width:
        return xxhash.xxh64_intdigest(b" ".join(words), SEED)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[: -width] + 1)).tolist()
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(joined[a:b], SEED) for a, b in zip(starts, ends[width - 1 :].tolist(), strict=True)], np.uint64)
    return majority(hashes)


def majority(hashes: np.ndarray) -> int:
    """A 64-bit number whose bits are 1 where over half of ``hashes`` have 1."""
    n, ones = len(hashes), np.zeros(BITS, np.int64)
    for at in range(0, n, 1 << 15):  # unpacked bits of a part of a long text only
        bits = np.unpackbits(hashes[at : at + (1 << 15)].astype(">u8").view(np.uint8)).reshape(-1, BITS)
        ones += bits.sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big")


def with_fingerprints(docs: DataFrame, width: int = 4) -> DataFrame:
    """doc_id, fp (the 64 bits as a signed long) of every document; a null text counts as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [fingerprint(t, width) for t in batch.column(1).to_pylist()]
            fps = pa.array(np.array(found, np.uint64).view(np.int64), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), fps], ["doc_id", "fp"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, fp long")


def fields(most: int) -> list[int]:
    """Masks of ``most + 2`` fields that cover all bits."""
    edges = [BITS * i // (most + 2) for i in range(most + 3)]
    return [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(edges, edges[1:], strict=False)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _tables(fps: np.ndarray) -> np.ndarray:
    return np.bitwise_count(fps[:, None] ^ pivots()[None, :]).astype(np.int16)


def _close(fps: np.ndarray, tables: np.ndarray, i: np.ndarray, j: np.ndarray, most: int) -> np.ndarray:
    """Which pairs (i, j) are within ``most`` bits: first by the tables, then bit by bit."""
    out = np.abs(tables[i] - tables[j]).max(axis=1) <= most
    out[out] = np.bitwise_count(fps[i[out]] ^ fps[j[out]]) <= most
    return out


def _forest(fps: np.ndarray, tables: np.ndarray, left: np.ndarray, right: np.ndarray, most: int) -> list[tuple[int, int]]:
    """Links that connect what links between ``left`` and ``right`` (equal, or apart) connect.

    A search from each fingerprint over those not reached yet: one link for each one reached.
    """
    links: list[tuple[int, int]] = []
    same = left is right
    todo = [left.copy(), left.copy() if same else right.copy()]
    while len(todo[0]):
        front = [(0, todo[0][0])]
        todo[0] = todo[0][1:]
        if same:
            todo[1] = todo[0]
        while front:
            side, x = front.pop()
            other = 0 if same else 1 - side
            rest = todo[other]
            if not len(rest):
                continue
            near = np.abs(tables[rest] - tables[x]).max(axis=1) <= most
            near[near] = np.bitwise_count(fps[rest[near]] ^ fps[x]) <= most
            for y in rest[near].tolist():
                links.append((int(x), y))
                front.append((other, y))
            todo[other] = rest[~near]
            if same:
                todo[1] = todo[0]
    return links


def link_keys(fps: DataFrame, most: int) -> DataFrame:
    """(k, block, other, side, fp): every fingerprint under each pair of its fields, keys with one row left out.

    ``block`` and ``other`` are -1 for keys of at most BLOCK rows.  The rows of a larger key fall into blocks by hash, and
    each block meets each other one: side 0 holds the rows of ``block``, side 1 those of ``other``.
    """
    masks = [a | b for a, b in combinations(fields(most), 2)]
    keys = [F.xxhash64(F.lit(i), F.col("fp").bitwiseAND(F.lit(_signed(m)))) for i, m in enumerate(masks)]
    rows = fps.select("fp", F.explode(F.array(*keys)).alias("k"))
    sizes = rows.groupBy("k").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    rows = rows.join(sizes, "k")
    count = F.ceil(F.col("n") / BLOCK)
    block = F.pmod(F.xxhash64("fp", F.lit(7)), count).cast("int")
    met = F.when(F.col("n") <= BLOCK, F.array(F.struct(F.lit(-1).alias("b"), F.lit(-1).alias("o"), F.lit(0).alias("s")))).otherwise(
        F.transform(
            F.sequence(F.lit(0), count.cast("int") - 1),
            lambda o: F.struct(F.least(F.col("block"), o).alias("b"), F.greatest(F.col("block"), o).alias("o"), F.when(F.col("block") <= o, 0).otherwise(1).alias("s")),
        )
    )
    return rows.withColumn("block", block).select("fp", "k", F.explode(met).alias("m")).select("k", F.col("m.b").alias("block"), F.col("m.o").alias("other"), F.col("m.s").alias("side"), "fp")


def links(fps: DataFrame, most: int = 4) -> DataFrame:
    """Links (a, b) between different fingerprints (column fp, distinct) that connect all that lie within ``most`` bits."""
    keyed = link_keys(fps, most)
    n = int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        for batch in batches:
            held.append(np.stack([c.to_numpy(zero_copy_only=False).astype(np.int64) for c in batch.columns]))
            rows = np.concatenate(held, axis=1)
            if not rows.shape[1]:
                continue
            # The last group may go on in the next batch.
            changes = np.flatnonzero((rows[:3, 1:] != rows[:3, :-1]).any(axis=0))
            cut = int(changes[-1]) + 1 if len(changes) else 0
            yield _found(rows[:, :cut])
            held = [rows[:, cut:]]
        if held:
            yield _found(np.concatenate(held, axis=1))

    def _found(rows: np.ndarray) -> pa.RecordBatch:
        fp = rows[4].astype(np.int64).view(np.uint64)
        table = _tables(fp)
        starts = np.flatnonzero(np.concatenate(([True], (rows[:3, 1:] != rows[:3, :-1]).any(axis=0)))) if rows.shape[1] else np.zeros(0, int)
        sizes = np.diff(np.concatenate((starts, [rows.shape[1]])))
        a, b = [], []
        group = np.repeat(np.arange(len(starts)), sizes)
        small = np.repeat(sizes <= 16, sizes)
        index = np.flatnonzero(small)
        for shift in range(1, 16):  # all pairs of the small groups, side by side
            i, j = index[:-shift], index[shift:]
            keep = group[i] == group[j]
            if not keep.any():
                break
            i, j = i[keep], j[keep]
            ok = _close(fp, table, i, j, most)
            a.append(fp[i[ok]])
            b.append(fp[j[ok]])
        for s, size in zip(starts[sizes > 16].tolist(), sizes[sizes > 16].tolist(), strict=True):
            at = np.arange(s, s + size)
            apart = rows[1, s] != rows[2, s]
            sides = (at[rows[3, at] == 0], at[rows[3, at] == 1]) if apart else (at, at)
            found = np.array(_forest(fp, table, *sides, most), np.int64).reshape(-1, 2)
            a.append(fp[found[:, 0]])
            b.append(fp[found[:, 1]])
        both = [np.concatenate(x).view(np.int64) if x else np.zeros(0, np.int64) for x in (a, b)]
        return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in both], ["a", "b"])

    order = ["k", "block", "other"]
    return keyed.repartition(n, *order).sortWithinPartitions(*order).mapInArrow(run, "a long, b long")


def near_duplicates(docs: DataFrame, width: int = 4, most: int = 4) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id (smallest doc_id reached by links, itself included).

    Every row of ``docs`` gives one row.  Texts without a word have the fingerprint zero and link like any
    other; documents of one fingerprint are linked.  Rows with a null doc_id get a component by the other
    members of it (null if it has none).  Equal rows give equal rows; other columns are ignored.
    """
    fps = stored(with_fingerprints(docs, width), "fingerprints")
    classes = stored(fps.groupBy("fp").agg(F.min("doc_id").alias("first")), "classes")
    found = links(classes.select("fp"), most).distinct()
    joined = components(found)
    member = classes.join(joined.withColumnRenamed("node", "fp"), "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    lowest = member.groupBy("component").agg(F.min("first").alias("component_id"))
    label = member.select("fp", "component").join(lowest, "component").select("fp", "component_id")
    return fps.join(label, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
