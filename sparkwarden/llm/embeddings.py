"""Near-duplicate vectors through a pivot-permutation index.

A vector is described by its nearest reference points (pivots), nearest first.  Near vectors see the same pivots
near, so candidates are vectors that share ``shared`` of their ``nearest`` pivots: the inverted lists are kept per set of
``shared`` pivots, and a list holds exactly the vectors that share it.  Lists are cut into blocks where long; within a
list, cosines are matrix products.  A pair counts in one list only, that of the smallest pivots it shares, so that links can be
counted per vector without writing pairs.  Equal vectors are one class throughout.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkwarden.functions.joins import many
from sparkwarden.llm.common import components, numbered, stored

COSINE = 0.95
#: Pivots, how many of the nearest describe a vector, and how many two vectors must share to meet.
PIVOTS, NEAREST, SHARED = 512, 6, 3
#: Vectors from which the pivots are taken (a bounded sample by hash), and the cosine above which one pivot stands for both.
CANDIDATES, APART = 4 * PIVOTS, 0.8
BLOCK = 1024


def classes_of(vectors: DataFrame) -> DataFrame:
    """Rows with two hashes of the vector; null hashes where it is null, empty, zero or not finite."""
    v = F.col("embedding").cast("array<double>")
    fine = F.col("embedding").isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists(v, lambda x: x != 0)
    return vectors.select("vec_id", F.when(fine, F.xxhash64("embedding")).alias("h1"), F.when(fine, F.xxhash64(F.lit(1), F.col("embedding"))).alias("h2"), "embedding")


def unit(rows: list, width: int | None = None) -> np.ndarray:
    """Vectors of one length (or cut and padded to ``width``) as rows of norm 1, in double precision."""
    if width is not None:
        rows = [np.pad(np.asarray(r[:width], float), (0, max(0, width - len(r)))) for r in rows]
    x = np.array(rows, float)
    scale = np.abs(x).max(axis=1, keepdims=True) if x.size else x  # so that squares neither vanish nor overflow
    x = x / np.where(scale == 0, 1, scale)
    norm = np.sqrt((x * x).sum(axis=1, keepdims=True))
    return x / np.where(norm == 0, 1, norm)


def pivots(reps: DataFrame) -> np.ndarray:
    """At most PIVOTS vectors of norm 1, no two nearer than APART, from the CANDIDATES with the lowest hashes."""
    # A threshold on the hash leaves a few times as many rows as are wanted, whatever the number of partitions.
    share = min(1.0, 4 * CANDIDATES / max(1, reps.count()))
    near = reps.where(F.pmod(F.xxhash64("h1"), F.lit(1 << 30)) < share * (1 << 30))
    rows = [r["embedding"] for r in near.orderBy(F.xxhash64("h1"), "rid").limit(CANDIDATES).select("embedding").collect()]
    if not rows:
        return np.zeros((0, 1))
    x = unit(rows, max(map(len, rows)))
    chosen: list[int] = []
    for i in range(len(x)):
        if len(chosen) < PIVOTS and (not chosen or (x[chosen] @ x[i]).max() < APART):
            chosen.append(i)
    return x[chosen]


def described(reps: DataFrame, table: np.ndarray) -> DataFrame:
    """rid, nearest (pivot numbers, nearest first) of every representative."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            near = unit(batch.column(1).to_pylist(), table.shape[1]) @ table.T
            order = np.argsort(-near, axis=1, kind="stable")[:, :NEAREST]
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(order) + 1) * order.shape[1], pa.int32()), pa.array(order.ravel(), pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column(0), lists], ["rid", "nearest"])

    return reps.select("rid", "embedding").mapInArrow(run, "rid long, nearest array<int>")


def _key(sets: np.ndarray) -> np.ndarray:
    """A number for each row of ascending pivot numbers."""
    key = np.zeros(len(sets), np.int64)
    for i in range(sets.shape[1]):
        key = key * PIVOTS + sets[:, i]
    return key


def lists(descriptions: DataFrame) -> DataFrame:
    """k, block, other, side, rid: the inverted lists with at least two vectors, long ones in blocks that meet in pairs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            near = [sorted(x) for x in batch.column(1).to_pylist()]
            rid, keys = batch.column(0).to_numpy(), []
            whose = []
            for size in {len(x) for x in near}:
                at = np.array([i for i, x in enumerate(near) if len(x) == size], np.int64)
                sets = np.array([near[i] for i in at], np.int64)
                for pick in combinations(range(size), min(size, SHARED)):  # with fewer pivots than that, all vectors share all
                    keys.append(_key(sets[:, pick]))
                    whose.append(rid[at])
            if keys:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys), pa.int64()), pa.array(np.concatenate(whose), pa.int64())], ["k", "rid"])

    rows = descriptions.mapInArrow(run, "k long, rid long")
    sizes = rows.groupBy("k").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    rows = rows.join(many(sizes), "k")
    count = F.ceil(F.col("n") / BLOCK).cast("int")
    rows = rows.withColumn("mine", F.pmod(F.xxhash64("rid"), count).cast("int"))
    met = F.transform(
        F.sequence(F.lit(0), count - 1),
        lambda o: F.struct(F.least("mine", o).alias("block"), F.greatest("mine", o).alias("other"), F.when(F.col("mine") <= o, 0).otherwise(1).alias("side")),
    )
    return rows.select("k", "rid", F.explode(met).alias("m")).select("k", "m.block", "m.other", "m.side", "rid")


def compared(rows: DataFrame, least: float) -> DataFrame:
    """rid, links, to: per list, how many vectors a class is linked with (``links``), or a class it hangs together with (``to``).

    ``rows`` are lists with nearest, n (vectors of the class) and embedding of each class.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            held = table if held is None else pa.concat_tables([held, table])
            if not held.num_rows:
                continue
            heads = np.stack([held.column(c).to_numpy() for c in ("k", "block", "other")])
            changes = np.flatnonzero((heads[:, 1:] != heads[:, :-1]).any(axis=0)) + 1
            if len(changes):
                yield from groups(held.slice(0, changes[-1]))
                held = held.slice(changes[-1])
        if held is not None and held.num_rows:
            yield from groups(held)

    def groups(table: pa.Table) -> Iterator[pa.RecordBatch]:
        heads = np.stack([table.column(c).to_numpy() for c in ("k", "block", "other")])
        starts = np.concatenate(([0], np.flatnonzero((heads[:, 1:] != heads[:, :-1]).any(axis=0)) + 1, [table.num_rows]))
        side, rid, n = (table.column(c).to_numpy() for c in ("side", "rid", "n"))
        near = table.column("nearest").to_pylist()
        vectors = table.column("embedding").to_pylist()
        ids, links, to = [], [], []
        for a, b in zip(starts, starts[1:], strict=False):
            lengths = np.array([len(v) for v in vectors[a:b]])
            for length in np.unique(lengths).tolist():
                at = a + np.flatnonzero(lengths == length)
                if len(at) < 2:
                    continue
                apart = heads[1, a] != heads[2, a]
                left, right = (at[side[at] == 0], at[side[at] == 1]) if apart else (at, at)
                x, y = (unit([vectors[i] for i in s]) for s in (left, right))
                close = x @ y.T >= least if len(left) and len(right) else np.zeros((len(left), len(right)), bool)
                if not apart:
                    close &= np.arange(len(at))[:, None] < np.arange(len(at))[None, :]
                i, j = np.nonzero(close)
                # A pair that shares several sets counts in the list of the smallest.
                own = np.zeros(len(i), bool)
                for s in range(0, len(i), 1 << 16):
                    own[s : s + (1 << 16)] = first_shared([near[q] for q in left], [near[q] for q in right], i[s : s + (1 << 16)], j[s : s + (1 << 16)]) == heads[0, a]
                i, j = left[i[own]], right[j[own]]
                if not len(i):
                    continue
                ids += [rid[i], rid[j]]
                links += [n[j], n[i]]
                to += [np.full(2 * len(i), -1)]
                u, v = forest(i, j)
                ids.append(rid[u])
                links.append(np.zeros(len(u), np.int64))
                to.append(rid[v])
        if ids:
            who, what, where = (np.concatenate(q) for q in (ids, links, to))
            degree = where < 0
            some, inverse = np.unique(who[degree], return_inverse=True)
            total = np.zeros(len(some), np.int64)
            np.add.at(total, inverse, what[degree])
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.concatenate((some, who[~degree])), pa.int64()), pa.array(np.concatenate((total, what[~degree])), pa.int64()),
                    pa.array(np.concatenate((np.full(len(some), -1), where[~degree])), pa.int64(), mask=np.concatenate((np.ones(len(some), bool), np.zeros(int((~degree).sum()), bool)))),
                ],
                ["rid", "links", "to"],
            )

    order = ["k", "block", "other"]
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = rows.select(*order, "side", "rid", "n", "nearest", "embedding").repartition(parts, *order).sortWithinPartitions(*order)
    return ordered.mapInArrow(run, "rid long, links long, to long")


def first_shared(left: list, right: list, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Key of the smallest SHARED pivots that vectors i and j have in common (all have one number of pivots)."""
    a, b = np.sort(np.array(left, np.int64), axis=1)[i], np.sort(np.array(right, np.int64), axis=1)[j]
    common = (a[:, :, None] == b[:, None, :]).any(axis=2)
    size = min(SHARED, a.shape[1])
    rank = np.cumsum(common, axis=1)
    key = np.zeros(len(a), np.int64)
    for s in range(1, size + 1):
        key = key * PIVOTS + a[np.arange(len(a)), np.argmax(common & (rank == s), axis=1)]
    return key


def forest(i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (node, smallest node of its part) that connect what the pairs (i, j) connect."""
    nodes, inverse = np.unique(np.concatenate((i, j)), return_inverse=True)
    a, b = inverse[: len(i)], inverse[len(i) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    rest = np.flatnonzero(label != np.arange(len(nodes)))
    return nodes[rest], nodes[label[rest]]


def near_duplicates(vectors: DataFrame, least: float = COSINE) -> DataFrame:
    """vec_id, n_links, component_id, kept of every row of ``vectors`` (vec_id, embedding); other columns are ignored.

    Links join rows with a cosine of ``least`` or more, in double precision.  Vectors that are null, empty, zero or
    hold null or non-finite components link with nothing, nor do vectors of different lengths.  Rows that repeat a vec_id are
    vectors of their own.  Rows without a vec_id link too, but give no component_id.
    """
    rows = stored(classes_of(vectors.select(F.col("vec_id").cast("long"), "embedding")), "vectors")
    fine = rows.where("h1 is not null")
    grouped = fine.groupBy("h1", "h2").agg(F.min("vec_id").alias("first"), F.count(F.lit(1)).alias("n"), F.first("embedding").alias("embedding"))
    reps = stored(numbered(grouped, [], ["first", "h1", "h2"], "rid", "vector-order"), "vector-classes")
    near = stored(described(reps, pivots(reps)), "pivot-permutations")
    rows_of = lists(near).join(many(near.join(many(reps.select("rid", "n", "embedding")), "rid")), "rid")
    found = stored(compared(rows_of, least), "vector-links")
    degree = found.where("to is null").groupBy("rid").agg(F.sum("links").alias("links"))
    joined = components(found.where("to is not null").select(F.col("rid").alias("a"), F.col("to").alias("b")))
    member = reps.select("rid", "h1", "h2", "first", "n").join(many(degree), "rid", "left").join(many(joined.withColumnRenamed("node", "rid")), "rid", "left").withColumn("component", F.coalesce("component", "rid"))
    lowest = member.groupBy("component").agg(F.min("first").alias("component_id"))
    label = member.join(many(lowest), "component").select("h1", "h2", "component_id", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"))
    linked = rows.where("h1 is not null").select("vec_id", "h1", "h2").join(many(label), ["h1", "h2"]).select("vec_id", "n_links", "component_id")
    alone = rows.where("h1 is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
