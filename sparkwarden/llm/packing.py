"""Packing token sequences by minimum bin slack.

A document's ids are cut into pieces only where they exceed the sequence length.  What has to be packed is then
a table of lengths and counts, at most one row per length, however many documents there are.  Per bin, the
longest piece left is taken, and a bitset of subset sums over the lengths left finds the fullest way to add to it; the bin is
repeated as often as counts allow.  The plan has a few rows per length; pieces find their place in it by
their rank within their length.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparkwarden.llm.common import stored
from sparkwarden.llm.tokens import encoder

LENGTH = 4096
END_ID = 1

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, part int, nth long"


def pieces(docs: DataFrame, tokenizer: str, length: int = LENGTH, end_id: int = END_ID) -> DataFrame:
    """PIECES: the cuts of every document's ids with the end id; ``nth`` counts a length's pieces within a ``part``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer)
        context = TaskContext.get()
        part = context.partitionId() if context else 0
        seen: Counter[int] = Counter()
        for batch in batches:
            rows: list[tuple] = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = np.append(encode.ids(text.as_py()), encode.dtype.type(end_id)).astype("<u4")
                for piece, start in enumerate(range(0, len(ids), length)):
                    cut = ids[start : start + length]
                    rows.append((doc_id, piece, start, len(cut), zlib.crc32(cut.tobytes()), part, seen[len(cut)]))
                    seen[len(cut)] += 1
            if rows:
                types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], [c.split()[0] for c in PIECES.split(", ")])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, PIECES)


def fullest(room: int, counts: list[int]) -> dict[int, int]:
    """The multiset of lengths, within ``counts``, whose sum comes nearest to ``room`` from below; long ones first."""
    reach, steps, mask = 1, [], (1 << (room + 1)) - 1
    for size in range(room, 0, -1):
        left = min(counts[size], room // size)
        times = 1
        while left > 0:
            take = min(times, left)
            steps.append((size, take, reach))
            reach |= (reach << (size * take)) & mask
            left -= take
            times *= 2
        if reach >> room & 1:
            break
    at, used = reach.bit_length() - 1, Counter()
    for size, take, before in reversed(steps):
        if not before >> at & 1:
            used[size] += take
            at -= size * take
    return used


def plan(counts: dict[int, int], length: int = LENGTH) -> list[tuple[int, int, int, int, int]]:
    """(length, first rank, uses per bin, first sequence, offset): which pieces go where, in order of rank per length."""
    left = [0] * (length + 1)
    for size, n in counts.items():
        left[size] = n
    placed, rows, sequence = Counter(), [], 0
    for size in range(length, 0, -1):
        while left[size]:
            left[size] -= 1
            used = fullest(length - size, left)
            left[size] += 1
            used[size] += 1
            times = min(left[s] // u for s, u in used.items())
            offset = 0
            for s in sorted(used, reverse=True):
                rows.append((s, placed[s], used[s], sequence, offset))
                offset += s * used[s]
                placed[s] += used[s] * times
                left[s] -= used[s] * times
            sequence += times
    return sorted(rows)


def packed(docs: DataFrame, tokenizer: str, length: int = LENGTH, end_id: int = END_ID) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    A null text counts as empty: it is the end id alone.  Every row of ``docs`` is packed, rows that repeat a
    doc_id too (their pieces can't be told apart by doc_id then).  The driver holds the count of each
    length and the plan, at most 90 rows a bin kind (so many different lengths fit in 4096) and a bin kind for each length used up.
    """
    cut = stored(pieces(docs, tokenizer, length, end_id), "pieces")
    per_part = stored(cut.groupBy("part", "length").agg(F.count(F.lit(1)).alias("n")), "lengths")
    counts = {r["length"]: r["n"] for r in per_part.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    table = np.array(plan(counts, length), np.int64).reshape(-1, 5)
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_part.select("part", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    ranked = cut.join(offsets, ["part", "length"]).withColumn("rank", F.col("nth") + F.col("before"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Rows are sorted by (length, first rank): one search over both finds a piece's row.
        key = table[:, 0] * (1 << 44) + table[:, 1]
        for batch in batches:
            size, rank = (batch.column(i).to_numpy() for i in (3, 5))
            at = table[np.searchsorted(key, size * (1 << 44) + rank, side="right") - 1]
            within = rank - at[:, 1]
            found = [at[:, 3] + within // at[:, 2], at[:, 4] + within % at[:, 2] * size]
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], *[pa.array(x, pa.int64()) for x in found]], [*batch.schema.names[:5], "sequence_id", "offset"])

    return ranked.select("doc_id", "piece", "start", "length", "ids_crc32", "rank").mapInArrow(
        place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    )
