"""A store of token ids: raw id payloads in shards, each with a minimal perfect hash index of its documents.

Written by Spark as a Parquet table, so that it lies wherever Spark can write and a lost task leaves nothing behind.
One row is a shard: its documents in ascending doc_id order, ``payload`` their ids in turn as little-endian numbers,
and an index over their keys.  A key is hashed to 64 bits; the levels of the hash function (bit arrays,
each with the keys that collided in the one before) give it a slot of its own in 0 .. n - 1; the slot holds a fingerprint of
the key, its place and its number of ids.  A key that isn't there meets another one's fingerprint and is refused.
A shard's range of keys (``low``, ``high``) is in the table's statistics: a lookup reads the shards that can hold a key.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparkwarden.llm.common import scratch_path
from sparkwarden.llm.tokens import encoder

END_ID = 2
#: Ids after which a shard ends; a longer document has a shard of its own.
SHARD_IDS = 1 << 20

SHARD = (
    "part int, shard int, low long, high long, n_docs long, n_ids long, id_width int, keys binary, known binary, copies binary, "
    "level_bits binary, level_sizes binary, fingerprints binary, offsets binary, lengths binary, payload binary"
)


def mixed_bits(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """64 well-mixed bits of each 64-bit number."""
    with np.errstate(over="ignore"):
        x = x.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15) * np.uint64(salt + 1)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def key_hash(keys: np.ndarray, known: np.ndarray, copies: np.ndarray) -> np.ndarray:
    """Hash of (doc_id or null, how many rows before have the same doc_id)."""
    base = mixed_bits(np.where(known, keys, -1).astype(np.int64).view(np.uint64), 1)
    return mixed_bits(base ^ mixed_bits(copies.astype(np.uint64) * np.uint64(2) + known.astype(np.uint64), 2), 3)


class PerfectHash:
    """A minimal perfect hash function over different 64-bit hashes, as levels of bits."""

    def __init__(self, bits: np.ndarray, sizes: np.ndarray):
        self.bits, self.sizes = bits, sizes
        self.starts = np.concatenate(([0], np.cumsum(sizes)[:-1])) if len(sizes) else np.zeros(0, np.int64)
        self.ranks = np.cumsum(bits, dtype=np.int64) - bits

    @classmethod
    def build(cls, hashes: np.ndarray) -> PerfectHash:
        levels: list[np.ndarray] = []
        while len(hashes):
            size = max(64, 2 * len(hashes))
            at = (mixed_bits(hashes, len(levels)) % np.uint64(size)).astype(np.int64)
            alone = np.bincount(at, minlength=size) == 1
            levels.append(alone)
            hashes = hashes[~alone[at]]
            if len(levels) > 64:
                raise ValueError("two keys have the same hash")
        return cls(np.concatenate(levels) if levels else np.zeros(0, bool), np.array([len(x) for x in levels], np.int64))

    def slots(self, hashes: np.ndarray) -> np.ndarray:
        """The slot of each hash; -1 where no level has a bit for it."""
        out = np.full(len(hashes), -1, np.int64)
        open_ = np.arange(len(hashes))
        for level, size in enumerate(self.sizes.tolist()):
            at = (mixed_bits(hashes[open_], level) % np.uint64(size)).astype(np.int64) + self.starts[level]
            hit = self.bits[at]
            out[open_[hit]] = self.ranks[at[hit]]
            open_ = open_[~hit]
            if not len(open_):
                break
        return out


def _shard(part: int, shard: int, keys: list[int | None], copies: list[int], ids: list[np.ndarray]) -> dict:
    known = np.array([k is not None for k in keys], bool)
    key = np.array([k or 0 for k in keys], np.int64)
    copy = np.array(copies, np.int64)
    hashes = key_hash(key, known, copy)
    function = PerfectHash.build(hashes)
    slots = function.slots(hashes)
    lengths = np.array([len(x) for x in ids], np.int64)
    by_slot = lambda x, kind: x.astype(kind)[np.argsort(slots)].tobytes()
    return {
        "part": part, "shard": shard, "low": int(key[known].min()) if known.any() else None, "high": int(key[known].max()) if known.any() else None,
        "n_docs": len(keys), "n_ids": int(lengths.sum()), "id_width": ids[0].dtype.itemsize,
        "keys": key.astype("<i8").tobytes(), "known": np.packbits(known).tobytes(), "copies": copy.astype("<i8").tobytes() if copy.any() else b"",
        "level_bits": np.packbits(function.bits).tobytes(), "level_sizes": function.sizes.astype("<i8").tobytes(),
        "fingerprints": by_slot(hashes >> np.uint64(32), "<u4"), "offsets": by_slot(np.cumsum(lengths) - lengths, "<i8"), "lengths": by_slot(lengths, "<i8"),
        "payload": np.concatenate(ids).tobytes(),
    }


class Shard:
    """A shard row, read back."""

    def __init__(self, row: dict):
        n = row["n_docs"]
        self.part, self.shard = row["part"], row["shard"]
        self.keys = np.frombuffer(row["keys"], "<i8")
        self.known = np.unpackbits(np.frombuffer(row["known"], np.uint8), count=n).astype(bool)
        self.copies = np.frombuffer(row["copies"], "<i8") if row["copies"] else np.zeros(n, np.int64)
        sizes = np.frombuffer(row["level_sizes"], "<i8")
        self.function = PerfectHash(np.unpackbits(np.frombuffer(row["level_bits"], np.uint8), count=int(sizes.sum())).astype(bool), sizes)
        self.fingerprints = np.frombuffer(row["fingerprints"], "<u4")
        self.offsets, self.lengths = (np.frombuffer(row[c], "<i8") for c in ("offsets", "lengths"))
        self.payload = np.frombuffer(row["payload"], f"<u{row['id_width']}")

    def find(self, keys: np.ndarray, known: np.ndarray, copies: np.ndarray) -> np.ndarray:
        """Slots of keys by the index; -1 where the fingerprint refuses."""
        hashes = key_hash(keys, known, copies)
        slots = self.function.slots(hashes)
        right = (slots >= 0) & (self.fingerprints[np.maximum(slots, 0)] == (hashes >> np.uint64(32)).astype(np.uint32))
        return np.where(right, slots, -1)

    def ids(self, slot: int) -> np.ndarray:
        at = int(self.offsets[slot])
        return self.payload[at : at + int(self.lengths[slot])]


def write(docs: DataFrame, path: str, tokenizer: str, end_id: int = END_ID, shard_ids: int = SHARD_IDS) -> None:
    """Write the ids of every row of ``docs``, each text whole and followed by ``end_id``, in ascending doc_id order.

    A null text counts as empty, null doc_ids come first, rows that repeat a doc_id follow each other in order of text.  Tables
    without rows give a store without shards.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer)
        context = TaskContext.get()
        part = context.partitionId() if context else 0
        schema = _schema()
        keys, copies, ids, held, shard, last, copy = [], [], [], 0, 0, (), 0
        out = lambda: pa.RecordBatch.from_pylist([_shard(part, shard, keys, copies, ids)], schema)
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                copy = copy + 1 if last == (doc_id,) else 0
                last = (doc_id,)
                found = np.append(encode.ids(text.as_py()), encode.dtype.type(end_id))
                if ids and held + len(found) > shard_ids:
                    yield out()
                    keys, copies, ids, held, shard = [], [], [], 0, shard + 1
                keys.append(doc_id)
                copies.append(copy)
                ids.append(found)
                held += len(found)
        if ids:
            yield out()

    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = docs.select(F.col("doc_id").cast("long"), "text").repartitionByRange(n, "doc_id").sortWithinPartitions("doc_id", "text")
    ordered.mapInArrow(run, SHARD).write.parquet(path)


def _schema() -> pa.Schema:
    kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}
    return pa.schema([(c.split()[0], kinds[c.split()[1]]) for c in SHARD.split(", ")])


def _shards(batches: Iterator[pa.RecordBatch]) -> Iterator[Shard]:
    for batch in batches:
        for i in range(batch.num_rows):
            yield Shard({name: batch.column(name)[i].as_py() for name in batch.schema.names})


def read(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, each found through its shard's index.

    ``start`` counts the ids of all documents before it.  Fails if a document can't be found.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard in _shards(batches):
            slots = shard.find(shard.keys, shard.known, shard.copies)
            if (slots < 0).any():
                raise ValueError(f"shard {shard.part}/{shard.shard} doesn't know its own documents")
            crcs = [zlib.crc32(shard.ids(s).astype("<u4").tobytes()) for s in slots.tolist()]
            n = len(slots)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.full(n, shard.part), pa.int32()), pa.array(np.full(n, shard.shard), pa.int32()), pa.array(shard.keys, pa.int64(), mask=~shard.known),
                    pa.array(shard.offsets[slots], pa.int64()), pa.array(shard.lengths[slots], pa.int64()), pa.array(crcs, pa.int64()),
                ],
                ["part", "shard", "doc_id", "at", "n_tokens", "ids_crc32"],
            )

    table = spark.read.parquet(path)
    parts = table.groupBy("part").agg(F.sum("n_ids").alias("n"))
    before = lambda w: F.coalesce(F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    bases = parts.select("part", before(Window.orderBy("part")).alias("base"))
    inside = table.select("part", "shard", F.col("n_ids").alias("n")).select("part", "shard", before(Window.partitionBy("part").orderBy("shard")).alias("within"))
    starts = inside.join(bases, "part").select("part", "shard", (F.col("base") + F.col("within")).alias("first"))
    docs = table.mapInArrow(run, "part int, shard int, doc_id long, at long, n_tokens long, ids_crc32 long")
    return docs.join(starts, ["part", "shard"]).select("doc_id", (F.col("first") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")


def lookup(spark: SparkSession, path: str, doc_ids: list[int]) -> DataFrame:
    """doc_id, ids of the documents in a list; reads the shards whose range holds one of them."""
    wanted = np.array(sorted(set(doc_ids)), np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard in _shards(batches):
            copy = np.zeros(len(wanted), np.int64)
            todo = wanted
            while len(todo):  # rows that repeat a doc_id are copies 0, 1, ...
                slots = shard.find(todo, np.ones(len(todo), bool), copy[: len(todo)])
                hit = slots >= 0
                rows = [shard.ids(s).astype("<u4").tolist() for s in slots[hit].tolist()]
                yield pa.RecordBatch.from_arrays([pa.array(todo[hit], pa.int64()), pa.array(rows, pa.list_(pa.int64()))], ["doc_id", "ids"])
                todo, copy = todo[hit], copy[: int(hit.sum())] + 1

    table = spark.read.parquet(path)
    if not len(wanted):
        return spark.createDataFrame([], "doc_id long, ids array<long>")
    near = reduce(lambda a, b: a | b, [(F.col("low") <= k) & (F.col("high") >= k) for k in wanted.tolist()])
    return table.where(near).mapInArrow(run, "doc_id long, ids array<long>")


def stored_ids(docs: DataFrame, tokenizer: str, end_id: int = END_ID) -> DataFrame:
    """Write ``docs`` to a new store in the shared folder and read it back."""
    path = scratch_path(docs.sparkSession, "token-store")
    write(docs, path, tokenizer, end_id)
    return read(docs.sparkSession, path)
