"""Language-model scores of texts: a log-bilinear model trained in numpy by noise-contrastive estimation.

Spark counts the corpus: every token, and every pair of a token's class with that of the one before.  The most
frequent tokens are classes of their own, the others share a fixed number of classes by hash; so the pair counts have a fixed
size however large the corpus, and cover all of it.  The model scores a class by the product of a projected context vector
and the class's vector, plus a bias.  It learns to tell the pairs of the corpus from pairs with noise drawn from the class frequencies;
with all pairs counted, the expectation over the noise is exact.  One batched matrix product gives the normalised
log-probabilities of all classes after all contexts; a token's is its class's, times its own share in it.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkwarden.llm.common import stored

#: Tokens with a class of their own, and classes that the others share.
FREQUENT, SHARED = 512, 64
DIMENSIONS, NOISE, STEPS, RATE, SEED = 32, 10, 300, 0.05, 1
#: Added to each token's count.
ADDED = 0.1
#: Bytes of text whose words are looked up together; different tokens that a task counts before it passes them on.
CHUNK_BYTES, KEPT = 24 << 20, 1 << 19
#: The end of a text; no word is empty.
END = b""


def tokens(text: str | None) -> list[bytes]:
    """Words with A-Z in lower case, then the end."""
    out = (text or "").encode("utf-8", "surrogatepass").lower().split()
    out.append(END)
    return out


def chunked(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, text and ``chunk``: rows that a task read together, CHUNK_BYTES of text or a single longer one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        chunk, held = (context.partitionId() if context else 0) << 32, 0
        for batch in batches:
            numbers = []
            for size in pc.binary_length(batch.column(2)).to_pylist():
                if held and held + (size or 0) > CHUNK_BYTES:
                    chunk, held = chunk + 1, 0
                held += size or 0
                numbers.append(chunk)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(numbers, pa.int64())], [*batch.schema.names, "chunk"])

    return docs.select("doc_id", "held_out", "text").mapInArrow(run, "doc_id long, held_out boolean, text string, chunk long")


def chunk_words(chunks: DataFrame) -> DataFrame:
    """chunk, token, n (in texts that aren't held out): the different tokens of each chunk, a token of a large chunk perhaps more than once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, Counter[bytes]] = {}

        def out(done: dict[int, Counter[bytes]]) -> Iterator[pa.RecordBatch]:
            for chunk, counts in done.items():
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(counts), chunk), pa.int64()), pa.array(list(counts), pa.binary()), pa.array(list(counts.values()), pa.int64())], ["chunk", "token", "n"]
                )

        for batch in batches:
            for chunk, held_out, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                counts = found.setdefault(chunk, Counter())
                if held_out:
                    for t in tokens(text.as_py()):
                        counts[t] += 0
                else:
                    counts.update(tokens(text.as_py()))
                if len(counts) > KEPT:
                    yield from out({chunk: found.pop(chunk)})
            if len(found) > 1:
                last = next(reversed(found))
                yield from out({k: v for k, v in found.items() if k != last})
                found = {last: found[last]}
        yield from out(found)

    return chunks.select("chunk", "held_out", "text").mapInArrow(run, "chunk long, token binary, n long")


def class_of(token: bytes, frequent: dict[bytes, int]) -> int:
    """A token's class: its own, or one of the SHARED ones."""
    own = frequent.get(token)
    return FREQUENT + zlib.crc32(token) % SHARED if own is None else own


def pair_counts(chunks: DataFrame, frequent: dict[bytes, int]) -> np.ndarray:
    """How often each class follows each other one in texts that aren't held out; a text's first token follows an end."""
    size = FREQUENT + SHARED

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classes = _Classes(frequent)
        table = np.zeros(size * size, np.int64)
        for batch in batches:
            for text in batch.column(0):
                found = np.fromiter(map(classes.__getitem__, tokens(text.as_py())), np.int64)
                before = np.concatenate((found[-1:], found[:-1]))
                np.add.at(table, before * size + found, 1)
        at = np.flatnonzero(table)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(table[at], pa.int64())], ["cell", "n"])

    rows = chunks.where("not held_out").select("text").mapInArrow(run, "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n")).toPandas()
    table = np.zeros(size * size)
    table[rows["cell"]] = rows["n"]
    return table.reshape(size, size)


class _Classes(dict):
    """token -> class, kept for the tokens met so far."""

    def __init__(self, frequent: dict[bytes, int]):
        super().__init__(frequent)
        self.frequent = frequent

    def __missing__(self, token: bytes) -> int:
        if len(self) > KEPT:
            self.clear()
            self.update(self.frequent)
        self[token] = found = class_of(token, self.frequent)
        return found


def trained(pairs: np.ndarray) -> np.ndarray:
    """log10 probability of each class (columns) after each class (rows), normalised over classes.

    Noise-contrastive estimation of a log-bilinear model by gradient steps (Adam) over the counted pairs; the same counts give
    the same model.
    """
    size = len(pairs)
    rng = np.random.default_rng(SEED)
    noise = (pairs.sum(axis=0) + 1) / (pairs.sum() + size)
    total = max(1.0, pairs.sum())
    data = pairs / total
    against = NOISE * data.sum(axis=1, keepdims=True) * noise[None, :]
    shift = np.log(NOISE * noise)[None, :]
    at = {
        "context": rng.normal(0, 0.1, (size, DIMENSIONS)), "project": np.eye(DIMENSIONS) + rng.normal(0, 0.01, (DIMENSIONS, DIMENSIONS)),
        "target": rng.normal(0, 0.1, (size, DIMENSIONS)), "bias": np.log(noise),
    }
    first, second = ({k: np.zeros_like(v) for k, v in at.items()} for _ in range(2))
    for step in range(1, STEPS + 1):
        seen = at["context"] @ at["project"]
        delta = seen @ at["target"].T + at["bias"][None, :] - shift
        real = 1 / (1 + np.exp(-np.clip(delta, -50, 50)))
        push = data * (1 - real) - against * real
        back = push @ at["target"]
        slopes = {"context": back @ at["project"].T, "project": at["context"].T @ back, "target": push.T @ seen, "bias": push.sum(axis=0)}
        for k, slope in slopes.items():
            first[k] = 0.9 * first[k] + 0.1 * slope
            second[k] = 0.99 * second[k] + 0.01 * slope * slope
            at[k] = at[k] + RATE * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-8)
    scores = at["context"] @ at["project"] @ at["target"].T + at["bias"][None, :]
    top = scores.max(axis=1, keepdims=True)
    return (scores - top - np.log(np.exp(scores - top).sum(axis=1, keepdims=True))) / math.log(10)


@dataclass(frozen=True)
class Scorer:
    """All that scoring needs: of a fixed size."""

    frequent: dict[bytes, int]
    log_pairs: np.ndarray
    class_tokens: np.ndarray  # tokens and different tokens of each shared class
    train_tokens: int
    different: int

    def base(self, count: np.ndarray) -> np.ndarray:
        return np.log10((count + ADDED) / (self.train_tokens + ADDED * (self.different + 1)))

    def share(self, cls: np.ndarray, count: np.ndarray) -> np.ndarray:
        """log10 of a token's share in its class: a class of its own has no other; unknown tokens count as one more."""
        shared = cls >= FREQUENT
        n, v = self.class_tokens[np.where(shared, cls - FREQUENT, 0)].T
        return np.where(shared, np.log10((count + ADDED) / (n + ADDED * (v + 1))), 0.0)


def scored(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row of ``docs`` (doc_id, held_out, text).

    Counts and model come from the rows that aren't held out; a null text is empty and holds the end alone.  Equal rows
    get equal results.  Without rows to learn from all tokens are unknown.
    """
    chunks = stored(chunked(docs), "chunks")
    by_chunk = stored(chunk_words(chunks), "chunk-words")
    totals = stored(by_chunk.groupBy("token").agg(F.sum("n").alias("c")), "token-counts")
    known = totals.where("c > 0")
    top = known.orderBy(F.desc("c"), "token").limit(FREQUENT).collect()
    frequent = {bytes(r["token"]): i for i, r in enumerate(top)}
    shared = F.crc32("token") % SHARED
    names = docs.sparkSession.createDataFrame([(k,) for k in frequent], "token binary")
    rare = known.join(F.broadcast(names), "token", "left_anti").groupBy(shared.cast("int").alias("class")).agg(F.sum("c").alias("n"), F.count(F.lit(1)).alias("v"))
    class_tokens = np.zeros((SHARED, 2))
    for r in rare.collect():
        class_tokens[r["class"]] = r["n"], r["v"]
    sums = known.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count(F.lit(1)).alias("v")).first()
    scorer = Scorer(frequent, trained(pair_counts(chunks, frequent)), class_tokens, sums["n"], sums["v"])
    # Each chunk gets the counts of its own tokens: nothing that grows with the vocabulary is in one place.
    counted = by_chunk.select("chunk", "token").join(totals, "token").select("chunk", "token", "c")
    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"

    def run(texts: pa.Table, counts: pa.Table) -> pa.Table:
        words = counts.column("token").to_pylist()
        place = dict(zip(words, range(len(words)), strict=True))
        count = counts.column("c").to_numpy()
        cls = np.fromiter((class_of(w, scorer.frequent) for w in words), np.int64, len(words))
        base, share, end = scorer.base(count), scorer.share(cls, count), class_of(END, scorer.frequent)
        rows = []
        for doc_id, held_out, text in zip(texts.column("doc_id").to_pylist(), texts.column("held_out").to_pylist(), texts.column("text"), strict=True):
            at = np.fromiter(map(place.__getitem__, tokens(text.as_py())), np.int64)
            classes = cls[at]
            pairs = scorer.log_pairs[np.concatenate(([end], classes[:-1])), classes].sum()
            rows.append((doc_id, held_out, len(at), int((count[at] > 0).sum()), scorer.train_tokens, math.fsum(base[at]), float(pairs + share[at].sum())))
        kinds = [pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64()]
        columns = zip(*rows, strict=True) if rows else [[]] * len(kinds)
        return pa.Table.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], [c.split()[0] for c in schema.split(", ")])

    return chunks.groupBy("chunk").cogroup(counted.groupBy("chunk")).applyInArrow(run, schema)
