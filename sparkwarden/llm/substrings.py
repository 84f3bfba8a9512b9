"""Removal of repeated substrings with a logarithmic family of sparse suffix arrays.

Every byte covered by a ``length``-byte string that also starts earlier (in a smaller document, or further left in the same
one) is to go.  A suffix array of all suffixes takes many times the text, and only matches of ``length`` bytes count; so
suffixes are sampled by content: a window of ``length`` bytes is anchored where its 16-byte substrings have
their smallest hash, and equal windows have equal anchors.  Windows that follow each other share an anchor; such a run is
an entry: a key (hash of bytes that all windows on this side of the anchor contain) and a class (hash of all bytes of the run).

A batch of documents becomes sorted arrays of entries, one per bucket of keys.  Existing levels hold the arrays of earlier
batches; merging the new array with them in one sorted scan shows which entries came earlier, and levels of the same size
are merged into one of twice the size, so that n batches leave about log2(n) levels.

An entry whose key and class came earlier goes as a whole.  Entries with one key but different classes may share
some windows (the edges of a match): their windows are compared one by one in a second pass, by the hash of the window.
So the result is that of comparing all windows, up to 64-bit hashes of windows and 89-bit ones of entries.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkwarden.llm.common import numbered, process_cache, scratch_path, stored

LENGTH = 100
GRAM = 16
BATCHES = 2
#: Bytes that are hashed together; longer texts are cut, with ``length - 1`` bytes in common.
CHUNK = 1 << 18
#: Entries that a task holds before it passes them on.
HELD = 1 << 19
#: Bits of the filter of keys that the second pass looks at: a fixed size; what it lets through needlessly costs time only.
FILTER_BITS = 1 << 25

ROWS = "bucket int, kind int, keys binary, classes binary, docs binary, los binary"
MARKS = "doc long, _marks array<struct<lo:long,upto:long>>"
_BASE = 0x9E3779B97F4A7C15
_U = np.uint64


def _tables() -> dict[str, np.ndarray]:
    """Powers of the base and of its inverse, and a random odd number for each byte."""

    def make() -> dict[str, np.ndarray]:
        n = CHUNK + 2 * LENGTH + 1
        start = np.ones(1, _U)
        powers = lambda base: np.cumprod(np.concatenate((start, np.full(n, base, _U))))
        return {
            "byte": np.random.default_rng(7).integers(0, 1 << 63, 256, _U) * _U(2) + _U(1),
            "power": powers(_BASE),
            "inverse": powers(pow(_BASE, -1, 1 << 64)),
        }

    return process_cache("substring hashes", make)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


class Hashes:
    """Hashes of any substring of ``data``, from running sums."""

    def __init__(self, data: np.ndarray):
        t = _tables()
        self.inverse = t["inverse"]
        self.sums = np.concatenate((np.zeros(1, _U), np.cumsum(t["byte"][data] * t["power"][: len(data)], dtype=_U)))

    def of(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Of bytes a .. b - 1."""
        return _mix((self.sums[b] - self.sums[a]) * self.inverse[a])


def _lowest(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each ``width`` values that follow each other."""
    step = 1
    while 2 * step <= width:
        x = np.minimum(x[:-step], x[step:])
        step *= 2
    return np.minimum(x[: len(x) - (width - step)], x[width - step :]) if step < width else x


def entries(data: np.ndarray, owner: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, ...]:
    """Runs of windows of concatenated texts: key, class, first start, number of starts; and the hashes.

    ``owner`` says which text a byte belongs to; windows don't cross texts.
    """
    hashes = Hashes(data)
    none = np.zeros(0, np.int64)
    if len(data) < length:
        return none.astype(_U), none, none, none, hashes
    at = np.arange(len(data) - GRAM + 1)
    gram = hashes.of(at, at + GRAM)
    ranked = (gram & _U(0xFFFFFFFF00000000)) | at.astype(_U)
    anchor = (_lowest(ranked, length - GRAM + 1) & _U(0xFFFFFFFF)).astype(np.int64)
    start = np.flatnonzero(owner[: len(anchor)] == owner[length - 1 :])
    if not len(start):
        return none.astype(_U), none, none, none, hashes
    anchor = anchor[start]
    half = (length - GRAM + 1) // 2
    left = anchor - start >= half  # the anchor lies in the window's second half
    new = np.flatnonzero((np.diff(start) != 1) | (np.diff(anchor) != 0) | (np.diff(left) != 0) | (np.diff(owner[start]) != 0)) + 1
    first = np.concatenate(([0], new))
    last = np.concatenate((new, [len(start)])) - 1
    lo, hi, a, side = start[first], start[last], anchor[first], left[first]
    # All windows of a side contain these bytes, wherever they start.
    key = hashes.of(np.where(side, a - half, a), np.where(side, a + GRAM, a - half + 1 + length))
    count = hi - lo + 1
    whole = _mix(hashes.of(lo, hi + length) ^ _mix((a - lo).astype(_U) * _U(1 << 20) + count.astype(_U)))
    cls = ((whole >> _U(39)) << _U(7)).astype(np.int64) | count
    return key ^ side.astype(_U), cls, lo, count, hashes


def chunks(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Texts (columns _seq, text) put together: bytes, owner of each byte, and per owner its document and offset in it."""
    parts, docs, bases, held = [], [], [], 0

    def out() -> tuple[np.ndarray, ...]:
        sizes = [len(p) for p in parts]
        return np.frombuffer(b"".join(parts), np.uint8), np.repeat(np.arange(len(parts)), sizes), np.array(docs, np.int64), np.array(bases, np.int64)

    for batch in batches:
        for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            data = (text.as_py() or "").encode("utf-8", "surrogatepass")
            for base in range(0, max(1, len(data) - length + 1), CHUNK // 2):
                part = data[base : base + CHUNK // 2 + length - 1]
                if len(part) < length:
                    continue
                if parts and held + len(part) > CHUNK:
                    yield out()
                    parts, docs, bases, held = [], [], [], 0
                parts.append(part)
                docs.append(doc)
                bases.append(base)
                held += len(part)
    if parts:
        yield out()


def _repeated(key: np.ndarray, cls: np.ndarray, doc: np.ndarray, lo: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order by (key, class, document, start), and in it whether an entry repeats the one before."""
    order = np.lexsort((lo, doc, cls, key))
    k, c = key[order], cls[order]
    return order, np.concatenate(([False], (k[1:] == k[:-1]) & (c[1:] == c[:-1]))) if len(k) else np.zeros(0, bool)


def _joined(doc: np.ndarray, lo: np.ndarray, upto: np.ndarray) -> tuple[np.ndarray, ...]:
    """Marks in order, those that touch or overlap made one."""
    order = np.lexsort((lo, doc))
    doc, lo, upto = doc[order], lo[order], upto[order]
    if not len(doc):
        return doc, lo, upto
    # Ends grow with starts inside a document, as marks of one kind do not contain each other by more than a window.
    reach = np.maximum.accumulate(upto + np.cumsum(np.concatenate(([0], (doc[1:] != doc[:-1]).astype(np.int64)))) * (1 << 33))
    shift = np.cumsum(np.concatenate(([0], (doc[1:] != doc[:-1]).astype(np.int64)))) * (1 << 33)
    new = np.flatnonzero(lo[1:] + shift[1:] > reach[:-1]) + 1
    first = np.concatenate(([0], new))
    last = np.concatenate((new, [len(doc)])) - 1
    return doc[first], lo[first], reach[last] - shift[last]


def _packed(bucket: int, kind: int, key: np.ndarray, cls: np.ndarray, doc: np.ndarray | None = None, lo: np.ndarray | None = None) -> dict:
    return {
        "bucket": bucket, "kind": kind, "keys": key.astype("<u8").tobytes(), "classes": cls.astype("<u4").tobytes(),
        "docs": None if doc is None else doc.astype("<i8").tobytes(), "los": None if lo is None else lo.astype("<u4").tobytes(),
    }


def _schema(columns: str) -> pa.Schema:
    kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}
    return pa.schema([(c.split()[0], kinds[c.split()[1]]) for c in columns.split(", ")])


def _spread(key: np.ndarray, cls: np.ndarray, doc: np.ndarray, lo: np.ndarray, buckets: int, length: int) -> pa.RecordBatch:
    """Sorted arrays per bucket (kind 0) of a task's first entries; entries it has seen before become marks (kind 1)."""
    order, again = _repeated(key, cls, doc, lo)
    rows = []
    marked = order[again]
    if len(marked):
        d, a, b = _joined(doc[marked], lo[marked], lo[marked] + (cls[marked] & 127) + length - 1)
        to = (_mix(d.astype(_U)) % _U(buckets)).astype(np.int64)
        for bucket in np.unique(to).tolist():
            i = to == bucket
            rows.append(_packed(bucket, 1, b[i], np.zeros(int(i.sum())), d[i], a[i]))
    kept = order[~again]
    to = (key[kept] % _U(buckets)).astype(np.int64)
    by = np.argsort(to, kind="stable")
    edges = np.searchsorted(to[by], np.arange(buckets + 1))
    for bucket in range(buckets):
        i = kept[by[edges[bucket] : edges[bucket + 1]]]
        if len(i):
            rows.append(_packed(bucket, 0, key[i], cls[i], doc[i], lo[i]))
    return pa.RecordBatch.from_pylist(rows, _schema(ROWS))


def _earliest(seen: dict[tuple[int, int], tuple[int, int]], key: np.ndarray, cls: np.ndarray, doc: np.ndarray, lo: np.ndarray) -> np.ndarray:
    """Which entries come before all that ``seen`` has of their key and class, and note them there.

    Later ones go as a whole, so only an entry that may be the first needs its windows compared.
    """
    keep = np.zeros(len(key), bool)
    for i, (k, place) in enumerate(zip(zip(key.tolist(), cls.tolist(), strict=True), zip(doc.tolist(), lo.tolist(), strict=True), strict=True)):
        if k not in seen or place < seen[k]:
            if len(seen) >= HELD:
                seen.clear()
            seen[k] = place
            keep[i] = True
    return keep


def _arrays(docs: DataFrame, buckets: int, length: int, asked: np.ndarray | None = None) -> DataFrame:
    """ROWS of ``docs`` (_seq, text): all entries; or, with a filter of keys, the windows of entries that pass it, each with class 1."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        seen: dict[tuple[int, int], tuple[int, int]] = {}
        n = 0
        for data, owner, doc, base in chunks(batches, length):
            key, cls, lo, count, hashes = entries(data, owner, length)
            if asked is not None:
                pick = np.flatnonzero(_passes(asked, key))
                at = lo[pick] - np.searchsorted(owner, owner[lo[pick]]) + base[owner[lo[pick]]]
                pick = pick[_earliest(seen, key[pick], cls[pick], doc[owner[lo[pick]]], at)]
                lo = np.repeat(lo[pick], count[pick]) + np.concatenate([np.zeros(0, np.int64), *[np.arange(c) for c in count[pick].tolist()]])
                key, cls = hashes.of(lo, lo + length), np.ones(len(lo), np.int64)
            whose = owner[lo]
            begin = np.searchsorted(owner, whose)
            held.append((key, cls, doc[whose], lo - begin + base[whose]))
            n += len(lo)
            if n >= HELD:
                yield _spread(*[np.concatenate(x) for x in zip(*held, strict=True)], buckets, length)
                held, n = [], 0
        if n:
            yield _spread(*[np.concatenate(x) for x in zip(*held, strict=True)], buckets, length)

    return docs.select("_seq", "text").mapInArrow(run, ROWS)


def _bits(key: np.ndarray) -> np.ndarray:
    return np.stack((key >> _U(8), key >> _U(36))) % _U(FILTER_BITS)


def _passes(asked: np.ndarray, key: np.ndarray) -> np.ndarray:
    at = _bits(key)
    return ((asked[(at >> _U(3)).astype(np.int64)] >> (at & _U(7)).astype(np.uint8)) & 1).astype(bool).all(axis=0)


def _scan(arrays: DataFrame, buckets: int, length: int) -> DataFrame:
    """Merge the arrays of each bucket (kind 0: new entries, 1: marks, 2: a level) and scan them once.

    Rows: kind 3, marks (docs, los, keys = ends) under the bucket of their documents; kind 2, new entries for a level (keys,
    classes); kind 4, contested keys.
    """

    def run(bucket: tuple, table: pa.Table) -> pa.Table:
        parts: dict[int, list[tuple]] = {0: [], 1: [], 2: []}
        for row in table.to_pylist():
            key, cls = np.frombuffer(row["keys"], "<u8"), np.frombuffer(row["classes"], "<u4").astype(np.int64)
            level = row["kind"] == 2
            doc = np.full(len(key), np.iinfo(np.int64).min) if level else np.frombuffer(row["docs"], "<i8")
            lo = np.full(len(key), -1) if level else np.frombuffer(row["los"], "<u4").astype(np.int64)
            parts[row["kind"]].append((key, cls, doc, lo))
        both = parts[0] + parts[2]
        rows, number = [], bucket[0].as_py()
        marks = [tuple(x) for x in [(d, lo, end.astype(np.int64)) for end, _, d, lo in parts[1]]]
        if both:
            key, cls, doc, lo = (np.concatenate(x) for x in zip(*both, strict=True))
            order, again = _repeated(key, cls, doc, lo)
            old = lo[order] < 0
            hit = order[again & ~old]
            marks.append((doc[hit], lo[hit], lo[hit] + (cls[hit] & 127) + length - 1))
            new = order[~again & ~old]
            if len(new):
                rows.append(_packed(number, 2, key[new], cls[new]))
            k = key[order[~again]]  # each class once: a key that comes twice has several
            twice = np.unique(k[1:][k[1:] == k[:-1]])
            if len(twice):
                rows.append(_packed(number, 4, twice, np.zeros(len(twice))))
        if marks:
            d, a, b = _joined(*(np.concatenate(x) for x in zip(*marks, strict=True)))
            to = (_mix(d.astype(_U)) % _U(buckets)).astype(np.int64)
            for target in np.unique(to).tolist():
                i = to == target
                rows.append(_packed(target, 3, b[i], np.zeros(int(i.sum())), d[i], a[i]))
        return pa.Table.from_pylist(rows, _schema(ROWS))

    return arrays.groupBy("bucket").applyInArrow(run, ROWS)


def _merged(levels: list[DataFrame], name: str) -> DataFrame:
    """Levels of one size as one: the arrays of each bucket in one sorted array."""
    both = levels[0]
    for x in levels[1:]:
        both = both.unionByName(x)

    def run(bucket: tuple, table: pa.Table) -> pa.Table:
        key = np.concatenate([np.frombuffer(x, "<u8") for x in table.column("keys").to_pylist()])
        cls = np.concatenate([np.frombuffer(x, "<u4") for x in table.column("classes").to_pylist()]).astype(np.int64)
        order = np.lexsort((cls, key))
        return pa.Table.from_pylist([_packed(bucket[0].as_py(), 2, key[order], cls[order])], _schema(ROWS))

    return stored(both.groupBy("bucket").applyInArrow(run, ROWS), name)


def _by_document(rows: DataFrame) -> DataFrame:
    """MARKS of rows of kind 3: one row per document, its marks in order and made one where they touch."""

    def run(bucket: tuple, table: pa.Table) -> pa.Table:
        parts = [(np.frombuffer(r["docs"], "<i8"), np.frombuffer(r["los"], "<u4").astype(np.int64), np.frombuffer(r["keys"], "<u8").astype(np.int64)) for r in table.to_pylist()]
        doc, lo, upto = _joined(*(np.concatenate(x) for x in zip(*parts, strict=True)))
        first = np.flatnonzero(np.concatenate(([True], doc[1:] != doc[:-1])))
        marks = pa.StructArray.from_arrays([pa.array(lo, pa.int64()), pa.array(upto, pa.int64())], ["lo", "upto"])
        lists = pa.ListArray.from_arrays(pa.array(np.append(first, len(doc)), pa.int32()), marks)
        return pa.Table.from_arrays([pa.array(doc[first], pa.int64()), lists], ["doc", "_marks"])

    return rows.where("kind = 3").groupBy("bucket").applyInArrow(run, MARKS)


class SuffixIndex:
    """A logarithmic family of levels: each batch is scanned against all of them and becomes a level itself."""

    def __init__(self, spark: SparkSession, length: int = LENGTH):
        self.spark, self.length = spark, length
        self.buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.levels: list[tuple[int, DataFrame]] = []  # (batches in it, its arrays), largest first
        self.found: list[DataFrame] = []

    def add(self, docs: DataFrame, last: bool = False) -> None:
        """Scan a batch (_seq, text; all _seq above those of earlier batches).  After the last batch no level is needed."""
        while len(self.levels) > 1 and self.levels[-1][0] == self.levels[-2][0]:
            (n, a), (m, b) = self.levels[-2:]
            self.levels[-2:] = [(n + m, _merged([a, b], "level"))]
        arrays = _arrays(docs, self.buckets, self.length)
        for _, level in self.levels:
            arrays = arrays.unionByName(level)
        out = _scan(arrays, self.buckets, self.length)
        out = stored(out.where("kind <> 2") if last else out, "scan")
        self.found.append(out.where("kind <> 2"))
        if not last:
            self.levels.append((1, out.where("kind = 2")))

    def contested(self) -> np.ndarray | None:
        """The filter of keys that occur with several classes: at most FILTER_BITS bits come to the driver."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for row in batch.to_pylist():
                    at = _bits(np.frombuffer(row["keys"], "<u8")).ravel()
                    word, inverse = np.unique(at >> _U(5), return_inverse=True)
                    value = np.zeros(len(word), np.int64)
                    np.bitwise_or.at(value, inverse.ravel(), np.int64(1) << (at & _U(31)).astype(np.int64))
                    yield pa.RecordBatch.from_arrays([pa.array(word.astype(np.int64), pa.int64()), pa.array(value, pa.int64())], ["word", "bits"])

        rows = self.found[0]
        for x in self.found[1:]:
            rows = rows.unionByName(x)
        words = rows.where("kind = 4").mapInArrow(run, "word long, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits")).toPandas()
        if not len(words):
            return None
        out = np.zeros(FILTER_BITS // 32, "<u4")
        out[words["word"].to_numpy()] = words["bits"].to_numpy().astype(np.uint32)
        return out.view(np.uint8)

    def marks(self, docs: DataFrame) -> DataFrame:
        """MARKS of all that has been added, a row per document that has any; ``docs`` are all batches together."""
        rows = self.found[0]
        for x in self.found[1:]:
            rows = rows.unionByName(x)
        asked = self.contested()
        if asked is not None:
            windows = stored(_scan(_arrays(docs, self.buckets, self.length, asked), self.buckets, self.length).where("kind = 3"), "windows")
            rows = rows.unionByName(windows)
        return _by_document(rows)


def sequenced(docs: DataFrame) -> DataFrame:
    """``docs`` with ``_seq``, a number of its own for each row, in order of doc_id: doc_id itself where that is one.

    Otherwise rows are numbered in order of (doc_id, text), null doc_ids first.
    """
    row = docs.agg(F.count(F.lit(1)), F.count("doc_id"), F.count_distinct("doc_id")).first()
    if row[0] == row[1] == row[2]:
        return docs.withColumn("_seq", F.col("doc_id").cast("long"))
    return stored(numbered(docs, [], ["doc_id", "text"], "_seq", "sequence"), "sequence")


def spans(docs: DataFrame, length: int = LENGTH, batches: int = BATCHES) -> DataFrame:
    """``docs`` (with _seq) and ``_spans``: the removed byte ranges (a, b) of each text, maximal and in order; null for none."""
    spark = docs.sparkSession
    inner = [q / batches for q in range(1, batches)]
    cuts = sorted(set(docs.approxQuantile("_seq", inner, 0.01))) if inner else []
    index = SuffixIndex(spark, length)
    bounds = [None, *cuts, None]
    for i, (a, b) in enumerate(zip(bounds, bounds[1:], strict=False)):
        part = docs
        part = part if a is None else part.where(F.col("_seq") > int(a))
        part = part if b is None else part.where(F.col("_seq") <= int(b))
        index.add(part, last=i == len(bounds) - 2)
    per_doc = index.marks(docs)
    return docs.join(per_doc, docs["_seq"] == per_doc["doc"], "left").drop("doc")


def cut(data: bytes, marks: list[dict] | None) -> tuple[bytes, list[tuple[int, int]]]:
    """What is left of a text, and the ranges that were removed."""
    merged: list[list[int]] = []
    for a, b in sorted((m["lo"], m["upto"]) for m in marks or []):
        if merged and a <= merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], b)
        else:
            merged.append([a, b])
    left, at = [], 0
    for a, b in merged:
        left.append(data[at:a])
        at = b
    return b"".join([*left, data[at:]]), [(a, b) for a, b in merged]


def deduplicated(docs: DataFrame, length: int = LENGTH, batches: int = BATCHES) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and ``text`` (what is left) of every document.

    A null text counts as empty.  Rows that repeat a doc_id are documents of their own, in order of text.  Where a cut splits
    a character, ``text`` leaves out its other part too; ``kept_sha256`` is over all remaining bytes.
    """

    def run(batches_: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches_:
            rows = []
            for doc_id, text, marks in zip(*(batch.column(i) for i in range(3)), strict=True):
                data = (text.as_py() or "").encode("utf-8", "surrogatepass")
                left, gone = cut(data, marks.as_py())
                rows.append((doc_id.as_py(), len(data), len(data) - len(left), len(gone), hashlib.sha256(left).hexdigest(), left.decode("utf-8", "ignore")))
            if rows:
                types = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()]
                names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "text"]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)

    found = spans(sequenced(docs.select(F.col("doc_id").cast("long"), "text")), length, batches)
    return found.select("doc_id", "text", "_marks").mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, text string")


def remaining(docs: DataFrame, length: int = LENGTH, batches: int = BATCHES) -> DataFrame:
    """``docs`` with what is left of each text (a null stays null); all other columns and the number of rows stay.

    Columns named ``_seq``, ``_marks`` or ``doc`` are taken.
    """

    @F.pandas_udf("string")
    def left(texts: pd.Series, marks: pd.Series) -> pd.Series:
        out = [None if t is None else t if m is None else cut(t.encode("utf-8", "surrogatepass"), list(m))[0].decode("utf-8", "ignore") for t, m in zip(texts, marks, strict=True)]
        return pd.Series(out, dtype=object)

    found = spans(sequenced(docs), length, batches)
    return found.select(*[left("text", "_marks").alias("text") if c == "text" else F.col(c) for c in docs.columns])
