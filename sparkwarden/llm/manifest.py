"""A Merkle manifest of a dataset, and proofs of its rows.

Every row is a leaf; the leaves of a source, in order of doc_id, form a tree whose nodes take three children each, and
the roots of all sources form another one.  A node is named by its tree, its level and its index there, so that parents
and siblings follow from arithmetic.

Both building and proving work on leaf partitions of ``BLOCK`` consecutive leaves (a power of three): a task derives all levels of
its block, and only the block's top goes on to the next pass, which has ``BLOCK`` times fewer rows.  No task sees a whole source.

Proofs are octopus multiproofs.  Per leaf partition, the wanted leaves are the known nodes of the lowest level; per level,
what is missing to derive all parents is the union of their siblings less what is known.  The coordinates of that union are joined with
the stored nodes once; every shared interior node is then derived once, and each leaf's own proof is read off and folded up to the root, whether the leaf was changed or not.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkwarden.llm.common import numbered, stored

ARITY = 3
#: Levels that a task derives at once, and the leaves below them.
LEVELS = 6
BLOCK = ARITY**LEVELS

NODES = "tree string, level int, idx long, digest binary"
PROOFS = "id long, digest binary, subroot binary, root binary, siblings binary, folded binary"


def digest(inputs: Iterable[bytes]) -> bytes:
    """The SHA-256 of digests, joined as lower-case hex text."""
    return hashlib.sha256("".join(x.hex() for x in inputs).encode()).digest()


def field(value: Column) -> Column:
    """A value as it enters a leaf: ``-`` for null, else its UTF-8 length, a colon and itself."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_digest(doc_id: Column, source: Column, lang: Column, n_chars: Column, text: Column) -> Column:
    return F.unhex(F.sha2(F.concat(*[field(c) for c in (doc_id, source, lang, n_chars, text)]), 256))


def tree_name(source: Column) -> Column:
    """A name of a source's tree that is never null and sorts as sources do: null first, then by bytes."""
    return F.coalesce(F.concat(F.lit("="), source.cast("string")), F.lit("-"))


def level_sizes(n: int) -> list[int]:
    """Nodes on each level of a tree of ``n`` leaves, from the leaves to the single root."""
    sizes = [n]
    while sizes[-1] > 1:
        sizes.append(-(-sizes[-1] // ARITY))
    return sizes


def run_of(idx: int, size: int) -> range:
    """The indexes of the run that ``idx`` belongs to, on a level of ``size`` nodes."""
    start = idx - idx % ARITY
    return range(start, min(start + ARITY, size))


def missing(wanted: Iterable[int], n: int) -> list[tuple[int, int]]:
    """The least set of (level, index) that, with the wanted leaves, gives the root of a tree of ``n`` leaves."""
    known, out = set(wanted), []
    for level, size in enumerate(level_sizes(n)[:-1]):
        need = {i for k in known for i in run_of(k, size)} - known
        out += [(level, i) for i in sorted(need)]
        known = {k // ARITY for k in known}
    return out


def interiors(leaves: dict[int, bytes], fetched: dict[tuple[int, int], bytes], n: int) -> list[dict[int, bytes]]:
    """Per level all nodes that follow from the wanted leaves and the fetched nodes; shared ones are derived once."""
    levels = []
    known = dict(leaves)
    for level, size in enumerate(level_sizes(n)):
        mine = sorted(known)
        known |= {i: d for (at, i), d in fetched.items() if at == level}
        levels.append(known)
        if size > 1:
            known = {p: digest(known[i] for i in run_of(p * ARITY, size)) for p in dict.fromkeys(k // ARITY for k in mine)}
    return levels


def fold(value: bytes, pos: int, n: int, siblings: bytes) -> bytes:
    """The root that a leaf at ``pos`` of ``n`` gives with these siblings (digests in turn, level by level, left to right)."""
    at = 0
    for size in level_sizes(n)[:-1]:
        run = run_of(pos, size)
        parts = []
        for i in run:
            if i == pos:
                parts.append(value)
            else:
                parts.append(siblings[at : at + 32])
                at += 32
        value = digest(parts)
        pos //= ARITY
    return value


def _table(rows: list[tuple], types: list[pa.DataType], names: list[str]) -> pa.Table:
    columns = zip(*rows, strict=True) if rows else [[] for _ in types]
    return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)


def nodes(leaves: DataFrame) -> DataFrame:
    """NODES of all trees, stored: ``leaves`` has tree, pos (0 ..), digest and n, the tree's number of leaves."""

    def climb(level: int):
        def run(table: pa.Table) -> pa.Table:
            name, n = table.column("tree")[0].as_py(), table.column("n")[0].as_py()
            sizes = level_sizes(n)
            known = dict(zip(table.column("pos").to_pylist(), table.column("digest").to_pylist(), strict=True))
            rows = []
            for at in range(level + 1, min(level + LEVELS, len(sizes) - 1) + 1):
                parents = dict.fromkeys(k // ARITY for k in sorted(known))
                known = {p: digest(known[i] for i in run_of(p * ARITY, sizes[at - 1])) for p in parents}
                rows += [(name, at, p, d, n) for p, d in known.items()]
            return _table(rows, [pa.string(), pa.int32(), pa.int64(), pa.binary(), pa.int64()], ["tree", "level", "idx", "digest", "n"])

        return run

    lowest = leaves.select("tree", F.lit(0).alias("level"), F.col("pos").alias("idx"), "digest", "n")
    out, at = lowest, 0
    deepest = len(level_sizes(leaves.agg(F.max("n")).first()[0] or 0)) - 1
    while at < deepest:
        base = out.where(F.col("level") == at).select("tree", F.col("idx").alias("pos"), "digest", "n", F.floor(F.col("idx") / BLOCK).alias("block"))
        made = base.groupBy("tree", "block").applyInArrow(climb(at), NODES + ", n long")
        at += LEVELS
        out = out.unionByName(stored(made, "merkle-nodes"))
    return out.drop("n")


def proofs(leaves: DataFrame, tree: DataFrame, upper: DataFrame | None = None) -> DataFrame:
    """PROOFS of the leaves: their siblings in turn, level by level up to the root, and the root that ``other`` folds to with them.

    ``leaves`` has id, tree, pos, digest, other (the digest to be checked) and n: all leaves of ``tree`` or any part of them.
    ``upper`` has a row per tree: its root's place ``pos`` of ``n`` in a tree of roots, and that tree's ``siblings`` and ``root``;
    proofs then go on to there.  Without it the root is the tree's own.
    """
    own = leaves.select("id", "tree", "pos", "digest", "other", "n", F.floor(F.col("pos") / BLOCK).alias("block"))

    def coordinates(table: pa.Table) -> pa.Table:
        name, n, block = (table.column(c)[0].as_py() for c in ("tree", "n", "block"))
        rows = [(name, block, level, idx) for level, idx in missing(table.column("pos").to_pylist(), n)]
        return _table(rows, [pa.string(), pa.int64(), pa.int32(), pa.int64()], ["tree", "block", "level", "idx"])

    wanted = own.select("tree", "block", "pos", "n").groupBy("tree", "block").applyInArrow(coordinates, "tree string, block long, level int, idx long")
    fetched = wanted.join(tree, ["tree", "level", "idx"]).select("tree", "block", "level", "idx", "digest", F.lit(None).cast("long").alias("m"), F.lit(None).cast("binary").alias("root"))
    if upper is not None:
        above = upper.select("tree", F.lit(-1).alias("level"), F.col("pos").alias("idx"), F.col("siblings").alias("digest"), F.col("n").alias("m"), "root")
        fetched = fetched.unionByName(own.select("tree", "block").distinct().join(above, "tree"))

    def expand(mine: pa.Table, got: pa.Table) -> pa.Table:
        n = mine.column("n")[0].as_py()
        ids, pos, digests, others = (mine.column(c).to_pylist() for c in ("id", "pos", "digest", "other"))
        there, up, m, up_pos, top = {}, b"", 1, 0, None
        for level, idx, value, count, root in zip(*[got.column(c).to_pylist() for c in ("level", "idx", "digest", "m", "root")], strict=True):
            if level < 0:
                up, m, up_pos, top = value, count, idx, root
            else:
                there[level, idx] = value
        levels, sizes = interiors(dict(zip(pos, digests, strict=True)), there, n), level_sizes(n)
        above: dict[tuple[int, int], bytes] = {}  # siblings from a node to the root, shared by all leaves below it

        def siblings(level: int, idx: int) -> bytes:
            if level == len(sizes) - 1:
                return up
            if (level, idx) not in above:
                beside = b"".join(levels[level][i] for i in run_of(idx, sizes[level]) if i != idx)
                above[level, idx] = beside + siblings(level + 1, idx // ARITY)
            return above[level, idx]

        subroot = levels[-1][0]
        top = subroot if top is None else top
        rows = []
        for key, p, d, other in zip(ids, pos, digests, others, strict=True):
            found = siblings(0, p)
            # Every proof is checked by itself: the root it gives owes nothing to the root it is compared with.
            folded = fold(fold(other, p, n, found), up_pos, m, up)
            rows.append((key, d, subroot, top, found, folded))
        return _table(rows, [pa.int64(), *[pa.binary()] * 5], [c.split()[0] for c in PROOFS.split(", ")])

    return own.groupBy("tree", "block").cogroup(fetched.groupBy("tree", "block")).applyInArrow(expand, PROOFS)


def placed(rows: DataFrame) -> DataFrame:
    """Stored ``rows`` (id, tree, digest, other) with their place ``pos`` in their tree and its number ``n`` of leaves.

    Leaves ascend by id, nulls first; rows that share an id follow in order of their digest.
    """
    sizes = rows.groupBy("tree").agg(F.count(F.lit(1)).alias("n"))
    at = numbered(rows, ["tree"], ["id", "digest", "other"], "pos", "merkle-leaves")
    return stored(at.join(sizes, "tree"), "merkle-placed")


def tampered(text: Column) -> Column:
    """A text that lost its line feeds."""
    return F.replace(text, F.lit("\n"), F.lit(""))


def even(doc_id: Column) -> Column:
    """Whether 2 divides the CRC-32 of the decimal doc_id; false for a null."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 2 == 0, F.lit(False))


def verified(docs: DataFrame, tamper: Column | None = None) -> DataFrame:
    """One row per document: doc_id, leaf, subroot, root, proof_sha256, folded_root and verified.

    ``tamper`` says which rows are checked with a text without line feeds (none: no row).  Equal rows are leaves of their own
    and interchangeable; a null doc_id comes first and is never tampered with by :func:`even`.  Null and empty values have leaves
    of their own (``-`` and ``0:``).  An empty table gives no rows.  Other columns are not read, whatever their names.
    """
    cells = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars")]
    changed = F.contains("text", F.lit("\n")) & (F.lit(False) if tamper is None else tamper)
    leaf = leaf_digest(*cells, F.col("text"))
    digests = docs.select(
        F.col("doc_id").cast("long").alias("id"), tree_name(F.col("source")).alias("tree"), leaf.alias("digest"),
        F.when(changed, leaf_digest(*cells, tampered(F.col("text")))).otherwise(leaf).alias("other"),
    )
    leaves = placed(stored(digests, "merkle-digests"))
    tree = nodes(leaves)
    # A tree's root is the one node of its topmost level.
    top = tree.where("idx = 0").groupBy("tree").agg(F.max_by("digest", "level").alias("digest"))
    sources = numbered(stored(top, "merkle-subroots"), [], ["tree"], "pos", "merkle-sources")
    n_sources = sources.count()
    roots = sources.select("pos", F.col("tree").alias("name"), F.lit("").alias("tree"), "digest", F.col("digest").alias("other"), F.lit(n_sources).cast("long").alias("n"))
    lines = proofs(roots.withColumn("id", F.col("pos")), nodes(roots))
    upper = roots.join(lines.select(F.col("id").alias("pos"), "siblings", "root"), "pos").select(F.col("name").alias("tree"), "pos", "n", "siblings", "root")
    found = proofs(leaves, tree, stored(upper, "merkle-upper"))
    text = lambda c: F.lower(F.hex(c))
    return found.select(
        F.col("id").alias("doc_id"), text("digest").alias("leaf"), text("subroot").alias("subroot"), text("root").alias("root"),
        F.sha2(text("siblings"), 256).alias("proof_sha256"), text("folded").alias("folded_root"), (F.col("folded") == F.col("root")).alias("verified"),
    )
