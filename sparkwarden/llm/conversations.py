"""Repair of conversation structure: the cheapest edits that make a conversation's roles well-formed.

A row's symbol says all that the choice of edits depends on: its role's initial, whether it is truncated, or that it must go.  A
conversation is a string of symbols, in segments of at most ``SEGMENT``.  Of all conversations' segments only different
ones are solved.  They are sorted from their ends and their suffixes form the nodes of one automaton, each shared by all segments
that end alike: a node's table follows from its symbol and the next node's and is made once for all of them.
It holds, for each grammar state before and after, the least cost to go and the first in order of the cheapest audits.  As edits of equal
audit and start lead to the same state, tables of consecutive segments compose.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkwarden.llm.common import SPACES, numbered, stored
from sparkwarden.llm.hot import spread_join

SEGMENT = 512
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5
LEGAL = ("su", "ua", "au")

#: Grammar states: nothing yet, after a system row, after a user row, after an assistant row; where one may end.
STATES = range(4)
ENDS = (0, 3)
#: The state after the one role, user or assistant, that may come next.
NEXT = (2, 2, 3, 2)
ROLE = {2: "user", 3: "assistant"}

#: (cost, audit) by state before * 4 + state after; None where no edits lead there.
Table = tuple[tuple[int, str] | None, ...]


def after_keep(state: int, symbol: str) -> int | None:
    """The state after a kept row, None if its role can't come next."""
    low = symbol.lower()
    if low == "s":
        return 1 if state == 0 else None
    return NEXT[state] if low == ROLE[NEXT[state]][0] else None


def _inserts(table: list) -> Table:
    """The table with rows inserted before: at most three, then a state would come again."""
    for _ in STATES:
        for state in STATES:
            for end in STATES:
                behind = table[NEXT[state] * 4 + end]
                if behind is not None:
                    option = (behind[0] + INSERT, "I" + behind[1])
                    now = table[state * 4 + end]
                    table[state * 4 + end] = option if now is None else min(now, option)
    return tuple(table)


END: Table = _inserts([(0, "") if i // 4 == i % 4 else None for i in range(16)])


def node(symbol: str, behind: Table) -> Table:
    """The table of a node: ``x`` must be deleted, a capital is truncated."""
    table: list = [None] * 16
    for state in STATES:
        steps = [("D", DELETE, state)]
        if symbol != "x":
            extra = TRUNCATED if symbol.isupper() else 0
            kept = after_keep(state, symbol)
            steps.append(("R", REROLE + extra, NEXT[state]))
            if kept is not None:
                steps.append(("K", KEEP + extra, kept))
        for end in STATES:
            options = [(cost + to[0], letter + to[1]) for letter, cost, at in steps if (to := behind[at * 4 + end]) is not None]
            table[state * 4 + end] = min(options, default=None)
    return _inserts(table)


def joined(first: Table, second: Table) -> Table:
    """The table of two segments in turn."""
    table: list = [None] * 16
    for state in STATES:
        for end in STATES:
            pairs = [(a, b) for mid in STATES if (a := first[state * 4 + mid]) is not None and (b := second[mid * 4 + end]) is not None]
            least = min((a[0] + b[0] for a, b in pairs), default=None)
            table[state * 4 + end] = min(((least, a[1] + b[1]) for a, b in pairs if a[0] + b[0] == least), default=None)
    return tuple(table)


def composed(tables: list[Table]) -> Table:
    """The table of all segments in turn, in pairs, so that audits are copied once per doubling."""
    while len(tables) > 1:
        tables = [joined(*tables[i : i + 2]) if i + 1 < len(tables) else tables[i] for i in range(0, len(tables), 2)]
    return tables[0]


TABLE_TYPE = pa.list_(pa.struct([("cost", pa.int64()), ("audit", pa.string())]))
TABLE = "array<struct<cost: long, audit: string>>"


class Automaton:
    """Tables of segments that come sorted from their ends; only the path of nodes of the last one is held."""

    def __init__(self) -> None:
        self.path, self.last = [END], ""

    def table(self, symbols: str) -> Table:
        turned = symbols[::-1]
        shared = 0
        while shared < min(len(turned), len(self.last)) and turned[shared] == self.last[shared]:
            shared += 1
        del self.path[shared + 1 :]
        for symbol in turned[shared:]:
            self.path.append(node(symbol, self.path[-1]))
        self.last = turned
        return self.path[-1]


def solved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Signatures (symbols, n_rows), sorted from their ends, with their tables."""
    automaton = Automaton()
    for batch in batches:
        tables = [[None if c is None else {"cost": c[0], "audit": c[1]} for c in automaton.table(text)] for text in batch.column(0).to_pylist()]
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(tables, TABLE_TYPE)], ["symbols", "n_rows", "table"])


def name(conv_id: Column) -> Column:
    """A conversation's key that is never null."""
    return F.coalesce(F.concat(F.lit("="), conv_id.cast("string")), F.lit("-"))


def damaged(conversations: DataFrame) -> DataFrame:
    """The rows after the damage that a checksum of conversation and turn decides: conv_id, turn, role, text (nulls: one space)."""
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(blank("conv_id"), F.lit(":"), blank("turn")).cast("binary")) % 20
    role = F.when(kind == 4, "user").otherwise(blank("role"))
    text = F.when(kind == 1, "").when(kind == 2, F.translate(blank("text"), ".!?", "")).otherwise(blank("text"))
    rows = conversations.select("conv_id", "turn", role.alias("role"), text.alias("text"), kind.alias("_kind")).where("_kind <> 0")
    times = F.array_repeat(F.lit(0), F.when(F.col("_kind") == 3, 2).otherwise(1))
    return rows.withColumn("_time", F.explode(times)).select("conv_id", "turn", "role", "text")


def _named(rows: DataFrame) -> DataFrame:
    """Rows with their key, nulls as one space, and a digest that tells texts of a role apart."""
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    return rows.select(name(F.col("conv_id")).alias("name"), F.col("turn").cast("long").alias("turn"), blank("role").alias("role"), blank("text").alias("text")).withColumn(
        "digest", F.unhex(F.sha2("text", 256))
    )


def faults(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Per conversation name, gaps, blank, duplicate, truncated, illegal; and its stored segments name, seg, symbols.

    ``rows`` are conv_id, turn, role, text.  A conversation's rows are in order of turn, nulls first; rows of one turn in order of
    role and of their text's SHA-256.  No text leaves the task that reads it.
    """
    seen = F.btrim("text", F.lit(SPACES))
    initial = F.substring("role", 1, 1)
    letter = F.when(initial.isin("s", "u", "a"), initial).otherwise("o")
    cut = ~F.right(seen, F.lit(1)).isin(".", "!", "?")
    narrow = _named(rows).select("name", "turn", "role", "digest", initial.alias("initial"), (seen == "").alias("blank"), F.when(cut, F.upper(letter)).otherwise(letter).alias("symbol"))
    placed = stored(numbered(stored(narrow, "turns"), ["name"], ["turn", "role", "digest"], "pos", "turn-order"), "turn-places")
    counts = placed.groupBy("name").agg(
        F.count(F.lit(1)).alias("n"), F.count_if("blank").alias("blank"),
        F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn"), F.lit(0)).alias("gaps"),
    )
    # Whatever is neither blank nor the first with its role and text has to go.
    first = placed.where("NOT blank").groupBy("name", "role", "digest").agg(F.min(F.struct("pos", "symbol")).alias("f")).select("name", F.col("f.pos").alias("pos"), F.col("f.symbol").alias("symbol"))
    both = placed.select("name", "pos", "initial", F.lit(None).cast("string").alias("symbol")).unionByName(first.withColumn("initial", F.lit(None).cast("string")))
    at = F.struct((F.col("pos") % SEGMENT).alias("at"), F.coalesce("initial", "symbol").alias("of"))
    lists = both.groupBy("name", F.floor(F.col("pos") / SEGMENT).alias("seg")).agg(
        F.array_sort(F.collect_list(F.when(F.col("initial").isNotNull(), at))).alias("rows"),
        F.map_from_entries(F.collect_list(F.when(F.col("symbol").isNotNull(), at))).alias("marks"),
    )
    initials = F.transform("rows", lambda x: x["of"])
    pairs = F.zip_with(F.slice(initials, 1, F.size("rows") - 1), F.slice(initials, 2, F.size("rows")), lambda a, b: F.concat(a, b))
    segments = stored(
        lists.select(
            "name", "seg",
            F.array_join(F.transform("rows", lambda x: F.coalesce(F.col("marks")[x["at"]], F.lit("x"))), "").alias("symbols"),
            F.size(F.filter(pairs, lambda p: ~p.isin(*LEGAL))).cast("long").alias("illegal"),
            F.size("marks").cast("long").alias("fresh"),
            F.size(F.filter(F.map_values("marks"), lambda s: s == F.upper(s))).cast("long").alias("truncated"),
            initials[0].alias("head"), F.element_at(initials, -1).alias("tail"),
        ),
        "segments",
    )
    over = Window.partitionBy("name").orderBy("seg")  # a row per segment
    seam = ~F.concat(F.lag("tail").over(over), F.col("head")).isin(*LEGAL)
    summed = segments.withColumn("seam", F.coalesce(seam, F.lit(False))).groupBy("name").agg(
        F.sum(F.col("illegal") + F.col("seam").cast("long")).alias("illegal"), F.sum("fresh").alias("fresh"), F.sum("truncated").alias("truncated"), F.count(F.lit(1)).alias("n_segments")
    )
    found = counts.join(summed, "name").select("name", "n_segments", "gaps", "blank", (F.col("n") - F.col("blank") - F.col("fresh")).alias("duplicate"), "truncated", "illegal")
    return stored(found, "faults"), segments.select("name", "seg", "symbols")


def audits(found: DataFrame, segments: DataFrame) -> DataFrame:
    """name, cost and audit of each conversation: one letter an edit, the first in order among the cheapest.

    A conversation's audit is one value; its task holds a few candidates of it, no rows.
    """
    signatures = stored(segments.groupBy("symbols").agg(F.count(F.lit(1)).alias("n_rows")), "signatures")
    n = int(segments.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    turned = signatures.withColumn("turned", F.reverse("symbols"))
    tables = turned.repartitionByRange(n, "turned").sortWithinPartitions("turned").select("symbols", "n_rows").mapInArrow(solved, f"symbols string, n_rows long, table {TABLE}")
    known = spread_join(segments.join(found.select("name", "n_segments"), "name"), stored(tables, "tables"), "symbols", "n_rows")
    best = F.array_min(F.filter(F.array(*[F.col("table")[e] for e in ENDS]), lambda c: c.isNotNull())).alias("best")
    single = known.where("n_segments = 1").select("name", best)

    def whole(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("seg")
        tables = [tuple(None if c is None else (c["cost"], c["audit"]) for c in t.as_py()) for t in rows.column("table")]
        table = composed(tables)
        cost, audit = min(c for e in ENDS if (c := table[e]) is not None)
        return pa.table({"name": rows.column("name")[:1], "cost": pa.array([cost], pa.int64()), "audit": pa.array([audit], pa.string())})

    many = known.where("n_segments > 1").select("name", "seg", "table").groupBy("name").applyInArrow(whole, "name string, cost long, audit string")
    return single.select("name", "best.cost", "best.audit").unionByName(many)


#: What is known of a conversation before its rows are read again.
FACTS = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"
ASSESSED = f"conv_id long, {FACTS}, repaired_sha256 string"
REPAIRED = "conv_id long, step long, edit string, role string, text string"


def _replayed(rows: DataFrame, everyone: DataFrame | None) -> DataFrame:
    """Facts and rows of all conversations, one conversation after the other: its facts first, its rows in order."""
    found, segments = faults(rows)
    facts = found.join(audits(found, segments), "name")
    fields = [c.split()[0] for c in FACTS.split(", ")]
    named = (rows if everyone is None else everyone).select("conv_id").distinct().select(name(F.col("conv_id")).alias("name"), F.col("conv_id").cast("long").alias("conv_id"))
    zero = {c: F.coalesce(c, F.lit("" if c == "audit" else 0)) for c in fields}
    heads = named.join(facts, "name", "left").select("name", "conv_id", *[v.alias(c) for c, v in zero.items()], F.lit(0).alias("kind"))
    body = _named(rows).withColumn("kind", F.lit(1))
    both = heads.unionByName(body, allowMissingColumns=True).repartition("name").sortWithinPartitions("name", "kind", "turn", "role", "digest")
    return both.select("kind", "conv_id", *fields, "role", "text")


class _Replay:
    """Goes through conversations that come row by row; holds one conversation's facts and a digest, no rows."""

    def __init__(self, facts: dict | None) -> None:
        self.facts, self.at, self.state, self.step, self.parts = facts, 0, 0, 0, 0
        self.digest = hashlib.sha256()

    def _done(self, letter: str, role: str, text: str) -> tuple:
        if letter in "IR":
            self.state = NEXT[self.state]
            role = ROLE[self.state]
        elif letter == "K":
            self.state = after_keep(self.state, role[:1])
        if letter != "D":
            self.digest.update((("\n" if self.parts else "") + role + ":" + text).encode("utf-8", "surrogatepass"))
            self.parts += 1
        self.at += 1
        return self.facts["conv_id"], self.at - 1, letter, role, text

    def inserted(self) -> Iterator[tuple]:
        audit = self.facts["audit"]
        while self.at < len(audit) and audit[self.at] == "I":
            yield self._done("I", "", "")

    def row(self, role: str, text: str) -> tuple:
        return self._done(self.facts["audit"][self.at], role, text)

    def result(self) -> tuple:
        return *self.facts.values(), self.digest.hexdigest()


def _replay(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[tuple], list[tuple]]]:
    """Per batch the edits done and the conversations ended."""
    names = ["conv_id", *[c.split()[0] for c in FACTS.split(", ")]]
    now = None
    for batch in batches:
        done, ended = [], []
        kinds, roles, texts = (batch.column(c).to_pylist() for c in ("kind", "role", "text"))
        for i, (kind, role, text) in enumerate(zip(kinds, roles, texts, strict=True)):
            if kind == 0:
                if now is not None:
                    done += now.inserted()
                    ended.append(now.result())
                now = _Replay({c: batch.column(c)[i].as_py() for c in names})
            else:
                done += now.inserted()
                done.append(now.row(role, text))
        yield done, ended
    if now is not None:
        yield list(now.inserted()), [now.result()]


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "string": pa.string()}
    fields = [f.split() for f in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[k]) for c, (_, k) in zip(zip(*rows, strict=True), fields, strict=True)], [n for n, _ in fields])


def assessed(rows: DataFrame, everyone: DataFrame | None = None) -> DataFrame:
    """ASSESSED: faults, least cost, audit and digest of the repair of each conversation of ``rows`` (or of ``everyone``).

    ``rows`` are conv_id, turn, role, text; null roles and texts count as one space, rows with a null conv_id are one
    conversation.  Rows that repeat are duplicates.  A conversation without rows has zeros, an empty audit and the
    digest of an empty text.  An empty table gives no rows.  Other columns are not read, whatever their names.  All texts of one
    conversation pass one task, as their digest is a running one; the task holds none of them.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, ended in _replay(batches):
            if ended:
                yield _batch(ended, ASSESSED)

    return _replayed(rows, everyone).mapInArrow(run, ASSESSED)


def repaired(rows: DataFrame) -> DataFrame:
    """REPAIRED: every edit of every conversation in turn (``step`` from 0); rows with edit D are those left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for done, _ in _replay(batches):
            if done:
                yield _batch(done, REPAIRED)

    return _replayed(rows, None).mapInArrow(run, REPAIRED)
