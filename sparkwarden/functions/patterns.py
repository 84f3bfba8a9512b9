"""Regular-expression helpers.

Patterns in :mod:`sparkwarden.values` carry no flags.  ``java`` adds the ones that make a
Spark (Java) match behave like the reference semantics: ``d`` so that ``.`` stops only at
``\\n``, and ``U`` so that ``\\w \\b \\s \\d`` and case folding follow Unicode.
"""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Letters outside ASCII that fold onto an ASCII letter under Unicode case folding.
_FOLDING = "\u0130\u0131\u017f\u212a"
_FOLDED = "iisk"


def java(pattern: str, *, ignore_case: bool = False, dotall: bool = False, multiline: bool = False) -> str:
    flags = "dU" + ("i" if ignore_case else "") + ("s" if dotall else "") + ("m" if multiline else "")
    return f"(?{flags}){pattern}"


def found(text: Column, pattern: str, **flags: bool) -> Column:
    return text.rlike(java(pattern, **flags))


def first(text: Column, pattern: str, group: int = 1, **flags: bool) -> Column:
    """Text of a group in the first match, '' when there is none."""
    return F.regexp_extract(text, java(pattern, **flags), group)


def every(text: Column, pattern: str, group: int = 0, **flags: bool) -> Column:
    """Text of a group in every non-overlapping match, left to right."""
    return F.regexp_extract_all(text, F.lit(java(pattern, **flags)), F.lit(group))


def strip(text: Column) -> Column:
    """Strip Unicode white space on both sides (``trim`` only strips blanks)."""
    return F.regexp_replace(text, r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$", "")


def lines(text: Column) -> Column:
    """Split on every line boundary, not only on ``\\n``."""
    return F.split(text, r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]")


def folded(text: Column) -> Column:
    """Lower-case form in which every anchor literal of a match is visible."""
    foreign = any_of([F.contains(text, F.lit(c)) for c in _FOLDING])
    return F.when(foreign, F.lower(F.translate(text, _FOLDING, _FOLDED))).otherwise(F.lower(text))


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once, even where the optimizer would inline it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def kept(columns: dict[str, Column], condition) -> Column:
    """The columns as one struct, exploded only when ``condition(struct)`` holds.

    A plain filter over a computed column is pushed below the projection and computed twice;
    inside a generator every column is computed once.
    """
    row = F.struct(*[c.alias(n) for n, c in columns.items()])
    return F.explode(F.filter(F.array(row), condition))


def literals_of(tests: list[tuple[list, str]]) -> list[str]:
    """Every anchor literal of some tests."""
    flat = [x for anchors, _ in tests for a in anchors for x in (a if isinstance(a, list) else [a])]
    return sorted(set(flat))


def literals_in(text: Column, literals: list[str]) -> Column:
    """Which of some lower-case literals a text contains, each looked for once.

    Measured against one alternation over all literals, separate byte searches are three times
    faster and need no regular expression.
    """
    if not literals:
        return F.array().cast("array<string>")
    return let(folded(text), lambda t: F.filter(strings(literals), lambda x: F.contains(t, x)))


def matching(text: Column, tests: list[tuple[list, str]], found_literals: Column | None = None) -> Column:
    """Indices of the tests, ``(anchors, Java pattern)``, that match a text.

    The tests are one constant array walked by a filter: a few dozen unrolled expressions would
    exceed what one generated method may hold, and a pattern only runs on a text that contains
    its anchors.  ``found_literals`` may come from a wider :func:`literals_in`.
    """
    if not tests:
        return F.array().cast("array<int>")
    rows = [
        {
            "i": i,
            "every": [a for a in anchors if not isinstance(a, list)],
            "some": next((a for a in anchors if isinstance(a, list)), []),
            "pattern": pattern,
        }
        for i, (anchors, pattern) in enumerate(tests)
    ]
    table = constant(rows, "array<struct<i:int,every:array<string>,some:array<string>,pattern:string>>")

    def hits(t: Column) -> Column:
        matched = F.filter(
            table,
            lambda r: (F.size(F.array_except(r["every"], t["found"])) == 0)
            & ((F.size(r["some"]) == 0) | F.arrays_overlap(r["some"], t["found"]))
            & F.rlike(t["text"], r["pattern"]),
        )
        return F.transform(matched, lambda r: r["i"])

    if found_literals is None:
        found_literals = literals_in(text, literals_of(tests))
    return let(F.struct(text.alias("text"), found_literals.alias("found")), hits)


def once(column: Column) -> Column:
    """The column behind a generator, which the optimizer never inlines or repeats."""
    return F.explode(F.array(column))


def any_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions)


def all_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions)


def is_json(text: Column) -> Column:
    """Strict validity: the JSON readers of Spark accept trailing text, this does not."""
    return F.coalesce(F.json_array_length(F.concat(F.lit("["), text, F.lit("]"))) == 1, F.lit(False))


def starts_with_any(text: Column, prefixes: list[str]) -> Column:
    return any_of([text.startswith(p) for p in prefixes])


def contains_any(text: Column, parts: list[str]) -> Column:
    return any_of([F.contains(text, F.lit(p)) for p in parts])


def strings(values: list[str]) -> Column:
    """A constant array of strings."""
    return constant(values, "array<string>")


def constant(value: object, schema: str) -> Column:
    """A nested constant from one JSON literal, folded by the optimizer.

    Building it from single literals would cost a call into the JVM for each of them.
    """
    return F.from_json(F.lit(json.dumps(value)), schema)


def severity_rank(name: Column) -> Column:
    """NONE < LOW < MEDIUM < HIGH < CRITICAL as 0..4; anything else ranks 0."""
    s = F.upper(name)
    return (
        F.when(s == "LOW", 1).when(s == "MEDIUM", 2).when(s == "HIGH", 3).when(s == "CRITICAL", 4).otherwise(0)
    )


def severity_name(rank: Column) -> Column:
    return (
        F.when(rank == 1, "LOW").when(rank == 2, "MEDIUM").when(rank == 3, "HIGH").when(rank == 4, "CRITICAL")
        .otherwise("NONE")
    )


def outcome_rank(name: Column) -> Column:
    """safe < needs_review < malicious < error as 0..3, which is also the exit code."""
    return F.when(name == "needs_review", 1).when(name == "malicious", 2).when(name == "error", 3).otherwise(0)


def outcome_name(rank: Column) -> Column:
    return F.when(rank == 1, "needs_review").when(rank == 2, "malicious").when(rank == 3, "error").otherwise("safe")
