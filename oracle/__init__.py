"""The same queries in DuckDB SQL, written independently of the Spark operators."""

from __future__ import annotations

ORACLES: dict[str, str] = {}


def all_oracles() -> dict[str, str]:
    from oracle import decisions, evidence, files, names, sinks, traces

    out: dict[str, str] = {}
    for module in (files, names, decisions, evidence, traces, sinks):
        out.update(module.sql())
    return out


def lit(text: str) -> str:
    """A DuckDB string literal."""
    return "'" + text.replace("'", "''") + "'"


def lits(items) -> str:
    return ", ".join(lit(i) for i in items)


def lst(items) -> str:
    return "[" + lits(items) + "]::VARCHAR[]"


def rx(pattern: str, flags: str = "") -> str:
    return lit((f"(?{flags})" if flags else "") + pattern)


def m(column: str, pattern: str, flags: str = "") -> str:
    return f"regexp_matches({column}, {rx(pattern, flags)})"


RANK = "CASE {c} WHEN 'LOW' THEN 1 WHEN 'MEDIUM' THEN 2 WHEN 'HIGH' THEN 3 WHEN 'CRITICAL' THEN 4 ELSE 0 END"
NAME = "CASE {c} WHEN 1 THEN 'LOW' WHEN 2 THEN 'MEDIUM' WHEN 3 THEN 'HIGH' WHEN 4 THEN 'CRITICAL' ELSE 'NONE' END"
ORANK = "CASE {c} WHEN 'needs_review' THEN 1 WHEN 'malicious' THEN 2 WHEN 'error' THEN 3 ELSE 0 END"
ONAME = "CASE {c} WHEN 1 THEN 'needs_review' WHEN 2 THEN 'malicious' WHEN 3 THEN 'error' ELSE 'safe' END"


def rank(c: str) -> str:
    return RANK.format(c=c)


def name(c: str) -> str:
    return NAME.format(c=c)


def orank(c: str) -> str:
    return ORANK.format(c=c)


def oname(c: str) -> str:
    return ONAME.format(c=c)
