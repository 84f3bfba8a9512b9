"""Compare Spark results with DuckDB results the way the correctness gate does."""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))

import duckdb  # noqa: E402

from sparkwarden.plans.views import TABLES  # noqa: E402


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def cell(value) -> str:
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return "∅"
    if isinstance(value, bool):
        return str(value)
    if isinstance(value, float):
        return f"{value:.6f}"
    if isinstance(value, (list, tuple)):
        return "[" + ",".join(cell(v) for v in value) + "]"
    return str(value)


def kind(name: str) -> str:
    n = name.lower()
    if n in ("int", "integer", "bigint", "smallint", "tinyint", "hugeint"):
        return "int"
    if n.startswith(("double", "float", "decimal")):
        return "float"
    if n.startswith("bool"):
        return "bool"
    if n in ("string", "varchar"):
        return "text"
    return n


def compare(spark, con, sf_dir: str, name: str, query, sql: str, show: int = 2) -> tuple[bool, str]:
    start = time.time()
    frame = query(spark, sf_dir)
    cols = sorted(frame.columns)
    got = sorted(tuple(cell(r[c]) for c in cols) for r in frame.select(*[f"`{c}`" for c in cols]).collect())
    middle = time.time()
    con.execute(sql)
    names = [d[0] for d in con.description]
    rows = con.fetchall()
    want_cols = sorted(names)
    if cols != want_cols:
        return False, f"columns {cols} != {want_cols}"
    idx = [names.index(c) for c in want_cols]
    want = sorted(tuple(cell(r[i]) for i in idx) for r in rows)
    types = {c: kind(t) for c, t in frame.dtypes}
    duck_types = {c: kind(str(t)) for c, t in zip(names, [d[1] for d in con.description])}
    took = f"spark {middle - start:.1f}s duck {time.time() - middle:.1f}s rows {len(got)}"
    odd = {c: (types[c], duck_types[c]) for c in cols if types[c] != duck_types[c]}
    if got != want:
        g, w = set(got) - set(want), set(want) - set(got)
        lines = [took + f" / {len(want)}; only spark {len(g)}, only duck {len(w)} {cols}"]
        lines += [f"   spark {str(x)[:400]}" for x in sorted(g)[:show]] + [f"   duck  {str(x)[:400]}" for x in sorted(w)[:show]]
        return False, "\n".join(lines)
    return True, took + (f" types {odd}" if odd else "")


def main(argv: list[str]) -> int:
    import __spark_entry__ as entry
    from sparkwarden.session import local_session

    sf_dir = "/root/testdata/sf0.01"
    spark = local_session(8)
    spark.sparkContext.setLogLevel("ERROR")
    con = duck(sf_dir)
    queries, oracles = entry.queries(), entry.oracle_sql()
    bad = []
    for name in [n for n in queries if not argv or any(a in n for a in argv)]:
        try:
            if name in oracles:
                ok, note = compare(spark, con, sf_dir, name, queries[name], oracles[name])
            else:
                start = time.time()
                rows = queries[name](spark, sf_dir).count()
                ok, note = rows > 0, f"rows only: {rows} {time.time() - start:.1f}s"
        except Exception as e:  # noqa: BLE001
            ok, note = False, f"{type(e).__name__}: {str(e)[:1500]}"
        print(("ok   " if ok else "FAIL ") + name, note, flush=True)
        if not ok:
            bad.append(name)
    print(f"{len(bad)} bad: {bad}")
    return len(bad)


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
