"""Runs queries next to their SQL and compares the rows. Usage: python tests/compare.py <folder> [name or part of a name ...]"""

from __future__ import annotations

import math
import sys
import time
from decimal import Decimal
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(folder: str):
    import duckdb

    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return con


def _plain(x):
    if isinstance(x, Decimal):
        return float(x)
    if isinstance(x, float):
        return None if math.isnan(x) else x
    return x


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    out = [tuple(_plain(r[i]) for i in order) for r in rows]
    return sorted(columns), sorted(out, key=lambda r: tuple((x is not None, str(x)) for x in r))


def compare(spark, con, fn, sql: str, folder: str) -> str:
    """Empty when equal, else what differs. The Spark time is left in ``compare.seconds``, the rows in ``compare.rows``."""
    start = time.time()
    df = fn(spark, folder)
    names, got = _rows(df.columns, [tuple(r) for r in df.collect()])
    compare.seconds, compare.rows = time.time() - start, len(got)
    res = con.execute(sql)
    want_names, want = _rows([c[0] for c in res.description], res.fetchall())
    if names != want_names:
        return f"columns {names} != {want_names}"
    if len(got) != len(want):
        return f"rows {len(got)} != {len(want)}; e.g. {[r for r in got if r not in set(want)][:2]} / {[r for r in want if r not in set(got)][:2]}"
    for a, b in zip(got, want, strict=True):
        if a != b or [type(x) for x in a] != [type(x) for x in b]:
            return f"{names}: {a} != {b}"
    return ""


def main() -> None:
    import __spark_entry__ as entry
    from confsieve.session import local_session

    folder, parts = sys.argv[1], sys.argv[2:]
    spark = local_session("compare", "8")
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(folder)
    bad = 0
    oracles = entry.oracle_sql()
    for name, fn in entry.queries().items():
        if parts and not any(p in name for p in parts):
            continue
        start = time.time()
        try:
            if name in oracles:
                said = compare(spark, con, fn, oracles[name], folder)
                said = said or f"ok {compare.rows} (Spark {compare.seconds:.1f}s)"
            else:
                said = f"ok rows only {fn(spark, folder).count()}"
        except Exception as e:  # noqa: BLE001
            said = f"{type(e).__name__}: {str(e)[:350]}"
        bad += not said.startswith("ok")
        print(f"{name:40s} {time.time() - start:6.1f}s {said[:700]}", flush=True)
    print("failed:", bad)


if __name__ == "__main__":
    main()
