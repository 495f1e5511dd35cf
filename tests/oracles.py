"""Compare registered queries with their SQL run by DuckDB on the same files.

Run as a script: python tests/oracles.py [folder] [name ...]
"""
from __future__ import annotations

import math
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

import duckdb  # noqa: E402

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def connect(folder: str):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{folder}/{name}.parquet')")
    return con


def _plain(v):
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return v + 0.0
    if isinstance(v, (list, tuple)):
        return tuple(_plain(x) for x in v)
    if type(v).__name__ == "Decimal":
        return float(v)
    return v


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(_plain(r[i]) for i in order) for r in rows), key=repr)


def compare(spark, con, folder, function, sql):
    """None when equal, else a short description of the difference."""
    df = function(spark, folder)
    got_columns = df.columns
    got = _rows(got_columns, [tuple(r) for r in df.collect()])
    cursor = con.execute(sql)
    want_columns = [c[0] for c in cursor.description]
    want = _rows(want_columns, cursor.fetchall())
    if sorted(got_columns) != sorted(want_columns):
        return f"columns {sorted(got_columns)} != {sorted(want_columns)}"
    if len(got) != len(want):
        extra = [g for g in got if g not in set(want)][:2]
        lost = [w for w in want if w not in set(got)][:2]
        return f"rows {len(got)} != {len(want)}; extra {extra}; lost {lost}"
    wrong = [(g, w) for g, w in zip(got, want) if g != w]
    if wrong:
        return f"{len(wrong)}/{len(got)} rows differ, {sorted(got_columns)}: {wrong[0][0]} != {wrong[0][1]}"
    if not got:
        return "both empty"
    return None


if __name__ == "__main__":
    from conftest import make_session

    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:]
    from cellwire.queries import ORACLES, QUERIES

    session, con = make_session(), connect(folder)
    for name, function in QUERIES.items():
        if names and not any(name.startswith(n) for n in names):
            continue
        start = time.time()
        try:
            if name in ORACLES:
                problem = compare(session, con, folder, function, ORACLES[name])
                state = "ok" if problem is None else "DIFF " + problem
            else:
                state = f"rows {function(session, folder).count()}"
        except Exception as error:  # noqa: BLE001
            state = f"ERROR {type(error).__name__}: {str(error)[:600]}"
        print(f"{name:34s} {time.time() - start:6.1f}s {state}", flush=True)
