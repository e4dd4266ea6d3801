"""Compare registered queries with their DuckDB counterparts: python tests/check.py sf0.01 [names]."""

from __future__ import annotations

import decimal
import math
import sys
import time
from pathlib import Path

import duckdb

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))
TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(sf_dir: str):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return con


def plain(value):
    if isinstance(value, decimal.Decimal):
        value = float(value)
    if isinstance(value, float):
        if math.isnan(value):
            return None
        return int(value) if value == int(value) else value
    if isinstance(value, bool):
        return value
    return value


def sorted_rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    out = [tuple(plain(r[i]) for i in order) for r in rows]
    return [columns[i] for i in order], sorted(out, key=repr)


def compare(spark, con, sf_dir: str, run, sql: str) -> str:
    df = run(spark, sf_dir)
    got_cols, got = sorted_rows(df.columns, [tuple(r) for r in df.collect()])
    cur = con.execute(sql)
    want_cols, want = sorted_rows([d[0] for d in cur.description], cur.fetchall())
    if got_cols != want_cols:
        return f"columns {got_cols} != {want_cols}"
    if got == want:
        return f"ok {len(got)} rows"
    loose = lambda rows: [tuple(round(v, 8) if isinstance(v, float) else v for v in r) for r in rows]
    if loose(got) == loose(want):
        return f"ok {len(got)} rows (equal after rounding)"
    got_set, want_set = set(got), set(want)
    left = [r for r in got if r not in want_set][:2]
    right = [r for r in want if r not in got_set][:2]
    cut = lambda rows: [tuple(str(v)[:120] for v in r) for r in rows]
    return f"DIFF rows {len(got)}/{len(want)}\n   spark {cut(left)}\n   duck  {cut(right)}"


if __name__ == "__main__":
    from conftest import session

    from workload.oracle import ORACLE
    from workload.queries import REGISTRY

    spark, sf_dir = session(), f"/root/testdata/{sys.argv[1]}"
    con = connect(sf_dir)
    for name in sys.argv[2:] or [n for n in REGISTRY if n in ORACLE]:
        start = time.time()
        try:
            result = compare(spark, con, sf_dir, REGISTRY[name], ORACLE[name])
        except Exception as error:  # report and go on
            result = f"FAIL {str(error)[:500]}"
        print(f"{name:28s} {time.time() - start:6.1f}s {result}", flush=True)
