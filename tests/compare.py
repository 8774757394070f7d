"""Run a query and its check SQL and compare the rows as multisets."""

from __future__ import annotations

import math

import duckdb

from ablaspark.workload.registry import TABLES


def connect(folder: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{folder}/{t}.parquet')")
    return con


def _cell(v):
    if isinstance(v, float):
        return None if math.isnan(v) else f"{v:.6g}" if abs(v) < 1e15 else repr(v)
    if isinstance(v, (list, tuple)):
        return tuple(_cell(x) for x in v)
    return v


def normal(rows, names):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(_cell(r[i]) for i in order) for r in rows), key=repr)


def differences(spark, con, run, sql, folder: str, limit: int = 3):
    """None if equal, else a short text of what differs."""
    df = run(spark, folder)
    got = df.collect()
    cur = con.execute(sql)
    want = cur.fetchall()
    names = [d[0] for d in cur.description]
    if sorted(names) != sorted(df.columns):
        return f"columns {df.columns} != {names}"
    a, b = normal(got, df.columns), normal(want, names)
    if a == b:
        return None
    only_a = [r for r in a if r not in set(b)][:limit]
    only_b = [r for r in b if r not in set(a)][:limit]
    return f"rows {len(a)} vs {len(b)}\n  spark {only_a}\n  sql   {only_b}"
