"""Run registered queries against their oracle statements."""

from __future__ import annotations

import math

import duckdb

from workload.views import TABLES


def connect(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def _cell(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.6f}"
    return str(v)


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    cells = [tuple(_cell(r[i]) for i in order) for r in rows]
    return [names[i] for i in order], sorted(cells)


def difference(spark, con, fn, sql: str, sf_dir: str) -> str | None:
    """None when the query and its oracle agree, else what differs."""
    df = fn(spark, sf_dir)
    ours = rows_of(df.columns, [tuple(r) for r in df.collect()])
    got = con.execute(sql)
    theirs = rows_of([c[0] for c in got.description], got.fetchall())
    if ours[0] != theirs[0]:
        return f"columns {ours[0]} != {theirs[0]}"
    if ours[1] != theirs[1]:
        only = [r for r in ours[1] if r not in set(theirs[1])][:3]
        missing = [r for r in theirs[1] if r not in set(ours[1])][:3]
        return f"{len(ours[1])} vs {len(theirs[1])} rows; only ours {only}; only oracle {missing}"
    return None
