"""Compares a query with its DuckDB form: columns, number of rows and values."""

from __future__ import annotations

import math
from collections import Counter
from pathlib import Path

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else float(f"{v:.9g}")
    return v


def differences(spark, query, sql: str, sf_dir: str) -> str | None:
    """None if both give the same rows, else what differs."""
    con = duckdb.connect()
    for t in TABLES:
        if (Path(sf_dir) / f"{t}.parquet").exists():
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    cur = con.execute(sql)
    names = [c[0] for c in cur.description]
    df = query(spark, sf_dir)
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} and {sorted(names)}"
    order = sorted(names)
    theirs = Counter(tuple(plain(r[names.index(n)]) for n in order) for r in cur.fetchall())
    ours = Counter(tuple(plain(r[n]) for n in order) for r in df.collect())
    if ours == theirs:
        return None
    return f"{sum(ours.values())} and {sum(theirs.values())} rows; only here {list((ours - theirs).items())[:3]}; only there {list((theirs - ours).items())[:3]}"
