"""Side-by-side check of a registered query against its SQL on the same files."""

from __future__ import annotations

import math

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
          "conversations").split()


def connect(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def _cell(v):
    if v is None:
        return None
    if isinstance(v, float):
        return None if math.isnan(v) else repr(v + 0.0)
    return repr(v)


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), sorted((tuple(_cell(r[i]) for i in order) for r in rows), key=repr)


def compare(spark, con, fn, sql, sf_dir):
    """(same, message)"""
    df = fn(spark, sf_dir)
    left = _rows(df.columns, [tuple(r) for r in df.collect()])
    res = con.execute(sql)
    right = _rows([c[0] for c in res.description], res.fetchall())
    if left[0] != right[0]:
        return False, f"columns {left[0]} vs {right[0]}"
    if left[1] == right[1]:
        return True, f"{len(left[1])} rows"
    a, b = set(left[1]), set(right[1])
    return False, (f"rows {len(left[1])} vs {len(right[1])}; columns {left[0]}\n  only spark {len(a - b)}: {sorted(a - b, key=repr)[:2]}"
                   f"\n  only sql   {len(b - a)}: {sorted(b - a, key=repr)[:2]}")
