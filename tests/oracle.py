"""Compare a registered query with its SQL, as the driver does: columns by name, rows in any order."""

from __future__ import annotations

import math

import duckdb

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents",
          "embeddings", "pages", "benchmark", "labels", "conversations"]


def connect(sf_dir):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def _norm(value):
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 6)
    return value


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(_norm(r[i]) for i in order) for r in rows), key=repr)


def compare(df, con, sql):
    """None if equal, else a short description of the difference."""
    expected = con.execute(sql)
    names = [d[0] for d in expected.description]
    want, got = _rows(names, expected.fetchall()), _rows(df.columns, [tuple(r) for r in df.collect()])
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} != {sorted(names)}"
    if len(want) != len(got):
        extra = [g for g in got if g not in set(want)][:2]
        return f"{len(got)} rows != {len(want)}; only here: {extra}"
    for w, g in zip(want, got):
        if w != g:
            return f"spark {g!r}\n  sql   {w!r}"[:1500]
    return None
