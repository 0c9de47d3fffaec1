"""Run one query on Spark and its SQL on DuckDB and compare the rows."""

from __future__ import annotations

import datetime
import decimal
import math
import pathlib
import threading

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


def _norm(v):
    if v is None:
        return None
    if hasattr(v, "tolist"):
        v = v.tolist()
    if isinstance(v, bool):
        return v
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, float):
        if math.isnan(v):
            return None
        return float(f"{v:.9g}")
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, datetime.date):
        return v.isoformat() + "T00:00:00"
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    if isinstance(v, dict):
        return tuple(sorted((k, _norm(x)) for k, x in v.items()))
    return v


def _kind(v):
    return "num" if isinstance(v, float) else type(v).__name__


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(_norm(r[i]) for i in order) for r in rows), key=repr)


def duck(sf: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        if pathlib.Path(f"{sf}/{t}.parquet").exists():
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def compare(df, sql: str, sf: str) -> list[str]:
    """Differences as texts; empty when both sides agree."""
    con = duck(sf)
    stop = threading.Timer(60, con.interrupt)
    stop.start()
    try:
        cur = con.execute(sql)
        rows = cur.fetchall()
    finally:
        stop.cancel()
    names = [d[0] for d in cur.description]
    theirs = rows
    ours = [tuple(r) for r in df.collect()]
    if sorted(names) != sorted(df.columns):
        return [f"columns {sorted(df.columns)} vs {sorted(names)}"]
    a, b = rows_of(df.columns, ours), rows_of(names, theirs)
    out = []
    if len(a) != len(b):
        out.append(f"rows {len(a)} vs {len(b)}")
    if a != b:
        sa, sb = set(a), set(b)
        ea, eb = [x for x in a if x not in sb][:3], [x for x in b if x not in sa][:3]
        out.append(f"only spark {ea}\nonly sql   {eb}\ncols {sorted(names)}")
    else:
        for i, (x, y) in enumerate(zip(*(next(iter(r), ()) for r in (a, b)))):
            if x is not None and y is not None and _kind(x) != _kind(y):
                out.append(f"kind of {sorted(names)[i]}: {_kind(x)} vs {_kind(y)}")
    return out
