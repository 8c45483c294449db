"""Run a query and its SQL on the same tables and compare columns, row counts and values regardless of order."""

from __future__ import annotations

import datetime
import decimal
import math
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(x):
    if isinstance(x, bool) or x is None:
        return x
    if isinstance(x, decimal.Decimal):
        x = float(x)
    if isinstance(x, float):
        return "nan" if math.isnan(x) else float(f"{x:.9g}")
    if isinstance(x, datetime.datetime):
        return x.replace(tzinfo=None).isoformat()
    if isinstance(x, datetime.date):
        return x.isoformat()
    if isinstance(x, (list, tuple)) and not hasattr(x, "asDict"):
        return [plain(y) for y in x]
    if hasattr(x, "asDict"):
        x = x.asDict()
    if isinstance(x, dict):
        return {k: plain(v) for k, v in x.items()}
    return x


def expected(sql: str, sf_dir: str):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path + '/*.parquet' if os.path.isdir(path) else path}')")
    con.execute(sql)
    names = [c[0] for c in con.description]
    return names, con.fetchall()


def compare(df, sql: str, sf_dir: str) -> str:
    """An empty string if both agree, else what differs."""
    names, rows = expected(sql, sf_dir)
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} against {sorted(names)}"
    order = sorted(names)
    want = sorted((repr([plain(r[names.index(c)]) for c in order]) for r in rows))
    got = sorted((repr([plain(r[c]) for c in order]) for r in df.collect()))
    if len(want) != len(got):
        return f"{len(got)} rows against {len(want)}"
    bad = [(g, w) for g, w in zip(got, want, strict=True) if g != w]
    return f"{len(bad)} of {len(got)} rows differ, such as {bad[0]}"[:1500] if bad else ""
