"""Compare a query with its SQL on the same tables."""

from __future__ import annotations

import os

import duckdb


def plain(v):
    if isinstance(v, float):
        return "nan" if v != v else round(v, 5) + 0.0
    if hasattr(v, "asDict"):
        v = v.asDict()
    if isinstance(v, dict):
        return tuple(sorted((k, plain(x)) for k, x in v.items()))
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    return v


def differences(df, sql: str, folder: str) -> tuple[set, set]:
    cols = sorted(df.columns)
    got = sorted(repr(tuple(plain(r[c]) for c in cols)) for r in df.collect())
    con = duckdb.connect()
    con.sql("SET TimeZone='UTC'")
    for f in os.listdir(folder):
        con.sql(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{folder}/{f}'")
    r = con.sql(sql)
    names = list(r.columns)
    assert sorted(names) == cols
    at = [names.index(c) for c in cols]
    want = sorted(repr(tuple(plain(x[i]) for i in at)) for x in r.fetchall())
    return set(got) - set(want) or ({"count"} if len(got) != len(want) else set()), set(want) - set(got)
