"""Rows of a DataFrame and of a SQL query, made comparable."""

import math


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else float(f"{v:.9g}")
    if isinstance(v, (bytes, bytearray)):
        return bytes(v).hex()
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    return v


def rows_of(df):
    names = sorted(df.columns)
    return sorted((tuple(plain(r[c]) for c in names) for r in df.collect()), key=repr)


def rows_of_sql(duck, sql):
    r = duck.sql(sql)
    names = sorted(r.columns)
    at = [r.columns.index(c) for c in names]
    return names, sorted((tuple(plain(x[i]) for i in at) for x in r.fetchall()), key=repr)


def check(df, duck, sql):
    names, want = rows_of_sql(duck, sql)
    assert sorted(df.columns) == names
    assert rows_of(df) == want
