"""Runs a query and its SQL side by side and compares the rows as multisets."""

import math

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connection(sf_dir):
    con = duckdb.connect()
    con.sql("set timezone='UTC'")
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return con


def plain(v):
    if v is None or isinstance(v, bool):
        return v
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    if isinstance(v, str):
        return v
    v = float(v)
    return "nan" if math.isnan(v) else v if math.isinf(v) else float(f"{v:.8g}")


def order(row):
    return tuple((x is None, str(type(x)), 0 if x is None else x) for x in row)


def assert_same(spark, con, sf_dir, query, sql):
    df = query(spark, sf_dir)
    names = sorted(df.columns)
    left = sorted((tuple(plain(r[c]) for c in names) for r in df.collect()), key=order)
    rel = con.sql(sql)
    assert sorted(rel.columns) == names
    at = [rel.columns.index(c) for c in names]
    right = sorted((tuple(plain(r[i]) for i in at) for r in rel.fetchall()), key=order)
    assert len(left) == len(right)
    for a, b in zip(left, right):
        for x, y in zip(a, b):
            assert x == y or (isinstance(x, float) and isinstance(y, float) and math.isclose(x, y, rel_tol=1e-6, abs_tol=1e-5)), (a, b)
