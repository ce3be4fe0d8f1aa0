"""Runs a query and its SQL on the same tables."""

import math

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else float(f"{v:.9g}")
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    return v


def assert_same(spark, query, sql, folder):
    got = query(spark, folder)
    columns = sorted(got.columns)
    db = duckdb.connect()
    for t in TABLES:
        db.execute(f"create view {t} as select * from '{folder}/{t}.parquet'")
    r = db.execute(sql)
    names = [d[0] for d in r.description]
    assert sorted(names) == columns
    want = sorted(str([plain(row[names.index(c)]) for c in columns]) for row in r.fetchall())
    assert sorted(str([plain(row[c]) for c in columns]) for row in got.collect()) == want
    assert want
