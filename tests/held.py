"""Runs a query and its SQL on the same tables and compares their rows."""

import duckdb

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(x):
    if isinstance(x, float):
        return "nan" if x != x else repr(round(x, 7) + 0.0)
    if isinstance(x, (list, tuple)):
        return str([plain(i) for i in x])
    return str(x)


def rows(names, records):
    at = sorted(range(len(names)), key=names.__getitem__)
    return [names[i] for i in at], sorted(tuple(plain(r[i]) for i in at) for r in records)


def assert_same(spark, query, sql, data=DATA):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{data}/{t}.parquet'")
    want = con.sql(sql)
    got = query(spark, data)
    assert rows(got.columns, [tuple(r) for r in got.collect()]) == rows(want.columns, want.fetchall())
