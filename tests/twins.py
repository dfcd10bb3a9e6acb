"""Runs a query in Spark and its SQL in DuckDB, and compares the rows."""

import math
import os

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
DATA = os.environ.get("TWIN_SF_DIR", "/root/testdata/sf0.001")


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 9)
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    return v


def connect():
    import duckdb

    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


def compare(spark, con, query, sql):
    df = query(spark, DATA)
    names = sorted(df.columns)
    mine = sorted((tuple(plain(r[c]) for c in names) for r in df.collect()), key=repr)
    said = con.execute(sql)
    order = [d[0] for d in said.description]
    assert sorted(order) == names
    theirs = sorted((tuple(plain(r[order.index(c)]) for c in names) for r in said.fetchall()), key=repr)
    assert mine == theirs
