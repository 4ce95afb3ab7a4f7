"""Comparing a query's rows with the rows of its SQL."""

import os
from collections import Counter
from decimal import Decimal

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SMALL = "/root/testdata/sf0.001"


def connected(sf_dir):
    c = duckdb.connect()
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        if os.path.exists(path):
            c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return c


def plain(x):
    if isinstance(x, float):
        return round(x, 8)
    if isinstance(x, Decimal):
        return float(x)
    return tuple(map(plain, x)) if isinstance(x, list) else x


def same(df, sql, sf_dir):
    columns = sorted(df.columns)
    got = Counter(tuple(map(plain, r)) for r in df.select(columns).collect())
    relation = connected(sf_dir).sql(sql)
    assert sorted(relation.columns) == columns
    wanted = Counter(tuple(map(plain, r)) for r in relation.select(*[duckdb.ColumnExpression(c) for c in columns]).fetchall())
    assert got == wanted, (list((got - wanted).items())[:3], list((wanted - got).items())[:3])
