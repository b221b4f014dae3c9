"""Compares a registered query with its SQL over the same tables."""

import math
import os

import duckdb

DATA = os.environ.get("TEST_DATA", "/root/testdata")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def duck(sf_dir):
    db = duckdb.connect()
    db.sql("SET TimeZone = 'UTC'")
    for t in TABLES:
        if os.path.exists(f"{sf_dir}/{t}.parquet"):
            db.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return db


def plain(x):
    if isinstance(x, float):
        return "nan" if math.isnan(x) else float(f"{x:.9g}") + 0.0
    return x if x is None or isinstance(x, (int, str, bool)) else str(x)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return [columns[k] for k in order], sorted((tuple(plain(r[k]) for k in order) for r in rows), key=lambda r: tuple((x is None, str(type(x)), x) for x in r))


def compare(spark, query, sql, sf_dir):
    got = query(spark, sf_dir)
    a = rows_of(got.columns, [tuple(x) for x in got.collect()])
    want = duck(sf_dir).sql(sql)
    b = rows_of(want.columns, want.fetchall())
    assert a[0] == b[0]
    assert len(a[1]) == len(b[1])
    for x, y in zip(a[1], b[1], strict=True):
        if x != y:
            assert all((isinstance(p, float) and isinstance(q, float) and math.isclose(p, q, rel_tol=1e-6, abs_tol=1e-6)) or p == q for p, q in zip(x, y, strict=True)), (x, y)
    return len(a[1])
