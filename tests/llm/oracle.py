"""Compares a registered query with its SQL on one folder of tables."""

import glob
import os

import duckdb


def same(spark, query, sql, sf_dir):
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path).removesuffix(".parquet")
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    relation = con.sql(sql)
    got = query(spark, sf_dir)
    columns = sorted(got.columns)
    assert columns == sorted(relation.columns)
    key = lambda r: tuple((x is not None, str(x)) for x in r)
    rows = lambda rs: sorted((tuple(r) for r in rs), key=key)
    want = rows(con.sql(f"SELECT {', '.join(columns)} FROM ({sql})").fetchall())
    found = rows(got.select(*columns).collect())
    assert len(found) == len(want)
    for a, b in zip(found, want, strict=True):
        assert a == b
    return len(found)
