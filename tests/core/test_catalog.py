import glob
import os
import re

import duckdb
import pytest

from sketchwell.plans import catalog

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def same_type(spark, duck):
    return {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "double": "DOUBLE", "boolean": "BOOLEAN"}.get(spark) == duck or spark.startswith("array") or {spark, duck} <= {"bigint", "int", "BIGINT", "INTEGER", "double", "DECIMAL(2,1)"} or re.match("DECIMAL", duck)


@pytest.mark.parametrize("name", list(catalog.queries()))
def test_query_equals_its_sql(spark, con, name):
    found = catalog.queries()[name](spark, SF)
    rows, columns = found.collect(), sorted(found.columns)
    assert rows
    if name not in catalog.oracle_sql():
        return
    relation = con.sql(catalog.oracle_sql()[name])
    assert sorted(relation.columns) == columns
    duck = dict(zip(relation.columns, map(str, relation.types), strict=True))
    assert all(same_type(t, duck[c]) for c, t in found.dtypes), (found.dtypes, duck)
    plain = lambda v: float(v) if isinstance(v, (int, float)) and not isinstance(v, bool) or type(v).__name__ == "Decimal" else v
    listed = lambda rs: sorted(str(tuple(plain(v) for v in r)) for r in rs)
    assert listed([[r[c] for c in columns] for r in rows]) == listed(con.sql(f"SELECT {', '.join(columns)} FROM ({catalog.oracle_sql()[name]})").fetchall())
