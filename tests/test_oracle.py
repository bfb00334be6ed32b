"""Every registered query against its SQL oracle (DuckDB) on the smallest test tables."""

import math
import os

import pytest

SF = "/root/testdata/sf0.001"
TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables not present")


def _norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    if hasattr(v, "tolist"):
        v = v.tolist()
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    return v


def _rows(pdf):
    cols = sorted(pdf.columns)
    return cols, sorted((tuple(_norm(x) for x in r) for r in pdf[cols].itertuples(index=False)), key=repr)


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


def _names():
    from shiftkit.plans.oracle import ORACLE

    return sorted(ORACLE)


SPARK_TO_DUCK = {"int": "INTEGER", "bigint": "BIGINT", "double": "DOUBLE", "string": "VARCHAR", "float": "FLOAT",
                 "boolean": "BOOLEAN"}


@pytest.mark.parametrize("name", _names())
def test_query_matches_oracle(spark, duck, name):
    from __spark_entry__ import oracle_sql, queries

    df = queries()[name](spark, SF)
    rel = duck.sql(oracle_sql()[name])
    spark_types = {f.name: SPARK_TO_DUCK.get(f.dataType.simpleString(), f.dataType.simpleString()) for f in df.schema}
    assert spark_types == {c: str(t) for c, t in zip(rel.columns, rel.types)}
    sp = df.toPandas()
    dk = duck.execute(oracle_sql()[name]).fetchdf()
    sc, sr = _rows(sp)
    dc, dr = _rows(dk)
    assert sc == dc
    assert len(sr) == len(dr)
    assert sr == dr


def test_every_query_of_the_library_has_an_oracle():
    from shiftkit.plans.oracle import ORACLE
    from shiftkit.plans.registry import QUERIES

    assert set(QUERIES) == set(ORACLE)


def test_entry_runs(spark):
    from __spark_entry__ import entry

    rows = entry(spark).collect()
    assert len(rows) == 10 and all(0 < r["separation"] < 2 for r in rows)
