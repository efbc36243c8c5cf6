"""Every kernel query against its DuckDB SQL, on the smallest tables."""

import datetime
import math

import duckdb
import pytest

from quiresmith.plans import kernels, objects  # noqa: F401  objects adds its queries to those of kernels

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return round(v, 6) if math.isfinite(v) else str(v)
    return v.replace(tzinfo=None) if isinstance(v, datetime.datetime) else v


def rows_of(rows, order):
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(kernels.ORACLE))
def test_equals_sql(spark, duck, name):
    df = kernels.QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    found = duck.execute(kernels.ORACLE[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == cols
    assert rows_of(df.collect(), [df.columns.index(c) for c in cols]) == rows_of(found.fetchall(), [names.index(c) for c in cols])
