"""Queries of document objects on tables whose keys are beyond what 256 object numbers for each of them leave in 32 bits."""

import duckdb
import pytest
from test_kernels import SF, rows_of

from quiresmith.plans import kernels, objects  # noqa: F401  objects adds its queries to those of kernels

SHIFT = 3 << 33
OBJECTS = [
    "pdf_annotations", "pdf_audit", "pdf_form_fields", "pdf_name_tree", "pdf_outline", "pdf_page_geometry", "pdf_page_tree", "pdf_edit_log", "pdf_crop",
    "pdf_edit_snapshot", "pdf_export", "pdf_guards", "pdf_links", "pdf_sanitize", "pdf_poster_split", "pdf_strict_geometry", "pdf_sanitize_prune",
    "pdf_work_budget", "pdf_metadata",
]


@pytest.fixture(scope="module")
def large(tmp_path_factory):
    """(folder, connection): 24 customers and what they ordered, all orders with large keys."""
    folder, con = tmp_path_factory.mktemp("large"), duckdb.connect()
    keys = {"customer": "", "orders": f" REPLACE (o_orderkey + {SHIFT} AS o_orderkey)", "lineitem": f" REPLACE (l_orderkey + {SHIFT} AS l_orderkey)"}
    picked = {"customer": "c_custkey < 24", "orders": "o_custkey < 24", "lineitem": f"l_orderkey IN (SELECT o_orderkey FROM '{SF}/orders.parquet' WHERE o_custkey < 24)"}
    for t, replaced in keys.items():
        con.execute(f"COPY (SELECT *{replaced} FROM '{SF}/{t}.parquet' WHERE {picked[t]}) TO '{folder}/{t}.parquet'")
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return str(folder), con


@pytest.mark.parametrize("name", OBJECTS)
def test_large_keys(spark, large, name):
    folder, con = large
    df = kernels.QUERIES[name](spark, folder)
    cols = sorted(df.columns)
    found = con.execute(kernels.ORACLE[name])
    names = [d[0] for d in found.description]
    expected = found.fetchall()
    assert expected and rows_of(df.collect(), [df.columns.index(c) for c in cols]) == rows_of(expected, [names.index(c) for c in cols])
