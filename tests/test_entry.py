import os

import duckdb
import pytest

import __spark_entry__ as E

SF = "/root/testdata/sf0.001"
QUICK = ("redact_pii", "pii_counts", "formula_guard", "fingerprint", "row_filter_preserving", "row_filter_and_or", "sheet_rollup", "repaired_assignments", "mapping_warnings", "message_sets", "usage_cost", "price_fallback_join", "expired_jobs", "expired_uploads_not_exists", "orphan_objects", "sweep_counts", "eta", "order_violations", "dedupe_frequency", "contextual_groups", "stream_context", "stream_dedupe")


def test_every_sql_has_a_query():
    assert set(E.oracle_sql()) <= set(E.queries())


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", QUICK)
def test_query_agrees_with_sql(spark, name):
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.sql(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{f}'")
    got = E.queries()[name](spark, SF)
    want = con.sql(E.oracle_sql()[name])
    assert sorted(got.columns) == sorted(want.columns)
    order = sorted(got.columns)
    rows = lambda x: sorted(map(repr, x))
    assert rows(tuple(r) for r in got.select(*order).collect()) == rows(con.sql(E.oracle_sql()[name]).select(", ".join(order)).fetchall())
