"""Registered queries against their SQL in DuckDB, on the smallest test tables."""

from __future__ import annotations

import os

import pytest

from tempora.plans import catalogue

SF = "/root/testdata/sf0.001"
SOME = ("series_build", "derivative", "z_normalise", "ed_ragged", "dtw_dependent", "dtw_independent", "knn_lb_pruned", "segments_coverage", "missing_segments", "hangover_runs", "alignment_pairs", "cost_table_last_rows", "best_paths", "warped_vectors", "barycenter_step", "similarity_cells", "hangover_runs", "series_calendar")


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", SOME)
def test_query_equals_its_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for table in ("events", "lineitem", "embeddings", "nation"):
        con.sql(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    df = catalogue.QUERIES[name](spark, SF)
    want = con.sql(catalogue.ORACLE_SQL[name])
    assert set(want.columns) == set(df.columns)
    at = [want.columns.index(c) for c in df.columns]
    assert sorted(map(repr, map(tuple, df.collect()))) == sorted(repr(tuple(r[k] for k in at)) for r in want.fetchall())


def test_every_sql_has_a_query():
    assert catalogue.ORACLE_SQL.keys() <= catalogue.QUERIES.keys()
