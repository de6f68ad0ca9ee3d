"""Queries that need operators, on tables without rows."""

from pathlib import Path

import pytest

from repolith.plans import data, graphs, search

QUERIES = {k: q for m in (data, graphs, search) for k, q in m.QUERIES.items()}


@pytest.fixture(scope="module")
def empty(spark, tmp_path_factory):
    d = tmp_path_factory.mktemp("empty")
    for f in Path("/root/testdata/sf0.001").glob("*.parquet"):
        spark.read.parquet(str(f)).limit(0).write.parquet(str(d / f.name))
    return str(d)


@pytest.mark.parametrize("name", ["p5_found", "p5_summary", "p6_found", "p6_ledger", "win_06_running_sum", "drf_03_trajectory", "gr_07_depth", "gr_08_cycles", "sem_02_vectors", "sem_04_hybrid", "tst_03_budget", "tmp_04_clusters"])
def test_no_rows_of_no_rows(spark, empty, name):
    assert QUERIES[name](spark, empty).count() == 0
