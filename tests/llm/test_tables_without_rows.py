"""The training-data queries on tables without rows, and with columns that clash with inner names."""

from pathlib import Path

import pytest
from pyspark.sql import functions as F

from repolith.llm.queries import QUERIES

TABLES = Path("/root/testdata/sf0.001")
CLASHING = ["key", "n", "g", "uid", "tok", "entity", "t", "same", "v", "doc", "rep", "value", "level", "idx", "pos", "kind", "line", "start", "part"]


@pytest.fixture(scope="module")
def folders(spark, tmp_path_factory):
    none, wide = tmp_path_factory.mktemp("none"), tmp_path_factory.mktemp("wide")
    for f in TABLES.glob("*.parquet"):
        d = spark.read.parquet(str(f))
        d.limit(0).write.parquet(str(none / f.name))
        d.withColumns({c: F.lit("z") for c in CLASHING if c not in d.columns}).write.parquet(str(wide / f.name))
    return str(none), str(wide)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_empty_and_widened_tables(spark, folders, name):
    none, wide = folders
    assert QUERIES[name](spark, none).count() == 0
    assert QUERIES[name](spark, wide).count() == QUERIES[name](spark, str(TABLES)).count() > 0
