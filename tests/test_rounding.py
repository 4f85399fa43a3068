"""Whole numbers in JSON are rounded as their SQL rounds them: halves away from zero."""

import duckdb
import pytest

from loomline.plans import sector_queries

HALVES = [-2.5, -1.5, -0.5, 0.5, 1.5, 2.5, -973.5, 1234.49, -0.49, 0.49999999999999994, 7.0]


@pytest.mark.parametrize("name, table, prefix, key", [("canonical_json", "customer", "c", "custkey"), ("row_matrix", "supplier", "s", "suppkey")])
def test_halves_go_away_from_zero(spark, tmp_path, name, table, prefix, key):
    rows = [(i, f"n{i}", i % 3, v) for i, v in enumerate(HALVES)]
    spark.createDataFrame(rows, f"{prefix}_{key} long, {prefix}_name string, {prefix}_nationkey int, {prefix}_acctbal double").write.parquet(f"{tmp_path}/{table}.parquet")
    got = sector_queries.QUERIES[name](spark, str(tmp_path))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{tmp_path}/{table}.parquet/*.parquet'")
    want = con.execute(sector_queries.SQL[name])
    columns = [c[0] for c in want.description]
    assert sorted(map(tuple, got.select(*columns).collect())) == sorted(want.fetchall())
