"""bare_number_validate against its SQL where quantities are fractions, line numbers large, and rows share a height."""

import duckdb
from pyspark.sql import functions as F

from tessera.operators import layout
from tessera.plans import problems as catalogue


def held(spark, tmp_path, rows):
    path = str(tmp_path / "lineitem.parquet")
    spark.createDataFrame(rows, "l_orderkey long, l_quantity double, l_extendedprice double, l_linenumber int").coalesce(1).write.parquet(path)
    got = sorted(map(tuple, catalogue.QUERIES["bare_number_validate"](spark, str(tmp_path)).collect()))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW lineitem AS SELECT * FROM read_parquet('{path}/*.parquet')")
    return got, sorted(con.execute(catalogue.SQL["bare_number_validate"]).fetchall())


def test_fractions_and_large_line_numbers(spark, tmp_path):
    rows = [(1, 2.5, 10.0, 1), (1, 3.25, 20.0, 2), (2, 2.0, 10.0, 1), (2, 10.0, 20.0, 3), (3, 1.0, 5.0, 400), (3, 9.0, 9.0, 402), (3, 17.0, 8.0, 401), (4, 1.0, 1.0, 1), (4, 9.5, 2.0, 2)]
    got, want = held(spark, tmp_path, rows)
    assert got == want and len(got) == 7


def test_null_comes_last_and_infinities_are_apart(spark, tmp_path):
    inf = float("inf")
    rows = [(1, None, 3.0, 2), (1, 1.0, 1.0, 5), (1, 30.0, 2.0, 1), (2, 1.0, None, 3), (2, 2.0, 5.0, 2), (2, 3.0, 4.0, 1), (3, inf, 1.0, 1), (3, inf, 2.0, 2), (3, 5.0, 1.0, 1), (3, 6.0, 2.0, 2), (4, 1.0, 1.0, 1), (4, 2.0, 2.0, None), (4, 3.0, 3.0, 2)]
    path = str(tmp_path / "lineitem.parquet")
    spark.createDataFrame(rows, "l_orderkey long, l_quantity double, l_extendedprice double, l_linenumber int").coalesce(1).write.parquet(path)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW lineitem AS SELECT * FROM read_parquet('{path}/*.parquet')")
    want = sorted(map(repr, con.execute(catalogue.SQL["bare_number_validate"]).fetchall()))
    assert sorted(repr(tuple(r)) for r in catalogue.QUERIES["bare_number_validate"](spark, str(tmp_path)).collect()) == want
    assert {eval(r)[0] for r in want} == {1, 2, 3, 4}


def test_equal_x_and_number_are_one_island(spark, tmp_path):
    """What every order of such rows gives, if it is the same in both windows; DuckDB's own two windows on several threads may differ."""
    rows = [(p, x, y, n) for p in range(40) for x, y, n in [(5.0, 90.0, 5), (26.0, 60.0, 4), (36.0, 47.0 + p, 2), (36.0, 10.0, 2), (46.0, 80.0, 6)]]
    path = str(tmp_path / "lineitem.parquet")
    spark.createDataFrame(rows, "l_orderkey long, l_quantity double, l_extendedprice double, l_linenumber int").repartition(5).write.parquet(path)
    assert catalogue.QUERIES["bare_number_validate"](spark, str(tmp_path)).count() == 0


def test_rows_of_one_height_have_an_order_of_their_own(spark):
    rows = [(p, 1.0 + i % 2 * (p % 3), 7.0 + (i > 1), i + 1) for p in range(60) for i in range(4)]
    df = spark.createDataFrame(rows, "page int, x double, y double, num int")
    seen = {tuple(sorted(map(tuple, layout.valid_islands(df.orderBy(F.rand(s)), ["page"], "x", "y", "num", F.lit(8.0)).select("page", "x", "y", "num").collect()))) for s in range(4)}
    assert len(seen) == 1 and len(seen.pop()) == 240
