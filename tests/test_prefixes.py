"""The prefix join against its SQL, on both of its paths, and what it broadcasts."""

import random

import duckdb
import pytest

from plumbline.plans import joins, registry
from plumbline.plans.base import Tables


@pytest.mark.parametrize("few", [0, 50_000])
def test_odd_names(spark, tmp_path, few):
    rng = random.Random(5)
    names = ["".join(rng.choice(["Ann", "b", "é", "_", "7", " "]) for _ in range(rng.randint(0, 9))) for _ in range(150)] + ["", "p", "p_3", "3", None, "1999", "Ann_3_1999"]
    rows = [(i, x, rng.choice([0, 3, 12, -4, None])) for i, x in enumerate(names * 2)]
    spark.createDataFrame(rows, "c_custkey long, c_name string, c_nationkey int").write.parquet(f"{tmp_path}/customer.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW customer AS SELECT * FROM read_parquet('{tmp_path}/customer.parquet/*.parquet')")
    got = joins.prefix5(Tables(spark, str(tmp_path)), few)
    assert sorted(map(tuple, got.collect())) == sorted(con.execute(joins.PREFIX5).fetchall())


@pytest.mark.parametrize("few", [0, 50_000])
def test_parts_are_not_broadcast(spark, few):
    plan = joins.prefix5(Tables(spark, "/root/testdata/sf0.001"), few)._jdf.queryExecution().executedPlan().toString()
    assert "BuildLeft" not in plan and ("BuildRight" in plan) == (few > 0)


def test_parts_are_not_broadcast_by_the_other_query(spark):
    """With Spark's own threshold, which the size of the keys before they are cut into parts stays below."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "10m")
    try:
        out = registry.queries()["jn_prefix5_all"](spark, "/root/testdata/sf0.1")
        assert "BuildLeft" not in out._jdf.queryExecution().executedPlan().toString()
        assert out.count() == 15_000
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
