"""The join queries over every row."""

import pytest
from pyspark.sql import functions as F

from plumbline.plans import registry
from plumbline.session import table

SF = "/root/testdata/sf0.001"


def test_every_key_has_its_match(spark):
    out = registry.queries()["jn_prefix5_all"](spark, SF)
    assert out.count() == table(spark, SF, "customer").count()


@pytest.mark.parametrize("name", ["jn_asof_pit_all", "jn_asof_diagonal_all"])
def test_facts_of_odd_orders(spark, name):
    odd = table(spark, SF, "orders").where("o_orderkey % 2 = 1").select("o_totalprice")
    out = registry.queries()[name](spark, SF)
    assert out.join(odd, F.col("v") == F.col("o_totalprice"), "left_semi").count() > 0
