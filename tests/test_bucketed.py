"""Bucketed tables give the same results and join without shuffles."""

import pytest
from conftest import DATA
from millrace.plans import BINDINGS, QUERIES
from millrace.plans.suite import PLANS
from millrace.sources import write_bucketed

SF = f"{DATA}/sf0.001"


@pytest.fixture(scope="module")
def stored(spark):
    tables = write_bucketed(spark, SF, "millrace_test", 4)
    yield tables
    spark.sql("DROP DATABASE millrace_test CASCADE")


@pytest.mark.parametrize("name", ["q3", "q9", "q11", "q18", "q20", "q21"])
def test_same_results(spark, stored, name):
    found = PLANS[name](stored, BINDINGS[name]).collect()
    assert sorted(map(tuple, found), key=repr) == sorted(map(tuple, QUERIES[name](spark, SF).collect()), key=repr)


def test_orders_and_lines_join_without_a_shuffle(spark, stored):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        df = stored.lineitem.join(stored.orders, stored.lineitem.l_orderkey == stored.orders.o_orderkey).groupBy("l_orderkey").count()
        text = df._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in text and "Exchange" not in text
        plain = QUERIES["q18"](spark, SF)._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")
        assert PLANS["q18"](stored, BINDINGS["q18"])._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") < plain
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
