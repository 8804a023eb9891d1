"""Every registered query that has SQL equals it on the smallest tables, and
its physical plan holds nothing that would not scale."""

import pytest

import __spark_entry__ as contract
from salesmart.operators.trends import recent_lines
from workload import ORACLES, QUERIES
from workload.check import compare, oracle
from workload.summaries import AS_OF, RECENT_LINES
from workload.tables import lines


@pytest.fixture(scope="module")
def duck(sf_dir):
    return oracle(sf_dir)


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, duck, sf_dir, name):
    df = QUERIES[name](spark, sf_dir)
    check_plan(plan_of(df))
    assert compare(spark, duck, name, sf_dir, df) == ""


def check_plan(plan):
    assert "Python" not in plan and "ArrowEval" not in plan
    assert "CartesianProduct" not in plan
    lines = plan.splitlines()
    for i, text in enumerate(lines):
        # a window over everything is allowed on per-partition counts only
        if "- Window [" in text and "Exchange SinglePartition" in "\n".join(lines[i:i + 4]):
            assert "_total#" in "\n".join(lines[i:i + 8])


def test_top_reports_limit_before_the_shuffle(spark, sf_dir):
    for name in ("top_customers", "top_products", "product_potential_top"):
        plan = plan_of(QUERIES[name](spark, sf_dir))
        assert "WindowGroupLimit" in plan and "Partial" in plan, name


def test_filters_and_columns_reach_the_scan(spark, sf_dir):
    def plan(name):
        return plan_of(QUERIES[name](spark, sf_dir))
    assert "In(o_orderpriority" in plan("table_filter_in")
    revenue = plan("revenue_month")
    assert "c_name" not in revenue and "region.parquet" not in revenue and "lineitem" not in revenue
    # the lines behind market_overview are collapsed and written when it is built
    assert "GreaterThanOrEqual(l_shipdate" in plan_of(recent_lines(lines(spark, sf_dir, RECENT_LINES), AS_OF))
    assert "part.parquet" not in plan("customer_summary")
    top = plan("top_customers")
    assert "part.parquet" not in top and "supplier.parquet" not in top and top.count("orders.parquet") == 1


def test_contract(spark):
    assert set(contract.oracle_sql()) <= set(contract.queries()) >= set(QUERIES)
    assert contract.entry(spark).count() > 0
