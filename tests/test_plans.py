"""Plan shape: keys first, one join for rows, hash aggregates, pushdown, no Python, no pairs."""

import re

import pytest

from concord import Reconciliation
from concord.operators import compare as CMP
from concord.operators import multiset as MS
from concord.operators import retention as RET
from concord.plans.catalog import QUERIES, cfg
from concord.sources.fixtures import lineitem_drift_pair, orders_pair
from tests_paths import SF001


@pytest.fixture(autouse=True)
def no_cached_plans(spark):
    # earlier tests may have persisted identical frames; plan from scratch
    spark.catalog.clearCache()


def plan_of(df, mode="formatted") -> str:
    return df._sc._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), mode)


def test_key_counts_read_keys_alone_and_combine_before_one_shuffle(spark):
    rec = Reconciliation(orders_pair(spark, SF001), cfg())
    plan = plan_of(CMP.key_counts(rec.prep), "simple")
    assert plan.count("Exchange hashpartitioning(__k") == 1 and "partial_count" in plan, plan
    assert "SortAggregate" not in plan and "Join" not in plan
    assert set(re.findall(r"ReadSchema: struct<([^>]*)>", plan)) == {"o_orderkey:bigint"}


def test_rows_are_one_join_with_hash_aggregates(spark):
    rec = Reconciliation(orders_pair(spark, SF001), cfg(), keep=False)
    plan = plan_of(rec.rows().agg(*CMP.single_counters(rec.prep)), "simple")
    assert plan.count("Join") == 1 and "FullOuter" in plan, plan
    assert "SortAggregate" not in plan
    assert plan.count("Exchange hashpartitioning") == 2  # each side once


def test_duplicate_keys_read_each_source_once_more(spark):
    rec = Reconciliation(lineitem_drift_pair(spark, SF001), cfg())
    plan = plan_of(MS.tuple_counts(rec.prep, rec.duplicate_keys(), rec.summary()), "simple")
    assert plan.count("FileScan parquet") - plan.count("concord-kept") == 2, plan
    assert "SortAggregate" not in plan and "partial_count" in plan
    rec.tuples()
    for df in (rec.values(), MS.matching_pairs(rec.tuples(), rec.duplicate_pairs())):
        plan = plan_of(df, "simple")
        assert "lineitem.parquet" not in plan and "SortAggregate" not in plan
    rec.close()


def test_only_the_first_list_joins_values(spark):
    """Complete differences of duplicate keys pair no values with each other."""
    rec = Reconciliation(lineitem_drift_pair(spark, SF001), cfg())
    plan = plan_of(MS.differences(rec.prep, rec.values()), "simple")
    assert "Join" not in plan, plan
    rec.close()


def test_window_pushed_into_scan(spark):
    rec = Reconciliation(orders_pair(spark, SF001), cfg(45))
    for df in (CMP.key_counts(rec.prep), rec.rows()):
        assert "PushedFilters: [IsNotNull(o_orderdate), GreaterThanOrEqual(o_orderdate" in plan_of(df)


def test_retention_pushed_into_scan(spark):
    plan = plan_of(RET.retention_count(orders_pair(spark, SF001), cfg(45)))
    assert "LessThan(o_orderdate" in plan


def test_top_differences_use_group_limit(spark):
    rec = Reconciliation(orders_pair(spark, SF001), cfg())
    assert "WindowGroupLimit" in plan_of(rec.top_differences(), "simple")


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_no_python_rows_or_cross_products(spark, name):
    plan = plan_of(QUERIES[name](spark, SF001), "simple")
    for bad in ("PythonUDF", "BatchEvalPython", "ArrowEvalPython", "CartesianProduct",
                "BroadcastNestedLoopJoin"):
        assert bad not in plan, f"{name}: {bad}"
