"""Properties on the derived pairs: self-compare, symmetry, conservation."""

from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from concord import Reconciliation, TablePair
from concord.plans.catalog import cfg
from concord.sources.fixtures import lineitem_drift_pair, orders_pair
from tests_paths import SF001


@pytest.fixture(scope="module")
def orders(spark):
    return orders_pair(spark, SF001)


def test_self_compare_is_perfect(spark, orders):
    rec = Reconciliation(TablePair("o", orders.left, orders.left), cfg())
    assert all(r.match_rate == 100.0 and r.mismatches == 0 for r in rec.column_stats().collect())
    m = rec.missing_totals().collect()[0]
    assert (m.missing_in_right, m.missing_in_left) == (0, 0)
    assert rec.top_differences().count() == 0


def test_swapping_sides_mirrors(spark, orders):
    a = Reconciliation(orders, cfg(45))
    b = Reconciliation(replace(orders, left=orders.right, right=orders.left), cfg(45))
    sa = {r.column_name: r for r in a.column_stats().collect()}
    sb = {r.column_name: r for r in b.column_stats().collect()}
    for c in sa:
        assert (sa[c].matches, sa[c].null_left, sa[c].null_right) == (sb[c].matches, sb[c].null_right, sb[c].null_left)
    ma, mb = a.missing_totals().collect()[0], b.missing_totals().collect()[0]
    assert (ma.missing_in_right, ma.missing_in_left) == (mb.missing_in_left, mb.missing_in_right)
    ca, cb = a.record_counts().collect()[0], b.record_counts().collect()[0]
    assert ca.difference == -cb.difference


@pytest.mark.parametrize("build", [orders_pair, lineitem_drift_pair])
def test_conservation(spark, build):
    rec = Reconciliation(build(spark, SF001), cfg())
    s = rec.record_stats().collect()[0]
    for r in rec.column_stats().collect():
        assert r.matches + r.mismatches == s.total_records
    summ = rec.summary()
    counts = rec.record_counts().collect()[0]
    assert (summ["left_rows"], summ["right_rows"]) == (counts.left_total, counts.right_total)


def test_scenarios_partition_rows_with_both_times(spark, orders):
    rec = Reconciliation(orders, cfg())
    sc = {r.scenario: r for r in rec.date_scenarios().collect()}
    both = orders.left.where("creation_time is not null and last_modified_time is not null").count()
    assert sc[1].left_count + sc[2].left_count + sc[3].left_count == both


def test_unique_keys_conserve_rows(spark, orders):
    rec = Reconciliation(orders, cfg(2000))
    s, m = rec.record_stats().collect()[0], rec.missing_totals().collect()[0]
    c = rec.record_counts().collect()[0]
    assert c.left_total == s.total_records + m.missing_in_right
    assert c.right_total == s.total_records + m.missing_in_left


def test_capped_lists_are_prefixes(spark, orders):
    rec = Reconciliation(orders, cfg())
    full = rec.all_differences().select("column_name", "record_id").collect()
    capped = rec.top_differences(limit=5).collect()
    full_set = {(r.column_name, r.record_id) for r in full}
    assert all((r.column_name, r.record_id) in full_set for r in capped)
    assert max(r.rn for r in capped) <= 5


def test_hash_sample_keeps_the_same_keys_on_both_sides(spark, orders):
    from concord.operators.sample import hash_sample, key_hash_bucket
    sampled = hash_sample(orders, 10)
    full = Reconciliation(orders, cfg())
    part = Reconciliation(sampled, cfg())
    # exactly the full run's missing keys whose bucket is in the sample
    t = [orders.left.schema["id"].dataType]
    in_sample = full.missing().where(key_hash_bucket([F.col("__k.id")], t, t, 100) < 10)
    want = {(r.side, r.record_id) for r in in_sample.select("side", "record_id").collect()}
    got = {(r.side, r.record_id) for r in part.missing().select("side", "record_id").collect()}
    assert got == want
    # and both sides keep a similar share of their rows (about 10 %)
    n_left = sampled.left.count()
    assert 0 < n_left < orders.left.count() * 0.2
