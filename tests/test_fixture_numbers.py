"""The drifted orders pair against the independently computed expected values."""

import pytest

from concord import Reconciliation
from concord.operators import retention as RET
from concord.plans.catalog import cfg
from concord.sources.fixtures import orders_pair
from tests_paths import SF001, SF01

# Expected numbers for the orders pair (see FIXTURES.md).
EXPECTED = {
    (SF001, 45): dict(counts=(36, 35), missing=(1, 0), scen_l=(6, 10, 12), scen_r=(6, 9, 13), pairs=35,
                      mism=(0, 2, 2, 1), full=30, note_nulls=(4, 2)),
    (SF001, 2000): dict(counts=(1244, 1246), missing=(13, 15), scen_l=(247, 258, 488), scen_r=(245, 253, 498),
                        pairs=1231, mism=(22, 23, 74, 16), full=1099, note_nulls=(114, 55)),
    (SF01, 45): dict(counts=(290, 287), missing=(3, 0), scen_l=(58, 61, 125), scen_r=(56, 60, 125), pairs=287,
                     mism=(6, 5, 19, 2), full=255, note_nulls=(29, 11)),
    (SF01, 2000): dict(counts=(12493, 12483), missing=(129, 119), scen_l=(2492, 2489, 5017),
                       scen_r=(2455, 2447, 5087), pairs=12364, mism=(231, 215, 692, 149), full=11118,
                       note_nulls=(1114, 557)),
}
RETENTION = {SF001: 1171, SF01: 11753}


@pytest.mark.parametrize("sf_dir,days", list(EXPECTED))
def test_orders_pair(spark, sf_dir, days):
    e = EXPECTED[(sf_dir, days)]
    rec = Reconciliation(orders_pair(spark, sf_dir), cfg(days))
    c = rec.record_counts().collect()[0]
    assert (c.left_total, c.right_total) == e["counts"]
    m = rec.missing_totals().collect()[0]
    assert (m.missing_in_right, m.missing_in_left) == e["missing"]
    sc = sorted(rec.date_scenarios().collect(), key=lambda r: r.scenario)
    assert tuple(r.left_count for r in sc) == e["scen_l"]
    assert tuple(r.right_count for r in sc) == e["scen_r"]
    s = rec.record_stats().collect()[0]
    assert (s.total_records, s.matching_records) == (e["pairs"], e["full"])
    cs = {r.column_name: r for r in rec.column_stats().collect()}
    assert tuple(cs[c].mismatches for c in ("status", "price", "note", "last_modified_time")) == e["mism"]
    assert (cs["note"].null_left, cs["note"].null_right) == e["note_nulls"]
    assert cs["cust"].mismatches == cs["priority"].mismatches == cs["creation_time"].mismatches == 0


@pytest.mark.parametrize("sf_dir", list(RETENTION))
def test_retention(spark, sf_dir):
    got = RET.retention_count(orders_pair(spark, sf_dir), cfg(45)).collect()[0].not_deleted
    assert got == RETENTION[sf_dir]
