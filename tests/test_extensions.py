"""Duplicate-key profile, window-edge reasons, archive states, record ids."""

from collections import Counter
from datetime import timedelta

from concord import Reconciliation, TablePair
from concord.operators import compare as CMP
from concord.operators import duplicates as DUP
from concord.operators import edges as EDGES
from concord.operators import retention as RET
from concord.plans.prepare import prepare
from concord.plans.reconcile import materialize, release
from helpers import AS_OF, cfg, pair

DAY = timedelta(days=1)


def test_duplicate_profile(spark):
    left = [(k,) for k in [1] * 50 + [2] * 3 + [3, 4, None, None]]
    right = [(k,) for k in [1, 2, 2, 5, 6, 6]]
    prep = prepare(pair(spark, left, right, "id int"), cfg())
    hist = {(r.side, r.copies): (r.keys, r.rows) for r in DUP.copies_histogram(prep).collect()}
    for side, rows in (("left", left), ("right", right)):
        want = Counter(Counter(k for k, in rows).values())
        assert {c: n for (s, c), (n, _) in hist.items() if s == side} == want
        assert sum(n for (s, _), (_, n) in hist.items() if s == side) == len(rows)
    top = [(r.side, r["rank"], r.record_id, r.copies) for r in DUP.most_copied(prep, 2).orderBy("side", "rank").collect()]
    assert top == [("left", 1, "1", 50), ("left", 2, "2", 3), ("right", 1, "2", 2), ("right", 2, "6", 2)]


SCHEMA = "id int, creation_time timestamp_ntz, last_modified_time timestamp_ntz"


def test_window_edges(spark, monkeypatch):
    new, old = AS_OF - DAY, AS_OF - 100 * DAY
    left = [(1, new, None), (2, new, None), (3, new, None), (4, old, None), (None, new, None), (6, new, None), (6, new, None), (7, None, None)]
    right = [(1, new, None), (2, old, None), (4, new, None), (5, new, None), (6, old, None), (6, old - DAY, None), (7, new, None), (None, None, None)]
    want = {("missing_in_right", "2", "outside_window", str(old)), ("missing_in_right", "3", "absent", "N/A"),
            ("missing_in_right", "NULL", "outside_window", "N/A"), ("missing_in_right", "6", "outside_window", str(old)),
            ("missing_in_left", "4", "outside_window", str(old)), ("missing_in_left", "5", "absent", "N/A"),
            ("missing_in_left", "7", "outside_window", "N/A")}
    p = pair(spark, left, right, SCHEMA)
    for limit in (None, -1):  # broadcast or shuffled
        if limit is not None:
            monkeypatch.setattr(CMP, "broadcast_limit", lambda spark: limit)
        found, kept = EDGES.window_edges(p, cfg(window_enabled=True, window_days=45), materialize)
        assert {(r.side, r.record_id, r.reason, r.other_created) for r in found.collect()} == want
        release(kept)
    plain = spark.createDataFrame([(1,), (2,)], "id int")
    found, _ = EDGES.window_edges(TablePair("t", plain, plain.where("id = 1")), cfg(window_enabled=True), materialize)
    assert [(r.record_id, r.reason) for r in found.collect()] == [("2", "absent")]


def test_archive_states(spark):
    old, new = AS_OF - 100 * DAY, AS_OF - DAY
    left = [(1, old, old), (2, old, old), (2, old, old), (3, new, new), (4, old, None), (None, old, old)]
    right = [(2, old, old), (3, new, new), (5, old, old), (6, old, old), (7, new, old), (None, old, old)]
    p = pair(spark, left, right, SCHEMA)
    r = RET.archive_state(p, cfg()).first()
    assert (r.total_old_records, r.deleted_records, r.archived, r.left_only, r.not_deleted, r.status) == (5, 2, 2, 1, 3, "OK")
    r = RET.archive_state(p, cfg(), archive=p.right.where("id = 5")).first()
    assert (r.total_old_records, r.deleted_records, r.archived, r.left_only) == (4, 1, 0, 3)
    assert RET.archive_state(p, cfg(), archive=p.right.limit(0)).first().deleted_records == 0
    r = RET.archive_state(p, cfg(), archive=p.right.drop("creation_time")).first()
    assert (r.status, r.total_old_records) == ("NO_TIME_COLUMNS", None)
    longs = p.right.selectExpr("cast(id as bigint) id", "creation_time", "last_modified_time")
    assert RET.archive_state(p, cfg(), archive=longs).first().archived == 2


def test_record_ids_are_unambiguous(spark):
    keys = [("a|b", "c"), ("a", "b|c"), ("a\\", "|b"), ("NULL", "x"), (None, "x"), ("\\NULL", "x"), ("a\\|b", "c")]
    left = spark.createDataFrame([(a, b, 1) for a, b in keys], "a string, b string, v int")
    rec = Reconciliation(TablePair("t", left, left.limit(0), keys=("a", "b")), cfg())
    ids = [r.record_id for r in rec.missing().collect()]
    assert len(set(ids)) == len(keys)
    single = spark.createDataFrame([("NULL", 1), (None, 1), ("x|y", 1)], "id string, v int")
    rec = Reconciliation(TablePair("t", single, single.limit(0)), cfg())
    assert {r.record_id for r in rec.missing().collect()} == {"\\NULL", "NULL", "x|y"}


def test_decimals_without_a_common_type(spark):
    left = spark.sql("select 1 id, cast('12345678901234567890123456789012345678' as decimal(38,0)) v union all select 2, 5 union all select 3, 0 union all select 4, null union all select 5, 120")
    right = spark.sql("select 1 id, cast('1.5' as decimal(38,18)) v union all select 2, 5.000 union all select 3, 0 union all select 4, null union all select 5, 120.0000000001")
    rec = Reconciliation(TablePair("t", left, right), cfg())
    assert {r.record_id: r.differing_columns for r in rec.record_verdicts().collect()} == {"1": 1, "2": 0, "3": 0, "4": 0, "5": 1}
