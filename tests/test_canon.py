"""Golden tests of the value-comparison rule (NULL, blank, whitespace, types)."""

from decimal import Decimal

from concord import Reconciliation, TablePair
from helpers import cfg

# (left, right, expected match)
LADDER = [
    (None, None, True),
    ("", "", True),
    ("", "   ", True),          # blank equals blank, whatever the spaces
    (None, "", False),          # NULL is not blank
    ("", None, False),
    (" a ", "a", True),         # outer whitespace ignored
    ("\ta\n", "a", True),       # tabs and newlines are whitespace too
    ("\u00a0a\u3000", "a", True),  # so are NBSP and ideographic space, as in str.strip()
    ("a b", "a  b", False),     # inner whitespace counts
    ("A", "a", False),          # case-sensitive
    ("x", "y", False),
]


def test_value_ladder(spark):
    rows_l = [(i, l) for i, (l, _, _) in enumerate(LADDER)]
    rows_r = [(i, r) for i, (_, r, _) in enumerate(LADDER)]
    p = TablePair("t", spark.createDataFrame(rows_l, "id int, v string"),
                  spark.createDataFrame(rows_r, "id int, v string"), keys=("id",))
    rec = Reconciliation(p, cfg())
    got = {r.record_id: r.differing_columns == 0 for r in rec.record_verdicts().collect()}
    for i, (_, _, expect) in enumerate(LADDER):
        assert got[str(i)] == expect, LADDER[i]
    stats = rec.column_stats().collect()[0]
    assert stats.matches == sum(e for *_, e in LADDER)
    assert stats.null_left == sum(l is None for l, _, _ in LADDER)
    assert stats.null_right == sum(r is None for _, r, _ in LADDER)


def test_numeric_mix(spark):
    # int vs double, decimal vs double: 1 = 1.0, 1.50 = 1.5, NaN = NULL
    left = spark.createDataFrame(
        [(1, 1, Decimal("1.50")), (2, 2, Decimal("2.00")), (3, None, None), (4, 4, Decimal("4.10"))],
        "id int, a int, b decimal(18,2)")
    right = spark.createDataFrame(
        [(1, 1.0, 1.5), (2, 2.5, 2.0), (3, float("nan"), float("nan")), (4, 4.0, 4.2)],
        "id int, a double, b double")
    rec = Reconciliation(TablePair("t", left, right), cfg())
    stats = {r.column_name: r for r in rec.column_stats().collect()}
    assert (stats["a"].matches, stats["a"].mismatches) == (3, 1)
    assert (stats["b"].matches, stats["b"].mismatches) == (3, 1)
    assert stats["a"].null_right == 1 and stats["b"].null_right == 1


def test_negative_zero_equals_zero(spark):
    left = spark.createDataFrame([(1, 0.0)], "id int, v double")
    right = spark.createDataFrame([(1, -0.0)], "id int, v double")
    stats = Reconciliation(TablePair("t", left, right), cfg()).column_stats().collect()[0]
    assert stats.matches == 1


def test_bool_vs_int(spark):
    left = spark.createDataFrame([(1, True), (2, False)], "id int, v boolean")
    right = spark.createDataFrame([(1, 1), (2, 0)], "id int, v int")
    strict = Reconciliation(TablePair("t", left, right), cfg()).column_stats().collect()[0]
    assert strict.mismatches == 2                       # 'true' is not '1'
    loose = Reconciliation(TablePair("t", left, right, bool_as_int=True), cfg()).column_stats().collect()[0]
    assert loose.matches == 2


def test_date_vs_timestamp_differs(spark):
    left = spark.sql("select 1 as id, date'2001-01-01' as d")
    right = spark.sql("select 1 as id, timestamp_ntz'2001-01-01 00:00:00' as d")
    stats = Reconciliation(TablePair("t", left, right), cfg()).column_stats().collect()[0]
    assert stats.mismatches == 1


def test_nested_values_compare_as_json(spark):
    left = spark.sql("select 1 as id, array(1,2) as a, map('k', 1) as m")
    right = spark.sql("select 1 as id, array(1,2) as a, map('k', 2) as m")
    stats = {r.column_name: r for r in Reconciliation(TablePair("t", left, right), cfg()).column_stats().collect()}
    assert stats["a"].matches == 1 and stats["m"].mismatches == 1


def test_display_keeps_raw_value(spark):
    left = spark.createDataFrame([(1, " a "), (2, None)], "id int, v string")
    right = spark.createDataFrame([(1, "b"), (2, "")], "id int, v string")
    diffs = {r.record_id: (r.left_value, r.right_value)
             for r in Reconciliation(TablePair("t", left, right), cfg()).top_differences().collect()}
    assert diffs == {"1": (" a ", "b"), "2": ("NULL", "")}


def test_maps_compare_by_entries_and_floats_by_their_digits(spark):
    from concord import Reconciliation, RunConfig, TablePair
    from datetime import datetime
    left = spark.sql("select 1 as id, map('a', 1, 'b', 2) as m, array(map('x', named_struct('y', map(2, 'q', 1, 'p')))) as n, cast(0.1 as float) as f")
    right = spark.sql("select 1 as id, map('b', 2, 'a', 1) as m, array(map('x', named_struct('y', map(1, 'p', 2, 'q')))) as n, 0.1D as f")
    rec = Reconciliation(TablePair("t", left, right), RunConfig(as_of=datetime(2001, 8, 1)))
    assert {r.column_name: r.matches for r in rec.column_stats().collect()} == {"m": 1, "n": 1, "f": 1}


def test_mapping_to_a_name_that_the_right_has_too(spark):
    from concord.sources.schema import apply_mapping
    right = spark.sql("select 1 as id, 'own' as a, 'mapped' as b, 'c' as c")
    assert apply_mapping(right, {"a": "b"}).first().asDict() == {"id": 1, "a": "mapped", "c": "c"}
    assert apply_mapping(right, {"a": "b", "b": "a"}).first().asDict() == {"id": 1, "b": "own", "a": "mapped", "c": "c"}
