"""Keys: NULL-safe pairing, duplicates counted as pairs, hot keys, composites."""

import random

from concord import Reconciliation, TablePair
from concord.plans.catalog import cfg as run_cfg
from helpers import brute_force, cfg


def test_null_and_duplicate_keys(spark):
    # keys 1,1,NULL on both sides: 2*2 + 1*1 = 5 pairs when NULL pairs with NULL
    rows = [(1, "a"), (1, "a"), (None, "n")]
    p = TablePair("t", spark.createDataFrame(rows, "id int, v string"),
                  spark.createDataFrame(rows, "id int, v string"))
    rec = Reconciliation(p, cfg())
    s = rec.record_stats().collect()[0]
    assert (s.total_records, s.matching_records) == (5, 5)
    m = rec.missing_totals().collect()[0]
    assert (m.missing_in_right, m.missing_in_left) == (0, 0)


def test_missing_counts_distinct_keys_including_null(spark):
    left = spark.createDataFrame([(1, "a"), (1, "b"), (None, "n"), (2, "x")], "id int, v string")
    right = spark.createDataFrame([(2, "x")], "id int, v string")
    rec = Reconciliation(TablePair("t", left, right), cfg())
    m = rec.missing_totals().collect()[0]
    assert (m.missing_in_right, m.missing_in_left) == (2, 0)    # keys 1 and NULL
    ids = sorted(r.record_id for r in rec.missing().collect())
    assert ids == ["1", "NULL"]


def _random_rows(rng, n, keys, values):
    return [(rng.choice(keys), rng.choice(values), rng.choice(values)) for _ in range(n)]


def test_mixed_duplicates_match_brute_force(spark):
    rng = random.Random(7)
    keys = [1, 2, 3, None]
    values = ["a", " a", "b", "", None, "c"]
    left = _random_rows(rng, 40, keys, values)
    right = _random_rows(rng, 35, keys + [9], values)
    schema = "id int, x string, y string"
    p = TablePair("t", spark.createDataFrame(left, schema), spark.createDataFrame(right, schema))
    rec = Reconciliation(p, cfg())
    pairs, matching, stats = brute_force(left, right, 0, [1, 2])
    s = rec.record_stats().collect()[0]
    assert (s.total_records, s.matching_records) == (pairs, matching)
    got = {r.column_name: (r.matches, r.mismatches, r.null_left, r.null_right)
           for r in rec.column_stats().collect()}
    assert got["x"] == tuple(stats[1]) and got["y"] == tuple(stats[2])


def test_hot_key_with_a_third_of_rows(spark):
    # one key holds a third of each side; its copies partly differ
    n = 3000
    left = [(i % 1000 if i % 3 else 0, f"v{i % 7}") for i in range(n)]
    right = [(i % 1000 if i % 3 else 0, f"v{(i + (i % 11 == 0)) % 7}") for i in range(n)]
    schema = "id int, v string"
    p = TablePair("t", spark.createDataFrame(left, schema), spark.createDataFrame(right, schema))
    rec = Reconciliation(p, cfg())
    s = rec.record_stats().collect()[0]
    # expected from value counts (pairs are never formed, here or in the engine)
    from collections import Counter
    cl, cr = Counter(left), Counter(right)
    nl, nr = Counter(k for k, _ in left), Counter(k for k, _ in right)
    pairs = sum(nl[k] * nr[k] for k in nl)
    matching = sum(c * cr[kv] for kv, c in cl.items())
    assert (s.total_records, s.matching_records) == (pairs, matching)


def test_composite_keys_missing(spark):
    from concord.sources.fixtures import lineitem_pair
    from tests_paths import SF001
    rec = Reconciliation(lineitem_pair(spark, SF001), run_cfg())
    li = spark.read.parquet(f"{SF001}/lineitem.parquet")
    left_keys = {(r.l_orderkey, r.l_linenumber) for r in li.select("l_orderkey", "l_linenumber").collect()}
    right_keys = {(r.l_orderkey, r.l_linenumber)
                  for r in li.where("year(l_shipdate) <> 1999").select("l_orderkey", "l_linenumber").collect()}
    m = rec.missing_totals().collect()[0]
    assert m.missing_in_right == len(left_keys - right_keys)
    assert m.missing_in_left == 0
    sample = {r.record_id for r in rec.missing().collect()}
    assert sample == {f"{a}|{b}" for a, b in left_keys - right_keys}


def test_copies_differing_in_one_column(spark):
    # CDC-style duplicates: versions of a row that differ only in 'ver'
    left = [(1, "a", 10, 1), (1, "a", 10, 2), (1, "a", 10, 3), (2, "b", 20, 1), (3, "c", 30, 1)]
    right = [(1, "a", 11, 1), (1, "a", 11, 2), (2, "b", 20, 1), (2, "b", 20, 9), (3, "c", 31, 1)]
    schema = "id int, s string, x int, ver int"
    p = TablePair("t", spark.createDataFrame(left, schema), spark.createDataFrame(right, schema))
    rec = Reconciliation(p, cfg())
    pairs, matching, stats = brute_force(left, right, 0, [1, 2, 3])
    s = rec.record_stats().collect()[0]
    assert (s.total_records, s.matching_records) == (pairs, matching)
    got = {r.column_name: (r.matches, r.mismatches, r.null_left, r.null_right)
           for r in rec.column_stats().collect()}
    assert got == {"s": tuple(stats[1]), "x": tuple(stats[2]), "ver": tuple(stats[3])}
    diffs = {(r.record_id, r.column_name, r.left_value, r.right_value, r.pairs)
             for r in rec.all_differences().collect()}
    # key 1: x is 10 on all 3 left copies and 11 on both right copies: 6 pairs
    assert ("1", "x", "10", "11", 6) in diffs
    assert ("3", "x", "30", "31", 1) in diffs
    assert not any(c == "s" for _, c, *_ in diffs)


def _every_result(rec):
    frames = [rec.column_stats(), rec.record_stats(), rec.fused(), rec.record_verdicts(), rec.all_differences(), rec.top_differences(4)]
    out = [sorted(map(repr, df.collect())) for df in frames]
    rec.close()
    return out


def test_many_duplicate_keys_give_the_same_in_one_pass(spark, monkeypatch):
    """More duplicate keys than a broadcast takes: light keys (of one row a side too) in one pass, heavy ones by their tuples."""
    from concord.operators import compare as CMP
    from concord.operators import dealt as DLT
    from test_plans import plan_of
    monkeypatch.setattr(CMP, "HEAVY", 8)
    rng = random.Random(11)
    words, numbers = ["a", " a", "b", "", None, "NULL"], [0.0, -0.0, 1.5, float("nan"), None]

    def side(singles):
        rows = [(rng.choice([5, 6, 7, None]), "x", rng.choice(words), rng.choice(numbers), rng.choice([1, 2, None])) for _ in range(40)]
        rows += [(9, "hot", rng.choice(words), rng.choice(numbers), 3) for _ in range(60)]
        return rows + [(i, None, rng.choice(words), rng.choice(numbers), rng.choice([1, None])) for i in singles]

    schema = "id int, part string, w string, d double, n int"
    p = TablePair("t", spark.createDataFrame(side(range(100, 130)), schema), spark.createDataFrame(side(range(110, 140)), schema), keys=("id", "part"))
    p2 = TablePair("t", p.left.where("id <> 9"), p.right.where("id <> 9"), keys=("id", "part"))
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    for pair, heavy, keep in ((p, 1, True), (p2, 0, False)):
        monkeypatch.setattr(CMP, "HEAVY", 8 if heavy else 2)
        want = _every_result(Reconciliation(pair, cfg()))
        assert all(want)
        try:
            spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "16b")
            rec = Reconciliation(pair, cfg(), keep=keep)
            assert rec.dealt() and (rec.heavy_keys().count() if heavy else rec.heavy_keys() is None)
            for df in (rec.light_totals(), DLT.verdicts(rec.prep, rec.light_rows()), DLT.differences(rec.prep, DLT.values(rec.prep, rec.light_rows()))):
                assert plan_of(df, "simple").count("Exchange hashpartitioning") == 1  # rows meet once
            assert _every_result(rec) == want
        finally:
            spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)


def test_keys_of_many_rows_are_dealt_to_tasks_of_bounded_size(spark, monkeypatch):
    """A task counts so many keys at most, however large the table (before, all of these met in one); heavy keys are combined first."""
    from concord.operators import compare as CMP
    from test_plans import plan_of
    left = spark.range(20_000).selectExpr("if(id % 4 = 0, 7, if(id % 50 = 1, null, id div 2)) as id", "cast(id % 3 as double) as d", "1 as v")
    p = TablePair("t", left, left.where("id is null or id % 5 <> 0"), keys=("id", "d"))

    def summary(rec):
        out = rec.summary().asDict(), sorted(map(repr, CMP.key_counts(rec.prep).collect()))
        rec.close()
        return out

    want = summary(Reconciliation(p, cfg()))
    monkeypatch.setattr(CMP, "ROWS_A_TASK", 1000)
    for heavy in (20, 1):  # some buckets hold a twentieth of the rows; none holds all
        monkeypatch.setattr(CMP, "HEAVY", heavy)
        rec = Reconciliation(p, cfg())
        counts = CMP.key_counts(rec.prep)
        n, buckets = rec.prep.key_weights
        assert bool(buckets) == (heavy == 20) and plan_of(counts, "simple").count("Union") == (2 * 1 + 1 if buckets else 1)
        counts.collect()
        sizes = [len(part) for part in counts.rdd.glom().collect()]
        assert len(sizes) >= n // 1000 and max(sizes) < 1000
        assert summary(rec) == want
    monkeypatch.setattr(CMP, "HEAVY", 20)
    prep = Reconciliation(p, cfg()).prep
    at_least = -(-(want[0]["left_rows"] + want[0]["right_rows"]) // 20)
    whole, some = ({repr(r) for r in CMP.key_counts(prep, h).where(f"n_l + n_r >= {at_least}").collect()} for h in (False, True))
    assert some == whole and whole
