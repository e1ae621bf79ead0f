"""Wide counters, failing tables, duplicate keys and keys of two types."""

from pyspark.sql import functions as F

from concord import Reconciliation, TablePair
from concord.operators import compare as CMP
from concord.operators import multiset as MS
from concord.operators.sample import hash_sample
from concord.plans.prepare import prepare
from concord.plans.run import run
from helpers import brute_force, cfg, pair

N = 4_000_000_000


def test_pair_counts_beyond_64_bits(spark):
    df = spark.createDataFrame([(1, "a")], "id int, v string")
    prep = prepare(TablePair("t", df, df), cfg())
    counts = CMP.key_counts(prep).withColumns({"n_l": F.lit(N), "n_r": F.lit(N)})
    s = CMP.key_summary(prep, counts).first()
    assert int(s.joined_pairs) == int(s.duplicate_pairs) == N * N and s.left_rows == N
    vc = spark.sql(f"select struct(1 id) __k, {2 * N}L n_l, {N}L n_r, 0 ci, 'a' v, {N}L cl, {N}L cr union all select struct(1 id), {2 * N}L, {N}L, 0, null, {N}L, 0L")
    got = MS.column_counts(prep, vc, 2 * N * N).first()
    assert [int(x) for x in (got.matches, got.mismatches, got.null_left, got.null_right)] == [N * N] * 3 + [0]
    v = MS.verdicts(prep, vc, 2 * N * N).first()
    assert int(v.pairs) == 2 * N * N and v.differing_list == "v"
    tuples = spark.sql(f"select {N}L cl, {N}L cr")
    assert int(MS.matching_pairs(tuples, 2 * N * N).first()[0]) == N * N


def test_64_bit_and_wide_counters_agree(spark, monkeypatch):
    left = [(i % 5, f"v{i % 3}", i % 2) for i in range(60)]
    right = [(i % 5, f"v{i % 4}", None if i % 7 == 0 else i % 2) for i in range(45)]
    p = pair(spark, left, right, "id int, v string, w int")

    def results():
        rec = Reconciliation(p, cfg())
        return [sorted(map(str, df.collect())) for df in (rec.column_stats(), rec.record_stats(), rec.record_verdicts(), rec.fused())]

    narrow = results()
    monkeypatch.setattr(MS, "NARROW", 0)
    assert results() == narrow


def test_verdicts_and_fused_cover_keys_whose_copies_differ(spark):
    left = [(1, "a", 1), (1, "b", 1), (2, "x", 5), (3, "q", 1), (3, "q", 2), (None, " n", 0), (7, "l", 0)]
    right = [(1, "a", 1), (1, "c", 1), (2, "y", 5), (3, "q", 1), (None, "n", 0), (8, "r", 0)]
    rec = Reconciliation(pair(spark, left, right, "id int, v string, w int"), cfg())
    got = {r.record_id: (int(r.pairs), r.differing_columns, r.differing_list) for r in rec.record_verdicts().collect()}
    assert got == {"1": (4, 1, "v"), "2": (1, 1, "v"), "3": (2, 1, "w"), "NULL": (1, 0, "")}
    pairs, matching, stats = brute_force(left, right, 0, [1, 2])
    f = rec.fused().first()
    assert [int(x) for x in (f.total_records, f.matching_records, f.matches_v, f.matches_w)] == [
        pairs, matching, stats[1][0], stats[2][0]]
    assert (f.left_total, f.right_total, f.missing_in_right, f.missing_in_left) == (7, 6, 1, 1)


def test_int_keys_against_bigint_and_text_keys(spark):
    rows = [(i, f"v{i}") for i in range(200)]
    ints = spark.createDataFrame(rows, "id int, v string")
    longs = spark.createDataFrame(rows, "id bigint, v string")
    texts = spark.createDataFrame([("5", "v5"), ("zz", "v6")], "id string, v string")
    whole = Reconciliation(TablePair("t", ints, longs), cfg()).missing_totals().first()
    part = hash_sample(TablePair("t", ints, longs), 10)
    sampled = Reconciliation(part, cfg()).missing_totals().first()
    assert whole[1:] == sampled[1:] == (0, 0) and 0 < part.left.count() < 60
    mixed = Reconciliation(TablePair("t", ints, texts), cfg()).missing_totals().first()
    assert mixed[1:] == (199, 1)


def test_table_that_fails_when_read_stays_alone(spark, tmp_path):
    good = spark.createDataFrame([(1, "a")], "id int, v string")
    bad = good.select("id", F.expr("cast(concat(v, 'x') as int)").alias("v"))
    res = run([TablePair("good", good, good), TablePair("bad", bad, bad)], cfg())
    assert {r.table_name: r.status for r in res["table_status"].collect()} == {"good": "OK", "bad": "ERROR"}
    total = res["run_summary"].first()
    assert (total.total_tables, total.tables_failed) == (2, 1)
    flags = {r.table_name: (r.perfect_match, r.record_match_rate) for r in res["table_summary"].collect()}
    assert flags == {"good": (True, 100.0), "bad": (False, None)}
    for _ in range(2):
        res.write(str(tmp_path))
    assert spark.read.parquet(f"{tmp_path}/column_stats").count() == 1
    res.close()


def test_run_reports_no_common_columns(spark):
    a, b = spark.createDataFrame([(1,)], "a int"), spark.createDataFrame([(1,)], "b int")
    res = run([TablePair("t", a, b, keys=("a",))], cfg())
    assert res["table_status"].first().status == "NO_COMMON_COLUMNS"


def value_lines(left, right, i):
    """Lines of :meth:`Reconciliation.all_differences` for column ``i``, from the pairs."""
    out = set()
    for k in {r[0] for r in left} & {r[0] for r in right}:
        a, b = ([r[i] for r in side if r[0] == k] for side in (left, right))
        text = lambda v: "NULL" if v is None else str(v)
        alone = [v for v in set(a + b) if (a.count(v) == len(a) and v not in b) or (b.count(v) == len(b) and v not in a)]
        if len(alone) == 2:
            x, y = (v for v in alone if v in a), (v for v in alone if v in b)
            out.add((str(k), text(next(x)), text(next(y)), len(a), len(b), len(a) * len(b)))
            continue
        for v in set(a + b):
            cl, cr = a.count(v), b.count(v)
            if (cl and cr < len(b)) or (cr and cl < len(a)):
                out.add((str(k), text(v) if cl else None, text(v) if cr else None, cl, cr, cl * (len(b) - cr)))
    return out


def test_all_differences_are_linear_and_add_up(spark):
    import random

    rng = random.Random(3)
    rows = lambda n: [(rng.choice([1, 2, 3, 4, 5, 6]), rng.choice(["a", "b", None, "c"]), rng.choice([1, 1, 2])) for _ in range(n)]
    left, right = rows(14) + [(8, "x", 1), (9, "y", 1)], rows(12) + [(8, "z", 1), (9, "y", 1), (9, "y", 1)]
    rec = Reconciliation(pair(spark, left, right, "id int, v string, w int"), cfg())
    got = rec.all_differences().collect()
    for i, c in ((1, "v"), (2, "w")):
        lines = [(r.record_id, r.left_value, r.right_value, r.left_rows, r.right_rows, int(r.pairs)) for r in got if r.column_name == c]
        assert len(lines) == len(set(lines)) and set(lines) == value_lines(left, right, i)
    stats = {r.column_name: int(r.mismatches) for r in rec.column_stats().collect()}
    assert stats == {c: sum(int(r.pairs) for r in got if r.column_name == c) for c in ("v", "w")}


def test_differences_of_a_hot_key_are_linear(spark):
    n = 100_000
    left = spark.range(n).selectExpr("1 as id", "concat('l', id) as v", "cast(id % 2 as int) as w")
    right = spark.range(n).selectExpr("1 as id", "concat('r', id) as v", "cast(id % 2 as int) as w")
    rec = Reconciliation(TablePair("t", left, right), cfg())
    lines = rec.all_differences()
    assert lines.groupBy("column_name").count().collect() == rec.spark.createDataFrame([("v", 2 * n), ("w", 2)], "column_name string, count long").sort("column_name").collect() or \
        {r["column_name"]: r["count"] for r in lines.groupBy("column_name").count().collect()} == {"v": 2 * n, "w": 2}
    top = rec.top_differences(20).where("column_name = 'v'").orderBy("rn").collect()
    assert [(r.left_value, r.right_value, int(r.pairs)) for r in top][:3] == [("l0", "r0", 1), ("l0", "r1", 1), ("l0", "r10", 1)]
    assert len(top) == 20
    rec.close()


def test_first_differences_take_few_keys(spark):
    """The first N lines of duplicate keys are those of the full pairing."""
    import random

    rng = random.Random(8)
    side = lambda n: [(rng.randint(1, 12), rng.choice("abcde"), rng.choice([1, 2])) for _ in range(n)]
    left, right = side(60), side(60)
    rec = Reconciliation(pair(spark, left, right, "id int, v string, w int"), cfg())
    for limit in (1, 4, 30, 1000):
        got = [(r.column_name, r.record_id, r.left_value, r.right_value, int(r.pairs), r.rn) for r in rec.top_differences(limit).collect()]
        want = []
        for i, c in ((1, "v"), (2, "w")):
            pairs = {}
            for a in left:
                for b in right:
                    if a[0] == b[0] and a[i] != b[i]:
                        pairs[a[0], str(a[i]), str(b[i])] = pairs.get((a[0], str(a[i]), str(b[i])), 0) + 1
            want += [(c, str(k), l, r, pairs[k, l, r], j + 1) for j, (k, l, r) in enumerate(sorted(pairs)[:limit])]
        assert sorted(got) == sorted(want)


def test_heavy_keys_are_split_from_light_ones(spark, monkeypatch):
    """Beyond the broadcast threshold, heavy keys go by broadcast and the others by shuffle, with the same results."""
    left = [(0 if i % 3 == 0 else i % 40, f"v{i % 6}") for i in range(400)] + [(1000 + i, "one") for i in range(20)]
    right = [(0 if i % 3 == 0 else i % 40, f"v{i % 5}") for i in range(400)] + [(1000 + i, "one") for i in range(5, 25)]
    p = pair(spark, left, right, "id int, v string")

    def results():
        rec = Reconciliation(p, cfg())
        return [sorted(map(str, df.drop("__k").collect())) for df in (rec.column_stats(), rec.record_stats(), rec.missing(), rec.all_differences())]

    whole = results()
    monkeypatch.setattr(CMP, "broadcast_limit", lambda spark: -1)
    monkeypatch.setattr(CMP, "HEAVY", 4)
    assert results() == whole


def test_missing_duplicate_keys_show_their_greatest_row(spark):
    left = spark.sql("select 1 id, timestamp_ntz'2001-01-01 00:00:00' creation_time, 5 v union all select 1, timestamp_ntz'2001-02-01 00:00:00', 1 union all select 2, null, 3")
    rec = Reconciliation(TablePair("t", left, left.where("id = 3")), cfg())
    got = {(r.record_id, r.side, r.created_date, r.last_modified) for r in rec.missing().collect()}
    assert got == {("1", "missing_in_right", "2001-02-01 00:00:00", "N/A"), ("2", "missing_in_right", "N/A", "N/A")}


def test_digest_prefilter_gives_the_same(spark):
    from concord.sources.fixtures import lineitem_drift_pair, orders_pair
    from tests_paths import SF001

    nulls = [(1, None, "a", 0.0), (2, "a", None, float("nan")), (3, " x", "y", -0.0), (4, None, None, 1.5), (6, "q", "q", 1.0)]
    other = [(1, "a", None, -0.0), (2, "a", None, None), (3, "x ", "y", 0.0), (4, None, None, 1.5), (5, "q", "q", 1.0)]
    for p in (orders_pair(spark, SF001), lineitem_drift_pair(spark, SF001), pair(spark, nulls, other, "id int, v string, w string, x double"),
              pair(spark, nulls[3:4], other[3:4], "id int, v string, w string, x double")):
        results = []
        for on in (False, True):
            rec = Reconciliation(p, cfg(digest_prefilter=on))
            results.append([sorted(map(str, df.drop("__k").collect())) for df in (
                rec.column_stats(), rec.record_stats(), rec.fused(), rec.missing(), rec.all_differences())])
            rec.close()
        assert results[0] == results[1]


def test_dotted_names(spark):
    left = spark.createDataFrame([(1, "a", 1), (2, "b", 2), (2, "c", 2)], "`k.id` int, `a.b` string, `x``y` int")
    right = spark.createDataFrame([(1, "z", 1), (2, "b", 2)], "`k.id` int, `a.b` string, `x``y` int")
    rec = Reconciliation(TablePair("t", left, right, keys=("k.id",)), cfg())
    assert {r.column_name: (int(r.matches), int(r.mismatches)) for r in rec.column_stats().collect()} == {"a.b": (1, 2), "x`y": (3, 0)}
    assert {(r.record_id, r.left_value, r.right_value) for r in rec.all_differences().collect()} == {("1", "a", "z"), ("2", "b", "b"), ("2", "c", None)}
    assert rec.missing_totals().first()[1:] == (0, 0) and rec.record_counts().first().left_total == 3
