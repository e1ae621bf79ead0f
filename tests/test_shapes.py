"""Table shapes: wide tables, string and timestamp keys, composite NULL keys."""

from datetime import datetime

from pyspark.sql import functions as F

from concord import Reconciliation, TablePair
from concord.operators import wide as WD
from helpers import cfg


def test_wide_table(spark):
    n_cols = 150
    base = spark.range(0, 500).select(
        F.col("id"), *[(F.col("id") * i % 97).cast("string").alias(f"c{i}") for i in range(n_cols)])
    right = base.withColumn("c7", F.when(F.col("id") % 10 == 0, F.lit("x")).otherwise(F.col("c7")))
    rec = Reconciliation(TablePair("wide", base, right), cfg())
    stats = {r.column_name: r for r in rec.column_stats().collect()}
    assert len(stats) == n_cols
    assert stats["c7"].mismatches == 50 and stats["c8"].mismatches == 0
    s = rec.record_stats().collect()[0]
    assert (s.total_records, s.matching_records) == (500, 450)


def test_string_and_timestamp_keys(spark):
    t = datetime(2001, 7, 1, 12, 0, 0)
    left = spark.createDataFrame([("a", t, 1), ("b", t, 2), (None, None, 3)], "k string, ts timestamp, v int")
    right = spark.createDataFrame([("a", t, 1), ("b", t, 5), (None, None, 3), ("c", t, 4)],
                                  "k string, ts timestamp, v int")
    rec = Reconciliation(TablePair("t", left, right, keys=("k", "ts")), cfg())
    s = rec.record_stats().collect()[0]
    assert (s.total_records, s.matching_records) == (3, 2)
    m = rec.missing_totals().collect()[0]
    assert (m.missing_in_right, m.missing_in_left) == (0, 1)
    diffs = [(r.record_id, r.left_value, r.right_value) for r in rec.top_differences().collect()]
    assert len(diffs) == 1 and diffs[0][0].startswith("b|2001-07-01") and diffs[0][1:] == ("2", "5")


def test_key_named_like_internal_columns(spark):
    left = spark.createDataFrame([(1, 1, "a"), (2, 2, "b")], "v int, ci int, cl string")
    right = spark.createDataFrame([(1, 1, "a"), (2, 2, "c")], "v int, ci int, cl string")
    rec = Reconciliation(TablePair("t", left, right, keys=("v",)), cfg())
    stats = {r.column_name: (r.matches, r.mismatches) for r in rec.column_stats().collect()}
    assert stats == {"ci": (2, 0), "cl": (1, 1)}


def test_packed_flags_equal_the_loop(spark, monkeypatch):
    """A wide pair, packed in chunks without interpreted code, against the counters of its columns a few at a time."""
    n = WD.CHUNK * 2 + 5
    rows = [(i, *[None if (i + j) % 11 == 0 else float("nan") if j % 3 == 1 and i % 7 == 0 else i * j % 5 for j in range(n)])
            for i in range(40)]
    types = ["string", "double", "bigint"]
    make = {0: lambda v: v if v is None else f" {v}", 1: lambda v: v if v is None else float(v), 2: lambda v: None if v != v else v}
    schema = "id int, " + ", ".join(f"`c.{j}` {types[j % 3]}" for j in range(n))

    def frame(keep, change):
        out = []
        for r in rows:
            if keep(r[0]):
                cells = [make[j % 3](v) for j, v in enumerate(r[1:])]
                out.append((r[0], *[None if change(r[0], j) else v for j, v in enumerate(cells)]))
        return spark.createDataFrame(out + [(99, *out[0][1:])] * 2, schema)  # 99 is a duplicate key

    left = frame(lambda i: i % 9 != 1, lambda i, j: False)
    right = frame(lambda i: i % 13 != 2, lambda i, j: i % 4 == 0 and j in (0, 31, 62, 66))
    monkeypatch.setattr(WD, "WIDE", 10)
    for key in ("spark.sql.codegen.factoryMode", "spark.sql.codegen.fallback"):
        spark.conf.set(key, "CODEGEN_ONLY" if key.endswith("Mode") else "false")
    try:
        pair = TablePair("wide", left, right)
        recs = [Reconciliation(pair, cfg(), keep=k) for k in (True, False)]
        got = [sorted(map(tuple, r.column_stats().collect())) for r in recs]
        lists = [sorted(map(tuple, f().collect())) for f in (recs[0].all_differences, recs[0].missing)]
        records = recs[0].record_stats().collect()
        recs[0].close()
    finally:
        spark.conf.unset("spark.sql.codegen.factoryMode")
        spark.conf.unset("spark.sql.codegen.fallback")
    monkeypatch.setattr(WD, "WIDE", 100)
    names = [f"c.{j}" for j in range(n)]
    loop = [tuple(r) for at in range(0, n, 8) for r in
            Reconciliation(pair, cfg(), columns=names[at:at + 8], keep=False).column_stats().collect()]
    assert got[0] == got[1] == sorted(loop) and any(r[3] for r in loop) and any(r[4] for r in loop)
    plain = Reconciliation(pair, cfg())
    assert lists == [sorted(map(tuple, f().collect())) for f in (plain.all_differences, plain.missing)]
    assert records == plain.record_stats().collect()


def test_packed_flags_of_pairs_without_common_keys(spark, monkeypatch):
    monkeypatch.setattr(WD, "WIDE", 1)
    left = spark.createDataFrame([(1, 2, 3)], "id int, a int, b int")
    for right, n in ((left.where("id < 0"), 0), (left.withColumn("id", F.lit(7)), 2)):
        rec = Reconciliation(TablePair("t", left, right), cfg(), keep=False)
        assert rec.column_stats().count() == n
        assert rec.totals().collect()[0].single_pairs == 0
