"""Committed runs: re-runs replace everything, pruning is even, failures leave nothing; tables at a time."""

import json
import os

import pytest
from pyspark.sql import functions as F

from concord import TablePair
from concord.cli import main
from concord.plans.run import run
from concord.sources import sinks
from concord.sources.runs import RunStore
from helpers import cfg
from tests_paths import SF001


def frames(spark, drift):
    left = spark.range(40).selectExpr("cast(id as int) id", "concat('v', id) v", "timestamp_ntz'2001-01-01 00:00:00' creation_time",
                                      "timestamp_ntz'2001-01-02 00:00:00' last_modified_time")
    right = left.where("id % 7 <> 0").withColumn("v", F.when(F.col("id") % 5 == 0, F.lit("x")).otherwise(F.col("v"))) if drift else left
    return TablePair("t", left, right)


def counts(store):
    return {(r.run_id, r.result_table): r.rows for r in store.rows().collect()}


def test_a_run_written_again_leaves_nothing_stale(spark):
    root = sinks.shared_dir(spark, "runs")
    store = RunStore(spark, root)
    for drift in (True, False):
        res = run([frames(spark, drift)], cfg(run_id="r1"))
        res.write(root)
        for name in res.frames:
            assert sorted(map(str, store.read(name).collect())) == sorted(map(str, res[name].collect()))
        res.close()
    got = counts(store)
    assert got["r1", "field_differences"] == got["r1", "missing_records"] == 0 and got["r1", "column_stats"] == 3
    assert store.read("field_differences").count() == 0
    assert len(sinks.subfolders(spark, f"{root}/field_differences")) == 1  # the first attempt's folder is gone


def test_pruning_keeps_the_same_runs_everywhere(spark):
    root = sinks.shared_dir(spark, "runs")
    for i, drift in enumerate((True, True, False, False)):
        res = run([frames(spark, drift)], cfg(run_id=f"r{i}"))
        res.write(root, keep_runs=2)
        res.close()
    store = RunStore(spark, root)
    assert list(store.runs()) == ["r2", "r3"]
    for name in sinks.subfolders(spark, root):
        if name != "_manifest":
            assert len(sinks.subfolders(spark, f"{root}/{name}")) == 2
            if store.read(name).count():
                assert {r.run_id for r in store.read(name).select("run_id").distinct().collect()} == {"r2", "r3"}
    assert store.read("field_differences").count() == 0
    assert store.prune(2) == [] and store.prune(1) == ["r2"] and store.prune(0) == ["r3"]
    with pytest.raises(ValueError):
        store.read("column_stats")


def test_uncommitted_attempts_are_not_read(spark):
    root = sinks.shared_dir(spark, "runs")
    store = RunStore(spark, root)
    good = spark.createDataFrame([("a", 1)], "run_id string, x int")
    store.write("a", {"t": good, "u": good})

    bad = good.withColumn("x", F.expr("cast(concat('y', run_id) as int)"))
    with pytest.raises(Exception):
        store.write("a", {"t": good.withColumn("x", F.lit(9)), "u": bad})
    assert [r.x for r in store.read("t").collect()] == [1]
    assert len(sinks.subfolders(spark, f"{root}/t")) == 2
    assert store.sweep() >= 1 and store.sweep() == 0
    assert [r.x for r in store.read("t").collect()] == [1] and store.read("u").count() == 1


def test_runs_of_other_columns_and_odd_ids(spark):
    root = sinks.shared_dir(spark, "runs")
    store = RunStore(spark, root)
    for run_id, extra in (("a/b c=%", False), ("12", True)):
        df = spark.createDataFrame([(run_id, 1)], "run_id string, x int")
        store.write(run_id, {"t": df.withColumn("more", F.lit("m")) if extra else df})
    assert {(r.run_id, r.x, r.more) for r in store.read("t").collect()} == {("a/b c=%", 1, None), ("12", 1, "m")}
    assert [r.run_id for r in store.read("t", ["12"]).collect()] == ["12"]
    assert RunStore(spark, root + "-none").runs() == {}


def test_all_tables_failing_gives_a_summary(spark):
    bad = frames(spark, False)
    res = run([TablePair(n, bad.left, bad.right, keys=("nope",)) for n in ("a", "b")], cfg())
    total = res["run_summary"].first()
    assert (total.total_tables, total.tables_failed, total.tables_with_mismatches, total.total_left_records) == (2, 2, 0, 0)
    assert {(r.table_name, r.perfect_match, r.record_match_rate, r.has_mismatch) for r in res["table_summary"].collect()} == {
        ("a", False, None, None), ("b", False, None, None)}
    root = sinks.shared_dir(spark, "runs")
    res.write(root)
    assert RunStore(spark, root).read("column_stats").count() == 0


def test_unread_tables_are_not_clean(spark):
    a, b = spark.createDataFrame([(1,)], "a int"), spark.createDataFrame([(1,)], "b int")
    res = run([TablePair("n", a, b, keys=("a",)), frames(spark, False)], cfg())
    row = res["table_summary"].where("table_name = 'n' and status = 'NO_COMMON_COLUMNS'").first()
    assert row is not None
    flags = (row.perfect_match, row.record_match_rate, row.has_mismatch)
    assert flags == (False, None, None)
    assert res["run_summary"].first().tables_failed == 1


def test_failed_table_leaves_no_scratch(spark):
    good = spark.range(30).selectExpr("id", "cast(id as string) v")
    bad = good.select("id", F.expr("cast(concat(v, 'x') as int)").alias("v"))
    root = spark.conf.get("spark.checkpoint.dir")
    before = set(os.listdir(root))
    res = run([TablePair("bad", bad, bad)], cfg())
    assert res["table_status"].first().status == "ERROR"
    res.close()
    assert set(os.listdir(root)) == before


def test_tables_at_a_time_give_the_same(spark):
    good = spark.range(300).selectExpr("id", "cast(id as string) v")
    bad = good.select("id", F.expr("cast(concat(v, 'x') as int)").alias("v"))
    pairs = [TablePair("one", good, good.where("id % 9 <> 0")), TablePair("bad", bad, bad),
             TablePair("two", good, good.withColumn("v", F.lit("x"))), frames(spark, True)]
    results = []
    for n in (1, 3):
        res = run(pairs, cfg(parallel_tables=n))
        results.append({name: sorted(str(r) for r in df.drop("message").collect()) for name, df in res.frames.items()})
        res.close()
    assert results[0] == results[1]
    assert spark.sparkContext.getLocalProperty("spark.scheduler.pool") is None
    assert spark.sparkContext.getLocalProperty("spark.jobGroup.id") is None


def test_cli_prunes(spark, tmp_path, capsys):
    out = sinks.shared_dir(spark, "cli-runs")
    for i in range(3):
        conf = {"as_of": "2001-08-01 00:00:00", "run_id": f"r{i}", "output": out, "keep_runs": 2, "parallel_tables": 2,
                "tables": [{"name": "customer", "keys": ["c_custkey"], "left": {"parquet": f"{SF001}/customer.parquet"},
                            "right": {"parquet": f"{SF001}/customer.parquet"}}]}
        path = tmp_path / "conf.json"
        path.write_text(json.dumps(conf))
        assert main([str(path)]) == 0
    capsys.readouterr()
    assert list(RunStore(spark, out).runs()) == ["r1", "r2"]
