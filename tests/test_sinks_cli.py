"""Sinks and the command line: result tables, CSV round trip, recent runs."""

import json
import os

import pytest

from concord import Reconciliation, TablePair
from concord.cli import main
from concord.plans import catalog
from concord.plans.run import RESULT_TABLES, run
from concord.sources import fixtures as FX
from concord.sources import sinks
from helpers import cfg
from tests_paths import SF001


def test_csv_round_trip_keeps_quotes_blanks_and_spaces(spark):
    left = spark.createDataFrame([(1, 'say "hi"'), (2, None), (3, "a,b")], "id int, v string")
    right = spark.createDataFrame([(1, "x"), (2, ""), (3, "  ")], "id int, v string")
    diffs = Reconciliation(TablePair("my_table", left, right), cfg()).top_differences()
    path = sinks.shared_dir(spark, "csv-test")
    sinks.export_differences_csv(diffs, path)
    back = sinks.read_differences_csv(spark, path).collect()
    got = {(r.table_name, r.column_name, r.record_id, r.left_value, r.right_value) for r in back}
    assert got == {("my_table", "v", "1", 'say "hi"', "x"), ("my_table", "v", "2", "NULL", ""),
                   ("my_table", "v", "3", "a,b", "  ")}


def test_compressed_csv_round_trip(spark):
    left = spark.createDataFrame([(1, 'say "hi"'), (2, None), (3, "a,b"), (4, "two\nlines"), (5, "\\N")], "id int, v string")
    right = spark.createDataFrame([(1, "x"), (2, ""), (3, "  "), (4, "\u00e9"), (5, "")], "id int, v string")
    diffs = Reconciliation(TablePair("my_table", left, right), cfg()).top_differences()
    plain, packed = sinks.shared_dir(spark, "csv-test"), sinks.shared_dir(spark, "csv-test")
    sinks.export_differences_csv(diffs, plain)
    sinks.export_differences_csv(diffs, packed, compression="gzip")
    assert len(_data_files(plain, ".csv")) > 0 and len(_data_files(packed, ".csv.gz")) > 0
    assert not _data_files(packed, ".csv") and not _data_files(plain, ".csv.gz")
    got = [sorted(map(tuple, sinks.read_differences_csv(spark, p).collect()), key=str) for p in (plain, packed)]
    assert got[0] == got[1] and len(got[0]) == 5


def _data_files(path, suffix):
    return [os.path.join(d, f) for d, _, names in os.walk(path) for f in names if f.endswith(suffix)]


def _lineitem(spark, path, orders):
    """Four rows an order, of every kind of drift; a third of the orders is folded into one key."""
    spark.range(4 * orders).selectExpr(
        "id div 4 as l_orderkey", "(id * 7919) % 2000 as l_partkey", "(id * 31) % 100 as l_suppkey", "cast(id % 4 + 1 as int) as l_linenumber",
        "cast(id % 50 + 1 as double) as l_quantity", "((id * 104729) % 9000000) / 100D as l_extendedprice",
        "(id % 11) / 100D as l_discount", "(id % 9) / 100D as l_tax", "if(id % 3 = 0, null, 'R') as l_returnflag", "if(id % 2 = 0, 'F', 'O') as l_linestatus",
        "timestamp_ntz'1998-12-01 00:00:00' + make_dt_interval(cast(id % 700 as int)) as l_shipdate",
    ).write.parquet(f"{path}/lineitem.parquet")


@pytest.mark.parametrize("limit", ["10485760", "0"])  # duplicate keys broadcast, or dealt out by key
def test_dup_key_export_takes_a_fraction_of_its_text_and_leaves_only_that(spark, tmp_path, monkeypatch, limit):
    """Every difference is in the files, which were as large as their text before: several lines per input row."""
    _lineitem(spark, tmp_path, 1500)
    monkeypatch.setattr(sinks, "checkpoint_root", lambda _: str(tmp_path / "kept"))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    try:
        rec = Reconciliation(FX.lineitem_hot_pair(spark, str(tmp_path)), catalog.cfg())
        assert rec.dealt() == (limit == "0")
        lines = catalog._lines(rec.all_differences())
        plain = sinks.shared_dir(spark, "csv-test")
        sinks.export_differences_csv(lines, plain)
        want = sorted(map(tuple, lines.collect()), key=str)
        rec.close()
        kept = set(os.listdir(tmp_path / "kept"))
        out = catalog.q_dup_key_export(spark, str(tmp_path))
        got = sorted(map(tuple, out.select(*lines.columns).collect()), key=str)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert got == want and len(want) > 6000
    size = lambda files: sum(map(os.path.getsize, files))
    packed = [f.removeprefix("file:") for f in out.inputFiles()]
    assert 3 * size(packed) < size(_data_files(plain, ".csv"))
    assert [d.split("-")[0] for d in set(os.listdir(tmp_path / "kept")) - kept] == ["differences"]


def test_latest_runs_keeps_ten(spark):
    df = spark.range(0, 300).selectExpr("cast(id % 15 as string) as run_id", "id")
    kept = sinks.latest_runs(df, keep=10)
    runs = sorted({r.run_id for r in kept.select("run_id").collect()})
    assert runs == sorted(sorted({str(i) for i in range(15)})[-10:])
    assert kept.count() == 200


def test_run_writes_partitioned_tables(spark):
    left = spark.createDataFrame([(1, "a"), (2, "b")], "id int, v string")
    right = spark.createDataFrame([(1, "a"), (3, "c")], "id int, v string")
    res = run([TablePair("t", left, right)], cfg(run_id="r1"))
    root = sinks.shared_dir(spark, "run-test")
    res.write(root)
    for name in res.frames:
        assert name in RESULT_TABLES or name in ("record_stats", "missing_totals", "retention_count")
        back = sinks.read_results(spark, f"{root}/{name}", res[name].schema)
        expected = {"r1"} if res[name].count() else set()
        assert {r.run_id for r in back.select("run_id").distinct().collect()} == expected
        assert back.count() == res[name].count()
    res.close()


def test_cli_runs_a_config(spark, tmp_path, capsys):
    out = sinks.shared_dir(spark, "cli-out")
    conf = {
        "as_of": "2001-08-01 00:00:00",
        "window": {"enabled": True, "days": 2000},
        "output": out,
        "tables": [{"name": "customer", "keys": ["c_custkey"],
                    "left": {"parquet": f"{SF001}/customer.parquet"},
                    "right": {"parquet": f"{SF001}/customer.parquet"}}],
    }
    path = tmp_path / "conf.json"
    path.write_text(json.dumps(conf))
    assert main([str(path)]) == 0
    printed = json.loads(capsys.readouterr().out.strip().splitlines()[-1])
    assert printed["tables"][0]["status"] == "OK"
    assert printed["summary"]["tables_with_mismatches"] == 0
    assert os.path.isdir(os.path.join(out, "column_stats"))


def test_cli_exit_code_on_failed_table(spark, tmp_path, capsys):
    conf = {
        "as_of": "2001-08-01 00:00:00",
        "tables": [{"name": "bad", "keys": ["no_such_key"],
                    "left": {"parquet": f"{SF001}/customer.parquet"},
                    "right": {"parquet": f"{SF001}/customer.parquet"}}],
    }
    path = tmp_path / "bad.json"
    path.write_text(json.dumps(conf))
    assert main([str(path)]) == 1
    printed = json.loads(capsys.readouterr().out.strip().splitlines()[-1])
    assert printed["tables"][0]["status"] == "ERROR"


def test_cli_exports_every_difference(spark, tmp_path, capsys):
    for side, shift in (("left", 0), ("right", 1)):
        spark.range(250).selectExpr("id", f"cast(id + {shift} as string) as v").write.parquet(str(tmp_path / side))
    spark.range(130).selectExpr("id as k", "cast(id as string) as w").write.parquet(str(tmp_path / "other_left"))
    spark.range(130).selectExpr("id as k", "'x' as w").write.parquet(str(tmp_path / "other_right"))
    sides = lambda p: {s: {"parquet": str(tmp_path / f"{p}{s}")} for s in ("left", "right")}
    conf = {"as_of": "2001-08-01 00:00:00", "max_differences": 100, "export_csv": str(tmp_path / "csv"),
            "tables": [{"name": "t", **sides("")}, {"name": "other", "keys": ["k"], **sides("other_")},
                       {"name": "bad", "keys": ["no_such_key"], **sides("")}]}
    path = tmp_path / "conf.json"
    path.write_text(json.dumps(conf))
    assert main([str(path)]) == 1  # the bad table
    got = [(r.table_name, r.record_id, r.left_value, r.right_value)
           for r in sinks.read_differences_csv(spark, str(tmp_path / "csv")).collect()]
    assert len(got) == 380
    assert set(got) == {("t", str(i), str(i), str(i + 1)) for i in range(250)} | {("other", str(i), str(i), "x") for i in range(130)}


def test_jdbc_partitioned_read_needs_bounds(spark):
    import pytest
    from concord.sources.readers import read_jdbc
    with pytest.raises(ValueError):
        read_jdbc(spark, "jdbc:postgresql://example.invalid/db", "t", partition_column="id")
