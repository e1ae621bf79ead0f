"""Honest statuses: empty sides, no common columns, schema drift, errors."""

import pytest

from concord import Reconciliation, TablePair
from concord.plans.prepare import EMPTY_RIGHT, NO_COMMON_COLUMNS
from concord.plans.run import run
from concord.sources.schema import schema_diff
from helpers import cfg


def test_empty_right(spark):
    left = spark.createDataFrame([(1, "a")], "id int, v string")
    rec = Reconciliation(TablePair("t", left, left.limit(0)), cfg())
    assert rec.status() == EMPTY_RIGHT
    assert rec.column_stats().count() == 0
    assert rec.missing_totals().collect()[0].missing_in_right == 1


def test_no_common_columns(spark):
    left = spark.createDataFrame([(1,)], "a int")
    right = spark.createDataFrame([(1,)], "b int")
    rec = Reconciliation(TablePair("t", left, right, keys=("a",)), cfg())
    assert rec.prep.status == NO_COMMON_COLUMNS
    assert rec.column_stats().count() == 0


def test_missing_key_column_raises(spark):
    df = spark.createDataFrame([(1, "a")], "x int, v string")
    with pytest.raises(ValueError):
        Reconciliation(TablePair("t", df, df, keys=("id",)), cfg())


def test_run_reports_error_instead_of_zeros(spark):
    good = spark.createDataFrame([(1, "a")], "id int, v string")
    bad = TablePair("bad", good.drop("id").withColumn("x", good.v), good, keys=("x",))
    res = run([TablePair("good", good, good), bad], cfg())
    status = {r.table_name: r.status for r in res["table_status"].collect()}
    assert status == {"good": "OK", "bad": "ERROR"}


def test_schema_diff(spark):
    left = spark.createDataFrame([(1, "a", 1.0)], "id int, v string, p double")
    right = spark.createDataFrame([(1, 2, "x")], "id int, v int, extra string")
    got = {r.column_name: r.status for r in schema_diff(spark, left, right).collect()}
    assert got == {"id": "both", "v": "type_differs", "p": "left_only", "extra": "right_only"}


def test_column_mapping(spark):
    left = spark.createDataFrame([(1, "a")], "id int, v string")
    right = spark.createDataFrame([(1, "a")], "id int, w string")
    rec = Reconciliation(TablePair("t", left, right, column_mapping={"v": "w"}), cfg())
    assert [r.column_name for r in rec.column_stats().collect()] == ["v"]


def test_close_removes_written_tables(spark):
    import os
    from concord.config import RunConfig
    from datetime import datetime
    df = spark.createDataFrame([(1, "a"), (2, "b"), (2, "c")], "id int, v string")
    rec = Reconciliation(TablePair("t", df, df), RunConfig(as_of=datetime(2001, 8, 1), materialize="table"))
    rec.column_stats().collect()
    paths = [df.written_to for df in (rec.drift(), rec.duplicate_keys(), rec.tuples())]
    assert paths and all(os.path.isdir(p.replace("file:", "")) for p in paths)
    rec.close()
    assert not any(os.path.isdir(p.replace("file:", "")) for p in paths)
