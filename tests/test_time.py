"""Time columns: detection, inclusive window edges, strict retention, defaults."""

from datetime import datetime, timedelta

from concord import Reconciliation, TablePair
from concord.config import RunConfig
from concord.functions.timecols import CREATED_CANDIDATES, MODIFIED_CANDIDATES, detect
from concord.operators import retention as RET
from concord.plans.prepare import NO_TIME_COLUMNS, prepare

AS_OF = datetime(2001, 8, 1, 12, 0, 0)


def test_detection_order():
    assert detect(["x", "created_at", "creation_time"], CREATED_CANDIDATES) == "creation_time"
    assert detect(["update_time", "updated_at"], MODIFIED_CANDIDATES) == "updated_at"
    assert detect(["x"], CREATED_CANDIDATES) is None


def test_created_only_table(spark):
    df = spark.sql("select 1 as id, timestamp_ntz'2001-07-30 00:00:00' as created_at")
    prep = prepare(TablePair("t", df, df), RunConfig(as_of=AS_OF, window_enabled=True))
    assert prep.created == "created_at" and prep.modified is None
    missing = Reconciliation(TablePair("t", df, df.limit(0)), RunConfig(as_of=AS_OF)).missing().collect()
    assert missing[0].created_date == "2001-07-30 00:00:00" and missing[0].last_modified == "N/A"


def test_window_edges_inclusive(spark):
    start = AS_OF - timedelta(days=45)
    times = [start - timedelta(seconds=1), start, start + timedelta(seconds=1),
             AS_OF - timedelta(seconds=1), AS_OF, AS_OF + timedelta(seconds=1)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(times)], "id int, creation_time timestamp_ntz")
    rec = Reconciliation(TablePair("t", df, df), RunConfig(as_of=AS_OF, window_enabled=True, window_days=45))
    c = rec.record_counts().collect()[0]
    assert c.left_total == 4       # both ends included, one second outside excluded


def test_bad_days_fall_back_to_45():
    for days in (None, 0, -3):
        cfg = RunConfig(as_of=AS_OF, window_enabled=True, window_days=days, retention_days=days)
        start, end = cfg.window_bounds()
        assert end - start == timedelta(days=45)
        assert cfg.retention_threshold() == AS_OF - timedelta(days=45)


def test_retention_is_strict_and_needs_both(spark):
    t = AS_OF - timedelta(days=45)
    rows = [(1, t - timedelta(seconds=1), t - timedelta(seconds=1)),   # old: counted
            (2, t, t - timedelta(days=1)),                             # created at threshold: not old
            (3, t - timedelta(days=9), None),                          # NULL modified: excluded
            (4, t - timedelta(days=9), t + timedelta(days=1))]         # recently modified
    df = spark.createDataFrame(rows, "id int, creation_time timestamp_ntz, last_modified_time timestamp_ntz")
    pair = TablePair("t", df, df)
    cfg = RunConfig(as_of=AS_OF)
    assert RET.retention_count(pair, cfg).collect()[0].not_deleted == 1
    assert [r.record_id for r in RET.retention_sample(pair, cfg).collect()] == ["1"]


def test_no_time_columns(spark):
    df = spark.createDataFrame([(1, "a")], "id int, v string")
    pair = TablePair("t", df, df)
    cfg = RunConfig(as_of=AS_OF, window_enabled=True)
    rec = Reconciliation(pair, cfg)
    assert rec.prep.window_status == NO_TIME_COLUMNS
    assert {r.status for r in rec.date_scenarios().collect()} == {NO_TIME_COLUMNS}
    assert RET.retention_count(pair, cfg).collect()[0].status == NO_TIME_COLUMNS


def test_date_columns_keep_what_timestamps_would(spark):
    days = "array('2001-07-30', '2001-07-31', '2001-08-01', '2001-08-02')"
    for as_of in (AS_OF, datetime(2001, 8, 1)):
        got = []
        for kind in ("date", "timestamp_ntz"):
            df = spark.sql(f"select row_number() over (order by x) as id, cast(x as {kind}) as created_at, "
                           f"cast(x as {kind}) as updated_at from (select explode({days}) as x)")
            cfg = RunConfig(as_of=as_of, window_enabled=True, window_days=1, retention_days=1)
            kept = sorted(r.id for r in prepare(TablePair("t", df, df), cfg).left.collect())
            got.append((kept, RET.retention_count(TablePair("t", df, df), cfg).first().total_old_records))
        assert got[0] == got[1]
