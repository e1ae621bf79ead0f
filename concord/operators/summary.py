"""Per-table and per-run roll-ups (A6-A9b, F8-F12).

All inputs are small result tables (a row per table or per column), so
these are cheap aggregates; they are still DataFrames so a run's summary
can be written next to its details.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from concord.config import FAILED_BELOW
from concord.functions import format as FM
from concord.plans.prepare import EMPTY_BOTH, EMPTY_LEFT, EMPTY_RIGHT, OK


#: Statuses of tables that were compared (an empty side compares as nothing in common).
COMPARED = (OK, EMPTY_LEFT, EMPTY_RIGHT, EMPTY_BOTH)

#: Columns of the parts that :func:`table_summary` folds.
PARTS = {
    "record_counts": "table_name string, left_total long, right_total long, difference long, status string",
    "record_stats": "table_name string, total_records decimal(38,0), matching_records decimal(38,0), mismatched_records decimal(38,0)",
    "missing_totals": "table_name string, missing_in_right long, missing_in_left long",
    "date_scenarios": "table_name string, scenario int, left_count long, right_count long, difference long, status string",
    "column_stats": "table_name string, column_name string, matches decimal(38,0), mismatches decimal(38,0), "
                    "null_left decimal(38,0), null_right decimal(38,0), match_rate double, band string, failed boolean",
    "field_differences": "table_name string, column_name string, record_id string, left_value string, right_value string, "
                         "pairs decimal(38,0), rn int",
    "missing_records": "table_name string, side string, record_id string, created_date string, last_modified string, rn int",
    "retention_count": "table_name string, retention_days int, total_old_records long, deleted_records long, not_deleted long, "
                       "status string",
    "retention_violations": "table_name string, record_id string, creation_time string, last_modified_time string, rn int",
}


def table_summary(record_counts: DataFrame, record_stats: DataFrame, missing_totals: DataFrame,
                  scenarios: DataFrame, retention: DataFrame, status: DataFrame) -> DataFrame:
    """One row per table, folded from the per-table results.

    The parts are unioned and grouped by ``table_name`` (each column is set
    by exactly one part), so no join is needed. ``has_mismatch``: counts
    differ or some joined record differs (the reference's flag; it ignores
    missing rows). ``perfect_match``: counts equal, scenarios equal, nothing
    missing either way, every joined record matching. Only tables that were
    read and compared (``COMPARED``) have a rate or a clean bill; of others,
    ``has_mismatch`` is NULL and ``perfect_match`` false.
    """
    parts = [
        record_counts.select("table_name", "left_total", "right_total", "status_counts"),
        record_stats.select("table_name", "total_records", "matching_records", "mismatched_records"),
        missing_totals.select("table_name", "missing_in_right", "missing_in_left"),
        scenarios.groupBy("table_name").agg(F.bool_and(F.col("difference") == 0).alias("scenarios_equal")),
        retention.select("table_name", "not_deleted"),
        status.select("table_name", "status"),
    ]
    folded = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    value_cols = [c for c in folded.columns if c != "table_name"]
    t = folded.groupBy("table_name").agg(*[F.max(c).alias(c) for c in value_cols])
    counts_differ = F.col("left_total") != F.col("right_total")
    has_mismatch = counts_differ | (F.col("mismatched_records") > 0)
    failed = ~F.col("status").isin(*COMPARED)  # nothing was compared: neither a rate nor a clean bill
    perfect = (
        ~failed & ~counts_differ
        & F.coalesce(F.col("scenarios_equal"), F.lit(True))
        & (F.col("missing_in_right") == 0) & (F.col("missing_in_left") == 0)
        & (F.col("mismatched_records") == 0)
    )
    return t.select(
        "table_name", "status", "left_total", "right_total", F.col("status_counts").alias("count_status"),
        "total_records", "matching_records", "mismatched_records",
        F.when(~failed, FM.match_rate(F.col("matching_records"), F.col("total_records"))).alias("record_match_rate"),
        "missing_in_right", "missing_in_left", "scenarios_equal", "not_deleted",
        F.when(~failed, has_mismatch).alias("has_mismatch"), F.when(failed, False).otherwise(perfect).alias("perfect_match"),
    )


def run_summary(tables: DataFrame, cfg=None) -> DataFrame:
    """Run totals over the per-table summary rows (A7, A9b), with the run's
    time window (enabled, start, end, days) when ``cfg`` is given."""
    out = tables.agg(
        F.count(F.lit(1)).alias("total_tables"),
        F.count_if(F.col("has_mismatch")).alias("tables_with_mismatches"),
        F.count_if(~F.col("status").isin(*COMPARED)).alias("tables_failed"),
        F.coalesce(F.sum("left_total"), F.lit(0)).cast("long").alias("total_left_records"),
        F.coalesce(F.sum("right_total"), F.lit(0)).cast("long").alias("total_right_records"),
        F.coalesce(F.sum("missing_in_right"), F.lit(0)).cast("long").alias("total_missing_in_right"),
        F.coalesce(F.sum("missing_in_left"), F.lit(0)).cast("long").alias("total_missing_in_left"),
        F.coalesce(F.sum("not_deleted"), F.lit(0)).cast("long").alias("total_not_deleted"),
    )
    if cfg is None:
        return out
    start, end = cfg.window_bounds()
    fmt = "%Y-%m-%d %H:%M:%S"
    return out.select(
        "*",
        F.lit(bool(cfg.window_enabled)).alias("window_enabled"),
        F.lit(start.strftime(fmt) if start else None).cast("string").alias("window_start"),
        F.lit(end.strftime(fmt) if end else None).cast("string").alias("window_end"),
        F.lit((end - start).days if start else None).cast("int").alias("window_days"),
    )


def column_failure_stats(column_stats: DataFrame) -> DataFrame:
    """Columns compared, columns under 95 %, and the column success rate (A8)."""
    agg = column_stats.agg(
        F.count(F.lit(1)).alias("total_columns"),
        F.count_if(F.col("match_rate") < F.lit(FAILED_BELOW)).alias("failed_columns"),
    )
    rate = FM.match_rate(F.col("total_columns") - F.col("failed_columns"), F.col("total_columns"))
    return agg.select(
        F.col("total_columns").cast("long").alias("total_columns"),
        F.col("failed_columns").cast("long").alias("failed_columns"),
        rate.alias("success_rate"),
        FM.one_decimal(rate).alias("success_rate_1dp"),
        FM.overall_band(rate).alias("band"),
    )


def table_kpis(tables: DataFrame) -> DataFrame:
    """Per-table KPI line: totals, missing both ways, not-deleted (A9)."""
    return tables.select(
        "table_name", "left_total", "right_total", "missing_in_right", "missing_in_left",
        F.coalesce(F.col("not_deleted"), F.lit(0)).cast("long").alias("not_deleted"),
        FM.thousands(F.col("left_total")).alias("left_total_text"),
        FM.thousands(F.col("right_total")).alias("right_total_text"),
        F.upper(F.col("table_name")).alias("title"),
    )
