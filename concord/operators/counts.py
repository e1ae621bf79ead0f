"""Record counts and created-vs-modified date scenarios (A1-A3, A12).

Each side is scanned once for all four numbers (count plus the three
scenario counts), with the window predicate pushed into the scan and
partial aggregation before a one-row exchange. The two one-row results are
unioned and folded into one row; no join is needed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from concord.functions import format as FM
from concord.functions import timecols as TC
from concord.plans.prepare import NO_TIME_COLUMNS, Prepared
from concord.sources.schema import quoted


def _side_counts(df: DataFrame, side: int, created, modified) -> DataFrame:
    aggs = [F.count(F.lit(1)).alias("total")]
    if created is not None and modified is not None:
        s1, s2, s3 = TC.scenario_flags(F.col(quoted(created)), F.col(quoted(modified)))
        aggs += [F.count_if(s1).alias("s1"), F.count_if(s2).alias("s2"), F.count_if(s3).alias("s3")]
    else:
        aggs += [F.lit(None).cast("long").alias(n) for n in ("s1", "s2", "s3")]
    return df.agg(*aggs).withColumn("side", F.lit(side))


def side_counts(prep: Prepared) -> DataFrame:
    """One row: left/right totals and scenario counts."""
    both = _side_counts(prep.left, 0, prep.created, prep.modified).unionByName(
        _side_counts(prep.right, 1, prep.created, prep.modified))

    def pick(col: str, side: int):
        return F.max(F.when(F.col("side") == side, F.col(col)))

    return both.agg(*[
        pick(c, s).alias(f"{c}_{'l' if s == 0 else 'r'}")
        for c in ("total", "s1", "s2", "s3") for s in (0, 1)
    ])


def record_counts(prep: Prepared, counts: DataFrame) -> DataFrame:
    diff = F.col("total_l") - F.col("total_r")
    return counts.select(
        F.lit(prep.name).alias("table_name"),
        F.col("total_l").cast("long").alias("left_total"),
        F.col("total_r").cast("long").alias("right_total"),
        diff.cast("long").alias("difference"),
        FM.count_status(diff).alias("status"),
    )


def date_scenarios(prep: Prepared, counts: DataFrame) -> DataFrame:
    has_time = prep.created is not None and prep.modified is not None
    rows = [
        F.struct(F.lit(i).alias("scenario"), F.col(f"s{i}_l").alias("left_count"), F.col(f"s{i}_r").alias("right_count"))
        for i in (1, 2, 3)
    ]
    diff = F.col("left_count") - F.col("right_count")
    status = FM.count_status(diff) if has_time else F.lit(NO_TIME_COLUMNS)
    return counts.select(F.inline(F.array(*rows))).select(
        F.lit(prep.name).alias("table_name"),
        "scenario",
        F.col("left_count").cast("long").alias("left_count"),
        F.col("right_count").cast("long").alias("right_count"),
        diff.cast("long").alias("difference"),
        status.alias("status"),
    )
