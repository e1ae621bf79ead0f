"""NULL / blank profile of compared columns (P8), and the window extract (P6).

NULL means NULL or NaN; blank means a non-NULL string that is empty after
removing outer whitespace. Each side is one scan with a partial aggregate
(no shuffle of rows); the one-row result is unpivoted to one row per
(column, side).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from concord.functions import canon as C
from concord.functions import timecols as TC
from concord.plans.prepare import Prepared
from concord.sources.schema import quoted


def null_empty_profile(prep: Prepared) -> DataFrame:
    def side(df: DataFrame, types, label: str) -> DataFrame:
        aggs = [F.count(F.lit(1)).alias("rows")]
        for i, (c, t) in enumerate(zip(prep.value_cols, types)):
            v = C.align(F.col(quoted(c)), t, prep.aligned[i])
            aggs.append(F.count_if(C.canon(v, prep.aligned[i]).isNull()).alias(f"z_{i}"))
            aggs.append(F.count_if(C.is_blank(v, prep.aligned[i])).alias(f"b_{i}"))
        one = df.agg(*aggs)
        rows = [
            F.struct(F.lit(c).alias("column_name"), F.col(f"z_{i}").alias("nulls"), F.col(f"b_{i}").alias("blanks"))
            for i, c in enumerate(prep.value_cols)
        ]
        return one.select(F.col("rows"), F.inline(F.array(*rows))).select(
            F.lit(prep.name).alias("table_name"), "column_name", F.lit(label).alias("side"),
            F.col("rows").cast("long").alias("rows"), F.col("nulls").cast("long").alias("nulls"),
            F.col("blanks").cast("long").alias("blanks"),
            (F.col("rows") - F.col("nulls") - F.col("blanks")).cast("long").alias("filled"),
        )

    return side(prep.left, prep.left_types, "left").unionByName(side(prep.right, prep.right_types, "right"))


def window_extract(prep: Prepared) -> DataFrame:
    """Keys and created time of the rows each side keeps after the window."""
    def side(df: DataFrame, label: str) -> DataFrame:
        key = F.struct(*[F.col(quoted(k)) for k in prep.keys])
        created = (TC.fmt_time(F.col(quoted(prep.created)), df.schema[prep.created].dataType)
                   if prep.created else F.lit("N/A"))
        return df.select(F.lit(prep.name).alias("table_name"), F.lit(label).alias("side"),
                         C.record_id(key, prep.keys).alias("record_id"), created.alias("creation_time"))
    return side(prep.left, "left").unionByName(side(prep.right, "right"))
