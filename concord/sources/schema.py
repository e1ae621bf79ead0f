"""Schema inspection: column lists, name mapping, and a side-by-side diff.

Schemas are metadata, so these frames are built from ``df.schema`` on the
driver (a handful of rows per table); no table data is read.
"""

from __future__ import annotations

from typing import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

SCHEMA_ROW = T.StructType([
    T.StructField("ordinal", T.IntegerType(), False),
    T.StructField("column_name", T.StringType(), False),
    T.StructField("data_type", T.StringType(), False),
])


def quoted(name: str) -> str:
    """The name as one column reference, whatever dots or backticks it has."""
    return "`" + name.replace("`", "``") + "`"


def apply_mapping(right: DataFrame, mapping: Mapping[str, str]) -> DataFrame:
    """Rename right columns to their left names (``mapping``: left -> right).

    A right column that has a mapped left name without being mapped itself
    gives way to the one that the mapping names.
    """
    inverse = {r: l for l, r in mapping.items() if r in right.columns}
    if not inverse:
        return right
    names = [c for c in right.columns if c in inverse or c not in inverse.values()]
    return right.select(*[F.col(quoted(c)).alias(inverse.get(c, c)) for c in names])


def common_columns(left: DataFrame, right: DataFrame) -> list[str]:
    """Names present on both sides (case-sensitive), in the left's order."""
    right_names = set(right.columns)
    return [c for c in left.columns if c in right_names]


def schema_frame(spark: SparkSession, df: DataFrame) -> DataFrame:
    rows = [(i + 1, f.name, f.dataType.simpleString()) for i, f in enumerate(df.schema.fields)]
    return spark.createDataFrame(rows, SCHEMA_ROW)


def schema_diff(spark: SparkSession, left: DataFrame, right: DataFrame,
                table_name: str = "") -> DataFrame:
    """Names and types of both sides with a status per column.

    status: ``both`` (same type), ``type_differs``, ``left_only``, ``right_only``.
    """
    l = schema_frame(spark, left).select(
        "column_name", F.col("ordinal").alias("left_ordinal"), F.col("data_type").alias("left_type"))
    r = schema_frame(spark, right).select(
        "column_name", F.col("ordinal").alias("right_ordinal"), F.col("data_type").alias("right_type"))
    j = l.join(r, "column_name", "full_outer")
    status = (
        F.when(F.col("right_type").isNull(), F.lit("left_only"))
        .when(F.col("left_type").isNull(), F.lit("right_only"))
        .when(F.col("left_type") == F.col("right_type"), F.lit("both"))
        .otherwise(F.lit("type_differs"))
    )
    return j.select(
        F.lit(table_name).alias("table_name"), "column_name", "left_ordinal", "left_type",
        "right_ordinal", "right_type", status.alias("status"),
    )
