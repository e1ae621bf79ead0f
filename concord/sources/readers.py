"""Readers for the two sides of a pair.

Every reader returns a lazy DataFrame; filters and column choices made later
are pushed into the scan by Catalyst (Parquet ``PushedFilters`` /
``ReadSchema``; JDBC ``WHERE`` and column list).
"""

from __future__ import annotations

import os
from typing import Mapping, Optional

from pyspark.sql import DataFrame, SparkSession


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def read_table(spark: SparkSession, name: str) -> DataFrame:
    """A catalog table (Hive / Delta / Iceberg, whatever the session has)."""
    return spark.read.table(name)


def testdata_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def read_jdbc(
    spark: SparkSession,
    url: str,
    table: str,
    *,
    partition_column: Optional[str] = None,
    lower_bound: Optional[int] = None,
    upper_bound: Optional[int] = None,
    num_partitions: Optional[int] = None,
    fetch_size: int = 10_000,
    query_timeout_s: int = 600,
    options: Optional[Mapping[str, str]] = None,
) -> DataFrame:
    """A JDBC table read in parallel slices of a numeric key.

    Credentials come from ``options`` (``user`` / ``password``) or the
    caller's environment; nothing is hard-coded. Without a partition column
    the read is one task, so pass the numeric key and its bounds for any
    table of size. ``queryTimeout`` applies the configured per-query limit.
    """
    reader = (
        spark.read.format("jdbc")
        .option("url", url)
        .option("dbtable", table)
        .option("fetchsize", str(fetch_size))
        .option("queryTimeout", str(query_timeout_s))
    )
    if partition_column is not None:
        if lower_bound is None or upper_bound is None or not num_partitions:
            raise ValueError("partition_column needs lower_bound, upper_bound and num_partitions")
        reader = (
            reader.option("partitionColumn", partition_column)
            .option("lowerBound", str(lower_bound))
            .option("upperBound", str(upper_bound))
            .option("numPartitions", str(num_partitions))
        )
    for key, value in (options or {}).items():
        reader = reader.option(key, value)
    return reader.load()
