"""Writing result tables: Parquet per run, CSV export, keeping recent runs.

All output paths must be on storage every executor can reach (the cluster's
shared folder); :func:`shared_dir` derives one from ``spark.checkpoint.dir``.
"""

from __future__ import annotations

import os
import uuid
from typing import Optional

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


# A NULL marker distinct from the empty string, so '' survives a round trip.
NULL_MARK = "\\N"
DIFFERENCE_COLUMNS = ("table_name", "column_name", "record_id", "left_value", "right_value")
#: Of the linear form: rows of either side with the value, and differing row pairs.
COUNT_COLUMNS = ("left_rows", "right_rows", "pairs")


def checkpoint_root(spark: SparkSession) -> Optional[str]:
    """The shared folder the session names in ``spark.checkpoint.dir``."""
    value = spark.conf.get("spark.checkpoint.dir", None)
    return value or None


def shared_dir(spark: SparkSession, name: str) -> str:
    """A fresh sub-folder of the shared checkpoint folder."""
    root = checkpoint_root(spark)
    if root is None:
        raise RuntimeError("spark.checkpoint.dir is not set; no shared folder to write to")
    return os.path.join(root, f"{name}-{uuid.uuid4().hex[:12]}")


def delete_path(spark: SparkSession, path: str) -> bool:
    """Remove a scratch folder this engine wrote (through Hadoop's file
    system, so it works on any shared storage the session can write)."""
    at, fs = _file_system(spark, path)
    return bool(fs.delete(at, True))


def _file_system(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def path_exists(spark: SparkSession, path: str) -> bool:
    at, fs = _file_system(spark, path)
    return bool(fs.exists(at))


def subfolders(spark: SparkSession, path: str) -> list[str]:
    """Names of the folders in a folder (none where it does not exist)."""
    at, fs = _file_system(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(at) if s.isDirectory()) if fs.exists(at) else []


def write_results(df: DataFrame, path: str, partition_by=("run_id",), mode: str = "overwrite") -> None:
    """Persist one result table, partitioned by run (one folder per run).

    ``overwrite`` replaces the partitions that ``df`` has rows for, and no
    others, so a run that is written again does not count twice.
    """
    (df.write.mode(mode).option("partitionOverwriteMode", "dynamic")
     .partitionBy(*partition_by).parquet(path))


def read_results(spark: SparkSession, path: str, schema=None) -> DataFrame:
    """Read a result table back; pass ``schema`` to read a table that may
    have no rows yet (an empty partitioned write leaves no files)."""
    reader = spark.read if schema is None else spark.read.schema(schema)
    return reader.parquet(path)


def export_differences_csv(diffs: DataFrame, path: str, compression: Optional[str] = None) -> None:
    """CSV of differences, every field quoted and inner quotes doubled.

    One folder per ``table_name`` / ``column_name`` (partition columns), so
    names containing underscores are never split apart. Counts of rows and
    pairs are written where ``diffs`` has them. Complete differences are several
    lines per input row and much alike: with ``compression="gzip"`` the files
    (``.csv.gz``) are a fraction of the text, and read back the same way.
    """
    packed = {"compression": compression} if compression else {}
    (diffs.select(*DIFFERENCE_COLUMNS, *[c for c in COUNT_COLUMNS if c in diffs.columns])
     .write.mode("overwrite")
     .option("header", True).option("quoteAll", True).option("escape", '"')
     .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False)
     .option("nullValue", NULL_MARK).options(**packed)
     .partitionBy("table_name", "column_name")
     .csv(path))


def read_differences_csv(spark: SparkSession, path: str, counts: bool = False) -> DataFrame:
    """An export of differences read back; ``counts``: with the counts of rows and pairs that it was written with."""
    more = ", left_rows long, right_rows long, pairs decimal(38,0)" if counts else ""
    schema = f"record_id string, left_value string, right_value string{more}, table_name string, column_name string"
    return (spark.read.option("header", True).option("escape", '"').option("multiLine", True)
            .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False)
            .option("nullValue", NULL_MARK).option("basePath", path).option("enforceSchema", True)
            .schema(schema).csv(path))


def latest_runs(results: DataFrame, keep: int = 10, run_col: str = "run_id") -> DataFrame:
    """Rows of the ``keep`` most recent runs (run ids sort by time).

    The distinct run ids are few (one per run), so the top-k over them is
    tiny; the rows themselves are filtered with a semi join, never sorted.
    """
    recent = results.select(run_col).distinct().orderBy(F.col(run_col).desc()).limit(keep)
    return results.join(F.broadcast(recent), run_col, "left_semi")
