"""Session settings the engine relies on.

On a cluster the session comes from the platform; :func:`tune` only adds
settings that are unset. :func:`local_session` is for tests and the bench.
"""

from __future__ import annotations

import os
import tempfile
from typing import Optional

from pyspark.sql import SparkSession

# Settings the plans assume: adaptive execution re-plans joins and partition
# counts at run time from measured sizes, and splits skewed partitions.
RECOMMENDED = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    # coalesce shuffle partitions toward the advisory size, not toward the
    # default parallelism, so partitions stay spill-friendly at any scale
    "spark.sql.adaptive.coalescePartitions.parallelismFirst": "false",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "128m",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
}


def tune(spark: SparkSession) -> SparkSession:
    for key, value in RECOMMENDED.items():
        if spark.conf.get(key, None) is None:
            spark.conf.set(key, value)
    return spark


def ensure_checkpoint_dir(spark: SparkSession, fallback: Optional[str] = None) -> str:
    """Use the session's ``spark.checkpoint.dir``; set one only when unset
    (tests and local runs), under ``fallback`` or a fresh temp folder. On a
    cluster a temp folder is another disk on every machine, so there the
    setting is required."""
    current = spark.conf.get("spark.checkpoint.dir", None)
    if current:
        if spark.sparkContext.getCheckpointDir() is None:
            spark.sparkContext.setCheckpointDir(current)
        return current
    if fallback is None and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    path = fallback or tempfile.mkdtemp(prefix="concord-ckpt-")
    spark.conf.set("spark.checkpoint.dir", path)
    spark.sparkContext.setCheckpointDir(path)
    return path


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, app: str = "concord") -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        # a call site per Column costs more than the Column; it can be set only before the session starts
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.driver.memory", os.environ.get("CONCORD_DRIVER_MEMORY", "16g"))
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return tune(spark)
