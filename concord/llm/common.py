"""Helpers shared by the operators: shared folder, lineage cuts, row keys, components."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows per Arrow batch: texts may be long, so batches are kept short.
BATCH_ROWS = 512


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (``spark.checkpoint.dir``).

    Where the setting is absent a temp folder is used, but only for a local
    master; on a cluster that would be another disk on every machine.
    """
    sc = spark.sparkContext
    path = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not path:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        path = tempfile.mkdtemp(prefix="concord-llm-")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(path)
    return path.rstrip("/")


def scratch(spark: SparkSession, what: str) -> str:
    """A fresh folder name under the shared folder."""
    return f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """Materialize in the shared folder and cut the lineage."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame, what: str) -> tuple[DataFrame, str]:
    """``df`` as a Parquet table in the shared folder, read again, and its place; its user removes it by :func:`remove`."""
    spark = df.sparkSession
    path = scratch(spark, what)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def remove(spark: SparkSession, *paths: str) -> None:
    """Delete scratch folders, through Hadoop's file systems."""
    jvm = spark.sparkContext._jvm
    for path in paths:
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def arrow_batches(spark: SparkSession) -> None:
    """Short Arrow batches, unless the session chose a size itself; Python workers find this package."""
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    env = spark.sparkContext.environment
    if root not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (root, env.get("PYTHONPATH")) if x)
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000":
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def text_key(text: Column) -> Column:
    """Tells rows that share an id but not the text apart (NULL counts as empty)."""
    return F.xxhash64(F.coalesce(text, F.lit("")))


def remainder(doc_id: Column, n: int) -> Column:
    """crc32 of the id's decimal text, modulo n (NULL ids: of the empty text)."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % n


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def unused(names, *wanted: str) -> list[str]:
    """The ``wanted`` column names, each prefixed until none of ``names`` is like it (case ignored)."""
    taken = {x.lower() for x in names}
    out = []
    for name in wanted:
        while name.lower() in taken:
            name = "_" + name
        out.append(name)
    return out


def same_row(docs: DataFrame, key: DataFrame, doc_id: str, key_name: str) -> Column:
    """Join condition of ``docs`` and the columns of ``key`` that hold the id and the text key."""
    return docs["doc_id"].eqNullSafe(key[doc_id]) & (text_key(docs["text"]) == key[key_name])


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Connected components of ``edges (a, b)``: one row ``(node, root)`` per node.

    Alternating large-star and small-star rounds: every round is two
    aggregations with map-side combine and two equi-joins (split by adaptive
    execution where one node has most edges), cut to the shared folder. The
    number of rounds grows with the logarithm of the largest component.
    ``root`` is the smallest node of the component.
    """
    def state(df):
        row = df.agg(F.count(F.lit(1)).alias("n"),
                     F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        return row["n"], row["h"]

    cur = cut(edges.select("a", "b").where("a <> b").distinct())
    seen = state(cur)
    for _ in range(max_rounds):
        if not seen[0]:
            break
        both = cur.select(F.col("a").alias("u"), F.col("b").alias("v")).union(
            cur.select(F.col("b").alias("u"), F.col("a").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = (both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .where("u <> v").distinct())
        down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        low = down.groupBy("u").agg(F.min("v").alias("m"))
        small = (down.join(low, "u").where("v <> m").select(F.col("v").alias("a"), F.col("m").alias("b"))
                 .union(low.select(F.col("u").alias("a"), F.col("m").alias("b"))).distinct())
        cur = cut(small)
        now = state(cur)
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    # a settled star: a is a leaf, b the smallest node
    return cur.select(F.col("a").alias("node"), F.col("b").alias("root")).union(
        cur.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
