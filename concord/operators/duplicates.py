"""Duplicate-key profile (X1): how many copies keys have on each side, and the keys with the most.

Both read the key counts of :func:`concord.operators.compare.key_counts`: keys
alone are scanned, and a hot key's rows are added up on the map side before
they meet, so a key that holds a third of all rows is one number per task. The
histogram is a second aggregate over those exact counts; the list of the
heaviest keys is limited in every partition before it is sorted.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from concord.functions import canon as C
from concord.operators.compare import key_counts
from concord.plans.prepare import Prepared


def _sides(prep: Prepared) -> DataFrame:
    """(flat key, side, copies) of every key on every side that has it."""
    sides = F.array(*[F.struct(F.lit(s).alias("side"), F.col(c).alias("copies")) for s, c in (("left", "n_l"), ("right", "n_r"))])
    return key_counts(prep).select(*prep.flat_keys(), F.inline(sides)).where("copies > 0")


def copies_histogram(prep: Prepared) -> DataFrame:
    """Per side and number of copies: how many keys have it, and their rows."""
    return _sides(prep).groupBy("side", "copies").agg(F.count(F.lit(1)).alias("keys"), F.sum("copies").alias("rows")).select(
        F.lit(prep.name).alias("table_name"), "side", "copies", "keys", "rows")


def most_copied(prep: Prepared, limit: int = 20) -> DataFrame:
    """Per side, the ``limit`` keys with the most copies (two at least); equal ones in order of the key."""
    w = Window.partitionBy("side").orderBy(F.col("copies").desc(), *[F.col(k).asc_nulls_first() for k in prep.flat_keys()])
    top = _sides(prep).where("copies > 1").withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= limit)
    return top.select("*", prep.key_from_flat()).select(
        F.lit(prep.name).alias("table_name"), "side", "rank", C.record_id(F.col("__k"), prep.keys).alias("record_id"), "copies")
