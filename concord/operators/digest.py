"""Row-digest prefilter: full rows travel only for keys whose digests differ.

Each row of a key with one row a side sends its key, a 128-bit digest of its
canonical values and a bit set of its NULLs (8 bytes for 62 columns). Where
both sides' digests and NULLs agree, all cells are taken to match; the keys
that differ, or are missing on a side, are joined with both sides again to
fetch full rows. The first exchange is narrow whatever the tables' width, so
wide tables that drift little shuffle a fraction of their bytes.

Equal digests of different rows are possible (two 64-bit hashes of each row
that agree both), so the prefilter is off unless a run asks for it.
"""

from __future__ import annotations

from functools import reduce
from typing import Callable

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from concord.functions import canon as C
from concord.operators import compare as CMP
from concord.plans.prepare import Prepared

#: NULL flags in one 64-bit number.
BITS = 62
# Fixed value: what the second hash starts from.
SECOND = 0x5DEECE66D


def _sent(prep: Prepared, side: int, letter: str, duplicates: DataFrame | None, totals: Row) -> DataFrame:
    """Flat key, digest and NULL bits of one side's rows, named by ``letter``."""
    rows = prep.rows(side)
    if duplicates is not None:
        rows = CMP.split_by_keys(prep, rows, duplicates, totals, inside=False)
    canon = [C.canon(F.col(f"v_{i}"), t) for i, t in enumerate(prep.aligned)]
    flags = [F.when(c.isNull(), F.lit(1 << (i % BITS))).otherwise(F.lit(0)).cast("long") for i, c in enumerate(canon)]
    masks = [reduce(lambda a, b: a.bitwiseOR(b), flags[at:at + BITS]) for at in range(0, len(flags), BITS)]
    return rows.select(
        *[F.col(k).alias(f"{letter}{k}") for k in prep.flat_keys()], F.lit(1).cast("long").alias(f"n_{letter}"),
        F.xxhash64(F.lit(0), *canon).alias(f"{letter}_d"), F.xxhash64(F.lit(SECOND), *canon).alias(f"{letter}_e"),
        *[m.alias(f"{letter}_z{j}") for j, m in enumerate(masks)])


def digests(prep: Prepared, duplicates: DataFrame | None, totals: Row) -> DataFrame:
    """One row per key: ``n_l``, ``n_r``, both sides' NULL bits, and whether both rows are taken to be ``equal``."""
    left, right = (_sent(prep, i, s, duplicates, totals) for i, s in enumerate("lr"))
    both = left.join(right, CMP.same_key(prep, "l", "r"), "full_outer")
    masks = [f"z{j}" for j in range(-(-len(prep.value_cols) // BITS))]
    equal = reduce(lambda a, b: a & b, [F.col(f"l_{x}").eqNullSafe(F.col(f"r_{x}")) for x in ("d", "e", *masks)])
    zero = F.lit(0).cast("long")
    return both.select(
        *[F.coalesce(f"l{k}", f"r{k}").alias(k) for k in prep.flat_keys()],
        F.coalesce("n_l", zero).alias("n_l"), F.coalesce("n_r", zero).alias("n_r"),
        *[F.col(f"{s}_{m}") for s in "lr" for m in masks], equal.alias("equal"))


def compared(prep: Prepared, duplicates: DataFrame | None, totals: Row,
             keep: Callable[[DataFrame, Column, list[Column]], tuple[DataFrame, DataFrame]]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The keys that differ, their full rows as :func:`compare.single_rows`, and the counters over all rows.

    ``keep`` keeps the rows of a frame that satisfy a condition and gives the
    counters over all its rows.
    """
    n = len(prep.value_cols)
    bit = lambda s, i: F.col(f"{s}_z{i // BITS}").bitwiseAND(F.lit(1 << (i % BITS)).cast("long")) != 0
    joined = CMP.joined()
    first = digests(prep, duplicates, totals)
    counters = [F.count_if(joined).alias("single_pairs"), F.count_if(joined & F.col("equal")).alias("same"),
                F.count_if(~(joined & F.col("equal"))).alias("n"),
                *[F.count_if(joined & bit(s, i)).alias(f"n{s}_{i}") for s in "lr" for i in range(n)]]
    changed, seen = keep(first, ~(joined & F.col("equal")), counters)
    known = seen.first()
    sent = changed.select(*[F.col(k).alias(f"_d{k}") for k in prep.flat_keys()])
    size = F.octet_length(F.to_json(F.struct("*"))) + CMP.ROW_OVERHEAD_BYTES
    if 0 <= (sent.agg(F.sum(size)).first()[0] or 0) <= CMP.broadcast_limit(first.sparkSession):
        sent = F.broadcast(sent)
    rows = CMP.single_rows(prep, None, None, only=sent)
    cells = CMP.single_counters(prep)
    drift, more = keep(rows, CMP.differs(prep), cells) if known["n"] else (rows.where(F.lit(False)), rows.limit(0).agg(*cells))
    same = F.lit(known["same"]).cast("long")
    own = [F.lit(known["single_pairs"]).cast("long").alias("single_pairs"), (same + F.col("single_matching")).alias("single_matching")]
    for i in range(n):
        own += [(same + F.col(f"m_{i}")).alias(f"m_{i}"), *[F.lit(known[f"n{s}_{i}"]).cast("long").alias(f"n{s}_{i}") for s in "lr"]]
    return changed, drift, more.select(*own)
