"""Window-edge classification (X2): why a key is missing under a created-time window.

Each side is windowed by its own created time, so a key may be missing because
the other side lacks it, or because the other side's row lies outside of the
window. The keys that are missing inside the window are looked up among the
unfiltered rows of the other side: a join that reads the key and the created
time alone. The missing keys are kept and measured; a set under the session's
broadcast threshold filters the other side's rows where they are scanned, a
larger one is shuffled (Spark may add its runtime Bloom filter to that scan).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from concord.config import RunConfig, TablePair
from concord.functions import canon as C
from concord.functions import timecols as TC
from concord.operators import compare as CMP
from concord.plans.prepare import KEY, SIDE, prepare

ABSENT, OUTSIDE = "absent", "outside_window"


def window_edges(pair: TablePair, cfg: RunConfig, keep) -> tuple[DataFrame, DataFrame]:
    """``(missing keys, kept)``: every key that is missing inside the window, with the reason.

    Reasons: ``absent`` (the other side has no row of the key) and
    ``outside_window`` (it has, but none inside); ``other_created`` is then the
    greatest created time there (``N/A`` where all are NULL, or absent).
    ``keep`` materializes the missing keys; the second frame is to be released.
    """
    inside = prepare(pair, cfg, columns=())
    whole = prepare(pair, cfg, windowed=False, columns=[c for c in (inside.created,) if c])
    flat = inside.flat_keys()
    # the side that lacks the key is the one to look at
    missing = keep(CMP.key_counts(inside).where(~CMP.joined()).select(
        *[F.col(k).alias(f"_d{k}") for k in flat], F.when(F.col("n_r") == 0, 1).otherwise(0).cast("tinyint").alias("_side")))
    size = missing.agg(F.sum(F.octet_length(F.to_json(F.struct("*"))) + CMP.ROW_OVERHEAD_BYTES)).first()[0] or 0
    sought = F.broadcast(missing) if size <= CMP.broadcast_limit(missing.sparkSession) else missing
    on = CMP.same_key(inside) & (F.col(SIDE) == F.col("_side"))
    in_key = inside.created in inside.keys
    created = (F.col(flat[inside.keys.index(inside.created)]) if in_key else F.col("v_0")) if inside.created else F.lit(None).cast("string")
    rows = whole.both_tagged().join(sought, on).groupBy(*[f"_d{k}" for k in flat], "_side").agg(F.max(created).alias("at"))
    found = rows.select(*[F.col(f"_d{k}").alias(f"_f{k}") for k in flat], F.col("_side").alias("_fside"), "at")
    same = reduce(lambda a, b: a & b, [F.col(f"_d{k}").eqNullSafe(F.col(f"_f{k}")) for k in flat], F.col("_side") == F.col("_fside"))
    kind = (whole.key_types[inside.keys.index(inside.created)] if in_key else whole.aligned[0]) if inside.created else None
    key = F.struct(*[F.col(f"_d{k}").alias(n) for k, n in zip(flat, inside.keys)]).alias(KEY)
    out = missing.join(found, same, "left").select("*", key).select(
        F.lit(pair.name).alias("table_name"),
        F.when(F.col("_side") == 1, CMP.MISSING_IN_RIGHT).otherwise(CMP.MISSING_IN_LEFT).alias("side"),
        C.record_id(F.col(KEY), inside.keys).alias("record_id"),
        F.when(F.col("_fside").isNull(), ABSENT).otherwise(OUTSIDE).alias("reason"),
        TC.fmt_time(F.col("at"), kind).alias("other_created"))
    return out, missing
