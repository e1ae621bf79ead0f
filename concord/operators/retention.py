"""Retention check (P7, A10, K4, X3): old rows that should have left the source.

Runs on the left side only, over the whole table (not the window): rows
created *and* last modified strictly before ``as_of - retention_days``.
The exact total is a plain aggregate; the listing is the newest ``N`` by
created time (ties broken by key), planned as a top-k, not a full sort.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from concord.config import RunConfig, TablePair
from concord.functions import canon as C
from concord.functions import timecols as TC
from concord.plans.prepare import NO_TIME_COLUMNS, OK
from concord.sources.schema import apply_mapping, quoted


def _resolve(pair: TablePair, df: DataFrame | None = None):
    # only one side is read, so only its columns matter
    columns = (pair.left if df is None else df).columns
    created = pair.created_col or TC.detect(columns, TC.CREATED_CANDIDATES)
    modified = pair.modified_col or TC.detect(columns, TC.MODIFIED_CANDIDATES)
    return created, modified


def _older(pair: TablePair, cfg: RunConfig, df: DataFrame):
    """Rows of ``df`` older than the threshold, or None without time columns."""
    created, modified = _resolve(pair, df)
    if created is None or modified is None:
        return None
    return df.where(TC.older_than(F.col(quoted(created)), F.col(quoted(modified)), df.schema[created].dataType,
                                  df.schema[modified].dataType, cfg.retention_threshold()))


def old_rows(pair: TablePair, cfg: RunConfig):
    """(status, rows) -- left rows older than the threshold, or None."""
    rows = _older(pair, cfg, pair.left)
    return (NO_TIME_COLUMNS, None) if rows is None else (OK, rows)


def retention_count(pair: TablePair, cfg: RunConfig) -> DataFrame:
    status, rows = old_rows(pair, cfg)
    days = F.lit((cfg.as_of_s - cfg.retention_threshold()).days).alias("retention_days")  # as applied
    # every old row is counted as not deleted; nothing on the left side can
    # show a deletion, so ``deleted_records`` is 0 by construction
    if rows is None:
        return pair.left.sparkSession.range(1).select(
            F.lit(pair.name).alias("table_name"), days, F.lit(None).cast("long").alias("total_old_records"),
            F.lit(None).cast("long").alias("deleted_records"), F.lit(None).cast("long").alias("not_deleted"),
            F.lit(status).alias("status"))
    n = F.col("n").cast("long")
    return rows.agg(F.count(F.lit(1)).alias("n")).select(
        F.lit(pair.name).alias("table_name"), days, n.alias("total_old_records"),
        F.lit(0).cast("long").alias("deleted_records"), n.alias("not_deleted"),
        F.lit(status).alias("status"))


def retention_sample(pair: TablePair, cfg: RunConfig, limit: int | None = None) -> DataFrame:
    """Newest ``limit`` violations (created desc, key asc): a top-k."""
    limit = cfg.max_missing if limit is None else limit
    created, modified = _resolve(pair)
    status, rows = old_rows(pair, cfg)
    if rows is None:
        return pair.left.limit(0).select(
            F.lit(pair.name).alias("table_name"), F.lit("").alias("record_id"),
            F.lit("").alias("creation_time"), F.lit("").alias("last_modified_time"),
            F.lit(0).alias("rn"))
    keys = list(pair.keys)
    key = F.struct(*[F.col(quoted(k)) for k in keys])
    c_type, m_type = rows.schema[created].dataType, rows.schema[modified].dataType
    top = rows.orderBy(F.col(quoted(created)).desc(), *[F.col(quoted(k)).asc_nulls_first() for k in keys]).limit(limit)
    order = Window.orderBy(F.col(quoted(created)).desc(), *[F.col(quoted(k)).asc_nulls_first() for k in keys])
    return top.select(
        F.lit(pair.name).alias("table_name"),
        C.record_id(key, keys).alias("record_id"),
        TC.fmt_time(F.col(quoted(created)), c_type, missing=None).alias("creation_time"),
        TC.fmt_time(F.col(quoted(modified)), m_type, missing=None).alias("last_modified_time"),
        F.row_number().over(order).alias("rn"),
    )


def archive_state(pair: TablePair, cfg: RunConfig, archive: DataFrame | None = None) -> DataFrame:
    """Where the old keys are: still on the left, in the archive, or both (X3).

    ``archive`` defaults to the right side; its columns go by the left's names
    (``column_mapping``). Old rows are told on each side by its own times. A key
    of old rows is ``left_only`` (not archived yet), ``archived`` (in both: it
    may be deleted) or deleted (in the archive alone), so ``not_deleted`` is
    ``left_only + archived``. One tagged union of both sides' old keys, one
    aggregate. A side without time columns gives ``NO_TIME_COLUMNS`` and NULLs.
    """
    spark = pair.left.sparkSession
    other = apply_mapping(pair.right if archive is None else archive, pair.column_mapping)
    sides = [_older(pair, cfg, df) for df in (pair.left, other)]
    days = F.lit((cfg.as_of_s - cfg.retention_threshold()).days).alias("retention_days")
    names = ("total_old_records", "deleted_records", "archived", "left_only", "not_deleted")
    head = (F.lit(pair.name).alias("table_name"), days)
    if sides[0] is None or sides[1] is None:
        return spark.range(1).select(*head, *[F.lit(None).cast("long").alias(n) for n in names], F.lit(NO_TIME_COLUMNS).alias("status"))
    kinds = [C.aligned_type(pair.left.schema[k].dataType, other.schema[k].dataType, pair.bool_as_int) for k in pair.keys]
    tagged = [df.select(*[C.align(F.col(quoted(k)), df.schema[k].dataType, t).alias(f"__k{i}") for i, (k, t) in enumerate(zip(pair.keys, kinds))],
                        F.lit(side).alias("side")) for side, df in enumerate(sides)]
    keys = tagged[0].unionByName(tagged[1]).groupBy(*[f"__k{i}" for i in range(len(kinds))]).agg(
        (F.min("side") == 0).alias("left"), (F.max("side") == 1).alias("archived"))
    left, kept = F.col("left"), F.col("archived")
    totals = (F.count(F.lit(1)), F.count_if(~left), F.count_if(left & kept), F.count_if(~kept), F.count_if(left))
    return keys.agg(*[t.alias(n) for t, n in zip(totals, names)]).select(*head, *names, F.lit(OK).alias("status"))
