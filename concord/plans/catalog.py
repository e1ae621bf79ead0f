"""Registered checks: Spark builders and equivalent SQL for an independent engine.

Each entry runs one operator of the engine over pairs that Spark derives
from the whole driver tables (see :mod:`concord.sources.fixtures`). The SQL
text computes the same result the naive way -- joins that really form every
row pair -- so it checks the pair-free Spark plans. Columns are aliased
identically on both sides.
"""

from __future__ import annotations

from dataclasses import replace
from typing import Callable, Optional, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from concord.config import RunConfig
from concord.operators import duplicates as DUP
from concord.operators import edges as EDGES
from concord.operators import profile as PROF
from concord.operators import retention as RET
from concord.operators import sample as SAMPLE
from concord.plans.prepare import prepare
from concord.plans.reconcile import Reconciliation, materialize
from concord.plans.run import run
from concord.session import ensure_checkpoint_dir
from concord.sources import fixtures as FX
from concord.sources import sinks
from concord.sources.runs import RunStore

WINDOWS = (45, 2000)
SEARCH_TERM = "53"


def cfg(days: Optional[int] = None, **kw) -> RunConfig:
    return RunConfig(as_of=FX.AS_OF, window_enabled=days is not None,
                     window_days=days if days is not None else 45, **kw)


def _orders(spark, sf_dir, days=None, keep=True) -> Reconciliation:
    return Reconciliation(FX.orders_pair(spark, sf_dir), cfg(days), keep=keep)


def _union(frames: Sequence[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def _per_window(build: Callable[[Reconciliation], DataFrame], spark, sf_dir) -> DataFrame:
    return _union([build(_orders(spark, sf_dir, d)).withColumn("window_days", F.lit(d)) for d in WINDOWS])


def _run(spark, sf_dir):
    pairs = [FX.orders_pair(spark, sf_dir), FX.customer_pair(spark, sf_dir)]
    return run(pairs, cfg(45))


# --------------------------------------------------------------------------
# Spark side
# --------------------------------------------------------------------------

def q_column_stats(spark, d):
    return _orders(spark, d, keep=False).column_stats()


def q_record_counts(spark, d):
    return _orders(spark, d).record_counts()


def q_record_counts_window(spark, d):
    return _per_window(lambda r: r.record_counts(), spark, d)


def q_date_scenarios(spark, d):
    return _orders(spark, d).date_scenarios()


def q_date_scenarios_window(spark, d):
    return _per_window(lambda r: r.date_scenarios(), spark, d)


def q_window_filter(spark, d):
    return PROF.window_extract(prepare(FX.orders_pair(spark, d), cfg(2000)))


def q_column_mapping(spark, d):
    pair = FX.orders_pair(spark, d)
    pair = replace(pair, right=pair.right.withColumnRenamed("cust", "customer_id"),
                   column_mapping={"cust": "customer_id"})
    return Reconciliation(pair, cfg(), keep=False).column_stats()


def q_composite_key_missing(spark, d):
    return Reconciliation.for_missing(FX.lineitem_pair(spark, d), cfg()).missing().drop("__k")


def q_dup_key_column_stats(spark, d):
    return Reconciliation(FX.lineitem_drift_pair(spark, d), cfg(), keep=False).column_stats()


def q_dup_key_record_stats(spark, d):
    return Reconciliation(FX.lineitem_drift_pair(spark, d), cfg(), keep=False).record_stats()


def q_dup_key_differences(spark, d):
    return Reconciliation(FX.lineitem_drift_pair(spark, d), cfg()).top_differences()


def q_hot_key_column_stats(spark, d):
    return Reconciliation(FX.lineitem_hot_pair(spark, d), cfg(), keep=False).column_stats()


def q_hot_key_record_stats(spark, d):
    return Reconciliation(FX.lineitem_hot_pair(spark, d), cfg(), keep=False).record_stats()


def q_retention_count(spark, d):
    return RET.retention_count(FX.orders_pair(spark, d), cfg(45))


def q_retention_sample(spark, d):
    return RET.retention_sample(FX.orders_pair(spark, d), cfg(45))


def q_null_empty_profile(spark, d):
    return PROF.null_empty_profile(prepare(FX.orders_pair(spark, d), cfg()))


def q_field_compare(spark, d):
    return _orders(spark, d).record_verdicts()


def q_matched_records(spark, d):
    return _orders(spark, d).record_verdicts().select(
        "table_name", "record_id", "pairs", (F.col("differing_columns") == 0).alias("all_match"))


def _orders_missing(spark, d) -> Reconciliation:
    return Reconciliation.for_missing(FX.orders_pair(spark, d), cfg())


def q_missing_in_right(spark, d):
    return _orders_missing(spark, d).missing().where(F.col("side") == "missing_in_right").drop("__k")


def q_missing_in_left(spark, d):
    return _orders_missing(spark, d).missing().where(F.col("side") == "missing_in_left").drop("__k")


def q_missing_totals(spark, d):
    return Reconciliation.for_missing(FX.orders_pair(spark, d), cfg(), keep=False).missing_totals()


def q_missing_sample(spark, d):
    return _orders_missing(spark, d).missing_sample()


def q_record_match_stats(spark, d):
    return _orders(spark, d, keep=False).record_stats()


def q_top_differences(spark, d):
    return _orders(spark, d).top_differences()


def q_search_differences(spark, d):
    return SAMPLE.search_record_id(_orders(spark, d).all_differences().drop("__k", "ls", "rs", "left_rows", "right_rows"), SEARCH_TERM)


def q_fused_reconcile(spark, d):
    return _orders(spark, d, 45, keep=False).fused()


def q_dup_key_fused(spark, d):
    return Reconciliation(FX.lineitem_drift_pair(spark, d), cfg(), keep=False).fused()


def q_dup_key_verdicts(spark, d):
    return Reconciliation(FX.lineitem_drift_pair(spark, d), cfg()).record_verdicts()


def q_table_summary(spark, d):
    pair = FX.orders_pair(spark, d)
    return run([pair], cfg(45))["table_summary"]


def q_run_report(spark, d):
    return _run(spark, d)["table_summary"]


def q_run_summary(spark, d):
    return _run(spark, d)["run_summary"]


def q_table_kpis(spark, d):
    return _run(spark, d)["table_kpis"]


def q_column_failure_stats(spark, d):
    return _run(spark, d)["column_failure_stats"]


def q_hash_sample(spark, d):
    pair = SAMPLE.hash_sample(FX.orders_pair(spark, d), 10)
    return Reconciliation(pair, cfg(), keep=False).column_stats()


def _store(spark, name: str) -> RunStore:
    ensure_checkpoint_dir(spark)
    return RunStore(spark, sinks.shared_dir(spark, name))


def q_persist_run(spark, d):
    """All result tables of a run are committed; the column statistics are read back."""
    store = _store(spark, "results")
    res = run([FX.orders_pair(spark, d)], cfg(45))
    res.write(store.root, keep_runs=10)
    res.close()
    return store.read("column_stats")


def q_write_run_twice(spark, d):
    """A run of the drifted pair, written again after the replica was mended: nothing of the first is left."""
    store = _store(spark, "twice")
    pair = FX.orders_pair(spark, d)
    for right in (pair.right, pair.left):
        res = run([replace(pair, right=right)], cfg())
        res.write(store.root)
        res.close()
    stale = sum(store.read(t).count() for t in ("field_differences", "missing_records"))
    return store.read("column_stats").withColumn("stale_rows", F.lit(stale).cast("long"))


def q_prune_runs(spark, d):
    """Of four runs, two of them without differences, every table keeps the same newest two."""
    store = _store(spark, "pruned")
    pair = FX.customer_pair(spark, d)
    for run_id, right in (("r1", pair.right), ("r2", pair.left), ("r3", pair.left), ("r4", pair.right)):
        res = run([replace(pair, right=right)], cfg(run_id=run_id))
        res.write(store.root, keep_runs=2)
        res.close()
    tables = ("column_stats", "field_differences", "missing_records", "table_status", "record_counts")
    return _union([store.read(t).groupBy("run_id").agg(F.count(F.lit(1)).alias("rows")).select(
        "run_id", F.lit(t).alias("result_table"), "rows") for t in tables])


def q_digest_column_stats(spark, d):
    """Column statistics with the row-digest prefilter."""
    return Reconciliation(FX.orders_pair(spark, d), cfg(digest_prefilter=True)).column_stats()


def _lines(df: DataFrame) -> DataFrame:
    return df.select("table_name", "column_name", "record_id", "left_value", "right_value", "left_rows", "right_rows", "pairs")


def q_dup_key_search(spark, d):
    """Every difference of duplicate keys in linear form, searched by record id."""
    return SAMPLE.search_record_id(_lines(Reconciliation(FX.lineitem_drift_pair(spark, d), cfg()).all_differences()), SEARCH_TERM)


def q_dup_key_export(spark, d):
    """Every difference of the hot-key pair, written as compressed CSV and read again."""
    ensure_checkpoint_dir(spark)
    path = sinks.shared_dir(spark, "differences")
    rec = Reconciliation(FX.lineitem_hot_pair(spark, d), cfg())
    sinks.export_differences_csv(rec.all_differences(), path, compression="gzip")
    rec.close()  # the rows come from the files: nothing else need stay on disk
    return sinks.read_differences_csv(spark, path, counts=True)


def q_duplicate_histogram(spark, d):
    return _union([DUP.copies_histogram(prepare(p, cfg())) for p in (FX.lineitem_drift_pair(spark, d), FX.lineitem_hot_pair(spark, d))])


def q_duplicate_top(spark, d):
    return _union([DUP.most_copied(prepare(p, cfg())) for p in (FX.lineitem_drift_pair(spark, d), FX.lineitem_hot_pair(spark, d))])


def q_window_edges(spark, d):
    """Why keys are missing inside the windows, on a pair whose created times moved."""
    def build(days):
        found, _ = EDGES.window_edges(FX.orders_shifted_pair(spark, d), cfg(days), materialize)
        return found.withColumn("window_days", F.lit(days))
    return _union([build(days) for days in WINDOWS])


def q_retention_archive(spark, d):
    return RET.archive_state(FX.orders_pair(spark, d), cfg(45))


def q_export_differences(spark, d):
    ensure_checkpoint_dir(spark)
    diffs = _orders(spark, d).all_differences().select(*sinks.DIFFERENCE_COLUMNS)
    path = sinks.shared_dir(spark, "differences")
    sinks.export_differences_csv(diffs, path)
    return sinks.read_differences_csv(spark, path)


def q_retain_latest_runs(spark, d):
    ev = FX.testdata_table(spark, d, "events").select(
        F.date_format(F.to_date("ts"), "yyyy-MM-dd").alias("run_id"), "event_id")
    return sinks.latest_runs(ev, keep=10)


def narrow(df: DataFrame) -> DataFrame:
    """Pair counts as 64-bit numbers, the type of the SQL's; raises where one doesn't fit."""
    counts = {"matches", "mismatches", "null_left", "null_right", "total_records", "matching_records",
              "mismatched_records", "pairs"}
    return df.select(*[F.col(c).cast("long").alias(c) if c in counts or c.startswith("matches_") else F.col(c)
                       for c in df.columns])


def _narrowed(build):
    def query(spark: SparkSession, d: str) -> DataFrame:
        return narrow(build(spark, d))
    query.__name__ = build.__name__
    return query


_CHECKS: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "column_stats": q_column_stats,
    "record_counts": q_record_counts,
    "record_counts_window": q_record_counts_window,
    "date_scenarios": q_date_scenarios,
    "date_scenarios_window": q_date_scenarios_window,
    "window_filter": q_window_filter,
    "column_mapping": q_column_mapping,
    "composite_key_missing": q_composite_key_missing,
    "dup_key_column_stats": q_dup_key_column_stats,
    "dup_key_record_stats": q_dup_key_record_stats,
    "dup_key_differences": q_dup_key_differences,
    "hot_key_column_stats": q_hot_key_column_stats,
    "hot_key_record_stats": q_hot_key_record_stats,
    "retention_count": q_retention_count,
    "retention_sample": q_retention_sample,
    "null_empty_profile": q_null_empty_profile,
    "field_compare": q_field_compare,
    "matched_records": q_matched_records,
    "missing_in_right": q_missing_in_right,
    "missing_in_left": q_missing_in_left,
    "missing_totals": q_missing_totals,
    "missing_sample": q_missing_sample,
    "record_match_stats": q_record_match_stats,
    "top_differences": q_top_differences,
    "search_differences": q_search_differences,
    "fused_reconcile": q_fused_reconcile,
    "dup_key_fused": q_dup_key_fused,
    "dup_key_verdicts": q_dup_key_verdicts,
    "table_summary": q_table_summary,
    "run_report": q_run_report,
    "run_summary": q_run_summary,
    "table_kpis": q_table_kpis,
    "column_failure_stats": q_column_failure_stats,
    "hash_sample": q_hash_sample,
    "persist_run": q_persist_run,
    "export_differences": q_export_differences,
    "retain_latest_runs": q_retain_latest_runs,
    "write_run_twice": q_write_run_twice,
    "prune_runs": q_prune_runs,
    "digest_column_stats": q_digest_column_stats,
    "dup_key_search": q_dup_key_search,
    "dup_key_export": q_dup_key_export,
    "duplicate_histogram": q_duplicate_histogram,
    "duplicate_top": q_duplicate_top,
    "window_edges": q_window_edges,
    "retention_archive": q_retention_archive,
}

QUERIES = {name: _narrowed(build) for name, build in _CHECKS.items()}
