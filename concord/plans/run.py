"""A run over several table pairs (S5, U3, S8): flat result tables.

Each table is reconciled on its own; the per-table results are unioned into
one table per kind, tagged with ``run_id``. A table that fails is reported
with status ``ERROR`` and its message instead of looking clean with zero
counts, and what it had kept is released. Every kind of result table exists
in every run, with no rows where no table gave any.

With ``cfg.parallel_tables`` above 1, tables run in that many threads. Each
table is one job group, so that the jobs of a failed table are cancelled alone,
and names its own scheduler pool, which FAIR scheduling shares out.
"""

from __future__ import annotations

import uuid
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from functools import reduce
from typing import Optional, Sequence

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from concord.config import RunConfig, TablePair
from concord.operators import retention as RET
from concord.operators import summary as SUM
from concord.plans.prepare import NO_COMMON_COLUMNS
from concord.plans.reconcile import Reconciliation
from concord.sources import sinks
from concord.sources.runs import Commit, RunStore

RESULT_TABLES = (
    "record_counts", "date_scenarios", "column_stats", "field_differences", "missing_records",
    "retention_violations", "table_status", "table_summary", "run_summary", "column_failure_stats",
    "table_kpis",
)


@dataclass
class RunResult:
    run_id: str
    frames: dict[str, DataFrame]
    reconciliations: list[Reconciliation] = field(default_factory=list)
    kept: list[DataFrame] = field(default_factory=list)
    compared: list[Reconciliation] = field(default_factory=list)

    def __getitem__(self, name: str) -> DataFrame:
        return self.frames[name]

    def write(self, root: str, keep_runs: Optional[int] = None) -> Commit:
        """Commit all result tables under ``root`` as this run (:mod:`concord.sources.runs`).

        Writing a run again replaces all its tables. With ``keep_runs``, all
        but that many newest runs go from every table.
        """
        store = RunStore(self["table_status"].sparkSession, root)
        commit = store.write(self.run_id, self.frames)
        if keep_runs is not None:
            store.prune(keep_runs)
        return commit

    def all_differences(self, spark: SparkSession) -> DataFrame:
        """Every difference of every compared table, uncapped; to be read before ``close()``."""
        columns = (*sinks.DIFFERENCE_COLUMNS, *sinks.COUNT_COLUMNS)
        kinds = ["string"] * len(sinks.DIFFERENCE_COLUMNS) + ["long", "long", "decimal(38,0)"]
        none = spark.createDataFrame([], ", ".join(f"{c} {k}" for c, k in zip(columns, kinds)))
        return _union([none, *(r.all_differences().select(*columns) for r in self.compared)])

    def close(self) -> None:
        for df in self.kept:
            df.unpersist()
        for r in self.reconciliations:
            r.close()


def _union(frames: Sequence[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), frames)


STATUS = "table_name string, status string, window_status string, message string"


def _status_row(spark: SparkSession, table: str, status: str, window_status: str, message: str) -> DataFrame:
    return spark.createDataFrame([(table, status, window_status, message)], STATUS)


def _results(spark: SparkSession, rec: Reconciliation, pair: TablePair, cfg: RunConfig) -> dict[str, DataFrame]:
    if rec.prep.status == NO_COMMON_COLUMNS:  # nothing to compare, count or window by
        return {"table_status": _status_row(spark, pair.name, rec.prep.status, rec.prep.window_status, "")}
    out = {
        "record_counts": rec.record_counts(),
        "date_scenarios": rec.date_scenarios(),
        "column_stats": rec.column_stats(),
        "record_stats": rec.record_stats(),
        "missing_totals": rec.missing_totals(),
        "field_differences": rec.top_differences(),
        "missing_records": rec.missing_sample(),
    }
    if cfg.retention_enabled:
        out["retention_count"] = RET.retention_count(pair, cfg)
        out["retention_violations"] = RET.retention_sample(pair, cfg)
    else:
        out["retention_count"] = spark.createDataFrame(
            [(pair.name, 0, None, None, None, "DISABLED")], SUM.PARTS["retention_count"])
    out["table_status"] = _status_row(spark, pair.name, rec.status(), rec.prep.window_status, "")
    return out


def _evaluated(out: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """The result frames of one table, computed here and kept (a few rows, or first-N lists).

    A table whose data fails only when it is read fails here, on its own;
    the roll-ups and the written run read what is kept, not the tables again.
    """
    kept: dict[str, DataFrame] = {}
    try:
        for name, df in out.items():
            kept[name] = df.persist()
            kept[name].count()
    except Exception:
        for df in kept.values():
            df.unpersist()
        raise
    return kept


def _one_table(spark: SparkSession, pair: TablePair, cfg: RunConfig, run_id: str) -> tuple[dict, Optional[Reconciliation]]:
    """The evaluated results of one table, or its error; its jobs are one group."""
    sc = spark.sparkContext
    group = f"{run_id}-{pair.name}-{uuid.uuid4().hex[:8]}"
    rec = None
    if cfg.parallel_tables > 1:  # in a thread of its own: nothing of the caller's is overwritten
        sc.setJobGroup(group, f"reconcile {pair.name}")
        sc.setLocalProperty("spark.scheduler.pool", f"concord-{pair.name}")
    try:
        rec = Reconciliation(pair, cfg)
        return _evaluated(_results(spark, rec, pair, cfg)), rec
    except Exception as exc:  # one bad table must not hide the others
        if cfg.parallel_tables > 1:
            sc.cancelJobGroup(group)
        if rec is not None:
            rec.close()
        return {"table_status": _status_row(spark, pair.name, "ERROR", "", str(exc))}, None


def run(pairs: Sequence[TablePair], cfg: RunConfig) -> RunResult:
    if not pairs:
        raise ValueError("no table pairs to compare")
    spark = pairs[0].left.sparkSession
    run_id = cfg.resolved_run_id()
    jobs = [lambda pair=pair: _one_table(spark, pair, cfg, run_id) for pair in pairs]
    if cfg.parallel_tables > 1:
        with ThreadPoolExecutor(cfg.parallel_tables) as pool:
            done = [f.result() for f in [pool.submit(inheritable_thread_target(spark)(job)) for job in jobs]]
    else:
        done = [job() for job in jobs]
    parts = {name: [spark.createDataFrame([], kind)] for name, kind in {**SUM.PARTS, "table_status": STATUS}.items()}
    for out, _ in done:
        for name, df in out.items():
            parts[name].append(df)
    frames = {name: _union(dfs) for name, dfs in parts.items()}
    tables = SUM.table_summary(
        frames["record_counts"].withColumnRenamed("status", "status_counts"),
        frames["record_stats"], frames["missing_totals"], frames["date_scenarios"],
        frames["retention_count"], frames["table_status"].select("table_name", "status", "window_status"))
    frames["table_summary"] = tables
    frames["run_summary"] = SUM.run_summary(tables, cfg)
    frames["table_kpis"] = SUM.table_kpis(tables)
    frames["column_failure_stats"] = SUM.column_failure_stats(frames["column_stats"])
    frames = {name: df.withColumn("run_id", F.lit(run_id)) for name, df in frames.items()}
    recs = [rec for _, rec in done if rec is not None]
    return RunResult(run_id, frames, recs, [df for out, _ in done for df in out.values()],
                     [rec for out, rec in done if rec is not None and "field_differences" in out])
