"""Command line: run a configured comparison and write its result tables.

    python -m concord config.json

Config (JSON)::

    {
      "as_of": "2001-08-01 00:00:00",          # optional, default: now
      "window": {"enabled": true, "days": 45},
      "retention": {"enabled": true, "days": 45},
      "max_differences": 100, "max_missing": 100,
      "output": "/shared/reconciliation",     # result tables, committed by run
      "keep_runs": 10,                        # optional, drop older runs
      "parallel_tables": 4,                   # optional, tables at a time
      "export_csv": "/shared/differences",    # optional, every difference
      "tables": [
        {"name": "orders", "keys": ["id"],
         "column_mapping": {"left_name": "right_name"},
         "left":  {"parquet": "/data/src/orders"},
         "right": {"table": "dw.orders"}}
      ]
    }

A side is one of ``{"parquet": path}``, ``{"table": name}``,
``{"csv": path, "options": {...}}`` or ``{"jdbc": {"url": ..., "table": ...,
"partition_column": ..., "lower_bound": ..., "upper_bound": ...,
"num_partitions": ..., "user_env": "VAR", "password_env": "VAR"}}``;
credentials are read from the named environment variables, never from the
file. Exit status: 0 when every table was compared, 1 when any failed.
"""

from __future__ import annotations

import json
import os
import sys
from datetime import datetime
from typing import Any, Mapping

from pyspark.sql import DataFrame, SparkSession

from concord.config import RunConfig, TablePair
from concord.operators.summary import COMPARED
from concord.plans.run import run
from concord.session import tune
from concord.sources import readers, sinks


def read_side(spark: SparkSession, spec: Mapping[str, Any]) -> DataFrame:
    if "parquet" in spec:
        return readers.read_parquet(spark, spec["parquet"])
    if "table" in spec:
        return readers.read_table(spark, spec["table"])
    if "csv" in spec:
        opts = {"header": "true", **spec.get("options", {})}
        return spark.read.options(**opts).csv(spec["csv"])
    if "jdbc" in spec:
        j = dict(spec["jdbc"])
        options = dict(j.pop("options", {}))
        for key in ("user", "password"):
            env = j.pop(f"{key}_env", None)
            if env:
                options[key] = os.environ[env]
        return readers.read_jdbc(spark, j.pop("url"), j.pop("table"), options=options, **j)
    raise ValueError(f"unknown source spec: {sorted(spec)}")


def load_config(spark: SparkSession, cfg: Mapping[str, Any]) -> tuple[list[TablePair], RunConfig]:
    window = cfg.get("window", {})
    retention = cfg.get("retention", {})
    as_of = cfg.get("as_of")
    run_cfg = RunConfig(
        as_of=datetime.fromisoformat(as_of) if as_of else datetime.now(),
        window_enabled=bool(window.get("enabled", False)),
        window_days=window.get("days"),
        retention_enabled=bool(retention.get("enabled", True)),
        retention_days=retention.get("days"),
        max_differences=int(cfg.get("max_differences", 100)),
        max_missing=int(cfg.get("max_missing", 100)),
        run_id=cfg.get("run_id"),
        parallel_tables=int(cfg.get("parallel_tables", 1)),
    )
    pairs = [
        TablePair(
            name=t["name"],
            left=read_side(spark, t["left"]),
            right=read_side(spark, t["right"]),
            keys=tuple(t.get("keys", ["id"])),
            column_mapping=t.get("column_mapping", {}),
            created_col=t.get("created_col"),
            modified_col=t.get("modified_col"),
            bool_as_int=bool(t.get("bool_as_int", False)),
        )
        for t in cfg["tables"]
    ]
    return pairs, run_cfg


def main(argv: list[str] | None = None) -> int:
    argv = sys.argv[1:] if argv is None else argv
    if len(argv) != 1:
        print(__doc__)
        return 2
    with open(argv[0]) as fh:
        cfg = json.load(fh)
    spark = tune(SparkSession.builder.appName("concord").getOrCreate())
    pairs, run_cfg = load_config(spark, cfg)
    result = run(pairs, run_cfg)
    try:
        if cfg.get("output"):
            result.write(cfg["output"], keep_runs=cfg.get("keep_runs"))
        if cfg.get("export_csv"):
            sinks.export_differences_csv(result.all_differences(spark), cfg["export_csv"])
        statuses = [r.asDict() for r in result["table_status"].collect()]
        print(json.dumps({"run_id": result.run_id, "tables": statuses,
                          "summary": result["run_summary"].first().asDict()}, default=str))
        failed = any(s["status"] not in COMPARED for s in statuses)
        return 1 if failed else 0
    finally:
        result.close()
