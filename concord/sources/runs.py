"""Result tables of runs, committed as a whole (S8, S9).

Layout under ``root``: one folder per result table, in it one folder per
written attempt (``commit=<id>``), and a manifest table. A run is written in
this order: every result table into a folder of a new attempt (a table without
rows leaves its schema), then one manifest row. Readers learn from the manifest
which attempt of which run holds, so they never see

* half a run: without its manifest row an attempt does not exist;
* rows of an earlier attempt: writing a run again replaces all its tables at
  once, those that have no rows any more too;
* runs that differ from table to table: pruning drops runs in the manifest,
  which is the only source of run ids, and only then the folders.

The manifest is append-only Parquet, one small file per commit; of a run's rows
the one with the greatest ``seq`` holds. It has one row per written run, so it
is read on the driver. One writer at a time per ``root``.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass
from typing import Mapping, Optional, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from concord.sources.sinks import delete_path, path_exists, subfolders

MANIFEST = "_manifest"
SCHEMA = ("seq long, run_id string, commit string, dropped boolean, "
          "tables array<struct<name: string, schema: string, rows: long>>")


@dataclass(frozen=True)
class Commit:
    """The attempt of a run that holds, with the schema and rows of its tables."""

    seq: int
    run_id: str
    commit: str
    tables: Mapping[str, tuple[str, int]]


class RunStore:
    """Committed runs under one ``root`` (shared storage)."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    # -- the manifest -------------------------------------------------------------
    def _log(self) -> list:
        path = f"{self.root}/{MANIFEST}"
        if not path_exists(self.spark, path):
            return []
        return self.spark.read.schema(SCHEMA).parquet(path).collect()  # a row per written run

    def _append(self, rows: Sequence[tuple]) -> None:
        self.spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(f"{self.root}/{MANIFEST}")

    def runs(self) -> dict[str, Commit]:
        """Committed runs by id, in order of their ids."""
        last: dict[str, tuple] = {}
        for r in self._log():
            if r["run_id"] not in last or r["seq"] > last[r["run_id"]]["seq"]:
                last[r["run_id"]] = r
        return {k: Commit(r["seq"], k, r["commit"], {t["name"]: (t["schema"], t["rows"]) for t in r["tables"]})
                for k, r in sorted(last.items()) if not r["dropped"]}

    def _next(self) -> int:
        return 1 + max((r["seq"] for r in self._log()), default=0)

    # -- writing --------------------------------------------------------------------
    def write(self, run_id: str, frames: Mapping[str, DataFrame]) -> Commit:
        """Write all ``frames`` as one attempt of the run and commit it; an earlier attempt's folders go afterwards."""
        before = self.runs().get(run_id)
        attempt = uuid.uuid4().hex
        tables = []
        for name, df in frames.items():
            path = self._folder(name, attempt)
            df.write.mode("error").parquet(path)
            tables.append((name, df.schema.json(), self.spark.read.schema(df.schema).parquet(path).count()))
        commit = Commit(self._next(), run_id, attempt, {n: (s, c) for n, s, c in tables})
        self._append([(commit.seq, run_id, attempt, False, tables)])
        if before is not None:
            self._remove([before])
        return commit

    def prune(self, keep: int) -> list[str]:
        """Drop all but the ``keep`` newest runs (the greatest ids) from every table; returns the ids dropped."""
        if keep < 0:
            raise ValueError("keep must not be negative")
        runs = list(self.runs().values())
        old = runs[:max(0, len(runs) - keep)]
        if old:
            seq = self._next()
            self._append([(seq, c.run_id, c.commit, True, []) for c in old])
            self._remove(old)
        return [c.run_id for c in old]

    def sweep(self) -> int:
        """Delete the folders of attempts that no manifest row holds (a writer died); returns how many went."""
        held = {c.commit for c in self.runs().values()}
        n = 0
        for table in subfolders(self.spark, self.root):
            if table == MANIFEST:
                continue
            for folder in subfolders(self.spark, f"{self.root}/{table}"):
                if folder.startswith("commit=") and folder[7:] not in held:
                    delete_path(self.spark, f"{self.root}/{table}/{folder}")
                    n += 1
        return n

    def _folder(self, table: str, commit: str) -> str:
        return f"{self.root}/{table}/commit={commit}"

    def _remove(self, commits: Sequence[Commit]) -> None:
        for c in commits:
            for name in c.tables:
                delete_path(self.spark, self._folder(name, c.commit))

    # -- reading ----------------------------------------------------------------------
    def read(self, table: str, run_ids: Optional[Sequence[str]] = None) -> DataFrame:
        """Rows of a result table over the committed runs (or some of them), with ``run_id``.

        Columns that only some runs have are NULL for the others. A table that
        no committed run has is an error.
        """
        runs = [c for c in self.runs().values() if run_ids is None or c.run_id in set(run_ids)]
        having = [c for c in runs if table in c.tables]
        if not having:
            raise ValueError(f"no committed run has a table {table!r}")
        out = None
        for schema in {c.tables[table][0]: None for c in having}:  # runs of one schema are read together
            kind = T.StructType.fromJson(json.loads(schema))
            paths = [self._folder(table, c.commit) for c in having if c.tables[table][0] == schema]
            part = self.spark.read.schema(kind).parquet(*paths)
            out = part if out is None else out.unionByName(part, allowMissingColumns=True)
        return out

    def rows(self) -> DataFrame:
        """``(run_id, result_table, rows)`` of every committed run, from the manifest."""
        found = [(c.run_id, name, n) for c in self.runs().values() for name, (_, n) in c.tables.items()]
        return self.spark.createDataFrame(found, "run_id string, result_table string, rows long")
