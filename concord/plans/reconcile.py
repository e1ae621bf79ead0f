"""Reconciliation of one table pair: every result table from two steps.

Job count for a pair with window and retention on:

* counts + scenarios: one scan per side (pushed-down window, partial
  aggregate, one-row exchange);
* keys: one scan of both sides' key columns, one aggregate by key -- row and
  missing totals, and the duplicate keys;
* comparison: one full outer join of the rows of all other keys. Its counters
  are taken while the rows that differ or are missing -- and no others -- are
  written to the shared ``spark.checkpoint.dir`` (or persisted), where the
  difference and missing lists read them (tables of over 100 columns: as bit
  sets of flags, counted by chunks of columns, see ``operators/wide.py``);
* duplicate keys (rare): their rows are read once more into one kept table of
  counted value tuples; where they are too many to broadcast, each list or
  count takes one pass over the rows instead, see ``operators/dealt.py``;
* retention: one scan of the left side with its own pushed-down filter.

Only one-row summaries, and the heavy hash buckets of keys (a thousand at most), reach the driver.
"""

from __future__ import annotations

from typing import Optional, Sequence

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from concord.config import FAILED_BELOW, RunConfig, TablePair
from concord.functions import canon as C
from concord.functions import format as FM
from concord.operators import compare as CMP
from concord.operators import counts as CNT
from concord.operators import dealt as DLT
from concord.operators import digest as DIG
from concord.operators import multiset as MS
from concord.operators import wide as WD
from concord.plans.prepare import (EMPTY_BOTH, EMPTY_LEFT, EMPTY_RIGHT, KEY, OK, Prepared,
                                   prepare)
from concord.sources.sinks import checkpoint_root, delete_path, shared_dir


def materialize(df: DataFrame, mode: str = "auto") -> DataFrame:
    """Keep ``df`` for reuse by several jobs.

    ``table`` writes it as Parquet under the session's shared checkpoint
    folder and reads it back: one job, lineage cut (survives lost
    executors), and later readers prune to the columns they need.
    ``checkpoint`` is Spark's reliable checkpoint into the same folder.
    ``persist`` keeps it in executor memory and local disk (lost blocks are
    recomputed from lineage). ``auto`` picks ``table`` when the session
    names a checkpoint folder, else ``persist``.
    """
    spark = df.sparkSession
    if mode == "auto":
        mode = "table" if checkpoint_root(spark) else "persist"
    if mode == "table":
        path = shared_dir(spark, "concord-kept")
        df.write.mode("error").parquet(path)
        kept = spark.read.parquet(path)
        kept.written_to = path  # the frame owns its folder: ``release`` removes it
        return kept
    if mode == "checkpoint":
        root = checkpoint_root(spark)
        if root and spark.sparkContext.getCheckpointDir() is None:
            spark.sparkContext.setCheckpointDir(root)
        return df.checkpoint(eager=True)
    if mode == "persist":
        return df.persist(StorageLevel.MEMORY_AND_DISK)
    if mode == "none":
        return df
    raise ValueError(f"unknown materialize mode {mode!r}")


def release(df: Optional[DataFrame]) -> None:
    """Undo ``materialize``: unpersist, or delete the written scratch table."""
    if df is None:
        return
    path = df.__dict__.pop("written_to", None)
    if path is not None:
        delete_path(df.sparkSession, path)
    else:
        df.unpersist()


def kept_with_counters(df: DataFrame, keep: Column, counters: Sequence[Column], mode: str) -> tuple[DataFrame, DataFrame]:
    """The rows of ``df`` that satisfy ``keep``, kept, and the one-row ``counters`` over all rows of ``df``.

    Where rows are written, the counters are observed by the same job. ``df``
    must have rows then: an empty plan may be optimized away with its counters.
    """
    spark = df.sparkSession
    if mode == "auto":
        mode = "table" if checkpoint_root(spark) else "persist"
    if mode != "table":
        return materialize(df.where(keep), mode), df.agg(*counters).cache()
    seen = Observation()
    kept = materialize(df.observe(seen, *counters).where(keep), mode)
    names = df.limit(0).agg(*counters).columns
    return kept, spark.createDataFrame([tuple(seen.get[c] for c in names)], ", ".join(f"`{c}` long" for c in names))


class Reconciliation:
    """Lazy result tables of one pair; each step runs at most once."""

    def __init__(self, pair: TablePair, cfg: RunConfig, windowed: Optional[bool] = None,
                 columns: Optional[Sequence[str]] = None, keep: bool = True):
        """``keep``: keep the rows that differ or are missing (``cfg.materialize``)
        while the counters are taken, for reuse by several outputs (the
        default). A caller that reads only counters passes ``keep=False``:
        nothing is written then."""
        self.pair = pair
        self.cfg = cfg
        self.keep = keep
        self.prep: Prepared = prepare(pair, cfg, windowed, columns)
        self._key_summary: Optional[DataFrame] = None
        self._summary = None
        self._duplicates: Optional[DataFrame] = None
        self._heavy: Optional[DataFrame] = None
        self._light_totals: Optional[DataFrame] = None
        self._first: Optional[DataFrame] = None
        self._drift: Optional[DataFrame] = None
        self._totals: Optional[DataFrame] = None
        self._digests = None
        self._packed: Optional[DataFrame] = None
        self._tuples: Optional[DataFrame] = None
        self._values: Optional[DataFrame] = None
        self._counts: Optional[DataFrame] = None

    @property
    def spark(self) -> SparkSession:
        return self.pair.left.sparkSession

    @property
    def name(self) -> str:
        return self.pair.name

    # -- keys -------------------------------------------------------------------
    def key_summary(self) -> DataFrame:
        """One row: totals that the keys alone tell."""
        if self._key_summary is None:
            self._key_summary = CMP.key_summary(self.prep, CMP.key_counts(self.prep)).cache()
        return self._key_summary

    def summary(self):
        """The one-row key totals (collected once; a few numbers)."""
        if self._summary is None:
            self._summary = self.key_summary().first()
        return self._summary

    def status(self) -> str:
        if self.prep.status != OK:
            return self.prep.status
        s = self.summary()
        if s["left_rows"] == 0 and s["right_rows"] == 0:
            return EMPTY_BOTH
        if s["left_rows"] == 0:
            return EMPTY_LEFT
        if s["right_rows"] == 0:
            return EMPTY_RIGHT
        return OK

    def has_duplicates(self) -> bool:
        """Some key that is on both sides has several rows on one."""
        return self.summary()["duplicate_joined_keys"] > 0

    def duplicate_keys(self) -> Optional[DataFrame]:
        """Counts of the duplicate keys (kept once), or None without any."""
        if not self.summary()["duplicate_keys"]:
            return None
        if self._duplicates is None:
            self._duplicates = materialize(CMP.key_counts(self.prep).where(CMP.duplicate()), self.cfg.materialize)
        return self._duplicates

    # -- many duplicate keys --------------------------------------------------------
    def dealt(self) -> bool:
        """Many keys are duplicates: rows are dealt out by key once for each result, whatever their key's copies."""
        return not self.cfg.digest_prefilter and DLT.fits(self.prep, self.summary())

    def heavy_keys(self) -> Optional[DataFrame]:
        """Counts of the heavy duplicate keys (kept once), or None without any."""
        if self.summary()["largest_key"] < DLT.least_heavy(self.summary()):
            return None
        if self._heavy is None:
            self._heavy = materialize(DLT.heavy_keys(self.prep, self.summary()), self.cfg.materialize)
        return self._heavy

    def light_rows(self, only: Optional[DataFrame] = None) -> DataFrame:
        return DLT.light_rows(self.prep, self.summary(), self.heavy_keys(), only)

    def light_totals(self, columns: bool = True, record: bool = True) -> DataFrame:
        """One row: the counters of light keys, all of them where rows are kept for several results."""
        if self._light_totals is not None:
            return self._light_totals
        every = self.keep or (columns and record)
        out = DLT.counters(self.prep, self.light_rows(), int(self.summary()["joined_pairs"]), columns or every, record or every)
        if every:
            out = self._light_totals = out.cache()
        return out

    # -- rows ---------------------------------------------------------------------
    def rows(self) -> DataFrame:
        """One row per key with at most one row a side, with both sides' values (not kept)."""
        return CMP.single_rows(self.prep, self.duplicate_keys(), self.summary())

    def _compared(self) -> None:
        """Keep the rows that differ or are missing, and the counters over all rows."""
        if self._drift is not None:
            return
        mode = self.cfg.materialize
        s = self.summary()
        both = s["joined_keys"] > s["duplicate_joined_keys"]  # some rows are joined
        if self.cfg.digest_prefilter and both:
            self._digests, self._drift, self._totals = DIG.compared(
                self.prep, self.duplicate_keys(), s, lambda *a: kept_with_counters(*a, mode))
        elif both and WD.is_wide(self.prep):
            self._packed = materialize(WD.packed(self.prep, self.rows()), mode)
            self._drift, self._totals = WD.drifted(self.prep, self._packed), WD.totals(self.prep, self._packed)
        elif both:
            self._drift, self._totals = kept_with_counters(
                self.rows(), CMP.differs(self.prep), CMP.single_counters(self.prep), mode)
        else:
            self._drift = materialize(self.rows().where(CMP.differs(self.prep)), mode)
            self._totals = self._drift.agg(*CMP.single_counters(self.prep)).cache()

    def drift(self) -> DataFrame:
        """The rows of :meth:`rows` that differ or are missing (kept once)."""
        self._compared()
        return self._drift

    def totals(self) -> DataFrame:
        """One row: the counters of keys with one row a side."""
        if self._totals is None:
            if self.keep or self.cfg.digest_prefilter:
                self._compared()
            elif WD.is_wide(self.prep):
                self._totals = WD.totals(self.prep, WD.packed(self.prep, self.rows()))
            else:
                self._totals = self.rows().agg(*CMP.single_counters(self.prep)).cache()
        return self._totals

    # -- duplicate keys -------------------------------------------------------------
    def tuples(self) -> DataFrame:
        """Counted value tuples of duplicate keys (kept once)."""
        if self._tuples is None:
            found = (MS.counted(self.prep, DLT.heavy_rows(self.prep, self.heavy_keys())) if self.dealt()
                     else MS.tuple_counts(self.prep, self.duplicate_keys(), self.summary()))
            self._tuples = materialize(found, self.cfg.materialize)
        return self._tuples

    def values(self) -> DataFrame:
        """Counted values of duplicate keys, column by column (kept once)."""
        if self._values is None:
            mode = "none" if self.cfg.materialize == "none" else "persist"  # short lineage: kept in executors
            self._values = materialize(MS.value_counts(self.prep, self.tuples()), mode)
        return self._values

    def counted_apart(self) -> bool:
        """Some joined keys are counted by their value tuples: the duplicates, or where rows are dealt out the heavy ones."""
        return self.heavy_keys() is not None if self.dealt() else self.has_duplicates()

    def duplicate_pairs(self) -> int:
        """Row pairs of the keys that are counted by their value tuples."""
        if self.dealt():
            n = F.col("n_l").cast("decimal(19,0)") * F.col("n_r").cast("decimal(19,0)")
            return int(self.heavy_keys().agg(F.sum(n)).first()[0] or 0)
        return int(self.summary()["duplicate_pairs"])

    # -- counts ---------------------------------------------------------------
    def side_counts(self) -> DataFrame:
        if self._counts is None:
            # one row; kept so counts and scenarios share one scan per side
            self._counts = CNT.side_counts(self.prep).cache()
        return self._counts

    def record_counts(self) -> DataFrame:
        return CNT.record_counts(self.prep, self.side_counts())

    def date_scenarios(self) -> DataFrame:
        return CNT.date_scenarios(self.prep, self.side_counts())

    # -- field comparison -----------------------------------------------------------
    def _column_counts(self) -> DataFrame:
        counts = CMP.column_counts(self.prep, self.light_totals(record=False) if self.dealt() else self.totals())
        if self.counted_apart() and self.prep.value_cols:
            more = MS.column_counts(self.prep, self.values(), self.duplicate_pairs())
            counts = counts.unionByName(more).groupBy("ci", "column_name").agg(
                *[F.sum(c).cast(CMP.PAIRS).alias(c) for c in CMP.COUNTS])
        return counts

    def column_stats(self) -> DataFrame:
        """Per compared column: matches, mismatches, NULLs per side, rate, band.

        No rows when either side is empty (nothing was compared).
        """
        if self.prep.status != OK or self.status() != OK:
            return self._empty_column_stats()
        rate = FM.match_rate(F.col("matches"), F.col("matches") + F.col("mismatches"))
        return self._column_counts().select(
            F.lit(self.name).alias("table_name"), "column_name", *CMP.COUNTS, rate.alias("match_rate"),
            FM.column_band(rate).alias("band"), (rate < F.lit(FAILED_BELOW)).alias("failed"),
        )

    def _empty_column_stats(self) -> DataFrame:
        counts = ", ".join(f"{c} {CMP.PAIRS}" for c in CMP.COUNTS)
        schema = f"table_name string, column_name string, {counts}, match_rate double, band string, failed boolean"
        return self.spark.createDataFrame([], schema)

    def _matching(self) -> DataFrame:
        """One row: row pairs that match on every column."""
        totals = self.light_totals(columns=False) if self.dealt() else self.totals()
        m = totals.select(F.col("single_matching").cast(CMP.PAIRS).alias("matching"))
        if self.counted_apart():
            m = m.union(MS.matching_pairs(self.tuples(), self.duplicate_pairs())).agg(F.sum("matching").cast(CMP.PAIRS).alias("matching"))
        return m

    def record_stats(self) -> DataFrame:
        """Joined record pairs, how many match on every column, how many not."""
        total = F.lit(self.summary()["joined_pairs"]).cast(CMP.PAIRS)
        return self._matching().select(
            F.lit(self.name).alias("table_name"),
            total.alias("total_records"),
            F.col("matching").alias("matching_records"),
            (total - F.col("matching")).cast(CMP.PAIRS).alias("mismatched_records"),
        )

    _LINE = ("column_name", KEY, "left_value", "right_value", "left_rows", "right_rows", "pairs", "ls", "rs")

    def _listed(self, lines: DataFrame) -> DataFrame:
        return lines.select(
            F.lit(self.name).alias("table_name"), "column_name", KEY,
            C.record_id(F.col(KEY), self.prep.keys).alias("record_id"),
            "left_value", "right_value", "left_rows", "right_rows", F.col("pairs").cast(CMP.PAIRS).alias("pairs"), "ls", "rs")

    def all_differences(self) -> DataFrame:
        """Every difference, uncapped, in linear form: a line per differing (key, column), or per value of it.

        A key with one row a side gives one line with both values. So does a
        duplicate key whose rows hold one value a side; otherwise each value
        has its line (:func:`concord.operators.multiset.differences`).
        """
        if self.dealt():
            d = DLT.differences(self.prep, DLT.values(self.prep, self.light_rows())).select(*self._LINE)
        else:
            d = CMP.single_differences(self.prep, self.drift()).select(*self._LINE)
        if self.counted_apart() and self.prep.value_cols:
            d = d.unionByName(MS.differences(self.prep, self.values()).select(*self._LINE))
        return self._listed(d)

    def top_differences(self, limit: Optional[int] = None) -> DataFrame:
        """First ``limit`` differences per column in key order (then values).

        For a duplicate key, a line per differing combination of values.
        """
        limit = self.cfg.max_differences if limit is None else limit
        if self.dealt():
            release(self._first)
            first = self._first = DLT.first_keys(self.prep, DLT.values(self.prep, self.light_rows()), limit).persist()  # few keys a column
            d = DLT.combinations(self.prep, DLT.values(self.prep, self.light_rows(only=first)), first, limit).select(*self._LINE)
        else:
            d = CMP.single_differences(self.prep, self.drift()).select(*self._LINE)
        if self.counted_apart() and self.prep.value_cols:
            d = d.unionByName(MS.first_differences(self.prep, self.values(), self.duplicate_pairs(), limit).select(*self._LINE))
        w = Window.partitionBy("column_name").orderBy(
            F.col(KEY).asc_nulls_first(), F.col("ls").asc_nulls_first(), F.col("rs").asc_nulls_first())
        return (self._listed(d).withColumn("rn", F.row_number().over(w))
                .where(F.col("rn") <= limit).drop(KEY, "ls", "rs", "left_rows", "right_rows"))

    def record_verdicts(self) -> DataFrame:
        """One row per joined key: its pairs and the columns in which any pair differs."""
        v = DLT.verdicts(self.prep, self.light_rows()) if self.dealt() else CMP.record_verdicts(self.prep, self.rows())
        if self.counted_apart():
            if self.prep.value_cols:
                more = MS.verdicts(self.prep, self.values(), self.duplicate_pairs())
            else:
                more = self.duplicate_keys().where(CMP.joined()).select(
                    self.prep.key_from_flat(), MS.product("n_l", "n_r", False).alias("pairs"),
                    F.lit(0).alias("differing_columns"), F.lit("").alias("differing_list"))
            v = v.unionByName(more)
        return v.select(
            F.lit(self.name).alias("table_name"),
            C.record_id(F.col(KEY), self.prep.keys).alias("record_id"),
            F.col("pairs").cast(CMP.PAIRS).alias("pairs"), "differing_columns", "differing_list")

    def fused(self) -> DataFrame:
        """One row: row, pair and missing totals and the matches of every column, all keys included."""
        s = self.summary()
        names = [f"m_{i}" for i in range(len(self.prep.value_cols))]
        parts = (self.light_totals() if self.dealt() else self.totals()).select(F.col("single_matching").cast(CMP.PAIRS).alias("matching"),
                                     *[F.col(m).cast(CMP.PAIRS).alias(m) for m in names])
        if self.counted_apart():
            parts = parts.unionByName(MS.matching_pairs(self.tuples(), self.duplicate_pairs()).toDF("matching"), allowMissingColumns=True)
            if names:
                per_col = MS.column_counts(self.prep, self.values(), self.duplicate_pairs()).agg(*[
                    F.max(F.when(F.col("ci") == i, F.col("matches"))).alias(m) for i, m in enumerate(names)])
                parts = parts.unionByName(per_col, allowMissingColumns=True)
            parts = parts.agg(*[F.sum(c).cast(CMP.PAIRS).alias(c) for c in ("matching", *names)])
        total = F.lit(s["joined_pairs"]).cast(CMP.PAIRS)
        known = {"left_total": "left_rows", "right_total": "right_rows"}
        return parts.select(
            F.lit(self.name).alias("table_name"),
            *[F.lit(s[c]).cast("long").alias(a) for a, c in known.items()],
            total.alias("total_records"), F.col("matching").alias("matching_records"),
            (total - F.col("matching")).cast(CMP.PAIRS).alias("mismatched_records"),
            *[F.lit(s[c]).cast("long").alias(c) for c in (CMP.MISSING_IN_RIGHT, CMP.MISSING_IN_LEFT)],
            *[F.col(m).alias(f"matches_{c}") for m, c in zip(names, self.prep.value_cols)])

    # -- missing records ------------------------------------------------------------
    def missing(self) -> DataFrame:
        """Every key found on one side only (uncapped)."""
        columns = (F.lit(self.name).alias("table_name"), KEY, "side", "record_id", "created_date", "last_modified")
        found = CMP.missing_keys(self.prep, self.drift()).select(*columns)
        s = self.summary()
        if s["duplicate_keys"] > s["duplicate_joined_keys"]:
            more = MS.missing_rows(self.prep, self.duplicate_keys(), s)
            found = found.unionByName(CMP.missing_keys(self.prep, more).select(*columns))
        return found

    def missing_totals(self) -> DataFrame:
        return self.key_summary().select(
            F.lit(self.name).alias("table_name"),
            F.col(CMP.MISSING_IN_RIGHT).cast("long").alias("missing_in_right"),
            F.col(CMP.MISSING_IN_LEFT).cast("long").alias("missing_in_left"),
        )

    def missing_sample(self, limit: Optional[int] = None) -> DataFrame:
        """First ``limit`` missing keys per direction, in key order."""
        limit = self.cfg.max_missing if limit is None else limit
        w = Window.partitionBy("side").orderBy(F.col(KEY).asc_nulls_first())
        return (self.missing().withColumn("rn", F.row_number().over(w))
                .where(F.col("rn") <= limit).drop(KEY))

    @classmethod
    def for_missing(cls, pair: TablePair, cfg: RunConfig, keep: bool = True) -> "Reconciliation":
        """A narrow reconciliation for missing records only: rows carry the
        key and the created / modified columns, nothing else."""
        full = prepare(pair, cfg)
        cols = [c for c in (full.created, full.modified) if c is not None]
        return cls(pair, cfg, columns=cols, keep=keep)

    # -- lifecycle ------------------------------------------------------------------
    def close(self) -> None:
        for df in (self._duplicates, self._heavy, self._light_totals, self._first, self._drift, self._packed, self._totals, self._digests,
                   self._tuples, self._values, self._key_summary, self._counts):
            release(df)
        self._duplicates = self._heavy = self._light_totals = self._first = self._drift = self._packed = self._totals = self._digests = self._tuples = self._values = None
        self._key_summary = self._counts = self._summary = None
