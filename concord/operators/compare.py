"""Field-by-field comparison (joins J1-J4, aggregates A4/A5/A11).

Semantics to reproduce: the two sides are joined on the key (many-to-many,
NULL keys match each other); every joined *pair* of rows is compared column
by column; a record matches when all its compared columns match; keys found
on one side only are "missing" on the other.

Plan, in two steps:

* **Key counts.** The keys alone of both sides are grouped (a hash aggregate
  of two counters, combined on the map side, so a key holding a third of all
  rows arrives as one buffer per task; of many rows, the light keys are dealt
  out uncombined, so that a task's memory is bounded). That gives row and key totals, both
  missing totals, the number of row pairs, and which keys are *duplicate*
  (two rows or more on a side).
* **Rows.** All other keys have one row a side: one full outer join on the
  key, with 64-bit counters, decides them. Rows of duplicate keys are left
  out of it and go to :mod:`concord.operators.multiset`, which counts values
  rather than pairs. Typical tables have none and skip that step.

Duplicate keys are told from the others by a join with their set: broadcast
where its measured size allows; else the heaviest keys, of which there are at
most ``HEAVY`` by their share of the rows, are broadcast and the light rest
is shuffled, so that no hot key meets in one task.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from concord.functions import canon as C
from concord.functions import timecols as TC
from concord.plans.prepare import KEY, SIDE, Prepared
from concord.sources.schema import quoted

MISSING_IN_RIGHT = "missing_in_right"
MISSING_IN_LEFT = "missing_in_left"

#: Type of everything that counts row pairs: a hot key's n_l * n_r passes 64 bits.
PAIRS = "decimal(38,0)"
#: Most keys that are broadcast for their weight alone: those with rows / HEAVY rows at least.
HEAVY = 1000
#: Rows whose keys Spark groups in tasks of its own choice; of more rows, a task gets so many at most, on average.
ROWS_A_TASK = 2_000_000
#: Hash buckets by which heavy keys are looked for before keys are counted.
BUCKETS = 1 << 16
#: Per-row overhead added to the measured key bytes when sizing a broadcast.
ROW_OVERHEAD_BYTES = 32


# -- key counts -------------------------------------------------------------------

def _bucket(prep: Prepared) -> Column:
    return F.pmod(F.xxhash64(*prep.flat_keys()), F.lit(BUCKETS)).cast("int")


def key_weights(prep: Prepared) -> tuple[int, list[int]]:
    """Rows of both sides and, where they are many, the buckets that hold rows / HEAVY of them at least (HEAVY at most); taken once."""
    if prep.key_weights is None:
        keys = prep.both_tagged(values=False)
        n, heavy = keys.count(), []
        if n > ROWS_A_TASK:
            found = keys.groupBy(_bucket(prep).alias("b")).agg(F.count(F.lit(1)).alias("n"))
            heavy = sorted(r["b"] for r in found.where(F.col("n") * HEAVY >= n).collect())
        prep.key_weights = n, heavy
    return prep.key_weights


def key_counts(prep: Prepared, heavy_only: bool = False) -> DataFrame:
    """One row per distinct key (NULL-safe) over both sides: ``n_l``, ``n_r`` rows.

    Of many rows, those in light buckets are dealt to so many tasks that the
    keys a task holds don't grow with the table; keys in heavy buckets are
    combined before their shuffle. With ``heavy_only``, keys of fewer than
    rows / HEAVY rows may be left out.
    """
    s, flat = F.col(SIDE), prep.flat_keys()
    grouped = lambda rows: rows.groupBy(*flat).agg(F.count_if(s == 0).alias("n_l"), F.count_if(s == 1).alias("n_r"))
    rows = prep.both_tagged(values=False)
    n, heavy = key_weights(prep)
    if n <= ROWS_A_TASK:
        return grouped(rows)
    weighty = _bucket(prep).isin(heavy)
    if heavy_only:
        return grouped(rows.where(weighty))
    tasks = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-n // ROWS_A_TASK))
    light = grouped(rows.where(~weighty).repartition(tasks, *flat))
    return light.unionByName(grouped(rows.where(weighty))) if heavy else light


def joined() -> Column:
    """The key is on both sides."""
    return (F.col("n_l") > 0) & (F.col("n_r") > 0)


def duplicate() -> Column:
    return (F.col("n_l") > 1) | (F.col("n_r") > 1)


def wide(count: Column) -> Column:
    """A 64-bit count as a factor whose products and sums don't overflow."""
    return count.cast("decimal(19,0)")


#: Pair counts are summed as two 64-bit sums, of n_l * (n_r div SPLIT) and n_l * (n_r mod SPLIT): decimals a row are slow.
SPLIT = 1 << 20


def _pairs(cond: Column, name: str) -> list[Column]:
    high, low = F.shiftright("n_r", 20), F.col("n_r").bitwiseAND(F.lit(SPLIT - 1))
    return [F.sum(F.when(cond, F.col("n_l") * part)).alias(f"{name}{end}") for part, end in ((high, "__hi"), (low, "__lo"))]


def _joined_sums(name: str) -> Column:
    high, low = (F.coalesce(F.col(f"{name}{end}"), F.lit(0)).cast("decimal(19,0)") for end in ("__hi", "__lo"))
    return (high * F.lit(SPLIT) + low).cast(PAIRS).alias(name)


def key_summary(prep: Prepared, counts: DataFrame) -> DataFrame:
    """One row: every total that the keys alone tell."""
    n_l, n_r = F.col("n_l"), F.col("n_r")
    size = F.octet_length(F.to_json(F.struct(*prep.flat_keys())))
    out = counts.agg(
        F.sum(n_l).alias("left_rows"),
        F.sum(n_r).alias("right_rows"),
        F.count_if(n_l > 0).alias("left_keys"),
        F.count_if(n_r > 0).alias("right_keys"),
        F.count_if(n_r == 0).alias(MISSING_IN_RIGHT),
        F.count_if(n_l == 0).alias(MISSING_IN_LEFT),
        F.count_if(joined()).alias("joined_keys"),
        F.count_if(duplicate()).alias("duplicate_keys"),
        F.count_if(duplicate() & joined()).alias("duplicate_joined_keys"),
        # size of the duplicate-key set, measured (sizes its broadcast)
        F.sum(F.when(duplicate(), size + ROW_OVERHEAD_BYTES)).alias("duplicate_key_bytes"),
        F.max(n_l + n_r).alias("largest_key"),
        *_pairs(joined(), "joined_pairs"),
        *_pairs(joined() & duplicate(), "duplicate_pairs"),
    )
    # sums over an empty input are NULL: report zeros instead
    return out.select(*[
        _joined_sums(c[:-4]) if c.endswith("__hi") else F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
        for c in out.columns if not c.endswith("__lo")])


# -- rows of duplicate keys, and all others --------------------------------------------

def broadcast_limit(spark) -> int:
    """The session's broadcast threshold in bytes; sizes may have a suffix (``64k``, ``10MB``)."""
    value = spark.conf.get("spark.sql.autoBroadcastJoinThreshold", "10485760")
    m = re.fullmatch(r"\s*(-?\d+)\s*([kmgtp]?)(?:i?b)?\s*", value.lower())
    if not m:
        return -1  # not a size: nothing is broadcast on its account
    return int(m[1]) << 10 * " kmgtp".index(m[2] or " ")


def same_key(prep: Prepared, left: str = "", right: str = "_d") -> Column:
    """The flat key columns with the two prefixes agree (NULL with NULL)."""
    return reduce(lambda a, b: a & b, [F.col(f"{left}{k}").eqNullSafe(F.col(f"{right}{k}")) for k in prep.flat_keys()])


def split_by_keys(prep: Prepared, rows: DataFrame, keys: DataFrame, totals: Row, inside: bool) -> DataFrame:
    """``rows`` whose key is among the duplicate ``keys`` (with the keys' ``n_l``, ``n_r``), or is not.

    ``keys``: key counts of (some) duplicate keys; ``totals``: the key summary.
    """
    own = keys.select(*[F.col(k).alias(f"_d{k}") for k in prep.flat_keys()], "n_l", "n_r")
    if 0 <= totals["duplicate_key_bytes"] <= broadcast_limit(rows.sparkSession):
        parts = [F.broadcast(own)]
    else:
        n = F.col("n_l") + F.col("n_r")
        least = max(2, -(-(totals["left_rows"] + totals["right_rows"]) // HEAVY))
        parts = [F.broadcast(own.where(n >= least)), own.where(n < least)]
    same = same_key(prep)
    if not inside:
        return reduce(lambda df, p: df.join(p, same, "left_anti"), parts, rows)
    found = []
    for p in parts:  # rows of heavy keys don't go to the shuffled join
        found.append(rows.join(p, same).select(*rows.columns, "n_l", "n_r"))
        rows = rows.join(p, same, "left_anti")
    return reduce(lambda a, b: a.unionByName(b), found)


# -- keys with one row a side ----------------------------------------------------------

def single_rows(prep: Prepared, duplicates: DataFrame | None, totals: Row | None, only: DataFrame | None = None) -> DataFrame:
    """One row per key that has at most one row a side: a full outer join.

    ``duplicates`` (keys that have more, with the key summary ``totals``) are
    left out; of ``only``, where given, no other key is read.
    Columns: the key, ``n_l`` / ``n_r`` (0 or 1), each side's values as flat
    columns ``l_i`` / ``r_i`` and ``e_i`` (cells equal, for joined keys).
    """
    n = len(prep.value_cols)

    def side(i: int, letter: str) -> DataFrame:
        rows = prep.rows(i)
        if duplicates is not None:
            rows = split_by_keys(prep, rows, duplicates, totals, inside=False)
        if only is not None:
            rows = rows.join(only, same_key(prep), "left_semi")
        return rows.selectExpr(*[f"{k} as {letter}{k}" for k in prep.flat_keys()], f"1L as n_{letter}",
                               *[f"v_{j} as {letter}_{j}" for j in range(n)])

    left, right = side(0, "l"), side(1, "r")
    both = left.join(right, same_key(prep, "l", "r"), "full_outer")
    key = ", ".join(f"coalesce(l{f}, r{f}) as {quoted(k)}" for f, k in zip(prep.flat_keys(), prep.keys))
    return both.selectExpr(
        f"struct({key}) as {KEY}", "coalesce(n_l, 0L) as n_l", "coalesce(n_r, 0L) as n_r",
        *[f"{s}_{j}" for s in "lr" for j in range(n)],
        *[f"{C.same_sql(f'l_{j}', f'r_{j}', prep.aligned[j])} as e_{j}" for j in range(n)])


def value(side: str, i: int) -> Column:
    return F.col(f"{side}_{i}")


def cell_equal(prep: Prepared, i: int) -> Column:
    return F.col(f"e_{i}")


def all_equal(prep: Prepared) -> Column:
    eqs = [cell_equal(prep, i) for i in range(len(prep.value_cols))]
    return reduce(lambda a, b: a & b, eqs, F.lit(True))


def differs(prep: Prepared) -> Column:
    """The key is missing on a side, or some cell differs."""
    return ~joined() | ~all_equal(prep)


def single_counters(prep: Prepared) -> list[Column]:
    """Aggregates over :func:`single_rows`; a joined key is one row pair."""
    joined, every = "n_l > 0 and n_r > 0", " and ".join(f"e_{i}" for i in range(len(prep.value_cols))) or "true"
    out = [f"count_if({joined}) as single_pairs", f"count_if({joined} and {every}) as single_matching"]
    for i, t in enumerate(prep.aligned):
        out += [f"count_if({joined} and e_{i}) as m_{i}",
                f"count_if({joined} and {C.is_null_sql(f'l_{i}', t)}) as nl_{i}",
                f"count_if({joined} and {C.is_null_sql(f'r_{i}', t)}) as nr_{i}"]
    return [F.expr(x) for x in out]


COUNTS = ("matches", "mismatches", "null_left", "null_right")


def column_counts(prep: Prepared, totals: DataFrame) -> DataFrame:
    """Unpivot the counters into (ci, column_name, matches, mismatches, null_left, null_right)."""
    if not prep.value_cols:
        return totals.select(F.lit(0).alias("ci"), F.lit("").alias("column_name"),
                             *[F.lit(0).cast(PAIRS).alias(c) for c in COUNTS]).where(F.lit(False))
    counts = [f"{i}, cast(m_{i} as {PAIRS}), cast(single_pairs - m_{i} as {PAIRS}), cast(nl_{i} as {PAIRS}), cast(nr_{i} as {PAIRS})"
              for i in range(len(prep.value_cols))]
    names = F.lit(prep.value_cols)
    return (totals.selectExpr(f"stack({len(counts)}, {', '.join(counts)}) as (ci, {', '.join(COUNTS)})")
            .select("ci", F.get(names, "ci").alias("column_name"), *COUNTS))


# -- differences -------------------------------------------------------------------------

def single_differences(prep: Prepared, rows: DataFrame) -> DataFrame:
    """Mismatching cells of joined keys in ``rows``: one row per (key, column).

    Cells are filtered inside the array before ``inline``, so matching
    cells never become rows.
    """
    cells = [
        f"named_struct('ci', {i}, 'differs', not e_{i}, "
        f"'left_value', coalesce(cast(l_{i} as string), 'NULL'), 'right_value', coalesce(cast(r_{i} as string), 'NULL'), "
        f"'ls', {C.canon_text_sql(f'l_{i}', t)}, 'rs', {C.canon_text_sql(f'r_{i}', t)})"
        for i, t in enumerate(prep.aligned)
    ]
    one = [F.lit(1).cast("long").alias(c) for c in ("left_rows", "right_rows")]
    if not cells:
        empty = ("ci int", "column_name string", "left_value string", "right_value string", "ls string", "rs string")
        return rows.where(F.lit(False)).select(
            KEY, *[F.lit(None).cast(c.split()[1]).alias(c.split()[0]) for c in empty], *one, F.lit(1).cast(PAIRS).alias("pairs"))
    return (
        rows.where(joined())
        .selectExpr(KEY, f"inline(filter(array({', '.join(cells)}), x -> x.differs))")
        .select(KEY, "ci", F.get(F.lit(prep.value_cols), "ci").alias("column_name"), "left_value", "right_value", "ls", "rs", *one, F.lit(1).cast(PAIRS).alias("pairs"))
    )


def record_verdicts(prep: Prepared, rows: DataFrame) -> DataFrame:
    """Per joined key of ``rows``: pairs, number and names of differing columns."""
    flags = [F.when(~cell_equal(prep, i), F.lit(c)) for i, c in enumerate(prep.value_cols)]
    names = F.filter(F.array(*flags), lambda x: x.isNotNull()) if flags else F.array().cast("array<string>")
    return (
        rows.where(joined())
        .select(KEY, names.alias("differing"))
        .select(KEY, F.lit(1).cast(PAIRS).alias("pairs"), F.size("differing").alias("differing_columns"),
                F.array_join("differing", ",").alias("differing_list"))
    )


# -- missing keys ---------------------------------------------------------------

def missing_keys(prep: Prepared, rows: DataFrame) -> DataFrame:
    """Keys of ``rows`` present on one side only, with that side's created / modified."""
    def time_of(side: str, name):
        if name is None:
            return F.lit("N/A")
        if name in prep.keys:
            return TC.fmt_time(F.col(KEY)[name], prep.key_types[prep.keys.index(name)])
        i = prep.value_cols.index(name)
        return TC.fmt_time(value(side, i), prep.aligned[i])

    n_r = F.col("n_r")
    return (
        rows.where(~joined())
        .select(
            KEY,
            F.when(n_r == 0, F.lit(MISSING_IN_RIGHT)).otherwise(F.lit(MISSING_IN_LEFT)).alias("side"),
            C.record_id(F.col(KEY), prep.keys).alias("record_id"),
            F.when(n_r == 0, time_of("l", prep.created)).otherwise(time_of("r", prep.created)).alias("created_date"),
            F.when(n_r == 0, time_of("l", prep.modified)).otherwise(time_of("r", prep.modified)).alias("last_modified"),
        )
    )
