"""One pass over tables in which many keys are duplicates.

Where the duplicate keys are too many to broadcast, telling their rows from
the others would send every row over the network several times: to the join
with the set, to the comparison, to the value tuples and to the values. Here
the rows of all *light* keys are dealt out by key once, with those of keys
that have one row a side, and everything is counted where they lie: windows
by key tell ``n_l`` and ``n_r``, windows by key and canonical value the rows
a side that hold the value. A left row matches as many row pairs in a column
as right rows hold its value, so no values are unpivoted to be counted.

*Heavy* keys (duplicates that hold rows / HEAVY rows at least, so at most
HEAVY of them) never meet in one task: they are broadcast, their rows left out
of this pass and counted by :mod:`concord.operators.multiset`.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from concord.functions import canon as C
from concord.operators import compare as CMP
from concord.operators import multiset as MS
from concord.plans.prepare import KEY, SIDE, Prepared

#: Columns up to which each has a window of its own.
MOST_COLUMNS = 50
#: Cells that a task gets, on average: it sorts its rows once a column.
CELLS = 2_500_000


def fits(prep: Prepared, totals: Row) -> bool:
    """The table has more duplicate keys than a broadcast takes, and not too many columns."""
    return (totals["duplicate_joined_keys"] > 0 and totals["duplicate_key_bytes"] > CMP.broadcast_limit(prep.left.sparkSession)
            and 0 < len(prep.value_cols) <= MOST_COLUMNS)


def least_heavy(totals: Row) -> int:
    return max(2, -(-(totals["left_rows"] + totals["right_rows"]) // CMP.HEAVY))


def heavy_keys(prep: Prepared, totals: Row) -> DataFrame:
    """Key counts of the heavy keys."""
    return CMP.key_counts(prep, heavy_only=True).where(CMP.duplicate() & (F.col("n_l") + F.col("n_r") >= least_heavy(totals)))


def _named(prep: Prepared, keys: DataFrame) -> DataFrame:
    return F.broadcast(keys.select(*[F.col(k).alias(f"_d{k}") for k in prep.flat_keys()], "n_l", "n_r"))


def heavy_rows(prep: Prepared, heavy: DataFrame) -> DataFrame:
    """Rows of the heavy keys that are on both sides, with ``n_l`` and ``n_r``."""
    rows = prep.both_tagged()
    return rows.join(_named(prep, heavy.where(CMP.joined())), CMP.same_key(prep)).select(*rows.columns, "n_l", "n_r")


def _count(side: int, *by) -> Column:
    return F.count_if(F.col(SIDE) == side).over(Window.partitionBy(*by))


def tasks(prep: Prepared, totals: Row) -> int:
    """So many that a task's memory stays the same however large the tables; not fewer than the session's shuffles have."""
    cells = (totals["left_rows"] + totals["right_rows"]) * (len(prep.keys) + len(prep.value_cols))
    return max(int(prep.left.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-cells // CELLS))


def light_rows(prep: Prepared, totals: Row, heavy: DataFrame | None, only: DataFrame | None = None) -> DataFrame:
    """Rows of all other keys that are on both sides, dealt out by key: ``n_l``, ``n_r``, values ``v_i``, canonical ``c_i``.

    Of ``only`` (few flat keys), where given, no other key is dealt out.
    """
    rows, flat = prep.both_tagged(), prep.flat_keys()
    if heavy is not None:
        rows = rows.join(_named(prep, heavy), CMP.same_key(prep), "left_anti")
    if only is not None:
        rows = rows.join(F.broadcast(only.select(*[F.col(k).alias(f"_d{k}") for k in flat])), CMP.same_key(prep), "left_semi")
    rows = (rows.repartition(*flat) if only is not None else rows.repartition(tasks(prep, totals), *flat)).withColumns({"n_l": _count(0, *flat), "n_r": _count(1, *flat)})
    return rows.where(CMP.joined()).withColumns({f"c_{i}": C.canon(F.col(f"v_{i}"), t) for i, t in enumerate(prep.aligned)})


def counters(prep: Prepared, rows: DataFrame, pairs: int, columns: bool, record: bool) -> DataFrame:
    """One row like that of :func:`compare.single_counters`, of all row pairs of light keys; only what is asked for is counted."""
    n, flat = range(len(prep.value_cols)), prep.flat_keys()
    left = F.col(SIDE) == 0
    cast = (lambda c: c) if pairs <= MS.NARROW else CMP.wide
    total = lambda c: F.coalesce(F.sum(cast(c)), F.lit(0))
    seen = {f"r_{i}": _count(1, *flat, f"c_{i}") for i in n if columns}
    if record:
        seen["r"] = _count(1, *flat, *[f"c_{i}" for i in n])
    out = [total(F.when(left, F.col("n_r"))).alias("single_pairs")]
    if record:
        out.append(total(F.when(left, F.col("r"))).alias("single_matching"))
    for i in n if columns else ():
        null = F.col(f"c_{i}").isNull()
        out += [total(F.when(left, F.col(f"r_{i}"))).alias(f"m_{i}"), total(F.when(left & null, F.col("n_r"))).alias(f"nl_{i}"),
                total(F.when(~left & null, F.col("n_l"))).alias(f"nr_{i}")]
    return reduce(lambda df, c: df.withColumn(*c), seen.items(), rows).agg(*out)


def _shown(prep: Prepared, i: int, t: T.DataType) -> Column:
    """How a value is shown: a key with one row a side shows it as it is, others the canonical value they count."""
    v = C.text(F.col(f"c_{i}"), t)
    if isinstance(t, (T.StringType, T.BinaryType, T.FloatType, T.DoubleType)):
        v = F.when((F.col("n_l") == 1) & (F.col("n_r") == 1), F.col(f"v_{i}").cast("string")).otherwise(v)
    return C.display(v)


def values(prep: Prepared, rows: DataFrame) -> DataFrame:
    """(flat key, n_l, n_r, ci, v, shown) -> (cl, cr), as :func:`multiset.value_counts`, of the columns in which some pair differs.

    The first row of a value in its window stands for it.
    """
    flat = prep.flat_keys()
    cells = []
    for i, t in enumerate(prep.aligned):
        w = Window.partitionBy(*flat, f"c_{i}").orderBy(f"c_{i}")
        whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        rows = rows.withColumns({
            f"l_{i}": F.count_if(F.col(SIDE) == 0).over(whole), f"r_{i}": F.count_if(F.col(SIDE) == 1).over(whole),
            # of a key with one row a side, both rows stand for themselves where they differ
            f"f_{i}": F.row_number().over(w)})
        same = (F.col(f"l_{i}") == F.col("n_l")) & (F.col(f"r_{i}") == F.col("n_r"))
        cells.append(F.struct(
            F.lit(i).alias("ci"), C.text(F.col(f"c_{i}"), t).alias("v"), _shown(prep, i, t).alias("shown"),
            F.col(f"l_{i}").alias("cl"), F.col(f"r_{i}").alias("cr"), ((F.col(f"f_{i}") == 1) & ~same).alias("stands")))
    return rows.select(*flat, "n_l", "n_r", F.inline(F.filter(F.array(*cells), lambda x: x["stands"]))).drop("stands")


def differences(prep: Prepared, vc: DataFrame) -> DataFrame:
    """Lines as :func:`multiset.differences`, of values that lie by key: one more grouping in place joins the two of a line."""
    cl, cr, n_l, n_r = (F.col(c) for c in ("cl", "cr", "n_l", "n_r"))
    alone = ((cl == n_l) & (cr == 0)) | ((cr == n_r) & (cl == 0))
    flat = prep.flat_keys()
    rows = vc.where(((cl > 0) & (cr < n_r)) | ((cr > 0) & (cl < n_l))).select(
        *flat, "n_l", "n_r", "ci", alone.alias("alone"), F.when(~alone, F.col("v")).alias("own"), "v", "shown", "cl", "cr")
    lines = rows.groupBy(*flat, "n_l", "n_r", "ci", "alone", "own").agg(
        F.max(F.when(cl > 0, F.col("shown"))).alias("left_value"), F.max(F.when(cr > 0, F.col("shown"))).alias("right_value"),
        F.max(F.when(cl > 0, F.col("v"))).alias("ls"), F.max(F.when(cr > 0, F.col("v"))).alias("rs"),
        F.sum("cl").alias("cl"), F.sum("cr").alias("cr"))
    both = F.col("alone") & F.col("left_value").isNotNull() & F.col("right_value").isNotNull()
    return lines.select(
        prep.key_from_flat(), "ci", MS._name(prep), "left_value", "right_value", "ls", "rs", F.col("cl").alias("left_rows"),
        F.col("cr").alias("right_rows"), MS.product("cl", n_r - F.when(both, 0).otherwise(cr), False).alias("pairs"))


def verdicts(prep: Prepared, rows: DataFrame) -> DataFrame:
    """Per light key: its pairs, and the columns in which some pair differs."""
    n, flat = range(len(prep.value_cols)), prep.flat_keys()
    left = F.col(SIDE) == 0
    seen = {f"o_{i}": F.when(left, _count(1, *flat, f"c_{i}") < F.col("n_r")).otherwise(F.lit(False)) for i in n}
    per_key = reduce(lambda df, c: df.withColumn(*c), seen.items(), rows).groupBy(*flat, "n_l", "n_r").agg(
        *[F.bool_or(f"o_{i}").alias(f"o_{i}") for i in n])
    names = F.filter(F.array(*[F.when(F.col(f"o_{i}"), F.lit(c)) for i, c in enumerate(prep.value_cols)]), lambda x: x.isNotNull())
    return per_key.select(prep.key_from_flat(), MS.product("n_l", "n_r", False).alias("pairs"), names.alias("differing")).select(
        KEY, "pairs", F.size("differing").alias("differing_columns"), F.array_join("differing", ",").alias("differing_list"))


def first_keys(prep: Prepared, vc: DataFrame, limit: int) -> DataFrame:
    """(key, flat key, ci): of every column, the keys among which its first ``limit`` differing combinations of values lie.

    Each key of ``limit`` at least comes with what it gives, so few keys need to be looked at again.
    """
    flat = prep.flat_keys()
    d_l, d_r, both = (F.count_if(c) for c in (F.col("cl") > 0, F.col("cr") > 0, (F.col("cl") > 0) & (F.col("cr") > 0)))
    per_key = vc.groupBy(*flat, "n_l", "n_r", "ci").agg(d_l.alias("d_l"), d_r.alias("d_r"), both.alias("d_both"))
    lines = CMP.wide(F.col("d_l")) * CMP.wide(F.col("d_r")) - F.col("d_both")
    w = Window.partitionBy("ci").orderBy(F.col(KEY).asc_nulls_first())
    first = per_key.select(*flat, prep.key_from_flat(), "ci", lines.alias("lines")).where("lines > 0").withColumn(
        "at", F.row_number().over(w)).where(F.col("at") <= limit)
    return first.select(*flat, KEY, "ci", F.least("lines", F.lit(limit)).alias("n"))


def combinations(prep: Prepared, vc: DataFrame, first: DataFrame, limit: int) -> DataFrame:
    """Differing value combinations among which each column's first ``limit`` lie; ``first``: (flat key, ci, n) of :func:`first_keys`."""
    flat = prep.flat_keys()
    w = Window.partitionBy("ci").orderBy(F.col(KEY).asc_nulls_first()).rowsBetween(Window.unboundedPreceding, -1)
    wanted = first.withColumn("before", F.coalesce(F.sum("n").over(w), F.lit(0))).where(F.col("before") < limit)
    wanted = F.broadcast(wanted.select(*[F.col(k).alias(f"_d{k}") for k in flat], F.col("ci").alias("_dci")))
    own = vc.join(wanted, CMP.same_key(prep) & (F.col("ci") == F.col("_dci")), "left_semi")
    by_value = Window.partitionBy(*flat, "ci").orderBy(F.col("v").asc_nulls_first())

    def side(count: str, letter: str) -> DataFrame:
        return own.where(F.col(count) > 0).withColumn("rk", F.row_number().over(by_value)).where(F.col("rk") <= limit + 1).select(
            *[F.col(k).alias(f"{letter}{k}") for k in flat], F.col("ci").alias(f"{letter}ci"), F.col("v").alias(f"{letter}s"),
            F.col("shown").alias(f"{letter}_shown"), F.col(count).alias(f"{letter}_rows"))

    found = side("cl", "l").join(side("cr", "r"), CMP.same_key(prep, "l", "r") & (F.col("lci") == F.col("rci"))).where(
        ~F.col("ls").eqNullSafe(F.col("rs")))
    key = F.struct(*[F.col(f"l{k}").alias(c) for k, c in zip(flat, prep.keys)]).alias(KEY)
    return found.select(key, F.col("lci").alias("ci"), "l_shown", "r_shown", "ls", "rs", "l_rows", "r_rows").select(
        KEY, "ci", MS._name(prep), F.col("l_shown").alias("left_value"), F.col("r_shown").alias("right_value"), "ls", "rs",
        F.col("l_rows").alias("left_rows"), F.col("r_rows").alias("right_rows"), MS.product("l_rows", "r_rows", False).alias("pairs"))
