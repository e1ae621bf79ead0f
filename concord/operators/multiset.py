"""Exact pair statistics for duplicate keys.

For a key ``k`` with ``n_l`` left and ``n_r`` right rows, the reference
semantics compare all ``n_l * n_r`` row pairs. Emitting those pairs is
quadratic in the size of a hot key, so the counts are derived from value
multiplicities instead::

    matching pairs in column c  = sum over values v of  L(k,c,v) * R(k,c,v)
    NULL-left pairs in column c = L(k,c,NULL) * n_r(k)
    matching record pairs       = sum over value tuples t of  L(k,t) * R(k,t)

where ``L(k,c,v)`` counts left rows of key ``k`` whose column ``c`` has
canonical value ``v`` (NULL groups with NULL, so NULL matches NULL).

The rows of duplicate keys are read once and collapse into one kept table of
``(key, tuple) -> cl, cr``; everything else is counted from it. Each count is
a hash aggregation with map-side combine, shuffled by ``(k, t)`` or
``(k, c, v)``: a hot key spreads over its distinct values, and its identical
copies collapse before the shuffle.

Differences are listed in linear form: one line per (key, column, value) with
its rows on either side, never one per combination of values. Combinations are
formed only for the first-``N`` list, of the few keys that it reaches.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

from concord.functions import canon as C
from concord.operators.compare import COUNTS, PAIRS, joined, split_by_keys, wide
from concord.plans.prepare import KEY, SIDE, Prepared

#: Row pairs up to which products of counts are summed as 64-bit numbers.
NARROW = (1 << 63) - 1


def product(a: str, b: Column | str, narrow: bool) -> Column:
    """Row pairs of two counts; 64-bit where all pairs of the table fit."""
    b = F.col(b) if isinstance(b, str) else b
    return F.col(a) * b if narrow else (wide(F.col(a)) * wide(b)).cast(PAIRS)


def tuple_counts(prep: Prepared, duplicates: DataFrame, totals: Row) -> DataFrame:
    """(flat key, n_l, n_r, canonical values c_i) -> (cl, cr) of duplicate keys on both sides."""
    return counted(prep, split_by_keys(prep, prep.both_tagged(), duplicates.where(joined()), totals, inside=True))


def counted(prep: Prepared, rows: DataFrame) -> DataFrame:
    """Tagged ``rows`` with ``n_l`` and ``n_r``, grouped by key and canonical values."""
    s = F.col(SIDE)
    cells = [C.canon(F.col(f"v_{i}"), t).alias(f"c_{i}") for i, t in enumerate(prep.aligned)]
    own = rows.select(*prep.flat_keys(), "n_l", "n_r", SIDE, *cells)
    return own.groupBy(*[c for c in own.columns if c != SIDE]).agg(
        F.count_if(s == 0).alias("cl"), F.count_if(s == 1).alias("cr"))


def value_counts(prep: Prepared, tuples: DataFrame) -> DataFrame:
    """(key, n_l, n_r, ci, v) -> (cl, cr): rows per side holding canonical value v."""
    cells = F.array(*[
        F.struct(F.lit(i).alias("ci"), C.text(F.col(f"c_{i}"), t).alias("v")) for i, t in enumerate(prep.aligned)])
    flat = [*prep.flat_keys(), "n_l", "n_r"]
    return (
        tuples.select(*flat, "cl", "cr", F.inline(cells))
        .groupBy(*flat, "ci", "v").agg(F.sum("cl").alias("cl"), F.sum("cr").alias("cr"))
        .select(prep.key_from_flat(), "n_l", "n_r", "ci", "v", "cl", "cr")
    )


def _name(prep: Prepared) -> Column:
    return F.element_at(F.array(*[F.lit(c) for c in prep.value_cols]), F.col("ci") + 1).alias("column_name")


def column_counts(prep: Prepared, vc: DataFrame, pairs: int) -> DataFrame:
    """(ci, column_name, matches, mismatches, null_left, null_right) over duplicate keys; ``pairs``: their row pairs."""
    narrow = pairs <= NARROW
    null = lambda c: F.when(F.col("v").isNull(), c).otherwise(F.lit(0))
    total = F.lit(Decimal(pairs)).cast(PAIRS)
    return vc.groupBy("ci").agg(
        F.sum(product("cl", "cr", narrow)).alias("matches"),
        F.sum(null(product("cl", "n_r", narrow))).alias("null_left"),
        F.sum(null(product("cr", "n_l", narrow))).alias("null_right"),
    ).withColumn("mismatches", total - F.col("matches")).select("ci", _name(prep), *[F.col(c).cast(PAIRS).alias(c) for c in COUNTS])


def matching_pairs(tuples: DataFrame, pairs: int) -> DataFrame:
    """One row: record pairs of duplicate keys that match on every column."""
    return tuples.agg(F.coalesce(F.sum(product("cl", "cr", pairs <= NARROW)), F.lit(0)).cast(PAIRS).alias("duplicate_matching"))


def key_columns(vc: DataFrame, pairs: int) -> DataFrame:
    """(key, ci) -> n_l, n_r, m matching pairs, and ``lines``: differing combinations of distinct values."""
    d_l, d_r, both = (F.count_if(c) for c in (F.col("cl") > 0, F.col("cr") > 0, (F.col("cl") > 0) & (F.col("cr") > 0)))
    narrow = pairs <= NARROW
    return vc.groupBy(KEY, "n_l", "n_r", "ci").agg(
        F.sum(product("cl", "cr", narrow)).alias("m"), d_l.alias("d_l"), d_r.alias("d_r"), both.alias("d_both")).select(
        KEY, "n_l", "n_r", "ci", "m", (wide(F.col("d_l")) * wide(F.col("d_r")) - F.col("d_both")).alias("lines"))


def verdicts(prep: Prepared, vc: DataFrame, pairs: int) -> DataFrame:
    """Per duplicate key: its pairs, and the columns in which some pair differs."""
    names = F.array(*[F.lit(c) for c in prep.value_cols])
    per_key = key_columns(vc, pairs).groupBy(KEY, "n_l", "n_r").agg(
        F.array_sort(F.collect_list(F.when(F.col("lines") > 0, F.col("ci")))).alias("cis"))  # one entry a column at most
    return per_key.select(
        KEY, product("n_l", "n_r", False).alias("pairs"), F.size("cis").alias("differing_columns"),
        F.array_join(F.transform("cis", lambda i: F.element_at(names, i + 1)), ",").alias("differing_list"))


def differences(prep: Prepared, vc: DataFrame) -> DataFrame:
    """Differences of duplicate keys in linear form: lines per (key, column, value).

    A value differs where some pair holds it on one side only. Where a column
    has one value on each side, the line shows both, as for a key with one row
    a side. Else every differing value has a line of its own: it stands under
    ``left_value`` if left rows have it and under ``right_value`` if right rows
    have it (NULL where the side has no such row). ``left_rows`` and
    ``right_rows`` count the rows; ``pairs`` counts the differing row pairs
    whose left value is the line's, so that a column's lines add up.
    """
    cl, cr, n_l, n_r = (F.col(c) for c in ("cl", "cr", "n_l", "n_r"))
    differing = vc.where(((cl > 0) & (cr < n_r)) | ((cr > 0) & (cl < n_l)))
    alone = ((cl == n_l) & (cr == 0)) | ((cr == n_r) & (cl == 0))  # a side's only value, not on the other side
    shown = lambda count: F.when(count > 0, C.display(F.col("v")))
    columns = (KEY, "n_l", "n_r", "ci")
    lines = differing.where(~alone).select(
        *columns, shown(cl).alias("left_value"), shown(cr).alias("right_value"),
        F.when(cl > 0, F.col("v")).alias("ls"), F.when(cr > 0, F.col("v")).alias("rs"), "cl", "cr")
    # at most two rows of a (key, column) are such; both together are one line
    only = differing.where(alone).select(*columns, "v", "cl", "cr").groupBy(*columns).agg(
        F.max(F.when(cl > 0, C.display(F.col("v")))).alias("left_value"), F.max(F.when(cr > 0, C.display(F.col("v")))).alias("right_value"),
        F.max(F.when(cl > 0, F.col("v"))).alias("ls"), F.max(F.when(cr > 0, F.col("v"))).alias("rs"),
        F.sum("cl").alias("cl"), F.sum("cr").alias("cr"))
    both = F.col("left_value").isNotNull() & F.col("right_value").isNotNull() & ~F.col("ls").eqNullSafe(F.col("rs"))
    pairs = product("cl", n_r - F.when(both, 0).otherwise(cr), False)
    return lines.unionByName(only).select(
        KEY, "ci", _name(prep), "left_value", "right_value", "ls", "rs", F.col("cl").alias("left_rows"), F.col("cr").alias("right_rows"),
        pairs.alias("pairs"))


def first_differences(prep: Prepared, vc: DataFrame, pairs: int, limit: int) -> DataFrame:
    """Differing value combinations among which each column's first ``limit`` lie, in order of key and values.

    A (key, column) gives as many combinations as its distinct values tell, so
    only the first keys of a column are needed: those before which fewer than
    ``limit`` combinations were counted. Of such a key, the first ``limit``
    differing combinations lie among the first ``limit + 1`` distinct values of
    each side (each left value differs from all right values but at most one),
    and only those are paired.
    """
    w = Window.partitionBy("ci").orderBy(F.col(KEY).asc_nulls_first())
    first = (key_columns(vc, pairs).where("lines > 0").select(KEY, "ci", F.least("lines", F.lit(limit)).alias("n"), F.row_number().over(w).alias("at"))
             .where(F.col("at") <= limit))
    before = F.coalesce(F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    first = first.withColumn("before", before).where(F.col("before") < limit).select(KEY, "ci")
    # at most ``limit`` keys a column
    own = vc.join(F.broadcast(first), [KEY, "ci"], "left_semi")
    by_value = Window.partitionBy(KEY, "ci").orderBy(F.col("v").asc_nulls_first())

    def side(count_col: str, value_alias: str, count_alias: str) -> DataFrame:
        return own.where(F.col(count_col) > 0).withColumn("rk", F.row_number().over(by_value)).where(F.col("rk") <= limit + 1).select(
            KEY, "ci", F.col("v").alias(value_alias), F.col(count_col).alias(count_alias))

    found = side("cl", "lv", "left_rows").join(side("cr", "rv", "right_rows"), [KEY, "ci"]).where(~F.col("lv").eqNullSafe(F.col("rv")))
    return found.select(
        KEY, "ci", _name(prep), C.display(F.col("lv")).alias("left_value"), C.display(F.col("rv")).alias("right_value"),
        F.col("lv").alias("ls"), F.col("rv").alias("rs"), "left_rows", "right_rows",
        product("left_rows", "right_rows", False).alias("pairs"))


def missing_rows(prep: Prepared, duplicates: DataFrame, totals: Row) -> DataFrame:
    """Duplicate keys of one side only, as :func:`compare.single_rows`: the greatest value tuple stands for a key."""
    rows = split_by_keys(prep, prep.both_tagged(), duplicates.where(~joined()), totals, inside=True)
    n = len(prep.value_cols)
    best = rows.groupBy(*prep.flat_keys(), "n_l", "n_r").agg(
        F.max(F.struct(*[F.col(f"v_{i}") for i in range(n)]) if n else F.lit(0)).alias("t"))
    kind = lambda i: prep.aligned[i].simpleString()
    return best.select(
        prep.key_from_flat(), "n_l", "n_r",
        *[(F.when(F.col(f"n_{s}") > 0, F.col("t")[f"v_{i}"]) if n else F.lit(None)).cast(kind(i)).alias(f"{s}_{i}")
          for s in "lr" for i in range(n)],
        *[F.lit(False).alias(f"e_{i}") for i in range(n)])
