"""Table pairs derived by Spark from the driver's test tables.

The reference ships no data, so the comparisons run on pairs derived from
the TPC-H-like tables. Every pair is computed from whole tables; the modulo
rules below *are* the drift (which rows go missing or change), not a way of
shrinking the input.

The same derivations exist as SQL text in :mod:`concord.sources.fixture_sql`
for the DuckDB oracle.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from concord.config import TablePair
from concord.sources.readers import testdata_table

# Fixed value: the pinned clock for the orders pair.
AS_OF = datetime(2001, 8, 1, 0, 0, 0)
EXTRA_ID_OFFSET = 10_000_000


def _note(id_: F.Column) -> F.Column:
    r = id_ % 11
    return (
        F.when(r == 0, F.lit(None).cast("string"))
        .when(r == 1, F.lit(""))
        .when(r == 2, F.lit("   "))
        .otherwise(F.concat(F.lit("n"), (id_ % 7).cast("string")))
    )


def orders_left(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = testdata_table(spark, sf_dir, "orders")
    id_ = F.col("o_orderkey")
    od = F.col("o_orderdate")
    r5 = id_ % 5
    return o.select(
        id_.alias("id"),
        F.col("o_custkey").alias("cust"),
        F.col("o_orderstatus").alias("status"),
        F.col("o_totalprice").cast("decimal(18,2)").alias("price"),
        F.when(id_ % 71 == 0, F.lit(None).cast("string"))
        .otherwise(F.col("o_orderpriority")).alias("priority"),
        _note(id_).alias("note"),
        od.alias("creation_time"),
        F.when(r5 == 0, F.lit(None).cast("timestamp_ntz"))
        .when(r5 == 1, od)
        .when(r5 == 2, od + F.expr("INTERVAL 3 HOURS"))
        .otherwise(od + F.expr("INTERVAL 2 DAYS"))
        .alias("last_modified_time"),
    )


def orders_right(left: DataFrame) -> DataFrame:
    """Replica of ``orders_left`` with dropped, changed and extra rows."""
    id_ = F.col("id")
    note = F.col("note")
    drifted = left.filter(id_ % 97 != 0).select(
        id_,
        F.col("cust"),
        F.when(id_ % 53 == 0, F.lit("X")).otherwise(F.col("status")).alias("status"),
        F.when(id_ % 59 == 0, (F.col("price") + F.lit(0.01).cast("decimal(3,2)")).cast("decimal(18,2)"))
        .otherwise(F.col("price")).alias("price"),
        F.col("priority"),
        F.when((id_ % 11 == 0) & (id_ % 2 == 0), F.lit(""))
        .when(id_ % 11 == 2, F.lit(" "))
        .when(id_ % 61 == 0, F.concat(F.lit("  "), note, F.lit(" ")))
        .when(id_ % 73 == 0, F.concat(note, F.lit("!")))
        .otherwise(note).alias("note"),
        F.col("creation_time"),
        F.when(id_ % 67 == 0, F.col("last_modified_time") + F.expr("INTERVAL 1 DAY"))
        .otherwise(F.col("last_modified_time")).alias("last_modified_time"),
    )
    extra = left.filter(id_ % 101 == 0).withColumn("id", id_ + F.lit(EXTRA_ID_OFFSET))
    return drifted.unionByName(extra)


def orders_pair(spark: SparkSession, sf_dir: str, name: str = "orders") -> TablePair:
    left = orders_left(spark, sf_dir)
    return TablePair(name=name, left=left, right=orders_right(left), keys=("id",))


def customer_pair(spark: SparkSession, sf_dir: str) -> TablePair:
    """Customer vs a replica whose balance drifted by 1 where key % 13 = 0.

    No time columns: window, scenarios and retention report NO_TIME_COLUMNS.
    """
    c = testdata_table(spark, sf_dir, "customer")
    right = c.withColumn(
        "c_acctbal",
        F.when(F.col("c_custkey") % 13 == 0, F.col("c_acctbal") + F.lit(1.0)).otherwise(F.col("c_acctbal")),
    )
    return TablePair(name="customer", left=c, right=right, keys=("c_custkey",))


def lineitem_pair(spark: SparkSession, sf_dir: str) -> TablePair:
    """Lineitem vs lineitem without ship year 1999, keyed on a non-unique key.

    ``(l_orderkey, l_linenumber)`` repeats in the generated data, so this
    pair exercises the duplicate-key (multiset) path on purpose.
    """
    li = testdata_table(spark, sf_dir, "lineitem")
    right = li.filter(F.year("l_shipdate") != 1999)
    return TablePair(name="lineitem", left=li, right=right, keys=("l_orderkey", "l_linenumber"))


def lineitem_drift_pair(spark: SparkSession, sf_dir: str) -> TablePair:
    """Duplicate-key pair with value drift: quantity +1 where partkey % 7 = 0,
    discount zeroed where suppkey % 5 = 0, and ship year 1999 dropped."""
    li = testdata_table(spark, sf_dir, "lineitem")
    right = li.filter(F.year("l_shipdate") != 1999).select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber",
        F.when(F.col("l_partkey") % 7 == 0, F.col("l_quantity") + F.lit(1.0))
        .otherwise(F.col("l_quantity")).alias("l_quantity"),
        "l_extendedprice",
        F.when(F.col("l_suppkey") % 5 == 0, F.lit(0.0)).otherwise(F.col("l_discount")).alias("l_discount"),
        "l_tax", "l_returnflag", "l_linestatus", "l_shipdate",
    )
    return TablePair(name="lineitem", left=li, right=right, keys=("l_orderkey", "l_linenumber"))


def lineitem_hot_pair(spark: SparkSession, sf_dir: str) -> TablePair:
    """A third of all rows under one key: orders whose key % 3 = 0 are folded
    into order 0, on both sides, with the drift of ``lineitem_drift_pair``.

    Keyed on ``l_orderkey`` alone, so key 0 holds a third of each side and
    its copies differ: the skewed, duplicate-key case at full size.
    """
    base = lineitem_drift_pair(spark, sf_dir)

    def fold(df: DataFrame) -> DataFrame:
        k = F.col("l_orderkey")
        return df.withColumn("l_orderkey", F.when(k % 3 == 0, F.lit(0).cast("bigint")).otherwise(k))

    return TablePair(name="lineitem_hot", left=fold(base.left), right=fold(base.right), keys=("l_orderkey",))


def orders_shifted_pair(spark: SparkSession, sf_dir: str) -> TablePair:
    """The orders pair with the replica's created time 100 days earlier where
    ``id % 41 = 0``, so that rows leave or enter a window on one side only."""
    pair = orders_pair(spark, sf_dir)
    t = F.col("creation_time")
    right = pair.right.withColumn("creation_time", F.when(F.col("id") % 41 == 0, t - F.expr("INTERVAL 100 DAYS")).otherwise(t))
    return TablePair(name="orders", left=pair.left, right=right, keys=("id",))
