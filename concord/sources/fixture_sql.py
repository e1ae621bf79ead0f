"""SQL text of the derived pairs, for the DuckDB oracle and for tests.

These CTEs compute, in plain ANSI SQL over the driver's tables, exactly the
frames :mod:`concord.sources.fixtures` builds with the DataFrame API.
"""

from __future__ import annotations

AS_OF_SQL = "TIMESTAMP '2001-08-01 00:00:00'"

# CTEs ``l`` and ``r``: the orders pair (left = source, right = replica).
ORDERS_PAIR = """
l as (
  select o_orderkey as id, o_custkey as cust, o_orderstatus as status,
    cast(o_totalprice as decimal(18,2)) as price,
    case when o_orderkey%71=0 then null else o_orderpriority end as priority,
    case o_orderkey%11 when 0 then null when 1 then '' when 2 then '   '
         else 'n'||cast(o_orderkey%7 as string) end as note,
    o_orderdate as creation_time,
    case o_orderkey%5 when 0 then null when 1 then o_orderdate
         when 2 then o_orderdate + interval 3 hours
         else o_orderdate + interval 2 days end as last_modified_time
  from orders),
r as (
  select id, cust, case when id%53=0 then 'X' else status end as status,
    case when id%59=0 then cast(price+0.01 as decimal(18,2)) else price end as price,
    priority,
    case when id%11=0 and id%2=0 then '' when id%11=2 then ' '
         when id%61=0 then '  '||note||' ' when id%73=0 then note||'!' else note end as note,
    creation_time,
    case when id%67=0 then last_modified_time + interval 1 day
         else last_modified_time end as last_modified_time
  from l where id%97<>0
  union all
  select id+10000000, cust, status, price, priority, note, creation_time, last_modified_time
  from l where id%101=0)
"""

ORDERS_VALUE_COLUMNS = ("cust", "status", "price", "priority", "note",
                        "creation_time", "last_modified_time")

CUSTOMER_PAIR = """
cl as (select * from customer),
cr as (
  select c_custkey, c_name, c_nationkey,
    case when c_custkey%13=0 then c_acctbal + 1.0 else c_acctbal end as c_acctbal,
    c_mktsegment
  from customer)
"""

CUSTOMER_VALUE_COLUMNS = ("c_name", "c_nationkey", "c_acctbal", "c_mktsegment")

LINEITEM_PAIR = """
ll as (select * from lineitem),
lr as (select * from lineitem where year(l_shipdate) <> 1999)
"""

LINEITEM_DRIFT_PAIR = """
ll as (select * from lineitem),
lr as (
  select l_orderkey, l_partkey, l_suppkey, l_linenumber,
    case when l_partkey%7=0 then l_quantity + 1.0 else l_quantity end as l_quantity,
    l_extendedprice,
    case when l_suppkey%5=0 then 0.0 else l_discount end as l_discount,
    l_tax, l_returnflag, l_linestatus, l_shipdate
  from lineitem where year(l_shipdate) <> 1999)
"""

LINEITEM_VALUE_COLUMNS = ("l_partkey", "l_suppkey", "l_quantity", "l_extendedprice",
                          "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate")

LINEITEM_HOT_PAIR = """
ll as (select case when l_orderkey%3=0 then cast(0 as bigint) else l_orderkey end as l_orderkey,
         l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice, l_discount, l_tax,
         l_returnflag, l_linestatus, l_shipdate from lineitem),
lr as (
  select case when l_orderkey%3=0 then cast(0 as bigint) else l_orderkey end as l_orderkey,
    l_partkey, l_suppkey, l_linenumber,
    case when l_partkey%7=0 then l_quantity + 1.0 else l_quantity end as l_quantity,
    l_extendedprice,
    case when l_suppkey%5=0 then 0.0 else l_discount end as l_discount,
    l_tax, l_returnflag, l_linestatus, l_shipdate
  from lineitem where year(l_shipdate) <> 1999)
"""

LINEITEM_HOT_VALUE_COLUMNS = ("l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice",
                              "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate")
