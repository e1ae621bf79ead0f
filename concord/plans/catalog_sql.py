"""SQL text for the registered checks, runnable by DuckDB over the driver tables.

Written the naive way on purpose: the comparisons join the two sides on the
key, forming every row pair (``IS NOT DISTINCT FROM``, so NULL keys pair
up), and count over pairs. That is the reference semantics the Spark plans
reach without forming pairs.
"""

from __future__ import annotations

from typing import Optional, Sequence

from concord.sources import fixture_sql as FS

AS_OF = FS.AS_OF_SQL
TS_FMT = "'%Y-%m-%d %H:%M:%S'"
RUN_ID = "'20010801_000000'"
STRING_COLS = {"status", "priority", "note", "c_name", "c_mktsegment", "l_returnflag", "l_linestatus"}


def canon(expr: str, col: str) -> str:
    if col in STRING_COLS:
        return f"regexp_replace({expr}, '^\\s+|\\s+$', '', 'g')"
    return expr


def eq(col: str) -> str:
    return f"({canon('l_' + col, col)} is not distinct from {canon('r_' + col, col)})"


def rate(m: str, t: str) -> str:
    return f"(case when {t} > 0 then cast({m} as double) / cast({t} as double) * 100.0 else 100.0 end)"


def band(r: str) -> str:
    return f"(case when {r} >= 90.0 then 'success' when {r} >= 75.0 then 'warning' else 'error' end)"


def disp(expr: str) -> str:
    return f"coalesce(cast({expr} as varchar), 'NULL')"


def tfmt(expr: str, missing: Optional[str] = "'N/A'") -> str:
    s = f"strftime({expr}, {TS_FMT})"
    return s if missing is None else f"coalesce({s}, {missing})"


def window(days: Optional[int]) -> str:
    if days is None:
        return "true"
    return f"creation_time between {AS_OF} - interval {days} day and {AS_OF}"


class Pair:
    """A derived pair as CTE text plus its key and compared columns."""

    def __init__(self, name: str, ctes: str, left: str, right: str, keys: Sequence[str],
                 cols: Sequence[str], days: Optional[int] = None):
        self.name, self.keys, self.cols = name, list(keys), list(cols)
        self.left_name = left
        self.ctes = f"{ctes.strip()},\n lw as (select * from {left} where {window(days)}),\n" \
                    f" rw as (select * from {right} where {window(days)})"

    def rid(self, alias: str = "") -> str:
        p = f"{alias}." if alias else ""
        parts = [disp(p + k) for k in self.keys]
        return " || '|' || ".join(parts)

    def on(self, a: str = "a", b: str = "b") -> str:
        return " and ".join(f"{a}.{k} is not distinct from {b}.{k}" for k in self.keys)

    def joined(self) -> str:
        """CTE ``j``: every row pair with the same key."""
        keys = ", ".join(f"a.{k} as {k}" for k in self.keys)
        vals = ", ".join(f"a.{c} as l_{c}, b.{c} as r_{c}" for c in self.cols)
        return f"j as (select {keys}, {vals} from lw a join rw b on {self.on()})"


def orders(days: Optional[int] = None) -> Pair:
    return Pair("orders", FS.ORDERS_PAIR, "l", "r", ["id"], FS.ORDERS_VALUE_COLUMNS, days)


def customer() -> Pair:
    return Pair("customer", FS.CUSTOMER_PAIR, "cl", "cr", ["c_custkey"], FS.CUSTOMER_VALUE_COLUMNS)


def lineitem() -> Pair:
    return Pair("lineitem", FS.LINEITEM_PAIR, "ll", "lr", ["l_orderkey", "l_linenumber"],
                FS.LINEITEM_VALUE_COLUMNS)


def lineitem_drift() -> Pair:
    return Pair("lineitem", FS.LINEITEM_DRIFT_PAIR, "ll", "lr", ["l_orderkey", "l_linenumber"],
                FS.LINEITEM_VALUE_COLUMNS)


def lineitem_hot() -> Pair:
    return Pair("lineitem_hot", FS.LINEITEM_HOT_PAIR, "ll", "lr", ["l_orderkey"],
                FS.LINEITEM_HOT_VALUE_COLUMNS)


# -- counting formulation (no pairs formed) ---------------------------------------

def _counted(p: Pair) -> str:
    """CTEs of per-key row counts ``nl`` / ``nr`` and ``pairs``."""
    k = ", ".join(p.keys)
    on = " and ".join(f"a.{x} is not distinct from b.{x}" for x in p.keys)
    return (f"nl as (select {k}, count(*) as n from lw group by all),\n"
            f" nr as (select {k}, count(*) as n from rw group by all),\n"
            f" pairs as (select coalesce(sum(a.n * b.n), 0) as p from nl a join nr b on {on})")


def column_stats_counted(p: Pair) -> str:
    """Column statistics from value multiplicities: sum L(k,v) * R(k,v)."""
    k = ", ".join(p.keys)
    on = " and ".join(f"a.{x} is not distinct from b.{x}" for x in p.keys)
    ctes, rows = [], []
    for i, c in enumerate(p.cols):
        ctes.append(f"lc{i} as (select {k}, {canon(c, c)} as v, count(*) as n from lw group by all)")
        ctes.append(f"rc{i} as (select {k}, {canon(c, c)} as v, count(*) as n from rw group by all)")
        m = f"(select coalesce(sum(a.n * b.n), 0) from lc{i} a join rc{i} b on {on} and a.v is not distinct from b.v)"
        zl = f"(select coalesce(sum(a.n * b.n), 0) from lc{i} a join nr b on {on} where a.v is null)"
        zr = f"(select coalesce(sum(a.n * b.n), 0) from rc{i} a join nl b on {on} where a.v is null)"
        rows.append(f"select '{c}' as column_name, {m} as m, (select p from pairs) as t, {zl} as nl, {zr} as nr")
    r = rate("m", "t")
    return f"""with {p.ctes}, {_counted(p)}, {', '.join(ctes)},
s as ({' union all '.join(rows)})
select '{p.name}' as table_name, column_name, cast(m as bigint) as matches, cast(t - m as bigint) as mismatches,
  cast(nl as bigint) as null_left, cast(nr as bigint) as null_right, {r} as match_rate,
  {band(r)} as band, {r} < 95.0 as failed
from s"""


def record_stats_counted(p: Pair) -> str:
    """Record statistics from tuple multiplicities: sum L(k,t) * R(k,t)."""
    k = ", ".join(p.keys)
    vals = ", ".join(f"{canon(c, c)} as v{i}" for i, c in enumerate(p.cols))
    on = " and ".join([f"a.{x} is not distinct from b.{x}" for x in p.keys] +
                      [f"a.v{i} is not distinct from b.v{i}" for i in range(len(p.cols))])
    return f"""with {p.ctes}, {_counted(p)},
lt as (select {k}, {vals}, count(*) as n from lw group by all),
rt as (select {k}, {vals}, count(*) as n from rw group by all),
m as (select coalesce(sum(a.n * b.n), 0) as m from lt a join rt b on {on})
select '{p.name}' as table_name, cast(p as bigint) as total_records, cast(m as bigint) as matching_records,
  cast(p - m as bigint) as mismatched_records
from pairs, m"""


# -- building blocks --------------------------------------------------------------

def column_counts_body(p: Pair) -> str:
    """Rows (column_name, m, t, nl, nr) over all pairs, one per column."""
    parts = []
    for c in p.cols:
        parts.append(
            f"select '{c}' as column_name, {p.cols.index(c)} as ci, count(*) filter (where {eq(c)}) as m, count(*) as t, "
            f"count(*) filter (where {canon('l_' + c, c)} is null) as nl, count(*) filter (where {canon('r_' + c, c)} is null) as nr from j")
    return "\nunion all\n".join(parts)


def column_stats(p: Pair, extra: str = "") -> str:
    r = rate("m", "t")
    return f"""with {p.ctes}, {p.joined()},
s as ({column_counts_body(p)})
select '{p.name}' as table_name, column_name, cast(m as bigint) as matches, cast(t - m as bigint) as mismatches,
  cast(nl as bigint) as null_left, cast(nr as bigint) as null_right, {r} as match_rate,
  {band(r)} as band, {r} < 95.0 as failed{extra}
from s"""


def all_eq(p: Pair) -> str:
    return " and ".join(eq(c) for c in p.cols)


def record_stats(p: Pair) -> str:
    return f"""with {p.ctes}, {p.joined()}
select '{p.name}' as table_name, cast(count(*) as bigint) as total_records,
  cast(count(*) filter (where {all_eq(p)}) as bigint) as matching_records,
  cast(count(*) filter (where not ({all_eq(p)})) as bigint) as mismatched_records
from j"""


def missing_body(p: Pair, time_cols: bool = True) -> str:
    """CTE ``m``: keys on one side only, distinct, with created / modified."""
    keys = ", ".join(p.keys)

    def side(label: str, own: str, other: str) -> str:
        if time_cols:
            created = tfmt("a.creation_time")
            modified = tfmt("a.last_modified_time")
            src = f"(select * from {own})"
        else:
            created = modified = "'N/A'"
            src = f"(select distinct {keys} from {own})"
        return (f"select '{label}' as side, {', '.join('a.' + k for k in p.keys)}, {p.rid('a')} as record_id, "
                f"{created} as created_date, {modified} as last_modified from {src} a "
                f"where not exists (select 1 from {other} b where {p.on('b', 'a')})")

    return (f"m as ({side('missing_in_right', 'lw', 'rw')}\n union all\n"
            f" {side('missing_in_left', 'rw', 'lw')})")


def missing(p: Pair, which: Optional[str] = None, time_cols: bool = True) -> str:
    cond = f"where side = '{which}'" if which else ""
    return f"""with {p.ctes}, {missing_body(p, time_cols)}
select '{p.name}' as table_name, side, record_id, created_date, last_modified from m {cond}"""


def missing_totals_cte(p: Pair) -> str:
    return (f"mt as (select count(*) filter (where side = 'missing_in_right') as missing_in_right, "
            f"count(*) filter (where side = 'missing_in_left') as missing_in_left from m)")


def differences_body(p: Pair) -> str:
    """CTE ``d``: differing (key, column, values) with pair counts."""
    keys = ", ".join(p.keys)
    parts = []
    for c in p.cols:
        parts.append(
            f"select '{c}' as column_name, {keys}, {disp('l_' + c)} as left_value, {disp('r_' + c)} as right_value, "
            f"{canon('l_' + c, c)} as ls, {canon('r_' + c, c)} as rs from j where not {eq(c)}")
    body = "\nunion all\n".join(parts)
    return (f"d0 as ({body}),\n d as (select column_name, {keys}, left_value, right_value, ls, rs, "
            f"count(*) as pairs from d0 group by all)")


def top_differences(p: Pair, limit: int = 100) -> str:
    order = ", ".join(f"{k} nulls first" for k in p.keys)
    return f"""with {p.ctes}, {p.joined()}, {differences_body(p)}
select '{p.name}' as table_name, column_name, {p.rid()} as record_id, left_value, right_value,
  cast(pairs as bigint) as pairs,
  cast(row_number() over (partition by column_name order by {order}, cast(ls as varchar) nulls first, cast(rs as varchar) nulls first) as integer) as rn
from d qualify rn <= {limit}"""


def scenario_counts(side: str) -> str:
    c, m = "creation_time", "last_modified_time"
    return (f"select count(*) as total, count(*) filter (where {c} = {m}) as s1, "
            f"count(*) filter (where cast({c} as date) = cast({m} as date) and {c} <> {m}) as s2, "
            f"count(*) filter (where cast({c} as date) <> cast({m} as date)) as s3 from {side}")


def record_counts(p: Pair, extra: str = "") -> str:
    return f"""with {p.ctes}, a as ({scenario_counts('lw')}), b as ({scenario_counts('rw')})
select '{p.name}' as table_name, a.total as left_total, b.total as right_total,
  a.total - b.total as difference,
  case when a.total = b.total then 'Match' else 'Mismatch' end as status{extra}
from a, b"""


def date_scenarios(p: Pair, extra: str = "") -> str:
    rows = "\nunion all\n".join(
        f"select {i} as scenario, a.s{i} as left_count, b.s{i} as right_count from a, b" for i in (1, 2, 3))
    return f"""with {p.ctes}, a as ({scenario_counts('lw')}), b as ({scenario_counts('rw')}),
s as ({rows})
select '{p.name}' as table_name, scenario, left_count, right_count, left_count - right_count as difference,
  case when left_count = right_count then 'Match' else 'Mismatch' end as status{extra}
from s"""


def retention_where(days: int = 45) -> str:
    t = f"{AS_OF} - interval {days} day"
    return f"creation_time < {t} and last_modified_time < {t}"


# -- the registered checks ------------------------------------------------------------

def sql_column_stats():
    return column_stats(orders())


def sql_record_counts():
    return record_counts(orders())


def sql_record_counts_window():
    return "\nunion all\n".join(
        f"select * from ({record_counts(orders(d), f', {d} as window_days')})" for d in (45, 2000))


def sql_date_scenarios():
    return date_scenarios(orders())


def sql_date_scenarios_window():
    return "\nunion all\n".join(
        f"select * from ({date_scenarios(orders(d), f', {d} as window_days')})" for d in (45, 2000))


def sql_window_filter():
    p = orders(2000)
    return f"""with {p.ctes}
select 'orders' as table_name, 'left' as side, {disp('id')} as record_id, {tfmt('creation_time')} as creation_time from lw
union all
select 'orders' as table_name, 'right' as side, {disp('id')} as record_id, {tfmt('creation_time')} as creation_time from rw"""


def sql_column_mapping():
    return column_stats(orders())


def sql_composite_key_missing():
    return missing(lineitem(), time_cols=False)


def sql_dup_key_column_stats():
    return column_stats(lineitem_drift())


def sql_dup_key_record_stats():
    return record_stats(lineitem_drift())


def sql_dup_key_differences():
    return top_differences(lineitem_drift())


def sql_hot_key_column_stats():
    return column_stats_counted(lineitem_hot())


def sql_hot_key_record_stats():
    return record_stats_counted(lineitem_hot())


def sql_retention_count():
    return f"""with {orders().ctes}
select 'orders' as table_name, 45 as retention_days, count(*) as total_old_records,
  cast(0 as bigint) as deleted_records, count(*) as not_deleted, 'OK' as status
from l where {retention_where()}"""


def sql_retention_sample():
    return f"""with {orders().ctes}
select 'orders' as table_name, {disp('id')} as record_id, {tfmt('creation_time', None)} as creation_time,
  {tfmt('last_modified_time', None)} as last_modified_time,
  cast(row_number() over (order by creation_time desc, id asc) as integer) as rn
from l where {retention_where()} qualify rn <= 100"""


def sql_null_empty_profile():
    p = orders()
    parts = []
    for side, src in (("left", "lw"), ("right", "rw")):
        for c in p.cols:
            blank = (f"count(*) filter (where {canon(c, c)} = '')" if c in STRING_COLS else "0")
            parts.append(f"select '{c}' as column_name, '{side}' as side, count(*) as rows, "
                         f"count(*) filter (where {canon(c, c)} is null) as nulls, {blank} as blanks from {src}")
    body = "\nunion all\n".join(parts)
    return f"""with {p.ctes}, s as ({body})
select 'orders' as table_name, column_name, side, cast(rows as bigint) as rows, cast(nulls as bigint) as nulls,
  cast(blanks as bigint) as blanks, cast(rows - nulls - blanks as bigint) as filled from s"""


def _verdicts(p: Pair) -> str:
    differs = [f"bool_or(not {eq(c)})" for c in p.cols]
    flags = ", ".join(f"case when {d} then '{c}' end" for d, c in zip(differs, p.cols))
    count = " + ".join(f"cast({d} as integer)" for d in differs)
    keys = ", ".join(p.keys)
    return f"""with {p.ctes}, {p.joined()},
v as (select {keys}, count(*) as pairs, cast({count} as integer) as differing_columns,
        concat_ws(',', {flags}) as differing_list from j group by {keys})"""


def sql_field_compare():
    return _verdicts(orders()) + f"""
select 'orders' as table_name, {disp('id')} as record_id, cast(pairs as bigint) as pairs, differing_columns,
  differing_list from v"""


def sql_matched_records():
    return _verdicts(orders()) + f"""
select 'orders' as table_name, {disp('id')} as record_id, cast(pairs as bigint) as pairs,
  differing_columns = 0 as all_match from v"""


def sql_missing_in_right():
    return missing(orders(), "missing_in_right")


def sql_missing_in_left():
    return missing(orders(), "missing_in_left")


def sql_missing_totals():
    p = orders()
    return f"""with {p.ctes}, {missing_body(p)}, {missing_totals_cte(p)}
select 'orders' as table_name, missing_in_right, missing_in_left from mt"""


def sql_missing_sample():
    p = orders()
    return f"""with {p.ctes}, {missing_body(p)}
select 'orders' as table_name, side, record_id, created_date, last_modified,
  cast(row_number() over (partition by side order by id nulls first) as integer) as rn
from m qualify rn <= 100"""


def sql_record_match_stats():
    return record_stats(orders())


def sql_top_differences():
    return top_differences(orders())


def sql_search_differences():
    p = orders()
    return f"""with {p.ctes}, {p.joined()}, {differences_body(p)}
select 'orders' as table_name, column_name, {p.rid()} as record_id, left_value, right_value,
  cast(pairs as bigint) as pairs
from d where lower({p.rid()}) like '%53%'"""


def _table_summary_rows(p: Pair, windowed_time: bool) -> str:
    """One summary row of a pair (counts windowed when the pair has time columns)."""
    scen = (f"(select bool_and(a.s1 = b.s1) and bool_and(a.s2 = b.s2) and bool_and(a.s3 = b.s3) "
            f"from ({scenario_counts('lw')}) a, ({scenario_counts('rw')}) b)") if windowed_time else "cast(null as boolean)"
    ret = (f"(select count(*) from {p.left_name} where {retention_where()})"
           if windowed_time else "cast(null as bigint)")
    return f"""with {p.ctes}, {p.joined()}, {missing_body(p, windowed_time)}, {missing_totals_cte(p)},
c as (select (select count(*) from lw) as left_total, (select count(*) from rw) as right_total,
        (select count(*) from j) as total_records,
        (select count(*) filter (where {all_eq(p)}) from j) as matching_records)
select '{p.name}' as table_name, 'OK' as status, left_total, right_total,
  case when left_total = right_total then 'Match' else 'Mismatch' end as count_status,
  total_records, matching_records, total_records - matching_records as mismatched_records,
  {rate('matching_records', 'total_records')} as record_match_rate,
  missing_in_right, missing_in_left, {scen} as scenarios_equal, {ret} as not_deleted,
  (left_total <> right_total or total_records - matching_records > 0) as has_mismatch,
  (left_total = right_total and coalesce({scen}, true) and missing_in_right = 0 and missing_in_left = 0
    and total_records - matching_records = 0) as perfect_match,
  {RUN_ID} as run_id
from c, mt"""


def sql_table_summary():
    return _table_summary_rows(orders(45), True)


def sql_run_report():
    return (f"select * from ({_table_summary_rows(orders(45), True)})\nunion all\n"
            f"select * from ({_table_summary_rows(customer(), False)})")


def sql_run_summary():
    return f"""with t as ({sql_run_report()})
select count(*) as total_tables, count(*) filter (where has_mismatch) as tables_with_mismatches,
  count(*) filter (where status = 'ERROR') as tables_failed,
  cast(sum(left_total) as bigint) as total_left_records, cast(sum(right_total) as bigint) as total_right_records,
  cast(sum(missing_in_right) as bigint) as total_missing_in_right,
  cast(sum(missing_in_left) as bigint) as total_missing_in_left,
  cast(coalesce(sum(not_deleted), 0) as bigint) as total_not_deleted, {RUN_ID} as run_id,
  true as window_enabled, strftime({AS_OF} - interval 45 day, {TS_FMT}) as window_start,
  strftime({AS_OF}, {TS_FMT}) as window_end, 45 as window_days
from t"""


def sql_table_kpis():
    return f"""with t as ({sql_run_report()})
select table_name, left_total, right_total, missing_in_right, missing_in_left,
  cast(coalesce(not_deleted, 0) as bigint) as not_deleted,
  format('{{:,}}', left_total) as left_total_text, format('{{:,}}', right_total) as right_total_text,
  upper(table_name) as title, run_id
from t"""


def sql_column_failure_stats():
    cs = (f"select * from ({column_stats(orders(45))})\nunion all\n"
          f"select * from ({column_stats(customer())})")
    r = rate("total_columns - failed_columns", "total_columns")
    return f"""with cs as ({cs}),
a as (select count(*) as total_columns, count(*) filter (where match_rate < 95.0) as failed_columns from cs)
select total_columns, failed_columns, {r} as success_rate, round({r}, 1) as success_rate_1dp,
  (case when {r} >= 95.0 then 'excellent' when {r} >= 90.0 then 'success'
        when {r} >= 70.0 then 'warning' else 'error' end) as band, {RUN_ID} as run_id
from a"""


def _fused(p: Pair, time_cols: bool = True) -> str:
    per_col = ", ".join(f"count(*) filter (where {eq(c)}) as matches_{c}" for c in p.cols)
    return f"""with {p.ctes}, {p.joined()}, {missing_body(p, time_cols)}, {missing_totals_cte(p)},
c as (select (select count(*) from lw) as left_total, (select count(*) from rw) as right_total),
jj as (select count(*) as total_records, count(*) filter (where {all_eq(p)}) as matching_records, {per_col} from j)
select '{p.name}' as table_name, left_total, right_total, total_records, matching_records,
  total_records - matching_records as mismatched_records, missing_in_right, missing_in_left,
  {', '.join('matches_' + c for c in p.cols)}
from c, jj, mt"""


def sql_fused_reconcile():
    return _fused(orders(45))


def sql_dup_key_fused():
    return _fused(lineitem_drift(), time_cols=False)


def sql_dup_key_verdicts():
    p = lineitem_drift()
    return _verdicts(p) + f"""
select '{p.name}' as table_name, {p.rid()} as record_id, cast(pairs as bigint) as pairs, differing_columns,
  differing_list from v"""


def sql_hash_sample():
    p = orders()
    p.ctes = p.ctes.replace("where true", f"where cast('0x' || substr(md5({disp('id')}), 1, 8) as bigint) % 100 < 10")
    return column_stats(p)


def sql_persist_run():
    return column_stats(orders(45), f", {RUN_ID} as run_id")


def sql_export_differences():
    return f"""select table_name, column_name, record_id, left_value, right_value
from ({top_differences(orders(), 1 << 62)})"""


def sql_retain_latest_runs():
    return """with e as (select strftime(cast(ts as date), '%Y-%m-%d') as run_id, event_id from events),
top as (select distinct run_id from e order by run_id desc limit 10)
select run_id, event_id from e where run_id in (select run_id from top)"""


def value_lines(p: Pair) -> str:
    """Differences in linear form, from value multiplicities (no pairs formed)."""
    k = ", ".join(p.keys)
    on = " and ".join(f"a.{x} is not distinct from b.{x}" for x in p.keys)
    cells = "\nunion all\n".join(
        f"select {k}, '{c}' as column_name, {disp(canon(c, c))} as value, {l} as sl, {1 - l} as sr from {w}"
        for c in p.cols for w, l in (("lw", 1), ("rw", 0)))
    return f"""with {p.ctes},
nl as (select {k}, count(*) as n_l from lw group by all), nr as (select {k}, count(*) as n_r from rw group by all),
n as (select {', '.join('a.' + x for x in p.keys)}, n_l, n_r from nl a join nr b on {on}),
cells as ({cells}),
vc as (select {k}, column_name, value, sum(sl) as cl, sum(sr) as cr from cells group by all),
d as (select a.*, n_l, n_r, (cl = n_l and cr = 0) or (cr = n_r and cl = 0) as alone
      from vc a join n b on {on} where (cl > 0 and cr < n_r) or (cr > 0 and cl < n_l)),
lines as (
  select {k}, column_name, case when cl > 0 then value end as left_value, case when cr > 0 then value end as right_value,
    cl as left_rows, cr as right_rows, cl * (n_r - cr) as pairs from d where not alone
  union all
  select {k}, column_name, max(case when cl > 0 then value end), max(case when cr > 0 then value end), sum(cl), sum(cr),
    case when count(*) = 2 then max(n_l) * max(n_r) else sum(cl) * (max(n_r) - sum(cr)) end
  from d where alone group by {k}, column_name)
select '{p.name}' as table_name, column_name, {p.rid()} as record_id, left_value, right_value,
  cast(left_rows as bigint) as left_rows, cast(right_rows as bigint) as right_rows, cast(pairs as bigint) as pairs from lines"""


def sql_dup_key_search():
    return f"select * from ({value_lines(lineitem_drift())}) where lower(record_id) like '%53%'"


def sql_dup_key_export():
    return value_lines(lineitem_hot())


def sql_digest_column_stats():
    return column_stats(orders())


def sql_write_run_twice():
    mended = Pair("orders", FS.ORDERS_PAIR, "l", "l", ["id"], FS.ORDERS_VALUE_COLUMNS)
    return column_stats(mended, f", {RUN_ID} as run_id, cast(0 as bigint) as stale_rows")


def sql_prune_runs():
    changed = "select count(*) as n from customer where c_custkey % 13 = 0"
    n = len(FS.CUSTOMER_VALUE_COLUMNS)
    rows = [f"select '{r}' as run_id, '{t}' as result_table, {c} as rows" for r in ("r3", "r4")
            for t, c in (("column_stats", n), ("table_status", 1), ("record_counts", 1))]
    return "\nunion all\n".join(f"select run_id, result_table, cast(rows as bigint) as rows from ({x})" for x in rows) + f"""
union all select 'r4', 'field_differences', cast(least(n, 100) as bigint) from ({changed}) where n > 0"""


def _copies(p: Pair) -> str:
    k = ", ".join(p.keys)
    return f"""with {p.ctes},
c as (select {k}, 'left' as side, count(*) as copies from lw group by all
      union all select {k}, 'right', count(*) from rw group by all)"""


def sql_duplicate_histogram():
    return "\nunion all\n".join(f"""select * from ({_copies(p)}
select '{p.name}' as table_name, side, copies, count(*) as keys, cast(sum(copies) as bigint) as rows from c group by side, copies)"""
                                for p in (lineitem_drift(), lineitem_hot()))


def sql_duplicate_top():
    def one(p: Pair) -> str:
        return f"""select * from ({_copies(p)},
t as (select *, row_number() over (partition by side order by copies desc, {', '.join(p.keys)}) as rank from c where copies > 1)
select '{p.name}' as table_name, side, cast(rank as integer) as rank, {p.rid()} as record_id, copies from t where rank <= 20)"""
    return "\nunion all\n".join(one(p) for p in (lineitem_drift(), lineitem_hot()))


SHIFTED_PAIR = f"""{FS.ORDERS_PAIR.strip()},
s as (select id, cust, status, price, priority, note,
  case when id % 41 = 0 then creation_time - interval 100 day else creation_time end as creation_time, last_modified_time from r)
"""


def sql_window_edges():
    def one(days: int) -> str:
        p = Pair("orders", SHIFTED_PAIR, "l", "s", ["id"], FS.ORDERS_VALUE_COLUMNS, days)

        def side(label: str, own: str, other: str, whole: str) -> str:
            return f"""select '{label}' as side, {disp('a.id')} as record_id,
  case when b.id is null then 'absent' else 'outside_window' end as reason, {tfmt('b.creation_time')} as other_created
  from {own} a left join {whole} b on b.id = a.id where a.id not in (select id from {other})"""
        return f"""select * from (with {p.ctes}, m as ({side('missing_in_right', 'lw', 'rw', 's')}
union all {side('missing_in_left', 'rw', 'lw', 'l')})
select 'orders' as table_name, side, record_id, reason, other_created, {days} as window_days from m)"""
    return "\nunion all\n".join(one(d) for d in (45, 2000))


def sql_retention_archive():
    return f"""with {orders().ctes},
k as (select id, bool_or(s = 0) as l, bool_or(s = 1) as a from (
  select id, 0 as s from l where {retention_where()} union all select id, 1 from r where {retention_where()}) group by id)
select 'orders' as table_name, 45 as retention_days, count(*) as total_old_records, count(*) filter (where not l) as deleted_records,
  count(*) filter (where l and a) as archived, count(*) filter (where not a) as left_only, count(*) filter (where l) as not_deleted,
  'OK' as status from k"""


SQL = {
    "write_run_twice": sql_write_run_twice,
    "prune_runs": sql_prune_runs,
    "digest_column_stats": sql_digest_column_stats,
    "dup_key_search": sql_dup_key_search,
    "dup_key_export": sql_dup_key_export,
    "duplicate_histogram": sql_duplicate_histogram,
    "duplicate_top": sql_duplicate_top,
    "window_edges": sql_window_edges,
    "retention_archive": sql_retention_archive,
    "column_stats": sql_column_stats,
    "record_counts": sql_record_counts,
    "record_counts_window": sql_record_counts_window,
    "date_scenarios": sql_date_scenarios,
    "date_scenarios_window": sql_date_scenarios_window,
    "window_filter": sql_window_filter,
    "column_mapping": sql_column_mapping,
    "composite_key_missing": sql_composite_key_missing,
    "dup_key_column_stats": sql_dup_key_column_stats,
    "dup_key_record_stats": sql_dup_key_record_stats,
    "dup_key_differences": sql_dup_key_differences,
    "hot_key_column_stats": sql_hot_key_column_stats,
    "hot_key_record_stats": sql_hot_key_record_stats,
    "retention_count": sql_retention_count,
    "retention_sample": sql_retention_sample,
    "null_empty_profile": sql_null_empty_profile,
    "field_compare": sql_field_compare,
    "matched_records": sql_matched_records,
    "missing_in_right": sql_missing_in_right,
    "missing_in_left": sql_missing_in_left,
    "missing_totals": sql_missing_totals,
    "missing_sample": sql_missing_sample,
    "record_match_stats": sql_record_match_stats,
    "top_differences": sql_top_differences,
    "search_differences": sql_search_differences,
    "fused_reconcile": sql_fused_reconcile,
    "dup_key_fused": sql_dup_key_fused,
    "dup_key_verdicts": sql_dup_key_verdicts,
    "hash_sample": sql_hash_sample,
    "table_summary": sql_table_summary,
    "run_report": sql_run_report,
    "run_summary": sql_run_summary,
    "table_kpis": sql_table_kpis,
    "column_failure_stats": sql_column_failure_stats,
    "persist_run": sql_persist_run,
    "export_differences": sql_export_differences,
    "retain_latest_runs": sql_retain_latest_runs,
}


def oracle_sql() -> dict[str, str]:
    return {name: build() for name, build in SQL.items()}
