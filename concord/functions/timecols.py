"""Time-column detection, window and retention predicates, time formatting.

Bounds are compared as literals of the column's own type (``timestamp_ntz``
columns get NTZ literals) so no cast wraps the column and the predicate is
pushed into the Parquet / JDBC scan.
"""

from __future__ import annotations

from datetime import datetime, time, timedelta
from typing import Optional, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Candidate names, searched in this order, first hit wins.
MODIFIED_CANDIDATES = (
    "last_modified_time", "updated_at", "modified_date", "last_modified",
    "modified_time", "update_time",
)
CREATED_CANDIDATES = (
    "creation_time", "created_time", "created_at", "creation_date", "created",
    "create_time", "insert_time", "created_date",
)

TS_FORMAT = "yyyy-MM-dd HH:mm:ss"


def detect(columns: Sequence[str], candidates: Sequence[str]) -> Optional[str]:
    present = set(columns)
    for name in candidates:
        if name in present:
            return name
    return None


def ts_literal(value: datetime, dtype: T.DataType, up: bool = True) -> Column:
    """A timestamp literal of the column's type, folded at plan time.

    A DATE stands for its midnight: a bound within a day is the next day (or
    the day itself, if not ``up``), so DATE columns keep what timestamps would.
    """
    if isinstance(dtype, T.DateType):
        return F.lit(value.date() + timedelta(days=int(up and value.time() != time())))
    text = value.strftime("%Y-%m-%d %H:%M:%S")
    if isinstance(dtype, T.TimestampNTZType):
        return F.lit(text).cast(T.TimestampNTZType())
    return F.lit(text).cast(T.TimestampType())


def in_window(col: Column, dtype: T.DataType, start: datetime, end: datetime) -> Column:
    """``start <= col <= end``, both ends inclusive; NULL is outside."""
    return (col >= ts_literal(start, dtype)) & (col <= ts_literal(end, dtype, up=False))


def older_than(created: Column, modified: Column, c_type: T.DataType,
               m_type: T.DataType, threshold: datetime) -> Column:
    """Retention predicate: created and modified both strictly before."""
    return (created < ts_literal(threshold, c_type)) & (modified < ts_literal(threshold, m_type))


def fmt_time(col: Column, dtype: Optional[T.DataType], missing: str | None = "N/A") -> Column:
    """Timestamp as ``yyyy-MM-dd HH:mm:ss``; other types as text; NULL -> ``missing``."""
    if dtype is None:
        return F.lit(missing).cast("string")
    if isinstance(dtype, (T.TimestampType, T.TimestampNTZType)):
        text = F.date_format(col, TS_FORMAT)
    else:
        text = col.cast("string")
    return text if missing is None else F.coalesce(text, F.lit(missing))


def scenario_flags(created: Column, modified: Column) -> tuple[Column, Column, Column]:
    """The three created-vs-modified patterns; NULL in either is in none.

    1. identical timestamps; 2. same calendar day, different time;
    3. different calendar day.
    """
    same_day = F.to_date(created) == F.to_date(modified)
    s1 = F.coalesce(created == modified, F.lit(False))
    s2 = F.coalesce(same_day & (created != modified), F.lit(False))
    s3 = F.coalesce(~same_day, F.lit(False))
    return s1, s2, s3
