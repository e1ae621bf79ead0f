"""Resolve a :class:`TablePair` into the frames every operator starts from.

Steps, all metadata-only except the window filter (which stays lazy and is
pushed into each side's scan):

1. rename right columns through ``column_mapping``;
2. keep the columns present on both sides, in the left's order;
3. check the keys are among them;
4. detect the created / modified columns among them;
5. filter each side to the created-time window (each side by its own
   created value, both ends inclusive), when the run asks for a window;
6. align each compared column to one type for both sides.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Optional, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from concord.config import RunConfig, TablePair
from concord.functions import canon as C
from concord.functions import timecols as TC
from concord.sources.schema import apply_mapping, common_columns, quoted

# Table statuses.
OK = "OK"
NO_COMMON_COLUMNS = "NO_COMMON_COLUMNS"
NO_TIME_COLUMNS = "NO_TIME_COLUMNS"
EMPTY_LEFT = "EMPTY_LEFT"
EMPTY_RIGHT = "EMPTY_RIGHT"
EMPTY_BOTH = "EMPTY_BOTH"
DISABLED = "DISABLED"

KEY = "__k"      # struct of the key columns: NULL-safe under plain equality
SIDE = "__s"     # 0 = left, 1 = right


@dataclass
class Prepared:
    name: str
    left: DataFrame            # mapped, windowed (if asked), all columns
    right: DataFrame
    keys: list[str]
    value_cols: list[str]      # common columns except the keys, left order
    aligned: list[T.DataType]  # aligned type per value column
    left_types: list[T.DataType]
    right_types: list[T.DataType]
    created: Optional[str]
    modified: Optional[str]
    windowed: bool
    status: str = OK
    window_status: str = DISABLED
    key_types: list[T.DataType] = field(default_factory=list)  # aligned type per key column
    key_weights: Optional[tuple[int, list[int]]] = field(default=None, init=False)  # see compare.key_weights

    # -- expressions ------------------------------------------------------
    def flat_keys(self) -> list[str]:
        """Internal names of the key columns in tagged rows (never clash)."""
        return [f"__k{i}" for i in range(len(self.keys))]

    def key_from_flat(self) -> Column:
        """The key struct rebuilt from the flat key columns, after grouping."""
        return F.struct(*[F.col(f).alias(k) for f, k in zip(self.flat_keys(), self.keys)]).alias(KEY)

    def rows(self, side: int, values: bool = True) -> DataFrame:
        """(flat key columns, aligned values ``v_0``, ``v_1``, ...) of one side's rows.

        Keys stay flat so aggregations group and sort on plain columns
        (prefix / radix sort); grouping is NULL-safe by itself. Without
        ``values`` only the keys are read.
        """
        df, types = (self.left, self.left_types) if side == 0 else (self.right, self.right_types)
        if values and list(types) == self.aligned and [df.schema[k].dataType for k in self.keys] == self.key_types:
            return df.selectExpr(*[f"{quoted(k)} as {f}" for k, f in zip(self.keys, self.flat_keys())],
                                 *[f"{quoted(c)} as v_{i}" for i, c in enumerate(self.value_cols)])
        keys = [C.align(F.col(quoted(k)), df.schema[k].dataType, t).alias(f)
                for k, t, f in zip(self.keys, self.key_types, self.flat_keys())]
        cells = [C.align(F.col(quoted(c)), src, tgt).alias(f"v_{i}")
                 for i, (c, src, tgt) in enumerate(zip(self.value_cols, types, self.aligned))] if values else []
        return df.select(*keys, *cells)

    def tagged(self, side: int, values: bool = True) -> DataFrame:
        return self.rows(side, values).withColumn(SIDE, F.lit(side).cast("tinyint"))

    def both_tagged(self, values: bool = True) -> DataFrame:
        return self.tagged(0, values).unionByName(self.tagged(1, values))


def prepare(pair: TablePair, cfg: RunConfig, windowed: Optional[bool] = None,
            columns: Optional[Sequence[str]] = None) -> Prepared:
    """Resolve ``pair`` under ``cfg``; ``columns`` optionally restricts the
    compared columns (the keys and time columns are still resolved)."""
    left = pair.left
    right = apply_mapping(pair.right, pair.column_mapping)
    common = common_columns(left, right)
    keys = list(pair.keys)
    windowed = cfg.window_enabled if windowed is None else windowed

    if not common:
        return Prepared(pair.name, left, right, keys, [], [], [], [], None, None, False,
                        status=NO_COMMON_COLUMNS)
    missing_keys = [k for k in keys if k not in common]
    if missing_keys:
        raise ValueError(f"{pair.name}: key column(s) {missing_keys} not on both sides")

    created = pair.created_col or TC.detect(common, TC.CREATED_CANDIDATES)
    modified = pair.modified_col or TC.detect(common, TC.MODIFIED_CANDIDATES)
    for name in (created, modified):
        if name is not None and name not in common:
            raise ValueError(f"{pair.name}: time column {name!r} not on both sides")

    window_status = DISABLED
    if windowed:
        start, end = cfg.window_bounds()
        if created is None:
            window_status = NO_TIME_COLUMNS
            windowed = False
        else:
            window_status = OK
            lt, rt = left.schema[created].dataType, right.schema[created].dataType
            left = left.filter(TC.in_window(F.col(quoted(created)), lt, start, end))
            right = right.filter(TC.in_window(F.col(quoted(created)), rt, start, end))

    value_cols = [c for c in common if c not in keys]
    if columns is not None:
        wanted = set(columns)
        value_cols = [c for c in value_cols if c in wanted]
    lts = [left.schema[c].dataType for c in value_cols]
    rts = [right.schema[c].dataType for c in value_cols]
    aligned = [C.aligned_type(a, b, pair.bool_as_int) for a, b in zip(lts, rts)]
    key_types = [C.aligned_type(left.schema[k].dataType, right.schema[k].dataType, pair.bool_as_int) for k in keys]
    return Prepared(pair.name, left, right, keys, value_cols, aligned, lts, rts,
                    created, modified, windowed, OK, window_status, key_types)
