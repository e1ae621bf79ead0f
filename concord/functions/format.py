"""Status words, quality bands and number formatting used in result tables."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Status words and band thresholds of the report.
MATCH, MISMATCH = "Match", "Mismatch"
COLUMN_BANDS = ((90.0, "success"), (75.0, "warning"))          # else "error"
OVERALL_BANDS = ((95.0, "excellent"), (90.0, "success"), (70.0, "warning"))  # else "error"


def count_status(difference: Column) -> Column:
    return F.when(difference == 0, F.lit(MATCH)).otherwise(F.lit(MISMATCH))


def _band(rate: Column, bands) -> Column:
    expr = None
    for threshold, name in bands:
        cond = rate >= F.lit(threshold)
        expr = F.when(cond, F.lit(name)) if expr is None else expr.when(cond, F.lit(name))
    return expr.otherwise(F.lit("error"))


def column_band(rate: Column) -> Column:
    """Per-column colour band: >=90 success, >=75 warning, else error."""
    return _band(rate, COLUMN_BANDS)


def overall_band(rate: Column) -> Column:
    """Run-level band: >=95 excellent, >=90 success, >=70 warning, else error."""
    return _band(rate, OVERALL_BANDS)


def match_rate(matches: Column, total: Column) -> Column:
    """``matches / total * 100``, and 100.0 when nothing was compared."""
    return F.when(total > 0, matches.cast("double") / total.cast("double") * F.lit(100.0)) \
        .otherwise(F.lit(100.0))


def thousands(n: Column) -> Column:
    """Integer with thousands separators, e.g. ``1,234``."""
    return F.format_number(n.cast("long"), 0)


def one_decimal(x: Column) -> Column:
    return F.round(x, 1)
