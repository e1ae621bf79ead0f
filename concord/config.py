"""Run and table-pair configuration.

A run compares one or more :class:`TablePair` objects under one pinned
``as_of`` clock, so every window and retention bound in a run is computed
from the same instant.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from datetime import datetime, timedelta
from typing import Mapping, Optional, Sequence

from pyspark.sql import DataFrame

# Defaults that must equal the reference's configuration.
DEFAULT_DAYS = 45              # look-back window and retention threshold, in days
DEFAULT_MAX_DIFFERENCES = 100  # differences listed per column
DEFAULT_MAX_MISSING = 100      # missing / retention rows listed per direction
FAILED_BELOW = 95.0            # a column "fails" below this match rate (percent)


def _valid_days(days: Optional[int]) -> int:
    """Missing or non-positive day counts fall back to the default."""
    if not days or days <= 0:
        return DEFAULT_DAYS
    return int(days)


@dataclass(frozen=True)
class RunConfig:
    """Settings shared by every table of a run.

    ``as_of`` replaces a wall clock read at each step: bounds are computed
    once, cut to whole seconds, and reused by every operator.
    """

    as_of: datetime
    window_enabled: bool = False
    window_days: Optional[int] = DEFAULT_DAYS
    retention_enabled: bool = True
    retention_days: Optional[int] = DEFAULT_DAYS
    max_differences: int = DEFAULT_MAX_DIFFERENCES
    max_missing: int = DEFAULT_MAX_MISSING
    # 'auto' checkpoints to spark.checkpoint.dir when the session names one,
    # otherwise persists; 'persist' / 'checkpoint' force a choice.
    materialize: str = "auto"
    # Compare 128-bit row digests first and fetch full rows only where they differ.
    # Rows of equal digests are taken for equal, which is not certain: off unless asked for.
    digest_prefilter: bool = False
    run_id: Optional[str] = None
    parallel_tables: int = 1  # tables of a run that are compared at a time

    @property
    def as_of_s(self) -> datetime:
        return self.as_of.replace(microsecond=0)

    def window_bounds(self) -> tuple[Optional[datetime], Optional[datetime]]:
        """Inclusive ``[start, end]`` of the created-time window, or Nones."""
        if not self.window_enabled:
            return None, None
        end = self.as_of_s
        return end - timedelta(days=_valid_days(self.window_days)), end

    def retention_threshold(self) -> datetime:
        """Rows created and modified strictly before this should be gone."""
        return self.as_of_s - timedelta(days=_valid_days(self.retention_days))

    def resolved_run_id(self) -> str:
        return self.run_id or self.as_of_s.strftime("%Y%m%d_%H%M%S")


@dataclass
class TablePair:
    """Two copies of one table: ``left`` (source) and ``right`` (replica).

    ``column_mapping`` maps left column names to the right side's names when
    they differ; right columns are renamed to the left names before anything
    else happens. ``created_col`` / ``modified_col`` default to detection
    from the candidate lists in :mod:`concord.functions.timecols`.
    """

    name: str
    left: DataFrame
    right: DataFrame
    keys: Sequence[str] = ("id",)
    column_mapping: Mapping[str, str] = field(default_factory=dict)
    created_col: Optional[str] = None
    modified_col: Optional[str] = None
    bool_as_int: bool = False
