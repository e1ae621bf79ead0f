"""concord: reconcile two copies of the same tables on Spark.

Compare a source table with its replica and report record counts,
created-vs-modified date patterns, per-column and per-record match
statistics (NULL kept distinct from blank), rows missing on either side,
and old rows that should have left the source -- optionally within a
rolling created-time window. Every check is a DataFrame plan.
"""

from concord.config import RunConfig, TablePair
from concord.plans.reconcile import Reconciliation

__all__ = ["RunConfig", "TablePair", "Reconciliation"]
