"""Tables of many columns: flags packed into bit sets, counted by chunks of columns.

Three counters a column make an aggregate of thousands of buffers, which takes
longer to plan and compile than to run. Here each joined row packs its flags
(cells equal, left NULL, right NULL) into three 64-bit numbers per ``CHUNK``
columns, and is counted as one short row per chunk: a hash aggregate by chunk
with ``3 * CHUNK`` counters, whatever the number of columns, combined on the
map side (there are as many groups as chunks). The packed rows are kept once,
with values only where a row differs or is missing; counters and difference
lists both read them, so rows are joined and compared once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from concord.functions import canon as C
from concord.operators import compare as CMP
from concord.plans.prepare import KEY, Prepared

#: Value columns beyond which a pair is compared in packed form.
WIDE = 100
#: Columns whose flags share a number; the counters of a chunk stay below Spark's limit of fields for whole-stage code.
CHUNK = 31
_FLAGS = ("m", "nl", "nr")


def is_wide(prep: Prepared) -> bool:
    return len(prep.value_cols) > WIDE


def _chunks(prep: Prepared) -> list[range]:
    n = len(prep.value_cols)
    return [range(at, min(at + CHUNK, n)) for at in range(0, n, CHUNK)]


def _or(parts: list[str]) -> str:
    """Bitwise or, as a balanced tree: generated code is split at its nodes."""
    while len(parts) > 1:
        parts = [f"({' | '.join(parts[i:i + 2])})" for i in range(0, len(parts), 2)]
    return parts[0]


def _set(bits: str, i: int) -> str:
    return f"({bits} & {1 << (i % CHUNK)}L) <> 0"


def packed(prep: Prepared, rows: DataFrame) -> DataFrame:
    """:func:`compare.single_rows` with packed flags; values are NULL in rows that agree.

    Columns: the key, ``n_l`` / ``n_r``, ``p_differs`` (missing on a side or
    some cell differs), per chunk ``p_m_c`` / ``p_nl_c`` / ``p_nr_c``, and the values.
    """
    tests = {"m": lambda i: f"e_{i}", "nl": lambda i: C.is_null_sql(f"l_{i}", prep.aligned[i]),
             "nr": lambda i: C.is_null_sql(f"r_{i}", prep.aligned[i])}
    values = [f"{s}_{i}" for s in "lr" for i in range(len(prep.value_cols))]
    chunks = list(enumerate(_chunks(prep)))
    flags = [_or([f"if({tests[f](i)}, {1 << (i % CHUNK)}L, 0L)" for i in chunk]) + f" as p_{f}_{c}"
             for f in _FLAGS for c, chunk in chunks]
    agree = " and ".join(f"p_m_{c} = {(1 << len(chunk)) - 1}L" for c, chunk in chunks)
    names = [f"p_{f}_{c}" for f in _FLAGS for c, _ in chunks]
    return (rows.selectExpr(KEY, "n_l", "n_r", *values, *flags)
            .selectExpr(KEY, "n_l", "n_r", *names, f"not (n_l > 0 and n_r > 0 and {agree}) as p_differs", *values)
            .selectExpr(KEY, "n_l", "n_r", *names, "p_differs", *[f"if(p_differs, {v}, null) as {v}" for v in values]))


def drifted(prep: Prepared, kept: DataFrame) -> DataFrame:
    """The rows of :func:`packed` that differ or are missing, as :func:`compare.single_rows`."""
    n = len(prep.value_cols)
    return kept.where("p_differs").selectExpr(
        KEY, "n_l", "n_r", *[f"{s}_{i}" for s in "lr" for i in range(n)],
        *[f"{_set(f'p_m_{i // CHUNK}', i)} as e_{i}" for i in range(n)])


def chunk_counts(prep: Prepared, kept: DataFrame) -> DataFrame:
    """One row per chunk ``c`` of columns: joined rows, rows that agree, and the chunk's counters."""
    per_chunk = [f"{c}, {', '.join(f'p_{f}_{c}' for f in _FLAGS)}" for c in range(len(_chunks(prep)))]
    short = kept.where(CMP.joined()).selectExpr(
        "p_differs", f"stack({len(per_chunk)}, {', '.join(per_chunk)}) as (c, {', '.join(_FLAGS)})")
    return short.groupBy("c").agg(
        F.expr("count(1) as pairs"), F.expr("count_if(not p_differs) as matching"),
        *[F.expr(f"count_if({_set(f, i)}) as {f}_{i}") for f in _FLAGS for i in range(CHUNK)])


def totals(prep: Prepared, kept: DataFrame) -> DataFrame:
    """The counters of :func:`compare.single_counters` (one row) from packed rows."""
    found = {r["c"]: r for r in chunk_counts(prep, kept).collect()}  # as many short rows as chunks of columns
    first = found.get(0)
    out = {"single_pairs": first["pairs"] if first else 0, "single_matching": first["matching"] if first else 0}
    for i in range(len(prep.value_cols)):
        row = found.get(i // CHUNK)
        out |= {f"{f}_{i}": row[f"{f}_{i % CHUNK}"] if row else 0 for f in _FLAGS}
    return kept.sparkSession.createDataFrame([tuple(out.values())], ", ".join(f"{c} long" for c in out))
