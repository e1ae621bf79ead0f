"""Small helpers for tests: build pairs and brute-force reference results."""

from __future__ import annotations

from datetime import datetime
from itertools import product

from concord import RunConfig, TablePair

AS_OF = datetime(2001, 8, 1)


def cfg(**kw) -> RunConfig:
    kw.setdefault("as_of", AS_OF)
    return RunConfig(**kw)


def pair(spark, left_rows, right_rows, schema, keys=("id",), name="t", **kw) -> TablePair:
    left = spark.createDataFrame(left_rows, schema)
    right = spark.createDataFrame(right_rows, schema if isinstance(schema, str) else schema)
    return TablePair(name=name, left=left, right=right, keys=keys, **kw)


def py_canon(v):
    """The comparison rule written plainly in Python (NULL/NaN, strip, str)."""
    if v is None or (isinstance(v, float) and v != v):
        return None
    return str(v).strip() if isinstance(v, str) else v


def brute_force(left, right, key_idx, value_idx):
    """Pair every left row with every right row of the same key (NULL = NULL)."""
    stats = {i: [0, 0, 0, 0] for i in value_idx}
    pairs = matching = 0
    for a, b in product(left, right):
        if a[key_idx] != b[key_idx]:
            continue
        pairs += 1
        all_eq = True
        for i in value_idx:
            ca, cb = py_canon(a[i]), py_canon(b[i])
            eq = ca == cb
            stats[i][0 if eq else 1] += 1
            stats[i][2] += ca is None
            stats[i][3] += cb is None
            all_eq &= eq
        matching += all_eq
    return pairs, matching, stats
