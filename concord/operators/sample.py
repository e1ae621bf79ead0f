"""Repeatable sampling (P11) and record-id search (P10).

The sample keeps the same keys on both sides: membership is a pure function
of the key values (md5 of their text, after both sides are aligned to one
type, so INT keys and their BIGINT replicas fall together).
``DataFrame.sample`` would draw each side independently and manufacture
"missing" rows.
"""

from __future__ import annotations

from dataclasses import replace
from typing import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from concord.config import TablePair
from concord.functions import canon as C
from concord.sources.schema import quoted


def key_hash_bucket(keys: Sequence[Column], types: Sequence[T.DataType], aligned: Sequence[T.DataType],
                    buckets: int) -> Column:
    """The bucket of the ``keys`` (of ``types``) once they have the types ``aligned``."""
    texts = [C.display(C.align(k, t, a)) for k, t, a in zip(keys, types, aligned)]
    first_hex = F.substring(F.md5(F.concat_ws("|", *texts).cast("binary")), 1, 8)
    return F.conv(first_hex, 16, 10).cast("long") % F.lit(buckets)


def hash_sample(pair: TablePair, fraction_num: int, buckets: int = 100) -> TablePair:
    """The pair restricted to keys whose hash bucket is below ``fraction_num``."""
    keys = list(pair.keys)
    right_keys = [pair.column_mapping.get(k, k) for k in keys]
    lts = [pair.left.schema[k].dataType for k in keys]
    rts = [pair.right.schema[k].dataType for k in right_keys]
    aligned = [C.aligned_type(a, b, pair.bool_as_int) for a, b in zip(lts, rts)]

    def part(df: DataFrame, names, types) -> DataFrame:
        return df.where(key_hash_bucket([F.col(quoted(k)) for k in names], types, aligned, buckets) < fraction_num)

    return replace(pair, left=part(pair.left, keys, lts), right=part(pair.right, right_keys, rts))


def search_record_id(diffs: DataFrame, term: str) -> DataFrame:
    """Differences whose record id contains ``term``, case-insensitively."""
    return diffs.where(F.lower(F.col("record_id")).contains(term.lower()))
