"""Line deduplication by overlapping windows of three lines.

Three consecutive non-blank lines (outer blanks trimmed) form a window. A
window that occurs more than once in the corpus keeps its first occurrence, in
order of (doc_id, text key, position); the positions that later occurrences
cover are merged and removed. Single repeated lines, and repeated pairs, stay.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, same_row, text_key, unused

WINDOW = 3
BLANKS = " \t\r"


def _lines(docs: DataFrame) -> DataFrame:
    """doc_id, text_key, lines, nb: 0-based places of the non-blank lines, each with its trimmed text."""
    split = docs.select("doc_id", text_key(F.col("text")).alias("text_key"),
                        F.split(F.coalesce("text", F.lit("")), "\n", -1).alias("lines"))
    return split.withColumn("nb", F.filter(
        F.transform("lines", lambda x, i: F.struct(i.alias("i"), F.btrim(x, F.lit(BLANKS)).alias("s"))),
        lambda x: x["s"] != ""))


def windows(docs: DataFrame) -> DataFrame:
    """``(h1, h2, doc_id, text_key, j)``: one row per window; j counts non-blank lines from 0."""
    src = _lines(docs).where(F.size("nb") >= WINDOW)

    def hashed(j):
        parts = [F.get("nb", j + k)["s"] for k in range(WINDOW)]
        return F.struct(F.xxhash64(*parts).alias("h1"), F.xxhash64(F.lit(1), *parts).alias("h2"), j.alias("j"))

    return src.select("doc_id", "text_key", F.explode(
        F.transform(F.sequence(F.lit(0), F.size("nb") - WINDOW), hashed)).alias("w")).select(
        "w.h1", "w.h2", "doc_id", "text_key", "w.j")


def covered(docs: DataFrame) -> DataFrame:
    """``(doc_id, text_key, at)``: places (among non-blank lines) that later occurrences cover, merged."""
    occ = cut(windows(docs))
    place = F.struct("doc_id", "text_key", "j")
    first = (occ.groupBy("h1", "h2").agg(F.min(place).alias("first"), F.max(place).alias("last"))
             .where(~F.col("first").eqNullSafe(F.col("last"))).select("h1", "h2", "first"))
    later = occ.join(first, ["h1", "h2"]).where(~place.eqNullSafe(F.col("first")))
    return later.groupBy("doc_id", "text_key").agg(F.collect_set("j").alias("js")).select(
        "doc_id", "text_key", F.array_distinct(F.flatten(F.transform(
            "js", lambda j: F.array(*[j + k for k in range(WINDOW)])))).alias("at"))


def line_dedup(docs: DataFrame) -> DataFrame:
    """``docs`` with later occurrences of repeated windows removed from ``text``.

    Adds ``n_lines`` and ``n_removed`` and keeps every other column as it is
    (columns of those names are replaced). A document whose non-blank lines
    all go has the empty text; a document nothing is removed from keeps its
    text as it is, NULL included. Texts of fewer than three non-blank lines
    are never touched. Rows repeated in full are one document and get the same
    result each; rows with one doc_id and different texts are ordered by their
    text key. NULL ids come first. An empty table gives no rows.
    """
    rest = docs.drop("n_lines", "n_removed")
    d, k, at, every, nb = unused(rest.columns, "_d", "_k", "_at", "_lines", "_nb")
    hit = covered(docs).select(F.col("doc_id").alias(d), F.col("text_key").alias(k), F.col("at").alias(at))
    joined = rest.join(hit, same_row(rest, hit, d, k), "left")
    lines = F.split(F.coalesce("text", F.lit("")), "\n", -1)
    full = F.filter(F.transform(F.col(every), lambda x, i: F.when(F.btrim(x, F.lit(BLANKS)) != "", i)),
                    lambda i: i.isNotNull())
    gone = F.transform(F.col(at), lambda j: F.get(F.col(nb), j))
    kept = F.array_except(F.sequence(F.lit(0), F.size(every) - 1), gone)
    text = F.when(F.size(at) >= F.size(nb), F.lit("")).otherwise(
        F.array_join(F.transform(kept, lambda i: F.get(F.col(every), i)), "\n"))
    out = joined.withColumn(every, lines).withColumn(nb, full)
    columns = [F.when(F.col(at).isNull(), F.col("text")).otherwise(text).alias("text") if c == "text" else F.col(f"`{c}`")
               for c in rest.columns]
    return out.select(*columns, F.size(every).alias("n_lines"),
                      F.when(F.col(at).isNull(), 0).otherwise(F.size(at)).alias("n_removed"))
