"""SimHash near-duplicates by a positional byte index with count filtering.

A 64-bit fingerprint is eight positional bytes. Two fingerprints that differ
in at most ``max_bits`` bits differ in at most that many bytes, so they share
at least ``8 - max_bits`` positional bytes: the guaranteed minimum of matches.
Posting lists of single bytes hold 1/256 of all fingerprints, and tallying
their pairs would grow with the square of the input; the index therefore posts
every fingerprint under each *combination* of that many positional bytes (28
keys of six bytes for two bits). A pair reaches the minimum tally exactly when
it meets in such a posting, and there only the remaining bytes decide.

A posting's members differ in the remaining bytes only, so it has at most
``256 ** max_bits`` members however many documents the corpus has. Inside a
posting the bit distance is verified and the links are reduced to a spanning
forest: pairs are never listed, and no link is lost for connectivity.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import arrow_batches, components, cut, same_row, text_key, unused

SEED = 42
#: Shingles unpacked to bits at a time.
CHUNK = 1 << 15
#: Postings up to this size are compared pair by pair, larger ones by bit flips.
SMALL = 24


def fingerprint(text: str | None, width: int = 3) -> int:
    """SimHash of a text: A-Z lower-cased, words between ASCII white space.

    Shingles of ``width`` words, repeats included; fewer words make one
    shingle, none the fingerprint zero. Unsigned 64 bits.
    """
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    digest = xxhash.xxh64_intdigest
    ones, n = np.zeros(64, np.int64), max(1, len(words) - width + 1)
    for at in range(0, n, CHUNK):
        part = words[at:at + CHUNK + width - 1] if n > 1 else words
        rows = map(b" ".join, zip(*(part[i:] for i in range(width)))) if n > 1 else [b" ".join(words)]
        h = np.array([digest(s, SEED) for s in rows], dtype="<u8")
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(2 * ones > n, bitorder="little")
    return int(bits.view("<u8")[0])


def fingerprints(docs: DataFrame, width: int = 3) -> DataFrame:
    """``(doc_id, text_key, fp)`` per row of ``docs (doc_id, text)``; fp is the signed 64-bit fingerprint."""
    arrow_batches(docs.sparkSession)

    def run(batches):
        for pdf in batches:
            fp = np.array([fingerprint(t, width) for t in pdf.pop("text")], dtype=np.uint64)
            pdf["fp"] = fp.view(np.int64)
            yield pdf

    src = docs.select("doc_id", text_key(F.col("text")).alias("text_key"), "text")
    kind = docs.schema["doc_id"].dataType.simpleString()
    return src.mapInPandas(run, f"doc_id {kind}, text_key bigint, fp bigint")


def _postings(fp: Column, max_bits: int) -> Column:
    """Array of (combination, shared bytes) keys of a fingerprint."""
    keys = []
    for c, free in enumerate(combinations(range(8), max_bits)):
        mask = sum(0xFF << (8 * i) for i in range(8) if i not in free)
        mask -= (1 << 64) * (mask >> 63)
        keys.append(F.struct(F.lit(c).alias("c"), fp.bitwiseAND(F.lit(mask).cast("bigint")).alias("shared")))
    return F.array(*keys)


def _spanning(members: np.ndarray, max_bits: int) -> list[tuple[int, int]]:
    """Links of a posting reduced to (member, smallest member of its part); all in one pass of union-find."""
    vals = [int(x) for x in members]
    n, parent = len(vals), list(range(len(vals)))

    def find(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    if n <= SMALL:
        for i in range(n):
            for j in range(i):
                if ((vals[i] ^ vals[j]) & 0xFFFFFFFFFFFFFFFF).bit_count() <= max_bits:
                    a, b = find(i), find(j)
                    if a != b:
                        parent[max(a, b)] = min(a, b)
    else:
        at = {v & 0xFFFFFFFFFFFFFFFF: i for i, v in enumerate(vals)}
        spread = 0
        for v in at:
            spread |= v ^ (vals[0] & 0xFFFFFFFFFFFFFFFF)
        free = [1 << b for b in range(64) if spread >> b & 1]
        flips = [sum(x) for r in range(1, max_bits + 1) for x in combinations(free, r)]
        for v, i in at.items():
            for f in flips:
                j = at.get(v ^ f)
                if j is not None:
                    a, b = find(i), find(j)
                    if a != b:
                        parent[max(a, b)] = min(a, b)
    return [(vals[i], vals[find(i)]) for i in range(n) if find(i) != i]


def links(prints: DataFrame, max_bits: int = 2) -> DataFrame:
    """Spanning links ``(a, b)`` between distinct fingerprints ``fp`` at most ``max_bits`` apart."""
    if not 1 <= max_bits <= 2:
        raise ValueError("max_bits is 1 or 2: larger distances leave too many free bytes in a posting")
    # a row becomes 28: deal the rows out by the configured number of partitions first
    spread = prints.select("fp").repartition(int(prints.sparkSession.conf.get("spark.sql.shuffle.partitions")), "fp")
    posted = (spread.select("fp", F.explode(_postings(F.col("fp"), max_bits)).alias("p"))
              .groupBy("p.c", "p.shared").agg(F.collect_list("fp").alias("members"))
              .where(F.size("members") > 1).select("members"))

    def run(batches):
        import pandas as pd

        for pdf in batches:
            found = [e for m in pdf["members"] for e in _spanning(m, max_bits)]
            yield pd.DataFrame(found, columns=["a", "b"], dtype="int64")

    return posted.mapInPandas(run, "a bigint, b bigint").distinct()


def simhash_groups(docs: DataFrame, width: int = 3, max_bits: int = 2) -> DataFrame:
    """``(doc_id, text_key, fp, component_id)`` per row of ``docs (doc_id, text)``.

    ``component_id`` is the smallest doc_id that is reachable by links of at
    most ``max_bits`` differing bits, the row's own included. NULL and blank
    texts have fingerprint zero and are linked like any other; rows that are
    repeated in full get the same result each; rows with one doc_id and
    different texts are separate nodes; NULL ids never become a component_id
    unless the component has no other id. An empty table gives no rows. Other
    columns are ignored.
    """
    return _rooted(docs, width, max_bits).drop("root")


def _rooted(docs: DataFrame, width: int, max_bits: int) -> DataFrame:
    """The rows of ``simhash_groups`` and ``root``, a fingerprint that names the group."""
    prints = cut(fingerprints(docs, width))
    nodes = cut(prints.groupBy("fp").agg(F.min("doc_id").alias("rep")))
    roots = components(links(nodes, max_bits))
    named = nodes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select(
        "fp", F.coalesce("root", "fp").alias("root"), "rep")
    best = named.groupBy("root").agg(F.min("rep").alias("component_id"))
    of = named.select("fp", "root").join(best, "root").select("fp", "root", "component_id")
    return prints.join(of, "fp").select("doc_id", "text_key", "fp", "component_id", "root")


def hex_fingerprint(fp: Column) -> Column:
    return F.lpad(F.lower(F.hex(fp)), 16, "0")


def keep_one(docs: DataFrame, width: int = 3, max_bits: int = 2) -> DataFrame:
    """One row of ``docs`` per group: that of the smallest doc_id, all columns kept.

    Of rows that share that id the smallest text key stays, of rows that share
    the text too any one; a group without ids keeps one row likewise. Rows that
    share an id (or have none) but are in different groups all stay.
    """
    place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_key")
    d, k = unused(docs.columns, "_d", "_k")
    stay = (_rooted(docs.select("doc_id", "text"), width, max_bits).groupBy("root").agg(F.min(place).alias("x"))
            .select(F.col("x.doc_id").alias(d), F.col("x.text_key").alias(k)))
    return docs.join(stay, same_row(docs, stay, d, k)).dropDuplicates(["doc_id", k]).drop(d, k)
