"""Ranked lexical search by an Aho-Corasick scan of the documents, without an index of them.

Every item of a query set is a bag of terms. One automaton holds the terms of
all items, each between two blanks (the guard that makes a hit a whole term);
documents are scanned for it with everything that is no term turned to blanks.
The automaton's outputs are the terms' numbers, and a table says which items
each term belongs to. Two scans over the documents: the first adds up how many
documents hold each term (and N and L, over all documents), the second scores
every document for every item and keeps, task by task, the best of each item.

The items are dealt into slices of about ``SLICE_BYTES`` of text by hash; a
slice's terms are what is broadcast and what the driver holds at a time, so
its size does not grow with the set of items, and every slice is one more pair
of scans.
"""

from __future__ import annotations

import math
import uuid

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import arrow_batches

#: Bytes of item text whose terms are in one automaton (one item more at most).
SLICE_BYTES = 8 << 20
#: Added to an item's bytes for its own sake.
ITEM_BYTES = 64
#: Best documents kept of every item.
TOP = 50

# Letters and digits of ASCII and all bytes beyond it make terms; A-Z are lower-cased, the rest is blank.
_TERM_BYTES = bytes(b + 32 if 0x41 <= b <= 0x5A else b if b >= 0x80 or chr(b).isalnum() else 0x20 for b in range(256))


def plain(text: str | None) -> bytes:
    """The text's terms between blanks."""
    return b" " + (text or "").encode("utf-8", "surrogatepass").translate(_TERM_BYTES) + b" "


def count_terms(data: bytes) -> int:
    """Number of terms of a ``plain`` text, repeats included."""
    inside = np.frombuffer(data, dtype=np.uint8) != 0x20
    return int(np.count_nonzero(inside[1:] & ~inside[:-1]))


class Slice:
    """Terms of some items and, for every term, the items that it is in (both by number)."""

    def __init__(self, bags: list[list[bytes]]):
        self.number: dict[bytes, int] = {}
        pairs = [(self.number.setdefault(t, len(self.number)), i) for i, bag in enumerate(bags) for t in bag]
        pairs.sort()
        self.items = np.array([i for _, i in pairs], dtype=np.int64)
        self.first = np.searchsorted(np.array([t for t, _ in pairs], dtype=np.int64), np.arange(len(self.number) + 1))
        self.n_items = len(bags)
        self.key = uuid.uuid4().hex


_BUILT: dict[str, object] = {}


def automaton(part: Slice):
    """The slice's automaton; a worker keeps the last one that it built."""
    if part.key not in _BUILT:
        import ahocorasick

        a = ahocorasick.Automaton()
        for term, i in part.number.items():
            a.add_word(f" {term.decode('utf-8', 'surrogatepass')} ", i)
        a.make_automaton()
        _BUILT.clear()
        _BUILT[part.key] = a
    return _BUILT[part.key]


def term_counts(scanner, data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of the slice's terms in a ``plain`` text, and how often each occurs."""
    hits = np.fromiter((i for _, i in scanner.iter(data.decode("utf-8", "surrogatepass"))), dtype=np.int64)
    return np.unique(hits, return_counts=True)


def weight(df: int, n_docs: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def _statistics(docs: DataFrame, shared) -> DataFrame:
    """``(term, n)``: documents holding the term; term -1: documents with terms, -2: terms of all documents."""
    def run(batches):
        import pyarrow as pa

        part = shared.value
        scanner = automaton(part) if part.number else None
        df, n_docs, n_terms = np.zeros(len(part.number), dtype=np.int64), 0, 0
        for batch in batches:
            for text in batch.column("text").to_pylist():
                data = plain(text)
                n = count_terms(data)
                n_docs, n_terms = n_docs + (n > 0), n_terms + n
                if n and scanner is not None:
                    df[term_counts(scanner, data)[0]] += 1
        terms = np.concatenate(([-1, -2], np.flatnonzero(df)))
        yield pa.RecordBatch.from_arrays([pa.array(terms), pa.array(np.concatenate(([n_docs, n_terms], df[df > 0])))], ["term", "n"])

    return docs.select("text").mapInArrow(run, "term bigint, n bigint").groupBy("term").agg(F.sum("n").alias("n"))


class Best:
    """The best ``top`` of what is added: (-score, whether there is an id, id), the smallest first."""

    def __init__(self, top: int):
        self.top, self.rows, self.full = top, [], False

    def add(self, row: tuple) -> None:
        if self.full and not row < self.rows[self.top - 1]:
            return
        self.rows.append(row)
        if len(self.rows) >= 2 * self.top:
            self.rows = sorted(self.rows)[:self.top]
            self.full = True

    def done(self) -> list[tuple]:
        return sorted(self.rows)[:self.top]


def _scored(docs: DataFrame, shared, weights, n_docs: int, n_terms: int, top: int) -> DataFrame:
    """``(item, doc_id, score)``: of every task, the best documents of each item of the slice."""
    kind = docs.schema["doc_id"].dataType
    arrow_kind = to_arrow_type(kind)

    def run(batches):
        import pyarrow as pa

        part, w = shared.value, weights.value
        scanner = automaton(part)
        best = [Best(top) for _ in range(part.n_items)]
        floor = np.ones(part.n_items, dtype=np.int64)  # scores below can't be among the best
        for batch in batches:
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                data = plain(text)
                n = count_terms(data)
                if not n:
                    continue
                terms, tf = term_counts(scanner, data)
                if not len(terms):
                    continue
                m = 50 + 50 * n * n_docs // n_terms
                gain = w[terms] * ((1_000_000_000 * tf) // (1000 * tf + 20 * m))
                size = part.first[terms + 1] - part.first[terms]
                of = part.items[np.repeat(part.first[terms + 1] - np.cumsum(size), size) + np.arange(size.sum())]
                score = np.zeros(part.n_items, dtype=np.int64)
                np.add.at(score, of, np.repeat(gain, size))
                for i in np.flatnonzero(score >= floor).tolist():
                    own = best[i]
                    own.add((-int(score[i]), doc is not None, doc))
                    if own.full:
                        floor[i] = max(1, -own.rows[top - 1][0])
        rows = [(i, doc, -s) for i, own in enumerate(best) for s, _, doc in own.done()]
        item, ids, scores = zip(*rows) if rows else ((), (), ())
        yield pa.RecordBatch.from_arrays([pa.array(item, pa.int64()), pa.array(ids, arrow_kind), pa.array(scores, pa.int64())],
                                         ["item", "doc_id", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, f"item bigint, doc_id {kind.simpleString()}, score bigint")


def ranked(docs: DataFrame, items: DataFrame, top: int = TOP, slice_bytes: int = SLICE_BYTES) -> DataFrame:
    """``(item_id, rank, doc_id, score)``: the ``top`` best documents of every item of ``items (item_id, text)``.

    Terms are runs of ASCII letters and digits and of characters beyond ASCII,
    A-Z lower-cased. N counts the ``docs (doc_id, text)`` with terms, L their
    terms, n one document's terms, df the documents that hold a term, tf its
    occurrences in one. A document's score sums w * (10**9 * tf div (1000 * tf
    + 20 * m)) over the item's different terms, with w = floor(1000 * ln((2N +
    2) / (2df + 1))) and m = 50 + 50 * n * N div L; documents of score 0 are
    left out and equal scores go by ascending doc_id, NULL first.

    NULL and wordless texts have no terms: such documents are not counted and
    such items get no rows. Rows of ``docs`` repeated in full are ranked one by
    one; rows of ``items`` that are equal in item_id and text are one item, and
    rows with one item_id and different texts are ranked each by itself. An
    empty table gives no rows; other columns are ignored.
    """
    spark = docs.sparkSession
    arrow_batches(spark)
    bags = items.select("item_id", "text").where(F.col("text").rlike("[0-9A-Za-z]|[^\\x00-\\x7F]")).distinct()
    n_bytes = bags.agg(F.sum(F.octet_length("text") + ITEM_BYTES)).first()[0] or 0
    n_slices = -(-n_bytes // slice_bytes)
    found = None
    for at in range(n_slices):
        own = F.pmod(F.xxhash64("item_id", "text"), F.lit(n_slices)) == at
        rows = bags.where(own).collect()  # about slice_bytes of text
        part = Slice([sorted(set(plain(r["text"]).split())) for r in rows])
        if not part.number:
            continue
        shared = spark.sparkContext.broadcast(part)
        counts = {r["term"]: r["n"] for r in _statistics(docs, shared).collect()}  # a row a term of the slice
        n_docs, n_terms = counts.get(-1, 0), counts.get(-2, 0)
        if not n_docs:
            break
        w = np.array([weight(counts.get(t, 0), n_docs) for t in range(len(part.number))], dtype=np.int64)
        scores = _scored(docs, shared, spark.sparkContext.broadcast(w), n_docs, n_terms, top)
        names = spark.createDataFrame([(i, r["item_id"]) for i, r in enumerate(rows)],
                                      f"item bigint, item_id {items.schema['item_id'].dataType.simpleString()}")
        order = Window.partitionBy("item").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_first())
        got = (scores.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
               .join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score"))
        found = got if found is None else found.union(got)
    if found is not None:
        return found
    kinds = [df.schema[c].dataType.simpleString() for df, c in ((items, "item_id"), (docs, "doc_id"))]
    return spark.createDataFrame([], f"item_id {kinds[0]}, rank int, doc_id {kinds[1]}, score bigint")
