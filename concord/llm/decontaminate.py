"""Benchmark decontamination by winnowing.

Words are runs of ASCII digits and letters (A-Z lower-cased) and of all
characters beyond ASCII. Documents and benchmark items keep the smallest hash
of every ``SPAN - K + 1`` consecutive k-grams (the rightmost of equals), so two
texts that share ``SPAN`` consecutive words keep at least one k-gram of that
span on both sides. Fingerprints are joined on their hash; every kept k-gram
carries the words around it, so a hit is extended word by word, both ways, to
whole windows of ``SPAN`` words without fetching either text again, and hash
collisions are discarded.

An item of fewer than ``SPAN`` words is one window by itself: its whole text
is the only k-gram, and documents are searched for k-grams of exactly the
lengths that such items have.

Documents keep only fingerprints that a bitmap of the benchmark's hashes
admits. The bitmap has at most ``MAX_BITS`` bits whatever the benchmark's size;
a fuller bitmap admits more fingerprints to the join, never fewer.

A long text is hashed in stretches that share ``SPAN - 1`` words, so every
window lies whole in one of them, and memory beyond the text itself does not
grow with it (one word longer than ``PIECE`` bytes is still held whole).
"""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_batches, cut, same_row, text_key, unused

SPAN = 13
K = 9
#: Words of context on either side of a k-gram: all windows of SPAN words around it.
REACH = SPAN - K
MAX_BITS = 1 << 26
#: Bytes of text hashed at a time; a longer text is cut between words.
PIECE = 1 << 20

_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_STEP = np.uint64(0xD6E8FEB86659FD93)

_byte = np.arange(256)
_IS_WORD = ((_byte >= 0x30) & (_byte <= 0x39)) | ((_byte >= 0x61) & (_byte <= 0x7A)) | (_byte >= 0x80)


def _mix(x: np.ndarray) -> np.ndarray:
    """Finalizer that spreads every bit of 64-bit integers (wrap-around arithmetic)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_VALUE = _mix(np.arange(1, 257, dtype=np.uint64) * _BASE)


class Words:
    """Words of some texts: byte places, 64-bit hashes and the text each belongs to."""

    def __init__(self, texts: list[bytes]):
        self.data = b"\x00".join(texts).lower()
        raw = np.frombuffer(self.data, dtype=np.uint8)
        sizes = np.fromiter((len(t) + 1 for t in texts), dtype=np.int64, count=len(texts))
        ends = np.cumsum(sizes)
        inside = np.concatenate(([False], _IS_WORD[raw], [False]))
        edge = np.flatnonzero(inside[1:] != inside[:-1])
        self.start, self.end = edge[::2], edge[1::2]
        #: words first[i] to first[i + 1] belong to text i
        self.first = np.searchsorted(self.start, np.concatenate(([0], ends)))
        if len(raw):
            power = np.cumprod(np.full(len(raw), _BASE, dtype=np.uint64))
            total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(_VALUE[raw] * power)))
            back = np.cumprod(np.full(len(raw), _INVERSE, dtype=np.uint64))
            self.hash = _mix((total[self.end] - total[self.start]) * back[self.start])
        else:
            self.hash = np.zeros(0, np.uint64)

    def grams(self, k: int) -> np.ndarray:
        """Hash of the k words from each word on (short of k words at the end: of none)."""
        n = len(self.hash) - k + 1
        if n <= 0:
            return np.zeros(0, np.uint64)
        g = np.full(n, np.uint64(k), dtype=np.uint64)
        for j in range(k):
            g = g * _STEP + self.hash[j:j + n]
        return _mix(g)

    def word(self, i: int) -> str:
        return self.data[self.start[i]:self.end[i]].decode("utf-8", "replace")


def winnow(words: Words, span: int = SPAN, k: int = K) -> tuple[np.ndarray, np.ndarray]:
    """Places and hashes of the k-grams kept; windows do not cross from one text into the next."""
    g, w = words.grams(k), span - k + 1
    n = len(g) - w + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    low, at = g[:n].copy(), np.arange(n)
    for j in range(1, w):
        nxt = g[j:j + n]
        take = nxt <= low
        low[take] = nxt[take]
        at[take] = np.flatnonzero(take) + j
    last = np.repeat(words.first[1:], np.diff(words.first))  # end of the text that a word belongs to
    at = np.unique(at[np.arange(n) + span <= last[:n]])
    return at, g[at]


def _context(words: Words, at: int, lo: int, hi: int, k: int) -> list[str | None]:
    """The k words at ``at`` with REACH words on either side, None beyond the text."""
    return [words.word(i) if lo <= i < hi else None for i in range(at - REACH, at + k + REACH)]


def _encoded(text) -> bytes:
    return text.encode("utf-8", "surrogatepass").replace(b"\x00", b" ") if isinstance(text, str) else b""


#: A byte that is in no word (before A-Z are lower-cased).
_GAP = re.compile(rb"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]")


def _stretches(text: bytes):
    """``(place of its first word, Words)`` of stretches of about PIECE bytes; neighbours share SPAN - 1 words."""
    at = first = 0
    while True:
        size = PIECE
        while True:
            gap = _GAP.search(text, at + size)
            end = gap.start() if gap else len(text)
            words = Words([text[at:end]])
            if end == len(text) or len(words.hash) >= 2 * SPAN:
                break
            size = 2 * (end - at)
        yield first, words
        if end == len(text):
            return
        step = len(words.hash) - (SPAN - 1)
        at, first = at + int(words.start[step]), first + step


def _worded(texts):
    """``(rows, place, Words)``: short texts some at a time, a long one stretch by stretch; place is that of its first word."""
    rows, held, size = [], [], 0
    for i, text in enumerate(texts):
        text = _encoded(text)
        if len(text) > PIECE:
            for first, words in _stretches(text):
                yield [i], first, words
            continue
        if rows and size + len(text) > PIECE:
            yield rows, 0, Words(held)
            rows, held, size = [], [], 0
        rows.append(i)
        held.append(text)
        size += len(text)
    if rows:
        yield rows, 0, Words(held)


def benchmark_prints(items: DataFrame) -> DataFrame:
    """``(item, k, hash, ctx)`` of ``items (item_id, text)``; item is the id as text."""
    arrow_batches(items.sparkSession)

    def run(batches):
        import pandas as pd

        for pdf in batches:
            out = []
            for item, text in zip(pdf["item"], pdf["text"]):
                for _, w in _stretches(_encoded(text)):
                    n = len(w.hash)
                    if n >= SPAN:
                        at, h = winnow(w)
                        out += [(item, K, x, _context(w, p, 0, n, K)) for p, x in zip(at.tolist(), h.view(np.int64).tolist())]
                    elif n:
                        out.append((item, n, int(w.grams(n).view(np.int64)[0]), [w.word(i) for i in range(n)]))
            yield pd.DataFrame(out, columns=["item", "k", "hash", "ctx"])

    src = items.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), "text")
    return src.mapInPandas(run, "item string, k int, hash bigint, ctx array<string>")


def _bitmap(prints: DataFrame) -> tuple[np.ndarray, int]:
    """Bitmap over the top bits of the benchmark's hashes, and the number of those bits."""
    n = prints.agg(F.approx_count_distinct("hash").alias("n")).first()["n"]
    width = min(MAX_BITS.bit_length() - 1, max(16, int(n * 32).bit_length()))
    slot = F.shiftrightunsigned("hash", 64 - width)
    words = (prints.groupBy(F.shiftright(slot, 6).alias("w"))
             .agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("bigint"), slot.bitwiseAND(F.lit(63)).cast("int"))).alias("b")))
    out = np.zeros(1 << (width - 6), dtype=np.uint64)
    for r in words.toLocalIterator():  # at most MAX_BITS / 64 rows
        out[r["w"]] = np.uint64(r["b"] & 0xFFFFFFFFFFFFFFFF)
    return out, width


def document_prints(docs: DataFrame, bitmap, lengths: list[int]) -> DataFrame:
    """``(doc_id, text_key, n_words, found)`` per row; found: kept fingerprints that the bitmap admits."""
    arrow_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(bitmap)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def admitted(h: np.ndarray) -> np.ndarray:
        bits, width = shared.value
        slot = h >> np.uint64(64 - width)
        return (bits[slot >> np.uint64(6)] >> (slot & np.uint64(63)) & np.uint64(1)).astype(bool)

    def marks(w: Words):
        """``(text, fingerprint)`` of the admitted fingerprints."""
        owner = np.repeat(np.arange(len(w.first) - 1), np.diff(w.first))
        for k in [0, *lengths]:
            if k:  # the length of short items: every place counts
                h = w.grams(k)
                at = np.flatnonzero(admitted(h)) if len(h) else np.zeros(0, np.int64)
                at = at[owner[at] == owner[at + k - 1]]
                h = h[at]
            else:
                at, h = winnow(w)
                keep = admitted(h) if len(h) else np.zeros(0, bool)
                at, h = at[keep], h[keep]
            for p, x in zip(at.tolist(), h.view(np.int64).tolist()):
                i = int(owner[p])
                lo, hi = int(w.first[i]), int(w.first[i + 1])
                ctx = [w.word(q) for q in range(p, p + k)] if k else _context(w, p, lo, hi, K)
                yield i, {"k": k or K, "hash": x, "at": p - lo, "short": bool(k), "ctx": ctx}

    def run(batches):
        for pdf in batches:
            texts = pdf.pop("text")
            found, counts = [[] for _ in texts], np.zeros(len(texts), np.int64)
            for rows, place, w in _worded(texts):
                counts[rows] = place + np.diff(w.first)
                for i, mark in marks(w):
                    mark["at"] += place
                    found[rows[i]].append(mark)
            pdf["n_words"], pdf["found"] = counts, found
            yield pdf

    src = docs.select("doc_id", text_key(F.col("text")).alias("text_key"), "text")
    return src.mapInPandas(run, f"doc_id {kind}, text_key bigint, n_words bigint, found array<struct<"
                                "k: int, hash: bigint, at: bigint, short: boolean, ctx: array<string>>>")


def contamination(docs: DataFrame, items: DataFrame) -> DataFrame:
    """Per row of ``docs (doc_id, text)``: n_words, n_hit, items and contaminated.

    A document word is hit if it lies in an occurrence of ``SPAN`` consecutive
    words of an item, or of a whole item of fewer words (but not none).
    ``items`` are the ids, as text and in text order, of the items with such
    occurrences; contaminated means n_hit > 0 and 20 * n_hit >= n_words. NULL
    and wordless texts have no words and no hits; rows repeated in full get the
    same result each; rows with one doc_id and different texts are separate; a
    NULL item_id counts as the id ''. Empty tables give no rows or no hits.
    Columns beyond doc_id, text and item_id are ignored.
    """
    prints = cut(benchmark_prints(items))
    short = F.size("ctx") < SPAN  # short items carry their words alone
    lengths = sorted(r["k"] for r in prints.where(short).select("k").distinct().collect())  # at most SPAN - 1
    marks = cut(document_prints(docs, _bitmap(prints), lengths))
    key = ["doc_id", "text_key"]
    # one row per different print, with the items that have it
    known = prints.select("k", "hash", short.alias("short"), F.col("ctx").alias("ictx"), "item").groupBy(
        "k", "hash", "short", "ictx").agg(F.collect_set("item").alias("of"))
    hits = marks.where(F.size("found") > 0).select(*key, F.explode("found").alias("f")).select(*key, "f.*")
    met = hits.join(known, ["k", "hash", "short"])

    def whole(o):
        mine, theirs = F.slice("ctx", o + 1, SPAN), F.slice("ictx", o + 1, SPAN)
        ends = F.get("ctx", o).isNotNull() & F.get("ctx", o + SPAN - 1).isNotNull()
        return ends & (mine == theirs)

    starts = F.when(F.col("short"), F.when(F.col("ctx") == F.col("ictx"), F.array(F.col("at")))).otherwise(
        F.transform(F.filter(F.sequence(F.lit(0), F.lit(REACH)), whole), lambda o: F.col("at") - REACH + o))
    spans = (met.withColumn("starts", starts).where(F.size("starts") > 0)
             .select(*key, F.explode("starts").alias("s"), F.when(F.col("short"), F.col("k")).otherwise(SPAN).alias("n"), "of")
             .groupBy(*key, "s", "n").agg(F.array_distinct(F.flatten(F.collect_set("of"))).alias("of")))
    per_doc = spans.groupBy(*key).agg(
        F.sort_array(F.collect_list(F.struct("s", "n"))).alias("spans"),
        F.sort_array(F.array_distinct(F.flatten(F.collect_set("of")))).alias("items"))
    covered = F.aggregate(
        "spans", F.struct(F.lit(0).cast("bigint").alias("hit"), F.lit(0).cast("bigint").alias("end")),
        lambda acc, x: F.struct(
            (acc["hit"] + F.greatest(F.lit(0).cast("bigint"), x["s"] + x["n"] - F.greatest(acc["end"], x["s"]))).alias("hit"),
            F.greatest(acc["end"], x["s"] + x["n"]).alias("end")))
    per_doc = per_doc.select(F.col("doc_id").alias("_d"), F.col("text_key").alias("_k"), covered["hit"].alias("hit"), "items")
    out = marks.select(*key, "n_words").join(
        per_doc, F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("text_key") == F.col("_k")), "left")
    n_hit = F.coalesce("hit", F.lit(0).cast("bigint"))
    return out.select(*key, "n_words", n_hit.alias("n_hit"),
                      F.coalesce("items", F.array().cast("array<string>")).alias("items"),
                      ((n_hit > 0) & (20 * n_hit >= F.col("n_words"))).alias("contaminated"))


def decontaminate(docs: DataFrame, items: DataFrame) -> DataFrame:
    """Rows of ``docs`` that are not contaminated, all columns kept."""
    d, k = unused(docs.columns, "_d", "_k")
    bad = contamination(docs, items).where("contaminated").select(
        F.col("doc_id").alias(d), F.col("text_key").alias(k)).distinct()
    return docs.join(bad, same_row(docs, bad, d, k), "left_anti")
