"""Quality classifier: a generalised additive model with pairwise interactions.

Every feature of a document falls into one of a few bins, and a lookup table
gives each bin a number; the sum of the numbers is the log-odds of quality. The
tables are learned by cyclic boosting: in turn, one feature after the other,
a shallow tree over the feature's bins is fitted to what the model still gets
wrong, and a small part of it is added to the table. Then the pairs of features
whose joint bins explain most of the rest get tables of their own, learned in
the same way by trees with one split on either feature. Scoring adds up table
entries, whole columns at a time.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import arrow_batches, cut

#: Labelled rows that the model is fitted on, at most (by a hash of the id).
FIT_ROWS = 40_000
BINS, PAIR_BINS, PAIRS = 32, 8, 6
ROUNDS, PAIR_ROUNDS, RATE = 120, 60, 0.15
THRESHOLD = 0.3
#: Words looked at together; features of a longer text are counted piece by piece.
PIECE = 1 << 16

NAMES = ("log_chars", "log_words", "word_length", "long_words", "upper", "digits", "symbols", "marks", "non_ascii",
         "distinct", "top_word", "echo", "one_letter", "shouted", "line_words", "line_repeats", "ends", "all_caps_run")

_b = np.arange(256)
_CLASS = np.zeros((256, 5), dtype=np.int64)
_CLASS[:, 0] = (_b >= 65) & (_b <= 90)
_CLASS[:, 1] = (_b >= 48) & (_b <= 57)
_CLASS[:, 2] = ((_b > 32) & (_b < 127)) & ~((_b >= 48) & (_b <= 57)) & ~((_b >= 65) & (_b <= 90)) & ~((_b >= 97) & (_b <= 122))
_CLASS[:, 3] = np.isin(_b, list(b"!|*#%&$^~<>{}[]=\\"))
_CLASS[:, 4] = _b >= 128


def features(text: str | None) -> list[float]:
    """The features NAMES of a whole text (NULL: empty). All are shares or means, but for the sizes."""
    text = text or ""
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), dtype=np.uint8)
    classes = np.bincount(raw, minlength=256) @ _CLASS / max(1, len(raw))
    words = text.split()
    n = max(1, len(words))
    seen: dict[str, int] = {}
    echo = shouted = one = long = run = best = 0
    last = None
    for w in words:
        seen[w] = seen.get(w, 0) + 1
        if w == last:
            echo += 1
        last = w
        k = len(w)
        if k == 1:
            one += 1
        elif k > 18:
            long += 1
        if w.isupper():
            shouted += 1
            run += 1
            if run > best:
                best = run
        else:
            run = 0
    lines = [x for x in text.split("\n") if x.strip()]
    chars = len(text)
    return [np.log1p(chars), np.log1p(len(words)), chars / n, long / n, *classes.tolist(),
            np.log(max(1, len(seen))) / np.log(n + 1.0), max(seen.values(), default=0) / n, echo / n, one / n, shouted / n,
            np.log1p(len(words) / max(1, len(lines))), 1 - len(set(lines)) / max(1, len(lines)),
            sum(x.rstrip()[-1] in ".!?…" for x in lines) / max(1, len(lines)), best / n]


def feature_rows(docs: DataFrame) -> DataFrame:
    """``(doc_id, x)`` per row of ``docs (doc_id, text)``."""
    arrow_batches(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for pdf in batches:
            pdf["x"] = [features(t if isinstance(t, str) else None) for t in pdf.pop("text")]
            yield pdf

    return docs.select("doc_id", "text").mapInPandas(run, f"doc_id {kind}, x array<double>")


def _tree(g: np.ndarray, h: np.ndarray, leaves: int = 3) -> np.ndarray:
    """Newton values of a tree of few leaves over ordered bins with gradient and curvature sums."""
    cuts = [0, len(g)]
    cg, ch = np.concatenate(([0.0], np.cumsum(g))), np.concatenate(([0.0], np.cumsum(h)))
    gain = lambda a, b: (cg[b] - cg[a]) ** 2 / (ch[b] - ch[a] + 1.0)
    for _ in range(leaves - 1):
        best = (1e-9, None)
        for a, b in zip(cuts, cuts[1:]):
            for m in range(a + 1, b):
                up = gain(a, m) + gain(m, b) - gain(a, b)
                if up > best[0]:
                    best = (up, m)
        if best[1] is None:
            break
        cuts = sorted([*cuts, best[1]])
    out = np.zeros(len(g))
    for a, b in zip(cuts, cuts[1:]):
        out[a:b] = (cg[b] - cg[a]) / (ch[b] - ch[a] + 1.0)
    return out


def _pair_tree(g: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, float]:
    """Best tree with one split on either feature over a table of bins, and its gain."""
    cg, ch = (np.pad(x.cumsum(0).cumsum(1), ((1, 0), (1, 0))) for x in (g, h))
    k = len(g)
    i, j = np.meshgrid(np.arange(1, k), np.arange(1, k), indexing="ij")
    parts = []
    for c in (cg, ch):
        a, top, left, total = c[i, j], c[i, k], c[k, j], c[k, k]
        parts.append(np.stack([a, top - a, left - a, total - top - left + a]))
    gains = (parts[0] ** 2 / (parts[1] + 1.0)).sum(axis=0)
    at = np.unravel_index(np.argmax(gains), gains.shape)
    v = parts[0][(slice(None), *at)] / (parts[1][(slice(None), *at)] + 1.0)
    out = np.empty_like(g)
    a, b = at[0] + 1, at[1] + 1
    out[:a, :b], out[:a, b:], out[a:, :b], out[a:, b:] = v
    return out, float(gains[at])


class Gam:
    """Bin edges and lookup tables. An unfitted model scores every row with ``base``."""

    def __init__(self):
        self.base = 0.0
        self.edges: list[np.ndarray] = []
        self.tables: list[np.ndarray] = []
        self.pairs: list[tuple[int, int, np.ndarray]] = []
        self.coarse: list[np.ndarray] = []

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.column_stack([np.searchsorted(e, x[:, f], side="right") for f, e in enumerate(self.edges)])

    def logits(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        if not self.edges or not len(x):
            return out
        b = self.bins(x)
        for f, t in enumerate(self.tables):
            out += t[b[:, f]]
        for f, g, t in self.pairs:
            out += t[self.coarse[f][b[:, f]], self.coarse[g][b[:, g]]]
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x), -30, 30)))

    def fit(self, x: np.ndarray, y: np.ndarray) -> "Gam":
        share = (y.sum() + 1) / (len(y) + 2)
        self.base = float(np.log(share / (1 - share)))
        if len(y) < 20 or y.min() == y.max():
            return self
        self.edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, BINS + 1)[1:-1])) for f in range(x.shape[1])]
        self.coarse = [np.arange(len(e) + 1) * PAIR_BINS // (len(e) + 1) for e in self.edges]
        b = self.bins(x)
        self.tables = [np.zeros(len(e) + 1) for e in self.edges]
        logit = np.full(len(y), self.base)

        def left(at, size):
            p = 1 / (1 + np.exp(-logit))
            return np.bincount(at, y - p, size), np.bincount(at, p * (1 - p), size)

        for _ in range(ROUNDS):
            for f, table in enumerate(self.tables):
                step = RATE * _tree(*left(b[:, f], len(table)))
                table += step
                logit += step[b[:, f]]
        cell = {(f, g): self.coarse[f][b[:, f]] * PAIR_BINS + self.coarse[g][b[:, g]]
                for f, g in combinations(range(len(self.tables)), 2)}
        square = lambda at: [v.reshape(PAIR_BINS, PAIR_BINS) for v in left(at, PAIR_BINS ** 2)]
        gains = {p: _pair_tree(*square(at))[1] for p, at in cell.items()}
        chosen = sorted(gains, key=lambda p: (-gains[p], p))[:PAIRS]
        self.pairs = [(f, g, np.zeros((PAIR_BINS, PAIR_BINS))) for f, g in chosen]
        for _ in range(PAIR_ROUNDS):
            for f, g, table in self.pairs:
                step = RATE * _pair_tree(*square(cell[f, g]))[0]
                table += step
                logit += step.ravel()[cell[f, g]]
        return self


def quality(docs: DataFrame, labels: DataFrame, learn: Column | None = None, limit: int = FIT_ROWS) -> DataFrame:
    """``(doc_id, score, predicted)`` per row of ``docs (doc_id, text)``; predicted is 1 if score >= 0.3, else 0.

    Learns from ``labels (doc_id, quality)`` of the documents that ``learn`` (a
    condition on doc_id; all by default) admits, at most about ``limit`` of
    them by a hash of the id. Of several labels of an id the smallest counts,
    NULL labels and ids none. NULL is the empty text, which has a score like
    any other. With under 20 labelled documents, or labels of one kind, all
    scores are the (smoothed) share of label 1. Repeated rows give repeated
    rows, an empty table none; other columns are ignored.
    """
    spark = docs.sparkSession
    rows = cut(feature_rows(docs))
    known = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull())
    known = known.where(learn) if learn is not None else known
    known = known.groupBy("doc_id").agg(F.min(F.col("quality").cast("int")).alias("y"))
    n = known.count()
    mark = F.pmod(F.xxhash64(F.col("doc_id").cast("string"), F.lit("quality")), F.lit(1_000_000))
    few = lambda df: df.where(mark < int(1_000_000 * min(1.0, limit / max(1, n))))
    train = few(rows).join(few(known), "doc_id").select("x", "y").collect()  # about `limit` short rows
    x = np.array([r["x"] for r in train]).reshape(-1, len(NAMES))
    y = np.array([float(r["y"] > 0) for r in train])
    order = np.lexsort((*x.T, y)) if len(y) else []
    model = spark.sparkContext.broadcast(Gam().fit(x[order], y[order]))
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for pdf in batches:
            own = pdf.pop("x")
            pdf["score"] = model.value.score(np.array(own.tolist(), dtype=float).reshape(-1, len(NAMES)))
            yield pdf

    scored = rows.mapInPandas(run, f"doc_id {kind}, score double")
    return scored.withColumn("predicted", F.when(F.col("score") >= THRESHOLD, 1).otherwise(0))
