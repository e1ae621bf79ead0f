"""Toxicity scoring behind a noisy-channel deobfuscation.

A writer who hides a word replaces letters by look-alikes, puts separators
between them or repeats them. Every odd token becomes a lattice: look-alikes
may stand for letters, separators for nothing or for a word boundary, runs of
one letter for one or two of it. The Viterbi path that is likeliest under the
channel and a character trigram model of the corpus is the restored word. A
token of plain letters without a run has a lattice of one path and is its own
restoration. Letters in runs of two are ordinary spelling too, and look-alikes
at a token's edges ordinary punctuation: there both readings are kept.

The trigram model counts the words of all documents over a folded alphabet (26
letters, one class for all other letters, one boundary), so it has 28**3
counts whatever the corpus.

Words are scored by how much oftener they, or their beginnings, stand in
documents labelled toxic than in others; a document's score is a logistic
function of its words' scores.
"""

from __future__ import annotations

import math
import re
import sys
import unicodedata
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_batches, cut

#: Labelled rows that the classifier is fitted on, at most (by a hash of the id); the LM counts all documents.
FIT_ROWS = 20_000
#: Word beginnings used as features, and the most features a model keeps.
BEGINNINGS, MODEL_SIZE = (3, 4, 5, 6), 100_000
#: Restored tokens kept per Python worker.
KEPT = 400_000
THRESHOLD = 0.3

#: Letters that a character may stand for.
LOOKALIKES = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "<": "c", "€": "e", "£": "l", "¡": "i", "§": "s",
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "і": "i", "ѕ": "s", "ј": "j", "к": "k", "ν": "v", "ο": "o", "α": "a",
}
INVISIBLE = dict.fromkeys(map(ord, "​‌‍⁠﻿­"))

BOUNDARY, OTHER, SYMBOLS = 0, 27, 28
#: Costs (natural logarithms) of the channel.
AS_LETTER, AS_ITSELF, DROPPED, SPLIT, JOINED, RUN = -1.0, -2.5, -5.0, -3.0, -1.0, -0.7
#: Characters on either side of a token that are punctuation, not spelling.
_EDGE = ".,;:?\"'()[]{}*#%&|_~^<>/\\=+-–—…“”‘’«»¿¡!`"
#: Those of them that stand for no letter.
_MARKS = "".join(c for c in _EDGE if c not in LOOKALIKES)
_SPACED = re.compile(r"(?:(?<=\s)|^)(?:\S\s+){2,}\S(?=\s|$)")
_GAP = re.compile(r"\s+")
_RUN, _LONG_RUN = re.compile(r"(.)\1", re.S), re.compile(r"(.)\1\1", re.S)


def fold(c: str) -> int:
    """Symbol of a letter: 1 to 26, or OTHER."""
    base = unicodedata.normalize("NFD", c)[:1].lower()
    return ord(base) - 96 if "a" <= base <= "z" else OTHER


_FOLD: list[np.ndarray] = []


def _folding() -> np.ndarray:
    """Symbol by code point, BOUNDARY for all that are no letters."""
    if not _FOLD:
        t = np.zeros(sys.maxunicode + 1, dtype=np.int32)
        for c in range(sys.maxunicode + 1):
            if chr(c).isalpha():
                t[c] = fold(chr(c)) if c < 0x2000 else OTHER
        _FOLD.append(t)
    return _FOLD[0]


def trigram_counts(docs: DataFrame) -> DataFrame:
    """``(tri, n)`` over the words of all texts; words that touch digits or symbols count too, split there."""
    arrow_batches(docs.sparkSession)

    def run(batches):
        total, table = np.zeros(SYMBOLS ** 3, dtype=np.int64), _folding()
        for pdf in batches:
            for t in pdf["text"]:
                if isinstance(t, str) and t:
                    code = np.frombuffer(t.lower().encode("utf-32-le", "surrogatepass"), dtype="<u4")
                    s = np.zeros(len(code) + 3, dtype=np.int32)
                    s[2:-1] = table[code]
                    tri = (s[:-2] * SYMBOLS + s[1:-1]) * SYMBOLS + s[2:]
                    # one trigram for every letter, and one for every word's end
                    total += np.bincount(tri[(s[2:] != 0) | (s[1:-1] != 0)], minlength=SYMBOLS ** 3)
        at = np.flatnonzero(total)
        yield pd.DataFrame({"tri": at.astype("int32"), "n": total[at]})

    return docs.select("text").mapInPandas(run, "tri int, n bigint").groupBy("tri").agg(F.sum("n").alias("n"))


class Speller:
    """Character model and Viterbi decoding."""

    def __init__(self, rows):
        n3 = np.zeros(SYMBOLS ** 3)
        for r in rows:
            n3[r["tri"]] = r["n"]
        n3 = n3.reshape(SYMBOLS, SYMBOLS, SYMBOLS)
        # after a boundary, what came before it does not matter
        n3[:, BOUNDARY, :] = n3[:, BOUNDARY, :].sum(axis=0)
        n2, n1 = n3.sum(axis=0), n3.sum(axis=(0, 1))
        p1 = (n1 + 1) / (n1.sum() + SYMBOLS)
        p2 = (n2 + 20 * p1) / (n2.sum(axis=1, keepdims=True) + 20)
        p3 = (n3 + 20 * p2) / (n3.sum(axis=2, keepdims=True) + 20)
        self.log = np.log(p3).ravel().tolist()

    def lattice(self, token: str) -> list[list[tuple[str, float]]]:
        """Alternatives (restored characters, cost) for every run of equal characters; ' ' is a boundary."""
        units, i = [], 0
        while i < len(token):
            c, j = token[i], i
            while j < len(token) and token[j] == c:
                j += 1
            run, i = j - i, j
            if c.isspace():
                units.append([("", JOINED), (" ", SPLIT if run == 1 else -0.1)])
                continue
            stands = LOOKALIKES.get(c, "")
            letters = [(x, AS_LETTER) for x in stands] + ([(c, AS_ITSELF if stands else 0.0)] if c.isalpha() else [])
            alts = []
            for x, cost in letters:
                alts.append((x, cost + (RUN if run > 1 else 0.0)))
                if run == 2:
                    alts.append((x * 2, cost))
                elif run > 2:
                    alts.append((x * 2, cost + RUN))
            if not c.isalpha():
                alts.append(("", DROPPED if stands else JOINED))
                alts.append((" ", SPLIT))
            units.append(alts)
        return units

    def viterbi(self, token: str) -> str:
        """The likeliest restoration; words in it are separated by blanks."""
        log = self.log
        best: dict[tuple[int, int], tuple[float, tuple | None]] = {(BOUNDARY, BOUNDARY): (0.0, None)}
        for alts in self.lattice(token):
            step: dict[tuple[int, int], tuple[float, tuple | None]] = {}
            for (p, q), (score, back) in best.items():
                for out, cost in alts:
                    a, b, s = p, q, score + cost
                    for c in out:
                        y = BOUNDARY if c == " " else _symbol(c)
                        if y or b:  # no boundary after a boundary
                            s += log[(a * SYMBOLS + b) * SYMBOLS + y]
                        a, b = b, y
                    if b == BOUNDARY:
                        a = BOUNDARY
                    known = step.get((a, b))
                    if known is None or s > known[0]:
                        step[a, b] = (s, (out, back))
            best = step
        ends = [(s + (log[(p * SYMBOLS + q) * SYMBOLS] if q else 0.0), back) for (p, q), (s, back) in best.items()]
        back, out = max(ends, key=lambda e: e[0])[1], []
        while back is not None:
            out.append(back[0])
            back = back[1]
        return "".join(reversed(out))

    def restore(self, token: str) -> list[str]:
        """Words that a lower-cased token without white space stands for, over all its readings."""
        if token.isalpha() and not _RUN.search(token) and token.isascii():
            return [token]
        core = token.translate(INVISIBLE).strip(_MARKS)
        out: dict[str, None] = {}
        # look-alikes at the edges are punctuation in one reading and letters in the other
        for reading in dict.fromkeys((core.strip(_EDGE), core)):
            odd = any(c in LOOKALIKES for c in reading)
            if reading.isalpha() and not odd and not _LONG_RUN.search(reading):
                out[reading] = None
                if not _RUN.search(reading):
                    continue
            if odd or any(c.isalpha() for c in reading):
                out.update(dict.fromkeys(self.viterbi(reading).split()))
        return list(out)

    def spaced(self, text: str) -> Iterator[list[str]]:
        """Words of every row of single characters in a lower-cased text, whatever white space is between them.

        The narrowest gap of a row is that between letters; a wider one is likelier a boundary.
        """
        for m in _SPACED.finditer(text):
            gaps = _GAP.findall(m.group())
            narrow = min(map(len, gaps))
            yield self.viterbi(_GAP.sub(lambda g: " " if len(g.group()) == narrow else "  ", m.group())).split()


_SYMBOLS: dict[str, int] = {}


def _symbol(c: str) -> int:
    y = _SYMBOLS.get(c)
    if y is None:
        y = _SYMBOLS[c] = fold(c)
    return y


def features(word: str) -> list[str]:
    """The word itself and its beginnings."""
    return ["=" + word] + [word[:n] for n in BEGINNINGS if len(word) >= n]


class Scorer:
    """Scores of restored words under a model: feature -> weight."""

    def __init__(self, speller: Speller, weights: dict[str, float] | None = None):
        self.speller, self.weights = speller, weights or {}
        self._kept: dict[str, float] = {}
        self._older: dict[str, float] = {}
        self._read: dict[str, list[str]] = {}

    def words(self, text: str) -> set[str]:
        """Distinct restored words."""
        low = text.lower()
        out = set()
        for t in set(low.split()):
            words = self._read.get(t)
            if words is None:
                words = self.speller.restore(t)
                if len(t) <= 64:
                    if len(self._read) >= KEPT // 2:
                        self._read.clear()
                    self._read[t] = words
            out.update(words)
        for words in self.speller.spaced(low):
            out.update(words)
        return out

    def _of_words(self, words: list[str]) -> float:
        get = self.weights.get
        return max((w for x in words for f in features(x) if (w := get(f)) is not None), default=0.0)

    def _token(self, token: str) -> float:
        w = self._older.get(token)
        if w is None:
            w = self._of_words(self.speller.restore(token))
        if len(token) <= 64:
            if len(self._kept) >= KEPT // 2:
                self._older, self._kept = self._kept, {}
            self._kept[token] = w
        return w

    def signals(self, text: str | None) -> list[float]:
        """Of a whole text: the two largest word scores, and how many words, and which share, score at all."""
        if not text:
            return [0.0, 0.0, 0.0, 0.0]
        low = text.lower()
        tokens = low.split()
        hits = []
        for t in tokens:
            w = self._kept.get(t)
            if w is None:
                w = self._token(t)
            if w:
                hits.append(w)
        for words in self.speller.spaced(low):
            w = self._of_words(words)
            if w:
                hits.append(w)
        top = sorted(hits, reverse=True)[:2] + [0.0, 0.0]
        return [top[0], top[1], math.log1p(len(hits)), len(hits) / max(1, len(tokens)) ** 0.5]


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, rounds: int = 50) -> np.ndarray:
    """Weights (last: bias) by Newton steps."""
    x = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (y - p) - ridge * w
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w)), g)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    return w


def _sample(docs: DataFrame, labels: DataFrame, limit: int) -> DataFrame:
    """At most about ``limit`` labelled rows ``(text, toxic, half)``, chosen by a hash of the id before the join."""
    known = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(
        F.max(F.col("toxic").cast("int")).alias("toxic"))
    n = known.count()
    mark = F.pmod(F.xxhash64(F.col("doc_id").cast("string"), F.lit("toxicity")), F.lit(1_000_000))
    few = lambda df: df.where(mark < int(1_000_000 * min(1.0, limit / max(1, n))))
    own = few(docs.select("doc_id", "text"))
    return own.join(few(known), "doc_id").select(
        "text", "toxic", F.pmod(F.xxhash64(F.col("doc_id").cast("string"), F.lit("half")), F.lit(2)).cast("int").alias("half"))


def learn(docs: DataFrame, train: DataFrame, labels: DataFrame, limit: int = FIT_ROWS) -> tuple[Scorer, np.ndarray]:
    """The word model and the weights of the signals.

    The character model counts all of ``docs``. The logistic function is
    fitted on the sampled rows of ``train`` that have labels, each scored with
    word weights of the other half of them, as unseen documents are; the final
    word weights come from both halves.
    """
    spark = docs.sparkSession
    speller = Speller(trigram_counts(docs).toLocalIterator())  # 28**3 rows at most
    sample = cut(_sample(train, labels, limit))
    plain = spark.sparkContext.broadcast(Scorer(speller))
    nothing = Scorer(speller), np.array([0.0, 0.0, 0.0, 0.0, -30.0])

    def count(batches):
        seen, n = {}, Counter()
        for pdf in batches:
            for text, toxic, half in zip(pdf["text"], pdf["toxic"], pdf["half"]):
                key = (int(half), int(bool(toxic)))
                own = {f for w in plain.value.words(text if isinstance(text, str) else "") for f in features(w)}
                seen.setdefault(key, Counter()).update(own)
                n[key] += 1
        for key, c in seen.items():
            c[""] = n[key]
            yield pd.DataFrame({"f": list(c), "half": key[0], "bad": [v * key[1] for v in c.values()],
                                "good": [v * (1 - key[1]) for v in c.values()]})

    side = [F.sum(F.when(F.col("half") == h, F.col(c)).otherwise(0)).alias(f"{c}{h}") for c in ("bad", "good") for h in (0, 1)]
    seen = cut(sample.mapInPandas(count, "f string, half int, bad bigint, good bigint").groupBy("f").agg(*side)
               .where("bad0 + bad1 > 0"))
    total = seen.where("f = ''").first()
    if total is None or not (total["bad0"] and total["bad1"]) or not (total["good0"] and total["good1"]):
        return nothing

    def weights(halves):
        bad, good = (sum((F.col(f"{c}{h}") for h in halves), F.lit(0)) for c in ("bad", "good"))
        n_bad, n_good = (sum(total[f"{c}{h}"] for h in halves) for c in ("bad", "good"))
        w = F.log((bad + 0.1) / (n_bad + 1.0)) - F.log((good + 0.5) / (n_good + 1.0))
        top = (seen.where((F.col("f") != "") & (bad >= 3)).select("f", w.alias("w"), bad.alias("bad")).where("w > 1.5")
               .orderBy(F.desc(F.col("w") * F.sqrt("bad")), "f").limit(MODEL_SIZE))
        return Scorer(speller, {r["f"]: r["w"] for r in top.toLocalIterator()})

    other = spark.sparkContext.broadcast([weights([1]), weights([0])])

    def measure(batches):
        for pdf in batches:
            yield pd.DataFrame({"toxic": pdf["toxic"].astype("int32"), "x": [
                other.value[h].signals(t if isinstance(t, str) else None) for t, h in zip(pdf["text"], pdf["half"])]})

    rows = sample.mapInPandas(measure, "toxic int, x array<double>").collect()  # FIT_ROWS short rows
    x, y = np.array([r["x"] for r in rows]), np.array([float(r["toxic"] > 0) for r in rows])
    return weights([0, 1]), logistic(x, y)


def toxicity(docs: DataFrame, train: DataFrame, labels: DataFrame, limit: int = FIT_ROWS) -> DataFrame:
    """``docs`` with ``score`` (0 to 1, higher: likelier toxic) and ``predicted`` (1 if score >= 0.3, else 0).

    ``train (doc_id, text)`` gives the rows whose labels may be learned from
    ``labels (doc_id, toxic)``; of several labels of an id the largest counts,
    NULL labels and ids none. NULL and empty texts get the score of a text
    without any scored word. Without labels of both kinds every score is near
    0. Repeated rows give repeated rows, an empty table none; other columns are
    kept, former ``score`` and ``predicted`` columns replaced.
    """
    spark = docs.sparkSession
    arrow_batches(spark)
    model = spark.sparkContext.broadcast(learn(docs, train, labels, limit))
    rest = docs.drop("score", "predicted")

    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        scorer, w = model.value
        for texts in batches:
            x = np.array([scorer.signals(t if isinstance(t, str) else None) for t in texts], dtype=float).reshape(-1, 4)
            yield pd.Series(1 / (1 + np.exp(-np.clip(x @ w[:-1] + w[-1], -30, 30))))

    scored = rest.withColumn("score", F.pandas_udf(score, "double")(F.col("text")))
    return scored.withColumn("predicted", F.when(F.col("score") >= THRESHOLD, 1).otherwise(0))
