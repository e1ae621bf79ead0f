"""Language identification by rank-order profiles.

A profile is the list of a language's most frequent letter n-grams, most
frequent first. A document's own list is compared with each profile: an n-gram
counts the difference of its two ranks (its out-of-place measure), one that the
profile lacks counts the whole length of the profile. The language with the
smallest sum wins.

N-grams have 1 to 3 letters of lower-cased text; every run of other characters
is one word boundary, which may begin or end an n-gram, not lie inside it.
"""

from __future__ import annotations

import sys

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import arrow_batches

#: Length of a profile, and of a document's own list.
PROFILE, OWN = 400, 300
#: Characters counted at a time; longer texts are counted in pieces.
PIECE = 1 << 20
#: n-grams held per language before a task hands on its counts.
HELD = 1 << 20
UNKNOWN = "und"

_BITS = 21
_LETTER: list[np.ndarray] = []


def _letters() -> np.ndarray:
    """Which code points are letters."""
    if not _LETTER:
        _LETTER.append(np.fromiter((chr(c).isalpha() for c in range(sys.maxunicode + 1)), dtype=bool, count=sys.maxunicode + 1))
    return _LETTER[0]


def grams(text: str) -> np.ndarray:
    """All n-grams of a text, each as one integer of its code points (a boundary is 1, no gram begins with 0)."""
    code = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype="<u4")
    c = np.ones(len(code) + 2, dtype=np.int64)
    c[1:-1] = np.where(_letters()[code], code, 1)
    c = c[np.concatenate(([True], (c[1:] != 1) | (c[:-1] != 1)))]
    two = (c[:-1] << _BITS) | c[1:]
    three = ((two[:-1] << _BITS) | c[2:])[c[1:-1] != 1]
    return np.concatenate((c[c != 1], two, three))


def counts(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-grams in ascending order and their counts; a cut between pieces is a word boundary."""
    if len(text) <= PIECE:
        return np.unique(grams(text), return_counts=True)
    parts = [np.unique(grams(text[i:i + PIECE]), return_counts=True) for i in range(0, len(text), PIECE)]
    return merged(parts)


def merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    keys, place = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
    total = np.zeros(len(keys), dtype=np.int64)
    np.add.at(total, place, np.concatenate([p[1] for p in parts]))
    return keys, total


def learn_profiles(docs: DataFrame, size: int = PROFILE) -> DataFrame:
    """``(lang, gram, place)``: the profile of every language in ``docs (text, lang)``, place from 0.

    Counts cover all rows with a language; ties go to the smaller n-gram.
    """
    arrow_batches(docs.sparkSession)

    def run(batches):
        held: dict[str, list] = {}

        def hand_on(lang):
            keys, n = merged(held.pop(lang))
            return pd.DataFrame({"lang": lang, "gram": keys, "n": n})

        for pdf in batches:
            for lang, group in pdf.groupby("lang"):
                text = "\n".join(t for t in group["text"] if isinstance(t, str))
                parts = held.setdefault(lang, [])
                parts.append(counts(text))
                if sum(len(p[0]) for p in parts) > HELD:
                    held[lang] = [merged(parts)]
                    if len(held[lang][0][0]) > HELD // 2:
                        yield hand_on(lang)
        for lang in list(held):
            yield hand_on(lang)

    counted = (docs.where(F.col("lang").isNotNull()).select(F.col("lang").cast("string").alias("lang"), "text")
               .mapInPandas(run, "lang string, gram bigint, n bigint")
               .groupBy("lang", "gram").agg(F.sum("n").alias("n")))
    order = Window.partitionBy("lang").orderBy(F.desc("n"), "gram")
    return (counted.withColumn("place", F.row_number().over(order) - 1).where(F.col("place") < size)
            .select("lang", "gram", "place"))


class Profiles:
    """Profiles as one table: rank by n-gram and language, ``size`` where a profile lacks it."""

    def __init__(self, rows, size: int = PROFILE):
        rows = list(rows)
        self.size = size
        self.langs = sorted({r["lang"] for r in rows})
        self.grams = np.unique(np.array([r["gram"] for r in rows], dtype=np.int64))
        self.rank = np.full((len(self.grams), len(self.langs)), size, dtype=np.int64)
        col = {x: i for i, x in enumerate(self.langs)}
        for r in rows:
            self.rank[np.searchsorted(self.grams, r["gram"]), col[r["lang"]]] = r["place"]

    def predict(self, text: str | None) -> tuple[str, float]:
        """Language and score: 1 less the out-of-place sum as a share of the largest possible."""
        if not text or not self.langs:
            return UNKNOWN, 0.0
        keys, n = counts(text)
        if not len(keys):
            return UNKNOWN, 0.0
        own = keys[np.argsort(-n, kind="stable")[:OWN]]
        at = np.searchsorted(self.grams, own)
        known = self.grams[np.minimum(at, len(self.grams) - 1)] == own
        place = np.arange(len(own))[known][:, None]
        rank = self.rank[at[known]]
        away = np.where(rank < self.size, np.abs(rank - place), self.size).sum(axis=0) + self.size * int((~known).sum())
        best = int(np.argmin(away))
        return self.langs[best], float(1 - away[best] / (self.size * len(own)))


def identify(docs: DataFrame, train: DataFrame, size: int = PROFILE) -> DataFrame:
    """``(doc_id, lang_pred, score)`` per row of ``docs (doc_id, text)``.

    Profiles are learned from ``train (text, lang)``, from all its rows with a
    language; rows whose text is NULL add nothing. ``lang_pred`` is ``und``
    with score 0 where the text is NULL or has no letter, or nothing was
    learned. Equal distances go to the language that sorts first. Repeated rows
    give repeated rows, an empty table none; other columns are ignored. What
    goes to the executors has ``size`` rows for each language.
    """
    spark = docs.sparkSession
    arrow_batches(spark)
    shared = spark.sparkContext.broadcast(Profiles(learn_profiles(train, size).toLocalIterator(), size))
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for pdf in batches:
            found = [shared.value.predict(t if isinstance(t, str) else None) for t in pdf.pop("text")]
            pdf["lang_pred"] = [x[0] for x in found]
            pdf["score"] = [x[1] for x in found]
            yield pdf

    return docs.select("doc_id", "text").mapInPandas(run, f"doc_id {kind}, lang_pred string, score double")
