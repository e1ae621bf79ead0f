import random
from collections import Counter
from fractions import Fraction

import numpy as np
import pytest

from concord.llm import collocations as C


def pieces(text):
    out, words, word = [], [], ""
    for c in (text or "") + "\n":
        c = c.lower() if "A" <= c <= "Z" else c
        if c in " \t" or c in ".,;:!?\n\x0b\x0c\r":
            if word:
                words.append(word)
            word = ""
            if c not in " \t":
                if words:
                    out.append(words)
                words = []
        else:
            word += c
    return out


def plain(docs, least, inside=50, top=2000):
    f, n = {}, Counter()
    for lang, text in docs:
        own = f.setdefault(lang or "und", Counter())
        for p in pieces(text):
            n[lang or "und"] += len(p)
            for k in (1, 2, 3):
                own.update(tuple(p[i:i + k]) for i in range(len(p) - k + 1))
    out = []
    for lang, own in f.items():
        found = {p: a for p, a in own.items() if len(p) > 1 and a >= least}
        kept = []
        for p, a in found.items():
            if any(q[i:i + len(p)] == p and 100 * b >= inside * a for q, b in found.items() if len(q) > len(p) for i in range(len(q))):
                continue
            cuts = [(int(Fraction(10 ** 6 * a * a, own[p[:k]] * own[p[k:]])), k, own[p[:k]], own[p[k:]]) for k in range(1, len(p))]
            s, _, l, r = min(cuts)
            kept.append((-s, -a, " ".join(p).encode(), a, l, r, s))
        out += [(lang, i + 1, x[2].decode(), *x[3:6], n[lang], x[6]) for i, x in enumerate(sorted(kept)[:top])]
    return sorted(out)


def rows(df):
    return sorted(tuple(r) for r in df.select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect())


@pytest.fixture(scope="module")
def docs():
    rng = random.Random(9)
    words = [f"w{i}" for i in range(25)] + ["Éa", "x\x00y", "nb sp", "ÿ"]
    out = []
    for i in range(300):
        text = "".join(rng.choice(words[:rng.choice((6, 12, 29))]) + rng.choice((" ", " ", " ", "\t", "  ", ", ", ". ", "\n", "\r\n", "\x0b", "!"))
                       for _ in range(rng.randint(0, 60)))
        out.append((rng.choice(("en", "en", "de", None, "und")), text))
    out += [("en", "the hot phrase here")] * 150 + [("en", None), ("fr", ""), ("es", "... !"), ("de", "w1 W2 w3 " * 3000)]
    return out


def frame(spark, docs):
    return spark.createDataFrame([(i, *d, "x", 0) for i, d in enumerate(docs)], "doc_id int, lang string, text string, word string, chunk int")


def test_matches_plain_form(spark, docs):
    df = frame(spark, docs).repartition(4)
    assert rows(C.collocations(df, least=4)) == plain(docs, 4)
    assert rows(C.collocations(df, least=10, inside=90, top=7)) == plain(docs, 10, 90, 7)


def test_small_chunks_and_tiles(spark, docs, monkeypatch):
    """Long texts cut anywhere, and every way of counting, give the same."""
    df = frame(spark, docs).repartition(3)
    cut = C.phrases(df, 4, chunk_bytes=200)
    assert sorted(map(tuple, cut.collect())) == sorted(map(tuple, C.phrases(df, 4).collect()))


def test_counter_is_exact(monkeypatch):
    rng = np.random.default_rng(1)
    for tile, hits, tiles, buffer, held in ((2, 1, 3, 50, 60), (9, 1 << 12, 48, 1 << 21, 1 << 21), (3, 20, 0, 10, 1 << 30)):
        for name, value in zip(("TILE", "DENSE_HITS", "DENSE_TILES", "BUFFER", "HELD"), (tile, hits, tiles, buffer, held)):
            monkeypatch.setattr(C, name, value)
        counter, want, got = C.Tiles(1000), Counter(), Counter()
        for _ in range(30):
            a, b = (rng.zipf(1.3, 200) % 1000 for _ in range(2))
            want.update((a * 1000 + b).tolist())
            counter.add(a, b)
            if counter.full():
                for codes, counts in counter.take():
                    got.update(dict(zip(codes.tolist(), counts.tolist())))
        for codes, counts in counter.take():
            for c, n in zip(codes.tolist(), counts.tolist()):
                got[c] += n
        assert got == want and list(counter.take()) == []


def test_numbered(spark):
    from pyspark.sql import functions as F

    df = spark.range(500).select((F.col("id") * 7 % 500).alias("x"))
    got = {r.x: r.id for r in C.numbered(df, "id", F.col("x").desc()).collect()}
    assert got == {x: 499 - x for x in range(500)}
    assert C.numbered(df.limit(0), "id", F.col("x")).count() == 0


def test_exact_beyond_64_bits(spark):
    big = 10 ** 13
    df = spark.createDataFrame([(big - 1, big, big + 3)], "a bigint, l bigint, r bigint").select(C._cut_at("l", "r").alias("c"))
    assert df.first().c.score == 10 ** 6 * (big - 1) ** 2 // (big * (big + 3))


def test_empty(spark, docs):
    df = frame(spark, docs)
    assert rows(C.collocations(df.limit(0))) == []
    assert rows(C.collocations(df.where("text is null"))) == []
    assert rows(C.collocations(df, least=10 ** 6)) == []
