from collections import Counter

from concord.llm import langid
from concord.llm.langid import Profiles, identify, learn_profiles

TEXTS = {"en": "the quick brown fox jumps over the lazy dog and then the fox thinks this is the way",
         "de": "der schnelle braune fuchs springt über den faulen hund und dann denkt der fuchs nach",
         "ru": "быстрая коричневая лиса прыгает через ленивую собаку и потом думает"}


def plain_grams(text):
    out, word = Counter(), ""
    for c in text.lower() + " ":
        if c.isalpha():
            word += c
            continue
        if word:
            p = " " + word + " "
            out.update(word)
            out.update(p[i:i + 2] for i in range(len(p) - 1))
            out.update(p[i:i + 3] for i in range(len(p) - 2))
        word = ""
    return out


def text_of(gram):
    return tuple(x for x in ((gram >> 42) & 0x1FFFFF, (gram >> 21) & 0x1FFFFF, gram & 0x1FFFFF))


def test_counts_match_plain_form(monkeypatch):
    text = "Über  die-Brücke, x 12 y\nа б" * 3
    keys, n = langid.counts(text)
    assert sorted(n.tolist()) == sorted(plain_grams(text).values())
    want = Counter({tuple([0] * (3 - len(g)) + [1 if c == " " else ord(c) for c in g]): v for g, v in plain_grams(text).items()})
    got = Counter({text_of(int(k)): int(v) for k, v in zip(keys, n)})
    assert got == want


def test_pieces_add_up(monkeypatch):
    text = "aa bb cc " * 50
    whole = langid.counts(text)
    monkeypatch.setattr(langid, "PIECE", 9)
    parts = langid.counts(text)
    assert [x.tolist() for x in whole] == [x.tolist() for x in parts]


def test_distance_is_out_of_place(spark):
    train = spark.createDataFrame([(t, k) for k, t in TEXTS.items()] + [(None, "en"), ("zzz", None)], "text string, lang string")
    rows = learn_profiles(train, 50).collect()
    prof = Profiles(rows, 50)
    ranks = {k: {r["gram"]: r["place"] for r in rows if r["lang"] == k} for k in TEXTS}
    text = "the brown dog über nach"
    keys, n = langid.counts(text)
    own = [int(k) for k, _ in sorted(zip(keys, n), key=lambda x: (-x[1], x[0]))][:langid.OWN]
    away = {k: sum(abs(r[g] - i) if g in r else 50 for i, g in enumerate(own)) for k, r in ranks.items()}
    best = min(sorted(away), key=away.get)
    assert prof.predict(text) == (best, 1 - away[best] / (50 * len(own)))


def test_rows(spark):
    train = spark.createDataFrame([(t, k) for k, t in TEXTS.items()], "text string, lang string")
    rows = [(1, TEXTS["en"][:40], "x"), (2, TEXTS["de"][:40], "x"), (2, TEXTS["de"][:40], "x"), (None, "лиса прыгает", None),
            (4, None, ""), (5, "12 34 !", ""), (6, "", "")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, score string")
    got = sorted((r.doc_id or 0, r.lang_pred) for r in identify(docs, train).collect())
    assert got == [(0, "ru"), (1, "en"), (2, "de"), (2, "de"), (4, "und"), (5, "und"), (6, "und")]
    assert {r.lang_pred for r in identify(docs, train.limit(0)).collect()} == {"und"}
    assert identify(docs.limit(0), train).count() == 0
