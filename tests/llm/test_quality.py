import random

import numpy as np
from pyspark.sql import functions as F

from concord.llm.quality import Gam, NAMES, features, quality


def test_features_of_any_text():
    for t in (None, "", " \n ", "é", "A!", "x" * 100_000, "a a a\nb.\n\n"):
        f = features(t)
        assert len(f) == len(NAMES) and np.isfinite(f).all()


def test_learns_shapes_and_an_interaction():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(4000, 4))
    y = ((np.abs(x[:, 0]) < 0.7) ^ ((x[:, 1] > 0) & (x[:, 2] > 0))).astype(float)
    gam = Gam().fit(x[:3000], y[:3000])
    hit = ((gam.score(x[3000:]) > 0.5) == (y[3000:] > 0)).mean()
    assert hit > 0.8
    assert any({f, g} == {1, 2} for f, g, _ in gam.pairs)
    # scoring adds bins
    row, b = x[:1], gam.bins(x[:1])[0]
    by_hand = gam.base + sum(t[b[f]] for f, t in enumerate(gam.tables)) + sum(
        t[gam.coarse[f][b[f]], gam.coarse[g][b[g]]] for f, g, t in gam.pairs)
    assert np.isclose(gam.logits(row)[0], by_hand)


def test_held_out_documents(spark):
    rng = random.Random(4)
    vocab = [f"wo{i}" for i in range(300)]
    rows, labels = [], []
    for i in range(500):
        words = [rng.choice(vocab) for _ in range(rng.randint(5, 80))]
        bad = i % 4 == 0
        if bad:
            words = rng.choice([[w.upper() + "!!" for w in words], [words[0]] * 40, [w + " |" for w in words]])
        rows.append((i, " ".join(words), "a"))
        labels.append((i, int(not bad), 0))
    rows += [(1000, None, None), (1001, "", ""), (1001, "", "")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, score string")
    lab = spark.createDataFrame(labels + [(None, 1, 0), (3, None, 0)], "doc_id bigint, quality int, x int")
    out = quality(docs, lab, F.col("doc_id") < 400)
    got = {r.doc_id: r for r in out.collect()}
    wrong = [i for i in range(400, 500) if got[i].predicted != int(i % 4 != 0)]
    assert len(wrong) <= 5
    assert 0 <= got[1000].score <= 1 and out.count() == 503
    none = quality(docs, lab.limit(0)).collect()
    assert {r.score for r in none} == {0.5}
    assert quality(docs.limit(0), lab).count() == 0


def plain_features(text):
    """The features one by one, in plain loops."""
    text = text or ""
    raw, words = text.encode(), text.split()
    lines = [x for x in text.split("\n") if x.strip()]
    n, m, size = max(1, len(words)), max(1, len(lines)), max(1, len(raw))
    ascii_shown = [chr(b) for b in raw if 32 < b < 127]
    runs, run = [0], 0
    for w in words:
        run = run + 1 if w.isupper() else 0
        runs.append(run)
    return {
        "log_chars": np.log(1 + len(text)), "log_words": np.log(1 + len(words)), "word_length": len(text) / n,
        "long_words": sum(len(w) > 18 for w in words) / n,
        "upper": sum("A" <= c <= "Z" for c in ascii_shown) / size, "digits": sum("0" <= c <= "9" for c in ascii_shown) / size,
        "symbols": sum(not c.isalnum() for c in ascii_shown) / size,
        "marks": sum(c in "!|*#%&$^~<>{}[]=\\" for c in ascii_shown) / size, "non_ascii": sum(b > 127 for b in raw) / size,
        "distinct": np.log(max(1, len(set(words)))) / np.log(n + 1), "top_word": max((words.count(w) for w in words), default=0) / n,
        "echo": sum(a == b for a, b in zip(words, words[1:])) / n, "one_letter": sum(len(w) == 1 for w in words) / n,
        "shouted": sum(w.isupper() for w in words) / n, "line_words": np.log(1 + len(words) / m),
        "line_repeats": 1 - len(set(lines)) / m, "ends": sum(x.rstrip()[-1] in ".!?…" for x in lines) / m, "all_caps_run": max(runs) / n}


def test_features_against_plain_loops():
    rng = random.Random(8)
    parts = ["word", "WORD", "A", "x9", "é", "日本", "!!", "a|b", "{=}", "end.", "why?", "\n", "\n\n", "\t", "y" * 19, "12", "…"]
    texts = [None, "", "\n", *[" ".join(rng.choice(parts) for _ in range(rng.randint(1, 60))) for _ in range(300)]]
    for t in texts:
        assert np.allclose(features(t), [plain_features(t)[k] for k in NAMES]), t


def test_equal_features_score_equally_and_rows_in_any_order_fit_the_same():
    """Ties: repeated rows, constant features and features with few values."""
    rng = np.random.default_rng(2)
    x = np.column_stack([rng.integers(0, 3, 600), np.ones(600), rng.integers(0, 2, 600)]).astype(float)
    y = ((x[:, 0] > 0) & (x[:, 2] > 0)).astype(float)
    gam = Gam().fit(x, y)
    seen = {}
    for row, s in zip(map(tuple, x), gam.score(x)):
        assert seen.setdefault(row, s) == s
    assert all((s > 0.5) == (r[0] > 0 and r[2] > 0) for r, s in seen.items())
    order = rng.permutation(600)
    assert np.allclose(Gam().fit(x[order], y[order]).score(x), gam.score(x))


def test_clashing_columns(spark):
    docs = spark.createDataFrame([(i, f"text {i} a", 1, 2, 3) for i in range(30)], "doc_id bigint, text string, x int, predicted int, y int")
    labels = spark.createDataFrame([(i, i % 2, 5, 6) for i in range(30)], "doc_id bigint, quality int, text int, y int")
    out = quality(docs, labels)
    assert out.columns == ["doc_id", "score", "predicted"] and out.count() == 30
