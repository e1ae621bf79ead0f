import itertools
import math
import random

import pytest

from concord.llm.toxicity import BOUNDARY, Speller, SYMBOLS, fold, toxicity, trigram_counts

CLEAN = ("the garden was quiet and green while rain fell over stone walls near old mills and people walked along rivers "
         "talking about bread winter trains letters music paper and long roads between small towns").split()
RUDE = ["idiot", "moron", "trash", "stupid"]


@pytest.fixture(scope="module")
def speller(spark):
    rows = [(" ".join(CLEAN + RUDE * 2),)] * 30
    return Speller(trigram_counts(spark.createDataFrame(rows, "text string")).collect())


def test_trigram_counts(spark):
    got = {r.tri: r.n for r in trigram_counts(spark.createDataFrame([("ab b",), (None,), ("",)], "text string")).collect()}
    code = lambda *x: (x[0] * SYMBOLS + x[1]) * SYMBOLS + x[2]
    assert got == {code(0, 0, 1): 1, code(0, 1, 2): 1, code(1, 2, 0): 1, code(2, 0, 2): 1, code(0, 2, 0): 1}


def test_viterbi_is_the_best_path(speller):
    def cost(out):
        a = b = BOUNDARY
        s = 0.0
        for c in "".join(x for x, _ in out):
            y = BOUNDARY if c == " " else fold(c)
            if y or b:
                s += speller.log[(a * SYMBOLS + b) * SYMBOLS + y]
            a, b = b, y
            if b == BOUNDARY:
                a = BOUNDARY
        return s + sum(c for _, c in out) + (speller.log[(a * SYMBOLS + b) * SYMBOLS] if b else 0.0)

    for token in ("1d10t", "m.0.r.o.n", "ttrraash", "st!!p1d", "a-b"):
        paths = list(itertools.product(*speller.lattice(token)))
        best = max(paths, key=cost)
        got = speller.viterbi(token)
        assert math.isclose(max(cost(p) for p in paths if "".join(x for x, _ in p) == got), cost(best))


def test_restores_hidden_words(speller):
    for hidden, word in [("1d10t", "idiot"), ("m0r0n!!", "moron"), ("i.d.i.o.t", "idiot"), ("stuuuupid", "stupid"),
                         ("tr@sh", "trash"), ("s_t_u_p_i_d", "stupid"), ("idi​ot", "idiot"), ("garden,", "garden")]:
        assert speller.restore(hidden) == [word], hidden
    assert speller.viterbi("i d i o t") == "idiot"
    assert speller.restore("2024") == [] and speller.restore("***") == []


def test_restores_what_the_lattice_names(speller):
    for hidden, word in [("ttrraash", "trash"), ("iidiot", "idiot"), ("!diot", "idiot"), ("+rash", "trash"), ("¡d!ot!", "idiot"),
                         ("|d|0+", "idiot"), ("$+up!d", "stupid")]:
        assert word in speller.restore(hidden), (hidden, speller.restore(hidden))
    # spelling and punctuation as they are remain a reading
    for token, word in [("letters", "letters"), ("(garden", "garden"), ("walls!", "walls"), ("garden!", "garden")]:
        assert word in speller.restore(token), token
    rude = ["ass", "soot"] * 30
    other = Speller([{"tri": t, "n": n} for t, n in trigrams(CLEAN + rude).items()])
    assert "soot" in other.restore("$007") and "soot" in other.restore("$00+")
    for gap in ("  ", "\t", " \t", "\n", "\u00a0", "\r\n"):
        assert ["idiot"] in list(speller.spaced("the " + gap.join("idiot") + " walls")), gap
    assert list(speller.spaced("i d i o t   m o r o n")) == [["idiot", "moron"]]


def trigrams(words):
    out = {}
    for w in words:
        s = [BOUNDARY, BOUNDARY, *map(fold, w), BOUNDARY]
        for x in zip(s, s[1:], s[2:]):
            at = (x[0] * SYMBOLS + x[1]) * SYMBOLS + x[2]
            out[at] = out.get(at, 0) + 1
    return out


def test_toxicity_of_doubled_edge_and_spaced_forms(spark):
    rng = random.Random(5)
    docs, labels = [], []
    for i in range(300):
        words = [rng.choice(CLEAN) for _ in range(30)]
        if i % 3 == 0:
            words[7], words[21] = rng.choice(RUDE), rng.choice(RUDE)
        docs.append((i, " ".join(words)))
        labels.append((i, int(i % 3 == 0)))
    hidden = ["ttrraash", "iidiot", "!diot", "+rash", "i  d  i  o  t", "t\nr\na\ns\nh"]
    base = " ".join(CLEAN[:20])
    docs += [(1000 + i, f"{base} {h} {base}") for i, h in enumerate(hidden)] + [(2000, f"{base} (walls! {base}")]
    d = spark.createDataFrame(docs, "doc_id bigint, text string")
    lab = spark.createDataFrame(labels, "doc_id bigint, toxic int")
    out = {r.doc_id: r.score for r in toxicity(d, d, lab).collect() if r.doc_id >= 1000}
    clean = out.pop(2000)
    assert all(s > clean for s in out.values()), (clean, out)


def hide(word, rng):
    return rng.choice([word.replace("i", "1").replace("o", "0").replace("a", "@"), ".".join(word), " ".join(word),
                       word[:2] + word[1] * 3 + word[2:], word.upper() + "!!"])


def test_finds_plain_and_hidden_toxic_documents(spark):
    rng = random.Random(2)
    docs, labels = [], []
    for i in range(600):
        words = [rng.choice(CLEAN) for _ in range(40)]
        toxic = i % 5 == 0
        if toxic:
            for _ in range(2):
                w = rng.choice(RUDE)
                words.insert(rng.randint(0, 40), hide(w, rng) if i % 10 == 0 and i >= 300 else w)
        docs.append((i, " ".join(words), "x"))
        if i < 450:
            labels.append((i, int(toxic), 9))
    docs += [(1000, None, ""), (1001, "", ""), (1001, "", "")]
    d = spark.createDataFrame(docs, "doc_id bigint, text string, score string")
    lab = spark.createDataFrame(labels + [(None, 1, 0), (5, None, 0)], "doc_id bigint, toxic int, text int")
    out = {(r.doc_id): r for r in toxicity(d, d, lab).collect()}
    wrong = [i for i in range(450, 600) if out[i].predicted != int(i % 5 == 0)]
    assert len(wrong) <= 3
    assert out[1000].predicted == 0 and 0 <= out[1001].score <= 1
    assert toxicity(d, d, lab).count() == 603


def test_without_labels(spark):
    d = spark.createDataFrame([(1, "idiot")], "doc_id bigint, text string")
    lab = spark.createDataFrame([], "doc_id bigint, toxic int")
    assert [(r.predicted, r.text) for r in toxicity(d, d, lab).collect()] == [(0, "idiot")]
    assert toxicity(d.limit(0), d, lab).count() == 0
