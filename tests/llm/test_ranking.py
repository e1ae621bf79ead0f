import math
import random
import re
from collections import Counter

import pytest

from concord.llm import ranking as R

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def plain(docs, items, top=50):
    """(item, rank, doc, score), by the formula."""
    bags = [(d, Counter(terms(t))) for d, t in docs]
    bags = [(d, c) for d, c in bags if c]
    n_docs, n_terms = len(bags), sum(sum(c.values()) for _, c in bags)
    df = Counter(t for _, c in bags for t in c)
    out = []
    for item, text in sorted(set(items), key=str):
        found = []
        for d, c in bags:
            m = 100 - 50 + (50 * sum(c.values()) * n_docs) // n_terms
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((1000000000 * c[t]) // (1000 * c[t] + 20 * m))
                    for t in set(terms(text)) if t in c)
            if s > 0:
                found.append((-s, d is not None, d))
        out += [(item, i + 1, d, -s) for i, (s, _, d) in enumerate(sorted(found)[:top])]
    return sorted(out, key=str)


def rows(df):
    return sorted(((r.item_id, r.rank, r.doc_id, r.score) for r in df.select("item_id", "rank", "doc_id", "score").collect()), key=str)


@pytest.fixture(scope="module")
def tables(spark):
    rng = random.Random(4)
    words = [f"w{i}" for i in range(60)] + ["Straße", "élan", "A1", "x_y", "don't"]
    text = lambda n: rng.choice((" ", ", ", "\n")).join(rng.choice(words) for _ in range(n))
    docs = [(i, text(rng.randint(0, 40))) for i in range(150)]
    docs += [(500 + i, docs[3][1]) for i in range(70)]  # more equal scores than are kept
    docs += [(7, docs[7][1]), (7, "w1 w1 other"), (None, "w1 w2"), (None, None), (900, ""), (901, "... !"), (902, text(30_000))]
    items = [(i, text(rng.randint(1, 12))) for i in range(12)] + [(3, "w3 w4"), (20, None), (21, ""), (22, "no such term"), (23, docs[3][1])]
    items += [items[0]]
    return docs, items


def frames(spark, docs, items):
    return (spark.createDataFrame([(d, t, "x", 1) for d, t in docs], "doc_id bigint, text string, score string, rank int"),
            spark.createDataFrame([(i, t, 2) for i, t in items], "item_id int, text string, doc_id int"))


def test_matches_plain_form(spark, tables):
    docs, items = tables
    d, i = frames(spark, docs, items)
    assert rows(R.ranked(d.repartition(5), i)) == plain(docs, items)
    assert rows(R.ranked(d, i, top=3)) == plain(docs, items, 3)


def test_slices_give_the_same(spark, tables):
    docs, items = tables
    d, i = frames(spark, docs, items)
    assert rows(R.ranked(d, i, slice_bytes=400)) == plain(docs, items)


def test_terms_and_counts():
    for text in ("", "a", " a  b", "A1_x-é!ß\x00z\x7f0", "ſK İ", "don't"):
        assert [t.decode() for t in R.plain(text).split()] == terms(text)
        assert R.count_terms(R.plain(text)) == len(terms(text))


def test_automaton_guards_the_boundaries():
    part = R.Slice([[b"ab", b"b"], [b"b", "é".encode()]])
    ids, tf = R.term_counts(R.automaton(part), R.plain("ab b abb b b-ab é éb"))
    assert {t: n for t, n in zip(ids.tolist(), tf.tolist())} == {part.number[b"ab"]: 2, part.number[b"b"]: 3, part.number["é".encode()]: 1}
    assert [part.items[part.first[j]:part.first[j + 1]].tolist() for j in (part.number[b"ab"], part.number[b"b"])] == [[0], [0, 1]]


def test_best_keeps_the_smallest():
    rng = random.Random(1)
    added = [(-rng.randint(1, 9), True, rng.randint(0, 400)) for _ in range(1000)]
    best = R.Best(20)
    for x in added:
        best.add(x)
    assert best.done() == sorted(added)[:20]


def test_empty(spark, tables):
    d, i = frames(spark, *tables)
    for docs, items in ((d.limit(0), i), (d, i.limit(0)), (d.where("doc_id = 900"), i), (d, i.where("item_id = 21"))):
        got = R.ranked(docs, items)
        assert got.collect() == [] and got.columns == ["item_id", "rank", "doc_id", "score"]
