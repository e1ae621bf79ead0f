import random
import re

import numpy as np

from concord.llm import decontaminate as module
from concord.llm.decontaminate import PIECE, SPAN, Words, _stretches, contamination, decontaminate, winnow


def words(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def plain(docs, items, span=13):
    out = {}
    for d, t in docs:
        w, hit, found = words(t), set(), set()
        for i, x in items:
            b = words(x)
            k = min(span, len(b))
            grams = {tuple(b[j:j + k]) for j in range(len(b) - k + 1)} if k else set()
            for j in range(len(w) - k + 1) if k else ():
                if tuple(w[j:j + k]) in grams:
                    hit |= set(range(j, j + k))
                    found.add(str(i))
        out[d] = (len(w), len(hit), sorted(found), len(hit) > 0 and 20 * len(hit) >= len(w))
    return out


def run(spark, docs, items):
    d = spark.createDataFrame(docs, "doc_id bigint, text string")
    b = spark.createDataFrame(items, "item_id bigint, text string")
    return {r.doc_id: (r.n_words, r.n_hit, r["items"], r.contaminated) for r in contamination(d, b).collect()}


def test_against_all_windows(spark):
    rng = random.Random(1)
    vocab = [f"w{i}" for i in range(60)] + ["Ünit", "naïve", "日本", "x9"]

    def text(n):
        return " ".join(rng.choice(vocab) for _ in range(n))

    items = [(i, text(n)) for i, n in enumerate([40, 13, 14, 25, 12, 5, 3])] + [(7, None), (8, ""), (9, "?!"), (10, "w1 w2")]
    items.append((11, items[0][1]))
    docs = []
    for d in range(60):
        parts = [text(rng.randint(0, 30))]
        for _ in range(rng.randint(0, 3)):
            b = rng.choice(items)[1] or ""
            w = b.split(" ")
            i = rng.randint(0, max(0, len(w) - 5))
            parts += [" ".join(w[i:i + rng.randint(5, 40)]).upper().replace("Ü", "ü"), text(rng.randint(0, 20))]
        docs.append((d, ", ".join(parts)))
    docs += [(100, None), (101, ""), (102, " - "), (103, items[0][1]), (104, "W3  " * 30)]
    items.append((12, "w3 " * 14))
    assert run(spark, docs, items) == plain(docs, items)


def test_hashes_do_not_depend_on_place():
    a, b = Words([b"one Two three"]), Words([b"", b"x y", b"zz one two  three q"])
    assert list(a.hash) == list(b.hash[3:6])
    assert list(a.grams(3)) == list(b.grams(3)[3:4])


def test_winnowing_keeps_a_gram_of_every_shared_span():
    rng = np.random.default_rng(4)
    for _ in range(50):
        shared = [f"s{x}" for x in rng.integers(0, 5, 13)]
        pad = lambda: [f"p{x}" for x in rng.integers(0, 99, rng.integers(0, 9))]
        prints = [set(winnow(Words([" ".join(pad() + shared + pad()).encode()]))[1].tolist()) for _ in range(2)]
        assert prints[0] & prints[1]


def test_odd_tables(spark):
    schema = "doc_id bigint, text string, hash string, item string, k int"
    t = " ".join(f"a{i}" for i in range(20))
    rows = [(None, t, "", "", 1), (1, t, None, "", 1), (1, t, None, "", 1), (1, "other", None, "", 1)]
    docs = spark.createDataFrame(rows, schema)
    items = spark.createDataFrame([(None, t, "q"), (5, t, "q"), (5, t, "r")], "item_id bigint, text string, ctx string")
    got = sorted((r.doc_id or 0, r.n_hit, r["items"]) for r in contamination(docs, items).collect())
    assert got == [(0, 20, ["", "5"]), (1, 0, []), (1, 20, ["", "5"]), (1, 20, ["", "5"])]
    assert [r.text for r in decontaminate(docs, items).collect()] == ["other"]
    assert decontaminate(docs, items.limit(0)).count() == 4
    assert contamination(docs.limit(0), items).count() == 0


def test_long_texts(spark):
    """Texts of several stretches, passages at and across every cut, a word longer than a piece, a long item."""
    rng = random.Random(3)
    item = " ".join(f"q{i}" for i in range(30))
    long = []
    while len(long) < 40_000:
        long += [f"w{rng.randint(0, 9999)}" * 14 for _ in range(200)]
        at = rng.randint(0, 17)
        long += item.split()[at:at + rng.randint(5, 30)]
    text = " ".join(long)
    assert len(text) > 2 * PIECE
    cuts = [first for first, _ in _stretches(text.encode())][1:]
    for c in cuts:  # a passage over each cut
        long[c - 8:c + 22] = item.split()
    edges = " ".join(long)
    giant = "x" * (PIECE + 5) + " " + item + " " + "y" * (PIECE + 7) + " " + item
    docs = [(1, text), (2, edges), (3, giant), (4, item), (5, "x" * (PIECE + 5))]
    items = [(1, item), (2, "q3 q4"), (3, " ".join(long[1000:21_000]))]
    assert run(spark, docs, items[:2]) == plain(docs, items[:2])
    got = run(spark, docs, items)
    assert got[2] == (len(long), got[2][1], ["1", "2", "3"], True) and got[2][1] >= 20_000


def test_stretches_hold_every_window():
    text = " ".join(f"w{i}" for i in range(300_000)).encode()
    whole, seen, end = Words([text]), 0, 0
    for first, w in _stretches(text):
        assert first == max(0, end - (SPAN - 1)) and list(w.hash[:5]) == list(whole.hash[first:first + 5])
        end, seen = first + len(w.hash), seen + 1
    assert end == len(whole.hash) and seen > 1


def test_memory_does_not_grow_with_a_long_text():
    import tracemalloc

    peaks = []
    for n in (4, 16):
        text = b"some words, of a long text. " * (n * 40_000)
        tracemalloc.start()
        for _, w in module._stretches(text):
            winnow(w)
        peaks.append(tracemalloc.get_traced_memory()[1])
        tracemalloc.stop()
    assert peaks[1] < 1.1 * peaks[0] < 150e6
