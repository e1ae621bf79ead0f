import re
from itertools import combinations

import numpy as np
import xxhash

from concord.llm.simhash import _spanning, components, fingerprint, keep_one, links, simhash_groups


def plain_print(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not w:
        return 0
    sh = [" ".join(w[i:i + 3]) for i in range(max(1, len(w) - 2))]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_groups(prints, bits=2):
    root = {i: i for i in prints}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in combinations(prints, 2):
        if (prints[i] ^ prints[j]).bit_count() <= bits:
            a, b = find(i), find(j)
            root[max(a, b)] = min(a, b)
    return {i: find(i) for i in prints}


def test_fingerprint_matches_plain_form(spark):
    texts = [None, "", " \n", "One", "one two", "Ä ö Ü b c d e", "a b\tc\x0bd e f a b c a b c"]
    assert [fingerprint(t) for t in texts] == [plain_print(t) for t in texts]


def test_fingerprint_over_chunks():
    text = " ".join(str(i * i % 977) for i in range(70_000))
    assert fingerprint(text) == plain_print(text)


def test_groups_against_all_pairs(spark):
    rng = np.random.default_rng(5)
    base = " ".join(f"w{x}" for x in rng.integers(0, 999, 400))
    rows = [(i, base + f" tail{i % 7}") for i in range(40)] + [(100 + i, f"x{i} y{i} z{i}") for i in range(30)]
    rows += [(300, None), (301, ""), (302, " ")]
    want = plain_groups({d: plain_print(t) for d, t in rows})
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = {r.doc_id: r.component_id for r in simhash_groups(df).collect()}
    assert got == want
    assert got[301] == got[302] == 300
    assert {r.doc_id for r in keep_one(df).collect()} == set(want.values())


def test_links_join_a_dense_ball_of_fingerprints(spark):
    rng = np.random.default_rng(1)
    vals = {0x7FEEDDCCBBAA9988}
    while len(vals) < 300:
        vals.add(list(vals)[rng.integers(len(vals))] ^ (1 << int(rng.integers(64))) ^ (1 << int(rng.integers(64))))
    vals |= {int(x) for x in rng.integers(0, 2**62, 300)}
    vals = [v - (1 << 64) * (v >> 63) for v in vals]
    df = spark.createDataFrame([(v,) for v in vals], "fp bigint")
    got = {r.node: r.root for r in components(links(df)).collect()}
    u = {v: v & (2**64 - 1) for v in vals}
    parts = {}
    for v, r in plain_groups(u).items():
        parts.setdefault(r, set()).add(v)
    mine = {}
    for v in vals:
        mine.setdefault(got.get(v, v), set()).add(v)
    assert sorted(map(sorted, mine.values())) == sorted(map(sorted, parts.values()))


def test_large_posting_links_like_small_one():
    rng = np.random.default_rng(2)
    vals = np.unique(rng.integers(0, 1 << 16, 400))
    part = {int(v): int(v) for v in vals}
    part.update(dict(_spanning(vals, 2)))
    want = plain_groups({int(v): int(v) for v in vals})
    groups = lambda d: sorted(sorted(k for k in d if d[k] == r) for r in set(d.values()))
    assert groups(part) == groups(want)


def test_odd_tables(spark):
    schema = "doc_id bigint, text string, fp string, a string"
    assert simhash_groups(spark.createDataFrame([], schema)).count() == 0
    rows = [(None, "p q r", None, None), (1, "k l m", "x", "y"), (1, "k l m", "x", "y"), (2, "K L M", "", "")]
    got = sorted((r.doc_id or 0, r.component_id or 0) for r in simhash_groups(spark.createDataFrame(rows, schema)).collect())
    assert got == [(0, 0), (1, 1), (1, 1), (2, 1)]
    kept = keep_one(spark.createDataFrame(rows, schema))
    assert kept.columns == ["doc_id", "text", "fp", "a"]
    assert sorted((r.doc_id or 0) for r in kept.collect()) == [0, 1]
