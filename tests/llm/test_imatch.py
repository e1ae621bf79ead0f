import hashlib
import random
import re
from collections import Counter

from pyspark.sql import functions as F

from concord.llm.imatch import fingerprints, lexicon, likeness


def run(spark, rows, **kw):
    return fingerprints(spark.createDataFrame(rows, "doc_id bigint, text string"), **kw)


def make(n, seed=3):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(400)]
    return [(3 * i, " ".join(rng.choice(vocab) for _ in range(rng.randint(30, 90)))) for i in range(n)]


def test_edited_text_and_likeness(spark):
    rows = make(80)
    rows[40] = (rows[40][0], rows[12][1])
    got = {r.doc_id: r for r in run(spark, rows, most=0.5).withColumns(
        {"near": likeness(F.col("fp"), F.col("edited_fp")), "far": likeness(F.col("fp"), F.col("next_fp"))}).collect()}
    texts = [t for _, t in rows]
    for i, (d, t) in enumerate(rows):
        k, nxt = len(t) // 4, texts[(i + 1) % len(rows)]
        assert got[d].n_chars == len(t)
        assert got[d].edited_sha256 == hashlib.sha256((t[:len(t) - k] + nxt[:k]).encode()).hexdigest()
        assert got[d].next_fp == got[rows[(i + 1) % len(rows)][0]].fp
    assert got[rows[40][0]].fp == got[rows[12][0]].fp
    near, far = [sum(getattr(r, c) for r in got.values()) / len(got) for c in ("near", "far")]
    assert near > 0.35 and far < 0.25


def test_lexicon_is_the_band(spark):
    rows = make(60) + [(999, None), (1000, "")]
    df = Counter(w for _, t in rows for w in set(re.findall(r"\w+", t or "")))
    want = sum(1 for v in df.values() if max(2, 0.05 * len(rows)) <= v <= 0.2 * len(rows))
    assert lexicon(spark.createDataFrame(rows, "doc_id bigint, text string"), 0.05, 0.2).count() == want


def test_near_copies_that_hold_a_third_of_the_rows(spark):
    rows = make(80)
    rng = random.Random(9)
    base = [f"c{i}" for i in range(120)]
    for i in range(40):  # neighbours in the order of ids, each with three words of its own
        words = list(base)
        for j in range(3):
            words[rng.randrange(120)] = f"own{i}x{j}"
        rows.append((10_000 + i, " ".join(words)))
    got = {r.doc_id: r for r in run(spark, rows).withColumns(
        {"near": likeness(F.col("fp"), F.col("edited_fp")), "next": likeness(F.col("fp"), F.col("next_fp"))}).collect()}
    group = [got[10_000 + i] for i in range(39)]  # the last one's next is another text
    assert sum(r.near for r in group) / 39 > 0.35 and sum(r.next for r in group) / 39 > 0.35
    assert all(r.near < 1 for r in group if r.fp != r.edited_fp)


def test_odd_tables(spark):
    assert run(spark, []).count() == 0
    one = run(spark, [(5, "abcdefgh")]).collect()[0]
    assert one.edited_sha256 == hashlib.sha256(b"abcdefab").hexdigest() and one.next_fp == one.fp
    schema = "doc_id bigint, text string, id string, h int, `rest` int"
    rows = [(None, "zz yy xx ww", "1", 1, 1), (1, "aaaa bbbb", "1", 1, 1), (1, "aaaa bbbb", "1", 1, 1), (1, "cc", "", 0, 0),
            (7, None, None, None, None), (8, "", "", 0, 0), (9, "?!?!", "", 0, 0)]
    out = fingerprints(spark.createDataFrame(rows, schema)).withColumn("near", likeness(F.col("fp"), F.col("edited_fp"))).collect()
    assert sorted((r.doc_id or 0) for r in out) == [0, 1, 1, 1, 7, 8, 9]
    by = {(r.doc_id, r.n_chars): r for r in out}
    assert by[7, 0].fp == by[8, 0].fp and set(by[7, 0].fp) == {0} and by[8, 0].near == 1.0
    assert by[9, 4].edited_sha256 == hashlib.sha256(b"?!?z").hexdigest()
    assert by[1, 9].edited_sha256 == hashlib.sha256(b"aaaa bb").hexdigest()
    assert any(by[1, 2].fp)


def test_equal_texts_have_equal_fingerprints_wherever_they_come_from(spark):
    """An edited text that is another document's text gets that document's fingerprint, whatever its origin's terms are."""
    rows = make(60)
    rare = " ".join(f"only{i}" for i in range(30)) + " " + " ".join(rows[5][1].split()[:40])  # few lexicon terms
    nxt = rows[6][1]
    k = len(rare) // 4
    rows += [(1_000, rare), (1_001, nxt), (2_000, rare[:len(rare) - k] + nxt[:k])]
    rows += [(3_000, "solo unique words here"), (3_001, "w1 w2 w3 w4 w5 w6"), (3_002, ("solo unique words here"[:17] + "w1 w2"))]
    got = {r.doc_id: r for r in run(spark, rows).collect()}
    assert got[1_000].edited_fp == got[2_000].fp
    assert got[3_000].edited_fp == got[3_002].fp
    by_text = {}
    for d, t in rows:
        by_text.setdefault(hashlib.sha256(t.encode()).hexdigest(), set()).add(tuple(got[d].fp))
    for r in got.values():
        by_text.setdefault(r.edited_sha256, set()).add(tuple(r.edited_fp))
    assert all(len(x) == 1 for x in by_text.values())


def test_likeness_does_not_jump(spark):
    """Texts that share 19 of 20 terms, as their share of lexicon terms goes from none to all."""
    import random as rnd

    from concord.llm.imatch import fingerprint

    rng = rnd.Random(4)
    n, rows = 80, []
    for known in range(0, 81):
        own, more = [[rng.getrandbits(62) for _ in range(k)] for k in (known, n - known)]
        swap = lambda xs: [rng.getrandbits(62) if rng.random() < 0.05 else x for x in xs]
        rows.append((known, own, more, swap(own), swap(more)))
    df = spark.createDataFrame(rows, "k int, a array<bigint>, b array<bigint>, c array<bigint>, d array<bigint>")
    df = df.select("k", likeness(fingerprint(F.col("a"), F.col("b")), fingerprint(F.col("c"), F.col("d"))).alias("x"))
    got = [r.x for r in df.orderBy("k").collect()]
    mean = lambda xs: sum(xs) / len(xs)
    around = [mean(got[i:i + 9]) for i in range(0, 72)]
    assert min(got) > 0.15 and max(abs(x - y) for x, y in zip(around, around[1:])) < 0.15
    assert abs(mean(got[10:20]) - mean(got[20:30])) < 0.2 and abs(mean(got[30:40]) - mean(got[40:50])) < 0.2


def plain_fingerprint(spark, terms, lexicon_terms):
    """The docstring's fingerprint, in plain Python over Spark's hash."""
    from concord.llm import imatch as I

    hashes = {t: h for t, h in zip(sorted(terms), [r[0] for r in spark.createDataFrame(
        [(t,) for t in sorted(terms)], "t string").select(F.xxhash64("t")).collect()])}
    own = [h for t, h in hashes.items() if t in lexicon_terms]
    g = {r.h: r.g for r in spark.createDataFrame([(h,) for h in hashes.values()] or [(0,)], "h bigint").select(
        "h", F.xxhash64(F.lit(I.MARK), "h").alias("g")).collect()}

    def parts(hs):
        out, shift = [hs], 0
        for size in I.SIZES:
            out += [[h for h in hs if (g[h] >> shift) & ((1 << size) - 1) == j] for j in range(min(I.PER_SIZE, 1 << size))]
            shift += size
        return out
    n = len(hashes)
    share = min(int(1000 * I.LEAST_OWN), 1000 * len(own) // n) if n else 0
    sets = parts(own) + (parts(list(hashes.values())) if len(own) < 2 * I.LEAST_OWN * n else [])
    rows = spark.createDataFrame([(i, sorted(x)) for i, x in enumerate(sets)], "i int, h array<bigint>").select(
        "i", F.when(F.size("h") > 0, F.xxhash64("h")).otherwise(F.lit(0).cast("bigint")).alias("d")).orderBy("i").collect()
    return [share, *(r.d for r in rows)]


def test_matches_plain_form(spark):
    rows = make(30) + [(500, "solo alone w1"), (501, "")]
    split = lambda t: set(re.findall(r"\w+", t.lower()))
    df = Counter(w for _, t in rows for w in split(t))
    band = {w for w, v in df.items() if 2 <= v <= 0.3 * len(rows)}
    got = {r.doc_id: r.fp for r in run(spark, rows, most=0.3).collect()}
    for d, t in [rows[0], rows[7], rows[30], rows[31]]:
        assert got[d] == plain_fingerprint(spark, split(t), band)


def test_rows_repeated_in_full_are_counted(spark):
    rows = [(1, "aa bb cc dd " * 20)] * 300 + make(40) + [(None, "x y z")] * 50
    out = run(spark, rows).collect()
    assert len(out) == len(rows)
    assert len({(tuple(r.fp), r.edited_sha256) for r in out if r.doc_id == 1}) == 1
    assert sum(r.doc_id is None for r in out) == 50


def test_very_long_text(spark):
    rng = random.Random(1)
    text = " ".join(f"w{rng.randint(0, 50_000)}" for _ in range(400_000))
    rows = make(20) + [(10_000, text), (10_001, text[:-20])]
    got = {r.doc_id: r for r in run(spark, rows).withColumn("near", likeness(F.col("fp"), F.col("next_fp"))).collect()}
    assert got[10_000].n_chars == len(text) and got[10_000].near > 0.7
