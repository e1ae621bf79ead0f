import hashlib
import re
from itertools import product

import pytest

from concord.llm.pii import KINDS, personal_data, reliabilities, train
from concord.llm.queries import op8_pii

FORMS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)",
         "card": r"[0-9](?:[\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(s):
    d = [int(x) for x in re.sub(r"[^0-9]", "", s)][::-1]
    return sum(x if i % 2 == 0 else 2 * x - 9 * (x > 4) for i, x in enumerate(d)) % 10 == 0


def plain(text):
    out = []
    for i, k in enumerate(KINDS):
        for m in re.finditer(FORMS[k], text or ""):
            n = len(re.sub(r"[^0-9]", "", m[0]))
            if k == "ip" and any(int(x) > 255 for x in m[0].split(".")) or k == "card" and not (14 <= n <= 19 and luhn(m[0])) \
                    or k == "phone" and not 10 <= n <= 15:
                continue
            out.append((m.start(), i, m.end()))
    return sorted(out)


TEXTS = ["é😀 a@b.co, x_y@d.e.f and a@b.c_x@d.e z@@q.r ..@-.-- a@b", "1.2.3.4.5.6.7.8 256.1.1.1 0001.02.3.255 1.2.3 12.34.56.78.",
         "4111111111111111 4111-1111-1111-1111 4111 1111 1111 1112 1 4111111111111111 79927398713", "+1 (855) 555-4208 +12 +1234567890123456 +49 30 1234-567.",
         "+1 (855) 555-4208 4866351201689520", "", None, "no data", "378282246310005 6011111111111117", "x" * 30_000 + "@" + "y" * 30_000,
         "7" * 50_000, "1." * 20_000, "+" * 1000 + "1 2" * 9000, "a@b." * 3000 + "c", "- 4111111111111111-", "1 2 3 4 5 6 7 8 9 0 1 2 3 4"]


def test_base_spans_match_plain_form(spark):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id bigint, text string")
    got = {r.doc_id: [(x.s, x.k, x.e) for x in r.base] for r in personal_data(df).collect()}
    for i, t in enumerate(TEXTS):
        assert got[i] == plain(t), t[:60] if t else t


def test_adds_what_the_strict_forms_miss(spark):
    rows = [(i, f"call ann{i}@mail.example.com or +1 (212) 555-{1000 + i} now, host 8.8.{i}.4 end") for i in range(60)]
    rows += [(100, "phone +1 (855) 555-4208 4866351201689520 end"), (101, "mail me: joe [at] example [dot] com"), (102, "3 of 4 at ten")]
    out = {r.doc_id: r for r in personal_data(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    for r in out.values():
        assert set((x.s, x.k, x.e) for x in r.base) <= set((x.s, x.k, x.e) for x in r.spans)
        assert [(x.s, x.k) for x in r.spans] == sorted((x.s, x.k) for x in r.spans)
    assert [(x.s, KINDS[x.k], x.e) for x in out[100].spans] == [(6, "phone", 23), (24, "card", 40)]
    assert [(x.s, KINDS[x.k], x.e) for x in out[101].spans] == [(9, "email", 35)]
    assert not out[102].spans


def test_em_finds_the_reliable_labelers():
    # three labelers follow the truth in 9 of 10 cases, one is a coin
    counts = {}
    for t, share in {1: 0.3, -1: 0.7}.items():
        for v in product((1, -1), repeat=4):
            p = share * 0.5
            for x in v[:3]:
                p *= 0.9 if x == t else 0.1
            counts[v] = counts.get(v, 0) + 10_000 * p
    post, share, odds = reliabilities(sorted(counts.items()))
    assert share == pytest.approx(0.3, abs=0.03)
    assert odds[0][1][0] == pytest.approx(0.9, abs=0.03) and odds[3][1][0] == pytest.approx(0.5, abs=0.03)
    assert post[1, 1, 1, -1] > 0.9 > 0.1 > post[-1, -1, -1, 1]
    w = train([((1, 1), 0, 10, 0.95), ((-1, -1), 0, 10, 0.05)])
    assert w[1] > 0


def test_odd_tables(spark):
    schema = "doc_id bigint, text string, base string, more int, k int"
    assert personal_data(spark.createDataFrame([], schema)).count() == 0
    rows = [(None, "a@b.co", "x", 1, 1), (1, None, None, None, None), (2, "a@b.co", "", 0, 0), (2, "a@b.co", "", 0, 0)]
    got = sorted((r.doc_id or 0, len(r.base)) for r in personal_data(spark.createDataFrame(rows, schema)).collect())
    assert got == [(0, 1), (1, 0), (2, 1), (2, 1)]


def test_running_totals(spark):
    from pyspark.sql import functions as F

    from concord.llm import pii

    rows = [(list(range(1, n + 1)),) for n in (0, 1, 2, 63, 64, 65, 128, 129, 5000)]
    df = spark.createDataFrame(rows, "xs array<int>")
    got = df.select("xs", pii.before(F.col("xs"), F.lit(0), lambda a, b: a + b).alias("sums"),
                    pii.before(F.col("xs"), F.lit(7), F.greatest).alias("tops")).collect()
    for r in got:
        assert r.sums == [i * (i + 1) // 2 for i in range(len(r.xs))] and r.tops == [max([7, *r.xs[:i]]) for i in range(len(r.xs))]


def test_apart_is_the_plain_overlap(spark):
    import random

    from pyspark.sql import functions as F

    from concord.llm import pii

    rng = random.Random(2)
    span = lambda: (lambda s: (s, rng.randint(0, 3), s + rng.randint(1, 9), f"key{s}"))(rng.randint(0, 300))
    rows = [([span() for _ in range(a)], [span() for _ in range(b)]) for a, b in ((0, 5), (5, 0), (1, 1), (12, 9), (80, 20), (40, 150))]
    kind = "array<struct<s:int,k:int,e:int,key:string>>"
    got = spark.createDataFrame(rows, f"x {kind}, y {kind}").select("x", "y", pii.apart(F.col("x"), F.col("y")).alias("z")).collect()
    for r in got:
        want = [tuple(a) for a in r.x if not any(a.s < b.e and b.s < a.e for b in r.y)]
        assert sorted(map(tuple, r.z)) == sorted(want)


def test_many_matches_in_one_text(spark):
    """A text of a megabyte of matches, in time that grows with its length."""
    import time

    from concord.llm.pii import personal_data

    line = "mail a.b{}@example.com or call (212) 555-01{} from 10.0.{}.7, "
    took = []
    for n in (2_000, 16_000):
        text = "".join(line.format(i, 10 + i % 90, i % 250) for i in range(n))
        df = spark.createDataFrame([(1, text)], "doc_id int, text string")
        t = time.perf_counter()
        r = personal_data(df).first()
        took.append(time.perf_counter() - t)
        assert len(r.base) == 2 * n and len(r.spans) >= len(r.base)
        assert all(text[x.s:x.e].startswith(("a.b", "10.0.")) for x in r.base)
    assert took[1] < 30


def planted(n=240, seed=6):
    """Documents with personal data in strict and in wider forms, and with numbers that are none; (rows, wanted spans)."""
    import random

    rng = random.Random(seed)
    digits = lambda k: "".join(rng.choice("0123456789") for _ in range(k))

    def card(sep):
        body = "4" + digits(14)
        last = next(c for c in "0123456789" if luhn(body + c))
        return sep.join((body + last)[i:i + 4] for i in range(0, 16, 4))
    name = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    area = lambda: rng.choice("23456789") + digits(2)
    forms = {
        "email": [lambda: f"{name()}@{name()}.com", lambda: f"{name()} [at] {name()} [dot] org", lambda: f"{name()} at {name()} dot com"],
        "ip": [lambda: f"10.{rng.randint(1, 250)}.4.{rng.randint(1, 250)}", lambda: f"84.{rng.randint(1, 250)}[.]7[.]9".replace("84.", "84[.]")],
        "card": [lambda: card(""), lambda: card("-"), lambda: card(" "), lambda: card(".")],
        "phone": [lambda: f"+1 ({area()}) {digits(3)}-{digits(4)}", lambda: f"({area()}) {digits(3)}-{digits(4)}", lambda: f"{area()}-{digits(3)}-{digits(4)}"],
    }
    cues = {"email": "write to", "ip": "host", "card": "card", "phone": "call"}
    decoys = [lambda: f"order {digits(12)}", lambda: f"version {digits(1)}.{digits(2)}.{digits(1)}", lambda: f"isbn {digits(3)}-{digits(9)}",
              lambda: f"meet at noon dot {digits(2)}", lambda: f"serial {digits(4)} {digits(4)}"]
    rows, want = [], {}
    words = "the river of stone and table lamp over green field then".split()
    for i in range(n):
        text, spans = "", []
        for _ in range(4):
            text += " ".join(rng.choice(words) for _ in range(rng.randint(3, 9))) + ", "
            if rng.random() < 0.6:
                kind = rng.choice(list(forms))
                text += cues[kind] + " "
                value = rng.choice(forms[kind])()
                spans.append((len(text), KINDS.index(kind), len(text) + len(value)))
                text += value + " "
            else:
                text += rng.choice(decoys)() + " "
        rows.append((i, text))
        want[i] = spans
    return rows, want


def test_planted_data_of_all_kinds(spark):
    rows, want = planted()
    out = {r.doc_id: [(x.s, x.k, x.e) for x in r.spans] for r in personal_data(spark.createDataFrame(rows, "doc_id int, text string")).collect()}
    hit, n, false = [0] * 4, [0] * 4, 0
    for i, spans in want.items():
        for s, k, e in spans:
            n[k] += 1
            hit[k] += any(a < e and s < b and kk == k for a, kk, b in out[i])
        false += sum(not any(a < e and s < b for s, _, e in spans) for a, _, b in out[i])
    print("recall", {KINDS[k]: (hit[k], n[k]) for k in range(4)}, "false", false)
    assert all(h >= 0.9 * m for h, m in zip(hit, n)) and false <= 0.05 * sum(n)


def test_query_counts_the_base_spans_as_its_digest_does(spark, tmp_path):
    rows = [(i, f"call ann{i}@mail.example.com or +1 (212) 555-{1000 + i} now, host 8.8.{i}.4 end") for i in range(60)]
    rows += [(100, "mail me: joe [at] example [dot] com"), (101, "phone +1 (855) 555-4208 4866351201689520 end"), (102, None)]
    spark.createDataFrame(rows, "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    added = 0
    for r in op8_pii(spark, str(tmp_path)).collect():
        base = plain(dict(rows)[r.doc_id])
        listed = ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in base)
        assert [r[f"n_{k}"] for k in KINDS] == [sum(x[1] == i for x in base) for i in range(len(KINDS))]
        assert r.base_sha256 == hashlib.sha256(listed.encode()).hexdigest()
        added += r.spans != listed
    assert added  # some texts have spans beyond the counted ones
