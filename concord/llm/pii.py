"""Personal data spans by weak supervision, in DataFrame functions only.

Strict patterns give the base spans, which always stay. Wider patterns give
further candidates (numbers without a leading plus, spelled-out or bracketed
separators, groups that a strict pattern swallowed together). Labelers vote on
every span, base or candidate: regex (which form matched), a check of the
digits or parts, a gazetteer, the words before it, and its edges. Votes are
1 (personal data), -1 (not) or 0 (abstains).

Expectation-maximisation over the counts of vote patterns, kind by kind,
estimates how reliable each labeler is and how likely each pattern is personal
data. Those likelihoods are the soft labels of a logistic span classifier over
votes, length, character shape and the word before the span; candidates that it
accepts are added. What words and shapes say is counted over the whole corpus:
hashed to BUCKETS, each bucket tells how often its spans are personal data.
Every counted table is bounded by votes, shapes, buckets and levels, whatever
the corpus.

Positions are code points. A pattern is applied by splitting the text at its
matches: the lengths of the pieces and of the matches add up to the positions,
so the work is linear in the text.
"""

from __future__ import annotations

import json
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut

KINDS = ("email", "ip", "card", "phone")

# The strict patterns read the text as the plain forms do, but never look at a
# run of characters twice: a match that starts inside a run would have started
# at its beginning, and repetitions don't give back.
_LOCAL = "[A-Za-z0-9._%+-]"
BASE = {
    "email": rf"(?:(?<!{_LOCAL})|\G){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    # of digits with single blanks or hyphens between, the whole run: 14 to 19 digits
    "card": r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?[0-9]){13,18}+(?![ -]?[0-9])",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
WIDE = {
    "email": rf"(?<!{_LOCAL}){_LOCAL}++(?: ?[\[(\{{<] ?(?:at|AT|@) ?[\])\}}>] ?| (?:at|AT) )[A-Za-z0-9-]++"
             r"(?:(?: ?[\[(\{<] ?(?:dot|DOT|\.) ?[\])\}>] ?| (?:dot|DOT) |\.)[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9.])[0-9]{1,3}(?:(?:\[\.\]|\(\.\)| dot )[0-9]{1,3}){3}(?![0-9])|(?<![0-9A-Za-z:])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Za-z:])",
    "card": r"(?<![0-9])[0-9]{4}([ .-]?)[0-9]{4}\1[0-9]{4}\1[0-9]{4}(?![0-9])",
    "phone": r"(?<![0-9])(?:\+?[0-9]{1,3}[ .-])?\([0-9]{3}\) ?[0-9]{3}[ .-][0-9]{4}(?![0-9])"
             r"|(?<![0-9.-])(?:\+?[0-9]{1,3}[ .-])?[0-9]{3}([ .-])[0-9]{3}\1[0-9]{4}(?![0-9])",
}
# Words before a span that speak for a kind, and some that speak against all.
CUES = {
    "email": "mail|e-mail|email|contact|contacto|kontakt|courriel|correo|write|reply",
    "ip": "ip|host|server|serveur|servidor|address|adresse|gateway|from",
    "card": "card|visa|mastercard|amex|carte|karte|tarjeta|credit|payment",
    "phone": "tel|phone|call|fax|mobile|telefon|telefono|téléphone|handy|sms|whatsapp",
}
AGAINST = "isbn|issn|doi|version|section|order|invoice|hash|sha|token|key|id|serial|build|release"
GAZETTEER = {
    "email": r"(?i)(?:com|org|net|edu|gov|info|io|co|de|fr|es|uk|us|eu|it|nl|ch|at)$",
    "ip": r"^(?!0|10\D|127\D|192\D+168\D|22[4-9]|2[3-5][0-9])[1-9a-fA-F]",
    "card": r"^(?:3[47]|4|5[1-5]|2[2-7]|6(?:011|4|5))",
    "phone": r"^(?:\+|\(?[2-9][0-9]{2}\D)",
}
CONTEXT = 24
ROUNDS = 60


#: Elements of an array that are gone through one by one; longer arrays are gone through in blocks of so many.
BLOCK = 64


def before(xs: Column, zero: Column, merge, depth: int = 2) -> Column:
    """For every element of ``xs``, ``zero`` merged with all elements before it.

    Results are appended within blocks only, and the blocks' totals are merged
    in the same way, so the work is linear up to BLOCK ** (depth + 1) elements.
    """
    def appended(v):
        return F.aggregate(
            v, F.struct(zero.alias("at"), F.slice(F.array(zero), 1, 0).alias("out")),
            lambda acc, x: F.struct(merge(acc["at"], x).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out")),
            lambda acc: acc["out"])

    def joined(blocks):
        totals = F.transform(blocks, lambda b: F.aggregate(b, zero, lambda x, y: merge(x, y)))
        return F.flatten(F.zip_with(blocks, before(totals, zero, merge, depth - 1),
                                    lambda b, base: F.transform(appended(b), lambda x: merge(base, x))))

    def whole(v):
        blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(v) - 1) / BLOCK).cast("int")), lambda i: F.slice(v, i * BLOCK + 1, F.lit(BLOCK)))
        return F.when(F.size(v) <= BLOCK, appended(v)).otherwise(F.element_at(F.transform(F.array(blocks), joined), 1))

    # arrays are bound once: every block looks at them
    return F.element_at(F.transform(F.array(xs), whole if depth else appended), 1)


def matches(text: Column, pattern: str) -> Column:
    """Array of (s, e, m, l, r): the pattern's leftmost non-overlapping matches with their places.

    l is what stands before a match, CONTEXT code points at most and not
    beyond the match before it; r is the code point after it. Both come from
    the pieces between matches, so that the text is never gone through again.
    """
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.split(text, pattern, -1)

    def with_gaps(both):
        xs, gs = both["found"], both["gaps"]
        n = F.size(xs)
        lefts = F.zip_with(F.slice(F.concat(F.array(F.lit("")), xs), F.lit(1), n), F.slice(gs, F.lit(1), n),
                           lambda m, g: F.struct(F.length(g).alias("g"), F.right(F.concat(m, g), F.lit(CONTEXT)).alias("l")))
        rights = F.zip_with(F.slice(gs, F.lit(2), n), F.slice(F.concat(xs, F.array(F.lit(""))), F.lit(2), n),
                            lambda g, m: F.left(F.concat(F.left(g, F.lit(1)), F.left(m, F.lit(1))), F.lit(1)))
        sides = F.zip_with(lefts, rights, lambda a, r: F.struct(a["g"].alias("g"), a["l"].alias("l"), r.alias("r")))
        starts = before(F.zip_with(xs, lefts, lambda m, a: F.length(m) + a["g"]), F.lit(0), lambda a, b: a + b)
        placed = F.zip_with(sides, starts, lambda a, at: F.struct((at + a["g"]).alias("s"), a["l"].alias("l"), a["r"].alias("r")))
        return F.zip_with(xs, placed, lambda m, a: F.struct(
            a["s"].alias("s"), (a["s"] + F.length(m)).alias("e"), m.alias("m"), a["l"].alias("l"), a["r"].alias("r")))

    return F.element_at(F.transform(F.array(F.struct(found.alias("found"), gaps.alias("gaps"))), with_gaps), 1)


def apart(spans: Column, others: Column) -> Column:
    """Those of ``spans (s, k, e, key)`` that overlap none of ``others (s, e)``, by one merge in order of starts."""
    last = F.lit(2 ** 31 - 1)

    def merged(u):
        reach = before(F.transform(u, lambda x: F.when(x["f"] == 0, x["e"]).otherwise(0)), F.lit(0), F.greatest)
        follows = F.reverse(before(F.transform(F.reverse(u), lambda x: F.when(x["f"] == 0, x["s"]).otherwise(last)), last, F.least))
        free = F.zip_with(F.zip_with(u, reach, lambda x, r: F.struct(x.alias("x"), r.alias("r"))), follows, lambda a, n: F.when(
            (a["x"]["f"] == 1) & (a["r"] <= a["x"]["s"]) & (n >= a["x"]["e"]),
            F.struct(*[a["x"][c].alias(c) for c in ("s", "k", "e", "key")])))
        return F.filter(free, lambda x: x.isNotNull())

    both = F.sort_array(F.concat(*[F.transform(a, lambda x: F.struct(
        x["s"].alias("s"), F.lit(f).alias("f"), x["e"].alias("e"), x["k"].alias("k"), x["key"].alias("key"))) for f, a in enumerate((others, spans))]))
    return F.when((F.size(spans) == 0) | (F.size(others) == 0), spans).otherwise(F.element_at(F.transform(F.array(both), merged), 1))


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _luhn(m: Column) -> Column:
    d = F.reverse(_digits(m))
    total = F.aggregate(F.sequence(F.lit(1), F.length(d)), F.lit(0), lambda acc, i: acc + F.when(
        i % 2 == 1, d.substr(i, F.lit(1)).cast("int")).otherwise(
        (d.substr(i, F.lit(1)).cast("int") * 2) % 10 + F.floor(d.substr(i, F.lit(1)).cast("int") / 5).cast("int")))
    return total % 10 == 0


def _octets(m: Column) -> Column:
    parts = F.split(F.regexp_replace(m, r"^[^0-9]+|[^0-9]+$", ""), "[^0-9]+")
    short = F.transform(parts, lambda p: F.regexp_replace(p, "^0+", ""))
    return F.forall(short, lambda p: (F.length(p) < 3) | ((F.length(p) == 3) & (p <= F.lit("255"))))


def valid(kind: str, m: Column) -> Column:
    """The check that a strict match of the kind must pass."""
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        return _octets(m)
    if kind == "card":
        return F.length(_digits(m)).between(14, 19) & _luhn(m)
    return F.length(_digits(m)).between(10, 15)


def _votes(kind: str, x: Column, strict: bool) -> Column:
    """Votes of the labelers, joined by commas."""
    m, ahead, behind = x["m"], F.lower(x["l"]), x["r"]
    regex = F.lit("1" if strict else "0")
    if kind == "email":
        check = F.when(m.rlike(r"\.\.|^[.-]|[.-]@|-$|[^A-Za-z0-9][0-9]+$"), "-1").otherwise("1")
    elif kind == "ip":
        check = F.when(m.contains(":") | _octets(m), "1").otherwise("-1")
    else:
        check = F.when(valid(kind, m), "1").otherwise("-1")
    gazette = F.when((_digits(m) if kind == "card" else m).rlike(GAZETTEER[kind]), "1").otherwise("-1" if kind == "card" else "0")
    cue = F.when(ahead.rlike(rf"(?:^|[^\p{{L}}])(?:{CUES[kind]})[^\p{{L}}]*$"), "1").when(
        ahead.rlike(rf"(?:^|[^\p{{L}}])(?:{AGAINST})[^\p{{L}}]*$"), "-1").otherwise("0")
    edges = F.when(ahead.rlike(r"[\p{L}\p{N}=]$") | behind.rlike(r"^[\p{L}\p{N}@]"), "-1").otherwise("1")
    return F.concat_ws(",", regex, check, gazette, cue, edges)


def _shape(m: Column) -> Column:
    """Length and make-up of a span: 12 classes."""
    size = F.when(F.length(m) < 12, 0).when(F.length(m) < 16, 1).when(F.length(m) < 24, 2).otherwise(3)
    kind = F.when(~m.rlike("[0-9]"), 0).when(m.rlike(r"[\p{L}]"), 1).otherwise(2)
    return (size * 3 + kind).cast("string")


#: Buckets of words before a span, and of spans' character shapes; levels of their evidence on either side of none.
BUCKETS, LEVELS = 256, 3


def _signs(x: Column) -> tuple[Column, Column]:
    """Buckets of the word before a span and of its characters' shape (letters, digits and runs of them told apart)."""
    word = F.regexp_extract(F.lower(x["l"]), r"(\p{L}+)[^\p{L}]*$", 1)
    shape = F.regexp_replace(F.regexp_replace(F.regexp_replace(x["m"], r"\p{L}+", "a"), "[0-9]{5,}", "9"), "[0-9]", "9")
    return tuple(F.pmod(F.xxhash64(v), F.lit(BUCKETS)).cast("string") for v in (word, shape))


def candidates(docs: DataFrame) -> DataFrame:
    """``(doc_id, base, more)``: arrays of (s, k, e, key); key names kind, votes, shape and the buckets of word and characters."""
    text = F.coalesce(F.col("text"), F.lit(""))
    need = {"email": text.contains("@"), "phone": text.contains("+")}
    passes = lambda k: lambda x: valid(k, x["m"])
    out = docs.select("doc_id", text.alias("text"))
    empty = F.array().cast("array<struct<s:int,e:int,m:string,l:string,r:string>>")
    out = out.select("doc_id", "text", *[
        (F.when(need[k], matches(F.col("text"), BASE[k])).otherwise(empty) if k in need else matches(F.col("text"), BASE[k])).alias(f"b_{k}")
        for k in KINDS], *[matches(F.col("text"), WIDE[k]).alias(f"w_{k}") for k in KINDS])
    out = out.select("doc_id", "text", *[F.filter(f"b_{k}", passes(k)).alias(f"b_{k}") for k in KINDS],
                     *[f"w_{k}" for k in KINDS])

    def keyed(k, at, strict):
        return lambda x: F.struct(x["s"].alias("s"), F.lit(at).alias("k"), x["e"].alias("e"), F.concat_ws(
            "|", F.lit(k), _votes(k, x, strict), _shape(x["m"]), *_signs(x)).alias("key"))

    base = F.concat(*[F.transform(f"b_{k}", keyed(k, i, True)) for i, k in enumerate(KINDS)])
    out = out.select("doc_id", base.alias("base"), *[F.transform(f"w_{k}", keyed(k, i, False)).alias(f"w_{k}") for i, k in enumerate(KINDS)])
    # a candidate that overlaps a base span, or an earlier kind's candidate, is another reading of it
    more = [apart(F.col(f"w_{k}"), F.concat("base", *[f"w_{x}" for x in KINDS[:i]])) for i, k in enumerate(KINDS)]
    return out.select("doc_id", F.sort_array("base").alias("base"), F.concat(*more).alias("more"))


def reliabilities(counts: list[tuple[tuple[int, ...], float]], rounds: int = ROUNDS) -> tuple[dict, float, list]:
    """EM for one kind: likelihood of every vote pattern, the share of personal data, and each labeler's vote odds.

    ``counts``: vote patterns and how often they occur. Starts from the sum of
    the votes; labelers vote independently given the truth.
    """
    n = len(counts[0][0])
    post = {v: 1 / (1 + math.exp(-sum(v))) for v, _ in counts}
    share, odds = 0.5, []
    for _ in range(rounds):
        total = sum(c for _, c in counts)
        yes = sum(c * post[v] for v, c in counts)
        share = (yes + 1) / (total + 2)
        odds = []
        for i in range(n):
            row = {}
            for vote in (-1, 0, 1):
                a = sum(c * post[v] for v, c in counts if v[i] == vote)
                b = sum(c * (1 - post[v]) for v, c in counts if v[i] == vote)
                # a labeler is taken to be better than chance until counts say otherwise
                row[vote] = ((a + 1 + vote / 2) / (yes + 3), (b + 1 - vote / 2) / (total - yes + 3))
            odds.append(row)
        for v, _ in counts:
            logit = math.log(share / (1 - share)) + sum(math.log(odds[i][x][0] / odds[i][x][1]) for i, x in enumerate(v))
            post[v] = 1 / (1 + math.exp(-max(-30.0, min(30.0, logit))))
    return post, share, odds


def train(rows: list[tuple[tuple[int, ...], int, float, float]], rounds: int = 300) -> list[float]:
    """Logistic weights over features and shape for rows (features, shape, count, soft label)."""
    def vector(features, shape):
        return [1.0, *(float(x) for x in features), *(float(shape == i) for i in range(12))]

    total = sum(c for _, _, c, _ in rows)
    data = [(vector(v, s), c / total, y) for v, s, c, y in rows]
    w = [0.0] * len(data[0][0])
    for _ in range(rounds):
        grad = [-1e-4 * x for x in w]
        for x, c, y in data:
            p = 1 / (1 + math.exp(-max(-30.0, min(30.0, sum(a * b for a, b in zip(w, x))))))
            for i, a in enumerate(x):
                if a:
                    grad[i] += c * (y - p) * a
        w = [a + 2.0 * g for a, g in zip(w, grad)]
    return w


def _level(n: float, yes: float, share: float) -> int:
    """Evidence of a bucket in which ``yes`` of ``n`` spans are personal data, against the kind's share: whole steps, LEVELS at most."""
    odds = math.log((yes + 2 * share) / (n - yes + 2 * (1 - share))) - math.log(share / (1 - share))
    return max(-LEVELS, min(LEVELS, round(odds)))


def classes(key: Column, levels: dict[str, int]) -> Column:
    """Kind, votes, shape and the levels of word and characters of a span's key."""
    parts = F.split(key, r"\|")
    known = F.from_json(F.lit(json.dumps(levels)), "map<string,int>")
    at = lambda what, i: F.coalesce(F.element_at(known, F.concat_ws("|", F.lit(what), parts[0], parts[i])), F.lit(0)).cast("string")
    return F.concat_ws("|", parts[0], parts[1], parts[2], at("word", 3), at("shape", 4))


def accepted(found: DataFrame) -> tuple[dict[str, int], list[str]]:
    """Levels of the buckets, and the :func:`classes` that the trained classifier takes for personal data.

    The votes' likelihoods are the soft labels. Words before spans and spans'
    characters are counted over the whole corpus, weighted by those labels.
    """
    every = found.select(F.explode(F.concat("base", "more")).alias("x")).select("x.key", F.split("x.key", r"\|").alias("p"))
    votes: dict[str, dict[tuple[int, ...], float]] = {}
    for r in every.groupBy(F.col("p")[0].alias("kind"), F.col("p")[1].alias("votes")).count().collect():  # at most 4 * 3**5
        votes.setdefault(r["kind"], {})[tuple(map(int, r["votes"].split(",")))] = float(r["count"])
    posts, shares = {}, {}
    for kind, counts in votes.items():
        posts[kind], shares[kind], _ = reliabilities(sorted(counts.items()))
    if not posts:
        return {}, []
    label = F.from_json(F.lit(json.dumps({f"{k}|{','.join(map(str, v))}": p for k, own in posts.items() for v, p in own.items()})), "map<string,double>")
    labelled = every.withColumn("y", F.element_at(label, F.concat_ws("|", F.col("p")[0], F.col("p")[1])))
    levels = {}
    for what, i in (("word", 3), ("shape", 4)):  # at most 4 * BUCKETS rows each
        for r in labelled.groupBy(F.col("p")[0].alias("kind"), F.col("p")[i].alias("b")).agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("y")).collect():
            levels[f"{what}|{r['kind']}|{r['b']}"] = _level(r["n"], min(r["n"], r["y"]), shares[r["kind"]])
    rows: dict[str, list] = {}
    for r in every.groupBy(classes(F.col("key"), levels).alias("c")).count().collect():  # at most 4 * 3**5 * 12 * (2 * LEVELS + 1)**2
        kind, v, shape, word, chars = r["c"].split("|")
        v = tuple(map(int, v.split(",")))
        rows.setdefault(kind, []).append(((*v, int(word), int(chars)), int(shape), float(r["count"]), posts[kind][v], r["c"]))
    out = []
    for own in rows.values():
        w = train([x[:4] for x in own])
        out += [c for v, s, _, _, c in own if w[0] + sum(a * b for a, b in zip(w[1:], v)) + w[1 + len(v) + s] > 0]
    return levels, sorted(out)


def personal_data(docs: DataFrame) -> DataFrame:
    """``(doc_id, base, spans)`` per row of ``docs (doc_id, text)``: arrays of (s, k, e).

    k is the place of the kind in KINDS; s and e are code points, e exclusive.
    ``base`` are the strict matches that pass their check, ``spans`` these and
    the accepted candidates; both in order of start, then kind. A candidate
    never overlaps a base span. NULL and empty texts have none; repeated rows
    give repeated rows, an empty table none; other columns are ignored.
    """
    found = cut(candidates(docs))
    levels, good = accepted(found)
    plain = lambda a: F.transform(a, lambda x: F.struct(x["s"].alias("s"), x["k"].alias("k"), x["e"].alias("e")))
    more = F.filter("more", lambda x: classes(x["key"], levels).isin(*good)) if good else F.slice("more", 1, 0)
    return found.select("doc_id", plain("base").alias("base"), F.sort_array(plain(F.concat("base", more))).alias("spans"))


def listed(spans: str) -> Column:
    """kind:start:end of every span, comma-joined."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(
        ":", F.element_at(names, x["k"] + 1), x["s"].cast("string"), x["e"].cast("string"))), ",")
