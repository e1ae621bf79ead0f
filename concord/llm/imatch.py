"""I-Match fingerprints with randomised lexicons, in DataFrame functions only.

A document's terms are its distinct lower-cased words (letters and digits). The
lexicon keeps the terms whose inverse document frequency lies in a band: very
common terms say nothing, very rare ones are misspellings. The document's
lexicon terms are sorted and hashed once as a whole, and once for each of
several random parts of the lexicon; small edits leave many of the parts
untouched. Parts come in sizes from 1/4 to 1/512 of the lexicon, so short
and long documents both have parts that few of their terms belong to.

A text's fingerprint depends on its own terms alone, so equal texts have equal
ones wherever they come from. A text of which few terms are in the lexicon (a
large group of near copies makes its own terms common) is hashed in the same
parts over all its terms as well. The likeness of two texts goes over from the
lexicon's parts to the better of both as the smaller of their shares of lexicon
terms falls below ``LEAST_OWN``: gradually, without a threshold at which it
jumps.

A term in the band is in at least ``LEAST_SHARE`` of all documents, so the
lexicon has at most (mean number of terms of a document) / LEAST_SHARE
entries however large the corpus is, and is broadcast after a look at its size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, text_key

#: The band as shares of the documents: idf from ln(1 / MOST_SHARE) to ln(1 / LEAST_SHARE).
LEAST_SHARE, MOST_SHARE = 0.0005, 0.2
#: Fewest documents of a lexicon term.
LEAST_DOCS = 2
#: Share of lexicon terms from which the lexicon's parts alone tell likeness; below twice that, all terms are hashed too.
LEAST_OWN = 0.25
#: Sizes of the lexicon's random parts (2 ** -size of it each), and how many there are of a size at most.
SIZES, PER_SIZE = (2, 3, 4, 5, 6, 7, 8, 9), 6
#: Terms of the lexicon that are broadcast at most (16 bytes each); beyond, the join shuffles.
BROADCAST_TERMS = 2_000_000
#: Stands for a row itself among its terms.
MARK = 1


def terms(text: Column) -> Column:
    """Hashes of the distinct terms."""
    words = F.split(F.lower(text), r"[^\p{L}\p{N}]+")
    return F.array_distinct(F.transform(F.filter(words, lambda w: w != ""), lambda w: F.xxhash64(w)))


def lexicon(docs: DataFrame, least: float = LEAST_SHARE, most: float = MOST_SHARE) -> DataFrame:
    """``(h)``: hashes of the terms of all ``docs (text)`` whose idf lies in the band."""
    n = docs.count()
    df = docs.select(F.explode(terms(F.coalesce("text", F.lit("")))).alias("h")).groupBy("h").agg(F.count(F.lit(1)).alias("df"))
    return df.where((F.col("df") >= max(LEAST_DOCS, least * n)) & (F.col("df") <= max(LEAST_DOCS, most * n))).select("h")


def _count(size: int) -> int:
    return min(PER_SIZE, 1 << size)


def parts(own: Column) -> Column:
    """Hashes of the sorted terms ``own``: of all, and of those in each part (0 where there are none)."""
    ordered = F.transform(F.array_sort(F.array_distinct(own)), lambda h: F.struct(h.alias("h"), F.xxhash64(F.lit(MARK), h).alias("g")))

    def digest(xs):
        return F.when(F.size(xs) > 0, F.xxhash64(F.transform(xs, lambda x: x["h"]))).otherwise(F.lit(0).cast("bigint"))

    def field(size):
        """The bits of a term's random number that say which part of that size it is in."""
        return lambda x: F.shiftright(x["g"], sum(range(SIZES[0], size))).bitwiseAND(F.lit((1 << size) - 1))

    def of_size(size):
        at = field(size)
        return lambda xs: F.array(*[digest(F.filter(xs, lambda x: at(x) == F.lit(j))) for j in range(_count(size))])

    def chosen(xs, size):
        at = field(size)
        return F.element_at(F.transform(F.array(F.filter(xs, lambda x: at(x) < _count(size))), of_size(size)), 1)

    def all_of(xs):
        return F.concat(F.array(digest(xs)), *[chosen(xs, size) for size in SIZES])

    # bound once: the sorted terms are looked at by every part
    return F.element_at(F.transform(F.array(ordered), all_of), 1)


#: Hashes of one set of terms.
PARTS = 1 + sum(_count(size) for size in SIZES)


def fingerprint(own: Column, more: Column) -> Column:
    """Fingerprint of a text with the lexicon terms ``own`` and the other terms ``more``.

    First the share of lexicon terms in thousandths, LEAST_OWN's at most; then
    the parts of the lexicon terms; and where less than twice LEAST_OWN of the
    terms are in the lexicon, the parts of all terms.
    """
    n = F.size(own) + F.size(more)
    share = F.when(n > 0, F.least(F.lit(int(1000 * LEAST_OWN)), F.floor(F.size(own) * 1000 / n))).otherwise(F.lit(0)).cast("bigint")
    whole = F.when(F.size(own) < 2 * LEAST_OWN * n, parts(F.concat(own, more))).otherwise(F.array().cast("array<bigint>"))
    return F.concat(F.array(share), parts(own), whole)


def _likeness(a: Column, b: Column, start: int) -> Column:
    """1 for equal parts, else the best share of equal hashes among the parts of one size; the parts begin at ``start``.

    Parts that neither document has terms in don't count, and one is added to
    those that do, so that a single equal part is no certainty.
    """
    pairs = F.zip_with(F.slice(a, start, PARTS), F.slice(b, start, PARTS), lambda x, y: F.when((x == 0) & (y == 0), 0).when(x == y, 2).otherwise(1))
    shares, at = [], 2
    for size in SIZES:
        part = F.slice(pairs, at, _count(size))
        shares.append(F.size(F.filter(part, lambda p: p == 2)) / (F.size(F.filter(part, lambda p: p > 0)) + 1))
        at += _count(size)
    return F.when(F.element_at(pairs, 1) == 2, 1.0).otherwise(F.greatest(*shares))


def likeness(a: Column, b: Column) -> Column:
    """1 for equal fingerprints, else the likeness of the lexicon's parts, or of all terms' as the lexicon says less."""
    lexicon_says = _likeness(a, b, 2)
    weight = F.least(F.element_at(a, 1), F.element_at(b, 1)) / (1000 * LEAST_OWN)
    both = (F.size(a) > 1 + PARTS) & (F.size(b) > 1 + PARTS)
    all_say = F.when(both, F.greatest(lexicon_says, _likeness(a, b, 2 + PARTS))).otherwise(lexicon_says)
    return F.when(a == b, 1.0).when(weight >= 1, lexicon_says).otherwise(weight * lexicon_says + (1 - weight) * all_say)


def as_text(fp: Column) -> Column:
    return F.array_join(F.transform(fp, lambda x: F.lower(F.hex(x))), ".")


def successors(docs: DataFrame) -> DataFrame:
    """``(doc_id, next_id, next_key)`` per distinct doc_id of ``docs (doc_id, text_key)``, ascending, the last followed by the first.

    NULL is the smallest id. Of rows that share an id, the smallest text_key
    stands for it. The order is taken within ranges of ids; only the first id
    of every range goes through one task.
    """
    spark = docs.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ids = docs.groupBy("doc_id").agg(F.min("text_key").alias("key")).repartitionByRange(n, "doc_id")
    ids = cut(ids.withColumn("part", F.spark_partition_id()))
    me = F.struct(F.col("doc_id").alias("id"), "key")
    inner = ids.withColumn("next", F.lead(me).over(Window.partitionBy("part").orderBy("doc_id")))
    firsts = ids.groupBy("part").agg(F.min(me).alias("first"))
    w = Window.partitionBy(F.lit(1)).orderBy("part")  # a row for each range
    firsts = firsts.select("part", F.coalesce(F.lead("first").over(w), F.first("first").over(
        w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))).alias("after"))
    both = inner.join(firsts, "part").withColumn("next", F.coalesce("next", "after"))
    return both.select("doc_id", F.col("next.id").alias("next_id"), F.col("next.key").alias("next_key"))


def _in_lexicon(rows: DataFrame, words: DataFrame) -> DataFrame:
    """``rows (id, text_key, doc_id, n_chars, edited_sha256, copies, a, b)`` with the terms a and b parted.

    ``own_a`` and ``own_b`` are those in the lexicon, ``more_a`` and ``more_b``
    the others. All terms of a row are exploded and grouped again within the
    row's partition; one more element carries the other columns.
    """
    words = cut(words).withColumn("known", F.lit(True))
    if words.count() <= BROADCAST_TERMS:
        words = F.broadcast(words)

    def tagged(c, tag):
        return F.transform(c, lambda h: F.struct(h.alias("h"), F.lit(tag).alias("tag")))

    def gathered(tag, known):
        return F.collect_list(F.when((F.col("tag") == tag) & (F.col("known").isNotNull() == F.lit(known)), F.col("h")))

    rest = F.struct("doc_id", "n_chars", "edited_sha256", "copies")
    out = rows.select(
        "id", "text_key", rest.alias("rest"),
        F.explode(F.concat(F.array(F.struct(F.lit(MARK).cast("bigint").alias("h"), F.lit(0).alias("tag"))), tagged("a", 1), tagged("b", 2))).alias("x"))
    out = out.select("id", "text_key", "x.h", "x.tag", F.when(F.col("x.tag") == 0, F.col("rest")).alias("rest")).join(words, "h", "left")
    out = out.groupBy("id", "text_key").agg(
        F.first("rest", ignorenulls=True).alias("rest"),
        gathered(1, True).alias("own_a"), gathered(2, True).alias("own_b"), gathered(1, False).alias("more_a"), gathered(2, False).alias("more_b"))
    return out.select("text_key", "rest.*", "own_a", "own_b", "more_a", "more_b")


def _distinct(src: DataFrame) -> DataFrame:
    """``src (id, text_key, text)`` with one row per id and text, and its ``copies``.

    Repeated rows are looked for by their keys alone; texts are regrouped only
    where there are some.
    """
    again = src.groupBy("id", "text_key").agg(F.count(F.lit(1)).alias("copies")).where("copies > 1")
    if again.isEmpty():
        return src.withColumn("copies", F.lit(1).cast("bigint"))
    return src.groupBy("id", "text_key").agg(F.first("text").alias("text"), F.count(F.lit(1)).alias("copies"))


def _same(left: str, right: str) -> Column:
    return F.col(left).eqNullSafe(F.col(right))


def fingerprints(docs: DataFrame, least: float = LEAST_SHARE, most: float = MOST_SHARE) -> DataFrame:
    """Fingerprints of every text of ``docs (doc_id, text)`` and of its edited text.

    The edited text has its last floor(n_chars / 4) code points replaced by the
    first as many (or all) of the next document, in ascending order of doc_id,
    the first after the last. Returns ``doc_id, n_chars, edited_sha256, fp,
    edited_fp, next_fp`` per row: arrays of numbers (:func:`fingerprint`), equal
    for equal texts; a text without any term has only zeros.
    NULL is the empty text and the smallest id; rows repeated in full give
    repeated rows; rows that share an id have the same next document, of which
    the smallest text key stands for its id. An empty table gives no rows;
    other columns are ignored.
    """
    # the id as a struct is NULL-safe in joins; both joins read the same exchange of texts
    every = docs.select(F.struct("doc_id").alias("id"), F.coalesce("text", F.lit("")).alias("text")).select(
        "id", text_key(F.col("text")).alias("text_key"), "text")
    src = _distinct(every)
    nxt = cut(successors(src.select("id.doc_id", "text_key")))
    want = src.select("id", "text_key", F.floor(F.char_length("text") / 4).cast("int").alias("k")).join(
        nxt.select(F.struct("doc_id").alias("id"), F.struct(F.col("next_id").alias("doc_id")).alias("next"), "next_key"), "id").where(
        "k > 0").select(F.col("id").alias("w_id"), F.col("text_key").alias("w_key"), "k", F.col("next").alias("id"),
                        F.col("next_key").alias("text_key"))
    heads = src.join(want, ["id", "text_key"]).select(
        "w_id", "w_key", F.substring("text", F.lit(1), F.col("k")).alias("head")).groupBy("w_id", "w_key").agg(F.first("head").alias("head"))
    n = F.char_length("text")
    edited = F.concat(F.substring("text", F.lit(1), n - F.floor(n / 4).cast("int")), F.coalesce("head", F.lit("")))
    rows = src.join(heads.select(F.col("w_id").alias("id"), F.col("w_key").alias("text_key"), "head"), ["id", "text_key"], "left").select(
        "id", "text_key", F.col("id.doc_id").alias("doc_id"), n.cast("long").alias("n_chars"), "text", edited.alias("edited"), "copies")
    rows = rows.select("id", "text_key", "doc_id", "n_chars", "copies", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
                       terms(F.col("text")).alias("a"), terms(F.col("edited")).alias("b"))
    rows = cut(_in_lexicon(rows, lexicon(every, least, most)).select(
        "doc_id", "text_key", "n_chars", "edited_sha256", "copies",
        *[fingerprint(F.col(f"own_{c}"), F.col(f"more_{c}")).alias(name) for c, name in (("a", "fp"), ("b", "edited_fp"))]))
    of = rows.select(F.col("doc_id").alias("n_id"), F.col("text_key").alias("n_key"), F.col("fp").alias("next_fp"))
    link = nxt.join(of, _same("next_id", "n_id") & (F.col("next_key") == F.col("n_key"))).select(F.col("doc_id").alias("l_id"), "next_fp")
    out = rows.join(link, _same("doc_id", "l_id"))
    return out.select("doc_id", "n_chars", "edited_sha256", "fp", "edited_fp", "next_fp",
                      F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).drop("col")
