"""Phrase collocation mining with directly addressed tiles of pair counts.

Texts are cut into pieces and words, language by language. Words that occur
often enough (a phrase is no more frequent than its words) are numbered by
language and falling frequency, so that the pairs of frequent words lie close
together in the square of all pairs of numbers. Every task counts the pairs of
its chunks in tiles of that square: tiles that are hit often are dense arrays
addressed by the pair itself (``numpy.bincount``), all other pairs are kept as
sorted coordinates (COO) that are merged when they are many. The tasks' counts
meet in one aggregation by pair, whose keys are spread whatever the tile.

Phrases of one word more come from the same counter: the frequent pairs are
numbered by falling frequency like words, and a triple is the pair of a
frequent pair's number and the word after it, counted where its last two words
are a frequent pair too.

A chunk is about ``CHUNK_BYTES`` of text of one language: its different words
and the text as numbers into them. Only a chunk's different words and frequent
pairs are joined with the numbered dictionaries, not every occurrence.
"""

from __future__ import annotations

import numpy as np
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import arrow_batches, cut, remove, written

#: Least frequency of a phrase.
LEAST = 10
#: A candidate goes if it lies in a longer one that has this share of its occurrences at least.
INSIDE = 50
TOP = 2000
#: Parts of a lang's phrases whose best are found first.
SHARES = 16
CHUNK_BYTES = 4 << 20
#: Side of a tile (2 ** TILE words), hits of one chunk from which a tile is dense, most dense tiles of a task.
TILE, DENSE_HITS, DENSE_TILES = 9, 1 << 12, 48
#: Coordinates that a task holds before it merges them, and merged ones that it holds before it gives them out.
BUFFER, HELD = 1 << 21, 3 << 20
#: Bits of the bitmap of frequent pairs at most; a fuller one admits more pairs to the join, never fewer.
MAX_BITS = 1 << 26

# A-Z lower-cased; piece ends become a byte that no UTF-8 text has; other white space than blank and tab is a piece end.
_END = b"\xff"
_LOWER = bytes(0xFF if b in b".,;:!?\x0a\x0b\x0c\x0d" else b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))


def tokens(text: str | None) -> list[bytes]:
    """Words of a text, and ``_END`` between pieces."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).replace(_END, b" \xff ").split()


class Chunk:
    """Words of some texts as numbers into the different words; -1 stands between pieces.

    Of a text that goes on in the next chunk, the first two words there are
    also the last of this one: occurrences count where they start, and only
    the first ``own`` numbers are starts.
    """

    def __init__(self):
        self.number: dict[bytes, int] = {}
        self.parts: list[np.ndarray] = []
        self.size = 0

    def add(self, words: list[bytes]) -> None:
        number = self.number
        ids = np.array([number.setdefault(w, len(number)) for w in words], dtype=np.int32)
        self.parts += [ids, np.array([-1], dtype=np.int32)]
        self.size += sum(map(len, words)) + len(words)

    def row(self, more: list[bytes]) -> tuple[list[str], np.ndarray, np.ndarray, int]:
        """Words, their counts, numbers (with the two words of ``more``) and how many of those are starts."""
        own = np.concatenate(self.parts)
        if more:  # the text goes on: no piece ends here
            own = own[:-1]
        tail = np.array([self.number.setdefault(w, len(self.number)) for w in more], dtype=np.int32)
        seq = np.concatenate([own, tail])
        # the end mark was a word until here; its place stays, as the empty word that occurs nowhere
        seq[seq == self.number.get(_END, -1)] = -1
        starts = seq[:len(own)]
        counts = np.bincount(starts[starts >= 0], minlength=len(self.number))
        words = ["" if w == _END else w.decode("utf-8", "surrogatepass") for w in self.number]
        return words, counts, seq, len(own)


def _pack(seq: np.ndarray) -> bytes:
    """Numbers of four or eight bytes, as many as the array's type has, compressed."""
    import pyarrow as pa

    return pa.compress(seq.astype(seq.dtype.newbyteorder("<")).tobytes(), codec="zstd", asbytes=True)


def _unpack(data: bytes, n: int, size: int = 4) -> np.ndarray:
    import pyarrow as pa

    return np.frombuffer(pa.decompress(data, decompressed_size=size * n, codec="zstd", asbytes=True), dtype=f"<i{size}")


def chunks(docs: DataFrame, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """``(chunk, lang, words, counts, seq, n, own)`` of ``docs (lang, text)``: see :class:`Chunk`."""
    def run(batches):
        import pyarrow as pa

        open_, base, made = {}, TaskContext.get().partitionId() << 33, 0
        schema = pa.schema([("chunk", pa.int64()), ("lang", pa.string()), ("words", pa.list_(pa.string())),
                            ("counts", pa.list_(pa.int64())), ("seq", pa.binary()), ("n", pa.int64()), ("own", pa.int64())])

        def closed(lang, more=()):
            nonlocal made
            words, counts, seq, own = open_.pop(lang).row(list(more))
            made += 1
            return pa.RecordBatch.from_pylist([{"chunk": base + made, "lang": lang, "words": words, "counts": counts.tolist(),
                                                "seq": _pack(seq), "n": len(seq), "own": own}], schema)

        for batch in batches:
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist()):
                words = tokens(text)
                step = max(1, chunk_bytes // 8)  # of a very long text, so many words at a time
                for at in range(0, len(words), step):
                    chunk = open_.setdefault(lang, Chunk())
                    chunk.add(words[at:at + step])
                    if chunk.size >= chunk_bytes or at + step < len(words):
                        yield closed(lang, words[at + step:at + step + 2])
        for lang in list(open_):
            yield closed(lang)

    src = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), "text")
    return src.mapInArrow(run, "chunk bigint, lang string, words array<string>, counts array<bigint>, seq binary, n bigint, own bigint")


class Tiles:
    """Counts of pairs (a, b), as codes a * width + b: dense tiles where pairs are many, sorted coordinates elsewhere."""

    def __init__(self, width: int):
        self.width = width
        self.dense: dict[int, np.ndarray] = {}
        self.codes: list[np.ndarray] = []
        self.counts: list[np.ndarray] = []
        self.waiting = 0

    def add(self, a: np.ndarray, b: np.ndarray) -> None:
        across = (self.width >> TILE) + 1
        tile = (a >> TILE) * across + (b >> TILE)
        order = np.argsort(tile, kind="stable")
        tile, a, b = tile[order], a[order], b[order]
        edge = np.flatnonzero(np.concatenate(([True], tile[1:] != tile[:-1]))) if len(tile) else np.zeros(0, np.int64)
        size = np.diff(np.append(edge, len(tile)))
        sparse = np.ones(len(tile), dtype=bool)
        for i in np.flatnonzero(size >= DENSE_HITS).tolist():
            lo, hi = edge[i], edge[i] + size[i]
            known = self.dense.get(int(tile[lo]))
            if known is None and len(self.dense) >= DENSE_TILES:
                continue
            mask = (1 << TILE) - 1
            hits = np.bincount(((a[lo:hi] & mask) << TILE) | (b[lo:hi] & mask), minlength=1 << (2 * TILE))
            if known is None:
                self.dense[int(tile[lo])] = hits
            else:
                known += hits
            sparse[lo:hi] = False
        codes, counts = np.unique(a[sparse] * self.width + b[sparse], return_counts=True)
        if len(codes):
            self.codes.append(codes)
            self.counts.append(counts)
            self.waiting += len(codes)
        if self.waiting > BUFFER:
            self._merge()

    def _merge(self) -> None:
        codes, counts = np.concatenate(self.codes), np.concatenate(self.counts)
        order = np.argsort(codes, kind="stable")
        codes, counts = codes[order], counts[order]
        edge = np.flatnonzero(np.concatenate(([True], codes[1:] != codes[:-1])))
        self.codes, self.counts, self.waiting = [codes[edge]], [np.add.reduceat(counts, edge)], 0

    def full(self) -> bool:
        return len(self.codes) == 1 and len(self.codes[0]) > HELD

    def take(self):
        """All codes and counts so far; the counter is empty after it."""
        across = (self.width >> TILE) + 1
        if self.codes:
            self._merge()
            yield self.codes[0], self.counts[0]
        for tile, hits in self.dense.items():
            at = np.flatnonzero(hits)
            a = ((tile // across) << TILE) + (at >> TILE)
            yield a * self.width + (((tile % across) << TILE) | (at & ((1 << TILE) - 1))), hits[at]
        self.dense, self.codes, self.counts, self.waiting = {}, [], [], 0


def _counted(coded: DataFrame, width: int, pairs_of) -> DataFrame:
    """``(code, f)``: how often each pair occurs that ``pairs_of`` finds in the chunks."""
    def run(batches):
        import pyarrow as pa

        tiles = Tiles(width)

        def given():
            for codes, counts in tiles.take():
                for at in range(0, len(codes), 1 << 16):
                    yield pa.RecordBatch.from_arrays([pa.array(codes[at:at + (1 << 16)]), pa.array(counts[at:at + (1 << 16)])], ["code", "c"])

        for batch in batches:
            for row in _rows(batch):
                tiles.add(*pairs_of(row))
                if tiles.full():
                    yield from given()
        yield from given()

    return coded.mapInArrow(run, "code bigint, c bigint").groupBy("code").agg(F.sum("c").alias("f"))


def _rows(batch):
    """Rows of an Arrow batch as dicts; lists of structs as dicts of arrays."""
    for i in range(batch.num_rows):
        row = {}
        for name in batch.schema.names:
            value = batch.column(name)[i]
            if hasattr(value, "values"):  # a list of structs of numbers
                found = value.values
                row[name] = {f.name: x.to_numpy(zero_copy_only=False) for f, x in zip(found.type, found.flatten())}
            else:
                row[name] = value.as_py()
        yield row


def encoded(chunks_: DataFrame, size: int) -> DataFrame:
    """``(chunk, seq, n, own)`` of chunks with ``ids (pos, id)``: dictionary numbers of ``size`` bytes.

    -1 stands for words that are not in the dictionary and between pieces.
    """
    def run(batches):
        import pyarrow as pa

        for batch in batches:
            out = []
            for row in _rows(batch):
                seq, pos = _unpack(row["seq"], row["n"]), row["ids"]["pos"]
                number = np.full(max(seq.max(initial=-1), pos.max(initial=-1)) + 2, -1, dtype=f"<i{size}")  # the last is what -1 picks
                number[pos] = row["ids"]["id"]
                out.append(_pack(number[seq]))
            yield pa.RecordBatch.from_arrays([batch.column("chunk"), pa.array(out, pa.binary()), batch.column("n"), batch.column("own")],
                                             ["chunk", "seq", "n", "own"])

    return chunks_.select("chunk", "seq", "n", "own", "ids").mapInArrow(run, "chunk bigint, seq binary, n bigint, own bigint")


def _neighbours(g: np.ndarray, own: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places of pairs that start in the first ``own`` numbers, and the pairs."""
    at = np.flatnonzero((g[:-1] >= 0) & (g[1:] >= 0))
    at = at[at < own]
    return at, g[at].astype(np.int64), g[at + 1].astype(np.int64)


def numbered(df: DataFrame, name: str, *order: Column) -> DataFrame:
    """``df`` with ``name``: 0, 1, ... in ``order``, which tells all rows apart.

    Rows are sorted within ranges of the order; one row a range goes through the driver.
    """
    spark = df.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    parts = cut(df.repartitionByRange(n, *order).withColumn("_part", F.spark_partition_id()))
    sizes = {r["_part"]: r["n"] for r in parts.groupBy("_part").agg(F.count(F.lit(1)).alias("n")).collect()}
    before, total = {}, 0
    for p in sorted(sizes):
        before[p], total = total, total + sizes[p]
    if not before:
        return parts.withColumn(name, F.lit(0).cast("bigint")).drop("_part")
    base = F.element_at(F.map_from_arrays(F.lit(list(before)), F.lit(list(before.values()))), F.col("_part"))
    at = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    return cut(parts.withColumn(name, (base + at - 1).cast("bigint")).drop("_part"))


_MIX = np.uint64(0x9E3779B97F4A7C15)


def _slots(codes: np.ndarray, width: int) -> np.ndarray:
    return (codes.view(np.uint64) * _MIX) >> np.uint64(64 - width)


def _bitmap(pairs: DataFrame, n: int) -> tuple[np.ndarray, int]:
    """Bitmap over the hashes of ``n`` codes of ``pairs (code)``, and the number of bits that address it."""
    width = min(MAX_BITS.bit_length() - 1, max(16, (n * 16).bit_length()))

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            slot = _slots(batch.column("code").to_numpy(zero_copy_only=False), width)
            word, at = np.unique(slot >> np.uint64(6), return_inverse=True)
            bits = np.zeros(len(word), dtype=np.uint64)
            np.bitwise_or.at(bits, at, np.uint64(1) << (slot & np.uint64(63)))
            yield pa.RecordBatch.from_arrays([pa.array(word.view(np.int64)), pa.array(bits.view(np.int64))], ["w", "b"])

    out = np.zeros(1 << (width - 6), dtype=np.uint64)
    words = pairs.select("code").mapInArrow(run, "w bigint, b bigint").groupBy("w").agg(F.bit_or("b").alias("b"))
    for r in words.toLocalIterator():  # at most MAX_BITS / 64 rows
        out[r["w"]] = np.uint64(r["b"] & 0xFFFFFFFFFFFFFFFF)
    return out, width


def _admitted(codes: np.ndarray, bits: np.ndarray, width: int) -> np.ndarray:
    slot = _slots(codes, width)
    return (bits[slot >> np.uint64(6)] >> (slot & np.uint64(63)) & np.uint64(1)).astype(bool)


def _cut_at(l: str, r: str) -> Column:
    """score, l and r of the cut into sides that occur l and r times; exact up to 10**16 occurrences."""
    wide = lambda c: F.col(c).cast("decimal(16,0)")
    top = (wide("a") * wide("a") * F.lit(1_000_000).cast("decimal(7,0)")).cast("decimal(38,0)")
    score = F.call_function("div", top, (wide(l) * wide(r)).cast("decimal(38,0)"))
    return F.struct(score.cast("bigint").alias("score"), F.col(l).alias("l"), F.col(r).alias("r"))


def phrases(docs: DataFrame, least: int = LEAST, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """``(lang, phrase, words, a, l, r, n, score, longer)`` of all candidate phrases of ``docs (lang, text)``.

    Texts (NULL: empty) have A-Z lower-cased and are split at ``. , ; : ! ?``
    and line ends (LF, VT, FF, CR) into pieces, those at blanks and tabs into
    words. Per lang (NULL: ``und``), n is the number of words, a the number of
    a phrase's contiguous occurrences in pieces, at least ``least``. The cut
    with the lowest floor(10**6 * a * a / (l * r)) counts, the earliest of
    equals; l and r are the frequencies of its sides. ``longer`` is the
    greatest frequency of a three-word candidate that holds the phrase (NULL:
    none). Repeated rows count as often as they are there; an empty table
    gives no rows; other columns are ignored.
    """
    spark = docs.sparkSession
    arrow_batches(spark)
    parts, parts_at = written(chunks(docs, chunk_bytes), "chunks")
    every = parts.select("lang", F.explode(F.arrays_zip("words", "counts")).alias("x")).groupBy(
        "lang", F.col("x.words").alias("word")).agg(F.sum("x.counts").alias("f"))
    n_of = parts.groupBy("lang").agg(F.sum(F.aggregate("counts", F.lit(0).cast("bigint"), lambda s, c: s + c)).alias("n"))
    words = numbered(every.where(F.col("f") >= least), "id", F.col("lang"), F.col("f").desc(), F.col("word"))
    width = max(1, words.count())
    size = 4 if width < 1 << 31 else 8
    ids = parts.select("chunk", "lang", F.posexplode("words").alias("pos", "word")).join(
        words.select("lang", "word", "id"), ["lang", "word"]).groupBy("chunk").agg(F.collect_list(F.struct("pos", "id")).alias("ids"))
    n_of = cut(n_of)
    coded, coded_at = written(encoded(parts.select("chunk", "seq", "n", "own").join(ids, "chunk"), size), "coded")
    remove(spark, parts_at)

    def word_pairs(row):
        return _neighbours(_unpack(row["seq"], row["n"], size), row["own"])[1:]

    frequent = _counted(coded, width, word_pairs).where(F.col("f") >= least)
    pairs = numbered(frequent, "id", F.col("f").desc(), F.col("code"))
    n_pairs = pairs.count()
    if n_pairs * width >= 1 << 63:
        raise OverflowError(f"{n_pairs} pairs of {width} words have no 64-bit codes")
    shared = spark.sparkContext.broadcast(_bitmap(pairs, n_pairs))

    def seen(batches):
        import pyarrow as pa

        for batch in batches:
            for row in _rows(batch):
                a, b = word_pairs(row)
                codes = np.unique(a * width + b)
                codes = codes[_admitted(codes, *shared.value)]
                for at in range(0, len(codes), 1 << 16):
                    some = codes[at:at + (1 << 16)]
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(some), row["chunk"])), pa.array(some)], ["chunk", "code"])

    known = coded.mapInArrow(seen, "chunk bigint, code bigint").join(pairs.select("code", "id"), "code").groupBy("chunk").agg(
        F.sort_array(F.collect_list(F.struct("code", F.col("id").alias("p")))).alias("pairs"))

    def triples_of(row):
        g = _unpack(row["seq"], row["n"], size)
        at, a, b = _neighbours(g, row["own"])
        code, p = row["pairs"]["code"], row["pairs"]["p"]
        mine = a * width + b
        slot = np.minimum(np.searchsorted(code, mine), len(code) - 1)
        number = np.full(len(g) + 1, -1, dtype=np.int64)  # of the pair that starts at each place
        number[at] = np.where(code[slot] == mine, p[slot], -1)
        start = at[number[at] >= 0]
        last = np.append(g, [-1, -1])[start + 2].astype(np.int64)
        # a pair that starts in the next chunk's part is not looked up: its last word must be frequent, the counts tell the rest
        keep = ((number[start + 1] >= 0) | (start + 1 >= row["own"])) & (last >= 0)
        return number[start[keep]], last[keep]

    three = _counted(coded.join(known, "chunk"), width, triples_of).where(F.col("f") >= least)
    # numbers back into words and frequencies
    word = words.select(F.col("id").alias("w"), "lang", "word", F.col("f").alias("wf"))
    two = cut(pairs.select("id", "code", "f", F.expr(f"code div {width}").alias("i"), F.expr(f"code % {width}").alias("j"))
              .join(word.select(F.col("w").alias("i"), "lang", F.col("word").alias("w1"), F.col("wf").alias("f1")), "i")
              .join(word.select(F.col("w").alias("j"), F.col("word").alias("w2"), F.col("wf").alias("f2")), "j"))
    left = two.select(F.col("id").alias("p"), "lang", F.col("f").alias("f12"), "f1", "j", "w1", "w2", F.col("code").alias("code12"))
    three = three.select(F.col("f").alias("a"), F.expr(f"code div {width}").alias("p"), F.expr(f"code % {width}").alias("k")).join(left, "p")
    three = three.withColumn("code", F.col("j") * width + F.col("k")).join(
        two.select("code", F.col("f").alias("f23"), F.col("w2").alias("w3"), F.col("f2").alias("f3")), "code")
    three = cut(three.select("lang", F.concat_ws(" ", "w1", "w2", "w3").alias("phrase"), "a", "code12", F.col("code").alias("code23"),
                             "f1", "f12", "f23", "f3"))
    remove(spark, coded_at)
    longer = three.select(F.col("code12").alias("code"), "a").union(three.select("code23", "a")).groupBy("code").agg(F.max("a").alias("longer"))

    found = two.join(longer, "code", "left").select(
        "lang", F.concat_ws(" ", "w1", "w2").alias("phrase"), F.lit(2).alias("words"), F.col("f").alias("a"), "f1", "f2", "longer")
    found = found.withColumn("cut", _cut_at("f1", "f2")).select("lang", "phrase", "words", "a", "cut", "longer")
    first, second = _cut_at("f1", "f23"), _cut_at("f12", "f3")
    more = three.select("lang", "phrase", F.lit(3).alias("words"), "a",
                        F.when(second["score"] < first["score"], second).otherwise(first).alias("cut"), F.lit(None).cast("bigint").alias("longer"))
    return found.unionByName(more).join(n_of, "lang").select(
        "lang", "phrase", "words", "a", F.col("cut.l").alias("l"), F.col("cut.r").alias("r"), "n", F.col("cut.score").alias("score"), "longer")


def collocations(docs: DataFrame, least: int = LEAST, inside: int = INSIDE, top: int = TOP) -> DataFrame:
    """``(lang, rank, phrase, a, l, r, n, score)``: the ``top`` best of each lang's :func:`phrases`.

    A phrase goes if it lies in a longer candidate that occurs ``inside`` per
    cent as often, or more. Order: score and a falling, then the phrase.
    """
    kept = phrases(docs, least).where(F.col("longer").isNull() | (100 * F.col("longer") < inside * F.col("a")))
    # the best of each of SHARES parts first, so that the last task of a lang gets SHARES * top rows at most
    best = (F.col("score").desc(), F.col("a").desc(), F.col("phrase"))
    part = Window.partitionBy("lang", F.pmod(F.xxhash64("phrase"), F.lit(SHARES))).orderBy(*best)
    kept = kept.withColumn("rank", F.row_number().over(part)).where(F.col("rank") <= top)
    return kept.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*best))).where(F.col("rank") <= top).select(
        "lang", F.col("rank").cast("bigint").alias("rank"), "phrase", "a", "l", "r", "n", "score")
