"""Every stage of the corpus pipeline against a brute-force version on its own input, and on odd tables."""

import hashlib

import pytest
from test_bpe import PATH
from test_decontaminate import plain as plain_contamination
from test_linededup import plain as plain_lines
from test_simhash import plain_groups, plain_print
from tokenizers import Tokenizer as Library

import corpus_pipeline
from concord.llm.queries import op2_toxicity

SF001, SF_LARGE = "/root/testdata/sf0.001", "/root/testdata/sf0.1"
STAGES = dict(corpus_pipeline.STAGES)


@pytest.fixture(scope="module")
def steps(spark, tmp_path_factory):
    """The input of every stage, and what the last returns."""
    docs, out = spark.read.parquet(f"{SF001}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        path = str(tmp_path_factory.mktemp(name) / "out")
        got = stage(spark, docs, SF001)
        got.write.parquet(path)
        out[name] = docs, spark.read.parquet(path)
        docs = out[name][1]
    return out


def texts(df):
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]


def test_all_but_the_last_keep_the_columns(steps):
    assert list(steps) == ["toxicity", "line_dedup", "simhash", "decontamination", "bpe"]
    for name, (before, after) in steps.items():
        if name != "bpe":
            assert after.columns == before.columns


def test_toxicity_stage_follows_the_operator(spark, steps):
    # too few labels here to hold the classes against (8 toxic ones to learn from): see the next test
    before, after = steps["toxicity"]
    score = {r.doc_id: r.predicted for r in op2_toxicity(spark, SF001).collect()}
    assert sorted(texts(after)) == sorted((d, t) for d, t in texts(before) if score[d] == 0)
    toxic = {r.doc_id: r.toxic for r in spark.read.parquet(f"{SF001}/labels.parquet").collect()}
    good = [d for d, _ in texts(before) if toxic.get(d) == 0]
    assert len(set(good) & {d for d, _ in texts(after)}) >= 0.97 * len(good)


def test_held_out_toxicity(spark):
    labels = spark.read.parquet(f"{SF_LARGE}/labels.parquet").select("doc_id", "toxic")
    rows = op2_toxicity(spark, SF_LARGE).where("held_out").join(labels, "doc_id").collect()
    bad, good = ([r.predicted for r in rows if r.toxic == x] for x in (1, 0))
    assert len(bad) >= 100 and sum(bad) >= 0.9 * len(bad)
    assert sum(good) <= 0.02 * len(good)


def test_lines(steps):
    before, after = steps["line_dedup"]
    want = {d: t for d, (t, _) in plain_lines(texts(before)).items()}
    assert dict(texts(after)) == want
    assert all(r.n_chars == len(r.text) for r in after.where("text is not null").collect())


def test_one_of_each_group(steps):
    before, after = steps["simhash"]
    every = texts(before)
    want = set(plain_groups({d: plain_print(t) for d, t in every}).values())
    assert sorted(texts(after)) == sorted((d, t) for d, t in every if d in want)


def test_contaminated_documents_go(spark, steps):
    before, after = steps["decontamination"]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF001}/benchmark.parquet").collect()]
    every = texts(before)
    bad = {d for d, x in plain_contamination(every, items).items() if x[3]}
    assert bad
    assert sorted(texts(after)) == sorted((d, t) for d, t in every if d not in bad)


def test_ids(steps):
    before, after = steps["bpe"]
    lib = Library.from_file(PATH)
    lib.no_truncation()
    lib.no_padding()
    want = {d: lib.encode(t or "", add_special_tokens=False).ids for d, t in texts(before)}
    got = {r.doc_id: r for r in after.collect()}
    assert {d: list(r.ids) for d, r in got.items()} == want
    for d, t in texts(before):
        assert got[d].n_tokens == len(want[d])
        assert got[d].decoded_sha256 == hashlib.sha256((t or "").encode()).hexdigest()


ODD = "doc_id bigint, text string, lang string, source string, n_chars bigint, score string, n_lines int, _d int, _k int, root int"


@pytest.mark.parametrize("name", list(STAGES))
def test_odd_tables(spark, name):
    clean = "green hills by the river\nold mills and stone walls\nquiet towns in winter\nlong roads"
    rows = [(None, clean, None, None, None, "s", 1, 2, 3, 4), (None, "some quite different text without an id", None, None, None, None, None, None, None, None),
            (7, None, "", "", 0, "", 0, 0, 0, 0), (7, "the same id with another text", "", "", 3, "x", 5, 6, 7, 8),
            (8, clean, "", "", 3, "x", 5, 6, 7, 8), (8, clean, "", "", 3, "x", 5, 6, 7, 8), (9, "", "", "", 0, "", 0, 0, 0, 0)]
    docs = spark.createDataFrame(rows, ODD)
    assert STAGES[name](spark, docs.limit(0), SF001).count() == 0
    out = STAGES[name](spark, docs, SF001)
    if name == "bpe":
        assert out.count() == len(rows)
        return
    assert out.columns == docs.columns
    got = [tuple(r) for r in out.collect()]
    if name in ("toxicity", "decontamination"):
        assert sorted(map(repr, got)) == sorted(map(repr, rows))
    elif name == "line_dedup":
        assert sorted((r[0] or 0, r[1] or "", r[5] or "") for r in got) == sorted(
            (r[0] or 0, "" if r[0] == 8 else r[1] or "", r[5] or "") for r in rows)
    else:  # both rows without an id and both of id 7 are in groups of their own; 8 is a copy, 9 is like the empty text of 7
        assert sorted((r[0] or 0, r[1] or "") for r in got) == sorted(
            [(0, rows[1][1]), (7, ""), (7, rows[3][1]), (8, clean)])
