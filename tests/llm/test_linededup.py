from concord.llm.linededup import line_dedup


def plain(rows):
    """rows: (doc_id, text) with unique ids."""
    seen, out = set(), {}
    for d, t in sorted(rows):
        lines = (t or "").split("\n")
        nb = [i for i, x in enumerate(lines) if x.strip(" \t\r")]
        s = [lines[i].strip(" \t\r") for i in nb]
        gone = set()
        for j in range(len(nb) - 2):
            w = tuple(s[j:j + 3])
            if w in seen:
                gone |= {nb[j], nb[j + 1], nb[j + 2]}
            seen.add(w)
        if gone and len(gone) == len(nb):
            out[d] = ("", len(gone))
        else:
            out[d] = (t if not gone else "\n".join(x for i, x in enumerate(lines) if i not in gone), len(gone))
    return out


def test_against_plain_form(spark):
    rows = [(1, "a\nb\nc\nd"), (2, "x\n a\nb \n\nc\r\ny"), (3, "a\nb\nc\nd"), (4, None), (5, ""), (6, "a\nb"),
            (7, "q\nq\nq\nq\nq"), (8, "\n\n\n\n"), (9, "b\nc\nd\nz"), (10, "c\nd\nz")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = {r.doc_id: (r.text, r.n_removed) for r in line_dedup(df).collect()}
    assert got == plain(rows)
    assert got[3] == ("", 4) and got[2] == ("x\n\ny", 3) and got[6] == ("a\nb", 0)


def test_many_lines_and_hot_passage(spark):
    hot = "one line here\nand a second\nand the third"
    rows = [(i, f"start {i}\n{hot}\nend {i}") for i in range(200)]
    rows += [(1000, "\n".join(f"line {i % 700}" for i in range(2100)))]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert {r.doc_id: (r.text, r.n_removed) for r in line_dedup(df).collect()} == plain(rows)


def test_odd_tables(spark):
    schema = "doc_id bigint, text string, `at` int, js int, n_lines string"
    assert line_dedup(spark.createDataFrame([], schema)).count() == 0
    t = "a\nb\nc"
    rows = [(None, t, 1, 2, "k"), (1, t, 1, 2, "k"), (2, t, 1, 2, None), (2, t, 1, 2, None)]
    out = line_dedup(spark.createDataFrame(rows, schema))
    assert out.columns == ["doc_id", "text", "at", "js", "n_lines", "n_removed"]
    got = sorted(((r.doc_id or 0), r.text) for r in out.collect())
    assert got == [(0, t), (1, ""), (2, ""), (2, "")]
