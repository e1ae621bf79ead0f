import base64
import gzip
import hashlib
import random

from concord.llm.warc import parse_record, read_warc, salvage, write_warc


def record(i, body, version=b"WARC/1.1"):
    digest = base64.b32encode(hashlib.sha1(body).digest())
    return (version + b"\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:x:%d>\r\nWARC-Block-Digest: sha1:%s\r\nContent-Length: %d\r\n\r\n"
            % (i, digest, len(body))) + body + b"\r\n\r\n"


def bodies(n, rng):
    return [bytes(rng.randrange(256) for _ in range(rng.randrange(200))) for _ in range(n)]


def check(data, starts, good, order):
    got = list(salvage(data))
    recs = [r["record_id"] for r in got if r["kind"] == "record"]
    assert recs == [f"urn:x:{i}" for i in order if i in good]
    at = 0
    for r in got:  # records and gaps cover the archive without overlap
        if r["offset"] != at:
            assert r["kind"] == "record" and r["offset"] < at  # same gzip member
        at = max(at, r["offset"] + r["length"])
    assert at == len(data)


def test_plain_and_gzip_with_damage():
    rng = random.Random(1)
    for zipped in (False, True):
        for _ in range(30):
            raw = [record(i, b, rng.choice([b"WARC/1.0", b"WARC/1.1"])) for i, b in enumerate(bodies(12, rng))]
            parts = [gzip.compress(r) if zipped else r for r in raw]
            broken = set(rng.sample(range(12), 3))
            for i in broken:
                p = bytearray(parts[i])
                how = rng.randrange(3)
                if how == 0:
                    p = p[:len(p) // 2]
                elif how == 1:
                    p[0] ^= 255
                else:
                    k = rng.randrange(20, len(p) - 12) if zipped else p.index(b"Length")
                    p[k] ^= 1 if not zipped else 255
                parts[i] = bytes(p)
            starts, data = [], b""
            for p in parts:
                starts.append(len(data))
                data += p
            check(data, starts, set(range(12)) - broken, range(12))


def test_body_that_looks_like_a_record():
    inner = record(99, b"inner")
    data = record(0, b"x" + inner + b"y") + b"junk\r\n" + record(1, b"z")
    got = list(salvage(data))
    assert [(r["kind"], r.get("record_id")) for r in got] == [("record", "urn:x:0"), ("gap", None), ("record", "urn:x:1")]
    assert got[1]["reason"] == "no version line" and got[1]["length"] == 6


def test_several_records_in_a_member_and_empty():
    data = gzip.compress(record(0, b"a") + record(1, b"b"))
    assert [r["record_id"] for r in salvage(data)] == ["urn:x:0", "urn:x:1"]
    assert list(salvage(b"")) == []
    assert [r["kind"] for r in salvage(b"\x00" * 10)] == ["gap"]
    assert parse_record(record(3, b""), 0)[0]["payload"] == b""


def test_damaged_members_of_several_records():
    rng = random.Random(4)
    raw = [record(i, rng.randbytes(30_000) if i % 2 else b"word " * 3000) for i in range(8)]
    after = gzip.compress(record(50, b"after"))
    rows = lambda data: [(r["kind"], r.get("record_id")) for r in salvage(data)]
    rec = lambda *ids, kind="record": [(kind, f"urn:x:{i}") for i in ids]
    doubt = lambda *ids: rec(*ids, kind="unverified")
    gap = [("gap", None)]

    bent = bytearray(raw[3])
    bent[-100] ^= 1
    inner = gzip.compress(b"".join(raw[:3] + [bytes(bent)] + raw[4:]))
    assert rows(inner + after) == rec(0, 1, 2) + gap + rec(4, 5, 6, 7, 50)
    got = [r for r in salvage(inner) if r["kind"] == "gap"][0]
    assert got["reason"].startswith("digest differs (inflated bytes ") and (got["offset"], got["length"]) == (0, len(inner))

    for level in (0, 6):  # stored blocks hold the version lines as they are
        whole = gzip.compress(b"".join(raw), level)
        short = gzip.compress(b"".join(raw[:5]), level)
        crc = bytearray(whole)
        crc[-6] ^= 255
        assert rows(bytes(crc) + after) == doubt(*range(8)) + gap + rec(50)
        assert rows(bytes(crc)) == doubt(*range(8)) + gap
        cut_at = len(short) + 2000
        got = rows(whole[:cut_at])
        assert got == rec(*range(len(got) - 1)) + gap and len(got) >= 5
        got = rows(whole[:cut_at] + after)
        assert got[-2:] == gap + rec(50) and [x for _, x in got[:4]] == [x for _, x in rec(0, 1, 2, 3)]
        for data in (bytes(crc) + after, whole[:cut_at] + after):  # rows cover the archive, those of one member together
            at = 0
            for r in salvage(data):
                assert r["offset"] in (0, at)
                at = r["offset"] + r["length"]
            assert at == len(data)


def test_round_trip(spark, tmp_path):
    rows = [(3, "http://a/ b\r\nX: y", "<p>é</p>", 1), (1, "u", "<p>é</p>", 1), (2, "u", "other\r\n\r\nWARC/1.1\r\n", 1), (7, None, None, 1),
            (8, "u", "", 1), (None, "u", "<p>é</p>", 1), (1, "u", "<p>é</p>", 1), (9, "u", "x" * 300_000, 1)]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string, digest int")
    write_warc(pages, str(tmp_path / "w"))
    out = read_warc(spark, str(tmp_path / "w"), payload=True).collect()
    assert all(r.kind == "record" for r in out) and len(out) == len(rows)
    want = []
    for p, _, h, _ in rows:
        b = (h or "").encode()
        same = [q for q, _, g, _ in rows if (g or "") == (h or "") and q is not None]
        again = p != min(same)
        want.append((str(p) if p is not None else "null", "revisit" if again else "response", len(b),
                     base64.b32encode(hashlib.sha1(b).digest()).decode(), str(min(same)) if again else None))
    got = [(r.record_id.split(":")[3], r.type, r.payload_bytes, r.payload_digest, r.refers_to.split(":")[3] if r.refers_to else None) for r in out]
    key = lambda t: tuple(map(str, t))
    assert sorted(got, key=key) == sorted(want, key=key)
    assert all(r.payload == b"" for r in out if r.type == "revisit")
    write_warc(pages.limit(0), str(tmp_path / "e"))
    assert read_warc(spark, str(tmp_path / "e")).count() == 0


def test_small_payloads_are_all_responses(spark, tmp_path):
    pages = spark.createDataFrame([(1, "u", "ab"), (2, "u", "ab"), (3, "u", "abc"), (4, "u", "abc")], "page_id int, url string, html string")
    write_warc(pages, str(tmp_path / "w"), least=3)
    assert sorted(r.type for r in read_warc(spark, str(tmp_path / "w")).collect()) == ["response"] * 3 + ["revisit"]


def test_other_header_forms_are_good_records():
    body = b"hello"
    hex_digest = hashlib.sha1(body).hexdigest().encode()
    folded = b"WARC/1.0\r\nWARC-Type: resource\r\nWARC-Record-ID:\r\n <urn:x:1>\r\nX-Note: a\r\n\tb\r\nContent-Length: 5\r\n\r\nhello\r\n\r\n"
    lf_only = b"WARC/1.0\nWARC-Type: resource\nWARC-Record-ID: <urn:x:2>\nContent-Length: 5\n\nhello\n\n"
    in_hex = b"WARC/1.1\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:x:3>\r\nWARC-Block-Digest: sha1:%s\r\nContent-Length: 5\r\n\r\nhello\r\n\r\n"
    wrong = in_hex % (hex_digest[:-1] + (b"0" if hex_digest[-1:] != b"0" else b"1"))
    data = folded + lf_only + in_hex % hex_digest + in_hex % hex_digest.upper() + wrong + record(4, body)
    got = list(salvage(data))
    assert [(r["kind"], r.get("record_id"), r.get("reason")) for r in got] == [
        ("record", "urn:x:1", None), ("record", "urn:x:2", None), ("record", "urn:x:3", None), ("record", "urn:x:3", None),
        ("gap", None, "digest differs"), ("record", "urn:x:4", None)]


def test_many_broken_members_take_linear_time():
    import time

    bad = bytearray(gzip.compress(record(0, b"x" * 40)))
    bad[20] ^= 255
    took = []
    for n in (20_000, 80_000):
        data = bytes(bad) * n + record(7, b"end")
        t = time.perf_counter()
        got = list(salvage(data))
        took.append(time.perf_counter() - t)
        assert [r["kind"] for r in got] == ["gap", "record"] and got[0]["length"] == len(bad) * n
    assert took[1] < 12 * took[0] + 1  # four times the data
    lines = b"WARC/1.0\r\nX: y\r\n" * 100_000 + b"\r\n\r\n" + record(8, b"end")
    t = time.perf_counter()
    assert [r.get("record_id") for r in salvage(lines)][-1] == "urn:x:8"
    assert time.perf_counter() - t < 30


def test_long_urls_and_odd_ids(spark, tmp_path):
    from concord.llm.warc import page_of
    from pyspark.sql import functions as F

    ids = ["null", None, "", "=null", "=", "a:b", "x\r\ny", "50%", "<z>", "plain"]
    rows = [(p, "http://x/" + ("u" * 1_500_000 if i == 0 else str(i)), f"html {i}") for i, p in enumerate(ids)]
    path = str(tmp_path / "odd")
    write_warc(spark.createDataFrame(rows, "page_id string, url string, html string"), path)
    got = read_warc(spark, path, payload=True).select("kind", page_of(F.col("record_id"), "string").alias("id"), "payload", "uri").collect()
    assert all(r.kind == "record" for r in got)
    assert sorted((r.id or "-NULL-" if r.id != "" else "", bytes(r.payload).decode()) for r in got) == sorted(
        (p if p is not None else "-NULL-", h) for p, _, h in rows)
    assert max(len(r.uri) for r in got) > 1_500_000


def test_files_are_bounded_by_their_bytes(spark, tmp_path, monkeypatch):
    import glob
    import os

    from concord.llm import warc

    monkeypatch.setattr(warc, "FILE_BYTES", 2 << 20)
    pages = spark.range(3000, numPartitions=1).selectExpr(
        "id page_id", "concat('u', id) url", "case when id >= 2900 then repeat(chr(65 + cast(id % 26 as int)), 200000) || id else concat('tiny', id) end html")
    path = str(tmp_path / "sizes")
    warc.write_warc(pages, path)
    sizes = [os.path.getsize(f) for f in glob.glob(path + "/part-*")]
    assert max(sizes) <= 2 << 20 and len(sizes) < 100
    assert read_warc(spark, path).where("kind = 'record'").count() == 3000
