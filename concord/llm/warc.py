"""WARC archives: distributed writer with revisit records, and a salvage reader.

The writer is Spark's own text writer with the record separator of the format,
so archives are committed like any table and lie in any store that Spark
writes to. The reader checks every record (version line, header, length,
terminator, digest). After a failed check it looks for the next gzip member or
version line that passes the checks, goes on from there and logs the bytes
between as a quarantined gap. Plain archives and such of gzip members (one or
more records each) are read, also damaged in either way; a damaged member is
inflated as far as it goes and searched in the same way.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_batches, cut

EOL, END = "\r\n", "\r\n\r\n"
#: Payloads of at least so many bytes are written once; later copies become revisit records.
REVISIT_BYTES = 0
#: Bytes of an archive file at most, unless one record has more; a reader task holds one file.
FILE_BYTES = 32 << 20
#: Records are written by size, up to 2 ** (13, 16, ...) bytes of page and URL; what is left goes one to a file.
SIZES = (13, 16, 19, 22)
#: Bytes of a record's headers beside its URL, less than that.
HEAD_BYTES = 1024
#: Rows of the revisit table that are broadcast at most (about 100 bytes each); beyond, the join shuffles.
BROADCAST_ROWS = 200_000
DATE = "2000-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Bytes given to the decompressor at a time.
PIECE = 1 << 16
URN = "urn:concord:page:"

_VERSION = re.compile(rb"WARC/1\.[01]\r?\n")
_TERMINATOR = re.compile(rb"\r\n\r\n|\n\n")
_MAGIC = b"\x1f\x8b\x08"
#: Of a gzip member that has damaged bytes or a wrong checksum.
BAD = "bad gzip member"


def base32_sha1(payload: Column) -> Column:
    """Upper-case base32 SHA-1 of a binary column: five hex digits are four base32 digits."""
    digest = F.sha1(payload)
    parts = [F.lpad(F.conv(F.substring(digest, i * 5 + 1, 5), 16, 32), 4, "0") for i in range(8)]
    return F.translate(F.concat(*parts), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def revisits(pages: DataFrame, least: int = REVISIT_BYTES) -> DataFrame:
    """``(page_id, digest, first)``: pages whose payload a page of smaller id has too; one row per id and digest."""
    own = pages.where(F.col("n") >= least).select("page_id", "digest")
    first = own.groupBy("digest").agg(F.min("page_id").alias("first"), F.max("page_id").alias("last"),
                                      F.count_if(F.col("page_id").isNull()).alias("no_id"))
    first = first.where(F.col("first").isNotNull() & ((F.col("first") < F.col("last")) | (F.col("no_id") > 0))).select("digest", "first")
    return own.join(first, "digest").where(~F.col("page_id").eqNullSafe(F.col("first"))).distinct()


def write_warc(pages: DataFrame, path: str, least: int = REVISIT_BYTES) -> None:
    """Write a record for every row of ``pages (page_id, url, html)`` to a folder of archives.

    The payload is the html in UTF-8 (NULL: empty). Of equal payloads of at
    least ``least`` bytes the smallest page_id's is a response record, the
    others are revisit records that refer to it; rows without an id come last
    (if no row of a payload has an id, all are responses), rows repeated in
    full are the same kind of record each. Control characters and blanks in
    URLs are percent-encoded, a NULL URL is ``urn:none``. Other columns are
    ignored; an empty table gives a folder without records.
    """
    html = F.coalesce(F.col("html"), F.lit(""))
    src = pages.select("page_id", "url", html.alias("html"), F.octet_length(html).cast("long").alias("n"),
                       base32_sha1(html.cast("binary")).alias("digest"))
    again = cut(revisits(src, least)).select(F.col("page_id").alias("_p"), F.col("digest").alias("_d"), "first")
    if again.count() <= BROADCAST_ROWS:
        again = F.broadcast(again)
    rows = src.join(again, F.col("page_id").eqNullSafe(F.col("_p")) & (F.col("digest") == F.col("_d")), "left")

    def urn(page: Column) -> Column:
        return F.concat(F.lit("<" + URN), id_text(page), F.lit(":"), F.col("digest"), F.lit(">"))

    url = F.coalesce(F.col("url"), F.lit("urn:none"))
    for c in "\r\n\t ":
        url = F.replace(url, F.lit(c), F.lit(f"%{ord(c):02X}"))
    is_again = F.col("first").isNotNull()
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{EOL}Content-Type: text/html;charset=utf-8{EOL}Content-Length: "),
                    F.col("n").cast("string"), F.lit(END))
    block = F.when(is_again, http).otherwise(F.concat(http, F.col("html")))
    head = F.concat(
        F.lit(f"WARC/1.1{EOL}WARC-Type: "), F.when(is_again, F.lit("revisit")).otherwise(F.lit("response")),
        F.lit(f"{EOL}WARC-Record-ID: "), urn(F.col("page_id")),
        F.lit(f"{EOL}WARC-Date: {DATE}{EOL}WARC-Target-URI: "), url,
        F.when(is_again, F.concat(F.lit(f"{EOL}WARC-Profile: {PROFILE}{EOL}WARC-Refers-To: "), urn(F.col("first")))).otherwise(F.lit("")),
        F.lit(f"{EOL}WARC-Payload-Digest: sha1:"), F.col("digest"),
        F.lit(f"{EOL}Content-Type: application/http;msgtype=response{EOL}Content-Length: "),
        F.octet_length(block).cast("string"), F.lit(END))
    out = rows.select((F.col("n") + F.octet_length(url)).alias("size"), F.concat(head, block).alias("value"))
    sizes = src.select(_size_class(F.col("n") + F.octet_length(url)).alias("c")).distinct().collect()
    classes = sorted(r["c"] for r in sizes) or [0]
    for i, c in enumerate(classes):
        records = FILE_BYTES // ((1 << SIZES[c]) + HEAD_BYTES) if c < len(SIZES) else 1
        (out.where(_size_class(F.col("size")) == c).select("value").write.mode("append" if i else "overwrite")
         .option("lineSep", END).option("maxRecordsPerFile", max(1, records)).text(path))


def _size_class(size: Column) -> Column:
    """Place in SIZES of the smallest power that holds the size, and after them for what none holds."""
    out = F.lit(len(SIZES))
    for i, bits in reversed(list(enumerate(SIZES))):
        out = F.when(size <= 1 << bits, i).otherwise(out)
    return out


def id_text(page: Column) -> Column:
    """A page id as it stands in a record id: ``null`` for NULL, texts that could be taken for it marked by ``=``."""
    text = page.cast("string")
    for c in "%\r\n":
        text = F.replace(text, F.lit(c), F.lit(f"%{ord(c):02X}"))
    return F.when(text.isNull(), F.lit("null")).when(text.rlike("^=*(null)?$"), F.concat(F.lit("="), text)).otherwise(text)


class Broken(Exception):
    """A check that failed."""


def _header(data: bytes, at: int) -> tuple[dict[str, str], int]:
    """Fields of the header lines from ``at`` on, and the place after the empty line; raises Broken at the first bad line.

    Lines end with CR LF or LF alone; a line that begins with a blank or tab
    goes on with the field before. However long, a header is read line by line,
    so a version line inside it ends the reading.
    """
    head: dict[str, list[str]] = {}
    last: list[str] | None = None
    while True:
        stop = data.find(b"\n", at)
        if stop < 0:
            raise Broken("header does not end")
        line = data[at:stop].rstrip(b"\r")
        at = stop + 1
        if not line:
            return {k: " ".join(v).strip() for k, v in head.items()}, at
        text = line.decode("utf-8", "replace")
        if text[0] in " \t":
            if last is None:
                raise Broken("bad header line")
            last.append(text.strip())
            continue
        name, colon, value = text.partition(":")
        if not colon:
            raise Broken("bad header line")
        head[name.strip().lower()] = last = [value.strip()]


def _is_sha1(value: str, what: bytes) -> bool:
    """The digest as base32 or hexadecimal, whatever the case."""
    own = hashlib.sha1(what)
    return value.upper() == base64.b32encode(own.digest()).decode() or value.lower() == own.hexdigest()


def parse_record(data: bytes, at: int) -> tuple[dict, int]:
    """The record at ``at`` and the place after its terminator; raises Broken."""
    m = _VERSION.match(data, at)
    if not m:
        raise Broken("no version line")
    head, start = _header(data, m.end())
    size = head.get("content-length", "")
    if not (size.isascii() and size.isdigit()):
        raise Broken("bad length")
    end = start + int(size)
    if end + 2 > len(data):
        raise Broken("truncated")
    after = _TERMINATOR.match(data, end)
    if not after:
        raise Broken("truncated" if end + 4 > len(data) else "no terminator")
    block = data[start:end]
    payload, declared = block, None
    if head.get("content-type", "").lower().startswith("application/http"):
        http, found, payload = block.partition(b"\r\n\r\n")
        if not found:
            http, found, payload = block.partition(b"\n\n")
        if not found:
            raise Broken("http header does not end")
        n = re.search(rb"(?im)^content-length:\s*(\d+)\s*$", http.replace(b"\r\n", b"\n"))
        declared = int(n[1]) if n else None
    kind = head.get("warc-type", "")
    for name, what in (("warc-block-digest", block), ("warc-payload-digest", payload)):
        algo, _, value = head.get(name, "").partition(":")
        if algo == "sha1" and not (kind == "revisit" and name == "warc-payload-digest"):
            if not _is_sha1(value.strip(), what):
                raise Broken("digest differs")
    return {"type": kind, "record_id": head.get("warc-record-id", "").strip("<>"),
            "uri": head.get("warc-target-uri"), "refers_to": (head.get("warc-refers-to") or "").strip("<>") or None,
            "payload_digest": head.get("warc-payload-digest", "").partition(":")[2] or None,
            "payload_bytes": declared if kind == "revisit" and declared is not None else len(payload),
            "payload": payload}, after.end()


def _inflate(data: bytes, at: int) -> tuple[bytes, int, str]:
    """What the gzip member at ``at`` inflates to as far as it can be, the place after it, and what is wrong with it ('': nothing)."""
    z, parts, p = zlib.decompressobj(31), [], at
    while not z.eof and p < len(data):  # in pieces: what follows the member isn't copied
        before = z.copy()
        try:
            parts.append(z.decompress(data[p:p + PIECE]))
        except zlib.error:
            try:
                for i in range(p, min(p + PIECE, len(data))):  # the piece up to its bad byte
                    parts.append(before.decompress(data[i:i + 1]))
            except zlib.error:
                pass
            return b"".join(parts), p, BAD
        p += PIECE
    if not z.eof:
        return b"".join(parts), len(data), "truncated gzip member"
    return b"".join(parts), min(p, len(data)) - len(z.unused_data), ""


def _consumed(data: bytes, at: int, size: int) -> int:
    """The place up to which the gzip member at ``at`` is read for its first ``size`` inflated bytes."""
    z, p = zlib.decompressobj(31), at
    while size > 0 and p < len(data):
        piece, before = data[p:p + PIECE], z.copy()
        try:
            size -= len(z.decompress(piece, size))
            p += len(piece) - len(z.unconsumed_tail) - len(z.unused_data)
        except zlib.error:  # in what follows those bytes; they are from this piece
            while size > 0:
                size -= len(before.decompress(data[p:p + 1]))
                p += 1
    return p


def _member(data: bytes, at: int) -> tuple[list[dict], int, str]:
    """Records and inner gaps of the gzip member at ``at``, the place after it, and what is wrong with it ('': nothing).

    In a member that does not inflate to its end, the place is that after its
    last good record. Raises Broken where no record passes the checks.
    """
    plain, end, why = _inflate(data, at)
    out, p, good, bad, reason = [], 0, 0, None, ""
    while p < len(plain):
        try:
            rec, stop = parse_record(plain, p)
        except Broken as e:
            if bad is None:
                bad, reason = p, str(e)
            m = _VERSION.search(plain, p + 1)
            p = m.start() if m else len(plain)
            continue
        if bad is not None:
            out.append({"kind": "gap", "reason": f"{reason} (inflated bytes {bad} to {p})"})
            bad = None
        # a cut member's bytes are as they were written, those of one that does not inflate may not be
        out.append(rec | ({"kind": "unverified", "reason": why} if why == BAD else {"kind": "record"}))
        p = good = stop
    if not good and (why or bad is not None):
        raise Broken(why or reason)
    if why:
        return out, _consumed(data, at, good), why
    if bad is not None:
        out.append({"kind": "gap", "reason": f"{reason} (inflated bytes {bad} to {len(plain)})"})
    return out, end, ""


def salvage(data: bytes):
    """Records and gaps of an archive: dicts with offset, length and, for gaps, the reason of the failed check.

    Of a damaged gzip member every record that passes is given. What comes from
    one member shares its offset and length, gaps inside it too; their reason
    tells the inflated bytes. Records of a member with damaged bytes or a wrong
    checksum are of kind ``unverified``: digests cover their blocks, but nothing
    covers their headers, in which the damage may be.
    """
    at, bad, why = 0, None, ""
    next_start = _Starts(data)
    while at < len(data):
        wrong = ""
        try:
            if data.startswith(_MAGIC, at):
                found, end, wrong = _member(data, at)
            else:
                rec, end = parse_record(data, at)
                found = [rec | {"kind": "record"}]
        except Broken as e:
            if bad is None:
                bad, why = at, str(e)
            at = next_start(at + 1)
            continue
        if bad is not None:
            yield {"kind": "gap", "offset": bad, "length": at - bad, "reason": why}
            bad = None
        for row in found:
            yield row | {"offset": at, "length": end - at}
        at = end
        if wrong and at < len(data):
            bad, why = at, wrong
            at = next_start(at)
    if bad is not None:
        yield {"kind": "gap", "offset": bad, "length": len(data) - bad, "reason": why}


class _Starts:
    """Places of the next gzip magic or version line, or the end; asked for at ascending places, the whole data is searched once."""

    def __init__(self, data: bytes):
        self.data, self.line, self.magic = data, -1, -1

    def __call__(self, at: int) -> int:
        if self.line < at:
            m = _VERSION.search(self.data, at)
            self.line = m.start() if m else len(self.data)
        if self.magic < at:
            magic = self.data.find(_MAGIC, at)
            self.magic = magic if magic >= 0 else len(self.data)
        return min(self.line, self.magic)


COLUMNS = {"path": "string", "kind": "string", "offset": "bigint", "length": "bigint", "reason": "string", "type": "string",
           "record_id": "string", "uri": "string", "refers_to": "string", "payload_digest": "string", "payload_bytes": "bigint"}


def read_warc(spark: SparkSession, path: str, payload: bool = False) -> DataFrame:
    """Records and quarantined gaps of all archives under ``path``, one row each (``kind``: record, unverified or gap).

    ``payload`` adds the payload itself. A task holds one archive at a time; an
    empty archive gives no rows.
    """
    arrow_batches(spark)
    columns = COLUMNS | ({"payload": "binary"} if payload else {})

    def run(batches):
        for pdf in batches:
            for name, data in zip(pdf["path"], pdf["content"]):
                rows = []
                for r in salvage(bytes(data)):
                    rows.append(tuple(r.get(c) if c != "path" else name for c in columns))
                    if len(rows) >= 4096 or payload and len(rows) >= 64:
                        yield pd.DataFrame(rows, columns=list(columns)).astype({"payload_bytes": "Int64"})
                        rows = []
                yield pd.DataFrame(rows, columns=list(columns)).astype({"payload_bytes": "Int64"})

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "content")
    return files.mapInPandas(run, ", ".join(f"`{c}` {t}" for c, t in columns.items()))


def page_of(urn: Column, kind: str) -> Column:
    """The page_id in a record id, NULL where it has none."""
    text = F.regexp_extract(urn, f"(?s)^{URN}(.*):[A-Z2-7]{{32}}$", 1)
    plain = F.when(text.rlike("^=+(null)?$"), F.substring(text, F.lit(2), F.length(text))).otherwise(text)
    for c in "\n\r%":
        plain = F.replace(plain, F.lit(f"%{ord(c):02X}"), F.lit(c))
    return F.when(text.isin("null", ""), None).otherwise(plain).cast(kind)
