"""WARC archives: a writer with revisit records, and reading that salvages.

The writer needs no Python: records are composed as strings and written by
Spark's text writer.  Files hold at most ``RECORDS_PER_FILE`` records and, by
classes of payload size, about ``FILE_BYTES``.  Whole files are read
as binary, plain or with gzip members.  Where a check fails (version line,
header, length, end of record, gzip data, payload digest) it logs the bytes as
a gap with the reason and goes on at the next place where a record or a member
can be read.  A record whose length and end mark are sound but whose payload
is not is one gap to its end: what looks like a record inside it is payload.
Of a damaged gzip member the records before the damage are recovered if their
payload digest holds; the whole member is logged as a gap.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .storage import written

LEAST_SHARED = 100
RECORDS_PER_FILE, FILE_BYTES = 2_000, 64_000_000
#: Greatest payloads of the classes that share files; larger ones have a file each.
CLASSES = (32_000, 1_000_000, 16_000_000)
#: Compressed bytes inflated at once, and at first.
_INFLATE, _FIRST = 65_536, 1_024
BROADCAST_DIGESTS = 500_000
_HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
_REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_URN = "urn:page:"


def _class(size: Column) -> Column:
    return reduce(lambda more, k: F.when(size <= CLASSES[k], k).otherwise(more), reversed(range(len(CLASSES))), F.lit(len(CLASSES)))


def _composed(pages: DataFrame, id_col: str, url_col: str, html_col: str, date: str) -> tuple[DataFrame, list[int]]:
    """``(record, class)`` and the classes of sizes that have rows."""
    html = F.coalesce(F.col(f"`{html_col}`"), F.lit(""))
    rows = pages.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{url_col}`").alias("url"), html.alias("html"), F.sha2(html, 256).alias("digest"), F.octet_length(html).cast("long").alias("bytes"))
    rows = rows.withColumn("class", _class(F.col("bytes")))
    classes = sorted(r[0] for r in rows.select("class").distinct().collect())  # at most one row for each class
    shared = written(rows.where(f"bytes >= {LEAST_SHARED}").groupBy("digest").agg(F.min("id").alias("first"), F.count("*").alias("n")).where("n > 1 and first is not null").select("digest", "first"))
    # The html is not shuffled while the repeated digests fit a broadcast.
    side = F.broadcast(shared) if shared.count() <= BROADCAST_DIGESTS else shared
    rows = rows.join(side, "digest", "left").withColumn("again", F.expr("first is not null and not first <=> id"))
    text = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    block = F.concat(F.lit(_HTTP), F.when(F.col("again"), F.lit("")).otherwise(F.col("html")))
    lines = [
        F.lit("WARC/1.1"),
        F.when(F.col("again"), F.lit("WARC-Type: revisit")).otherwise(F.lit("WARC-Type: response")),
        F.concat(F.lit(f"WARC-Record-ID: <{_URN}"), text(F.col("id")), F.lit(">")),
        F.lit(f"WARC-Date: {date}"),
        F.concat(F.lit("WARC-Target-URI: "), F.regexp_replace(F.col("url"), r"[\r\n]", "")),
        F.concat(F.lit("WARC-Payload-Digest: sha256:"), F.col("digest")),
        F.concat(F.lit("X-Payload-Length: "), F.col("bytes")),
        F.when(F.col("again"), F.concat(F.lit(f"WARC-Profile: {_REVISIT}\r\nWARC-Refers-To: <{_URN}"), text(F.col("first")), F.lit(">"))),
        F.lit("Content-Type: application/http;msgtype=response"),
        F.concat(F.lit("Content-Length: "), F.octet_length("block")),
    ]
    record = F.concat(F.concat_ws("\r\n", *lines), F.lit("\r\n\r\n"), F.col("block"), F.lit("\r\n\r"))
    return rows.withColumn("block", block).select(record.alias("record"), "class"), classes


def records(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """One WARC record a row, as ``record`` strings without the last line feed.

    Of rows with equal payloads of at least ``LEAST_SHARED`` bytes that with
    the smallest id is a response and the others revisit it; all other rows are
    responses.  Null html is an empty payload.  Rows that repeat the smallest
    id are responses too.  A null id is written as an empty one and is never
    revisited unless all ids of its payload are null (then all are responses).
    Other columns are ignored; an empty table gives no record.
    """
    return _composed(pages, id_col, url_col, html_col, date)[0].select("record")


def write_warc(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", date: str = "2024-01-01T00:00:00Z") -> None:
    """Write ``pages`` as WARC files below ``path``, a pass for each class of sizes that has rows."""
    rows, classes = _composed(pages, id_col, url_col, html_col, date)
    for k in classes or [0]:
        most = min(RECORDS_PER_FILE, FILE_BYTES // CLASSES[k]) if k < len(CLASSES) else 1
        rows.where(f"class = {k}").select("record").write.mode("append").option("lineSep", "\n").option("maxRecordsPerFile", most).text(path)


_VERSION = re.compile(rb"WARC/1\.[01]\r\n")
_HEADER_STOP = re.compile(rb"\r\n(?:\r\n|WARC/1\.[01]\r\n)")
_MAGIC = b"\x1f\x8b\x08"
#: Headers of which a record has one.
_ONCE = (b"warc-type", b"warc-record-id", b"content-length")


class _Scan:
    """Where things are in some bytes, asked at rising places: no byte is searched again for each false start."""

    def __init__(self, data: bytes):
        self.data = data
        self._next: dict[tuple, tuple[int, int]] = {}
        self._stop, self._stop_from = None, -1
        # Of the header block that ends at _block: its last line that is none, and place and value of each header that there is to be once.
        self._block, self._bad, self._once = -1, -1, {}

    def next(self, what: bytes, at: int, asked: int = 0) -> int:
        """The first place of ``what`` from ``at`` on; the end if there is none.  Askers of their own numbers ask at rising places each."""
        begin, found = self._next.get((what, asked), (0, -1))
        if not begin <= at <= found:
            found = self.data.find(what, at)
            found = len(self.data) if found < 0 else found
            self._next[what, asked] = at, found
        return found

    def member(self, at: int) -> int:
        """The next place from ``at`` on where a gzip member may begin; the end if there is none."""
        found = self.next(_MAGIC, at)
        while found < len(self.data) and not self.may_inflate(found):
            found = self.next(_MAGIC, found + 1)
        return found

    def may_inflate(self, at: int) -> bool:
        """Whether a gzip header is sound and data of a possible kind follow it; a member cut off in its header holds nothing."""
        data, begin = self.data, at + 10
        if begin >= len(data) or data[at + 3] & 0xE0:
            return False
        if flags := data[at + 3]:
            if flags & 4:
                begin += 2 + int.from_bytes(data[begin : begin + 2], "little")
            for bit in (8, 16):
                if flags & bit:
                    begin = self.next(b"\0", begin, bit) + 1
            begin += flags & 2
            if begin >= len(data):
                return False
        kind = data[begin] >> 1 & 3
        if kind == 0 and begin + 5 <= len(data):  # a stored block says its length twice, once inverted
            return data[begin + 1] ^ data[begin + 3] == 255 == data[begin + 2] ^ data[begin + 4]
        return kind != 3

    def stop(self, at: int) -> re.Match | None:
        """Where the header that begins at ``at`` ends, or runs into the next version line."""
        if self._stop_from < 0 or self._stop is not None and self._stop.start() < at:
            self._stop, self._stop_from = _HEADER_STOP.search(self.data, at), at
        return self._stop

    def header(self, at: int, end: int) -> str | tuple[dict, int]:
        """The headers of a record that begins at ``at``, and where its block ends; or why there are none."""
        data = self.data
        if self._block != end:
            self._block, self._bad, self._once = end, -1, {name: [] for name in _ONCE}
            place = data.find(b"\r\n", at, end + 2) + 2
            while place <= end:
                stop = data.find(b"\r\n", place, end + 2)
                name, colon, value = data[place:stop].partition(b":")
                if not colon:
                    self._bad = place
                elif (key := name.strip().lower()) in self._once:
                    self._once[key].append((place, value.strip()))
                place = stop + 2
        if self._bad > at:
            return "bad header line"
        if any(len(said) > 1 and said[-2][0] > at for said in self._once.values()):
            return "header runs into another"
        lengths = self._once[b"content-length"]
        if not lengths or lengths[-1][0] < at or not re.fullmatch(rb"[0-9]{1,18}", lengths[-1][1]):
            return "no content length"
        last = end + 4 + int(lengths[-1][1])
        if data[last : last + 4] != b"\r\n\r\n":
            return "record without end"
        headers = {}
        for line in data[at:end].split(b"\r\n")[1:]:
            name, _, value = line.partition(b":")
            headers[name.strip().lower().decode("latin-1")] = value.strip().decode("utf-8", "replace")
        return headers, last


def _record(scan: _Scan, at: int) -> tuple[dict, bytes, int] | str:
    """Headers, block and end of the record at ``at``, or why there is none."""
    if not _VERSION.match(scan.data, at):
        return "no version line"
    # A header of any length ends at its empty line; a version line before that is the next record's.
    stop = scan.stop(at)
    if not stop or stop[0] != b"\r\n\r\n":
        return "header without end"
    found = scan.header(at, stop.start())
    return found if isinstance(found, str) else (found[0], scan.data[stop.end() : found[1]], found[1] + 4)


def _checked(headers: dict, block: bytes) -> tuple[bytes, str]:
    """The payload, and what is wrong with it ("" if nothing)."""
    payload = block
    if headers.get("content-type", "").startswith("application/http"):
        head, gap, payload = block.partition(b"\r\n\r\n")
        if not gap:
            return b"", "block without HTTP header"
    said = headers.get("warc-payload-digest", "")
    if headers.get("warc-type") != "revisit" and said.startswith("sha256:") and said[7:] != hashlib.sha256(payload).hexdigest():
        return payload, "payload digest differs"
    return payload, ""


def salvage(data: bytes) -> Iterator[tuple[int, int, str, dict, bytes]]:
    """All of a file as (offset, length, reason, headers, payload); a reason makes it a gap of lost bytes.

    An empty file gives nothing.  Offsets and lengths are those in the file;
    a gap inside a gzip member has the member's, and a record recovered from a
    damaged member has the member's offset and length 0.
    """
    at, size, lost, why, scan = 0, len(data), -1, "", _Scan(data)
    while at < size:
        found, reason, end = [], "", at
        if data[at : at + 3] == _MAGIC:
            found, reason, end = _member(scan, at)
        else:
            got = _record(scan, at)
            if isinstance(got, str):
                reason = got
            else:
                payload, reason = _checked(got[0], got[1])
                end = got[2]
                found = [] if reason else [(at, end - at, "", got[0], payload)]
        if found:
            if lost >= 0:
                yield lost, at - lost, why, {}, b""
                lost = -1
            yield from found
        if found and end > at:
            at = end
            continue
        if lost < 0:
            lost, why = at, reason
        # A sound length and end mark bound what failed; else the next version line or member may be anywhere behind.
        after = end if end > at else at + 1
        at = min(scan.next(b"WARC/1.", after), scan.member(after))
    if lost >= 0:
        yield lost, size - lost, why, {}, b""


def _inflated(data: bytes, at: int) -> tuple[bytes, int, str]:
    """What the gzip member at ``at`` holds as far as it can be read, its end, and what is wrong with it."""
    inflate, view, out, begin = zlib.decompressobj(31), memoryview(data), [], at
    while begin < len(data) and not inflate.eof:
        # The first block is a small one: what is no member shows soon.
        first = begin == at
        before, block = None if first else inflate.copy(), view[begin : begin + (_FIRST if first else _INFLATE)]
        try:
            out.append(inflate.decompress(block))
        except zlib.error:
            before = before or zlib.decompressobj(31)
            # The same block again in ever smaller steps, to keep all before the damage.
            step = len(block)
            while step > 1 and len(block):
                step = max(1, step // 16)
                while len(block):
                    kept = before.copy()
                    try:
                        out.append(before.decompress(block[:step]))
                    except zlib.error:
                        before, block = kept, block[:step]
                        break
                    block = block[step:]
            return b"".join(out), at, "bad gzip data"
        begin += len(block)
    if not inflate.eof:
        return b"".join(out), at, "gzip member without end"
    return b"".join(out), begin - len(inflate.unused_data), ""


def _member(scan: _Scan, at: int) -> tuple[list, str, int]:
    """What the gzip member at ``at`` holds, why it can't be read, and its end (``at`` if damaged)."""
    if not scan.may_inflate(at):
        return [], "bad gzip data", at
    plain, end, reason = _inflated(scan.data, at)
    if reason:
        sound = [f for f in salvage(plain) if not f[2] and f[3].get("warc-type") != "revisit" and f[3].get("warc-payload-digest", "").startswith("sha256:")]
        return [(at, 0, "", headers, payload) for _, _, _, headers, payload in sound], reason, at
    return [(at, end - at, why, headers, payload) for _, _, why, headers, payload in salvage(plain)], "empty gzip member", end


READ = "path string, offset long, length long, kind string, reason string, record_type string, record_id string, target_uri string, refers_to string, payload_digest string, payload_bytes long, payload binary"


def read_warc(spark: SparkSession, path: str, with_payload: bool = True) -> DataFrame:
    """All records (kind ``record``) and lost bytes (kind ``gap``, with offset, length and reason) of the files at ``path``.

    Equal records are all returned; a folder of empty files gives no row.
    payload_digest and payload_bytes are those of the full payload; for a
    revisit, which carries none, they are read from its header.
    """
    schema = [f.name for f in spark.createDataFrame([], READ).schema]

    def row(name, offset, length, reason, h, payload):
        if reason:
            return (name, offset, length, "gap", reason, None, None, None, None, None, None, None)
        ref = lambda k: h[k].strip("<>") if k in h else None
        if h.get("warc-type") == "revisit":
            digest, size = h.get("warc-payload-digest", "").removeprefix("sha256:"), int(h.get("x-payload-length", 0))
        else:
            digest, size = hashlib.sha256(payload).hexdigest(), len(payload)
        return (name, offset, length, "record", None, h.get("warc-type"), ref("warc-record-id"), h.get("warc-target-uri"), ref("warc-refers-to"), digest, size, payload if with_payload else None)

    types = [pa.string(), pa.int64(), pa.int64(), *[pa.string()] * 7, pa.int64(), pa.binary()]

    def batch(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for given in batches:
            for name, data in zip(given.column(0).to_pylist(), given.column(1), strict=True):
                rows, held = [], 0
                for found in salvage(data.as_py()):
                    rows.append(row(name, *found))
                    held += len(found[4]) if with_payload else 0
                    if len(rows) >= 5_000 or held > 16_000_000:
                        yield batch(rows)
                        rows, held = [], 0
                if rows:
                    yield batch(rows)

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, READ)


def page_number(urn: str = "record_id"):
    """The page id in a record id column (null for an empty one)."""
    return F.nullif(F.substring(F.col(urn), len(_URN) + 1, 30), F.lit("")).cast("long")
