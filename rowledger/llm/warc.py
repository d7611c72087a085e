"""WARC archives of pages: writing with revisits, chunked framing and segments; reading with segment reassembly.

Writing. Pages are stored once with a row number, the size of their payload and its SHA-1 and SHA-256. Of pages
with equal payloads (both digests, and the size at least ``least_bytes``) that with the smallest id is
a ``response``, the others are ``revisit`` records that refer to it and carry headers only. A
response's body is framed in chunks; a block longer than ``segment_bytes`` is cut into
segments: the first in the response record, the others in ``continuation`` records with
the origin's identifier and their number, the last with the total length. Records, made in
tasks, are written by Spark's own text writer with the two line ends that close a record, so a
lost task leaves nothing behind and any file system will do; segments are spread
over the files like other records.

Reading. Files are parsed by their lengths in the tasks. Records without segments need no
shuffle. Segments are grouped by origin, ordered by number, checked (numbers 1..k without a gap,
one total length, equal to the sum) and joined; then the HTTP header is split off, the
chunked framing decoded and the digest compared. What does not fit gives a status and no payload:
``missing segment``, ``conflicting segments``, ``wrong length``, ``bad chunk``, ``wrong digest``, ``bad header``; repeated
equal segments count once.

Revisits are joined with the responses they refer to; a response that very many refer to is one row of
that join, whose other side Spark may split.

Defined results: null html is an empty payload; with ``least_bytes`` 0 empty payloads
are deduplicated like others; of rows with equal ids and payloads one is the response; null
ids are written without an id, come after all others and refer like others; url may be null;
line ends in urls become spaces; other columns are not read; an empty table gives an empty result. A
payload is a value of one row, so it must fit in a task.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, table

#: Bytes of one chunk of a body, of one segment, and of one file before compression, headers aside.
CHUNK, SEGMENT, FILE = 8 << 10, 32 << 10, 64 << 20
#: Bytes that tasks hand on at once.
BATCH = 4 << 20
_CREATED = "2024-01-01T00:00:00Z"
_SPLIT = "\r\n\r\n"


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def base32_of_hex(digest: Column) -> Column:
    """Upper-case base32 of a SHA-1 in hexadecimal: 20 bits, five signs of one, are four signs of the other."""
    letters = F.lit("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")

    def letter(i: Column) -> Column:
        bits = F.conv(F.substring(digest, (F.floor(i / 4) * 5 + 1).cast("int"), F.lit(5)), 16, 2)
        five = F.substring(F.lpad(bits, 20, "0"), (i % 4 * 5 + 1).cast("int"), F.lit(5))
        return F.substring(letters, (F.conv(five, 2, 10).cast("int") + 1), F.lit(1))

    return F.array_join(F.transform(F.sequence(F.lit(0), F.lit(31)), letter), "")


def chunked(payload: bytes, size: int = CHUNK) -> bytes:
    """The payload in chunked transfer framing."""
    parts = [payload[i : i + size] for i in range(0, len(payload), size)]
    return b"".join(b"%x\r\n%b\r\n" % (len(p), p) for p in [*parts, b""])


_SIZE = re.compile(rb"([0-9A-Fa-f]+)[ \t]*(?:;[^\r\n]*)?\r\n")
_TRAILERS = re.compile(rb"(?:[^\r\n]+\r\n)*\r\n")


def unchunked(body: bytes) -> bytes | None:
    """The payload behind chunked transfer framing (extensions and trailers are skipped); None if the framing is broken."""
    out, at = [], 0
    while True:
        head = _SIZE.match(body, at)
        if not head:
            return None
        n, at = int(head[1], 16), head.end()
        if not n:
            return b"".join(out) if _TRAILERS.fullmatch(body, at) else None
        if body[at + n : at + n + 2] != b"\r\n":
            return None
        out.append(body[at : at + n])
        at += n + 2


def _record(headers: list[tuple[str, object]], block: bytes) -> bytes:
    lines = "".join(f"{k}: {v}\r\n" for k, v in headers if v is not None)
    return f"WARC/1.1\r\n{lines}Content-Length: {len(block)}\r\n\r\n".encode() + block


def records_of(row: int, name: str | None, url: str | None, payload: bytes, digest: str, refers: int | None, segment: int, chunk: int) -> Iterator[bytes]:
    """The records of one page: a response with its continuations, or a revisit."""
    origin = f"<urn:rowledger:record:{row}>"
    common = [("WARC-Date", _CREATED), ("WARC-Target-URI", None if url is None else re.sub(r"[\r\n]+", " ", url))]
    head = [("WARC-Type", "response" if refers is None else "revisit"), ("WARC-Record-ID", origin), *common]
    head += [("WARC-Payload-Digest", f"sha1:{digest}"), ("X-Page-Id", None if name is None else quote(name)), ("Content-Type", "application/http;msgtype=response")]
    status = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked" + _SPLIT
    if refers is not None:
        more = [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", f"<urn:rowledger:record:{refers}>")]
        yield _record(head + more, status.encode())
        return
    block = status.encode() + chunked(payload, chunk)
    parts = [block[i : i + segment] for i in range(0, len(block), segment)]
    if len(parts) == 1:
        yield _record(head, block)
        return
    yield _record([*head, ("WARC-Segment-Number", 1)], parts[0])
    for i, part in enumerate(parts[1:], 2):
        own = [("WARC-Type", "continuation"), ("WARC-Record-ID", f"<urn:rowledger:record:{row}:{i}>"), *common, ("WARC-Segment-Origin-ID", origin), ("WARC-Segment-Number", i)]
        yield _record([*own, *([("WARC-Segment-Total-Length", len(block))] if i == len(parts) else [])], part)


def write(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", least_bytes: int = 0, segment_bytes: int = SEGMENT, chunk_bytes: int = CHUNK, file_bytes: int = FILE, compression: str = "gzip") -> None:
    """Write a record for each row, and continuations, as WARC files below ``path``. Payloads are read once and stored once
    more before the archives; of them only digests are shuffled."""
    spark = pages.sparkSession
    payload = F.coalesce(F.col(payload_col).cast("binary"), F.lit(b""))
    stored = table(
        pages.select(F.col(id_col).alias("id"), F.col(url_col).cast("string").alias("url"), payload.alias("payload"))
        .select("*", F.monotonically_increasing_id().alias("row"), F.octet_length("payload").cast("long").alias("size"), F.sha1("payload").alias("sha1"), F.sha2("payload", 256).alias("sha2")),
        "pages", compression="zstd",
    )
    # null ids last: a struct orders nulls first
    first = F.min(F.struct(F.col("id").isNull(), "id", "row")).alias("first")
    same = stored.where(F.col("size") >= least_bytes).groupBy("sha1", "sha2", "size").agg(first, F.count(F.lit(1)).alias("copies")).where("copies > 1")
    same = table(same.select("sha1", "sha2", "size", F.col("first.row").alias("first_row")), "copies")
    joined = stored.join(same, ["sha1", "sha2", "size"], "left").withColumn("refers", F.when(F.col("first_row") != F.col("row"), F.col("first_row")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, held = [], 0
            for k in range(batch.num_rows):
                for r in records_of(*(c[k].as_py() for c in batch.columns), segment_bytes, chunk_bytes):
                    out.append(r)
                    held += len(r)
                if held > BATCH:
                    yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["record"])
                    out, held = [], 0
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["record"])

    # a revisit needs no payload
    sent = F.when(F.col("refers").isNull(), F.col("payload")).otherwise(F.lit(b""))
    records = joined.select("row", F.col("id").cast("string"), "url", sent.alias("payload"), base32_of_hex(F.col("sha1")).alias("digest"), "refers").mapInArrow(run, "record binary")
    options = {"lineSep": _SPLIT, "compression": compression, "maxRecordsPerFile": str(max(1, file_bytes // segment_bytes))}
    records.select(F.col("record").cast("string")).write.options(**options).text(path)
    discard(stored, same)


RECORD = "path string, offset long, type string, record_id string, origin_id string, segment_number int, total_length long, refers_to string, digest string, id string, url string, block binary"
_FIELDS = ("warc-type", "warc-record-id", "warc-segment-origin-id", "warc-segment-number", "warc-segment-total-length", "warc-refers-to", "warc-payload-digest", "x-page-id", "warc-target-uri")


def _parsed(data: bytes) -> Iterator[tuple]:
    """(offset, fields..., block) of each record of a file; one of type ``broken`` ends a file that is none from there on."""
    at = 0
    while at < len(data):
        end = data.find(b"\r\n\r\n", at)
        lines = data[at:end].decode("utf-8", "replace").split("\r\n") if end >= 0 else [""]
        fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
        length = fields.get("content-length", "")
        upto = end + 4 + int(length) if length.isdigit() else len(data)
        if not lines[0].startswith("WARC/") or data[upto : upto + 4] != b"\r\n\r\n":
            yield (at, "broken", *[None] * (len(_FIELDS) - 1), data[at : at + 200])
            return
        kind, record, origin, number, total, refers, digest, name, url = map(fields.get, _FIELDS)
        number, total = (int(x) if x and x.isdigit() else None for x in (number, total))
        digest = digest.removeprefix("sha1:") if digest else None
        yield at, kind, record, origin, number, total, refers, digest, None if name is None else unquote(name), url, data[end + 4 : upto]
        at = upto + 4


def read(spark: SparkSession, path: str) -> DataFrame:
    """The records of the archives below ``path``, plain or compressed with gzip (whole or by records), as ``RECORD``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.string(), pa.int64(), *[pa.string()] * 3, pa.int32(), pa.int64(), *[pa.string()] * 4, pa.binary()]
        names = [x.split(" ")[0] for x in RECORD.split(", ")]
        for batch in batches:
            for k in range(batch.num_rows):
                name, data = batch.column(0)[k].as_py(), batch.column(1)[k].as_py()
                rows, held = [], 0
                for r in _parsed(gzip.decompress(data) if data[:2] == b"\x1f\x8b" else data):
                    rows.append((name, *r))
                    held += len(r[-1])
                    if held > BATCH:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)
                        rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, RECORD)


def reassembled(segments: list[tuple[int, int | None, bytes]]) -> tuple[bytes | None, str]:
    """The block of (number, total length, bytes) segments, in any order, and a status."""
    by_number: dict[int, bytes] = {}
    for number, _, block in segments:
        if by_number.setdefault(number, block) != block:
            return None, "conflicting segments"
    totals = {t for _, t, _ in segments if t is not None}
    if len(totals) > 1:
        return None, "conflicting segments"
    if not totals or sorted(by_number) != list(range(1, len(by_number) + 1)):
        return None, "missing segment"
    block = b"".join(by_number[i] for i in sorted(by_number))
    return (block, "ok") if len(block) in totals else (None, "wrong length")


def payload_of(block: bytes, digest: str | None) -> tuple[bytes | None, str]:
    """The payload of an HTTP response block, and a status."""
    end = block.find(b"\r\n\r\n")
    if end < 0 or not block.startswith(b"HTTP/"):
        return None, "bad header"
    head, body = block[:end].decode("latin-1").lower().split("\r\n"), block[end + 4 :]
    if any(re.fullmatch(r"transfer-encoding:\s*chunked\s*", x) for x in head):
        body = unchunked(body)
        if body is None:
            return None, "bad chunk"
    return (body, "ok") if digest is None or base32_sha1(body) == digest else (None, "wrong digest")


def payloads(records: DataFrame, with_payload: bool = True) -> DataFrame:
    """(record_id, type, id, url, refers_to, declared, status, payload_bytes, digest, payload): a row for each response and
    revisit. Only segments are shuffled, by their origin. ``payload`` is null without ``with_payload``."""
    names = ["record_id", "type", "id", "url", "refers_to", "declared", "status", "payload_bytes", "digest", "payload"]
    kinds = [*[pa.string()] * 7, pa.int64(), pa.string(), pa.binary()]
    schema = ", ".join(f"{n} {'long' if n == 'payload_bytes' else 'binary' if n == 'payload' else 'string'}" for n in names)

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    def decoded(head: list, block: bytes | None, status: str) -> tuple:
        """``head``: record_id, type, id, url, refers_to, declared digest."""
        payload = None
        if head[1] == "revisit":
            return *head, status, None, None, None
        if block is not None:
            payload, status = payload_of(block, head[5])
        if payload is None:
            return *head, status, None, None, None
        return *head, status, len(payload), base32_sha1(payload), payload if with_payload else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Columns: the head, then either one block or lists of numbers, totals and blocks."""
        for batch in batches:
            rows, held = [], 0
            for k in range(batch.num_rows):
                *head, last = (c[k].as_py() for c in batch.columns)
                block, status = (last, "ok") if isinstance(last, bytes) else reassembled([(s["segment_number"], s["total_length"], s["block"]) for s in last])
                rows.append(decoded(head, block, status))
                held += len(rows[-1][-1] or b"")
                if held > BATCH:
                    yield batch_of(rows)
                    rows, held = [], 0
            if rows:
                yield batch_of(rows)

    head = ["record_id", "type", "id", "url", "refers_to", "digest"]
    some = records.where(F.col("type").isin("response", "revisit", "continuation"))
    whole = some.where("segment_number IS NULL AND type <> 'continuation'").select(*head, "block")
    origin = F.when(F.col("type") == "continuation", F.col("origin_id")).otherwise(F.col("record_id"))
    # a segment's number orders it; the first has the head
    first = [F.max(F.when(F.col("type") != "continuation", F.col(c))).alias(c) for c in head[1:]]
    parts = some.where("segment_number IS NOT NULL").groupBy(origin.alias("record_id")).agg(*first, F.collect_list(F.struct("segment_number", "total_length", "block")).alias("segments"))
    return whole.mapInArrow(run, schema).unionByName(parts.select(*head, "segments").mapInArrow(run, schema))


def resolved(found: DataFrame) -> DataFrame:
    """Adds to ``payloads``' rows what revisits refer to: their size and digest, and ``refers_to_id``. Revisits of what is
    not there, or of another digest, say so in their status."""
    told = found.where("type = 'response'").select(F.col("record_id").alias("of"), F.col("id").alias("refers_to_id"), F.col("payload_bytes").alias("b"), F.col("digest").alias("d"))
    out = found.join(told, (F.col("type") == "revisit") & (F.col("refers_to") == F.col("of")), "left")
    revisit = F.col("type") == "revisit"
    wrong = F.when(F.col("d").isNull(), "missing response").when(F.col("declared") != F.col("d"), "wrong digest").otherwise("ok")
    good = revisit & (wrong == "ok")
    return out.withColumns({
        "status": F.when(revisit, wrong).otherwise(F.col("status")),
        "payload_bytes": F.when(good, F.col("b")).otherwise(F.col("payload_bytes")), "digest": F.when(good, F.col("d")).otherwise(F.col("digest")),
    }).drop("of", "b", "d")
