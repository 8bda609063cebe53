"""WARC archives: writing with segmented and revisit records, and reading with segment reassembly.

Writing: of pages with equal payloads that with the largest id is a `response`, the others are `revisit` records that
refer to it. A response's block is an HTTP message with chunked transfer framing; a block over SEGMENT_BYTES becomes
segments: a first record, and `continuation` records that name it as their origin.
Archives are a table in the shared folder (archive, seq, data): the rows of an archive, in order of seq, are its file's
bytes, each a whole record, so any Spark store holds them.

Reading: records are parsed; those in segments are grouped by origin identifier, ordered by segment number, checked for
gaps and against the total length, and joined; then the HTTP head is cut off and the chunks are decoded; the payload's
digest is compared with the header's.

Defined cases: a null or empty page has an empty payload (equal to other empty ones); repeated rows are equal payloads,
each with a record and a record id of its own; a null page id is left out of the headers; an empty table gives no record. Damaged records raise an error.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomspark.llm import bytetext as B
from loomspark.llm.frames import arrow, numbered
from loomspark.plans.shared import saved

SEGMENT_BYTES = 32_768
CHUNK_BYTES = 4096
#: Pages with repeated payloads that may be broadcast (about 60 bytes each).
BROADCAST_ROLES = 200_000
_DATE = "2024-01-01T00:00:00Z"


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(row: int, segment: int = 1) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_OID, f'{row}/{segment}')}>"


def _page(name: str, page_id: int | None) -> dict[str, str]:
    return {} if page_id is None else {name: str(page_id)}


def chunked(payload: bytes, size: int = CHUNK_BYTES) -> bytes:
    out = [b"%x\r\n%b\r\n" % (len(part), part) for part in (payload[i : i + size] for i in range(0, len(payload), size))]
    return b"".join(out) + b"0\r\n\r\n"


def dechunked(body: bytes) -> bytes:
    out, at = [], 0
    while True:
        end = body.index(b"\r\n", at)
        size = int(body[at:end].split(b";")[0], 16)
        at = end + 2
        if not size:
            return b"".join(out)
        if body[at + size : at + size + 2] != b"\r\n":
            raise ValueError("a chunk's frame is broken")
        out.append(body[at : at + size])
        at += size + 2


def record(kind: str, rid: str, headers: dict[str, str], block: bytes) -> bytes:
    head = {"WARC-Type": kind, "WARC-Record-ID": rid, "WARC-Date": _DATE, **headers, "Content-Length": str(len(block))}
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head.items()).encode() + b"\r\n" + block + b"\r\n\r\n"


def response_records(row: int, page_id: int | None, url: str, payload: bytes, payload_digest: str, segment_bytes: int = SEGMENT_BYTES) -> list[bytes]:
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n" + chunked(payload)
    about = {"WARC-Target-URI": url, "WARC-Payload-Digest": f"sha1:{payload_digest}", **_page("X-Page-ID", page_id), "Content-Type": "application/http;msgtype=response"}
    parts = [block[i : i + segment_bytes] for i in range(0, len(block), segment_bytes)]
    if len(parts) == 1:
        return [record("response", record_id(row), about, block)]
    out = [record("response", record_id(row), about | {"WARC-Segment-Number": "1"}, parts[0])]
    for k, part in enumerate(parts[1:], 2):
        more = {"WARC-Segment-Number": str(k), "WARC-Segment-Origin-ID": record_id(row)}
        if k == len(parts):
            more["WARC-Segment-Total-Length"] = str(len(block))
        out.append(record("continuation", record_id(row, k), more, part))
    return out


def revisit_record(row: int, page_id: int | None, url: str, size: int, payload_digest: str, refers_to: int, refers_to_page: int | None) -> bytes:
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    about = {"WARC-Target-URI": url, "WARC-Payload-Digest": f"sha1:{payload_digest}", **_page("X-Page-ID", page_id), "WARC-Refers-To": record_id(refers_to), **_page("X-Refers-To-Page-ID", refers_to_page), "WARC-Profile": "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"}
    return record("revisit", record_id(row), about, block)


def parse(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers (names in lower case) and block of each record."""
    at = 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        lines = data[at:end].decode().split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError("not a WARC record")
        head = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
        size = int(head["content-length"])
        if data[end + 4 + size : end + 8 + size] != b"\r\n\r\n":
            raise ValueError("a record is cut off")
        yield head, data[end + 4 : end + 4 + size]
        at = end + 8 + size


def http_payload(block: bytes) -> bytes:
    head, _, body = block.partition(b"\r\n\r\n")
    return dechunked(body) if b"\r\ntransfer-encoding: chunked" in head.lower() else body


def reassemble(parts: list[tuple[int, int | None, bytes]]) -> bytes:
    """parts: segment number, total length (None but for the last), block."""
    parts = sorted(parts, key=lambda p: p[0])
    if [p[0] for p in parts] != list(range(1, len(parts) + 1)) or parts[-1][1] is None:
        raise ValueError("a segment is missing or repeated")
    block = b"".join(p[2] for p in parts)
    if len(block) != parts[-1][1]:
        raise ValueError(f"segments have {len(block)} bytes, not {parts[-1][1]}")
    return block


def write_archives(pages: DataFrame, text: str = "html", id: str = "page_id", url: str = "url", segment_bytes: int = SEGMENT_BYTES) -> DataFrame:
    """The archive table of pages, written."""
    rows = pages.select(F.col(id).cast("long").alias("page_id"), F.coalesce(F.col(url).cast("string"), F.lit("")).alias("url"), F.coalesce(F.col(text).cast("string"), F.lit("")).cast("binary").alias("body"))
    rows = numbered(rows, "page_id", "row")[0].withColumn("sha", F.sha1("body"))
    winners = rows.groupBy("sha").agg(F.max(F.struct("page_id", "row")).alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    # ids and digests of repeated payloads; few are broadcast, else texts are shuffled by row, never by payload
    roles = saved(rows.select("row", "sha").join(winners, "sha").select("row", F.col("first.row").alias("first"), F.col("first.page_id").alias("first_page")), "roles")
    repeated = rows.join(F.broadcast(roles) if roles.count() <= BROADCAST_ROLES else roles, "row", "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seq = 0
        for b in batches:
            archive, out = b["archive"].to_pylist(), []
            for row, page, link, body, sha, first, first_page in zip(*(b[c].to_pylist() for c in ("row", "page_id", "url", "body", "sha", "first", "first_page")), strict=True):
                named = base64.b32encode(bytes.fromhex(sha)).decode()
                link = link.replace("\r", "%0D").replace("\n", "%0A")
                out += response_records(row, page, link, body, named, segment_bytes) if first is None or first == row else [revisit_record(row, page, link, len(body), named, first, first_page)]
            yield pa.RecordBatch.from_arrays([pa.array(archive[:1] * len(out), pa.int32()), pa.array(range(seq, seq + len(out)), pa.int64()), pa.array(out, pa.binary())], ["archive", "seq", "data"])
            seq += len(out)

    rows = repeated.select("row", "page_id", "url", "body", "sha", "first", "first_page", F.spark_partition_id().alias("archive"))
    return saved(arrow(rows, run, "archive int, seq long, data binary"), "archives")


def read_archives(archives: DataFrame, data: str = "data") -> DataFrame:
    """page_id, record_type, payload (null for revisits), payload_bytes, payload_digest, refers_to of every record but continuations."""

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[tuple] = []
            for raw in B.texts_of(b["data"]):
                for h, block in parse(raw):
                    number = int(h.get("warc-segment-number", 0))
                    origin = h.get("warc-segment-origin-id", h["warc-record-id"]) if number else None
                    total = int(h["warc-segment-total-length"]) if "warc-segment-total-length" in h else None
                    page, refers = h.get("x-page-id"), h.get("x-refers-to-page-id")
                    out.append((h["warc-type"], origin, number, total, page and int(page), h.get("warc-payload-digest", "").removeprefix("sha1:"), refers and int(refers), block))
            types = [pa.string(), pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.binary()]
            cols = list(zip(*out, strict=True)) if out else [()] * 8
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(cols, types, strict=True)], names)

    names = ["record_type", "origin", "number", "total", "page_id", "digest", "refers_to", "block"]
    records = arrow(archives.select(F.col(data).alias("data")), split, "record_type string, origin string, number int, total long, page_id long, digest string, refers_to long, block binary")

    def finish(rows: list[dict]) -> tuple:
        first = min(rows, key=lambda r: r["number"])
        block = first["block"] if not first["number"] else reassemble([(r["number"], r["total"], r["block"]) for r in rows])
        if first["record_type"] == "revisit":
            size = next(int(x.split(b":")[1]) for x in block.split(b"\r\n") if x.lower().startswith(b"content-length:"))
            return first["page_id"], "revisit", None, size, first["digest"], first["refers_to"]
        payload = http_payload(block)
        found = digest(payload)
        if found != first["digest"]:
            raise ValueError(f"page {first['page_id']}: its payload has digest {found}, not {first['digest']}")
        return first["page_id"], first["record_type"], payload, len(payload), found, None

    def batch(out: list[tuple]) -> pa.RecordBatch:
        types = [pa.int64(), pa.string(), pa.binary(), pa.int64(), pa.string(), pa.int64()]
        cols = list(zip(*out, strict=True)) if out else [()] * 6
        return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(cols, types, strict=True)], ["page_id", "record_type", "payload", "payload_bytes", "payload_digest", "refers_to"])

    def alone(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield batch([finish([r]) for r in b.to_pylist()])

    def grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []
        for b in batches:
            out = []
            for r in b.to_pylist():
                if held and held[0]["origin"] != r["origin"]:
                    out.append(finish(held))
                    held = []
                held.append(r)
            yield batch(out)
        if held:
            yield batch([finish(held)])

    schema = "page_id long, record_type string, payload binary, payload_bytes long, payload_digest string, refers_to long"
    whole = arrow(records.where("number = 0"), alone, schema)
    segments = records.where("number > 0").repartition("origin").sortWithinPartitions("origin", "number")
    return whole.unionByName(arrow(segments, grouped, schema))
