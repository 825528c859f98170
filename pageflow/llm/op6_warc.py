"""Operator 6: WARC records in seekable Zstandard bundles.

A bundle is a row of independent Zstandard frames of about FRAME bytes of whole records, ended by the seek table of the
seekable format (a skippable frame with the sizes and checksum of every frame). An index table maps each record to its
bundle, frame and offset in that frame, so that one record is read by decompressing one frame.

Of the records whose payloads are equal (by SHA-1 and length) and have at least ``min_bytes`` bytes, the one with the
largest page_id is a response and the others are revisits that refer to it; smaller ones are all responses. Groups of
copies are aggregated before anything is shuffled, and only groups of two or more are joined back.

A null html is an empty payload. A null page_id is written as a record without a number and read back as null; it can
refer to another record, and if all ids of a group are null its records are all responses. Rows that repeat the largest
page_id are all responses. A null url has no target header. An empty table gives no bundles and an empty result. Only
the id, url and html columns are read. Memory: one frame and one batch.

Bundles are moved to their names when whole. A name holds the attempt that wrote it, and an index row names its bundle, so
a repeated or speculative attempt that sees its rows in another order never replaces a file that an index describes.
Reading back is one task for each bundle.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pageflow.llm.batches import portions
from pageflow.llm.files import file_size, read_range, write_whole
from pageflow.session import materialise, shared_dir, ship

#: Bytes of records in a frame and in a bundle, about; compression level.
FRAME, BUNDLE, LEVEL = 1 << 20, 1 << 28, 3

# Fixed values of the seekable format.
SKIPPABLE, SEEKABLE, WITH_CHECKSUM = 0x184D2A5E, 0x8F92EAB1, 0x80
ENTRY, FOOT = struct.Struct("<III"), struct.Struct("<IBI")
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
INDEX = "page_id long, bundle string, frame int, frame_start long, frame_bytes long, offset long, length long"
RECORDS = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(page_id: int | None) -> str:
    return f"<urn:x-page:{'' if page_id is None else page_id}>"


def page_of(record: str) -> int | None:
    number = record.rpartition(":")[2].rstrip(">")
    return int(number) if number else None


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """A response, or a revisit of refers_to, as WARC/1.1."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {record_id(page_id)}", "WARC-Date: 1970-01-01T00:00:00Z"]
    if url is not None:
        head.append("WARC-Target-URI: " + "".join(c if c > " " else f"%{ord(c):02X}" for c in url))
    if refers_to is not None:
        head += [f"WARC-Profile: {REVISIT}", f"WARC-Refers-To: {record_id(refers_to)}"]
    head += [f"WARC-Payload-Digest: sha1:{base32_sha1(payload)}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(data: bytes, at: int = 0) -> tuple[dict[str, str], bytes, bytes, int]:
    """Headers, HTTP header, payload and end of the record at an offset."""
    end = data.index(b"\r\n\r\n", at)
    lines = data[at:end].decode().split("\r\n")
    if lines[0] != "WARC/1.1":
        raise ValueError("no record begins here")
    head = dict(line.split(": ", 1) for line in lines[1:])
    block = data[end + 4 : (stop := end + 4 + int(head["Content-Length"]))]
    if data[stop : stop + 4] != b"\r\n\r\n":
        raise ValueError("a record's length is wrong")
    http, _, payload = block.partition(b"\r\n\r\n")
    return head, http, payload, stop + 4


def row_of(head: dict[str, str], http: bytes, payload: bytes) -> tuple[int | None, int, str, str, int | None]:
    """What a record says of its page; a response's payload is checked against its digest and length."""
    size = int(http.rpartition(b"Content-Length: ")[2])
    digest = head["WARC-Payload-Digest"].removeprefix("sha1:")
    if head["WARC-Type"] == "response" and (len(payload) != size or base32_sha1(payload) != digest):
        raise ValueError(f"the payload of {head['WARC-Record-ID']} is damaged")
    return page_of(head["WARC-Record-ID"]), size, digest, head["WARC-Type"], page_of(head["WARC-Refers-To"]) if "WARC-Refers-To" in head else None


def seek_table(frames: list[tuple[int, int, int]]) -> bytes:
    """frames: compressed size, size, checksum."""
    body = b"".join(ENTRY.pack(*f) for f in frames) + FOOT.pack(len(frames), WITH_CHECKSUM, SEEKABLE)
    return struct.pack("<II", SKIPPABLE, len(body)) + body


def read_seek_table(uri: str) -> list[tuple[int, int, int, int]]:
    """Start, compressed size, size and checksum of every frame."""
    total = file_size(uri)
    n, flags, magic = FOOT.unpack(read_range(uri, total - FOOT.size, FOOT.size))
    if magic != SEEKABLE or flags != WITH_CHECKSUM:
        raise ValueError("no seek table")
    entries = read_range(uri, total - FOOT.size - n * ENTRY.size, n * ENTRY.size)
    out, start = [], 0
    for packed, size, check in ENTRY.iter_unpack(entries):
        out.append((start, packed, size, check))
        start += packed
    return out


def read_frame(uri: str, start: int, packed: int) -> bytes:
    import zstandard

    return zstandard.ZstdDecompressor().decompress(read_range(uri, start, packed))


def read_one(uri: str, frame_start: int, frame_bytes: int, offset: int) -> tuple[dict[str, str], bytes, bytes]:
    """One record, by what the index says of it."""
    return parse(read_frame(uri, frame_start, frame_bytes), offset)[:3]


def bundle_parts(records: Iterator[tuple[int | None, bytes]], index: list[tuple]) -> Iterator[bytes]:
    """The parts of one bundle; index gets (page_id, frame, frame start, frame bytes, offset, length) of each record."""
    import xxhash
    import zstandard

    squeeze = zstandard.ZstdCompressor(level=LEVEL)
    frames: list[tuple[int, int, int]] = []
    start, held, size, own = 0, [], 0, []

    def flush() -> bytes:
        nonlocal start, held, size, own
        raw = b"".join(held)
        packed = squeeze.compress(raw)
        index.extend((page, len(frames), start, len(packed), offset, length) for page, offset, length in own)
        frames.append((len(packed), len(raw), xxhash.xxh64_intdigest(raw, 0) & 0xFFFFFFFF))
        start, held, size, own = start + len(packed), [], 0, []
        return packed

    for page, data in records:
        own.append((page, size, len(data)))
        held.append(data)
        size += len(data)
        if size >= FRAME:
            yield flush()
    if held:
        yield flush()
    yield seek_table(frames)


def decide(pages: DataFrame, min_bytes: int) -> DataFrame:
    """page_id, url, html and refers_to (null for responses)."""
    keyed = pages.withColumns({"sha": F.sha1(F.col("html").cast("binary")), "size": F.octet_length("html")})
    copies = keyed.where(F.col("size") >= min_bytes).groupBy("sha", "size").agg(F.max("page_id").alias("last"), F.count("*").alias("n")).where("n > 1 and last is not null").select("sha", "size", "last")
    # read back, its size is known, and Spark broadcasts it only under its threshold
    copies = materialise(copies, "op6-copies")
    found = keyed.join(copies, ["sha", "size"], "left")
    return found.select("page_id", "url", "html", F.when(~F.col("page_id").eqNullSafe(F.col("last")), F.col("last")).alias("refers_to"))


def write_warc(pages: DataFrame, min_bytes: int = 0, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Write the bundles; the index of their records."""
    spark = pages.sparkSession
    ship(spark)
    folder = f"{shared_dir(spark)}/op6-{uuid.uuid4().hex}"
    own = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.coalesce(F.col(html_col).cast("string"), F.lit("")).alias("html"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, attempt = TaskContext.get().partitionId(), TaskContext.get().taskAttemptId()
        rows = ((i, record(i, u, h.encode(), r)) for b in batches for p in portions(b, "html") for i, u, h, r in zip(*(p.column(c).to_pylist() for c in ("page_id", "url", "html", "refers_to"))))
        more = next(rows, None)
        number = 0
        while more is not None:

            def some(first=more):
                nonlocal more
                size, now = 0, first
                while now is not None and size < BUNDLE:
                    size += len(now[1])
                    yield now
                    now = next(rows, None)
                more = now

            index: list[tuple] = []
            path = f"{folder}/{part:08d}-{number:04d}-{attempt}.warc.zst"
            write_whole(path, bundle_parts(some(), index))
            number += 1
            page, frame, start, packed, offset, length = map(list, zip(*index))
            yield pa.RecordBatch.from_arrays([pa.array(page, pa.int64()), pa.array([path] * len(page)), pa.array(frame, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, packed, offset, length))], ["page_id", "bundle", "frame", "frame_start", "frame_bytes", "offset", "length"])

    return materialise(decide(own, min_bytes).mapInArrow(write, INDEX), "op6-index")


def read_warc(index: DataFrame) -> DataFrame:
    """Every record of the bundles of an index, read back and checked: page_id, payload_bytes, payload_digest, record_type, refers_to."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for batch in batches:
            for bundle in batch.column("bundle").to_pylist():
                for start, packed, size, check in read_seek_table(bundle):
                    data = read_frame(bundle, start, packed)
                    if len(data) != size or xxhash.xxh64_intdigest(data, 0) & 0xFFFFFFFF != check:
                        raise ValueError(f"a frame of {bundle} is damaged")
                    rows, at = [], 0
                    while at < len(data):
                        head, http, payload, at = parse(data, at)
                        rows.append(row_of(head, http, payload))
                    page, n, digest, kind, refers = map(list, zip(*rows))
                    yield pa.RecordBatch.from_arrays([pa.array(page, pa.int64()), pa.array(n, pa.int64()), pa.array(digest), pa.array(kind), pa.array(refers, pa.int64())], ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"])

    # a small row for each bundle; numbered, so that each has a partition of its own
    bundles = materialise(index.select("bundle").distinct().select("bundle", (F.row_number().over(Window.orderBy("bundle")) - 1).alias("n")), "op6-bundles")
    return bundles.repartitionById(max(1, bundles.count()), "n").select("bundle").mapInArrow(read, RECORDS)


#: The same by SQL; DuckDB has no base32, so the digest is cut in groups of five bits.
ORACLE = """
with p as (select page_id, coalesce(html, '') as html, sha1(coalesce(html, '')) as sha from pages),
g as (select sha, strlen(html) as size, max(page_id) as last from p group by all),
x as (select p.page_id, strlen(html) as payload_bytes, g.last,
             list_aggregate(list_transform(range(0, 32), lambda i:
               substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((
                 (('0x' || substr(p.sha || '000', 1 + (5 * i) // 4, 3))::bigint >> (12 - 5 - (5 * i) % 4)) & 31))::int, 1)), 'string_agg', '') as payload_digest
      from p join g on p.sha = g.sha and strlen(p.html) = g.size)
select page_id, payload_bytes, payload_digest,
       case when page_id is not distinct from last then 'response' else 'revisit' end as record_type,
       case when page_id is not distinct from last then null else last end as refers_to
from x
"""
