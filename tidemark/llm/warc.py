"""Web archives packed in ZIP files: a writer, and a reader that never unpacks them.

Writer: one ZIP file per partition (a new one after ``ZIP_BYTES``) with two stored
members, ``archive/data.warc.gz`` (every record a gzip member of its own) and
``indexes/index.jsonl`` (a line per record: offset, length, page).
Equal payloads of a size or more are written once as response; the others
become revisits of it. Names are unique per attempt, and only files listed by
tasks that succeeded are read, so a lost executor leaves nothing wrong behind.

Reader: the end records, the ZIP64 ones included, lead to the central directory,
that to the members' local headers. The index is read by range, cut into
blocks of neighbouring records, and each block is one range read in its own task.
The archives lie in the shared folder and are opened by URI.

Defined results: NULL html counts as empty. NULL page ids are allowed and rank last;
rows that repeat a page id are records of their own, and all that carry the smallest id are
responses. An empty table gives an empty result. Extra columns are not looked at.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import json
import struct
import uuid
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass
from datetime import UTC, datetime

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.session import checkpoint_dir, materialize
from tidemark.llm.columns import join_null_safe

ZIP_BYTES = 1 << 30
BLOCK_BYTES = 8 << 20
DATA, INDEX = "archive/data.warc.gz", "indexes/index.jsonl"
_DATE = "%Y-%m-%dT%H:%M:%SZ"
_ID = "urn:pageid:"


def _open_fs(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


def payload_digest(payload: bytes) -> str:
    """Bare upper-case base 32 SHA-1."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


# --- records ---------------------------------------------------------------------------------------------------------

def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool, date: str) -> bytes:
    """A WARC/1.1 response with its payload, or a revisit with the HTTP headers only."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    head = [
        "WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <{_ID}{'' if page_id is None else page_id}>",
        f"WARC-Date: {date}", f"WARC-Payload-Digest: sha1:{payload_digest(payload)}",
        "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}",
    ]
    if url:
        head.append("WARC-Target-URI: " + "".join(f"%{ord(c):02X}" if c in "\r\n" else c for c in url))
    if revisit:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <{_ID}{'' if refers_to is None else refers_to}>"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _headers(raw: bytes) -> dict[str, str]:
    return dict(line.split(": ", 1) for line in raw.decode("utf-8").split("\r\n")[1:])


def _page(urn: str | None) -> int | None:
    number = urn[len(_ID) + 1: -1] if urn else ""
    return int(number) if number else None


def parse(raw: bytes) -> dict:
    """One record back; the payload's digest and size are checked where it is there."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    h = _headers(head)
    block = rest[: int(h["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    size, digest = int(_headers(http)["Content-Length"]), h["WARC-Payload-Digest"].removeprefix("sha1:")
    kind = h["WARC-Type"]
    if kind == "response" and (len(payload) != size or payload_digest(payload) != digest):
        raise ValueError(f"payload of {h['WARC-Record-ID']} does not match its digest")
    return {
        "page_id": _page(h["WARC-Record-ID"]), "payload_bytes": size, "payload_digest": digest, "record_type": kind,
        "refers_to": _page(h.get("WARC-Refers-To")), "payload": payload if kind == "response" else None,
    }


# --- ZIP directories -------------------------------------------------------------------------------------------------

@dataclass(frozen=True)
class Member:
    name: str
    method: int
    start: int  # of the data, not of the local header
    size: int


def members(read, size: int) -> list[Member]:
    """Members of a ZIP file of ``size`` bytes; ``read(start, n)`` reads a range."""
    tail_at = max(0, size - (1 << 16) - 22)
    tail = read(tail_at, size - tail_at)
    end = tail.rfind(b"PK\x05\x06")
    if end < 0:
        raise ValueError("no end of central directory")
    entries, length, at = struct.unpack("<H2L", tail[end + 10: end + 20])
    if entries == 0xFFFF or length == 0xFFFFFFFF or at == 0xFFFFFFFF:
        locator = read(tail_at + end - 20, 20)
        if locator[:4] != b"PK\x06\x07":
            raise ValueError("no ZIP64 locator")
        wide = read(struct.unpack("<Q", locator[8:16])[0], 56)
        if wide[:4] != b"PK\x06\x06":
            raise ValueError("no ZIP64 end record")
        entries, length, at = struct.unpack("<3Q", wide[32:56])
    directory, out, p = read(at, length), [], 0
    for _ in range(entries):
        if directory[p: p + 4] != b"PK\x01\x02":
            raise ValueError("broken central directory")
        method, = struct.unpack("<H", directory[p + 10: p + 12])
        packed, plain, n_name, n_extra, n_comment = struct.unpack("<2L3H", directory[p + 20: p + 34])
        header, = struct.unpack("<L", directory[p + 42: p + 46])
        name = directory[p + 46: p + 46 + n_name].decode("utf-8")
        extra = directory[p + 46 + n_name: p + 46 + n_name + n_extra]
        while len(extra) >= 4:
            kind, n = struct.unpack("<2H", extra[:4])
            if kind == 1:
                # only what did not fit the 32-bit fields, in this order
                wide = iter(struct.unpack(f"<{n // 8}Q", extra[4: 4 + n // 8 * 8]))
                plain = next(wide) if plain == 0xFFFFFFFF else plain
                packed = next(wide) if packed == 0xFFFFFFFF else packed
                header = next(wide) if header == 0xFFFFFFFF else header
            extra = extra[4 + n:]
        local = read(header, 30)
        out.append(Member(name, method, header + 30 + sum(struct.unpack("<2H", local[26:30])), packed))
        p += 46 + n_name + n_extra + n_comment
    return out


# --- writing ---------------------------------------------------------------------------------------------------------

def roles(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """Pages that are revisits (``page_id``, ``digest``) with the response they refer to.

    Only page ids and digests travel; equal payloads are combined on the map side.
    """
    html = F.coalesce(F.col("html"), F.lit(""))
    marked = pages.where(F.octet_length(html) >= least_bytes).select("page_id", F.sha1(html).alias("digest"))
    groups = marked.groupBy("digest").agg(F.min("page_id").alias("refers_to"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    groups = materialize(groups)  # so that the join is a plain shuffle of both sides and a hot payload can be split
    return marked.join(groups, "digest").where(~F.col("page_id").eqNullSafe(F.col("refers_to"))).select("page_id", "digest", "refers_to").distinct()


def write(pages: DataFrame, folder: str, least_bytes: int = 0, zip_bytes: int = ZIP_BYTES) -> DataFrame:
    """Write the archives; a written table of their places (``path``, ``bytes``, ``records``)."""
    html = F.coalesce(F.col("html"), F.lit(""))
    # written, so that its size is known when the join is planned
    revisits = materialize(roles(pages, least_bytes)).select(F.col("page_id").alias("_page"), F.col("digest").alias("_digest"), "refers_to")
    rows = pages.select("page_id", "url", html.alias("html"))
    # few revisits (below Spark's own threshold) are sent to the pages; else both sides are shuffled
    rows = join_null_safe(rows.withColumn("digest", F.sha1("html")), revisits, {"page_id": "_page", "digest": "_digest"}, "left")
    date = datetime.now(UTC).strftime(_DATE)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = _open_fs(folder)
        fs.create_dir(root, recursive=True)
        rows = ((p.as_py(), u.as_py(), h.as_py().encode(), r.as_py(), v.as_py()) for b in batches for p, u, h, r, v in zip(*b.columns, strict=True))
        row = next(rows, None)
        while row:
            name = f"part-{uuid.uuid4().hex}.zip"
            index, at = [], 0
            with fs.open_output_stream(f"{root}/{name}") as out, zipfile.ZipFile(out, "w", zipfile.ZIP_STORED) as archive:
                with archive.open(DATA, "w", force_zip64=True) as data:
                    while row and (not at or at < zip_bytes):
                        page_id, url, payload, refers_to, revisit = row
                        raw = gzip.compress(record(page_id, url, payload, refers_to, revisit, date), mtime=0)
                        data.write(raw)
                        index.append(json.dumps({"offset": at, "length": len(raw), "page": page_id, "url": url}))
                        at += len(raw)
                        row = next(rows, None)
                archive.writestr(INDEX, "\n".join(index))
            size = fs.get_file_info(f"{root}/{name}").size
            yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([size], pa.int64()), pa.array([len(index)], pa.int64())], names=["path", "bytes", "records"])

    columns = rows.select("page_id", "url", "html", "refers_to", F.col("refers_to").isNotNull().alias("revisit"))
    return materialize(columns.mapInArrow(run, "path string, bytes long, records long"))


# --- reading ---------------------------------------------------------------------------------------------------------

def _reader(fs: pafs.FileSystem, path: str):
    source = fs.open_input_file(path)

    def read(start: int, n: int) -> bytes:
        source.seek(start)
        raw = source.read(n)
        if len(raw) != n:
            raise ValueError(f"{path} is cut off")
        return raw

    return read, source.size()


def blocks(archives: DataFrame, folder: str, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(``path``, ``start``, ``lengths``): runs of neighbouring records, from the archives' own indexes."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = _open_fs(folder)
        for batch in batches:
            for path in batch.column("path").to_pylist():
                read, size = _reader(fs, f"{root}/{path}")
                found = {m.name: m for m in members(read, size)}
                data, index = found[DATA], found[INDEX]
                if data.method or index.method:
                    raise ValueError(f"{path} has packed members")
                lengths: list[int] = []
                begin = held = 0
                for line in read(index.start, index.size).splitlines():
                    entry = json.loads(line)
                    if lengths and held + entry["length"] > block_bytes:
                        yield _block(path, data.start + begin, lengths)
                        lengths, begin, held = [], entry["offset"], 0
                    lengths.append(entry["length"])
                    held += entry["length"]
                if lengths:
                    yield _block(path, data.start + begin, lengths)

    return archives.select("path").mapInArrow(run, "path string, start long, lengths array<long>")


def _block(path: str, start: int, lengths: list[int]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([path]), pa.array([start], pa.int64()), pa.array([lengths], pa.list_(pa.int64()))], names=["path", "start", "lengths"])


def read(archives: DataFrame, folder: str, with_payload: bool = False, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """All records of the archives. ``payload`` of responses on request."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = _open_fs(folder)
        for batch in batches:
            for row in batch.to_pylist():
                get, _ = _reader(fs, f"{root}/{row['path']}")
                raw, at, found = get(row["start"], sum(row["lengths"])), 0, []
                for n in row["lengths"]:
                    found.append(parse(gzip.decompress(raw[at: at + n])))
                    at += n
                cols = {"page_id": pa.int64(), "payload_bytes": pa.int64(), "payload_digest": pa.string(), "record_type": pa.string(), "refers_to": pa.int64()}
                if with_payload:
                    cols["payload"] = pa.binary()
                yield pa.RecordBatch.from_arrays([pa.array([f[c] for f in found], t) for c, t in cols.items()], names=list(cols))

    schema = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long" + (", payload binary" if with_payload else "")
    # one row per block, dealt out evenly: a large archive is read by many tasks
    spread = materialize(blocks(archives, folder, block_bytes))
    n = max(archives.sparkSession.sparkContext.defaultParallelism, 1)
    return spread.repartition(max(n, -(-spread.count() // 4)), "path", "start").mapInArrow(run, schema)


def round_trip(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """Write all pages to new archives in the shared folder and read them back."""
    folder = f"{checkpoint_dir(pages.sparkSession)}/archives-{uuid.uuid4().hex}"
    return read(write(pages, folder, least_bytes), folder)
