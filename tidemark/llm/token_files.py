"""Token ids as binary files of byte or bit planes.

Documents are range-partitioned by id, tokenised where they land, and their ids
(each document followed by the end id) run through one file after the other in
ascending order of the document ids. A file is a row of blocks of ``BLOCK`` ids;
the last one may be shorter. A block is transposed: byte ``k`` of all its ids makes
plane ``k`` (with ``planes="bit"``, bit ``k``), every plane is compressed with zstandard
on its own, and planes above the highest one in use are not stored.
After the blocks come the chunk index (ids, checksum and plane sizes of every block),
the document index (ids and lengths, as byte planes), and a footer with their places.

Any range of ids is read by fetching the blocks that it touches. A reader of whole
files holds one block at a time, however long a document is. File names are unique
per attempt and only those that successful tasks report are read, so a lost executor
leaves nothing wrong behind. The files lie in a folder that all executors share.

Defined results: NULL text counts as empty, a document of the end id alone. NULL
document ids come last; rows that share an id are documents of their own, ordered by a
hash of the text, equal ones by nothing that shows. An empty table gives no files and
an empty result. Extra columns are not looked at.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.functions.session import checkpoint_dir, materialize
from tidemark.llm.tokens import Tokens

#: ids in a block; a multiple of eight, so that bit planes have whole bytes
BLOCK = 1 << 16
#: a new file is begun after so many ids or documents
FILE_IDS, FILE_DOCS = 1 << 26, 1 << 20
END = 0
LEVEL = 3
MAGIC = b"IDPLANE1"
_FOOTER = struct.Struct("<QQQQBxxx8s")
_KINDS = ("bit", "byte")


@lru_cache(maxsize=4)
def _tokens(path: str) -> Tokens:
    return Tokens(path, literal=False)


def _open_fs(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


# --- planes ----------------------------------------------------------------------------------------------------------

def to_planes(values: np.ndarray, kind: str = "bit") -> list[bytes]:
    """Planes of unsigned integers, lowest first, up to the highest one that is not all zero."""
    used = int(values.max()).bit_length() if len(values) else 0
    raw = values.view(np.uint8).reshape(len(values), values.itemsize)
    if kind == "byte":
        return [raw[:, k].tobytes() for k in range(-(-used // 8))]
    bits = np.unpackbits(raw[:, : -(-used // 8)], axis=1, count=used, bitorder="little")
    return [p.tobytes() for p in np.packbits(bits.T, axis=1, bitorder="little")]


def from_planes(planes: list[bytes], count: int, kind: str = "bit", dtype: str = "<u4") -> np.ndarray:
    out = np.zeros((count, np.dtype(dtype).itemsize), np.uint8)
    if planes and kind == "byte":
        out[:, : len(planes)] = np.frombuffer(b"".join(planes), np.uint8).reshape(len(planes), count).T
    elif planes:
        packed = np.frombuffer(b"".join(planes), np.uint8).reshape(len(planes), -1)
        bits = np.unpackbits(packed, axis=1, count=count, bitorder="little").T
        out[:, : -(-len(planes) // 8)] = np.packbits(bits, axis=1, bitorder="little")
    return out.reshape(-1).view(dtype)


def _squeeze(values: np.ndarray) -> bytes:
    """An index array: its length and compressed byte planes."""
    planes = [zstandard.ZstdCompressor(level=LEVEL).compress(p) for p in to_planes(np.ascontiguousarray(values, "<u8"), "byte")]
    return struct.pack(f"<QB{len(planes)}Q", len(values), len(planes), *map(len, planes)) + b"".join(planes)


def _expand(raw: bytes, at: int) -> tuple[np.ndarray, int]:
    count, n = struct.unpack_from("<QB", raw, at)
    sizes = struct.unpack_from(f"<{n}Q", raw, at + 9)
    at += 9 + 8 * n
    planes = []
    for size in sizes:
        planes.append(zstandard.ZstdDecompressor().decompress(raw[at: at + size]))
        at += size
    return from_planes(planes, count, "byte", "<u8"), at


# --- one file --------------------------------------------------------------------------------------------------------

class Writer:
    """Blocks as they fill up; both indexes and the footer when closed."""

    def __init__(self, out, block: int = BLOCK, kind: str = "bit"):
        if block % 8:
            raise ValueError("a block must be a multiple of eight ids")
        self.out, self.block, self.kind = out, block, kind
        self.held: list[np.ndarray] = []
        self.waiting = self.n_ids = self.n_docs = 0
        self.counts: list[int] = []
        self.checks: list[int] = []
        self.sizes: list[list[int]] = []
        self.docs: list[np.ndarray] = []
        self.lengths: list[np.ndarray] = []
        self.known: list[np.ndarray] = []
        self.at = out.write(MAGIC)

    def add(self, doc_ids: pa.Array, lengths: np.ndarray, ids: np.ndarray) -> None:
        """Whole documents: their ids one after the other."""
        self.docs.append(doc_ids.cast(pa.int64()).fill_null(0).to_numpy(zero_copy_only=False).view(np.uint64))
        self.known.append(doc_ids.is_valid().to_numpy(zero_copy_only=False).astype(np.uint64))
        self.lengths.append(lengths.astype(np.uint64))
        self.n_docs += len(lengths)
        self.n_ids += len(ids)
        self.held.append(ids.astype("<u4"))
        self.waiting += len(ids)
        if self.waiting >= self.block:
            flat = np.concatenate(self.held)
            whole = len(flat) // self.block * self.block
            for lo in range(0, whole, self.block):
                self._put(flat[lo: lo + self.block])
            self.held, self.waiting = [flat[whole:]], len(flat) - whole

    def _put(self, ids: np.ndarray) -> None:
        planes = [zstandard.ZstdCompressor(level=LEVEL).compress(p) for p in to_planes(ids, self.kind)]
        self.counts.append(len(ids))
        self.checks.append(zlib.crc32(ids))
        self.sizes.append([len(p) for p in planes])
        self.at += self.out.write(b"".join(planes)) if planes else 0

    def close(self) -> None:
        rest = np.concatenate(self.held) if self.held else np.zeros(0, "<u4")
        if len(rest):
            self._put(rest)
        flat = [s for sizes in self.sizes for s in sizes]
        chunk_index = b"".join(_squeeze(np.array(a, np.uint64)) for a in (self.counts, self.checks, [len(s) for s in self.sizes], flat))
        doc_index = b"".join(_squeeze(np.concatenate([np.zeros(0, np.uint64), *a])) for a in (self.docs, self.known, self.lengths))
        self.out.write(chunk_index)
        self.out.write(doc_index)
        self.out.write(_FOOTER.pack(self.at, len(chunk_index), len(doc_index), self.n_ids, _KINDS.index(self.kind), MAGIC))
        self.at += len(chunk_index) + len(doc_index) + _FOOTER.size


class Reader:
    """Blocks and indexes of one file, by range reads."""

    def __init__(self, source):
        self.source = source
        tail = source.read_at(_FOOTER.size, source.size() - _FOOTER.size)
        at, chunk_size, self._doc_size, self.n_ids, kind, magic = _FOOTER.unpack(tail)
        if magic != MAGIC:
            raise ValueError("not a file of id planes")
        self.kind, self._doc_at = _KINDS[kind], at + chunk_size
        raw = source.read_at(chunk_size, at)
        arrays, p = [], 0
        for _ in range(4):
            values, p = _expand(raw, p)
            arrays.append(values.astype(np.int64))
        self.counts, self.checks, planes, sizes = arrays
        self._first = np.append(0, np.cumsum(planes))
        self._sizes = sizes
        self._at = len(MAGIC) + np.append(0, np.cumsum(sizes))
        self.ends = np.cumsum(self.counts)

    def block(self, k: int) -> np.ndarray:
        lo, hi = int(self._first[k]), int(self._first[k + 1])
        raw = self.source.read_at(int(self._at[hi] - self._at[lo]), int(self._at[lo]))
        planes, p = [], 0
        for size in self._sizes[lo:hi].tolist():
            planes.append(zstandard.ZstdDecompressor().decompress(raw[p: p + size]))
            p += size
        ids = from_planes(planes, int(self.counts[k]), self.kind)
        if zlib.crc32(ids) != self.checks[k]:
            raise ValueError(f"block {k} does not match its checksum")
        return ids

    def blocks(self) -> Iterator[np.ndarray]:
        for k in range(len(self.counts)):
            yield self.block(k)

    def read(self, start: int, count: int) -> np.ndarray:
        """Ids ``start`` to ``start + count`` of the file, from the blocks that hold them."""
        stop = min(start + count, self.n_ids)
        if stop <= start:
            return np.zeros(0, "<u4")
        lo, hi = np.searchsorted(self.ends, [start, stop - 1], "right")
        flat = np.concatenate([self.block(k) for k in range(lo, hi + 1)])
        skip = start - int(self.ends[lo] - self.counts[lo])
        return flat[skip: skip + stop - start]

    def documents(self) -> tuple[pa.Array, np.ndarray]:
        """Document ids, and the lengths of the documents, in the order of the file."""
        raw = self.source.read_at(self._doc_size, self._doc_at)
        arrays, p = [], 0
        for _ in range(3):
            values, p = _expand(raw, p)
            arrays.append(values)
        return pa.array(arrays[0].view(np.int64), mask=arrays[1] == 0), arrays[2].astype(np.int64)


# --- jobs ------------------------------------------------------------------------------------------------------------

def write(docs: DataFrame, tokenizer: str, folder: str, planes: str = "byte", block: int = BLOCK, file_ids: int = FILE_IDS) -> DataFrame:
    """Write the files; a written table of them: ``name``, ``start`` (ids before the file), ``n_ids``, ``n_docs``, ``bytes``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = _open_fs(folder)
        part, turn, name, out, file = TaskContext.get().partitionId(), 0, "", None, None

        def done() -> pa.RecordBatch:
            file.close()
            out.close()
            return pa.RecordBatch.from_pylist([{"part": part, "turn": turn, "name": name, "n_ids": file.n_ids, "n_docs": file.n_docs, "bytes": file.at}], made)

        for batch in batches:
            for rows, ids, ends in _tokens(tokenizer).encode(batch.column("text")):
                ids, lengths = np.insert(ids, ends, END), np.diff(ends, prepend=0) + 1
                total = np.cumsum(lengths)
                lo = 0
                while lo < len(lengths):
                    if file is None:
                        fs.create_dir(root, recursive=True)
                        name = f"part-{part:06d}-{turn:04d}-{uuid.uuid4().hex}.ids"
                        out = fs.open_output_stream(f"{root}/{name}")
                        file = Writer(out, block, planes)
                    before = int(total[lo] - lengths[lo])
                    # up to the document with which the file is full
                    hi = min(int(np.searchsorted(total, before + file_ids - file.n_ids)) + 1, lo + FILE_DOCS, len(lengths))
                    file.add(batch.column("doc_id").slice(rows.start + lo, hi - lo), lengths[lo:hi], ids[before: total[hi - 1]])
                    lo = hi
                    if file.n_ids >= file_ids or file.n_docs >= FILE_DOCS:
                        yield done()
                        file, turn = None, turn + 1
        if file is not None:
            yield done()

    made = pa.schema([("part", pa.int32()), ("turn", pa.int32()), ("name", pa.string()), ("n_ids", pa.int64()), ("n_docs", pa.int64()), ("bytes", pa.int64())])
    tie = F.xxhash64("text")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    # partitions follow each other in the order of the ids, also where small neighbours are put together at run time
    ordered = texts.repartitionByRange(F.col("doc_id").asc_nulls_last(), tie).sortWithinPartitions(F.col("doc_id").asc_nulls_last(), tie, "text")
    files = materialize(ordered.mapInArrow(run, "part int, turn int, name string, n_ids long, n_docs long, bytes long"))
    # one row per file
    before = Window.orderBy("part", "turn").rowsBetween(Window.unboundedPreceding, -1)
    return materialize(files.select("name", F.coalesce(F.sum("n_ids").over(before), F.lit(0)).alias("start"), "n_ids", "n_docs", "bytes"))


def _documents_of(file: Reader, start: int, with_ids: bool) -> Iterator[tuple[int, int, int, list[bytes]]]:
    """(start, length, checksum, ids) of the documents of one file; a block is held at a time."""
    _, lengths = file.documents()
    blocks = file.blocks()
    block, at = np.zeros(0, "<u4"), 0
    for n in lengths.tolist():
        crc, left, parts = 0, n, []
        while left:
            if at == len(block):
                block, at = next(blocks), 0
            piece = block[at: at + left]
            crc = zlib.crc32(piece, crc)
            if with_ids:
                parts.append(piece.tobytes())
            at += len(piece)
            left -= len(piece)
        yield start, n, crc, parts
        start += n


def read(files: DataFrame, folder: str, with_ids: bool = False) -> DataFrame:
    """Every document of the files: ``doc_id``, ``start``, ``n_tokens``, ``ids_crc32``, on request ``ids`` (little-endian unsigned 32 bits)."""
    rows_at_once = 256 if with_ids else 1 << 16

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = _open_fs(folder)
        for batch in batches:
            for name, base in zip(batch.column("name").to_pylist(), batch.column("start").to_pylist(), strict=True):
                with fs.open_input_file(f"{root}/{name}") as source:
                    file = Reader(source)
                    doc_ids, _ = file.documents()
                    each, lo = _documents_of(file, base, with_ids), 0
                    while lo < len(doc_ids):
                        hi = min(lo + rows_at_once, len(doc_ids))
                        start, length, crc, ids = zip(*(next(each) for _ in range(lo, hi)), strict=True)
                        columns = [doc_ids.slice(lo, hi - lo), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
                        if with_ids:
                            columns.append(pa.array([b"".join(i) for i in ids], pa.binary()))
                        yield pa.RecordBatch.from_arrays(columns, names=names)
                        lo = hi

    names = ["doc_id", "start", "n_tokens", "ids_crc32", *(["ids"] if with_ids else [])]
    spread = int(files.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + (", ids binary" if with_ids else "")
    return files.select("name", "start").repartition(spread).mapInArrow(run, schema)


def ranges(files: DataFrame, folder: str, wanted: DataFrame) -> DataFrame:
    """``start``, ``length`` and ``ids`` of ``wanted`` ranges of the whole sequence of ids, as one part per file that a range touches.

    ``offset`` is where the part begins in its range. Only blocks that hold wanted ids are read.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = _open_fs(folder)
        last, source, file = None, None, None
        for batch in batches:
            for row in batch.to_pylist():
                if row["name"] != last:
                    if source is not None:
                        source.close()
                    last, source = row["name"], fs.open_input_file(f"{root}/{row['name']}")
                    file = Reader(source)
                lo = max(row["start"], row["base"])
                ids = file.read(lo - row["base"], row["start"] + row["length"] - lo)
                yield pa.RecordBatch.from_pylist([{"start": row["start"], "length": row["length"], "offset": lo - row["start"], "ids": ids.tobytes()}])
        if source is not None:
            source.close()

    base = files.select("name", F.col("start").alias("base"), (F.col("start") + F.col("n_ids")).alias("_stop"))
    # the table has one row per file of FILE_IDS ids; it is left to the optimizer, which sees its size
    at = base.join(wanted.select("start", "length"), (F.col("start") < F.col("_stop")) & (F.col("start") + F.col("length") > F.col("base")))
    parted = at.select("name", "base", "start", "length").repartition("name").sortWithinPartitions("name", "start")
    return parted.mapInArrow(run, "start long, length long, offset long, ids binary")


def round_trip(docs: DataFrame, tokenizer: str, planes: str = "byte") -> DataFrame:
    """Write all documents to files in the shared folder, and read their numbers back from them."""
    folder = f"{checkpoint_dir(docs.sparkSession)}/ids-{uuid.uuid4().hex}"
    return read(write(docs, tokenizer, folder, planes), folder)
