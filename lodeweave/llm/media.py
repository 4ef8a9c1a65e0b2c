"""Media columns: payloads as 8-bit greyscale PNG images in ZIP archives, read by a Spark data source.

Writing: each text's bytes, padded with 255 to a positive multiple of SIDE * SIDE, are the pixels of an
image of SIDE columns; a task stores its images as members of ZIP archives (stored, not deflated again)
of about `archive_bytes` in a shared folder, under names of its own attempt. Only archives that a
finished attempt reports, in the folder's manifest, are read, so a repeated or lost attempt adds nothing;
an attempt that fails deletes its archives.

Reading: the data source `lodeweave_media` plans partitions as byte ranges of the archives, from the sizes
in the manifest alone; a reader is sent its own range, not the list. It gets the archive's central
directory from its end, takes the members whose headers start in its range, fetches them by offset, checks
each one's crc32, and on a failure opens the archive again and retries that member alone, `retries` times,
before it gives up on it: then the row has the error and no payload, or the query fails if `onError` is
fail (the default). Members leave in Arrow batches of about BATCH_BYTES, and at least one member.

A member's comment is `=` and its doc_id, or empty for a null one; an id too long for a comment is stored
as a member of its own, and the comment is `@`.

Defined cases: null and empty texts are one block of 255s (n_bytes 0); UTF-8 has no byte 255, so the
unpadded length is found again from the payload; a very long text is one member and in memory as a whole,
alone in its batch; repeated rows are members of their own; a null doc_id stays null and an empty one
empty; an empty table makes no archive and gives no rows; further columns are not read.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
import zipfile
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from lodeweave.llm.common import cut, text_bytes
from lodeweave.sources.storage import open_store, remove, shared_root

SIDE = 24
BLOCK = SIDE * SIDE
BATCH_BYTES = 1 << 20
RANGE_BYTES, MOST_RANGES = 16 << 20, 200_000
MANIFEST = "_manifest"
_LONGEST_COMMENT = 65_535
_SIGNATURE = b"\x89PNG\r\n\x1a\n"


def padded(data: bytes, block: int = BLOCK) -> bytes:
    return data + b"\xff" * (-len(data) % block if data else block)


def encode_png(payload: bytes, width: int = SIDE) -> bytes:
    """An 8-bit greyscale PNG whose pixels are the payload, a multiple of width; rows are unfiltered."""
    rows = np.frombuffer(payload, np.uint8).reshape(-1, width)
    lines = np.zeros((len(rows), width + 1), np.uint8)
    lines[:, 1:] = rows

    def chunk(kind: bytes, data: bytes) -> bytes:
        return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))

    return _SIGNATURE + chunk(b"IHDR", struct.pack(">IIBBBBB", width, len(rows), 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(lines.tobytes(), 3)) + chunk(b"IEND", b"")


def decode_png(media: bytes) -> bytes:
    """The pixels of an image that encode_png made; raises ValueError on damage."""
    if media[:8] != _SIGNATURE:
        raise ValueError("not a PNG")
    at, data, width, height = 8, b"", 0, 0
    while at < len(media):
        size, kind = struct.unpack_from(">I4s", media, at)
        body = media[at + 8 : at + 8 + size]
        if zlib.crc32(kind + body) != struct.unpack_from(">I", media, at + 8 + size)[0]:
            raise ValueError(f"damaged {kind!r} chunk")
        if kind == b"IHDR":
            width, height, depth, colour = struct.unpack_from(">IIBB", body)
            if (depth, colour) != (8, 0):
                raise ValueError("not 8-bit greyscale")
        elif kind == b"IDAT":
            data += body
        at += size + 12
    lines = np.frombuffer(zlib.decompress(data), np.uint8).reshape(height, width + 1)
    if lines[:, 0].any():
        raise ValueError("filtered rows")
    return lines[:, 1:].tobytes()


def feature(payload: bytes) -> str:
    """rows, mean and variance of the samples, and a 64-bit average hash of an 8 by 8 reduction, in hex."""
    x = np.frombuffer(payload, np.uint8).reshape(-1, SIDE)
    edges = np.arange(9) * len(x) // 8
    tall = np.array([x[lo:hi].sum(axis=0, dtype=np.int64) for lo, hi in zip(edges, edges[1:], strict=False)])
    cells = tall.reshape(8, 8, SIDE // 8).sum(axis=2)
    bits = cells * len(x) * 8 > cells.sum() * np.diff(edges)[:, None]
    held = np.zeros(256, np.int64)
    for at in range(0, len(payload), 1 << 16):  # bincount copies its input in 64 bits
        held += np.bincount(x.reshape(-1)[at : at + (1 << 16)], minlength=256)
    n, value = len(payload), np.arange(256)
    total, squares = int(held @ value), int(held @ value**2)
    return f"{len(x)}x{SIDE};mean={total / n:.4f};var={squares / n - (total / n) ** 2:.3f};ahash={np.packbits(bits.ravel()).tobytes().hex()}"


def write_archives(docs: DataFrame, folder: str, archive_bytes: int = 64 << 20) -> None:
    """Store every document as a member of archives of about archive_bytes, and the list of finished ones in MANIFEST."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        system, path = open_store(folder)
        system.create_dir(path, recursive=True)
        names, sizes = [], []
        out = sink = None

        def close():
            nonlocal out
            if out:
                out.close()
                sizes.append(sink.tell())
                sink.close()
                out = None

        try:
            for batch in batches:
                for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()), strict=True):
                    if out is None:
                        names.append(f"part-{context.partitionId()}-{context.taskAttemptId()}-{uuid.uuid4().hex[:8]}-{len(names)}.zip")
                        sink = system.open_output_stream(f"{path}/{names[-1]}")
                        out, members, written = zipfile.ZipFile(sink, "w", zipfile.ZIP_STORED), 0, 0
                    media = encode_png(padded(text.as_py()))
                    info = zipfile.ZipInfo(f"{members}.png")
                    info.comment = b"" if doc is None else b"=" + doc.encode()
                    if len(info.comment) > _LONGEST_COMMENT:
                        out.writestr(zipfile.ZipInfo(f"{members}.id"), doc.encode())
                        info.comment = b"@"
                    out.writestr(info, media)
                    members, written = members + 1, written + len(media)
                    if written >= archive_bytes:
                        close()
            close()
        except BaseException:
            if sink is not None:
                sink.close()
            for name in names:  # of an attempt that failed
                system.delete_file(f"{path}/{name}")
            raise
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(sizes, pa.int64())], ["name", "size"])

    rows = docs.select(F.col("doc_id").cast("string"), text_bytes(F.col("text")).alias("text"))
    rows.mapInArrow(run, "name string, size long").write.parquet(f"{folder}/{MANIFEST}")


class Range(InputPartition):
    def __init__(self, name: str, lo: int, hi: int):
        self.name, self.lo, self.hi = name, lo, hi


class ArchiveReader(DataSourceReader):
    def __init__(self, options):
        self.folder = options["folder"]
        self.range_bytes = int(options.get("rangebytes", 0))
        self.retries = int(options.get("retries", 3))
        self.keep_going = options.get("onerror", "fail") == "row"

    def partitions(self):
        system, folder = open_store(self.folder)
        listed = pq.read_table(f"{folder}/{MANIFEST}", filesystem=system)
        names, sizes = listed.column("name").to_pylist(), listed.column("size").to_pylist()
        step = self.range_bytes or max(RANGE_BYTES, sum(sizes) // MOST_RANGES)
        return [Range(name, lo, min(size, lo + step)) for name, size in sorted(zip(names, sizes, strict=True)) for lo in range(0, size, step)] or [Range("", 0, 0)]

    def directory(self, system, path: str) -> list[zipfile.ZipInfo]:
        """The archive's members, from the directory at its end; tried again like a member."""
        for attempt in range(self.retries + 1):
            try:
                with system.open_input_file(path) as f:
                    return zipfile.ZipFile(f).infolist()
            except (OSError, zipfile.BadZipFile):
                if attempt == self.retries:
                    raise
        return []

    def member(self, system, path: str, offset: int, size: int, crc: int) -> tuple[bytes | None, int, str | None]:
        """One stored member by its header's offset: the bytes or None, failed attempts, the last error."""
        error = None
        for attempt in range(self.retries + 1):
            try:
                with system.open_input_file(path) as f:
                    head = f.read_at(30, offset)
                    if head[:4] != b"PK\x03\x04":
                        raise ValueError("no member header")
                    name, extra = struct.unpack_from("<HH", head, 26)
                    data = f.read_at(size, offset + 30 + name + extra)
                if zlib.crc32(data) != crc:
                    raise ValueError("crc32 differs")
                return data, attempt, None
            except (OSError, ValueError, struct.error) as e:
                error = f"{type(e).__name__}: {e}"
        return None, self.retries + 1, error

    def doc_id(self, system, path: str, m: zipfile.ZipInfo, ids: dict[str, zipfile.ZipInfo]) -> str | None:
        if m.comment != b"@":
            return m.comment[1:].decode() if m.comment else None
        own = ids[m.filename.removesuffix(".png") + ".id"]
        data, _, error = self.member(system, path, own.header_offset, own.file_size, own.CRC)
        if data is None:
            raise OSError(f"{path} at {own.header_offset}: {error}")
        return data.decode()

    def read(self, partition):
        if not partition.name:
            return
        system, folder = open_store(self.folder)
        path = f"{folder}/{partition.name}"
        ids, members = {}, []
        for m in self.directory(system, path):
            if m.filename.endswith(".id"):
                ids[m.filename] = m
            elif partition.lo <= m.header_offset < partition.hi:
                members.append(m)
        kinds = (pa.string(), pa.string(), pa.int64(), pa.binary(), pa.int32(), pa.string())
        at = 0
        while at < len(members):
            upto, held = at + 1, members[at].file_size
            while upto < len(members) and held + members[upto].file_size <= BATCH_BYTES:
                held += members[upto].file_size
                upto += 1
            run, at = members[at:upto], upto
            start, last = run[0].header_offset, run[-1]
            stretch = self.stretch(system, path, start, last.header_offset + last.compress_size + 30 + len(last.filename) + len(last.extra))
            rows = []
            for m in run:
                first = m.header_offset - start + 30 + len(m.filename.encode()) + len(m.extra)
                data, failed, error = stretch[first : first + m.file_size], 0, None
                if zlib.crc32(data) != m.CRC:
                    data, failed, error = self.member(system, path, m.header_offset, m.file_size, m.CRC)
                if data is None and not self.keep_going:
                    raise OSError(f"{partition.name} at {m.header_offset}: {error}")
                rows.append((self.doc_id(system, path, m, ids), partition.name, m.header_offset, data, failed, error))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["member", "archive", "offset", "media", "failed", "error"])

    def stretch(self, system, path: str, start: int, end: int) -> bytes:
        """The bytes of consecutive members at once; what is short or wrong is left to each member's own retries."""
        try:
            with system.open_input_file(path) as f:
                return f.read_at(end - start, start)
        except OSError:
            return b""


class ArchiveSource(DataSource):
    @classmethod
    def name(cls):
        return "lodeweave_media"

    def schema(self):
        return "member string, archive string, offset long, media binary, failed int, error string"

    def reader(self, schema):
        return ArchiveReader({k.lower(): v for k, v in self.options.items()})


def read_archives(spark: SparkSession, folder: str, **options) -> DataFrame:
    """The members of the archives in the folder's manifest. Options: rangeBytes, retries, onError (fail or row)."""
    spark.dataSource.register(ArchiveSource)
    return spark.read.format("lodeweave_media").options(folder=folder, **options).load()


def features(media: DataFrame, kind: str = "bigint") -> DataFrame:
    """doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature."""
    names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
    types = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc, stored in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                stored = stored.as_py()
                p = decode_png(stored)
                rows.append((doc, len(p.rstrip(b"\xff")), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-32:]), len(stored), hashlib.sha256(stored).hexdigest(), feature(p)))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(list(zip(*rows, strict=True)) or [[]] * 8, types, strict=True)], names)

    found = media.where("media IS NOT NULL").select("member", "media").mapInArrow(run, "doc_id string, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
    return found.withColumn("doc_id", F.col("doc_id").cast(kind))


def media_columns(docs: DataFrame, folder: str | None = None) -> DataFrame:
    """Store docs as images and describe what is read back from the archives; these stay only if their folder is given."""
    spark, kind = docs.sparkSession, docs.schema["doc_id"].dataType.simpleString()
    own = folder or f"{shared_root(spark)}/media-{uuid.uuid4().hex}"
    try:
        write_archives(docs, own)
        found = features(read_archives(spark, own), kind)
        return found if folder else cut(found)
    finally:
        if not folder:
            remove(spark, own)
