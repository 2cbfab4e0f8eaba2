"""Media columns: content-addressed payloads in tar shards, read back by ranges.

A text's UTF-8 bytes, padded with zeros to a positive multiple of 64, are the samples of an 8-bit
grey image 64 wide; the stored form is a PNG, which is lossless and about half the text's size.
Every task writes tar shards to the shared folder and stores equal payloads once per shard, under
their SHA-256.  Rows carry digest, shard, offset and length, never the payload: metadata columns
come from a range read of the PNG's header, features from a range read of the member.

Shards appear under their name only when complete, and rows name the shard that their own attempt
wrote, so a retried task leaves at most an unused file.

Defined cases: a null or empty text is 64 zero bytes; repeated rows point at one member of their
shard; a null doc_id is carried as null; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import struct
import tarfile
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm import common as C

WIDE = 64
#: Bytes after which a task starts another shard.
SHARD_BYTES = 256 << 20
#: Bytes of a shard that one reading task takes.
READ_BYTES = 8 << 20
_HEADER = 33  # signature and IHDR
_SIGNATURE = b"\x89PNG\r\n\x1a\n"


def payload(text: bytes) -> bytes:
    return text + bytes(-len(text) % WIDE or (0 if text else WIDE))


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def to_png(samples: bytes) -> bytes:
    """An 8-bit grey PNG, 64 wide; every line has filter 0."""
    rows = np.frombuffer(samples, np.uint8).reshape(-1, WIDE)
    lines = np.zeros((len(rows), WIDE + 1), np.uint8)
    lines[:, 1:] = rows
    head = struct.pack(">IIBBBBB", WIDE, len(rows), 8, 0, 0, 0, 0)
    return _SIGNATURE + _chunk(b"IHDR", head) + _chunk(b"IDAT", zlib.compress(lines, 3)) + _chunk(b"IEND", b"")


def png_header(data: bytes) -> tuple[int, int, int]:
    """(width, height, bits) from a PNG's first 33 bytes."""
    if data[:8] != _SIGNATURE or data[12:16] != b"IHDR":
        raise ValueError("not a PNG")
    return struct.unpack(">IIB", data[16:25])


def from_png(data: bytes) -> bytes:
    """The samples of a PNG that to_png() made."""
    wide, high, bits = png_header(data)
    at, packed = 8, b""
    while at < len(data):
        size, kind = struct.unpack(">I4s", data[at : at + 8])
        body = data[at + 8 : at + 8 + size]
        if zlib.crc32(kind + body) != struct.unpack(">I", data[at + 8 + size : at + 12 + size])[0]:
            raise ValueError("a chunk fails its check")
        packed += body if kind == b"IDAT" else b""
        at += 12 + size
    lines = np.frombuffer(zlib.decompress(packed), np.uint8).reshape(high, wide + 1)
    if bits != 8 or lines[:, 0].any():
        raise ValueError("not the form that is stored here")
    return lines[:, 1:].tobytes()


_INDEX = pa.schema([("doc_id", pa.int64()), ("digest", pa.string()), ("shard", pa.string()), ("offset", pa.int64()), ("length", pa.int64()), ("n_bytes", pa.int64())])


def _store(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task = TaskContext.get()
        store, root = fs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        shard, out, at, where, part = "", None, 0, {}, 0

        def close() -> None:
            nonlocal out
            if out is not None:
                out.write(bytes(1024))
                out.close()
                store.move(f"{root}/{shard}.part", f"{root}/{shard}")
                out = None

        for b in C.slices(batches):
            if out is None:
                shard, at, where, part = f"{task.partitionId():06d}-{part:04d}-{task.taskAttemptId()}.tar", 0, {}, part + 1
                out = store.open_output_stream(f"{root}/{shard}.part")
            raw, offsets = C.utf8(b.column("text"))
            data, rows = raw.tobytes(), []
            for x, y in zip(offsets[:-1], offsets[1:], strict=True):
                samples = payload(data[x:y])
                digest = hashlib.sha256(samples).hexdigest()
                if digest not in where:
                    png = to_png(samples)
                    info = tarfile.TarInfo(f"{digest}.png")
                    info.size = len(png)
                    head = info.tobuf(tarfile.USTAR_FORMAT)
                    where[digest] = at + len(head), len(png)
                    rest = bytes(-len(png) % 512)
                    out.write(head + png + rest)
                    at += len(head) + len(png) + len(rest)
                rows.append((digest, *where[digest], int(y - x)))
            digests, starts, lengths, sizes = zip(*rows, strict=True)
            yield pa.record_batch([b.column("doc_id"), pa.array(digests), pa.array([shard] * len(rows)), pa.array(starts), pa.array(lengths), pa.array(sizes)], schema=_INDEX)
            if at >= SHARD_BYTES:
                close()
        close()

    return run


_MEDIA = pa.schema(
    [
        *((n, t) for n, t in [("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64())]),
        *((n, t) for n, t in [("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string())]),
        *((n, t) for n, t in [("width", pa.int32()), ("height", pa.int32()), ("bits", pa.int32()), ("digest", pa.string())]),
    ]
)


def feature(samples: bytes, wide: int, high: int, bits: int) -> str:
    """Shape, mean, and shares (in 10,000ths) of eight ranges of samples; whole numbers only."""
    a = np.frombuffer(samples, np.uint8)
    shares = np.bincount(a >> 5, minlength=8) * 10_000 // len(a)
    return f"{wide}x{high}x{bits};mean={int(a.sum(dtype=np.int64)) * 1000 // len(a)};" + ",".join(map(str, shares))


def _load(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(folder)
        name, file, key, seen = None, None, None, None
        for b in batches:
            cols = {c: b.column(c).to_pylist() for c in ("digest", "shard", "offset", "length", "n_bytes")}
            rows = []
            for digest, shard, offset, length, n_bytes in zip(*cols.values(), strict=True):
                if shard != name:
                    if file is not None:
                        file.close()
                    name, file = shard, store.open_input_file(f"{root}/{shard}")
                if (shard, offset) != key:  # rows come by place, so copies follow one another
                    shape = png_header(file.read_at(_HEADER, offset))
                    png = file.read_at(length, offset)
                    samples = from_png(png)
                    found = hashlib.sha256(samples).hexdigest()
                    if found != digest:
                        raise ValueError(f"{shard} at {offset} has not the payload of its digest")
                    key, seen = (shard, offset), (len(samples), found, zlib.crc32(samples[-64:]), length, hashlib.sha256(png).hexdigest(), feature(samples, *shape), *shape, digest)
                rows.append((n_bytes, *seen))
            if rows:
                yield pa.record_batch([b.column("doc_id"), *(pa.array(x, f.type) for x, f in zip(zip(*rows, strict=True), list(_MEDIA)[1:], strict=True))], schema=_MEDIA)
        if file is not None:
            file.close()

    return run


def store(docs: DataFrame, folder: str) -> DataFrame:
    """Writes the payloads; doc_id, digest, shard, offset, length and n_bytes of every row."""
    rows = C.keyed_documents(docs).mapInArrow(_store(folder), "doc_id long, digest string, shard string, offset long, length long, n_bytes long")
    return C.materialize(rows, "media-index")


def load(index: DataFrame, folder: str) -> DataFrame:
    """Metadata and features of every row of the index, from range reads.

    Tasks are as many as the bytes to read ask for; the index itself is small and says nothing about that.
    """
    total = index.agg(F.coalesce(F.sum("length"), F.lit(0))).first()[0]
    placed = index.repartition(int(total) // READ_BYTES + 1, "shard", F.floor(F.col("offset") / READ_BYTES)).sortWithinPartitions("shard", "offset")
    kinds = {pa.int64(): "long", pa.string(): "string", pa.int32(): "int"}
    return placed.mapInArrow(_load(folder), ", ".join(f"{f.name} {kinds[f.type]}" for f in _MEDIA))


def media_columns(docs: DataFrame) -> DataFrame:
    folder = C.scratch(docs.sparkSession, "media")
    return load(store(docs, folder), folder)
