"""Media columns: content-addressed payloads in tar shards.

A payload of 8-bit samples is stored as a grey PNG image, named by the SHA-256 of that file, in a tar
shard; table rows carry digest, shard, offset and length of the stored bytes. A task writes one shard
and stores equal payloads in it once, so the size of a hot payload's copies is bounded by the number
of shards and no payload is shuffled. Metadata columns are filled by reading the image header only.

Nulls, empty and long texts: a null or empty text has a payload of padding alone; long texts give
higher images. Repeated rows share bytes; a null doc_id stays null; an empty table gives no rows.
Further columns are ignored.
"""

from __future__ import annotations

import hashlib
import struct
import tarfile
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, open_fs, scratch, slices

#: A payload is padded to a positive multiple of this; it is also the width of the image.
UNIT = 576
PAD = 255
#: The PNG signature, and the bytes that hold it and the header chunk.
SIGNATURE, HEADER_BYTES = b"\x89PNG\r\n\x1a\n", 33
LEVEL = 6

INDEX = "doc_id long, shard string, digest string, offset long, length long"


def payload_of(text: str | None) -> bytes:
    """UTF-8 bytes, padded by bytes 255 (which UTF-8 never has) to a positive multiple of UNIT."""
    data = (text or "").encode("utf-8")
    return data + bytes([PAD]) * (-len(data) % UNIT if data else UNIT)


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def encode_png(payload: bytes, width: int = UNIT) -> bytes:
    """An 8-bit grey image of the samples, width to a row, each row unfiltered."""
    rows = np.frombuffer(payload, np.uint8).reshape(-1, width)
    raw = np.zeros((len(rows), width + 1), np.uint8)
    raw[:, 1:] = rows
    head = struct.pack(">IIBBBBB", width, len(rows), 8, 0, 0, 0, 0)
    return SIGNATURE + _chunk(b"IHDR", head) + _chunk(b"IDAT", zlib.compress(raw.tobytes(), LEVEL)) + _chunk(b"IEND", b"")


def read_header(data: bytes) -> tuple[int, int, int]:
    """Width, height and bits of a sample, from the first HEADER_BYTES bytes."""
    if data[:8] != SIGNATURE or data[12:16] != b"IHDR" or zlib.crc32(data[12:29]) != struct.unpack(">I", data[29:33])[0]:
        raise ValueError("not a PNG header")
    width, height, bits = struct.unpack(">IIB", data[16:25])
    return width, height, bits


def decode_png(data: bytes) -> bytes:
    """The samples of an image that encode_png made."""
    width, height, _ = read_header(data)
    (size,) = struct.unpack(">I", data[33:37])
    raw = np.frombuffer(zlib.decompress(data[41 : 41 + size]), np.uint8).reshape(height, width + 1)
    if raw[:, 0].any():
        raise ValueError("filtered rows")
    return raw[:, 1:].tobytes()


def store_payloads(docs: DataFrame, folder: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write every text's payload into tar shards under folder: a row per document (INDEX).

    Each attempt of a task writes a shard of its own name, which only the rows of the attempt that
    Spark accepts point to; nothing is renamed or written over.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, out, at = TaskContext.get().partitionId(), None, 0
        fs, root = open_fs(folder)
        name, stored = f"shard-{part:06d}-{uuid.uuid4().hex}.tar", {}
        for batch in slices(batches, "text"):
            if out is None:
                fs.create_dir(root, recursive=True)
                out = fs.open_output_stream(f"{root}/{name}")
            rows = []
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                payload = payload_of(text)
                key = hashlib.blake2b(payload, digest_size=16).digest()
                if key not in stored:
                    media = encode_png(payload)
                    digest = hashlib.sha256(media).hexdigest()
                    member = tarfile.TarInfo(f"{digest}.png")
                    member.size = len(media)
                    head = member.tobuf(format=tarfile.USTAR_FORMAT)
                    out.write(head + media + bytes(-len(media) % 512))
                    stored[key] = (digest, at + len(head), len(media))
                    at += len(head) + len(media) + -len(media) % 512
                rows.append((doc, f"{folder}/{name}", *stored[key]))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64()))], names=["doc_id", "shard", "digest", "offset", "length"])
        if out is not None:
            out.write(bytes(1024))
            out.close()

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(write, INDEX)


def _reader(columns: list[tuple[str, pa.DataType]], size: int | None, compute):
    """A mapInArrow function: adds columns computed from the first size bytes (all if None) of each payload."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path = file = None
        last: tuple = ()
        for whole in batches:
            for k in range(0, whole.num_rows, 2000):
                batch = whole.slice(k, 2000)
                found = []
                for shard, offset, length in zip(batch.column("shard").to_pylist(), batch.column("offset").to_pylist(), batch.column("length").to_pylist()):
                    if shard != path:
                        if file is not None:
                            file.close()
                        fs, name = open_fs(shard)
                        path, file, last = shard, fs.open_input_file(name), ()
                    if last[:1] != (offset,):
                        file.seek(offset)
                        last = (offset, compute(file.read(length if size is None else min(size, length))))
                    found.append(last[1])
                added = [pa.array(c, t) for c, (_, t) in zip(zip(*found), columns)]
                yield pa.RecordBatch.from_arrays([*batch.columns, *added], names=[*batch.schema.names, *(n for n, _ in columns)])
        if file is not None:
            file.close()

    return run


def with_metadata(index: DataFrame) -> DataFrame:
    """Add width, height and bits of a sample by range reads of the image headers alone."""
    return index.mapInArrow(_reader([("width", pa.int32()), ("height", pa.int32()), ("sample_bits", pa.int32())], HEADER_BYTES, read_header), f"{_ddl(index)}, width int, height int, sample_bits int")


def _ddl(df: DataFrame) -> str:
    return ", ".join(f"`{n}` {t}" for n, t in df.dtypes)


def measure(media: bytes) -> tuple:
    """What a stored image holds: sizes, digests and features of its samples."""
    payload = decode_png(media)
    samples = np.frombuffer(payload, np.uint8)
    counts = np.bincount(samples, minlength=256)
    share = counts[counts > 0] / len(samples)
    n = len(payload.rstrip(bytes([PAD])))
    feature = f"mean={samples.mean():.4f};std={samples.std():.4f};entropy={-(share * np.log2(share)).sum() + 0.0:.4f};edges={np.abs(np.diff(samples.astype(np.int16))).mean():.4f}"
    return n, len(payload), hashlib.sha256(payload).hexdigest(), payload[-32:], len(media), hashlib.sha256(media).hexdigest(), feature


def with_features(index: DataFrame) -> DataFrame:
    """Add sizes, digests and features computed from the stored bytes."""
    kinds = [("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail", pa.binary()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string())]
    return index.mapInArrow(_reader(kinds, None, measure), f"{_ddl(index)}, n_bytes long, payload_bytes long, payload_sha256 string, tail binary, media_bytes long, media_sha256 string, feature string")


def media_columns(docs: DataFrame) -> DataFrame:
    """Store all payloads, then fill metadata by header reads and features by reading the bytes back."""
    folder = scratch(docs.sparkSession, "media")
    index = materialize(store_payloads(docs, folder), "media-index")
    # Index rows are small but stand for payloads: as many tasks read as wrote, each some ranges of shards.
    tasks = max(1, index.select("shard").distinct().count())
    spread = index.repartitionByRange(tasks, "shard", "offset").sortWithinPartitions("shard", "offset")
    return with_features(with_metadata(spread))
