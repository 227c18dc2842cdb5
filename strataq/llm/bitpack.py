"""Token-id files with fixed-width bit packing.

A shard holds the ids of consecutive documents, each id in the fewest bits that hold the vocabulary,
in blocks of a fixed number of ids. A footer has the blocks' byte offsets and the documents' ids and
starts, so numpy unpacks any block, document or range of ids without reading the rest.

    magic | block 0 | block 1 | ... | footer | footer's length (8 bytes) | magic

Nulls, empty and long texts: a null or empty text has only the end id; long texts span blocks.
Rows are ordered by doc_id (null first), ties by text; a repeated row is stored again. An empty table
gives no shard. Further columns of the input are ignored.
"""

from __future__ import annotations

import struct
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, open_fs, scratch, slices
from .tokens import ENCODED_BYTES, encoder

MAGIC = b"BPK1"
BLOCK_IDS = 1 << 14
HEAD = struct.Struct("<BIQQQ")  # width, ids a block, ids, documents, blocks
#: Ids that a reader holds unpacked at once (one longer document still goes alone).
READ_IDS = 1 << 21


def width_of(vocab_size: int) -> int:
    """The minimum number of bits for ids 0 .. vocab_size - 1."""
    return max(1, (vocab_size - 1).bit_length())


def pack(ids: np.ndarray, width: int) -> bytes:
    """Ids as width bits each, lowest bit first, padded to a whole byte."""
    if width in (8, 16, 32):
        return ids.astype(f"<u{width // 8}").tobytes()
    bits = np.unpackbits(ids.astype("<u4").view(np.uint8).reshape(-1, 4), axis=1, bitorder="little")
    return np.packbits(bits[:, :width], bitorder="little").tobytes()


def unpack(data: bytes, width: int, n: int) -> np.ndarray:
    if width in (8, 16, 32):
        return np.frombuffer(data, f"<u{width // 8}", n).astype("<u4")
    bits = np.unpackbits(np.frombuffer(data, np.uint8), count=n * width, bitorder="little").reshape(n, width)
    full = np.zeros((n, 32), np.uint8)
    full[:, :width] = bits
    return np.packbits(full, axis=1, bitorder="little").view("<u4").reshape(-1)


class ShardWriter:
    """Appends documents to a stream; holds one block and the index in memory."""

    def __init__(self, out, width: int, block_ids: int = BLOCK_IDS):
        self.out, self.width, self.block_ids = out, width, block_ids
        self.at, self.rest, self.n_ids = len(MAGIC), np.empty(0, "<u4"), 0
        self.blocks: list[int] = []
        self.docs: list[int | None] = []
        self.starts: list[int] = [0]
        out.write(MAGIC)

    def add(self, doc_ids: list[int | None], ids: np.ndarray, borders: np.ndarray) -> None:
        """Documents whose ids lie between consecutive borders."""
        self.docs += doc_ids
        self.starts += (borders[1:] + self.n_ids).tolist()
        self.n_ids += len(ids)
        ids = np.concatenate((self.rest, ids))
        full = len(ids) // self.block_ids * self.block_ids
        for i in range(0, full, self.block_ids):
            self._block(ids[i : i + self.block_ids])
        self.rest = ids[full:]

    def _block(self, ids: np.ndarray) -> None:
        self.blocks.append(self.at)
        data = pack(ids, self.width)
        self.out.write(data)
        self.at += len(data)

    def close(self) -> None:
        if len(self.rest):
            self._block(self.rest)
        footer = HEAD.pack(self.width, self.block_ids, self.n_ids, len(self.docs), len(self.blocks))
        footer += np.array([*self.blocks, self.at], "<u8").tobytes()
        footer += np.array([d or 0 for d in self.docs], "<i8").tobytes()
        footer += np.array([d is None for d in self.docs], np.uint8).tobytes()
        footer += np.array(self.starts, "<u8").tobytes()
        self.out.write(footer + struct.pack("<Q", len(footer)) + MAGIC)


class ShardReader:
    """Random access to a shard over a seekable file."""

    def __init__(self, file, size: int):
        self.file = file
        tail = self._read(size - 12, 12)
        if tail[8:] != MAGIC:
            raise ValueError("not a shard of packed ids")
        (length,) = struct.unpack("<Q", tail[:8])
        data = self._read(size - 12 - length, length)
        self.width, self.block_ids, self.n_ids, n_docs, n_blocks = HEAD.unpack_from(data)
        at = HEAD.size

        def take(kind: str, n: int) -> np.ndarray:
            nonlocal at
            found = np.frombuffer(data, kind, n, at)
            at += found.nbytes
            return found

        self.blocks = take("<u8", n_blocks + 1).astype(np.int64)
        ids, null = take("<i8", n_docs), take("u1", n_docs)
        self.doc_ids: list[int | None] = [None if x else d for d, x in zip(ids.tolist(), null.tolist())]
        self.starts = take("<u8", n_docs + 1).astype(np.int64)

    def _read(self, at: int, n: int) -> bytes:
        self.file.seek(at)
        return self.file.read(n)

    def ids(self, start: int, end: int) -> np.ndarray:
        """Ids start .. end - 1 of the shard; reads only the blocks that hold them."""
        if end <= start:
            return np.empty(0, "<u4")
        a, b = start // self.block_ids, (end - 1) // self.block_ids + 1
        data = self._read(int(self.blocks[a]), int(self.blocks[b] - self.blocks[a]))
        parts = [unpack(data[self.blocks[k] - self.blocks[a] : self.blocks[k + 1] - self.blocks[a]], self.width, min(self.block_ids, self.n_ids - k * self.block_ids)) for k in range(a, b)]
        return np.concatenate(parts)[start - a * self.block_ids : end - a * self.block_ids]

    def document(self, i: int) -> np.ndarray:
        return self.ids(int(self.starts[i]), int(self.starts[i + 1]))


def write_token_files(docs: DataFrame, folder: str, vocabulary: str, vocab_size: int, end_id: int = 0, byte_level: bool = True, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode every text and write shards in ascending document order under folder.

    Range-partitions by document id, so shard k holds ids below those of shard k + 1. Each attempt of
    a task streams its shard to a file of its own name, which only the row of the attempt that Spark
    accepts points to; nothing is renamed or written over. Returns (shard, path, n_docs, n_ids), one row per shard.
    """
    width = width_of(vocab_size)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, out, enc = TaskContext.get().partitionId(), None, encoder(vocabulary, byte_level)
        fs, root = open_fs(folder)
        for batch in slices(batches, "text", ENCODED_BYTES):
            if out is None:
                fs.create_dir(root, recursive=True)
                name = f"shard-{shard:06d}-{uuid.uuid4().hex}.bpk"
                out = fs.open_output_stream(f"{root}/{name}")
                writer = ShardWriter(out, width)
            ids, borders = enc.encode(batch.column("text"), end_id)
            writer.add(batch.column("doc_id").to_pylist(), ids, borders)
        if out is not None:
            writer.close()
            out.close()
            yield pa.RecordBatch.from_pydict({"shard": [shard], "path": [f"{folder}/{name}"], "n_docs": [len(writer.docs)], "n_ids": [writer.n_ids]})

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    ordered = rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    return ordered.mapInArrow(write, "shard long, path string, n_docs long, n_ids long")


def read_token_files(shards: DataFrame) -> DataFrame:
    """Documents of the shards: (doc_id, start, n_tokens, ids as little-endian unsigned 32-bit integers).

    start counts the ids of all documents before, over all shards. One task reads one shard's
    blocks in turn and never holds more than READ_IDS ids, or one document.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, base in zip(batch.column("path").to_pylist(), batch.column("base").to_pylist()):
                fs, name = open_fs(path)
                with fs.open_input_file(name) as file:
                    shard = ShardReader(file, file.size())
                    at, n = 0, len(shard.doc_ids)
                    while at < n:
                        to = max(at + 1, int(np.searchsorted(shard.starts, shard.starts[at] + READ_IDS, side="right")) - 1)
                        to = min(to, n)
                        borders = shard.starts[at : to + 1] - shard.starts[at]
                        raw = shard.ids(int(shard.starts[at]), int(shard.starts[to])).tobytes()
                        yield pa.RecordBatch.from_arrays(
                            [
                                pa.array(shard.doc_ids[at:to], pa.int64()),
                                pa.array(shard.starts[at:to] + base, pa.int64()),
                                pa.array(np.diff(borders), pa.int64()),
                                pa.array([raw[4 * a : 4 * b] for a, b in zip(borders[:-1].tolist(), borders[1:].tolist())], pa.binary()),
                            ],
                            names=["doc_id", "start", "n_tokens", "ids"],
                        )
                        at = to

    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)  # a row per shard only
    based = shards.withColumn("base", F.coalesce(F.sum("n_ids").over(before), F.lit(0)))
    tasks = based.select("path", "base").repartition(max(1, min(shards.count(), 100_000)))
    return tasks.mapInArrow(read, "doc_id long, start long, n_tokens long, ids binary")


def token_files(docs: DataFrame, vocabulary: str, vocab_size: int, end_id: int = 0) -> DataFrame:
    """Write documents as packed token files in the shared folder, then read the files back."""
    folder = scratch(docs.sparkSession, "tokens")
    return read_token_files(materialize(write_token_files(docs, folder, vocabulary, vocab_size, end_id), "token-shards"))


