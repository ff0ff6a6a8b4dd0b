"""Token-id files with byte- or bit-plane shuffling.

A file holds the ids of documents in ascending ``doc_id`` order. Ids are cut into blocks of ``BLOCK``
ids; a block is transposed into planes (four byte planes or 32 bit planes), each plane compressed on
its own with zstandard; a plane of zeros takes no space. The footer has the chunk index (place and
size of each plane of each block) and the documents' ids and token counts, so a reader can fetch
the blocks of any document alone.

    magic 8 | planes ... | index (zstd) | index length u64 | magic 8
"""

from __future__ import annotations

import atexit
import os
import struct
import zlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import drop, partitions, ready, scratch, text_or_empty, whole_file

MAGIC = b"PLANES01"
BLOCK = 1 << 16


def to_planes(block: np.ndarray, bits: bool) -> list[bytes]:
    """Planes of a block of u32 ids, least significant first."""
    rows = np.ascontiguousarray(block.astype("<u4").view("u1").reshape(-1, 4).T)
    if not bits:
        return [r.tobytes() for r in rows]
    return [np.packbits((r >> b) & 1, bitorder="little").tobytes() for r in rows for b in range(8)]


def from_planes(planes: list[bytes | None], n: int, bits: bool) -> np.ndarray:
    out = np.zeros((n, 4), "u1")
    for i, p in enumerate(planes):
        if p is None:
            continue
        if bits:
            out[:, i // 8] |= np.unpackbits(np.frombuffer(p, "u1"), count=n, bitorder="little") << (i % 8)
        else:
            out[:, i] = np.frombuffer(p, "u1")
    return out.reshape(-1).view("<u4")


class Writer:
    """Takes documents in order and writes blocks to ``out`` as they fill up; ``finish()`` adds the index."""

    def __init__(self, out, bits: bool = False, level: int = 1):
        self.bits, self.packer = bits, zstandard.ZstdCompressor(level=level)
        self.out = out
        self.out.write(MAGIC)
        self.held, self.n_held = [], 0
        self.index: list[tuple] = []
        self.ids, self.counts = [], []

    def add(self, doc_id: int | None, ids: bytes) -> None:
        self.ids.append(doc_id)
        self.counts.append(len(ids) // 4)
        self.held.append(ids)
        self.n_held += len(ids)
        if self.n_held >= BLOCK * 4:
            whole = b"".join(self.held)
            cut = len(whole) - len(whole) % (BLOCK * 4)
            for at in range(0, cut, BLOCK * 4):
                self._block(whole[at : at + BLOCK * 4])
            self.held, self.n_held = [whole[cut:]], len(whole) - cut

    def _block(self, data: bytes) -> None:
        sizes = []
        for p in to_planes(np.frombuffer(data, "<u4"), self.bits):
            packed = self.packer.compress(p) if any(p) else b""
            sizes.append(len(packed))
            self.out.write(packed)
        self.index.append((len(data) // 4, sizes))

    def finish(self) -> None:
        if self.n_held:
            self._block(b"".join(self.held))
        n_planes = 32 if self.bits else 4
        null = np.array([x is None for x in self.ids], "u1")
        body = struct.pack("<QQI", len(self.ids), len(self.index), n_planes)
        body += np.array([x or 0 for x in self.ids], "<i8").tobytes() + null.tobytes() + np.array(self.counts, "<u8").tobytes()
        body += np.array([n for n, _ in self.index], "<u4").tobytes() + np.array([s for _, s in self.index], "<u4").tobytes()
        packed = zstandard.ZstdCompressor(level=3).compress(body)
        self.out.write(packed + struct.pack("<Q", len(packed)) + MAGIC)


class Reader:
    """Reads a file block by block; holds its index and one block."""

    def __init__(self, path: str):
        self.file = open(path, "rb")  # noqa: SIM115
        self.file.seek(-16, os.SEEK_END)
        n, magic = struct.unpack("<Q8s", self.file.read(16))
        if magic != MAGIC:
            raise ValueError(f"{path} is no token file")
        self.file.seek(-16 - n, os.SEEK_END)
        self.unpacker = zstandard.ZstdDecompressor()
        body = self.unpacker.decompress(self.file.read(n))
        docs, blocks, planes = struct.unpack_from("<QQI", body)
        at = 20
        ids = np.frombuffer(body, "<i8", docs, at)
        null = np.frombuffer(body, "u1", docs, at + 8 * docs)
        self.ids = [None if z else int(i) for i, z in zip(ids, null)]
        at += 9 * docs
        self.counts = np.frombuffer(body, "<u8", docs, at).astype(np.int64)
        at += 8 * docs
        self.sizes = np.frombuffer(body, "<u4", blocks, at)
        self.planes = np.frombuffer(body, "<u4", blocks * planes, at + 4 * blocks).reshape(blocks, planes)
        self.begins = len(MAGIC) + np.concatenate([[0], np.cumsum(self.planes.sum(1, dtype=np.int64))])
        self.bits = planes == 32

    def block(self, i: int) -> bytes:
        self.file.seek(int(self.begins[i]))
        data = [self.file.read(int(s)) for s in self.planes[i]]
        return from_planes([self.unpacker.decompress(p) if p else None for p in data], int(self.sizes[i]), self.bits).tobytes()

    def documents(self):
        """(doc_id, place in the file, ids as bytes) in file order."""
        held, at, place = b"", 0, 0
        for doc_id, n in zip(self.ids, self.counts):
            need, parts = int(n) * 4, []
            while len(held) < need:
                parts.append(held)
                need -= len(held)
                held = self.block(at)
                at += 1
            parts.append(held[:need])
            held = held[need:]
            yield doc_id, place, b"".join(parts)
            place += int(n)

    def document(self, i: int) -> bytes:
        """Ids of the i-th document; only its blocks are read."""
        low = int(self.counts[:i].sum())
        high = low + int(self.counts[i])
        ends = np.cumsum(self.sizes.astype(np.int64))
        first, last = int(np.searchsorted(ends, low, "right")), int(np.searchsorted(ends, high, "left"))
        if low == high:
            return b""
        data = b"".join(self.block(b) for b in range(first, last + 1))
        begin = low - (int(ends[first - 1]) if first else 0)
        return data[begin * 4 : (begin + high - low) * 4]


def write_tokens(spark: SparkSession, docs: DataFrame, folder: str, vocabulary: str, kind: str = "word", end_id: int = 1, bits: bool = False, level: int = 1, added: bool = False) -> list[tuple]:
    """Write all documents' ids below ``folder``; gives the manifest (part, file, documents, ids), one row a file.

    A null text is empty: it has the end id alone. Documents of one ``doc_id`` are ordered by text; a null
    ``doc_id`` comes first. A retried task writes its file again, whole. ``added``: see CachedEncoder.
    """
    end = struct.pack("<I", end_id)

    def write(batches):
        from lectern.llm.tokenization import encoder

        enc = encoder(vocabulary, kind, added)
        part = TaskContext.get().partitionId()
        name = f"{folder}/part-{part:06d}.ids"
        with whole_file(name) as file:
            out = Writer(file, bits, level)
            for batch in batches:
                ids, texts = batch.column(0), batch.column(1)
                for at in range(0, batch.num_rows, 256):
                    for d, e in zip(ids[at : at + 256].to_pylist(), enc.encode(texts[at : at + 256].to_pylist())):
                        out.add(d, e + end)
            out.finish()
        if out.ids:
            yield pa.RecordBatch.from_pydict({"part": [part], "file": [name], "docs": [len(out.ids)], "ids": [sum(out.counts)]}, pa.schema([("part", pa.int32()), ("file", pa.string()), ("docs", pa.int64()), ("ids", pa.int64())]))

    ordered = docs.select("doc_id", text_or_empty().alias("text")).repartitionByRange(partitions(spark), F.col("doc_id").asc_nulls_first())
    rows = ordered.sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text").mapInArrow(write, "part int, file string, docs bigint, ids bigint").collect()
    return sorted(tuple(r) for r in rows)


def read_tokens(spark: SparkSession, manifest: list[tuple]) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, from the files."""
    if not manifest:
        return spark.createDataFrame([], "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")
    files, before = [], 0
    for _, name, _, n in manifest:
        files.append((name, before))
        before += n

    def read(batches):
        schema = pa.schema([(c, pa.int64()) for c in ("doc_id", "start", "n_tokens", "ids_crc32")])
        for batch in batches:
            for row in batch.to_pylist():
                held = []
                for d, place, ids in Reader(row["file"]).documents():
                    held.append((d, row["before"] + place, len(ids) // 4, zlib.crc32(ids)))
                    if len(held) == 4096:
                        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*held)], schema=schema)
                        held = []
                if held:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*held)], schema=schema)

    listed = spark.createDataFrame(files, "file string, before bigint").repartition(len(files), "file")
    return listed.mapInArrow(read, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")


def round_trip(spark: SparkSession, docs: DataFrame, vocabulary: str, **how) -> DataFrame:
    """Write into the shared folder and read back; the files go when the driver ends."""
    ready(spark)
    folder = scratch(spark, "tokens")
    atexit.register(drop, folder)
    return read_tokens(spark, write_tokens(spark, docs, folder, vocabulary, **how))
