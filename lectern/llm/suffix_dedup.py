"""Exact-substring removal over a corpus, by suffix sorting.

Every byte covered by a ``LENGTH``-byte string that also starts earlier (in a document of smaller id, or
earlier in the same one) goes; strings are judged on the input. Nothing of the size of the suffix array
is ever shuffled: equal strings share their anchor (the gram of least hash in them), so

1. texts go into chunk files in the shared folder, and whole copies are told by digest;
2. each chunk sends its distinct anchors' hashes, and those met twice come back;
3. a piece of a chunk sorts the windows of such anchors (deep-shallow, see ``suffixes``), marks what starts earlier in
   the piece itself; the bytes of the windows that are its first are sent on, in one row a chunk and bucket;
4. the firsts of all pieces meet by anchor, in as many levels as keep a meeting small, and are sorted again, some anchors at a time;
5. marks go back to the chunks, which drop the bytes.

A hot string is sent once a piece, not once an occurrence. Rows are as many as chunks times buckets, and each step takes a row once.
"""

from __future__ import annotations

import atexit
import hashlib
import uuid
import zlib
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import drop, give_back, partitions, ready, saved, scratch
from .suffixes import LENGTH, anchors, characters, equal_classes, later_members, minima, runs, spread

CHUNK = 8 << 20
PIECE = 1 << 20
#: Pieces whose firsts meet in one group; more pieces make more levels.
FAN = 4096
#: Bytes of text whose anchors (and windows) a bucket is planned for.
BUCKET_BYTES = 16 << 20
#: Windows that are sorted at a time; one anchor's stay together.
BLOCK = 1 << 18
#: Bytes of a batch that is handed on.
BATCH = 2 << 20

_LISTED = "chunk string, at int, doc_id bigint, digest binary, size bigint"


def write_chunks(docs: DataFrame, folder: str, chunk: int = CHUNK) -> DataFrame:
    """Chunk files with all columns; a row a document. A task names its own files, so a lost attempt's are never read."""

    def apply(batches):
        give_back()
        held, size = [], 0

        def flush():
            table = pa.Table.from_batches(held).combine_chunks()
            name = uuid.uuid4().hex
            with pa.OSFile(f"{folder}/{name}", "wb") as out, pa.ipc.new_file(out, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
                w.write_table(table, max_chunksize=table.num_rows)
            data, offsets = text_bytes(table)
            raw = memoryview(data)
            ends = offsets.tolist()
            digests = [hashlib.blake2b(raw[a:b], digest_size=16).digest() for a, b in zip(ends, ends[1:])]
            n = table.num_rows
            return pa.RecordBatch.from_arrays([pa.array([name] * n), pa.array(range(n), pa.int32()), table.column("doc_id").combine_chunks() if n else pa.array([], pa.int64()), pa.array(digests, pa.binary()), pa.array(np.diff(offsets))], names=["chunk", "at", "doc_id", "digest", "size"])

        for batch in batches:
            texts, low = batch.column("text"), 0
            for k in range(batch.num_rows):
                size += texts[k].as_buffer().size if texts[k].is_valid else 0
                if size >= chunk:
                    held.append(batch.slice(low, k + 1 - low))
                    yield flush()
                    held, size, low = [], 0, k + 1
            if low < batch.num_rows:
                held.append(batch.slice(low))
        if held:
            yield flush()

    return docs.mapInArrow(apply, _LISTED)


def text_bytes(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """All texts' UTF-8 bytes one after another, and the offsets of each."""
    column = table.column("text").cast(pa.large_string()).combine_chunks()
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.large_string())
    column = pa.concat_arrays([column.fill_null("")])
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def read_chunk(folder: str, name: str) -> pa.Table:
    with pa.memory_map(f"{folder}/{name}") as file:
        return pa.ipc.open_file(file).read_all()


class Piece:
    """Windows that start in one stretch of a chunk."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, copies: np.ndarray, low: int, high: int):
        end = min(high + LENGTH - 1, len(data))
        self.low = low
        self.chars = characters(data[low:end])
        self.hashes, self.low_hash = minima(self.chars)
        n = len(self.low_hash)
        starts, stops = offsets[:-1], offsets[1:] - LENGTH + 1
        own = (stops > starts) & (stops > low) & (starts < low + n)
        own[copies] = False
        edge = np.zeros(n + 1, np.int32)
        np.add.at(edge, np.clip(starts[own] - low, 0, n), 1)
        np.add.at(edge, np.clip(stops[own] - low, 0, n), -1)
        self.valid = np.cumsum(edge[:n]) > 0

    def anchor_keys(self) -> np.ndarray:
        """Distinct anchors' keys; the lowest bit tells that the anchor is at two places or more."""
        found, counts = np.unique(spread(anchors(self.hashes, self.low_hash, self.valid)) & ~np.uint64(1), return_counts=True)
        return found | (counts > 1).astype(np.uint64)

    def window_keys(self) -> np.ndarray:
        return spread(self.low_hash) & ~np.uint64(1)


def pieces(data: np.ndarray, offsets: np.ndarray, copies: np.ndarray, size: int):
    for low in range(0, max(len(data) - LENGTH + 1, 0), size):
        yield low, Piece(data, offsets, copies, low, min(low + size, len(data) - LENGTH + 1))


def _parted(keys: np.ndarray, buckets: int) -> list[tuple[int, np.ndarray]]:
    """(bucket, indexes) of the keys."""
    bucket = ((keys >> np.uint64(33)) % np.uint64(buckets)).astype(np.int64)
    return _parted_by(bucket)


def _parted_by(value: np.ndarray) -> list[tuple[int, np.ndarray]]:
    order = np.argsort(value, kind="stable")
    cuts = np.flatnonzero(np.diff(value[order])) + 1
    return [(int(value[part[0]]), part) for part in np.split(order, cuts) if len(part)]


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)


def _batches(rows, schema: pa.Schema):
    """Batches of about ``BATCH`` bytes of the rows, which may be made as they are taken."""
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += sum(len(x) for x in row if isinstance(x, bytes))
        if size >= BATCH:
            yield _batch(held, schema)
            held, size = [], 0
    if held:
        yield _batch(held, schema)


_KEYS = "chunk string, bucket int, data binary"
_KEYS_SCHEMA = pa.schema([("chunk", pa.string()), ("bucket", pa.int32()), ("data", pa.binary())])
# kind 0: windows of a chunk; data has the headers, more the bytes. kind 1: marks of a chunk.
_SENT = "bucket int, salt int, kind int, chunk string, data binary, more binary"
_SENT_SCHEMA = pa.schema([("bucket", pa.int32()), ("salt", pa.int32()), ("kind", pa.int32()), ("chunk", pa.string()), ("data", pa.binary()), ("more", pa.binary())])
#: A stretch of windows of one anchor: its key, its document's id and digest, first window in the document and in the chunk, windows.
_HEAD = np.dtype([("key", "<u8"), ("doc", "<i8"), ("tie", "<u8"), ("start", "<i8"), ("place", "<i8"), ("n", "<i4")])


def _send_keys(chunks: DataFrame, folder: str, buckets: int, size: int) -> DataFrame:
    def apply(batches):
        give_back()
        for batch in batches:
            for row in batch.to_pylist():
                data, offsets = text_bytes(read_chunk(folder, row["chunk"]))
                every = np.sort(np.concatenate([np.zeros(0, np.uint64), *[piece.anchor_keys() for _, piece in pieces(data, offsets, np.array(row["copies"] or [], np.int64), size)]]))
                keys, at, counts = np.unique(every & ~np.uint64(1), return_index=True, return_counts=True)
                keys |= (every[at + counts - 1] & np.uint64(1)) | (counts > 1).astype(np.uint64)
                yield from _batches(((row["chunk"], b, keys[i].tobytes()) for b, i in _parted(keys, buckets)), _KEYS_SCHEMA)

    return chunks.mapInArrow(apply, _KEYS)


def _grouped(batches, columns: list[str]):
    """Rows of each run of equal ``columns`` of sorted input, as lists."""
    key, held = None, []
    for batch in batches:
        for row in batch.to_pylist():
            k = tuple(row[c] for c in columns)
            if k != key:
                if held:
                    yield key, held
                key, held = k, []
            held.append(row)
    if held:
        yield key, held


def _met_twice(keys: DataFrame, parts: int) -> DataFrame:
    """Keys that two chunks have, or one at two places, sent back to their chunks."""

    def apply(batches):
        give_back()
        for _, rows in _grouped(batches, ["bucket"]):
            found = [np.frombuffer(r["data"], np.uint64) for r in rows]
            every = np.sort(np.concatenate(found))
            bare = every & ~np.uint64(1)
            twice = np.zeros(len(bare), bool)
            same = bare[1:] == bare[:-1]
            twice[1:] |= same
            twice[:-1] |= same
            wanted = np.unique(bare[twice | ((every & np.uint64(1)) == 1)])
            if not len(wanted):
                continue
            bare = ((r, f & ~np.uint64(1)) for r, f in zip(rows, found))
            back = ((r, f[wanted[np.minimum(np.searchsorted(wanted, f), len(wanted) - 1)] == f]) for r, f in bare)
            yield from _batches(((r["chunk"], r["bucket"], f.tobytes()) for r, f in back if len(f)), _KEYS_SCHEMA)

    return keys.repartition(parts, "bucket").sortWithinPartitions("bucket").mapInArrow(apply, _KEYS)


def _marks(place: np.ndarray) -> bytes:
    """Window starts as (first, count) runs."""
    place = np.unique(place)
    if not len(place):
        return b""
    cut = np.flatnonzero(np.diff(place) != 1) + 1
    first = place[np.concatenate([[0], cut])]
    count = np.diff(np.concatenate([[0], cut, [len(place)]]))
    return np.stack([first, count], 1).astype("<i8").tobytes()


def _spread(chunk: str) -> int:
    """Salt of a chunk's marks, which go from level to level in a group of their own (bucket -1)."""
    return zlib.crc32(chunk.encode()) >> 1


def _send_windows(shared: DataFrame, chunks: DataFrame, folder: str, buckets: int, salts: int, parts: int, size: int) -> DataFrame:
    """Local marks, and the windows of shared anchors that are the first in their piece."""

    def apply(batches):
        give_back()
        for (name,), rows in _grouped(batches, ["chunk"]):
            keys = np.unique(np.concatenate([np.zeros(0, np.uint64), *[np.frombuffer(r["data"], np.uint64) for r in rows if r["data"] is not None]]))
            if not len(keys):
                continue
            copies = np.array(next((r["copies"] for r in rows if r["copies"]), None) or [], np.int64)
            table = read_chunk(folder, name)
            data, offsets = text_bytes(table)
            ids = table.column("doc_id").to_pylist()
            raw = memoryview(data)
            marks, heads = zip(*(sort_piece(low, piece, offsets, ids, raw, keys) for low, piece in pieces(data, offsets, copies, size)))
            salt = int.from_bytes(hashlib.blake2b(name.encode(), digest_size=4).digest(), "big") % salts
            head = np.concatenate(heads)
            out = ((b, salt, 0, name, head[some].tobytes(), b"".join([raw[p : p + n + LENGTH - 1] for p, n in zip(head["place"][some].tolist(), head["n"][some].tolist())])) for b, some in _parted(head["key"], buckets))
            local = b"".join(marks)
            yield from _batches(chain([(-1, _spread(name), 1, name, local, None)] if local else [], out), _SENT_SCHEMA)

    def sort_piece(low, piece, offsets, ids, raw, keys):
        """Marks of the windows that start earlier in the piece, and the stretches of those that don't."""
        window = piece.window_keys()
        turn = np.flatnonzero(np.concatenate([[True], window[1:] != window[:-1]])) if len(window) else np.zeros(0, np.int64)
        at = np.minimum(np.searchsorted(keys, window[turn]), len(keys) - 1)
        hot = np.repeat(keys[at] == window[turn], np.diff(np.concatenate([turn, [len(window)]]))) & piece.valid
        pos = np.flatnonzero(hot)
        if not len(pos):
            return b"", np.zeros(0, _HEAD)
        doc = np.searchsorted(offsets, pos + low, "right") - 1
        # Documents of the piece in corpus order: id, then digest of the text.
        present = np.unique(doc)
        tie = {d: int.from_bytes(hashlib.blake2b(raw[offsets[d] : offsets[d + 1]], digest_size=16).digest()[:8], "big") for d in present.tolist()}
        order = sorted(present.tolist(), key=lambda d: (_MIN if ids[d] is None else ids[d], tie[d], d))
        place_of = np.zeros(len(offsets), np.int64)
        place_of[order] = np.arange(len(order))
        rank = place_of[doc] * np.int64(1 << 40) + pos
        later = later_members(*equal_classes(piece.chars, pos, window[pos]), rank)
        marks = _marks(pos[later] + low)
        hot[pos[later]] = False
        pos = np.flatnonzero(hot)
        doc = np.searchsorted(offsets, pos + low, "right") - 1
        first = np.flatnonzero(np.concatenate([[True], (np.diff(pos) != 1) | (np.diff(doc) != 0) | (window[pos][1:] != window[pos][:-1])]))
        head = np.empty(len(first), _HEAD)
        head["key"], head["n"] = window[pos[first]], np.diff(np.concatenate([first, [len(pos)]]))
        d = doc[first]
        head["doc"] = [_MIN if ids[k] is None else ids[k] for k in d.tolist()]
        head["tie"] = [tie[k] for k in d.tolist()]
        head["place"] = pos[first] + low
        head["start"] = head["place"] - offsets[d]
        return marks, head

    joined = shared.select("chunk", "data", F.lit(None).cast("array<int>").alias("copies")).unionByName(chunks.select("chunk", F.lit(None).cast("binary").alias("data"), "copies"))
    return joined.repartition(parts, "chunk").sortWithinPartitions("chunk").mapInArrow(apply, _SENT)


_MIN = -(1 << 63)


def _blocks(head: np.ndarray) -> list[np.ndarray]:
    """Indexes of the stretches by anchor, cut between anchors after about ``BLOCK`` windows."""
    order = np.argsort(head["key"], kind="stable")
    key, before = head["key"][order], np.cumsum(head["n"][order]) - head["n"][order]
    new = np.concatenate([[True], key[1:] != key[:-1]])
    block = (before // BLOCK)[np.maximum.accumulate(np.where(new, np.arange(len(key)), 0))]
    return np.split(order, np.flatnonzero(np.diff(block)) + 1)


def _sorted(head: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of windows that are alike in whether they start earlier: stretch, first window in it, windows, and whether they do."""
    n = head["n"].astype(np.int64)
    sizes = n + LENGTH - 1
    of = np.repeat(np.arange(len(head)), n)
    step = np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)
    by = np.lexsort((head["start"], head["tie"], head["doc"]))
    place = np.empty(len(head), np.int64)
    place[by] = np.arange(len(by))
    # Stretches of one document don't overlap, so stretch order then step is corpus order.
    rank = place[of] * np.int64(1 << 32) + step
    gone = np.zeros(len(of), bool)
    gone[later_members(*equal_classes(characters(data), (np.cumsum(sizes) - sizes)[of] + step, head["key"][of]), rank)] = True
    at = np.flatnonzero(np.concatenate([[True], (of[1:] != of[:-1]) | (gone[1:] != gone[:-1])]))
    return of[at], step[at], np.diff(np.append(at, len(of))), gone[at]


def _meet(sent: DataFrame, salts: int, next_salts: int, parts: int) -> DataFrame:
    """Sort the windows that meet; marks for all but the first of each, which goes on to the next level if there is one."""

    def apply(batches):
        give_back()
        for (bucket, salt), rows in _grouped(batches, ["bucket", "salt"]):
            yield from _batches(((bucket, salt, 1, r["chunk"], r["data"], None) for r in rows if r["kind"] == 1), _SENT_SCHEMA)
            if rows := [r for r in rows if r["kind"] == 0]:
                yield from _batches(met(bucket, salt, [r["chunk"] for r in rows], [r["data"] for r in rows], [memoryview(r["more"]) for r in rows]), _SENT_SCHEMA)

    def met(bucket, salt, chunks, heads, more):
        owner = np.repeat(np.arange(len(heads)), [len(h) // _HEAD.itemsize for h in heads])
        head = np.frombuffer(b"".join(heads), _HEAD)
        sizes = head["n"].astype(np.int64) + LENGTH - 1
        begin = np.cumsum(sizes) - sizes
        begin -= begin[np.searchsorted(owner, owner)]
        marks, firsts = [], []
        for some in _blocks(head):
            data = b"".join([more[k][a : a + n] for k, a, n in zip(owner[some].tolist(), begin[some].tolist(), sizes[some].tolist())])
            of, step, n, gone = _sorted(head[some], np.frombuffer(data, np.uint8))
            at = some[of]
            marks.append((owner[at[gone]], np.stack([head["place"][at] + step, n], 1)[gone]))
            if next_salts:
                part = head[at]
                part["place"] += step
                part["start"] += step
                part["n"] = n
                firsts.append((owner[at[~gone]], (begin[at] + step)[~gone], part[~gone]))
        who, runs_ = (np.concatenate(x) for x in zip(*marks))
        for k, some in _parted_by(who):
            yield -1, _spread(chunks[k]), 1, chunks[k], runs_[some].astype("<i8").tobytes(), None
        if next_salts:
            who, at, part = (np.concatenate(x) for x in zip(*firsts))
            for k, some in _parted_by(who):
                yield bucket, salt % next_salts, 0, chunks[k], part[some].tobytes(), b"".join([more[k][a : a + n + LENGTH - 1] for a, n in zip(at[some].tolist(), part["n"][some].tolist())])

    return sent.repartition(parts, "bucket", "salt").sortWithinPartitions("bucket", "salt").mapInArrow(apply, _SENT)


def _apply_marks(marks: DataFrame, chunks: DataFrame, folder: str, parts: int, finish, schema) -> DataFrame:
    """``finish`` gets each chunk's table, bytes, offsets and mask of removed bytes, and gives a record batch."""

    def apply(batches):
        give_back()
        for (name,), rows in _grouped(batches, ["chunk"]):
            table = read_chunk(folder, name)
            data, offsets = text_bytes(table)
            edge = np.zeros(len(data) + 1, np.int32)
            for r in rows:
                if r["data"]:
                    first, count = np.frombuffer(r["data"], "<i8").reshape(-1, 2).T
                    np.add.at(edge, first, 1)
                    np.add.at(edge, first + count + LENGTH - 1, -1)
                for k in r["copies"] or []:
                    edge[offsets[k]] += 1
                    edge[offsets[k + 1]] -= 1
            yield from finish(table, data, offsets, np.cumsum(edge[: len(data)]) > 0)

    joined = marks.where("kind = 1").select("chunk", "data", F.lit(None).cast("array<int>").alias("copies")).unionByName(chunks.select("chunk", F.lit(None).cast("binary").alias("data"), "copies"))
    return joined.repartition(parts, "chunk").sortWithinPartitions("chunk").mapInArrow(apply, schema)


def _report(table, data, offsets, gone):
    rows, raw = [], data
    for d, (doc_id, a, b) in enumerate(zip(table.column("doc_id").to_pylist(), offsets.tolist(), offsets[1:].tolist())):
        mask = gone[a:b]
        removed = int(mask.sum())
        spans = len(runs(mask)[0]) if removed else 0
        rows.append((doc_id, b - a, removed, spans, hashlib.sha256(raw[a:b][~mask].tobytes() if removed else raw[a:b].tobytes()).hexdigest()))
    if rows:
        yield _batch(rows, pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string())]))


def _cleaned(table, data, offsets, gone):
    """The rows with the bytes removed; characters cut through are dropped whole; rows left without text go."""
    texts, valid = [], table.column("text").is_valid().to_pylist()
    keep = []
    for a, b, has in zip(offsets.tolist(), offsets[1:].tolist(), valid):
        mask = gone[a:b]
        text = data[a:b][~mask].tobytes().decode("utf-8", "ignore") if has else None
        texts.append(text)
        keep.append(not (mask.any() and not (text or "").strip()))
    column = table.schema.get_field_index("text")
    table = table.set_column(column, "text", pa.array(texts, table.schema.field("text").type)).filter(pa.array(keep, pa.bool_()))
    yield from table.combine_chunks().to_batches()


def _run(spark: SparkSession, docs: DataFrame, finish, schema, fan: int, chunk: int = CHUNK, piece: int = PIECE) -> DataFrame:
    ready(spark)
    folder = scratch(spark, "suffixes")
    atexit.register(drop, folder)
    listed = saved(write_chunks(docs, folder, chunk))
    first = listed.where(F.col("size") >= LENGTH).groupBy("digest").agg(F.min(F.struct("doc_id", "chunk", "at")).alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    copies = listed.where(F.col("size") >= LENGTH).join(first, "digest").where((F.col("chunk") != F.col("first.chunk")) | (F.col("at") != F.col("first.at"))).groupBy("chunk").agg(F.sort_array(F.collect_list("at")).alias("copies"))
    # A chunk's copies are at most its documents.
    sizes = listed.groupBy("chunk").agg(F.sum("size").alias("size"))
    total = sizes.agg(F.sum("size").alias("bytes"), F.sum(F.floor(F.col("size") / piece) + 1).alias("pieces")).first()
    if total["bytes"] is None:
        return listed.sparkSession.createDataFrame([], schema)
    chunks = saved(sizes.join(copies, "chunk", "left").select("chunk", "copies").repartition(partitions(spark), "chunk"))
    parts = partitions(spark)
    buckets = max(parts, -(-total["bytes"] // BUCKET_BYTES))
    levels = 1
    while fan**levels < total["pieces"]:
        levels += 1
    salts = [fan ** (levels - 1 - k) for k in range(levels)]
    shared = _met_twice(_send_keys(chunks, folder, buckets, piece), parts)
    sent = _send_windows(shared, chunks, folder, buckets, salts[0], parts, piece)
    for k in range(levels):
        sent = _meet(sent, salts[k], salts[k + 1] if k + 1 < levels else 0, parts)
    return _apply_marks(sent, chunks, folder, parts, finish, schema)


def removed_bytes(spark: SparkSession, docs: DataFrame, fan: int = FAN, chunk: int = CHUNK, piece: int = PIECE) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every row of ``docs``.

    A null text counts as empty. Documents of one doc_id are ordered by a digest of their text; rows alike in both
    are copies, of which one is the first. A null doc_id comes before all others. Other columns are ignored.
    """
    return _run(spark, docs.select("doc_id", "text"), _report, "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string", fan, chunk, piece)


def remove_repeats(spark: SparkSession, docs: DataFrame, fan: int = FAN) -> DataFrame:
    """The rows of ``docs``, all columns, with the repeated bytes cut from their texts; rows of which only white space is left go."""
    return _run(spark, docs, _cleaned, docs.schema, fan)
