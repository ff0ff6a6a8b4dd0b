"""Best-fit packing of documents into sequences, with lower bounds that certify the bin counts.

Documents are tokenised once; a document longer than a sequence is cut into whole pieces (its first
piece may be shorter). Pieces are spread over groups of bounded size; each group runs best-fit
decreasing and gets a lower bound from dual-feasible functions. While the sum of bins exceeds the
bound of the whole table, groups exchange the pieces of all bins that are not full (groups that meet
their own bound exactly and have only full bins are finished) and run again, in fewer groups each time.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ready, saved, text_or_empty, trim

#: Pieces that one task packs at a time.
GROUP = 20_000
#: Rounds of exchange at most; each but the last must save bins.
ROUNDS = 6

PIECES = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, lot bigint"
PACKED = PIECES + ", grp int, bin int, offset bigint, fill bigint, bins int, bound int"


def lower_bound(counts: np.ndarray, capacity: int) -> int:
    """Bins that items need at least; ``counts[s]`` items have size s (0 to capacity).

    Dual-feasible functions: the identity; the threshold family (items over capacity - e count whole,
    items under e not at all); the rounding family x -> floor((k+1)x)/k with fixed points.
    """
    sizes = np.arange(capacity + 1, dtype=np.int64)
    total = int((counts * sizes).sum())
    best = -(-total // capacity)
    used = np.flatnonzero(counts[: capacity // 2 + 1])
    n, v = np.cumsum(counts), np.cumsum(counts * sizes)
    for e in used:
        if e == 0:
            continue
        over = int(n[capacity] - n[capacity - e])
        middle = int(v[capacity - e] - v[e - 1])
        best = max(best, over + -(-middle // capacity))
    for k in range(1, 101):
        scaled = (k + 1) * sizes
        whole = scaled % capacity == 0
        f = np.where(whole, sizes * k, (scaled // capacity) * capacity)  # in units of 1 / (k * capacity)
        best = max(best, -(-int((counts * f).sum()) // (k * capacity)))
    return best


def best_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bin and offset of each item and the fill of each bin. An item goes to the fullest bin that takes it."""
    order = np.argsort(-lengths, kind="stable")
    bins, offsets = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    fills: list[int] = []
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    mask = 0  # bit r: there is a bin with room r
    for i, size in zip(order.tolist(), lengths[order].tolist()):
        fit = mask >> size
        if fit:
            room = size + (fit & -fit).bit_length() - 1
            b = by_room[room].pop()
            if not by_room[room]:
                mask ^= 1 << room
        else:
            room, b = capacity, len(fills)
            fills.append(0)
        bins[i], offsets[i] = b, fills[b]
        fills[b] += size
        left = room - size
        if left:
            by_room[left].append(b)
            mask |= 1 << left
    return bins, offsets, np.array(fills, np.int64)


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n ids: whole sequences, the rest first."""
    if n <= capacity:
        return [(0, n)]
    rest = n % capacity
    first = [(0, rest)] if rest else []
    return first + [(s, capacity) for s in range(rest, n, capacity)]


def pieces_of(docs: DataFrame, vocabulary: str, kind: str, end_id: int, capacity: int, added: bool = False, cache: int | None = None) -> DataFrame:
    end = int(end_id).to_bytes(4, "little")

    def tokenise(batches):
        from lectern.llm.tokenization import encoder

        trim()
        enc, seen = encoder(vocabulary, kind, added, cache), TaskContext.get().partitionId() << 40
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                ids, texts = batch.column(0)[at : at + 2048].to_pylist(), batch.column(1)[at : at + 2048].to_pylist()
                rows = []
                for d, e in zip(ids, enc.encode(texts)):
                    e += end
                    for k, (s, n) in enumerate(cut(len(e) // 4, capacity)):
                        rows.append((d, k, s, n, zlib.crc32(e[4 * s : 4 * (s + n)]), seen))
                        seen += 1
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), _PIECE_TYPES)], names=_PIECE_NAMES)

    return docs.select("doc_id", text_or_empty().alias("text")).mapInArrow(tokenise, PIECES)


_PIECE_NAMES = ["doc_id", "piece", "start", "length", "ids_crc32", "lot"]
_PIECE_TYPES = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64()]


def _pack_round(pieces: DataFrame, groups: int, capacity: int, number: int) -> DataFrame:
    def pack(group: pa.Table) -> pa.Table:
        group = group.combine_chunks().sort_by("lot")
        lengths = group.column("length").to_numpy()
        bins, offsets, fills = best_fit_decreasing(lengths, capacity)
        bound = lower_bound(np.bincount(lengths, minlength=capacity + 1), capacity)
        n = group.num_rows
        for name, values, kind in (("bin", bins, pa.int32()), ("offset", offsets, pa.int64()), ("fill", fills[bins], pa.int64()), ("bins", np.full(n, len(fills)), pa.int32()), ("bound", np.full(n, bound), pa.int32())):
            group = group.append_column(name, pa.array(values, kind))
        return group

    spread = F.pmod(F.xxhash64("lot", F.lit(number)), F.lit(groups)).cast("int")
    return pieces.withColumn("grp", spread).groupBy("grp").applyInArrow(pack, PACKED)


def pack_documents(spark: SparkSession, docs: DataFrame, vocabulary: str, kind: str = "byte", end_id: int = 2, capacity: int = 1024, added: bool = False, cache: int | None = None) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset, certified, for every piece of every document.

    A null text is empty and gives a piece with the end id alone. Repeated rows are packed each for itself;
    a null doc_id stays null. An empty table gives an empty result. ``certified``: the piece's group
    met its lower bound in the round that placed it. ``added``: see CachedEncoder; ``cache``: what
    its worker remembers, which takes some 200 bytes an entry. Other columns are ignored.
    """
    ready(spark)
    waiting = saved(pieces_of(docs, vocabulary, kind, end_id, capacity, added, cache))
    sizes = waiting.groupBy("length").count().collect()  # at most ``capacity`` rows
    counts = np.zeros(capacity + 1, np.int64)
    for r in sizes:
        counts[r["length"]] = r["count"]
    goal, finished, n_finished, last, fewest = lower_bound(counts, capacity), [], 0, None, None
    n = int(counts.sum())
    for number in range(ROUNDS if n else 0):
        groups = max(1, -(-n // GROUP))
        packed = saved(_pack_round(waiting, groups, capacity, number))
        by_group = packed.groupBy("grp").agg(
            F.first("bins").alias("bins"),
            F.sum(F.when(F.col("fill") == capacity, F.col("length")).otherwise(0)).alias("full"),
            F.count(F.when(F.col("fill") < capacity, 1)).alias("rest"),
        )
        got = by_group.agg(F.sum("bins").alias("bins"), F.sum("full").alias("full"), F.sum("rest").alias("rest")).first()
        total = n_finished + got["bins"]
        if last is not None and total >= fewest:
            break  # the exchange saved nothing: the former places stand
        if last is not None:
            finished.append(last.where(F.col("fill") == capacity))
        last = packed.withColumn("sequence_id", F.lit(number).cast("long") * (1 << 56) + F.col("grp").cast("long") * (1 << 24) + F.col("bin"))
        fewest, n = total, got["rest"]
        if total <= goal or groups == 1 or not n:
            break
        n_finished += got["full"] // capacity
        waiting = packed.where(F.col("fill") < capacity).select("doc_id", "piece", "start", "length", "ids_crc32", "lot")
    if last is None:
        last = waiting.selectExpr("*", "0L as sequence_id", "0L as offset", "0 as bins", "0 as bound").limit(0)
        finished = []
    out = last
    for part in finished:
        out = out.unionByName(part)
    return out.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset", (F.col("bins") == F.col("bound")).alias("certified"))
