"""Near-duplicate classes: SimHash signatures in an LSH forest, exact Jaccard verification.

Texts with the same set of five-word windows are one node. A node has a 256-bit SimHash of its set. The
forest has several tries, each over bits in an order of its own; a node's label in a trie is the first ``LABEL`` bits
of its signature in that order. Sorted labels are the trie: nodes that share a prefix lie together.

A prefix is divided until a subtree holds ``LEAF`` nodes at most, so leaves are as deep as their part of the space is dense;
leaves compare their nodes, and the search climbs from there, a bit at a time: at each shorter prefix the
nodes of its two subtrees meet. It stops at the depth where all tries together reach the target recall at the similarity
threshold. That depth and the number of tries follow the number of nodes, by cost. The recall is the joint one of
all tries, which read the same signature: a sum over the Hamming distances of a pair, within the radius and within what a label shows of it.

A subtree over ``HOT`` nodes climbs with fewer: those close to another one, which stands for them, stay behind. Where more
than ``HOT`` are left on either side the climb ends; what is left forms a denser forest of its own, with deeper prefixes
and as many tries as the recall needs, until nothing is left. Beyond ``DEEPEST`` bits all that meet are compared, whatever their number.
The forests share what may be missed.

The signature bits of very small sets differ more than their similarity says. Sets of up to ``SMALL`` windows aren't in the
forest: they and the sets they can be similar to are joined exactly, on the rarest windows of each.

Pairs within a Hamming radius are candidates; of pairs that are both close to a third node only those with that node are
sent on. Candidates are verified on their whole sets, each node's nearest first and then those that aren't connected yet; where a
pair fails, the pairs that its nodes stood for are verified as well, as far as their signatures allow. Classes are the
components of verified pairs.

Sets to verify go in groups: nodes with a partner in common are held together, and a set is sent once to each group that it has partners in.

Entries of the tries are three numbers (label, rest of the label, node number), so the forest shuffles 24 bytes an entry and never a text.
"""

from __future__ import annotations

import hashlib
import math
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import bucketed, give_back, partitions, ready, saved, spread_join, unused
from .graph import components
from .words import shingle_sets, slices

BITS = 256
WIDTH, SIMILARITY, RECALL = 5, 0.8, 0.99
#: Bits of a label in the first number (below the trie's number) and in both.
HEAD, LABEL = 52, 116
LEAF, HOT = 1024, 4096
DEEPEST = 36
#: What an entry costs, in comparisons: it is sorted and shuffled.
ENTRY = 2000
SMALL = 40
#: Bytes of a window's hash that a set is verified by: two unlike windows of a pair agree in one of 10**7 pairs of usual size.
SHOWN = 5
#: Sets that a group holds to be compared with those sent to it, and their bytes.
STAR, STAR_BYTES = 256, 4 << 20
#: Pairs of a node that are verified in each round; the last has all that are left.
NEAREST = (2, 8, None)
#: A node stands for others that are as near as sets of this similarity are.
CLOSE = 0.88
#: Document ids up to this number (16 bytes each) are sent to all executors; more are joined by shuffle.
BROADCAST_IDS = 1 << 20
_BLOCK = 2_000_000
_MIX = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)]
_BYTE_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).astype(np.int32) * 2 - 1
_SIG = ["s0", "s1", "s2", "s3"]


def bit_agreement(similarity: float) -> float:
    """Chance that a signature bit agrees for two sets of like size with this Jaccard similarity."""
    return 1 - math.acos(min(1.0, 2 * similarity / (1 + similarity))) / math.pi


def radius(similarity: float, deviations: float) -> int:
    p = 1 - bit_agreement(similarity)
    return int(BITS * p + deviations * math.sqrt(BITS * p * (1 - p)))


@lru_cache
def bit_gap(similarity: float) -> float:
    """Largest chance that a signature bit differs for two sets of at least this similarity in the forest, exact in the sets' sizes."""

    def tosses(n):
        return np.array([math.comb(n, k) for k in range(n + 1)]) / 2.0**n, 2 * np.arange(n + 1) - n

    def gap(shared, a, b):
        weights, values = tosses(shared)
        one, two = ((values[:, None] + v > 0) @ w for w, v in (tosses(a), tosses(b)))
        return float(weights @ (one * (1 - two) + two * (1 - one)))

    most = 1 - bit_agreement(similarity)
    for union in range(SMALL + 1, 2 * SMALL + 1):
        shared = math.ceil(similarity * union - 1e-9)
        most = max([most, *(gap(shared, a, union - shared - a) for a in range((union - shared) // 2 + 1))])
    return most


@lru_cache
def _distances(similarity: float) -> np.ndarray:
    """Chance of each Hamming distance of a pair at the similarity."""
    p = bit_gap(similarity)
    return np.array([math.comb(BITS, h) * p**h * (1 - p) ** (BITS - h) for h in range(BITS + 1)])


@lru_cache
def reach(similarity: float, recall: float) -> int:
    """The radius beyond which lies a tenth of what may be missed."""
    return int(np.searchsorted(np.cumsum(_distances(similarity)), 1 - (1 - recall) / 10))


@lru_cache
def _shown(depth: int, h: int) -> np.ndarray:
    """Chance that a label shows at most 0, 1, ... differing bits beyond a shared prefix, of ``h`` in all."""
    n, all_ = LABEL - depth, math.comb(BITS - depth, h)
    return np.cumsum([math.comb(n, k) * math.comb(BITS - depth - n, h - k) / all_ if h - k <= BITS - depth - n else 0.0 for k in range(min(n, h) + 1)])


@lru_cache
def label_reach(depth: int, near: int) -> int:
    """Differing bits that a label may show: 98 of 100 pairs at the radius show no more."""
    return int(np.searchsorted(_shown(depth, near), 0.98))


@lru_cache
def _chances(depth: int, near: int) -> np.ndarray:
    """Chance that one trie finds a pair at each Hamming distance: the prefix is shared and the label shows little."""
    most = label_reach(depth, near)
    share = [math.comb(BITS - depth, h) / math.comb(BITS, h) for h in range(near + 1)]
    return np.array([s * _shown(depth, h)[min(most, len(_shown(depth, h)) - 1)] for h, s in enumerate(share)])


def joint_recall(depth: int, tries: int, similarity: float, near: int) -> float:
    """Chance that a pair at the similarity is within the radius and found in some trie; all tries read the same signature."""
    return float(_distances(similarity)[: near + 1] @ (1 - (1 - _chances(depth, near)) ** tries))


@lru_cache
def tries_for(depth: int, similarity: float, recall: float) -> int:
    near, high = reach(similarity, recall), 1
    while joint_recall(depth, high, similarity, near) < recall:
        high *= 2
    low = high // 2
    while high - low > 1:
        mid = (low + high) // 2
        low, high = (low, mid) if joint_recall(depth, mid, similarity, near) >= recall else (mid, high)
    return high


def plan(nodes: int, similarity: float = SIMILARITY, recall: float = RECALL, least: int = 4) -> tuple[int, int]:
    """(depth, tries): the depth that the climb ends at, from that of one node a prefix upwards as long as that costs less."""
    depth = max(least, min(DEEPEST, math.ceil(math.log2(max(nodes, 2)))))
    cost = lambda d: tries_for(d, similarity, recall) * (ENTRY + nodes / 2 ** (d + 1))
    while depth > least and cost(depth - 1) <= cost(depth):
        depth -= 1
    return depth, tries_for(depth, similarity, recall)


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """256-bit SimHash of each set, as (sets x 32) bytes."""
    sizes = np.fromiter(map(len, sets), np.int64, len(sets))
    if not sizes.sum():
        return np.zeros((len(sets), BITS // 8), np.uint8)
    h = np.concatenate(sets)
    row = np.repeat(np.arange(len(sets)) * 256, sizes)
    out = np.empty((len(sets), BITS // 8), np.uint8)
    for w, mix in enumerate(_MIX):
        x = (h ^ (h >> np.uint64(33))) * mix
        x ^= x >> np.uint64(29)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(32)
        data = x.view(np.uint8).reshape(-1, 8)
        for b in range(8):
            counts = np.bincount(row + data[:, b], minlength=256 * len(sets)).reshape(-1, 256).astype(np.int32)
            out[:, 8 * w + b] = np.packbits(counts @ _BYTE_BITS > 0, axis=1)[:, 0]
    return out


def node_of(found: np.ndarray) -> bytes:
    return hashlib.blake2b(found.tobytes(), digest_size=16).digest() if len(found) else b""


_MARKS = "doc_id bigint, node binary, num bigint, s0 bigint, s1 bigint, s2 bigint, s3 bigint, size int, few binary, alike binary"
_MARK_NAMES = ["doc_id", "node", "num", *_SIG, "size", "few", "alike"]


def fingerprint(docs: DataFrame, few: int, alike: bool = False) -> DataFrame:
    """Of each row the node and its number in the forest, signature, size, the set itself where it has ``few`` windows at most, and with ``alike`` the text's MD5; a null text has no node."""

    def apply(batches):
        give_back()
        for batch in batches:
            ids, texts, sums = batch.columns
            for low, high in slices(texts, _BLOCK):
                some = texts[low:high].to_pylist()
                sets = shingle_sets([x or "" for x in some], WIDTH)
                sigs = signatures(sets).view("<i8")
                nodes = [None if t is None else node_of(s) for t, s in zip(some, sets)]
                nums = [None if n is None else int.from_bytes(n[:8], "little", signed=True) for n in nodes]
                columns = [ids[low:high], pa.array(nodes, pa.binary()), pa.array(nums, pa.int64()), *[pa.array(np.ascontiguousarray(sigs[:, k])) for k in range(4)], pa.array([len(s) for s in sets], pa.int32()), pa.array([s.tobytes() if 0 < len(s) <= few else None for s in sets], pa.binary()), sums[low:high]]
                yield pa.RecordBatch.from_arrays(columns, names=_MARK_NAMES)

    md5 = F.unhex(F.md5("text")) if alike else F.lit(None).cast("binary")
    return docs.select("doc_id", "text", md5.alias("alike")).mapInArrow(apply, _MARKS)


class Climb:
    """One prefix of a trie: sorted labels (``head``, ``rest``) and node numbers, searched from the leaves up to ``depth``.

    ``pairs`` gets (a, b, tight); of pairs that are both tight to one node (``a``), which stands for them, only those with it.
    """

    def __init__(self, head: np.ndarray, rest: np.ndarray, num: np.ndarray, depth: int, near: int, tight: int, hot: int, whole: bool = False):
        self.head, self.rest, self.num = head.view(np.uint64), rest.view(np.uint64), num
        self.depth, self.near, self.tight, self.hot, self.whole = depth, near, tight, hot, whole
        self.stood = np.full(len(num), -1)  # the node that stands for this one
        self.over = False
        self.pairs: tuple[list, list, list] = ([], [], [])

    def run(self) -> np.ndarray:
        """What is left for a denser forest: nothing, unless the prefix holds too many."""
        alive = self._climb(0, len(self.num), self.depth)
        return self.staying(alive) if self.over else alive[:0]

    def staying(self, at: np.ndarray) -> np.ndarray:
        """Nodes that no other stands for."""
        return at[(self.stood[at] < 0) | (self.stood[at] == at)]

    def _climb(self, low: int, high: int, depth: int) -> np.ndarray:
        if high - low <= min(LEAF, self.hot):
            own = np.arange(low, high)
            self._meet(own, own, True)
            return own
        if depth < HEAD:
            mid = low + int(np.searchsorted((self.head[low:high] >> np.uint64(HEAD - 1 - depth)) & np.uint64(1), 1))
        else:
            mid = (low + high) // 2
        if mid in (low, high):
            return self._climb(low, high, depth + 1)
        left, right = self._climb(low, mid, depth + 1), self._climb(mid, high, depth + 1)
        if len(left) + len(right) > self.hot:
            left, right = self.staying(left), self.staying(right)
            self.over |= not self.whole and max(len(left), len(right)) > self.hot
        if not self.over:
            self._meet(left, right, False)
        return np.concatenate([left, right])

    def _meet(self, rows: np.ndarray, cols: np.ndarray, same: bool) -> None:
        """Compare rows with columns, least numbers first, so that the pairs don't depend on the order of arrival.

        Where two subtrees meet, nodes that stand for others come first: if they are close, one's nodes pass to the other.
        """
        leads = np.zeros(len(rows), bool) if same else self.stood[rows] == rows
        rows = rows[np.lexsort((self.num[rows], ~leads))]
        cols = rows if same else cols[np.argsort(self.num[cols], kind="stable")]
        step = max(1, (1 << 16) // max(1, len(cols)))
        for a in range(0, len(rows), step):
            r, c = rows[a : a + step], cols[a:] if same else cols
            d = np.bitwise_count(self.head[r][:, None] ^ self.head[c]) + np.bitwise_count(self.rest[r][:, None] ^ self.rest[c])
            ok = d <= self.near
            if same:
                ok &= np.arange(len(c)) > np.arange(len(r))[:, None]
            for i in np.flatnonzero(ok.any(1)).tolist():
                me, at = r[i], np.flatnonzero(ok[i])
                j, close = c[at], d[i, at] <= self.tight
                if self.stood[me] >= 0:
                    other = self.stood[j] != self.stood[me]
                    j, close = j[other], close[other]
                if 0 <= self.stood[me] != me:
                    close[:] = False
                else:
                    fresh, led = j[close & (self.stood[j] < 0)], j[close & (self.stood[j] == j)]
                    if len(fresh) or len(led):
                        self.stood[fresh], self.stood[me] = me, me
                        self.stood[np.isin(self.stood, led)] = me
                self.pairs[0].append(np.full(len(j), self.num[me]))
                self.pairs[1].append(self.num[j])
                self.pairs[2].append(close)


def _enter(nodes: DataFrame, depth: int, tries: int, seed: int) -> DataFrame:
    """An entry (head, rest, num) a trie and node: the trie's number and the label's first bits, the label's other bits, the node."""
    order = [np.random.default_rng((seed, t)).permutation(BITS)[:LABEL] for t in range(tries)]

    def number(bits):
        return np.ascontiguousarray(np.packbits(bits, axis=1)).view(">u8")[:, 0].astype(np.uint64)

    def apply(batches):
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            sig = np.stack([batch.column(1 + k).to_numpy() for k in range(4)], 1).astype("<i8")
            bits = np.unpackbits(sig.view(np.uint8), axis=1)
            for t, o in enumerate(order):
                own = bits[:, o]
                head = number(np.concatenate([np.zeros((n, 64 - HEAD), np.uint8), own[:, :HEAD]], 1)) | (np.uint64(t) << np.uint64(HEAD))
                yield pa.RecordBatch.from_arrays([pa.array(head.view(np.int64)), pa.array(number(own[:, HEAD:]).view(np.int64)), batch.column(0)], names=["head", "rest", "num"])

    if tries > 1 << (63 - HEAD):
        raise ValueError("too many tries for a label's head")
    return nodes.select("num", *_SIG).mapInArrow(apply, "head bigint, rest bigint, num bigint")


_FOUND = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("tight", pa.bool_())])
#: Entries of one prefix that a task holds at most before it leaves those behind that another one stands for.
HELD = 1 << 20


def _search(entries: DataFrame, depth: int, near: int, tight: int, hot: int, whole: bool, parts: int) -> DataFrame:
    """Candidates (a, b, tight), and nodes of prefixes that hold too many (a; b null)."""
    shift = HEAD - depth

    def apply(batches):
        out: list[pa.RecordBatch] = []

        def search(held):
            head, rest, num = (np.concatenate(x) for x in zip(*held))
            if len(num) < 2:
                return None, num[:0]
            climb = Climb(head, rest, num, depth, near, tight, hot, whole)
            left = climb.run()
            if climb.pairs[0]:
                out.append(pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in climb.pairs], schema=_FOUND))
            return climb, left

        def pass_on(num):
            if len(num):
                out.append(pa.RecordBatch.from_arrays([pa.array(num), pa.nulls(len(num), pa.int64()), pa.nulls(len(num), pa.bool_())], schema=_FOUND))

        key, held, size, over = None, [], 0, False

        def close():
            if size > 1 or over and held:
                climb, left = search(held)
                pass_on(climb.num[climb.staying(np.arange(len(climb.num)))] if over and climb is not None else held[0][2] if over else climb.num[left])

        for batch in batches:
            head, rest, num = (c.to_numpy() for c in batch.columns)
            keys = head >> shift
            ends = np.append(np.flatnonzero(np.diff(keys)) + 1, len(keys)).tolist() if len(keys) else []
            at = 0
            for end in ends:
                if keys[at] != key:
                    close()
                    key, held, size, over = keys[at], [], 0, False
                held.append((head[at:end], rest[at:end], num[at:end]))
                size += end - at
                if size > HELD:
                    climb, left = search(held)
                    stay = climb.staying(np.arange(size))
                    if climb.over or len(stay) > HELD // 2 and not whole:
                        pass_on(climb.num[stay])
                        over, held, size = True, [], 0
                    else:
                        held, size = [(climb.head[stay].view(np.int64), climb.rest[stay].view(np.int64), climb.num[stay])], len(stay)
                at = end
            yield from out
            out.clear()
        close()
        yield from out

    key = F.shiftright("head", shift)
    return entries.repartition(parts, key).sortWithinPartitions("head", "rest", "num").mapInArrow(apply, "a bigint, b bigint, tight boolean")


def candidates(spark: SparkSession, nodes: DataFrame, similarity: float, recall: float, hot: int | None = None) -> DataFrame:
    """Pairs (a, b, tight) of node numbers that the forest finds, each once; where tight, ``a`` stands for ``b``. ``nodes`` has num and the signature."""
    hot, found, least, level = hot or HOT, None, 4, 0
    while True:
        n = nodes.count()
        if n < 2:
            break
        own = 1 - (1 - recall) * 2 / 3 ** (level + 1)  # all levels together miss no more than 1 - recall
        depth, tries = plan(n, similarity, own, least)
        near, tight = label_reach(depth, reach(similarity, own)), int((1 - bit_agreement(CLOSE)) * (LABEL - depth))
        got = saved(_search(_enter(nodes, depth, tries, level), depth, near, tight, hot, depth >= DEEPEST, partitions(spark)))
        pairs = got.where("b is not null")
        found = pairs if found is None else found.unionByName(pairs)
        if depth >= DEEPEST:
            break
        nodes = saved(nodes.join(got.where("b is null").select(F.col("a").alias("num")).distinct(), "num", "left_semi"))
        least, level = min(DEEPEST, depth + 6), level + 1
    if found is None:
        return spark.createDataFrame([], "a bigint, b bigint, tight boolean")
    return saved(found.groupBy("a", "b").agg(F.max("tight").alias("tight")))


def linked_exactly(sets: list[np.ndarray], similarity: float) -> list[tuple[int, int]]:
    """Pairs of sets that are similar enough, as many as connect all that such pairs connect."""
    sizes = np.fromiter(map(len, sets), np.int64, len(sets))
    values, ids = np.unique(np.concatenate(sets), return_inverse=True)
    starts = np.cumsum(sizes) - sizes
    left, flat, out, queue = np.arange(len(sets)), ids, [], []
    while len(left):
        if not queue:
            queue.append(int(left[0]))
            left, flat = left[1:], flat[sizes[left[0]] :]
            continue
        me = queue.pop()
        mine = np.zeros(len(values), bool)
        mine[ids[starts[me] : starts[me] + sizes[me]]] = True
        size = sizes[left]
        both = np.add.reduceat(mine[flat], np.cumsum(size) - size, dtype=np.int64)
        near = both / (size + sizes[me] - both) >= similarity
        if near.any():
            met = left[near].tolist()
            out += [(me, x) for x in met]
            queue += met
            left, flat = left[~near], flat[np.repeat(~near, size)]
    return out


def small_links(few: DataFrame, similarity: float, parts: int) -> DataFrame:
    """Linked pairs (a, b) of the small sets ``few`` (node, size, few), exact: similar sets share one of the rarest windows of each."""
    each = few.withColumn("hex", F.hex("few")).select("node", "size", F.explode(F.expr("transform(sequence(0, size - 1), k -> substr(hex, 16 * k + 1, 16))")).alias("window"))
    often = each.groupBy("window").agg(F.count("*").alias("n"))
    order = Window.partitionBy("node").orderBy("n", "window")
    rarest = each.join(often, "window").withColumn("at", F.row_number().over(order)).where((F.col("at") <= F.col("size") - F.ceil(F.col("size") * similarity - 1e-9) + 1) & (F.col("n") > 1))
    entries = rarest.select("window", "node").join(few.select("node", "few"), "node").select("window", "node", "few")

    def apply(batches):
        key, nodes, sets = None, [], []

        def pairs():
            found = linked_exactly(sets, similarity) if len(sets) > 1 else []
            return [(nodes[i], nodes[j]) for i, j in found]

        def batch_of(rows):
            return pa.RecordBatch.from_arrays([pa.array(c, pa.binary()) for c in zip(*rows)], names=["a", "b"])

        for batch in batches:
            out = []
            for k, node, data in zip(*(c.to_pylist() for c in batch.columns)):
                if k != key:
                    out += pairs()
                    key, nodes, sets = k, [], []
                nodes.append(node)
                sets.append(np.frombuffer(data, np.uint64))
            if out:
                yield batch_of(out)
        if out := pairs():
            yield batch_of(out)

    return entries.repartition(parts, "window").sortWithinPartitions("window", "node").mapInArrow(apply, "a binary, b binary")


def packed(found: np.ndarray) -> bytes:
    """A set's hashes, ``SHOWN`` bytes each."""
    low = np.unique(found & np.uint64((1 << 8 * SHOWN) - 1))
    return low.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :SHOWN].tobytes()


def unpacked(data: bytes) -> np.ndarray:
    out = np.zeros((len(data) // SHOWN, 8), np.uint8)
    out[:, :SHOWN] = np.frombuffer(data, np.uint8).reshape(-1, SHOWN)
    return out.reshape(-1).view("<u8")


def _groups(pairs: DataFrame, data: DataFrame) -> DataFrame:
    """(hub, salt, b, partners, data) of pairs (a, b), ``data`` (node, data) being what nodes bring along.

    Nodes ``a`` are held in groups by their partner of most pairs, up to ``STAR`` nodes or ``STAR_BYTES`` as planned: a row
    each, without b. A ``b`` has one row for each group that it has partners in.
    """
    degree = pairs.groupBy("b").agg(F.count("*").alias("n"))
    hub = pairs.join(degree, "b").groupBy("a").agg(F.max(F.struct("n", "b"))["b"].alias("hub"))
    sized = saved(hub.join(data.select(F.col("node").alias("a"), F.length("data").alias("bytes")), "a", "left"))
    salts = sized.groupBy("hub").agg(F.ceil(F.greatest(F.count("*") / STAR, F.sum("bytes") / STAR_BYTES)).alias("salts"))
    held = saved(sized.join(salts, "hub").select("a", "hub", F.pmod(F.xxhash64("a"), F.col("salts")).cast("int").alias("salt")).distinct())
    of_b = pairs.join(held, "a").groupBy("hub", "salt", "b").agg(F.collect_list("a").alias("partners")).join(data.withColumnRenamed("node", "b"), "b").select("hub", "salt", "b", "partners", "data")
    of_a = held.join(data.withColumnRenamed("node", "a"), "a").select("hub", "salt", F.lit(None).cast("binary").alias("b"), F.array("a").alias("partners"), "data")
    return of_b.unionByName(of_a)


def verify(pairs: DataFrame, sets: DataFrame, parts: int) -> DataFrame:
    """Pairs (a, b) with the Jaccard similarity of their whole sets; a group's sets and one more are in memory."""

    def apply(batches):
        key, own = None, {}
        for batch in batches:
            rows = []
            for hub, salt, b, partners, data in zip(*(c.to_pylist() for c in batch.columns)):
                if (hub, salt) != key:
                    key, own = (hub, salt), {}
                found = unpacked(data)
                if b is None:
                    own[partners[0]] = found
                    continue
                sizes = np.array([len(own[a]) for a in partners])
                flat = np.concatenate([own[a] for a in partners])
                met = found[np.minimum(np.searchsorted(found, flat), len(found) - 1)] == flat
                both = np.add.reduceat(met, np.cumsum(sizes) - sizes, dtype=np.int64)
                rows += zip(partners, [b] * len(partners), (both / (sizes + len(found) - both)).tolist())
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), [pa.binary(), pa.binary(), pa.float64()])], names=["a", "b", "jaccard"])

    together = _groups(pairs, sets.withColumnRenamed("shingles", "data")).repartition(parts, "hub", "salt").sortWithinPartitions("hub", "salt", F.col("b").asc_nulls_first())
    return together.mapInArrow(apply, "a binary, b binary, jaccard double")


def sets_of(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(node, shingles) of the nodes ``wanted`` (node, doc_id): the texts are read again and only those documents' sets kept.

    Texts are shuffled only where there are more ids than may be sent around. A node comes more than once only where texts of
    one doc_id differ and have the same set.
    """

    def apply(batches):
        for batch in batches:
            for low, high in slices(batch.column("text"), _BLOCK):
                found = shingle_sets([x or "" for x in batch.column("text")[low:high].to_pylist()], WIDTH)
                rows = [(w, packed(s)) for w, s in zip(batch.column("node")[low:high].to_pylist(), found) if node_of(s) == w]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.binary()) for c in zip(*rows)], names=["node", "shingles"])

    side = F.broadcast(wanted) if wanted.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS else wanted
    rows = docs.select("doc_id", "text").join(side, "doc_id")
    # Rows alike go once.
    rows = rows.withColumn("alike", F.md5("text")).dropDuplicates(["doc_id", "node", "alike"]).select("node", "text")
    return rows.mapInArrow(apply, "node binary, shingles binary")


def _fit(pairs: DataFrame, fine: DataFrame, on: str, similarity: float, recall: float) -> DataFrame:
    """``pairs`` (a, b of column ``on`` of ``fine``) as nodes, where sizes and whole signatures fit the similarity; other columns stay."""
    own = lambda e: fine.select(F.col(on).alias(e), *[F.col(c).alias(f"{c}_{e}") for c in {"node", "size", *_SIG} - {on}])
    both = pairs.join(own("a"), "a").join(own("b"), "b")
    apart = sum((F.bit_count(F.col(f"{s}_a").bitwiseXOR(F.col(f"{s}_b"))) for s in _SIG[1:]), F.bit_count(F.col("s0_a").bitwiseXOR(F.col("s0_b"))))
    fit = (F.least("size_a", "size_b") >= similarity * F.greatest("size_a", "size_b")) & (apart <= reach(similarity, recall))
    ends = [F.col(e if on == "node" else f"node_{e}").alias(e) for e in "ab"]
    return both.where(fit).select(*ends, *[c for c in pairs.columns if c not in "ab"], apart.alias("apart")).where("a <> b")


def _across(pairs: DataFrame, roots: DataFrame) -> DataFrame:
    """``pairs`` whose ends aren't in one component."""
    own = lambda e: roots.select(F.col("node").alias(e), F.col("root").alias(f"root_{e}"))
    both = pairs.join(own("a"), "a", "left").join(own("b"), "b", "left")
    return both.where(F.coalesce("root_a", "a") != F.coalesce("root_b", "b")).select(*pairs.columns)


def _judge(compared: DataFrame, sets: DataFrame, known: DataFrame, similarity: float, parts: int) -> tuple[DataFrame, DataFrame]:
    """Components (node, root) of the links ``known`` and of the pairs ``compared`` (a, b, apart) that are similar, and the pairs that proved not to be.

    Each node's nearest pairs are verified first; pairs that these connect needn't be, so of a large group of
    copies some pairs a node are, and not all.
    """
    left, roots, lost = compared, None, None
    for nearest in NEAREST:
        pick = left
        if nearest:
            order = Window.partitionBy("node").orderBy("apart", "a", "b")
            ends = left.select(F.explode(F.array("a", "b")).alias("node"), "a", "b", "apart")
            pick = saved(ends.withColumn("n", F.row_number().over(order)).where(F.col("n") <= nearest).select("a", "b").distinct())
        judged = saved(verify(pick.select("a", "b"), sets, parts))
        links = judged.where(F.col("jaccard") >= similarity).select("a", "b")
        roots = components(links.unionByName(known if roots is None else roots.select(F.col("node").alias("a"), F.col("root").alias("b"))))
        failed = judged.where(F.col("jaccard") < similarity).select("a", "b")
        lost = failed if lost is None else lost.unionByName(failed)
        if nearest:
            left = saved(_across(left.join(pick, ["a", "b"], "left_anti"), roots))
    return roots, lost


#: What goes along with a node: one that it stands for, that one's component, size and signature.
_MEMBER = np.dtype([("node", "V16"), ("root", ">u8", (2,)), ("size", ">i4"), ("sig", ">u8", (4,))])


class Kin:
    """Pairs of members of nodes that are held and of nodes that are sent to them, each once, where components differ and sizes and signatures fit."""

    def __init__(self, similarity: float, near: int, most: int = 1 << 22):
        self.similarity, self.near, self.most = similarity, near, most
        self.own: dict[bytes, np.ndarray] = {}
        self.held, self.at = None, {}
        self.sent: dict[bytes, int] = {}
        self.codes, self.fresh = np.zeros(0, np.int64), []

    def hold(self, node: bytes, data: bytes) -> None:
        self.own[node] = np.frombuffer(data, _MEMBER)

    def meet(self, partners: list[bytes], data: bytes):
        if self.held is None:
            every = np.concatenate(list(self.own.values()))
            _, first, ids = np.unique(np.ascontiguousarray(every["node"]), return_index=True, return_inverse=True)
            self.held = every[first]
            self.at = dict(zip(self.own, np.split(ids.reshape(-1), np.cumsum([len(x) for x in self.own.values()])[:-1])))
        rows, you = np.unique(np.concatenate([self.at[a] for a in partners])), np.frombuffer(data, _MEMBER)
        ids = np.array([self.sent.setdefault(data[k : k + 16], len(self.sent)) for k in range(0, len(data), _MEMBER.itemsize)])
        size, sig = you["size"].astype(np.int64), you["sig"].astype(np.uint64)
        step = max(1, (1 << 16) // len(you))
        for low in range(0, len(rows), step):
            me = self.held[rows[low : low + step]]
            own = me["size"].astype(np.int64)[:, None]
            ok = np.minimum(own, size) >= self.similarity * np.maximum(own, size)
            ok &= (me["root"][:, None] != you["root"]).any(2)
            ok &= np.bitwise_count(me["sig"].astype(np.uint64)[:, None] ^ sig).sum(2, dtype=np.int64) <= self.near
            i, j = np.nonzero(ok)
            self.fresh.append(rows[low + i] << 32 | ids[j])
        if sum(map(len, self.fresh)) > self.most // 4:
            self.codes, self.fresh = np.unique(np.concatenate([self.codes, *self.fresh])), []
            if len(self.codes) > self.most:
                yield from self.found()

    def found(self):
        """Batches (a, b) of what was found so far."""
        codes = np.unique(np.concatenate([self.codes, *self.fresh]))
        self.codes, self.fresh = codes[:0], []
        if len(codes):
            nodes = np.frombuffer(b"".join(self.sent), "V16")
            columns = [np.ascontiguousarray(self.held["node"])[codes >> 32], nodes[codes & 0xFFFFFFFF]]
            for low in range(0, len(codes), 1 << 16):
                yield pa.RecordBatch.from_arrays([pa.FixedSizeBinaryArray.from_buffers(pa.binary(16), len(x), [None, pa.py_buffer(x.tobytes())]).cast(pa.binary()) for x in (c[low : low + (1 << 16)] for c in columns)], names=["a", "b"])


def _stood_for(lost: DataFrame, close: DataFrame, fine: DataFrame, roots: DataFrame, similarity: float, recall: float, parts: int) -> DataFrame:
    """Pairs (a, b) of nodes that the ends of ``lost`` stand for, by ``close`` (a for x, itself included), where components differ and sizes and whole signatures fit.

    Most such pairs come by many failed pairs, so they are made distinct in the groups in which they are found.
    """
    members = lost.select(F.explode(F.array("a", "b")).alias("node")).distinct().join(close.withColumnRenamed("a", "node"), "node", "left").select("node", F.coalesce("x", "node").alias("x"))
    number = lambda c, digits: F.lpad(F.hex(c), digits, "0")
    shown = F.concat(F.hex("x"), F.hex(F.coalesce("root", "x")), number("size", 8), *[number(c, 16) for c in _SIG])
    members = members.join(fine.withColumnRenamed("node", "x"), "x").join(roots.withColumnRenamed("node", "x"), "x", "left").select("node", shown.alias("shown"))
    members = saved(members.groupBy("node").agg(F.unhex(F.concat_ws("", F.collect_list("shown"))).alias("data")))
    near = reach(similarity, recall)

    def apply(batches):
        key, kin = None, None
        for batch in batches:
            for hub, salt, b, partners, data in zip(*(c.to_pylist() for c in batch.columns)):
                if (hub, salt) != key:
                    if kin:
                        yield from kin.found()
                    key, kin = (hub, salt), Kin(similarity, near)
                if b is None:
                    kin.hold(partners[0], data)
                else:
                    yield from kin.meet(partners, data)
        if kin:
            yield from kin.found()

    together = _groups(lost, members).repartition(parts, "hub", "salt").sortWithinPartitions("hub", "salt", F.col("b").asc_nulls_first())
    return together.mapInArrow(apply, "a binary, b binary").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _classified(spark: SparkSession, docs: DataFrame, similarity: float, recall: float, alike: bool = False) -> tuple[DataFrame, DataFrame]:
    """The marks of all rows, and node, doc_id (the least of the node), rows, class_id, class_size and root (the class) of every node."""
    ready(spark)
    few, parts = int(SMALL / similarity), partitions(spark)
    marks = saved(fingerprint(docs, few, alike))
    first = [F.first(c).alias(c) for c in ("num", *_SIG, "size", "few")]
    nodes = saved(marks.where("node is not null and doc_id is not null").groupBy("node").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("rows"), *first))
    found = candidates(spark, nodes.where(F.col("size") > SMALL), similarity, recall)
    numbers = found.select(F.explode(F.array("a", "b")).alias("num")).distinct()
    fine = saved(nodes.join(numbers, "num", "left_semi").select("num", "node", "doc_id", "size", *_SIG))
    # Two nodes of one number are told apart here: a pair of numbers stands for all pairs of their nodes.
    pairs = saved(_fit(found, fine, "num", similarity, recall))
    compared = saved(pairs.groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.min("apart").alias("apart")))
    ends = compared.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    # Partitioned by node, so that each round moves its pairs and not all sets.
    sets = bucketed(sets_of(docs, saved(fine.join(ends, "node", "left_semi").select("node", "doc_id"))), "node")
    small = small_links(nodes.where("few is not null").select("node", "size", "few"), similarity, parts)
    roots, lost = _judge(compared, sets, small, similarity, parts)
    # Where a pair fails, those pairs are verified as well that weren't sent on as their nodes stood for others in it.
    close = pairs.where("tight").select("a", F.col("b").alias("x")).distinct()
    close = saved(close.unionByName(close.select("a", F.col("a").alias("x")).distinct()))
    again = _stood_for(saved(_across(lost, roots)), close, fine, roots, similarity, recall, parts).join(compared, ["a", "b"], "left_anti")
    linked = saved(verify(saved(again), sets, parts).where(F.col("jaccard") >= similarity).select("a", "b"))
    if not linked.isEmpty():
        roots = components(linked.unionByName(roots.select(F.col("node").alias("a"), F.col("root").alias("b"))))
    classed = saved(nodes.select("node", "doc_id", "rows").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")))
    classes = saved(classed.groupBy("root").agg(F.min("doc_id").alias("class_id"), F.sum("rows").alias("class_size"), F.count("*").alias("nodes")))
    return marks, spread_join(classed, classes, "root", "nodes").select("node", "doc_id", "rows", "root", "class_id", "class_size")


def near_duplicates(spark: SparkSession, docs: DataFrame, similarity: float = SIMILARITY, recall: float = RECALL) -> DataFrame:
    """doc_id, class_id (the least doc_id of the class) and class_size (rows) for every row of ``docs``.

    Texts are compared as lower-cased words without ASCII punctuation; texts with fewer than five words have
    one window of all. Texts without a word are copies of each other; a null text is a class of its own, as is a
    row without a doc_id (its class_id is null). Rows of one doc_id and text count as copies. Other columns are ignored.
    """
    marks, named = _classified(spark, docs, similarity, recall)
    named = saved(named.select("node", "class_id", "class_size", "rows"))
    known = spread_join(marks.where("node is not null and doc_id is not null").select("doc_id", "node"), named, "node", "rows").select("doc_id", "class_id", "class_size")
    alone = marks.where("node is null or doc_id is null").select("doc_id", F.col("doc_id").alias("class_id"), F.lit(1).cast("long").alias("class_size"))
    return known.unionByName(alone)


def keep_one(spark: SparkSession, docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """The rows of ``docs``, all columns, of the first document of each class: one row a class, of the least doc_id and node.

    Rows of one doc_id whose texts are classes of their own each stay, as do rows without a doc_id and rows with a null text.
    """
    marks, named = _classified(spark, docs, similarity, RECALL, alike=True)
    least = named.groupBy("root").agg(F.min(F.struct("doc_id", "node")).alias("x")).select("x.doc_id", "x.node")
    alike, n = unused(docs.columns, "alike"), unused(docs.columns, "n")
    first = marks.join(least, ["doc_id", "node"]).groupBy("doc_id", "node").agg(F.min("alike").alias(alike)).select("doc_id", alike)
    kept = docs.where("text is not null").withColumn(alike, F.unhex(F.md5("text"))).join(first, ["doc_id", alike], "left_semi")
    kept = kept.withColumn(n, F.row_number().over(Window.partitionBy("doc_id", alike).orderBy("text"))).where(F.col(n) == 1).select(docs.columns)
    return kept.unionByName(docs.where("doc_id is null or text is null"))
