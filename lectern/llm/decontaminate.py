"""Benchmark decontamination: a BM25 index of test items with block-max WAND, queried by every passage.

Items are indexed by their words. A posting's BM25 impact is stored as a share of the item's own score
(what a passage with all its words would get), so one threshold serves all items. Passages are windows
of twice the longest item's words, half overlapping: an item copied into a text lies whole in one.

For a passage, an item can reach the threshold only with words beyond its pivot word: an item's most common
words, as many as stay under half the threshold together, can't lift it there alone. So lists hold items by their words
beyond it, in order of items, with the largest share of each list and of each block of items in it. A passage has a cursor
on each of its words' lists. Ordered by the items they stand at, the cursors whose lists together may reach the threshold name the next
item that can; if the maxima of its block don't reach it, the cursors skip to the block's end or the next cursor's item, else
they move up to the item, and once all stand there it is added up. All passages of a batch take each step together, as arrays.
What is left is scored in full, and kept if the passage also holds the question's word windows and the answer's words.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import give_back, ready, saved
from .words import slices, words

K1, B = 1.2, 0.75
THRESHOLD = 0.6
BLOCK_ITEMS = 16
#: Text of items in one index that is sent to all tasks; more items make more indexes, each queried in turn.
INDEX_BYTES = 16 << 20
_BLOCK = 2_000_000
_SENTENCE = re.compile(r"(?<=[.!?])\s+")


@dataclass
class Item:
    item_id: int
    question: set  # windows of words
    width: int
    answer: set
    weights: dict  # word id -> share


@dataclass
class Counts:
    """Of the whole benchmark; ``df`` may leave out words that an index doesn't have."""

    n: int
    mean: float
    longest: int
    df: dict  # word -> items


class Index:
    def __init__(self, rows: list[tuple[int, str]], threshold: float = THRESHOLD, overlap: float = 0.5, whole: Counts | None = None):
        rows = sorted((i, t) for i, t in rows)
        cut = [(i, words(t), t) for i, t in rows]
        cut = [(i, w, t) for i, w, t in cut if w]
        self.threshold, self.overlap = threshold, overlap
        n = len(cut)
        found = Counter(x for _, w, _ in cut for x in set(w))
        if whole is None:
            whole = Counts(n, sum(len(w) for _, w, _ in cut) / max(n, 1), max((len(w) for _, w, _ in cut), default=1), found)
        self.longest, mean, df = whole.longest, whole.mean, whole.df
        self.terms = {x: k for k, x in enumerate(sorted(found))}
        self.items: list[Item] = []
        self.pivot = np.zeros(n)  # what the words before an item's pivot can add at most
        essential: dict[int, list[tuple[int, float]]] = defaultdict(list)
        for at, (item_id, w, text) in enumerate(cut):
            tf = Counter(w)
            gain = {x: math.log(1 + (whole.n - df[x] + 0.5) / (df[x] + 0.5)) * f * (K1 + 1) / (f + K1 * (1 - B + B * len(w) / mean)) for x, f in tf.items()}
            own = sum(gain.values())
            common = 0.0
            passed = False
            for x in sorted(gain, key=lambda x: (-df[x], x)):
                share = gain[x] / own
                if not passed and common + share < threshold / 2:
                    common += share
                else:
                    passed = True
                    essential[self.terms[x]].append((at, share))
            self.pivot[at] = common
            sentences = [s for s in map(words, _SENTENCE.split(text)) if s]
            answer = sentences[-1] if len(sentences) > 1 else w[-1:]
            asked = w[: len(w) - len(answer)] or w
            width = min(5, len(asked))
            self.items.append(Item(item_id, set(zip(*(asked[k:] for k in range(width)))), width, set(answer), {self.terms[x]: g / own for x, g in gain.items()}))
        # Postings by term and item, and the largest share of each term and of each of its blocks.
        posts = [(term, at, share) for term in sorted(essential) for at, share in essential[term]]
        post_term = np.array([x[0] for x in posts], np.int64)
        self.posted, self.share = np.array([x[1] for x in posts], np.int64), np.array([x[2] for x in posts])
        self.post_key = post_term * (n + 1) + self.posted
        self.post_begin = np.searchsorted(post_term, np.arange(len(self.terms) + 1))
        self.term_max = np.zeros(len(self.terms))
        np.maximum.at(self.term_max, post_term, self.share)
        self.n_blocks = -(-n // BLOCK_ITEMS) if n else 0
        self.block_key, own = np.unique(post_term * self.n_blocks + self.posted // BLOCK_ITEMS, return_inverse=True)
        self.block_max = np.zeros(len(self.block_key))
        np.maximum.at(self.block_max, own, self.share)
        self.block_pivot = np.array([self.pivot[b * BLOCK_ITEMS : (b + 1) * BLOCK_ITEMS].max() for b in range(self.n_blocks)])

    def retrieve(self, window: np.ndarray, term: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(window, item) of what may reach the threshold; windows with their terms, sorted by window."""
        out_w, out_i, n_items = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], len(self.items)
        enough = self.threshold - 1e-9
        least = enough - self.pivot.max()  # what the lists must add to some item
        at, end, top = self.post_begin[term], self.post_begin[term + 1], self.term_max[term]
        while len(window):
            first = np.flatnonzero(np.concatenate([[True], window[1:] != window[:-1]]))
            n = np.diff(np.append(first, len(window)))
            able = np.add.reduceat(top, first) >= least
            if not able.all():
                keep = np.repeat(able, n)
                window, term, at, end, top = (x[keep] for x in (window, term, at, end, top))
                continue
            item = self.posted[at]
            order = np.lexsort((item, window))
            term, at, end, top, item = (x[order] for x in (term, at, end, top, item))
            group = np.repeat(np.arange(len(first)), n)
            run = np.cumsum(top)
            reached = run - (run[first] - top[first])[group] >= least - 1e-9
            reached[first + n - 1] = True
            goal = item[np.minimum.reduceat(np.where(reached, np.arange(len(item)), len(item)), first)]  # a window's next item that can reach
            to = goal[group]
            within = item <= to
            key = term * self.n_blocks + to // BLOCK_ITEMS
            spot = np.minimum(np.searchsorted(self.block_key, key), len(self.block_key) - 1)
            most = np.where(within & (self.block_key[spot] == key), self.block_max[spot], 0.0)
            good = np.bincount(group, weights=most) + self.block_pivot[goal // BLOCK_ITEMS] >= enough
            there = good & (item[first] == goal)
            here = item == to
            score = np.bincount(group, weights=np.where(here, self.share[at], 0.0)) + self.pivot[goal]
            hit = there & (score >= enough)
            out_w.append(window[first[hit]])
            out_i.append(goal[hit])
            beyond = np.minimum.reduceat(np.where(within, n_items, item), first)
            skip = np.minimum((goal // BLOCK_ITEMS + 1) * BLOCK_ITEMS, beyond)
            target = np.where(~good[group] & within, skip[group], np.where(there[group] & here, to + 1, np.where(good[group] & within, to, item)))
            moved = np.flatnonzero(target > item)
            at[moved] = np.searchsorted(self.post_key, term[moved] * (n_items + 1) + target[moved])
            left = at < end
            window, term, at, end, top = (x[left] for x in (window, term, at, end, top))
        return np.concatenate(out_w), np.concatenate(out_i)

    def search(self, texts: list[str]) -> list[tuple[int, Item, float, float, float]]:
        """(text, item, share of the item's own score, question overlap, answer overlap) of what passes, once a text and item."""
        if not self.items:
            return []
        lists = [words(t) for t in texts]
        ids = np.array([self.terms.get(x, -1) for ws in lists for x in ws], np.int64)
        if not len(ids):
            return []
        sizes = np.fromiter(map(len, lists), np.int64, len(lists))
        text_of = np.repeat(np.arange(len(lists)), sizes)
        starts = np.cumsum(sizes) - sizes
        step = self.longest
        # Windows are numbered through all texts; window j of a text has the words of steps j and j + 1.
        steps = np.maximum(-(-sizes // step), 1)
        first_window = np.cumsum(steps) - steps
        hit = np.flatnonzero((ids >= 0) & (self.post_begin[ids + 1] > self.post_begin[ids]))
        if not len(hit):
            return []
        own = first_window[text_of[hit]] + (hit - starts[text_of[hit]]) // step
        before = np.where((hit - starts[text_of[hit]]) >= step, own - 1, -1)
        window = np.concatenate([own, before[before >= 0]])
        term = np.concatenate([ids[hit], ids[hit[before >= 0]]])
        # A word counts once in a passage.
        key = np.unique(window * np.int64(len(self.terms)) + term)
        window, term = key // len(self.terms), key % len(self.terms)
        windows, items = self.retrieve(window, term)
        best: dict[tuple[int, int], tuple] = {}
        window_text = np.repeat(np.arange(len(lists)), steps)
        for w, number in sorted(zip(windows.tolist(), items.tolist())):
            t, item = int(window_text[w]), self.items[number]
            low = (w - int(first_window[t])) * step
            passage = lists[t][low : low + 2 * step]
            terms = {self.terms.get(x, -1) for x in passage}
            score = sum(s for x, s in item.weights.items() if x in terms)
            if score < self.threshold - 1e-9:
                continue
            found = set(zip(*(passage[k:] for k in range(item.width))))
            question = len(item.question & found) / len(item.question)
            answer = len(item.answer & set(passage)) / len(item.answer)
            if question >= self.overlap and answer >= self.overlap:
                best[t, number] = max(best.get((t, number), ()), (score, question, answer))
        return [(t, self.items[k], *v) for (t, k), v in sorted(best.items())]


def _words_of(batches):
    """Part, number of words and distinct words of each item that has words."""
    for batch in batches:
        rows = [(k, len(w), sorted(set(w))) for k, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) if (w := words(t))]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), [pa.int32(), pa.int32(), pa.list_(pa.binary())])], names=["part", "length", "words"])


def indexes(benchmark: DataFrame, threshold: float, overlap: float):
    """One index for each INDEX_BYTES of items, in order of id; the items of one at a time are on the driver.

    Counts are those of the whole benchmark, so that shares and passages don't depend on how it is split.
    """
    sized = benchmark.where("item_id is not null and text is not null").select("item_id", "text", F.octet_length("text").alias("n"))
    total = sized.agg(F.sum("n")).first()[0] or 0
    parts = -(-total // INDEX_BYTES)
    part = F.pmod(F.xxhash64("item_id", "text"), F.lit(max(parts, 1))).cast("int")
    if parts > 1:
        items = saved(sized.select("item_id", "text").distinct().withColumn("part", part).select("part", "text").mapInArrow(_words_of, "part int, length int, words array<binary>"))
        n, length, longest = items.agg(F.count("*"), F.sum("length"), F.max("length")).first()
        each = items.select("part", F.explode("words").alias("word"))
        often = saved(each.groupBy("word").agg(F.count("*").alias("df")))
    for k in range(parts):
        whole = None
        if parts > 1 and n:
            own = often.join(each.where(F.col("part") == k).select("word").distinct(), "word")
            whole = Counts(n, length / n, longest, {bytes(r["word"]): r["df"] for r in own.collect()})
        yield Index([(r["item_id"], r["text"]) for r in sized.where(part == k).distinct().collect()], threshold, overlap, whole)


MATCHED = "doc_id bigint, item_id bigint, score_share double, question_overlap double, answer_overlap double"


def find_contaminated(spark: SparkSession, docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, overlap: float = 0.5) -> DataFrame:
    """A row for each document and item it holds, with the best passage's figures.

    Null or empty texts hold nothing; items without a word, id or text are left out; without items the result is
    empty. Repeated rows report each for itself. Other columns are ignored.
    """
    ready(spark)
    out = None
    for index in indexes(benchmark, threshold, overlap):

        def search(batches, index=index):
            for batch in batches:
                ids, texts = batch.column(0).to_pylist(), batch.column(1)
                for low, high in slices(texts, _BLOCK):
                    found = index.search([x or "" for x in texts[low:high].to_pylist()])
                    if found:
                        rows = [(ids[low + t], item.item_id, s, q, a) for t, item, s, q, a in found]
                        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), [pa.int64()] * 2 + [pa.float64()] * 3)], names=["doc_id", "item_id", "score_share", "question_overlap", "answer_overlap"])

        part = docs.select("doc_id", "text").mapInArrow(search, MATCHED)
        out = part if out is None else out.unionByName(part)
    return spark.createDataFrame([], MATCHED) if out is None else out


def drop_contaminated(spark: SparkSession, docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, overlap: float = 0.5) -> DataFrame:
    """The rows of ``docs``, all columns, whose text holds no item."""
    ready(spark)
    for index in indexes(benchmark, threshold, overlap):

        def keep(batches, index=index):
            give_back()
            for batch in batches:
                texts = batch.column("text")
                for low, high in slices(texts, _BLOCK):
                    found = {t for t, *_ in index.search([x or "" for x in texts[low:high].to_pylist()])}
                    yield batch.slice(low, high - low).filter(pa.array([k not in found for k in range(high - low)], pa.bool_()))

        docs = docs.mapInArrow(keep, docs.schema)
    return docs
