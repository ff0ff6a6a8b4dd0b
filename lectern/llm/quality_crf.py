"""Quality rules with line labelling by a linear-chain conditional random field.

Each text's lines are labelled content or boilerplate by Viterbi decoding; the characters in content
lines, as a share of those in all lines with a word, decide whether a text is kept. Counts that need
no model (``base`` rules) come from the same pass.

The field is fitted on a bounded sample of labelled rows (``SAMPLE`` documents, those with the least
hash of their id; every label and document is a candidate; one text an id, of ``LINES`` lines at most). Only documents carry labels, so lines of
documents of quality 0 are hidden: they start as boilerplate and are decoded again between fits, with
at least one line of such a document held to be boilerplate.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import give_back, ready

SAMPLE = 3000
#: Longer texts aren't fitted on; with SAMPLE this bounds what comes to the driver.
LINES = 2000
SPACES = " \t\n\r\x0b\x0c"
SYMBOLS = "#*$%&|<>"
N_FEATURES = 14
_BLOCK = 4_000_000

# Byte classes: 0 space, 1 lower, 2 upper, 3 digit, 4 listed symbol, 5 sentence end, 6 other ASCII, 7 non-ASCII lead, 8 continuation byte
_CLASS = np.full(256, 6, np.uint8)
for _c in SPACES:
    _CLASS[ord(_c)] = 0
_CLASS[97:123], _CLASS[65:91], _CLASS[48:58] = 1, 2, 3
for _c in SYMBOLS:
    _CLASS[ord(_c)] = 4
for _c in ".!?":
    _CLASS[ord(_c)] = 5
_CLASS[128:192], _CLASS[192:] = 8, 7


@dataclass
class Model:
    """Emission weights of boilerplate against content, log-potentials of steps, threshold on the content share."""

    weights: np.ndarray
    steps: np.ndarray  # steps[a, b]: from label a to b; 0 content, 1 boilerplate
    start: np.ndarray
    share: float = 0.5


def fallback() -> Model:
    """Used where no labelled row exists: symbol-heavy, shouted or repeated lines count as boilerplate."""
    w = np.zeros(N_FEATURES)
    w[0], w[1], w[2], w[6] = -3.0, 30.0, 6.0, 3.0
    return Model(w, np.array([[0.5, -0.5], [-0.5, 0.5]]), np.zeros(2))


def line_features(lines: list[bytes], repeated: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """A row of features for each line."""
    lengths = np.fromiter(map(len, lines), np.int64, len(lines))
    data = np.frombuffer(b"".join(lines), np.uint8)
    row = np.repeat(np.arange(len(lines)) * 9, lengths)
    counts = np.bincount(row + _CLASS[data], minlength=9 * len(lines)).reshape(-1, 9).astype(np.float64)
    chars = counts[:, :8].sum(1)
    n = np.maximum(chars - counts[:, 0], 1)
    letters = np.maximum(counts[:, 1] + counts[:, 2] + counts[:, 7], 1)
    words = counts[:, 0] + 1
    ends = np.cumsum(lengths)
    filled = lengths > 0
    tail = np.zeros(len(lines), np.uint8)
    tail[filled] = _CLASS[data[ends[filled] - 1]] if len(data) else 0
    out = np.empty((len(lines), N_FEATURES))
    out[:, 0] = 1
    out[:, 1] = counts[:, 4] / n
    out[:, 2] = counts[:, 2] / letters
    out[:, 3] = counts[:, 3] / n
    out[:, 4] = counts[:, 5] / n
    out[:, 5] = counts[:, 6] / n
    out[:, 6] = repeated
    out[:, 7] = tail == 5
    out[:, 8] = np.log1p(words) / 4
    out[:, 9] = n / words / 10
    out[:, 10] = words <= 3
    out[:, 11] = first
    out[:, 12] = last
    out[:, 13] = counts[:, 4] > 0.1 * n
    return out


def read_block(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Base counts (texts x 5), features of lines with a word, characters of each such line, lines of each text."""
    base = np.zeros((len(texts), 5), np.int64)
    words_of, lines, repeated, first, last = [], [], [], [], []
    n_lines = np.zeros(len(texts), np.int64)
    chars = []
    for i, text in enumerate(texts):
        data = text.encode("utf-8", "surrogatepass")
        words = data.split()
        words_of.append(words)
        base[i, 0] = len(words)
        base[i, 1] = len(text) - sum(map(text.count, SPACES))
        base[i, 2] = sum(map(text.count, SYMBOLS))
        seen: set[bytes] = set()
        own = [x for x in data.split(b"\n") if x and not x.isspace()]
        for x in own:
            repeated.append(x in seen)
            seen.add(x)
        base[i, 3] = len(own) - len(seen)
        lines += own
        n_lines[i] = len(own)
        first += [True] + [False] * (len(own) - 1) if own else []
        last += [False] * (len(own) - 1) + [True] if own else []
    base[:, 4] = repeat_words(words_of)
    if lines:
        feats = line_features(lines, np.array(repeated), np.array(first), np.array(last))
        chars = np.fromiter((len(x) for x in lines), np.int64, len(lines))
    else:
        feats, chars = np.zeros((0, N_FEATURES)), np.zeros(0, np.int64)
    return base, feats, chars, n_lines


def repeat_words(words_of: list[list[bytes]], width: int = 5) -> np.ndarray:
    """Words of each text inside a window of ``width`` words that the text has twice or more."""
    sizes = np.fromiter(map(len, words_of), np.int64, len(words_of))
    total = int(sizes.sum())
    if not total:
        return np.zeros(len(words_of), np.int64)
    h = np.fromiter((hash(w) for ws in words_of for w in ws), np.int64, total).view(np.uint64)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    doc = np.repeat(np.arange(len(words_of)), sizes)
    n = total - width + 1
    if n <= 0:
        return np.zeros(len(words_of), np.int64)
    win = np.zeros(n, np.uint64)
    for k in range(width):
        win = win * np.uint64(0x9E3779B97F4A7C15) + h[k : k + n]
    whole = doc[:n] == doc[width - 1 :]
    win = (win ^ (win >> np.uint64(31))) + doc[:n].astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    at = np.flatnonzero(whole)
    key = win[at]
    order = np.argsort(key, kind="stable")
    key = key[order]
    same = key[1:] == key[:-1]
    twice = np.zeros(len(key), bool)
    twice[1:] |= same
    twice[:-1] |= same
    marked = at[order[twice]]
    begins = np.cumsum(np.bincount(marked, minlength=total + width))[:total]  # windows begun so far
    covered = begins - np.concatenate([np.zeros(width, np.int64), begins[:-width]]) > 0
    return np.bincount(doc, weights=covered, minlength=len(words_of)).astype(np.int64)


def viterbi(score: np.ndarray, n_lines: np.ndarray, model: Model) -> np.ndarray:
    """Best label of each line; ``score`` is the lines' emission score of boilerplate against content. Ties go to content.

    Texts are taken longest first, so step t works on the texts that have a line t, and nothing is padded.
    """
    labels = np.zeros(len(score), np.int8)
    some = np.flatnonzero(n_lines)
    if not len(some):
        return labels
    order = some[np.argsort(-n_lines[some], kind="stable")]
    sizes, begin = n_lines[order], (np.cumsum(n_lines) - n_lines)[order]
    alive = np.searchsorted(-sizes, -np.arange(int(sizes[0])), "left")  # texts with more than t lines
    back = np.zeros((len(score), 2), np.int8)
    best = np.zeros((len(order), 2))
    best[:, 0], best[:, 1] = model.start[0], model.start[1] + score[begin]
    for t in range(1, int(sizes[0])):
        k = alive[t]
        at = begin[:k] + t
        for b in (0, 1):
            stay, other = best[:k, 0] + model.steps[0, b], best[:k, 1] + model.steps[1, b]
            back[at, b] = other > stay
            new = np.maximum(stay, other) + (score[at] if b else 0)
            if b:
                best[:k, 1] = new
            else:
                zero = new
        best[:k, 0] = zero
    state = (best[:, 1] > best[:, 0]).astype(np.int8)
    for t in range(int(sizes[0]) - 1, -1, -1):
        k = alive[t]
        at = begin[:k] + t
        labels[at] = state[:k]
        if t:
            state[:k] = back[at, state[:k]]
    return labels


def _marginals(score, begin, alive, model):
    """Expected labels of all lines, steps and first labels. Runs of lines are given longest first: ``begin`` of each, and how many have a line t.

    Forward and backward messages are probabilities, normalised at each line.
    """
    step, up = np.exp(model.steps), np.exp(np.clip(score, -30, 30))
    n = len(alive)
    forward, scale = np.empty((len(score), 2)), np.empty(len(score))
    for t in range(n):
        at = begin[: alive[t]] + t
        f = forward[at - 1] @ step if t else np.broadcast_to(np.exp(model.start), (len(at), 2)).copy()
        f[:, 1] *= up[at]
        scale[at] = f.sum(1)
        forward[at] = f / scale[at][:, None]
    node, pairs = np.empty(len(score)), np.zeros((2, 2))
    back = np.ones((len(begin), 2))
    for t in range(n - 1, -1, -1):
        k = alive[t]
        at = begin[:k] + t
        b = back[:k]
        node[at] = forward[at, 1] * b[:, 1]
        if t:
            b = b / scale[at][:, None]
            b[:, 1] *= up[at]
            pairs += step * (forward[at - 1].T @ b)
            back[:k] = b @ step.T
    first = node[begin]
    return node, pairs, np.array([len(begin) - first.sum(), first.sum()])


def fit(feats: np.ndarray, n_lines: np.ndarray, chars: np.ndarray, quality: np.ndarray, rounds: int = 3, steps: int = 60) -> Model:
    """Hard EM around penalised maximum likelihood; the share threshold is the one that tells the sample's qualities apart best."""
    keep = n_lines > 0
    doc = np.repeat(np.arange(len(n_lines)), n_lines)
    if not keep.any() or len(set(quality[keep].tolist())) < 2:
        return fallback()
    labels = (quality[doc] == 0).astype(np.int8)
    model = Model(np.zeros(N_FEATURES), np.zeros((2, 2)), np.zeros(2))
    # Long texts are cut into runs of 64 lines for fitting, so that steps work on many at once.
    cut = np.concatenate([[min(64, n - a) for a in range(0, n, 64)] for n in n_lines if n]).astype(np.int64)
    begin = np.cumsum(cut) - cut
    longest_first = np.argsort(-cut, kind="stable")
    runs, alive = begin[longest_first], np.searchsorted(-cut[longest_first], -np.arange(int(cut.max())), "left")
    weight = 1.0 / len(labels)
    for r in range(rounds):
        inner = np.ones(len(labels), bool)
        inner[begin] = False
        at = np.flatnonzero(inner)
        seen_steps = np.zeros((2, 2))
        np.add.at(seen_steps, (labels[at - 1], labels[at]), 1)
        seen_start = np.bincount(labels[begin], minlength=2).astype(float)
        seen = feats.T @ labels
        m = [np.zeros(N_FEATURES + 6), np.zeros(N_FEATURES + 6)]
        for k in range(1, steps + 1):
            p, pairs, first = _marginals(feats @ model.weights, runs, alive, model)
            g = np.concatenate([(seen - feats.T @ p) * weight - 1e-4 * model.weights, ((seen_steps - pairs) * weight).ravel() - 1e-4 * model.steps.ravel(), (seen_start - first) * weight])
            m[0] = 0.9 * m[0] + 0.1 * g
            m[1] = 0.99 * m[1] + 0.01 * g * g
            step = 0.3 * (m[0] / (1 - 0.9**k)) / (np.sqrt(m[1] / (1 - 0.99**k)) + 1e-8)
            model.weights = model.weights + step[:N_FEATURES]
            model.steps = model.steps + step[N_FEATURES : N_FEATURES + 4].reshape(2, 2)
            model.start = model.start + step[N_FEATURES + 4 :]
        score = feats @ model.weights
        if r < rounds - 1:
            labels = viterbi(score, n_lines, model)
            labels[quality[doc] == 1] = 0
            bad = np.flatnonzero(keep & (quality == 0))
            starts = np.cumsum(n_lines) - n_lines
            for i in bad:
                own = slice(starts[i], starts[i] + n_lines[i])
                if not labels[own].any():
                    labels[starts[i] + int(np.argmax(score[own]))] = 1
    share = content_share(viterbi(feats @ model.weights, n_lines, model), chars, n_lines)[keep]
    q = quality[keep]
    best = max((0.5 * ((share >= c)[q == 1].mean() + (share < c)[q == 0].mean()), -abs(c - 0.5), c) for c in np.arange(0.05, 1.0, 0.05))
    model.share = float(best[2])
    return model


def content_share(labels: np.ndarray, chars: np.ndarray, n_lines: np.ndarray) -> np.ndarray:
    """Share of bytes in content lines; 0 for a text without a line."""
    doc = np.repeat(np.arange(len(n_lines)), n_lines)
    total = np.bincount(doc, weights=chars, minlength=len(n_lines))
    content = np.bincount(doc, weights=chars * (labels == 0), minlength=len(n_lines))
    return content / np.maximum(total, 1)


def train(spark: SparkSession, docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """Fit on at most ``sample`` labelled documents. Rows without a quality or a text are left out."""
    ready(spark)
    chosen = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    chosen = chosen.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)  # bounded, so it may be sent around

    def describe(batches):
        for batch in batches:
            _, feats, chars, n = read_block(batch.column(1).to_pylist())
            at = np.cumsum(n) - n
            rows = [(q, feats[a : a + k].astype("<f4").tobytes(), chars[a : a + k].astype("<i8").tobytes()) for q, a, k in zip(batch.column(2).to_pylist(), at.tolist(), n.tolist())]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary()), pa.array([r[2] for r in rows], pa.binary())], names=["quality", "feats", "chars"])

    short = (F.length("text") - F.length(F.translate("text", "\n", ""))) < LINES
    rows = docs.select("doc_id", "text").where("text is not null").where(short).join(F.broadcast(chosen), "doc_id")
    # One text an id, that of least digest; rows of one id meet as partial minima.
    rows = rows.groupBy("doc_id", F.col("quality").cast("int").alias("quality")).agg(F.min(F.struct(F.md5("text").alias("digest"), "text")).alias("x")).select("doc_id", F.col("x.text").alias("text"), "quality")
    got = sorted(rows.mapInArrow(describe, "quality int, feats binary, chars binary").collect())
    if not got:
        return fallback()
    chars = np.concatenate([np.frombuffer(r["chars"], "<i8") for r in got])
    n_lines = np.array([len(r["chars"]) // 8 for r in got])
    feats = np.concatenate([np.frombuffer(r["feats"], "<f4").reshape(-1, N_FEATURES) for r in got]).astype(float)
    return fit(feats, n_lines, chars, np.array([r["quality"] for r in got]))


JUDGED = "doc_id bigint, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, base_failed boolean, kept boolean, n_lines bigint, n_content_lines bigint, content_share double"
_TYPES = [pa.int64()] * 6 + [pa.bool_()] * 2 + [pa.int64()] * 2 + [pa.float64()]


def judge(docs: DataFrame, model: Model, passed: list[str] | None = None) -> DataFrame:
    """The counts and verdicts of every row of ``docs``; with ``passed``, the kept rows' columns of that name instead.

    A null or empty text has no words, fails the base rules and is not kept. Repeated rows are judged each for
    itself. Other columns are ignored.
    """
    names = [x.split()[0] for x in JUDGED.split(", ")]

    def apply(batches):
        give_back()
        for batch in batches:
            ids, texts = batch.column("doc_id"), batch.column("text")
            at = 0
            while at < batch.num_rows:
                end, size = at, 0
                while end < batch.num_rows and (size < _BLOCK or end == at):
                    size += 1 + (texts[end].as_buffer().size if texts[end].is_valid else 0)
                    end += 1
                base, feats, chars, n = read_block([x or "" for x in texts[at:end].to_pylist()])
                labels = viterbi(feats @ model.weights, n, model)
                share = content_share(labels, chars, n)
                doc = np.repeat(np.arange(len(n)), n)
                content = np.bincount(doc, weights=labels == 0, minlength=len(n)).astype(np.int64)
                failed = (base[:, 0] < 10) | (100 * base[:, 4] > 20 * base[:, 0])
                kept = ~failed & (share >= model.share)
                if passed is not None:
                    yield batch.slice(at, end - at).filter(pa.array(kept)).select(passed)
                else:
                    columns = [ids[at:end], *[pa.array(base[:, k]) for k in range(5)], pa.array(failed), pa.array(kept), pa.array(n), pa.array(content), pa.array(share)]
                    yield pa.RecordBatch.from_arrays([c.cast(t) for c, t in zip(columns, _TYPES)], names=names)
                at = end

    if passed is None:
        return docs.select("doc_id", "text").mapInArrow(apply, JUDGED)
    kinds = docs.select(*passed).schema
    return docs.select(*passed).mapInArrow(apply, kinds)


def judge_documents(spark: SparkSession, docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    return judge(docs, train(spark, docs, labels, sample))
