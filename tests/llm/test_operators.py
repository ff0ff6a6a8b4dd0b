"""The ten operators against brute force, on small fixtures with nulls, empty and long texts, ties and repeated rows."""

from __future__ import annotations

import base64
import hashlib
import os
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

os.environ.setdefault("PYTHONHASHSEED", "0")
tokenizers = pytest.importorskip("tokenizers")
vocab = pytest.importorskip("public_tokenizers")

from lectern.llm import decontaminate, graph, packing, quality_crf, ring, simhash_forest, suffix_dedup, suffixes, token_store, unigram_count, url_filter, warc  # noqa: E402
from lectern.llm.tokenization import CachedEncoder  # noqa: E402

RNG = random.Random(7)
SYL = "the er on an re he in ed nd ha at en es or nt ea ti to io le is ou ar as de rt ve".split()
ODD = [None, "", "   \n\t ", "a", "éàü ñ 漢字 😀 e\u0301", "x" * 70_000, "tab\there  two  spaces \n \n end ", "don't we'LL <|endoftext|>", "a\u00a0b\u2003c\x1cd\x85e"]


def prose(n: int) -> str:
    out = ["".join(RNG.choice(SYL) for _ in range(RNG.randint(1, 4))) for _ in range(n)]
    for i in range(7, n, 9):
        out[i] += RNG.choice([".", ",", ".\n", "!"])
    return " ".join(out)


@pytest.fixture(scope="module")
def rows():
    texts = ODD + [prose(RNG.randint(5, 400)) for _ in range(60)]
    texts += texts[12:18] + [texts[20] + " " + texts[21]]
    docs = [(i, t) for i, t in enumerate(texts)]
    return docs + [docs[30], docs[30], (31, "another text under a number that is taken"), (None, texts[15]), (None, None)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame([(d, t, "xx", -1, "clash") for d, t in rows], "doc_id bigint, text string, lang string, n_words bigint, shard string").repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], "doc_id bigint, text string")


def got(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


# -- 1


def base_counts(t):
    t = t or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    c = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    covered = {k for i in range(len(w) - 4) if c[tuple(w[i : i + 5])] > 1 for k in range(i, i + 5)}
    seen, dup = set(), 0
    for line in t.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), dup, len(covered)


def test_quality_base(docs, rows, spark):
    df = quality_crf.judge(docs, quality_crf.fallback())
    mine = Counter((r["doc_id"], r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) for r in df.collect())
    want = Counter((d, *b, b[0] < 10 or 100 * b[4] > 20 * b[0]) for d, t in rows for b in [base_counts(t)])
    assert mine == want


def test_quality_repeats():
    for text in ("a b c d e a b c d e", "a " * 12, "a b c d", "a b c d e f\n" * 3, "\n".join(["same line here"] * 4)):
        assert tuple(quality_crf.read_block([text, "other", text])[0][2]) == base_counts(text)


def test_viterbi_is_best_of_all_paths():
    rng = np.random.default_rng(1)
    m = quality_crf.Model(np.zeros(1), rng.normal(size=(2, 2)), rng.normal(size=2))
    n = np.array([3, 0, 6, 1, 6, 2])
    score = rng.normal(size=n.sum()) * 2
    labels = quality_crf.viterbi(score, n, m)
    at = 0
    for k in n:
        s = score[at : at + k]
        if k:
            value = lambda y: m.start[y[0]] + sum(s[i] for i in range(k) if y[i]) + sum(m.steps[y[i - 1], y[i]] for i in range(1, k))  # noqa: B023, E731
            best = max((tuple((c >> i) & 1 for i in range(k)) for c in range(2**k)), key=value)
            assert tuple(labels[at : at + k]) == best
        at += k


def test_marginals_are_sums_over_paths():
    rng = np.random.default_rng(2)
    m = quality_crf.Model(np.zeros(1), rng.normal(size=(2, 2)), rng.normal(size=2))
    score, k = rng.normal(size=4), 4
    node, pairs, first = quality_crf._marginals(score, np.array([0]), np.array([1] * 4), m)
    paths = [tuple((c >> i) & 1 for i in range(k)) for c in range(2**k)]
    w = np.array([np.exp(m.start[y[0]] + sum(score[i] for i in range(k) if y[i]) + sum(m.steps[y[i - 1], y[i]] for i in range(1, k))) for y in paths])
    w /= w.sum()
    assert np.allclose(node, [sum(p for p, y in zip(w, paths) if y[i]) for i in range(k)])
    assert np.allclose(pairs, [[sum(p * sum(y[i - 1] == a and y[i] == b for i in range(1, k)) for p, y in zip(w, paths)) for b in (0, 1)] for a in (0, 1)])
    assert np.allclose(first[1], node[0])


def test_quality_learns(spark):
    good = [prose(120) for _ in range(80)]
    bad = ["\n".join(" ".join(w + "***" for w in prose(12).split()) for _ in range(8)) for _ in range(80)]
    data = [(i, t) for i, t in enumerate(good + bad)]
    df = spark.createDataFrame(data, "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, int(i < 80), 0) for i in range(0, 160, 2)] + [(1, None, None), (None, 1, 0), (999, 1, 0)], "doc_id bigint, quality int, toxic int")
    kept = {r["doc_id"]: r["kept"] for r in quality_crf.judge_documents(spark, df, labels).collect()}
    odd = [(kept[i], i < 80) for i in range(1, 160, 2)]  # held out
    assert sum(a == b for a, b in odd) >= 0.95 * len(odd)


def test_quality_fits_on_one_text_an_id(spark, monkeypatch):
    """Repeated ids and very long texts don't add to what the driver gets."""
    seen = []
    monkeypatch.setattr(quality_crf, "LINES", 50)
    monkeypatch.setattr(quality_crf, "fit", lambda feats, n, chars, q: seen.append((len(n), int(n.sum()))))
    df = spark.createDataFrame([(1, "a line\n" * 3)] * 40 + [(1, "b")] * 3 + [(2, "c\n" * 500), (2, "d")], "doc_id bigint, text string")
    quality_crf.train(spark, df, spark.createDataFrame([(1, 1, 0), (1, 0, 0), (2, 0, 0)], "doc_id bigint, quality int, toxic int"))
    assert seen[0][0] == 2 and seen[0][1] <= 4


def test_quality_edges(spark, docs, empty):
    none = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    assert quality_crf.judge_documents(spark, empty, none).count() == 0
    kept = quality_crf.judge(docs, quality_crf.fallback(), docs.columns)
    assert kept.columns == docs.columns and 0 < kept.count() < docs.count()


# -- 2

URLS = [None, "", "no scheme", "http://", "https://EXAMPLE.com/en/748?x#y", "http://a.b.example.com/en/8", "http://example.com:80/en/7", "ftp://x.com/en", "http://com/en/1", "http://notexample.net/de/8", "http://example.net/de/8x", "http://x.org/es/?q", "http://x.org#/es/", "http://É.org/es/a", "a://b://c.org/es/", "http://sub.example.net/de/81/../", "http://x.net/de/\nline"]


def verdict_of(url, rules, default):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        host = re.split(r"[/?#]", rest)[0]
        path = re.split(r"[?#]", rest[len(host) :])[0]
        host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
    fit = [(len(h + p), len(h), h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fit, default=None)
    return host, path, best and best[2], best[3] if best else default


@pytest.mark.parametrize(("bound", "prefix"), [(64 << 20, 8), (-1, 8), (64 << 20, 1)])
def test_urls(spark, monkeypatch, bound, prefix):
    from lectern.llm.queries import RULES

    monkeypatch.setattr(url_filter, "PREFIX", prefix)  # of one digit: rules share it
    monkeypatch.setattr(url_filter, "BROADCAST_BYTES", bound)
    data = list(enumerate(URLS)) + [(3, URLS[4]), (4, URLS[4]), (None, URLS[5])]
    pages = spark.createDataFrame([(i, u, "h") for i, u in data], "page_id bigint, url string, host string")
    rules = [*RULES, ("org", "", "allow"), ("É.org", "/es/", "allow"), ("net", "/de/", "block"), ("net", "/de/", "allow")]
    df = url_filter.judge_urls(spark, pages, url_filter.rule_table(spark, [*rules, (None, "/", "block")]))
    want = [r for r in rules if r != ("net", "/de/", "allow")]
    assert got(df) == sorted(((i, u, *verdict_of(u, [(h.replace("É", "É"), p, v) for h, p, v in want], "allow")) for i, u in data), key=repr)


def test_urls_without_rules(spark):
    pages = spark.createDataFrame([(1, "http://a.b/c")], "page_id bigint, url string")
    assert got(url_filter.judge_urls(spark, pages, url_filter.rule_table(spark, [("x", None, "block")]))) == [(1, "http://a.b/c", "a.b", "/c", None, "allow")]
    assert url_filter.judge_urls(spark, pages.limit(0), url_filter.rule_table(spark, [("x", "/", "block")])).count() == 0


# -- 3


def jaccard_classes(rows, similarity=0.8):
    from lectern.llm.words import shingle_sets

    texts = [(d, t) for d, t in rows if d is not None and t is not None]
    sets = [set(s.tolist()) for s in shingle_sets([t for _, t in texts])]
    up = list(range(len(texts)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(texts)):
        for j in range(i):
            a, b = sets[i], sets[j]
            if a == b or a | b and len(a & b) / len(a | b) >= similarity:
                up[find(i)] = find(j)
    groups = {}
    for i, (d, _) in enumerate(texts):
        groups.setdefault(find(i), []).append(d)
    return sorted(((d, min(g), len(g)) for g in groups.values() for d in g), key=repr)


def near_copies(rng):
    base, out = [prose(200) for _ in range(6)], []
    for b in base:
        out.append(b)
        for k in range(12):
            w = b.split()
            for _ in range(rng.randint(0, 6)):
                w[rng.randrange(len(w))] = "changed"
            out.append(" ".join(w))
    return out


@pytest.mark.parametrize("hot", [4096, 6])
def test_near_duplicates(spark, monkeypatch, hot):
    monkeypatch.setattr(simhash_forest, "HOT", hot)
    monkeypatch.setattr(simhash_forest, "STAR", 5)
    rows = list(enumerate(near_copies(random.Random(3)) + ["", " ", "one two", "One, two.", "a b c d e"])) + [(500, None), (501, None), (None, "x")]
    rows.append((2, rows[2][1]))
    df = spark.createDataFrame([(d, t, "e") for d, t in rows], "doc_id bigint, text string, node string").repartition(4)
    mine = got(simhash_forest.near_duplicates(spark, df))
    alone = [(500, 500, 1), (501, 501, 1), (None, None, 1)]
    assert [x for x in mine if x not in alone] == sorted(jaccard_classes(rows), key=repr)
    assert [x for x in mine if x in alone] == sorted(alone, key=repr)
    kept = simhash_forest.keep_one(spark, df)
    assert kept.columns == df.columns
    assert sorted(r["doc_id"] for r in kept.where("doc_id is not null").collect()) == sorted({x[1] for x in mine if x[1] is not None})


def test_sets_are_sent_once_a_group(spark, monkeypatch):
    """Of 40 nodes that all meet each other, a set goes to each group of ten, and not to each pair."""
    monkeypatch.setattr(simhash_forest, "STAR", 10)
    rng = np.random.default_rng(9)
    sets = {bytes([k]) * 16: np.unique(rng.integers(0, 300, 200).astype(np.uint64)) for k in range(40)}
    keys = sorted(sets)
    pairs = spark.createDataFrame([(a, b) for i, a in enumerate(keys) for b in keys[i + 1 :]], "a binary, b binary")
    shown = spark.createDataFrame([(k, simhash_forest.packed(v)) for k, v in sets.items()], "node binary, shingles binary")
    groups = simhash_forest._groups(pairs, shown.withColumnRenamed("shingles", "data")).collect()
    assert len(groups) <= 39 + 39 * 5
    out = {(bytes(r["a"]), bytes(r["b"])): r["jaccard"] for r in simhash_forest.verify(pairs, shown, 3).collect()}
    assert out == {(a, b): len(np.intersect1d(sets[a], sets[b])) / len(np.union1d(sets[a], sets[b])) for i, a in enumerate(keys) for b in keys[i + 1 :]}


@pytest.mark.parametrize("most", [1 << 22, 50])
def test_kin_are_the_pairs_that_fit(most):
    """Members of nodes that failed, against all pairs; those that many failed pairs lead to are given once."""
    rng = np.random.default_rng(10)
    every = np.zeros(60, simhash_forest._MEMBER)
    every["node"] = np.frombuffer(rng.bytes(16 * 60), "V16")
    every["root"][:, 1], every["size"] = rng.integers(0, 12, 60), rng.integers(80, 120, 60)
    every["sig"] = rng.integers(0, 1 << 63, 4).astype(np.uint64) ^ (np.uint64(1) << rng.integers(0, 60, (60, 4)).astype(np.uint64))
    close = [rng.choice(60, 8, False) for _ in range(20)]
    lost = {(int(a), int(b)) for a, b in rng.integers(0, 20, (150, 2)) if a < b}
    kin = simhash_forest.Kin(0.8, 6, most)
    for a in {a for a, _ in lost}:
        kin.hold(bytes([a]), every[close[a]].tobytes())
    out = []
    for b in {b for _, b in lost}:
        out += kin.meet([bytes([x]) for x, y in lost if y == b], every[close[b]].tobytes())
    out += kin.found()
    mine = [(a, b) for batch in out for a, b in zip(*(c.to_pylist() for c in batch.columns))]

    def fits(x, y):
        apart = sum(int(i ^ j).bit_count() for i, j in zip(x["sig"].tolist(), y["sig"].tolist()))
        return tuple(x["root"]) != tuple(y["root"]) and min(x["size"], y["size"]) >= 0.8 * max(x["size"], y["size"]) and apart <= 6

    want = {(every["node"][x].tobytes(), every["node"][y].tobytes()) for a, b in lost for x in close[a] for y in close[b] if fits(every[x], every[y])}
    assert want and set(mine) == want
    assert most == 50 or len(mine) == len(want)


def test_keep_one_of_repeated_ids(spark):
    one, two, three = prose(80), prose(80), prose(80)
    # 5 has a text of its own, a copy of 1 and a text that 7 copies.
    rows = [(1, one), (5, one), (5, two), (5, two), (5, three), (7, three), (9, None)]
    df = spark.createDataFrame([(d, "x", t) for d, t in rows], "doc_id bigint, lang string, text string").repartition(3)
    kept = simhash_forest.keep_one(spark, df)
    assert kept.columns == df.columns
    assert got(kept) == sorted([(1, "x", one), (5, "x", two), (5, "x", three), (9, "x", None)], key=repr)


def test_forest_plan_meets_recall():
    for n in (2, 1000, 10**6, 10**10):
        depth, tries = simhash_forest.plan(n)
        assert 1 - (1 - simhash_forest.bit_agreement(0.8) ** depth) ** tries >= simhash_forest.RECALL
    assert simhash_forest.plan(10**9)[0] > simhash_forest.plan(10**5)[0]


def test_forest_plan_meets_joint_recall():
    from math import comb

    p = 1 - simhash_forest.bit_agreement(0.8)
    near = simhash_forest.reach(0.8, simhash_forest.RECALL)
    for n in (1000, 250_000, 15_000_000, 10**10):
        depth, tries = simhash_forest.plan(n)
        found = sum(comb(256, h) * p**h * (1 - p) ** (256 - h) * (1 - (1 - comb(256 - h, depth) / comb(256, depth)) ** tries) for h in range(near + 1))
        assert found >= simhash_forest.RECALL


def test_near_duplicates_of_few_words(spark):
    rng = random.Random(4)
    rows = []
    for n in [8] * 150 + [12, 20, 30, 44] * 10:
        w = [f"w{rng.randrange(10**6)}" for _ in range(n)]
        rows += [(len(rows), " ".join(w)), (len(rows) + 1, " ".join([*w, "more"]))]
    rows += [(len(rows) + i, f"the page that you look for is not on this server any more {i}") for i in range(200)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert got(simhash_forest.near_duplicates(spark, df)) == jaccard_classes(rows)


def test_linked_exactly():
    rng = np.random.default_rng(8)
    for _ in range(20):
        base = [rng.integers(0, 2**63, 10, np.uint64) for _ in range(4)]
        sets = []
        for _ in range(30):
            s = base[rng.integers(4)].copy()
            k = rng.integers(0, 3)
            s[rng.choice(10, k, False)] = rng.integers(0, 40, k)
            sets.append(np.unique(s))
        own = [set(s.tolist()) for s in sets]
        alike = lambda i, j: len(own[i] & own[j]) / len(own[i] | own[j]) >= 0.8  # noqa: B023, E731
        links = simhash_forest.linked_exactly(sets, 0.8)
        assert all(alike(i, j) for i, j in links)
        root = list(range(30))
        for i, j in links:
            root = [root[i] if r == root[j] else r for r in root]
        assert all(root[i] == root[j] for i in range(30) for j in range(i) if alike(i, j))


def test_simhash_bits():
    rng = np.random.default_rng(5)
    sets = [np.unique(rng.integers(0, 2**63, n, np.uint64)) for n in (1, 9, 300)]
    sig = simhash_forest.signatures([np.zeros(0, np.uint64), *sets])
    assert sig.shape == (4, 32)
    a = sets[2]
    b = np.unique(np.concatenate([a[:270], rng.integers(0, 2**63, 30, np.uint64)]))
    s = simhash_forest.signatures([a, b])
    assert np.bitwise_count(s[0] ^ s[1]).sum() < simhash_forest.radius(0.8, 3)


def sorted_labels(sig):
    """Of 128-bit signatures the first bits as a trie's head (trie 0), the rest, and numbers, in the order of the trie."""
    bits = np.unpackbits(sig, axis=1)
    head = np.ascontiguousarray(np.packbits(np.concatenate([np.zeros((len(sig), 12), np.uint8), bits[:, :52]], 1), axis=1)).view(">u8")[:, 0].astype(np.int64)
    rest = np.ascontiguousarray(np.packbits(bits[:, 52:116], axis=1)).view(">u8")[:, 0].astype(np.uint64).view(np.int64)
    order = np.lexsort((rest, head))
    return head[order], rest[order], order.astype(np.int64)


def roots_of(n, pairs):
    up = list(range(n))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in pairs:
        up[find(a)] = find(b)
    return [find(x) for x in range(n)]


@pytest.mark.parametrize("hot", [4096, 16])
def test_climb_keeps_connections(hot, monkeypatch):
    rng = np.random.default_rng(6)
    monkeypatch.setattr(simhash_forest, "LEAF", 8)
    sig = np.repeat(rng.integers(0, 256, (3, 16), np.uint8), 30, 0)
    for r in sig:
        r[rng.integers(0, 14, 2)] ^= 1
    climb = simhash_forest.Climb(*sorted_labels(sig), 0, 33, 9, hot)
    assert not len(climb.run())  # stars shrink, so nothing is over
    pairs = list(zip(*(np.concatenate(x).tolist() for x in climb.pairs[:2])))
    assert len(pairs) < 90 * 4
    assert len(set(roots_of(90, pairs))) == 3


def test_climb_meets_all_pairs_or_passes_on():
    rng = np.random.default_rng(7)
    sig = np.repeat(rng.integers(0, 256, (40, 16), np.uint8), 5, 0)
    for r in sig:
        at = rng.choice(112, 14, False)
        r[at // 8] ^= (1 << (at % 8)).astype(np.uint8)  # within the radius, but not close
    labels = sorted_labels(sig)
    climb = simhash_forest.Climb(*labels, 0, 33, 5, 4096)
    assert not len(climb.run())
    found = set(map(frozenset, zip(*(np.concatenate(x).tolist() for x in climb.pairs[:2]))))
    bits = np.unpackbits(sig, axis=1)[:, :116]
    apart = (bits[:, None] != bits[None]).sum(2)
    assert found == {frozenset((i, j)) for i in range(200) for j in range(i) if apart[i, j] <= 33}
    dense = simhash_forest.Climb(*labels, 0, 33, 5, 20)
    assert sorted(dense.num[dense.run()].tolist()) == list(range(200))  # none stands for another: all go on
    whole = simhash_forest.Climb(*labels, 0, 33, 5, 20, whole=True)
    assert not len(whole.run())
    assert set(map(frozenset, zip(*(np.concatenate(x).tolist() for x in whole.pairs[:2])))) == found


def test_label_recall_is_that_of_drawn_pairs():
    """The planned recall against pairs drawn at the threshold, through real tries."""
    rng = np.random.default_rng(8)
    depth, tries = simhash_forest.plan(250_000)
    near = simhash_forest.reach(0.8, simhash_forest.RECALL)
    most, n = simhash_forest.label_reach(depth, near), 4000
    differs = rng.random((n, 256)) < simhash_forest.bit_gap(0.8)
    found = np.zeros(n, bool)
    for t in range(tries):
        own = differs[:, np.random.default_rng((0, t)).permutation(256)[: simhash_forest.LABEL]]
        found |= ~own[:, :depth].any(1) & (own.sum(1) <= most)
    assert (found & (differs.sum(1) <= near)).mean() >= simhash_forest.RECALL - 0.005


def test_keep_one_with_clashing_columns(spark):
    rows = [(1, "one two three", 5, "a"), (2, "one two three", 6, "b")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, n int, alike string")
    assert got(simhash_forest.keep_one(spark, df)) == [rows[0]]


def test_spread_join(spark, monkeypatch):
    from lectern.llm import common

    monkeypatch.setattr(common, "CROWDED", 3)
    left = spark.createDataFrame([(k,) for k in [1] * 10 + [2] * 2 + [3]], "k int")
    right = spark.createDataFrame([(1, 10, "a"), (2, 2, "b"), (3, 1, "c")], "k int, n long, v string")
    assert got(common.spread_join(left, right, "k", "n")) == sorted([(1, 10, "a")] * 10 + [(2, 2, "b")] * 2 + [(3, 1, "c")])


def test_components(spark):
    rng = random.Random(9)
    edges = [(i, i + 1) for i in range(30)] + [(100 + rng.randrange(40), 100 + rng.randrange(40)) for _ in range(30)] + [(7, 7)]
    up = {x: x for e in edges for x in e}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    from lectern.llm.common import ready

    mine = dict(got(graph.components(ready(spark).createDataFrame(edges, "a bigint, b bigint"))))
    assert mine == {x: find(x) for x in up if any(x in e and e[0] != e[1] for e in edges)}
    assert graph.components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


# -- 4, 8, tokenisation


@pytest.mark.parametrize("name, kind", [("word_bpe_49k.json", "word"), ("byte_bpe_50k.json", "byte")])
def test_cached_encoder_is_exact(name, kind, monkeypatch):
    import lectern.llm.tokenization as tk

    monkeypatch.setattr(tk, "CACHE", 300)
    mine = CachedEncoder(vocab.path(name), kind)
    plain = tokenizers.Tokenizer.from_file(vocab.path(name))
    plain.encode_special_tokens = True
    texts = [t for t in ODD if t is not None] + [prose(50) for _ in range(40)] + ["  x", "x  ", "\n \n a", "a  b", " \n", "ΑΣ ß İ K Å", "it'S 'tis x'll", "12 3a4", "\u3000a \u3000 b", "e\u0301 \u0301x", "a \u00a0 b", "²½x", "l'été c'est d'où"]
    rng = random.Random(4)
    texts += [f"a{chr(i)}b{chr(i)} {chr(i)}{chr(i)}A" for i in range(1, 0x250)]
    texts += ["".join(rng.choice("ab  \n\t'.É1\u00a0s") for _ in range(rng.randint(0, 30))) for _ in range(300)]
    for t, e in zip(texts, mine.encode(texts)):
        assert np.frombuffer(e, "<u4").tolist() == plain.encode(t, add_special_tokens=False).ids, repr(t)


@pytest.mark.parametrize("name, kind", [("word_bpe_49k.json", "word"), ("byte_bpe_50k.json", "byte")])
def test_encoder_finds_added_tokens(name, kind):
    mine = CachedEncoder(vocab.path(name), kind, added=True)
    plain = tokenizers.Tokenizer.from_file(vocab.path(name))  # left at its defaults
    assert len(plain.encode("end of it <|endoftext|> next", add_special_tokens=False).ids) == {"word": 5, "byte": 6}[kind]
    end, start = "<|endoftext|>", "<|startoftext|>"
    texts = [t for t in ODD if t is not None] + [f"end of it {end} next", end, end * 3, f" {end} ", f"a{end}b", f"a  {end}  b", f"{start}x {end}\n\n y", end.upper(), end[:-1], f"<|{end}|>", f"it{end}'s", f"e{end}\u0301"]
    rng = random.Random(5)
    texts += ["".join(rng.choice([end, start, "a", " ", "\n", "'s", "É", "漢", "<|"]) for _ in range(rng.randint(0, 20))) for _ in range(300)]
    for t, e in zip(texts, mine.encode(texts)):
        assert np.frombuffer(e, "<u4").tolist() == plain.encode(t, add_special_tokens=False).ids, repr(t)


def test_parts_are_looked_up_once_for_all_texts():
    path = vocab.path("byte_bpe_50k.json")
    plain = tokenizers.Tokenizer.from_file(path)  # left at its defaults
    mine = CachedEncoder(path, "byte", added=True, cache=50)
    calls, model = [], mine.model

    class Counting:
        def tokenize(self, piece):
            calls.append(piece)
            return model.tokenize(piece)

    mine.model = Counting()
    words = [f"{a}{b}{c}" for a in ("qu", "zé", "Wo") for b in ("rta", "lm", "xie", "pf") for c in ("n", "sch", "ô", "rr", "ed")]
    rng = random.Random(6)
    texts = ["the " + " ".join(w + rng.choice(["", ",", "."]) for w in words) for _ in range(30)]
    for t, e in zip(texts, mine.encode(texts)):
        assert np.frombuffer(e, "<u4").tolist() == plain.encode(t, add_special_tokens=False).ids
    assert len(calls) <= 2 * len(words)  # beside the words: the first, commas and full stops, words at the ends
    some = ["a", "É", "bc", " a", " É", " bc", " x", ", ", ". ", ",", ".", ".\n", ",\n", "\n", "\n", "\n\n", "\t", "\u00a0", "\x1c", " 1", "'s", "'", " '", ";", "漢", "ª", "\u02b0", "\u0301", "<|endoftext|>"]
    odd = ["".join(rng.choice(some) for _ in range(rng.randint(0, 12))) for _ in range(4000)]
    for t, e in zip(odd, mine.encode(odd)):
        assert np.frombuffer(e, "<u4").tolist() == plain.encode(t, add_special_tokens=False).ids, repr(t)


@pytest.mark.parametrize("bits", [False, True])
def test_planes(bits, tmp_path):
    rng = np.random.default_rng(3)
    file = open(tmp_path / "f", "wb")
    w, want = token_store.Writer(file, bits), []
    for i in range(50):
        ids = rng.integers(0, 2 ** (32 if i % 7 == 0 else 16), int(rng.integers(0, 6000)), dtype=np.uint64).astype("<u4").tobytes()
        w.add(None if i == 0 else i, ids)
        want.append((None if i == 0 else i, ids))
    w.finish()
    file.close()
    r = token_store.Reader(str(tmp_path / "f"))
    assert [(d, ids) for d, _, ids in r.documents()] == want
    for k in (0, 7, 23, 49):
        assert r.document(k) == want[k][1]


def test_token_files(spark, docs, rows, empty):
    path = vocab.path("word_bpe_49k.json")
    plain = tokenizers.Tokenizer.from_file(path)
    plain.encode_special_tokens = True
    want, start = [], 0
    for d, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")):
        ids = plain.encode(t or "", add_special_tokens=False).ids + [1]
        want.append((d, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert got(token_store.round_trip(spark, docs, path)) == sorted(want, key=repr)
    assert token_store.round_trip(spark, empty, path).count() == 0


def test_lower_bound_and_best_fit():
    rng = np.random.default_rng(8)
    for _ in range(30):
        sizes = rng.integers(1, 65, int(rng.integers(1, 9)))
        bins, offsets, fills = packing.best_fit_decreasing(sizes, 64)
        assert fills.max() <= 64 and fills.sum() == sizes.sum()
        bound = packing.lower_bound(np.bincount(sizes, minlength=65), 64)

        def fits(items, room, left):
            if not items:
                return True
            tried = set()
            for i, r in enumerate(room):
                if r >= items[0] and r not in tried:
                    tried.add(r)
                    if fits(items[1:], room[:i] + [r - items[0]] + room[i + 1 :], left):
                        return True
            return left > 0 and fits(items[1:], [*room, 64 - items[0]], left - 1)

        least = next(k for k in range(1, 10) if fits(sorted(sizes.tolist(), reverse=True), [], k))
        assert bound <= least <= len(fills)
    assert packing.lower_bound(np.bincount([40, 40, 40], minlength=65), 64) == 3


def test_packing(spark, docs, rows, empty, monkeypatch):
    monkeypatch.setattr(packing, "GROUP", 40)
    path = vocab.path("byte_bpe_50k.json")
    plain = tokenizers.Tokenizer.from_file(path)
    plain.encode_special_tokens = True
    out = packing.pack_documents(spark, docs, path, capacity=256).collect()
    want = Counter()
    for d, t in rows:
        ids = plain.encode(t or "", add_special_tokens=False).ids + [2]
        n = len(ids)
        cuts = [(0, n)] if n <= 256 else ([(0, n % 256)] if n % 256 else []) + [(s, 256) for s in range(n % 256, n, 256)]
        want.update((d, k, s, m, zlib.crc32(np.array(ids[s : s + m], "<u4").tobytes())) for k, (s, m) in enumerate(cuts))
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in out) == want
    bins = {}
    for r in out:
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for b in bins.values():
        at = 0
        for o, n in sorted(b):
            assert o == at
            at += n
        assert at <= 256
    total = sum(r["length"] for r in out)
    assert len(bins) <= -(-total // 256) * 1.05 + 2
    assert packing.pack_documents(spark, empty, path).count() == 0


# -- 5


def test_decontamination(spark, empty):
    items = [(i, prose(25) + ". " + prose(6) + ".") for i in range(40)] + [(90, None), (91, ""), (92, "one"), (None, "x y")]
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    filler = [prose(300) for _ in range(30)]
    dirty = {i: filler[i][:400] + " " + items[i][1].upper().replace(" ", "  ") + " " + filler[i][400:] for i in range(8)}
    edited = items[9][1].split()
    edited[5] = "otherword"
    dirty[9] = filler[9] + " " + " ".join(edited)
    half = filler[10] + " " + " ".join(items[10][1].split()[:8])
    data = [(i, dirty.get(i, half if i == 10 else t), "s") for i, t in enumerate(filler)] + [(100, None, "s"), (101, "", "s"), (3, dirty[3], "s")]
    df = spark.createDataFrame(data, "doc_id bigint, text string, item_id string").repartition(3)
    found = [(r["doc_id"], r["item_id"]) for r in decontaminate.find_contaminated(spark, df, bench).collect()]
    assert sorted(x for x in found if x[1] != 92) == sorted([(i, i) for i in dirty] + [(3, 3)])
    assert {r["doc_id"] for r in decontaminate.drop_contaminated(spark, df, bench).collect()} == {d for d, *_ in data} - set(dirty) - {d for d, i in found if i == 92}
    assert decontaminate.find_contaminated(spark, empty, bench).count() == 0
    assert decontaminate.find_contaminated(spark, df, bench.limit(0)).count() == 0
    assert decontaminate.drop_contaminated(spark, df, bench.limit(0)).count() == len(data)


def test_wand_loses_nothing():
    rows = [(i, prose(30)) for i in range(50)]
    ix = decontaminate.Index(rows, overlap=0.0)
    texts = [prose(200) + " " + " ".join(RNG.sample(rows[i][1].split(), RNG.randint(15, 30))) for i in range(40)]
    mine = {(t, i.item_id) for t, i, *_ in ix.search(texts)}
    want = set()
    for t, text in enumerate(texts):
        w = decontaminate.words(text)
        for at in range(0, max(len(w), 1), ix.longest):
            have = {ix.terms.get(x) for x in w[at : at + 2 * ix.longest]}
            want |= {(t, it.item_id) for it in ix.items if sum(s for x, s in it.weights.items() if x in have) >= ix.threshold}
    assert mine == want and want


@pytest.mark.parametrize("threshold", [0.25, 0.6])
@pytest.mark.parametrize("block", [1, 4, 16])
def test_wand_on_long_lists(monkeypatch, threshold, block):
    """Items of few words: lists are long, cursors skip blocks and meet again; ties in all shares."""
    monkeypatch.setattr(decontaminate, "BLOCK_ITEMS", block)
    rng = random.Random(11)
    vocabulary = [f"w{k}" for k in range(60)]
    rows = [(i, " ".join(rng.choice(vocabulary[: rng.choice([10, 60])]) for _ in range(rng.randint(3, 12)))) for i in range(150)]
    rows += [(200 + i, rows[i][1]) for i in range(10)]
    ix = decontaminate.Index(rows, threshold, overlap=0.0)
    texts = [" ".join(rng.choice(vocabulary) for _ in range(rng.randint(1, 60))) for _ in range(60)] + ["", "nothing of these"]
    mine = {(t, i.item_id) for t, i, *_ in ix.search(texts)}
    want = set()
    for t, text in enumerate(texts):
        w = decontaminate.words(text)
        for at in range(0, max(len(w), 1), ix.longest):
            have = {ix.terms.get(x) for x in w[at : at + 2 * ix.longest]}
            want |= {(t, it.item_id) for it in ix.items if sum(s for x, s in it.weights.items() if x in have) >= ix.threshold}
    # The wider search holds answers and questions to nothing here.
    assert mine == want and len(want) > 50


def test_split_benchmark_scores_as_one(spark, monkeypatch):
    rng = random.Random(9)
    usual = [prose(1) for _ in range(40)]
    items = [(k, " ".join(rng.choice(usual) if rng.random() < 0.6 else f"q{k}x{i}" for i in range(rng.randint(8, 40))) + ". yes") for k in range(60)]
    docs = []
    for k, t in items:
        w = t.split()
        docs.append((k, prose(20) + " " + " ".join(w[: int(len(w) * rng.uniform(0.4, 1))]) + " yes " + prose(20)))
    df, bench = spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string")
    one = got(decontaminate.find_contaminated(spark, df, bench))
    monkeypatch.setattr(decontaminate, "INDEX_BYTES", 1500)
    assert len(list(decontaminate.indexes(bench, 0.6, 0.5))) > 3
    many = got(decontaminate.find_contaminated(spark, df, bench))
    assert 0 < len(one) and [x[:2] for x in one] == [x[:2] for x in many]
    assert np.allclose([x[2:] for x in one], [x[2:] for x in many])


def test_several_indexes(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "INDEX_BYTES", 500)
    items = [(i, prose(30)) for i in range(12)]
    df = spark.createDataFrame([(i, prose(50) + " " + t + " " + prose(50)) for i, t in items], "doc_id bigint, text string")
    found = decontaminate.find_contaminated(spark, df, spark.createDataFrame(items, "item_id bigint, text string"))
    assert {(r["doc_id"], r["item_id"]) for r in found.collect()} >= {(i, i) for i, _ in items}


# -- 6


def brute_removed(rows):
    data = [(d, (t or "").encode()) for d, t in rows]
    key = lambda k: (-(1 << 63) if data[k][0] is None else data[k][0], hashlib.blake2b(data[k][1], digest_size=16).digest()[:8])
    seen, out = set(), []
    for k in sorted(range(len(data)), key=key):
        d, b = data[k]
        gone = bytearray(len(b))
        for p in range(len(b) - 99):
            if b[p : p + 100] in seen:
                gone[p : p + 100] = b"\1" * 100
            else:
                seen.add(b[p : p + 100])
        kept = bytes(x for x, g in zip(b, gone) if not g)
        out.append((d, len(b), sum(gone), len(re.findall(b"\1+", bytes(gone))), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


@pytest.fixture(scope="module")
def repeats():
    rng = random.Random(11)
    base = ["".join(rng.choice("abcd é") for _ in range(400)) for _ in range(6)]
    out = []
    for i in range(50):
        t = ""
        for _ in range(rng.randint(0, 6)):
            c = rng.random()
            if c < 0.4:
                a = rng.randint(0, 300)
                t += rng.choice(base)[a : a + rng.randint(50, 250)]
            elif c < 0.6:
                t += rng.choice("xy") * rng.randint(1, 300)
            elif c < 0.7:
                t += "ab" * rng.randint(1, 200)
            else:
                t += "".join(rng.choice("abcdefgh ") for _ in range(rng.randint(0, 200)))
        out.append((i, t))
    return out + [(70, out[3][1]), (71, None), (72, ""), (5, out[6][1]), (5, out[5][1]), (80, base[0] * 3), (None, base[1] + base[2]), (None, base[1])]


def test_marks_are_spread_by_chunk(spark, monkeypatch):
    texts = [prose(60) for _ in range(6)]
    repeats = [(i, f"{prose(20)} {texts[i % 6]} {prose(20)}") for i in range(24)]
    df = spark.createDataFrame(repeats, "doc_id bigint, text string").repartition(3)
    meet, seen = suffix_dedup._meet, []

    def watched(sent, *how):
        out = meet(sent, *how)
        seen.append({tuple(r) for r in out.where("kind = 1").select("bucket", "salt", "chunk").collect()})
        return out

    monkeypatch.setattr(suffix_dedup, "_meet", watched)
    assert got(suffix_dedup.removed_bytes(spark, df, fan=8, piece=1500, chunk=3000)) == brute_removed(repeats)
    assert len(seen) > 1 and all(len({s for _, s, _ in x}) == len({c for *_, c in x}) > 1 for x in seen)


@pytest.mark.parametrize("how", [{}, {"fan": 2, "piece": 300, "chunk": 900}])
def test_suffix_dedup(spark, repeats, how):
    df = spark.createDataFrame([(d, t, 9) for d, t in repeats], "doc_id bigint, text string, n_bytes int").repartition(3)
    assert got(suffix_dedup.removed_bytes(spark, df, **how)) == brute_removed(repeats)


def test_suffix_rows_are_chunks_times_buckets(spark, repeats, monkeypatch):
    """However many pieces a chunk has, it sends one row to a bucket."""
    df = spark.createDataFrame(repeats, "doc_id bigint, text string").repartition(2)
    steps = {"_send_keys": [], "_send_windows": [], "_meet": []}

    def watch(name):
        step = getattr(suffix_dedup, name)

        def watched(*how):
            out = step(*how)
            kind = ["kind"] if "kind" in out.columns else []
            steps[name].append(out.groupBy("bucket", "chunk", *kind).count().agg({"count": "max"}).first()[0])
            return out

        monkeypatch.setattr(suffix_dedup, name, watched)

    for name in steps:
        watch(name)
    assert got(suffix_dedup.removed_bytes(spark, df, fan=1 << 20, piece=200, chunk=4000)) == brute_removed(repeats)
    assert steps["_send_keys"] == [1] and steps["_send_windows"] == [1]


def test_suffix_blocks_keep_anchors_together(monkeypatch):
    rng = np.random.default_rng(3)
    head = np.zeros(500, suffix_dedup._HEAD)
    head["key"], head["n"] = rng.integers(0, 40, 500), rng.integers(1, 30, 500)
    monkeypatch.setattr(suffix_dedup, "BLOCK", 600)
    blocks = suffix_dedup._blocks(head)
    keys = [set(head["key"][b].tolist()) for b in blocks]
    assert len(blocks) > 5 and sum(map(len, keys)) == 40
    assert sorted(np.concatenate(blocks).tolist()) == list(range(500))
    assert max(head["n"][b].sum() for b in blocks) < 600 + max(head["n"][head["key"] == k].sum() for k in range(40))


def test_remove_repeats(spark, repeats, empty):
    df = spark.createDataFrame([(d, t, 9) for d, t in repeats], "doc_id bigint, text string, n_bytes int")
    out = suffix_dedup.remove_repeats(spark, df)
    assert out.columns == df.columns
    kept = {(d, sha): n_removed for d, _, n_removed, _, sha in brute_removed(repeats)}
    texts = [(r["doc_id"], r["text"]) for r in out.collect()]
    # Characters that were cut through are gone, so only texts without cut characters are compared by digest.
    plain = {(d, hashlib.sha256((t or "").encode()).hexdigest()) for d, t in texts}
    assert sum(k in plain for k, n in kept.items() if n == 0) == sum(n == 0 for n in kept.values())
    assert all((t or "").strip() or (d, "") in texts or (d, None) in texts for d, t in texts)
    assert suffix_dedup.removed_bytes(spark, empty).count() == 0


def test_equal_classes_are_exact():
    rng = np.random.default_rng(12)
    data = np.concatenate([rng.integers(97, 99, 300), np.full(400, 97), np.tile(rng.integers(97, 123, 150), 4)]).astype(np.uint8)
    pos = np.arange(len(data) - 99)
    order, group = suffixes.equal_classes(suffixes.characters(data), pos, np.zeros(len(pos), np.uint64))
    mine = {}
    for o, g in zip(order.tolist(), group.tolist()):
        mine.setdefault(g, set()).add(o)
    want = {}
    for p in pos.tolist():
        want.setdefault(bytes(data[p : p + 100]), set()).add(p)
    assert sorted(map(sorted, mine.values())) == sorted(sorted(v) for v in want.values() if len(v) > 1)


# -- 7


def test_ring(spark, docs, rows, empty):
    out = ring.shard_documents(spark, docs, n_shards=7, vnodes=8).collect()
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in out) == Counter((d, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for d, t in rows)
    sizes = Counter(r["shard"] for r in out)
    assert max(sizes.values()) - min(sizes.values()) <= 1 and set(sizes) <= set(range(7))
    for s in sizes:
        assert sorted(r["slot"] for r in out if r["shard"] == s) == list(range(sizes[s]))
    assert ring.shard_documents(spark, empty).count() == 0


@pytest.mark.parametrize("stretch", [1 << 20, 2])
def test_ring_key_by_key(spark, monkeypatch, stretch):
    """Every key walks the ring by itself: to its own point's shard, or on clockwise from full ones, arcs in ring order."""
    import bisect

    monkeypatch.setattr(ring, "STRETCH", stretch)
    monkeypatch.setattr(ring, "RUN", 3)
    n_shards, vnodes = 5, 4
    data = [(i, prose(3)) for i in range(200)] + [(7, "the same")] * 90 + [(None, None)] * 20 + [(9, f"other {i}") for i in range(30)]
    df = spark.createDataFrame(data, "doc_id bigint, text string").repartition(5)
    out = ring.shard_documents(spark, df, n_shards=n_shards, vnodes=vnodes).collect()
    points = ring.ring_points(n_shards, vnodes)
    cells = [c for c, _ in points]
    place = {r["d"]: r["p"] for r in df.selectExpr("doc_id as d", "xxhash64(doc_id) as p").distinct().collect()}
    arc = lambda d: bisect.bisect_left(cells, (place[d] % 2**64) >> 48) % len(points)
    room = [len(data) // n_shards + (s < len(data) % n_shards) for s in range(n_shards)]
    waiting = {a: sum(arc(d) == a for d, _ in data) for a in range(len(points))}
    load = Counter()  # (arc, shard): keys
    for step in range(len(points)):
        for a in sorted(waiting):
            shard = points[(a + step) % len(points)][1]
            while waiting[a] and room[shard]:
                waiting[a], room[shard] = waiting[a] - 1, room[shard] - 1
                load[a, shard] += 1
    assert Counter((arc(r["doc_id"]), r["shard"]) for r in out) == +load
    assert Counter((r["doc_id"], r["size"]) for r in out) == Counter((d, len((t or "").encode()) + 8) for d, t in data)
    for s in range(n_shards):
        assert sorted(r["slot"] for r in out if r["shard"] == s) == list(range(sum(r["shard"] == s for r in out)))


def test_ring_moves_few_keys(spark):
    df = spark.range(20_000).selectExpr("id as doc_id", "'x' as text")
    before = {r["doc_id"]: r["shard"] for r in ring.shard_documents(spark, df, n_shards=24).collect()}
    after = {r["doc_id"]: r["shard"] for r in ring.shard_documents(spark, df, n_shards=25).collect()}
    assert sum(before[d] != after[d] for d in before) < 0.15 * len(before)  # 0.04 at least; a plain modulo moves 0.96


def test_ring_overflow_walks_clockwise():
    points = ring.ring_points(5, 4)
    rng = random.Random(2)
    counts = {a: rng.randrange(50) for a in range(len(points))}
    total = sum(counts.values())
    room = ring.bounds(total, 5, 0.1)
    segments = ring.settle(points, counts, room)
    load = Counter()
    for a, low, high, shard, slot in segments:
        load[shard] += high - low
    assert all(load[s] <= room[s] for s in range(5)) and sum(load.values()) == total
    for a in counts:
        mine = sorted((low, high, s) for b, low, high, s, _ in segments if b == a)
        assert [low for low, _, _ in mine] == [0, *[h for _, h, _ in mine][:-1]] if mine else not counts[a]
        order = list(dict.fromkeys(points[(a + k) % len(points)][1] for k in range(len(points))))
        if mine and mine[0][2] != order[0]:
            assert load[order[0]] == room[order[0]]
    grown = ring.settle(points, {**counts, 3: counts[3] + 1}, ring.bounds(total + 1, 5, 0.1))
    assert sum(h - low for _, low, h, _, _ in grown) == total + 1


# -- 9


def test_unigram_counts(spark, docs, rows, empty):
    scores = unigram_count.vocabulary(vocab.path("piece_bpe_32k.model"))
    from tokenizers.models import Unigram

    bytes_ = [(f"<0x{i:02X}>", 0.0) for i in range(256)]
    plain = tokenizers.Tokenizer(Unigram([("<unk>", 0.0), *scores.items(), *((b, -1e6) for b, _ in bytes_)], unk_id=0, byte_fallback=True))
    mine = unigram_count.TrieCounter(scores)
    least = min(scores.values()) - 10
    words = list({w for _, t in rows if t and len(t) < 5000 for w in t.split(" ") if w and "\n" not in w})

    def brute(w):
        best = [(0.0, 0)]
        for i in range(1, len(w) + 1):
            found = [(best[j][0] + scores[w[j:i]], best[j][1] + 1) for j in range(max(0, i - 40), i) if w[j:i] in scores]
            if w[i - 1] not in scores:
                found.append((best[i - 1][0] + least, best[i - 1][1] + len(w[i - 1].encode())))
            best.append(max(found, key=lambda x: x[0]))
        return best[-1]

    counts = mine.count_distinct([w.encode() for w in words])
    for w in words:
        assert counts[w.encode()] == brute("▁" + w)[1], w
    known = [w for w in words if w.isascii() and w.isalpha()][:300]
    assert sum(counts[w.encode()] == len(plain.encode("▁" + w, add_special_tokens=False).ids) for w in known) == len(known)
    out = unigram_count.count_tokens(spark, docs, vocab.path("piece_bpe_32k.model"))
    want = Counter()
    for d, t in rows:
        ws = (t or "").encode().split()
        c = mine.count_distinct(list(set(ws)))
        want[d, sum(c[w] for w in ws), len(ws)] += 1
    assert Counter(tuple(r) for r in out.collect()) == want
    assert unigram_count.count_tokens(spark, empty, vocab.path("piece_bpe_32k.model")).count() == 0


# -- 10


@pytest.mark.parametrize("least", [0, 50])
def test_warc(spark, least):
    rng = random.Random(5)
    html = ["", None, "<p>ü</p>", "x" * 200_000, "y" * 40] + ["".join(rng.choice("abc<>\r\n") for _ in range(rng.randrange(3000))) for _ in range(20)]
    data = [(i, f"http://h/{i} \r\nx", h) for i, h in enumerate(html)] + [(100 + i, None, html[i]) for i in (0, 2, 3, 3, 7, 8)] + [(200, "u", html[3])]
    data += [(None, "a", html[1]), (None, "b", "of no number"), (None, "a", "of no number"), (None, "a", "of no number"), (None, None, "of no number"), (None, "c", html[3])]
    pages = spark.createDataFrame([(i, u, h, "d") for i, u, h in data], "page_id bigint, url string, html string, digest string").repartition(3)
    want, groups = Counter(), {}
    for i, _, h in data:
        groups.setdefault((h or "").encode(), []).append(i)
    for b, ids in groups.items():
        sha = base64.b32encode(hashlib.sha1(b).digest()).decode()
        numbered = [i for i in ids if i is not None]
        top, first = max(numbered, default=None), True
        for i in sorted(numbered, reverse=True) + [None] * (len(ids) - len(numbered)):
            response = len(b) < least or (i == top and first)
            first = first and i != top
            want[i, len(b), sha, "response" if response else "revisit", None if response else top] += 1
    assert Counter(tuple(r) for r in warc.archive_pages(spark, pages, least=least, segment=4096).collect()) == want
    assert warc.archive_pages(spark, pages.limit(0)).count() == 0


def test_unchunker_in_any_parts():
    block = b"HTTP/1.1 200 OK\r\nA: b\r\n\r\n" + b"5;ext=1\r\nhello\r\n6\r\n world\r\n0\r\nTrailer: x\r\n\r\n"
    for step in (1, 2, 3, 7, 100):
        u = warc.Unchunker()
        for at in range(0, len(block), step):
            u.feed(block[at : at + step])
        assert u.finish() == (11, base64.b32encode(hashlib.sha1(b"hello world").digest()).decode())
    u = warc.Unchunker()
    u.feed(block[:-3])
    with pytest.raises(ValueError):
        u.finish()
