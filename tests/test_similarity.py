"""The similarity of texts against difflib, and how long it takes."""

import random
import time
from difflib import SequenceMatcher

import pytest

from lectern.functions import similarity, text as tx


def plain(a, b):
    return SequenceMatcher(None, a, b, autojunk=False).ratio()


def some(seed, n):
    r = random.Random(seed)
    for _ in range(n):
        letters, (x, y) = r.choice(["a", "ab", "abc", "abcdefgh"]), r.choice([(0, 0), (0, 5), (1, 9), (3, 7), (20, 20), (60, 40), (5, 80)])
        yield "".join(r.choices(letters, k=x)), "".join(r.choices(letters, k=y))


def test_as_difflib():
    for a, b in some(1, 3000):
        assert similarity.ratio(a, b) == plain(a, b), (a, b)


@pytest.mark.parametrize("most", [0, 3, 30])
def test_more_matches_than_are_listed(monkeypatch, most):
    monkeypatch.setattr(similarity, "MOST", most)
    for a, b in some(2, 600):
        assert similarity.ratio(a, b) == plain(a, b), (a, b)


def test_long_texts_take_a_fraction_of_the_time():
    r = random.Random(3)
    words = ["".join(r.choices("etaoinshrdlu", k=r.randint(2, 5))) for _ in range(60)]
    pairs = [("".join(r.choices(words, k=400)), "".join(r.choices(words, k=400))) for _ in range(6)]
    began = time.process_time()
    want = [plain(*p) for p in pairs]
    between = time.process_time()
    assert tx.similarity.func(*map(__import__("pandas").Series, zip(*pairs))).tolist() == want
    assert time.process_time() - between < 0.5 * (between - began)
