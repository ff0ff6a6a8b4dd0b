"""Ratcliff-Obershelp similarity, as ``difflib`` has it without junk, by longest matches that are looked for once a pair."""

from __future__ import annotations

from difflib import SequenceMatcher

#: Matches of so many letters and more are listed once; shorter ones are looked for where none of these is left.
SEED = 4
#: Matches listed at most; of two texts that have more, a match is looked for at a time, without a list.
MOST = 100_000


def _segments(a: str, b: str) -> list[tuple[int, int, int]] | None:
    """All matches (start in a, start in b, length) of ``SEED`` letters or more that can't be made longer; null if they are too many."""
    at: dict[str, list[int]] = {}
    for j in range(len(b) - SEED + 1):
        at.setdefault(b[j : j + SEED], []).append(j)
    out, na, nb = [], len(a), len(b)
    for i in range(na - SEED + 1):
        for j in at.get(a[i : i + SEED], ()):
            if i and j and a[i - 1] == b[j - 1]:
                continue
            p, q = i + SEED, j + SEED
            while p < na and q < nb and a[p] == b[q]:
                p, q = p + 1, q + 1
            out.append((i, j, p - i))
        if len(out) > MOST:
            return None
    return out


def _within(segments: list, alo: int, ahi: int, blo: int, bhi: int) -> list[tuple[int, int, int]]:
    """What is left of matches inside the window, where it is ``SEED`` letters or more."""
    out = []
    if ahi - alo < SEED or bhi - blo < SEED:
        return out
    for i, j, n in segments:
        low = max(alo - i, blo - j, 0)
        high = min(ahi - i, bhi - j, n)
        if high - low >= SEED:
            out.append((i + low, j + low, high - low))
    return out


def _short(a: str, b: str, longest: int) -> int:
    """Letters in common where no match is longer than ``longest``."""
    total, todo = 0, [(a, b, longest)]
    while todo:
        a, b, k = todo.pop()
        if not a or not b:
            continue
        if len(a) == 1 or len(b) == 1:
            total += a in b or b in a
            continue
        i = -1
        for n in range(min(k, len(a), len(b)), 1, -1):
            grams = {b[j : j + n] for j in range(len(b) - n + 1)}
            i = next((i for i in range(len(a) - n + 1) if a[i : i + n] in grams), -1)
            if i >= 0:
                break
        else:
            n, letters = 1, set(b)
            i = next((i for i, x in enumerate(a) if x in letters), -1)
            if i < 0:
                continue
        j = b.find(a[i : i + n])
        total += n
        todo.append((a[:i], b[:j], n))
        todo.append((a[i + n :], b[j + n :], n))
    return total


def matching(a: str, b: str) -> int:
    """Letters in common: of the longest match (the first in a, then in b, of several) and, in the same way, left and right of it."""
    total, todo = 0, [(None, 0, len(a), 0, len(b))]
    while todo:
        found, alo, ahi, blo, bhi = todo.pop()
        if found is None:
            found = _segments(a[alo:ahi], b[blo:bhi])
            if found is None:
                i, j, n = SequenceMatcher(None, a[alo:ahi], b[blo:bhi], autojunk=False).find_longest_match()
                total += n
                todo += [(None, alo, alo + i, blo, blo + j), (None, alo + i + n, ahi, blo + j + n, bhi)]
                continue
            found = [(alo + i, blo + j, n) for i, j, n in found]
        if not found:
            total += _short(a[alo:ahi], b[blo:bhi], SEED - 1)
            continue
        i, j, n = min(found, key=lambda s: (-s[2], s[0], s[1]))
        total += n
        todo += [(_within(found, *w), *w) for w in ((alo, i, blo, j), (i + n, ahi, j + n, bhi))]
    return total


def ratio(a: str, b: str) -> float:
    both = len(a) + len(b)
    return 2.0 * matching(a, b) / both if both else 1.0
