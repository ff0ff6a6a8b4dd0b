"""Deep-shallow sorting of text positions, and the anchors that bring equal strings together.

``equal_classes`` orders positions by the ``LENGTH`` bytes from there on. Positions come in groups (by
anchor); a group is sorted by multikey quicksort over 8-byte characters down to a shallow depth, and
groups still alike there go through blind tries: the members' common bytes are skipped by comparing
each with one leaf, the trie branches at the first character where any differs, and so on until each
leaf's members are equal over the whole length. All groups of a block take each step together, as arrays.
"""

from __future__ import annotations

import numpy as np

LENGTH = 100
GRAM = 32
SHALLOW = 2  # 8-byte characters
_OFFSETS = [*range(0, LENGTH - 8, 8), LENGTH - 8]
_C = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)]


def characters(data: np.ndarray) -> np.ndarray:
    """The 8 bytes from each position as a number that sorts as they do; zeros after the end."""
    padded = np.zeros(len(data) + 8, np.uint8)
    padded[: len(data)] = data
    return np.ndarray((len(data),), ">u8", padded, strides=(1,)).astype(np.uint64)


def _slide(x: np.ndarray, width: int, take) -> np.ndarray:
    """take over each run of ``width`` elements."""
    have, now = 1, x
    while have * 2 <= width:
        now = take(now[:-have], now[have:])
        have *= 2
    if have < width:
        now = take(now[: len(now) - (width - have)], now[width - have :])
    return now


def minima(chars: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each gram, and for each window of LENGTH bytes the least hash of its grams. Equal windows have equal minima."""
    n = len(chars) - GRAM + 1
    if n < LENGTH - GRAM + 1:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    h = chars[:n] * _C[0]
    for k in range(1, GRAM // 8):
        h += chars[8 * k : 8 * k + n] * _C[k]
        h ^= h >> np.uint64(31)
        h *= _C[(k + 1) % 4]
    h ^= h >> np.uint64(29)
    return h, _slide(h, LENGTH - GRAM + 1, np.minimum)


def spread(h: np.ndarray) -> np.ndarray:
    """Least hashes are small; this makes them even again."""
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


def anchors(h: np.ndarray, low: np.ndarray, valid: np.ndarray) -> np.ndarray:
    """Hash of each place whose gram is the least of some valid window that covers it."""
    width = LENGTH - GRAM + 1
    padded = np.zeros(len(low) + 2 * (width - 1), np.uint64)
    padded[width - 1 : width - 1 + len(low)] = np.where(valid, low, np.uint64(0))
    top = _slide(padded, width, np.maximum)
    return h[(top == h) & (top > 0)]


def runs(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(begin, end) of each run of true elements."""
    edge = np.flatnonzero(np.diff(np.concatenate([[0], flags.view(np.int8), [0]])))
    return edge[::2], edge[1::2]


def _split(order, group, value):
    """Sort members by value inside their groups; gives the new order and group numbers, singles dropped."""
    by = np.lexsort((value, group))
    order, group, value = order[by], group[by], value[by]
    new = np.empty(len(order), bool)
    new[:1] = True
    new[1:] = (group[1:] != group[:-1]) | (value[1:] != value[:-1])
    return _shared(order, np.cumsum(new) - 1)


def _shared(order, group):
    """Without groups of one member; groups are numbered anew. Groups must be contiguous."""
    size = np.bincount(group)
    keep = size[group] > 1
    order, group = order[keep], group[keep]
    if len(group):
        group = np.cumsum(np.concatenate([[0], group[1:] != group[:-1]]))
    return order, group


def equal_classes(chars: np.ndarray, pos: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index into pos, class) of the members of classes of two or more equal windows; classes contiguous."""
    order = np.argsort(key, kind="stable")
    group = np.cumsum(np.concatenate([[0], key[order][1:] != key[order][:-1]])) if len(key) else np.zeros(0, np.int64)
    order, group = _shared(order, group)
    done_o, done_g, n_done = [], [], 0
    # Shallow: multikey quicksort, a character at a time.
    for off in _OFFSETS[:SHALLOW]:
        if not len(order):
            break
        order, group = _split(order, group, chars[pos[order] + off])
    # Deep: blind tries.
    first = SHALLOW
    while len(order):
        leader = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
        of = leader[group]
        at = pos[order]
        common = np.full(len(order), len(_OFFSETS), np.int8)
        rest = np.arange(len(order))
        for d in range(first, len(_OFFSETS)):
            differs = chars[at[rest] + _OFFSETS[d]] != chars[at[of[rest]] + _OFFSETS[d]]
            common[rest[differs]] = d
            rest = rest[~differs]
        branch = np.minimum.reduceat(common, leader)
        whole = (branch == len(_OFFSETS))[group]
        if whole.any():
            o, g = order[whole], group[whole]
            g = np.cumsum(np.concatenate([[0], g[1:] != g[:-1]])) + n_done
            done_o.append(o)
            done_g.append(g)
            n_done = int(g[-1]) + 1
        order, group, branch = order[~whole], group[~whole], branch[group[~whole]]
        if len(order):
            offsets = np.array(_OFFSETS)[branch]
            order, group = _split(order, group, chars[pos[order] + offsets])
    if not done_o:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(done_o), np.concatenate(done_g)


def later_members(order: np.ndarray, group: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """Members that aren't the one of least rank in their class."""
    if not len(order):
        return order
    starts = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
    least = np.minimum.reduceat(rank[order], starts)
    return order[rank[order] > least[group]]
