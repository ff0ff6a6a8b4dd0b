"""Normalised words and their windows, shared by the operators that compare texts by words."""

from __future__ import annotations

import os

import numpy as np

#: ASCII letters and digits and all bytes of other characters stay; other ASCII characters part words.
_TABLE = bytes(b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))


def words(text: str) -> list[bytes]:
    """Lower-cased words without ASCII punctuation, in order, as UTF-8."""
    return text.lower().encode("utf-8", "surrogatepass").translate(_TABLE).split()


def stable_hashes(lists: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words, and the number of words of each list. The same in every worker: Spark fixes the hash seed."""
    if not os.environ.get("PYTHONHASHSEED", "").isdigit():
        raise RuntimeError("PYTHONHASHSEED must be set for workers")
    sizes = np.fromiter(map(len, lists), np.int64, len(lists))
    h = np.fromiter((hash(w) for ws in lists for w in ws), np.int64, int(sizes.sum())).view(np.uint64)
    return (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9), sizes


def shingle_sets(texts: list[str], width: int = 5) -> list[np.ndarray]:
    """Sorted distinct 64-bit hashes of each text's windows of ``width`` words; a shorter text has one window, a text without words none."""
    lists = [words(t) for t in texts]
    h, sizes = stable_hashes(lists)
    out, at = [], 0
    n = max(len(h) - width + 1, 0)
    win = np.zeros(n, np.uint64)
    for k in range(width):
        win = win * np.uint64(0x9E3779B97F4A7C15) + h[k : k + n]
    win = (win ^ (win >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    win ^= win >> np.uint64(32)
    for size in sizes.tolist():
        if size >= width:
            out.append(np.unique(win[at : at + size - width + 1]))
        elif size:
            one = np.uint64(size)
            with np.errstate(over="ignore"):
                for x in h[at : at + size]:
                    one = one * np.uint64(0x9E3779B97F4A7C15) + x
            out.append(np.array([one], np.uint64))
        else:
            out.append(np.zeros(0, np.uint64))
        at += size
    return out


def slices(column, block: int):
    """(from, to) of runs of rows of about ``block`` bytes of text; at least a row each."""
    n, at = len(column), 0
    while at < n:
        end, size = at, 0
        while end < n and (size < block or end == at):
            size += 1 + (column[end].as_buffer().size if column[end].is_valid else 0)
            end += 1
        yield at, end
        at = end
