"""Token counts of whole texts under a unigram vocabulary, by dynamic programming shared in a trie.

A pre-token is the word mark followed by a word (a run without ASCII white space). Its best
segmentation's score up to a character depends on the characters before it alone, so the distinct
pre-tokens of a block go into a trie (walked here in sorted order, the path from the root kept as a
stack), the forward score of a node is computed once for all pre-tokens below it, and the count of
tokens is stored where a pre-token ends. Texts then add up stored counts.

Piece scores follow the vocabulary's rank by Zipf's law, ``-log(rank + 2)``, as a merge vocabulary has no
probabilities of its own and tokenizers aren't trained here. A character without a piece costs the
least score less ten, and counts as many tokens as it has bytes.
"""

from __future__ import annotations

import math

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import ready

MARK = "▁"
CACHE = 1_000_000
_BLOCK = 8_000_000
_MODELS: dict[str, "TrieCounter"] = {}


def vocabulary(path: str) -> dict[str, float]:
    """Scores of the pieces of a sentencepiece file; control and byte pieces aside."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    plain = [i for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
    return {sp.id_to_piece(i): -math.log(rank + 2) for rank, i in enumerate(plain)}


class TrieCounter:
    def __init__(self, scores: dict[str, float]):
        self.scores = scores
        self.longest = max(map(len, scores), default=1)
        self.unknown = min(scores.values(), default=0.0) - 10
        self.ends: dict[str, tuple[int, ...]] = {}
        by_end: dict[str, set[int]] = {}
        for p in scores:
            by_end.setdefault(p[-1], set()).add(len(p))
        self.ends = {c: tuple(sorted(n)) for c, n in by_end.items()}
        self.counts: dict[bytes, int] = {}

    def count_distinct(self, words: list[bytes]) -> dict[bytes, int]:
        """Tokens of each distinct word; nodes shared by words are scored once."""
        get, ends, unknown = self.scores.get, self.ends, self.unknown
        out: dict[bytes, int] = {}
        path, best, tokens = "", [0.0], [0]  # scores and token counts at each depth of the path
        for raw in sorted(words):
            word = MARK + raw.decode("utf-8", "replace")
            at, top = 0, min(len(path), len(word))
            if word[:top] == path[:top]:
                at = top
            else:
                low, high = 0, top  # longest common prefix by bisection
                while low < high:
                    mid = (low + high + 1) // 2
                    if word[:mid] == path[:mid]:
                        low = mid
                    else:
                        high = mid - 1
                at = low
            del best[at + 1 :], tokens[at + 1 :]
            for i in range(at + 1, len(word) + 1):
                c = word[i - 1]
                top_score, top_count = None, 0
                for n in ends.get(c, ()):
                    if n > i:
                        break
                    s = get(word[i - n : i])
                    if s is not None:
                        s += best[i - n]
                        if top_score is None or s > top_score:
                            top_score, top_count = s, tokens[i - n] + 1
                if word[i - 1 : i] not in self.scores:
                    s = best[i - 1] + unknown
                    if top_score is None or s > top_score:
                        top_score, top_count = s, tokens[i - 1] + len(c.encode("utf-8", "replace"))
                best.append(top_score)
                tokens.append(top_count)
            path = word
            out[raw] = tokens[-1]
        return out

    def count(self, texts: list[str]) -> list[tuple[int, int]]:
        """(tokens, words) of each text."""
        cut = [t.encode("utf-8", "surrogatepass").split() for t in texts]
        got = [list(map(self.counts.get, c)) for c in cut]
        missing = {x for c, g in zip(cut, got) if None in g for x, y in zip(c, g) if y is None}
        if missing:
            new = self.count_distinct(list(missing))
            for c, g in zip(cut, got):
                if None in g:
                    g[:] = [new[x] if y is None else y for x, y in zip(c, g)]
            if len(self.counts) + len(new) > CACHE:
                self.counts.clear()
            if len(new) <= CACHE:
                self.counts.update(new)
        return [(sum(g), len(g)) for g in got]


def counter(path: str) -> TrieCounter:
    if path not in _MODELS:
        _MODELS[path] = TrieCounter(vocabulary(path))
    return _MODELS[path]


def count_tokens(spark: SparkSession, docs: DataFrame, model_path: str) -> DataFrame:
    """doc_id, n_tokens, n_words of every row.

    A null or empty text has none of either. Repeated rows count each for itself; a null doc_id stays null; an
    empty table gives an empty result. Other columns are ignored. A word of any length is one pre-token.
    """
    ready(spark)

    def apply(batches):
        from lectern.llm.unigram_count import counter

        model = counter(model_path)
        for batch in batches:
            texts, at = batch.column(1), 0
            while at < batch.num_rows:
                end, size = at, 0
                while end < batch.num_rows and size < _BLOCK:
                    size += 1 + (texts[end].as_buffer().size if texts[end].is_valid else 0)
                    end += 1
                got = model.count([x or "" for x in texts[at:end].to_pylist()])
                yield pa.RecordBatch.from_arrays([batch.column(0)[at:end], pa.array([g[0] for g in got], pa.int64()), pa.array([g[1] for g in got], pa.int64())], names=["doc_id", "n_tokens", "n_words"])
                at = end

    return docs.select("doc_id", "text").mapInArrow(apply, "doc_id bigint, n_tokens bigint, n_words bigint")
