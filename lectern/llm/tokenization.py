"""Exact, cached use of the ``tokenizers`` library.

A text is cut at places that are always borders between pre-tokens, so that the ids of the
text are the ids of its parts one after another. Parts repeat; each distinct one is encoded
once per worker; texts of kind ``byte`` look it up once for all of them. A cache has two generations of at most ``CACHE`` entries: when the
younger is full it becomes the older, whose entries move up as they are met again, so that frequent parts
stay and others go.
"""

from __future__ import annotations

import codecs
import re
import struct

import pyarrow as pa
import pyarrow.compute as pc

CACHE = 400_000
#: Characters of texts (or one longer text) whose parts are made distinct before they are looked up.
AT_ONCE = 4_000_000
_ENCODERS: dict[tuple, "CachedEncoder"] = {}


def _byte_letters() -> dict[int, int]:
    """The byte-level alphabet: each byte's printable stand-in."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {b: b for b in plain} | {b: 256 + i for i, b in enumerate(rest)}


_LETTERS = _byte_letters()
_BYTES = {v: k for k, v in _LETTERS.items()}
_TABLE = "".join(chr(_LETTERS[b]) for b in range(256))


def _map(piece: str) -> str:
    return codecs.charmap_decode(piece.encode("utf-8", "replace"), "strict", _TABLE)[0]


def _unmap(piece: str) -> str:
    return piece.translate(_BYTES).encode("latin-1").decode("utf-8", "replace")


def _pack(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


#: Below this, characters are composed and lower-case alike in Python and in the library (tests hold them against each other).
_LATIN_END = "\u0250"
_LOOSE = re.compile(r" (?:\s|\Z)")
_UNSAFE = re.compile(r"\s (?:\s|\Z)")
_BORDER = re.compile(r"(?= \S)")
#: A line feed alone between other characters: a pre-token of its own.
_LINE = re.compile(r"\n(?<=\S\n)(?=\S)")
_LETTER = "A-Za-z\u00aa\u00b5\u00ba\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f"
#: A comma or full stop alone between a letter and white space: a pre-token of its own.
_COMMA = re.compile(rf",(?=[ \n])(?<=[{_LETTER}],)")
_STOP = re.compile(rf"\.(?=[ \n]|\Z)(?<=[{_LETTER}]\.)")
#: Letters and what stands behind them, without an apostrophe, which may start a pre-token of letters.
_WORD = re.compile(rf"(\n?)([{_LETTER}]+)([!-&(-/:-@\[-`{{-~]*)").fullmatch


def _apart(text: str) -> str:
    """Text where white space follows no space, with a space at each border: white space behind one shows that the border has no space itself.

    A line feed stays as the start of its part, a tab is there for a border alone.
    """
    return _LINE.sub(" \n", _STOP.sub(" \t.", _COMMA.sub(" \t,", text)))


def encoder(path: str, kind: str, added: bool = False, cache: int | None = None) -> "CachedEncoder":
    """The worker's encoder for a vocabulary file; ``kind`` is ``byte`` or ``word``. ``cache``: entries of a generation, where not ``CACHE``."""
    key = (path, kind, added, cache)
    if key not in _ENCODERS:
        _ENCODERS[key] = CachedEncoder(path, kind, added, cache)
    return _ENCODERS[key]


class CachedEncoder:
    """Ids of whole texts as little-endian unsigned 32-bit bytes.

    ``word``: white space is no token, and no pre-token crosses it, so ASCII white space is a border.
    ``byte``: a space that starts a pre-token (one before a non-space character, or one after a
    non-space character) is a border; where it isn't sure, only the first kind is used. Where white space follows no
    space, line feeds, commas and full stops that stand alone have borders too (``_apart``).

    ``added``: the vocabulary's added tokens are found in texts, as the library does by default; without it
    they are text like any other (the library's ``encode_special_tokens``).
    """

    def __init__(self, path: str, kind: str, added: bool = False, cache: int | None = None):
        import regex
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.tok.encode_special_tokens = not added
        tokens = self.tok.get_added_tokens_decoder() if added else {}
        #: Tokens that take white space, stand alone or are met in normalised text are left to the library.
        self.plain = not any(t.lstrip or t.rstrip or t.single_word or t.normalized for t in tokens.values())
        self.added = {t.content: _pack([k]) for k, t in tokens.items()}
        self.cut_added = re.compile("(%s)" % "|".join(map(re.escape, sorted(self.added, key=len, reverse=True)))) if tokens else None
        self.model = self.tok.model
        self.kind = kind
        self.cache = cache or CACHE
        self.parts, self.parts_old, self.small, self.small_old = {}, {}, {}, {}
        tails = r"'s|'t|'re|'ve|'m|'ll|'d"
        byte = tails + r"| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
        self.find = regex.compile(byte if kind == "byte" else tails + r"|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+").findall

    def split(self, text: str) -> tuple[list, bytes]:
        """The parts, and the ids of what comes before them. Parts of kind ``byte`` are without the space they start with, if no white space follows it."""
        if self.kind == "word":
            return text.encode("utf-8", "surrogatepass").split(), b""
        if _UNSAFE.search(text):
            first, *rest = _BORDER.split(text)
            if first[:1] == " " and first[1:2].strip():
                first, rest = "", [first, *rest]
            rest = [x[1:] for x in rest]
        else:
            first, *rest = text.split(" ")
            rest = [" " + x if x[:1].isspace() else x for x in rest]
        return rest, self._ids(self.find_in(first)) if first else b""

    def find_in(self, text: str) -> list[str]:
        """Pre-tokens of text of kind ``byte``. Beyond Latin letters the library cuts, whose Unicode tables count."""
        if text.isascii() or max(text) < _LATIN_END:
            return self.find(text)
        return [_unmap(p) for p, _ in self.tok.pre_tokenizer.pre_tokenize_str(text)]

    def _pieces(self, part) -> list[str]:
        if self.kind == "byte":
            if part[:1] == "\t":
                return [part[1:]] if len(part) == 2 else self.find_in(part[1:])
            plain = _WORD(part)
            if plain:
                line, word, tail = plain.groups()
                pieces = [line, word] if line else [" " + word]
                return [*pieces, tail] if tail else pieces
            return self.find_in(part if part[:1].isspace() else " " + part)
        if part.isalpha():  # ASCII letters alone
            return [part.lower().decode()]
        text = part.decode("utf-8", "replace")
        if text.isascii() or max(text) < _LATIN_END:
            return self.find(text.lower())
        text = self.tok.normalizer.normalize_str(text)
        return [_unmap(p) for p, _ in self.tok.pre_tokenizer.pre_tokenize_str(text)]

    def _new(self, piece: str) -> bytes:
        return _pack([t.id for t in self.model.tokenize(_map(piece))])

    def _ids(self, pieces: list[str]) -> bytes:
        out = []
        for p in pieces:
            got = self.small.get(p)
            if got is None:
                got = self.small_old.pop(p, None)
                if got is None:
                    got = self._new(p)
                if len(self.small) >= self.cache // 2:
                    self.small, self.small_old = {}, self.small
                self.small[p] = got
            out.append(got)
        return out[0] if len(out) == 1 else b"".join(out)

    def _learn(self, part) -> bytes:
        got = self.parts_old.pop(part, None)
        if got is None:
            pieces = self._pieces(part)
            got = self._new(pieces[0]) if len(pieces) == 1 and self.kind == "byte" else self._ids(pieces)
        self.parts[part] = got
        return got

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text."""
        if not self.cut_added:
            return self._encode(texts)
        if not self.plain:
            return [_pack(self.tok.encode(t, add_special_tokens=False).ids) for t in texts]
        cut = [self.cut_added.split(t) for t in texts]  # what lies between added tokens, and at odd places these
        between = iter(self._encode([x for c in cut for x in c[::2]]))
        return [b"".join(self.added[x] if k % 2 else next(between) for k, x in enumerate(c)) for c in cut]

    def _encode(self, texts: list[str]) -> list[bytes]:
        if self.kind == "word":
            return [self._alone(t) for t in texts]
        out, held, size = [], [], 0
        for text in texts:
            held.append(text)
            size += len(text)
            if size >= AT_ONCE:
                out += self._together(held)
                held, size = [], 0
        return out + self._together(held)

    def _alone(self, text: str) -> bytes:
        cut, before = self.split(text)
        return before + b"".join(self._look(cut))

    def _together(self, texts: list[str]) -> list[bytes]:
        """Ids of texts of kind ``byte``: a part is looked up once for all texts where white space follows no space."""
        out, rests = [], {}
        for k, text in enumerate(texts):
            if _LOOSE.search(text):
                out.append(self._alone(text))
                continue
            first, space, rest = _apart(text).partition(" ")
            out.append(self._ids(self.find_in(first)) if first else b"")
            if space:
                rests[k] = rest
        cut = pc.split_pattern(pa.array(rests.values(), pa.large_string()), " ")
        parts = cut.flatten().dictionary_encode()
        distinct, ids = parts.dictionary.to_numpy(zero_copy_only=False).tolist(), []
        for at in range(0, len(distinct), 4096):
            ids += self._look(distinct[at : at + 4096])
        spread = list(map(ids.__getitem__, parts.indices.to_numpy().tolist()))
        ends = cut.offsets.to_numpy().tolist()
        for k, start, end in zip(rests, ends, ends[1:]):
            out[k] += b"".join(spread[start:end])
        return out

    def _look(self, cut: list) -> list[bytes]:
        """Ids of each part."""
        if len(self.parts) >= self.cache:
            self.parts, self.parts_old = {}, self.parts
        known = self.parts.get
        got = list(map(known, cut))
        try:
            at = got.index(None)
            while True:
                ids = known(cut[at])
                got[at] = self._learn(cut[at]) if ids is None else ids
                at = got.index(None, at + 1)
        except ValueError:  # none is missing any more
            return got
