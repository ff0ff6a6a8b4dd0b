"""PDF objects: tokens, cross-reference tables and streams, object streams, filters.

Names are ``Name``, strings ``bytes``, dictionaries and arrays Python's own, streams ``Stream``, references ``Ref``.
A file with a broken cross-reference table is scanned for objects instead.
"""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass

from .crypt import Decryptor


class Name(str):
    __slots__ = ()


@dataclass(frozen=True)
class Ref:
    num: int
    gen: int


class Keyword(bytes):
    __slots__ = ()


class Stream:
    __slots__ = ("dict", "raw", "key")

    def __init__(self, d: dict, raw: bytes, key: tuple | None):
        self.dict, self.raw, self.key = d, raw, key


class PdfError(Exception):
    pass


_SPACE = b"\0\t\n\f\r "
_DELIM = b"()<>[]{}/%"
_REGULAR = re.compile(rb"[^\0\t\n\f\r ()<>\[\]{}/%]+")
_SKIP = re.compile(rb"(?:[\0\t\n\f\r ]+|%[^\r\n]*)*")
_PLAIN = re.compile(rb"\(([^()\\]*)\)")
_NUMBER = re.compile(rb"[+-]?(?:\d+\.?\d*|\.\d+)$")
_REF = re.compile(rb"(\d+)[\0\t\n\f\r ]+(\d+)[\0\t\n\f\r ]+R(?![^\0\t\n\f\r ()<>\[\]{}/%])")
_ESCAPES = {110: 10, 114: 13, 116: 9, 98: 8, 102: 12, 40: 40, 41: 41, 92: 92}
END = object()


class Lexer:
    def __init__(self, data: bytes, pos: int = 0, refs: bool = True):
        self.data, self.pos, self.refs = data, pos, refs

    def skip(self) -> None:
        self.pos = _SKIP.match(self.data, self.pos).end()

    def next(self, depth: int = 0):
        """The next object or keyword; END at the end."""
        data, at = self.data, self.pos
        if at < len(data) and (data[at] <= 32 or data[at] == 37):
            self.skip()
            at = self.pos
        if at >= len(data):
            return END
        if depth > 200:
            raise PdfError("nested too deep")
        c = data[at]
        if c == 47:  # /
            m = _REGULAR.match(data, at + 1)
            self.pos = m.end() if m else at + 1
            raw = m.group() if m else b""
            if b"#" in raw:
                raw = re.sub(rb"#([0-9A-Fa-f]{2})", lambda x: bytes([int(x[1], 16)]), raw)
            return Name(raw.decode("utf-8", "replace"))
        if c == 40:
            m = _PLAIN.match(data, at)
            if m:
                self.pos = m.end()
                return m[1]
            return self._string()
        if c == 60:
            if data[at + 1 : at + 2] == b"<":
                self.pos += 2
                return self._dict(depth)
            end = data.find(b">", at)
            end = len(data) if end < 0 else end
            self.pos = end + 1
            digits = re.sub(rb"[^0-9A-Fa-f]", b"", data[at + 1 : end])
            return bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode())
        if c == 91:
            self.pos += 1
            out = []
            while True:
                x = self.next(depth + 1)
                if x is END or x == b"]" and isinstance(x, Keyword):
                    return out
                if not (isinstance(x, Keyword) and x in (b">>", b"endobj")):
                    out.append(x)
        if c in b"]{}":
            self.pos += 1
            return Keyword(data[at : at + 1])
        if c == 62:
            self.pos += 2 if data[at + 1 : at + 2] == b">" else 1
            return Keyword(data[at : self.pos])
        if c == 41:
            self.pos += 1
            return self.next(depth)
        m = _REGULAR.match(data, at)
        word = m.group()
        if self.refs and 48 <= c <= 57:
            r = _REF.match(data, at)
            if r:
                self.pos = r.end()
                return Ref(int(r[1]), int(r[2]))
        self.pos = m.end()
        if word.isdigit():
            return int(word)
        if _NUMBER.match(word):
            return float(word) if b"." in word else int(word)
        if word == b"true":
            return True
        if word == b"false":
            return False
        if word == b"null":
            return None
        if c in b"+-.0123456789":
            n = re.match(rb"[+-]*(\d*\.?\d*)", word)
            if n and n[1] not in (b"", b"."):
                v = float(n[1])
                return -v if word.startswith(b"-") else v
        return Keyword(word)

    def _dict(self, depth: int) -> dict:
        out = {}
        while True:
            k = self.next(depth + 1)
            if k is END or isinstance(k, Keyword) and k in (b">>", b"endobj", b"stream"):
                return out
            if not isinstance(k, Name):
                continue
            v = self.next(depth + 1)
            if v is END or isinstance(v, Keyword) and v == b">>":
                return out
            if v is not None:
                out[k] = v

    def _string(self) -> bytes:
        data, at, level, out = self.data, self.pos + 1, 1, bytearray()
        n = len(data)
        while at < n:
            c = data[at]
            if c == 92:
                at += 1
                if at >= n:
                    break
                c = data[at]
                if c in _ESCAPES:
                    out.append(_ESCAPES[c])
                elif 48 <= c <= 55:
                    m = re.match(rb"[0-7]{1,3}", data[at : at + 3])
                    out.append(int(m[0], 8) & 255)
                    at += len(m[0]) - 1
                elif c == 13:
                    at += data[at + 1 : at + 2] == b"\n"
                elif c != 10:
                    out.append(c)
            elif c == 40:
                level += 1
                out.append(c)
            elif c == 41:
                level -= 1
                if not level:
                    at += 1
                    break
                out.append(c)
            else:
                out.append(c)
            at += 1
        self.pos = at
        return bytes(out)


def text(v) -> str | None:
    """A text string; None for what is none."""
    if isinstance(v, Name):
        return str(v)
    if not isinstance(v, bytes):
        return None
    if v.startswith(b"\xfe\xff"):
        return v[2:].decode("utf-16-be", "replace")
    if v.startswith(b"\xff\xfe"):
        return v[2:].decode("utf-16-le", "replace")
    if v.startswith(b"\xef\xbb\xbf"):
        return v[3:].decode("utf-8", "replace")
    return "".join(_DOC_ENCODING.get(b, chr(b)) for b in v)


_DOC_ENCODING = dict(zip(range(0x18, 0x20), "˘ˇˆ˙˝˛˚˜")) | dict(zip(range(0x80, 0x9F), "•†‡…—–ƒ⁄‹›−‰„“”‘’‚™ﬁﬂŁŒŠŸŽıłœšž")) | {0xA0: "€"}


def _predict(data: bytes, parms: dict) -> bytes:
    kind = parms.get("Predictor", 1)
    if kind < 2:
        return data
    colors, bits, columns = parms.get("Colors", 1), parms.get("BitsPerComponent", 8), parms.get("Columns", 1)
    step, row = max(1, colors * bits // 8), (colors * bits * columns + 7) // 8
    if kind == 2:
        if bits != 8:
            return data
        out = bytearray(data)
        for r in range(0, len(out), row):
            for i in range(r + step, min(r + row, len(out))):
                out[i] = (out[i] + out[i - step]) & 255
        return bytes(out)
    out, before = bytearray(), bytearray(row)
    for r in range(0, len(data), row + 1):
        tag, line = data[r], bytearray(data[r + 1 : r + 1 + row])
        line += bytes(row - len(line))
        for i in range(row):
            a, b, c = (line[i - step] if i >= step else 0), before[i], (before[i - step] if i >= step else 0)
            if tag == 1:
                line[i] = (line[i] + a) & 255
            elif tag == 2:
                line[i] = (line[i] + b) & 255
            elif tag == 3:
                line[i] = (line[i] + (a + b) // 2) & 255
            elif tag == 4:
                p = a + b - c
                pa, pb, pc = abs(p - a), abs(p - b), abs(p - c)
                line[i] = (line[i] + (a if pa <= pb and pa <= pc else b if pb <= pc else c)) & 255
        out += line
        before = line
    return bytes(out)


def _inflate(data: bytes) -> bytes:
    try:
        return zlib.decompress(data)
    except zlib.error:
        d, out = zlib.decompressobj(), b""
        try:  # what can be had of a damaged stream
            for i in range(0, len(data), 64):
                out += d.decompress(data[i : i + 64])
        except zlib.error:
            pass
        return out


def _lzw(data: bytes, early: int) -> bytes:
    out, table, width, held, bits, prev = bytearray(), [bytes([i]) for i in range(256)] + [b"", b""], 9, 0, 0, b""
    for byte in data:
        held, bits = (held << 8) | byte, bits + 8
        if bits < width:
            continue
        code = (held >> (bits - width)) & ((1 << width) - 1)
        bits -= width
        held &= (1 << bits) - 1
        if code == 256:
            table, width, prev = table[:258], 9, b""
            continue
        if code == 257:
            break
        entry = table[code] if code < len(table) else prev + prev[:1]
        out += entry
        if prev:
            table.append(prev + entry[:1])
        prev = entry
        n = len(table) + early
        width = 12 if n >= 2048 else 11 if n >= 1024 else 10 if n >= 512 else 9
    return bytes(out)


def _ascii85(data: bytes) -> bytes:
    data = re.sub(rb"\s+", b"", data.split(b"~>")[0])
    out = bytearray()
    group = []
    for c in data:
        if c == 122 and not group:
            out += bytes(4)
        elif 33 <= c <= 117:
            group.append(c - 33)
            if len(group) == 5:
                v = 0
                for g in group:
                    v = v * 85 + g
                out += (v & 0xFFFFFFFF).to_bytes(4, "big")
                group = []
    if len(group) > 1:
        n = len(group)
        v = 0
        for g in group + [84] * (5 - n):
            v = v * 85 + g
        out += (v & 0xFFFFFFFF).to_bytes(4, "big")[: n - 1]
    return bytes(out)


def _run_length(data: bytes) -> bytes:
    out, at = bytearray(), 0
    while at < len(data) and data[at] != 128:
        n = data[at]
        if n < 128:
            out += data[at + 1 : at + 2 + n]
            at += n + 2
        else:
            out += data[at + 1 : at + 2] * (257 - n)
            at += 2
    return bytes(out)


class File:
    """Objects of a file by number."""

    def __init__(self, data: bytes):
        if b"%PDF-" not in data[:1024]:
            raise PdfError("no PDF header")
        self.data, self.cache, self.crypt = data, {}, None
        self.table: dict[int, tuple] = {}
        self.trailer: dict = {}
        self._streams: dict[int, dict[int, object]] = {}
        try:
            self._read_table()
            if not isinstance(self.get(self.trailer.get("Root")), dict):
                raise PdfError("no catalog")
        except Exception:  # noqa: BLE001 - a damaged table is mended by a scan
            self._scan()
        if "Encrypt" in self.trailer:
            enc, self.cache, self._streams = self.get(self.trailer["Encrypt"]), {}, {}
            self.encrypt_ref = self.trailer["Encrypt"] if isinstance(self.trailer["Encrypt"], Ref) else None
            ids = self.get(self.trailer.get("ID")) or [b""]
            self.encrypt = {k: self.get(v) for k, v in enc.items()}
            self.crypt = Decryptor(self.encrypt, ids[0] if ids and isinstance(ids[0], bytes) else b"", self)
            self.cache, self._streams = {}, {}
        else:
            self.encrypt, self.encrypt_ref = None, None
        self.root = self.get(self.trailer.get("Root"))
        if not isinstance(self.root, dict):
            raise PdfError("no catalog")

    # -- cross-reference

    def _read_table(self) -> None:
        at = self.data.rfind(b"startxref")
        if at < 0:
            raise PdfError("no startxref")
        pos, seen = Lexer(self.data, at + 9).next(), set()
        todo = [pos]
        while todo:
            pos = todo.pop(0)
            if not isinstance(pos, int) or pos in seen:
                continue
            seen.add(pos)
            lex = Lexer(self.data, pos)
            first = lex.next()
            if first == b"xref" and isinstance(first, Keyword):
                trailer = self._plain_table(lex)
                if isinstance(trailer.get("XRefStm"), int):
                    todo.insert(0, trailer["XRefStm"])
            else:
                trailer = self._stream_table(pos)
            for k, v in trailer.items():
                self.trailer.setdefault(k, v)
            if "Prev" in trailer:
                todo.append(trailer["Prev"])
        if "Root" not in self.trailer:
            raise PdfError("no trailer")

    def _plain_table(self, lex: Lexer) -> dict:
        while True:
            first = lex.next()
            if isinstance(first, Keyword):
                if first != b"trailer":
                    raise PdfError("broken table")
                d = lex.next()
                return d if isinstance(d, dict) else {}
            count = lex.next()
            for i in range(count):
                offset, gen, kind = lex.next(), lex.next(), lex.next()
                if kind == b"n":
                    self.table.setdefault(first + i, ("at", offset, gen))
                else:
                    self.table.setdefault(first + i, ("free", 0, 0))

    def _stream_table(self, pos: int) -> dict:
        s = self._object_at(pos, None)[1]
        if not isinstance(s, Stream):
            raise PdfError("no table at its place")
        d, data, w = s.dict, self.decode(s), s.dict["W"]
        index, at = d.get("Index") or [0, d["Size"]], 0
        take = lambda n: int.from_bytes(data[at : at + n], "big")
        for first, count in zip(index[::2], index[1::2]):
            for i in range(count):
                kind = take(w[0]) if w[0] else 1
                at += w[0]
                a = take(w[1])
                at += w[1]
                b = take(w[2])
                at += w[2]
                self.table.setdefault(first + i, ("at", a, b) if kind == 1 else ("in", a, b) if kind == 2 else ("free", 0, 0))
        return d

    def _scan(self) -> None:
        self.table, self.cache, self._streams = {}, {}, {}
        for m in re.finditer(rb"(?<![0-9])(\d{1,10})[ \t\r\n]+(\d{1,5})[ \t\r\n]+obj\b", self.data):
            self.table[int(m[1])] = ("at", m.start(), int(m[2]))
        trailer = {}
        for m in re.finditer(rb"trailer", self.data):
            d = Lexer(self.data, m.end()).next()
            if isinstance(d, dict):
                trailer |= d
        for num in list(self.table):
            try:
                o = self._fetch(num)
            except Exception:  # noqa: BLE001
                continue
            if isinstance(o, Stream) and o.dict.get("Type") == "ObjStm":
                try:
                    for i, inner in enumerate(self._members(num)):
                        self.table.setdefault(inner, ("in", num, i))
                except Exception:  # noqa: BLE001
                    continue
            if isinstance(o, Stream) and o.dict.get("Type") == "XRef":
                trailer |= {k: v for k, v in o.dict.items() if k in ("Root", "Info", "ID", "Encrypt")}
            if isinstance(o, dict) and o.get("Type") == "Catalog":
                trailer.setdefault("Root", Ref(num, 0))
        self.trailer = trailer
        self.cache = {}

    # -- objects

    def _object_at(self, pos: int, num: int | None):
        lex = Lexer(self.data, pos)
        n, g, kw = lex.next(), lex.next(), lex.next()
        if kw != b"obj" or not isinstance(n, int) or num is not None and n != num:
            raise PdfError("no object at its place")
        value = lex.next()
        if isinstance(value, dict):
            lex.skip()
            if self.data[lex.pos : lex.pos + 6] == b"stream":
                at = lex.pos + 6
                at += 2 if self.data[at : at + 2] == b"\r\n" else 1 if self.data[at : at + 1] in (b"\n", b"\r") else 0
                length = value.get("Length")
                if isinstance(length, Ref):
                    length = self.get(length) if length.num != n else None
                end = at + length if isinstance(length, int) and length >= 0 else -1
                if end < 0 or not re.match(rb"\s*endstream", self.data[end : end + 20]):
                    end = self.data.find(b"endstream", at)
                    end = len(self.data) if end < 0 else end
                    while end > at and self.data[end - 1] in b"\r\n":
                        end -= 1
                        if self.data[end - 1 : end + 1] != b"\r\n":
                            break
                value = Stream(value, self.data[at:end], (n, g))
        return (n, g), value

    def _members(self, num: int) -> dict[int, object]:
        if num not in self._streams:
            s = self._fetch(num)
            data = self.decode(s)
            lex = Lexer(data)
            heads = [(lex.next(), lex.next()) for _ in range(self.get(s.dict["N"]))]
            first = self.get(s.dict["First"])
            self._streams[num] = {n: Lexer(data, first + off).next() for n, off in heads}
        return self._streams[num]

    def _fetch(self, num: int):
        if num in self.cache:
            return self.cache[num]
        entry = self.table.get(num)
        value = None
        if entry and entry[0] == "at":
            key, value = self._object_at(entry[1], num)
            if self.crypt and not (self.encrypt_ref and num == self.encrypt_ref.num):
                value = self._decrypt(value, key)
        elif entry and entry[0] == "in":
            value = self._members(entry[1]).get(num)
        self.cache[num] = value
        return value

    def _decrypt(self, v, key):
        if isinstance(v, bytes):
            return self.crypt.string(v, key)
        if isinstance(v, list):
            return [self._decrypt(x, key) for x in v]
        if isinstance(v, dict):
            return {k: self._decrypt(x, key) for k, x in v.items()}
        if isinstance(v, Stream) and v.dict.get("Type") != "XRef":
            return Stream(self._decrypt(v.dict, key), self.crypt.stream(v.raw, key, v.dict), v.key)
        return v

    def get(self, v):
        """What a value is, references followed; null where they lead nowhere."""
        for _ in range(32):
            if not isinstance(v, Ref):
                return v
            try:
                v = self._fetch(v.num)
            except (PdfError, RecursionError, ValueError, TypeError, KeyError, IndexError):
                return None
        return None

    def dict(self, v) -> dict:
        v = self.get(v)
        return v if isinstance(v, dict) else v.dict if isinstance(v, Stream) else {}

    def array(self, v) -> list:
        v = self.get(v)
        return v if isinstance(v, list) else []

    def name(self, v) -> str | None:
        v = self.get(v)
        return str(v) if isinstance(v, Name) else None

    def number(self, v, default=0.0) -> float:
        v = self.get(v)
        return v if isinstance(v, (int, float)) and not isinstance(v, bool) else default

    def decode(self, s: Stream) -> bytes:
        filters, parms = self.get(s.dict.get("Filter")), self.get(s.dict.get("DecodeParms") or s.dict.get("DP"))
        filters = filters if isinstance(filters, list) else [] if filters is None else [filters]
        parms = parms if isinstance(parms, list) else [parms]
        data = s.raw
        for i, f in enumerate(filters):
            p = {k: self.get(v) for k, v in self.dict(parms[i] if i < len(parms) else None).items()}
            f = self.get(f)
            if f in ("FlateDecode", "Fl"):
                data = _predict(_inflate(data), p)
            elif f in ("LZWDecode", "LZW"):
                data = _predict(_lzw(data, p.get("EarlyChange", 1)), p)
            elif f in ("ASCII85Decode", "A85"):
                data = _ascii85(data)
            elif f in ("ASCIIHexDecode", "AHx"):
                digits = re.sub(rb"[^0-9A-Fa-f]", b"", data.split(b">")[0])
                data = bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode())
            elif f in ("RunLengthDecode", "RL"):
                data = _run_length(data)
            elif f != "Crypt":
                break  # image filters: their data is of no use here
        return data
