"""Fonts of a page: codes, their text and width, and whether the font has a glyph for them (None: can't tell)."""

from __future__ import annotations

import re
import struct
import unicodedata

from .objects import File, Keyword, Lexer, Name, Ref, Stream, END

_MARKS = {"grave": "GRAVE", "acute": "ACUTE", "circumflex": "CIRCUMFLEX", "tilde": "TILDE", "dieresis": "DIAERESIS", "ring": "RING ABOVE", "cedilla": "CEDILLA", "caron": "CARON", "macron": "MACRON", "breve": "BREVE", "dotaccent": "DOT ABOVE", "ogonek": "OGONEK", "hungarumlaut": "DOUBLE ACUTE"}
_NAMES = dict(zip("zero one two three four five six seven eight nine".split(), "0123456789")) | dict(
    zip(
        "space exclam quotedbl numbersign dollar percent ampersand quotesingle parenleft parenright asterisk plus comma hyphen period slash colon semicolon less equal greater question at bracketleft backslash bracketright asciicircum underscore grave braceleft bar braceright asciitilde "
        "exclamdown cent sterling currency yen brokenbar section dieresis copyright ordfeminine guillemotleft logicalnot registered macron degree plusminus acute mu paragraph periodcentered cedilla ordmasculine guillemotright onequarter onehalf threequarters questiondown "
        "quoteleft quoteright quotesinglbase quotedblleft quotedblright quotedblbase dagger daggerdbl bullet ellipsis perthousand guilsinglleft guilsinglright endash emdash trademark florin fraction fi fl ff ffi ffl Euro minus multiply divide AE ae Oslash oslash OE oe germandbls dotlessi Lslash lslash Eth eth Thorn thorn nbspace sfthyphen".split(),
        [*" !\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~", *"¡¢£¤¥¦§¨©ª«¬®¯°±´µ¶·¸º»¼½¾¿", *"‘’‚“”„†‡•…‰‹›–—™ƒ⁄", "fi", "fl", "ff", "ffi", "ffl", *"€−×÷ÆæØøŒœßıŁłÐðÞþ", "\xa0", "\xad"],
    )
)


def glyph_text(name: str) -> str | None:
    """Text of a glyph name; None where it says nothing."""
    base = name.split(".")[0]
    if base in _NAMES:
        return _NAMES[base]
    if len(base) == 1:
        return base
    m = re.fullmatch(r"uni((?:[0-9A-F]{4})+)", base)
    if m:
        return "".join(chr(int(m[1][i : i + 4], 16)) for i in range(0, len(m[1]), 4))
    m = re.fullmatch(r"u([0-9A-F]{4,6})", base)
    if m and int(m[1], 16) < 0x110000:
        return chr(int(m[1], 16))
    for mark, word in _MARKS.items():
        if base.endswith(mark) and len(base) == len(mark) + 1 and base[0].isalpha():
            try:
                return unicodedata.lookup(f"LATIN {'CAPITAL' if base[0].isupper() else 'SMALL'} LETTER {base[0].upper()} WITH {word}")
            except KeyError:
                return None
    if "_" in base:
        parts = [glyph_text(p) for p in base.split("_")]
        return "".join(parts) if all(parts) else None
    return None


def _codec(name: str) -> dict[int, str]:
    out = {}
    for i in range(32, 256):
        try:
            out[i] = bytes([i]).decode(name)
        except UnicodeDecodeError:
            continue
    return out


_ENCODINGS = {"WinAnsiEncoding": _codec("cp1252"), "MacRomanEncoding": _codec("mac_roman")}
_ENCODINGS["StandardEncoding"] = {i: chr(i) for i in range(32, 127)} | {39: "’", 96: "‘"} | dict(
    zip([*range(0xA1, 0xB0), *range(0xB1, 0xB5), *range(0xB6, 0xBE), 0xBF], "¡¢£⁄¥ƒ§¤'“«‹›ﬁﬂ–†‡·¶•‚„”»…‰¿")
) | {0xD0: "—", 0xE1: "Æ", 0xE3: "ª", 0xE8: "Ł", 0xE9: "Ø", 0xEA: "Œ", 0xEB: "º", 0xF1: "æ", 0xF5: "ı", 0xF8: "ł", 0xF9: "ø", 0xFA: "œ", 0xFB: "ß"}


def parse_cmap(data: bytes, simple: bool) -> tuple[dict[int, str], set[int]]:
    """Targets by code, and the lengths of codes in bytes."""
    out: dict[int, str] = {}
    widths: set[int] = set()
    lex, held = Lexer(data, refs=False), []
    text = lambda b: b.decode("utf-16-be", "replace") if len(b) > 1 else b.decode("latin-1")
    number = lambda b: int.from_bytes(b, "big")
    while True:
        t = lex.next()
        if t is END:
            break
        if not isinstance(t, Keyword):
            held.append(t)
            continue
        if t == b"endcodespacerange":
            widths |= {len(x) for x in held if isinstance(x, bytes)}
        elif t == b"endbfchar":
            for a, b in zip(held[::2], held[1::2]):
                if isinstance(a, bytes) and isinstance(b, bytes):
                    out[number(a)] = text(b)
                    widths.add(len(a))
        elif t == b"endbfrange":
            for a, b, c in zip(held[::3], held[1::3], held[2::3]):
                if not (isinstance(a, bytes) and isinstance(b, bytes)):
                    continue
                low, high = number(a), min(number(b), number(a) + 65535)
                widths.add(len(a))
                if isinstance(c, list):
                    out |= {low + i: text(x) for i, x in enumerate(c) if isinstance(x, bytes) and low + i <= high}
                elif isinstance(c, bytes) and c:
                    base = text(c)
                    for i in range(high - low + 1):
                        last = ord(base[-1]) + i
                        out[low + i] = base[:-1] + (chr(last) if last < 0x110000 else "�")
        held = []
    return out, {1} if simple else widths


class TrueType:
    """Number of glyphs and the character maps of a TrueType program."""

    def __init__(self, data: bytes):
        n = struct.unpack(">H", data[4:6])[0]
        tables = {data[12 + 16 * i : 16 + 16 * i]: struct.unpack(">II", data[20 + 16 * i : 28 + 16 * i]) for i in range(n)}
        at = tables[b"maxp"][0]
        self.glyphs = struct.unpack(">H", data[at + 4 : at + 6])[0]
        self.maps: dict[tuple[int, int], dict[int, int]] = {}
        if b"cmap" not in tables:
            return
        base = tables[b"cmap"][0]
        for i in range(struct.unpack(">H", data[base + 2 : base + 4])[0]):
            platform, enc, off = struct.unpack(">HHI", data[base + 4 + 8 * i : base + 12 + 8 * i])
            self.maps[platform, enc] = self._map(data, base + off)

    @staticmethod
    def _map(data: bytes, at: int) -> dict[int, int]:
        form, out = struct.unpack(">H", data[at : at + 2])[0], {}
        if form == 0:
            out = dict(enumerate(data[at + 6 : at + 262]))
        elif form == 4:
            n = struct.unpack(">H", data[at + 6 : at + 8])[0] // 2
            u = lambda p, kind: struct.unpack(f">{n}{kind}", data[p : p + 2 * n])
            ends, starts, deltas, offs = u(at + 14, "H"), u(at + 16 + 2 * n, "H"), u(at + 16 + 4 * n, "h"), u(at + 16 + 6 * n, "H")
            for k, (e, s, d, o) in enumerate(zip(ends, starts, deltas, offs)):
                for c in range(s, e + 1):
                    if c == 0xFFFF:
                        continue
                    g = c + d
                    if o:
                        p = at + 16 + 6 * n + 2 * k + o + 2 * (c - s)
                        g = struct.unpack(">H", data[p : p + 2])[0] if p + 2 <= len(data) else 0
                        g = g + d if g else 0
                    out[c] = g & 0xFFFF
        elif form == 6:
            first, n = struct.unpack(">HH", data[at + 6 : at + 10])
            out = {first + i: g for i, g in enumerate(struct.unpack(f">{n}H", data[at + 10 : at + 10 + 2 * n]))}
        elif form == 12:
            for i in range(struct.unpack(">I", data[at + 12 : at + 16])[0]):
                s, e, g = struct.unpack(">III", data[at + 16 + 12 * i : at + 28 + 12 * i])
                out |= {c: g + c - s for c in range(s, min(e, s + 65535) + 1)}
        return out


class Font:
    def __init__(self, file: File, ref, key: str):
        d = file.dict(ref)
        self.key, self.indirect = key, isinstance(ref, Ref)
        self.subtype = file.name(d.get("Subtype")) or "?"
        self.base_font = file.name(d.get("BaseFont")) or file.name(d.get("Name")) or "?"
        self.simple = self.subtype != "Type0"
        self.pages: set[int] = set()
        self.shown: set[int] = set()
        self.notdef: set[int] = set()
        kids = file.array(d.get("DescendantFonts"))
        inner = file.dict(kids[0]) if kids else {}
        self.descendant = file.name(inner.get("Subtype"))
        self.has_cidtogid = file.get(inner.get("CIDToGIDMap")) is not None
        info = file.dict((inner if kids else d).get("FontDescriptor"))
        program = next((file.get(info[k]) for k in ("FontFile", "FontFile2", "FontFile3") if k in info), None)
        self.embedded = self.subtype == "Type3" or isinstance(program, Stream)
        self.symbolic = bool(int(file.number(info.get("Flags"), 0)) & 4)
        scale = 1000.0
        self.ascent, self.descent = file.number(info.get("Ascent"), 0) / scale or 0.8, file.number(info.get("Descent"), 0) / scale or -0.2
        self.ascent, self.descent = (self.ascent, self.descent) if -2 < self.descent <= 0 < self.ascent < 3 else (0.8, -0.2)
        self.matrix = [file.number(x) for x in file.array(d.get("FontMatrix"))] if self.subtype == "Type3" else None
        self.cmap: dict[int, str] = {}
        widths: set[int] = set()
        to = file.get(d.get("ToUnicode"))
        self.has_tounicode = isinstance(to, Stream)
        if self.has_tounicode:
            try:
                self.cmap, widths = parse_cmap(file.decode(to), self.simple)
            except Exception:  # noqa: BLE001
                self.cmap = {}
        self.bytes_per_code = 1 if self.simple else (min(widths) if widths and min(widths) > 0 and len(widths) == 1 else 2)
        self.names: dict[int, str] = {}
        self.encoding = self._encoding(file, d) if self.simple else {}
        self.has_encoding = bool(self.encoding)
        if not self.simple:
            system = file.dict(inner.get("CIDSystemInfo"))
            ordering = file.get(system.get("Ordering"))
            # Characters of a known collection can be mapped, though not here.
            self.has_encoding = isinstance(ordering, bytes) and ordering != b"Identity"
        self._widths(file, d, inner)
        self._coverage(file, d, inner, program)

    def _encoding(self, file: File, d: dict) -> dict[int, str]:
        e = file.get(d.get("Encoding"))
        base = e if isinstance(e, Name) else file.name(e.get("BaseEncoding")) if isinstance(e, dict) else None
        out = dict(_ENCODINGS.get(str(base), {}))
        if not out and self.subtype != "Type3" and not (self.symbolic and self.embedded) and (isinstance(e, dict) or not self.embedded or not self.symbolic):
            out = dict(_ENCODINGS["StandardEncoding"])
        if isinstance(e, dict):
            code = 0
            for x in file.array(e.get("Differences")):
                x = file.get(x)
                if isinstance(x, int):
                    code = x
                elif isinstance(x, Name):
                    self.names[code] = str(x)
                    t = glyph_text(str(x))
                    if t:
                        out[code] = t
                    else:
                        out.pop(code, None)
                    code += 1
        return out

    def _widths(self, file: File, d: dict, inner: dict) -> None:
        self.width: dict[int, float] = {}
        if self.simple:
            first = int(file.number(d.get("FirstChar"), 0))
            scale = abs(self.matrix[0]) if self.matrix and self.matrix[0] else 0.001
            self.width = {first + i: file.number(w) * scale for i, w in enumerate(file.array(d.get("Widths")))}
            self.missing = file.number(file.dict(d.get("FontDescriptor")).get("MissingWidth"), 0) / 1000 or (0.5 if not self.width else 0.0)
            return
        self.missing = file.number(inner.get("DW"), 1000) / 1000
        w = [file.get(x) for x in file.array(inner.get("W"))]
        i = 0
        while i + 1 < len(w):
            if isinstance(w[i + 1], list):
                self.width |= {int(w[i]) + k: file.number(x) / 1000 for k, x in enumerate(w[i + 1])}
                i += 2
            elif i + 2 < len(w):
                for c in range(int(w[i]), min(int(w[i + 1]), int(w[i]) + 65535) + 1):
                    self.width[c] = file.number(w[i + 2]) / 1000
                i += 3
            else:
                break

    def _coverage(self, file: File, d: dict, inner: dict, program) -> None:
        self.glyph = lambda code: None
        try:
            if self.subtype == "Type3":
                procs = file.dict(d.get("CharProcs"))
                self.glyph = lambda code: self.names.get(code) in procs
                return
            if not isinstance(program, Stream):
                return
            data = file.decode(program)
            if data[:4] not in (b"\0\1\0\0", b"true"):
                return
            tt = TrueType(data)
            if not self.simple:
                to = file.get(inner.get("CIDToGIDMap"))
                table = file.decode(to) if isinstance(to, Stream) else None
                gid = (lambda c: int.from_bytes(table[2 * c : 2 * c + 2], "big")) if table else (lambda c: c)
                if file.name(d.get("Encoding")) in ("Identity-H", "Identity-V"):
                    self.glyph = lambda code: 0 < gid(code) < tt.glyphs
                return
            symbol, unicode_, mac = tt.maps.get((3, 0)), tt.maps.get((3, 1)) or tt.maps.get((0, 3)), tt.maps.get((1, 0))

            def has(code):
                if symbol:
                    return any(symbol.get(b + code) for b in (0, 0xF000, 0xF100, 0xF200))
                t = self.encoding.get(code)
                if unicode_ and t and len(t) == 1:
                    return bool(unicode_.get(ord(t))) or bool(mac and mac.get(code)) or None
                return bool(mac.get(code)) if mac else None

            self.glyph = has
        except Exception:  # noqa: BLE001 - a program that can't be read tells nothing
            self.glyph = lambda code: None

    def codes(self, data: bytes):
        n = self.bytes_per_code
        return list(data) if n == 1 else [int.from_bytes(data[i : i + n], "big") for i in range(0, len(data), n)]

    def text_of(self, code: int) -> str | None:
        t = self.cmap.get(code)
        return t if t is not None else self.encoding.get(code) if self.simple else None

    def rows(self, doc_id: int) -> tuple[tuple, list[tuple]]:
        font = (doc_id, self.key, self.subtype, self.base_font, self.embedded, self.has_tounicode, self.has_encoding, self.descendant, self.has_cidtogid, self.indirect, min(self.pages, default=0))
        return font, [(doc_id, self.key, c, True, self.cmap.get(c), self.text_of(c) is not None, c in self.notdef) for c in sorted(self.shown)]
