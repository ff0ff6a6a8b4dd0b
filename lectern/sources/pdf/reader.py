"""One file to rows of every fact table. Nothing raises: a file that can't be read is a document with an error."""

from __future__ import annotations

import re
from itertools import count
from xml.etree import ElementTree

from ...catalogue import STANDARD_TYPES
from .content import State, Walker, merge
from .objects import File, Name, PdfError, Ref, Stream, text

STANDARD = frozenset(STANDARD_TYPES)
DEPTH = 60
ROW_GROUPS = ("THead", "TBody", "TFoot")
_RDF = "{http://www.w3.org/1999/" + "02/22-rdf-syntax-ns#}"
_DC = "{http://purl.org/dc/" + "elements/1.1/}"
_UA = "{http://www.aiim.org/" + "pdfua/ns/id/}"


def resolve(kind: str, role_map: dict[str, str]) -> tuple[str, bool]:
    """The standard type that a type maps to, and whether its chain is a loop (then the type stays)."""
    seen, at = set(), kind
    while at not in STANDARD and at in role_map:
        if at in seen:
            return kind, True
        seen.add(at)
        at = role_map[at]
    return at, False


def xmp(data: bytes) -> tuple[str | None, str | None]:
    """(title, PDF/UA part) of a metadata packet; where it is no XML, of its text."""
    try:
        root = ElementTree.fromstring(data.strip(b"\0 \t\r\n"))
        title = next((li.text for t in root.iter(f"{_DC}title") for li in t.iter(f"{_RDF}li")), None)
        part = next((e.text for e in root.iter(f"{_UA}part")), None) or next((e.attrib[f"{_UA}part"] for e in root.iter() if f"{_UA}part" in e.attrib), None)
        return title, part
    except ElementTree.ParseError:
        raw = data.decode("utf-8", "replace")
        t = re.search(r"<dc:title\b.*?<rdf:li[^>]*>([^<]*)", raw, re.S)
        p = re.search(r"pdfuaid:part[\s>=\"']+(\d+)", raw)
        return (t[1] if t else None), (p[1] if p else None)


class Document:
    def __init__(self, doc_id: int, path: str, data: bytes):
        self.id, self.path, self.file = doc_id, path, File(data)
        self.rows: dict[str, list[tuple]] = {}

    def add(self, table: str, *row) -> None:
        self.rows.setdefault(table, []).append((self.id, *row))

    def read(self) -> dict[str, list[tuple]]:
        f = self.file
        self.pages = self._pages()
        self.index = {k: i for i, (k, _) in enumerate(self.pages) if k}
        self.role_map = {str(k): f.name(v) for k, v in f.dict(f.dict(f.root.get("StructTreeRoot")).get("RoleMap")).items() if f.name(v)}
        self._content()
        self._annotations()
        self.has_struct = isinstance(f.get(f.root.get("StructTreeRoot")), dict)
        if self.has_struct:
            self._structure()
        self._catalog()
        return self.rows

    # -- pages

    def _pages(self) -> list[tuple]:
        """(object key, page with what it inherits) in order; a node is visited once."""
        f, out, seen = self.file, [], set()
        todo = [(f.root.get("Pages"), {})]
        while todo:
            ref, given = todo.pop()
            key = (ref.num, ref.gen) if isinstance(ref, Ref) else None
            node = f.get(ref)
            if not isinstance(node, dict) or key in seen:
                continue
            if key:
                seen.add(key)
            here = given | {k: node[k] for k in ("MediaBox", "CropBox", "Rotate", "Resources") if k in node}
            if "Kids" in node and f.name(node.get("Type")) != "Page":
                todo += [(k, here) for k in reversed(f.array(node["Kids"]))]
            else:
                out.append((key, node | here))
        return out

    def _content(self) -> None:
        f, fonts = self.file, {}
        refs = count()
        seen_forms: set = set()
        for i, (_, page) in enumerate(self.pages):
            box = [f.number(x) for x in f.array(page.get("CropBox") or page.get("MediaBox"))]
            box = box if len(box) == 4 else [0, 0, 612, 792]
            res = f.dict(page.get("Resources"))
            kinds = set()
            for name, ref in f.dict(res.get("XObject")).items():
                x = f.get(ref)
                if isinstance(x, Stream):
                    kinds.add(f.name(x.dict.get("Subtype")))
                self._reference(i, str(name), x, refs, seen_forms)
            w = Walker(f, i, fonts)
            try:
                w.resource_fonts(res)
                parts = f.get(page.get("Contents"))
                parts = parts if isinstance(parts, list) else [parts]
                data = b"\n".join(f.decode(s) for s in map(f.get, parts) if isinstance(s, Stream))
                w.walk(data, res, State(), None)
            except Exception as e:  # noqa: BLE001 - the page stays with what was read
                w.out.error = f"{type(e).__name__}: {e}"[:200]
            o = w.out
            rotate = int(f.number(page.get("Rotate"), 0)) % 360
            left, low, right, top = box
            self.add("pages", i, abs(right - left), abs(top - low), rotate, f.name(page.get("Tabs")), "Image" in kinds, "Form" in kinds, o.error)
            for n, r in enumerate(merge(o.runs)):
                self.add("runs", i, n, r.paint, *r.facts())
            for paint, name, b, mcid, stream, art, width, height, inside in o.images:
                self.add("images", i, paint, name, *b, mcid, stream, art, width, height, inside)
            for paint, b, mcid, art, kind, stroked, filled in o.paths:
                self.add("paths", i, paint, *b, mcid, art, kind, stroked, filled)
            for n, (stream, mcid) in enumerate(o.nesting):
                self.add("nesting_events", i, n, stream, mcid)
            for key, n in o.notdef.items():
                self.add("notdefs", i, key, n)
        for font in fonts.values():
            row, codes = font.rows(self.id)
            self.rows.setdefault("fonts", []).append(row)
            self.rows.setdefault("font_codes", []).extend(codes)
        self.has_fonts = bool(fonts)

    def _reference(self, page: int, name: str, x, refs, seen: set, depth: int = 0) -> None:
        f = self.file
        if not isinstance(x, Stream) or x.key in seen or depth > 6:
            return
        seen.add(x.key)
        if f.name(x.dict.get("Subtype")) == "Form":
            if f.get(x.dict.get("Ref")) is not None:
                self.add("reference_xobjects", page, name, next(refs))
            for n, ref in f.dict(f.dict(x.dict.get("Resources")).get("XObject")).items():
                self._reference(page, str(n), f.get(ref), refs, seen, depth + 1)

    # -- annotations

    def _annotations(self) -> None:
        f, seq = self.file, count()
        for i, (_, page) in enumerate(self.pages):
            for ref in f.array(page.get("Annots")):
                a = f.get(ref)
                if not isinstance(a, dict) or f.name(a.get("Subtype")) == "Popup":
                    continue
                flags = int(f.number(a.get("F"), 0))
                rect = [float(f.number(x)) for x in f.array(a.get("Rect"))]
                rect = rect if len(rect) == 4 else [0.0] * 4
                got, node = {}, a
                for _ in range(8):
                    for k in ("TU", "T", "FT"):
                        if k not in got and node.get(k) is not None:
                            got[k] = text(f.get(node[k]))
                    node = f.get(node.get("Parent"))
                    if not isinstance(node, dict):
                        break
                key = (ref.num, ref.gen) if isinstance(ref, Ref) else None
                self.add("annotations", next(seq), i, key, f.name(a.get("Subtype")) or "?", text(f.get(a.get("Contents"))), flags, *rect, got.get("TU"), got.get("T"), got.get("FT"), bool(flags & 34))

    # -- structure

    def _structure(self) -> None:
        f = self.file
        seen: set = set()
        elements: list[dict] = []
        root = f.dict(f.root.get("StructTreeRoot"))

        def page_of(d, inherited):
            ref = d.get("Pg")
            if ref is None:
                return inherited, False
            key = (ref.num, ref.gen) if isinstance(ref, Ref) else None
            at = self.index.get(key)
            return (inherited if at is None else at), at is None and isinstance(f.get(ref), dict)

        def visit(ref, parent, depth, page):
            node = f.get(ref)
            if not isinstance(node, dict) or depth > DEPTH:
                return
            key = (ref.num, ref.gen) if isinstance(ref, Ref) else None
            if key in seen:
                return
            if key:
                seen.add(key)
            raw = f.name(node.get("S"))
            if raw is None:
                for kid in self._kids(node):
                    visit(kid, parent, depth + 1, page)
                return
            page, dangling = page_of(node, page)
            kind, circular = resolve(raw, self.role_map)
            up = elements[parent] if parent is not None else None
            logical = parent
            while logical is not None and elements[logical]["type"] == "NonStruct":
                logical = elements[logical]["parent"]
            e = {
                "ord": len(elements), "parent": parent, "logical": logical, "depth": depth, "raw": raw, "type": kind, "circular": circular, "page": page, "node": node, "dangling": dangling,
                "path": f"{up['path']}/{raw}" if up else raw, "refs": [], "objs": [], "ancestors": [*(up["ancestors"] if up else []), len(elements)],
            }
            elements.append(e)
            me = e["ord"]
            for kid in self._kids(node):
                k = f.get(kid)
                if isinstance(k, int) and not isinstance(k, bool):
                    e["refs"].append((page, None, k))
                elif isinstance(k, dict) and f.name(k.get("Type")) == "MCR":
                    at, _ = page_of(k, page)
                    s = k.get("Stm")
                    mcid = f.get(k.get("MCID"))
                    if isinstance(mcid, int):
                        e["refs"].append((at, (s.num, s.gen) if isinstance(s, Ref) else None, mcid))
                elif isinstance(k, dict) and f.name(k.get("Type")) == "OBJR":
                    o = k.get("Obj")
                    e["objs"].append((o.num, o.gen) if isinstance(o, Ref) else None)
                else:
                    visit(kid, me, depth + 1, page)
            e["end"] = len(elements) - 1

        for kid in self._kids(root):
            visit(kid, None, 0, None)
        for e in elements:
            n, a = e["node"], self._attributes(e["node"])
            table, layout = a.get("Table", {}), a.get("Layout", {})
            bbox = layout.get("BBox")
            bbox = [float(x) for x in bbox] if isinstance(bbox, list) and len(bbox) == 4 and all(isinstance(x, (int, float)) for x in bbox) else None
            heads, of = table.get("Headers"), e["logical"] if e["type"] == "TR" else None
            while of is not None and elements[of]["type"] in ROW_GROUPS:
                of = elements[of]["logical"]
            of = of if of is not None and elements[of]["type"] == "Table" else None
            opt = lambda k: text(f.get(n.get(k)))  # noqa: B023, E731
            self.add(
                "elements", e["ord"], e["end"], e["parent"], e["logical"], e["depth"], e["raw"], e["type"], e["type"] in STANDARD, e["circular"], e["page"], opt("Alt"), opt("ActualText"), opt("Lang"), opt("ID"), e["path"],
                n.get("P") is not None, e["dangling"], n.get("AF") is not None, table.get("Scope") if isinstance(table.get("Scope"), str) else None, [str(h) for h in heads] if isinstance(heads, list) else [], _span(table.get("ColSpan")), _span(table.get("RowSpan")), bbox, e["ancestors"], of,
            )
            for s, (page, stream, mcid) in enumerate(e["refs"]):
                self.add("mcrefs", e["ord"], s, page, stream, mcid)
            for s, key in enumerate(e["objs"]):
                self.add("objrefs", e["ord"], s, key)

    def _kids(self, node: dict) -> list:
        k = node.get("K")
        got = self.file.get(k)
        return got if isinstance(got, list) else [] if got is None else [k]

    def _attributes(self, node: dict) -> dict[str, dict]:
        f, out = self.file, {}
        a = f.get(node.get("A"))
        for item in a if isinstance(a, list) else [a]:
            d = f.get(item)
            d = d.dict if isinstance(d, Stream) else d
            if isinstance(d, dict):
                out.setdefault(f.name(d.get("O")) or "", {}).update({k: self.plain(v) for k, v in d.items() if k != "O"})
        return out

    def plain(self, v, depth: int = 0):
        """Attribute values as plain data, six levels deep."""
        v = self.file.get(v)
        if depth > 6 or v is None:
            return None
        if isinstance(v, Name):
            return str(v)
        if isinstance(v, bytes):
            return text(v)
        deeper = depth + 1
        match v:
            case list():
                return [self.plain(x, deeper) for x in v]
            case dict():
                return dict(zip(map(str, v), (self.plain(x, deeper) for x in v.values())))
            case bool() | int() | float():
                return v
        return str(v)

    # -- catalog

    def _catalog(self) -> None:
        f, root = self.file, self.file.root
        meta = f.get(root.get("Metadata"))
        title, part = xmp(f.decode(meta)) if isinstance(meta, Stream) else (None, None)
        info = f.dict(f.trailer.get("Info"))
        mark = {str(k): f.get(v) for k, v in f.dict(root.get("MarkInfo")).items() if isinstance(f.get(v), bool)}
        shown = f.get(f.dict(root.get("ViewerPreferences")).get("DisplayDocTitle"))
        names, form = f.dict(root.get("Names")), f.get(root.get("AcroForm"))
        oc = f.dict(root.get("OCProperties"))
        configs = [("default", f.get(oc.get("D")))] + [(f"alternate {i}", f.get(c)) for i, c in enumerate(f.array(oc.get("Configs")), 1)]
        configs = [(label, text(f.get(c.get("Name"))), f.get(c.get("AS")) is not None) for label, c in configs if isinstance(c, dict)]
        p = f.encrypt.get("P") if f.encrypt else None
        n, node, seen = 0, f.dict(root.get("Outlines")).get("First"), set()
        while n < 3 and isinstance(f.get(node), dict):
            key = (node.num, node.gen) if isinstance(node, Ref) else None
            if key and key in seen:
                break
            seen.add(key)
            n += 1
            node = f.get(node).get("Next")
        self.add(
            "docs", self.path, None, self.has_struct, text(f.get(root.get("Lang"))), title, text(f.get(info.get("Title"))), part, mark, shown if isinstance(shown, bool) else None, self.role_map, f.encrypt is not None,
            None if p is None else (p + (1 << 31)) % (1 << 32) - (1 << 31), None if p is None else bool(p & 16), form is not None, isinstance(form, dict) and f.get(form.get("XFA")) is not None,
            f.get(names.get("JavaScript")) is not None or f.get(root.get("OpenAction")) is not None or f.get(root.get("AA")) is not None, f.get(root.get("Threads")) is not None, f.get(root.get("OCProperties")) is not None,
            isinstance(f.get(names.get("EmbeddedFiles")), dict), n, len(self.pages), configs, self._files(names.get("EmbeddedFiles")),
        )

    def _files(self, ref, depth: int = 0) -> list[tuple]:
        f, node = self.file, self.file.dict(ref)
        out = []
        if depth <= 10:
            for spec in f.array(node.get("Names"))[1::2]:
                s = f.get(spec)
                if isinstance(s, dict):
                    out.append(tuple(text(f.get(s.get(k))) for k in ("F", "UF", "Desc")))
            for kid in f.array(node.get("Kids")):
                out += self._files(kid, depth + 1)
        return out


def _span(v) -> int:
    try:
        n = int(float(v))
    except (OverflowError, TypeError, ValueError):
        n = 1
    return n if n > 1 else 1


def read_file(doc_id: int, path: str, data: bytes | None) -> dict[str, list[tuple]]:
    """Rows by table. A file that can't be read gives its document with the reason and nothing else."""
    try:
        if data is None:
            raise FileNotFoundError("no such file")
        return Document(doc_id, path, data).read()
    except Exception as e:  # noqa: BLE001
        why = str(e) if isinstance(e, (PdfError, FileNotFoundError)) else f"{type(e).__name__}: {e}"
        return {"docs": [(doc_id, path, why[:300], False, None, None, None, None, {}, None, {}, False, None, None, False, False, False, False, False, False, 0, 0, [], [])]}
