"""Writes small tagged PDF files. Text is drawn in a Type 3 font, so no font file is needed."""

from __future__ import annotations

from dataclasses import dataclass, field
from xml.etree import ElementTree


class N(str):
    """A name."""


@dataclass
class R:
    """A reference."""

    num: int


@dataclass
class T:
    """Text drawn as one marked-content sequence; mcid is given when the page is drawn."""

    text: str
    page: int = 0
    size: float = 12
    mode: int = 0
    x: float = 72
    y: float | None = None
    tagged: bool = True  # False: drawn bare
    artifact: bool = False
    form: bool = False  # drawn inside a form XObject
    font: str = "F1"
    again: bool = False  # refers to the sequence of the text before it


@dataclass
class E:
    """A structure element."""

    kind: str
    kids: list = field(default_factory=list)
    entries: dict = field(default_factory=dict)


@dataclass
class Annot:
    """An annotation; as a kid it becomes an object reference of its element."""

    subtype: str
    rect: tuple = (72, 700, 200, 715)
    entries: dict = field(default_factory=dict)
    page: int = 0
    flags: int = 4


def obj(v) -> bytes:
    if isinstance(v, bool):
        return b"true" if v else b"false"
    if v is None:
        return b"null"
    if isinstance(v, R):
        return b"%d 0 R" % v.num
    if isinstance(v, N):
        return b"/" + v.encode()
    if isinstance(v, str):
        return b"<" + (b"\xfe\xff" + v.encode("utf-16-be")).hex().encode() + b">"
    if isinstance(v, bytes):
        return b"<" + v.hex().encode() + b">"
    if isinstance(v, dict):
        return b"<<" + b" ".join(b"/" + k.encode() + b" " + obj(x) for k, x in v.items()) + b">>"
    if isinstance(v, (list, tuple)):
        return b"[" + b" ".join(map(obj, v)) + b"]"
    return str(v).encode()


class Maker:
    def __init__(self):
        self.objects: list[bytes] = []

    def add(self, v=None, stream: bytes | None = None) -> R:
        body = obj(v) if stream is None else obj({**(v or {}), "Length": len(stream)}) + b"\nstream\n" + stream + b"\nendstream"
        self.objects.append(body)
        return R(len(self.objects))

    def put(self, ref: R, v) -> None:
        self.objects[ref.num - 1] = obj(v)

    def file(self, trailer: dict) -> bytes:
        out, places = bytearray(b"%PDF-1.7\n"), []
        for i, body in enumerate(self.objects, 1):
            places.append(len(out))
            out += b"%d 0 obj\n" % i + body + b"\nendobj\n"
        at = len(out)
        out += b"xref\n0 %d\n0000000000 65535 f \n" % (len(places) + 1) + b"".join(b"%010d 00000 n \n" % p for p in places)
        return bytes(out + b"trailer\n" + obj({**trailer, "Size": len(places) + 1}) + b"\nstartxref\n%d\n%%%%EOF\n" % at)


def font(m: Maker, cmap: dict[int, str] | None, extra: dict | None = None, codes: str = "".join(map(chr, range(32, 127)))) -> R:
    proc = m.add({}, b"500 0 d0")
    names = [N(f"uni{ord(c):04X}") for c in codes]
    d = {
        "Type": N("Font"), "Subtype": N("Type3"), "Name": N("Plain"), "FontBBox": [0, 0, 500, 800], "FontMatrix": [0.001, 0, 0, 0.001, 0, 0], "FirstChar": 32, "LastChar": 126,
        "Widths": [500] * 95, "Encoding": {"Type": N("Encoding"), "Differences": [32, *names]}, "CharProcs": {n: proc for n in names}, "Resources": {},
    }
    if cmap is not None:
        pairs = b"".join(b"<%02x> <%s>\n" % (c, t.encode("utf-16-be").hex().encode()) for c, t in cmap.items())
        d["ToUnicode"] = m.add({}, b"1 begincodespacerange <00> <ff> endcodespacerange\n%d beginbfchar\n" % len(cmap) + pairs + b"endbfchar")
    return m.add({**d, **(extra or {})})


PLAIN = {i: chr(i) for i in range(32, 127)}


def make(
    tree: list | None, loose: list = (), n_pages: int = 1, size=(612, 792), title="A sound title", info=None, lang="en", marked=True, suspects=False, display=True, part="1", role_map=None, tabs="S", outlines=False, annots: list = (),
    raw: dict[int, bytes] | None = None, images: dict[int, list] | None = None, cmap=PLAIN, fonts: dict | None = None, catalog: dict | None = None, encrypt: dict | None = None, order=None, no_parent: bool = False, page_entries: dict | None = None, extra_forms: dict | None = None,
) -> bytes:
    """``tree``: elements below the root, None for an untagged file. ``loose``: texts outside the tree. ``order`` sorts what is drawn."""
    m = Maker()
    cat, pages_ref = m.add(), m.add()
    refs = [m.add() for _ in range(n_pages)]
    f1 = font(m, cmap)
    made = {"F1": f1, **{k: (v(m) if callable(v) else v) for k, v in (fonts or {}).items()}}
    texts: list[T] = []
    where: dict[int, tuple] = {}

    def gather(kids):
        for k in kids:
            if isinstance(k, T):
                texts.append(k)
            elif isinstance(k, E):
                gather(k.kids)

    gather(tree or [])
    texts += list(loose)
    y = {p: size[1] - 90.0 for p in range(n_pages)}
    for t in texts:
        if t.y is None:
            t.y = y[t.page]
            y[t.page] -= 1.8 * t.size
    content = {p: [] for p in range(n_pages)}
    forms: dict[int, dict] = {p: {} for p in range(n_pages)}
    ids = dict.fromkeys(range(n_pages), 0)
    last = None
    for t in texts:
        if t.again:
            where[id(t)] = last
            continue
        if t.tagged and not t.artifact:
            where[id(t)] = last = (t.page, ids[t.page])
            ids[t.page] += 1
    for t in sorted(texts, key=order) if order else texts:
        if t.again:
            continue
        show = b"BT /%s %g Tf %d Tr 1 0 0 1 %g %g Tm %s Tj ET\n" % (t.font.encode(), t.size, t.mode, t.x, t.y, obj(t.text.encode("latin-1")))
        if t.form:
            x = m.add({"Type": N("XObject"), "Subtype": N("Form"), "BBox": [0, 0, *size], "Resources": {"Font": made}}, show)
            name = f"X{len(forms[t.page])}"
            forms[t.page][name] = x
            show = b"/%s Do\n" % name.encode()
        if t.artifact:
            show = b"/Artifact BMC\n" + show + b"EMC\n"
        elif t.tagged:
            show = b"/Span <</MCID %d>> BDC\n" % where[id(t)][1] + show + b"EMC\n"
        content[t.page].append(show)
    lists: dict[int, list] = {p: [] for p in range(n_pages)}
    annot_refs: dict[int, R] = {}

    def annot(a: Annot) -> R:
        if id(a) not in annot_refs:
            annot_refs[id(a)] = m.add({"Type": N("Annot"), "Subtype": N(a.subtype), "Rect": list(a.rect), "F": a.flags, **a.entries})
            lists[a.page].append(annot_refs[id(a)])
        return annot_refs[id(a)]

    def element(e: E, parent: R) -> R:
        ref = m.add()
        kids = []
        for k in e.kids:
            if isinstance(k, T):
                page, mcid = where[id(k)]
                kids.append({"Type": N("MCR"), "Pg": refs[page], "MCID": mcid})
            elif isinstance(k, Annot):
                kids.append({"Type": N("OBJR"), "Obj": annot(k)})
            elif isinstance(k, dict):
                kids.append(k)
            else:
                kids.append(element(k, ref))
        d = {"Type": N("StructElem"), "S": N(e.kind), "P": parent, "K": kids, **e.entries}
        if isinstance(d.get("Pg"), int):  # a page by its number; one that doesn't exist leads to another object
            d["Pg"] = refs[d["Pg"]] if d["Pg"] < n_pages else cat
        if no_parent:
            d.pop("P")
        m.put(ref, d)
        return ref

    root = None
    if tree is not None:
        root = m.add()
        m.put(root, {"Type": N("StructTreeRoot"), "K": [element(e, root) for e in tree], **({"RoleMap": {k: N(v) for k, v in role_map.items()}} if role_map else {})})
    for a in annots:
        annot(a)
    for p, ref in enumerate(refs):
        xobjects = forms[p] | {k: m.add({"Type": N("XObject"), "Subtype": N("Form"), "BBox": [0, 0, 9, 9], **v}, b"") for k, v in (extra_forms or {}).items()}
        drawn = []
        for i, (px, box, tag) in enumerate((images or {}).get(p, [])):
            xobjects[f"Im{i}"] = m.add({"Type": N("XObject"), "Subtype": N("Image"), "Width": px[0], "Height": px[1], "ColorSpace": N("DeviceGray"), "BitsPerComponent": 8}, b"\0")
            draw = b"q %g 0 0 %g %g %g cm /Im%d Do Q\n" % (box[2] - box[0], box[3] - box[1], box[0], box[1], i)
            drawn.append(tag + draw + (b"EMC\n" if tag else b""))
        data = b"".join(drawn) + b"".join(content[p]) + (raw or {}).get(p, b"")
        d = {
            "Type": N("Page"), "Parent": pages_ref, "MediaBox": [0, 0, *size], "Contents": m.add({}, data), "Resources": {"Font": made, **({"XObject": xobjects} if xobjects else {})},
            **({"Annots": lists[p]} if lists[p] else {}), **({"Tabs": N(tabs)} if tabs else {}), **(page_entries or {}),
        }
        m.put(ref, d)
    m.put(pages_ref, {"Type": N("Pages"), "Kids": refs, "Count": n_pages})
    from .reader import _DC, _RDF, _UA

    packet = ElementTree.Element(f"{_RDF}RDF")
    about = ElementTree.SubElement(packet, f"{_RDF}Description")
    if title:
        ElementTree.SubElement(ElementTree.SubElement(ElementTree.SubElement(about, f"{_DC}title"), f"{_RDF}Alt"), f"{_RDF}li").text = title
    if part:
        ElementTree.SubElement(about, f"{_UA}part").text = part
    xml = ElementTree.tostring(packet, "unicode")
    c = {
        "Type": N("Catalog"), "Pages": pages_ref, "Metadata": m.add({"Type": N("Metadata"), "Subtype": N("XML")}, xml.encode()), "MarkInfo": {**({} if marked is None else {"Marked": marked}), **({"Suspects": True} if suspects else {})},
        **({"StructTreeRoot": root} if root else {}), **({"Lang": lang} if lang is not None else {}), **({} if display is None else {"ViewerPreferences": {"DisplayDocTitle": display}}), **({k: (v(m) if callable(v) else v) for k, v in (catalog or {}).items()}),
    }
    if outlines:
        c["Outlines"] = {"First": m.add({"Title": "One"})}
    m.put(cat, c)
    trailer = {"Root": cat, "ID": [b"0" * 16, b"0" * 16]}
    if info:
        trailer["Info"] = m.add({"Title": info})
    if encrypt:
        trailer["Encrypt"] = m.add(encrypt)
    return m.file(trailer)


def attrs(owner: str, **values) -> dict:
    return {"A": {"O": N(owner), **values}}


def table(*rows, **entries) -> E:
    """Rows of cells; a cell is a text (TD), or an element."""
    return E("Table", [E("TR", [c if isinstance(c, E) else E("TD", [T(c)] if c else []) for c in r]) for r in rows], entries)


def th(text: str, **table_attrs) -> E:
    entries = attrs("Table", **table_attrs) if table_attrs else {}
    return E("TH", [T(text)] if text else [], entries)


def clean() -> list:
    link = Annot("Link", entries={"Contents": "Home page"})
    return [
        E("H1", [T("A heading of the document")]),
        E("P", [T("A paragraph with a few words in it.")]),
        E("H2", [T("A section")]),
        E("Figure", [T("drawn")], {"Alt": "A photograph of a harbour at dawn"}),
        table([th("Name", Scope=N("Column")), th("Town", Scope=N("Column"))], ["Ann", "Oslo"], ["Bo", "Rome"]),
        E("L", [E("LI", [E("Lbl", [T("-")]), E("LBody", [T("an item")])]), E("LI", [E("LBody", [T("another item")])])]),
        E("Link", [T("our home page"), link]),
        E("Formula", [T("x")], {"Alt": "x equals two"}),
    ]
