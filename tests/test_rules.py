"""Every rule on a file with its defect and on the clean file; all files are audited in one run."""

import pytest
from pdfmaker import PLAIN, Annot, E, N, T, attrs, clean, font, make, table, th

from lectern.catalogue import CRITERIA, RULES

P = E("P", [T("Some plain words here.")])
LONG = "the quick brown fox jumps over the lazy dog while many other animals watch it from afar"
SENT = "This heading goes on for quite some time. It has more than one sentence in it. " + LONG


def p(text="Some plain words here.", **k):
    return E("P", [T(text, **k)])


def pages(n, make_texts):
    return [E("P", [t]) for i in range(n) for t in make_texts(i)]


def grid_lines():
    h = b"".join(b"72 %d 300 0.5 re f\n" % y for y in (500, 540, 580, 620))
    v = b"".join(b"%d 500 0.5 120 re f\n" % x for x in (72, 172, 272, 371))
    return b"/Artifact BMC\n" + h + v + b"EMC\n"


def doc_with_font(f):
    return make([p(), E("P", [T("abcdefgh", font="F2")])], fonts={"F2": f})


def truetype_cid(m):
    program = m.add({}, b"\0\1\0\0")
    inner = m.add({"Type": N("Font"), "Subtype": N("CIDFontType2"), "BaseFont": N("Cid"), "CIDSystemInfo": {"Registry": b"Adobe", "Ordering": b"Identity", "Supplement": 0}, "FontDescriptor": m.add({"Type": N("FontDescriptor"), "FontFile2": program})})
    to = m.add({}, b"1 begincodespacerange <0000> <ffff> endcodespacerange 1 beginbfrange <0000> <ffff> <0041> endbfrange")
    return m.add({"Type": N("Font"), "Subtype": N("Type0"), "BaseFont": N("Cid"), "Encoding": N("Identity-H"), "DescendantFonts": [inner], "ToUnicode": to})


def bare_font(m):
    return m.add({"Type": N("Font"), "Subtype": N("Type0"), "BaseFont": N("Bare"), "Encoding": N("Identity-H"), "DescendantFonts": [m.add({"Type": N("Font"), "Subtype": N("CIDFontType0"), "BaseFont": N("Bare")})]})


W = dict(entries={"Contents": "field", "FT": N("Tx"), "TU": "Your name", "T": "name"})
CASES = {
    "DOC-001": make(clean(), marked=None),
    "DOC-002": make(None, loose=[T("words", tagged=False)]),
    "DOC-003": make(clean(), suspects=True),
    "DOC-004": make(None, images={0: [((2000, 2600), (0, 0, 612, 792), b"")]}),
    "DOC-010": make(clean(), title=None, info="Only here"),
    "DOC-011": make(clean(), display=None),
    "DOC-012": make(clean(), part=None),
    "DOC-013": make(clean(), lang=None),
    "DOC-014": make(clean(), lang="english"),
    "DOC-015": make(clean(), info="Something else"),
    "DOC-021": make(clean(), catalog={"AcroForm": {"XFA": b"x"}}),
    "DOC-030": make(clean(), catalog={"OCProperties": {"D": {"AS": []}}}),
    "DOC-031": make(clean(), catalog={"Names": {"EmbeddedFiles": {"Names": ["a", {"F": "a.txt"}]}}}),
    "DOC-040": make(clean(), title="report.docx"),
    "TAG-001": make(clean(), loose=[T("bare words", tagged=False)]),
    "TAG-002": make(clean(), loose=[T(LONG, artifact=True)]),
    "TAG-004": make(clean(), raw={0: b"/Artifact BMC /Span <</MCID 0>> BDC EMC EMC\n"}),
    "TAG-010": make([*clean(), E("Odd", [T("odd content")])]),
    "TAG-011": make(clean(), role_map={"Up": "Down", "Down": "Up"}),
    "TAG-012": make(clean(), role_map={"P": "Span"}),
    "TAG-020": make([*clean(), E("P", [])]),
    "TAG-021": make([*clean(), E("P", [{"Type": N("MCR"), "MCID": 0}])]),
    "TAG-022": make([*clean(), E("P", [T("x"), ]), E("P", [T("", again=True)])]),
    "TAG-023": make(clean(), no_parent=True),
    "TAG-030": make([*clean(), E("Figure", [T(LONG + " " + LONG, size=4)], {"Alt": "A page", "Pg": 0, **attrs("Layout", BBox=[0, 0, 612, 792])})]),
    "TAG-031": make([*clean(), E("P", [T(LONG)], {"Alt": "short"})]),
    "TAG-032": make([*clean(), E("P", [T("an ordinary sentence")], {"ActualText": "qqqq zzzz vvvv kkkk wwww"})]),
    "TAG-040": make(clean(), extra_forms={"Far": {"Ref": {"F": "other.pdf"}}}),
    "TXT-001": doc_with_font(lambda m: m.add({"Type": N("Font"), "Subtype": N("Type1"), "BaseFont": N("Helvetica"), "Encoding": N("WinAnsiEncoding")})),
    "TXT-002": doc_with_font(bare_font),
    "TXT-003": doc_with_font(lambda m: font(m, {97: "a"}, {"Encoding": {"Differences": [97, N("nosuchglyph"), N("nosuchtoo"), N("c")]}})),
    "TXT-004": make(clean(), cmap={**PLAIN, **{i: "e" for i in range(97, 110)}}),
    "TXT-005": doc_with_font(lambda m: font(m, PLAIN, codes="abc")),
    "TXT-006": make(clean(), cmap={**PLAIN, 97: "﻿"}),
    "TXT-007": make([p(), E("P", [T("\0A\0B", font="F2")])], fonts={"F2": truetype_cid}),
    "TXT-010": make([E("P", [T(LONG, mode=3, size=6)])]),
    "TXT-011": make(clean(), loose=[T("words in a form", tagged=False, form=True)]),
    "HDG-001": make([E("H1", [T("One")]), p(), E("H3", [T("Three")])]),
    "HDG-002": make([E("H2", [T("Two")]), p()]),
    "HDG-003": make([E("H1", [T("One")]), E("H", [T("Other")])]),
    "HDG-005": make([E("Sect", [E("H", [T("One")]), E("H", [T("Two")])])]),
    "HDG-010": make([E("H1", [T("Dear reader")]), p()]),
    "HDG-011": make([E("H1", [T(SENT, size=3)]), p()]),
    "HDG-012": make(pages(5, lambda i: [T(LONG + " " + LONG + " " + LONG, page=i, size=3, y=400)]), n_pages=5),
    "TBL-001": make([p(), table(["one", "two"], ["three", "four"])]),
    "TBL-002": make([p(), table([th("a"), th("b")], ["c", "d"])]),
    "TBL-003": make([p(), E("Table", [E("TD", [T("loose")])])]),
    "TBL-004": make([p(), table([th("a", Scope=N("Column")), "b", "c"], ["d", "e"])]),
    "TBL-005": make([p(), E("Table", [E("P", [T("stray")]), E("TR", [th("a", Scope=N("Column")), E("TD", [T("b")])])])]),
    "TBL-010": make([p(), table(*[[th("One"), th("Two")] for _ in range(4)], ["a", "b"])]),
    "TBL-011": make([p(), table([E("TH", [], {"ID": "h", **attrs("Table", Scope=N("Column"))})], [E("TD", [T("x")], attrs("Table", Headers=["h"]))])]),
    "TBL-012": make([p(), table([th("a", Scope=N("Column")), *[""] * 2], [*[""] * 2, "b"])]),
    "TBL-013": make([E("Sect", [E("Table", [E("TR", [th(n, Scope=N("Column")), E("TD", [T(n, x=x, y=600)])])], {"Pg": 0}) for n, x in (("left", 72), ("right", 110))])]),
    "TBL-014": make([E("P", [T(f"some words number {i} here", x=80 + 100 * (i % 2), y=510 + 20 * i, size=6)]) for i in range(5)], raw={0: grid_lines()}),
    "TBL-015": make([p(), table([th("a", Scope=N("Column")), "b", "c"], ["d", "e", "f"], ["four words in here"], ["again four words here"])]),
    "LST-001": make([p(), E("LI", [E("LBody", [T("x")])])]),
    "LST-002": make([p(), E("L", [E("LI", [T("x")])])]),
    "LST-003": make([p(), E("L", [E("P", [T("x")])])]),
    "LST-004": make([p(), E("L", [E("LI", [E("LBody", [T("x")]), E("L", [E("LI", [E("LBody", [T("y")])])])])])]),
    "FIG-001": make([p(), E("Figure", [T("x")])]),
    "FIG-002": make([p(), E("Figure", [T("x")], {"Alt": "  "})]),
    "FIG-010": make([p(), E("Figure", [T("x")], {"Alt": "image 12"})]),
    "FIG-011": make([p(), E("Figure", [T("x"), E("Caption", [T("A busy harbour")])], {"Alt": "a busy  HARBOUR"})]),
    "FIG-012": make([p(), E("Figure", [T("x")], {"Alt": "1234 5678 #### ab"})]),
    "LNK-001": make(clean(), annots=[Annot("Link", entries={"Contents": "c"})]),
    "LNK-002": make([p(), E("Link", [T("x"), Annot("Link")])]),
    "LNK-003": make([p(), E("Link", [Annot("Link", entries={"Contents": "c"})])]),
    "LNK-004": make([p(), E("Link", [T("x"), Annot("Link", entries={"Contents": "c"}, flags=0)])]),
    "LNK-005": make(clean(), tabs=None),
    "LNK-006": make(clean(), annots=[Annot("Text", entries={"Contents": "c"})]),
    "LNK-010": make([p("write to someone@example.org today")]),
    "FRM-001": make([p(), E("Form", [Annot("Widget", entries={"FT": N("Tx")})])]),
    "FRM-002": make([p(), E("Form", [Annot("Widget", entries={"FT": N("Tx"), "TU": "Text1"})])]),
    "FRM-003": make([p()], annots=[Annot("Widget", **W)]),
    "NOTE-001": make([p(), E("Note", [E("Lbl", [T("1")]), T("a note")])]),
    "NOTE-002": make([p(), E("Reference", [T("7")]), E("Note", [E("Lbl", [T("1")]), T("a note")], {"ID": "n"})]),
    "NOTE-003": make([p(), E("Note", [T("Footnote text that has no label")], {"ID": "n"})]),
    "NOTE-004": make([p(), *[E("Note", [E("Lbl", [T(str(i))]), T("a note")], {"ID": "n"}) for i in (1, 2)]]),
    "MATH-001": make([p(), E("Formula", [T("x")])]),
    "MATH-010": make([p(), E("Formula", [T("x")], {"Alt": "\\frac{1}{2}"})]),
    "MATH-011": make([p(), E("Formula", [T(LONG)], {"Alt": "x"})]),
    "ORD-001": make([E("P", [T(f"line {i}")]) for i in range(8)], order=lambda t: t.y),
    "NAV-001": make(pages(10, lambda i: [T("words", page=i)]), n_pages=10),
    "PAG-001": make(pages(4, lambda i: [T(f"body {i} {'abcd'[i] * 4}", page=i), T("Running footer", page=i, y=30)]), n_pages=4),
}
SILENT = {
    "TAG-002": make(pages(4, lambda i: [T("body text", page=i)]), loose=[T(LONG, page=i, y=30, artifact=True, size=4) for i in range(4)], n_pages=4),
    "NAV-001": make(pages(10, lambda i: [T("words", page=i)]), n_pages=10, outlines=True),
    "DOC-014": make(clean(), lang="de-AT"),
    "TXT-004": make(clean()),
    "HDG-001": make([E("H1", [T("One")]), E("H2", [T("Two")]), E("H1", [T("Three")])]),
}


def nested(rows, depth):
    """A table whose rows lie in row groups, each in another one."""
    for k in range(depth):
        rows = [E(("TBody", "THead", "TFoot")[k % 3], rows)]
    return make([p(), E("Table", rows)])


ROWS = [E("TR", [E("TD", [T("one")]), E("TD", [T("two")])]), E("TR", [E("TD", [T("three")]), E("TD", [T("four")])])]
DEEP = {f"deep {k}": nested(ROWS, k) for k in (0, 1, 4, 6, 20)}


@pytest.fixture(scope="module")
def audit(spark, tmp_path_factory):
    from lectern.api import check

    d = tmp_path_factory.mktemp("pdf")
    for name, data in {"clean": make(clean()), "untitled": make([p()], lang="x"), **DEEP, **CASES}.items():
        (d / f"{name}.pdf").write_bytes(data)
    for name, data in SILENT.items():
        (d / f"not {name}.PDF").write_bytes(data)
    (d / "broken.pdf").write_bytes(b"no pdf at all")
    r = check(spark, [str(d), str(d / "gone.pdf")])
    rows = r.results.select("doc_id", "path", "verdict", "error", "errors", "warnings").collect()
    names = {x["doc_id"]: x["path"].rsplit("/", 1)[1][:-4] for x in rows}
    found = {}
    for f in r.ordered.collect():
        found.setdefault(names[f["doc_id"]], []).append(f)
    runs = {}
    for x in r.runs.collect():
        runs.setdefault(names[x["doc_id"]], {})[x["rule"]] = x
    crit = {}
    for x in r.criteria.collect():
        crit.setdefault(names[x["doc_id"]], {})[x["framework"], x["id"]] = x
    return {"r": r, "results": {names[x["doc_id"]]: x for x in rows}, "found": found, "runs": runs, "criteria": crit}


def test_clean_file_passes(audit):
    assert [(f["rule"], f["message"]) for f in audit["found"].get("clean", [])] == []
    assert audit["results"]["clean"]["verdict"] == "pass"
    assert not audit["r"].crashed


@pytest.mark.parametrize("rule", sorted(CASES))
def test_defect_is_found(audit, rule):
    assert rule in {f["rule"] for f in audit["found"].get(rule, [])}, [(f["rule"], f["message"]) for f in audit["found"].get(rule, [])]


def test_rows_below_nested_groups_are_seen(audit):
    """TBL-001 sees the two rows and four cells at any depth of row groups."""
    for name in DEEP:
        assert [f["message"] for f in audit["found"][name] if f["rule"] == "TBL-001"] == ["a table of 2 row(s) and 4 cells has no header cell"], name


@pytest.mark.parametrize("rule", sorted(SILENT))
def test_sound_file_is_left_alone(audit, rule):
    assert rule not in {f["rule"] for f in audit["found"].get(f"not {rule}", [])}


def test_every_rule_has_a_run(audit):
    for name, runs in audit["runs"].items():
        assert len(runs) == len(RULES), name
    assert audit["runs"]["clean"]["HDG-004"]["status"] == "not-implemented"
    assert audit["runs"]["untitled"]["TBL-001"]["status"] == "not-applicable"
    assert audit["runs"]["clean"]["SEM-001"]["status"] == "skipped"
    assert audit["runs"]["clean"]["TAG-003"]["status"] == "skipped"


def test_unreadable(audit):
    assert audit["results"]["broken"]["verdict"] == "unreadable"
    assert audit["results"]["gone"]["error"] == "no such file"
    assert "broken" not in audit["runs"]
    assert audit["r"].exit_code() == 2


def test_criteria(audit):
    for name, rows in audit["criteria"].items():
        assert len(rows) == len(CRITERIA), name
    def status(name, *key):
        return audit["criteria"][name][key]["status"]

    assert status("FIG-001", "wcag22", "1.1.1") == status("FIG-001", "pdfua1", "13") == "fail"
    # A blank alternative is a matter of meaning: the criterion fails, the checkpoint doesn't.
    assert (status("FIG-002", "wcag22", "1.1.1"), status("FIG-002", "pdfua1", "13")) == ("fail", "pass")
    assert status("clean", "wcag22", "1.2.4") == "not-applicable"


def test_reports(audit, spark, tmp_path):
    import json

    from lectern import sinks
    from lectern.api import Results
    from pyspark.sql import functions as F

    r = audit["r"]
    few = [x["doc_id"] for x in r.results.collect() if x["path"].endswith(("FIG-001.pdf", "broken.pdf"))]
    small = Results(r.facts, r.findings.where(F.col("doc_id").isin(few)), r.runs)
    small.__dict__["results"] = r.results.where(F.col("doc_id").isin(few))
    small.__dict__["criteria"] = r.criteria
    got = json.loads(sinks.json_report(small))
    assert {x["verdict"] for x in got["results"]} == {"fail", "unreadable"}
    log = json.loads(sinks.sarif_report(small))["runs"][0]
    assert {x["ruleId"] for x in log["results"]} >= {"FIG-001", "unreadable"}
    assert "FIG-001" in sinks.html_report(small) and "FIG-001" in sinks.text_report(small, criteria=True)
    view = sinks.viewer_payload(small, next(d for d in few if audit["runs"] and d in {x["doc_id"] for x in small.findings.collect()}))
    assert view["tree"] and view["reading_order"]
    sinks.write_json_lines(small, str(tmp_path / "lines"))
    assert spark.read.text(str(tmp_path / "lines")).count() == 2
    assert "TBL-001" in sinks.rules_document() and sinks.rule_list().count("\n") == 91


def test_no_file_is_read_twice(spark, tmp_path):
    from lectern.sources.files import binary_files

    (tmp_path / "in").mkdir()
    for name in ("a.pdf", "in/b.PDF", "in/c.txt"):
        (tmp_path / name).write_bytes(b"x")
    d = str(tmp_path)
    df = binary_files(spark, [d, f"{d}/a.pdf", f"{d}/in", f"{d}/in/", d, f"{d}/in/c.txt", f"{d}/gone.pdf", f"{d}/gone.pdf"])
    assert sorted((r["path"][len(d) + 1 :], r["content"] is None) for r in df.collect()) == [("a.pdf", False), ("gone.pdf", True), ("in/b.PDF", False), ("in/c.txt", False)]
    assert "Exchange" not in df._jdf.queryExecution().executedPlan().toString()
    assert binary_files(spark, []).count() == 0


def test_shared_tables_lie_by_document(audit):
    """Joins by document and element don't shuffle, and closing drops the tables."""
    from lectern.sources.shared import co_located

    f = audit["r"].facts
    with co_located(f.spark):
        plan = f.told.join(f.parents, ["doc_id", "ord"]).groupBy("doc_id", "type").count()._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan


def test_selection_and_source(spark, tmp_path):
    from lectern.api import check

    (tmp_path / "a.pdf").write_bytes(make([p("hello")]))
    (tmp_path / "b.pdf").write_bytes(make(clean()))
    r = check(spark, [str(tmp_path / "a.pdf")], source=str(tmp_path / "b.pdf"), only=["SEM-001", "SEM-002", "DOC-001"])
    assert {f["rule"] for f in r.findings.collect()} == {"SEM-001", "SEM-002"}
    assert r.runs.count() == 3 and r.results.count() == 1
    r.close()
    assert not r.facts.shelf.tables
    with pytest.raises(KeyError):
        check(spark, [], only=["XXX-001"])
