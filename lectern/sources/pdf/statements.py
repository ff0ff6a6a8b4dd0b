"""Statements: a PDF file a row, whose defects follow from the row's key, for queries and benchmarks of the whole audit."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..shared import spread
from .maker import Annot, E, N, T, make, table, th

#: What make() is told where a key has the defect.
SETTINGS = {
    "DOC-001": {"marked": None}, "DOC-003": {"suspects": True}, "DOC-010": {"title": None}, "DOC-011": {"display": None}, "DOC-012": {"part": None}, "DOC-013": {"lang": None}, "DOC-014": {"lang": "english"},
    "DOC-040": {"title": "report.docx"}, "LNK-005": {"tabs": None},
}
#: Blocks that are added to a statement; made anew for each, as drawing marks their texts.
BLOCKS = {
    "FIG-001": lambda: E("Figure", [T("bars")]),
    "FIG-002": lambda: E("Figure", [T("bars")], {"Alt": "  "}),
    "FIG-010": lambda: E("Figure", [T("bars")], {"Alt": "image 12"}),
    "FIG-012": lambda: E("Figure", [T("bars")], {"Alt": "1234 5678 #### ab"}),
    "TBL-001": lambda: table(["one", "two"], ["three", "four"]),
    "TBL-002": lambda: table([th("a"), th("b")], ["c", "d"]),
    "TBL-004": lambda: table([th("a", Scope=N("Column")), "b", "c"], ["d", "e"]),
    "TBL-012": lambda: table([th("a", Scope=N("Column")), "", ""], ["", "", "b"]),
    "LST-001": lambda: E("LI", [E("LBody", [T("loose")])]),
    "LST-002": lambda: E("L", [E("LI", [T("bare")])]),
    "LST-003": lambda: E("L", [E("P", [T("no item")])]),
    "HDG-001": lambda: E("H4", [T("Deep")]),
    "HDG-010": lambda: E("H2", [T("Dear reader")]),
    "LNK-002": lambda: E("Link", [T("there"), Annot("Link")]),
    "LNK-010": lambda: E("P", [T("write to someone@example.org today")]),
    "NOTE-001": lambda: E("Note", [E("Lbl", [T("1")]), T("a note")]),
    "NOTE-003": lambda: E("Note", [T("Footnote text that has no label")], {"ID": "n"}),
    "MATH-001": lambda: E("Formula", [T("x")]),
    "MATH-010": lambda: E("Formula", [T("x")], {"Alt": "\\frac{1}{2}"}),
    "TAG-010": lambda: E("Odd", [T("odd content")]),
    "TAG-020": lambda: E("P", []),
    "TAG-021": lambda: E("P", [{"Type": N("MCR"), "MCID": 0}]),
    "TAG-032": lambda: E("P", [T("an ordinary sentence")], {"ActualText": "qqqq zzzz vvvv kkkk wwww"}),
}
#: Rule: (modulus, remainder, weight): keys with that remainder have the defect, which counts so often.
DEFECTS = {
    "DOC-001": (6, 0, 1), "DOC-003": (11, 0, 1), "DOC-010": (5, 0, 1), "DOC-011": (3, 0, 1), "DOC-012": (4, 0, 1), "DOC-013": (7, 0, 1), "DOC-014": (7, 1, 1), "DOC-040": (5, 1, 1),
    "FIG-001": (8, 2, 1), "FIG-002": (9, 3, 1), "FIG-010": (10, 4, 1), "FIG-012": (11, 5, 1), "TBL-001": (6, 1, 1), "TBL-002": (7, 2, 2), "TBL-004": (8, 3, 1), "TBL-012": (9, 4, 1),
    "LST-001": (10, 5, 1), "LST-002": (11, 6, 1), "LST-003": (12, 7, 1), "HDG-001": (5, 2, 1), "HDG-010": (6, 3, 1), "LNK-002": (7, 4, 1), "LNK-010": (8, 5, 1),
    "NOTE-001": (9, 6, 1), "NOTE-003": (10, 7, 1), "MATH-001": (11, 8, 1), "MATH-010": (12, 9, 1), "TAG-010": (5, 3, 1), "TAG-020": (6, 4, 1), "TAG-021": (7, 5, 1), "TAG-032": (8, 6, 1),
}


def statement(key: int, name: str) -> bytes:
    """One key's file: a heading, a paragraph and a sound figure, table and list, then the blocks of its defects."""
    mine = [r for r, (m, rest, _) in DEFECTS.items() if key % m == rest]
    settings = {"title": f"Statement of {name}"} | {k: v for r in mine for k, v in SETTINGS.get(r, {}).items()}
    tree = [
        E("H1", [T(f"Statement of {name}")]), E("P", [T("A paragraph with a few words in it.")]), E("Figure", [T("drawn")], {"Alt": "A photograph of a harbour at dawn"}),
        table([th("Name", Scope=N("Column")), th("Town", Scope=N("Column"))], ["Ann", "Oslo"], ["Bo", "Rome"]), E("L", [E("LI", [E("Lbl", [T("-")]), E("LBody", [T("an item")])])]),
        *[BLOCKS[r]() for r in mine if r in BLOCKS],
    ]
    return make(tree, size=(612, 1584), **settings)


def statements(rows: DataFrame, key: Column, name: Column, folder: str) -> DataFrame:
    """(doc_id, path, content) of a statement for each row, made and read by all cores."""

    def apply(batches):
        schema = pa.schema([("path", pa.string()), ("content", pa.binary())])
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                keys, names = (c[at : at + 256].to_pylist() for c in batch.columns)
                yield pa.RecordBatch.from_arrays([pa.array([f"{folder}/{k}.pdf" for k in keys]), pa.array([statement(k, n or "") for k, n in zip(keys, names)], pa.binary())], schema=schema)

    made = spread(rows.select(key.cast("bigint").alias("key"), name), "key").mapInArrow(apply, "path string, content binary")
    return made.select(F.xxhash64("path").alias("doc_id"), "path", "content")


__all__ = ["DEFECTS", "statement", "statements"]
