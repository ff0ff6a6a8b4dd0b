"""Registration of rules and the shapes that findings come in."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..catalogue import BY_ID
from ..functions import text as tx
from ..plans.facts import MAX_BOXES, Facts, box
from ..schema import BOX, FINDING_COLUMNS

BUILDERS: dict[str, Callable[[Facts], DataFrame]] = {}
MODULES = ("document", "tagging", "fonts", "structure", "tables", "annotations", "layout", "compare")


def rule(rule_id: str):
    """Register a builder for a catalogue rule. An unknown id is a KeyError, a second builder a ValueError."""
    if rule_id not in BY_ID:
        raise KeyError(rule_id)

    def register(fn):
        if rule_id in BUILDERS:
            raise ValueError(f"{rule_id} has a builder already")
        BUILDERS[rule_id] = fn
        fn.rule_id = rule_id
        return fn

    return register


def builders() -> dict[str, Callable[[Facts], DataFrame]]:
    for m in MODULES:
        importlib.import_module(f"{__package__}.{m}")
    return BUILDERS


def _lit(x):
    return x if isinstance(x, Column) else F.lit(x)


def findings(df: DataFrame, message, page=None, count=1, evidence=None, severity=None, location=None, boxes=None) -> DataFrame:
    """A finding for each row of ``df``; severity null leaves it to the catalogue."""
    return df.select(
        "doc_id",
        F.lit(None).cast("string").alias("rule"),
        _lit(severity).cast("string").alias("severity"),
        _lit(message).cast("string").alias("message"),
        _lit(page).cast("int").alias("page"),
        (F.lit(None) if location is None else location).cast("map<string,string>").alias("location"),
        _lit(evidence).cast("string").alias("evidence"),
        _lit(count).cast("int").alias("count"),
        F.coalesce(F.lit(None) if boxes is None else boxes, F.array()).cast(f"array<{BOX}>").alias("boxes"),
    ).select(*FINDING_COLUMNS)


def say(*parts) -> Column:
    return F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in parts])


def boxes_in_order(order: Column | str, b: Column | str = "box") -> Column:
    """The first boxes of a group, in order."""
    b = F.col(b) if isinstance(b, str) else b
    packed = F.sort_array(F.collect_list(F.when(b.isNotNull(), F.struct(_col(order).alias("o"), b.alias("b")))))
    return F.slice(F.transform(packed, lambda x: x["b"]), 1, MAX_BOXES)


def _col(c):
    return F.col(c) if isinstance(c, str) else c


def texts_in_order(order, text, n: int = 3, width: int = 60, where: Column | None = None) -> Column:
    """The first n texts of a group joined for a finding's evidence; null where there is none."""
    item = F.struct(_col(order).alias("o"), _col(text).alias("t"))
    packed = F.sort_array(F.collect_list(item if where is None else F.when(where, item)))
    return F.nullif(tx.sample(F.transform(packed, lambda x: x["t"]), n, width), F.lit(""))


def all_of(bad: DataFrame, message: Callable[[Column], Column], evidence: Column | None = None, order: str = "ord") -> DataFrame:
    """One finding a document for all its bad elements (columns find_page, path, box): page and path of the first, their number, their boxes."""
    g = bad.groupBy("doc_id").agg(
        F.count("*").alias("n"),
        F.min_by("find_page", order).alias("p"),
        F.min_by("path", order).alias("first"),
        boxes_in_order(order).alias("bx"),
        (F.lit(None).cast("string") if evidence is None else evidence).alias("ev"),
    )
    return findings(g, message(F.col("n")), F.col("p"), F.col("n"), F.col("ev"), location=F.create_map(F.lit("first"), F.col("first")), boxes=F.col("bx"))


def each_of(bad: DataFrame, message, evidence=None, count=1, severity=None) -> DataFrame:
    """One finding for each bad element."""
    return findings(bad, message, F.col("find_page"), count, evidence, severity, F.create_map(F.lit("element"), F.col("path")), F.when(F.col("box").isNotNull(), F.array("box")))


def page_box(x0="x0", y0="y0", x1="x1", y1="y1", page="page") -> Column:
    return box(*[_col(c) for c in (page, x0, y0, x1, y1)])
