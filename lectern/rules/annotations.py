"""Rules about links, other annotations and form fields."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import patterns
from ..functions import text as tx
from .base import all_of, boxes_in_order, findings, page_box, rule, say, texts_in_order

PRINT, HIDDEN, NOVIEW = 4, 2, 32

def _annots(t):
    a = t.annotations
    return a.withColumns({"l": F.least("x0", "x1"), "b": F.least("y0", "y1"), "r": F.greatest("x0", "x1"), "u": F.greatest("y0", "y1")})


def _tagged(t):
    return _annots(t).join(t.tagged_docs.select("doc_id"), "doc_id", "left_semi")


def _unowned(t, annots, owners):
    """Annotations whose key no row of ``owners`` has; direct objects have no key and no owner."""
    return annots.join(owners.select("doc_id", "key").distinct(), ["doc_id", "key"], "left_anti")


def _report(bad, message, evidence=None, rect=False):
    plain = F.struct((F.col("page") + 1).alias("page"), *[F.bround(c, 1).alias(n) for c, n in (("l", "x0"), ("b", "y0"), ("r", "x1"), ("u", "y1"))])
    g = bad.groupBy("doc_id").agg(
        F.count("*").alias("n"), F.min_by("page", "seq").alias("p"), F.sort_array(F.collect_set("subtype")).alias("kinds"), boxes_in_order("seq", plain).alias("bx"),
        F.min_by(F.concat_ws(", ", *[F.bround(c, 1).cast("string") for c in ("x0", "y0", "x1", "y1")]), "seq").alias("rect"), (F.lit(None).cast("string") if evidence is None else evidence).alias("ev"),
    )
    return findings(g, message(F.col("n").cast("string"), F.concat_ws(", ", "kinds")), F.col("p") + 1, F.col("n"), F.col("ev"), location=F.create_map(F.lit("rect"), F.col("rect")) if rect else None, boxes=F.col("bx"))


@rule("LNK-001")
def untagged_links(t):
    bad = _unowned(t, _tagged(t).where("subtype = 'Link' and not hidden"), t.owners.where("type = 'Link'"))
    return _report(bad, lambda n, _: say(n, " link annotation(s) aren't in a Link element"), rect=True)


@rule("LNK-002")
def undescribed(t):
    bad = _annots(t).where("not hidden and subtype not in ('Widget', 'Popup')").where(tx.blank(F.col("contents")))
    bad = _unowned(t, bad, t.owners.where(~tx.blank(F.col("alt"))))
    return _report(bad, lambda n, k: say(n, " annotation(s) have no contents, and their element no alternative (", k, ")"), rect=True)


@rule("LNK-003")
def nameless(t):
    return all_of(t.told.where("type = 'Link'").where(tx.blank(F.col("alt")) & tx.blank(F.col("text"))), lambda n: say(n.cast("string"), " link(s) have no text and no alternative"))


@rule("LNK-004")
def flags(t):
    f = F.coalesce("flags", F.lit(0))
    a = _annots(t).withColumn("f", f)
    one = _report(a.where("not hidden and subtype <> 'Popup'").where(F.col("f").bitwiseAND(PRINT) == 0), lambda n, _: say(n, " annotation(s) aren't printed"))
    two = _report(a.where((F.col("f").bitwiseAND(NOVIEW) != 0) & (F.col("f").bitwiseAND(HIDDEN) == 0)), lambda n, _: say(n, " annotation(s) are announced but not shown"))
    return one.unionByName(two)


@rule("LNK-005")
def tab_order(t):
    bad = t.pages.where("coalesce(tabs, '') <> 'S'").join(t.annotations.select("doc_id", "page"), ["doc_id", "page"], "left_semi")
    g = bad.groupBy("doc_id").agg(F.count("*").alias("n"), F.sort_array(F.collect_list("page")).alias("p"))
    return findings(g, say(F.col("n").cast("string"), " page(s) with annotations don't set Tabs to S"), F.get("p", F.lit(0)) + 1, F.col("n"), F.concat_ws(", ", F.transform(F.slice("p", 1, 8), lambda x: (x + 1).cast("string"))))


@rule("LNK-006")
def untagged_annotations(t):
    bad = _unowned(t, _tagged(t).where("subtype not in ('Link', 'Widget', 'PrinterMark', 'Popup') and not hidden"), t.owners.where("type = 'Annot'"))
    return _report(bad, lambda n, k: say(n, " annotation(s) aren't in an Annot element (", k, ")"))


@rule("LNK-010")
def unlinked(t):
    r = t.runs.where("not artifact").withColumn("found", F.regexp_extract("text", patterns.ADDRESS, 1)).where("found <> ''").withColumn("found", F.regexp_replace("found", r"[.,;)]+$", ""))
    a = _annots(t).where("subtype = 'Link'").select(F.col("doc_id").alias("d"), F.col("page").alias("p"), "l", "b", "r", "u")
    bad = r.join(a, (F.col("doc_id") == F.col("d")) & (F.col("page") == F.col("p")) & F.expr("x1 > l and x0 < r and y1 > b and y0 < u"), "left_anti")
    g = bad.groupBy("doc_id", "page").agg(F.array_distinct(F.transform(F.sort_array(F.collect_list(F.struct("run_seq", "found"))), lambda x: x["found"])).alias("u"), boxes_in_order("run_seq", page_box()).alias("bx"))
    return findings(g, say(F.size("u").cast("string"), " address(es) are printed without a link"), F.col("page") + 1, F.size("u"), tx.sample(F.col("u"), 3, 40), boxes=F.col("bx"))


def _widgets(t):
    return _annots(t).where("subtype = 'Widget'")


@rule("FRM-001")
def unnamed(t):
    bad = _widgets(t).where("not hidden").where(tx.blank(F.col("field_tu")))
    return _report(bad, lambda n, _: say(n, " form field(s) have no name for readers"), texts_in_order("seq", F.coalesce("field_t", F.lit("?")), 4, 20))


@rule("FRM-002")
def generated_names(t):
    bad = _widgets(t).where(~tx.blank(F.col("field_tu"))).where(F.trim("field_tu").rlike(patterns.GENERATED))
    return _report(bad, lambda n, _: say(n, " form field(s) have a generated id for a name"), texts_in_order("seq", "field_tu", 4, 20))


@rule("FRM-003")
def untagged_fields(t):
    bad = _unowned(t, _tagged(t).where("subtype = 'Widget' and not hidden"), t.owners.where("type = 'Form'"))
    return _report(bad, lambda n, _: say(n, " form field(s) aren't in a Form element"))
