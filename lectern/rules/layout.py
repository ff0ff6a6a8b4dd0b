"""Rules about order on the page, running lines and bookmarks."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import patterns
from ..functions import text as tx
from .base import boxes_in_order, findings, page_box, rule, say


@rule("ORD-001")
def order(t):
    """Of a key that is claimed twice the last claim counts."""
    w = Window.partitionBy("doc_id", "page").orderBy("ord", "seq")
    want = t.mcrefs.where("page is not null").join(t.tagged_docs.select("doc_id"), "doc_id", "left_semi").withColumn("rank", F.row_number().over(w)).groupBy("doc_id", "page", "stream", "mcid").agg(F.max("rank").alias("rank"), F.count("*").alias("n"))
    many = want.groupBy("doc_id", "page").agg(F.sum("n").alias("n")).where("n >= 4")
    painted = t.runs.select("doc_id", "page", "stream", "mcid", "paint_ord").unionByName(t.images.select("doc_id", "page", "stream", "mcid", "paint_ord")).where("mcid is not null").groupBy("doc_id", "page", "stream", "mcid").agg(F.min("paint_ord").alias("paint_ord"))
    a, b = want.alias("a"), painted.alias("b")
    both = a.join(b, (F.col("a.doc_id") == F.col("b.doc_id")) & (F.col("a.page") == F.col("b.page")) & (F.col("a.mcid") == F.col("b.mcid")) & F.col("a.stream").eqNullSafe(F.col("b.stream"))).select("a.doc_id", "a.page", "rank", "paint_ord")
    seq = both.join(many, ["doc_id", "page"], "left_semi").groupBy("doc_id", "page").agg(F.transform(F.sort_array(F.collect_list(F.struct("paint_ord", "rank"))), lambda x: x["rank"]).alias("seq")).where("size(seq) >= 4")
    bad = seq.withColumn("n", F.size("seq")).withColumn("kept", tx.longest_increasing("seq")).withColumn("share", F.col("kept") / F.col("n")).where("share < 0.8")
    g = bad.groupBy("doc_id").agg(F.count("*").alias("pages"), F.min_by(F.struct("page", "share", "n", "kept"), F.struct("share", "page")).alias("w"))
    x = F.col("w")
    s = lambda c: c.cast("string")
    return findings(g, say(s(F.col("pages")), " page(s) are painted out of tag order; on page ", s(x["page"] + 1), " ", s(x["n"] - x["kept"]), " of ", s(x["n"]), " sequences are out of place"), x["page"] + 1, F.col("pages"))


@rule("NAV-001")
def bookmarks(t):
    return findings(t.docs.where("n_pages >= 10 and coalesce(outline_count, 0) = 0"), say("a document of ", F.col("n_pages").cast("string"), " pages has no bookmarks"))


@rule("PAG-001")
def running_lines(t):
    need = F.when(F.col("n_pages") >= 6, 3).otherwise(F.col("n_pages"))
    h = F.coalesce(F.nullif("height", F.lit(0.0)), F.lit(792.0))
    ln = t.lines.where("tagged_share >= 0.8").join(t.pages.select("doc_id", "page", h.alias("h")), ["doc_id", "page"]).where("y0 >= 0.88 * h or y1 <= 0.12 * h").join(t.tagged_docs.where("n_pages >= 3"), "doc_id")
    ln = ln.withColumn("line", F.trim("text")).withColumn("number", F.col("line").rlike(patterns.BARE_NUMBER)).withColumn("key", tx.furniture_key(F.col("line"))).withColumn("at", F.struct("page", "line_no"))
    keys = ln.where("not number and length(key) >= 4").groupBy("doc_id", "key", "n_pages").agg(F.countDistinct("page").alias("n"), F.min("page").alias("p"), F.min("at").alias("at"), F.min_by("line", "at").alias("line"), F.min_by(page_box(), "at").alias("box")).where(F.col("n") >= need)
    lines = F.transform(F.sort_array(F.collect_list(F.struct("at", "line"))), lambda x: x["line"])
    a = keys.groupBy("doc_id", "n_pages").agg(F.count("*").alias("k"), F.min("p").alias("p"), lines.alias("lines"), boxes_in_order("at").alias("bx"))
    one = findings(a, say(F.col("k").cast("string"), " running line(s) are tagged on ", need.cast("string"), " pages or more"), F.col("p") + 1, F.col("k"), tx.sample(F.col("lines"), 3, 50), boxes=F.col("bx"))
    b = ln.where("number").groupBy("doc_id", "n_pages").agg(F.countDistinct("page").alias("n"), F.min("page").alias("p"), boxes_in_order("at", page_box()).alias("bx")).where(F.col("n") >= need)
    return one.unionByName(findings(b, say("page numbers are tagged on ", F.col("n").cast("string"), " of ", F.col("n_pages").cast("string"), " pages"), F.col("p") + 1, F.col("n"), boxes=F.col("bx")))
