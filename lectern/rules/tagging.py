"""Rules about what is tagged, and how tags relate to content."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..catalogue import STANDARD_TYPES
from ..functions import patterns
from ..functions import text as tx
from .base import all_of, boxes_in_order, each_of, findings, page_box, rule, say, texts_in_order

GROUPING = "Art Div Document Figure Form Formula Index L LI Link NonStruct Part Private Sect TBody TD TFoot TH THead TOC TR Table".split()
DENSE = 1000


def untagged(df):
    return df.where("mcid is null and not artifact")


@rule("TAG-001")
def untagged_content(t):
    runs = untagged(t.runs).where("not in_form").where(~tx.blank(F.col("text")))
    r = runs.groupBy("doc_id", "page").agg(F.count("*").alias("n_runs"), texts_in_order("run_seq", "text").alias("ev"), boxes_in_order("run_seq", page_box()).alias("bx"))
    i = untagged(t.images).where("not in_form").groupBy("doc_id", "page").agg(F.count("*").alias("n_images"), F.min_by("name", "paint_ord").alias("image"), boxes_in_order("paint_ord", page_box()).alias("ibx"))
    p = untagged(t.paths).where("stroked or filled").groupBy("doc_id", "page").agg(F.count("*").alias("n_paths"), boxes_in_order("paint_ord", page_box()).alias("pbx"))
    g = r.join(i, ["doc_id", "page"], "full").join(p, ["doc_id", "page"], "full").join(t.tagged_docs.select("doc_id"), "doc_id", "left_semi")
    n = lambda c: F.coalesce(c, F.lit(0))
    both = n("n_runs") + n("n_images")
    parts = F.concat_ws(", ", *[F.when(n(c) > 0, say(F.col(c).cast("string"), w)) for c, w in (("n_runs", " text run(s)"), ("n_images", " image(s)"), ("n_paths", " path(s)"))])
    where = F.create_map(*[x for c in ("n_runs", "n_images", "n_paths") for x in (F.lit(c), n(c).cast("string"))])
    empty = F.array().cast("array<struct<page:int,x0:double,y0:double,x1:double,y1:double>>")
    boxes = F.slice(F.concat(*[F.coalesce(c, empty) for c in ("bx", "ibx", "pbx")]), 1, 40)
    return findings(g, say(parts, " neither tagged nor artifact"), F.col("page") + 1, F.greatest(both, F.lit(1)), F.coalesce("ev", "image"), F.when(both == 0, "warning"), where, boxes)


@rule("TAG-002")
def hidden_prose(t):
    ln = t.lines.where("artifact_share >= 0.8").where(~F.col("text").rlike(patterns.NUMBERISH)).join(t.tagged_docs.select("doc_id"), "doc_id", "left_semi")
    ln = ln.withColumn("key", tx.furniture_key(F.col("text"))).join(t.furniture, ["doc_id", "key"], "left_anti")
    ln = ln.withColumn("w", tx.words(tx.nfkc("text"))).where("size(w) >= 8").where(F.size(F.filter("w", lambda w: w.rlike(r"^\p{Ll}"))) >= 4)
    g = ln.groupBy("doc_id", "page").agg(F.count("*").alias("n"), texts_in_order("line_no", "text", 2, 90).alias("ev"), boxes_in_order("line_no", page_box()).alias("bx"))
    return findings(g, say(F.col("n").cast("string"), " line(s) of prose are artifacts, which no reader announces"), F.col("page") + 1, F.col("n"), F.col("ev"), boxes=F.col("bx"))


@rule("TAG-003")
def silent_words(t):
    """Needs the words of another extractor (``witness_words``); without them nothing is found and the run counts as skipped."""
    blob = lambda c: F.regexp_replace(F.lower(tx.nfkc(F.concat_ws(" ", F.collect_list(c)))), r"[\s]+", "")
    told = F.col("mcid").isNotNull() & ~F.col("artifact")
    alts = t.el.where("page is not null").select("doc_id", "page", F.explode(F.array("alt", "actual_text")).alias("text")).where("text is not null").withColumn("told", F.lit(True))
    said = t.runs.select("doc_id", "page", "text", told.alias("told")).unionByName(alts)
    blobs = said.groupBy("doc_id", "page").agg(blob(F.col("text")).alias("blob"))
    dense = t.paths.groupBy("doc_id", "page").agg(F.count("*").alias("n")).where(F.col("n") > DENSE)
    w = t.witness_words.join(t.tagged_docs.select("doc_id"), "doc_id", "left_semi").join(dense, ["doc_id", "page"], "left_anti")
    keys = w.groupBy("doc_id", "page", "line_no").agg(tx.furniture_key(F.concat_ws(" ", F.transform(F.sort_array(F.collect_list(F.struct("word_no", "text"))), lambda x: x["text"]))).alias("key"))
    running = keys.join(t.furniture, ["doc_id", "key"], "left_semi")
    w = w.join(running, ["doc_id", "page", "line_no"], "left_anti").join(blobs, ["doc_id", "page"], "left")
    new = F.filter(tx.words(tx.nfkc("text")), lambda x: (F.length(x) >= 3) & ~F.coalesce(F.col("blob"), F.lit("")).contains(F.lower(x)))
    w = w.withColumn("new", new).where("size(new) > 0").withColumn("cx", F.expr("(x0 + x1) / 2")).withColumn("cy", F.expr("(y0 + y1) / 2"))
    p = t.runs.where(~tx.blank(F.col("text"))).select("doc_id", "page", *[F.col(c).alias(f"r_{c}") for c in ("x0", "y0", "x1", "y1")])
    w = w.join(p, (w["doc_id"] == p["doc_id"]) & (w["page"] == p["page"]) & F.expr("cx between r_x0 - 2 and r_x1 + 2 and cy between r_y0 - 2 and r_y1 + 2"), "left_anti")
    ordered = F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("line_no", "word_no", "new"))), lambda x: x["new"]))
    g = w.groupBy("doc_id", "page").agg(ordered.alias("missing"), boxes_in_order(F.struct("line_no", "word_no"), page_box()).alias("bx")).where("size(missing) >= 3").withColumn("u", F.array_distinct("missing"))
    return findings(g, say(F.size("u").cast("string"), " printed word(s) are announced by no element"), F.col("page") + 1, F.size("u"), tx.sample(F.col("u"), 8, 30), boxes=F.col("bx"))


@rule("TAG-004")
def nesting(t):
    e, m = t.nesting_events.alias("e"), t.mcrefs.alias("m")
    same = (F.col("e.doc_id") == F.col("m.doc_id")) & (F.col("e.page") == F.col("m.page")) & (F.col("e.mcid") == F.col("m.mcid")) & F.col("e.stream").eqNullSafe(F.col("m.stream"))
    g = e.join(m, same, "left_semi").groupBy("doc_id", "page").agg(F.count("*").alias("n"), F.min_by("mcid", "seq").alias("first"))
    return findings(g, say(F.col("n").cast("string"), " sequence(s) nest tagged content and artifacts"), F.col("page") + 1, F.col("n"), say("MCID ", F.col("first").cast("string")))


@rule("TAG-010")
def unmapped_types(t):
    bad = t.el.where(~F.col("type_raw").isin(STANDARD_TYPES) & ~F.col("type").isin(STANDARD_TYPES) & ~F.coalesce("circular", F.lit(False)))
    g = bad.groupBy("doc_id", "type_raw").agg(F.count("*").alias("n"), F.min_by("find_page", "ord").alias("p"))
    return findings(g, say("type ", F.col("type_raw"), " isn't standard and maps to none (", F.col("n").cast("string"), " element(s))"), F.col("p"), F.col("n"), F.col("type_raw"))


def _role_map(t):
    return t.docs.select("doc_id", F.explode("role_map").alias("source", "target"))


@rule("TAG-011")
def role_loops(t):
    """Chains of the role map are followed to a standard type or back; a chain is no longer than the map."""
    m = _role_map(t)
    chains = t.docs.where("role_map is not null").select("doc_id", "role_map", F.explode(F.map_keys("role_map")).alias("source"))
    step = lambda a, _: F.when(a.isNull() | a.isin(STANDARD_TYPES), F.lit(None)).otherwise(F.col("role_map")[a])
    end = F.aggregate(F.sequence(F.lit(1), F.size("role_map") + 1), F.when(F.col("source").isin(STANDARD_TYPES), F.lit(None)).otherwise(F.col("source")), step)
    bad = chains.where(end.isNotNull()).join(m.select("doc_id", "source"), ["doc_id", "source"])
    return findings(bad, say("the mapping of ", F.col("source"), " leads back to itself"), evidence=F.col("source"))


@rule("TAG-012")
def remapped(t):
    bad = _role_map(t).where(F.col("source").isin(STANDARD_TYPES) & (F.col("source") != F.col("target")))
    return findings(bad, say("the standard type ", F.col("source"), " is mapped to ", F.col("target")), evidence=say(F.col("source"), " -> ", F.col("target")))


@rule("TAG-020")
def empty(t):
    bad = t.told.where(~F.col("type").isin(GROUPING) & F.col("type").isin(STANDARD_TYPES) & ~F.col("has_content"))
    g = bad.groupBy("doc_id", "type").agg(F.count("*").alias("n"), F.min_by("find_page", "ord").alias("p"), F.min_by("path", "ord").alias("first"))
    return findings(g, say(F.col("n").cast("string"), " ", F.col("type"), " element(s) hold nothing"), F.col("p"), F.col("n"), location=F.create_map(F.lit("first"), F.col("first")))


@rule("TAG-021")
def lost_pages(t):
    a = t.elements.where("pg_dangling").select("doc_id", "ord", "path", F.lit("p").alias("kind"))
    b = t.mcrefs.where("page is null").join(t.elements.select("doc_id", "ord", "path"), ["doc_id", "ord"]).select("doc_id", "ord", "path", F.lit("m").alias("kind"))
    g = a.unionByName(b).groupBy("doc_id").agg(F.min_by("path", "ord").alias("first"), F.count_if(F.col("kind") == "p").alias("n_p"), F.count_if(F.col("kind") == "m").alias("n_m"))
    where = F.create_map(F.lit("first"), F.col("first"))
    one = findings(g.where("n_p > 0"), say(F.col("n_p").cast("string"), " element(s) point at a page that isn't in this file"), count=F.col("n_p"), location=where)
    return one.unionByName(findings(g.where("n_m > 0"), say(F.col("n_m").cast("string"), " content reference(s) have no page"), count=F.col("n_m"), location=where))


@rule("TAG-022")
def shared_ids(t):
    r = t.mcrefs.join(t.told.select("doc_id", "ord", "path", "box"), ["doc_id", "ord"])
    both = r.groupBy("doc_id", "page", "stream", "mcid").agg(F.sort_array(F.collect_set(F.struct("ord", "path"))).alias("els"), F.min(F.struct("ord", "seq")).alias("first"), F.sort_array(F.collect_list(F.struct("ord", "box"))).alias("bx")).where("size(els) > 1")
    g = both.groupBy("doc_id").agg(F.count("*").alias("n"), F.min_by(F.struct("page", "mcid", "els"), "first").alias("f"), F.flatten(F.collect_list("bx")).alias("bx"))
    paths = F.concat_ws(" and ", F.transform(F.slice(F.col("f")["els"], 1, 2), lambda x: x["path"]))
    boxes = F.slice(F.filter(F.transform("bx", lambda x: x["box"]), lambda x: x.isNotNull()), 1, 40)
    return findings(g, say(F.col("n").cast("string"), " content id(s) have more than one owner"), F.col("f")["page"] + 1, F.col("n"), say("MCID ", F.col("f")["mcid"].cast("string"), ": ", paths), boxes=boxes)


@rule("TAG-023")
def no_parent(t):
    return all_of(t.told.where("not has_p").withColumn("box", F.lit(None).cast("struct<page:int,x0:double,y0:double,x1:double,y1:double>")), lambda n: say(n.cast("string"), " element(s) don't name their parent"))


@rule("TAG-030")
def page_as_figure(t):
    words = t.runs.where("mcid is not null and not artifact and render_mode <> 3").groupBy("doc_id", "page").agg(F.sum(F.size(tx.words(tx.nfkc("text")))).alias("n_words"))
    b = F.when(F.size("layout_bbox") == 4, F.struct(*[F.get("layout_bbox", F.lit(i)).alias(c) for i, c in enumerate(("x0", "y0", "x1", "y1"))])).otherwise(F.struct("x0", "y0", "x1", "y1"))
    f = t.told.where("type = 'Figure' and page is not null").withColumn("b", b).join(t.pages.select("doc_id", "page", "width", "height"), ["doc_id", "page"]).join(words, ["doc_id", "page"])
    f = f.where("n_words >= 20 and width * height > 0 and greatest(0.0, b.x1 - b.x0) * greatest(0.0, b.y1 - b.y0) / (width * height) >= 0.85")
    f = f.withColumn("box", page_box("b.x0", "b.y0", "b.x1", "b.y1")).withColumn("find_page", F.col("page") + 1)
    return each_of(f, "a figure covers a page of tagged text: the scan is described as a picture", F.substring(F.coalesce("alt", F.lit("")), 1, 80))


def _replaced(t, replacement):
    return t.told.withColumn("rep", replacement).where("rep is not null and rep <> ''").withColumn("content", tx.letters(F.col("norm_text"))).withColumn("rep_letters", tx.letters(tx.nfkc("rep")))


@rule("TAG-031")
def hiding_alternatives(t):
    bad = _replaced(t, F.coalesce(F.nullif("actual_text", F.lit("")), "alt")).where("type not in ('Figure', 'Formula') and length(content) >= 60 and length(rep_letters) < 0.35 * length(content)")
    return each_of(bad, say("a ", F.col("type"), " replaces ", F.length("content").cast("string"), " letters by ", F.length("rep_letters").cast("string")), F.substring("text", 1, 100))


@rule("TAG-032")
def unlike_replacement(t):
    bad = _replaced(t, F.col("actual_text")).where("type <> 'Formula' and length(content) >= 12").where(~F.col("rep_letters").contains(F.col("content")))
    bad = bad.withColumn("ratio", tx.similarity("content", "rep_letters")).where("ratio < 0.6")
    return each_of(bad, say("the replacement text of a ", F.col("type"), " matches ", F.bround(F.col("ratio") * 100).cast("int").cast("string"), "% of its content"), F.substring("text", 1, 80))


@rule("TAG-040")
def reference_xobjects(t):
    g = t.reference_xobjects.groupBy("doc_id").agg(F.count("*").alias("n"), F.min_by("page", "seq").alias("p"), F.min_by("name", "seq").alias("first"))
    return findings(g, say(F.col("n").cast("string"), " XObject(s) show content of another file"), F.col("p") + 1, F.col("n"), F.col("first"))
