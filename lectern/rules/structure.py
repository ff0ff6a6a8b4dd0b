"""Rules about headings, lists, figures, notes and formulae."""

from __future__ import annotations


from pyspark.sql import functions as F

from ..functions import patterns
from ..functions import text as tx
from ..operators import kernels as k
from .base import all_of, boxes_in_order, each_of, findings, rule, say, texts_in_order


def headings(t):
    return t.told.where("is_heading").withColumn("line", tx.collapse(F.col("text")))


@rule("HDG-001")
def skipped_levels(t):
    bad = k.jumps(headings(t).where("level is not null"), ["doc_id"], [F.col("ord")], "level")
    g = bad.groupBy("doc_id").agg(F.count("*").alias("n"), F.min_by(F.struct("previous", "level", "find_page", "path", "text"), "ord").alias("f"), boxes_in_order("ord").alias("bx"))
    f = F.col("f")
    return findings(g, say(F.col("n").cast("string"), " heading(s) skip a level, first H", f["previous"].cast("string"), " to H", f["level"].cast("string")), f["find_page"], F.col("n"), F.substring(f["text"], 1, 80), location=F.create_map(F.lit("element"), f["path"]), boxes=F.col("bx"))


@rule("HDG-002")
def first_level(t):
    return each_of(k.first_rows(headings(t), ["doc_id"], [F.col("ord")]).where("level > 1"), say("the first heading is H", F.col("level").cast("string")), F.substring("text", 1, 80))


@rule("HDG-003")
def mixed(t):
    g = t.el.where("is_heading").groupBy("doc_id").agg(F.bool_or(F.col("level").isNull()).alias("a"), F.bool_or(F.col("level").isNotNull()).alias("b"))
    return findings(g.where("a and b"), "numbered and unnumbered headings are mixed")


@rule("HDG-005")
def several_h(t):
    many = t.elements.where("type = 'H' and logical_parent_ord is not null").groupBy("doc_id", F.col("logical_parent_ord").alias("ord")).agg(F.count("*").alias("n_h")).where("n_h > 1")
    return all_of(t.told.join(many, ["doc_id", "ord"]), lambda n: say(n.cast("string"), " element(s) have several H children"))


@rule("HDG-010")
def odd_headings(t):
    line = F.col("line")
    why = (
        F.when(line.rlike(r"^\p{Ll}") & line.rlike("[,;]$"), "part of a sentence")
        .when(line.rlike(patterns.SALUTATION), "a salutation or a closing")
        .when(line.rlike(patterns.REFERENCE_NUMBER) & (F.size(tx.words(F.col("norm_text"))) <= 2), "a reference number")
    )
    return each_of(headings(t).where("line <> ''").withColumn("why", why).where("why is not null"), say("a heading reads as ", F.col("why")), F.substring(line, 1, 80))


@rule("HDG-011")
def long_headings(t):
    n = F.size(tx.words(F.col("norm_text")))
    bad = headings(t).withColumn("n_words", n).where("n_words >= 25").where(F.size(F.regexp_extract_all("line", F.lit(r"([.!?](?:\s|$))"), F.lit(1))) >= 2)
    return each_of(bad, say("a heading of ", F.col("n_words").cast("string"), " words in several sentences"), F.substring("line", 1, 80))


@rule("HDG-012")
def no_headings(t):
    long = t.tagged_docs.where("n_pages >= 5").join(t.el.where("is_heading").select("doc_id"), "doc_id", "left_anti")
    words = t.runs.where("mcid is not null and not artifact").groupBy("doc_id").agg(F.sum(F.size(tx.words(tx.nfkc("text")))).alias("n")).where("n >= 200")
    return findings(long.join(words, "doc_id"), say("a document of ", F.col("n_pages").cast("string"), " pages has no heading"))


def _with_parent(t):
    return t.told.join(t.parents.select("doc_id", "ord", "parent_type"), ["doc_id", "ord"])


@rule("LST-001")
def items_in_lists(t):
    return all_of(_with_parent(t).where("type = 'LI' and coalesce(parent_type, '') <> 'L'"), lambda n: say(n.cast("string"), " list item(s) aren't in a list"))


@rule("LST-002")
def item_bodies(t):
    bodies = t.elements.where("type = 'LBody'").select("doc_id", F.col("logical_parent_ord").alias("ord"))
    return all_of(t.told.where("type = 'LI'").join(bodies, ["doc_id", "ord"], "left_anti"), lambda n: say(n.cast("string"), " list item(s) have no body"))


@rule("LST-003")
def other_children(t):
    bad = _with_parent(t).where("parent_type = 'L' and type not in ('LI', 'L', 'Caption')")
    return all_of(bad, lambda n: say(n.cast("string"), " child(ren) of lists aren't items"), F.concat(F.lit("/"), F.min_by("type", "ord")), )


@rule("LST-004")
def lists_in_items(t):
    return all_of(_with_parent(t).where("type = 'L' and parent_type = 'LI'"), lambda n: say(n.cast("string"), " nested list(s) stand beside an item's body"))


def figures(t):
    return t.told.where("type = 'Figure'").withColumn("told_alt", F.trim(F.regexp_replace(F.coalesce("alt", F.lit("")), r"^\s+|\s+$", "")))


@rule("FIG-001")
def no_alternative(t):
    return all_of(figures(t).where("alt is null and actual_text is null"), lambda n: say(n.cast("string"), " figure(s) have no alternative"))


@rule("FIG-002")
def blank_alternative(t):
    return all_of(figures(t).where("alt is not null").where(tx.blank(F.col("alt")) & tx.blank(F.col("actual_text"))), lambda n: say(n.cast("string"), " figure(s) have a blank alternative"))


@rule("FIG-010")
def placeholders(t):
    bad = figures(t).where("told_alt <> ''").where(F.col("told_alt").rlike(patterns.PLACEHOLDER))
    return all_of(bad, lambda n: say(n.cast("string"), " figure(s) have a placeholder for an alternative"), texts_in_order("ord", "told_alt", 4, 30))


@rule("FIG-011")
def like_caption(t):
    """A caption counts if it is the figure's child or stands beside it."""
    caps = t.told.where("type = 'Caption'").select("doc_id", F.col("logical_parent_ord").alias("at"), F.lower(tx.collapse(F.col("text"))).alias("same")).where("same <> '' and at is not null")
    f = figures(t).withColumn("same", F.lower(tx.collapse(F.col("alt")))).where("same <> ''")
    near = f.withColumn("at", F.explode(F.array("ord", "logical_parent_ord")))
    hit = near.join(caps, ["doc_id", "at", "same"], "left_semi").dropDuplicates(["doc_id", "ord"])
    return each_of(hit, "a figure's alternative repeats its caption", F.substring("same", 1, 80))


@rule("FIG-012")
def no_language(t):
    alt = F.col("told_alt")
    w = F.transform(tx.words(tx.nfkc("told_alt")), lambda x: F.lower(x))
    f = figures(t).where(alt != "").where(~alt.rlike(patterns.PLACEHOLDER)).withColumn("w", w)
    bad = f.where((F.length(F.regexp_replace(alt, r"[^\p{L}]", "")) / F.length(alt) < 0.5) | ((F.size("w") >= 3) & (F.size(F.array_distinct("w")) == 1)) | ((F.size("w") <= 1) & (F.length(alt) > 30)))
    return all_of(bad, lambda n: say(n.cast("string"), " figure(s) have an alternative that isn't language"), texts_in_order("ord", "told_alt", 3, 40))


def notes(t):
    return t.told.where("type = 'Note'")


@rule("NOTE-001")
def note_ids(t):
    return all_of(notes(t).where(tx.blank(F.col("id"))), lambda n: say(n.cast("string"), " note(s) have no id"))


@rule("NOTE-004")
def repeated_ids(t):
    twice = t.elements.where("type = 'Note' and coalesce(id, '') <> ''").groupBy("doc_id", "id").agg(F.count("*").alias("n"), F.min("ord").alias("ord")).where("n > 1")
    g = twice.groupBy("doc_id").agg(F.count("*").alias("n"), F.transform(F.sort_array(F.collect_list(F.struct("ord", "id"))), lambda x: x["id"]).alias("ids"))
    return findings(g, say(F.col("n").cast("string"), " note id(s) are used more than once"), count=F.col("n"), evidence=F.concat_ws(", ", F.slice("ids", 1, 4)))


def _mark(c):
    return F.regexp_replace(F.lower(c), patterns.NO_MARK, "")


def _labels(t):
    """Children Lbl of notes, by the note's ord (physical children)."""
    lbl = t.told.where("type = 'Lbl'").select("doc_id", F.col("parent_ord").alias("ord"), F.col("text").alias("label"))
    return t.elements.where("type = 'Note'").select("doc_id", "ord").join(lbl, ["doc_id", "ord"])


@rule("NOTE-002")
def loose_references(t):
    marks = _labels(t).select("doc_id", _mark(F.col("label")).alias("key")).unionByName(notes(t).select("doc_id", _mark(F.regexp_extract(tx.collapse(F.col("text")), patterns.LABEL, 1)).alias("key"))).where("key <> ''").distinct()
    refs = t.told.where("type = 'Reference'")
    leading = t.elements.where("type = 'Link'").select("doc_id", "ord").unionByName(t.objrefs.select("doc_id", "ord"))
    linked = t.above(leading).select("doc_id", F.col("a_ord").alias("ord"))
    bad = refs.join(linked, ["doc_id", "ord"], "left_anti").withColumn("key", _mark(F.col("text"))).join(marks, ["doc_id", "key"], "left_anti").where(tx.blank(F.col("text")) | F.col("text").rlike(patterns.MARKER))
    return all_of(bad, lambda n: say(n.cast("string"), " reference(s) lead to no note or link"), F.nullif(tx.sample(F.transform(F.sort_array(F.collect_list(F.struct("ord", "text"))), lambda x: x["text"]), 4, 12), F.lit("")))


@rule("NOTE-003")
def note_shape(t):
    n = notes(t)
    bare = n.join(_labels(t).select("doc_id", "ord"), ["doc_id", "ord"], "left_anti").where(~F.substring(F.trim("text"), 1, 6).rlike(patterns.MARKER) & ~F.col("text").rlike(patterns.LABELLED))
    one = all_of(bare, lambda c: say(c.cast("string"), " note(s) have no label"), F.substring(F.min_by("text", "ord"), 1, 60))
    low = lambda c: F.lower(tx.collapse(F.col(c)))
    p = t.told.where("type = 'P'").select("doc_id", low("own_text").alias("same"))
    again = n.withColumn("same", low("text")).where(F.length("same") >= 20).join(p, ["doc_id", "same"], "left_semi").groupBy("doc_id", "same").agg(F.min("ord").alias("ord"))
    g = again.groupBy("doc_id").agg(F.count("*").alias("n"), F.min_by("same", "ord").alias("first"))
    return one.unionByName(findings(g, say(F.col("n").cast("string"), " note(s) are tagged again as a paragraph"), count=F.col("n"), evidence=F.substring("first", 1, 60)))


def formulae(t):
    return t.told.where("type = 'Formula'")


@rule("MATH-001")
def no_formula_alternative(t):
    bad = formulae(t).where(tx.blank(F.col("alt")) & tx.blank(F.col("actual_text")) & ~F.coalesce("has_af", F.lit(False)))
    return all_of(bad, lambda n: say(n.cast("string"), " formula(e) have no alternative"), F.substring(F.min_by("text", "ord"), 1, 60))


@rule("MATH-010")
def formula_source(t):
    return all_of(formulae(t).where(F.coalesce("alt", F.lit("")).rlike(patterns.FORMULA_SOURCE)), lambda n: say(n.cast("string"), " formula(e) have source code for an alternative"), F.substring(F.min_by("alt", "ord"), 1, 60))


@rule("MATH-011")
def hidden_prose(t):
    n = F.size(F.filter(tx.words(F.col("norm_text")), lambda w: F.length(w) >= 3))
    rep = F.size(tx.words(tx.nfkc(F.concat_ws(" ", "actual_text", "alt"))))
    bad = formulae(t).withColumn("n", n).withColumn("n_rep", rep).where("n >= 10 and n_rep < 0.3 * n")
    return each_of(bad, say("a formula covers ", F.col("n").cast("string"), " words and its alternative has ", F.col("n_rep").cast("string")), F.substring("text", 1, 90))


