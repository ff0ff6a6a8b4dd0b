"""Rules about the document as a whole."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import patterns
from ..functions import text as tx
from .base import findings, rule, say


@rule("DOC-001")
def marked(t):
    flag = F.col("mark_info")["Marked"]
    bad = t.docs.where(~F.coalesce(flag, F.lit(False)))
    return findings(bad, say("MarkInfo Marked is ", F.when(flag.isNull(), "missing").otherwise("false"), ": readers won't look for tags"))


@rule("DOC-002")
def structure(t):
    scanned = t.scans.groupBy("doc_id").agg(F.count("*").alias("n_scans"))
    bad = t.docs.where("not has_struct").join(scanned, "doc_id", "left")
    return findings(bad, F.when((F.col("n_scans") == F.col("n_pages")) & (F.col("n_pages") > 0), "no structure tree, and every page is a picture: recognise the text first (DOC-004)").otherwise("no structure tree"))


@rule("DOC-003")
def suspects(t):
    return findings(t.docs.where(F.coalesce(F.col("mark_info")["Suspects"], F.lit(False))), "MarkInfo Suspects is true")


@rule("DOC-004")
def unread_scans(t):
    pages = F.sort_array(F.collect_list(F.struct("page", "boxes")))
    g = t.scans.groupBy("doc_id").agg(F.count("*").alias("n"), pages.alias("found")).join(t.n_pages, "doc_id")
    numbers = F.transform("found", lambda x: (x["page"] + 1).cast("string"))
    which = F.when(F.col("n") < F.col("n_pages"), say(F.col("n").cast("string"), " of ", F.col("n_pages").cast("string"), " pages are images")).when(F.col("n") == 1, "the only page is an image").otherwise("all pages are images")
    listed = say("pages ", F.concat_ws(", ", F.slice(numbers, 1, 12)), F.when(F.col("n") > 12, " …").otherwise(""))
    return findings(g, say(which, " without a text layer"), F.get("found", F.lit(0))["page"] + 1, F.col("n"), F.when(F.col("n") < F.col("n_pages"), listed), boxes=F.slice(F.flatten(F.transform("found", lambda x: x["boxes"])), 1, 40))


@rule("DOC-010")
def title(t):
    bad = t.docs.where(tx.blank(F.col("xmp_title")))
    info = ~tx.blank(F.col("info_title"))
    return findings(bad, F.when(info, "the XMP metadata has no title, and the Info title doesn't count").otherwise("neither the XMP metadata nor the Info dictionary has a title"), evidence=F.when(info, F.trim("info_title")))


@rule("DOC-011")
def display_title(t):
    v = F.col("display_doc_title")
    return findings(t.docs.where(~F.coalesce(v, F.lit(False))), say("DisplayDocTitle is ", F.when(v.isNull(), "missing").otherwise("false")))


@rule("DOC-012")
def ua_part(t):
    part = F.col("ua_part")
    none = F.coalesce(part, F.lit("")) == ""
    bad = t.docs.where(none | (F.trim(part) != "1"))
    return findings(bad, F.when(none, "the XMP metadata declares no PDF/UA part").otherwise(say("PDF/UA part ", part, " is declared; this audit knows part 1")), severity=F.when(~none, "info"))


@rule("DOC-013")
def language(t):
    return findings(t.docs.where(tx.blank(F.col("lang"))), "the catalog has no language")


@rule("DOC-014")
def language_tag(t):
    lang = F.trim("lang")
    bad = t.docs.where((lang != "") & ~lang.rlike(patterns.LANGUAGE))
    return findings(bad, say("'", lang, "' is no language tag"), evidence=lang)


@rule("DOC-015")
def two_titles(t):
    a, b = tx.collapse(F.col("xmp_title")), tx.collapse(F.col("info_title"))
    bad = t.docs.where((a != "") & (b != "")).where(tx.casefold(a) != tx.casefold(b))
    return findings(bad, "the titles of the Info dictionary and of the XMP metadata differ", evidence=say("Info: ", F.substring(b, 1, 60), "; XMP: ", F.substring(a, 1, 60)))


@rule("DOC-020")
def permissions(t):
    closed = F.col("encryption_p").isNotNull() & (F.col("encryption_p").bitwiseAND(512) == 0)
    bad = t.docs.where("is_encrypted").where(closed | ~F.coalesce("extract_allowed", F.lit(True)))
    return findings(bad, F.when(closed, "encryption denies extraction even for accessibility").otherwise("encryption denies general extraction, but not for accessibility"), severity=F.when(~closed, "info"))


@rule("DOC-021")
def xfa(t):
    return findings(t.docs.where("has_xfa"), "the form dictionary carries an XFA form")


@rule("DOC-030")
def layers(t):
    def of(bad, message):
        names = F.transform(F.filter("oc_configs", bad), lambda c: c["label"])
        rows = t.docs.where(F.size(F.filter("oc_configs", bad)) > 0)
        return findings(rows, say(message, F.concat_ws(", ", names)), count=F.size(names))

    return of(lambda c: tx.blank(c["name"]), "layer configurations without a name: ").unionByName(of(lambda c: c["has_as"], "layer configurations with automatic states: "))


@rule("DOC-031")
def attachments(t):
    bad = F.filter("embedded_files", lambda s: s["f"].isNull() | s["uf"].isNull() | tx.blank(s["desc"]))
    rows = t.docs.withColumn("bad", bad).where("size(bad) > 0")
    names = F.transform(F.slice("bad", 1, 3), lambda s: F.coalesce(s["uf"], s["f"], F.lit("?")))
    return findings(rows, say(F.size("bad").cast("string"), " attachment(s) lack a name or a description"), count=F.size("bad"), evidence=F.concat_ws("; ", names))


@rule("DOC-040")
def title_quality(t):
    title = F.trim(F.when(~tx.blank(F.col("xmp_title")), F.col("xmp_title")).otherwise(F.coalesce("info_title", F.lit(""))))
    low = F.lower(title)
    stem = F.lower(F.regexp_replace(F.regexp_extract("path", r"([^/]+)$", 1), r"\.[^.]*$", ""))
    reason = (
        F.when(low.rlike(patterns.FILE_ENDING), "a file name with its ending")
        .when(~title.contains(" ") & ((low == stem) | title.contains("_")), "the file name")
        .when(low.rlike(patterns.WINDOW_TITLE), "an application's window title")
        .when(low.isin(*patterns.NO_TITLE), "a placeholder")
        .when(title.rlike(patterns.DATE), "a date")
        .when(title.rlike(r"^\p{Ll}") & title.rlike(patterns.FRAGMENT_END), "part of a sentence")
        .when(F.length(title) > 200, "longer than 200 characters")
    )
    rows = t.docs.where(title != "").withColumn("why", reason).where("why is not null")
    return findings(rows, say("the title is ", F.col("why")), evidence=F.substring(title, 1, 120))
