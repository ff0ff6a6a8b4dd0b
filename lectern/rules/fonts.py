"""Rules about fonts and the text they show."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as tx
from .base import boxes_in_order, findings, page_box, rule, say, texts_in_order

HEX = lambda c: F.concat(F.lit("0x"), F.lower(F.hex(c)))


def _codes(t):
    return t.font_codes.join(t.fonts, ["doc_id", "font_key"])


def _listed(codes, n):
    return F.concat_ws(", ", F.transform(F.slice(F.sort_array(codes), 1, n), HEX))


@rule("TXT-001")
def embedded(t):
    used = t.font_codes.where("shown").select("doc_id", "font_key").distinct()
    g = t.fonts.where("not embedded").join(used, ["doc_id", "font_key"], "left_semi").groupBy("doc_id").agg(F.count("*").alias("n"), F.sort_array(F.collect_set("base_font")).alias("names"), F.min("first_page").alias("p"))
    return findings(g, say(F.col("n").cast("string"), " font(s) in use aren't embedded"), F.col("p") + 1, F.col("n"), F.concat_ws(", ", F.slice("names", 1, 6)))


@rule("TXT-002")
def readable(t):
    used = t.font_codes.where("shown").groupBy("doc_id", "font_key").agg(F.count("*").alias("n"))
    f = t.fonts.where("not has_tounicode and not has_encoding").join(used, ["doc_id", "font_key"])
    return findings(f, say("font ", F.col("base_font"), " (", F.col("subtype"), ") has no mapping to Unicode and no known encoding"), F.col("first_page") + 1, evidence=F.col("base_font"), location=F.create_map(F.lit("codes_shown"), F.col("n").cast("string")))


@rule("TXT-003")
def unmapped(t):
    g = _codes(t).where("shown and (has_tounicode or has_encoding)").groupBy("doc_id", "font_key").agg(F.first("base_font").alias("base_font"), F.first("first_page").alias("p"), F.count("*").alias("n"), F.collect_list(F.when(~F.col("mapped"), F.col("code"))).alias("bad")).where("size(bad) > 0")
    many = (F.size("bad") / F.col("n") >= 0.05) | (F.size("bad") >= 5)
    return findings(g, say("font ", F.col("base_font"), ": ", F.size("bad").cast("string"), " of ", F.col("n").cast("string"), " codes shown map to nothing"), F.col("p") + 1, evidence=_listed(F.col("bad"), 8), severity=F.when(~many, "warning"))


def _mapped(t):
    return _codes(t).where("shown and has_tounicode and coalesce(cmap_text, '') <> ''")


@rule("TXT-004")
def plausible(t):
    first = F.ascii("cmap_text")
    each = _mapped(t).groupBy("doc_id", "font_key", "cmap_text").agg(F.count("*").alias("n"), F.first("base_font").alias("base_font"), F.min("first_page").alias("p"))
    hit = F.when(~tx.blank(F.col("cmap_text")) & (F.col("n") >= 5), F.col("n"))
    g = each.groupBy("doc_id", "font_key").agg(
        F.first("base_font").alias("base_font"), F.first("p").alias("p"), F.sum("n").alias("shown"), F.max(hit).alias("n_same"),
        F.max_by("cmap_text", F.struct(hit, "cmap_text")).alias("same"),
        F.sum(F.when((first < 32) & ~first.isin(9, 10, 13), F.col("n")).otherwise(0)).alias("n_control"),
        F.sum(F.when(first.between(0xE000, 0xF8FF), F.col("n")).otherwise(0)).alias("n_private"),
    ).where("shown >= 4 and (n_same is not null or n_control > 0 or n_private > 0)")
    points = F.concat_ws(" ", F.transform(F.split("same", ""), lambda ch: F.concat(F.lit("U+"), F.lpad(F.hex(F.ascii(ch)), 4, "0"))))
    problems = F.concat_ws(
        "; ",
        F.when(F.col("n_same").isNotNull(), say(F.col("n_same").cast("string"), " codes map to ", points)),
        F.when(F.col("n_control") > 0, say(F.col("n_control").cast("string"), " code(s) map to control characters")),
        F.when(F.col("n_private") > 0, say(F.col("n_private").cast("string"), " code(s) map to private use")),
    )
    return findings(g, say("font ", F.col("base_font"), ": ", problems), F.col("p") + 1, evidence=F.col("base_font"))


@rule("TXT-005")
def notdef(t):
    n = t.notdefs.join(t.fonts.select("doc_id", "font_key", "base_font"), ["doc_id", "font_key"])
    codes = t.font_codes.where("notdef").groupBy("doc_id", "font_key").agg(F.collect_set("code").alias("codes"))
    g = n.join(codes, ["doc_id", "font_key"], "left").groupBy("doc_id", "page").agg(F.sum("n").alias("n"), F.sort_array(F.collect_list(F.struct((-F.col("n")).alias("k"), "base_font", F.col("n").alias("n")))).alias("f"), F.array_distinct(F.flatten(F.collect_list("codes"))).alias("codes"))
    fonts = F.concat_ws(", ", F.transform(F.slice("f", 1, 3), lambda x: F.concat(x["base_font"], F.lit(": "), x["n"].cast("string"))))
    return findings(g, say(F.col("n").cast("string"), " glyph(s) shown are missing ones (", fonts, ")"), F.col("page") + 1, F.col("n"), F.when(F.size("codes") > 0, say("codes ", _listed(F.col("codes"), 8))))


@rule("TXT-006")
def noncharacters(t):
    g = _mapped(t).where(F.ascii("cmap_text").isin(0, 0xFEFF, 0xFFFE)).groupBy("doc_id", "font_key").agg(F.first("base_font").alias("base_font"), F.min("first_page").alias("p"), F.collect_list("code").alias("bad"))
    return findings(g, say("font ", F.col("base_font"), ": ", F.size("bad").cast("string"), " code(s) map to U+0000, U+FEFF or U+FFFE"), F.col("p") + 1, F.size("bad"), _listed(F.col("bad"), 6))


@rule("TXT-007")
def cid_map(t):
    bad = t.fonts.where("subtype = 'Type0' and embedded and indirect and descendant_subtype = 'CIDFontType2' and not has_cidtogid")
    return findings(bad, say("font ", F.col("base_font"), ": embedded CIDFontType2 without a CIDToGIDMap"), F.col("first_page") + 1, evidence=F.col("base_font"))


@rule("TXT-010")
def invisible(t):
    r = t.runs.where(~tx.blank(F.col("text"))).groupBy("doc_id", "page").agg(F.sum(F.length("text")).alias("n"), F.sum(F.when(F.col("render_mode") == 3, F.length("text")).otherwise(0)).alias("n_hidden"))
    r = r.where("n >= 40 and n_hidden / n >= 0.9").join(t.pages.select("doc_id", "page", "width", "height"), ["doc_id", "page"])
    carried = t.images.join(t.pages.select("doc_id", "page", "width", "height"), ["doc_id", "page"]).where("x1 > x0 and (x1 - x0) * (y1 - y0) >= 0.5 * coalesce(nullif(width * height, 0), 1) and width_px / ((x1 - x0) / 72.0) >= 100")
    n_images = t.images.groupBy("doc_id", "page").agg(F.count("*").alias("n_images"))
    bad = r.join(carried, ["doc_id", "page"], "left_anti").join(n_images, ["doc_id", "page"], "left")
    where = F.create_map(F.lit("invisible_chars"), F.col("n_hidden").cast("string"), F.lit("images"), F.coalesce("n_images", F.lit(0)).cast("string"))
    return findings(bad, "the text is invisible and no image of 100 dpi shows it: the page looks blank", F.col("page") + 1, location=where)


@rule("TXT-011")
def forms_untagged(t):
    bad = t.runs.where("mcid is null and not artifact and in_form").where(~tx.blank(F.col("text"))).join(t.tagged_docs.select("doc_id"), "doc_id", "left_semi")
    g = bad.groupBy("doc_id", "page").agg(F.count("*").alias("n"), texts_in_order("run_seq", "text", 3, 90).alias("ev"), boxes_in_order("run_seq", page_box()).alias("bx"))
    return findings(g, say(F.col("n").cast("string"), " text run(s) of form XObjects are neither tagged nor artifacts"), F.col("page") + 1, F.col("n"), F.col("ev"), boxes=F.col("bx"))
