"""Rules about tables."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text as tx
from .base import all_of, boxes_in_order, findings, page_box, rule, say, texts_in_order

GROUPS = ("THead", "TBody", "TFoot")


def tables(t):
    return t.told.where("type = 'Table'")


def _of_tables(t, g, message, count=1, evidence=None, boxes=None):
    """A finding for each table of ``g`` (doc_id, table_ord and what the message needs)."""
    at = tables(t).select("doc_id", F.col("ord").alias("table_ord"), "find_page", "path", "box")
    rows = g.join(at, ["doc_id", "table_ord"])
    return findings(rows, message, F.col("find_page"), count, evidence, location=F.create_map(F.lit("element"), F.col("path")), boxes=F.when(F.col("box").isNotNull(), F.array("box")) if boxes is None else boxes)


def _filled(c="text"):
    return F.col(c) != ""


def by_row(t):
    """Rows of each table with what their cells add up to; rows without a cell included."""
    c = t.cells.groupBy("doc_id", "table_ord", "row_ord").agg(
        F.count("*").alias("n"), F.count_if(F.col("kind") == "TH").alias("n_th"), F.count_if(_filled()).alias("n_filled"),
        F.count_if(_filled() & (F.size(tx.words(tx.nfkc("text"))) == 1)).alias("n_single"),
        F.sort_array(F.collect_list(F.struct("ord", "colspan", "rowspan"))).alias("spans"), F.min_by(F.struct("text", "colspan", "box"), "ord").alias("first"),
    )
    zero = F.lit(0).cast("long")
    return t.rows.join(c, ["doc_id", "table_ord", "row_ord"], "left").withColumns({x: F.coalesce(x, zero) for x in ("n", "n_th", "n_filled", "n_single")})


@rule("TBL-001")
def no_headers(t):
    g = t.cells.groupBy("doc_id", "table_ord").agg(F.count("*").alias("n"), F.bool_or((F.col("kind") == "TH") | (F.size("headers") > 0)).alias("has"), texts_in_order("ord", "text", 3, 30, _filled()).alias("ev"))
    n_rows = t.rows.groupBy("doc_id", "table_ord").agg(F.count("*").alias("n_rows"))
    return _of_tables(t, g.where("n >= 2 and not has").join(n_rows, ["doc_id", "table_ord"]), say("a table of ", F.col("n_rows").cast("string"), " row(s) and ", F.col("n").cast("string"), " cells has no header cell"), evidence=F.col("ev"))


@rule("TBL-002")
def no_scope(t):
    named = t.cells.select("doc_id", "table_ord", F.explode("headers").alias("id")).distinct()
    loose = t.cells.where("kind = 'TH' and coalesce(scope, '') = ''").join(named, ["doc_id", "table_ord", "id"], "left_anti")
    g = loose.groupBy("doc_id", "table_ord").agg(F.count("*").alias("n"), texts_in_order("ord", "text", 3, 30, _filled()).alias("ev"), boxes_in_order("ord").alias("bx"))
    several = t.rows.groupBy("doc_id", "table_ord").agg(F.count("*").alias("n_rows")).where("n_rows > 1")
    return _of_tables(t, g.join(several, ["doc_id", "table_ord"]), say(F.col("n").cast("string"), " header cell(s) have no scope and no cell refers to them"), F.col("n"), F.col("ev"), F.col("bx"))


@rule("TBL-003")
def misplaced(t):
    e = t.told.join(t.parents.select("doc_id", "ord", "parent_type"), ["doc_id", "ord"])
    a = all_of(e.where("type in ('TH', 'TD') and coalesce(parent_type, '') <> 'TR'"), lambda n: say(n.cast("string"), " cell(s) aren't in a row"))
    return a.unionByName(all_of(e.where(f"type = 'TR' and coalesce(parent_type, '') not in {(*GROUPS, 'Table')}"), lambda n: say(n.cast("string"), " row(s) aren't in a table")))


def row_widths(rows, strict: bool = False) -> list[int]:
    """Columns that each row takes, spans carried down; a row is a list of (colspan, rowspan).

    In the plain form a span over a row's last columns is counted one row too few; ``strict`` counts it in full.
    """
    carry: dict[int, int] = {}  # column: rows it stays taken, this one included
    widths = []
    for row in rows:
        col = used = 0
        fresh = {}
        for span, down in row:
            while carry.get(col):
                col, used = col + 1, used + 1
            if down > 1:
                fresh |= dict.fromkeys(range(col, col + span), down)
            col, used = col + span, used + span
        beyond = {k for k, n in carry.items() if k >= col and (n > 0 if strict else n > 1)}
        carry = {k: n - 1 for k, n in (carry | fresh).items() if n > 1}
        widths.append(used + len(beyond))
    return widths


@F.pandas_udf(T.ArrayType(T.IntegerType()))
def widths(grids: pd.Series) -> pd.Series:
    return grids.map(lambda grid: row_widths([[tuple(s) for s in row] for row in grid]))


@rule("TBL-004")
def uneven(t):
    rows = F.transform(F.sort_array(F.collect_list(F.struct("row_ord", "spans"))), lambda r: F.coalesce(F.transform(r["spans"], lambda s: F.array(s["colspan"], s["rowspan"])), F.array().cast("array<array<int>>")))
    g = by_row(t).groupBy("doc_id", "table_ord").agg(rows.alias("grid")).where("size(grid) >= 2")

    g = g.withColumn("w", widths("grid")).where(F.array_min("w") != F.array_max("w"))
    return _of_tables(t, g, say("rows take from ", F.array_min("w").cast("string"), " to ", F.array_max("w").cast("string"), " columns"), evidence=F.concat_ws(", ", F.slice("w", 1, 12)))


@rule("TBL-005")
def parts(t):
    kids = t.el.where("logical_parent_ord is not null").select("doc_id", F.col("logical_parent_ord").alias("up"), "ord", "place", "type")
    own = kids.join(tables(t).select("doc_id", F.col("ord").alias("up")), ["doc_id", "up"], "left_semi")
    stray = ~F.col("type").isin("Caption", "TR", *GROUPS)
    n = lambda x: F.count_if(F.col("type") == x)
    g = own.groupBy("doc_id", F.col("up").alias("table_ord")).agg(
        F.count("*").alias("n_kids"), F.count_if(stray).alias("n_stray"), F.sort_array(F.collect_set(F.when(stray, F.col("type")))).alias("kinds"), texts_in_order("ord", "type", 3, 20, stray).alias("ev"),
        n("THead").alias("heads"), n("TFoot").alias("feet"), n("TBody").alias("bodies"), n("Caption").alias("captions"), F.min(F.when(F.col("type") == "Caption", F.col("place"))).alias("caption_at"),
    )
    inner = kids.where("type <> 'TR'").groupBy("doc_id", "up").agg(F.count("*").alias("n_inner"))
    inside = own.where(F.col("type").isin(*GROUPS)).select("doc_id", F.col("up").alias("table_ord"), F.col("ord").alias("up")).join(inner, ["doc_id", "up"]).groupBy("doc_id", "table_ord").agg(F.sum("n_inner").alias("n_inner"))
    g = g.join(inside, ["doc_id", "table_ord"], "left")
    s = lambda c: F.col(c).cast("string")
    problems = F.concat_ws(
        "; ",
        F.when(F.col("n_stray") > 0, say(s("n_stray"), " child(ren) that are no part of a table (", F.concat_ws(", ", F.slice("kinds", 1, 4)), ")")),
        F.when(F.col("heads") > 1, say(s("heads"), " table heads")),
        F.when(F.col("feet") > 1, say(s("feet"), " table feet")),
        F.when((F.col("heads") + F.col("feet") > 0) & (F.col("bodies") == 0), "a head or foot without a body"),
        F.when((F.col("captions") > 1) | ((F.col("captions") == 1) & ~F.col("caption_at").isin(1) & (F.col("caption_at") != F.col("n_kids"))), "a caption that isn't first or last"),
        F.when(F.col("n_inner") > 0, say(s("n_inner"), " child(ren) of row groups that are no rows")),
    )
    return _of_tables(t, g.withColumn("problems", problems).where("problems <> ''"), say("the table has ", F.col("problems")), evidence=F.col("ev"))


@rule("TBL-010")
def split_headers(t):
    head = (F.col("n") > 0) & (F.col("n_th") == F.col("n"))
    g = by_row(t).groupBy("doc_id", "table_ord").agg(F.sum("n").alias("n"), F.sum("n_th").alias("th"), F.count_if(head).alias("rows"), F.sum(F.when(head, F.col("n_filled")).otherwise(0)).alias("filled"), F.sum(F.when(head, F.col("n_single")).otherwise(0)).alias("single"))
    g = g.where("n >= 6 and th > 0").withColumn("td", F.col("n") - F.col("th"))
    s = lambda c: F.col(c).cast("string")
    more = F.col("th") > F.col("td")
    why = F.concat_ws(
        "; ",
        F.when(more & (F.col("td") > 0), say(s("th"), " header cells for ", s("td"), " others")),
        F.when(F.col("rows") > 3, say(s("rows"), " header rows")),
        F.when((F.col("filled") > 0) & (F.col("single") / F.col("filled") >= 0.8) & (F.col("rows") >= 3), "header rows of single words"),
    )
    g = g.withColumn("why", why).where((F.col("why") != "") & ((F.col("rows") > 3) | more))
    heads = by_row(t).where(head).select("doc_id", "table_ord", "row_ord")
    single = t.cells.join(heads, ["doc_id", "table_ord", "row_ord"], "left_semi").where(F.size(tx.words(tx.nfkc("text"))) == 1).groupBy("doc_id", "table_ord").agg(texts_in_order("ord", "text", 6, 16).alias("ev"))
    return _of_tables(t, g.join(single, ["doc_id", "table_ord"], "left"), say("header cells look split up: ", F.col("why")), evidence=F.col("ev"))


@rule("TBL-011")
def empty_headers(t):
    ids = t.cells.where("coalesce(id, '') <> ''").groupBy("doc_id", "table_ord", "id").agg(F.max_by("text", "ord").alias("header"))
    named = t.cells.where("kind = 'TD'").select("doc_id", "table_ord", "ord", "box", F.explode("headers").alias("id")).join(ids, ["doc_id", "table_ord", "id"])
    silent = named.groupBy("doc_id", "table_ord", "ord").agg(F.max("header").alias("most"), F.first("box").alias("box")).where("most = ''")
    g = silent.groupBy("doc_id", "table_ord").agg(F.count("*").alias("n"), boxes_in_order("ord").alias("bx"))
    return _of_tables(t, g, say(F.col("n").cast("string"), " cell(s) have empty header cells only"), F.col("n"), boxes=F.col("bx"))


@rule("TBL-012")
def hollow(t):
    g = t.cells.groupBy("doc_id", "table_ord").agg(F.count("*").alias("n"), F.count_if(~_filled()).alias("empty")).where("n >= 6 and empty / n > 0.6")
    return _of_tables(t, g, say(F.col("empty").cast("string"), " of ", F.col("n").cast("string"), " cells are empty: this may be no table"))


@rule("TBL-013")
def halves(t):
    w = Window.partitionBy("doc_id").orderBy("ord")
    nxt = lambda c: F.lead(c).over(w)
    e = tables(t).withColumns({f"b_{c}": nxt(c) for c in ("logical_parent_ord", "page", "place", "x0", "y0", "x1", "y1", "path", "box")})
    bad = e.where("logical_parent_ord is not null and b_logical_parent_ord = logical_parent_ord and b_page = page and b_place = place + 1 and x0 is not null and b_x0 is not null").where(
        "(least(y1, b_y1) - greatest(y0, b_y0)) / coalesce(nullif(least(y1 - y0, b_y1 - b_y0), 0), 1) >= 0.5 and greatest(b_x0 - x1, x0 - b_x1) < 24"
    )
    boxes = F.filter(F.array("box", "b_box"), lambda x: x.isNotNull())
    return findings(bad, "two tables stand side by side with nothing between: one may have been split", F.col("page") + 1, location=F.create_map(F.lit("first"), F.col("path"), F.lit("second"), F.col("b_path")), boxes=boxes)


@rule("TBL-014")
def ruled_grids(t):
    key = ["doc_id", "page"]
    p = t.paths.where("stroked or filled").withColumn("w", F.expr("x1 - x0")).withColumn("h", F.expr("y1 - y0"))
    hz, vt = p.where("h <= 2.5 and w >= 40"), p.where("w <= 2.5 and h >= 12 and not (h <= 2.5 and w >= 40)")
    enough = hz.groupBy(*key).agg(F.count("*").alias("nh")).where("nh >= 3").join(vt.groupBy(*key).agg(F.count("*").alias("nv")).where("nv >= 3"), key).select(*key)
    cols = ("paint_ord", "x0", "y0", "x1", "y1")
    hz = hz.join(enough, key, "left_semi").select(*key, *[F.col(c).alias(f"h_{c}") for c in cols])
    vt = vt.join(enough, key, "left_semi").select(*key, *[F.col(c).alias(f"v_{c}") for c in cols])
    cross = hz.join(vt, key).where("v_x0 between h_x0 - 1 and h_x1 + 1 and h_y0 between v_y0 - 1 and v_y1 + 1")
    h_ok = cross.groupBy(*key, "h_paint_ord").agg(F.count("*").alias("n"), F.first("h_x0").alias("x0"), F.first("h_x1").alias("x1")).where("n >= 2")
    v_ok = cross.join(h_ok.select(*key, "h_paint_ord"), [*key, "h_paint_ord"], "left_semi").groupBy(*key, "v_paint_ord").agg(F.count("*").alias("n"), F.first("v_y0").alias("y0"), F.first("v_y1").alias("y1")).where("n >= 2")
    region = h_ok.groupBy(*key).agg(F.count("*").alias("nh"), F.min("x0").alias("gx0"), F.max("x1").alias("gx1")).where("nh >= 3").join(v_ok.groupBy(*key).agg(F.count("*").alias("nv"), F.min("y0").alias("gy0"), F.max("y1").alias("gy1")).where("nv >= 3"), key)
    region = region.where("gx1 - gx0 >= 100 and gy1 - gy0 >= 30")
    inside = t.lines.join(region, key).where("x0 >= gx0 - 2 and x1 <= gx1 + 2 and y0 >= gy0 - 2 and y1 <= gy1 + 2")
    g = inside.groupBy(*key, "nh", "nv", "gx0", "gy0", "gx1", "gy1").agg(F.count("*").alias("n"), F.sum(F.size(tx.words(tx.nfkc("text")))).alias("n_words"), F.max("tagged_share").alias("tagged"), texts_in_order("line_no", "text", 3, 40).alias("ev")).where("n >= 4 and n_words >= 8 and tagged > 0")
    tb = tables(t).where("x0 is not null").select(*key, "x0", "y0", "x1", "y1")
    covered = g.select(*key, "gx0", "gy0", "gx1", "gy1").join(tb, key).where("greatest(0.0, least(x1, gx1) - greatest(x0, gx0)) * greatest(0.0, least(y1, gy1) - greatest(y0, gy0)) / ((gx1 - gx0) * (gy1 - gy0)) >= 0.5").select(*key)
    bad = g.join(covered, key, "left_anti")
    s = lambda c: F.col(c).cast("string")
    return findings(bad, say("a grid of ", s("nh"), " by ", s("nv"), " ruled lines holds ", s("n"), " line(s) of text outside any table"), F.col("page") + 1, evidence=F.col("ev"), boxes=F.array(page_box("gx0", "gy0", "gx1", "gy1")))


@rule("TBL-015")
def collapsed(t):
    most = Window.partitionBy("doc_id", "table_ord")
    r = by_row(t).withColumn("n_rows", F.count("*").over(most)).withColumn("widest", F.max("n").over(most)).where("n_rows >= 3 and widest >= 3")
    one = (F.col("n") == 1) & (F.col("first")["text"] != "") & (F.size(tx.words(tx.nfkc(F.col("first")["text"]))) >= 4) & (F.col("first")["colspan"] < F.col("widest"))
    g = r.withColumn("one", F.coalesce(one, F.lit(False))).groupBy("doc_id", "table_ord").agg(F.count_if(F.col("n_filled") >= 2).alias("multi"), F.count_if("one").alias("n"), texts_in_order("row_ord", F.col("first")["text"], 2, 60, F.col("one")).alias("ev"), boxes_in_order("row_ord", F.when(F.col("one"), F.col("first")["box"])).alias("bx"))
    return _of_tables(t, g.where("multi >= 2 and n >= 2"), say(F.col("n").cast("string"), " row(s) hold everything in one cell"), F.col("n"), F.col("ev"), F.col("bx"))
