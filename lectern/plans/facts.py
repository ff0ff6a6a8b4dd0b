"""The fact store, and the relations that rules share. Each relation is built once, when first asked for."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from functools import cached_property

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import kernels as k
from ..schema import BOX, TABLES
from ..sources.shared import Shelf

MAX_BOXES = 40


def box(page: Column, x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    """A highlight: 1-based page, at least two points wide and high where it would be a hair, rounded half to even."""
    thin = (x1 - x0 < 0.5) | (y1 - y0 < 0.5)
    right = F.when(thin, x0 + F.greatest(x1 - x0, F.lit(2.0))).otherwise(x1)
    top = F.when(thin, y0 + F.greatest(y1 - y0, F.lit(2.0))).otherwise(y1)
    r = lambda c: F.bround(c, 1)
    made = F.struct((page + 1).cast("int").alias("page"), r(x0).alias("x0"), r(y0).alias("y0"), r(right).alias("x1"), r(top).alias("y1"))
    return F.when(page.isNotNull() & x0.isNotNull(), made).cast(BOX)


class Facts:
    """Fact tables by name, and what is derived from them. What many rules share is written to ``shelf``, bucketed by document."""

    def __init__(self, spark: SparkSession, tables: dict[str, DataFrame], shelf: Shelf | None = None):
        self.spark = spark
        self.given = set(tables)
        self.shelf = shelf or Shelf(spark)
        for name, ddl in TABLES.items():
            df = tables.get(name)
            setattr(self, name, spark.createDataFrame([], ddl) if df is None else df)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> "Facts":
        """A store written by ``save``; tables that are missing are empty."""
        tables = {}
        for name, ddl in TABLES.items():
            try:
                tables[name] = spark.read.schema(ddl).parquet(f"{path}/{name}")
            except AnalysisException:
                continue
        return cls(spark, tables)

    def save(self, path: str) -> None:
        for name in TABLES:
            if name in self.given:
                getattr(self, name).write.mode("overwrite").parquet(f"{path}/{name}")

    def close(self) -> None:
        """Drop the tables that were written for this audit."""
        self.shelf.clear()

    def _keep(self, df: DataFrame, name: str) -> DataFrame:
        return self.shelf.put(df, name)

    def prepare(self) -> None:
        """Write what rules share, each table once, before rules are built side by side."""
        with ThreadPoolExecutor(3) as pool:
            list(pool.map(lambda name: getattr(self, name), ("told", "lines", "features")))
        self.cells  # noqa: B018 - needs told

    # -- documents and pages

    @cached_property
    def n_pages(self) -> DataFrame:
        return self.docs.select("doc_id", "n_pages", "has_struct")

    @cached_property
    def tagged_docs(self) -> DataFrame:
        return self.docs.where("has_struct").select("doc_id", "n_pages")

    # -- elements

    @cached_property
    def el(self) -> DataFrame:
        """Elements with heading level, 1-based place among logical siblings, and finding page."""
        return self.told

    @cached_property
    def _placed(self) -> DataFrame:
        w = Window.partitionBy("doc_id", "logical_parent_ord").orderBy("ord")
        first_ref = self.mcrefs.where("page is not null").groupBy("doc_id", "ord").agg(F.min_by("page", "seq").alias("ref_page"))
        below = self.elements.where("page is not null").select("doc_id", "ord", "page", F.explode("ancestors").alias("a_ord")).where("ord > a_ord")
        below = below.groupBy("doc_id", F.col("a_ord").alias("ord")).agg(F.min_by("page", "ord").alias("child_page"))
        e = self.elements.join(first_ref, ["doc_id", "ord"], "left").join(below, ["doc_id", "ord"], "left")
        return (
            e.withColumn("place", F.row_number().over(w))
            .withColumn("is_heading", F.col("type").rlike("^H([1-9][0-9]*)?$"))
            .withColumn("level", F.expr("try_cast(nullif(regexp_extract(type, '^H([1-9][0-9]*)$', 1), '') as int)"))
            .withColumn("find_page", F.coalesce("page", "ref_page", "child_page") + 1)
        )

    def above(self, nodes: DataFrame) -> DataFrame:
        """``nodes`` (doc_id, ord of an element, ...), a row for each element that holds it, itself included (a_ord): an equi-join, at most 61 rows a node."""
        return nodes.join(self.elements.select("doc_id", "ord", "ancestors"), ["doc_id", "ord"]).withColumn("a_ord", F.explode("ancestors")).drop("ancestors")

    @cached_property
    def mcid_text(self) -> DataFrame:
        """Text of each marked-content sequence, runs in order, one space between unless one is there."""
        ordered = F.transform(F.sort_array(F.collect_list(F.struct("run_seq", "text"))), lambda x: x["text"])
        spaced = lambda a, x: F.when((a == "") | a.endswith(" ") | x.startswith(" "), F.concat(a, x)).otherwise(F.concat(a, F.lit(" "), x))
        return self.runs.where("mcid is not null").groupBy("doc_id", "page", "stream", "mcid").agg(F.aggregate(ordered, F.lit(""), spaced).alias("text"))

    @cached_property
    def refs(self) -> DataFrame:
        """Marked-content references with their text and extent; a form's ids fall back to the page's."""
        m = self.mcrefs.alias("m")
        t = self.mcid_text.alias("t")
        p = self.mcid_text.where("stream is null").select("doc_id", "page", "mcid", F.col("text").alias("page_text")).alias("p")
        painted = self.runs.select("doc_id", "page", "stream", "mcid", "x0", "y0", "x1", "y1").unionByName(self.images.select("doc_id", "page", "stream", "mcid", "x0", "y0", "x1", "y1"))
        b = painted.where("mcid is not null").groupBy("doc_id", "page", "stream", "mcid").agg(*[f(c).alias(c) for f, c in ((F.min, "x0"), (F.min, "y0"), (F.max, "x1"), (F.max, "y1"))]).alias("b")
        joined = (
            m.join(t, (F.col("m.doc_id") == F.col("t.doc_id")) & (F.col("m.page") == F.col("t.page")) & (F.col("m.mcid") == F.col("t.mcid")) & F.col("m.stream").eqNullSafe(F.col("t.stream")), "left")
            .join(p, (F.col("m.doc_id") == F.col("p.doc_id")) & (F.col("m.page") == F.col("p.page")) & (F.col("m.mcid") == F.col("p.mcid")), "left")
            .join(b, (F.col("m.doc_id") == F.col("b.doc_id")) & (F.col("m.page") == F.col("b.page")) & (F.col("m.mcid") == F.col("b.mcid")) & F.col("m.stream").eqNullSafe(F.col("b.stream")), "left")
        )
        return joined.select("m.*", F.coalesce("t.text", F.when(F.col("m.stream").isNotNull(), F.col("p.page_text"))).alias("text"), "b.x0", "b.y0", "b.x1", "b.y1")

    @cached_property
    def told(self) -> DataFrame:
        """Elements with text (own and below, in tree order), own_text, extent over all pages, has_content, box."""
        full = F.col("text").isNotNull() & (F.col("text") != "")
        packed = F.sort_array(F.collect_list(F.when(full, F.struct("ord", "seq", "text"))))
        own = F.sort_array(F.collect_list(F.when(full & (F.col("ord") == F.col("a_ord")), F.struct("ord", "seq", "text"))))
        joined = lambda c: F.concat_ws(" ", F.transform(c, lambda x: x["text"]))
        got = self.above(self.refs).groupBy("doc_id", F.col("a_ord").alias("ord")).agg(
            joined(packed).alias("text"),
            joined(own).alias("own_text"),
            *[f(c).alias(c) for f, c in ((F.min, "x0"), (F.min, "y0"), (F.max, "x1"), (F.max, "y1"))],
            F.min_by("page", F.when(F.col("page").isNotNull(), F.struct("ord", "seq"))).alias("box_page"),
        )
        bearing = self.elements.where("coalesce(alt, '') <> '' or coalesce(actual_text, '') <> ''").select("doc_id", "ord").unionByName(self.mcrefs.select("doc_id", "ord")).unionByName(self.objrefs.select("doc_id", "ord"))
        bears = self.above(bearing).select("doc_id", F.col("a_ord").alias("ord")).distinct().withColumn("has_content", F.lit(True))
        e = self._placed.join(got, ["doc_id", "ord"], "left").join(bears, ["doc_id", "ord"], "left")
        lb, ok = F.col("layout_bbox"), (F.size("layout_bbox") == 4) & F.col("find_page").isNotNull()
        at = lambda i: F.get(lb, F.lit(i))
        laid = box(F.col("find_page") - 1, at(0), at(1), at(2), at(3))
        return self._keep(
            e.withColumns({
                "norm_text": tx.nfkc(F.coalesce("text", F.lit(""))), "text": F.coalesce("text", F.lit("")), "own_text": F.coalesce("own_text", F.lit("")), "has_content": F.coalesce("has_content", F.lit(False)),
                "box": F.when(ok, laid).otherwise(box(F.col("box_page"), F.col("x0"), F.col("y0"), F.col("x1"), F.col("y1"))),
            }).drop("box_page", "ancestors"),
            "told",
        )

    @cached_property
    def parents(self) -> DataFrame:
        """doc_id, ord and the logical parent's type."""
        p = self.elements.select("doc_id", F.col("ord").alias("logical_parent_ord"), F.col("type").alias("parent_type"))
        return self.elements.select("doc_id", "ord", "logical_parent_ord").join(p, ["doc_id", "logical_parent_ord"], "left")

    # -- page content

    @cached_property
    def lines(self) -> DataFrame:
        """Runs on one baseline: doc_id, page, line_no, text, extent, artifact_share, tagged_share."""
        r = self.runs.withColumn("mid", (F.col("y0") + F.col("y1")) / 2)
        order = [F.col("mid").desc(), F.col("x0"), F.col("run_seq")]
        before = r.withColumn("before", F.lag("mid").over(Window.partitionBy("doc_id", "page").orderBy(*order)))
        r = k.islands(before, ["doc_id", "page"], order, F.abs(F.col("mid") - F.col("before")) > 0.5 * F.greatest("size", F.lit(1.0)), "line_no")
        gap = F.col("x0") - F.lag("x1").over(Window.partitionBy("doc_id", "page", "line_no").orderBy("x0", "run_seq"))
        r = r.withColumn("piece", F.when(gap > 0.15 * F.col("size"), F.concat(F.lit(" "), F.col("text"))).otherwise(F.col("text")))
        n = F.length("text")
        share = lambda c: F.sum(F.when(c, n).otherwise(0)) / F.greatest(F.sum(n), F.lit(1))
        return self._keep(
            r.groupBy("doc_id", "page", "line_no").agg(
                F.concat_ws("", F.transform(F.sort_array(F.collect_list(F.struct("x0", "run_seq", "piece"))), lambda x: x["piece"])).alias("text"),
                F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"),
                share(F.col("artifact")).alias("artifact_share"), share(F.col("mcid").isNotNull() & ~F.col("artifact")).alias("tagged_share"),
            ),
            "lines",
        )

    @cached_property
    def furniture(self) -> DataFrame:
        """Keys of lines that recur on three pages, or on all (two at least) of fewer than six."""
        keyed = self.lines.select("doc_id", "page", tx.furniture_key(F.col("text")).alias("key")).where(F.length("key") >= 4).join(self.n_pages, "doc_id")
        need = F.when(F.col("n_pages") >= 6, 3).otherwise(F.greatest(F.lit(2), F.col("n_pages")))
        return keyed.groupBy("doc_id", "key").agg(F.countDistinct("page").alias("n"), F.first("n_pages").alias("n_pages")).where(F.col("n") >= need).select("doc_id", "key")

    @cached_property
    def figures_described(self) -> DataFrame:
        """(doc_id, page, stream, mcid) of content inside a Figure whose alternative has three words or more."""
        fig = self.elements.where("type = 'Figure'").where(F.size(F.split(tx.collapse(F.col("alt")), " ")) >= 3).select("doc_id", F.col("ord").alias("a_ord"))
        return self.above(self.mcrefs).join(fig, ["doc_id", "a_ord"], "left_semi").select("doc_id", "page", "stream", "mcid").distinct()

    @cached_property
    def scans(self) -> DataFrame:
        """Pages that are an image and no text to speak of: doc_id, page, boxes."""
        chars = self.runs.groupBy("doc_id", "page").agg(F.sum(F.length(tx.collapse(F.col("text")))).alias("chars"))
        big = self.images.join(self.pages.select("doc_id", "page", "width", "height"), ["doc_id", "page"]).where("(x1 - x0) * (y1 - y0) >= 0.5 * greatest(1.0, width * height)")
        d = self.figures_described.alias("d")
        b = big.alias("b")
        told = b.join(d, (F.col("b.doc_id") == F.col("d.doc_id")) & (F.col("b.page") == F.col("d.page")) & (F.col("b.mcid") == F.col("d.mcid")) & F.col("b.stream").eqNullSafe(F.col("d.stream")), "left_semi").select("doc_id", "page").distinct()
        found = big.join(chars, ["doc_id", "page"], "left").where("coalesce(chars, 0) <= 5").join(told, ["doc_id", "page"], "left_anti")
        packed = F.sort_array(F.collect_list(F.struct("paint_ord", box(F.col("page"), F.col("x0"), F.col("y0"), F.col("x1"), F.col("y1")).alias("box"))))
        return found.groupBy("doc_id", "page").agg(F.transform(packed, lambda x: x["box"]).alias("boxes"))

    # -- tables

    @cached_property
    def cells(self) -> DataFrame:
        """Cells of each table: table_ord, row_ord, ord, kind, text, spans, scope, headers, id."""
        cells = self.told.where("type in ('TH', 'TD')").select("doc_id", F.col("logical_parent_ord").alias("row_ord"), "ord", F.col("type").alias("kind"), tx.collapse(F.col("text")).alias("text"), F.coalesce("colspan", F.lit(1)).alias("colspan"), F.coalesce("rowspan", F.lit(1)).alias("rowspan"), "scope", F.coalesce("headers", F.array().cast("array<string>")).alias("headers"), "id", "box")
        return self._keep(self.rows.join(cells, ["doc_id", "row_ord"]), "cells")

    @cached_property
    def rows(self) -> DataFrame:
        """Rows of each table, under the table itself or under row groups at any depth (the reader has walked up)."""
        return self.elements.where("type = 'TR' and table_ord is not null").select("doc_id", "table_ord", F.col("ord").alias("row_ord"))

    # -- owners of annotations

    @cached_property
    def owners(self) -> DataFrame:
        """Elements that hold an annotation: doc_id, key, type, alt."""
        return self.objrefs.where("target is not null").join(self.elements.select("doc_id", "ord", "type", "alt"), ["doc_id", "ord"]).select("doc_id", F.col("target").alias("key"), "type", "alt")

    # -- features

    @cached_property
    def features(self) -> DataFrame:
        """doc_id and a map from feature to whether the document has it."""
        flag = lambda df, **flags: df.groupBy("doc_id").agg(*[F.bool_or(F.expr(e)).alias(n) for n, e in flags.items()])
        e = flag(self.elements, headings="type rlike '^H([1-9][0-9]*)?$'", tables="type in ('Table', 'TR', 'TH', 'TD')", lists="type in ('L', 'LI', 'LBody')", figures="type = 'Figure'", formulas="type = 'Formula'", notes="type in ('Note', 'Reference')", link_elements="type = 'Link'")
        a = flag(self.annotations, link_annots="subtype = 'Link'", annots="true", widgets="subtype = 'Widget'", media="subtype in ('Screen', 'RichMedia', 'Movie', 'Sound', '3D')", signatures="field_ft = 'Sig'")
        p = flag(self.pages, xobjects="has_form_xobject", scanned="has_image_xobject")
        f = self.fonts.select("doc_id").distinct().withColumn("fonts", F.lit(True))
        s = self.pairs.select("doc_id").distinct().withColumn("source", F.lit(True))
        d = self.docs
        for part in (e, a, p, f, s):
            d = d.join(part, "doc_id", "left")
        c = lambda x: F.coalesce(F.expr(x), F.lit(False))
        flags = {
            "source": "source", "struct": "has_struct", "text": "fonts", "fonts": "fonts", "headings": "headings", "tables": "tables", "lists": "lists", "figures": "figures", "formulas": "formulas", "notes": "notes",
            "links": "coalesce(link_elements, false) or coalesce(link_annots, false)", "annots": "annots", "forms": "coalesce(widgets, false) or coalesce(has_acroform, false)", "acroform": "has_acroform", "interactive": "annots",
            "media": "media", "actions": "coalesce(has_actions, false) or coalesce(widgets, false)", "encrypted": "is_encrypted", "oc": "has_oc", "embedded": "has_embedded", "threads": "has_threads", "signatures": "signatures",
            "xobjects": "xobjects", "scanned": "scanned", "lang": "trim(coalesce(lang, '')) <> ''", "title": "trim(coalesce(xmp_title, info_title, '')) <> '' or trim(coalesce(info_title, '')) <> ''", "pages3": "n_pages >= 3",
        }
        entries = [x for n, e_ in flags.items() for x in (F.lit(n), c(e_))]
        return self._keep(d.where("error is null").select("doc_id", F.create_map(*entries).alias("features")), "features")
