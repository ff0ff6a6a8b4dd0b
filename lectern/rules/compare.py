"""Rules that hold a document against its original (``pairs``); both are documents of the store."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import kernels as k
from .base import findings, rule, say

KINDS = tuple("Figure Formula L Link Note Table".split())


@rule("SEM-001")
def structure(t):
    kind = F.when(F.col("type").rlike("^H([1-9][0-9]*)?$"), "heading").when(F.col("type").isin(*KINDS), F.col("type"))
    counts = t.elements.withColumn("kind", kind).where("kind is not null").groupBy("doc_id", "kind").agg(F.count("*").alias("n"))
    sources = t.pairs.join(t.docs.where("has_struct").select(F.col("doc_id").alias("source_id")), "source_id")
    was = sources.join(counts.select(F.col("doc_id").alias("source_id"), "kind", F.col("n").alias("was")), "source_id")
    lost = was.join(counts, ["doc_id", "kind"], "left").withColumn("now", F.coalesce("n", F.lit(0))).where("now < was")
    part = say(F.col("kind"), ": ", F.col("was").cast("string"), " to ", F.col("now").cast("string"))
    g = lost.groupBy("doc_id").agg(F.concat_ws(", ", F.sort_array(F.collect_list(part))).alias("what"))
    return findings(g, say("the document has less structure than its original (", F.col("what"), ")"), evidence=F.col("what"))


@rule("SEM-002")
def text(t):
    words = t.runs.select("doc_id", "page", F.explode(tx.words(tx.nfkc("text"))).alias("w")).where(F.length("w") >= 3).withColumn("w", F.lower("w"))
    of_source = t.pairs.join(words.withColumnRenamed("doc_id", "source_id"), "source_id").select("doc_id", "page", "w")
    n = t.docs.select("doc_id", "n_pages")
    pages = t.pairs.join(n, "doc_id").join(n.select(F.col("doc_id").alias("source_id"), F.col("n_pages").alias("source_pages")), "source_id")
    common = of_source.join(pages.select("doc_id", F.least("n_pages", "source_pages").alias("m")), "doc_id").where("page < m").select("doc_id", "page", "w")
    loss = k.multiset_loss(common, words, ["doc_id", "page"], "w")
    worst = F.max_by(F.struct("page", "lost"), F.when(F.col("lost") / F.col("total") > 0.02, F.struct("lost", (-F.col("page")).alias("p"))))
    g = loss.groupBy("doc_id").agg(F.sum("lost").alias("lost"), F.sum("total").alias("total"), worst.alias("worst")).where("lost / total > 0.02")
    one = findings(g, say(F.col("lost").cast("string"), " of ", F.col("total").cast("string"), " words of the original are missing"), F.col("worst")["page"] + 1, F.col("lost"))
    changed = pages.where("n_pages <> source_pages")
    return one.unionByName(findings(changed, say("the original has ", F.col("source_pages").cast("string"), " pages, the document ", F.col("n_pages").cast("string"))))


@rule("SEM-003")
def appearance(t):
    """Needs grey images of the pages (``rasters``); without them nothing is found and the run counts as skipped."""
    a = t.rasters.where("page < 80").alias("a")
    b = t.pairs.join(t.rasters.withColumnRenamed("doc_id", "source_id"), "source_id").alias("b")
    both = a.join(b, (F.col("a.doc_id") == F.col("b.doc_id")) & (F.col("a.page") == F.col("b.page")))
    same = (F.col("a.width") == F.col("b.width")) & (F.col("a.height") == F.col("b.height"))
    total = F.aggregate(F.zip_with("a.pixels", "b.pixels", lambda x, y: F.abs(x - y).cast("long")), F.lit(0).cast("long"), lambda s, x: s + x)
    diff = both.select("a.doc_id", "a.page", F.when(same, total / (255.0 * F.greatest(F.size("a.pixels"), F.lit(1)))).otherwise(1.0).alias("diff"))
    first_other = diff.where("diff = 1.0").groupBy("doc_id").agg(F.min("page").alias("stop"))
    seen = diff.join(first_other, "doc_id", "left").where("(stop is null or page <= stop) and diff > 0.006")
    g = seen.groupBy("doc_id").agg(F.max_by(F.struct("page", "diff"), F.struct("diff", (-F.col("page")).alias("p"))).alias("w"))
    return findings(g, say("page ", (F.col("w")["page"] + 1).cast("string"), " looks different from the original (", F.format_number(F.col("w")["diff"], 3), ")"), F.col("w")["page"] + 1)
