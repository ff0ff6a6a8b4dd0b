"""The web-page adapter: html of ``pages`` to facts, by expressions alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Scripts, styles and comments: what they hold looks like markup and isn't.
_HIDDEN = r"(?is)<script\b.*?</script\s*>|<style\b.*?</style\s*>|<!--.*?-->"


def visible(html: Column) -> Column:
    return F.regexp_replace(F.coalesce(html, F.lit("")), _HIDDEN, "")


def page_facts(pages: DataFrame) -> DataFrame:
    """page_id, lang, title, h1, headings (levels in order), links (texts), n_paragraphs, n_items, n_lists."""
    clean = pages.select("page_id", "html", visible(F.col("html")).alias("body"))
    plain = lambda c: F.trim(F.regexp_replace(F.regexp_replace(c, r"<[^>]*>", " "), r"[ \t\r\n]+", " "))
    return clean.select(
        "page_id",
        F.regexp_extract("html", r'<html[^>]* lang="([^"]*)"', 1).alias("lang"),
        plain(F.regexp_extract("body", r"(?is)<title>(.*?)</title>", 1)).alias("title"),
        plain(F.regexp_extract("body", r"(?is)<h1>(.*?)</h1>", 1)).alias("h1"),
        F.regexp_extract_all("body", F.lit(r"<h([1-6])[ >]"), F.lit(1)).alias("headings"),
        F.transform(F.regexp_extract_all("body", F.lit(r"(?is)<a\b[^>]*>(.*?)</a>"), F.lit(1)), plain).alias("links"),
        F.size(F.regexp_extract_all("body", F.lit(r"(<p[ >])"), F.lit(1))).alias("n_paragraphs"),
        F.size(F.regexp_extract_all("body", F.lit(r"(<li[ >])"), F.lit(1))).alias("n_items"),
        F.size(F.regexp_extract_all("body", F.lit(r"(<ul[ >])"), F.lit(1))).alias("n_lists"),
    )
