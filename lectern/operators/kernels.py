"""Relational kernels that the audit rules and the registered queries are made of."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def severity_rank(c: Column) -> Column:
    return F.when(c == "error", 0).when(c == "warning", 1).otherwise(2)


def islands(df: DataFrame, by: list[str], order: list[Column], starts: Column, name: str) -> DataFrame:
    """Gaps and islands: a new island where ``starts`` holds (or is null); islands are numbered from 1 in order."""
    w = Window.partitionBy(*by).orderBy(*order)
    flagged = df.withColumn("__new", F.when(F.coalesce(starts, F.lit(True)), 1).otherwise(0))
    return flagged.withColumn(name, F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("__new")


def jumps(df: DataFrame, by: list[str], order: list[Column], level: str) -> DataFrame:
    """Rows whose level exceeds the one before by more than one; ``previous`` has that one."""
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn("previous", F.lag(level).over(w)).where(F.col(level) > F.col("previous") + 1)


def first_rows(df: DataFrame, by: list[str], order: list[Column]) -> DataFrame:
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def ordered_text(df: DataFrame, by: list[str], order: list[str], text: str, sep: str = " ") -> DataFrame:
    """Texts of each group joined in order."""
    packed = F.sort_array(F.collect_list(F.struct(*order, F.col(text).alias("__t"))))
    return df.groupBy(*by).agg(F.concat_ws(sep, F.transform(packed, lambda x: x["__t"])).alias("text"))


def subtree(ancestors: DataFrame, nodes: DataFrame, key: str = "doc_id") -> DataFrame:
    """(ancestor columns a_*, node columns) for each node in each ancestor's subtree, itself included: a range join inside ``key``."""
    a = ancestors.select(*[F.col(c).alias(c if c == key else f"a_{c}") for c in ancestors.columns])
    return a.join(nodes, key).where(F.col("ord").between(F.col("a_ord"), F.col("a_subtree_end")))


def multiset_loss(left: DataFrame, right: DataFrame, by: list[str], item: str) -> DataFrame:
    """Per group: items on the left, and how many of them (with multiplicity) the right lacks."""
    a = left.groupBy(*by, item).agg(F.count("*").alias("__a"))
    b = right.groupBy(*by, item).agg(F.count("*").alias("__b"))
    both = a.join(b, [*by, item], "left")
    return both.groupBy(*by).agg(F.sum("__a").alias("total"), F.sum(F.greatest(F.col("__a") - F.coalesce("__b", F.lit(0)), F.lit(0))).alias("lost"))


def recurring(df: DataFrame, by: list[str], key: str, page: str, need: Column) -> DataFrame:
    """Keys that at least ``need`` distinct pages of a group have."""
    return df.groupBy(*by, key).agg(F.countDistinct(page).alias("n_pages")).where(F.col("n_pages") >= need)


def outcome(findings: DataFrame, by: list[str], severity: str = "severity") -> DataFrame:
    """The worst severity of each group as an outcome."""
    rank = F.min(severity_rank(F.col(severity)))
    return findings.groupBy(*by).agg(F.when(rank == 0, "fail").when(rank == 1, "warning").otherwise("info").alias("outcome"))


def verdict(errors: Column, warnings: Column) -> Column:
    return F.when(errors > 0, "fail").when(warnings > 0, "review").otherwise("pass")


def overlaps(ax0: Column, ax1: Column, bx0: Column, bx1: Column) -> Column:
    return (ax1 > bx0) & (ax0 < bx1)
