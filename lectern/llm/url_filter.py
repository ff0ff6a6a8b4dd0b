"""URL filtering by host-suffix and path-prefix expressions (DataFrame functions only).

Each url is expanded into host-suffix x path-prefix expressions, as long as rules are; expressions
meet rules in an equi-join on a short prefix of their SHA-256, the full digest confirms, and the
longest rule wins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rules up to this many bytes are sent to all executors; a larger list is joined by shuffle.
BROADCAST_BYTES = 64 << 20
PREFIX = 8
_UP, _LOW = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, ASCII letters lower-cased."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), _UP, _LOW)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_table(spark: SparkSession, rules: list[tuple[str, str, str]]) -> DataFrame:
    """Rules (host, path, verdict) as a DataFrame."""
    return spark.createDataFrame(rules, "rule_host string, rule_path string, rule_verdict string")


def prepare(rules: DataFrame) -> DataFrame:
    """One row per rule text with its digests. Of rules alike but for the verdict, block stands."""
    text = F.concat("rule_host", "rule_path")
    # The separator keeps host and path apart, so that a/b is not taken for ab/.
    return (
        rules.where("rule_host is not null and rule_path is not null")
        .withColumn("rule_host", F.translate("rule_host", _UP, _LOW))
        .groupBy("rule_host", "rule_path")
        .agg(F.max(F.when(F.col("rule_verdict") == "block", 1).otherwise(0)).alias("blocks"))
        .select(
            "rule_host",
            "rule_path",
            text.alias("rule"),
            F.when(F.col("blocks") == 1, "block").otherwise("allow").alias("rule_verdict"),
            F.sha2(F.concat_ws("\n", "rule_host", "rule_path"), 256).alias("rule_digest"),
        )
        .withColumn("rule_prefix", F.substring("rule_digest", 1, PREFIX))
    )


def judge_urls(spark: SparkSession, pages: DataFrame, rules: DataFrame, default: str = "allow", key: str = "page_id", url: str = "url") -> DataFrame:
    """page_id, url, host, path, rule, verdict for every row of ``pages``.

    A null url, or one without ``://``, has an empty host and path and gets the default verdict unless
    a rule with an empty host fits. Of fitting rules the one with the most characters wins, then the
    one with the longer host. Repeated rows come back as often as they came; other columns are ignored.
    """
    ready = prepare(rules)
    size = ready.agg(
        F.max(F.size(F.split("rule_host", r"\."))).alias("labels"),
        F.collect_set(F.length("rule_path")).alias("lengths"),  # distinct lengths: bounded by the longest url path
        F.sum(F.octet_length("rule") + 160).alias("bytes"),
    ).first()
    labels, lengths = size["labels"] or 0, sorted(size["lengths"] or [])
    # A short prefix may be that of several rules: they come together, so an expression meets one row, and the full digest tells.
    side = ready.groupBy("rule_prefix").agg(F.collect_list(F.struct("rule_digest", "rule", "rule_host", "rule_verdict")).alias("held"))
    side = F.broadcast(side) if (size["bytes"] or 0) <= BROADCAST_BYTES else side
    base = pages.select(F.col(key).alias("page_id"), F.col(url).alias("url"))
    base = base.withColumn("host", host_of(F.col("url"))).withColumn("path", path_of(F.col("url")))
    if not lengths:
        return base.select("page_id", "url", "host", "path", F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"))
    suffixes = F.array_distinct(F.array(*[F.substring_index("host", ".", -k) for k in range(1, labels + 1)]))
    prefixes = F.array_distinct(F.array(*[F.substring("path", 1, n) if n else F.lit("") for n in lengths]))
    pairs = F.flatten(F.transform(suffixes, lambda h: F.transform(prefixes, lambda p: F.concat_ws("\n", h, p))))
    # posexplode: the expression numbered 0 counts its row, so repeated rows are told apart from expressions.
    seen = base.select("page_id", "url", "host", "path", F.posexplode(pairs).alias("at", "expression"))
    seen = seen.withColumn("digest", F.sha2("expression", 256)).withColumn("prefix", F.substring("digest", 1, PREFIX))
    met = seen.join(side, F.col("prefix") == F.col("rule_prefix"), "left")
    hit = F.get(F.filter("held", lambda r: r["rule_digest"] == F.col("digest")), F.lit(0))
    met = met.withColumn("hit", hit).select("page_id", "url", "host", "path", "at", "hit.*")
    best = F.max(
        F.when(
            F.col("rule").isNotNull(),
            F.struct(F.length("rule").alias("n"), F.length("rule_host").alias("h"), F.col("rule").alias("rule"), F.col("rule_verdict").alias("verdict")),
        )
    )
    judged = met.groupBy("page_id", "url", "host", "path").agg(best.alias("best"), F.count(F.when(F.col("at") == 0, 1)).alias("copies"))
    return judged.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select(
        "page_id", "url", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict")
    )
