"""From findings to rule runs, criteria and verdicts: joins and grouped minima over small dimensions."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..catalogue import BY_ID, FEATURES, Rule, criteria_df, rules_df
from ..operators import kernels as k
from ..rules.base import builders
from ..schema import FINDING, FINDING_COLUMNS
from .facts import Facts

#: Rules that need a table from another tool; without it they are skipped.
NEEDS = {"TAG-003": ("witness_words", "needs words of another extractor"), "SEM-003": ("rasters", "needs page images")}
#: Jobs that run side by side.
LANES = 8
STATUSES = "fail warning pass not-applicable manual not-tested".split()
_RUN = "rule string, crash string"


def applicable(requires: Column, features: Column) -> Column:
    """Whether a document has one of the alternatives that a rule requires; an unknown feature counts as there."""
    return requires.isNull() | F.exists(F.split(requires, r"\|"), lambda f: F.coalesce(features[f], F.lit(True)))


def _features_of_corpus(facts: Facts) -> set[str]:
    """Features that some document has: rules that none needs aren't built. One row comes back."""
    row = facts.features.agg(*[F.bool_or(F.col("features")[f]).alias(f) for f in FEATURES]).first()
    return {f for f in FEATURES if row[f] is None or row[f]}


def collect_findings(facts: Facts, rules: list[Rule]) -> tuple[DataFrame, dict[str, str], set[str]]:
    """Findings of all rules that some document needs, those that crashed while being built, those that lack a table.

    Rules are built and run in ``LANES`` jobs side by side: planning a rule takes the driver longer than small batches take the
    executors, and on large ones the jobs share the cluster.
    """
    have, wanted, missing = _features_of_corpus(facts), [], set()
    for r in rules:
        if r.status == "planned" or builders().get(r.id) is None:
            continue
        if r.id in NEEDS and NEEDS[r.id][0] not in facts.given:
            missing.add(r.id)
        elif not r.requires or any(f in have or f not in FEATURES for f in r.requires.split("|")):
            wanted.append(r)
    crashed: dict[str, str] = {}

    def run(lane: int) -> DataFrame | None:
        parts = []
        for r in wanted[lane::LANES]:
            try:
                own = {"rule": F.lit(r.id), "severity": F.coalesce("severity", F.lit(r.severity)), "requires": F.lit(r.requires).cast("string")}
                parts.append(builders()[r.id](facts).withColumns(own).select(*FINDING_COLUMNS, "requires"))
            except Exception as e:  # noqa: BLE001 - one broken rule must not hide the others
                crashed[r.id] = f"{type(e).__name__}: {e}"[:200]
        if not parts:
            return None
        # A rule speaks only about documents that it applies to.
        found = reduce(DataFrame.unionByName, parts).join(facts.features, "doc_id").where(applicable(F.col("requires"), F.col("features")))
        return facts.shelf.put(found.select(*FINDING_COLUMNS), f"findings_{lane}")

    builders()
    facts.prepare()
    with ThreadPoolExecutor(LANES) as pool:
        found = [df for df in pool.map(run, range(LANES)) if df is not None]
    return reduce(DataFrame.unionByName, found) if found else facts.spark.createDataFrame([], FINDING), crashed, missing


def rule_runs(facts: Facts, findings: DataFrame, rules: list[Rule], crashed: dict[str, str], missing: set[str]) -> DataFrame:
    """A row for each document and rule: status, reason, findings (weighted), outcome."""
    spark = facts.spark
    built = builders()
    rows = [(r.id, i, r.requires, FEATURES.get((r.requires or "").split("|")[0], f"no {r.requires}"), r.status == "planned" or r.id not in built, crashed.get(r.id), NEEDS[r.id][1] if r.id in missing else None) for i, r in enumerate(rules)]
    cat = F.broadcast(spark.createDataFrame(rows, "rule string, pos int, requires string, why string, planned boolean, crash string, lacks string"))
    rank = F.min(k.severity_rank(F.col("severity")))
    g = findings.groupBy("doc_id", "rule").agg(F.sum("count").alias("findings"), rank.alias("rank"))
    every = facts.features.withColumn("rule", F.explode(F.array(*[F.lit(r.id) for r in rules]) if rules else F.array().cast("array<string>"))).join(cat, "rule").join(g, ["doc_id", "rule"], "left")
    applies = applicable(F.col("requires"), F.col("features"))
    status = F.when(F.col("planned"), "not-implemented").when(~applies & (F.col("requires") == "source"), "skipped").when(~applies, "not-applicable").when(F.col("lacks").isNotNull(), "skipped").when(F.col("crash").isNotNull(), "crashed").otherwise("ran")
    s = F.col("status")
    outcome = F.when(s == "ran", F.when(F.col("rank").isNull(), "pass").when(F.col("rank") == 0, "fail").when(F.col("rank") == 1, "warning").otherwise("info")).when(s == "not-applicable", "not-applicable").otherwise("not-run")
    return every.withColumn("status", status).select(
        "doc_id", "pos", "rule", "status", F.when(s.isin("skipped", "not-applicable"), F.when(~applies, F.col("why")).otherwise(F.col("lacks"))).when(s == "crashed", F.col("crash")).alias("reason"),
        F.coalesce("findings", F.lit(0)).alias("findings"), outcome.alias("outcome"),
    )


def _status(rank: Column) -> Column:
    return F.when(rank == 0, "fail").when(rank == 1, "warning").when(rank == 2, "pass").when(rank == 3, "not-applicable").when(rank.isNotNull(), "not-tested")


def _outcome_rank(o: Column) -> Column:
    return F.when(o == "fail", 0).when(o == "warning", 1).when(o.isin("pass", "info"), 2).when(o == "not-applicable", 3).otherwise(5)


def criteria(facts: Facts, findings: DataFrame, runs: DataFrame) -> DataFrame:
    """A row for each document, framework and criterion: 31 checkpoints and 55 criteria, in their order.

    A rule that wasn't selected counts as not run. A checkpoint takes its status from conformance rules, else from
    semantic ones (``semantic_only``); a criterion from all its rules, but an absent feature comes before everything.
    """
    spark = facts.spark
    cat = rules_df(spark).select("rule", "pos", "layer", "checkpoint", "criteria")
    per = F.struct(F.lit("pdfua1").alias("framework"), F.col("checkpoint").alias("criterion"))
    links = F.concat(F.when(F.col("checkpoint").isNotNull(), F.array(per)).otherwise(F.array().cast("array<struct<framework:string,criterion:string>>")), F.transform("criteria", lambda c: F.struct(F.lit("wcag22").alias("framework"), c.alias("criterion"))))
    links = F.broadcast(cat.select("rule", "layer", F.explode(links).alias("x")).select("rule", "layer", "x.*"))  # some 170 rows
    counts = findings.groupBy("doc_id", "rule").agg(F.sum(F.when(F.col("severity") == "error", F.col("count")).otherwise(0)).alias("errors"), F.sum(F.when(F.col("severity") == "warning", F.col("count")).otherwise(0)).alias("warnings"))
    done = runs.join(counts, ["doc_id", "rule"], "left").select("doc_id", "rule", "outcome", F.coalesce("errors", F.lit(0)).alias("errors"), F.coalesce("warnings", F.lit(0)).alias("warnings"))
    every = facts.features.select("doc_id").withColumn("rule", F.explode(F.array(*[F.lit(r) for r in BY_ID])))
    o = every.join(done, ["doc_id", "rule"], "left").withColumn("r", _outcome_rank(F.coalesce("outcome", F.lit("not-run")))).join(links, "rule")
    conf, ua = F.col("layer") == "conformance", F.col("framework") == "pdfua1"
    g = o.groupBy("doc_id", "framework", "criterion").agg(
        F.min(F.when(conf, F.col("r"))).alias("conf"), F.min(F.when(~conf, F.col("r"))).alias("sem"), F.min("r").alias("all"),
        F.sum(F.when(conf | ~ua, F.col("errors")).otherwise(0)).alias("errors"), F.sum(F.when(conf | ~ua, F.col("warnings")).otherwise(0)).alias("warnings"),
        F.sort_array(F.collect_list("rule")).alias("rules"), F.sort_array(F.collect_list(F.when(F.col("r") <= 1, F.col("rule")))).alias("failing"),
    )
    dim = F.broadcast(criteria_df(spark))  # 86 rows
    full = facts.features.withColumn("key", F.explode(F.array(*[F.struct(F.lit(c.framework).alias("framework"), F.lit(c.id).alias("criterion")) for c in _criteria()]))).select("doc_id", "features", "key.*").join(dim, ["framework", "criterion"]).join(g, ["doc_id", "framework", "criterion"], "left")
    absent = F.when(F.col("needs").isNull(), False).when(F.col("needs") == "never", True).otherwise(~F.coalesce(F.col("features")[F.col("needs")], F.lit(False)))
    only_sem = F.col("conf").isNull() & (F.col("sem") < 5)
    mine = F.when(only_sem, F.col("sem")).otherwise(F.col("conf"))
    open_ = mine.isNull() | ((mine == 5) & F.coalesce(F.col("conf") == 5, F.lit(True)))
    checkpoint = F.when(open_, F.when(absent, "not-applicable").when(F.col("by_hand") | mine.isNull(), "manual").otherwise("not-tested")).otherwise(_status(mine))
    criterion = F.when(absent, "not-applicable").when(F.col("all").isNull(), "manual").otherwise(_status(F.col("all")))
    ua = F.col("framework") == "pdfua1"
    status = F.when(ua, checkpoint).otherwise(criterion)
    note = F.when(F.col("status") == "manual", F.when(F.col("by_hand"), "a person has to judge this").otherwise("no automated test")).when(
        F.col("by_hand") & F.when(ua, F.col("semantic_only")).otherwise((F.col("needs").isNotNull() & (F.col("needs") == "never")) | F.col("status").isin("pass")), "a person has to judge the rest"
    )
    none = F.array().cast("array<string>")
    return (
        full.withColumn("status", status)
        .withColumn("semantic_only", ua & F.coalesce(only_sem, F.lit(False)) & ~open_)
        .withColumn("note", note)
        .select("doc_id", "framework", "cpos", F.col("criterion").alias("id"), "name", "level", "status", "semantic_only", F.when(ua, _status(F.col("sem"))).alias("semantic_status"), "note", F.coalesce("errors", F.lit(0)).alias("errors"), F.coalesce("warnings", F.lit(0)).alias("warnings"), F.coalesce("rules", none).alias("rules"), F.coalesce("failing", none).alias("failing"))
    )


def _criteria():
    from ..catalogue import CRITERIA

    return CRITERIA


def tally(rows: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Criteria by status; every status has a column."""
    return rows.groupBy(*(by or []), "framework").agg(*[F.count_if(F.col("status") == s).alias(s) for s in STATUSES])


def results(facts: Facts, findings: DataFrame) -> DataFrame:
    """One row a document: weighted counts and the verdict."""
    n = lambda s: F.coalesce(F.sum(F.when(F.col("severity") == s, F.col("count"))), F.lit(0)).alias(f"{s}s" if s != "info" else s)
    g = findings.groupBy("doc_id").agg(n("error"), n("warning"), n("info"))
    z = lambda c: F.coalesce(c, F.lit(0))
    verdict = F.when(F.col("error").isNotNull(), "unreadable").otherwise(k.verdict(z("errors"), z("warnings")))
    d = getattr(facts, "reported", facts.docs).join(g, "doc_id", "left").join(facts.features, "doc_id", "left")
    return d.select("doc_id", "path", "error", "n_pages", "has_struct", z("errors").alias("errors"), z("warnings").alias("warnings"), z("info").alias("info"), verdict.alias("verdict"), F.map_filter("features", lambda _, v: v).alias("features"))


def in_order(findings: DataFrame, spark: SparkSession) -> DataFrame:
    """Findings by document, severity, page, rule and place in the catalogue."""
    pos = F.broadcast(rules_df(spark).select("rule", "pos"))
    return findings.join(pos, "rule").orderBy("doc_id", k.severity_rank(F.col("severity")), F.coalesce("page", F.lit(0)), "rule", "pos", "message").select(*FINDING_COLUMNS)


def batch_totals(rows: DataFrame) -> DataFrame:
    """Documents by verdict, with the total (verdict null)."""
    return rows.rollup("verdict").agg(F.count("*").alias("documents"), F.sum("errors").alias("errors"), F.sum("warnings").alias("warnings"))


def exit_code(rows: DataFrame, fail_on: str = "error") -> int:
    """2 where a document can't be read, 1 where one fails by ``fail_on`` (error, warning or never), else 0."""
    bad = F.lit(False) if fail_on == "never" else (F.col("errors") > 0) if fail_on == "error" else (F.col("errors") + F.col("warnings") > 0)
    worst = rows.agg(F.max(F.when(F.col("verdict") == "unreadable", 2).when(bad, 1).otherwise(0)).alias("c")).first()["c"]
    return worst or 0
