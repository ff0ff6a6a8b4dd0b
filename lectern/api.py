"""The library's entry: ``check`` runs the audit over files or a fact store."""

from __future__ import annotations

import os
import time
from dataclasses import dataclass, field
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .catalogue import select
from .plans import rollup
from .plans.facts import Facts
from .sources.files import binary_files, facts_of
from .sources.shared import co_located


@dataclass
class Results:
    """Tables of one audit. All are DataFrames with ``doc_id``."""

    facts: Facts
    findings: DataFrame
    runs: DataFrame
    seconds: float = 0.0
    crashed: dict[str, str] = field(default_factory=dict)

    @cached_property
    def results(self) -> DataFrame:
        """One row a document: counts weighted by ``count``, verdict, features."""
        return rollup.results(self.facts, self.findings)

    @cached_property
    def criteria(self) -> DataFrame:
        return rollup.criteria(self.facts, self.findings, self.runs)

    @property
    def ordered(self) -> DataFrame:
        return rollup.in_order(self.findings, self.facts.spark)

    @property
    def totals(self) -> DataFrame:
        return rollup.batch_totals(self.results)

    def close(self) -> None:
        """Drop the tables that were written for this audit; its DataFrames can't be read any more."""
        self.facts.close()

    def exit_code(self, fail_on: str = "error") -> int:
        return rollup.exit_code(self.results, fail_on)


def check(spark: SparkSession, paths=None, source=None, only=None, skip=None, layers=None, facts: Facts | None = None, store: str | None = None) -> Results:
    """Audit files (or ``facts``). ``source`` is the original that every file is compared with.

    ``only``, ``skip`` and ``layers`` choose rules before anything runs; rules left out have no run. A file that can't be
    read gets the verdict ``unreadable``; a rule that can't be built is recorded as crashed.
    """
    began = time.time()
    only, skip, layers = (set(x) if x else None for x in (only, skip, layers))
    rules = select(only, skip, layers)
    with co_located(spark):
        if facts is None:
            paths = [paths] if isinstance(paths, (str, os.PathLike)) else list(paths or [])
            files = binary_files(spark, [str(p) for p in paths])
            pairs = None
            if source:
                other = binary_files(spark, [str(source)])
                source_id = other.select("doc_id").first()["doc_id"]
                pairs = files.select("doc_id", F.lit(source_id).alias("source_id")).where("doc_id <> source_id")
                files = files.where(F.col("doc_id") != source_id).unionByName(other)
            facts = facts_of(spark, files, store, pairs)
            if source:
                facts = _without_sources(facts)
        findings, crashed, missing = rollup.collect_findings(facts, rules)
        runs = facts.shelf.put(rollup.rule_runs(facts, findings, rules, crashed, missing), "runs")
    return Results(facts, findings, runs, time.time() - began, crashed)


def _without_sources(facts: Facts) -> Facts:
    """Originals are read for comparison only: they get no verdict of their own."""
    only_sources = facts.pairs.select(F.col("source_id").alias("doc_id")).join(facts.pairs.select("doc_id"), "doc_id", "left_anti").distinct()
    facts.features  # noqa: B018 - built from all documents, then narrowed
    facts.__dict__["features"] = facts.features.join(only_sources, "doc_id", "left_anti")
    facts.__dict__["reported"] = facts.docs.join(only_sources, "doc_id", "left_anti")
    return facts
