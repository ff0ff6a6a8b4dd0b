"""The corpus pipeline: raw documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and gives a DataFrame, which is written as Parquet and read again
as the next one's ``docs``. All but the last give the columns of ``documents``, and carry columns beyond these.

Rows that aren't as they should be: a null or empty text, or one of white space alone, fails the quality rules; the later stages
pass null texts on. ``near_dedup`` keeps rows without an id, and takes texts without words for copies of each other. Repeated rows are
copies: one stays. ``pack`` gives a null or empty text a piece of its end id. Texts are taken whole, however long; a tie goes to the
least id, and then to the least text. No rows in, no rows out.
"""

from __future__ import annotations

import atexit

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm import decontaminate, packing, quality_crf, simhash_forest, suffix_dedup
from lectern.llm.common import drop, ready, scratch, table
from lectern.llm.queries import vocabulary


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and whose lines are content for the most part (operator 1)."""
    model = quality_crf.train(spark, docs, table(spark, sf_dir, "labels"))
    return quality_crf.judge(docs, model, docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each near-duplicate class (operator 3)."""
    return simhash_forest.keep_one(spark, docs)


def repeat_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without passages that start earlier in the corpus (operator 6); ``n_chars`` follows."""
    return suffix_dedup.remove_repeats(spark, docs).withColumn("n_chars", F.length("text").cast("long"))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark item (operator 5)."""
    return decontaminate.drop_contaminated(spark, docs, table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces with their sequence and offset (operator 8)."""
    return packing.pack_documents(spark, docs, vocabulary("byte_bpe_50k.json"), end_id=2, capacity=1024, added=True, cache=150_000)  # workers also hold what other stages left


STAGES = [
    ("quality_rules", quality_rules),
    ("near_dedup", near_dedup),
    ("repeat_dedup", repeat_dedup),
    ("decontamination", decontamination),
    ("pack", pack),
]

#: Line fields, LSH, suffix sorting and tokenisation have no SQL form; tests run the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole ``documents`` table."""
    ready(spark)
    folder = scratch(spark, "pipeline")
    atexit.register(drop, folder)
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        place = f"file://{folder}/{k}-{name}"
        stage(spark, docs, sf_dir).write.parquet(place)
        docs = spark.read.parquet(place)
    return docs
