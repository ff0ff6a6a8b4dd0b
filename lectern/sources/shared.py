"""Tables in the cluster's shared folder, bucketed by document so that what is joined by document lies together already."""

from __future__ import annotations

import atexit
import os
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: Joins and groups by document and more use the partitioning by document; with it in place no side needs to be sent around.
CO_LOCATED = {"spark.sql.requireAllClusterKeysForCoPartition": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}


def root(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` or the checkpoint folder that was set; a private folder only where there is neither."""
    return spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir() or "file://" + os.path.join(os.environ.get("TMPDIR", "/tmp"), f"lectern-{spark.sparkContext.applicationId}")


def spread(df: DataFrame, by: str) -> DataFrame:
    """Rows that take milliseconds each, for all cores: by bytes a scan or an adaptive shuffle makes a few tasks of them, one for each core at best."""
    spark = df.sparkSession
    return df.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism), by)


def delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


class Shelf:
    """The bucketed tables of one audit; ``clear`` drops them and their files, at the driver's end at the latest."""

    def __init__(self, spark: SparkSession, path: str | None = None):
        self.spark, self.own = spark, path is None
        self.name = f"lectern_{uuid.uuid4().hex[:12]}"
        self.path = path or f"{root(spark)}/{self.name}"
        self.buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.tables: list[str] = []
        atexit.register(self.clear)

    def put(self, df: DataFrame, what: str, spread: bool = False) -> DataFrame:
        """Write ``df``, bucketed by doc_id, and read it back. ``spread``: its rows don't lie by document yet."""
        if spread:
            df = df.repartition(self.buckets, "doc_id")
        table = f"{self.name}_{what}"
        df.write.format("parquet").mode("overwrite").bucketBy(self.buckets, "doc_id").option("path", f"{self.path}/{what}").saveAsTable(table)
        self.tables.append(table)
        return self.spark.table(table)

    def clear(self) -> None:
        atexit.unregister(self.clear)
        tables, self.tables = self.tables, []
        try:
            for t in tables:
                self.spark.sql(f"drop table if exists {t}")
            if self.own and tables:
                delete(self.spark, self.path)
        except Exception:  # noqa: BLE001, S110 - the session has ended, and its folder goes with the cluster's
            pass


@contextmanager
def co_located(spark: SparkSession):
    before = {k: spark.conf.get(k, None) for k in CO_LOCATED}
    for k, v in CO_LOCATED.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
