"""Plumbing shared by the operators: shared folder, worker path, safe Arrow access."""

from __future__ import annotations

import atexit
import ctypes
import gc
import os
import shutil
import sys
import uuid
from contextlib import contextmanager
from pathlib import Path
from urllib.parse import urlparse

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Keys that more than one in so many rows have are sent around in ``spread_join``; there are no more of them than that.
CROWDED = 1000
_ROOT = str(Path(__file__).resolve().parents[2])


def ready(spark: SparkSession) -> SparkSession:
    """Make the package importable in Python workers and a checkpoint folder available."""
    env = spark.sparkContext.environment
    have = env.get("PYTHONPATH", "")
    if _ROOT not in have.split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (_ROOT, have) if x)
    env.setdefault("TOKENIZERS_PARALLELISM", "false")
    env.setdefault("OMP_NUM_THREADS", "1")
    shared_root(spark)
    return spark


def shared_root(spark: SparkSession) -> str:
    """The cluster's shared folder (``spark.checkpoint.dir``); a private one only where that is unset."""
    sc = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        root = "file://" + os.path.join(os.environ.get("TMPDIR", "/tmp"), f"lectern-{sc.applicationId}")
        spark.conf.set("spark.checkpoint.dir", root)
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(root)
    return root


def scratch(spark: SparkSession, what: str) -> str:
    """A fresh folder below the shared one, as a local path (a mounted shared filesystem)."""
    url = urlparse(shared_root(spark))
    if url.scheme not in ("", "file"):
        raise ValueError(f"the file-writing operators need a mounted shared folder, not {url.scheme}://")
    path = os.path.join(url.path, f"{what}-{uuid.uuid4().hex}")
    os.makedirs(path, exist_ok=True)
    return path


def drop(path: str) -> None:
    shutil.rmtree(path, ignore_errors=True)


@contextmanager
def whole_file(path: str):
    """A file that appears under its name when it is whole: a retried or speculative task leaves one of its writers' files."""
    tmp = f"{path}.{uuid.uuid4().hex}"
    try:
        with open(tmp, "wb") as out:
            yield out
        os.replace(tmp, path)
    except BaseException:
        if os.path.exists(tmp):
            os.remove(tmp)
        raise


def saved(df: DataFrame, eager: bool = True) -> DataFrame:
    """Cut lineage through the shared folder; survives lost executors."""
    return df.checkpoint(eager)


def bucketed(df: DataFrame, key: str) -> DataFrame:
    """A table in the shared folder, bucketed by ``key``: what is joined with it by that key comes to it. It goes when the driver ends."""
    spark = df.sparkSession
    n, name = partitions(spark), f"lectern_{uuid.uuid4().hex}"
    path = f"{shared_root(spark).rstrip('/')}/{name}"
    df.repartition(n, key).write.format("parquet").bucketBy(n, key).option("path", path).saveAsTable(name)
    atexit.register(_forget, spark, name, path)
    return spark.table(name)


def _forget(spark: SparkSession, name: str, path: str) -> None:
    try:
        spark.sql(f"drop table if exists {name}")
        drop(urlparse(path).path)
    except Exception:  # noqa: BLE001, S110 - the session has ended
        pass


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return ready(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def text_or_empty(col: str = "text"):
    return F.coalesce(F.col(col), F.lit(""))


def unused(columns: list[str], name: str) -> str:
    """A column name that no column has, in any case of letters."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def spread_join(left: DataFrame, right: DataFrame, key: str, weight: str) -> DataFrame:
    """``left`` joined with ``right``, which has one row a key and says in ``weight`` how many rows of ``left`` have it.

    The keys of more than one in ``CROWDED`` rows, so that many at most, are sent around: their rows don't meet in one task.
    """
    total = right.agg(F.sum(weight)).first()[0] or 0
    crowd = right.where(F.col(weight) * CROWDED > total)
    rest = left.join(F.broadcast(crowd.select(key)), key, "left_anti")
    return left.join(F.broadcast(crowd), key).unionByName(rest.join(right, key))


def trim() -> None:
    """A worker's freed memory goes back to the system, where the C library can do that."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        return


def give_back() -> None:
    """At a task's start: an encoder's cache that another operator left in the worker goes, and freed memory with it."""
    used = sys.modules.get("lectern.llm.tokenization")
    if used and used._ENCODERS:
        used._ENCODERS.clear()
        gc.collect()
    trim()
