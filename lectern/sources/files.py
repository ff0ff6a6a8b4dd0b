"""PDF files to a fact store: each file is parsed once, in Python, into one row of nested arrays."""

from __future__ import annotations

import glob
import os
import sys

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..plans.facts import Facts
from ..schema import TABLES
from .shared import Shelf

READ = [n for n in TABLES if n not in ("witness_words", "rasters", "pairs")]
#: Bytes of files whose rows are passed on at once.
FLUSH = 8 << 20
_ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def _ready(spark: SparkSession) -> None:
    env = spark.sparkContext.environment
    have = env.get("PYTHONPATH", "")
    if _ROOT not in have.split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (_ROOT, have) if x)


def _parsed_schema() -> T.StructType:
    """doc_id, and for each fact table an array of its rows without the id."""
    own = [T.StructField(n, T.ArrayType(T.StructType([f for f in T._parse_datatype_string(TABLES[n]).fields if f.name != "doc_id"]))) for n in READ]
    return T.StructType([T.StructField("doc_id", T.LongType()), *own])


def _column(values: list, kind: pa.DataType) -> pa.Array:
    """An Arrow column; structs come as tuples and maps as dicts."""
    if pa.types.is_struct(kind):
        given = pa.array([v is None for v in values], pa.bool_())
        parts = list(zip(*[v or (None,) * kind.num_fields for v in values])) or [()] * kind.num_fields
        return pa.StructArray.from_arrays([_column(list(c), f.type) for c, f in zip(parts, kind)], fields=list(kind), mask=given)
    if pa.types.is_list(kind) and pa.types.is_nested(kind.value_type):
        offsets = np.cumsum([0, *(len(v or ()) for v in values)]).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(offsets), _column([x for v in values for x in v or ()], kind.value_type), type=kind)
    if pa.types.is_map(kind):
        return pa.array([None if v is None else list(v.items()) for v in values], kind)
    return pa.array(values, kind)


def parse(files: DataFrame) -> DataFrame:
    """(doc_id, path, content) to one row a file with an array of rows for each fact table."""
    _ready(files.sparkSession)
    schema = _parsed_schema()
    arrow = to_arrow_schema(schema)

    def apply(batches):
        sys.setrecursionlimit(max(sys.getrecursionlimit(), 5000))
        from lectern.sources.pdf.reader import read_file

        held: list[tuple[int, dict]] = []

        def flush():
            columns = [pa.array([d for d, _ in held], pa.int64())]
            columns += [_column([[r[1:] for r in got.get(f.name, ())] for _, got in held], f.type) for f in list(arrow)[1:]]
            held.clear()
            return pa.RecordBatch.from_arrays(columns, schema=arrow)

        size = 0
        for batch in batches:
            for k in range(batch.num_rows):  # one file's bytes at a time
                doc_id, path, data = (c[k].as_py() for c in batch.columns)
                held.append((doc_id, read_file(doc_id, path, data)))
                size += len(data or b"")
                if size > FLUSH or len(held) >= 500:
                    yield flush()
                    size = 0
        if held:
            yield flush()

    return files.select("doc_id", "path", "content").mapInArrow(apply, schema)


def listed(paths: list[str]) -> list[str]:
    """Folders as their PDF files at any depth, in order; other paths stay, whether they exist or not."""

    def below(folder: str) -> list[str]:
        every = glob.glob(os.path.join(glob.escape(folder), "**", "*"), recursive=True)
        return sorted(x for x in every if x.lower().endswith(".pdf") and os.path.isfile(x))

    found = [x for p in paths for x in (below(p) if os.path.isdir(p) else [p])]
    return list(dict.fromkeys(found))


def _outermost(paths: list[str]) -> list[str]:
    """Without repeated paths and PDF files or folders inside a folder that is listed: no file is read twice."""
    real = {p: p.rstrip("/") if "://" in p else os.path.abspath(p) for p in paths}
    folders = {r for p, r in real.items() if "://" in p and not r.lower().endswith(".pdf") or os.path.isdir(p)}

    def inside(r: str) -> bool:
        listed = r in folders or r.lower().endswith(".pdf") and ("://" in r or os.path.isfile(r))
        return listed and any(r.startswith(f"{f.rstrip('/')}/") for f in folders)

    first = {r: p for p, r in reversed(real.items())}
    return [p for p, r in real.items() if first[r] == p and not inside(r)]


def binary_files(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(doc_id, path, content). Paths that lead nowhere are rows without content; the id is a hash of the path.

    Paths are made distinct before anything is read, so contents go from the scan to the parser without a shuffle.
    """
    here, gone = [], []
    for p in _outermost(paths):
        (here if "://" in p or os.path.exists(p) else gone).append(p)
    out = spark.createDataFrame([(p, None) for p in gone], "path string, content binary") if gone or not here else None
    read = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.[pP][dD][fF]")
    folders, single = [p for p in here if os.path.isdir(p) or "://" in p], [p for p in here if not (os.path.isdir(p) or "://" in p)]
    for df in ([read.load(folders)] if folders else []) + ([spark.read.format("binaryFile").load(single)] if single else []):
        df = df.select(F.regexp_replace("path", "^file:/*", "/").alias("path"), "content")
        out = df if out is None else out.unionByName(df)
    return out.select(F.xxhash64("path").alias("doc_id"), "path", "content")


def facts_of(spark: SparkSession, files: DataFrame, store: str | None = None, pairs: DataFrame | None = None) -> Facts:
    """Parse files once into a table bucketed by document, an array column a fact table; rules read the columns they need.

    With ``store`` the fact tables are written there as well.
    """
    shelf = Shelf(spark)
    parsed = shelf.put(parse(files), "parsed", spread=True)
    tables = {n: parsed.select("doc_id", F.explode(n).alias("r")).select("doc_id", "r.*") for n in READ}
    if pairs is not None:
        tables["pairs"] = pairs
    facts = Facts(spark, tables, shelf)
    if store:
        facts.save(store)
    return facts
