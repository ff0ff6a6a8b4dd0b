"""A folder watched by Structured Streaming: files that arrive are audited by the same plans, batch by batch."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..api import check
from ..sources.files import facts_of


def watch(spark: SparkSession, folder: str, out: str, checkpoint: str, only=None, skip=None, layers=None, once: bool = False) -> StreamingQuery:
    """Append findings and results of new files below ``out``.

    Files carry no order and a verdict needs its own file alone, so there is no state and no watermark; a batch that is
    run again writes its own folder again, so results stay exactly once.
    """
    files = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.[pP][dD][fF]").load(folder)

    def audit(batch, number):
        named = batch.select(F.regexp_replace("path", "^file:/*", "/").alias("path"), "content").select(F.xxhash64("path").alias("doc_id"), "path", "content")
        r = check(spark, only=only, skip=skip, layers=layers, facts=facts_of(spark, named))
        r.findings.write.mode("overwrite").parquet(f"{out}/findings/batch={number}")
        r.results.write.mode("overwrite").parquet(f"{out}/results/batch={number}")

    w = files.writeStream.foreachBatch(audit).option("checkpointLocation", checkpoint)
    return (w.trigger(availableNow=True) if once else w).start()
