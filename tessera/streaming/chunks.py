"""Chunks as they arrive: every new chunk directory is answered by the same request.

Relations never cross a block and pages compose, so the stream is stateless:
each micro-batch names chunk directories, and their answers are appended.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from tessera.catalog import Catalog
from tessera.engine import execute
from tessera.sources.chunks import ParquetSource


def answer_chunks(spark: SparkSession, inbox: str, request: dict, catalog: Catalog, out: str, checkpoint: str) -> StreamingQuery:
    """Start a query over text files in ``inbox`` whose lines name chunk directories; answers go to ``out`` as text.

    A batch overwrites its own folder, so a batch that runs again after a
    failure leaves one copy.
    """

    def batch(names: DataFrame, number: int) -> None:
        directories = [r["value"] for r in names.distinct().collect()]
        if directories:
            lines = execute(spark, request, catalog, ParquetSource(spark, sorted(directories)), budget=None).lines()
            lines.orderBy("block").select("line").write.mode("overwrite").text(f"{out}/batch={number}")

    stream = spark.readStream.text(inbox)
    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
