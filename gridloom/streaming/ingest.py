"""Incremental ingestion: new files of a folder through the batch operators, each micro-batch appended once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery


def ingest_files(spark: SparkSession, source: str, sink: str, checkpoint: str, plan: Callable[[DataFrame], DataFrame], glob: str = "*") -> StreamingQuery:
    """Run ``plan`` over the new files of ``source`` and append its rows to ``sink`` as Parquet; ends when what is there has been read."""
    schema = "path string, modificationTime timestamp, length bigint, content binary"
    files = spark.readStream.schema(schema).format("binaryFile").option("pathGlobFilter", glob).load(source)

    def write(batch: DataFrame, batch_id: int) -> None:
        plan(batch).write.mode("overwrite").parquet(f"{sink}/batch={batch_id}")

    return files.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
