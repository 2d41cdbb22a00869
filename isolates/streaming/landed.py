"""Isolates that arrive over time: every micro-batch of landed samples goes through the per-sample operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery


def run_landed(
    spark: SparkSession, source: str, schema: str, steps: dict[str, Callable[[DataFrame], DataFrame]], out: str, checkpoint: str, files_per_batch: int = 100
) -> StreamingQuery:
    """Start a query that reads Parquet tables as they land and appends each step's rows under ``out``/name.

    All steps are keyed by sample and a sample lands in one file, so a batch's rows are final. A batch writes to
    batch=N of its own, in overwrite mode, so one that is run again after a failure replaces what it had written.
    """

    def each(batch: DataFrame, number: int) -> None:
        batch.persist()
        for name, step in steps.items():
            step(batch).write.mode("overwrite").parquet(f"{out}/{name}/batch={number}")
        batch.unpersist()

    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(source)
    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
