"""Resumable runs: new page files become checkpoints once, whatever stops the run in between."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def run_available(spark: SparkSession, source: str, schema: str, transform: Callable[[DataFrame], DataFrame], target: str, checkpoint: str, files_per_batch: int = 1000) -> int:
    """Takes every file of source that no run before took, and appends transform's rows to target; returns the batches run.

    source holds Parquet files. Spark's checkpoint remembers the files, so a second run
    without new ones does nothing; a new checkpoint folder forces all again. A batch's
    rows are written under its id, and a repeated batch replaces them.
    """
    done: list[int] = []

    def write(batch: DataFrame, batch_id: int) -> None:
        transform(batch).write.mode("overwrite").parquet(f"{target}/batch={batch_id}")
        done.append(batch_id)

    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(source)
    stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return len(done)


def stale(indexed: DataFrame, texts: DataFrame, key: str = "path") -> DataFrame:
    """Index rows whose cached text is gone."""
    return indexed.join(texts.select(key), key, "left_anti")
