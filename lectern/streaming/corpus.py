"""Incremental reading of a growing collection."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F


def read_growing(spark: SparkSession, path: str, schema: str, files_a_batch: int = 200) -> DataFrame:
    """New Parquet files of a folder, some at a time; where it stands is the checkpoint's business."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_a_batch).parquet(path)


def run_available(stream: DataFrame, out: str, checkpoint: str, work: Callable[[DataFrame], DataFrame] = lambda x: x) -> None:
    """Process what is there and stop.  A batch that was interrupted is written again in the same place, so nothing doubles."""

    def each(batch: DataFrame, number: int) -> None:
        work(batch).write.mode("overwrite").parquet(f"{out}/batch={number}")

    stream.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(each).start().awaitTermination()


def run_updates(counts: DataFrame, out: str, checkpoint: str) -> None:
    """Process what is there and stop; each batch writes the rows of an aggregation that it changed."""

    def each(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")

    counts.writeStream.outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(each).start().awaitTermination()


def latest(spark: SparkSession, out: str, keys: list[str]) -> DataFrame:
    """The rows of ``run_updates`` as they stand: of each key that of its last batch."""
    rows = spark.read.parquet(out)
    rest = [c for c in rows.columns if c not in {*keys, "batch"}]
    last = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("x"))
    return last.select(*keys, *[f"x.{c}" for c in rest])
