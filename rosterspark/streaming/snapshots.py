"""Keeping the newest row of each key while snapshots arrive as a stream."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession

from rosterspark.operators.timeline import keep_latest


def upsert_batches(path: str, keys: list[str], order: list[Column]) -> Callable[[DataFrame, int], None]:
    """For ``foreachBatch``: each micro-batch's newest rows go to a folder of its own, which a repeated batch replaces,
    so a batch that runs twice changes nothing."""

    def write(batch: DataFrame, number: int) -> None:
        keep_latest(batch, keys, order).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return write


def current(spark: SparkSession, path: str, keys: list[str], order: list[Column]) -> DataFrame:
    """The newest row of each key over all batches."""
    return keep_latest(spark.read.parquet(path).drop("batch"), keys, order)
