"""Outlier summaries of a stream of points: each micro-batch is summarised as a site of its own and appended.

A summary of a union is the union of summaries, so the appended table can be clustered at any time.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from robustclust.operators.coresets import summarize_sites


def summarizing(stream: DataFrame, path: str, k: int, z: int, sites: int = 8, **options) -> DataStreamWriter:
    """A writer that appends (batch, machine_id, id, features, weight, round) to Parquet under ``path``."""

    def batch(points: DataFrame, number: int) -> None:
        dealt = points.withColumn("machine_id", F.pmod("id", F.lit(sites)).cast("int"))
        summary = summarize_sites(dealt, k, z, sites, **options)
        summary.write.mode("overwrite").parquet(f"{path}/batch={number}")  # a repeated batch replaces itself

    return stream.writeStream.foreachBatch(batch)
