"""Uniform samples by least random priority."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def window_samples(df: DataFrame, k: int = 100, unit: str = "minute", time: str = "event_time", id: str = "review_id", seed: int = 42) -> DataFrame:
    """Up to ``k`` rows of each window, all equally likely, with ``window_start``.

    Priorities are hashes of the id, so a sample doesn't depend on partitioning and
    samples merge. The rank limit is applied before the shuffle. Rows of a null id share a priority.
    """
    priority = F.md5(F.concat(F.coalesce(F.col(id), F.lit("")), F.lit(f":{seed}")))
    rows = df.where(F.col(time).isNotNull()).withColumn("window_start", F.date_trunc(unit, time).cast("timestamp_ntz"))
    others = [F.col(c) for c in df.columns if c != id]
    rank = F.row_number().over(Window.partitionBy("window_start").orderBy(priority, *others))
    return rows.withColumn("_rank", rank).where(F.col("_rank") <= k).drop("_rank")
