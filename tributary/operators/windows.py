"""Windowed metrics: tumbling and sliding windows, peaks, gaps, volatility."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tributary.session import BROADCAST_ROWS


def high_rated(stars: str = "stars", least: float = 4.0) -> Column:
    """The segment of highly rated reviews."""
    return F.col(stars) >= least


def tumbling_metrics(df: DataFrame, duration: str = "1 minute", time: str = "event_time", value: str = "stars", segment: Column | None = None, watermark: str | None = None) -> DataFrame:
    """(window_start, window_end, n_reviews, avg_stars) per tumbling window; rows without a time are in none.

    On a stream give a ``watermark``: a window comes out once it has passed, and later rows are dropped.
    """
    rows = df if segment is None else df.where(segment)
    if watermark:
        rows = rows.withWatermark(time, watermark)
    out = rows.groupBy(F.window(time, duration).alias("w")).agg(F.count(F.lit(1)).alias("n_reviews"), F.avg(value).alias("avg_stars"))
    return out.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "n_reviews", "avg_stars")


def kpi_summary(metrics: DataFrame) -> DataFrame:
    """One row over all windows."""
    rated = F.sum(F.col("n_reviews") * F.col("avg_stars")) / F.sum(F.when(F.col("avg_stars").isNotNull(), F.col("n_reviews")))
    return metrics.agg(F.count(F.lit(1)).alias("n_windows"), F.sum("n_reviews").alias("total_reviews"), F.avg("n_reviews").alias("avg_per_window"), F.max("n_reviews").alias("peak_reviews"), rated.alias("avg_stars"))


def peak_windows(metrics: DataFrame, top: int = 10) -> DataFrame:
    """The ``top`` busiest windows, ties by time."""
    return metrics.orderBy(F.desc("n_reviews"), "window_start").limit(top).select("window_start", "n_reviews")


def quiet_gaps(df: DataFrame, time: str = "event_time", least_minutes: int = 60) -> DataFrame:
    """(gap_start, gap_end, minutes): stretches without a row of at least ``least_minutes``.

    Gaps are found between neighbours within each day, and between each day's last row and the next day's first, so no
    task sorts more than a day.
    """
    minute = df.where(F.col(time).isNotNull()).select(F.date_trunc("minute", time).cast("timestamp_ntz").alias("m")).distinct().withColumn("d", F.to_date("m"))
    within = minute.withColumn("n", F.lead("m").over(Window.partitionBy("d").orderBy("m"))).where("n is not null").select("m", "n")
    days = minute.groupBy("d").agg(F.min("m").alias("first"), F.max("m").alias("last"))
    # one row a day: a single ordered window over them is small
    across = days.select(F.col("last").alias("m"), F.lead("first").over(Window.orderBy("d")).alias("n")).where("n is not null")
    length = F.expr("timestampdiff(minute, m, n) - 1")
    return within.union(across).select(F.expr("m + interval 1 minute").alias("gap_start"), F.col("n").alias("gap_end"), length.cast("long").alias("minutes")).where(F.col("minutes") >= least_minutes)


def rating_volatility(df: DataFrame, unit: str = "day", time: str = "event_time", value: str = "stars") -> DataFrame:
    """(period, n_reviews, avg_stars, stddev_stars) per hour or day."""
    period = F.date_trunc(unit, time).cast("timestamp_ntz").alias("period")
    return df.where(F.col(time).isNotNull()).groupBy(period).agg(F.count(F.lit(1)).alias("n_reviews"), F.avg(value).alias("avg_stars"), F.stddev_samp(value).alias("stddev_stars"))


def low_count_share(df: DataFrame, most: int = 1, time: str = "event_time") -> DataFrame:
    """One row: minutes from the first to the last row, the share without any row, and with at most ``most``.

    Empty minutes are counted by arithmetic, not by building them.
    """
    minute = df.where(F.col(time).isNotNull()).groupBy(F.date_trunc("minute", time).cast("timestamp_ntz").alias("m")).agg(F.count(F.lit(1)).alias("n"))
    all_of = F.expr("timestampdiff(minute, min(m), max(m)) + 1")
    row = minute.agg(all_of.cast("long").alias("minutes"), F.count(F.lit(1)).alias("filled"), F.count_if(F.col("n") <= most).alias("low"))
    empty = F.col("minutes") - F.col("filled")
    return row.select("minutes", (empty / F.col("minutes")).alias("empty_share"), ((empty + F.col("low")) / F.col("minutes")).alias("low_share"))


def sliding_ones(df: DataFrame, predicate: Column, minutes: int = 60, time: str = "event_time", key: str = "business_id") -> DataFrame:
    """(key, ts, ones): at each time of a row the rows of the key with ``predicate`` in the ``minutes`` up to it, both ends included.

    Rows are first counted per key and time. Each count is given to its own period of
    ``minutes`` and to the next as history, so a hot key is spread over its periods and
    every task holds two periods of one key.
    """
    t = F.unix_micros(F.col(time).cast("timestamp"))
    span = minutes * 60_000_000
    counted = df.where(F.col(time).isNotNull() & F.col(key).isNotNull()).groupBy(F.col(key).alias("key"), t.alias("t")).agg(F.count_if(predicate).alias("ones"))
    period = F.floor(F.col("t") / span)
    both = counted.withColumn("p", F.explode(F.array(period, period + 1)))
    window = Window.partitionBy("key", "p").orderBy("t").rangeBetween(-span, Window.currentRow)
    summed = both.withColumn("total", F.sum("ones").over(window)).where(F.col("p") == period)
    return summed.select(F.col("key").alias(key), F.timestamp_micros("t").cast("timestamp_ntz").alias("ts"), F.col("total").alias("ones"))


def enrich(df: DataFrame, dimension: DataFrame, key: str) -> DataFrame:
    """Left join of a stream or table with a dimension, which is broadcast if its counted rows are at most BROADCAST_ROWS."""
    small = dimension.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    return df.join(F.broadcast(dimension) if small else dimension, key, "left")
