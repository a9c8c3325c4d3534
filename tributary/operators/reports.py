"""Reports: accuracy of sketches, throughput and latency, storage, dashboard tables."""

from __future__ import annotations

import time as clock
from collections import deque

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

TRIGGER_SECONDS = 5


def fm_accuracy(windows: DataFrame) -> DataFrame:
    """One row: estimates against exact counts, over the windows that have them."""
    e, r = F.col("distinct_users_exact"), F.col("raw_distinct_users_estimate")
    known = windows.where(e > 0).select(e.alias("e"), r.alias("r"), F.abs(r - e).alias("a"), (F.abs(r - e) / e).alias("x"))
    total = windows.agg(F.count(F.lit(1)).alias("total_windows"))
    part = lambda p: F.percentile("x", F.lit(p))
    row = known.agg(F.count(F.lit(1)).alias("windows_with_exact"), F.avg("r").alias("avg_estimate"), F.avg("e").alias("avg_exact"), F.avg("a").alias("avg_abs_error"), F.avg("x").alias("avg_rel_error"), part(0.5).alias("median_rel_error"), part(0.95).alias("p95_rel_error"), part(0.99).alias("p99_rel_error"), F.max("x").alias("max_rel_error"), F.min("x").alias("min_rel_error"))
    return total.crossJoin(row)  # two single rows


def flag_accuracy(truth: DataFrame, told: DataFrame, keys: list[str], window: str = "window_start") -> DataFrame:
    """Per window: rows flagged, true duplicates, TP, FP, FN, precision, recall, F1; both sides are distinct key lists."""
    both = truth.select(window, *keys).distinct().withColumn("t", F.lit(True)).join(told.select(window, *keys).distinct().withColumn("p", F.lit(True)), [window, *keys], "full")
    t, p = F.coalesce("t", F.lit(False)), F.coalesce("p", F.lit(False))
    out = both.groupBy(window).agg(F.count_if(p).alias("flagged"), F.count_if(t).alias("exact"), F.count_if(t & p).alias("tp"), F.count_if(p & ~t).alias("fp"), F.count_if(t & ~p).alias("fn"))
    precision, recall = F.coalesce(F.try_divide("tp", F.col("tp") + F.col("fp")), F.lit(0.0)), F.coalesce(F.try_divide("tp", F.col("tp") + F.col("fn")), F.lit(0.0))
    return out.withColumns({"precision": precision, "recall": recall, "f1": F.coalesce(F.try_divide(2 * precision * recall, precision + recall), F.lit(0.0))})


def bloom_accuracy(per_window: DataFrame) -> DataFrame:
    """One row over the windows of ``flag_accuracy`` that have a duplicate or a flag."""
    means = {"flagged": "avg_bloom_flagged", "exact": "avg_exact_duplicates", "tp": "avg_true_positives", "fp": "avg_false_positives", "fn": "avg_false_negatives", "precision": "avg_precision", "recall": "avg_recall", "f1": "avg_f1_score"}
    return per_window.agg(F.count(F.lit(1)).alias("windows_analyzed"), *[F.avg(c).alias(n) for c, n in means.items()], F.median("precision").alias("median_precision"), F.median("recall").alias("median_recall"))


def batch_performance(df: DataFrame, batch: Column, ended: Column, event: str = "event_time", arrival: str = "ingest_time") -> DataFrame:
    """One row per batch: events, processing time, throughput, latency and event delay in seconds.

    Latency is from arrival to the batch's end; delays below 0 are 0; a batch whose arrivals span no time counts as
    TRIGGER_SECONDS long.
    """
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    rows = df.select(batch.alias("batch"), micros(arrival).alias("i"), F.greatest(F.lit(0.0), (micros(arrival) - micros(event)) / 1e6).alias("delay"), F.unix_micros(ended.cast("timestamp")).alias("end"))
    latency = (F.col("end") - F.col("i")) / 1e6
    rows = rows.withColumn("latency", latency)
    part = lambda p: F.percentile("latency", F.lit(p))
    span = (F.max("i") - F.min("i")) / 1e6
    took = F.when(span > 0, span).otherwise(F.lit(float(TRIGGER_SECONDS)))
    return rows.groupBy("batch").agg(F.count(F.lit(1)).alias("events"), took.alias("processing_time"), (F.count(F.lit(1)) / took).alias("throughput"), F.avg("latency").alias("avg_latency"), part(0.5).alias("p50_latency"), part(0.95).alias("p95_latency"), part(0.99).alias("p99_latency"), F.max("latency").alias("max_latency"), F.avg("delay").alias("avg_delay"), F.max("delay").alias("max_delay"))


def performance_rollup(batches: DataFrame, minute: Column) -> DataFrame:
    """Batches per minute; throughput is events over sixty seconds, and percentiles are medians of the batches' own but p99, their p99."""
    return batches.groupBy(minute.alias("window_start")).agg(
        F.sum("events").alias("total_events"),
        F.sum("processing_time").alias("total_processing_time"),
        (F.sum("events") / 60).alias("avg_throughput"),
        F.max("throughput").alias("max_throughput"),
        F.avg("avg_latency").alias("avg_latency"),
        F.median("p50_latency").alias("p50_latency"),
        F.percentile("p95_latency", F.lit(0.95)).alias("p95_latency"),
        F.percentile("p99_latency", F.lit(0.99)).alias("p99_latency"),
        F.max("max_latency").alias("max_latency"),
        F.avg("avg_delay").alias("avg_event_delay"),
        F.max("max_delay").alias("max_event_delay"),
        F.count(F.lit(1)).alias("num_batches"),
    )


class ProgressLog(StreamingQueryListener):
    """What Spark reports of each batch of each query: rates, state size, late rows. The last ``most`` reports are held; ``drain`` takes them."""

    SCHEMA = "name string, batch long, input_rows long, input_rate double, process_rate double, state_bytes long, late_rows long"

    def __init__(self, most: int = 10_000):
        self.rows: deque[dict] = deque(maxlen=most)

    def drain(self) -> list[dict]:
        """The reports since the last call."""
        out = []
        while self.rows:
            out.append(self.rows.popleft())
        return out

    def onQueryStarted(self, event):  # noqa: N802
        pass

    def onQueryProgress(self, event):  # noqa: N802
        p = event.progress
        state = p.stateOperators
        self.rows.append({"name": p.name, "batch": p.batchId, "input_rows": p.numInputRows, "input_rate": p.inputRowsPerSecond, "process_rate": p.processedRowsPerSecond, "state_bytes": sum(s.memoryUsedBytes for s in state), "late_rows": sum(s.numRowsDroppedByWatermark for s in state)})

    def onQueryIdle(self, event):  # noqa: N802
        pass

    def onQueryTerminated(self, event):  # noqa: N802
        pass


def storage_report(spark: SparkSession, root: str) -> DataFrame:
    """(timestamp, checkpoint_name, checkpoint_path, size_bytes, size_mb): each folder under ``root``, as there are now."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    rows = []
    if fs.exists(path):
        for s in fs.listStatus(path):
            if s.isDirectory():
                n = fs.getContentSummary(s.getPath()).getLength()
                rows.append((s.getPath().getName().lstrip("_"), s.getPath().toString(), n, n / 1024 / 1024))
    df = spark.createDataFrame(rows, "checkpoint_name string, checkpoint_path string, size_bytes long, size_mb double")
    return df.select(F.timestamp_seconds(F.lit(clock.time())).alias("timestamp"), "*")


def latest(df: DataFrame, time: str, keys: list[str] = ()) -> DataFrame:
    """The last row of each group by time, or the last row of all; equal times by the other columns."""
    rest = [c for c in df.columns if c not in keys]
    last = F.max(F.struct(time, *[c for c in rest if c != time])).alias("_l")
    grouped = df.groupBy(*keys).agg(last) if keys else df.agg(last)
    return grouped.select(*[F.col(k) if k in keys else F.col(f"_l.{k}").alias(k) for k in df.columns])


def error_histogram(windows: DataFrame, bins: int = 30) -> DataFrame:
    """(bin, low, high, n): relative errors in percent, in bins of equal width between least and greatest; empty bins are left out."""
    x = windows.where("error_percent is not null").select((F.col("error_percent") * 100).alias("x"))
    ends = x.agg(F.min("x").alias("a"), F.max("x").alias("b"))
    placed = x.crossJoin(F.broadcast(ends))  # one row
    width = (F.col("b") - F.col("a")) / bins
    number = F.when(width == 0, 0).otherwise(F.least(F.floor((F.col("x") - F.col("a")) / F.when(width == 0, 1).otherwise(width)), F.lit(bins - 1))).cast("int").alias("bin")
    return placed.groupBy(number, "a", width.alias("w")).agg(F.count(F.lit(1)).alias("n")).select("bin", (F.col("a") + F.col("bin") * F.col("w")).alias("low"), (F.col("a") + (F.col("bin") + 1) * F.col("w")).alias("high"), "n")


def latency_deltas(rollup: DataFrame, columns: list[str]) -> DataFrame:
    """``columns`` less the least value of them all."""
    floor = rollup.agg(F.min(F.least(*columns)).alias("_floor"))
    both = rollup.crossJoin(F.broadcast(floor))  # one row
    return both.select(*[c for c in rollup.columns if c not in columns], *[(F.col(c) - F.col("_floor")).alias(c) for c in columns])


def auto_unit(seconds: Column) -> Column:
    """A duration with its unit: ms below a second, s below a minute, min below an hour, else h."""
    shown = lambda x, u: F.concat(F.format_number(x, 2), F.lit(u))
    return F.when(seconds < 1, shown(seconds * 1000, " ms")).when(seconds < 60, shown(seconds, " s")).when(seconds < 3600, shown(seconds / 60, " min")).otherwise(shown(seconds / 3600, " h"))


def ranked_by(df: DataFrame, key: str, top: int, name: str = "n") -> DataFrame:
    """The ``top`` values of a column by their rows, ties by value."""
    return top_rows(df.groupBy(key).agg(F.count(F.lit(1)).alias(name)), name, [key], top)


def top_rows(df: DataFrame, measure: str, ties: list[str], top: int) -> DataFrame:
    """The ``top`` rows by a measure, nulls last, equal ones by the columns ``ties``."""
    return df.orderBy(F.desc_nulls_last(measure), *ties).limit(top)


def last_windows(df: DataFrame, top: int = 50, window: str = "window_start") -> DataFrame:
    """The last ``top`` distinct windows."""
    return df.select(window).distinct().orderBy(F.desc(window)).limit(top)


def tail(df: DataFrame, order: list[str], rows: int) -> DataFrame:
    """The last rows in order."""
    return df.orderBy(*[F.desc(c) for c in order]).limit(rows).orderBy(*order)


def noise_compare(private: DataFrame, exact: DataFrame) -> DataFrame:
    """Noisy beside exact frequencies and their difference."""
    keys = ["similar_review_id", "similar_business_id"]
    return private.select(*keys, "noisy_frequency").distinct().join(exact, keys, "left").withColumn("noise", F.col("noisy_frequency") - F.col("exact_frequency"))


def repeats_within(df: DataFrame, window: str = "window_start", id: str = "review_id") -> DataFrame:
    """(id, window, n_repeats): by how many rows an id repeats within a window: a count less one, combined before the shuffle."""
    n = F.count(F.lit(1))
    return df.where(F.col(id).isNotNull()).groupBy(id, window).agg((n - 1).alias("n_repeats")).where("n_repeats > 0")


def iso_time(time: Column) -> Column:
    """A UTC time as ISO 8601 to the second."""
    return F.date_format(time, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def snippet(text: Column, length: int = 160) -> Column:
    """The first characters of a text without white space around it; null for null."""
    return F.substring(F.trim(text), 1, length)
