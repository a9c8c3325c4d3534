"""All streaming queries of a segment of reviews, the jobs beside them, and running them together."""

from __future__ import annotations

import posixpath
import threading
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tributary.config import BloomConfig, DGIMConfig, FMConfig, MetricsConfig, ReservoirConfig
from tributary.operators import duplicates, reports
from tributary.operators.distinct import fm_windows
from tributary.operators.windows import enrich, high_rated, tumbling_metrics
from tributary.schemas import REVIEW, TABLES
from tributary.session import ship
from tributary.sources.reviews import read_or_empty
from tributary.sources.sinks import Tolerant, append_batch, append_counted, batch_stream, parquet_stream
from tributary.streaming.processors import bloom_seen_flags, dup_rates, minute_samples, sliding_estimates


@dataclass
class Segment:
    """A part of the stream with queries of its own."""

    name: str
    predicate: Column | None = None

    def table(self, base: str) -> str:
        return base if self.name == "all" else f"{base}_{self.name}"

    def rows(self, df: DataFrame) -> DataFrame:
        return df if self.predicate is None else df.where(self.predicate)


def default_segments() -> list[Segment]:
    return [Segment("all"), Segment("high_rated", high_rated())]


@dataclass
class Places:
    """Where tables go: to the configured sinks, or all of them under ``root``."""

    root: str | None = None

    def __call__(self, configured: str, segment: Segment | None = None) -> str:
        path = configured if self.root is None else f"{self.root}/{posixpath.basename(configured)}"
        return path if segment is None else segment.table(path)

    def checkpoint(self, path: str) -> str:
        return f"{self.checkpoints()}/{posixpath.basename(path)}"

    def checkpoints(self) -> str:
        return f"{self.root or 'delta'}/_checkpoints"


def performance_batches(spark: SparkSession, table: str) -> Callable[[DataFrame, int], None]:
    """For ``batch_stream``: each batch's performance, and anew the figures of the minute it ended in.

    A batch is a row in a folder of its number and a minute a row in a folder of its time, so what is repeated replaces itself.
    """

    def handle(batch: DataFrame, number: int) -> None:
        rows = reports.batch_performance(batch, F.lit(number), F.current_timestamp()).withColumn("minute", F.date_trunc("minute", F.current_timestamp()))
        rows.write.mode("overwrite").parquet(f"{table}_batches/number={number}")
        done = spark.read.parquet(f"{table}_batches/number={number}").select("minute").first()
        if done is not None:
            same = spark.read.parquet(f"{table}_batches").where(F.col("minute") == F.lit(done.minute))
            reports.performance_rollup(same, F.col("minute")).coalesce(1).write.mode("overwrite").parquet(f"{table}/minute={int(done.minute.timestamp())}")

    return handle


def start_all(reviews: DataFrame, root: str | None = None, segments: list[Segment] | None = None, trigger: str | None = "5 seconds", dimension: DataFrame | None = None) -> list[StreamingQuery]:
    """Start every query of every segment; tables go to the configured sinks, or under ``root``, each with a checkpoint of its own.

    State and offsets are Spark's, so a restarted query goes on where it stopped. ``dimension``
    (business_id and further columns) is joined to the reviews, so segments may be made of its columns.
    """
    fm, sample, dgim, bloom, metrics = FMConfig.from_env(), ReservoirConfig.from_env(), DGIMConfig.from_env(), BloomConfig.from_env(), MetricsConfig.from_env()
    spark, place, late = reviews.sparkSession, Places(root), f"{bloom.watermark_minutes} minutes"
    ship(spark)
    started = []

    def start(df: DataFrame, path: str, partition_by: list[str] = ()) -> None:
        started.append(parquet_stream(df, path, place.checkpoint(path), trigger, partition_by).queryName(posixpath.basename(path)).start())

    def start_batches(df: DataFrame, handle: Callable[[DataFrame, int], None], path: str, mode: str = "append") -> None:
        started.append(batch_stream(df, handle, place.checkpoint(path), trigger).outputMode(mode).queryName(posixpath.basename(path)).start())

    if dimension is not None:
        reviews = enrich(reviews, dimension, "business_id")
    start(reviews.withColumn("ingest_date", F.to_date("ingest_time")), place("delta/bronze_reviews"), ["ingest_date"])
    for s in segments or default_segments():
        rows = s.rows(reviews)
        start(tumbling_metrics(rows, watermark=late), place("delta/metrics_1m", s))
        start(fm_windows(rows, fm.num_hash_functions, fm.window_size, fm.window_column, exact_below=fm.compute_exact_for_windows_under, watermark=f"{fm.watermark_minutes} minutes"), place(fm.sink, s))
        start(bloom_seen_flags(rows, bloom).where("is_dup").drop("is_dup"), place(bloom.dup_sink, s))
        start(dup_rates(rows, bloom), place(bloom.metrics_sink, s))
        timed = place(metrics.performance_sink, s)
        start_batches(rows.select("event_time", "ingest_time"), Tolerant(performance_batches(spark, timed), timed), timed)
        if s.name == "all":
            start(minute_samples(rows, sample.sample_size, f"{sample.watermark_minutes} minutes"), place(sample.sink))
            estimates = place(dgim.sink)
            start_batches(sliding_estimates(rows, dgim.window_minutes, exact=dgim.compute_exact), append_batch(estimates), estimates, "update")
    return started


def _stamped(df: DataFrame, source: str) -> DataFrame:
    return df.select(F.current_timestamp().alias("report_timestamp"), F.lit(source).alias("data_source"), "*")


def report_accuracy(spark: SparkSession, root: str | None = None, segments: list[Segment] | None = None, windows: int = 50) -> None:
    """Append the accuracy of the distinct counts and of the Bloom flags of each segment to their summaries.

    Flags of the last ``windows`` minutes that have a rate are set against exact duplicates of the same segment, within the same
    stretches between resets.
    """
    place, fm, bloom = Places(root), FMConfig.from_env(), BloomConfig.from_env()
    stored = read_or_empty(spark, place("delta/bronze_reviews"), REVIEW)
    minute = F.date_trunc("minute", "event_time").cast("timestamp_ntz").alias("window_start")
    for s in segments or default_segments():
        counted = read_or_empty(spark, place(fm.sink, s), TABLES["fm_distinct_users"])
        append_counted(_stamped(reports.fm_accuracy(counted).where("total_windows > 0"), s.name), place("delta/accuracy_fm_summary", s))
        rated = read_or_empty(spark, place(bloom.metrics_sink, s), TABLES["gold_dup_rate_1m"]).select(F.col("window_start").cast("timestamp_ntz"))
        last = F.broadcast(reports.last_windows(rated, windows))  # as many rows as asked for
        rows = duplicates.with_epochs(duplicates.keyed_rows(s.rows(stored)), bloom.capacity, bloom.reset_interval_minutes)
        truth = duplicates.exact_flags(rows).where("dups > 0 and review_id is not null").join(last, "window_start", "left_semi")
        flagged = read_or_empty(spark, place(bloom.dup_sink, s), TABLES["dup_bloom"]).where("review_id is not null")
        told = flagged.select(minute, "review_id", duplicates.key_digest(F.col("dup_key")).alias("dup_key")).join(last, "window_start", "left_semi")
        found = reports.bloom_accuracy(reports.flag_accuracy(truth, told, ["review_id", "dup_key"]))
        append_counted(_stamped(found.where("windows_analyzed > 0"), s.name), place("delta/accuracy_bloom_summary", s))


class Repeating(threading.Thread):
    """Runs a job again and again until it is stopped; errors are counted in ``job.errors``."""

    def __init__(self, name: str, job: Callable[[], None], first: float, seconds: float):
        super().__init__(name=name, daemon=True)
        self.job, self.first, self.seconds, self.runs, self._ended = Tolerant(job, name), first, seconds, 0, threading.Event()

    def run(self) -> None:
        pause = self.first
        while not self._ended.wait(pause):
            self.job()
            self.runs += 1
            pause = self.seconds

    def stop(self) -> None:
        self._ended.set()


@dataclass
class Pipeline:
    """Running queries, and the jobs beside them."""

    spark: SparkSession
    queries: list[StreamingQuery]
    jobs: list[Repeating] = field(default_factory=list)
    progress: reports.ProgressLog | None = None

    def wait(self) -> None:
        """Until any query ends or fails; the rest is stopped then."""
        try:
            self.spark.streams.awaitAnyTermination()
        finally:
            self.stop()

    def stop(self) -> None:
        for j in self.jobs:
            j.stop()
        for q in self.queries:
            q.stop()
        if self.progress is not None:
            self.spark.streams.removeListener(self.progress)
            self.progress = None


def start_pipeline(reviews: DataFrame, root: str | None = None, segments: list[Segment] | None = None, trigger: str | None = "5 seconds", dimension: DataFrame | None = None, metrics: MetricsConfig | None = None) -> Pipeline:
    """``start_all``, with what Spark reports of each batch, the sizes of the checkpoints and the accuracy reports stored at intervals."""
    spark, place, metrics = reviews.sparkSession, Places(root), metrics or MetricsConfig.from_env()
    progress = reports.ProgressLog()
    spark.streams.addListener(progress)

    def storage() -> None:
        append_counted(reports.storage_report(spark, place.checkpoints()), place(metrics.storage_sink))
        rows = [tuple(r.values()) for r in progress.drain()]
        append_counted(spark.createDataFrame(rows, reports.ProgressLog.SCHEMA), place("delta/progress_metrics"))

    def accuracy() -> None:
        report_accuracy(spark, root, segments, metrics.accuracy_windows)

    queries = start_all(reviews, root, segments, trigger, dimension)
    jobs = [Repeating("storage", storage, 0, metrics.storage_seconds), Repeating("accuracy", accuracy, metrics.accuracy_first_seconds, metrics.accuracy_seconds)]
    for j in jobs:
        j.start()
    return Pipeline(spark, queries, jobs, progress)
