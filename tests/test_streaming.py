import random
import time
from datetime import datetime, timedelta

from conftest import REVIEW
from pyspark.sql import functions as F

from tributary.config import BloomConfig, MetricsConfig
from tributary.operators.windows import tumbling_metrics
from tributary.sources.reviews import file_stream
from tributary.sources.sinks import append_batch, batch_stream
from tributary.streaming.pipelines import Repeating, Segment, report_accuracy, start_all, start_pipeline
from tributary.streaming.processors import bloom_seen_flags, seen_flags

T = datetime(2020, 1, 1, 10)


def test_streams_equal_batches(spark, make_reviews, tmp_path):
    rng = random.Random(5)
    for part in range(2):
        rows = [{"review_id": f"r{part}-{i}", "user_id": f"u{rng.randrange(9)}", "stars": float(rng.randrange(1, 6)), "text": f"t{i % 5}", "event_time": T + timedelta(minutes=part * 5, seconds=rng.randrange(280)), "ingest_time": T + timedelta(minutes=part * 5 + 5)} for i in range(40)]
        if part == 1:
            rows.append({"review_id": "end", "stars": 5.0, "event_time": T + timedelta(hours=5), "ingest_time": T + timedelta(hours=5)})
        make_reviews(rows).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = file_stream(spark, str(tmp_path / "in"), REVIEW, files_per_trigger=1)
    root, segments = f"file://{tmp_path}/out", [Segment("all"), Segment("high_rated", F.col("stars") >= 4)]
    for q in start_all(stream, root, segments, trigger=None):
        assert q.awaitTermination(180), q.name
        assert q.exception() is None
    read = lambda name: spark.read.parquet(f"{tmp_path}/out/{name}")
    batch = spark.read.parquet(str(tmp_path / "in"))
    assert read("bronze_reviews").count() == 81
    closed = tumbling_metrics(batch.where("review_id <> 'end'"))
    assert sorted(map(tuple, read("metrics_1m").collect())) == sorted(map(tuple, closed.collect()))
    assert read("metrics_1m_high_rated").agg(F.sum("n_reviews")).first()[0] == batch.where("stars >= 4 and review_id <> 'end'").count()
    sampled = read("reservoir_samples").where("window_start < '2020-01-01 14:00'")
    assert sorted(map(tuple, sampled.select("review_id", "event_time", "text", "stars").collect())) == sorted(map(tuple, batch.where("review_id <> 'end'").select("review_id", "event_time", "text", "stars").collect()))
    keys = batch.where("review_id <> 'end'").select("user_id", "text").distinct().count()
    assert read("dup_bloom").count() == 80 - keys
    assert read("gold_dup_rate_1m").agg(F.sum("total"), F.sum("dup_count")).first() == (80, 80 - keys)
    assert read("gold_dgim_highstar").where("estimate > 0 and exact > 0 and abs(estimate - exact) * 2 <= exact").count() >= 1
    assert read("performance_metrics").agg(F.sum("total_events")).first()[0] == 81
    assert read("fm_distinct_users").count() == 2  # 10:05 and 10:10
    report_accuracy(spark, root, segments)
    report = read("accuracy_bloom_summary").first()
    assert (report.data_source, report.avg_recall, report.avg_precision) == ("all", 1.0, 1.0)
    assert read("accuracy_fm_summary_high_rated").count() == 1


def test_flags_follow_arrival(spark, make_reviews, tmp_path):
    """Keys come again in the same batch, in the next one, and after more than the reset."""
    for part, minute in enumerate((0, 1, 200)):
        make_reviews([{"review_id": f"{part}{i}", "text": f"t{i % 2}", "ingest_time": T + timedelta(minutes=minute, seconds=i)} for i in range(4)]).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        time.sleep(0.05)
    want = {f"{p}{i}": i > 1 if p != 1 else True for p in range(3) for i in range(4)}
    for name, flags in (("exact", seen_flags), ("bloom", lambda df: bloom_seen_flags(df, BloomConfig(buckets=2)))):
        df = flags(file_stream(spark, str(tmp_path / "in"), REVIEW, files_per_trigger=1))
        q = batch_stream(df, append_batch(f"file://{tmp_path}/{name}"), f"file://{tmp_path}/check-{name}", None).start()
        assert q.awaitTermination(90) and q.exception() is None
        assert {r.review_id: r.is_dup for r in spark.read.parquet(f"{tmp_path}/{name}").collect()} == want, name


def test_full_filter_is_emptied(spark, make_reviews, tmp_path):
    for part in range(2):
        make_reviews([{"review_id": f"{part}{i}", "text": f"t{i}"} for i in range(10)]).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    flags = bloom_seen_flags(file_stream(spark, str(tmp_path / "in"), REVIEW, files_per_trigger=1), BloomConfig(capacity=10, buckets=1))
    q = batch_stream(flags, append_batch(f"file://{tmp_path}/out"), f"file://{tmp_path}/check", None).start()
    assert q.awaitTermination(90) and q.exception() is None
    assert spark.read.parquet(f"{tmp_path}/out").where("is_dup").count() <= 3


def test_pipeline_stores_what_it_costs(spark, make_reviews, tmp_path):
    make_reviews([{"review_id": str(i)} for i in range(5)]).write.parquet(str(tmp_path / "in"))
    metrics = MetricsConfig(storage_seconds=1, accuracy_first_seconds=3600)
    pipeline = start_pipeline(file_stream(spark, str(tmp_path / "in"), REVIEW), f"file://{tmp_path}/out", [], None, metrics=metrics)
    assert all(q.awaitTermination(90) for q in pipeline.queries)
    seen = pipeline.jobs[0].runs
    until = time.time() + 60
    while pipeline.jobs[0].runs < seen + 2 and time.time() < until:
        time.sleep(0.2)
    pipeline.stop()
    assert pipeline.jobs[0].job.errors == 0
    assert spark.read.parquet(f"{tmp_path}/out/storage_metrics").where("checkpoint_name = 'bronze_reviews' and size_bytes > 0").count() >= 1
    assert spark.read.parquet(f"{tmp_path}/out/progress_metrics").where("name = 'bronze_reviews' and input_rows = 5").count() == 1


def test_repeating_jobs_outlive_errors():
    job = Repeating("fails", lambda: 1 / 0, 0, 0.01)
    job.start()
    until = time.time() + 10
    while job.runs < 2 and time.time() < until:
        time.sleep(0.01)
    job.stop()
    assert job.job.errors >= 2
