"""Streaming queries over the review tables, run until what is there is taken, with their SQL.

What an append query hasn't given out yet stays in its state: windows that the watermark, the greatest time less
two minutes, hasn't passed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tributary.config import BloomConfig
from tributary.operators.distinct import fm_windows
from tributary.operators.duplicates import bloom_size, key_digest
from tributary.operators.windows import tumbling_metrics
from tributary.plans import catalogue
from tributary.session import file_system, new_path, ship, table
from tributary.sources.reviews import parse_messages
from tributary.sources.sinks import append_batch, batch_stream, parquet_stream
from tributary.streaming.processors import bloom_seen_flags, dup_rates, minute_samples, sliding_estimates

LATE = "2 minutes"
PASSED = "<= (select max({}) from bronze_reviews) - interval 2 minutes"


def _stream(spark: SparkSession, folder: str, name: str = "bronze_reviews") -> DataFrame:
    """A stored table as a stream, with times that a watermark can follow."""
    ship(spark)
    kept = table(spark, folder, name)
    path = f"{folder}/{name}.parquet"
    fs, target = file_system(spark, path)
    reader = spark.readStream.schema(kept.schema)
    # a stream reads folders only: of a table that is one file, the folder it is in
    rows = reader.parquet(path) if fs.getFileStatus(target).isDirectory() else reader.option("pathGlobFilter", f"{name}.parquet").parquet(folder)
    return rows.select(*[F.col(c).cast("timestamp").alias(c) if t == "timestamp_ntz" else F.col(c) for c, t in kept.dtypes])


def _run(df: DataFrame, mode: str = "append") -> DataFrame:
    """All that the stream gives for what is there."""
    spark, path = df.sparkSession, new_path(df.sparkSession, "stream")
    writer = parquet_stream(df, f"{path}/table", f"{path}/check", None) if mode == "append" else batch_stream(df, append_batch(f"{path}/table"), f"{path}/check", None).outputMode(mode)
    writer.start().awaitTermination()
    return spark.read.schema(df.schema).option("recursiveFileLookup", "true").parquet(f"{path}/table")


def _plain(df: DataFrame) -> DataFrame:
    return df.select(*[F.col(c).cast("timestamp_ntz").alias(c) if t == "timestamp" else F.col(c) for c, t in df.dtypes])


def stream_metrics_1m(spark: SparkSession, folder: str) -> DataFrame:
    """Tumbling minutes that the watermark has passed."""
    return _plain(catalogue.rounded(_run(tumbling_metrics(_stream(spark, folder), watermark=LATE)), "avg_stars"))


def stream_parse_payloads(spark: SparkSession, folder: str) -> DataFrame:
    """Messages decoded on the way."""
    return _plain(_run(parse_messages(_stream(spark, folder, "review_messages"), "payload", "arrived_at")))


def stream_fm_distinct_users(spark: SparkSession, folder: str) -> DataFrame:
    """Distinct users per ten seconds of arrival."""
    return _plain(catalogue.rounded(_run(fm_windows(_stream(spark, folder), watermark=LATE)), "raw_distinct_users_estimate", "error_percent"))


def stream_dup_bloom(spark: SparkSession, folder: str) -> DataFrame:
    """Rows that the Bloom filter flags, per id and key."""
    flagged = _run(bloom_seen_flags(_stream(spark, folder)).where("is_dup").drop("is_dup"))
    return flagged.groupBy("review_id", F.lower(F.hex(key_digest(F.col("dup_key")))).alias("key_md5")).agg(F.count(F.lit(1)).alias("dups"))


def stream_dup_rate_1m(spark: SparkSession, folder: str) -> DataFrame:
    """The rate of flagged rows per minute, from the same filter chained to a window."""
    return _plain(catalogue.rounded(_run(dup_rates(_stream(spark, folder))), "dup_rate"))


def stream_reservoir(spark: SparkSession, folder: str) -> DataFrame:
    """The sampled ids of each minute."""
    return _plain(_run(minute_samples(_stream(spark, folder))).select("window_start", "review_id"))


def stream_dgim(spark: SparkSession, folder: str) -> DataFrame:
    """Per business the exact count of the hour up to its last row, and whether the estimate is within half of it."""
    told = _run(sliding_estimates(_stream(spark, folder)), "update")
    return _plain(told.select(F.col("key").alias("business_id"), "ts", "exact", (F.abs(F.col("estimate") - F.col("exact")) * 2 <= F.col("exact")).alias("within_half")))


QUERIES = {f.__name__: f for f in (stream_metrics_1m, stream_parse_payloads, stream_fm_distinct_users, stream_dup_bloom, stream_dup_rate_1m, stream_reservoir, stream_dgim)}

_BLOOM = BloomConfig()
_BITS, _HASHES = bloom_size(-(-_BLOOM.capacity // _BLOOM.buckets), _BLOOM.error_rate)
# one batch, so no filter is reset; buckets are independent of each other
_FLAGS = f"""with k as (select *, {catalogue._KEY} as dup_key, md5({catalogue._KEY}) as m from bronze_reviews where event_time is not null),
h as (select *, ('0x' || substr(m, 1, 8))::bigint as a, ('0x' || substr(m, 9, 8))::bigint as b, ('0x' || substr(m, 17, 8))::bigint % {_BLOOM.buckets} as bucket from k),
r as (select *, row_number() over (partition by bucket order by coalesce(epoch_us(ingest_time), 0), review_id nulls first, a, b, event_time) as o from h),
first as (select bucket, a, b, min(o) as o from r group by 1, 2, 3),
bits as (select distinct bucket, a, b, o, (a + i * b) % {_BITS} as bit from first, range({_HASHES}) t(i)),
born as (select bucket, bit, min(o) as born from bits group by 1, 2),
fp as (select bucket, a, b, max(born) < min(o) as fp, min(o) as first_o from bits join born using (bucket, bit) group by 1, 2, 3),
f as (select r.*, r.o <> first_o or fp as dup from r join fp using (bucket, a, b))
"""

ORACLE = {
    "stream_metrics_1m": f"select * from ({catalogue.ORACLE['metrics_1m']}) where window_end {PASSED.format('event_time')}",
    "stream_parse_payloads": catalogue.ORACLE["parse_payloads"],
    "stream_fm_distinct_users": f"select * from ({catalogue.ORACLE['fm_distinct_users']}) where window_start + interval 10 seconds {PASSED.format('ingest_time')}",
    "stream_dup_bloom": _FLAGS + "select review_id, m as key_md5, count(*) as dups from f where dup group by 1, 2",
    "stream_dup_rate_1m": _FLAGS + f"select date_trunc('minute', event_time)::timestamp as window_start, count(*) as total, count(*) filter (dup) as dup_count, round(count(*) filter (dup) / count(*), 6) as dup_rate from f where date_trunc('minute', event_time) + interval 1 minute {PASSED.format('event_time')} group by 1",
    "stream_reservoir": f"select w as window_start, review_id from (select w, review_id, row_number() over (partition by w order by md5(review_id || ':42')) as r from (select distinct date_trunc('minute', event_time)::timestamp as w, review_id from bronze_reviews where review_id is not null and event_time is not null)) where r <= 100 and w + interval 1 minute {PASSED.format('event_time')}",
    "stream_dgim": "with l as (select business_id, max(event_time) as ts from bronze_reviews where event_time is not null group by 1) select business_id, ts, count(*) filter (stars >= 4 and event_time >= ts - interval 60 minutes) as exact, true as within_half from bronze_reviews join l using (business_id) where event_time is not null group by 1, 2",
}
