"""Queries of the general problems: repeated deliveries (4) and late events (6)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tributary.operators.idindex import deliveries, keep_one
from tributary.operators.replay import EventTimeReplay, replayed_in_batches
from tributary.session import table


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    """Identifiers that were delivered more than once."""
    told = deliveries(table(spark, folder, "bronze_reviews"))
    return told.where("copies > 1 or known").select(F.col("id").alias("review_id")).distinct()


def p4_kept(spark: SparkSession, folder: str) -> DataFrame:
    """One row of each message."""
    return keep_one(table(spark, folder, "bronze_reviews"))


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    """Reviews that came after the cut-off of their hour."""
    return EventTimeReplay(table(spark, folder, "bronze_reviews")).rejected().where("id is not null").select(F.col("id").alias("review_id"))


def p6_hourly(spark: SparkSession, folder: str) -> DataFrame:
    """Corrected counts and averages per hour."""
    now = EventTimeReplay(table(spark, folder, "bronze_reviews")).current()
    return now.select(F.col("hour").cast("timestamp_ntz").alias("hour"), "n_reviews", F.round("avg_stars", 6).alias("avg_stars"), "day_reviews", F.round("day_avg_stars", 6).alias("day_avg_stars"))


def p6_stored_hourly(spark: SparkSession, folder: str) -> DataFrame:
    """The same as p6_hourly, from stored state to which the arrivals were applied in four batches."""
    now = replayed_in_batches(table(spark, folder, "bronze_reviews")).current()
    return now.select(F.col("hour").cast("timestamp_ntz").alias("hour"), "n_reviews", F.round("avg_stars", 6).alias("avg_stars"), "day_reviews", F.round("day_avg_stars", 6).alias("day_avg_stars"))


def p6_business_hourly(spark: SparkSession, folder: str) -> DataFrame:
    """The same per business."""
    now = EventTimeReplay(table(spark, folder, "bronze_reviews"), key="business_id").current()
    return now.select(F.col("key").alias("business_id"), F.col("hour").cast("timestamp_ntz").alias("hour"), "n_reviews", F.round("avg_stars", 6).alias("avg_stars"))


def p6_revisions(spark: SparkSession, folder: str) -> DataFrame:
    """How often the hours' outputs were replaced, per day."""
    now = EventTimeReplay(table(spark, folder, "bronze_reviews")).current()
    return now.groupBy(F.to_date("hour").alias("day")).agg(F.sum("n_reviews").alias("n_reviews"), F.sum("versions").alias("outputs_written"), F.max("versions").alias("most_versions"))


QUERIES = {f.__name__: f for f in (p4_found, p4_kept, p6_found, p6_hourly, p6_stored_hourly, p6_business_hourly, p6_revisions)}

_FIRST = """
with ranked as (select *, row_number() over (partition by review_id order by ingest_time, event_time, stars, business_id) as r from bronze_reviews where event_time is not null and ingest_time is not null),
first as (select * from ranked where review_id is null or r = 1),
placed as (select *, date_trunc('hour', event_time) as hour, ingest_time > date_trunc('hour', event_time) + interval 25 hours as late from first)
"""

ORACLE = {
    "p4_found": "select review_id from bronze_reviews where review_id is not null group by review_id having count(*) > 1",
    "p4_kept": "select review_id, user_id, business_id, stars, text, event_time, ingest_time from (select *, row_number() over (partition by review_id order by ingest_time nulls last, user_id nulls first, business_id nulls first, stars nulls first, text nulls first, event_time nulls first) as r from bronze_reviews) where r = 1 or review_id is null",
    "p6_found": _FIRST + "select review_id from placed where late and review_id is not null",
    "p6_hourly": _FIRST
    + """, hourly as (select hour, count(*) as n, sum(stars) as s, count(stars) as c from placed where not late group by hour)
select hour::timestamp as hour, n as n_reviews, round(s / c, 6) as avg_stars, (sum(n) over w)::bigint as day_reviews, round((sum(s) over w) / (sum(c) over w), 6) as day_avg_stars
from hourly window w as (partition by date_trunc('day', hour) order by hour)""",
    "p6_business_hourly": _FIRST + "select business_id, hour::timestamp as hour, count(*) as n_reviews, round(avg(stars), 6) as avg_stars from placed where not late group by business_id, hour",
}
ORACLE["p6_stored_hourly"] = ORACLE["p6_hourly"]
# an arrival hour that brings a row in time replaces the outputs of the day's hours from the row's own on that have rows by then
ORACLE["p6_revisions"] = (
    _FIRST
    + """, steps as (select hour, date_trunc('day', hour) as day, ceil(epoch_us(ingest_time) / 3600000000.0)::bigint as piece from placed where not late),
arrivals as (select day, piece, min(hour) as earliest from steps group by 1, 2),
hours as (select day, hour, min(piece) as born, count(*) as n from steps group by 1, 2),
versions as (select h.day, h.hour, n, count(*) as versions from hours h join arrivals a on a.day = h.day and a.earliest <= h.hour and a.piece >= h.born group by 1, 2, 3)
select day::date as day, sum(n)::bigint as n_reviews, sum(versions)::bigint as outputs_written, max(versions) as most_versions from versions group by 1"""
)
