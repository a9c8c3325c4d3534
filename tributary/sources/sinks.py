"""Sinks: streams to Parquet, batches, JSON lines, Kafka, relational databases."""

from __future__ import annotations

import logging
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter
from pyspark.sql.types import StructType

from tributary.schemas import TABLES
from tributary.session import drop_path, file_system

log = logging.getLogger(__name__)


def parquet_stream(df: DataFrame, path: str, checkpoint: str, trigger: str | None = "5 seconds", partition_by: list[str] = ()) -> DataStreamWriter:
    """A writer that appends a stream to a Parquet table; ``trigger=None`` takes all there is and stops."""
    writer = df.writeStream.format("parquet").outputMode("append").option("path", path).option("checkpointLocation", checkpoint)
    writer = writer.trigger(availableNow=True) if trigger is None else writer.trigger(processingTime=trigger)
    return writer.partitionBy(*partition_by) if partition_by else writer


class Tolerant:
    """Calls a function; its errors are logged and counted in ``errors``, and don't reach the caller."""

    def __init__(self, call: Callable[..., None], name: str = ""):
        self.call, self.name, self.errors = call, name or getattr(call, "__name__", "call"), 0

    def __call__(self, *args) -> None:
        try:
            self.call(*args)
        except Exception:
            self.errors += 1
            log.exception("%s failed", self.name)


def batch_stream(df: DataFrame, handle: Callable[[DataFrame, int], None], checkpoint: str, trigger: str | None = "5 seconds") -> DataStreamWriter:
    """A writer that hands each batch to ``handle``; wrapped in ``Tolerant`` a failing batch is counted there and the stream goes on."""
    writer = df.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint)
    return writer.trigger(availableNow=True) if trigger is None else writer.trigger(processingTime=trigger)


def append_batch(path: str) -> Callable[[DataFrame, int], None]:
    """For ``batch_stream``: each batch in a folder of its number, so a repeated batch replaces itself."""
    return lambda batch, number: batch.write.mode("overwrite").parquet(f"{path}/batch={number}")


def append_counted(df: DataFrame, path: str) -> int:
    """Append to a Parquet table; the number of rows, counted as they are written. Nothing is appended where there is no row.

    The rows are written to a folder of their own beside the table's, whose files are then moved in; so an empty frame leaves no file, without a
    job that looks for a first row.
    """
    spark, seen = df.sparkSession, Observation()
    draft = f"{path.rstrip('/')}/_draft-{uuid.uuid4().hex}"
    df.observe(seen, F.count(F.lit(1)).alias("n")).write.parquet(draft)
    n = seen.get["n"]
    if n:
        fs, folder = file_system(spark, draft)
        for s in fs.listStatus(folder):
            if s.getPath().getName().startswith("part-"):
                fs.rename(s.getPath(), file_system(spark, f"{path.rstrip('/')}/{s.getPath().getName()}")[1])
    drop_path(spark, draft)
    return n


def write_json_lines(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def replay(df: DataFrame, send: Callable[[str], None] | None = None, servers: str = "localhost:9092", topic: str = "reviews", rows_per_second: float = 20) -> int:
    """Publish rows as JSON messages: to Kafka by its connector, or by ``send`` at a steady rate, a partition at a time.

    Lines that are blank don't occur in a table; a null row is skipped.
    """
    import time

    values = df.select(F.to_json(F.struct("*")).alias("value"))
    if send is None:
        values.write.format("kafka").option("kafka.bootstrap.servers", servers).option("topic", topic).save()
        return -1
    sent = 0
    for row in values.toLocalIterator():
        send(row.value)
        sent += 1
        if rows_per_second:
            time.sleep(1 / rows_per_second)
    return sent


# The tables that ``load_all`` moves to the reporting database, and their names there.
REPORTED = {
    "metrics_1m": "metrics_1m",
    "gold_dup_rate_1m": "dup_rate_1m",
    "fm_distinct_users": "fm_distinct_users",
    "performance_metrics": "performance_metrics",
    "accuracy_fm_summary": "accuracy_fm_summary",
    "accuracy_bloom_summary": "accuracy_bloom_summary",
}
REPORTED |= {f"{t}_high_rated": f"{n}_high_rated" for t, n in REPORTED.items()}
REPORTED |= {"storage_metrics": "storage_metrics", "dup_lsh_bug_summary": "dup_lsh_bug_summary"}


def jdbc_writer(url: str, user: str, password: str) -> Callable[[DataFrame, str], None]:
    """Appends a table over JDBC; the driver has to be on the class path."""
    return lambda df, name: df.write.jdbc(url, name, mode="append", properties={"user": user, "password": password})


def load_all(spark: SparkSession, folder: str, write: Callable[[DataFrame, str], None], names: dict[str, str] | None = None) -> dict[str, str]:
    """Append each table of ``folder`` under its name; missing and empty ones are skipped, and a failure doesn't stop the others."""
    told = {}
    for name, target in (REPORTED if names is None else names).items():
        try:
            df = spark.read.parquet(f"{folder}/{name}")
            known = TABLES.get(name)
            df = df.select(*[c for c in StructType.fromDDL(known).names if c in df.columns]) if known else df
            if df.isEmpty():
                told[name] = "empty"
                continue
            write(df, target)
            told[name] = "loaded"
        except Exception as e:
            kinds = {"PATH_NOT_FOUND": "missing", "UNABLE_TO_INFER_SCHEMA": "empty"}
            told[name] = next((v for k, v in kinds.items() if k in str(e)), f"failed: {type(e).__name__}")
            log.warning("%s: %s", name, told[name])
    return told
