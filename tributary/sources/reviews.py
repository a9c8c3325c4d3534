"""Sources of reviews: streams, files, messages."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tributary.schemas import PAYLOAD

MANDATORY = ["event_time", "user_id", "business_id", "stars"]


def kafka_stream(spark: SparkSession, servers: str = "localhost:9092", topic: str = "reviews", starting: str = "latest", **options: str) -> DataFrame:
    """Messages of a Kafka topic; needs Spark's Kafka connector on the class path."""
    reader = spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers).option("subscribe", topic).option("startingOffsets", starting)
    return reader.options(**options).load()


def file_stream(spark: SparkSession, path: str, schema: str, fmt: str = "parquet", files_per_trigger: int | None = None) -> DataFrame:
    """New files of a folder as a stream."""
    reader = spark.readStream.format(fmt).schema(schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.load(path)


def parse_messages(messages: DataFrame, value: str = "value", arrival: str | Column | None = None) -> DataFrame:
    """Typed reviews of JSON messages, batch or stream.

    ``event_time``, or ``date`` in its absence, becomes a timestamp; ``ingest_time`` is
    ``arrival`` or the current time. Rows whose JSON is malformed or whose event time,
    user, business or stars are missing or unusable are dropped; review_id and text may be null.
    """
    schema = f"{PAYLOAD}, _bad string"
    decoded = F.from_json(F.col(value).cast("string"), schema, {"columnNameOfCorruptRecord": "_bad"})
    when = F.current_timestamp() if arrival is None else F.col(arrival) if isinstance(arrival, str) else arrival
    rows = messages.select(decoded.alias("d"), when.alias("ingest_time")).where("d is not null and d._bad is null").select("d.*", "ingest_time")
    event = F.try_to_timestamp(F.coalesce("event_time", "date"))
    return rows.withColumn("event_time", event).drop("date", "_bad").dropna(subset=MANDATORY).select("review_id", "user_id", "business_id", "stars", "text", "event_time", "ingest_time")


def read_batch(spark: SparkSession, path: str, fmt: str = "parquet", required: list[str] = ()) -> DataFrame:
    """A stored table; missing ``required`` columns are an error before anything runs."""
    df = spark.read.format(fmt).load(path)
    if missing := sorted(set(required) - set(df.columns)):
        raise ValueError(f"{path} lacks {', '.join(missing)}")
    return df


def read_many(spark: SparkSession, paths: list[str], columns: list[str], fmt: str = "parquet") -> DataFrame:
    """The rows of all tables, by the names of ``columns``: a union that drops no copies."""
    tables = [spark.read.format(fmt).load(p).select(*columns) for p in paths]
    return reduce(DataFrame.unionByName, tables)


def event_column(df: DataFrame, configured: str = "") -> Column:
    """The first of: the configured column, ingest_time, event_time, date, the current time."""
    for name in (configured, "ingest_time", "event_time", "date"):
        if name and name in df.columns:
            return F.col(name).cast("timestamp")
    return F.current_timestamp()


def read_or_empty(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A Parquet table, or an empty one of the schema where there is none."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    exists = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop)
    return spark.read.schema(schema).parquet(path) if exists else spark.createDataFrame([], schema)


def recent_files(df: DataFrame, count: int) -> DataFrame:
    """Rows of the ``count`` last modified files of a file-based table."""
    meta = df.select("*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_modification_time").alias("_at"))
    last = meta.groupBy("_file").agg(F.max("_at").alias("_at")).orderBy(F.desc("_at"), F.desc("_file")).limit(count).select("_file")
    return meta.join(F.broadcast(last), "_file", "left_semi").drop("_file", "_at")


def json_lines(spark: SparkSession, path: str, rows: int | None = None, strict: bool = False) -> DataFrame:
    """JSON lines of reviews, the first ``rows`` if given; ``strict`` fails on a malformed line, else its fields are null."""
    df = spark.read.schema(PAYLOAD).option("mode", "FAILFAST" if strict else "PERMISSIVE").json(path)
    return df if rows is None else df.limit(rows)


def head_lines(spark: SparkSession, path: str, rows: int = 100_000) -> DataFrame:
    """The first ``rows`` lines that aren't blank."""
    return spark.read.text(path).where(F.trim("value") != "").limit(rows)


def sample_lines(spark: SparkSession, path: str, rows: int = 100_000, seed: int = 7) -> DataFrame:
    """``rows`` lines that aren't blank, all equally likely: those of least random priority."""
    lines = spark.read.text(path).where(F.trim("value") != "")
    return lines.withColumn("_p", F.rand(seed)).orderBy("_p").limit(rows).drop("_p")
