"""Duplicates by normalised key: exact, and by a Bloom filter."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tributary.functions.text import dup_key
from tributary.session import tasks, written


def key_digest(df_key: Column) -> Column:
    """The MD5 of a key: what crosses the network in place of the text that the key holds."""
    return F.unhex(F.md5(df_key))


def with_key(df: DataFrame, unicode_space: bool = True) -> DataFrame:
    return df.withColumn("dup_key", dup_key(F.col("user_id"), F.col("business_id"), F.col("text"), unicode_space))


def keyed_rows(df: DataFrame, unicode_space: bool = True, time: str = "ingest_time") -> DataFrame:
    """(dup_key, at, review_id, window_start, n): rows of equal key, arrival, id and minute counted once; ``dup_key`` is the key's digest."""
    minute = F.date_trunc("minute", "event_time").cast("timestamp_ntz").alias("window_start")
    digest = key_digest(dup_key(F.col("user_id"), F.col("business_id"), F.col("text"), unicode_space)).alias("dup_key")
    return df.select(digest, F.col(time).alias("at"), "review_id", minute).groupBy("dup_key", "at", "review_id", "window_start").agg(F.count(F.lit(1)).alias("n"))


def with_epochs(rows: DataFrame, capacity: int = 200_000, minutes: int = 60, fill: float = 0.8) -> DataFrame:
    """Adds ``epoch`` to ``keyed_rows``: the stretch of arrivals between two resets of a filter.

    A filter is emptied each ``minutes`` of the arrival clock (stretches start at multiples of it) and, within one, when
    ``fill`` of its capacity has arrived, copies included; both are looked at once per batch of equal arrival time, before the batch. Rows
    without an arrival time are a stretch of their own.
    """
    t = F.unix_micros(F.col("at").cast("timestamp"))
    period = F.coalesce(F.floor(t / (minutes * 60_000_000)), F.lit(-1)).alias("period")
    counted = rows.groupBy(period, "at").agg(F.sum("n").alias("arrived"))
    # the batches of one period: at most as many as it has arrival times
    before = F.coalesce(F.sum("arrived").over(Window.partitionBy("period").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    epochs = counted.select("at", F.struct("period", F.floor(before / (fill * capacity)).alias("part")).alias("epoch"))
    return rows.join(epochs, rows["at"].eqNullSafe(epochs["at"])).drop(epochs["at"])


def exact_flags(rows: DataFrame) -> DataFrame:
    """Adds ``dups``: of the rows of an entry of ``keyed_rows``, those that are not the first of their key to arrive.

    The first of a key (within its epoch, if there are epochs) is a grouped minimum, joined back, so a key that a third of all
    rows bear is never sorted in one task.
    """
    key = ["dup_key", *(["epoch"] if "epoch" in rows.columns else [])]
    order = F.struct("at", "review_id", "window_start")
    first = rows.groupBy(*key).agg(F.min(order).alias("first"))
    return rows.join(first, key).withColumn("dups", F.col("n") - (order == F.col("first")).cast("int")).drop("first")


def dup_rate(flagged: DataFrame) -> DataFrame:
    """(window_start, total, dup_count, dup_rate) per minute of event time."""
    out = flagged.groupBy("window_start").agg(F.sum("n").alias("total"), F.sum("dups").alias("dup_count"))
    return out.withColumn("dup_rate", F.coalesce(F.try_divide("dup_count", "total"), F.lit(0.0)))


def bloom_size(capacity: int, error_rate: float) -> tuple[int, int]:
    """(bits, hash functions) of a Bloom filter (Bloom 1970)."""
    bits = math.ceil(-capacity * math.log(error_rate) / math.log(2) ** 2)
    return bits, max(1, round(bits / capacity * math.log(2)))


def bloom_halves(digest: Column) -> tuple[Column, Column]:
    """The halves of a key's digest that decide its bits."""
    part = lambda start: F.conv(F.hex(F.substring(digest, start, 4)), 16, 10).cast("long")
    return part(1), part(5)


def bloom_positions(a: Column, b: Column, bits: int, hashes: int) -> Column:
    """The bits of a key by double hashing of its halves (Kirsch, Mitzenmacher 2006)."""
    return F.array(*[F.pmod(a + F.lit(i) * b, F.lit(bits)) for i in range(hashes)])


def bloom_flags(rows: DataFrame, capacity: int | None = None, error_rate: float = 0.01) -> DataFrame:
    """Adds ``dups`` as ``exact_flags`` does, but as a Bloom filter read in order of arrival tells it.

    A row is flagged iff all its bits were set by rows before it, of its epoch if there are epochs. The keys are numbered in the order of their
    first rows; the number at which a bit is first set is a grouped minimum, so the sequential filter becomes an
    aggregation and a join of numbers. ``capacity`` is that of the filter, by default the counted number of
    keys, so that the error rate holds at every size; beyond a given one errors rise as the filter's do, unless ``with_epochs``
    resets it. Positions come of 32-bit halves, enough for some 448 million keys at 1 %.
    """
    epoch = ["epoch"] if "epoch" in rows.columns else []
    order = F.struct("at", "review_id", "window_start")
    a, b = bloom_halves(F.col("dup_key"))
    halved = rows.withColumns({"_a": a, "_b": b})
    # keys of equal halves are one key to the filter
    first = halved.groupBy("_a", "_b", *epoch).agg(F.min(F.struct(order.alias("first"), "dup_key")).alias("f")).orderBy(*epoch, "f")
    first = written(first.select("_a", "_b", *epoch, "f.first", F.monotonically_increasing_id().alias("o")), "bloom-keys")
    bits, hashes = bloom_size(max(1, first.count()) if capacity is None else capacity, error_rate)
    placed = first.select("o", *epoch, F.explode(F.array_distinct(bloom_positions(F.col("_a"), F.col("_b"), bits, hashes))).alias("bit"))
    set_at = placed.groupBy("bit", *epoch).agg(F.min("o").alias("set_at"))
    false = placed.join(set_at, ["bit", *epoch]).groupBy("o").agg((F.max("set_at") < F.col("o")).alias("false_positive"))
    marked = first.join(false.where("false_positive"), "o", "left").drop("o")
    own_first = (order == F.col("first")) & F.col("false_positive").isNull()
    return halved.join(marked, ["_a", "_b", *epoch]).withColumn("dups", F.col("n") - own_first.cast("int")).drop("_a", "_b", "first", "false_positive")


def numbered(df: DataFrame, order: list[str], name: str = "_number") -> DataFrame:
    """``df`` with its rows' numbers from 0 in ``order``, sorted by ranges: no task holds more than its range."""
    marked = written(df.orderBy(*order).select("*", F.spark_partition_id().alias("_part"), F.monotonically_increasing_id().alias("_at")), "ordered")
    sizes = marked.groupBy("_part").agg(F.min("_at").alias("_low"), F.count(F.lit(1)).alias("_n"))
    # one row a partition
    offset = F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = sizes.select("_part", "_low", offset.alias("_offset"))
    return marked.join(F.broadcast(starts), "_part").withColumn(name, F.col("_at") - F.col("_low") + F.col("_offset")).drop("_part", "_at", "_low", "_offset")


def draws(df: DataFrame, rows: int, count: int, seed: int = 7) -> DataFrame:
    """(_number, _copies): ``count`` draws with replacement of numbers below ``rows``, by hash of the draw's number."""
    hashed = F.conv(F.substring(F.md5(F.concat_ws(":", F.col("id").cast("string"), F.lit(str(seed)))), 1, 15), 16, 10).cast("long")
    drawn = df.sparkSession.range(0, count, 1, tasks(df.sparkSession)).select(F.pmod(hashed, F.lit(rows)).alias("_number"))
    return drawn.groupBy("_number").agg(F.count(F.lit(1)).alias("_copies"))


def inject_exactly(df: DataFrame, fraction: float = 0.1, seed: int = 7) -> DataFrame:
    """``df`` and max(1, int(n * fraction)) copies of its rows, drawn with replacement; 0 or an empty table stay as they are, less is an error.

    Rows are numbered in the order of their columns, so the draw doesn't depend on partitioning.
    """
    if fraction < 0:
        raise ValueError("fraction must not be negative")
    rows = numbered(df, df.columns) if fraction else df
    n = rows.count() if fraction else 0
    if n == 0:
        return df
    chosen = rows.join(draws(df, n, max(1, int(n * fraction)), seed), "_number")
    return df.unionByName(chosen.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_copies").cast("int")))).select(*df.columns))


def inject_duplicates(df: DataFrame, fraction: float = 0.1, key: str = "review_id", seed: int = 7) -> DataFrame:
    """``df`` with about ``fraction`` of its rows once more, drawn by a hash of their key, without a sort; 0 leaves it as it is, less is an error."""
    if fraction < 0:
        raise ValueError("fraction must not be negative")
    if fraction == 0:
        return df
    part = F.conv(F.substring(F.md5(F.concat_ws(":", F.coalesce(F.col(key).cast("string"), F.lit("")), F.lit(str(seed)))), 1, 8), 16, 10).cast("long")
    return df.unionByName(df.where(part < int(fraction * 2**32)))


def shuffled(df: DataFrame, seed: int = 7) -> DataFrame:
    """Rows in random order."""
    return df.orderBy(F.rand(seed))
