"""Stateful stream processors: duplicate flags, exact and by Bloom filters, bottom-k samples, DGIM."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tributary.config import BloomConfig
from tributary.functions.text import dup_key
from tributary.operators.dgim import Buckets
from tributary.operators.duplicates import bloom_halves, bloom_size, key_digest
from tributary.session import keep_states, ship

CARRIED = "event_time timestamp, review_id string, user_id string, business_id string, stars double, text string"
NAMES = ["event_time", "review_id", "user_id", "business_id", "stars", "text"]


def _in_order(rows: Iterator[pd.DataFrame]) -> pd.DataFrame:
    frame = pd.concat(list(rows))
    return frame.sort_values(["arrived", "review_id", *(c for c in ("a", "b") if c in frame), "event_time"], na_position="first", kind="stable")


class _SeenFlags(StatefulProcessor):
    """Per bucket a map from the digests met to the arrival time of their last row.

    A key is forgotten once the arrival times have moved on by ``reset`` microseconds; entries that old are
    removed whenever the clock has moved by that much. The state is asked and told once per key of a batch.
    """

    def __init__(self, reset: int):
        self.reset = reset

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getMapState("seen", "k string", "at long")
        self.pruned = handle.getValueState("pruned", "at long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        frame = _in_order(rows)
        at = frame["arrived"].to_numpy()
        before = frame.groupby("digest", sort=False)["arrived"].shift(1)
        first = before.isna().to_numpy()
        stored = [self.seen.getValue((k,))[0] if self.seen.containsKey((k,)) else None for k in frame["digest"][first]]
        last_met = before.to_numpy(dtype=float)
        last_met[first] = [np.nan if s is None else s for s in stored]
        flags = at - last_met <= self.reset
        for k, t in frame.groupby("digest", sort=False)["arrived"].last().items():
            self.seen.updateValue((k,), (int(t),))
        now = int(at[-1])
        last = self.pruned.get()[0] if self.pruned.exists() else now
        if now - last > self.reset:
            for k in [k[0] for k, t in self.seen.iterator() if now - t[0] > self.reset]:
                self.seen.removeKey((k,))
            last = now
        self.pruned.update((last,))
        yield frame[NAMES].assign(is_dup=flags)

    def close(self) -> None:
        pass


def _bucketed(reviews: DataFrame, buckets: int) -> DataFrame:
    """Rows with arrival in microseconds (0 if there is none), the key's digest and the digest's bucket."""
    ship(reviews.sparkSession)
    keep_states(reviews.sparkSession)
    digest = key_digest(dup_key(F.col("user_id"), F.col("business_id"), F.col("text")))
    keyed = reviews.select(*NAMES, F.coalesce(F.unix_micros("ingest_time"), F.lit(0)).alias("arrived"), digest.alias("d"))
    return keyed.withColumn("bucket", F.pmod(F.conv(F.hex(F.substring("d", 9, 4)), 16, 10).cast("long"), F.lit(buckets)))


def _with_key(flagged: DataFrame) -> DataFrame:
    return flagged.withColumn("dup_key", dup_key(F.col("user_id"), F.col("business_id"), F.col("text")))


def seen_flags(reviews: DataFrame, reset_minutes: int = 60, buckets: int = 1024) -> DataFrame:
    """Each row of a stream with ``is_dup`` and ``dup_key``: whether its key came within ``reset_minutes`` before it, exactly.

    Keys are state entries of ``buckets`` buckets, by digest, so they spread over all tasks, and each expires by itself. Rows without
    an arrival time count as the earliest.
    """
    rows = _bucketed(reviews, buckets).withColumn("digest", F.hex("d")).drop("d")
    return _with_key(rows.groupBy("bucket").transformWithStateInPandas(_SeenFlags(reset_minutes * 60_000_000), f"{CARRIED}, is_dup boolean", "Append", "None"))


class _BloomFlags(StatefulProcessor):
    """Per bucket a Bloom filter, emptied before a batch once it is ``fill`` full or ``reset`` microseconds of arrival time old."""

    def __init__(self, bits: int, hashes: int, full: float, reset: int):
        self.bits, self.hashes, self.full, self.reset = bits, hashes, full, reset

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.filter = handle.getValueState("filter", "bits binary, adds long, since long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        frame = _in_order(rows)
        now = int(frame["arrived"].iloc[0])
        bits, adds, since = self.filter.get() if self.filter.exists() else (b"", 0, now)
        if not bits or adds >= self.full or now - since >= self.reset:
            bits, adds, since = bytes(-(-self.bits // 8)), 0, now
        own = bytearray(bits)
        i = np.arange(self.hashes, dtype=np.int64)
        places = (frame["a"].to_numpy()[:, None] + i * frame["b"].to_numpy()[:, None]) % self.bits
        flags = []
        for row in places.tolist():
            known = True
            for p in row:
                if not own[p >> 3] >> (p & 7) & 1:
                    known = False
                    own[p >> 3] |= 1 << (p & 7)
            flags.append(known)
        self.filter.update((bytes(own), adds + len(frame), since))
        yield frame[NAMES].assign(is_dup=flags)

    def close(self) -> None:
        pass


def bloom_seen_flags(reviews: DataFrame, config: BloomConfig | None = None, watermark: str | None = None) -> DataFrame:
    """Each row of a stream with ``is_dup`` and ``dup_key``, as a Bloom filter of ``capacity`` keys and ``error_rate`` tells it.

    The filter is cut into ``buckets`` by the key's digest, each with its share of the capacity and reset by itself, so it
    is spread over all tasks, a key always meets the same part, and no repeat since the last reset is missed; a key of a third of all rows is still
    one bucket's. With a ``watermark`` later rows are dropped and the event time may be aggregated further.
    """
    config = config or BloomConfig()
    share = max(1, -(-config.capacity // config.buckets))
    bits, hashes = bloom_size(share, config.error_rate)
    a, b = bloom_halves(F.col("d"))
    rows = reviews.withWatermark("event_time", watermark) if watermark else reviews
    rows = _bucketed(rows, config.buckets).withColumns({"a": a, "b": b}).drop("d")
    work = _BloomFlags(bits, hashes, 0.8 * share, config.reset_interval_minutes * 60_000_000)
    kinds = f"{CARRIED}, is_dup boolean"
    grouped = rows.groupBy("bucket")
    if watermark:
        return _with_key(grouped.transformWithStateInPandas(work, kinds, "Append", "EventTime", eventTimeColumnName="event_time"))
    return _with_key(grouped.transformWithStateInPandas(work, kinds, "Append", "None"))


def dup_rates(reviews: DataFrame, config: BloomConfig | None = None) -> DataFrame:
    """(window_start, total, dup_count, dup_rate) of a stream per minute of event time, once the watermark has passed it."""
    config = config or BloomConfig()
    flagged = bloom_seen_flags(reviews, config, f"{config.watermark_minutes} minutes")
    out = flagged.groupBy(F.window("event_time", "1 minute").alias("w")).agg(F.count(F.lit(1)).alias("total"), F.count_if("is_dup").alias("dup_count"))
    return out.select(F.col("w.start").alias("window_start"), "total", "dup_count", F.coalesce(F.try_divide("dup_count", "total"), F.lit(0.0)).alias("dup_rate"))


class _BottomK(StatefulProcessor):
    """The k rows of least priority of a window, an id once; out they come when the watermark passes its end."""

    def __init__(self, k: int):
        self.k = k

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.kept = handle.getListState("kept", "priority string, at long, review_id string, user_id string, business_id string, stars double, text string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        held = {r[0]: tuple(r) for r in self.kept.get()}
        fresh = not held
        for frame in rows:
            least = frame.drop_duplicates("priority").sort_values("priority").head(self.k)
            columns = [least[c].astype(object).where(least[c].notna(), None) for c in NAMES[1:]]
            for r in zip(least["priority"], least["at"].tolist(), *columns):
                held.setdefault(r[0], r)
        self.kept.put([held[p] for p in sorted(held)[: self.k]])
        if fresh:
            self.handle.registerTimer(int(key[0]) * 1000)
        return iter([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        held = pd.DataFrame([tuple(r)[1:] for r in self.kept.get()], columns=NAMES)
        self.kept.clear()
        yield held.assign(event_time=pd.to_datetime(held["event_time"], unit="us"), window_start=pd.to_datetime(int(key[0]) - 60, unit="s"))

    def close(self) -> None:
        pass


def minute_samples(reviews: DataFrame, k: int = 100, watermark: str = "2 minutes", seed: int = 42) -> DataFrame:
    """Whole rows of a stream with ``window_start``: up to ``k`` of different ids per minute of event time, all equally likely; rows without an id take no part."""
    ship(reviews.sparkSession)
    keep_states(reviews.sparkSession)
    priority = F.md5(F.concat("review_id", F.lit(f":{seed}"))).alias("priority")
    end = (F.unix_seconds(F.date_trunc("minute", "event_time")) + 60).alias("window_end")
    rows = reviews.where("review_id is not null").withWatermark("event_time", watermark).select(*NAMES, F.unix_micros("event_time").alias("at"), priority, end)
    return rows.groupBy("window_end").transformWithStateInPandas(_BottomK(k), f"{CARRIED}, window_start timestamp", "Append", "EventTime")


class _DGIM(StatefulProcessor):
    """Buckets of a key, and with ``exact`` the ones of each time in the window beside them."""

    def __init__(self, minutes: int, exact: bool):
        self.minutes, self.exact = minutes, exact

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("buckets", "clock long, times array<long>, sizes array<long>, met array<long>, ones array<long>")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        clock, times, sizes, met, ones = self.state.get() if self.state.exists() else (-(2**62), [], [], [], [])
        span = self.minutes * 60_000_000
        buckets = Buckets(span, list(zip(times, sizes)), clock)
        # frames come in any order: sort the whole batch of the key
        frame = pd.concat(list(rows)).groupby("t", sort=True)["one"].sum()
        for t, n in zip(frame.index.tolist(), frame.tolist()):
            buckets.add(t, int(n)) if n else buckets.advance(t)
        total = None
        if self.exact:
            every = pd.Series(list(ones), index=list(met), dtype="int64").add(frame, fill_value=0).astype("int64")
            every = every[(every.index >= buckets.clock - span) & (every > 0)]
            met, ones, total = every.index.tolist(), every.tolist(), int(every.sum())
        self.state.update((buckets.clock, [b[0] for b in buckets.buckets], [b[1] for b in buckets.buckets], met, ones))
        yield pd.DataFrame({"key": [key[0]], "ts": pd.to_datetime([buckets.clock], unit="us"), "window_minutes": pd.array([self.minutes], dtype="int32"), "estimate": [buckets.estimate()], "exact": pd.array([total], dtype="Int64")})

    def close(self) -> None:
        pass


def sliding_estimates(reviews: DataFrame, minutes: int = 60, least_stars: float = 4.0, key: str = "business_id", exact: bool = True) -> DataFrame:
    """(key, ts, window_minutes, estimate, exact) after each batch of a stream, for each key in it: rows of at least ``least_stars`` in the last ``minutes``.

    The exact count, null if not asked for, takes a number for each time in the window.
    """
    ship(reviews.sparkSession)
    keep_states(reviews.sparkSession)
    rows = reviews.select(F.col(key).cast("string").alias("key"), F.unix_micros("event_time").alias("t"), (F.coalesce(F.col("stars"), F.lit(0.0)) >= least_stars).cast("int").alias("one")).where("key is not null and t is not null")
    return rows.groupBy("key").transformWithStateInPandas(_DGIM(minutes, exact), "key string, ts timestamp, window_minutes int, estimate long, exact long", "Update", "None")
