"""Count of ones in a sliding time window in logarithmic space (Datar, Gionis, Indyk, Motwani 2002)."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tributary.functions.grouped import sorted_groups
from tributary.session import ship


class Buckets:
    """Buckets of ones, newest first, each a (time of its latest one, size); at most two of a size.

    ``earliest=True`` gives the older variant that stamps a merged bucket with its earliest one and takes
    its size for minutes that it still covers.
    """

    def __init__(self, window: int, buckets: list[tuple[int, int]] = (), clock: int = -(2**62), earliest: bool = False):
        self.window, self.buckets, self.clock, self.earliest = window, list(buckets), clock, earliest

    def advance(self, time: int) -> None:
        """Move the clock; buckets that have left the window go."""
        self.clock = max(self.clock, time)
        covers = 60_000_000 if self.earliest else 0
        self.buckets = [(t, s) for t, s in self.buckets if t + s * covers >= self.clock - self.window]

    def add(self, time: int, ones: int = 1) -> None:
        """Ones at a time; a time before the clock counts at its own place."""
        self.advance(time)
        if time < self.clock - self.window:
            return
        for _ in range(ones):
            i = 0
            while i < len(self.buckets) and self.buckets[i][0] > time:
                i += 1
            self.buckets.insert(i, (time, 1))
            size = 1
            while len(same := [j for j, b in enumerate(self.buckets) if b[1] == size]) > 2:
                a, b = same[-2], same[-1]
                stamp = min(self.buckets[a][0], self.buckets[b][0]) if self.earliest else max(self.buckets[a][0], self.buckets[b][0])
                del self.buckets[b]
                self.buckets[a] = (stamp, 2 * size)
                size *= 2

    def estimate(self) -> int:
        """All buckets but half of the oldest, whose first ones may have left."""
        if not self.buckets:
            return 0
        if self.earliest:
            inside = [s for t, s in self.buckets if t >= self.clock - self.window]
            older = [s for t, s in self.buckets if t < self.clock - self.window]
            return sum(inside) + (older[0] // 2 if older else 0)
        oldest = self.buckets[-1][1]
        return sum(s for _, s in self.buckets) - oldest + (oldest + 1) // 2


def dgim(df: DataFrame, predicate: Column, minutes: int = 60, time: str = "event_time", key: str = "business_id", earliest: bool = False) -> DataFrame:
    """(key, ts, window_minutes, estimate): after each time at which the key has rows, the estimated rows with ``predicate`` in the window.

    Rows are counted per key and time first. As only ``minutes`` of history matter, a key
    is cut into periods of ``minutes``, each replayed with the period before it: a hot key is spread over
    its periods. The error is at most half of the exact count. Null keys and times take no part.
    """
    ship(df.sparkSession)
    span = minutes * 60_000_000
    t = F.unix_micros(F.col(time).cast("timestamp"))
    counted = df.where(F.col(time).isNotNull() & F.col(key).isNotNull()).groupBy(F.col(key).cast("string").alias("key"), t.alias("t")).agg(F.count_if(predicate).alias("ones"))
    period = F.floor(F.col("t") / span)
    both = counted.withColumn("own", period).withColumn("p", F.explode(F.array(period, period + 1)))

    def replay(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (k, p), g in sorted_groups(batches, ["key", "p"]):
            state, out = Buckets(span, earliest=earliest), []
            for at, n, own in zip(g["t"], g["ones"], g["own"]):
                state.add(at, n) if n else state.advance(at)
                if own == p:
                    out.append((at, state.estimate()))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array([k] * len(out)), pa.array([o[0] for o in out], pa.int64()), pa.array([o[1] for o in out], pa.int64())], names=["key", "t", "estimate"])

    ordered = both.repartition("key", "p").sortWithinPartitions("key", "p", "t")
    found = ordered.mapInArrow(replay, "key string, t long, estimate long")
    return found.select(F.col("key").alias(key), F.timestamp_micros("t").cast("timestamp_ntz").alias("ts"), F.lit(minutes).alias("window_minutes"), "estimate")
