"""Flajolet-Martin distinct counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed value: the correction factor of Flajolet and Martin (1985).
PHI = 0.77351


def trailing_zeros(user: Column, i: int) -> Column:
    """Trailing zero bits of the i-th 32-bit hash of a user; 32 for a hash of 0."""
    h = F.conv(F.substring(F.md5(F.concat(user, F.lit(f"_{i}"))), 1, 8), 16, 10).cast("long")
    low = h.bitwiseAND(-h)
    return F.when(h == 0, 32).otherwise(F.bit_count(low - 1)).cast("int")


def median_of(columns: list[Column]) -> Column:
    ordered, n = F.array_sort(F.array(*columns)), len(columns)
    return (F.get(ordered, F.lit((n - 1) // 2)) + F.get(ordered, F.lit(n // 2))) / 2


def fm_windows(df: DataFrame, hashes: int = 5, duration: str = "10 seconds", time: str = "ingest_time", user: str = "user_id", exact_below: int = 1_000_000, emit_zero: bool = True, watermark: str | None = None) -> DataFrame:
    """Estimate beside exact count per window; with ``emit_zero`` false, windows whose registers are all 0 are left out.

    Registers are maxima and the exact count's distinct users combine before the shuffle.
    ``distinct_users_exact`` is null from ``exact_below`` on. ``distinct_users_estimate`` is the exact count where
    known, the sketch's own is ``raw_distinct_users_estimate``; ``error_percent`` is a fraction. On a stream (with a
    ``watermark``) the exact count is the size of a state set.
    """
    rows = df.where(F.col(user).isNotNull() & F.col(time).isNotNull()).select(F.col(time).alias("t"), F.col(user).alias("u"))
    if watermark:
        rows = rows.withWatermark("t", watermark)
    registers = [F.max(trailing_zeros(F.col("u"), i)).alias(f"r{i}") for i in range(hashes)]
    w = F.window("t", duration).alias("w")
    exact = F.size(F.collect_set("u")).cast("long") if watermark else F.count_distinct("u")
    merged = rows.groupBy(w).agg(*registers, exact.alias("n"))
    names = [F.col(f"r{i}") for i in range(hashes)]
    most = F.greatest(*names) if hashes > 1 else names[0]
    raw = F.greatest(median_of([F.pow(F.lit(2.0), r) for r in names]) / PHI, F.lit(1.0))
    known = F.when(F.col("n") < exact_below, F.col("n"))
    out = merged.select(F.col("w.start").alias("window_start"), known.alias("distinct_users_exact"), raw.alias("raw_distinct_users_estimate"), most.cast("long").alias("max_trailing_zeros"), F.lit(hashes).cast("long").alias("num_hash_functions"))
    if not emit_zero:
        out = out.where("max_trailing_zeros > 0")
    e, r = F.col("distinct_users_exact"), F.col("raw_distinct_users_estimate")
    out = out.withColumns({"distinct_users_estimate": F.coalesce(e.cast("double"), r), "error_percent": F.try_divide(F.abs(r - e), e)})
    return out.select("window_start", "distinct_users_estimate", "distinct_users_exact", "raw_distinct_users_estimate", "error_percent", "max_trailing_zeros", "num_hash_functions")
