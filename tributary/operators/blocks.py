"""Pairs of members of a class, in blocks of bounded size."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tributary.session import written

#: Members in a block; a task's cell holds at most the square of it.
BLOCK = 256


def block_pairs(members: DataFrame, key: list[str], member: str, carry: list[str] = (), block: int = BLOCK) -> DataFrame:
    """Unordered pairs of different members of each class, ``{member}_a < {member}_b``.

    A class of n members is cut into ceil(n / block) blocks; every two blocks meet in one
    cell of a triangular grid, so no task ever holds a whole large class and its work is
    spread over many join keys. Classes up to ``block`` members are one cell. Members of classes of one are dropped
    first, and the rest is written once, as both sides of the grid read it.

    ``members``: ``key``, ``member`` (not null, distinct within its class) and the columns
    of ``carry``, which come out with suffixes ``_a`` and ``_b``. Null keys match nothing.
    """
    rows = members.select(*key, member, *carry)
    sizes = rows.groupBy(*key).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1")
    grid = (
        rows.join(sizes, key)
        .withColumn("_of", F.ceil(F.col("_n") / F.lit(block)).cast("int"))
        .withColumn("_i", F.pmod(F.xxhash64(member), F.col("_of")).cast("int"))
        .drop("_n")
    )
    grid = written(grid, "grid")
    left = grid.select(*key, F.col(member).alias(f"{member}_a"), *[F.col(c).alias(f"{c}_a") for c in carry], F.col("_i").alias("_x"), F.explode(F.sequence(F.col("_i"), F.col("_of") - 1)).alias("_y"))
    right = grid.select(*key, F.col(member).alias(f"{member}_b"), *[F.col(c).alias(f"{c}_b") for c in carry], F.col("_i").alias("_y"), F.explode(F.sequence(F.lit(0), F.col("_i"))).alias("_x"))
    a, b = F.col(f"{member}_a"), F.col(f"{member}_b")
    met = left.join(right, [*key, "_x", "_y"]).where((F.col("_x") < F.col("_y")) & (a != b) | (F.col("_x") == F.col("_y")) & (a < b))
    swap = a > b
    out = [*key]
    for c in [member, *carry]:
        x, y = F.col(f"{c}_a"), F.col(f"{c}_b")
        out += [F.when(swap, y).otherwise(x).alias(f"{c}_a"), F.when(swap, x).otherwise(y).alias(f"{c}_b")]
    return met.select(*out)
