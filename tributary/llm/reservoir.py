"""A uniform sample of fixed size per window from data that arrives in pieces."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tributary.functions.grouped import sorted_groups
from tributary.operators.idindex import IdIndex
from tributary.session import new_path, ship, written
from tributary.stored import Manifest


def _rng(*parts) -> np.random.Generator:
    import xxhash

    return np.random.default_rng(xxhash.xxh3_128_intdigest(repr(parts).encode()))


#: Records of a sample that a slot should hold at most.
SLOT = 1 << 16


def slots_for(k: int) -> int:
    """Slots of a sample of ``k``: a slot's share of it is one task's work at a time."""
    return max(8, -(-k // SLOT))


def draw(counts: dict[object, list[int]], k: int, rng: np.random.Generator, seen: int = 0, held: list[int] | None = None) -> list[tuple[object, list[int], list[int]]]:
    """(piece, inserted per slot, evicted per slot) for one window.

    ``counts``: rows per slot of each piece, in order of arrival; ``seen`` rows came before, of which the slots hold ``held``. With ``seen`` rows before
    and n in a piece, the sample of min(k, seen + n) of all holds a hypergeometric number
    of the piece's; that number is split over the slots by the multivariate hypergeometric
    distribution of their counts, the evictions by that of their present rows.
    """
    out, held = [], None if held is None else np.asarray(held, dtype=np.int64)
    for piece, per_slot in counts.items():
        own = np.asarray(per_slot, dtype=np.int64)
        held = np.zeros(len(own), dtype=np.int64) if held is None else held
        n, size = int(own.sum()), min(k, seen)
        after = min(k, seen + n)
        taken = int(rng.hypergeometric(n, seen, after)) if seen else after
        inserted = rng.multivariate_hypergeometric(own, taken, method="marginals")
        evicted = rng.multivariate_hypergeometric(held, size + taken - after, method="marginals")
        held, seen = held - evicted + inserted, seen + n
        out.append((piece, inserted.tolist(), evicted.tolist()))
    return out


def evict(held: list, count: int, rng: np.random.Generator) -> None:
    """Remove ``count`` members, all equally likely, in place: the last ones take their places."""
    for _ in range(count):
        i = int(rng.integers(len(held)))
        last = held.pop()
        if i < len(held):
            held[i] = last


def planner(k: int, slots: int, seed: int):
    """Rows (w, p, slot, n) sorted by window and piece to (w, p, slot, inserted, evicted, seen).

    Rows of piece STORED tell what is there: ``n`` is the members of a slot, and ``seen`` the records met so far, in each of them.
    """
    schema = pa.schema([("w", pa.int64()), ("p", pa.int64()), ("slot", pa.int32()), ("inserted", pa.int64()), ("evicted", pa.int64()), ("seen", pa.int64())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        for (w,), g in sorted_groups(batches, ["w"]):
            counts, held, seen, last = {}, [0] * slots, 0, None
            for p, s, n, before in zip(g["p"], g["slot"], g["n"], g["seen"]):
                if p == STORED:
                    held[s] += n
                    seen = before
                else:
                    counts.setdefault(p, [0] * slots)[s] += n
                    last = p
            if last is None:
                continue
            total = seen + sum(map(sum, counts.values()))
            # what is drawn depends on the pieces before, too
            for p, ins, out in draw(counts, k, _rng(seed, w, seen, last), seen, held):
                rows += [(w, p, s, i, o, total) for s, (i, o) in enumerate(zip(ins, out)) if i or o or p == last]
            if len(rows) > 10_000:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)
                rows = []
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    return work


def sampler(seed: int, kind: pa.DataType):
    """Rows (w, slot, p, kind, id, evicted) sorted by window, slot, piece and kind to the members (w, slot, id) of each slot: 0 evicts, 1 adds."""
    schema = pa.schema([("w", pa.int64()), ("slot", pa.int32()), ("id", kind)])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        for (w, slot), g in sorted_groups(batches, ["w", "slot"]):
            held: list = []
            for p, kind_, id_, n in zip(g["p"], g["kind"], g["id"], g["evicted"]):
                if kind_ == 0:
                    evict(held, n, _rng(seed, w, slot, p))
                else:
                    held.append(id_)
            rows += [(w, slot, x) for x in held]
            if len(rows) > 10_000:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)
                rows = []
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    return work


#: The piece of what a store holds already: before all others, those without an arrival time too.
STORED = -(2**63)


class WindowReservoir:
    """``k`` records of each window, every distinct record of it being equally likely.

    Records are the distinct non-null ``id`` of ``df``; rows of an id count once, in the
    window of its first row to arrive (least ``arrival``, then least ``event``). Rows with a
    null id or event time take no part; a null arrival comes before all others. Windows of up to ``k`` records come out
    whole. ``piece`` maps the arrival time to the batch it came in.

    Per window and piece only counts per slot (a hash of the id) go through the draw. Of a
    piece at most k rows per slot leave the map side (rank limit), and each slot of a
    window evicts and inserts on its own, so a window with a third of all rows is spread
    over its slots, whose number follows ``k`` (SLOT members to each). Draws are seeded by
    ``seed``, window, slot and piece: a task that is run again draws the same.

    ``stored`` (w, slot, id, seen) are the members of samples of earlier batches, which the table's pieces go on from.
    """

    def __init__(self, df: DataFrame, id: str, event: str, arrival: str, window: str = "minute", piece: str = "hour", k: int = 100, slots: int | None = None, seed: int = 42, stored: DataFrame | None = None):
        ship(df.sparkSession)
        self.k, self.slots, self.seed, self.stored = k, slots or slots_for(k), seed, stored
        rows = df.select(F.col(id).alias("id"), F.col(event).cast("timestamp").alias("e"), F.col(arrival).cast("timestamp").alias("a")).where("id is not null and e is not null")
        first = rows.groupBy("id").agg(F.min(F.struct("a", "e")).alias("r"))
        slot: Column = F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(self.slots)).cast("int")
        self.id_type = rows.schema["id"].dataType.simpleString()
        placed = first.select("id", F.unix_micros(F.date_trunc(window, "r.e")).alias("w"), F.coalesce(F.unix_micros(F.date_trunc(piece, "r.a")), F.lit(-(2**62))).alias("p"), slot.alias("slot"))
        self.rows = written(placed, "records")

    def plan(self) -> DataFrame:
        """(w, p, slot, inserted, evicted, seen)."""
        counted = self.rows.groupBy("w", "p", "slot").agg(F.count(F.lit(1)).alias("n")).withColumn("seen", F.lit(0).cast("long"))
        if self.stored is not None:
            before = self.stored.groupBy("w", F.lit(STORED).alias("p"), "slot").agg(F.count(F.lit(1)).alias("n"), F.max("seen").alias("seen"))
            counted = counted.unionByName(before)
        ordered = counted.repartition("w").sortWithinPartitions("w", "p", "slot")
        return written(ordered.mapInArrow(planner(self.k, self.slots, self.seed), "w long, p long, slot int, inserted long, evicted long, seen long"), "draws")

    def members(self, plan: DataFrame) -> DataFrame:
        """(w, slot, id) of the windows that the plan touches."""
        # a uniform subset of a piece's slot: the least of random priorities
        by = Window.partitionBy("w", "p", "slot").orderBy(F.xxhash64("id", F.lit(self.seed + 1)), "id")
        ranked = self.rows.withColumn("r", F.row_number().over(by)).where(F.col("r") <= self.k)
        nothing = F.lit(0).cast("long").alias("evicted")
        inserted = ranked.join(plan.where("inserted > 0").drop("evicted"), ["w", "p", "slot"]).where("r <= inserted").select("w", "slot", "p", F.lit(1).alias("kind"), "id", nothing)
        evicted = plan.where("evicted > 0").select("w", "slot", "p", F.lit(0).alias("kind"), F.lit(None).cast(self.id_type).alias("id"), "evicted")
        events = inserted.unionByName(evicted)
        if self.stored is not None:
            events = events.unionByName(self.stored.select("w", "slot", F.lit(STORED).alias("p"), F.lit(1).alias("kind"), "id", nothing))
        ordered = events.repartition("w", "slot").sortWithinPartitions("w", "slot", "p", "kind", "id")
        kind = self.rows.select("id").limit(0).toArrow().schema.field(0).type
        return ordered.mapInArrow(sampler(self.seed, kind), f"w long, slot int, id {self.id_type}")

    def sample(self) -> DataFrame:
        """(window_start, id)."""
        return self.members(self.plan()).select(F.timestamp_micros("w").alias("window_start"), "id")


class ReservoirStore:
    """Samples that outlive a run: each batch goes on from the stored members and counts.

    Under ``path`` lie the members of each window with the number of records it has met, per day, and the identifiers met so far
    (IdIndex), as an id counts once. A batch rewrites the days it touches; the manifest then names the new tables, all at once. The newest batch may be
    processed again under its ``batch_id``. ``k``, ``slots`` and ``seed`` must stay the same. See WindowReservoir for the rest.
    """

    def __init__(self, spark: SparkSession, path: str | None = None, id: str = "review_id", event: str = "event_time", arrival: str = "ingest_time", window: str = "minute", k: int = 100, slots: int | None = None, seed: int = 42):
        self.spark, self.path, self.columns, self.k, self.window, self.seed = spark, path or new_path(spark, "samples"), (id, event, arrival), k, window, seed
        self.slots = slots or slots_for(k)
        self.manifest, self.index = Manifest(spark, self.path), IdIndex(spark, f"{self.path}/ids")
        self.state = self.manifest.read() or {"batch": None, "days": {}, "before": {}}

    def process(self, batch: DataFrame, batch_id: int | str) -> None:
        """Draw from the batch."""
        again = self.state["batch"] == str(batch_id)
        days = self.state["before"] if again else self.state["days"]
        id, event, arrival = self.columns
        rows = written(batch.select(F.col(id).cast("string").alias("id"), F.col(event).cast("timestamp").alias("e"), F.col(arrival).cast("timestamp").alias("a")).where("id is not null and e is not null"), "arrived")
        novel = self.index.process(rows, batch_id, "id").where("not known").select("id")
        drawn = WindowReservoir(rows.join(novel, "id", "left_semi"), "id", "e", "a", self.window, "hour", self.k, self.slots, self.seed)
        day = F.to_date(F.timestamp_micros("w"))
        touched = [r[0].isoformat() for r in drawn.rows.select(day.alias("day")).distinct().collect()]  # days of the calendar
        # windows of these days that the batch doesn't touch are kept as they are
        drawn.stored = self._members({d: days[d] for d in touched if d in days})
        plan = drawn.plan()
        seen = plan.groupBy("w").agg(F.max("seen").alias("seen"))
        members = drawn.members(plan).join(seen, "w", "left")
        if drawn.stored is not None:
            kept = drawn.stored.groupBy("w").agg(F.max("seen").alias("kept"))
            members = members.join(kept, "w", "left").select("w", "slot", "id", F.coalesce("seen", "kept").alias("seen"))
        step = self.manifest.new_table("step")
        members.select("w", "slot", "id", "seen", day.alias("day")).write.partitionBy("day").parquet(self.manifest.at(step))
        old = {*self.state["days"].values(), *self.state["before"].values()}
        self.state = {"batch": str(batch_id), "days": days | {d: step for d in touched}, "before": days}
        self.manifest.commit(self.state)
        self.manifest.drop(sorted(old - {*self.state["days"].values(), *days.values()}))

    def _members(self, days: dict[str, str]) -> DataFrame | None:
        out = None
        for step in sorted(set(days.values())):
            own = [d for d, s in days.items() if s == step]
            part = self.spark.read.schema("w long, slot int, id string, seen long, day date").parquet(self.manifest.at(step)).where(F.col("day").isin(own)).drop("day")
            out = part if out is None else out.unionByName(part)
        return out

    def sample(self) -> DataFrame:
        """(window_start, id, seen): the samples as they now are, and how many records their windows have met."""
        rows = self._members(self.state["days"])
        if rows is None:
            rows = self.spark.createDataFrame([], "w long, slot int, id string, seen long")
        return rows.select(F.timestamp_micros("w").alias("window_start"), "id", "seen")
