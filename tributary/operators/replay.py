"""Aggregates by event time that are corrected as late rows arrive: checkpoint and replay."""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tributary.functions.grouped import sorted_groups
from tributary.operators.idindex import IdIndex, arrival_slices
from tributary.session import new_path, semi, ship, tasks, written
from tributary.stored import Manifest


class OrderedState:
    """The ordered state of one key and day: a log by event minute, with a snapshot before each period."""

    def __init__(self, period: int = 60):
        self.period, self.minutes, self.log, self.snapshots = period, [], {}, {}

    def restore(self, log: list[tuple[int, int, float, int]], snapshots: list[tuple[int, int, float, int]]) -> None:
        """Take up a stored state: (minute, rows, sum, rated) by minute, and (period, running rows, sum, rated)."""
        self.minutes, self.log = [e[0] for e in log], {e[0]: e[1:] for e in log}
        self.snapshots = {s[0]: s[1:] for s in snapshots}

    def apply(self, events: list[tuple[int, int, float, int]]) -> list[tuple[int, int, float, int, int, float, int]]:
        """Add (minute, rows, sum, rated) deltas of one arrival; outputs (period, n, sum, rated, running n, running sum, running rated) that it changed.

        The snapshot before the earliest touched period is restored, the sorted suffix of
        the log from there replayed, and the outputs of every replayed period replaced.
        """
        for minute, n, total, rated in events:
            if minute not in self.log:
                self.minutes.insert(bisect_left(self.minutes, minute), minute)
                self.log[minute] = (0, 0.0, 0)
            a, b, c = self.log[minute]
            self.log[minute] = (a + n, b + total, c + rated)
        start = min(e[0] for e in events) // self.period
        before = [p for p in self.snapshots if p <= start]
        running = self.snapshots[max(before)] if before else (0, 0.0, 0)
        resume = max(before) if before else start
        for p in [p for p in self.snapshots if p > start]:
            del self.snapshots[p]
        out, i = [], bisect_left(self.minutes, resume * self.period)
        while i < len(self.minutes):
            p = self.minutes[i] // self.period
            self.snapshots[p] = running
            own = (0, 0.0, 0)
            while i < len(self.minutes) and self.minutes[i] // self.period == p:
                own = tuple(x + y for x, y in zip(own, self.log[self.minutes[i]]))
                i += 1
            running = tuple(x + y for x, y in zip(running, own))
            if p >= start:
                out.append((p, *own, *running))
        return out


NAMES = ["key", "day", "minute", "version", "n", "total", "rated", "running_n", "running_total", "running_rated"]
KINDS = [pa.string(), pa.date32(), pa.int32(), pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64(), pa.float64(), pa.int64()]
SCHEMA = "key string, day date, minute int, version long, n long, total double, rated long, running_n long, running_total double, running_rated long"


#: What a row of ``_replay`` is: a snapshot or a minute of the stored state, a delta, an output, a delta left out.
SNAPSHOT, LOG, DELTA, OUTPUT, LEFT_OUT = range(5)


def _replay(lateness: int, keep: bool = False):
    """Deltas in order of arrival to outputs, and to the deltas that were left out (``running_n`` null).

    Arrivals come in steps of whole hours, rounded up, and ``lateness`` is in hours; an hour's
    state is closed once an arrival is beyond the limit. Rows of a stored state come first and are restored; with ``keep`` the new state
    comes out beside the outputs.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (key, day), g in sorted_groups(batches, ["key", "day"]):
            state, rows, i = OrderedState(), [], 0
            kinds = g.get("kind", [DELTA])
            while i < len(kinds) and kinds[i] != DELTA:
                i += 1
            if i:
                stored = list(zip(g["minute"][:i], g["n"][:i], g["total"][:i], g["rated"][:i]))
                cut = kinds[:i].count(SNAPSHOT)
                state.restore(stored[cut:], [(m // 60, *rest) for m, *rest in stored[:cut]])
            while i < len(g["piece"]):
                j, piece = i, g["piece"][i]
                while j < len(g["piece"]) and g["piece"][j] == piece:
                    j += 1
                deltas = list(zip(g["minute"][i:j], g["n"][i:j], g["total"][i:j], g["rated"][i:j]))
                # hours from the start of the day to the arrival
                since = (piece - g["start"][i]) // 3600
                open_ = [d for d in deltas if since <= d[0] // 60 + 1 + lateness]
                rows += [(key, day, d[0], piece, d[1], d[2], d[3], None, None, None) for d in deltas if since > d[0] // 60 + 1 + lateness]
                if open_:
                    rows += [(key, day, out[0] * 60, piece, *out[1:]) for out in state.apply(open_)]
                i = j
            if keep:
                rows = [(*r, LEFT_OUT if r[7] is None else OUTPUT) for r in rows]
                rows += [(key, day, p * 60, None, *s, None, None, None, SNAPSHOT) for p, s in state.snapshots.items()]
                rows += [(key, day, m, None, *state.log[m], None, None, None, LOG) for m in state.minutes]
            names, types = ([*NAMES, "kind"], [*KINDS, pa.int32()]) if keep else (NAMES, KINDS)
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, type=k) for c, k in zip(zip(*rows), types)], names=names)

    return work


def complete(df: DataFrame, key: str | None, id: str, event: str, arrival: str, value: str) -> DataFrame:
    """(id, arrival, event, value, key): rows that can be placed."""
    key_column = F.lit("all") if key is None else F.col(key).cast("string")
    rows = df.select(F.col(id).alias("id"), F.col(arrival).cast("timestamp").alias("arrival"), F.col(event).cast("timestamp").alias("event"), F.col(value).cast("double").alias("value"), key_column.alias("key"))
    return rows.where("event is not null and arrival is not null and key is not null")


def firsts(rows: DataFrame) -> DataFrame:
    """The first row to arrive of each identifier, and all rows without one."""
    whole = F.min(F.struct("arrival", "event", "value", "key")).alias("r")
    first = rows.where("id is not null").groupBy("id").agg(whole).select("id", "r.*")
    return first.unionByName(rows.where("id is null"))


def placed(rows: DataFrame) -> DataFrame:
    """With the event's day and minute and the hour of arrival, rounded up, in seconds."""
    piece = F.ceil(F.unix_micros("arrival") / 3_600_000_000).cast("long") * 3600
    return rows.withColumns({"day": F.to_date("event"), "minute": F.hour("event") * 60 + F.minute("event"), "piece": piece})


def deltas(rows: DataFrame) -> DataFrame:
    """Placed rows summed per key, event minute and hour of arrival."""
    sums = [F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("value"), F.lit(0.0)).alias("total"), F.count("value").alias("rated")]
    return rows.groupBy("key", "day", "piece", "minute").agg(*sums).withColumn("start", F.unix_seconds(F.col("day").cast("timestamp")))


def left_out(rows: DataFrame, out: DataFrame) -> DataFrame:
    """(id, key, event_time, ingest_time, hours_late): the placed rows of the deltas ``out``, a written table."""
    on = ["key", "day", "minute", "piece"]
    late = (F.unix_micros("arrival") - F.unix_micros(F.date_trunc("hour", "event"))) / 3.6e9 - 1
    rows = semi(rows, out, on).join(out, on, "left_semi")
    return rows.select("id", "key", F.col("event").alias("event_time"), F.col("arrival").alias("ingest_time"), late.alias("hours_late"))


def outputs(replayed: DataFrame) -> DataFrame:
    """Outputs of the replay with hours and averages."""
    hour = F.timestamp_seconds(F.unix_seconds(F.col("day").cast("timestamp")) + F.col("minute") * 60).alias("hour")
    average = lambda s, c: F.try_divide(F.col(s), F.col(c))
    return replayed.select("key", hour, F.timestamp_seconds("version").alias("version"), F.col("n").alias("n_reviews"), average("total", "rated").alias("avg_stars"), F.col("running_n").alias("day_reviews"), average("running_total", "running_rated").alias("day_avg_stars"))


class EventTimeReplay:
    """Counts and averages per hour of ``event``, corrected by later ``arrival``, with a cut-off.

    A row counts if it arrives at most ``lateness_hours`` after the end of the hour of its
    event time; other rows are left out and come out of ``rejected``. Rows that repeat an
    identifier count once, as the first to arrive (of equal times, the least event time); rows with
    a null identifier count each by itself. Rows with a null event or arrival time, or a null key, can't be
    placed and are in neither. ``value`` may be null: such rows count but not in averages.

    Rows are summed per key, event minute and arrival hour before the shuffle, so what a
    key brings to a task is bounded by the minutes of a day times the hours within the
    limit, however many rows it has; each key and day is a state of its own (OrderedState).
    """

    def __init__(self, df: DataFrame, key: str | None = None, id: str = "review_id", event: str = "event_time", arrival: str = "ingest_time", value: str = "stars", lateness_hours: int = 24):
        ship(df.sparkSession)
        self.rows, self.lateness = placed(firsts(complete(df, key, id, event, arrival, value))), lateness_hours

    def _replayed(self) -> DataFrame:
        ordered = deltas(self.rows).repartition(tasks(self.rows.sparkSession), "key", "day").sortWithinPartitions("key", "day", "piece", "minute")
        return ordered.mapInArrow(_replay(self.lateness), SCHEMA)

    def rejected(self) -> DataFrame:
        """(id, key, event_time, ingest_time, hours_late): the rows of the deltas that the replay left out."""
        out = written(self._replayed().where("running_n is null").select("key", "day", "minute", F.col("version").alias("piece")), "rejected")
        return left_out(self.rows, out)

    def versions(self) -> DataFrame:
        """(key, hour, version, n_reviews, avg_stars, day_reviews, day_avg_stars): each output as of the end of each arrival hour that changed it.

        ``day_`` columns run from the start of the day to the end of the hour, so a late row
        replaces the outputs of its own hour and of all later hours of the day.
        """
        return outputs(self._replayed().where("running_n is not null"))

    def current(self) -> DataFrame:
        """The last version of each output, with the number of versions it had."""
        last = F.max_by(F.struct("n_reviews", "avg_stars", "day_reviews", "day_avg_stars"), "version").alias("o")
        return self.versions().groupBy("key", "hour").agg(last, F.count(F.lit(1)).alias("versions")).select("key", "hour", "o.*", "versions")


class EventTimeStore:
    """The same corrected aggregates, with state that outlives a run: batches are applied as they come.

    Under ``path`` lie, per day of event time, the ordered state of each key (its log by minute and its snapshots), the
    identifiers met so far (IdIndex), and the rows that came too late. A batch loads the states of the days it
    touches only, restores the snapshot before its earliest row, replays the suffix and writes these days' states anew; the manifest then
    names the new tables, all at once. Opened again on its ``path`` it goes on where the last committed batch ended. The newest
    batch may be processed again under its ``batch_id`` and gives the same. Fit for ``foreachBatch``. Batches must come in order of arrival.

    Rows without event or arrival time or key take no part; see EventTimeReplay for the rest.
    """

    def __init__(self, spark: SparkSession, path: str | None = None, key: str | None = None, id: str = "review_id", event: str = "event_time", arrival: str = "ingest_time", value: str = "stars", lateness_hours: int = 24):
        ship(spark)
        self.spark, self.path, self.lateness = spark, path or new_path(spark, "replay"), lateness_hours
        self.columns = (key, id, event, arrival, value)
        self.manifest, self.index = Manifest(spark, self.path), IdIndex(spark, f"{self.path}/ids")
        self.state = self.manifest.read() or {"batch": None, "days": {}, "before": {}, "steps": []}

    def process(self, batch: DataFrame, batch_id: int | str) -> DataFrame:
        """(key, hour, version, ...): the outputs that the batch replaced, as ``EventTimeReplay.versions`` has them."""
        again = self.state["batch"] == str(batch_id)
        days = self.state["before"] if again else self.state["days"]
        steps = self.state["steps"][:-1] if again else self.state["steps"]
        first = written(placed(firsts(complete(batch, *self.columns))), "first")
        novel = self.index.process(first, batch_id, "id").where("not known").select("id")
        rows = written(first.join(novel, "id", "left_semi").unionByName(first.where("id is null")), "novel")
        summed = written(deltas(rows), "deltas")
        touched = [r[0].isoformat() for r in summed.select("day").distinct().collect()]  # days of the calendar
        fresh = summed.select("key", "day", F.lit(DELTA).alias("kind"), "piece", "start", "minute", "n", "total", "rated")
        stored = self._state({d: days[d] for d in touched if d in days})
        if stored is not None:
            nothing = F.lit(None).cast("long")
            fresh = stored.select("key", "day", "kind", nothing.alias("piece"), nothing.alias("start"), "minute", "n", "total", "rated").union(fresh)
        ordered = fresh.repartition(tasks(self.spark), "key", "day").sortWithinPartitions("key", "day", "kind", "piece", "minute")
        step = self.manifest.new_table("step")
        ordered.mapInArrow(_replay(self.lateness, True), SCHEMA + ", kind int").write.partitionBy("kind", "day").parquet(self.manifest.at(step))
        late = self._step(step).where(F.col("kind") == LEFT_OUT).select("key", "day", "minute", F.col("version").alias("piece"))
        left_out(rows, late).write.parquet(self.manifest.at(f"late-{step}"))
        old = {*self.state["days"].values(), *self.state["before"].values()}
        gone = self.state["steps"][-1:] if again else []
        self.state = {"batch": str(batch_id), "days": days | {d: step for d in touched}, "before": days, "steps": [*steps, step]}
        self.manifest.commit(self.state)
        unused = old - {*self.state["days"].values(), *days.values()}
        self.manifest.drop([*sorted(unused), *(f"late-{s}" for s in gone)])
        return outputs(self._step(step).where(F.col("kind") == OUTPUT))

    def _step(self, *steps: str) -> DataFrame:
        return self.spark.read.schema(SCHEMA + ", kind int").option("basePath", self.manifest.at(steps[0])).parquet(self.manifest.at(steps[0]))

    def _state(self, days: dict[str, str]) -> DataFrame | None:
        """Snapshots and logs of some days."""
        out = None
        for step in sorted(set(days.values())):
            own = [d for d, s in days.items() if s == step]
            part = self._step(step).where(F.col("kind").isin(SNAPSHOT, LOG) & F.col("day").isin(own))
            out = part if out is None else out.union(part)
        return out

    def current(self) -> DataFrame:
        """(key, hour, n_reviews, avg_stars, day_reviews, day_avg_stars): all outputs as they now are, from the stored logs."""
        stored = self._state(self.state["days"])
        if stored is None:
            stored = self.spark.createDataFrame([], SCHEMA + ", kind int")
        hourly = stored.where(F.col("kind") == LOG).groupBy("key", "day", (F.floor(F.col("minute") / 60) * 60).cast("int").alias("minute")).agg(*[F.sum(c).alias(c) for c in ("n", "total", "rated")])
        # at most 24 rows of a key and day
        so_far = Window.partitionBy("key", "day").orderBy("minute").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        running = hourly.withColumns({f"running_{c}": F.sum(c).over(so_far) for c in ("n", "total", "rated")}).withColumn("version", F.lit(0))
        return outputs(running).drop("version")

    def rejected(self) -> DataFrame:
        """(id, key, event_time, ingest_time, hours_late): all rows that came too late."""
        kinds = "id string, key string, event_time timestamp, ingest_time timestamp, hours_late double"
        paths = [self.manifest.at(f"late-{s}") for s in self.state["steps"]]
        return self.spark.read.schema(kinds).parquet(*paths) if paths else self.spark.createDataFrame([], kinds)


def replayed_in_batches(df: DataFrame, batches: int = 4, arrival: str = "ingest_time", **columns) -> EventTimeStore:
    """A store that a whole table has been run through, in batches of equal time of arrival."""
    store = EventTimeStore(df.sparkSession, arrival=arrival, **columns)
    used = [c for c in (store.columns[0], *store.columns[1:]) if c]
    for k, part in enumerate(arrival_slices(df.select(*dict.fromkeys(used)), arrival, batches)):
        store.process(part, k)
    return store
