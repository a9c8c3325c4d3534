"""Messages delivered more than once: a persisted index of sorted identifier arrays."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tributary.session import new_path, ship, written
from tributary.stored import Manifest

#: Identifiers in one stored array at most.
RUN_ROWS = 16_384
#: Identifiers of one prefix that the index aims at; a task holds those of one prefix at a time.
PREFIX_ROWS = 1 << 20
#: Identifiers that are worth a task.
TASK_ROWS = 20_000

RUNS = "prefix int, n long, hashes binary, ids array<string>"
TOLD = pa.schema([("id", pa.string()), ("h", pa.int64()), ("copies", pa.int64()), ("known", pa.bool_())])


class _Prefix:
    """The arrays of one prefix, as one sorted array of hashes and the identifiers beside it."""

    def __init__(self):
        self.hashes, self.ids, self.order = [], [], None

    def hold(self, hashes: bytes, ids: pa.Array) -> None:
        self.hashes.append(np.frombuffer(hashes, dtype=np.int64))
        self.ids.append(ids)

    def search(self, hashes: np.ndarray, ids: pa.Array) -> np.ndarray:
        """Which identifiers are stored: binary search of the hashes; equal hashes are settled by the identifier."""
        known = np.zeros(len(hashes), dtype=bool)
        if not self.hashes:
            return known
        if self.order is None:
            every = np.concatenate(self.hashes)
            self.order = np.argsort(every, kind="stable")
            self.hashes, self.ids = [every[self.order]], [pa.concat_arrays(self.ids)]
        stored, names = self.hashes[0], self.ids[0]
        at = np.searchsorted(stored, hashes)
        left = np.flatnonzero((at < len(stored)) & (stored[np.minimum(at, len(stored) - 1)] == hashes))
        while len(left):
            same = pc.equal(names.take(pa.array(self.order[at[left]])), ids.take(pa.array(left))).to_numpy(zero_copy_only=False)
            known[left[same]] = True
            left = left[~same]
            at[left] += 1
            left = left[at[left] < len(stored)]
            left = left[stored[at[left]] == hashes[left]]
        return known


def _search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by prefix, the arrays of a prefix before its probes."""
    held, prefix = _Prefix(), None
    for batch in batches:
        prefixes = batch.column("prefix").to_numpy()
        kinds = batch.column("kind").to_numpy()
        cuts = [0, *(np.flatnonzero(np.diff(prefixes) | np.diff(kinds)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:]):
            if a == b:
                continue
            if prefixes[a] != prefix:
                held, prefix = _Prefix(), prefixes[a]
            part = batch.slice(a, b - a)
            if kinds[a] == 0:
                arrays = part.column("ids")
                for i, blob in enumerate(part.column("hashes").to_pylist()):
                    held.hold(blob, arrays[i].values)
            else:
                ids, hashes = part.column("id"), part.column("h")
                known = held.search(hashes.to_numpy(), ids)
                yield pa.RecordBatch.from_arrays([ids, hashes, part.column("copies"), pa.array(known)], schema=TOLD)


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (prefix, h, id) sorted by prefix and h to arrays of at most RUN_ROWS."""
    schema = pa.schema([("prefix", pa.int32()), ("n", pa.int64()), ("hashes", pa.binary()), ("ids", pa.list_(pa.string()))])
    held: list[pa.RecordBatch] = []

    def cut(parts: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = pa.Table.from_batches(parts).combine_chunks()
        for s in range(0, own.num_rows, RUN_ROWS):
            part = own.slice(s, RUN_ROWS)
            ids = pa.concat_arrays(part.column("id").chunks)
            yield pa.RecordBatch.from_arrays([pa.array([part.column("prefix")[0].as_py()], pa.int32()), pa.array([part.num_rows], pa.int64()), pa.array([part.column("h").to_numpy().tobytes()], pa.binary()), pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids)], schema=schema)

    for batch in batches:
        prefixes = batch.column("prefix").to_numpy()
        cuts = [0, *(np.flatnonzero(np.diff(prefixes)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:]):
            if a == b:
                continue
            if held and (held[0].column("prefix")[0].as_py() != prefixes[a] or sum(x.num_rows for x in held) >= RUN_ROWS):
                yield from cut(held)
                held = []
            held.append(batch.slice(a, b - a))
    if held:
        yield from cut(held)


class IdIndex:
    """An index of all identifiers met so far, kept as immutable runs under ``path``.

    A run is a table (prefix, n, hashes, ids): for each prefix of the 64-bit hash the sorted hashes,
    RUN_ROWS to an array, and beside them the identifiers themselves, so answers are exact. A batch is
    deduplicated within itself first, with map-side combining, so one identifier in a third of all rows
    reaches the index as one row. Rows of a prefix meet in one task: its arrays come first and are held, the batch's
    identifiers stream past them. The number of prefixes follows the number of identifiers (``prefix_rows``
    to a prefix); when it has to grow, all runs are merged into the finer prefixes, once per doubling. Runs are
    merged when the one before is less than twice as long, so an identifier is rewritten a logarithmic number of times.

    Which runs count stands in a manifest that is replaced atomically, so an index opened again on its ``path`` knows all
    that was committed. The newest batch may be processed again under its ``batch_id``: its own run is neither searched
    nor merged yet, and is replaced. Batches before it may not. Null identifiers can't be told apart: they aren't indexed and count as no
    copies. Empty batches add an empty run. One writer at a time. ``path`` must be a folder that all executors share.
    """

    def __init__(self, spark: SparkSession, path: str | None = None, prefix_rows: int = PREFIX_ROWS, least_bits: int = 5):
        ship(spark)
        self.spark, self.path, self.prefix_rows = spark, path or new_path(spark, "ids"), prefix_rows
        self.manifest = Manifest(spark, self.path)
        self.state = self.manifest.read() or {"bits": least_bits, "runs": [], "newest": None}
        self.made: list[str] = []

    @property
    def runs(self) -> list[str]:
        """Names of the runs that count."""
        return [r["name"] for r in self._all()]

    def _all(self) -> list[dict]:
        newest = self.state["newest"]
        return [*self.state["runs"], *([newest["run"]] if newest else [])]

    def _prefix(self, bits: int) -> Column:
        return F.shiftrightunsigned("h", 64 - bits).cast("int")

    def process(self, batch: DataFrame, batch_id: int | str, id: str = "review_id") -> DataFrame:
        """(id, copies, known): each identifier of the batch, its rows here, and whether an earlier batch had it."""
        newest = self.state["newest"]
        again = newest is not None and newest["batch"] == str(batch_id)
        before = list(self.state["runs"]) if again else self._all()
        live = {r["name"] for r in self._all()}
        self.made = []
        local = batch.select(F.col(id).cast("string").alias("id")).where("id is not null").groupBy("id").agg(F.count(F.lit(1)).alias("copies"))
        local = written(local.select("id", F.xxhash64("id").alias("h"), "copies"), "arrived")
        n = local.count()
        total = n + sum(r["n"] for r in before)
        bits = max(self.state["bits"], math.ceil(math.log2(max(1, total / self.prefix_rows))))
        if bits > self.state["bits"] and before:
            before = [self._merged(before, bits)]
        while len(before) > 1 and before[-2]["n"] < 2 * before[-1]["n"]:
            before[-2:] = [self._merged(before[-2:], bits)]
        result = self._probed(local, before, bits, total)
        target = self._store(result.where("not known").select("h", "id"), bits, n)
        self.state = {"bits": bits, "runs": before, "newest": {"batch": str(batch_id), "run": target}}
        self.manifest.commit(self.state)
        self.manifest.drop(sorted({*live, *self.made} - set(self.runs)))
        return result.select("id", "copies", "known")

    def _probed(self, local: DataFrame, before: list[dict], bits: int, rows: int) -> DataFrame:
        if not before:
            return local.withColumn("known", F.lit(False))
        stored = self._read(before).select("prefix", F.lit(0).alias("kind"), "hashes", "ids", F.lit(None).cast("string").alias("id"), F.lit(None).cast("long").alias("h"), F.lit(None).cast("long").alias("copies"))
        probes = local.select(self._prefix(bits).alias("prefix"), F.lit(1).alias("kind"), F.lit(None).cast("binary").alias("hashes"), F.lit(None).cast("array<string>").alias("ids"), "id", "h", "copies")
        ordered = stored.union(probes).repartition(self._parts(bits, rows), "prefix").sortWithinPartitions("prefix", "kind")
        return written(ordered.mapInArrow(_search, "id string, h long, copies long, known boolean"), "probed")

    def _parts(self, bits: int, rows: int) -> int:
        """Tasks for so many identifiers; a task has several prefixes, or at large sizes one."""
        return max(1, min(2**bits, rows // TASK_ROWS))

    def _read(self, runs: list[dict]) -> DataFrame:
        return self.spark.read.schema(RUNS).parquet(*[self.manifest.at(r["name"]) for r in runs])

    def _store(self, rows: DataFrame, bits: int, about: int) -> dict:
        """A new run of (h, id)."""
        name = self.manifest.new_table("run")
        self.made.append(name)
        ordered = rows.select(self._prefix(bits).alias("prefix"), "h", "id").repartition(self._parts(bits, about), "prefix").sortWithinPartitions("prefix", "h")
        ordered.mapInArrow(_runs, RUNS).write.parquet(self.manifest.at(name))
        n = self._read([{"name": name}]).agg(F.sum("n")).first()[0] or 0
        return {"name": name, "n": n}

    def _merged(self, parts: list[dict], bits: int) -> dict:
        """One run of several; they stay until the manifest no longer names them."""
        return self._store(self._read(parts).select(F.explode("ids").alias("id")).select("id", F.xxhash64("id").alias("h")), bits, sum(r["n"] for r in parts))


def slice_number(df: DataFrame, time: str, count: int) -> Column:
    """The number of a row's range, of ``count`` equal ranges of ``time``; rows with a null time are in the first."""
    t = F.unix_micros(F.col(time).cast("timestamp"))
    low, high = df.agg(F.min(t), F.max(t)).first()
    if low is None or high == low:
        return F.lit(0)
    step = -(-(high - low + 1) // count)
    return F.coalesce(F.floor((t - F.lit(low)) / F.lit(step)), F.lit(0)).cast("int")


def arrival_slices(df: DataFrame, time: str, count: int) -> list[DataFrame]:
    """``df`` in ``count`` consecutive ranges of ``time``, written once, a folder each."""
    cut = written(df.withColumn("_slice", slice_number(df, time, count)), "slices", ["_slice"])
    return [cut.where(F.col("_slice") == i).drop("_slice") for i in range(count)]


def deliveries(df: DataFrame, id: str = "review_id", time: str = "ingest_time", batches: int = 4, prefix_rows: int = PREFIX_ROWS) -> DataFrame:
    """(batch, id, copies, known) of a whole table, run through an index in order of arrival."""
    index, out = IdIndex(df.sparkSession, prefix_rows=prefix_rows), None
    for k, part in enumerate(arrival_slices(df.select(id, time), time, batches)):
        told = index.process(part, k, id).withColumn("batch", F.lit(k))
        out = told if out is None else out.union(told)
    return out


def keep_one(df: DataFrame, id: str = "review_id", time: str = "ingest_time", batches: int = 4) -> DataFrame:
    """Exactly one row of each identifier: the first to arrive, of equal times the least of the other columns.

    Rows with a null identifier all stay. The index tells in which batch an identifier was new; whole rows are
    read once, and the rank limit of 1 within identifier and batch is applied before they are shuffled.
    """
    novel = deliveries(df, id, time, batches).where("not known").select(F.col("id").alias("_novel"), F.col("batch").alias("_slice"))
    order = [F.col(time).asc_nulls_last(), *[F.col(c) for c in df.columns if c not in (id, time)]]
    rows = df.where(F.col(id).isNotNull()).withColumns({"_slice": slice_number(df, time, batches), "_novel": F.col(id).cast("string")})
    first = rows.withColumn("_rank", F.row_number().over(Window.partitionBy("_novel", "_slice").orderBy(*order))).where("_rank = 1").drop("_rank")
    return first.join(novel, ["_novel", "_slice"], "left_semi").select(*df.columns).unionByName(df.where(F.col(id).isNull()))
