"""Near-exact distinct counts from mergeable runs of sorted, delta-coded 64-bit hashes."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from operator import and_

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tributary.session import new_path, ship, tasks, written
from tributary.stored import Manifest

#: Hashes in one run at most.
RUN = 65_536
#: Runs up to this length are coded without arrays, whose overhead would exceed the work.
FEW = 12


def encode(sorted_hashes: np.ndarray) -> bytes:
    """Strictly rising unsigned 64-bit values as LEB128 of the first and then of the gaps."""
    if len(sorted_hashes) <= FEW:
        short, before = bytearray(), 0
        for value in sorted_hashes.tolist():
            gap, before = value - before, value
            while gap >= 0x80:
                short.append(gap & 0x7F | 0x80)
                gap >>= 7
            short.append(gap)
        return bytes(short)
    gaps = np.diff(sorted_hashes, prepend=np.uint64(0)).astype(np.uint64)
    length = np.ones(len(gaps), dtype=np.int64)
    for k in range(1, 10):
        length += gaps >= np.uint64(1 << (7 * k))
    ends = np.cumsum(length)
    out = np.empty(int(ends[-1]) if len(ends) else 0, dtype=np.uint8)
    starts = ends - length
    for k in range(10):
        on = np.flatnonzero(length > k)
        if not len(on):
            break
        low = (gaps[on] >> np.uint64(7 * k)).astype(np.uint8) & 0x7F
        out[starts[on] + k] = low | np.where(length[on] > k + 1, 0x80, 0).astype(np.uint8)
    return out.tobytes()


def decode(blob: bytes) -> np.ndarray:
    """The values that ``encode`` was given."""
    if len(blob) <= 10 * FEW:
        values, total, gap, place = [], 0, 0, 0
        for byte in blob:
            gap |= (byte & 0x7F) << place
            place += 7
            if byte < 0x80:
                total, gap, place = total + gap, 0, 0
                values.append(total)
        return np.array(values, dtype=np.uint64)
    data = np.frombuffer(blob, dtype=np.uint8)
    if not len(data):
        return np.empty(0, dtype=np.uint64)
    last = data < 0x80
    group = np.concatenate([[0], np.cumsum(last)[:-1]])
    starts = np.concatenate([[0], np.flatnonzero(last)[:-1] + 1])
    place = (np.arange(len(data)) - starts[group]).astype(np.uint64)
    with np.errstate(over="ignore"):
        gaps = np.zeros(int(last.sum()), dtype=np.uint64)
        np.bitwise_or.at(gaps, group, (data & 0x7F).astype(np.uint64) << (place * np.uint64(7)))
        return np.cumsum(gaps, dtype=np.uint64)


def union(runs: list[np.ndarray]) -> np.ndarray:
    """K-way union of sorted arrays; the stable sort merges the runs that are there."""
    if len(runs) == 1:
        return runs[0]
    merged = np.sort(np.concatenate(runs), kind="stable")
    return merged[np.concatenate([[True], merged[1:] != merged[:-1]])]


def _pieces(batches: Iterator[pa.RecordBatch], names: list[str], carry: list[str]) -> Iterator[tuple[tuple, list, bool]]:
    """(key, values of the columns of ``carry``) of each stretch of equal ``names`` in sorted batches, and whether it continues the one before."""
    before = None
    for batch in batches:
        if not batch.num_rows:
            continue
        codes = np.zeros(batch.num_rows - 1, dtype=bool)
        for n in names:
            ids = batch.column(n).dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
            codes |= ids[1:] != ids[:-1]
        cuts = [0, *(np.flatnonzero(codes) + 1).tolist(), batch.num_rows]
        starts = pa.array(cuts[:-1], type=pa.int64())
        keys = zip(*[batch.column(n).take(starts).to_pylist() for n in names])
        rest = [batch.column(c) for c in carry]
        rest = [c.to_numpy() if pa.types.is_int64(c.type) else c.to_pylist() for c in rest]
        for key, a, b in zip(keys, cuts, cuts[1:]):
            yield key, [c[a:b] for c in rest], key == before
            before = key


def _out(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*rows), schema)], schema=schema)


def _builder(by: list[str], schema: pa.Schema, merge: bool):
    """Sorted rows (by, shard, then h or first) to runs of at most RUN hashes.

    While merging, the runs of one key and shard that overlap are held together; as they
    come by their first hash, all hashes below the next run's first are final and go out.
    """
    names = [*by, "shard"]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        limit = 4 * RUN
        key, open_, held = None, [], 0

        def flush(values: np.ndarray) -> None:
            for s in range(0, len(values), RUN):
                part = values[s : s + RUN]
                rows.append((*key, int(part[0]) - 2**63, len(part), encode(part)))

        for k, piece, same in _pieces(batches, names, ["first", "run"] if merge else ["h"]):
            if not same and open_:
                flush(union(open_))
                open_, held, limit = [], 0, 4 * RUN
            key = k
            if merge:
                for first, blob in zip(piece[0].tolist(), piece[1]):
                    if held >= limit:
                        values, edge = union(open_), np.uint64(first + 2**63)
                        cut = int(np.searchsorted(values, edge))
                        flush(values[:cut])
                        open_ = [values[cut:]] if cut < len(values) else []
                        held = len(values) - cut
                        # what overlaps the next run stays: look again when as much has come again
                        limit = max(4 * RUN, 2 * held)
                    open_.append(decode(blob))
                    held += len(open_[-1])
            else:
                open_.append((piece[0] ^ np.int64(-(2**63))).view(np.uint64))
                held += len(open_[-1])
                if held >= 2 * RUN:
                    values = np.concatenate(open_)
                    cut = held - held % RUN
                    flush(values[:cut])
                    open_, held = [values[cut:]], held - cut
            if len(rows) >= 2000:
                yield _out(rows, schema)
                rows = []
        if open_:
            flush(union(open_) if merge else np.concatenate(open_))
        if rows:
            yield _out(rows, schema)

    return work


def _splitter(by: list[str], schema: pa.Schema):
    """Runs to their parts in the finer shards that their group wants: the hash's top ``want`` bits."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            want = batch.column("want").to_numpy()
            fine = np.flatnonzero(want > 0)
            if not len(fine):
                yield pa.RecordBatch.from_arrays([batch.column(f.name) for f in schema], schema=schema)
                continue
            coarse = pa.array(np.flatnonzero(want == 0))
            yield pa.RecordBatch.from_arrays([batch.column(f.name).take(coarse) for f in schema], schema=schema)
            part = batch.take(pa.array(fine))
            rows, blobs = [], part.column("run").to_pylist()
            for i, (bits, blob) in enumerate(zip(part.column("want").to_pylist(), blobs)):
                values = decode(blob)
                shards = (values >> np.uint64(64 - bits)).astype(np.int64)
                cuts = [0, *(np.flatnonzero(np.diff(shards)) + 1).tolist(), len(values)]
                rows += [(i, int(shards[a]), int(values[a]) - 2**63, encode(values[a:b])) for a, b in zip(cuts, cuts[1:])]
            source = pa.array([r[0] for r in rows])
            own = {"shard": pa.array([r[1] for r in rows], pa.int32()), "first": pa.array([r[2] for r in rows], pa.int64()), "run": pa.array([r[3] for r in rows], pa.binary())}
            yield pa.RecordBatch.from_arrays([own[f.name] if f.name in own else part.column(f.name).take(source) for f in schema], schema=schema)

    return work


#: Hashes of one group that one task sorts or merges; larger groups are cut into shards.
SHARD = 1 << 17


def _wanted(counted: DataFrame, by: list[str]) -> DataFrame:
    """(by, want): the bits of the shards of groups of (by, n) that hold more than SHARD hashes. Such groups are few: at most the rows over SHARD."""
    large = counted.where(F.col("n") > SHARD)
    return large.select(*by, F.ceil(F.log2(F.col("n") / F.lit(SHARD))).cast("int").alias("want"))


def _with_bits(rows: DataFrame, counted: DataFrame, by: list[str]) -> DataFrame:
    """``rows`` with ``want``, 0 where a group is small; null groups are groups."""
    wanted = _wanted(counted, by)
    if wanted.isEmpty():
        return rows.withColumn("want", F.lit(0))
    named = wanted.select(*[F.col(c).alias(f"_{c}") for c in by], "want")
    same = reduce(and_, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in by])
    return rows.join(named, same, "left").drop(*[f"_{c}" for c in by]).withColumn("want", F.coalesce("want", F.lit(0)))


class DistinctRuns:
    """Mergeable distinct counts of ``id`` per group.

    A run is a row (group columns, shard, first, n, run): at most RUN sorted 64-bit hashes
    of one shard. Groups of up to SHARD hashes are one shard, larger ones are cut by as many of the hash's top bits as
    bring them below it, so a group of any size is spread over tasks. Shards are
    disjoint, so counts add up over shards. Identifiers are made distinct with map-side combining before
    the shuffle. Runs of different days, machines or groups are merged by k-way union in
    ``regroup``; counts of merged runs are counts of the union.

    Only hash collisions make a count too low: among n identifiers n(n-1)/2^65 are
    expected (birthday bound), and the chance of any is at most that. Null identifiers
    don't count; a null group is a group; empty tables have no runs. Identifiers are
    compared byte by byte.
    """

    def __init__(self, runs: DataFrame, by: list[str]):
        self.runs, self.by = runs, by

    @staticmethod
    def _schema(df: DataFrame, by: list[str]) -> tuple[str, pa.Schema]:
        from pyspark.sql.pandas.types import to_arrow_schema

        ddl = ", ".join([*(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in by), "shard int, first long, n long, run binary"])
        kept = df.select(*by).schema
        return ddl, pa.schema([*to_arrow_schema(kept), ("shard", pa.int32()), ("first", pa.int64()), ("n", pa.int64()), ("run", pa.binary())])

    @classmethod
    def build(cls, df: DataFrame, by: dict[str, Column], id: str) -> DistinctRuns:
        """Runs of ``df`` per the columns ``by`` gives names to."""
        ship(df.sparkSession)
        names = list(by)
        sign = F.lit(-(2**63)).cast("long")
        # the sign bit is flipped so that signed order is the order of the unsigned hashes
        h = F.xxhash64(id).bitwiseXOR(sign)
        rows = written(df.where(F.col(id).isNotNull()).select(*[c.alias(n) for n, c in by.items()], h.alias("h")).distinct(), "hashes")
        rows = _with_bits(rows, rows.groupBy(*names).agg(F.count(F.lit(1)).alias("n")), names)
        # a shift by 64 would be one by 0
        shard = F.when(F.col("want") > 0, F.call_function("shiftrightunsigned", F.col("h").bitwiseXOR(sign), F.lit(64) - F.col("want"))).otherwise(F.lit(0)).cast("int").alias("shard")
        ordered = rows.select(*names, shard, "h").repartition(tasks(df.sparkSession), *names, "shard").sortWithinPartitions(*names, "shard", "h")
        ddl, schema = cls._schema(rows, names)
        return cls(ordered.mapInArrow(_builder(names, schema, False), ddl), names)

    def regroup(self, groups: DataFrame | None, by: list[str]) -> DistinctRuns:
        """Runs of the unions of groups: per fewer of the columns, or per ``by`` of ``groups``, which are joined on the columns they share.

        Runs that lie across the shards of a larger group are cut before the shuffle.
        """
        joined = self.runs if groups is None else self.runs.join(groups, [c for c in groups.columns if c in self.by])
        rows = joined.select(*by, "shard", "first", "n", "run")
        ddl, schema = self._schema(rows, by)
        rows = _with_bits(rows.drop("shard").withColumn("shard", F.lit(0)), rows.groupBy(*by).agg(F.sum("n").alias("n")), by)
        cut = pa.schema([f for f in schema if f.name != "n"])
        kinds = ", ".join(p for p in ddl.split(", ") if p != "n long")
        rows = rows.mapInArrow(_splitter(by, cut), kinds)
        ordered = rows.repartition(tasks(rows.sparkSession), *by, "shard").sortWithinPartitions(*by, "shard", "first")
        return DistinctRuns(ordered.mapInArrow(_builder(by, schema, True), ddl), by)

    def counts(self, name: str = "distinct_users") -> DataFrame:
        """(group, count, expected_collisions, relative_error): of merged or just built runs."""
        n = F.col(name).cast("double")
        collisions = n * (n - 1) / F.lit(2.0**65)
        return self.runs.groupBy(*self.by).agg(F.sum("n").alias(name)).withColumns({"expected_collisions": collisions, "relative_error": collisions / n})


class RunStore:
    """Runs kept under ``path``: each batch adds a table of runs of its own, and any grouping of all batches is merged from them.

    A table is never changed. Which ones count stands in a manifest that is replaced atomically, so a store opened again on
    its ``path`` has all committed batches. A batch that is added again under its ``batch_id`` replaces itself; as unions ignore
    repeats, it would do no harm anyway. Tables are merged to one when there is another of like size (counted in hashes), so a hash is
    rewritten a logarithmic number of times. One writer at a time.
    """

    def __init__(self, spark: SparkSession, by: dict[str, Column], id: str, path: str | None = None):
        self.spark, self.by, self.id = spark, by, id
        self.manifest = Manifest(spark, path or new_path(spark, "runs"))
        self.state = self.manifest.read() or {"schema": "", "tables": []}

    def add(self, batch: DataFrame, batch_id: int | str) -> None:
        """Code the batch's identifiers to runs and keep them."""
        made, before = self._keep(DistinctRuns.build(batch, self.by, self.id)), self.state["tables"]
        kept = [t for t in before if t["batches"] != [str(batch_id)]]
        kept.append(made | {"batches": [str(batch_id)]})
        gone = {t["name"] for t in before} - {t["name"] for t in kept}
        while len(kept) > 2 and kept[-3]["n"] < 2 * kept[-2]["n"]:
            # the newest table stays as it is, so that its batch can be replaced
            a, b = kept[-3], kept[-2]
            merged = self._keep(self._runs([a["name"], b["name"]]).regroup(None, list(self.by)))
            kept[-3:-1] = [merged | {"batches": [*a["batches"], *b["batches"]]}]
            gone |= {a["name"], b["name"]}
        self.state = self.state | {"tables": kept}
        self.manifest.commit(self.state)
        self.manifest.drop(sorted(gone))

    def _keep(self, made: DistinctRuns) -> dict:
        name = self.manifest.new_table("runs")
        self.state["schema"] = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in made.runs.schema)
        made.runs.write.option("compression", "zstd").parquet(self.manifest.at(name))
        return {"name": name, "n": self._runs([name]).runs.agg(F.sum("n")).first()[0] or 0}

    def _runs(self, names: list[str]) -> DistinctRuns:
        return DistinctRuns(self.spark.read.schema(self.state["schema"]).parquet(*map(self.manifest.at, names)), list(self.by))

    def runs(self) -> DistinctRuns:
        """All batches' runs, of different batches unmerged: ``regroup`` before counting. Add a batch first."""
        return self._runs([t["name"] for t in self.state["tables"]])
