"""Session factory, shared working folder and shipping of this package to executors."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PACKAGE = Path(__file__).resolve().parent


def build_session(app: str = "tributary", master: str | None = None, **conf: str) -> SparkSession:
    """A session with UTC, AQE, Arrow and the RocksDB state store; ``conf`` overrides.

    Underscored keywords stand for dots, e.g. ``spark_sql_shuffle_partitions="64"``.
    """
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.sql.streaming.stateStore.providerClass": STATE_STORE,
        "spark.ui.showConsoleProgress": "false",
    }
    settings |= {k.replace("_", "."): v for k, v in conf.items()}
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    spark = builder.config(map=settings).getOrCreate()
    ship(spark)
    return spark


#: The state store that processors with several state variables need.
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def keep_states(spark: SparkSession) -> None:
    """Let streams that start from now on use STATE_STORE, in sessions that weren't built here too."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)


def is_local(spark: SparkSession) -> bool:
    """Whether driver and executors are one process."""
    master = spark.sparkContext.master
    return master.startswith("local") and not master.startswith("local-cluster")


def ship(spark: SparkSession) -> None:
    """Let Python workers import this package, wherever they start: once per application.

    Executors in other processes get it as an archive; workers of a local session get its folder on their path.
    """
    sc = spark.sparkContext
    if getattr(sc, "_tributary_shipped", False):
        return
    if is_local(spark):
        given = sc.environment.get("PYTHONPATH", "")
        sc.environment["PYTHONPATH"] = os.pathsep.join([str(PACKAGE.parent), *([given] if given else [])])
        sc._tributary_shipped = True
        return
    folder = tempfile.mkdtemp(prefix="tributary-code-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    target = os.path.join(folder, "tributary.zip")
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(PACKAGE.rglob("*.py")):
            z.write(p, str(Path(PACKAGE.name) / p.relative_to(PACKAGE)))
    sc.addPyFile(target)
    sc._tributary_shipped = True


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``.

    Where the setting is absent it is only made up in local mode, where driver and
    executors see one disk; on a cluster its absence is an error.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or getattr(spark, "_tributary_shared", None)
    if folder:
        return folder.rstrip("/")
    if not is_local(spark):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    made = tempfile.mkdtemp(prefix="tributary-shared-")
    atexit.register(shutil.rmtree, made, ignore_errors=True)
    spark.sparkContext.setCheckpointDir(f"file://{made}")
    spark._tributary_shared = f"file://{made}"
    return spark._tributary_shared


def file_system(spark: SparkSession, path: str):
    """(file system, path) of Hadoop for a path."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), target


def drop_path(spark: SparkSession, path: str) -> None:
    """Remove a file or folder, if it is there."""
    fs, target = file_system(spark, path)
    fs.delete(target, True)


def _drop_at_exit(spark: SparkSession, path: str) -> None:
    """Intermediate tables live as long as the Python process, as results may still be computed from them; then they go, also if the session was stopped before."""
    paths = getattr(spark, "_tributary_written", None)
    if paths is None:
        paths = spark._tributary_written = []
        jvm, settings = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()

        def clean() -> None:
            for p in paths:
                try:
                    target = jvm.org.apache.hadoop.fs.Path(p)
                    target.getFileSystem(settings).delete(target, True)
                except Exception:  # the process is ending: what can't be removed stays
                    return

        atexit.register(clean)
    paths.append(path)


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh path for a table in the shared folder; what is there goes when the process ends."""
    path = f"{shared_dir(spark)}/tributary-{name}-{uuid.uuid4().hex}"
    _drop_at_exit(spark, path)
    return path


def written(df: DataFrame, name: str, partition_by: list[str] | None = None) -> DataFrame:
    """``df`` as a table in the shared folder: computed once, lineage cut, survives lost executors; removed when the application ends."""
    spark = df.sparkSession
    path = new_path(spark, name)
    writer = df.write.option("compression", "zstd")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Remove a table that ``written`` made and that nothing will read again."""
    for file in {f.rpartition("/")[0] for f in df.inputFiles()}:
        drop_path(df.sparkSession, file)


def spread(df: DataFrame, *keys) -> DataFrame:
    """``df`` over at least as many partitions as the cluster has cores.

    A table of one small file is one task; heavy work per row must not run in it. Inputs
    that already have enough partitions are returned unchanged, without a shuffle.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores, *keys)


def tasks(spark: SparkSession) -> int:
    """Partitions for a shuffle before Python work, which adaptive coalescing by bytes would put into too few tasks."""
    return max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A Parquet table of a folder of tables."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


#: Rows of keys that are broadcast at most: 16 bytes each and the hash table's overhead, under 100 MB.
BROADCAST_ROWS = 1_000_000


def semi(df: DataFrame, keys: DataFrame, on: list[str]) -> DataFrame:
    """Rows of ``df`` whose ``on`` may be in ``keys``, a table that is already written.

    Up to BROADCAST_ROWS keys are broadcast as 64-bit hashes, so ``df`` isn't shuffled (a
    few rows may pass by collision: a join on the keys must follow); more keys are joined
    by shuffle.
    """
    if keys.limit(BROADCAST_ROWS + 1).count() > BROADCAST_ROWS:
        return df.join(keys.select(*on).distinct(), on, "left_semi")
    hashed = keys.select(F.xxhash64(*on).alias("_key")).distinct()
    return df.join(F.broadcast(hashed), F.xxhash64(*[df[c] for c in on]) == hashed["_key"], "left_semi")
