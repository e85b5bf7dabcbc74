"""Session settings and durable intermediate results."""

from __future__ import annotations

import atexit
import contextlib
import uuid

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    # Shuffles are cut into many parts, and small ones are put together again up to this size, so that what a task holds does not grow with the input.
    "spark.sql.adaptive.coalescePartitions.initialPartitionNum": "512",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "16m",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.legacy.parquet.nanosAsLong": "false",
    # Of repeated JSON keys the last counts.
    "spark.sql.variant.allowDuplicateKeys": "true",
    # A small table is read in as many splits as there are cores, a large one in splits of at most this size.
    "spark.sql.files.maxPartitionBytes": "128m",
    "spark.sql.files.openCostInBytes": "1m",
}

# Settings that a session made elsewhere takes over as well.
CARRIED = [
    "spark.sql.variant.allowDuplicateKeys", "spark.sql.adaptive.coalescePartitions.initialPartitionNum", "spark.sql.adaptive.advisoryPartitionSizeInBytes"]


def build_session(master: str = "local[*]", partitions: int = 8, **extra: str) -> SparkSession:
    builder = SparkSession.builder.master(master).appName("marquesina")
    for key, value in {**SETTINGS, "spark.sql.shuffle.partitions": str(partitions), **extra}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder for durable intermediates: ``spark.checkpoint.dir``, or one in the warehouse where that is unset."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    return named or f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_stages"


_KNOWN: set[str] = set()


def _stage_root(spark: SparkSession) -> str:
    """Folder of this application below the shared one; it is deleted when the driver ends."""
    root = f"{shared_dir(spark).rstrip('/')}/{spark.sparkContext.applicationId}"
    if root not in _KNOWN:
        _KNOWN.add(root)

        def forget() -> None:
            with contextlib.suppress(Exception):  # the session may have ended before
                _delete(spark, root)

        atexit.register(forget)
    return root


def _delete(spark: SparkSession, path: str) -> None:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def work_dir(spark: SparkSession, label: str) -> str:
    """A new folder of this application on shared storage, deleted with its other intermediates."""
    return f"{_stage_root(spark)}/{label}-{uuid.uuid4().hex}"


@contextlib.contextmanager
def setting(spark: SparkSession, key: str, value: str):
    """The session's setting ``key`` held at ``value`` while a step runs."""
    before = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once to the shared folder and continue from the written files.

    Unlike a cache this survives the loss of executors, and it cuts the lineage of loops. What the step shuffled is
    deleted with its end; else it stays on the disks until the driver happens to collect its garbage.
    """
    spark = df.sparkSession
    path = work_dir(spark, label)
    with setting(spark, "spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true"):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_materialized(*frames: DataFrame) -> None:
    """Delete files written by :func:`materialize` once no later step reads them."""
    for df in frames:
        for parent in {name.rsplit("/", 1)[0] for name in df.inputFiles()}:
            _delete(df.sparkSession, parent)
