"""Log statistics and incremental extraction over streams."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession, functions as F

from marquesina.operators.content import extracted_rows
from marquesina.sources.store import KeyedTable

LOG_SCHEMA = "event string, run string, seq long, at timestamp, source_name string, hostname string, event_count int, events_extracted int, content_bytes long, tier int, error string"


def read_log_stream(spark: SparkSession, folder: str) -> DataFrame:
    """JSON lines as they arrive in a folder."""
    return spark.readStream.schema(LOG_SCHEMA).json(folder)


def hourly_log_kpis(log: DataFrame, lateness: str = "1 hour") -> DataFrame:
    """Hourly counts per kind of log line and tier; works on streams and tables alike."""
    timed = log.withWatermark("at", lateness) if log.isStreaming else log
    return timed.groupBy(F.window("at", "1 hour").alias("w"), "event", "tier").agg(
        F.count("*").alias("lines"), F.sum(F.coalesce("event_count", F.lit(0))).alias("events")
    ).select(F.col("w.start").alias("hour"), "event", "tier", "lines", "events")


def running_progress(log: DataFrame) -> DataFrame:
    """Completed sources and extracted events per run so far, for update mode."""
    return log.groupBy("run").agg(
        F.count_if(F.col("event") == "source_complete").alias("sources_done"),
        F.sum(F.when(F.col("event") == "source_extracted", F.coalesce("events_extracted", F.lit(0))).otherwise(0)).alias("events_found"))


def per_batch(stream: DataFrame, work: Callable[[DataFrame, int], None], checkpoint: str):
    """Run a batch job on every new slice of the stream.

    ``work`` must be repeatable for one batch number, since a slice is handed over again after a failure.
    """
    return stream.writeStream.foreachBatch(work).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def append_once(df: DataFrame, folder: str, batch: int) -> None:
    """Write a batch into its own folder, so that a repeated batch replaces itself."""
    df.write.mode("overwrite").parquet(f"{folder.rstrip('/')}/batch={batch}")


ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def keyed_state(spark: SparkSession) -> Iterator[None]:
    """The state store that streams with state of their own need, for streams started inside."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, ROCKS)
    try:
        yield
    finally:
        spark.conf.set(name, before)


def drain(stream: DataFrame, folder: str, checkpoint: str) -> None:
    """Append what a stream yields from all that has arrived, then stop."""
    query = stream.writeStream.format("parquet").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(folder)
    query.awaitTermination()


def feed_extractions(contents: DataFrame, held: KeyedTable, checkpoint: str):
    """New extracted contents of a stream as event rows in ``held``, keyed by result and position.

    ``contents``: crawl_result_id, extracted_content. A slice handed over again, and a result that arrives a
    second time, change nothing: results that have rows are left out, and rows are put in by key.
    """
    def work(batch: DataFrame, number: int) -> None:
        first = batch.groupBy("crawl_result_id").agg(F.min("extracted_content").alias("extracted_content"))
        held.upsert(extracted_rows(first, held.read().select("crawl_result_id")))

    return per_batch(contents, work, checkpoint)
