"""Helpers shared by the text operators: words, shingle hashes, durable steps, connected groups."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from marquesina.session import materialize

MIX = np.uint64(0x9E3779B97F4A7C15)
# Python dictionaries that speed up repeated words are emptied beyond this many entries; results do not depend on it.
MEMO = 400_000
# Rows of one Arrow batch; long texts make a batch of Spark's default 10,000 rows too heavy for a small executor.
BATCH_ROWS = 1_000


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One of the given tables."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def stage(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and go on from the files."""
    return materialize(df, label)


# Rows of one or two numbers that may be broadcast, some 30 MB on the receiving side.
SMALL_ROWS = 500_000


def small_or_joined(df: DataFrame, rows: int = SMALL_ROWS) -> DataFrame:
    """A staged table of short rows, marked for broadcast if its counted rows are few; else left to a shuffled join."""
    return F.broadcast(df) if df.count() <= rows else df


def raw_texts(batch: pa.RecordBatch, name: str = "text") -> list[bytes]:
    """UTF-8 bytes of a text column; null is the empty text."""
    return [x or b"" for x in batch.column(name).cast(pa.binary()).to_pylist()]


class WordHash(dict):
    """64-bit hash of a word, remembered while the word is in use."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > MEMO:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word, 42)
        return h

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), dtype=np.uint64, count=len(words))


def gram_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Hash of every run of ``n`` words from the hashes of the words; fewer words: one hash of them all."""
    if not len(words):
        return words
    n = min(n, len(words))
    size = len(words) - n + 1
    out = np.full(size, n, dtype=np.uint64)
    for k in range(n):
        out = (out ^ words[k : size + k]) * MIX
        out ^= out >> np.uint64(29)
    return out


def map_texts(
    docs: DataFrame, columns: list[str], make: Callable[[], Callable[[pa.RecordBatch], pa.RecordBatch | None]], schema: str
) -> DataFrame:
    """Run one batch function, built once per task, over the named columns."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for batch in batches:
            out = work(batch)
            if out is not None:
                yield out

    return docs.select(*columns).mapInArrow(run, schema)


def keep_rows(docs: DataFrame, make: Callable[[], Callable[[list[bytes]], list[bool]]]) -> DataFrame:
    """Documents whose whole text passes; all columns stay as they are."""
    small_batches(docs.sparkSession)
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        passes = make()
        for batch in batches:
            texts = [x or b"" for x in batch.column(at).cast(pa.binary()).to_pylist()]
            yield batch.filter(pa.array(passes(texts), pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def _stars(edges: DataFrame) -> bool:
    """Whether every node hangs below one node that hangs below none."""
    ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("below"), F.lit(0).alias("above")).unionByName(
        edges.select(F.col("v").alias("node"), F.lit(0).alias("below"), F.lit(1).alias("above")))
    counts = ends.groupBy("node").agg(F.sum("below").alias("below"), F.max("above").alias("above"))
    return counts.filter("below > 1 OR below = 1 AND above = 1").isEmpty()


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Connected groups of the links ``(a, b)`` as ``(node, root)``, the root being the smallest node.

    Large-star and small-star steps in turn: every step hangs the larger neighbours of a node, then the
    node itself, below the smallest node in sight, until the links are stars. A hub is only ever met in
    a minimum (combined before the shuffle) and in a join whose large side Spark may split. Each step is
    written to the shared folder, so a lost executor costs one step and no plan grows. Nodes without
    links are not returned; null ends and loops are ignored.
    """
    edges = stage(
        links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("u > v").distinct(), "links"
    )
    while not _stars(edges):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u > v")
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        hung = large.join(low, "u").filter("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = stage(hung.unionByName(low.select("u", F.col("m").alias("v"))).distinct(), "stars")
    nodes = edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return nodes.unionByName(roots)


def crc_mod(column: Column, n: int) -> Column:
    """crc32 of the value as text, modulo ``n``."""
    return F.crc32(column.cast("string").cast("binary")) % n
