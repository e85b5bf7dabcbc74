"""Tables that are kept on storage and changed by key."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from marquesina.operators.lifecycle import upsert
from marquesina.session import drop_materialized, materialize

BUCKET = "_bucket"


@dataclass(frozen=True)
class KeyedTable:
    """A table in one folder per bucket of its key, so that a change rewrites only the buckets it falls into.

    ``buckets`` is fixed when the table is made and should follow its size; a bucket is what one task reads and
    writes. Keys are unique. A change is worked out and written beside the table first; then the buckets it
    touches are replaced. A change that broke off can be applied again: it leads to the same rows.
    """

    spark: SparkSession
    folder: str
    schema: str
    keys: tuple[str, ...]
    buckets: int = 64

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int").alias(BUCKET)

    def _stored(self) -> DataFrame:
        # A folder that is not there yet is an empty table.
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.folder)
        if not path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path):
            return self.spark.createDataFrame([], f"{self.schema}, {BUCKET} int")
        return self.spark.read.schema(f"{self.schema}, {BUCKET} int").parquet(self.folder)

    def read(self) -> DataFrame:
        return self._stored().drop(BUCKET)

    def upsert(self, rows: DataFrame, replace: list[str] | None = None) -> list[int]:
        """Insert ``rows`` by key and overwrite ``replace`` columns of held keys; returns the buckets that were rewritten.

        ``rows`` are unique by key and have the table's columns; keys are not null. No rows, no change.
        """
        stored = self._stored()
        names = [c for c in stored.columns if c != BUCKET]
        changes = materialize(rows.select(*names, self._bucket()), "changes")
        # At most as many numbers as there are buckets.
        touched = sorted(r[0] for r in changes.select(BUCKET).distinct().collect())
        if touched:
            held = stored.filter(F.col(BUCKET).isin(touched))
            after = materialize(upsert(held, changes, [BUCKET, *self.keys], replace).select(*names, BUCKET), "upserted")
            after.repartition(BUCKET).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(BUCKET).parquet(self.folder)
            drop_materialized(after)
        drop_materialized(changes)
        return touched
