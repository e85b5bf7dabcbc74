"""Keyed table changes on files that cannot be updated in place."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from marquesina.session import materialize


def upsert(table: DataFrame, rows: DataFrame, keys: list[str], replace: list[str] | None = None) -> DataFrame:
    """Insert rows by key; on a held key overwrite ``replace`` columns, or nothing when empty (M1).

    Both sides are unique on the key, so this is one join on the key and no window.
    """
    rest = [c for c in table.columns if c not in keys]
    over = set(replace or [])
    new = rows.select(*keys, *[F.col(c).alias(f"_n_{c}") for c in rest], F.lit(True).alias("_new"))
    held = table.withColumn("_held", F.lit(True))
    joined = held.join(new, keys, "full")
    def pick(c: str) -> Column:
        fresh, old = F.col(f"_n_{c}"), F.col(c)
        if c in over:
            return F.when(F.col("_new"), fresh).otherwise(old).alias(c)
        return F.when(F.col("_held"), old).otherwise(fresh).alias(c)
    return joined.select(*keys, *[pick(c) for c in rest])


def numbered(rows: DataFrame, order: list[str | Column], start: int, name: str = "id") -> DataFrame:
    """Dense ids after ``start`` in the given order, without putting all rows into one task.

    Rows are partitioned by ranges of the order and numbered within their partition; one row per partition
    meets in the window that adds up the sizes. The numbered rows are written once, so that both reads of
    them agree even when a task is run again.
    """
    ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id())
    placed = materialize(ranged, "numbered").withColumn("_part", F.shiftright("_at", 33))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = placed.groupBy("_part").count().select("_part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_before"))
    within = F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)) + 1
    return placed.join(sizes, "_part").withColumn(name, F.lit(start) + F.col("_before") + within).drop("_part", "_at", "_before")


def replace_children(table: DataFrame, parents: DataFrame, rows: DataFrame, parent: str) -> DataFrame:
    """Drop the children of the named parents and put the given rows in their place."""
    return table.join(parents.select(parent).distinct(), parent, "left_anti").unionByName(rows)


def soft_delete(table: DataFrame, ids: DataFrame, at: Column, key: str = "id") -> DataFrame:
    """Set the deletion time of named rows that are still live."""
    named = ids.select(key).distinct().withColumn("_hit", F.lit(True))
    joined = table.join(named, key, "left")
    return joined.withColumn(
        "deleted_at", F.when(F.col("_hit") & F.col("deleted_at").isNull(), at).otherwise(F.col("deleted_at"))).drop("_hit").select(table.columns)


def restore(table: DataFrame, ids: DataFrame, key: str = "id") -> DataFrame:
    named = ids.select(key).distinct().withColumn("_hit", F.lit(True))
    return table.join(named, key, "left").withColumn(
        "deleted_at", F.when(F.col("_hit").isNull(), F.col("deleted_at"))).drop("_hit").select(table.columns)


def toggle(table: DataFrame, ids: DataFrame, column: str, key: str = "id") -> DataFrame:
    """Flip a flag, or active and archived, of named rows."""
    named = ids.select(key).distinct().withColumn("_hit", F.lit(True))
    old = F.col(column)
    flipped = ~old if dict(table.dtypes)[column] == "boolean" else F.when(old == "archived", "active").otherwise("archived")
    return table.join(named, key, "left").withColumn(column, F.when(F.col("_hit"), flipped).otherwise(old)).drop("_hit").select(table.columns)


def get_or_create(dimension: DataFrame, names: DataFrame, start: int) -> DataFrame:
    """The dimension with rows added for names it lacks (M8)."""
    missing = names.select("name").distinct().join(dimension, "name", "left_anti")
    return dimension.select("id", "name").unionByName(numbered(missing, ["name"], start).select("id", "name"))


def remap(rows: DataFrame, mapping: DataFrame, column: str) -> DataFrame:
    """Repoint a foreign key by (duplicate, canonical) pairs."""
    m = mapping.select(F.col("duplicate").alias(column), "canonical")
    return rows.join(m, column, "left").withColumn(column, F.coalesce("canonical", column)).drop("canonical").select(rows.columns)
