"""Ordered and grouped work that stays spread when one key holds much of the data.

A plain window puts a whole key into one task. Here the order of a key is cut into blocks (a
column of the data, such as the hour of a timestamp), each block is worked alone, and only one
summary row per block is carried on.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F


def first_per_key(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """First row per key as a combinable aggregate instead of a window sort."""
    rest = [c for c in df.columns if c not in keys]
    return (
        df.groupBy(*keys)
        .agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_row"))
        .select(*keys, "_row.*")
    )


def top_per_key(df: DataFrame, keys: list[str], order: list[Column], n: int, rank: str = "rank") -> DataFrame:
    """First ``n`` rows per key; Spark cuts each task to ``n`` rows per key before the shuffle."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w)).filter(F.col(rank) <= n)


def _same(left: str, right: str, keys: list[str]) -> Column:
    return reduce(lambda a, b: a & b, [F.col(f"{left}.{k}").eqNullSafe(F.col(f"{right}.{k}")) for k in keys])


def _carry(df: DataFrame, summary: DataFrame, keys: list[str], names: list[str]) -> DataFrame:
    joined = df.alias("l").join(summary.alias("r"), _same("l", "r", keys + ["_block"]), "left")
    return joined.select("l.*", *[F.col(f"r.{n}") for n in names])


def running_total(
    df: DataFrame, keys: list[str], block: Column, order: list[str], values: dict[str, Column], inclusive: bool = True
) -> DataFrame:
    """Add running sums per key; ``values`` maps new column names to the summed expressions."""
    rows = df.withColumn("_block", block)
    for name, value in values.items():
        rows = rows.withColumn(f"_v_{name}", value)
    local = Window.partitionBy(*keys, "_block").orderBy(*order).rowsBetween(
        Window.unboundedPreceding, 0 if inclusive else -1
    )
    before = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    totals = rows.groupBy(*keys, "_block").agg(*[F.sum(f"_v_{n}").alias(f"_t_{n}") for n in values])
    for name in values:
        totals = totals.withColumn(f"_b_{name}", F.sum(f"_t_{name}").over(before))
    out = _carry(rows, totals, keys, [f"_b_{n}" for n in values])
    zero = F.lit(0)
    for name in values:
        own = F.coalesce(F.sum(f"_v_{name}").over(local), zero)
        out = out.withColumn(name, own + F.coalesce(F.col(f"_b_{name}"), zero))
    return out.drop("_block", *[f"_v_{n}" for n in values], *[f"_b_{n}" for n in values])


def previous_value(df: DataFrame, keys: list[str], block: Column, order: list[str], value: Column, name: str) -> DataFrame:
    """Value of the row before, within each key."""
    rows = df.withColumn("_block", block).withColumn("_v", value)
    local = Window.partitionBy(*keys, "_block").orderBy(*order)
    before = Window.partitionBy(*keys).orderBy("_block")
    ends = rows.groupBy(*keys, "_block").agg(F.max_by("_v", F.struct(*order)).alias("_end"))
    ends = ends.withColumn("_before", F.lag("_end").over(before))
    out = _carry(rows, ends, keys, ["_before"])
    first = F.row_number().over(local) == 1
    return out.withColumn(name, F.when(first, F.col("_before")).otherwise(F.lag("_v").over(local))).drop("_block", "_v", "_before")


def running_max(df: DataFrame, keys: list[str], block: Column, order: list[str], value: Column, name: str) -> DataFrame:
    """Largest value over the rows before, within each key."""
    rows = df.withColumn("_block", block).withColumn("_v", value)
    local = Window.partitionBy(*keys, "_block").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    before = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    tops = rows.groupBy(*keys, "_block").agg(F.max("_v").alias("_top"))
    tops = tops.withColumn("_before", F.max("_top").over(before))
    out = _carry(rows, tops, keys, ["_before"])
    return out.withColumn(name, F.greatest(F.max("_v").over(local), F.col("_before"))).drop("_block", "_v", "_before")
