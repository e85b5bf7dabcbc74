"""Points stored along an interleaved cell key, so that a map view reads only the row groups it can show."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

CELL = "_cell"
BITS = 24
# Ranges of cells one view is put together from; a view of more is covered by ranges that hold a little more.
RANGES = 48
ROW_GROUP_BYTES = 16 << 20


def _grid(degrees: float, span: float) -> int:
    return min(max(int((degrees + span) / (2 * span) * (1 << BITS) // 1), 0), (1 << BITS) - 1)


def _axis(degrees: Column, span: float) -> Column:
    cell = F.floor((degrees.cast("double") + F.lit(span)) / F.lit(2 * span) * F.lit(float(1 << BITS)))
    return F.greatest(F.least(cell, F.lit((1 << BITS) - 1)), F.lit(0)).cast("long")


def _spread(axis: Column) -> Column:
    """The bits of a coordinate at every second place of the key."""
    out = axis
    for shift in (16, 8, 4, 2, 1):
        mask = sum(((1 << shift) - 1) << at for at in range(0, 2 * BITS, 2 * shift))
        out = out.bitwiseOR(F.shiftleft(out, shift)).bitwiseAND(F.lit(mask).cast("long"))
    return out


def cell_of(lat: Column, lng: Column) -> Column:
    """Interleaved key of a point; null without coordinates. Points beyond the globe fall into its outermost cells."""
    return F.when(lat.isNotNull() & lng.isNotNull(), F.shiftleft(_spread(_axis(lat, 90.0)), 1).bitwiseOR(_spread(_axis(lng, 180.0))))


def cell_ranges(low: tuple[float, float], high: tuple[float, float], most: int = RANGES) -> list[tuple[int, int]]:
    """Ranges of keys that together hold every point of a (lat, lng) box; at most ``most`` of them.

    Quarters of the globe are halved on, the largest first, where they reach beyond the box.
    """
    (y0, x0), (y1, x1) = ((_grid(p[0], 90.0), _grid(p[1], 180.0)) for p in (low, high))
    done, open_ = [], [(BITS, 0, 0, 0)]
    while open_:
        level, key, y, x = open_.pop(0)
        size = 1 << level
        if y > y1 or x > x1 or y + size <= y0 or x + size <= x0:
            continue
        inside = y >= y0 and x >= x0 and y + size - 1 <= y1 and x + size - 1 <= x1
        if inside or level == 0 or len(done) + len(open_) + 4 > most:
            done.append((key, key + (1 << 2 * level) - 1))
            continue
        half = size // 2
        open_ += [(level - 1, key + (q << 2 * (level - 1)), y + (q >> 1) * half, x + (q & 1) * half) for q in range(4)]
    out: list[tuple[int, int]] = []
    for a, b in sorted(done):
        if out and out[-1][1] + 1 == a:
            out[-1] = (out[-1][0], b)
        else:
            out.append((a, b))
    return out


def write_points(df: DataFrame, lat: str, lng: str, folder: str, group_bytes: int = ROW_GROUP_BYTES) -> None:
    """Write rows in order of their cells: ranges of cells to tasks, sorted row groups within; points of one place may fill several files."""
    placed = df.withColumn(CELL, cell_of(F.col(lat), F.col(lng)))
    placed.repartitionByRange(CELL).sortWithinPartitions(CELL).write.mode("overwrite").option("parquet.block.size", group_bytes).parquet(folder)


def read_box(spark: SparkSession, folder: str, low: tuple[float, float], high: tuple[float, float]) -> DataFrame:
    """Rows of the cells that meet a (lat, lng) box; the ranges reach the scan, exact tests are the caller's."""
    stored, ranges = spark.read.parquet(folder), cell_ranges(low, high)
    hit = F.lit(False)
    for a, b in ranges:
        hit = hit | F.col(CELL).between(a, b)
    return stored.filter(hit).drop(CELL)
