"""Points stored by cell: keys, ranges, answers and what a view reads, next to plain Python."""

import glob
import random

import pyarrow.parquet as pq
from pyspark.sql import functions as F

from marquesina.sources import cells as C


def key(lat, lng):
    """Bits of both coordinates one after the other."""
    y, x = C._grid(lat, 90.0), C._grid(lng, 180.0)
    return int("".join(a + b for a, b in zip(f"{y:024b}", f"{x:024b}")), 2)


def points(n, seed):
    r = random.Random(seed)
    city = [(r.uniform(10.2, 10.7), r.uniform(-67.2, -66.6)) for _ in range(n)]
    return city + [(r.uniform(-90, 90), r.uniform(-180, 180)) for _ in range(n)] + [(90.0, 180.0), (-90.0, -180.0), (0.0, 0.0), (95.0, -200.0)]


def test_keys_interleave_both_coordinates(spark):
    rows = points(150, 1)
    df = spark.createDataFrame([*rows, (None, 1.0), (1.0, None)], "lat double, lng double")
    got = [(x.lat, x.lng, x.k) for x in df.select("lat", "lng", C.cell_of(F.col("lat"), F.col("lng")).alias("k")).collect()]
    assert got == [*((a, b, key(a, b)) for a, b in rows), (None, 1.0, None), (1.0, None, None)]


def test_ranges_hold_every_point_of_a_box():
    r = random.Random(2)
    for box in range(60):
        reach = r.choice([0.0, 0.001, 0.2, 20.0])
        y, x = r.uniform(-80, 80), r.uniform(-170, 170)
        low, high = (y, x), (y + reach, x + reach * r.random())
        ranges = C.cell_ranges(low, high)
        assert len(ranges) <= C.RANGES and all(a <= b for a, b in ranges) and all(p[1] < q[0] for p, q in zip(ranges, ranges[1:]))
        for _ in range(40):
            k = key(r.uniform(low[0], high[0]), r.uniform(low[1], high[1]))
            assert any(a <= k <= b for a, b in ranges)


def test_view_reads_few_row_groups(spark, tmp_path):
    rows = points(20_000, 3)
    df = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(rows)] + [(-1, None, None)], "id long, lat double, lng double")
    folder = str(tmp_path / "points")
    C.write_points(df, "lat", "lng", folder, 8192)
    assert spark.read.parquet(folder).count() == df.count()
    low, high = (10.40, -66.95), (10.45, -66.90)
    got = C.read_box(spark, folder, low, high).filter(F.col("lat").between(low[0], high[0]) & F.col("lng").between(low[1], high[1]))
    inside = lambda p: low[0] <= p[0] <= high[0] and low[1] <= p[1] <= high[1]
    assert sorted(x.id for x in got.collect()) == [i for i, p in enumerate(rows) if inside(p)]
    assert "And(GreaterThanOrEqual(_c" in got._jdf.queryExecution().toString().split("PushedFilters")[1]
    total = met = 0
    for f in glob.glob(f"{folder}/part-*"):
        meta = pq.ParquetFile(f).metadata
        at = [meta.schema.column(i).name for i in range(meta.num_columns)].index(C.CELL)
        for g in range(meta.num_row_groups):
            stats = meta.row_group(g).column(at).statistics
            total += 1
            met += stats.has_min_max and any(a <= stats.max and b >= stats.min for a, b in C.cell_ranges(low, high))
    assert total > 40 and met * 8 < total
