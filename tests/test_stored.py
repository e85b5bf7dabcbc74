"""Tables changed by key, streams with state and watermark, and the map document, next to plain Python."""

import datetime as dt
import json
import os
import random

import pytest
from pyspark.sql import functions as F

from marquesina.sources.store import KeyedTable
from marquesina.sources.tables import GEOJSON_EDGES, read_document, write_document
from marquesina.streaming.cooldowns import cooldown_stream
from marquesina.streaming.feeds import hourly_log_kpis, read_log_stream, running_progress
from marquesina.streaming.limits import cooldown_audit

START = dt.datetime(2026, 4, 10, tzinfo=dt.timezone.utc)


def files(folder):
    return {os.path.join(d, f) for d, _, names in os.walk(folder) for f in names if f.endswith(".parquet")}


def test_upsert_rewrites_touched_buckets(spark, tmp_path):
    t = KeyedTable(spark, str(tmp_path / "t"), "job long, source string, status string, n int", ("job", "source"), 16)
    frame = lambda rows: spark.createDataFrame(rows, t.schema)
    assert t.read().collect() == [] and t.upsert(frame([])) == []
    t.upsert(frame([(i, f"s{i % 3}", "old", i) for i in range(200)]))
    before = files(t.folder)
    change = [(5, "s2", "new", -5), (900, "s0", "new", -9)]
    touched = t.upsert(frame(change), replace=["status"])
    expected = {(i, f"s{i % 3}"): ("old", i) for i in range(200)} | {(5, "s2"): ("new", 5), (900, "s0"): ("new", -9)}
    assert {(r.job, r.source): (r.status, r.n) for r in t.read().collect()} == expected
    kept = {f for f in before if not any(f"_bucket={b}/" in f for b in touched)}
    assert 0 < len(touched) <= 2 and kept and kept == {f for f in files(t.folder) if f in before}
    t.upsert(frame(change), replace=["status"])
    t.upsert(frame([(5, "s2", "other", 1)]))
    assert {(r.job, r.source): (r.status, r.n) for r in t.read().collect()} == expected


def stream_rows(spark, tmp_path, slices, schema, work):
    """Output of a stream that is handed one slice after the other."""
    source, out, cp = (str(tmp_path / n) for n in ("in", "out", "cp"))
    for rows in slices:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
        q = work(spark.readStream.schema(schema).parquet(source)).writeStream.format("parquet").option(
            "checkpointLocation", cp).trigger(availableNow=True).start(out)
        q.awaitTermination(240)
        assert q.exception() is None
    return spark.read.parquet(out).collect(), q.lastProgress


@pytest.fixture
def rocks(spark):
    name = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield
    spark.conf.unset(name)


def test_cooldowns_of_stream_and_table(spark, tmp_path, rocks):
    r = random.Random(4)
    rows = [(1 if r.random() < 0.4 else r.randint(2, 5), i, START + dt.timedelta(seconds=r.randrange(7200)), r.random() < 0.2, r.choice([None, 5.0, 90.0]))
            for i in range(150)]
    schema = "host long, seq long, ts timestamp, refused boolean, retry_after double"
    rows.sort(key=lambda x: x[2])
    slices = [rows[:60], rows[60:100], rows[100:]]
    # Some rows come a slice late, within the hour that is allowed.
    slices[1] += slices[0][40::5]
    del slices[0][40::5]
    for part in slices:
        r.shuffle(part)
    slices.append([(-1, -1, START + dt.timedelta(days=2), False, None)])
    got, progress = stream_rows(spark, tmp_path, slices, schema, cooldown_stream)
    table = spark.createDataFrame(rows, schema).withColumn("at", F.unix_micros("ts") / 1e6)
    expected = cooldown_audit(table, F.floor(F.col("at") / 600)).select("host", "seq", "in_cooldown").collect()
    assert sorted((x.host, x.seq, x.in_cooldown) for x in got) == sorted(map(tuple, expected))
    assert any(x.in_cooldown for x in got)
    # Only the last row, which no watermark has passed, is still held.
    assert progress.stateOperators[0].numRowsTotal <= 2


def test_windows_close_behind_the_watermark(spark, tmp_path):
    at = lambda h, m=0: START + dt.timedelta(hours=h, minutes=m)
    schema = "event string, tier int, at timestamp, event_count int"
    line = lambda *t: ("source_complete", 1, at(*t), 2)
    slices = [
        [line(0, 5), line(0, 50), line(1, 10)],
        [line(0, 55), line(2, 30)],  # late by less than the hour allowed
        [line(0, 58), line(3, 5)],  # its window has been told: dropped
        [line(9)],
    ]
    got, progress = stream_rows(spark, tmp_path, slices, schema, lambda s: hourly_log_kpis(s))
    hour = lambda h: at(h).replace(tzinfo=None)
    assert sorted((x.hour, x.lines, x.events) for x in got) == [(hour(0), 3, 6), (hour(1), 1, 2), (hour(2), 1, 2), (hour(3), 1, 2)]
    assert progress.stateOperators[0].numRowsTotal == 1


def test_progress_in_update_mode(spark, tmp_path):
    source, told = str(tmp_path / "in"), []
    os.makedirs(source)
    lines = [("source_complete", "a", None), ("source_extracted", "a", 3), ("source_extracted", "b", 4), ("source_extracted", "a", 2)]
    for part in (lines[:2], lines[2:]):
        with open(f"{source}/{len(told)}.json", "w") as f:
            f.writelines(json.dumps({"event": e, "run": r, "events_extracted": n}) + "\n" for e, r, n in part)
        q = running_progress(read_log_stream(spark, source)).writeStream.outputMode("update").foreachBatch(
            lambda d, n: told.append(sorted(map(tuple, d.collect())))).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        q.awaitTermination(240)
        assert q.exception() is None
    assert [t for t in told if t] == [[("a", 1, 3)], [("a", 1, 5), ("b", 0, 4)]]


def test_parts_join_to_one_document(spark, tmp_path):
    r = random.Random(2)
    for name, n in (("many", 500), ("one", 1), ("none", 0)):
        rows = [(float(r.randrange(40)), json.dumps({"n": r.randrange(30)})) for _ in range(n)]
        lines = spark.createDataFrame(rows, "sort_key double, value string").repartition(5)
        path = str(tmp_path / name)
        write_document(lines, ["sort_key"], GEOJSON_EDGES, path)
        parts = sorted(f for f in os.listdir(path) if f.startswith("part-"))
        whole = json.loads("".join(open(f"{path}/{p}").read() for p in parts))
        assert whole == {"type": "FeatureCollection", "features": [json.loads(v) for _, v in sorted(rows)]}
        assert sorted(x.value for x in read_document(spark, path, GEOJSON_EDGES).collect()) == sorted(v for _, v in rows)


def test_tasks_stay_small_in_a_session_made_elsewhere(spark, tmp_path):
    from marquesina.plans.bindings import Bound

    held = {k: spark.conf.get(k, None) for k in ("spark.sql.adaptive.coalescePartitions.initialPartitionNum", "spark.sql.adaptive.advisoryPartitionSizeInBytes")}
    try:
        for k in held:
            spark.conf.unset(k)
        Bound(spark, str(tmp_path))
        rows = spark.range(0, 3_000_000, 1, 4).selectExpr("id * 7919 % 1000003 AS k", "uuid() AS v")
        parts = rows.groupBy("k").agg({"v": "max"}).rdd.getNumPartitions()
        assert parts > int(spark.conf.get("spark.sql.shuffle.partitions"))
    finally:
        for k, v in held.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
