"""Queries over the event table as request, log and content streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from marquesina.operators import content as C, crawl as CR
from marquesina.plans.content import log_lines, responses
from marquesina.plans.registry import query
from marquesina.session import work_dir
from marquesina.sources.store import KeyedTable
from marquesina.streaming import feeds as S, limits as N
from marquesina.streaming.cooldowns import cooldown_stream


def requests(b):
    return b.events.select(F.concat(F.lit("/feed:"), (F.col("user_id") % 7).cast("string")).alias("key"), F.col("event_id").alias("seq"), F.col("ts").alias("at"))


@query("n1_rate_limited", """
SELECT '/feed:' || CAST(user_id % 7 AS STRING) AS key, strftime(date_trunc('hour', ts), '%Y-%m-%d %H') AS hour, COUNT(*) AS requests, GREATEST(COUNT(*) - 3, 0) AS over
FROM {events} GROUP BY 1, 2""")
def _(b):
    load = N.window_load(requests(b).withColumn("at", F.col("at").cast("timestamp")), N.REGISTER)
    return load.select("key", F.date_format("window_start", "yyyy-MM-dd HH").alias("hour"), "requests", "over")


@query("n2_cooldown_audit", """
WITH r AS (SELECT event_id AS seq, user_id % 20 AS host, epoch(date_trunc('second', ts)) AS moment, event_type = 'click' AS refused, CAST(json_extract(props, '$.k') AS DOUBLE) AS k FROM {events}),
c AS (SELECT *, LAST_VALUE(CASE WHEN refused THEN moment + GREATEST(k * 100, 30) END IGNORE NULLS) OVER (PARTITION BY host ORDER BY moment, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS until FROM r)
SELECT seq, until AS cooling_until, COALESCE(moment < until, FALSE) AS in_cooldown FROM c""")
def _(b):
    r = b.events.select(
        F.col("event_id").alias("seq"), (F.col("user_id") % 20).alias("host"), F.unix_seconds(F.col("ts").cast("timestamp")).cast("double").alias("at"),
        (F.col("event_type") == "click").alias("refused"), (F.get_json_object("props", "$.k").cast("double") * 100).alias("retry_after"))
    return N.cooldown_audit(r, F.floor(F.col("at") / 3600)).select("seq", "cooling_until", "in_cooldown")


@query("e9_gap_audit", """
WITH r AS (SELECT event_id AS seq, user_id % 20 AS host, epoch(date_trunc('second', ts)) AS moment, CASE user_id % 3 WHEN 0 THEN 0.5 WHEN 1 THEN 2.0 ELSE 5.0 END * 60 AS gap FROM {events})
SELECT seq, moment - LAG(moment) OVER w AS waited, COALESCE(moment - LAG(moment) OVER w < gap, FALSE) AS too_soon FROM r WINDOW w AS (PARTITION BY host ORDER BY moment, seq)""")
def _(b):
    gap = CR.request_gap(F.col("user_id") % 3 + 1, F.lit(None)) * 60
    r = b.events.select(F.col("event_id").alias("seq"), (F.col("user_id") % 20).alias("host"), F.unix_seconds(F.col("ts").cast("timestamp")).cast("double").alias("at"), gap.alias("gap"))
    return CR.gap_audit(r, F.floor(F.col("at") / 3600)).select("seq", "waited", "too_soon")


@query("n3_hourly_log_kpis", """
SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H') AS hour, CASE event_type WHEN 'view' THEN 'source_complete' WHEN 'purchase' THEN 'source_extracted' WHEN 'error' THEN 'source_error' WHEN 'click' THEN 'host_backoff' ELSE 'source_extract_error' END AS event,
  CAST(user_id % 3 + 1 AS INT) AS tier, COUNT(*) AS lines, CAST(SUM(CASE WHEN event_type = 'view' THEN CAST(json_extract(props, '$.k') AS INT) % 4 ELSE 0 END) AS BIGINT) AS events FROM {events} GROUP BY 1, 2, 3""")
def _(b):
    log = C.read_log_lines(log_lines(b)).withColumn("at", F.col("at").cast("timestamp"))
    return S.hourly_log_kpis(log).withColumn("hour", F.date_format("hour", "yyyy-MM-dd HH"))


@query("n2_cooldown_stream", """
WITH r AS (SELECT event_id AS seq, user_id % 20 AS host, ts, epoch(ts) AS moment, event_type = 'click' AS refused, CAST(json_extract(props, '$.k') AS DOUBLE) AS k FROM {events}),
c AS (SELECT *, LAST_VALUE(CASE WHEN refused THEN moment + GREATEST(k * 100, 30) END IGNORE NULLS) OVER (PARTITION BY host ORDER BY ts, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS until FROM r)
SELECT seq, host, CASE WHEN moment < until THEN ROUND(until, 3) END AS cooling_until, COALESCE(moment < until, FALSE) AS in_cooldown FROM c""")
def _(b):
    """The requests arrive in three slices of time, then the clock moves on, so that the last ones are told too."""
    schema = "host long, seq long, ts timestamp, refused boolean, retry_after double"
    r = b.events.select(
        (F.col("user_id") % 20).cast("long").alias("host"), F.col("event_id").cast("long").alias("seq"), F.col("ts").cast("timestamp").alias("ts"),
        (F.col("event_type") == "click").alias("refused"), (F.get_json_object("props", "$.k").cast("double") * 100).alias("retry_after"))
    folder, out, checkpoint = (work_dir(b.spark, f"cooldowns-{n}") for n in ("in", "out", "checkpoint"))
    ends = r.agg(F.min("ts").alias("low"), F.max("ts").alias("high"))
    part = F.least(F.floor((F.unix_micros("ts") - F.unix_micros("low")) * 3 / (F.unix_micros("high") - F.unix_micros("low") + 1)), F.lit(2))
    placed = r.join(ends, F.lit(True)).withColumn("slice", part).select(*r.columns, "slice")
    last = ends.select(F.lit(-1).cast("long").alias("host"), F.lit(-1).cast("long").alias("seq"), F.expr("high + INTERVAL 30 DAYS").alias("ts"),
                       F.lit(False).alias("refused"), F.lit(None).cast("double").alias("retry_after"))
    with S.keyed_state(b.spark):
        for arrived in [*(placed.filter(F.col("slice") == i).drop("slice") for i in range(3)), last]:
            arrived.write.mode("append").parquet(folder)
            S.drain(cooldown_stream(b.spark.readStream.schema(schema).parquet(folder)), out, checkpoint)
    told = b.spark.read.schema("host long, seq long, cooling_until double, in_cooldown boolean").parquet(out)
    return told.withColumn("cooling_until", F.round("cooling_until", 3))


@query("n4_incremental_extraction", """
SELECT d.doc_id AS crawl_result_id, v.position, CASE v.position WHEN 0 THEN substring(d.name, 1, 500) ELSE 'Second' END AS name,
       CASE v.position WHEN 0 THEN d.source ELSE 'Hall' END AS location_name, CASE v.position WHEN 0 THEN '' ELSE 'u' END AS url
FROM {doc_row} d, (SELECT 0 AS position UNION ALL SELECT 1) v WHERE d.lang IN ('en', 'fr')""")
def _(b):
    """Responses arrive in two slices, and the first one comes in once more."""
    schema = "crawl_result_id long, extracted_content string"
    folder, held, checkpoint = (work_dir(b.spark, f"extraction-{n}") for n in ("in", "table", "checkpoint"))
    made = C.extracted_rows(b.spark.createDataFrame([], schema), b.spark.createDataFrame([], "crawl_result_id long"))
    table = KeyedTable(b.spark, held, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in made.schema), ("crawl_result_id", "position"), 16)
    arriving = responses(b).select(F.col("crawl_result_id").cast("long").alias("crawl_result_id"), "extracted_content")
    even = F.col("crawl_result_id") % 2 == 0
    for arrived in (arriving.filter(even), arriving.filter(~even), arriving.filter(even)):
        arrived.write.mode("append").parquet(folder)
        S.feed_extractions(b.spark.readStream.schema(schema).parquet(folder), table, checkpoint).awaitTermination()
    return table.read().select("crawl_result_id", "position", "name", "location_name", "url")


@query("m1_stored_upsert", """
WITH held AS (SELECT crawl_job_id, source_id, MIN(id) AS id, MIN(status) AS status FROM {res} GROUP BY 1, 2),
again AS (SELECT DISTINCT crawl_job_id, source_id FROM {res} WHERE status = 'failed'),
later AS (SELECT DISTINCT crawl_job_id + 1000000 AS crawl_job_id, source_id FROM {res})
SELECT h.crawl_job_id, h.source_id, h.id, CASE WHEN a.source_id IS NOT NULL THEN 'pending' ELSE h.status END AS status
FROM held h LEFT JOIN again a ON a.crawl_job_id = h.crawl_job_id AND a.source_id = h.source_id
UNION ALL SELECT crawl_job_id, source_id, NULL, 'pending' FROM later""")
def _(b):
    """All results are stored; those that failed are asked for again, twice; then every source gets a new job."""
    key = ["crawl_job_id", "source_id"]
    rows = b.res.select(F.col("crawl_job_id").cast("long").alias("crawl_job_id"), F.col("source_id").cast("long").alias("source_id"), F.col("id").cast("long").alias("id"), "status")
    table = KeyedTable(b.spark, work_dir(b.spark, "results"), "crawl_job_id long, source_id long, id long, status string", tuple(key), 16)
    pending = lambda d: d.select(*key).distinct().select(*key, F.lit(None).cast("long").alias("id"), F.lit("pending").alias("status"))
    table.upsert(rows.groupBy(*key).agg(F.min("id").alias("id"), F.min("status").alias("status")))
    for change in (*[pending(rows.filter("status = 'failed'"))] * 2, pending(rows.withColumn("crawl_job_id", F.col("crawl_job_id") + 1_000_000))):
        table.upsert(change, replace=["status"])
    return table.read()
