"""Queries over sources, crawl results, usage records and the crawl log."""

from __future__ import annotations

from pyspark.sql import functions as F

from marquesina.functions import text as T
from marquesina.functions.dates import elapsed_seconds, resolve_url_template
from marquesina.operators import crawl as C, dashboards as B, lifecycle as L
from marquesina.plans.bindings import LOG_NOW, SOURCES_NOW
from marquesina.plans.registry import query

def now():
    return F.lit(SOURCES_NOW).cast("timestamp_ntz")



def _due(b, **how):
    return C.due_sources(b.src, b.cfg, b.src_url, now(), **how)


def _flat(due):
    return due.select("id", "name", "tier", "min_interval", "crawl_frequency", "num_clicks", "max_pages", "crawl_mode", "notes", "n_urls")


DUE_SQL = """
SELECT s.id, s.name, CASE WHEN s.tier IS NULL THEN 1 ELSE s.tier END AS tier, s.min_interval,
       COALESCE(NULLIF(c.crawl_frequency, 0), 7) AS crawl_frequency, COALESCE(NULLIF(c.num_clicks, 0), 2) AS num_clicks,
       COALESCE(NULLIF(c.max_pages, 0), 30) AS max_pages, COALESCE(c.crawl_mode, 'browser') AS crawl_mode, c.notes,
       COUNT(u.url) AS n_urls
FROM {{src}} s JOIN {{cfg}} c ON c.source_id = s.id
LEFT JOIN {{src_url}} u ON u.source_id = s.id AND u.deleted_at IS NULL
WHERE s.deleted_at IS NULL AND {where}
GROUP BY ALL HAVING COUNT(u.url) > 0 OR c.crawl_mode IN ('json_api', 'instagram')"""
CADENCE = "NOT s.disabled AND (c.crawl_after IS NULL OR c.crawl_after <= DATE '2001-11-08')"
STANDARD = CADENCE + """ AND (c.force_crawl OR c.last_crawled_at IS NULL
    OR FLOOR(date_diff('second', c.last_crawled_at, TIMESTAMP '2001-11-08 12:00:00') / 86400) >= COALESCE(c.crawl_frequency, 7))"""


@query("a1_due_sources", DUE_SQL.format(where=STANDARD).replace("GROUP BY ALL", "GROUP BY s.id, s.name, s.tier, s.min_interval, c.crawl_frequency, c.num_clicks, c.max_pages, c.crawl_mode, c.notes"))
def _(b):
    return _flat(_due(b))


@query("a2_due_sources_by_id", DUE_SQL.format(where="s.id IN (3, 5, 8, 13, 21, 34)").replace("GROUP BY ALL", "GROUP BY s.id, s.name, s.tier, s.min_interval, c.crawl_frequency, c.num_clicks, c.max_pages, c.crawl_mode, c.notes"))
def _(b):
    return _flat(_due(b, source_ids=[3, 5, 8, 13, 21, 34]))


@query("a3_due_sources_by_tier", DUE_SQL.format(where=CADENCE + " AND s.tier = 2").replace("GROUP BY ALL", "GROUP BY s.id, s.name, s.tier, s.min_interval, c.crawl_frequency, c.num_clicks, c.max_pages, c.crawl_mode, c.notes"))
def _(b):
    return _flat(_due(b, tier=2))


@query("a4_packed_urls", "SELECT source_id, sort_order, id, url, js_code FROM {src_url} WHERE deleted_at IS NULL")
def _(b):
    return C.live_urls(b.src_url)


@query("a5_config_defaults", """
SELECT source_id, COALESCE(NULLIF(crawl_frequency, 0), 7) AS crawl_frequency, COALESCE(NULLIF(num_clicks, 0), 2) AS num_clicks,
       COALESCE(NULLIF(max_pages, 0), 30) AS max_pages, COALESCE(crawl_mode, 'browser') AS crawl_mode FROM {cfg}""")
def _(b):
    d = C.or_default
    return b.cfg.select("source_id", *[d(F.col(c), v).alias(c) for c, v in [
        ("crawl_frequency", 7), ("num_clicks", 2), ("max_pages", 30), ("crawl_mode", "browser")]])


@query("a6_retry_scan", """
SELECT r.id AS crawl_result_id, r.status AS original_status, r.source_id, r.crawl_job_id, s.name, c.notes, j.started_at,
       CASE WHEN r.status = 'failed' AND t.crawled_content IS NOT NULL AND t.extracted_content IS NULL THEN 'crawled' ELSE r.status END AS status
FROM {res} r JOIN {src} s ON s.id = r.source_id JOIN {job} j ON j.id = r.crawl_job_id
LEFT JOIN {content} t ON t.crawl_result_id = r.id LEFT JOIN {cfg} c ON c.source_id = s.id
WHERE NOT s.disabled AND s.deleted_at IS NULL AND (r.status = 'crawled' OR (r.status = 'failed' AND t.crawled_content IS NOT NULL))""")
def _(b):
    return C.retry_scan(b.res, b.src, b.job, b.content, b.cfg)


@query("f8_retry_order_top", """
SELECT r.id AS crawl_result_id, r.status AS original_status, j.started_at, ROW_NUMBER() OVER (ORDER BY r.status, j.started_at DESC, r.id) AS place
FROM {res} r JOIN {src} s ON s.id = r.source_id JOIN {job} j ON j.id = r.crawl_job_id
WHERE NOT s.disabled AND s.deleted_at IS NULL AND r.status IN ('crawled', 'failed')""")
def _(b):
    scan = C.retry_scan(b.res, b.src, b.job, b.content, b.cfg).select("crawl_result_id", "original_status", "started_at")
    return L.numbered(scan, ["original_status", F.col("started_at").desc(), "crawl_result_id"], 0, "place")


@query("f2_f11_due_order_limit", """
SELECT s.id, c.force_crawl FROM {src} s JOIN {cfg} c ON c.source_id = s.id
LEFT JOIN (SELECT source_id, COUNT(*) AS n FROM {src_url} WHERE deleted_at IS NULL GROUP BY source_id) u ON u.source_id = s.id
WHERE s.deleted_at IS NULL AND """ + STANDARD + """ AND (u.n > 0 OR c.crawl_mode IN ('json_api', 'instagram'))
ORDER BY c.force_crawl DESC, c.last_crawled_at ASC NULLS FIRST, s.id LIMIT 10""")
def _(b):
    return C.due_order(_due(b)).limit(10).select("id", "force_crawl")


@query("a7_upsert_crawl_result", """
SELECT crawl_job_id, source_id, MIN(id) AS id, 'pending' AS status FROM {res} GROUP BY crawl_job_id, source_id""")
def _(b):
    held = C.first_per_key(b.res.select("crawl_job_id", "source_id", "id", "status"), ["crawl_job_id", "source_id"], [F.col("id")])
    again = b.res.select("crawl_job_id", "source_id", F.lit(None).cast("long").alias("id"), F.lit("pending").alias("status")).distinct()
    return L.upsert(held, again, ["crawl_job_id", "source_id"], replace=["status"])


@query("a8_stage_transition", """
SELECT id, crawl_job_id, source_id, CASE status WHEN 'crawled' THEN 'extracted' WHEN 'extracted' THEN 'failed' ELSE status END AS status,
       CASE WHEN status = 'crawled' THEN DATE '2026-04-10' END AS extracted_at,
       CASE WHEN status = 'extracted' THEN 'no answer for ' || CAST(id AS STRING) ELSE error_message END AS error_message FROM {res}""")
def _(b):
    change = b.res.filter(F.col("status").isin("crawled", "extracted")).select(
        "id", F.when(F.col("status") == "crawled", "extracted").otherwise("failed").alias("new_status"),
        F.when(F.col("status") == "extracted", F.concat(F.lit("no answer for "), F.col("id").cast("string"))).alias("new_error"))
    return C.stage_update(b.res, change, F.lit("2026-04-10").cast("date")).drop("crawled_at")


@query("a9_mark_crawled", """
SELECT c.source_id, CASE WHEN r.source_id IS NULL THEN CAST(c.last_crawled_at AS DATE) ELSE DATE '2001-11-08' END AS last_crawled,
       c.force_crawl AND r.source_id IS NULL AS force_crawl
FROM {cfg} c LEFT JOIN (SELECT DISTINCT source_id FROM {res} WHERE status = 'processed') r ON r.source_id = c.source_id""")
def _(b):
    return C.mark_crawled(b.cfg, b.res.filter("status = 'processed'"), now()).select(
        "source_id", F.to_date("last_crawled_at").alias("last_crawled"), "force_crawl")


@query("a18_content_size_gate", """
SELECT crawl_result_id, LENGTH(crawled_content) AS content_size,
       CASE WHEN LENGTH(crawled_content) < 500 THEN 'failed' ELSE 'crawled' END AS gate,
       CASE WHEN LENGTH(crawled_content) < 500 THEN 'Crawled content too small (' || CAST(LENGTH(crawled_content) AS STRING) ||
            ' bytes < 500 minimum) - likely failed to load page content' END AS gate_error,
       CASE WHEN LENGTH(crawled_content) >= 500 THEN LEAST(LENGTH(crawled_content), 120000) END AS kept FROM {content}""")
def _(b):
    return C.size_gate(b.content).select("crawl_result_id", F.col("content_size").cast("long").alias("content_size"), "gate", "gate_error",
                                         F.length("kept_text").cast("long").alias("kept"))


@query("a19_bulk_new_sources", """
WITH w AS (SELECT page_id AS id, CASE WHEN page_id % 2 = 0 THEN ' SUPPLIER#' ELSE 'Site ' END || lpad(CAST(page_id % 300 AS STRING), 9, '0') AS name FROM {pages})
SELECT MIN(id) AS id, min_by(name, id) AS name FROM w
WHERE lower(trim(name)) NOT IN (SELECT lower(trim(name)) FROM {src}) GROUP BY lower(trim(name))""")
def _(b):
    candidates = b.pages.select(F.col("page_id").alias("id"), F.concat(
        F.when(F.col("page_id") % 2 == 0, " SUPPLIER#").otherwise("Site "), F.lpad((F.col("page_id") % 300).cast("string"), 9, "0")).alias("name"))
    return C.new_rows(candidates, b.src).select("id", "name")


@query("a22_request_plan", """
SELECT host, COUNT(*) AS requests, MAX(gap) AS gap, SUM(gap) AS seconds FROM (
  SELECT page_id, lower(split_part(split_part(split_part(url, '://', 2), '/', 1), ':', 1)) AS host,
         CASE WHEN s.min_interval > 0 THEN s.min_interval ELSE CASE s.tier WHEN 2 THEN 2.0 WHEN 3 THEN 5.0 ELSE 0.5 END END AS gap
  FROM {pages} LEFT JOIN {src} s ON s.id = page_id % 40) GROUP BY host""")
def _(b):
    r = b.pages.join(b.src.withColumnRenamed("id", "sid"), F.col("page_id") % 40 == F.col("sid"), "left").select(
        "page_id", T.hostname(F.col("url")).alias("host"), C.request_gap(F.col("tier"), F.col("min_interval")).alias("gap"))
    return C.request_plan(r)


@query("a24_appended_urls", """
SELECT (SELECT MAX(id) FROM {src_url}) + ROW_NUMBER() OVER (ORDER BY url) AS id, source_id, url FROM (
  SELECT w.url, MIN(w.source_id) AS source_id FROM (SELECT 'https://crawl.example.org/' || CAST(n_chars AS STRING) AS url, n_chars % 40 AS source_id FROM {documents} UNION ALL SELECT url, page_id % 40 FROM {pages}) w
  WHERE w.url NOT IN (SELECT url FROM {src_url} WHERE deleted_at IS NULL) GROUP BY w.url)""")
def _(b):
    wanted = b.documents.select(F.concat(F.lit("https://crawl.example.org/"), F.col("n_chars").cast("string")).alias("url"), (F.col("n_chars") % 40).alias("source_id")).unionByName(
        b.pages.select("url", (F.col("page_id") % 40).alias("source_id")))
    return C.appended_urls(wanted, b.src_url)


@query("a24_c7_url_conflicts", """
WITH w AS (SELECT 'https://crawl.example.org/' || CAST(n_chars AS STRING) AS url FROM {documents} UNION ALL SELECT url FROM {pages})
SELECT w.url, CASE WHEN MAX(u.url) IS NOT NULL THEN 'exists' WHEN COUNT(*) > 1 THEN 'repeated' ELSE 'free' END AS verdict, COUNT(*) AS times
FROM w LEFT JOIN (SELECT DISTINCT url FROM {src_url} WHERE deleted_at IS NULL) u ON u.url = w.url GROUP BY w.url""")
def _(b):
    asked = b.documents.select(F.concat(F.lit("https://crawl.example.org/"), F.col("n_chars").cast("string")).alias("url")).union(b.pages.select("url"))
    return C.url_conflicts(asked, b.src_url)


@query("e6_first_url", """
SELECT source_id, min_by(url, sort_order) AS url FROM {src_url} WHERE deleted_at IS NULL GROUP BY source_id""")
def _(b):
    return C.first_urls(b.src_url)


@query("i8_url_templates", """
SELECT page_id, CASE WHEN instr(url, '?') > 0 THEN url || '&m=' || lower(monthname(d)) || '&y=' || CAST(year(d) AS STRING) || '&n=' || lower(monthname(n)) || '&ny=' || CAST(year(n) AS STRING) ELSE url END AS url
FROM (SELECT *, d + INTERVAL 1 MONTH AS n FROM (SELECT *, DATE '1999-01-15' + INTERVAL (page_id % 30) MONTH AS d FROM {pages}))""")
def _(b):
    marked = F.when(F.instr("url", "?") > 0, F.concat("url", F.lit("&m={{month}}&y={{year}}&n={{next_month}}&ny={{next_month_year}}"))).otherwise(F.col("url"))
    day = F.add_months(F.lit("1999-01-15").cast("date"), (F.col("page_id") % 30).cast("int"))
    return b.pages.select("page_id", resolve_url_template(marked, day).alias("url"))


@query("h17_hostnames", """
SELECT page_id, lower(split_part(split_part(split_part(url, '://', 2), '/', 1), ':', 1)) AS host FROM {pages}""")
def _(b):
    return b.pages.select("page_id", T.hostname(F.col("url")).alias("host"))


@query("k7_config_partial_update", """
SELECT c.source_id, COALESCE(n.crawl_frequency, c.crawl_frequency) AS crawl_frequency, COALESCE(n.notes, c.notes) AS notes, c.crawl_mode
FROM {cfg} c LEFT JOIN (SELECT id AS source_id, 30 AS crawl_frequency, CAST(NULL AS STRING) AS notes FROM {src} WHERE disabled) n ON n.source_id = c.source_id""")
def _(b):
    change = b.src.filter("disabled").select(F.col("id").alias("source_id"), F.lit(30).alias("crawl_frequency"), F.lit(None).cast("string").alias("notes"))
    return C.merge_config(b.cfg, change, ["crawl_frequency", "notes"]).select("source_id", "crawl_frequency", "notes", "crawl_mode")


# Usage records and the log live in the event table: one record per row.

def log_now():
    return F.lit(LOG_NOW).cast("timestamp_ntz")



@query("b15_active_and_stuck_jobs", """
SELECT COUNT(CASE WHEN created_at >= TIMESTAMP '2024-01-25 08:30:00' THEN 1 END) AS active,
       COUNT(CASE WHEN created_at < TIMESTAMP '2024-01-25 08:30:00' THEN 1 END) AS stuck
FROM {usage} WHERE provider = 'view' AND created_at <= TIMESTAMP '2024-01-25 10:30:00'""")
def _(b):
    jobs = b.usage.filter(F.col("created_at") <= log_now()).select(
        F.when(F.col("provider") == "view", "running").otherwise("completed").alias("status"), F.col("created_at").alias("started_at"))
    return B.job_split(jobs, log_now())


@query("b19_failed_results", """
SELECT id, source_id, error_message, created_at FROM {res} WHERE status = 'failed' AND error_message IS NOT NULL
ORDER BY created_at DESC, id LIMIT 50""")
def _(b):
    return B.recent_failures(b.res, 50).select("id", "source_id", "error_message", "created_at")


@query("d2_sources_by_tier", "SELECT tier, COUNT(*) AS n FROM {src} WHERE deleted_at IS NULL GROUP BY tier")
def _(b):
    return b.src.filter("deleted_at IS NULL").groupBy("tier").agg(F.count("*").alias("n"))


@query("d3_sources_summary", """
SELECT COUNT(*) AS total, COUNT(CASE WHEN NOT disabled THEN 1 END) AS active, COUNT(CASE WHEN disabled THEN 1 END) AS disabled
FROM {src} WHERE deleted_at IS NULL""")
def _(b):
    return B.source_counts(b.src)


@query("d4_usage_today", """
SELECT COUNT(*) AS api_calls, COALESCE(SUM(input_tokens), 0) AS input_tokens, COALESCE(SUM(output_tokens), 0) AS output_tokens,
       CAST(ROUND(CAST(COALESCE(SUM(input_tokens), 0) + 4 * COALESCE(SUM(output_tokens), 0) AS DECIMAL(24,0)) * 0.0000001, 6) AS DOUBLE) AS cost
FROM {usage} WHERE created_at >= TIMESTAMP '2024-01-25 00:00:00'""")
def _(b):
    return B.usage_since(b.usage, F.date_trunc("day", log_now()))


@query("d5_hourly_cost", """
WITH h AS (SELECT TIMESTAMP '2024-01-24 11:00:00' + INTERVAL (i) HOUR AS hour, i AS bucket FROM range(24) t(i)),
u AS (SELECT date_trunc('hour', created_at) AS hour, SUM(input_tokens) AS tokens, COUNT(*) AS calls FROM {usage}
      WHERE created_at >= TIMESTAMP '2024-01-24 10:30:00' GROUP BY 1)
SELECT CAST(h.bucket AS INT) AS bucket, COALESCE(u.tokens, 0) AS tokens, COALESCE(u.calls, 0) AS calls FROM h LEFT JOIN u ON u.hour = h.hour""")
def _(b):
    return B.hourly_series(b.usage, "created_at", log_now(), {"tokens": F.sum("input_tokens"), "calls": F.count("*")})


@query("d10_k6_usage_by_job", """
SELECT user_id, COUNT(*) AS api_calls, SUM(input_tokens) AS input_tokens, SUM(output_tokens) AS output_tokens,
       CAST(ROUND(CAST(SUM(input_tokens) + 4 * SUM(output_tokens) AS DECIMAL(24,0)) * 0.0000001, 6) AS DOUBLE) AS cost,
       (SELECT STRING_AGG(p.provider || '=' || CAST(p.n AS STRING), ',' ORDER BY p.provider) FROM
         (SELECT user_id, provider, COUNT(*) AS n FROM {usage} GROUP BY 1, 2) p WHERE p.user_id = t.user_id) AS providers,
       (SELECT p.provider FROM (SELECT user_id, provider, COUNT(*) AS n FROM {usage} GROUP BY 1, 2) p
         WHERE p.user_id = t.user_id ORDER BY n DESC, provider LIMIT 1) AS primary_provider
FROM {usage} t GROUP BY user_id""")
def _(b):
    out = B.usage_totals(b.usage, ["user_id"])
    listed = F.array_join(F.transform(F.array_sort(F.map_entries("providers")), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ",")
    return out.withColumn("providers", listed)


@query("d18_run_counters", """
SELECT COUNT(CASE WHEN status = 'processed' THEN 1 END) AS processed, COUNT(CASE WHEN status = 'extracted' THEN 1 END) AS extracted,
       COUNT(CASE WHEN status = 'crawled' THEN 1 END) AS crawled, COUNT(CASE WHEN status = 'failed' THEN 1 END) AS failed FROM {res}""")
def _(b):
    return B.status_counters(b.res, ["processed", "extracted", "crawled", "failed"])


@query("d20_m14_backlog_jobs", "SELECT crawl_job_id, COUNT(*) AS waiting FROM {res} WHERE status = 'extracted' AND crawl_job_id IS NOT NULL GROUP BY 1")
def _(b):
    return B.backlog(b.res)


@query("d23_recent_event_count", "SELECT COUNT(*) AS n FROM {ev} WHERE created_at >= TIMESTAMP '1998-06-15 00:00:00'")
def _(b):
    return B.count_since(b.ev, "created_at", F.date_trunc("day", F.lit("1998-06-15 18:00:00").cast("timestamp_ntz")))


@query("h22_relative_time", """
SELECT event_id, CASE WHEN s < 60 THEN 'just now' WHEN s < 3600 THEN CAST(CAST(FLOOR(s / 60) AS BIGINT) AS STRING) || 'm ago'
  WHEN s < 86400 THEN CAST(CAST(FLOOR(s / 3600) AS BIGINT) AS STRING) || 'h ago' WHEN s < 172800 THEN 'yesterday'
  WHEN s < 604800 THEN CAST(CAST(FLOOR(s / 86400) AS BIGINT) AS STRING) || 'd ago' ELSE strftime(ts, '%b %d') END AS label
FROM (SELECT event_id, ts, date_diff('microsecond', ts, TIMESTAMP '2024-01-25 10:30:00') / 1000000 AS s FROM {events})""")
def _(b):
    return b.events.select("event_id", T.relative_time(F.col("ts"), log_now()).alias("label"))


@query("i12_elapsed_and_local_time", """
SELECT event_id, date_diff('second', ts, TIMESTAMP '2024-02-01 00:00:00') AS whole, strftime(ts - INTERVAL 4 HOUR, '%Y-%m-%d %H:%M') AS shown
FROM (SELECT event_id, date_trunc('second', ts) AS ts FROM {events})""")
def _(b):
    from marquesina.functions.dates import display_time
    at = F.date_trunc("second", F.col("ts")).cast("timestamp_ntz")
    return b.events.select("event_id", elapsed_seconds(at, F.lit("2024-02-01").cast("timestamp_ntz")).alias("whole"),
                           F.date_format(display_time(at, "America/Caracas"), "yyyy-MM-dd HH:mm").alias("shown"))
