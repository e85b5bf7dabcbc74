"""Source selection, crawl bookkeeping and request pacing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from marquesina.functions.dates import whole_days_between
from marquesina.functions.text import strip
from marquesina.operators.lifecycle import numbered
from marquesina.operators.skew import first_per_key, previous_value

# Crawl modes that need no url, default days between crawls, request gaps per tier
# in seconds, the shortest pause after a refusal, and the text limits.
URL_FREE_MODES = ["json_api", "instagram"]
DEFAULT_FREQUENCY = 7
TIER_GAPS = {1: 0.5, 2: 2.0, 3: 5.0}
COOLDOWN_SECONDS = 30.0
MIN_CONTENT = 500
MAX_CONTENT = 120_000
MAX_ERROR = 65_535


def or_default(c: Column, default) -> Column:
    """Null, zero and empty text all fall back (A5)."""
    empty = (c == "") if isinstance(default, str) else (c == 0)
    return F.when(c.isNull() | empty, F.lit(default)).otherwise(c)


def live_urls(urls: DataFrame) -> DataFrame:
    """(source_id, sort_order, id, url, js_code) of the live urls, read per source in this order (A4)."""
    return urls.filter("deleted_at IS NULL").select("source_id", "sort_order", "id", "url", "js_code")


def due_sources(
    sources: DataFrame, configs: DataFrame, urls: DataFrame, now: Column,
    source_ids: list[int] | None = None, tier: int | None = None,
) -> DataFrame:
    """Sources to crawl now (A1), from an id list (A2) or for one tier (A3), defaults filled (A5).

    Each comes with the number of its urls; the urls themselves stay rows (see :func:`live_urls`).
    """
    joined = sources.filter("deleted_at IS NULL").join(configs, sources["id"] == configs["source_id"]).drop("source_id")
    if source_ids:
        joined = joined.filter(F.col("id").isin(source_ids))
    else:
        joined = joined.filter(~F.col("disabled")).filter(
            F.col("crawl_after").isNull() | (F.col("crawl_after") <= F.to_date(now))
        )
        if tier is not None:
            joined = joined.filter(F.col("tier") == tier)
        else:
            rested = whole_days_between(F.col("last_crawled_at"), now) >= F.coalesce("crawl_frequency", F.lit(DEFAULT_FREQUENCY))
            joined = joined.filter(F.col("force_crawl") | F.col("last_crawled_at").isNull() | rested)
    counts = live_urls(urls).groupBy(F.col("source_id").alias("id")).agg(F.count("*").alias("n_urls"))
    with_urls = joined.join(counts, "id", "left")
    return with_urls.filter(F.col("n_urls").isNotNull() | F.col("crawl_mode").isin(URL_FREE_MODES)).select(
        "id", "name", or_default(F.col("tier"), 1).alias("tier"), "min_interval",
        or_default(F.col("crawl_frequency"), DEFAULT_FREQUENCY).alias("crawl_frequency"),
        or_default(F.col("num_clicks"), 2).alias("num_clicks"),
        or_default(F.col("max_pages"), 30).alias("max_pages"),
        or_default(F.col("crawl_mode"), "browser").alias("crawl_mode"),
        "notes", "force_crawl", "last_crawled_at",
        F.coalesce("n_urls", F.lit(0)).alias("n_urls"),
    )


def due_order(due: DataFrame) -> DataFrame:
    """Forced first, then longest unvisited, never visited before all (F2)."""
    return due.orderBy(F.col("force_crawl").desc_nulls_first(), F.col("last_crawled_at").asc_nulls_first(), "id")


def retry_scan(results: DataFrame, sources: DataFrame, jobs: DataFrame, contents: DataFrame, configs: DataFrame) -> DataFrame:
    """Results whose extraction can be tried again."""
    # Only whether a content exists is carried, never the text itself.
    flags = contents.select(
        F.col("crawl_result_id").alias("id"),
        F.col("crawled_content").isNotNull().alias("has_crawled"),
        F.col("extracted_content").isNotNull().alias("has_extracted"),
    )
    live = sources.filter(~F.col("disabled") & F.col("deleted_at").isNull()).select(F.col("id").alias("source_id"), "name")
    has = F.coalesce(F.col("has_crawled"), F.lit(False))
    return (
        results.filter(F.col("status").isin("crawled", "failed"))
        .join(live, "source_id")
        .join(jobs.select(F.col("id").alias("crawl_job_id"), "started_at"), "crawl_job_id")
        .join(flags, "id", "left")
        .join(configs.select("source_id", "notes"), "source_id", "left")
        .filter((F.col("status") == "crawled") | has)
        .select(
            F.col("id").alias("crawl_result_id"), F.col("status").alias("original_status"), "source_id", "crawl_job_id",
            "name", "notes", "started_at",
            F.when((F.col("status") == "failed") & has & ~F.coalesce(F.col("has_extracted"), F.lit(False)), "crawled")
            .otherwise(F.col("status")).alias("status"),
        )
    )


def stage_update(results: DataFrame, updates: DataFrame, now: Column) -> DataFrame:
    """Apply (id, new_status, new_error) to results: status, stage time, cut error text."""
    u = updates.select("id", "new_status", F.substring("new_error", 1, MAX_ERROR).alias("new_error"), F.lit(True).alias("hit"))
    out = results.join(u, "id", "left")
    status = F.coalesce("new_status", "status")
    stamped = lambda stage, old: F.when(F.col("new_status") == stage, now).otherwise(old)
    return out.select(
        "id", "crawl_job_id", "source_id", status.alias("status"),
        stamped("crawled", F.col("crawled_at") if "crawled_at" in results.columns else F.lit(None)).alias("crawled_at"),
        stamped("extracted", F.col("extracted_at") if "extracted_at" in results.columns else F.lit(None)).alias("extracted_at"),
        F.coalesce("new_error", "error_message").alias("error_message"),
    )


def mark_crawled(configs: DataFrame, crawled: DataFrame, now: Column) -> DataFrame:
    """Set the visit time and reset the force flag of visited sources."""
    hit = crawled.select("source_id").distinct().withColumn("hit", F.lit(True))
    out = configs.join(hit, "source_id", "left")
    was = F.coalesce("hit", F.lit(False))
    return out.withColumn("last_crawled_at", F.when(was, now).otherwise(F.col("last_crawled_at"))).withColumn(
        "force_crawl", F.when(was, F.lit(False)).otherwise(F.col("force_crawl"))
    ).drop("hit")


def size_gate(contents: DataFrame, text: str = "crawled_content") -> DataFrame:
    """Status, error and capped text by content length."""
    size = F.length(text)
    empty = F.coalesce(F.length(strip(F.col(text))) == 0, F.lit(True))
    small = size < MIN_CONTENT
    return contents.withColumn("content_size", F.coalesce(size, F.lit(0))).withColumn(
        "gate", F.when(empty | small, "failed").otherwise("crawled")
    ).withColumn(
        "gate_error",
        F.when(empty, "No content retrieved").when(
            small,
            F.format_string(
                f"Crawled content too small (%d bytes < {MIN_CONTENT} minimum) - likely failed to load page content", size
            ),
        ),
    ).withColumn("kept_text", F.when(~(empty | small), F.substring(text, 1, MAX_CONTENT)))


def request_gap(tier: Column, override: Column) -> Column:
    """Seconds between requests to a host: positive override, else by tier, unknown as tier 1."""
    table = F.create_map(*[F.lit(x) for pair in TIER_GAPS.items() for x in pair])
    return F.when(override > 0, override.cast("double")).otherwise(
        F.coalesce(table[F.coalesce(tier, F.lit(1)).cast("int")], F.lit(TIER_GAPS[1]))
    )


def request_plan(requests: DataFrame) -> DataFrame:
    """Per host the requests to make, the gap to keep and the seconds they need, from (host, gap)."""
    return requests.groupBy("host").agg(F.count("*").alias("requests"), F.max("gap").alias("gap"), F.sum("gap").alias("seconds"))


def gap_audit(requests: DataFrame, block: Column) -> DataFrame:
    """Time since the host's request before, and whether it fell short of the gap."""
    timed = previous_value(requests, ["host"], block, ["at", "seq"], F.col("at"), "previous_at")
    waited = F.col("at") - F.col("previous_at")
    return timed.withColumn("waited", waited).withColumn("too_soon", F.coalesce(waited < F.col("gap"), F.lit(False)))


def first_urls(urls: DataFrame) -> DataFrame:
    """First live url per source."""
    live = urls.filter("deleted_at IS NULL").select("source_id", "sort_order", "id", "url")
    return first_per_key(live, ["source_id"], [F.col("sort_order"), F.col("id")]).select("source_id", "url")


def new_rows(candidates: DataFrame, existing: DataFrame, key: str = "name") -> DataFrame:
    """Candidates whose lower-case trimmed key is not present yet, first of each key."""
    norm = F.lower(strip(F.col(key)))
    fresh = candidates.withColumn("_k", norm).join(existing.select(norm.alias("_k")).distinct(), "_k", "left_anti")
    return first_per_key(fresh, ["_k"], [F.col("id")]).drop("_k")


def url_conflicts(requested: DataFrame, urls: DataFrame) -> DataFrame:
    """Requested urls that exist already or are named twice in the request."""
    live = urls.filter("deleted_at IS NULL").select("url").distinct()
    counted = requested.groupBy("url").agg(F.count("*").alias("times"))
    taken = counted.join(live.withColumn("taken", F.lit(True)), "url", "left")
    return taken.select(
        "url", F.when(F.col("taken"), "exists").when(F.col("times") > 1, "repeated").otherwise("free").alias("verdict"), "times"
    )


def appended_urls(requested: DataFrame, urls: DataFrame) -> DataFrame:
    """Rows to append for requested (source_id, url) that are not live yet, each url once, ids following the last."""
    live = urls.filter("deleted_at IS NULL").select("url")
    fresh = requested.join(live, "url", "left_anti").groupBy("url").agg(F.min("source_id").alias("source_id"))
    last = urls.agg(F.max("id").alias("id")).scalar()
    return numbered(fresh, ["url"], 0, "place").select((F.coalesce(last, F.lit(0)) + F.col("place")).alias("id"), "source_id", "url")


def merge_config(old: DataFrame, change: DataFrame, columns: list[str]) -> DataFrame:
    """Partial update by source: given fields replace, missing ones stay (K7)."""
    new = change.select("source_id", *[F.col(c).alias(f"_new_{c}") for c in columns])
    joined = old.join(new, "source_id", "full")
    return joined.select(
        "source_id", *[F.coalesce(f"_new_{c}", c).alias(c) for c in columns], *[c for c in old.columns if c not in columns + ["source_id"]]
    )
