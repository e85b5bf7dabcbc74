"""Operational counts and series."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame, functions as F

# Hours after which a running job counts as stuck, and prices per million tokens.
STUCK_HOURS = 2
INPUT_PRICE = Decimal("0.10")
OUTPUT_PRICE = Decimal("0.40")


def token_cost(input_tokens: Column, output_tokens: Column) -> Column:
    """Cost at six decimals, half up on the exact decimal."""
    def price(tokens: Column, per_million: Decimal) -> Column:
        return tokens.cast("decimal(20,0)") * F.lit(per_million / 1_000_000).cast("decimal(10,8)")
    return F.round(price(input_tokens, INPUT_PRICE) + price(output_tokens, OUTPUT_PRICE), 6).cast("double")


def job_split(jobs: DataFrame, now: Column) -> DataFrame:
    """Running jobs younger and older than the limit."""
    limit = now - F.make_dt_interval(hours=F.lit(STUCK_HOURS))
    return jobs.filter("status = 'running'").agg(
        F.count_if(F.col("started_at") >= limit).alias("active"), F.count_if(F.col("started_at") < limit).alias("stuck")
    )


def recent_failures(results: DataFrame, limit: int) -> DataFrame:
    """Latest failed results that carry a message."""
    failed = results.filter((F.col("status") == "failed") & F.col("error_message").isNotNull())
    return failed.orderBy(F.col("created_at").desc_nulls_first(), "id").limit(limit)


def source_counts(sources: DataFrame) -> DataFrame:
    return sources.filter("deleted_at IS NULL").agg(
        F.count("*").alias("total"), F.count_if(~F.col("disabled")).alias("active"), F.count_if(F.col("disabled")).alias("disabled")
    )


def usage_since(usage: DataFrame, since: Column) -> DataFrame:
    """Coalesced sums of calls, tokens and cost."""
    zero = F.lit(0)
    sums = usage.filter(F.col("created_at") >= since).agg(
        F.count("*").alias("api_calls"),
        F.coalesce(F.sum("input_tokens"), zero).alias("input_tokens"),
        F.coalesce(F.sum("output_tokens"), zero).alias("output_tokens"),
    )
    return sums.withColumn("cost", token_cost(F.col("input_tokens"), F.col("output_tokens")))


def hourly_series(df: DataFrame, at: str, now: Column, measures: dict[str, Column]) -> DataFrame:
    """24 zero-filled hourly buckets, the last one the current hour, keyed by the full hour."""
    spark = df.sparkSession
    spine = spark.range(24).select(
        F.col("id").cast("int").alias("bucket"),
        (F.date_trunc("hour", now) - F.make_dt_interval(hours=(F.lit(23) - F.col("id")).cast("int"))).cast("timestamp_ntz").alias("hour"),
    )
    recent = df.filter(F.col(at) >= now - F.make_dt_interval(hours=F.lit(24)))
    sums = recent.groupBy(F.date_trunc("hour", at).cast("timestamp_ntz").alias("hour")).agg(*[m.alias(n) for n, m in measures.items()])
    # The series has at most 25 hours, so the spine side decides the join.
    return spine.join(sums, "hour", "left").select("bucket", *[F.coalesce(n, F.lit(0)).alias(n) for n in measures])


def usage_totals(usage: DataFrame, keys: list[str]) -> DataFrame:
    """Sums, per-provider counts as a map and the most used provider, per key."""
    by_provider = usage.groupBy(*keys, "provider").agg(
        F.count("*").alias("n"), F.sum("input_tokens").alias("i"), F.sum("output_tokens").alias("o")
    )
    totals = by_provider.groupBy(*keys).agg(
        F.sum("n").alias("api_calls"), F.sum("i").alias("input_tokens"), F.sum("o").alias("output_tokens"),
        F.map_from_entries(F.collect_list(F.struct("provider", "n"))).alias("providers"),
        F.min_by("provider", F.struct(-F.col("n"), "provider")).alias("primary_provider"),
    )
    return totals.withColumn("cost", token_cost(F.col("input_tokens"), F.col("output_tokens")))


def status_counters(rows: DataFrame, statuses: list[str], column: str = "status") -> DataFrame:
    """One row of counts, one column per status."""
    return rows.agg(*[F.count_if(F.col(column) == s).alias(s) for s in statuses])


def backlog(results: DataFrame) -> DataFrame:
    """Jobs that hold extracted results and how many."""
    waiting = results.filter((F.col("status") == "extracted") & F.col("crawl_job_id").isNotNull())
    return waiting.groupBy("crawl_job_id").agg(F.count("*").alias("waiting"))


def count_since(rows: DataFrame, at: str, since: Column) -> DataFrame:
    return rows.filter(F.col(at) >= since).agg(F.count("*").alias("n"))
