"""Load of call windows and host cooldowns, as batch jobs and as streams."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from marquesina.operators.crawl import COOLDOWN_SECONDS
from marquesina.operators.skew import running_max

# Requests allowed and window seconds by kind of call.
LOGIN, REGISTER, ADMIN, FEED = (5, 60), (3, 3600), (5, 60), (60, 60)


def window_load(requests: DataFrame, limit: tuple[int, int]) -> DataFrame:
    """Requests per key and time window, and how many of them pass the limit.

    ``requests``: key, at. Windows are aligned to the clock, so this is one combinable aggregate that also
    runs over a stream, where a watermark on ``at`` closes windows and drops their state.
    """
    allowed, seconds = limit
    counted = requests.groupBy("key", F.window("at", f"{seconds} seconds").alias("w")).agg(F.count("*").alias("requests"))
    return counted.select("key", F.col("w.start").alias("window_start"), "requests", F.greatest(F.col("requests") - allowed, F.lit(0)).alias("over"))


def cooldown_audit(requests: DataFrame, block: Column) -> DataFrame:
    """Requests that fall into a cooldown of their host.

    ``requests``: host, seq, at (seconds), refused, retry_after. A refusal starts a cooldown of at least
    30 seconds. The latest end so far is a running maximum: a later refusal ends no earlier unless a long
    one is still on, and then the newest one counts.
    """
    lasts = F.when(F.col("refused"), F.greatest(F.coalesce("retry_after", F.lit(0.0)), F.lit(COOLDOWN_SECONDS)))
    newest = F.when(F.col("refused"), F.struct("at", "seq", (F.col("at") + lasts).alias("until")))
    out = running_max(requests, ["host"], block, ["at", "seq"], newest, "_last")
    until = F.col("_last.until")
    return out.withColumn("cooling_until", until).withColumn("in_cooldown", F.coalesce(F.col("at") < until, F.lit(False))).drop("_last")
