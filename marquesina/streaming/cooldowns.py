"""Cooldowns of hosts as a stream with state (N2); ``limits.cooldown_audit`` is the same over a table."""

from __future__ import annotations

import sys
from collections.abc import Iterator

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from marquesina.operators.crawl import COOLDOWN_SECONDS

OUT = "host long, seq long, cooling_until double, in_cooldown boolean"

# Workers need not find the package on their path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


class Cooldowns(StatefulProcessor):
    """Per host the requests the watermark has not passed yet, and the newest refusal before them.

    Requests are told in order of time once the watermark has passed them, so those that arrive late, but within
    the allowed lateness, are placed right. A timer stands at the earliest waiting request, or at the end of
    the cooldown when none waits; there the state of the host is dropped. What a host holds is bounded by its
    requests within the lateness. Rows of one moment are taken by ``seq``.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "at double, seq long, lasts double")
        self.refusal = handle.getValueState("refusal", "until double")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        first = None
        for part in rows:
            lasts = part["lasts"].astype(object).where(part["lasts"].notna(), None)
            self.waiting.appendList([(float(a), int(s), v) for a, s, v in zip(part["at"], part["seq"], lasts)])
            first = min(part["at"].min(), first if first is not None else float("inf"))
        if first is not None:
            self._wake(first)
        return iter([])

    def _wake(self, seconds: float) -> None:
        # Rounded up, so that the watermark has passed the moment when the timer rings.
        self.handle.registerTimer(int(-(-seconds * 1000 // 1)))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs()
        held = sorted(((r[0], r[1], r[2]) for r in self.waiting.get()), key=lambda r: r[:2]) if self.waiting.exists() else []
        until = self.refusal.get()[0] if self.refusal.exists() else None
        out = []
        ready = [r for r in held if r[0] * 1000 <= passed]
        for at, seq, lasts in ready:
            cooling = until is not None and at < until
            out.append((key[0], seq, until if cooling else None, cooling))
            if lasts is not None:
                until = at + lasts
        rest = held[len(ready):]
        if rest:
            self.waiting.put(rest)
            self._wake(rest[0][0])
        else:
            self.waiting.clear()
        if ready and until is not None:
            self.refusal.update((until,))
        if not rest and until is not None:
            if until * 1000 > passed:
                self._wake(until)
            else:
                self.refusal.clear()
        if out:
            frame = pd.DataFrame(out, columns=["host", "seq", "cooling_until", "in_cooldown"])
            yield frame.astype({"cooling_until": "float64"})

    def close(self) -> None:
        pass


def cooldown_stream(requests: DataFrame, lateness: str = "1 hour") -> DataFrame:
    """Requests that fall into a cooldown of their host, told once the watermark has passed them.

    ``requests``: host, seq, ts (timestamp), refused, retry_after. ``cooling_until`` is the end, in seconds, of the
    cooldown a request falls into, null for others. Needs the RocksDB state store.
    """
    lasts = F.when(F.col("refused"), F.greatest(F.coalesce("retry_after", F.lit(0.0)), F.lit(float(COOLDOWN_SECONDS))))
    rows = requests.withWatermark("ts", lateness).select(
        F.col("host").cast("long").alias("host"), F.col("seq").cast("long").alias("seq"), "ts", F.unix_micros("ts").cast("double").alias("at"), lasts.alias("lasts"))
    rows = rows.withColumn("at", F.col("at") / 1e6)
    return rows.groupBy("host").transformWithStateInPandas(Cooldowns(), OUT, "Append", "EventTime")
