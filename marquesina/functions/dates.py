"""Date and time expressions (I1-I12). ``today`` and ``now`` are always parameters."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, functions as F

from marquesina.functions.text import blank_to_null, let, strip

# Horizons in days, the hour before which a night still counts as the day before,
# and the zone events are listed in.
FUTURE_DAYS = 90
RECENT_DAYS = 10
GRACE_DAYS = 14
NIGHT_CUTOFF_HOUR = 5
EVENT_ZONE = "America/Caracas"
OFFSET_HOURS = -4


def parse_date(text: Column) -> Column:
    """Year-month-day with one or two digits, else null; impossible dates are null."""
    whole = F.when(text.rlike(r"^\d{4}-\d{1,2}-\d{1,2}$"), text)
    return F.try_to_timestamp(whole, F.lit("y-M-d")).cast("date")


def parse_time_text(text: Column) -> Column:
    """Trimmed text or null."""
    return blank_to_null(strip(text))


def clock(text: Column) -> Column:
    """Struct of hours and minutes from free text, noon when there is none to read (I4).

    Every step is bound, so that a pattern runs once a text however often its result is used.
    """
    shape = r"^\s*(\d+)\s*(?::\s*(\d*)\s*(?::.*)?)?$"

    def read(low: Column) -> Column:
        part = lambda bare, n: F.regexp_extract(bare, shape, n).try_cast("int")
        return let(let(F.regexp_replace(low, "am|pm", ""), lambda bare: F.struct(part(bare, 1).alias("hour"), part(bare, 2).alias("minute"))), lambda p: put(low, p["hour"], p["minute"]))

    def put(low: Column, hour: Column, minute: Column) -> Column:
        shift = F.when(F.contains(low, F.lit("pm")), F.when(hour < 12, 12).otherwise(0)).when(
            F.contains(low, F.lit("am")) & (hour == 12), -12).otherwise(0)
        return F.struct(
            F.coalesce(hour + shift, F.lit(12)).alias("hours"),
            F.when(hour.isNull(), 0).otherwise(F.coalesce(minute, F.lit(0))).alias("minutes"))

    return let(F.lower(text), read)


def event_instant(date_text: Column, time_text: Column) -> Column:
    """Instant of a listed date and time in the fixed offset of the events."""
    return day_instant(F.when(date_text.rlike(r"^\d{4}-\d{2}-\d{2}$"), date_text).try_cast("date"), time_text)


def day_instant(day: Column, time_text: Column) -> Column:
    """The same for a date that is one already; no text is made of it."""
    def seconds(at: Column) -> Column:
        hours, minutes = at["hours"], at["minutes"]
        return F.when((hours < 24) & (minutes < 60), hours * 3600 + minutes * 60)
    return F.timestamp_seconds(F.unix_date(day).cast("long") * 86400 - OFFSET_HOURS * 3600 + let(clock(time_text), seconds))


def parse_listed_occurrences(raw: Column) -> Column:
    """Arrays of (date, time, end date, end time) texts to instants, sorted by start."""
    def parse(o: Column) -> Column:
        start = event_instant(o["start_date"], o["start_time"])
        end = event_instant(
            F.coalesce(parse_time_text(o["end_date"]), o["start_date"]),
            F.coalesce(parse_time_text(o["end_time"]), o["start_time"]),
        )
        return F.struct(
            start.alias("start"), F.coalesce(end, start).alias("end"),
            o["start_time"].alias("start_text"), o["end_time"].alias("end_text"),
        )
    return F.array_sort(F.filter(F.transform(F.coalesce(raw, F.array()), parse), lambda o: o["start"].isNotNull()))


def local(at: Column) -> Column:
    """Wall-clock time in the event zone."""
    return F.from_utc_timestamp(at, EVENT_ZONE)


def effective_end(start: Column, end: Column) -> Column:
    """An end before 05:00 of another day counts as the last instant of the day before."""
    return let(F.struct(start.alias("start"), end.alias("end")), lambda t: effective_end_of(t["start"], t["end"]))


def effective_end_of(start: Column, end: Column) -> Column:
    """The same where both are stored columns: nothing has to be bound, so the zone is looked up once, not once a row."""
    wall = local(end)
    overnight = (F.to_date(local(start)) != F.to_date(wall)) & (F.hour(wall) < NIGHT_CUTOFF_HOUR)
    day_before = F.to_utc_timestamp(F.date_trunc("day", wall), EVENT_ZONE) - F.expr("interval 1 millisecond")
    return F.when(overnight, day_before).otherwise(end)


def filter_bounds(start: dt.date | None, end: dt.date | None, app_start: dt.date, app_end: dt.date) -> tuple[Column, Column]:
    """Filter instants: application range by default, the end through its last millisecond."""
    first, last = start or app_start, end or app_end
    floor = F.to_utc_timestamp(F.lit(first.isoformat()).cast("timestamp"), EVENT_ZONE)
    ceiling = F.to_utc_timestamp(F.lit((last + dt.timedelta(days=1)).isoformat()).cast("timestamp"), EVENT_ZONE)
    return floor, ceiling - F.expr("interval 1 millisecond")


def resolve_url_template(url: Column, now: Column) -> Column:
    """Fill month and year placeholders; next month rolls over the year (I8)."""
    following = F.add_months(F.trunc(now, "month"), 1)
    for mark, value in [
        ("{{month}}", F.lower(F.date_format(now, "MMMM"))),
        ("{{year}}", F.year(now).cast("string")),
        ("{{next_month}}", F.lower(F.date_format(following, "MMMM"))),
        ("{{next_month_year}}", F.year(following).cast("string")),
    ]:
        url = F.replace(url, F.lit(mark), value)
    return url


def twelve_hour(text: Column) -> Column:
    """``HH:MM`` to ``h:MM AM``; other text unchanged."""
    valid = text.rlike(r"^([01]?\d|2[0-3]):[0-5]?\d$")
    at = F.try_to_timestamp(F.when(valid, F.concat(F.lit("2000-01-01 "), text)), F.lit("y-M-d H:m"))
    return F.coalesce(F.date_format(at, "h:mm a"), text)


def compact_clock(at: Column) -> Column:
    """``7pm`` or ``7:30pm`` in the event zone."""
    return F.lower(F.replace(F.replace(F.date_format(local(at), "h:mm a"), F.lit(":00")), F.lit(" ")))


def _day(at: Column) -> Column:
    return F.date_format(local(at), "MMM d")


def _given(text: Column) -> Column:
    return F.coalesce(F.length(strip(text)) > 0, F.lit(False))


def _label_parts(o: Column) -> Column:
    """The texts a label is put together from; a time is null where none was given."""
    return F.struct(
        F.to_date(o["start"]).alias("day"), _day(o["start"]).alias("start_day"), _day(o["end"]).alias("end_day"),
        (F.to_date(local(o["start"])) == F.to_date(local(o["end"]))).alias("one_day"),
        F.when(_given(o["start_text"]), compact_clock(o["start"])).alias("start"),
        F.when(_given(o["end_text"]), compact_clock(o["end"])).alias("end"))


def _span(p: Column) -> Column:
    return F.when(p["start"] != p["end"], F.concat(p["start"], F.lit("–"), p["end"])).otherwise(p["start"])


def single_label(o: Column) -> Column:
    """Label of one occurrence."""
    def put(p: Column) -> Column:
        after = lambda c: F.coalesce(F.concat(F.lit(", "), c), F.lit(""))
        return F.when(p["one_day"], F.concat(p["start_day"], after(_span(p)))).otherwise(
            F.concat(p["start_day"], after(p["start"]), F.lit(" – "), p["end_day"], after(p["end"])))
    return let(_label_parts(o), put)


def multiple_label(occurrences: Column) -> Column:
    """Label of several occurrences, grouped by date with distinct times in order."""
    def put(dated: Column) -> Column:
        def group(day: Column) -> Column:
            inside = F.filter(dated, lambda p: p["day"] == day)
            times = F.transform(inside, lambda p: F.when(p["one_day"], _span(p)).otherwise(p["start"]))
            listed = F.array_distinct(F.filter(times, lambda t: t.isNotNull()))
            label = F.get(inside, F.lit(0))["start_day"]
            return let(listed, lambda t: F.when(F.size(t) > 0, F.concat(label, F.lit(": "), F.array_join(t, ", "))).otherwise(label))
        return F.array_join(F.transform(F.array_distinct(F.transform(dated, lambda p: p["day"])), group), "; ")
    return let(F.transform(occurrences, _label_parts), put)


def occurrence_label(occurrences: Column) -> Column:
    return (
        F.when(F.coalesce(F.size(occurrences), F.lit(0)) == 0, "Date/Time N/A")
        .when(F.size(occurrences) == 1, single_label(F.get(occurrences, F.lit(0))))
        .otherwise(multiple_label(occurrences))
    )


def elapsed_seconds(start: Column, end: Column) -> Column:
    """Whole seconds between two times."""
    return F.timestamp_diff("SECOND", start, end)


def display_time(at_utc: Column, zone: str) -> Column:
    """UTC wall time as local wall time."""
    return F.convert_timezone(F.lit("UTC"), F.lit(zone), at_utc)


def whole_days_between(earlier: Column, later: Column) -> Column:
    """Complete 24-hour days, as an interval's day part counts them."""
    return F.floor(F.timestamp_diff("SECOND", earlier, later) / 86400)
