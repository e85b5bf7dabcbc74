"""Listings, nested details, feeds and map features."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from marquesina.functions.dates import FUTURE_DAYS
from marquesina.functions.text import blank_to_null

# Marker colours by emoji with the default, and the pin used where none is set.
DEFAULT_COLOUR = "#444"
DEFAULT_PIN = "📍"


def active(df: DataFrame, include_deleted: bool = False) -> DataFrame:
    """Rows that are not soft-deleted (B1)."""
    return df if include_deleted else df.filter(F.col("deleted_at").isNull())


def upcoming_ids(occurrences: DataFrame, today: Column, days: int | None = None) -> DataFrame:
    """Ids of events with an occurrence from today on, at most ``days`` ahead."""
    start = F.col("start_date")
    window = start >= today if days is None else start.between(today, F.date_add(today, days))
    return occurrences.filter(window).select(F.col("event_id").alias("id"))


def next_dates(occurrences: DataFrame, today: Column) -> DataFrame:
    """First date from today on per event."""
    return occurrences.filter(F.col("start_date") >= today).groupBy("event_id").agg(F.min("start_date").alias("next_date"))


def listing_filter(
    events: DataFrame, occurrences: DataFrame, today: Column, upcoming: bool = False,
    location_id: int | None = None, status: str | None = None, include_deleted: bool = False,
) -> DataFrame:
    """The optional filters a page and its count share (B2)."""
    out = active(events, include_deleted)
    if location_id is not None:
        out = out.filter(F.col("location_id") == location_id)
    if status is not None:
        out = out.filter(F.col("status") == status)
    if upcoming:
        out = out.join(upcoming_ids(occurrences, today), "id", "left_semi")
    return out


def listing_page(events: DataFrame, occurrences: DataFrame, locations: DataFrame, today: Column, limit: int = 50, offset: int = 0) -> DataFrame:
    """Events with display venue and next date, earliest first, undated last."""
    venue = locations.select(
        F.col("id").alias("location_id"), F.coalesce("short_name", "name").alias("location_name"))
    rows = events.join(next_dates(occurrences, today), events["id"] == F.col("event_id"), "left").drop("event_id")
    page = rows.select("id", "name", "status", "location_id", "next_date").orderBy(
        F.col("next_date").asc_nulls_last(), "name", "id").offset(offset).limit(limit)
    # The page is cut before venues are looked up, so the join meets at most ``limit`` rows.
    return page.join(venue, "location_id", "left")


def search_name(df: DataFrame, text: str, column: str = "name") -> DataFrame:
    """Case-insensitive substring filter; % and _ in the text act as wildcards."""
    return df.filter(F.col(column).ilike(f"%{text}%")) if text else df


def with_count(df: DataFrame, children: DataFrame, key: str, parent: str, name: str) -> DataFrame:
    """Left join of a pre-aggregated child count, zero where there is none."""
    counts = children.groupBy(F.col(parent).alias(key)).agg(F.count("*").alias(name))
    return df.join(counts, key, "left").withColumn(name, F.coalesce(name, F.lit(0)))


def duplicate_groups(events: DataFrame) -> DataFrame:
    """Live (name, location) groups of more than one event with their lowest id."""
    return active(events).groupBy("name", "location_id").agg(
        F.count("*").alias("copies"), F.min("id").alias("first_id")).filter("copies > 1")


OCCURRENCE_ORDER = ["start_date", "start_time", "end_date", "end_time"]


def occurrence_text() -> Column:
    """An occurrence as one text, unknown parts as a dash."""
    return F.concat_ws(" ", *[F.coalesce(F.col(c).cast("string"), F.lit("-")) for c in OCCURRENCE_ORDER])


def details(heads: DataFrame, key: str, kind: str, children: dict[str, DataFrame]) -> DataFrame:
    """A parent's own row and a row for each of its children: key, kind, item, and the parent's columns (C11).

    ``children``: kind to (key, item) rows. Consumers read them in the order key, kind, item. A parent
    with very many children is many short rows, never one row that has to fit into a task.
    """
    out = heads.select(key, F.lit(kind).alias("kind"), F.lit(None).cast("string").alias("item"), *[c for c in heads.columns if c != key])
    for name, rows in children.items():
        out = out.unionByName(rows.select(key, F.lit(name).alias("kind"), "item"), allowMissingColumns=True)
    return out


def _items(rows: DataFrame, item: Column, parent: str = "event_id") -> DataFrame:
    return rows.select(F.col(parent).alias("id"), item.alias("item"))


def event_details(events: DataFrame, occurrences: DataFrame, urls: DataFrame, tags: DataFrame, locations: DataFrame) -> DataFrame:
    """Events with venue, and their occurrences, urls and tags (C11)."""
    venue = locations.select(F.col("id").alias("location_id"), F.col("name").alias("location"), "lat", "lng")
    return details(events.join(venue, "location_id", "left").drop("location_id"), "id", "event", {
        "occurrence": _items(occurrences, occurrence_text()), "url": _items(urls, F.col("url")), "tag": _items(tags, F.col("tag"))})


def job_details(jobs: DataFrame, results: DataFrame, usage: DataFrame) -> DataFrame:
    """Crawl jobs with their results and usage summary (C11)."""
    total = usage.groupBy("crawl_job_id").agg(F.count("*").alias("calls"), F.sum("input_tokens").alias("i"), F.sum("output_tokens").alias("o"))
    summary = F.concat_ws(" ", F.col("calls").cast("string"), F.col("i").cast("string"), F.col("o").cast("string"))
    return details(jobs, "id", "job", {
        "result": _items(results, F.concat_ws(" ", F.col("id").cast("string"), F.col("source_id").cast("string"), "status"), "crawl_job_id"),
        "summary": _items(total, summary, "crawl_job_id")})


def location_details(locations: DataFrame, aliases: DataFrame, tags: DataFrame) -> DataFrame:
    """Locations with their alternate names and tags (C11)."""
    return details(locations, "id", "location", {"alias": _items(aliases, F.col("alternate_name"), "location_id"), "tag": _items(tags, F.col("tag"), "location_id")})


def source_details(sources: DataFrame, urls: DataFrame, configs: DataFrame) -> DataFrame:
    """Sources with their live urls and config (C11)."""
    config = F.concat_ws(" ", F.coalesce("crawl_mode", F.lit("-")), F.coalesce(F.col("crawl_frequency").cast("string"), F.lit("-")))
    return details(sources, "id", "source", {"url": _items(active(urls), F.col("url"), "source_id"), "config": _items(configs, config, "source_id")})


def feed_heads(events: DataFrame, occurrences: DataFrame, today: Column) -> DataFrame:
    """Active events with an occurrence in the next 90 days."""
    return active(events).filter("status = 'active'").join(upcoming_ids(occurrences, today, FUTURE_DAYS), "id", "left_semi")


def feed_events(
    events: DataFrame, occurrences: DataFrame, urls: DataFrame, tags: DataFrame, locations: DataFrame, today: Column,
) -> DataFrame:
    """Active events with an occurrence in the next 90 days, and all their occurrences."""
    shown = feed_heads(events, occurrences, today)
    keep = shown.select(F.col("id").alias("event_id"))
    child = lambda df: df.join(keep, "event_id", "left_semi")
    return event_details(
        shown.select("id", "location_id", "name", "short_name", "description", "emoji", "sublocation"),
        child(occurrences), child(urls), child(tags), locations)


def feed_locations(locations: DataFrame, tags: DataFrame) -> DataFrame:
    """Live locations with coordinates and their tags."""
    placed = active(locations).filter(F.col("lat").isNotNull() & F.col("lng").isNotNull())
    shown = tags.join(placed.select(F.col("id").alias("location_id")), "location_id", "left_semi")
    return details(placed, "id", "location", {"tag": _items(shown, F.col("tag"), "location_id")})


def existing_upcoming(events: DataFrame, occurrences: DataFrame, urls: DataFrame, tags: DataFrame, links: DataFrame, locations: DataFrame, today: Column) -> DataFrame:
    """Active events with upcoming occurrences: their sources, and occurrences as JSON, urls and tags.

    Children meet their event, never each other; a seven-table join would multiply them.
    """
    live = active(events).filter("status = 'active'")
    upcoming = occurrences.filter(F.col("start_date") >= today)
    first = upcoming.groupBy(F.col("event_id").alias("id")).agg(F.min("start_date").alias("first_date"))
    venue = locations.select(F.col("id").alias("location_id"), F.col("name").alias("location"))
    rows = live.join(first, "id").join(venue, "location_id", "left").select("id", "name", "description", "location", "sublocation", "first_date", "emoji")
    child = lambda df: df.join(rows.select(F.col("id").alias("event_id")), "event_id", "left_semi")
    return details(rows, "id", "event", {
        "source": _items(child(links.select("event_id", "source_id").distinct()), F.col("source_id").cast("string")),
        "occurrence": _items(child(upcoming), F.to_json(F.struct(*OCCURRENCE_ORDER))),
        "url": _items(child(urls.select("event_id", "url").distinct()), F.col("url")),
        "tag": _items(child(tags.select("event_id", "tag").distinct()), F.col("tag"))})


def marker_features(locations: DataFrame, location_keys: DataFrame, colours: DataFrame) -> DataFrame:
    """Icon, label and short-label feature per location with events."""
    rows = locations.join(location_keys.select("location_key").distinct(), "location_key", "left_semi").filter(
        (F.col("lat") != 0) | (F.col("lng") != 0)).join(colours, "emoji", "left")
    lat = F.col("lat").cast("double")
    label = F.coalesce(blank_to_null(F.col("short_name")), F.col("name"), F.lit(""))
    none = F.lit(None)
    feature = lambda kind, text, icon, short, key: F.struct(
        F.lit(kind).alias("kind"), text.alias("short_name"), icon.cast("string").alias("icon"),
        F.lit(short).alias("is_short_label"), key.alias("sort_key"))
    three = F.array(
        feature("icon", F.lit(""), F.concat(F.lit("emoji-"), F.coalesce("emoji", F.lit(DEFAULT_PIN))), False, F.lit(-10000.0) - lat),
        feature("label", label, none, False, F.lit(0.0) - lat),
        feature("short", F.coalesce("very_short_name", F.lit("")), none, True, F.lit(10000.0) - lat),
    )
    return rows.select(
        "location_key", "lat", "lng", F.coalesce("colour", F.lit(DEFAULT_COLOUR)).alias("colour"), F.explode(three).alias("f")
    ).select("location_key", "lat", "lng", "colour", "f.*")


def geojson_lines(features: DataFrame) -> DataFrame:
    """One GeoJSON feature per line, ready for a text sink."""
    props = F.struct(
        F.col("location_key").alias("locationKey"), F.col("short_name").alias("shortName"), F.col("icon").alias("emojiImageId"),
        F.col("colour").alias("color"), F.when(F.col("is_short_label"), True).alias("isShortLabel"), F.col("sort_key").alias("sortKey"))
    return features.select("sort_key", F.to_json(F.struct(
        F.lit("Feature").alias("type"),
        F.struct(F.lit("Point").alias("type"), F.array(F.col("lng").cast("double"), F.col("lat").cast("double")).alias("coordinates")).alias("geometry"),
        props.alias("properties"))).alias("value"))


def document_lines(lines: DataFrame, order: list[str], head: str, tail: str) -> DataFrame:
    """Lines (place, copy, value) that, read in order of place, copy and text, are one document.

    ``lines``: value (JSON text) and the columns of ``order``. The first element has no comma before it, all others
    have; equal lines are numbered, so that just one of them can be first. No lines make an empty list.
    """
    place = F.struct(*[F.col(c) for c in order], "value")
    counted = lines.groupBy(*order, "value").agg(F.count("*").alias("n"))
    rows = counted.select(place.alias("at"), "value", F.explode(F.sequence(F.lit(1).cast("long"), "n")).alias("copy"))
    first = counted.agg(F.min(place).alias("first"))
    joined = rows.join(first, F.lit(True))
    body = joined.select(
        F.lit(1).alias("part"), "at", "copy",
        F.when((F.col("at") == F.col("first")) & (F.col("copy") == 1), F.col("value")).otherwise(F.concat(F.lit(","), "value")).alias("value"))
    edge = lambda part, text: first.select(F.lit(part).alias("part"), F.lit(None).cast(body.schema["at"].dataType).alias("at"), F.lit(1).cast("long").alias("copy"), F.lit(text).alias("value"))
    return body.unionByName(edge(0, head)).unionByName(edge(2, tail))
