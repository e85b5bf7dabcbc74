"""Facet filters, tag statistics, viewport and ranked search."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, functions as F

from marquesina.functions import geo as G
from marquesina.functions.dates import effective_end
from marquesina.functions.text import decode_entities, display_name, emphasis_to_tags, is_country_flag, normalize_for_search
from marquesina.operators.search import TermIndex, keys_with
from marquesina.operators.skew import first_per_key, top_per_key
from marquesina.session import materialize

# Hidden results shown without a term, and the head start of ongoing events in days.
HIDDEN_LIMIT = 100
ONGOING_BOOST_SECONDS = 5 * 86_400


def split_states(states: dict[str, str]) -> tuple[list[str], list[str], list[str]]:
    """Selected (with implicit), required and forbidden tags of a state map."""
    of = lambda *kinds: [t for t, s in states.items() if s in kinds]
    return of("selected", "implicit"), of("required"), of("forbidden")


def locations_by_key(locations: DataFrame) -> DataFrame:
    """First location per coordinate key."""
    placed = locations.filter(F.col("lat").isNotNull() & F.col("lng").isNotNull()).withColumn(
        "location_key", G.location_key(F.col("lat"), F.col("lng")))
    return first_per_key(placed, ["location_key"], [F.col("id")])


def append_locations(held: DataFrame, more: DataFrame) -> DataFrame:
    """Add locations of new keys; a held key keeps its location."""
    return held.unionByName(locations_by_key(more).join(held.select("location_key"), "location_key", "left_anti"), allowMissingColumns=True)


def valid_feed_rows(rows: DataFrame, spans: DataFrame, app_start: Column, app_end: Column, windows: bool = False) -> DataFrame:
    """Rows the browser would keep, with text fields cleaned.

    ``spans``: event_id, start, end, one row per occurrence.
    """
    inside = spans.filter((F.col("start") <= app_end) & (F.col("end") >= app_start))
    out = rows.join(inside.select("event_id"), "event_id", "left_semi")
    for c in ("name", "location", "sublocation"):
        out = out.withColumn(c, decode_entities(F.col(c)))
    for c in ("location", "sublocation"):
        out = out.withColumn(c, F.when(F.col(c).startswith("None") | F.col(c).startswith("N/A"), "").otherwise(F.col(c)))
    out = out.filter((F.length("name") > 0) & F.col("lat").isNotNull() & F.col("lng").isNotNull())
    if windows:
        out = out.withColumn("emoji", F.when(is_country_flag(F.col("emoji")), F.coalesce("location_emoji", "emoji")).otherwise(F.col("emoji")))
    return out


def around_days(occurrences: DataFrame, first: dt.date, last: dt.date) -> DataFrame:
    """Occurrences whose plain dates come within a day of the range; this test can reach the scan.

    Where an end cannot be read the start stands for it, so the later of both days is tested.
    """
    day = dt.timedelta(days=1)
    return occurrences.filter((F.col("start_date") <= F.lit(last + day)) & (F.greatest("end_date", "start_date") >= F.lit(first - day)))


def overlapping(occurrences: DataFrame, start: Column, end: Column) -> DataFrame:
    """Occurrences, as instants, that overlap a range of instants."""
    return occurrences.filter((F.col("start") <= end) & (effective_end(F.col("start"), F.col("end")) >= start))


def in_date_range(events: DataFrame, occurrences: DataFrame, start: Column, end: Column) -> DataFrame:
    """Events with overlapping occurrences, which are counted and bounded.

    ``occurrences``: event_id, start, end as instants. The filter runs before any grouping.
    """
    hit = overlapping(occurrences, start, end)
    per_event = hit.groupBy("event_id").agg(
        F.count("*").alias("matching"), F.min("start").alias("first_start"), F.max("end").alias("last_end"))
    return events.join(per_event, "event_id")


def tag_bitmaps(index: DataFrame, marks: dict[str, list[str]]) -> DataFrame:
    """Per bucket of event ids one bitmap for each mark: the events that have any of its tags (G1).

    ``index``: (tag, event_id) rows. Only rows of the named tags are read, and each becomes a bit; a tag that most
    events have is one bit of each. Rows meet by bucket before they are aggregated, so that a bitmap is built once
    however the ids are dealt to files.
    """
    named = index.filter(F.col("tag").isin(sorted({t for tags in marks.values() for t in tags})))
    placed = named.select("tag", F.bitmap_bucket_number("event_id").alias("bucket"), F.bitmap_bit_position("event_id").alias("_bit")).repartition("bucket")
    return placed.groupBy("bucket").agg(*[F.bitmap_construct_agg(F.when(F.col("tag").isin(tags), F.col("_bit"))).alias(mark) for mark, tags in marks.items()])


def has_bit(bitmap: Column, event_id: Column) -> Column:
    """Whether the bitmap of the event's bucket has the event; false where there is no bitmap."""
    bit = F.bitmap_bit_position(event_id).cast("int")
    byte = F.conv(F.hex(F.substring(bitmap, F.shiftright(bit, 3) + 1, 1)), 16, 10).cast("int")
    return F.coalesce(F.getbit(byte, F.pmod(bit, F.lit(8))) == 1, F.lit(False))


def _marked(events: DataFrame, index: DataFrame, marks: dict[str, list[str]]) -> DataFrame:
    """Events with one boolean for each mark that has tags."""
    marks = {mark: tags for mark, tags in marks.items() if tags}
    if not marks:
        return events
    keyed = events.withColumn("bucket", F.bitmap_bucket_number("event_id")).join(tag_bitmaps(index, marks), "bucket", "left")
    return keyed.select(*events.columns, *[has_bit(F.col(mark), F.col("event_id")).alias(mark) for mark in marks])


def _all_of(tags: list[str]) -> dict[str, list[str]]:
    return {f"_all{k}": [tag] for k, tag in enumerate(sorted(set(tags)))}


def with_matching(events: DataFrame, index: DataFrame, states: dict[str, str]) -> DataFrame:
    """Add ``matching``: the tri-state predicate over an event's tags (B6), read from bitmaps of the named tags.

    ``index``: (tag, event_id) rows, so an event may have any number of tags.
    """
    selected, required, forbidden = split_states(states)
    every = _all_of(required)
    marked = _marked(events, index, {**every, "_some": [] if required else selected, "_bad": forbidden})
    ok = ~F.col("_bad") if forbidden else F.lit(True)
    for mark in every:
        ok = ok & F.col(mark)
    if selected and not required:
        ok = ok & F.col("_some")
    return marked.withColumn("matching", ok).select(*events.columns, "matching")


def tag_index(event_tags: DataFrame, events: DataFrame, location_tags: DataFrame) -> DataFrame:
    """(tag, event_id) postings over event and location tags."""
    own = event_tags.select("tag", "event_id")
    # Tags meet distinct locations first, then their events; only keys and tags are shuffled.
    venue = events.select("event_id", "location_id").join(location_tags, "location_id").select("tag", "event_id")
    return own.unionByName(venue).distinct()


def filter_by_tags(base: DataFrame, index: DataFrame, event_tags: DataFrame, all_events: DataFrame, states: dict[str, str], selected: list[str] | None = None) -> DataFrame:
    """Indexed tag filter.

    Required tags intersect and selected tags unite over all events, as the reference does; forbidden
    tags look at the event's own tags only.
    """
    chosen, required, forbidden = split_states(states)
    chosen = selected if selected is not None else chosen
    every = _all_of(required)
    found = base
    if required or chosen:
        found = _marked(all_events, index, {**every, "_some": [] if required else chosen})
        for mark in every or ["_some"]:
            found = found.filter(mark)
        found = found.select(*all_events.columns)
    if forbidden:
        found = _marked(found, event_tags, {"_bad": forbidden}).filter("NOT _bad").drop("_bad")
    return found


def tag_counts(index: DataFrame) -> DataFrame:
    """(tag, bucket, events): the size of each posting bitmap, one row per tag and bucket of ids."""
    bits = index.groupBy("tag", F.bitmap_bucket_number("event_id").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("event_id")).alias("_bits"))
    return bits.select("tag", "bucket", F.bitmap_count("_bits").alias("events"))


def locations_with_match(events: DataFrame, index: DataFrame, states: dict[str, str]) -> DataFrame:
    """Location keys with at least one matching event."""
    return with_matching(events, index, states).filter("matching").select("location_key").distinct()


def in_viewport(rows: DataFrame, corners: list[tuple[float, float]]) -> DataFrame:
    """Rows inside a quadrilateral; its bounding box is tested first and can reach the scan."""
    lat, lng = F.col("lat").cast("double"), F.col("lng").cast("double")
    lats, lngs = [c[0] for c in corners], [c[1] for c in corners]
    box = lat.between(min(lats), max(lats)) & lng.between(min(lngs), max(lngs))
    return rows.filter(box & G.in_quadrilateral(lat, lng, corners))


def with_distance(rows: DataFrame, centre: tuple[float, float]) -> DataFrame:
    """Distance of every row from the centre."""
    return rows.withColumn("distance", G.haversine_m(F.lit(centre[0]), F.lit(centre[1]), F.col("lat").cast("double"), F.col("lng").cast("double")))


# Tag statistics.


def tag_frequencies(event_tags: DataFrame, location_tags: DataFrame) -> DataFrame:
    """Distinct locations per tag over (tag, location_key) pairs of both kinds."""
    pairs = event_tags.select("tag", "location_key").unionByName(location_tags.select("tag", "location_key"))
    return pairs.distinct().groupBy("tag").agg(F.count("*").alias("frequency"))


def dynamic_frequencies(known: DataFrame, event_tags: DataFrame) -> DataFrame:
    """Distinct locations per known tag over the filtered events, zero by default."""
    counts = event_tags.select("tag", "location_key").distinct().groupBy("tag").agg(F.count("*").alias("frequency"))
    return known.join(counts, "tag", "left").withColumn("frequency", F.coalesce("frequency", F.lit(0)))


def visible_frequencies(event_tags: DataFrame) -> DataFrame:
    """Sum of 1 plus nearness over visible events, from (tag, distance) rows."""
    weight = 1 + F.greatest(F.lit(0.0), 1 - F.col("distance") / G.PROXIMITY_REACH_M)
    return event_tags.groupBy("tag").agg(F.sum(weight).alias("frequency"))


def tag_universe(event_tags: DataFrame, location_tags: DataFrame) -> DataFrame:
    return event_tags.select("tag").union(location_tags.select("tag")).distinct().orderBy("tag")


def events_by_location(events: DataFrame) -> DataFrame:
    """(location_key, event_id) postings; a crowded key has many rows, not a long one."""
    return events.select("location_key", "event_id")


# Ranking.


def tag_hits(tags: DataFrame, key: str, wanted: list[str], name: str) -> DataFrame:
    """Number of wanted tags per key."""
    return tags.filter(F.col("tag").isin(wanted)).groupBy(key).agg(F.count("*").cast("int").alias(name))


def popup_order(
    events: DataFrame, index: DataFrame, event_tags: DataFrame, location_tags: DataFrame, states: dict[str, str], reference: Column, forced: int | None = None,
) -> DataFrame:
    """Events per location: the forced one, then matching, then matched tags, then nearness in time.

    ``events``: location_key, location_id, event_id, start, end. The order is a distributed sort, so a
    crowded location needs no task of its own.
    """
    selected, _, _ = split_states(states)
    rows = with_matching(events, index, states)
    rows = rows.join(tag_hits(event_tags, "event_id", selected, "_own"), "event_id", "left").join(tag_hits(location_tags, "location_id", selected, "_place"), "location_id", "left")
    away = F.abs(F.unix_seconds("start") - F.unix_seconds(reference))
    ongoing = (F.col("start") <= reference) & (F.col("end") >= reference)
    hits = F.coalesce("_own", F.lit(0)) + F.coalesce("_place", F.lit(0))
    out = rows.withColumn("tag_count", F.when(F.col("matching"), hits).otherwise(0)).withColumn(
        "away", F.when(ongoing, F.greatest(F.lit(0), away - ONGOING_BOOST_SECONDS)).otherwise(away)
    ).withColumn("forced", F.lit(False) if forced is None else F.col("event_id") == forced).drop("_own", "_place")
    return out.orderBy("location_key", F.col("forced").desc(), F.col("matching").desc(), F.col("tag_count").desc(), "away", "event_id")


def tag_scores(index: DataFrame, key: str, weights: dict[str, float]) -> DataFrame:
    """Sum of the weights of the weighted tags per key (J7); ``index`` has each (tag, key) once."""
    named = index.filter(F.col("tag").isin(list(weights)))
    return named.groupBy(key).agg(F.sum(G.tag_weight(F.col("tag"), weights)).alias("tag_score"))


def score_items(items: DataFrame, kind: str, label: Column) -> DataFrame:
    """Result rows of locations or events from matching, visible, distance, tag_score."""
    score = G.item_score(F.col("matching"), F.col("visible"), F.col("distance"), F.col("tag_score"))
    return items.select(F.lit(kind).alias("type"), F.col("ref"), label.alias("shown"), "emoji", score.alias("score"), "visible")


def location_results(locations: DataFrame, index: TermIndex, term: str) -> DataFrame:
    """Scored locations whose name, short name or tags, taken together, have the term."""
    return score_items(_candidates(locations, index, term), "location", display_name(F.col("short_name"), F.col("name")))


def event_results(events: DataFrame, index: TermIndex, term: str) -> DataFrame:
    label = emphasis_to_tags(decode_entities(display_name(F.col("short_name"), F.col("name"))))
    return score_items(_candidates(events, index, term), "event", F.regexp_replace(label, "</?em>", ""))


def _candidates(items: DataFrame, index: TermIndex, term: str) -> DataFrame:
    """Items that the index of their ``ref`` names for the term, or without one all visible and the first hidden matching items."""
    if term:
        return items.join(keys_with(index, term).withColumnRenamed("key", "ref"), "ref", "left_semi")
    hidden = top_per_key(
        items.filter(F.col("matching") & ~F.col("visible")).withColumn("_all", F.lit(1)), ["_all"], [F.col("ref")], HIDDEN_LIMIT)
    return items.filter("visible").unionByName(hidden.drop("_all", "rank"))


def tag_results(tags: DataFrame, term: str, geotags: list[str]) -> DataFrame:
    """Scored tags from (tag, dynamic, visible_frequency, total)."""
    norm, needle = normalize_for_search(F.col("tag")), normalize_for_search(F.lit(term))
    found = tags.filter(F.contains(norm, needle))
    if not term:
        found = found.filter(~F.lower("tag").isin([g.lower() for g in geotags]))
    seen = F.coalesce("visible_frequency", F.lit(0.0))
    return found.select(
        F.lit("tag").alias("type"), F.col("tag").alias("ref"), F.col("tag").alias("shown"), F.lit(None).cast("string").alias("emoji"),
        G.tag_score(F.col("dynamic"), norm == needle, seen, F.col("total")).alias("score"), (seen > 0).alias("visible"))


def ranked(results: DataFrame, term: str, selected_location: str | None, states: dict[str, str]) -> DataFrame:
    """Groups in order: shown before hidden, the selected location first, then by score."""
    closed = [t for t, s in states.items() if s not in ("unselected", "implicit")]
    kept = results.filter((F.col("type") != "tag") | ~F.col("ref").isin(closed)) if closed else results
    hidden = F.lit(False) if term.strip() else ~F.col("visible")
    first = (F.col("type") == "location") & (F.col("ref") == F.lit(selected_location)) & ~hidden
    return kept.withColumn("hidden", hidden).withColumn("picked", F.coalesce(first, F.lit(False))).orderBy(
        "type", "hidden", F.col("picked").desc(), F.col("score").desc(), "ref")


def nearest_feature(points: DataFrame, features: DataFrame, size: float) -> DataFrame:
    """Nearest feature of each point, the lower key on a tie (F10); null where the point or every feature has no place.

    Features lie in square cells of ``size`` degrees; a point meets the features of the cells around it.
    What it finds is certain once it is no farther than the rim of the cells searched, otherwise the point
    goes on with cells twice as wide. Each round works on the points still open and on features by cell; all
    points are settled at the latest when a cell is as wide as the farthest feature is away.
    """
    points = points.select("point_id", "lat", "lng")
    features = features.filter("at_lat IS NOT NULL AND at_lng IS NOT NULL")
    placed = "lat IS NOT NULL AND lng IS NOT NULL"
    nowhere = points if features.isEmpty() else points.filter(f"NOT ({placed})")
    found = nowhere.select("point_id", F.lit(None).cast(features.schema["location_key"].dataType).alias("location_key"))
    if features.isEmpty():
        return found
    points = points.filter(placed)
    while True:
        cell = lambda c: F.floor(F.col(c) / size).cast("long")
        held = features.select("location_key", "at_lat", "at_lng", cell("at_lat").alias("cy"), cell("at_lng").alias("cx"))
        steps = F.array(*[F.struct(F.lit(y).alias("dy"), F.lit(x).alias("dx")) for y in (-1, 0, 1) for x in (-1, 0, 1)])
        around = points.withColumn("s", F.explode(steps)).select("point_id", "lat", "lng", (cell("lat") + F.col("s.dy")).alias("cy"), (cell("lng") + F.col("s.dx")).alias("cx"))
        d = F.pow(F.col("lng") - F.col("at_lng"), F.lit(2)) + F.pow(F.col("lat") - F.col("at_lat"), F.lit(2))
        best = around.join(held, ["cy", "cx"]).groupBy("point_id").agg(F.min(F.struct(d.alias("d"), F.col("location_key"))).alias("m"))
        seen = materialize(points.join(best, "point_id", "left"), "nearest")
        found = found.unionByName(seen.filter(F.col("m.d") <= size * size).select("point_id", F.col("m.location_key").alias("location_key")))
        points = seen.filter(F.col("m").isNull() | (F.col("m.d") > size * size)).select("point_id", "lat", "lng")
        if points.isEmpty():
            return found
        size *= 2
