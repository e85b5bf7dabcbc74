"""Queries over the feed: filters, tag statistics, viewport and ranked search."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from marquesina.functions import dates as DT, geo as G, text as T
from marquesina.operators import browse as S, search as X
from marquesina.plans.registry import query
from marquesina.session import materialize, work_dir
from marquesina.sources import cells as CL

# The tag choices, the viewport corners and the centre the queries run with.
SELECTED = {"promo": "selected", "AFRICA": "selected", "Brand#4": "forbidden"}
REQUIRED = {"small": "required", "Brand#7": "required", "Brand#9": "forbidden"}
QUAD = [(10.34, -67.08), (10.56, -67.02), (10.52, -66.74), (10.31, -66.80)]
CENTRE = (10.45, -66.90)
WEIGHTS = {"promo": 1.0, "AFRICA": 0.5, "Brand#7": 0.25}

def _edge_sql(i):
    (ya, xa), (yb, xb) = QUAD[i], QUAD[i - 1]
    return f"((({ya} > y) <> ({yb} > y)) AND x < ({xb} - ({xa})) * (y - {ya}) / ({yb - ya!r}) + ({xa}))"


IN_QUAD = f"(({_edge_sql(0)} <> {_edge_sql(1)}) <> ({_edge_sql(2)} <> {_edge_sql(3)}))"
HAV = "2 * 6371000 * atan2(sqrt(h), sqrt(1 - h))"
H = "pow(sin(radians(y - 10.45) / 2), 2) + cos(radians(10.45)) * cos(radians(y)) * pow(sin(radians(x + 66.90) / 2), 2)"
XY = "CAST(lat AS DOUBLE) AS y, CAST(lng AS DOUBLE) AS x"
ALL_TAGS = "(SELECT tag, event_id FROM {fev_tag} UNION SELECT t.tag, e.event_id FROM {fev} e JOIN {loc_tag} t ON t.location_id = e.location_id)"


def index(b):
    return S.tag_index(b.fev_tag, b.fev, b.loc_tag)


def instants(b, occurrences=None):
    start = DT.day_instant(F.col("start_date"), F.col("start_time"))
    end = DT.day_instant(F.coalesce("end_date", "start_date"), F.coalesce("end_time", "start_time"))
    return (b.occ if occurrences is None else occurrences).select("event_id", start.alias("start"), F.coalesce(end, start).alias("end"))


SPAN_SQL = """(SELECT *, start_date::TIMESTAMP + CASE start_time WHEN '7:30 PM' THEN INTERVAL 1410 MINUTE WHEN '19:00' THEN INTERVAL 1380 MINUTE ELSE INTERVAL 960 MINUTE END AS s,
  COALESCE(end_date, start_date)::TIMESTAMP + CASE COALESCE(end_time, start_time) WHEN '9:00 PM' THEN INTERVAL 1500 MINUTE WHEN '2:00 am' THEN INTERVAL 360 MINUTE
    WHEN '7:30 PM' THEN INTERVAL 1410 MINUTE WHEN '19:00' THEN INTERVAL 1380 MINUTE ELSE INTERVAL 960 MINUTE END AS e FROM {occ})"""
EFFECTIVE = """CASE WHEN (s - INTERVAL 4 HOUR)::DATE <> (e - INTERVAL 4 HOUR)::DATE AND hour(e - INTERVAL 4 HOUR) < 5
  THEN date_trunc('day', e - INTERVAL 4 HOUR) + INTERVAL 4 HOUR - INTERVAL 1 MILLISECOND ELSE e END"""


@query("b5_i7_events_in_date_range", f"""
SELECT f.event_id, COUNT(*) AS matching FROM {{fev}} f JOIN {SPAN_SQL} o ON o.event_id = f.event_id
WHERE o.s <= TIMESTAMP '1998-06-20 03:59:59.999' AND {EFFECTIVE} >= TIMESTAMP '1998-06-15 04:00:00' GROUP BY f.event_id""")
def _(b):
    start, end = DT.filter_bounds(dt.date(1998, 6, 15), dt.date(1998, 6, 19), dt.date(1998, 1, 1), dt.date(1998, 12, 31))
    return S.in_date_range(b.fev, instants(b, S.around_days(b.occ, dt.date(1998, 6, 15), dt.date(1998, 6, 19))), start, end).select("event_id", "matching")


@query("b5_matching_occurrences", f"""
SELECT f.event_id, strftime(o.s, '%Y-%m-%d %H:%M') AS start_utc, strftime(o.e, '%Y-%m-%d %H:%M') AS end_utc FROM {{fev}} f JOIN {SPAN_SQL} o ON o.event_id = f.event_id
WHERE o.s <= TIMESTAMP '1998-06-20 03:59:59.999' AND {EFFECTIVE} >= TIMESTAMP '1998-06-15 04:00:00'""")
def _(b):
    first, last = dt.date(1998, 6, 15), dt.date(1998, 6, 19)
    start, end = DT.filter_bounds(first, last, dt.date(1998, 1, 1), dt.date(1998, 12, 31))
    # A day's margin on the plain dates leaves few rows whose clock texts have to be read.
    near = S.around_days(b.occ, first, last)
    hit = S.overlapping(instants(b, near), start, end).join(b.fev.select("event_id"), "event_id")
    show = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm")
    return hit.select("event_id", show("start").alias("start_utc"), show("end").alias("end_utc"))


@query("b6_tag_state_predicate", f"""
SELECT event_id FROM {{fev}} WHERE event_id IN (SELECT event_id FROM {ALL_TAGS} WHERE tag IN ('promo', 'AFRICA'))
AND event_id NOT IN (SELECT event_id FROM {ALL_TAGS} WHERE tag = 'Brand#4')""")
def _(b):
    return S.with_matching(b.fev, index(b), SELECTED).filter("matching").select("event_id")


@query("b6_locations_with_match", f"""
SELECT DISTINCT location_key FROM {{fev}} WHERE event_id IN (SELECT event_id FROM {ALL_TAGS} WHERE tag = 'small') AND event_id IN (SELECT event_id FROM {ALL_TAGS} WHERE tag = 'Brand#7')
AND event_id NOT IN (SELECT event_id FROM {ALL_TAGS} WHERE tag = 'Brand#9')""")
def _(b):
    return S.locations_with_match(b.fev, index(b), REQUIRED)


@query("b7_g1_indexed_selected", f"""
SELECT event_id, name FROM {{fev}} WHERE event_id IN (SELECT event_id FROM {ALL_TAGS} WHERE tag IN ('promo', 'AFRICA'))
AND event_id NOT IN (SELECT event_id FROM {{fev_tag}} WHERE tag = 'Brand#4')""")
def _(b):
    return S.filter_by_tags(b.fev, index(b), b.fev_tag, b.fev, SELECTED).select("event_id", "name")


@query("b7_g2_indexed_required", f"""
SELECT event_id, name FROM {{fev}} WHERE event_id IN (SELECT event_id FROM {ALL_TAGS} WHERE tag = 'small') AND event_id IN (SELECT event_id FROM {ALL_TAGS} WHERE tag = 'Brand#7')
AND event_id NOT IN (SELECT event_id FROM {{fev_tag}} WHERE tag = 'Brand#9')""")
def _(b):
    return S.filter_by_tags(b.fev, index(b), b.fev_tag, b.fev, REQUIRED).select("event_id", "name")


@query("b8_geotag_filter", "SELECT e.event_id FROM {fev} e WHERE e.location_id IN (SELECT location_id FROM {loc_tag} WHERE tag IN ('ASIA', 'EUROPE'))")
def _(b):
    return b.fev.join(b.loc_tag.filter(F.col("tag").isin("ASIA", "EUROPE")), "location_id", "left_semi").select("event_id")


VIEWPORT = f"SELECT event_id, location_key FROM (SELECT event_id, location_key, {XY} FROM {{fev}}) WHERE {IN_QUAD}"


@query("b9_j2_viewport", VIEWPORT)
def _(b):
    return S.in_viewport(b.fev, QUAD).select("event_id", "location_key")


@query("b9_stored_viewport", VIEWPORT)
def _(b):
    """Events written in order of their cells; the view reads the ranges of cells it covers."""
    folder = work_dir(b.spark, "points")
    CL.write_points(b.fev.select("event_id", "location_key", "lat", "lng"), "lat", "lng", folder)
    lats, lngs = [c[0] for c in QUAD], [c[1] for c in QUAD]
    near = CL.read_box(b.spark, folder, (min(lats), min(lngs)), (max(lats), max(lngs)))
    return S.in_viewport(near, QUAD).select("event_id", "location_key")


@query("b10_city_box", f"SELECT id, y BETWEEN 10.35 AND 10.55 AND x BETWEEN -67.05 AND -66.75 AS inside FROM (SELECT id, {XY} FROM {{loc}})")
def _(b):
    return b.loc.select("id", G.in_city(F.col("lat").cast("double"), F.col("lng").cast("double")).alias("inside"))


@query("b12_valid_feed_rows", f"""
SELECT f.event_id, f.location, CASE WHEN starts_with(f.sublocation, 'N/A') THEN '' ELSE f.sublocation END AS sublocation FROM {{fev}} f
WHERE f.event_id IN (SELECT event_id FROM {SPAN_SQL} WHERE s <= TIMESTAMP '1998-12-31 00:00:00' AND e >= TIMESTAMP '1998-01-01 00:00:00')""")
def _(b):
    at = lambda d: F.lit(d).cast("timestamp")
    near = S.around_days(b.occ, dt.date(1998, 1, 1), dt.date(1998, 12, 31))
    return S.valid_feed_rows(b.fev, instants(b, near), at("1998-01-01"), at("1998-12-31")).select("event_id", "location", "sublocation")


# The text of a place: name, short name and its tags in order.
PLACE_TEXT = "lower(concat_ws(' ', l.name, l.short_name, (SELECT string_agg(tag, ' ' ORDER BY tag) FROM (SELECT DISTINCT tag FROM {place_tag} t WHERE t.location_key = p.location_key))))"
EVENT_TEXT = "lower(concat_ws(' ', name, short_name, description, location, sublocation))"


def place_index(b):
    return X.build_index(X.place_texts(S.locations_by_key(b.loc), b.place_tag))


def event_index(b):
    return X.build_index(X.event_texts(b.fev))


def term_filter(term):
    return f"""
SELECT event_id FROM {{fev}} WHERE location_key IN (
  SELECT location_key FROM {{fev}} WHERE {EVENT_TEXT} LIKE '%{term}%'
  UNION SELECT location_key FROM (SELECT p.location_key, {PLACE_TEXT} AS txt FROM {{place}} p JOIN {{loc}} l ON l.id = p.id) WHERE txt LIKE '%{term}%')"""


@query("b13_search_term_filter", term_filter("urgent show 3"))
def _(b):
    return X.events_of_term(b.fev, place_index(b), event_index(b), "Urgent Show 3").select("event_id")


@query("b13_term_of_a_tag_only", term_filter("middle east"))
def _(b):
    return X.events_of_term(b.fev, place_index(b), event_index(b), "Middle East").select("event_id")


@query("b13_term_across_fields", term_filter("nation_1 america"))
def _(b):
    return X.events_of_term(b.fev, place_index(b), event_index(b), "Nation_1 America").select("event_id")


@query("b13_term_of_two_letters", term_filter("w "))
def _(b):
    return X.events_of_term(b.fev, place_index(b), event_index(b), "W ").select("event_id")


@query("h14_trigram_postings", f"""
SELECT DISTINCT location_key AS key, substring(txt, i::INT, 3) AS gram FROM (
  SELECT location_key, txt, unnest(range(1, length(txt) + 1)) AS i FROM (SELECT p.location_key, {PLACE_TEXT} AS txt FROM {{place}} p JOIN {{loc}} l ON l.id = p.id))""")
def _(b):
    return X.postings_by_key(place_index(b))


@query("c18_e4_locations_by_key", "SELECT location_key, id FROM {place}")
def _(b):
    return S.locations_by_key(b.loc).select("location_key", "id")


@query("g7_append_locations", """
SELECT location_key, MIN(id) AS id FROM (SELECT location_key, id FROM {place} UNION ALL
SELECT CAST(CAST(lat + 1 AS DECIMAL(10,6)) AS STRING) || ',' || CAST(lng AS STRING), id + 1000000 FROM {loc} WHERE lat IS NOT NULL AND lng IS NOT NULL) GROUP BY location_key""")
def _(b):
    more = b.loc.select((F.col("id") + 1000000).alias("id"), (F.col("lat") + 1).cast("decimal(10,6)").alias("lat"), "lng")
    return S.append_locations(S.locations_by_key(b.loc.select("id", "lat", "lng")), more).select("location_key", "id")


@query("d11_tag_frequencies", """
SELECT tag, COUNT(DISTINCT location_key) AS frequency FROM (SELECT tag, location_key FROM {fev_tag} UNION ALL SELECT tag, location_key FROM {place_tag}) GROUP BY tag""")
def _(b):
    return S.tag_frequencies(b.fev_tag, b.place_tag)


@query("d12_dynamic_frequencies", """
WITH u AS (SELECT DISTINCT tag FROM (SELECT tag FROM {fev_tag} UNION ALL SELECT tag FROM {place_tag})),
c AS (SELECT tag, COUNT(DISTINCT location_key) AS n FROM {fev_tag} WHERE event_id IN (SELECT event_id FROM {fev_tag} WHERE tag = 'Brand#7') GROUP BY tag)
SELECT u.tag, COALESCE(c.n, 0) AS frequency FROM u LEFT JOIN c ON c.tag = u.tag""")
def _(b):
    shown = b.fev_tag.join(b.fev_tag.filter("tag = 'Brand#7'"), "event_id", "left_semi")
    return S.dynamic_frequencies(S.tag_universe(b.fev_tag, b.place_tag), shown)


@query("d13_j4_visible_frequencies", f"""
SELECT t.tag, ROUND(SUM(1 + GREATEST(0, 1 - d.d / 20000)), 6) AS frequency FROM (SELECT event_id, {HAV} AS d FROM (SELECT *, {H} AS h FROM (SELECT event_id, {XY} FROM {{fev}})) WHERE {IN_QUAD}) d
JOIN {{fev_tag}} t ON t.event_id = d.event_id GROUP BY t.tag""")
def _(b):
    seen = S.with_distance(S.in_viewport(b.fev, QUAD), CENTRE).select("event_id", "distance")
    out = S.visible_frequencies(b.fev_tag.join(seen, "event_id"))
    return out.select("tag", F.round("frequency", 6).alias("frequency"))


@query("d14_posting_lists", f"SELECT tag, event_id FROM {ALL_TAGS}")
def _(b):
    return index(b)


@query("d15_events_by_location", "SELECT location_key, event_id FROM {fev}")
def _(b):
    return S.events_by_location(b.fev)


@query("d17_tag_universe", "SELECT DISTINCT tag FROM (SELECT tag FROM {fev_tag} UNION ALL SELECT tag FROM {place_tag})")
def _(b):
    return S.tag_universe(b.fev_tag, b.place_tag)


@query("j1_j9_distances", f"SELECT id, ROUND({HAV}, 3) AS distance FROM (SELECT *, {H} AS h FROM (SELECT id, {XY} FROM {{loc}}))")
def _(b):
    return S.with_distance(b.loc, CENTRE).select("id", F.round("distance", 3).alias("distance"))


@query("j3_coordinate_keys", "SELECT event_id, CAST(ROUND(CAST(lat AS DECIMAL(10,6)), 5) AS DOUBLE) AS lat5 FROM {fev}")
def _(b):
    return b.fev.select("event_id", G.coordinate_key(F.col("lat")).cast("double").alias("lat5"))


SPANS = f"(SELECT event_id, MIN(s) AS s, arg_min(e, (s, e)) AS e FROM {SPAN_SQL} GROUP BY event_id)"
REFERENCE = "1998-06-15 16:00:00"


@query("f5_popup_order", f"""
SELECT f.event_id, f.location_key, f.event_id = 33 AS forced, m.event_id IS NOT NULL AS matching, CAST(CASE WHEN m.event_id IS NULL THEN 0 ELSE COALESCE(a.n, 0) + COALESCE(c.n, 0) END AS INT) AS tag_count,
  CASE WHEN p.s <= TIMESTAMP '{REFERENCE}' AND p.e >= TIMESTAMP '{REFERENCE}' THEN GREATEST(0, ABS(date_diff('second', TIMESTAMP '{REFERENCE}', p.s)) - 432000) ELSE ABS(date_diff('second', TIMESTAMP '{REFERENCE}', p.s)) END AS away
FROM {{fev}} f JOIN {SPANS} p ON p.event_id = f.event_id
LEFT JOIN (SELECT DISTINCT event_id FROM {ALL_TAGS} WHERE tag IN ('promo', 'AFRICA') AND event_id NOT IN (SELECT event_id FROM {ALL_TAGS} WHERE tag = 'Brand#4')) m ON m.event_id = f.event_id
LEFT JOIN (SELECT event_id, COUNT(*) AS n FROM {{fev_tag}} WHERE tag IN ('promo', 'AFRICA') GROUP BY 1) a ON a.event_id = f.event_id
LEFT JOIN (SELECT location_id, COUNT(*) AS n FROM {{loc_tag}} WHERE tag IN ('promo', 'AFRICA') GROUP BY 1) c ON c.location_id = f.location_id""")
def _(b):
    # Start and end are those of an event's first occurrence.
    spans = instants(b).groupBy("event_id").agg(F.min(F.struct("start", "end")).alias("o")).select("event_id", "o.*")
    out = S.popup_order(b.fev.join(spans, "event_id"), index(b), b.fev_tag, b.loc_tag, SELECTED, F.lit(REFERENCE).cast("timestamp"), forced=33)
    return out.select("event_id", "location_key", "forced", "matching", "tag_count", "away")


@query("d14_posting_bitmaps", f"""
SELECT tag, 1 + CAST(floor((event_id - 1) / 32768) AS BIGINT) AS bucket, COUNT(*) AS events FROM {ALL_TAGS} GROUP BY ALL""")
def _(b):
    return S.tag_counts(index(b))


def search_items(b):
    seen = S.in_viewport(b.fev, QUAD).select("event_id", F.lit(True).alias("in_view"))
    flags = S.with_matching(b.fev, index(b), SELECTED).join(seen, "event_id", "left").join(S.tag_scores(index(b), "event_id", WEIGHTS), "event_id", "left")
    rows = S.with_distance(flags, CENTRE).withColumn("visible", F.coalesce("in_view", F.lit(False)) & F.col("matching"))
    return rows.withColumn("ref", F.col("event_id"))


SCORED = f"""
WITH t AS (SELECT event_id, SUM(CASE tag WHEN 'promo' THEN 3.0 WHEN 'AFRICA' THEN 1.5 WHEN 'Brand#7' THEN 0.75 ELSE 0 END) AS w,
  MAX(CASE WHEN tag IN ('promo', 'AFRICA') THEN 1 ELSE 0 END) AS hit, MAX(CASE WHEN tag = 'Brand#4' THEN 1 ELSE 0 END) AS bad FROM {ALL_TAGS} GROUP BY event_id),
f AS (SELECT *, {HAV} AS d, {IN_QUAD} AS in_view FROM (SELECT *, {H} AS h FROM (SELECT *, {XY} FROM {{fev}}))),
g AS (SELECT f.*, COALESCE(t.hit, 0) = 1 AND COALESCE(t.bad, 0) = 0 AS matching, COALESCE(t.w, 0) AS w FROM f LEFT JOIN t ON t.event_id = f.event_id),
e AS (SELECT event_id AS ref, COALESCE(short_name, name) AS shown, lower(concat_ws(' ', name, short_name, description, location, sublocation)) AS txt, matching, in_view AND matching AS visible,
  1 + CASE WHEN matching THEN 10 ELSE 0 END + w + GREATEST(0, 5 * (1 - d / 20000)) + CASE WHEN in_view AND matching THEN 5 ELSE 0 END AS score FROM g)"""


@query("j6_j7_event_search", SCORED + " SELECT ref, shown, ROUND(score, 6) AS score, visible FROM e WHERE txt LIKE '%show 3%'")
def _(b):
    return S.event_results(search_items(b), event_index(b), "Show 3").select("ref", "shown", F.round("score", 6).alias("score"), "visible")


@query("e10_event_results_without_term", SCORED + """
SELECT ref, ROUND(score, 6) AS score, visible FROM e WHERE visible
UNION ALL SELECT ref, ROUND(score, 6), visible FROM (SELECT * FROM e WHERE matching AND NOT visible ORDER BY ref LIMIT 100)""")
def _(b):
    return S.event_results(search_items(b), None, "").select("ref", F.round("score", 6).alias("score"), "visible")


def search_places(b, items=None):
    matching = (search_items(b) if items is None else items).filter("matching")
    keys = matching.groupBy("location_key").agg(F.bool_or("visible").alias("visible"))
    scores = S.tag_scores(b.place_tag.select("tag", "location_key").distinct(), "location_key", WEIGHTS)
    p = S.with_distance(S.locations_by_key(b.loc), CENTRE).join(keys.withColumn("matching", F.lit(True)), "location_key", "left").join(scores, "location_key", "left")
    return p.withColumn("ref", F.col("location_key")).withColumn("matching", F.coalesce("matching", F.lit(False))).withColumn("visible", F.coalesce("visible", F.lit(False)))


PLACES = """,
k AS (SELECT location_key, MAX(CASE WHEN in_view THEN 1 ELSE 0 END) AS v FROM g WHERE matching GROUP BY location_key),
q AS (SELECT p.location_key AS ref, k.location_key IS NOT NULL AS matching, COALESCE(k.v, 0) = 1 AS visible, """ + PLACE_TEXT + """ AS txt, """ + XY.replace("lat", "l.lat").replace("lng", "l.lng") + """,
  (SELECT COALESCE(SUM(CASE tag WHEN 'AFRICA' THEN 1.5 ELSE 0 END), 0) FROM {loc_tag} t WHERE t.location_id = l.id) AS w FROM {place} p JOIN {loc} l ON l.id = p.id LEFT JOIN k ON k.location_key = p.location_key),
r AS (SELECT ref, matching, visible, txt, 1 + CASE WHEN matching THEN 10 ELSE 0 END + w + GREATEST(0, 5 * (1 - (""" + HAV + """) / 20000)) + CASE WHEN visible THEN 5 ELSE 0 END AS score FROM (SELECT *, """ + H + """ AS h FROM q))"""


@query("j5_location_search", SCORED + PLACES + " SELECT ref, ROUND(score, 6) AS score, visible FROM r WHERE txt LIKE '%hall nation_1%'")
def _(b):
    return S.location_results(search_places(b), place_index(b), "Hall Nation_1").select("ref", F.round("score", 6).alias("score"), "visible")


@query("j5_location_search_by_tag", SCORED + PLACES + " SELECT ref, ROUND(score, 6) AS score, visible FROM r WHERE txt LIKE '%africa%'")
def _(b):
    return S.location_results(search_places(b), place_index(b), "África").select("ref", F.round("score", 6).alias("score"), "visible")


@query("j5_location_search_across_fields", SCORED + PLACES + " SELECT ref, ROUND(score, 6) AS score, visible FROM r WHERE txt LIKE '%nation_1 america%'")
def _(b):
    return S.location_results(search_places(b), place_index(b), "nation_1 AMERICA").select("ref", F.round("score", 6).alias("score"), "visible")


def tag_table(b):
    total = S.tag_frequencies(b.fev_tag, b.place_tag).withColumnRenamed("frequency", "total")
    shown = b.fev_tag.join(b.fev_tag.filter("tag = 'Brand#7'"), "event_id", "left_semi")
    dynamic = S.dynamic_frequencies(S.tag_universe(b.fev_tag, b.place_tag), shown).withColumnRenamed("frequency", "dynamic")
    seen = S.with_distance(S.in_viewport(b.fev, QUAD), CENTRE).select("event_id", "distance")
    visible = S.visible_frequencies(b.fev_tag.join(seen, "event_id")).withColumnRenamed("frequency", "visible_frequency")
    return total.join(dynamic, "tag").join(visible, "tag", "left")


TAG_SQL = f"""
WITH u AS (SELECT tag, COUNT(DISTINCT location_key) AS total FROM (SELECT tag, location_key FROM {{fev_tag}} UNION ALL SELECT tag, location_key FROM {{place_tag}}) GROUP BY tag),
c AS (SELECT tag, COUNT(DISTINCT location_key) AS n FROM {{fev_tag}} WHERE event_id IN (SELECT event_id FROM {{fev_tag}} WHERE tag = 'Brand#7') GROUP BY tag),
v AS (SELECT t.tag, SUM(1 + GREATEST(0, 1 - d.d / 20000)) AS f FROM (SELECT event_id, {HAV} AS d FROM (SELECT *, {H} AS h FROM (SELECT event_id, {XY} FROM {{fev}})) WHERE {IN_QUAD}) d JOIN {{fev_tag}} t ON t.event_id = d.event_id GROUP BY t.tag),
tags AS (SELECT u.tag, v.f IS NOT NULL AS visible, u.total * 0.01 + COALESCE(c.n, 0) + COALESCE(v.f * 5 + 5, 0) AS score FROM u LEFT JOIN c ON c.tag = u.tag LEFT JOIN v ON v.tag = u.tag)"""


@query("j8_tag_search", TAG_SQL + " SELECT tag AS ref, ROUND(score + CASE WHEN lower(tag) = 'brand#1' THEN 1000 ELSE 0 END, 5) AS score, visible FROM tags WHERE lower(tag) LIKE '%brand#1%'")
def _(b):
    return S.tag_results(tag_table(b), "Brand#1", ["Asia"]).select("ref", F.round("score", 5).alias("score"), "visible")


@query("f6_g6_ranked_results", TAG_SQL + SCORED.replace("\nWITH t AS", ",\nt AS") + PLACES + """
SELECT 'event' AS type, CAST(ref AS STRING) AS ref, ROUND(score, 5) AS score, FALSE AS hidden, FALSE AS picked FROM e WHERE visible
UNION ALL SELECT 'event', CAST(ref AS STRING), ROUND(score, 5), TRUE, FALSE FROM (SELECT * FROM e WHERE matching AND NOT visible ORDER BY ref LIMIT 100)
UNION ALL SELECT 'location', ref, ROUND(score, 5), FALSE, FALSE FROM r WHERE visible
UNION ALL SELECT 'location', ref, ROUND(score, 5), TRUE, FALSE FROM (SELECT * FROM r WHERE matching AND NOT visible ORDER BY ref LIMIT 100)
UNION ALL SELECT 'tag', tag, ROUND(score, 5), NOT visible, FALSE FROM tags WHERE tag NOT IN ('promo', 'AFRICA', 'Brand#4') AND lower(tag) <> 'asia'""")
def _(b):
    items = materialize(search_items(b), "search-items")
    events = S.event_results(items, None, "").withColumn("ref", F.col("ref").cast("string"))
    found = events.unionByName(S.location_results(search_places(b, items), None, "")).unionByName(S.tag_results(tag_table(b), "", ["Asia"]))
    return S.ranked(found, "", None, SELECTED).select("type", "ref", F.round("score", 5).alias("score"), "hidden", "picked")


@query("f10_nearest_feature", """
WITH p AS (SELECT p.location_key, CAST(l.lat AS DOUBLE) AS y, CAST(l.lng AS DOUBLE) AS x FROM {place} p JOIN {loc} l ON l.id = p.id),
e AS (SELECT event_id AS point_id, CAST(lat AS DOUBLE) + 0.0004 AS py, CAST(lng AS DOUBLE) - 0.0003 AS px FROM {fev}),
d AS (SELECT DISTINCT py, px FROM e),
n AS (SELECT py, px, arg_min(location_key, ((x - px) * (x - px) + (y - py) * (y - py), location_key)) AS location_key FROM d, p GROUP BY py, px)
SELECT point_id, location_key FROM e JOIN n ON n.py = e.py AND n.px = e.px""")
def _(b):
    features = S.locations_by_key(b.loc).select("location_key", F.col("lat").cast("double").alias("at_lat"), F.col("lng").cast("double").alias("at_lng"))
    points = b.fev.select(F.col("event_id").alias("point_id"), (F.col("lat").cast("double") + 0.0004).alias("lat"), (F.col("lng").cast("double") - 0.0003).alias("lng"))
    return S.nearest_feature(points, features, 0.01)
