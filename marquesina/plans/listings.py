"""Queries over golden events, their children and venues: listings, details and feeds."""

from __future__ import annotations

from pyspark.sql import functions as F

from marquesina.functions.geo import location_key
from marquesina.operators import feed as D, skew
from marquesina.operators.dashboards import count_since
from marquesina.plans.bindings import ORDERS_DAY
from marquesina.plans.registry import query
from marquesina.session import materialize, work_dir
from marquesina.sources import tables as S

def today():
    return F.lit(ORDERS_DAY).cast("date")

DAY = f"DATE '{ORDERS_DAY}'"


OCC_ITEM = """CAST(start_date AS STRING) || ' ' || COALESCE(start_time, '-') || ' ' || COALESCE(CAST(end_date AS STRING), '-') || ' ' || COALESCE(end_time, '-')"""


@query("f1_upcoming_listing", f"""
SELECT e.id, e.name, e.status, e.location_id, n.next_date, COALESCE(l.short_name, l.name) AS location_name
FROM {{ev}} e LEFT JOIN (SELECT event_id, MIN(start_date) AS next_date FROM {{occ}} WHERE start_date >= {DAY} GROUP BY 1) n ON n.event_id = e.id
LEFT JOIN {{loc}} l ON l.id = e.location_id WHERE e.deleted_at IS NULL
ORDER BY n.next_date ASC NULLS LAST, e.name, e.id LIMIT 50""")
def _(b):
    return D.listing_page(D.listing_filter(b.ev, b.occ, today()), b.occ, b.loc, today())


@query("b1_live_events", "SELECT id, name, status FROM {ev} WHERE deleted_at IS NULL")
def _(b):
    return D.active(b.ev).select("id", "name", "status")


@query("b2_filtered_listing_count", f"""
SELECT COUNT(*) AS total FROM {{ev}} WHERE deleted_at IS NULL AND status = 'active' AND id IN (SELECT event_id FROM {{occ}} WHERE start_date >= {DAY})""")
def _(b):
    return D.listing_filter(b.ev, b.occ, today(), upcoming=True, status="active").agg(F.count("*").alias("total"))


@query("d1_second_page_with_total", """
SELECT id, name, (SELECT COUNT(*) FROM {ev} WHERE deleted_at IS NULL AND name ILIKE '%show 3%') AS total
FROM {ev} WHERE deleted_at IS NULL AND name ILIKE '%show 3%' ORDER BY created_at DESC, id LIMIT 50 OFFSET 50""")
def _(b):
    found = D.search_name(D.active(b.ev), "show 3")
    total = found.agg(F.count("*").alias("total"))
    page = found.orderBy(F.col("created_at").desc_nulls_first(), "id").offset(50).limit(50)
    return page.select("id", "name", total.scalar().alias("total"))


@query("b11_name_search", "SELECT id, name, type FROM {loc} WHERE name ILIKE '%hall nation_1%' AND deleted_at IS NULL")
def _(b):
    return D.search_name(D.active(b.loc), "hall nation_1").select("id", "name", "type")


@query("c1_event_display_venue", """
SELECT e.id, COALESCE(l.short_name, l.name) AS location_name FROM {ev} e LEFT JOIN {loc} l ON l.id = e.location_id""")
def _(b):
    v = b.loc.select(F.col("id").alias("location_id"), F.coalesce("short_name", "name").alias("location_name"))
    return b.ev.join(v, "location_id", "left").select("id", "location_name")


@query("c2_f3_recent_events", """
SELECT e.id, e.name, e.emoji, e.status, l.name AS location_name FROM {ev} e JOIN {loc} l ON l.id = e.location_id
WHERE e.deleted_at IS NULL ORDER BY e.created_at DESC, e.id LIMIT 10""")
def _(b):
    latest = D.active(b.ev).join(b.loc.select(F.col("id").alias("location_id"), F.col("name").alias("location_name")), "location_id")
    return latest.orderBy(F.col("created_at").desc_nulls_first(), "id").limit(10).select("id", "name", "emoji", "status", "location_name")


@query("c3_d16_candidate_dates", f"""
SELECT e.id, e.name, e.location_id, COUNT(DISTINCT o.start_date) AS n_dates, MIN(o.start_date) AS first_date, MAX(o.start_date) AS last_date
FROM {{ev}} e JOIN {{occ}} o ON o.event_id = e.id WHERE e.status = 'active' AND e.deleted_at IS NULL
AND o.start_date BETWEEN {DAY} - 10 AND {DAY} + 90 GROUP BY 1, 2, 3""")
def _(b):
    from marquesina.operators.matching import candidate_index
    idx = candidate_index(b.ev, b.occ, b.loc, b.ev_src, today())
    dates = idx.dates.groupBy("event_id").agg(F.count("*").alias("n_dates"), F.min("day").alias("first_date"), F.max("day").alias("last_date"))
    return idx.events.join(dates, "event_id").select(F.col("event_id").alias("id"), "name", "location_id", "n_dates", "first_date", "last_date")


@query("c4_unprocessed_extractions", """
SELECT x.id, x.name, x.source_id FROM {xev} x LEFT JOIN {labels} b ON b.doc_id = x.id WHERE b.doc_id IS NULL""")
def _(b):
    return b.xev.join(b.labels.select(F.col("doc_id").alias("id")), "id", "left_anti").select("id", "name", "source_id")


@query("c5_events_in_window", f"""
SELECT id, name FROM {{ev}} WHERE id IN (SELECT event_id FROM {{occ}} WHERE start_date BETWEEN {DAY} AND {DAY} + 90)""")
def _(b):
    return b.ev.join(D.upcoming_ids(b.occ, today(), 90), "id", "left_semi").select("id", "name")


@query("c8_sources_with_counts", """
SELECT s.id, s.name, COALESCE(u.url, '') AS website, COALESCE(k.n, 0) AS event_count, CAST(c.last_crawled_at AS DATE) AS last_crawled
FROM {src} s LEFT JOIN (SELECT source_id, min_by(url, sort_order) AS url FROM {src_url} WHERE deleted_at IS NULL GROUP BY 1) u ON u.source_id = s.id
LEFT JOIN (SELECT source_id, COUNT(*) AS n FROM {ev_src} GROUP BY 1) k ON k.source_id = s.id
LEFT JOIN {cfg} c ON c.source_id = s.id WHERE s.deleted_at IS NULL""")
def _(b):
    from marquesina.operators.crawl import first_urls
    s = D.with_count(D.active(b.src), b.ev_src, "id", "source_id", "event_count")
    u = first_urls(b.src_url).select(F.col("source_id").alias("id"), "url")
    c = b.cfg.select(F.col("source_id").alias("id"), F.to_date("last_crawled_at").alias("last_crawled"))
    return s.join(u, "id", "left").join(c, "id", "left").select("id", "name", F.coalesce("url", F.lit("")).alias("website"), "event_count", "last_crawled")


@query("c9_events_with_occurrence_count", """
SELECT e.id, e.name, COALESCE(o.n, 0) AS occurrences FROM {ev} e
LEFT JOIN (SELECT event_id, COUNT(*) AS n FROM {occ} GROUP BY 1) o ON o.event_id = e.id WHERE e.deleted_at IS NULL""")
def _(b):
    return D.with_count(D.active(b.ev), b.occ, "id", "event_id", "occurrences").select("id", "name", "occurrences")


@query("c9_locations_with_event_count", """
SELECT l.id, l.name, COALESCE(e.n, 0) AS event_count FROM {loc} l
LEFT JOIN (SELECT location_id, COUNT(*) AS n FROM {ev} WHERE deleted_at IS NULL GROUP BY 1) e ON e.location_id = l.id WHERE l.deleted_at IS NULL""")
def _(b):
    return D.with_count(D.active(b.loc), D.active(b.ev), "id", "location_id", "event_count").select("id", "name", "event_count")


@query("c11_f7_event_details", f"""
SELECT e.id, 'event' AS kind, NULL AS item, l.name AS location FROM {{ev}} e LEFT JOIN {{loc}} l ON l.id = e.location_id
UNION ALL SELECT event_id, 'occurrence', {OCC_ITEM}, NULL FROM {{occ}} UNION ALL SELECT event_id, 'url', url, NULL FROM {{ev_url}}
UNION ALL SELECT event_id, 'tag', tag, NULL FROM {{ev_tag}}""")
def _(b):
    return D.event_details(b.ev.select("id", "location_id"), b.occ, b.ev_url, b.ev_tag, b.loc).select("id", "kind", "item", "location")


@query("c11_job_details", """
SELECT id, 'job' AS kind, NULL AS item, status FROM {job} UNION ALL SELECT crawl_job_id, 'result', CAST(id AS STRING) || ' ' || CAST(source_id AS STRING) || ' ' || status, NULL FROM {res}
UNION ALL SELECT crawl_job_id, 'summary', CAST(COUNT(*) AS STRING) || ' ' || CAST(CAST(SUM(input_tokens) AS BIGINT) AS STRING) || ' ' || CAST(CAST(SUM(output_tokens) AS BIGINT) AS STRING), NULL FROM {usage} GROUP BY crawl_job_id""")
def _(b):
    return D.job_details(b.job.select("id", "status"), b.res, b.usage)


@query("c11_location_details", """
SELECT id, 'location' AS kind, NULL AS item, name FROM {loc} UNION ALL SELECT location_id, 'alias', alternate_name, NULL FROM {alias} UNION ALL SELECT location_id, 'tag', tag, NULL FROM {loc_tag}""")
def _(b):
    return D.location_details(b.loc.select("id", "name"), b.alias, b.loc_tag)


@query("c11_source_details", """
SELECT id, 'source' AS kind, NULL AS item, name FROM {src} UNION ALL SELECT source_id, 'url', url, NULL FROM {src_url} WHERE deleted_at IS NULL
UNION ALL SELECT source_id, 'config', COALESCE(crawl_mode, '-') || ' ' || COALESCE(CAST(crawl_frequency AS STRING), '-'), NULL FROM {cfg}""")
def _(b):
    return D.source_details(b.src.select("id", "name"), b.src_url, b.cfg)


FEED = f"""
WITH s AS (SELECT * FROM {{ev}} WHERE status = 'active' AND deleted_at IS NULL AND id IN (SELECT event_id FROM {{occ}} WHERE start_date BETWEEN {DAY} AND {DAY} + 90))
SELECT e.id, 'event' AS kind, NULL AS item, e.name, e.short_name, e.emoji, e.sublocation, l.name AS location, CAST(l.lat AS DOUBLE) AS lat, CAST(l.lng AS DOUBLE) AS lng
FROM s e LEFT JOIN {{loc}} l ON l.id = e.location_id
UNION ALL SELECT event_id, 'occurrence', {OCC_ITEM}, NULL, NULL, NULL, NULL, NULL, NULL, NULL FROM {{occ}} WHERE event_id IN (SELECT id FROM s)
UNION ALL SELECT event_id, 'url', url, NULL, NULL, NULL, NULL, NULL, NULL, NULL FROM {{ev_url}} WHERE event_id IN (SELECT id FROM s)
UNION ALL SELECT event_id, 'tag', tag, NULL, NULL, NULL, NULL, NULL, NULL, NULL FROM {{ev_tag}} WHERE event_id IN (SELECT id FROM s)"""


def feed(b):
    """The feed; lines of other events are left out once, before occurrences, urls and tags are made of the rest.

    Left to the end, every child would be moved for all events, tags twice more to find the different ones.
    """
    shown = D.feed_heads(b.ev, b.occ, today()).select(F.col("id").alias("l_orderkey"))
    lines = b.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_shipdate").join(shown, "l_orderkey", "left_semi")
    c = b.over(lineitem=materialize(lines, "feed-lines"))
    f = D.feed_events(b.ev, c.occ, c.ev_url, c.ev_tag, b.loc, today())
    return f.select("id", "kind", "item", "name", "short_name", "emoji", "sublocation", "location", F.col("lat").cast("double").alias("lat"), F.col("lng").cast("double").alias("lng"))


@query("a13_feed_events", FEED)
def _(b):
    return feed(b)


@query("a13_feed_document", FEED)
def _(b):
    """The feed written as one list and read back."""
    path, rows = work_dir(b.spark, "feed"), feed(b)
    lines = rows.select("id", "kind", "item", F.to_json(F.struct(*rows.columns)).alias("value"))
    S.write_document(lines, ["id", "kind", "item"], S.FEED_EDGES, path)
    return S.read_document(b.spark, path, S.FEED_EDGES).select(F.from_json("value", rows.schema).alias("r")).select("r.*")


@query("a14_feed_locations", """
WITH p AS (SELECT * FROM {loc} WHERE deleted_at IS NULL AND lat IS NOT NULL AND lng IS NOT NULL)
SELECT id, 'location' AS kind, NULL AS item, name, short_name, CAST(lat AS DOUBLE) AS lat, CAST(lng AS DOUBLE) AS lng, emoji FROM p
UNION ALL SELECT location_id, 'tag', tag, NULL, NULL, NULL, NULL, NULL FROM {loc_tag} WHERE location_id IN (SELECT id FROM p)""")
def _(b):
    return D.feed_locations(b.loc, b.loc_tag).select("id", "kind", "item", "name", "short_name", F.col("lat").cast("double").alias("lat"), F.col("lng").cast("double").alias("lng"), "emoji")


def occurrence_json(*fields: str) -> str:
    """SQL of the JSON text of an occurrence: fields that are null are left out."""
    rest = " || ".join(f"""COALESCE(',"{f}":"' || CAST({f} AS STRING) || '"', '')""" for f in fields[1:])
    return f"""'{{{{"{fields[0]}":"' || CAST({fields[0]} AS STRING) || '"' || {rest} || '}}}}'"""


@query("a23_c10_existing_upcoming", f"""
WITH o AS (SELECT event_id, MIN(start_date) AS first_date FROM {{occ}} WHERE start_date >= {DAY} GROUP BY 1),
r AS (SELECT e.id, e.name, l.name AS location, o.first_date FROM {{ev}} e JOIN o ON o.event_id = e.id LEFT JOIN {{loc}} l ON l.id = e.location_id WHERE e.status = 'active' AND e.deleted_at IS NULL)
SELECT id, 'event' AS kind, NULL AS item, name, location, first_date FROM r
UNION ALL SELECT DISTINCT event_id, 'source', CAST(source_id AS STRING), NULL, NULL, NULL FROM {{ev_src}} WHERE event_id IN (SELECT id FROM r)
UNION ALL SELECT event_id, 'occurrence', {occurrence_json('start_date', 'start_time', 'end_date', 'end_time')}, NULL, NULL, NULL FROM {{occ}} WHERE start_date >= {DAY} AND event_id IN (SELECT id FROM r)
UNION ALL SELECT DISTINCT event_id, 'url', url, NULL, NULL, NULL FROM {{ev_url}} WHERE event_id IN (SELECT id FROM r)
UNION ALL SELECT DISTINCT event_id, 'tag', tag, NULL, NULL, NULL FROM {{ev_tag}} WHERE event_id IN (SELECT id FROM r)""")
def _(b):
    x = D.existing_upcoming(b.ev, b.occ, b.ev_url, b.ev_tag, b.ev_src, b.loc, today())
    return x.select("id", "kind", "item", "name", "location", "first_date")


@query("d9_k5_occurrence_json", f"SELECT event_id, start_date, {occurrence_json('start_date', 'start_time')} AS item FROM {{occ}}")
def _(b):
    return b.occ.select("event_id", "start_date", F.to_json(F.struct("start_date", "start_time")).alias("item"))


@query("d2_events_by_status", "SELECT status, COUNT(*) AS n FROM {ev} WHERE deleted_at IS NULL GROUP BY status")
def _(b):
    return D.active(b.ev).groupBy("status").agg(F.count("*").alias("n"))


@query("d6_next_date", f"SELECT event_id, MIN(start_date) AS next_date FROM {{occ}} WHERE start_date >= {DAY} GROUP BY event_id")
def _(b):
    return D.next_dates(b.occ, today())


@query("d8_duplicate_groups", """
SELECT name, location_id, COUNT(*) AS copies, MIN(id) AS first_id FROM {ev} WHERE deleted_at IS NULL GROUP BY 1, 2 HAVING COUNT(*) > 1""")
def _(b):
    return D.duplicate_groups(b.ev)


@query("e12_first_events_per_location", """
SELECT location_id, id, name, rank, total - 20 AS remaining FROM (
  SELECT location_id, id, name, ROW_NUMBER() OVER (PARTITION BY location_id ORDER BY id) AS rank, COUNT(*) OVER (PARTITION BY location_id) AS total
  FROM {ev} WHERE deleted_at IS NULL) WHERE rank <= 20""")
def _(b):
    live = D.active(b.ev).select("location_id", "id", "name")
    first = skew.top_per_key(live, ["location_id"], [F.col("id")], 20)
    return first.join(live.groupBy("location_id").agg((F.count("*") - 20).alias("remaining")), "location_id")


@query("f4_rule_order", """
SELECT p_partkey, p_type, p_name FROM {part}
ORDER BY CASE p_type WHEN 'PROMO' THEN 0 WHEN 'ECONOMY' THEN 1 ELSE 2 END, p_name, p_partkey LIMIT 100""")
def _(b):
    # Closed vocabularies sort by their declared order, not by name.
    ordinal = F.when(F.col("p_type") == "PROMO", 0).when(F.col("p_type") == "ECONOMY", 1).otherwise(2)
    return b.part.orderBy(ordinal, "p_name", "p_partkey").limit(100).select("p_partkey", "p_type", "p_name")


@query("b14_m15_missing_coordinates", "SELECT id, name, address FROM {loc} WHERE deleted_at IS NULL AND (lat IS NULL OR lng IS NULL)")
def _(b):
    from marquesina.operators.venues import geocode_worklist
    return geocode_worklist(b.loc).select("id", "name", "address")


MARKERS = """
WITH k AS (SELECT DISTINCT l.id FROM {loc} l JOIN {ev} e ON e.location_id = l.id WHERE e.deleted_at IS NULL),
p AS (SELECT l.* FROM {loc} l WHERE l.id IN (SELECT id FROM k) AND l.lat IS NOT NULL AND (l.lat <> 0 OR l.lng <> 0)),
f AS (SELECT id, 'icon' AS kind, '' AS short_name, -10000 - CAST(lat AS DOUBLE) AS sort_key, emoji, lat, lng FROM p
UNION ALL SELECT id, 'label', COALESCE(short_name, name), -CAST(lat AS DOUBLE), emoji, lat, lng FROM p
UNION ALL SELECT id, 'short', very_short_name, 10000 - CAST(lat AS DOUBLE), emoji, lat, lng FROM p)
"""


def markers(b):
    colours = b.spark.createDataFrame([("🎭", "#a33"), ("🎵", "#33a")], "emoji string, colour string")
    loc = b.loc.filter("lat IS NOT NULL").withColumn("location_key", F.col("id").cast("string"))
    keys = D.active(b.ev).select(F.col("location_id").cast("string").alias("location_key"))
    return D.marker_features(loc, keys, colours)


@query("a15_c25_marker_features", MARKERS + """
SELECT id, kind, short_name, ROUND(sort_key, 6) AS sort_key, CASE emoji WHEN '🎭' THEN '#a33' WHEN '🎵' THEN '#33a' ELSE '#444' END AS colour FROM f""")
def _(b):
    return markers(b).select(F.col("location_key").cast("long").alias("id"), "kind", "short_name", F.round("sort_key", 6).alias("sort_key"), "colour")


@query("a15_geojson_document", MARKERS + """
SELECT id, COALESCE(short_name, '') AS short_name, CASE WHEN kind = 'icon' THEN 'emoji-' || COALESCE(emoji, '📍') END AS icon, kind = 'short' AS is_short_label, ROUND(sort_key, 6) AS sort_key,
  CASE emoji WHEN '🎭' THEN '#a33' WHEN '🎵' THEN '#33a' ELSE '#444' END AS colour, ROUND(CAST(lng AS DOUBLE), 6) AS lng, ROUND(CAST(lat AS DOUBLE), 6) AS lat FROM f""")
def _(b):
    """Markers written as one map document and read back."""
    path = work_dir(b.spark, "markers")
    S.write_document(D.geojson_lines(markers(b)), ["sort_key"], S.GEOJSON_EDGES, path)
    kind = ("type string, geometry struct<type:string,coordinates:array<double>>, "
            "properties struct<locationKey:string,shortName:string,emojiImageId:string,color:string,isShortLabel:boolean,sortKey:double>")
    f = S.read_document(b.spark, path, S.GEOJSON_EDGES).select(F.from_json("value", kind).alias("f")).select("f.geometry.coordinates", "f.properties.*")
    return f.select(
        F.col("locationKey").cast("long").alias("id"), F.col("shortName").alias("short_name"), F.col("emojiImageId").alias("icon"),
        F.coalesce("isShortLabel", F.lit(False)).alias("is_short_label"), F.round("sortKey", 6).alias("sort_key"), F.col("color").alias("colour"),
        F.round(F.get("coordinates", F.lit(0)), 6).alias("lng"), F.round(F.get("coordinates", F.lit(1)), 6).alias("lat"))


@query("h15_display_names", """
SELECT id, CASE WHEN LENGTH(n) > 40 THEN substring(n, 1, 35) || '…' ELSE n END AS shown
FROM (SELECT id, COALESCE(NULLIF(short_name, ''), name || ' with a rather long subtitle') AS n FROM {ev})""")
def _(b):
    from marquesina.functions.text import display_name
    return b.ev.select("id", display_name(F.col("short_name"), F.concat("name", F.lit(" with a rather long subtitle"))).alias("shown"))
