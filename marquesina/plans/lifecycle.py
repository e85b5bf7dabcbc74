"""Queries over venue resolution, batch decisions, archiving and consolidation."""

from __future__ import annotations

from pyspark.sql import functions as F

from marquesina.functions import venues as VF
from marquesina.operators import lifecycle as L, merging as G, runs as U, venues as V
from marquesina.plans.bindings import DOCUMENTS_DAY, ORDERS_DAY
from marquesina.plans.matching import golden, index_of
from marquesina.plans.registry import query


def today():
    return F.lit(DOCUMENTS_DAY).cast("date")


DAY = f"DATE '{DOCUMENTS_DAY}'"
BARE = "trim(regexp_replace(regexp_replace(lower({c}), '[^\\p{{L}}\\p{{N}}_\\s]', '', 'g'), '\\s+', ' ', 'g'))"


def bare(c):
    return BARE.replace("{c}", c)


@query("c14_exact_steps", f"""
WITH ln AS (SELECT id, lower(name) AS low, lower(address) AS addr, {bare('name')} AS key FROM {{loc}} WHERE deleted_at IS NULL),
al AS (SELECT a.location_id AS id, {bare('alternate_name')} AS key FROM {{alias}} a JOIN ln ON ln.id = a.location_id),
k AS (SELECT id, lower(location_name) AS low, lower(sublocation) AS sub, {bare('location_name')} AS key, trim({bare('location_name')} || ' ' || COALESCE({bare('sublocation')}, '')) AS full_key FROM {{ask}} WHERE location_name IS NOT NULL),
h AS (SELECT k.id, 0 AS level, ln.id AS location_id FROM k JOIN ln ON ln.low = k.low WHERE k.sub IS NULL OR ln.addr IS NULL OR ln.addr = k.sub
UNION ALL SELECT k.id, 1, ln.id FROM k JOIN ln ON ln.key = k.key UNION ALL SELECT k.id, 1, ln.id FROM k JOIN ln ON ln.key = k.full_key
UNION ALL SELECT k.id, 2, al.id FROM k JOIN al ON al.key = k.key UNION ALL SELECT k.id, 2, al.id FROM k JOIN al ON al.key = k.full_key
UNION ALL SELECT a.id, 4, ln.id FROM {{ask}} a JOIN ln ON ln.key = {bare('a.event_name')} WHERE a.location_name IS NOT NULL)
SELECT id, min(level) AS level, arg_min(location_id, level * 1000000 + location_id) AS location_id FROM h GROUP BY id""")
def _(b):
    return V.resolve_existing(b.ask, b.loc, b.alias, fuzzy=False)


@query("c14_e3_j10_resolved")
def _(b):
    return V.resolve_existing(b.ask, b.loc, b.alias)


@query("c14_new_venues")
def _(b):
    known = V.resolve_existing(b.ask, b.loc, b.alias)
    return V.new_venues(b.ask.join(known, "id", "left_anti"))


@query("m2_prepared_rows", """
SELECT doc_id AS id, trim(name, ' ') AS short, CASE WHEN lang = 'en' THEN '🎵' END AS emoji FROM {doc_row}""")
def _(b):
    x = b.doc_row
    name = F.concat(F.when(F.col("lang") == "en", "Exhibition: ").otherwise(""), "name", F.lit(" - at "), "source")
    named = x.select(F.col("doc_id").alias("id"), name.alias("name"), "location_id", F.when(F.col("lang") == "en", "🎵").alias("emoji"))
    resolved = x.select(F.col("doc_id").alias("id"), F.col("source_id").alias("location_id"), F.col("source").alias("venue_name"))
    return G.prepare_rows(named, resolved).select("id", F.col("short_name").alias("short"), "emoji")


@query("m2_result_status", """
SELECT r.id, CASE WHEN r.status <> 'extracted' THEN r.status WHEN d.lang IN ('en', 'fr') THEN 'processed' ELSE 'failed' END AS status FROM {res} r JOIN {documents} d ON d.doc_id = r.id""")
def _(b):
    found = b.documents.filter(F.col("lang").isin("en", "fr")).select(F.col("doc_id").alias("crawl_result_id"))
    return G.result_status(b.res, found).select("id", "status")


def batch(b):
    """Decisions over the documents that carry no label yet."""
    rows = b.xev.join(b.labels.select(F.col("doc_id").alias("id")), "id", "left_anti")
    return rows, G.decide(rows, b.loc, index_of(b), today())


@query("m3_decisions")
def _(b):
    return batch(b)[1].select("id", "status", "is_new", "e", "level")


@query("m3_skipped_rows", f"""
SELECT x.doc_id AS id, CASE WHEN x.location_id IS NULL THEN 'skipped_no_location' ELSE 'skipped_no_occurrences' END AS status FROM {{doc_row}} x
WHERE x.doc_id NOT IN (SELECT doc_id FROM {{labels}}) AND x.name <> '' AND (x.location_id IS NULL OR NOT (x.first_day BETWEEN {DAY} AND {DAY} + 90 OR x.first_day + 7 BETWEEN {DAY} AND {DAY} + 90))""")
def _(b):
    rows = b.xev.join(b.labels.select(F.col("doc_id").alias("id")), "id", "left_anti")
    return G.screened(rows, today()).filter("skip IS NOT NULL").select("id", F.col("skip").alias("status"))


@query("m3_m4_new_event_ids")
def _(b):
    return G.with_event_ids(batch(b)[1].select("id", "source_id", "status", "is_new", "e"), 1_000_000).select("id", "status", "event_id")


def merge_inputs(b):
    rows = b.xev.join(b.labels.select(F.col("doc_id").alias("id")), "id", "left_anti").withColumn("short_name", F.lit("")).withColumn(
        "description", F.col("tags")).withColumn("emoji", F.lit("🎭")).withColumn("sublocation", F.lit(None).cast("string"))
    events = b.gold.select("id", "name", "location_id", "status", F.lit(None).cast("date").alias("deleted_at"))
    occurrences = b.gold.select(F.col("id").alias("event_id"), F.explode(F.array("first_day", F.date_add("first_day", 7))).alias("start_date"))
    links = b.gold.select(F.col("id").alias("event_id"), F.col("id").alias("extracted_event_id"), "source_id", F.lit(True).alias("is_primary"))
    urls = b.gold.select(F.col("id").alias("event_id"), F.lit("u").alias("url"))
    extracted = b.xev.select("id", "crawl_result_id")
    results = b.res.select("id", "source_id", F.lit("processed").alias("status"))
    return rows, events, occurrences, urls, links, b.loc, extracted, results


@query("m3_merge_run_counts")
def _(b):
    return U.merge(*merge_inputs(b), 1_000_000, today())["counts"]


@query("m3_merge_run_events")
def _(b):
    return U.merge(*merge_inputs(b), 1_000_000, today())["events"].select("id", "name", "location_id", "status")


@query("m14_reprocessed_jobs", """
SELECT r.id, CASE WHEN r.crawl_job_id % 3 = 0 AND r.status = 'processed' THEN 'extracted' ELSE r.status END AS status,
       r.crawl_job_id % 3 = 0 AND r.id NOT IN (SELECT doc_id FROM {labels}) AS open FROM {res} r""")
def _(b):
    links = b.labels.select(F.col("doc_id").alias("extracted_event_id"))
    back, rows = U.again(b.res, b.xev.select("id", "crawl_result_id"), links, b.res.filter("crawl_job_id % 3 = 0"))
    flag = rows.select("id", F.lit(True).alias("open"))
    return back.join(flag, "id", "left").select("id", "status", F.coalesce("open", F.lit(False)).alias("open"))


@query("m2_prepared_venues", f"""
WITH ln AS (SELECT id, lower(name) AS low, lower(address) AS addr, {bare('name')} AS key FROM {{loc}} WHERE deleted_at IS NULL),
al AS (SELECT a.location_id AS id, {bare('alternate_name')} AS key FROM {{alias}} a JOIN ln ON ln.id = a.location_id),
k AS (SELECT id, lower(location_name) AS low, lower(sublocation) AS sub, {bare('location_name')} AS key, trim({bare('location_name')} || ' ' || COALESCE({bare('sublocation')}, '')) AS full_key FROM {{ask}} WHERE location_name IS NOT NULL),
h AS (SELECT k.id, 0 AS level, ln.id AS location_id FROM k JOIN ln ON ln.low = k.low WHERE k.sub IS NULL OR ln.addr IS NULL OR ln.addr = k.sub
UNION ALL SELECT k.id, 1, ln.id FROM k JOIN ln ON ln.key = k.key UNION ALL SELECT k.id, 1, ln.id FROM k JOIN ln ON ln.key = k.full_key
UNION ALL SELECT k.id, 2, al.id FROM k JOIN al ON al.key = k.key UNION ALL SELECT k.id, 2, al.id FROM k JOIN al ON al.key = k.full_key
UNION ALL SELECT a.id, 4, ln.id FROM {{ask}} a JOIN ln ON ln.key = {bare('a.event_name')} WHERE a.location_name IS NOT NULL),
b AS (SELECT id, arg_min(location_id, level * 1000000 + location_id) AS location_id FROM h GROUP BY id)
SELECT a.id, b.location_id, CASE WHEN a.id % 5 = 0 THEN 1 ELSE 2 END AS n_tags FROM {{ask}} a LEFT JOIN b ON b.id = a.id WHERE a.id % 7 <> 0""")
def _(b):
    return prepared(b, False)


@query("m2_prepared_with_fuzzy_venues")
def _(b):
    return prepared(b, True)


def to_prepare(b):
    rules = b.spark.createDataFrame([("rewrite", "jazz", "Jazz"), ("exclude", "free", None), ("remove", "gone", None)], "rule_type string, key string, replacement string")
    second = F.when(F.col("id") % 7 == 0, "Gone").when(F.col("id") % 5 == 0, "free").otherwise("open air")
    x = b.ask.select("id", F.col("id").alias("crawl_result_id"), F.col("event_name").alias("name"), "location_name", "sublocation", "site_name",
                     F.concat(F.lit('["jazz","'), second, F.lit('"]')).alias("tags"), F.lit(None).cast("string").alias("emoji"))
    return x, rules


def prepared(b, fuzzy):
    x, rules = to_prepare(b)
    out = U.prepare(x, b.res, b.loc, b.alias, rules, fuzzy=fuzzy)
    n = out["tags"].groupBy("id").agg(F.count("*").cast("int").alias("n_tags"))
    return out["rows"].join(n, "id", "left").select("id", "location_id", "n_tags")


def written(b):
    verdict = b.verdict
    rows = b.xev.withColumn("short_name", F.lit("")).withColumn("description", F.col("tags")).withColumn("emoji", F.lit("🎭")).withColumn("sublocation", F.lit(None).cast("string"))
    return verdict, rows


@query("m4_created_events", """
SELECT v.event_id AS id, substring(x.name, 1, 500) AS name, x.location_id, '🎭' AS emoji, 'active' AS status FROM {verdict} v JOIN {xev} x ON x.id = v.id WHERE v.status = 'created'""")
def _(b):
    return G.created_tables(*written(b), today())["events"].select("id", "name", "location_id", "emoji", "status")


@query("m4_created_occurrences", f"""
SELECT v.event_id, d.first_day + k.k AS start_date, CASE WHEN k.k = 0 THEN '7:30 PM' END AS start_time FROM {{verdict}} v JOIN {{doc_row}} d ON d.doc_id = v.id, (SELECT 0 AS k UNION ALL SELECT 7) k
WHERE v.status = 'created' AND d.first_day + k.k BETWEEN {DAY} AND {DAY} + 90""")
def _(b):
    return G.created_tables(*written(b), today())["occurrences"].select("event_id", "start_date", "start_time")


@query("m4_e7_primary_links", "SELECT event_id, id AS extracted_event_id, source_id, status = 'created' AS is_primary FROM {verdict} WHERE status IN ('created', 'merged')")
def _(b):
    verdict, rows = written(b)
    new = G.created_tables(verdict, rows, today())
    old = G.merged_tables(verdict, rows, golden_table(b), golden_urls(b), new["urls"])
    return new["links"].unionByName(old["links"])


def golden_table(b):
    return b.gold.select("id", F.when(F.col("id") % 2 == 0, F.col("location_id")).alias("location_id"), "status", F.lit(None).cast("date").alias("deleted_at"))


def golden_urls(b):
    return b.doc_row.select(F.col("doc_id").alias("event_id"), F.concat(F.lit("https://crawl.example.org/"), F.col("n_chars").cast("string")).alias("url"))


@query("m5_merged_events", """
SELECT g.id, COALESCE(CASE WHEN g.id % 2 = 0 THEN g.location_id END, p.place) AS location_id, CASE WHEN p.event_id IS NOT NULL THEN 'active' ELSE g.status END AS status
FROM {gold} g LEFT JOIN (SELECT v.event_id, arg_min(x.location_id, v.id) AS place FROM {verdict} v JOIN {xev} x ON x.id = v.id WHERE v.status = 'merged' GROUP BY 1) p ON p.event_id = g.id""")
def _(b):
    verdict, rows = written(b)
    return G.merged_tables(verdict, rows, golden_table(b), golden_urls(b), golden_urls(b))["events"].select("id", "location_id", "status")


@query("m5_merged_urls", """
SELECT DISTINCT v.event_id, x.url FROM {verdict} v JOIN {xev} x ON x.id = v.id LEFT JOIN {doc_row} d ON d.doc_id = v.event_id AND 'https://crawl.example.org/' || CAST(d.n_chars AS STRING) = x.url
WHERE v.status = 'merged' AND d.doc_id IS NULL""")
def _(b):
    verdict, rows = written(b)
    return G.merged_tables(verdict, rows, golden_table(b), golden_urls(b), golden_urls(b))["urls"]


@query("m7_audit_log", """
SELECT id AS extracted_event_id, status, event_id, CASE status WHEN 'merged' THEN 'Merged with existing event ' || CAST(event_id AS STRING) WHEN 'created' THEN 'Created new event ' || CAST(event_id AS STRING)
  ELSE 'No location_id on extracted event' END AS message FROM {verdict}""")
def _(b):
    return G.audit_log(b.verdict)


@query("m8_tag_links", """
SELECT event_id, tag AS name FROM (SELECT l_orderkey AS event_id, lower(p_type) AS tag FROM {lineitem} JOIN {part} ON p_partkey = l_partkey UNION SELECT l_orderkey, p_brand FROM {lineitem} JOIN {part} ON p_partkey = l_partkey)""")
def _(b):
    held = b.part.groupBy(F.lower("p_type").alias("name")).agg(F.min("p_partkey").alias("id"))
    tags, links = G.tag_links(held, b.ev_tag.withColumnRenamed("tag", "name"), 1_000_000)
    return links.join(tags.withColumnRenamed("id", "tag_id"), "tag_id").select("event_id", "name")


@query("m8_tag_ids", "SELECT COUNT(DISTINCT tag) AS tags, COUNT(DISTINCT tag) AS ids FROM {ev_tag}")
def _(b):
    held = b.ev_tag.filter("tag = 'promo'").select(F.col("tag").alias("name")).distinct().withColumn("id", F.lit(7).cast("long"))
    all_tags = L.get_or_create(held, b.ev_tag.select(F.col("tag").alias("name")), 1000)
    return all_tags.agg(F.countDistinct("name").alias("tags"), F.countDistinct("id").alias("ids"))


@query("d7_latest_results", "SELECT source_id, MAX(id) AS crawl_result_id FROM {res} WHERE status IN ('processed', 'extracted') GROUP BY source_id")
def _(b):
    return G.latest_results(b.res)


OUTDATED = f"""
WITH latest AS (SELECT source_id, MAX(id) AS rid FROM {{res}} WHERE status IN ('processed', 'extracted') GROUP BY source_id)
SELECT g.id AS event_id, g.name, CASE WHEN g.first_day > {DAY} THEN g.first_day WHEN g.first_day + 7 > {DAY} THEN g.first_day + 7 END AS next_date FROM {{gold}} g
WHERE g.status = 'active' AND g.id NOT IN (SELECT rid FROM latest) AND g.first_day + 7 < {DAY} + 14"""


def gone(b):
    events, days, links = golden(b)
    extracted = b.xev.select("id", "crawl_result_id")
    return G.outdated(events, links, extracted, b.res, days, today())


@query("c19_m6_outdated_events", OUTDATED)
def _(b):
    return gone(b)


@query("m6_archived_status", f"SELECT g.id, CASE WHEN o.event_id IS NOT NULL THEN 'archived' ELSE g.status END AS status FROM {{gold}} g LEFT JOIN ({OUTDATED}) o ON o.event_id = g.id")
def _(b):
    return G.archive(golden(b)[0], gone(b)).select("id", "status")


DUPLICATES = """
n AS (SELECT event_id, COUNT(*) AS n FROM {ev_src} GROUP BY 1),
e AS (SELECT v.id, v.name, v.location_id, ROW_NUMBER() OVER w AS r, FIRST_VALUE(v.id) OVER w AS canonical FROM {ev} v LEFT JOIN n ON n.event_id = v.id WHERE v.deleted_at IS NULL
  WINDOW w AS (PARTITION BY v.name, v.location_id ORDER BY COALESCE(n.n, 0) DESC, v.id)),
m AS (SELECT id AS duplicate, canonical FROM e WHERE r > 1)"""


@query("e2_e8_duplicate_map", "WITH " + DUPLICATES + " SELECT duplicate, canonical FROM m")
def _(b):
    return G.duplicate_map(b.ev, b.ev_src)


@query("c6_occurrences_new_to_canonical", "WITH " + DUPLICATES + """
SELECT m.canonical AS event_id, o.start_date, o.start_time, o.end_date, o.end_time FROM m JOIN {occ} o ON o.event_id = m.duplicate
WHERE NOT EXISTS (SELECT 1 FROM {occ} h WHERE h.event_id = m.canonical AND h.start_date = o.start_date AND COALESCE(h.start_time, '') = COALESCE(o.start_time, '')
  AND COALESCE(h.end_date, DATE '0001-01-01') = COALESCE(o.end_date, DATE '0001-01-01') AND COALESCE(h.end_time, '') = COALESCE(o.end_time, ''))""")
def _(b):
    return G.new_to_canonical(b.occ, G.duplicate_map(b.ev, b.ev_src))


def folded(b):
    return G.consolidate(b.ev, b.ev_src, b.ev_url, b.occ, b.ev_tag, F.lit(ORDERS_DAY).cast("date"))


@query("m9_consolidation_report", "WITH " + DUPLICATES + """,
u AS (SELECT m.canonical, COUNT(*) AS n FROM m JOIN {ev_url} x ON x.event_id = m.duplicate GROUP BY 1),
k AS (SELECT canonical, COUNT(*) AS n FROM (SELECT DISTINCT m.canonical, x.extracted_event_id FROM m JOIN {ev_src} x ON x.event_id = m.duplicate) d
  WHERE NOT EXISTS (SELECT 1 FROM {ev_src} h WHERE h.event_id = d.canonical AND h.extracted_event_id = d.extracted_event_id) GROUP BY 1)
SELECT m.canonical, COUNT(*) AS copies, COALESCE(MAX(u.n), 0) AS urls, COALESCE(MAX(k.n), 0) AS links FROM m LEFT JOIN u ON u.canonical = m.canonical LEFT JOIN k ON k.canonical = m.canonical GROUP BY m.canonical""")
def _(b):
    return folded(b)["report"].select("canonical", "copies", "urls", "links")


@query("m9_consolidated_tags", "WITH " + DUPLICATES + """
SELECT DISTINCT COALESCE(m.canonical, t.event_id) AS event_id, t.tag FROM {ev_tag} t LEFT JOIN m ON m.duplicate = t.event_id""")
def _(b):
    return folded(b)["tags"].select("event_id", "tag")


@query("m9_live_events_after", "WITH " + DUPLICATES + " SELECT id FROM {ev} WHERE deleted_at IS NULL AND id NOT IN (SELECT duplicate FROM m)")
def _(b):
    return folded(b)["events"].filter("deleted_at IS NULL").select("id")


def same_place(b):
    """Locations at one point: all but the lowest id are duplicates of it."""
    at = b.loc.filter("lat IS NOT NULL AND lat <> 0 AND deleted_at IS NULL").select("id", "lat", "lng")
    first = at.groupBy("lat", "lng").agg(F.min("id").alias("canonical"))
    return at.join(first, ["lat", "lng"]).filter("id <> canonical").select(F.col("id").alias("duplicate"), "canonical")


SAME = """WITH m AS (SELECT l.id AS duplicate, f.canonical FROM {loc} l JOIN (SELECT lat, lng, MIN(id) AS canonical FROM {loc} WHERE lat IS NOT NULL AND lat <> 0 AND deleted_at IS NULL GROUP BY 1, 2) f ON f.lat = l.lat AND f.lng = l.lng
  WHERE l.deleted_at IS NULL AND l.id <> f.canonical)"""


def merged(b):
    return V.merge_locations(b.ev.select("id", "location_id", "deleted_at"), b.alias, b.loc_tag, b.loc.select("id", "name", "deleted_at"), same_place(b), F.lit(ORDERS_DAY).cast("date"))


@query("c22_m10_location_merge", SAME + """
SELECT e.id, CASE WHEN e.deleted_at IS NULL THEN COALESCE(m.canonical, e.location_id) ELSE e.location_id END AS location_id FROM {ev} e LEFT JOIN m ON m.duplicate = e.location_id""")
def _(b):
    return merged(b)["events"].select("id", "location_id")


@query("m10_merged_locations", SAME + " SELECT l.id, COALESCE(l.deleted_at, CASE WHEN m.duplicate IS NOT NULL THEN DATE '1998-06-15' END) AS deleted_at FROM {loc} l LEFT JOIN m ON m.duplicate = l.id")
def _(b):
    return merged(b)["locations"].select("id", "deleted_at")


@query("m10_merge_report", SAME + " SELECT m.canonical, m.duplicate, (SELECT COUNT(*) FROM {ev} e WHERE e.location_id = m.duplicate AND e.deleted_at IS NULL) AS moved FROM m")
def _(b):
    return merged(b)["report"]


@query("c23_seeded_aliases", """
SELECT DISTINCT f.id AS location_id, s.s_name AS alternate_name FROM {supplier} s JOIN {nation} n ON n.n_nationkey = s.s_nationkey
JOIN (SELECT lower(name) AS low, MIN(id) AS id FROM {loc} WHERE deleted_at IS NULL GROUP BY 1) f ON f.low = lower('BUILDING HALL ' || n.n_name)""")
def _(b):
    known = b.supplier.join(b.nation, F.col("n_nationkey") == F.col("s_nationkey")).select(F.concat(F.lit("BUILDING HALL "), "n_name").alias("canonical"), F.col("s_name").alias("alternate_name"))
    return V.seed_aliases(known, b.loc, b.alias)


@query("m11_e5_g5_bulk_import", f"""
WITH w AS (SELECT s_suppkey AS idx, CASE WHEN s_suppkey % 4 = 0 THEN 'building hall, nation_' || CAST(s_nationkey AS STRING) ELSE 'New Place ' || CAST(s_nationkey AS STRING) END AS name, s_suppkey AS n FROM {{supplier}}),
k AS (SELECT *, {bare('name')} AS norm, MIN(idx) OVER (PARTITION BY {bare('name')}) AS first_idx FROM w), h AS (SELECT DISTINCT {bare('name')} AS norm FROM {{loc}} WHERE deleted_at IS NULL)
SELECT idx, CASE WHEN h.norm IS NOT NULL OR idx <> first_idx THEN 'duplicate' WHEN n % 3 <> 0 AND n % 5 <> 0 THEN 'geocode_failed' ELSE 'created' END AS status FROM k LEFT JOIN h ON h.norm = k.norm""")
def _(b):
    name = F.when(F.col("s_suppkey") % 4 == 0, F.concat(F.lit("building hall, nation_"), F.col("s_nationkey").cast("string"))).otherwise(F.concat(F.lit("New Place "), F.col("s_nationkey").cast("string")))
    at = F.when(F.col("s_suppkey") % 3 == 0, F.lit(10.4))
    rows = b.supplier.select(F.col("s_suppkey").alias("idx"), name.alias("name"), at.alias("lat"), at.alias("lng"))
    hits = b.supplier.select(F.col("s_suppkey").alias("idx"), F.when(F.col("s_suppkey") % 5 == 0, F.lit(10.5)).alias("geo_lat")).withColumn("geo_lng", F.col("geo_lat"))
    return V.bulk_import(rows, b.loc, b.alias, hits).select("idx", "status")


def hits(b):
    """Two providers' answers per location, shifted by a distance that depends on the location."""
    shift = F.element_at(F.array(*[F.lit(x) for x in (0.0001, 0.004, 0.05)]), (F.col("id") % 3 + 1).cast("int"))
    base = b.loc.select(F.col("id").alias("location_id"), F.coalesce(F.col("lat").cast("double"), F.lit(10.4)).alias("y"), F.coalesce(F.col("lng").cast("double"), F.lit(-66.9)).alias("x"), shift.alias("d"))
    one = lambda p, k: base.select("location_id", F.lit(p).alias("provider"), F.lit(1).alias("position"), (F.col("y") + F.col("d") * k).alias("lat"), F.col("x").alias("lng"), F.lit("" if p == 2 else "Street 1").alias("address"))
    return one(1, 1.0).union(one(2, -1.0))


HITS = """WITH s AS (SELECT id, lat, lng, address, deleted_at, COALESCE(CAST(lat AS DOUBLE), 10.4) AS y, COALESCE(CAST(lng AS DOUBLE), -66.9) AS x, CASE id % 3 WHEN 0 THEN 0.0001 WHEN 1 THEN 0.004 ELSE 0.05 END AS d FROM {loc}),
p AS (SELECT *, CASE WHEN x NOT BETWEEN -67.05 AND -66.75 THEN NULL WHEN y + d BETWEEN 10.35 AND 10.55 THEN 1 WHEN y - d BETWEEN 10.35 AND 10.55 THEN 2 END AS provider FROM s)"""


@query("c21_picked_hits", HITS + " SELECT id AS location_id, provider FROM p WHERE provider IS NOT NULL")
def _(b):
    return V.pick_hits(hits(b)).select("location_id", "provider")


@query("c20_m16_reconciled", HITS + """
SELECT id, CASE WHEN provider IS NULL THEN 'no result' WHEN lat IS NULL THEN 'update' WHEN d = 0.05 THEN 'refused' WHEN d = 0.004 THEN 'update' ELSE 'close' END AS verdict FROM p WHERE deleted_at IS NULL""")
def _(b):
    return V.reconcile(b.loc, V.pick_hits(hits(b))).select("id", "verdict")


@query("m16_d18_applied_coordinates", HITS + """
SELECT id, CASE WHEN provider IS NOT NULL AND (lat IS NULL OR d = 0.004) THEN ROUND(CASE provider WHEN 1 THEN y + d ELSE y - d END, 6) ELSE CAST(lat AS DOUBLE) END AS lat,
       CASE WHEN provider = 1 AND (lat IS NULL OR d = 0.004) THEN 'Street 1' ELSE address END AS address FROM p WHERE deleted_at IS NULL""")
def _(b):
    out = V.apply_coordinates(V.reconcile(b.loc, V.pick_hits(hits(b))), ["id", "lat", "lng", "address"])
    return out.select("id", F.round("lat", 6).alias("lat"), "address")


@query("m12_replaced_tags", """
SELECT location_id, tag FROM {loc_tag} WHERE location_id NOT IN (SELECT id FROM {loc} WHERE type = 'machinery') UNION ALL SELECT id, 'workshop' FROM {loc} WHERE type = 'machinery'""")
def _(b):
    new = b.loc.filter("type = 'machinery'").select(F.col("id").alias("location_id"), F.lit("workshop").alias("tag"))
    return L.replace_children(b.loc_tag, new, new, "location_id")


@query("m13_soft_delete_and_toggle", """
SELECT id, CASE WHEN deleted_at IS NULL AND tier = 2 THEN DATE '2001-11-08' WHEN tier = 3 THEN NULL ELSE deleted_at END AS deleted_at, CASE WHEN nation_id = 1 THEN NOT disabled ELSE disabled END AS disabled FROM {src}""")
def _(b):
    s = L.soft_delete(b.src, b.src.filter("tier = 2"), F.lit("2001-11-08").cast("date"))
    s = L.restore(s, b.src.filter("tier = 3"))
    return L.toggle(s, b.src.filter("nation_id = 1"), "disabled").select("id", "deleted_at", "disabled")


@query("m13_toggled_status", "SELECT id, CASE WHEN location_id = 5 THEN CASE status WHEN 'archived' THEN 'active' ELSE 'archived' END ELSE status END AS status FROM {ev}")
def _(b):
    return L.toggle(b.ev, b.ev.filter("location_id = 5"), "status").select("id", "status")


@query("j10_fuzzy_pairs")
def _(b):
    keys = b.ask.select(VF.venue_key(F.col("location_name")).alias("key")).filter("key <> ''").distinct()
    venues = b.loc.select(VF.venue_key(F.col("name")).alias("venue")).distinct()
    return V.fuzzy_pairs(keys, venues).select("key", "venue", F.round("score", 6).alias("score"))
