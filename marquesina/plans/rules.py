"""Queries over rules, tags and venue names."""

from __future__ import annotations

from pyspark.sql import functions as F

from marquesina.functions import tags as TG, text as T, venues as V
from marquesina.operators import rules as R
from marquesina.plans.registry import query
from marquesina.sources.tables import edges_of, settings_of


def rule_table(b):
    """Tag rules drawn from the part table: brands are rewritten, excluded or removed by number."""
    n = F.substring("p_brand", 7, 3).cast("int")
    kind = F.when(n % 5 == 0, "exclude").when(n % 7 == 0, "remove").otherwise("rewrite")
    return b.part.groupBy("p_brand").agg(F.min("p_partkey").alias("id")).select(
        "id", kind.alias("rule_type"), F.upper("p_brand").alias("pattern"),
        F.when(n % 2 == 0, F.concat(F.lit("Label "), (n % 3).cast("string"))).alias("replacement"), F.lit(None).cast("date").alias("deleted_at"))


def raw_tags(b):
    """Distinct brand tags of orders, in brand order."""
    pairs = b.lineitem.join(b.part, F.col("l_partkey") == F.col("p_partkey")).select(F.col("l_orderkey").alias("event_id"), F.col("p_brand").alias("tag")).distinct()
    return pairs.select("event_id", F.lit(1).alias("group"), F.col("tag").alias("at"), "tag")


RULED = """
WITH r AS (SELECT DISTINCT l_orderkey AS event_id, p_brand AS tag, CAST(substring(p_brand, 7) AS INT) AS n FROM {lineitem} JOIN {part} ON p_partkey = l_partkey),
x AS (SELECT event_id, tag, n, CASE WHEN n % 5 <> 0 AND n % 7 <> 0 AND n % 2 = 0 THEN 'Label ' || CAST(n % 3 AS STRING) ELSE tag END AS final FROM r),
k AS (SELECT event_id, final, MIN(tag) AS at FROM x WHERE NOT (n % 5 = 0) GROUP BY event_id, final)"""


@query("c16_g8_processed_tags", RULED + " SELECT k.event_id, k.final AS tag, k.at AS first_of FROM k")
def _(b):
    return R.apply_tag_rules(raw_tags(b), "event_id", TG.live_rules(rule_table(b)))[0].select("event_id", "tag", F.col("at").alias("first_of"))


@query("b16_removed_events", """
SELECT DISTINCT l_orderkey AS event_id FROM {lineitem} JOIN {part} ON p_partkey = l_partkey
WHERE CAST(substring(p_brand, 7) AS INT) % 7 = 0 AND CAST(substring(p_brand, 7) AS INT) % 5 <> 0""")
def _(b):
    return R.apply_tag_rules(raw_tags(b), "event_id", TG.live_rules(rule_table(b)))[1]


@query("c16_joined_tag_rules", RULED + """
SELECT e.event_id, COUNT(k.final) AS n_tags, e.event_id IN (SELECT event_id FROM r WHERE n % 7 = 0 AND n % 5 <> 0) AS removed
FROM (SELECT DISTINCT event_id FROM r) e LEFT JOIN k ON k.event_id = e.event_id GROUP BY e.event_id""")
def _(b):
    raw = raw_tags(b)
    tags, removed = R.apply_tag_rules(raw, "event_id", TG.live_rules(rule_table(b)))
    counts = tags.groupBy("event_id").agg(F.count("*").alias("n_tags"))
    out = raw.select("event_id").distinct().join(counts, "event_id", "left").join(removed.withColumn("removed", F.lit(True)), "event_id", "left")
    return out.select("event_id", F.coalesce("n_tags", F.lit(0)).alias("n_tags"), F.coalesce("removed", F.lit(False)).alias("removed"))


@query("h11_coerced_tags", "SELECT p_partkey, lower(p_brand) AS key, p_type || '|' || p_brand AS tags FROM {part}")
def _(b):
    text = F.concat(F.lit(" #"), "p_type", F.lit(",# "), F.replace("p_brand", F.lit("#"), F.lit("~")))
    tags = F.transform(TG.split_hash_tags(text), lambda t: F.replace(t, F.lit("~"), F.lit("#")))
    return b.part.select("p_partkey", TG.tag_key(F.col("p_brand")).alias("key"), F.array_join(tags, "|").alias("tags"))


@query("c15_rule_emojis", """
SELECT id, CASE WHEN lower(word) = 'museum' THEN '🏛️' WHEN lower(word) = 'teatro' THEN '🎭' ELSE COALESCE(emoji, '📍') END AS emoji,
       CASE WHEN lower(word) = 'museum' THEN '🎨' WHEN lower(word) = 'teatro' THEN '🎬' WHEN emoji IS NULL THEN '📌' END AS alt_emoji
FROM (SELECT id, emoji, CASE id % 3 WHEN 0 THEN 'Museum' WHEN 1 THEN 'TEATRO' ELSE 'Place' END AS word FROM {loc} WHERE deleted_at IS NULL)""")
def _(b):
    word = F.when(F.col("id") % 3 == 0, "Museum").when(F.col("id") % 3 == 1, "TEATRO").otherwise("Place")
    named = b.loc.filter("deleted_at IS NULL").select("id", "emoji", F.concat("type", F.lit(" "), word).alias("name"))
    return R.rule_emojis(named).select("id", "emoji", "alt_emoji")


@query("c17_related_tags", """
SELECT tag, weight FROM (SELECT 'promo' AS tag, 1.0 AS weight UNION ALL SELECT 'small', 1.0
UNION ALL SELECT related, MAX(weight) FROM {edge} WHERE tag IN ('promo', 'small') AND related NOT IN ('promo', 'small', 'Brand#3') GROUP BY related)""")
def _(b):
    return R.related_tags(b.edge, ["promo", "small"], ["Brand#3"])


@query("g3_tag_union", """
SELECT e.id AS event_id, t.tag FROM {ev} e JOIN {ev_tag} t ON t.event_id = e.id UNION SELECT e.id, g.tag FROM {ev} e JOIN {loc_tag} g ON g.location_id = e.location_id""")
def _(b):
    return R.tag_union(b.ev_tag, b.loc_tag, b.ev.withColumnRenamed("id", "event_id"))


@query("g4_implicit_change", """
SELECT a.tag, CASE WHEN a.tag IN (SELECT related FROM {edge} WHERE tag = 'large') THEN 'kept' ELSE 'removed' END AS change
FROM (SELECT DISTINCT related AS tag FROM {edge} WHERE tag = 'promo') a
UNION ALL SELECT related, 'added' FROM {edge} WHERE tag = 'large' AND related NOT IN (SELECT related FROM {edge} WHERE tag = 'promo')""")
def _(b):
    of = lambda tag: b.edge.filter(F.col("tag") == tag).select(F.col("related").alias("tag"))
    return R.implicit_change(of("promo"), of("large"))


@query("b22_shown_location_tags", "SELECT location_id, tag FROM {loc_tag} WHERE lower(tag) NOT IN ('asia', 'europe')")
def _(b):
    return R.shown_location_tags(b.loc_tag, ["Asia", "EUROPE"])


@query("b17_row_violations", """
SELECT page_id, concat_ws('|', CASE WHEN page_id > 90 THEN 'lat' END, CASE WHEN page_id > 180 THEN 'lng' END,
  CASE WHEN LENGTH(html) > 255 THEN 'name too long' END, CASE WHEN regexp_matches(url, '[^a-zA-Z0-9 _&-]') THEN 'bad tag' END,
  CASE page_id % 4 WHEN 1 THEN 'bad date format' WHEN 2 THEN 'year out of range' WHEN 3 THEN 'no such day' END) AS problems FROM {pages}""")
def _(b):
    day = F.when(F.col("page_id") % 4 == 1, "2024-1-1").when(F.col("page_id") % 4 == 2, "1999-01-01").when(F.col("page_id") % 4 == 3, "2023-02-29").otherwise("2024-02-29")
    n = F.col("page_id").cast("double")
    return b.pages.select("page_id", F.array_join(R.violations(n, n, {"name": F.col("html")}, F.array("url"), day), "|").alias("problems"))


@query("b18_junk_locations", """
SELECT id FROM {loc} WHERE deleted_at IS NULL AND type IN ('building', 'machinery') AND id NOT IN (SELECT location_id FROM {gold})""")
def _(b):
    bad = b.loc.withColumn("name", F.when(F.col("type").isin("building", "machinery"), F.concat(F.lit('{"name": "'), "name", F.lit('"}'))).otherwise(F.col("name")))
    return R.junk_locations(bad, b.gold.withColumn("deleted_at", F.lit(None).cast("date"))).select("id")


@query("h8_h9_h10_venue_keys", f"""
SELECT c_custkey, CASE WHEN c_nationkey = 3 THEN '' WHEN LENGTH(bare) > 15 THEN substring(bare, 5) ELSE bare END AS key, CASE WHEN c_nationkey = 3 THEN 'online' ELSE bare END AS plain,
       lower(c_mktsegment) || ' st e' AS street
FROM (SELECT *, CASE WHEN c_nationkey % 5 = 0 THEN 'the grand ' ELSE 'the ' END || lower(c_mktsegment) AS bare FROM {{customer}})""")
def _(b):
    name = F.when(F.col("c_nationkey") == 3, "Online!").otherwise(F.concat(F.when(F.col("c_nationkey") % 5 == 0, "The Grand, ").otherwise("The "), "c_mktsegment"))
    return b.customer.select("c_custkey", V.venue_key(name).alias("key"), V.plain_venue_name(name).alias("plain"),
                             V.street_key(F.concat("c_mktsegment", F.lit(" Street East "))).alias("street"))


@query("a16_related_tag_edges", "SELECT tag, related, weight FROM {edge}")
def _(b):
    near = F.collect_list(F.array(F.col("related"), F.col("weight").cast("string")))
    objects = b.edge.groupBy("tag").agg(near.alias("near")).select(F.to_json(F.create_map("tag", "near")).alias("value"))
    return edges_of(objects)


@query("a16_tag_settings", """
SELECT 'tag' AS kind, r_name AS name, NULL AS colour FROM {region} UNION ALL SELECT 'marker', n_name, '#' || CAST(100 + n_nationkey AS STRING) FROM {nation}""")
def _(b):
    tags = b.region.join(b.nation, F.col("n_regionkey") == F.col("r_regionkey")).groupBy("r_name").agg(F.map_from_entries(F.collect_list(F.struct(
        "n_name", F.concat(F.lit("#"), (100 + F.col("n_nationkey")).cast("string"))))).alias("markerColors"))
    geotags, colours = settings_of(tags.select(F.to_json(F.struct(F.array("r_name").alias("geotags"), "markerColors")).alias("value")))
    return geotags.select(F.lit("tag").alias("kind"), F.col("tag").alias("name"), F.lit(None).cast("string").alias("colour")).unionByName(
        colours.select(F.lit("marker").alias("kind"), F.col("emoji").alias("name"), "colour"))
