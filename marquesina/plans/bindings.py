"""The given tables seen through the engine's data model.

Each entry is a projection in SQL that Spark and the checking database both read, so the checks
start from the same rows. ``{name}`` refers to a given table or to another entry.
"""

from __future__ import annotations

import re
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession

from marquesina.session import CARRIED, SETTINGS

GIVEN = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()

# The fixed days the jobs run at: one for the order tables, one for the document tables.
ORDERS_DAY = "1998-06-15"
SOURCES_NOW = "2001-11-08 12:00:00"
DOCUMENTS_DAY = "2026-04-10"
LOG_NOW = "2024-01-25 10:30:00"

VIEWS = {
    "src": """
        SELECT s_suppkey AS id, s_name AS name,
               CASE WHEN s_nationkey % 7 = 0 THEN NULL ELSE 1 + s_nationkey % 3 END AS tier,
               s_acctbal < 1500 AS disabled,
               CASE WHEN s_acctbal > 9500 THEN DATE '2001-01-01' END AS deleted_at,
               CASE WHEN s_suppkey % 5 = 0 THEN CAST(s_suppkey % 4 AS DOUBLE) END AS min_interval,
               s_nationkey AS nation_id
        FROM {supplier}""",
    "cfg": """
        SELECT s_suppkey AS source_id,
               CASE s_suppkey % 4 WHEN 0 THEN NULL WHEN 1 THEN 0 WHEN 2 THEN 3 ELSE 14 END AS crawl_frequency,
               CASE s_nationkey % 4 WHEN 0 THEN DATE '2001-12-01' WHEN 1 THEN DATE '2001-10-01' END AS crawl_after,
               s_acctbal > 8000 AS force_crawl,
               CASE WHEN s_suppkey % 6 <> 0 THEN last_ship END AS last_crawled_at,
               CASE s_suppkey % 3 WHEN 0 THEN 0 WHEN 1 THEN 5 END AS num_clicks,
               CASE s_suppkey % 7 WHEN 0 THEN 0 WHEN 1 THEN 12 END AS max_pages,
               CASE s_suppkey % 5 WHEN 0 THEN 'json_api' WHEN 1 THEN 'instagram' WHEN 2 THEN NULL ELSE 'browser' END AS crawl_mode,
               'notes ' || s_name AS notes
        FROM {supplier}
        LEFT JOIN (SELECT l_suppkey, MAX(l_shipdate) AS last_ship FROM {lineitem} GROUP BY l_suppkey) ship
          ON l_suppkey = s_suppkey""",
    "src_url": """
        SELECT page_id AS id, page_id % 40 AS source_id, url,
               CAST(FLOOR(page_id / 40) AS BIGINT) AS sort_order,
               CASE WHEN instr(url, '?') > 0 THEN 'scroll()' END AS js_code,
               CASE WHEN instr(url, '#top') > 0 THEN DATE '2001-01-01' END AS deleted_at
        FROM {pages}""",
    "loc": """
        SELECT c_custkey AS id, c_mktsegment || ' Hall ' || n_name AS name,
               CASE WHEN c_nationkey % 2 = 0 THEN c_mktsegment || ' ' || n_name END AS short_name,
               substring(c_mktsegment, 1, 3) AS very_short_name,
               CASE WHEN c_nationkey % 3 = 0 THEN NULL ELSE n_name END AS address,
               CASE WHEN c_nationkey = 7 THEN NULL WHEN c_nationkey = 8 THEN CAST(0 AS DECIMAL(10,6))
                    ELSE CAST(CAST(10300 + c_custkey % 300 AS DOUBLE) / 1000 AS DECIMAL(10,6)) END AS lat,
               CASE WHEN c_nationkey = 7 THEN NULL WHEN c_nationkey = 8 THEN CAST(0 AS DECIMAL(10,6))
                    ELSE CAST(CAST(-67100 + c_custkey % 400 AS DOUBLE) / 1000 AS DECIMAL(10,6)) END AS lng,
               CASE c_nationkey % 4 WHEN 0 THEN '🎭' WHEN 1 THEN '🎵' WHEN 2 THEN NULL ELSE '📍' END AS emoji,
               lower(c_mktsegment) AS type, r_name AS region,
               CASE WHEN c_acctbal < 0 THEN DATE '1998-01-01' END AS deleted_at
        FROM {customer} JOIN {nation} ON n_nationkey = c_nationkey JOIN {region} ON r_regionkey = n_regionkey""",
    "alias": "SELECT c_custkey AS location_id, c_name AS alternate_name FROM {customer}",
    "loc_tag": """
        SELECT c_custkey AS location_id, lower(c_mktsegment) AS tag FROM {customer}
        UNION ALL
        SELECT c_custkey, r_name FROM {customer} JOIN {nation} ON n_nationkey = c_nationkey
        JOIN {region} ON r_regionkey = n_regionkey""",
    "ev": """
        SELECT o_orderkey AS id, substring(o_orderpriority, 3) || ' show ' || CAST(o_custkey % 9 AS STRING) AS name,
               CASE WHEN o_orderkey % 3 = 0 THEN substring(o_orderpriority, 3) END AS short_name,
               o_custkey AS location_id,
               CASE o_orderstatus WHEN 'F' THEN 'archived' ELSE 'active' END AS status,
               CASE WHEN o_orderkey % 4 = 0 THEN '🎵' END AS emoji,
               'priority ' || o_orderpriority AS description,
               CASE WHEN o_orderkey % 5 = 0 THEN 'N/A' WHEN o_orderkey % 5 = 1 THEN 'Room ' || CAST(o_custkey % 3 AS STRING) END AS sublocation,
               o_orderdate AS created_at,
               CASE WHEN o_totalprice > 450000 THEN DATE '1998-01-01' END AS deleted_at
        FROM {orders}""",
    "occ": """
        SELECT l_orderkey AS event_id, CAST(l_shipdate AS DATE) AS start_date,
               CASE l_linenumber % 3 WHEN 1 THEN '7:30 PM' WHEN 2 THEN '19:00' END AS start_time,
               CASE WHEN l_quantity > 40 THEN CAST(l_shipdate AS DATE) + 2 WHEN l_quantity > 35 THEN CAST(l_shipdate AS DATE) + 1 END AS end_date,
               CASE WHEN l_quantity < 5 THEN '9:00 PM' WHEN l_quantity > 35 THEN '2:00 am' END AS end_time
        FROM {lineitem}""",
    "ev_src": """
        SELECT l_orderkey AS event_id, l_suppkey AS source_id, l_partkey AS extracted_event_id,
               l_linenumber = 1 AS is_primary
        FROM {lineitem}""",
    "ev_url": "SELECT l_orderkey AS event_id, 'https://tickets.example.org/' || CAST(l_partkey AS STRING) AS url FROM {lineitem}",
    "ev_tag": """
        SELECT l_orderkey AS event_id, lower(p_type) AS tag FROM {lineitem} JOIN {part} ON p_partkey = l_partkey
        UNION
        SELECT l_orderkey, p_brand FROM {lineitem} JOIN {part} ON p_partkey = l_partkey""",
    "place": """
        SELECT CAST(lat AS STRING) || ',' || CAST(lng AS STRING) AS location_key, MIN(id) AS id
        FROM {loc} WHERE lat IS NOT NULL AND lng IS NOT NULL GROUP BY CAST(lat AS STRING) || ',' || CAST(lng AS STRING)""",
    "fev": """
        SELECT e.id AS event_id, e.name, e.short_name, e.description, e.sublocation, e.emoji, e.location_id, l.name AS location,
               l.lat, l.lng, CAST(l.lat AS STRING) || ',' || CAST(l.lng AS STRING) AS location_key, CAST(e.created_at AS DATE) AS day
        FROM {ev} e JOIN {loc} l ON l.id = e.location_id
        WHERE e.deleted_at IS NULL AND e.status = 'active' AND l.lat IS NOT NULL AND l.lng IS NOT NULL""",
    "fev_tag": "SELECT t.tag, e.event_id, e.location_key FROM {ev_tag} t JOIN {fev} e ON e.event_id = t.event_id",
    "place_tag": "SELECT t.tag, p.location_key, p.id FROM {loc_tag} t JOIN {place} p ON p.id = t.location_id",
    "edge": """
        SELECT lower(p_type) AS tag, p_brand AS related, CAST(MAX(p_size) AS DOUBLE) / 100 AS weight FROM {part} GROUP BY lower(p_type), p_brand""",
    "ask": """
        SELECT o.o_orderkey AS id,
               CASE o.o_orderkey % 6 WHEN 0 THEN lower(l.name) WHEN 1 THEN '  ' || l.name || '!' WHEN 2 THEN c.c_name
                    WHEN 3 THEN replace(l.name, 'Hall', 'Hal') WHEN 4 THEN 'Open Air Place ' || CAST(o.o_custkey % 90 AS STRING) END AS location_name,
               CASE o.o_orderkey % 4 WHEN 0 THEN l.address WHEN 1 THEN 'Room 1' END AS sublocation,
               'Site ' || CAST(o.o_custkey % 5 AS STRING) AS site_name,
               CASE WHEN o.o_orderkey % 12 = 4 THEN l.name ELSE 'Show' END AS event_name
        FROM {orders} o JOIN {loc} l ON l.id = o.o_custkey JOIN {customer} c ON c.c_custkey = o.o_custkey""",
    "verdict": """
        SELECT doc_id AS id, source_id, CASE WHEN location_id IS NULL THEN 'skipped_no_location' WHEN n_chars % 3 = 0 THEN 'created' ELSE 'merged' END AS status,
               CASE WHEN location_id IS NULL THEN NULL WHEN n_chars % 3 = 0 THEN doc_id + 1000000 ELSE n_chars % 100 END AS event_id
        FROM {doc_row}""",
    "res": """
        SELECT d.doc_id AS id, CAST(FLOOR(d.doc_id / 20) AS BIGINT) AS crawl_job_id,
               CAST(substring(d.source, 4) AS BIGINT) AS source_id,
               CASE WHEN b.doc_id IS NULL THEN 'extracted' WHEN b.toxic = 1 THEN 'crawled'
                    WHEN b.quality = 1 THEN 'processed' ELSE 'failed' END AS status,
               CASE WHEN b.toxic = 0 AND b.quality = 0 THEN 'Crawled content too small' END AS error_message,
               DATE '2026-03-01' + CAST(d.doc_id % 40 AS INT) AS created_at
        FROM {documents} d LEFT JOIN {labels} b ON b.doc_id = d.doc_id""",
    "content": """
        SELECT doc_id AS crawl_result_id, text AS crawled_content,
               CASE WHEN lang = 'en' THEN NULL ELSE '{{"events": []}}' END AS extracted_content
        FROM {documents}""",
    "job": """
        SELECT CAST(FLOOR(doc_id / 20) AS BIGINT) AS id,
               CASE WHEN MIN(n_chars) < 60 THEN 'running' ELSE 'completed' END AS status,
               DATE '2026-03-20' + CAST(MIN(doc_id) % 21 AS INT) AS started_at
        FROM {documents} GROUP BY CAST(FLOOR(doc_id / 20) AS BIGINT)""",
    "usage": """
        SELECT event_id AS crawl_job_id, ts AS created_at, event_type AS provider, user_id,
               CAST(FLOOR(value * 100) AS BIGINT) AS input_tokens, CAST(FLOOR(value * 10) AS BIGINT) AS output_tokens
        FROM {events}""",
    "doc_row": """
        SELECT doc_id, lang, source, n_chars, CAST(substring(source, 4) AS BIGINT) AS source_id,
               <sentence> AS name,
               CASE WHEN n_chars % 11 = 0 THEN NULL ELSE n_chars % 37 END AS location_id,
               DATE '2026-04-10' + CAST(n_chars % 60 - 5 AS INT) AS first_day
        FROM {documents}""",
    "xev": """
        SELECT doc_id AS id, doc_id AS crawl_result_id, name, location_id, source_id,
               'https://crawl.example.org/' || CAST(n_chars AS STRING) AS url,
               '[{{"start_date":"' || CAST(first_day AS STRING) || '","start_time":" 7:30 PM "}},"note",'
               || '{{"start_date":"' || CAST(first_day + 7 AS STRING) || '","end_date":"soon","end_time":9}},{{"start_date":"2020-01-01"}}]' AS occurrences,
               '["' || lang || '","  ' || source || ' ","",null,42]' AS tags
        FROM {doc_row}""",
    "gold": """
        SELECT x.doc_id AS id, x.name, COALESCE(x.location_id, 1) AS location_id, x.source_id, x.first_day,
               CASE WHEN b.quality = 1 THEN 'active' ELSE 'archived' END AS status
        FROM {doc_row} x JOIN {labels} b ON b.doc_id = x.doc_id""",
    "new_xev": """
        SELECT x.doc_id AS id, x.name, x.location_id, x.source_id, x.first_day
        FROM {doc_row} x LEFT JOIN {labels} b ON b.doc_id = x.doc_id WHERE b.doc_id IS NULL""",
}


# The sentence of a whole text with the smallest digest: copies of a text mostly agree on it. The two
# databases write it differently.
SENTENCE = {
    "spark": "trim(substring(array_min(transform(split(replace(text, chr(10), '. '), '[.] '), s -> md5(s) || s)), 33))",
    "check": "trim(substring(list_min(list_transform(string_split(replace(text, chr(10), '. '), '. '), lambda s: md5(s) || s)), 33))",
}


def _references(text: str) -> list[str]:
    return sorted(set(re.findall(r"(?<!{){(\w+)}(?!})", text)))


class Bound:
    """Given tables and bound views of one data folder as DataFrames."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder
        # Sessions made elsewhere may lack these settings of ours.
        for key in CARRIED:
            spark.conf.set(key, SETTINGS[key])

    def over(self, **given: DataFrame) -> Bound:
        """The same views over other rows of the named given tables."""
        out = Bound(self.spark, self.folder)
        out.__dict__.update(given)
        return out

    def __getattr__(self, name: str) -> DataFrame:
        if name in GIVEN:
            return self.spark.read.parquet(f"{self.folder}/{name}.parquet")
        if name not in VIEWS:
            raise AttributeError(name)
        text = VIEWS[name].replace("<sentence>", SENTENCE["spark"])
        return self.spark.sql(text, **{ref: getattr(self, ref) for ref in _references(text)})


@lru_cache(maxsize=None)
def _needed(name: str) -> tuple[str, ...]:
    out: list[str] = []
    for ref in _references(VIEWS[name]):
        if ref in VIEWS:
            out += [r for r in _needed(ref) if r not in out]
    return tuple(out + [name])


def check_sql(text: str) -> str:
    """SQL of a check: bound views named in ``text`` as ``{name}`` become common table expressions."""
    order: list[str] = []
    for ref in _references(text):
        if ref in VIEWS:
            order += [r for r in _needed(ref) if r not in order]
    names = {n: n for n in [*GIVEN, *VIEWS]}
    ctes = ", ".join(f"{n} AS ({VIEWS[n].format(**names)})" for n in order).replace("<sentence>", SENTENCE["check"])
    body = text.format(**names).strip()
    if not ctes:
        return body
    return f"WITH {ctes}, {body[5:]}" if body.upper().startswith("WITH ") else f"WITH {ctes} {body}"
