"""Queries over name similarity and event matching."""

from __future__ import annotations

from pyspark.sql import functions as F

from marquesina.operators import matching as M
from marquesina.plans.bindings import DOCUMENTS_DAY
from marquesina.plans.registry import query

def today():
    return F.lit(DOCUMENTS_DAY).cast("date")

DAY = f"DATE '{DOCUMENTS_DAY}'"


def golden(b):
    """Labelled documents as golden events with two days and one source each."""
    events = b.gold.select("id", "name", "location_id", "status", F.lit(None).cast("date").alias("deleted_at"))
    days = b.gold.select(F.col("id").alias("event_id"), F.explode(F.array("first_day", F.date_add("first_day", 7))).alias("start_date"))
    links = b.gold.select(F.col("id").alias("event_id"), "source_id", F.col("id").alias("extracted_event_id"))
    return events, days, links


def index_of(b):
    events, days, links = golden(b)
    return M.candidate_index(events, days, b.loc, links, today())


def new_rows(b):
    """Unlabelled documents as rows to match, one line per valid day."""
    days = F.filter(F.array("first_day", F.date_add("first_day", 7)), lambda d: d.between(today(), F.date_add(today(), 90)))
    rows = b.new_xev.filter("location_id IS NOT NULL AND name <> ''").select("id", "name", "location_id", "source_id", F.explode(days).alias("day"))
    return M.with_place(rows, b.loc)


STEM = """CASE WHEN w IN ('dinner', 'dining', 'diner') THEN 'dine' WHEN w IN ('sun', 'mon', 'fri') THEN w || 'day'
  WHEN w LIKE '%ency' AND LENGTH(w) > 6 THEN substring(w, 1, LENGTH(w) - 4) || 'enc' WHEN w LIKE '%ence' AND LENGTH(w) > 6 THEN substring(w, 1, LENGTH(w) - 4) || 'enc'
  WHEN w LIKE '%ing' AND LENGTH(w) > 5 THEN substring(w, 1, LENGTH(w) - 3) WHEN w LIKE '%tion' AND LENGTH(w) > 6 THEN substring(w, 1, LENGTH(w) - 4) || 't'
  WHEN w LIKE '%sion' AND LENGTH(w) > 6 THEN substring(w, 1, LENGTH(w) - 4) || 's' WHEN w LIKE '%ies' AND LENGTH(w) > 5 THEN substring(w, 1, LENGTH(w) - 3) || 'y'
  WHEN w LIKE '%es' AND LENGTH(w) > 4 THEN substring(w, 1, LENGTH(w) - 2) WHEN w LIKE '%s' AND LENGTH(w) > 3 THEN substring(w, 1, LENGTH(w) - 1) ELSE w END"""


def norm_sql(c):
    return f"trim(regexp_replace(regexp_replace(replace(lower(strip_accents({c})), '_', ''), '[^\\p{{{{L}}}}\\p{{{{N}}}}_\\s]', ' ', 'g'), '\\s+', ' ', 'g'))"


CORE_RAW = "regexp_replace(regexp_replace(st, '^.+?\\s+(?:presents?|productions?)\\s*:?\\s*', '', 'i'), '^hosted\\s+by\\s+.+?:\\s*', '', 'i')"
NUMBERS = ["'\\d{{3,4}}\\s*(?:am|pm)$', 0", "'night\\s*(\\d+)', 1", "'ep(?:isode)?\\.?\\s*(\\d+)', 1", "'^\\s*(\\d+)\\s*$', 1"] + [
    f"'\\b{k}\\.?\\s*(\\d+)', 1" for k in ("set", "part", "vol", "volume", "chapter", "session", "round")]
NUMBERS_SQL = ", ".join(f"regexp_extract(norm, {n})" for n in NUMBERS)

# Features of the distinct names of a table ``nm(name)`` and the similarity test of two of them.
FEATURES = f"""
s1 AS (SELECT name, trim(regexp_replace(regexp_replace(trim(name), '^\\s*\\[[^\\]]+\\]\\s*', ''), '^FIDO\\s+', '', 'i')) AS st FROM nm),
s2 AS (SELECT name, st, {CORE_RAW} AS cr FROM s1),
s3 AS (SELECT name, {norm_sql('name')} AS norm, {norm_sql('st')} AS strp,
  {norm_sql("CASE WHEN instr(cr, ':') > 0 AND LENGTH(trim(split_part(cr, ':', 1))) >= 5 THEN trim(split_part(cr, ':', 1)) ELSE trim(cr) END")} AS core,
  instr(name, ':') > 0 AND trim(substring(name, instr(name, ':') + 1)) <> '' AS has_sub, {norm_sql("substring(name, instr(name, ':') + 1)")} AS sub FROM s2),
s4 AS (SELECT *, list_distinct(list_filter(string_split(norm, ' '), lambda w: LENGTH(w) >= 3 AND w NOT IN ('the', 'and', 'for', 'with', 'from', 'into', 'your') AND NOT regexp_full_match(w, '20\\d\\d'))) AS words FROM s3),
feat AS (SELECT *, list_distinct(list_transform(words, lambda w: {STEM})) AS stems, [contains(norm, 'men'), contains(norm, 'women'), contains(norm, 'early'), contains(norm, 'late')] AS marks,
  [{NUMBERS_SQL}] AS numbers, trim(regexp_extract(norm, 'vs\\.?\\s+(.+?)(?:\\s*-|$)', 1)) AS opp,
  list_sort(list_distinct(regexp_extract_all(norm, '\\b\\d{{{{1,2}}}}\\s*\\d{{{{2}}}}\\s*(?:am|pm)\\b'))) AS times FROM s4)""".replace("{{{{", "{{").replace("}}}}", "}}")


def either(x, y):
    return f"(contains({x}, {y}) OR contains({y}, {x}))"


def word_sql(c, stemmed):
    inter = f"len(list_intersect(a.{c}, b.{c}))"
    small, total = f"LEAST(len(a.{c}), len(b.{c}))", f"(len(a.{c}) + len(b.{c}) - {inter})"
    more = f" OR ({small} >= 2 AND {inter}::DOUBLE / {small} >= 0.75)" if stemmed else ""
    return f"({small} > 0 AND ({inter} = {small} OR {inter}::DOUBLE / {total} >= 0.7{more}))"


FALSE_POSITIVE = f"""(a.marks <> b.marks OR list_bool_or(list_transform(range(1, len(a.numbers) + 1), lambda i: a.numbers[i] <> '' AND b.numbers[i] <> '' AND a.numbers[i] <> b.numbers[i]))
  OR (a.opp <> '' AND b.opp <> '' AND NOT {either('a.opp', 'b.opp')}) OR (len(a.times) > 0 AND len(b.times) > 0 AND a.times <> b.times))"""
ALIKE = f"""(a.norm = b.norm OR a.strp = b.strp OR (LENGTH(a.norm) >= 5 AND LENGTH(b.norm) >= 5 AND {either('a.norm', 'b.norm')})
  OR (LENGTH(a.strp) >= 5 AND LENGTH(b.strp) >= 5 AND {either('a.strp', 'b.strp')})
  OR (CASE WHEN a.core = b.core THEN NOT (a.has_sub AND b.has_sub) OR {either('a.sub', 'b.sub')} ELSE LENGTH(a.core) >= 5 AND LENGTH(b.core) >= 5 AND {either('a.core', 'b.core')} END)
  OR {word_sql('words', False)} OR {word_sql('stems', True)})"""
SIMILAR = f"(NOT {FALSE_POSITIVE} AND {ALIKE})"
INDEX_SQL = f"""
ix AS (SELECT g.id AS event_id, g.name, g.location_id, g.source_id, d.day, CAST(ROUND(l.lat, 5) AS STRING) || ',' || CAST(ROUND(l.lng, 5) AS STRING) AS point
  FROM {{gold}} g JOIN (SELECT id, first_day AS day FROM {{gold}} UNION ALL SELECT id, first_day + 7 FROM {{gold}}) d ON d.id = g.id LEFT JOIN {{loc}} l ON l.id = g.location_id
  WHERE g.status = 'active' AND d.day BETWEEN {DAY} - 10 AND {DAY} + 90),
rw AS (SELECT x.id, x.name, x.location_id, x.source_id, d.day, CAST(ROUND(l.lat, 5) AS STRING) || ',' || CAST(ROUND(l.lng, 5) AS STRING) AS point
  FROM {{new_xev}} x JOIN (SELECT id, first_day AS day FROM {{new_xev}} UNION ALL SELECT id, first_day + 7 FROM {{new_xev}}) d ON d.id = x.id LEFT JOIN {{loc}} l ON l.id = x.location_id
  WHERE x.location_id IS NOT NULL AND x.name <> '' AND d.day BETWEEN {DAY} AND {DAY} + 90),
nm AS (SELECT name FROM ix UNION SELECT name FROM rw)"""


@query("h6_h7_similar_pairs", "WITH nm AS (SELECT DISTINCT name FROM {doc_row} WHERE location_id IS NOT NULL)," + FEATURES + f"""
SELECT DISTINCT x.location_id, x.name, y.name AS other, a.norm = b.norm AS exact FROM (SELECT DISTINCT location_id, name FROM {{doc_row}}) x JOIN (SELECT DISTINCT location_id, name FROM {{doc_row}}) y ON x.location_id = y.location_id
JOIN feat a ON a.name = x.name JOIN feat b ON b.name = y.name WHERE {SIMILAR}""")
def _(b):
    names = b.doc_row.filter("location_id IS NOT NULL").select(F.col("location_id").cast("string").alias("block"), "name").distinct()
    pairs = M.similar_pairs(names, names, M.features_of(names))
    return pairs.select(F.col("block").cast("long").alias("location_id"), "name", "other", "exact")


@query("h6_false_positives", """
WITH low AS (SELECT DISTINCT id % 4 AS k, lower(name) AS name FROM {ev}),
nm AS (SELECT lead || name AS name FROM (SELECT DISTINCT name FROM low), (VALUES (''), ('early '), ('late '), ('men '), ('women ')) v(lead)
  UNION SELECT 'jazz ' || name || ' set ' || CAST(k AS STRING) FROM low),""" + FEATURES + f"""
SELECT a.name, b.name AS other FROM feat a JOIN feat b ON a.name < b.name WHERE {FALSE_POSITIVE} AND {ALIKE}""")
def _(b):
    low = F.lower("name")
    made = F.explode(F.array(
        low, F.concat(F.lit("jazz "), low, F.lit(" set "), (F.col("id") % 4).cast("string")), *[F.concat(F.lit(f"{lead} "), low) for lead in ("early", "late", "men", "women")]))
    return M.false_positives(b.ev.select(made.alias("name")).distinct())


LEVELS = " UNION ALL ".join(
    f"SELECT rw.id, {n} AS level, a.norm <> b.norm AS partial, ix.event_id FROM rw JOIN ix ON ix.{k} = rw.{k} AND ix.day = rw.day JOIN feat a ON a.name = rw.name JOIN feat b ON b.name = ix.name WHERE {SIMILAR}"
    for n, k in enumerate(["location_id", "point", "source_id"], 1))


@query("c12_c13_e1_match_existing", "WITH " + INDEX_SQL.strip() + "," + FEATURES + f""", m AS ({LEVELS})
SELECT id, level, NOT partial AS exact, event_id FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY id ORDER BY level, partial, event_id) AS r FROM m) WHERE r = 1""")
def _(b):
    return M.match_existing(new_rows(b), index_of(b))


@query("m3_batch_decisions")
def _(b):
    return M.match_batch(new_rows(b), index_of(b))
