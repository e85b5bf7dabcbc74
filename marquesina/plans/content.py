"""Queries over crawled text, extracted JSON, show payloads and log lines."""

from __future__ import annotations

from pyspark.sql import functions as F

from marquesina.functions import dates as DT, jsons as J, names as N, text as T
from marquesina.operators import content as C
from marquesina.plans.bindings import DOCUMENTS_DAY
from marquesina.plans.registry import query

def today():
    return F.lit(DOCUMENTS_DAY).cast("date")

DAY = f"DATE '{DOCUMENTS_DAY}'"
NL = "chr(10)"


def marked(b):
    """Documents with every sentence turned into a marked event line."""
    return b.documents.select("doc_id", F.replace("text", F.lit(". "), F.lit(".\n### [x] ")).alias("text"))


MARKED = "(SELECT doc_id, replace(text, '. ', '.' || chr(10) || '### [x] ') AS text FROM {documents})"


def strings(c, sep="|"):
    return F.array_join(c, sep)


@query("a10_combined_contents", """
SELECT source_id AS crawl_result_id, ROW_NUMBER() OVER (PARTITION BY source_id ORDER BY n_chars, doc_id) AS place,
       md5('https://crawl.example.org/' || CAST(doc_id AS STRING) || chr(10) || text) AS digest
FROM (SELECT d.*, x.source_id FROM {documents} d JOIN {doc_row} x ON x.doc_id = d.doc_id WHERE d.lang <> 'de')""")
def _(b):
    r = b.documents.select(
        F.substring("source", 4, 9).cast("long").alias("crawl_result_id"), F.col("doc_id").alias("id"), F.col("n_chars").alias("created_at"),
        F.concat(F.lit("https://crawl.example.org/"), F.col("doc_id").cast("string")).alias("url"), F.col("text").alias("content"),
        F.when(F.col("lang") == "de", "failed").otherwise("crawled").alias("status"))
    return C.combine_url_contents(r, F.floor(F.col("created_at") / 256)).select("crawl_result_id", "place", F.md5("content").alias("digest"))


@query("a10_fit_or_raw", """
SELECT doc_id, CASE WHEN fit >= 500 THEN fit ELSE LENGTH(text) END AS kept FROM (
  SELECT doc_id, text, CAST(list_sum(list_transform(lines, lambda x: LENGTH(x))) + len(lines) - 1 AS BIGINT) AS fit
  FROM (SELECT doc_id, text, list_distinct(string_split(text, chr(10))) AS lines FROM {documents}))""")
def _(b):
    # The condensed text is the page without its repeated lines.
    fit = F.array_join(F.array_distinct(F.split("text", "\n")), "\n")
    return b.documents.select("doc_id", F.length(C.fit_or_raw(fit, F.col("text"))).cast("long").alias("kept"))


def payloads(b):
    """A nested show payload per document, some in a callback, one event key repeated."""
    x = b.doc_row
    show = lambda when, hour: F.struct(F.lit("viernes").alias("dia"), hour.alias("hora"), when.alias("proxima_fecha"))
    at = lambda d, t: F.concat(F.date_format(F.date_add("first_day", d), "yyyy-MM-dd"), F.lit(t))
    shows = F.create_map(F.lit("1"), show(at(0, " 20:00"), F.lit("20:00")), F.lit("2"), show(F.lit(""), F.lit("21:00")), F.lit("3"), show(at(7, " 09:05"), F.lit("9")))
    venue = lambda name: F.struct(name.alias("nombre"), F.lit("Calle 1").alias("direccion"), F.col("lang").alias("zona"), shows.alias("funciones"))
    classes = F.when(F.col("lang") == "en", F.create_map(F.lit("1"), F.struct(F.lit("Danza").alias("descripcion")), F.lit("2"), F.struct(F.lit("Humor").alias("descripcion"))))
    event = F.struct(F.col("name").alias("titulo"), F.concat(F.lit("obra"), F.col("doc_id").cast("string")).alias("url"), classes.alias("clasificaciones"),
                     F.create_map(F.lit("a"), venue(F.col("source")), F.lit("b"), venue(F.lit("")), F.lit("c"), venue(F.lit("Gran Sala"))).alias("lugares"))
    body = F.to_json(event)
    text = F.concat(F.lit('{"k":{"titulo":"old"},"k":'), body, F.lit("}"))
    wrapped = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("\ufeffjsonCallback("), text, F.lit(");"))).when(
        F.col("doc_id") % 3 == 1, F.concat(F.lit("  cb1( "), text, F.lit(" ) "))).otherwise(text)
    return x.select(F.col("doc_id").alias("payload_id"), wrapped.alias("payload"), "first_day")


@query("a11_unwrapped_payloads", "SELECT doc_id AS payload_id, name AS titulo, 1 AS n FROM {doc_row}")
def _(b):
    return C.api_events(payloads(b), "jsonCallback").select("payload_id", F.col("event.titulo").alias("titulo"), F.lit(1).alias("n"))


@query("k4_api_event_rows", """
SELECT doc_id AS payload_id, v.location, name, CAST(first_day AS STRING) || ' 8:00 PM;' || CAST(first_day + 7 AS STRING) || ' 9:05 AM' AS shows,
       CASE WHEN lang = 'en' THEN 'Danza, Humor en ' || v.location || '.' ELSE 'Evento en ' || v.location || '.' END AS description,
       'https://www.alternativateatral.com/obra' || CAST(doc_id AS STRING) AS url,
       CASE WHEN lang = 'en' THEN 'Danza|Humor' ELSE 'Teatro' END AS hashtags, CASE WHEN lang = 'en' THEN '💃' ELSE '📅' END AS emoji
FROM {doc_row}, LATERAL (SELECT source AS location UNION ALL SELECT 'Gran Sala') v""")
def _(b):
    shows = F.array_join(F.transform("occurrences", lambda o: F.concat_ws(" ", o["start_date"], o["start_time"])), ";")
    return C.api_event_rows(C.api_events(payloads(b), "jsonCallback")).select(
        "payload_id", "location", "name", shows.alias("shows"), "description", "url", strings("hashtags").alias("hashtags"), "emoji")


@query("b4_shows_in_window", f"SELECT doc_id AS payload_id FROM {{doc_row}} WHERE first_day BETWEEN {DAY} AND {DAY} + 29 OR first_day + 7 BETWEEN {DAY} AND {DAY} + 29")
def _(b):
    now = F.lit(f"{DOCUMENTS_DAY} 00:00:00").cast("timestamp")
    e = C.api_events(payloads(b), "jsonCallback")
    return e.filter(J.has_show_in_window(F.col("event"), now, 30)).select("payload_id")


@query("a21_markdown_digest", """
SELECT doc_id AS payload_id, '## ' || name || chr(10) || CASE WHEN lang = 'en' THEN '**Tags:** Danza, Humor' || chr(10) ELSE '' END
  || '**Venue:** ' || source || chr(10) || rest || rest || '**Venue:** Gran Sala' || chr(10) || rest
  || '**URL:** https://www.alternativateatral.com/obra' || CAST(doc_id AS STRING) || chr(10) AS digest
FROM (SELECT *, '**Address:** Calle 1, ' || lang || chr(10) || '- viernes 20:00 (next: ' || CAST(first_day AS STRING) || ' 20:00)' || chr(10)
  || '- viernes 21:00' || chr(10) || '- viernes 9 (next: ' || CAST(first_day + 7 AS STRING) || ' 09:05)' || chr(10) AS rest FROM {doc_row})""")
def _(b):
    return C.api_events(payloads(b), "jsonCallback").select("payload_id", J.markdown_digest(F.col("event_id"), F.col("event")).alias("digest"))


@query("h20_class_emoji", "SELECT doc_id AS payload_id, CASE WHEN lang = 'en' THEN '💃' ELSE '📅' END AS emoji FROM {doc_row}")
def _(b):
    return C.api_events(payloads(b), "jsonCallback").select("payload_id", J.class_emoji(F.col("event")).alias("emoji"))


def responses(b):
    """Model answers in the shapes that occur: an object, a bare array, broken text."""
    x = b.doc_row
    occ = F.lit('"occurrences":[{"start_date":"2026-04-15"},{"start_date":"2026-04-16"}]')
    first = F.concat(F.expr("regexp_replace(to_json(named_struct('name', name)), '[}]$', '')"), F.lit(","), occ, F.lit(',"location":'),
                     F.when(F.col("lang") == "fr", F.concat(F.lit('{"venue_name":"'), "source", F.lit('"}'))).otherwise(F.concat(F.lit('"'), "source", F.lit('"'))),
                     F.lit(',"hashtags":["'), "lang", F.lit('"]}'))
    second = F.lit('{"name":"Second","location_name":"Hall","tags":["a","b"],"url":"u"}')
    both = F.concat(F.lit("["), first, F.lit(","), second, F.lit("]"))
    body = F.when(F.col("lang") == "en", F.concat(F.lit('{"events":'), both, F.lit("}"))).when(F.col("lang") == "de", F.concat(both, F.lit("oops"))).when(
        F.col("lang") == "es", "").otherwise(both)
    return x.select(F.col("doc_id").alias("crawl_result_id"), body.alias("extracted_content"))


@query("a12_extracted_rows", """
SELECT d.doc_id AS crawl_result_id, v.position, CASE v.position WHEN 0 THEN substring(d.name, 1, 500) ELSE 'Second' END AS name,
       CASE v.position WHEN 0 THEN d.source ELSE 'Hall' END AS location_name,
       CASE v.position WHEN 0 THEN '["' || d.lang || '"]' ELSE '["a","b"]' END AS tags, CASE v.position WHEN 0 THEN '' ELSE 'u' END AS url,
       CASE v.position WHEN 0 THEN '[{{"start_date":"2026-04-15"}},{{"start_date":"2026-04-16"}}]' ELSE '[]' END AS occurrences
FROM {doc_row} d, (SELECT 0 AS position UNION ALL SELECT 1) v
WHERE d.lang IN ('en', 'fr') AND d.doc_id NOT IN (SELECT doc_id FROM {labels})""")
def _(b):
    return C.extracted_rows(responses(b), b.labels.select(F.col("doc_id").alias("crawl_result_id"))).select(
        "crawl_result_id", "position", "name", "location_name", "tags", "url", "occurrences")


@query("l6_d22_extraction_quality", """
SELECT doc_id AS crawl_result_id, CASE lang WHEN 'de' THEN 'invalid' WHEN 'es' THEN 'empty' ELSE 'ok' END AS verdict,
       CASE WHEN lang IN ('de', 'es') THEN 0 ELSE 2 END AS event_count, CASE WHEN lang IN ('de', 'es') THEN 0 ELSE 2 END AS occurrence_count FROM {documents}""")
def _(b):
    return C.extraction_quality(responses(b))


@query("k3_response_sizes", "SELECT doc_id AS crawl_result_id, CASE WHEN lang IN ('de', 'es') THEN 0 ELSE 2 END AS n FROM {documents}")
def _(b):
    return responses(b).select("crawl_result_id", F.size(J.response_events(F.col("extracted_content"))).alias("n"))


@query("k1_json_containers", "SELECT id, id % 5 < 2 AS is_container, id % 5 = 0 AS is_list FROM {xev}")
def _(b):
    kind = F.col("id") % 5
    raw = F.when(kind == 0, F.col("occurrences")).when(kind == 1, F.concat(F.lit('{"url": "'), "url", F.lit('"}'))).when(kind == 2, F.col("id").cast("string")).when(kind == 3, F.col("url"))
    held = J.json_container(raw)
    return b.xev.select("id", held.isNotNull().alias("is_container"), F.coalesce(F.startswith(F.to_json(held), F.lit("[")), F.lit(False)).alias("is_list"))


@query("k2_parsed_tags", "SELECT doc_id AS id, lang || '|' || source AS tags FROM {documents}")
def _(b):
    return b.xev.select("id", strings(J.parse_tags(F.col("tags"))).alias("tags"))


@query("b3_i1_i2_occurrence_window", f"""
SELECT doc_id AS id, concat_ws(';', CASE WHEN first_day BETWEEN {DAY} AND {DAY} + 90 THEN CAST(first_day AS STRING) || ' 7:30 PM' END,
  CASE WHEN first_day + 7 BETWEEN {DAY} AND {DAY} + 90 THEN CAST(first_day + 7 AS STRING) END) AS kept FROM {{doc_row}}""")
def _(b):
    kept = J.parse_occurrences(F.col("occurrences"), today())
    return b.xev.select("id", F.array_join(F.transform(kept, lambda o: F.concat_ws(" ", o["start_date"].cast("string"), o["start_time"], o["end_date"].cast("string"), o["end_time"])), ";").alias("kept"))


@query("a20_profile_documents", """
SELECT conv_id AS profile, 0 AS number, 'Instagram Profile: @' || CAST(conv_id AS STRING) || chr(10) || 'Bio: ' || MAX(role) || chr(10) || 'Posts harvested: ' || CAST(COUNT(*) AS STRING)
  || chr(10) || chr(10) || '---' || chr(10) AS content FROM {conversations} GROUP BY conv_id
UNION ALL SELECT conv_id, n, 'Post ' || CAST(n AS STRING) || ':' || chr(10) || '  Date: 2026-04-0' || CAST(turn % 9 + 1 AS STRING) || chr(10) || '  Caption: ' || text || chr(10)
FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY conv_id ORDER BY turn) AS n FROM {conversations})""")
def _(b):
    posts = b.conversations.select(
        F.col("conv_id").cast("string").alias("profile"), F.lit(None).cast("string").alias("full_name"), F.col("role").alias("bio"), F.col("turn").alias("seq"),
        F.concat(F.lit("2026-04-0"), (F.col("turn") % 9 + 1).cast("string")).alias("posted_at"), F.lit("").alias("location_name"), F.col("text").alias("caption"), F.lit(None).cast("string").alias("url"))
    return C.profile_documents(posts, F.floor(F.col("seq") / 1024)).select(F.col("profile").cast("long").alias("profile"), "number", "content")


@query("e11_harvested_posts", """
SELECT source AS profile, code, seq, rank FROM (
  SELECT source, code, MIN(doc_id) AS seq, ROW_NUMBER() OVER (PARTITION BY source ORDER BY MIN(doc_id), code) AS rank
  FROM (SELECT source, doc_id, 'C' || CAST(n_chars % 60 AS STRING) AS code FROM {documents}) GROUP BY source, code) WHERE rank <= 12""")
def _(b):
    link = F.concat(F.lit("https://www.instagram.com/p/C"), (F.col("n_chars") % 60).cast("string"), F.lit("/?img=1"))
    posts = b.documents.select(F.col("source").alias("profile"), T.post_code(link).alias("code"), F.col("doc_id").alias("seq"))
    return C.harvested_posts(posts, 12)


@query("d19_event_count_estimate", """
SELECT doc_id, greatest(CAST(FLOOR(len(regexp_extract_all(t, '(?i)(?:January|February|March|April|May|June|July|August|September|October|November|December)\\s+\\d{{1,2}}')) / 2) AS INT),
  CAST(len(regexp_extract_all(t, '(?i)View\\s+Event|View\\s+Details|More\\s+Info')) AS INT), CAST(FLOOR(len(regexp_extract_all(t, '/events?/[^/\\s"'']+')) / 2) AS INT),
  CAST(FLOOR(len(regexp_extract_all(t, '/listings?/[^/\\s"'']+')) / 2) AS INT)) AS estimate
FROM (SELECT doc_id, replace(replace(replace(text, ' the ', ' View Event '), ' and ', ' may 12 '), ' of ', ' /events/x ') AS t FROM {documents})""")
def _(b):
    t = F.replace(F.replace(F.replace("text", F.lit(" the "), F.lit(" View Event ")), F.lit(" and "), F.lit(" may 12 ")), F.lit(" of "), F.lit(" /events/x "))
    return b.documents.select("doc_id", C.event_count_estimate(t).alias("estimate"))


@query("d19_marker_count", "SELECT doc_id, CAST(len(regexp_extract_all(text, '(?m)^### \\[')) AS INT) AS markers FROM " + MARKED)
def _(b):
    return marked(b).select("doc_id", C.marker_count(F.col("text")).alias("markers"))


@query("b21_routing_flag", "SELECT doc_id, LENGTH(text) * 4 > 60000 AS two_step FROM {documents}")
def _(b):
    return b.documents.select("doc_id", C.is_large_page(F.repeat("text", F.lit(4))).alias("two_step"))


@query("l1_chunks_by_event", """
WITH m AS """ + MARKED + """, lines AS (SELECT doc_id, UNNEST(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM m),
n AS (SELECT *, SUM(CASE WHEN starts_with(trim(line), '### [') THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS k FROM lines)
SELECT doc_id, CAST(GREATEST(FLOOR((k - 1) / 20), 0) AS INT) AS chunk, md5(STRING_AGG(line, chr(10) ORDER BY i)) AS digest FROM n GROUP BY 1, 2""")
def _(b):
    return marked(b).select("doc_id", F.posexplode(C.chunk_by_events(F.col("text"), 20)).alias("chunk", "c")).select("doc_id", "chunk", F.md5("c").alias("digest"))


# Pages here have no blank lines, so a long page is one long paragraph and is packed by lines.
@query("l2_chunks_by_size", """
WITH RECURSIVE l AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM {documents} WHERE LENGTH(text) > 1500),
s AS (SELECT doc_id, ls, 1 AS i, 0 AS chunk, LENGTH(ls[1]) + 1 AS size FROM l UNION ALL
  SELECT doc_id, ls, i + 1, CASE WHEN size + LENGTH(ls[i + 1]) + 1 > 1500 THEN chunk + 1 ELSE chunk END,
         CASE WHEN size + LENGTH(ls[i + 1]) + 1 > 1500 THEN LENGTH(ls[i + 1]) + 1 ELSE size + LENGTH(ls[i + 1]) + 1 END FROM s WHERE i < len(ls)),
c AS (SELECT doc_id, chunk, STRING_AGG(ls[i], chr(10) ORDER BY i) AS c FROM s GROUP BY doc_id, chunk)
SELECT doc_id, chunk, LENGTH(c) AS size, md5(c) AS digest FROM c UNION ALL SELECT doc_id, 0, LENGTH(text), md5(text) FROM {documents} WHERE LENGTH(text) <= 1500""")
def _(b):
    return b.documents.select("doc_id", F.posexplode(C.chunk_by_size(F.col("text"), 1500)).alias("chunk", "c")).select(
        "doc_id", "chunk", F.length("c").cast("long").alias("size"), F.md5("c").alias("digest"))


@query("l3_chunk_method", """
SELECT doc_id, CASE WHEN k > 20 THEN 'events' WHEN LENGTH(text) <= 1500 THEN 'single' ELSE 'size' END AS method
FROM (SELECT doc_id, text, len(regexp_extract_all(text, '(?m)^[ \\t]*### \\[')) AS k FROM """ + MARKED + ")")
def _(b):
    return marked(b).select("doc_id", C.chunk(F.col("text"), 20, 1500)["method"].alias("method"))


@query("l4_prompt_inputs", """
SELECT r.id, r.source_id, s.name, c.notes, CASE WHEN starts_with(t.crawled_content, 'http') THEN split_part(t.crawled_content, chr(10), 1) ELSE '' END AS url,
       LEAST(LENGTH(t.crawled_content), 120000) AS size, COALESCE(k.n, 0) AS known_events
FROM {res} r JOIN {content} t ON t.crawl_result_id = r.id LEFT JOIN {src} s ON s.id = r.source_id LEFT JOIN {cfg} c ON c.source_id = r.source_id
LEFT JOIN (SELECT source_id, COUNT(*) AS n FROM {gold} WHERE status = 'active' GROUP BY 1) k ON k.source_id = r.source_id WHERE LENGTH(t.crawled_content) >= 500""")
def _(b):
    p = C.prompt_inputs(b.content, b.res, b.src, b.cfg, b.gold.filter("status = 'active'"), today())
    return p.select("id", "source_id", "name", "notes", "url", F.length("page_text").cast("long").alias("size"), "known_events")


@query("l5_f9_batches", """
SELECT crawl_job_id AS crawl_result_id, id AS position, place, CAST(FLOOR((place - 1) / 30) AS INT) AS batch FROM (
  SELECT source_id AS crawl_job_id, id, ROW_NUMBER() OVER (PARTITION BY source_id ORDER BY id) AS place FROM {res}) WHERE place <= 90""")
def _(b):
    events = b.res.select(F.col("source_id").alias("crawl_result_id"), F.col("id").alias("position"))
    return C.batches(events, F.floor(F.col("position") / 4096))


@query("c24_enrichment_merge", """
WITH x AS (SELECT name, max_by(lang, doc_id) AS lang FROM {doc_row} WHERE doc_id IN (SELECT doc_id FROM {labels}) GROUP BY name)
SELECT d.doc_id, COALESCE('about ' || x.lang, 'Event at ' || d.source) AS description, COALESCE(x.lang, 'Event') AS hashtags, CASE WHEN x.name IS NULL THEN '📅' ELSE '🎵' END AS emoji
FROM {doc_row} d LEFT JOIN x ON x.name = d.name""")
def _(b):
    known = b.doc_row.join(b.labels, "doc_id", "left_semi").select(
        "name", F.concat(F.lit("about "), "lang").alias("description"), F.array("lang").alias("hashtags"), F.lit("🎵").alias("emoji"), F.col("doc_id").alias("seq"))
    return C.enriched(b.doc_row.select("doc_id", "name", F.col("source").alias("location")), known).select("doc_id", "description", strings("hashtags").alias("hashtags"), "emoji")


# Names and texts.


@query("h1_normalized_names", "SELECT doc_id, trim(regexp_replace(regexp_replace(replace(lower(strip_accents(name)), '_', ''), '[^\\p{{L}}\\p{{N}}_\\s]', ' ', 'g'), '\\s+', ' ', 'g')) AS norm FROM {doc_row}")
def _(b):
    return b.doc_row.select("doc_id", T.normalize_name(F.col("name")).alias("norm"))


WORDS_SQL = """list_filter(list_distinct(string_split(trim(regexp_replace(regexp_replace(replace(lower(strip_accents(text)), '_', ''), '[^\\p{{L}}\\p{{N}}_\\s]', ' ', 'g'), '\\s+', ' ', 'g')), ' ')),
  lambda w: LENGTH(w) >= 3 AND w NOT IN ('the', 'and', 'for', 'with', 'from', 'into', 'your') AND NOT regexp_full_match(w, '20\\d\\d'))"""


@query("h3_significant_words", f"SELECT doc_id, list_aggregate(list_sort({WORDS_SQL}), 'string_agg', ' ') AS words FROM {{documents}}")
def _(b):
    w = F.sort_array(N.significant_words(T.normalize_name(F.col("text"))))
    return b.documents.select("doc_id", T.let(w, lambda x: F.when(F.size(x) > 0, strings(x, " "))).alias("words"))


@query("h2_stems", """
SELECT word, CASE WHEN word IN ('dinner', 'dining', 'diner') THEN 'dine' WHEN word IN ('sun', 'mon', 'fri') THEN word || 'day'
  WHEN word LIKE '%ency' AND LENGTH(word) > 6 THEN substring(word, 1, LENGTH(word) - 4) || 'enc' WHEN word LIKE '%ence' AND LENGTH(word) > 6 THEN substring(word, 1, LENGTH(word) - 4) || 'enc'
  WHEN word LIKE '%ing' AND LENGTH(word) > 5 THEN substring(word, 1, LENGTH(word) - 3) WHEN word LIKE '%tion' AND LENGTH(word) > 6 THEN substring(word, 1, LENGTH(word) - 4) || 't'
  WHEN word LIKE '%sion' AND LENGTH(word) > 6 THEN substring(word, 1, LENGTH(word) - 4) || 's' WHEN word LIKE '%ies' AND LENGTH(word) > 5 THEN substring(word, 1, LENGTH(word) - 3) || 'y'
  WHEN word LIKE '%es' AND LENGTH(word) > 4 THEN substring(word, 1, LENGTH(word) - 2) WHEN word LIKE '%s' AND LENGTH(word) > 3 THEN substring(word, 1, LENGTH(word) - 1) ELSE word END AS stem
FROM (SELECT DISTINCT UNNEST(string_split(lower(replace(text, chr(10), ' ')), ' ')) AS word FROM {documents})""")
def _(b):
    words = b.documents.select(F.explode(F.split(F.lower(F.replace("text", F.lit("\n"), F.lit(" "))), " ")).alias("word")).distinct()
    return words.select("word", N.stem(F.col("word")).alias("stem"))


@query("h4_h5_titles", """
SELECT doc_id, name AS stripped, CASE WHEN doc_id % 3 = 0 OR LENGTH(name) >= 5 THEN name ELSE name || ': ' || source END AS core
FROM (SELECT doc_id, source, trim(regexp_replace(name, '[^a-zA-Z ]', '', 'g')) AS name FROM {doc_row})""")
def _(b):
    bare = b.doc_row.select("doc_id", "source", T.strip(F.regexp_replace("name", "[^a-zA-Z ]", "")).alias("name"))
    full = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("[free] FIDO  Grand Hall Presents: "), "name")).otherwise(
        F.concat("name", F.lit(": "), "source"))
    dressed = F.concat(F.lit(" [members only] fido "), "name")
    return bare.select("doc_id", N.strip_prefixes(dressed).alias("stripped"), N.core_title(full).alias("core"))


@query("h12_short_names", "SELECT doc_id, trim(name, ' ') AS short FROM {doc_row}")
def _(b):
    full = F.concat(F.lit("Exhibition:  "), "name", F.lit(" - at "), "source")
    return b.doc_row.select("doc_id", T.short_name(full, F.col("source")).alias("short"))


@query("h13_emoji", "SELECT doc_id, CASE lang WHEN 'en' THEN '🎵' WHEN 'fr' THEN '🎭' END AS emoji, CASE lang WHEN 'en' THEN source WHEN 'fr' THEN source || ' 🎭 x' WHEN 'de' THEN '⬜ ' || source ELSE source END AS rest FROM {documents}")
def _(b):
    t = F.when(F.col("lang") == "en", F.concat(F.lit("⬜ 🎵  "), "source")).when(F.col("lang") == "fr", F.concat("source", F.lit(" 🎭 x"))).when(
        F.col("lang") == "de", F.concat(F.lit("⬜ "), "source")).otherwise(F.col("source"))
    return b.documents.select("doc_id", T.first_emoji(t).alias("emoji"), T.without_leading_emoji(t).alias("rest"))


@query("h14_search_text", "SELECT doc_id, md5(lower(strip_accents(text))) AS digest FROM {documents}")
def _(b):
    return b.documents.select("doc_id", F.md5(T.normalize_for_search(F.col("text"))).alias("digest"))


@query("h16_entities_and_emphasis", """
SELECT page_id, md5(replace(replace(replace(replace(replace(replace(html, '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&nbsp;', ' '), '&amp;', '&')) AS decoded,
       md5(replace(replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#039;')) AS escaped,
       '<strong>' || CAST(page_id AS STRING) || '</strong> and <em>x</em>' AS shown FROM {pages}""")
def _(b):
    note = F.concat(F.lit("**"), F.col("page_id").cast("string"), F.lit("** and _x_"))
    return b.pages.select("page_id", F.md5(T.decode_entities(F.col("html"))).alias("decoded"), F.md5(T.escape_markup(F.col("html"))).alias("escaped"), T.emphasis_to_tags(note).alias("shown"))


@query("h18_urls_in_content", """
SELECT page_id, url AS first_url, LENGTH(html) AS body, 'https://m.example.org/a/' || CAST(page_id AS STRING) || '.png' AS images FROM {pages}""")
def _(b):
    content = F.concat("url", F.lit("\n"), "html")
    n = F.col("page_id").cast("string")
    pics = F.concat(F.lit("![x](data:a) ![y](/icon.png) ![z]("), n, F.lit(".png)"))
    return b.pages.select("page_id", T.leading_url(content).alias("first_url"), F.length(T.body_after_url(content)).cast("long").alias("body"),
                          strings(T.image_urls(pics, "https://m.example.org/a/b")).alias("images"))


@query("h21_url_and_flag_tests", """
SELECT page_id, starts_with(url, 'http') AS url_ok, page_id % 3 = 0 AND starts_with(url, 'http') AS other_ok, page_id % 2 = 0 AS flag FROM {pages}""")
def _(b):
    mark = F.when(F.col("page_id") % 2 == 0, "🇻🇪").otherwise("🎭")
    bare = F.substring_index("url", "://", -1)
    other = F.when(F.col("page_id") % 3 == 0, F.col("url")).when(F.col("page_id") % 3 == 1, F.concat(F.lit("ftp://"), bare)).otherwise(bare)
    return b.pages.select("page_id", T.is_valid_url(F.col("url")).alias("url_ok"), T.is_valid_url(other).alias("other_ok"), T.is_country_flag(mark).alias("flag"))


@query("h19_write_truncations", "SELECT doc_id, LEAST(LENGTH(text), 500) AS name_size, LEAST(LENGTH(text), 2000) AS url_size FROM {documents}")
def _(b):
    return b.documents.select("doc_id", F.length(F.substring("text", 1, C.NAME_CHARS)).cast("long").alias("name_size"), F.length(F.substring("text", 1, C.URL_CHARS)).cast("long").alias("url_size"))


# Clock and calendar texts of the occurrence table.


@query("i4_clock", """
SELECT start_time, end_time, COUNT(*) AS n, CASE start_time WHEN '7:30 PM' THEN 1930 WHEN '19:00' THEN 1900 ELSE 1200 END AS start_clock,
       CASE end_time WHEN '9:00 PM' THEN 2100 WHEN '2:00 am' THEN 200 ELSE 1200 END AS end_clock FROM {occ} GROUP BY ALL""".replace("GROUP BY ALL", "GROUP BY start_time, end_time"))
def _(b):
    at = lambda c: (DT.clock(F.col(c))["hours"] * 100 + DT.clock(F.col(c))["minutes"]).alias(c.replace("time", "clock"))
    return b.occ.select("start_time", "end_time", at("start_time"), at("end_time")).groupBy("start_time", "end_time", "start_clock", "end_clock").agg(F.count("*").alias("n"))


@query("i5_i6_effective_ends", """
SELECT event_id, start_date, start_time, end_date, end_time, COUNT(*) AS n, MIN(strftime(e, '%Y-%m-%d %H:%M')) AS end_utc,
  MIN(strftime(CASE WHEN (s - INTERVAL 4 HOUR)::DATE <> (e - INTERVAL 4 HOUR)::DATE AND hour(e - INTERVAL 4 HOUR) < 5
       THEN date_trunc('day', e - INTERVAL 4 HOUR) + INTERVAL 4 HOUR - INTERVAL 1 MILLISECOND ELSE e END, '%Y-%m-%d %H:%M')) AS effective_utc
FROM (SELECT *, start_date::TIMESTAMP + CASE start_time WHEN '7:30 PM' THEN INTERVAL 1410 MINUTE WHEN '19:00' THEN INTERVAL 1380 MINUTE ELSE INTERVAL 960 MINUTE END AS s,
  COALESCE(end_date, start_date)::TIMESTAMP + CASE COALESCE(end_time, start_time) WHEN '9:00 PM' THEN INTERVAL 1500 MINUTE WHEN '2:00 am' THEN INTERVAL 360 MINUTE
    WHEN '7:30 PM' THEN INTERVAL 1410 MINUTE WHEN '19:00' THEN INTERVAL 1380 MINUTE ELSE INTERVAL 960 MINUTE END AS e FROM {occ})
GROUP BY event_id, start_date, start_time, end_date, end_time""")
def _(b):
    s = DT.day_instant(F.col("start_date"), F.col("start_time"))
    e = DT.day_instant(F.coalesce("end_date", "start_date"), F.coalesce("end_time", "start_time"))
    show = lambda c, n: F.date_format(c, "yyyy-MM-dd HH:mm").alias(n)
    kinds = b.occ.groupBy("event_id", "start_date", "start_time", "end_date", "end_time").agg(F.count("*").alias("n"))
    timed = kinds.select("*", s.alias("_s"), e.alias("_e"))
    return timed.select("*", show(F.col("_e"), "end_utc"), show(DT.effective_end_of(F.col("_s"), F.col("_e")), "effective_utc")).drop("_s", "_e")


@query("i9_twelve_hour", """
SELECT event_id, CAST((hour(ts) + 11) % 12 + 1 AS STRING) || ':' || lpad(CAST(minute(ts) AS STRING), 2, '0') || CASE WHEN hour(ts) < 12 THEN ' AM' ELSE ' PM' END AS shown FROM {events}""")
def _(b):
    return b.events.select("event_id", DT.twelve_hour(F.date_format("ts", "HH:mm")).alias("shown"))


@query("i3_i10_occurrence_labels", """
WITH t AS (SELECT event_id, start_date, end_date, CASE start_time WHEN '7:30 PM' THEN '7:30pm' WHEN '19:00' THEN '7pm' END AS shown FROM {occ}),
n AS (SELECT event_id, COUNT(*) AS total FROM t GROUP BY event_id)
SELECT t.event_id, t.start_date AS day, CASE n.total WHEN 1 THEN 'one' ELSE 'many' END AS form, COUNT(*) AS occurrences, COUNT(DISTINCT shown) AS n_times,
       strftime(t.start_date, '%b') || ' ' || CAST(day(t.start_date) AS STRING) AS label, COALESCE(STRING_AGG(DISTINCT shown, ' ' ORDER BY shown), '') AS times
FROM t JOIN n ON n.event_id = t.event_id GROUP BY t.event_id, t.start_date, n.total""")
def _(b):
    start = DT.event_instant(F.date_format("start_date", "yyyy-MM-dd"), F.col("start_time"))
    shown = F.when(F.col("start_time").isNotNull(), DT.compact_clock(start))
    rows = b.occ.select("event_id", F.col("start_date").alias("day"), F.date_format(DT.local(start), "MMM d").alias("label"), shown.alias("shown"))
    total = rows.groupBy("event_id").agg(F.count("*").alias("total"))
    # A day has at most as many times as minutes, so its list is bounded however many occurrences there are.
    days = rows.groupBy("event_id", "day").agg(F.count("*").alias("occurrences"), F.count_distinct("shown").alias("n_times"), F.min("label").alias("label"),
                                               F.array_join(F.array_sort(F.collect_set("shown")), " ").alias("times"))
    return days.join(total, "event_id").select("event_id", "day", F.when(F.col("total") == 1, "one").otherwise("many").alias("form"), "occurrences", "n_times", "label", "times")


# The log: one record per row of the event table, first written out as lines.


def log_lines(b):
    kind = F.element_at(F.create_map(*[F.lit(x) for pair in [
        ("view", "source_complete"), ("purchase", "source_extracted"), ("error", "source_error"), ("click", "host_backoff"), ("signup", "source_extract_error")
    ] for x in pair]), F.col("event_type"))
    k = F.get_json_object("props", "$.k").cast("int")
    record = F.to_json(F.struct(
        kind.alias("event"), (F.col("user_id") % 50).cast("string").alias("run"), F.col("event_id").alias("seq"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("at"),
        F.concat(F.lit("site "), F.col("user_id").cast("string")).alias("source_name"), F.concat(F.lit("host"), (F.col("user_id") % 20).cast("string")).alias("hostname"),
        F.when(F.col("event_type") == "view", k % 4).alias("event_count"), F.when(F.col("event_type") == "purchase", k).alias("events_extracted"),
        F.floor(F.col("value") * 10000).alias("content_bytes"), (F.col("user_id") % 3 + 1).alias("tier"), F.when(F.col("event_type") == "signup", "bad answer").alias("error")))
    noise = b.events.filter("event_type = 'click'").select(F.concat(F.lit("net::ERR_ABORTED "), F.col("event_id").cast("string")).alias("value"))
    return b.events.select(record.alias("value")).union(noise)


LOG_SQL = """(SELECT CASE event_type WHEN 'view' THEN 'source_complete' WHEN 'purchase' THEN 'source_extracted' WHEN 'error' THEN 'source_error' WHEN 'click' THEN 'host_backoff' ELSE 'source_extract_error' END AS event,
  CAST(user_id % 50 AS STRING) AS run, event_id AS seq, ts, 'site ' || CAST(user_id AS STRING) AS source_name, 'host' || CAST(user_id % 20 AS STRING) AS hostname, CAST(json_extract(props, '$.k') AS INT) AS k,
  CAST(FLOOR(value * 10000) AS BIGINT) AS content_bytes, CAST(user_id % 3 + 1 AS INT) AS tier FROM {events})"""


@query("a17_log_records", f"SELECT event, run, seq, source_name, content_bytes, tier FROM {LOG_SQL}")
def _(b):
    return C.read_log_lines(log_lines(b)).select("event", "run", "seq", "source_name", "content_bytes", "tier")


@query("b20_log_filters", f"""
SELECT seq, CASE WHEN event = 'source_complete' AND k % 4 = 0 THEN 'zero yield' WHEN event = 'source_error' AND ts >= TIMESTAMP '2024-01-20' THEN 'recent error'
  WHEN event = 'host_backoff' THEN 'backoff' WHEN content_bytes > 100000 THEN 'large' END AS reason
FROM {LOG_SQL} WHERE (event = 'source_complete' AND k % 4 = 0) OR (event = 'source_error' AND ts >= TIMESTAMP '2024-01-20') OR event = 'host_backoff' OR (event = 'source_complete' AND content_bytes > 100000)""")
def _(b):
    log = C.read_log_lines(log_lines(b))
    e = F.col("event")
    reason = F.when((e == "source_complete") & (F.col("event_count") == 0), "zero yield").when(
        (e == "source_error") & (F.col("at") >= F.lit("2024-01-20").cast("timestamp_ntz")), "recent error").when(
        e == "host_backoff", "backoff").when((e == "source_complete") & (F.col("content_bytes") > 100000), "large")
    return log.select("seq", reason.alias("reason")).filter("reason IS NOT NULL")


@query("d21_log_kpis", f"""
SELECT tier, COUNT(CASE WHEN event = 'source_complete' THEN 1 END) AS completed, COUNT(CASE WHEN event = 'source_error' THEN 1 END) AS errors,
  COUNT(CASE WHEN event = 'host_backoff' THEN 1 END) AS backoffs, COUNT(CASE WHEN event = 'source_complete' AND k % 4 = 0 THEN 1 END) AS zero_yield,
  CAST(SUM(CASE WHEN event = 'source_complete' THEN k % 4 END) AS BIGINT) AS throughput,
  ROUND(AVG(CASE WHEN event = 'source_error' THEN 1.0 WHEN event = 'source_complete' THEN 0.0 END), 6) AS error_rate FROM {LOG_SQL} GROUP BY tier""")
def _(b):
    return C.log_kpis(C.read_log_lines(log_lines(b)))


@query("d21_host_kpis", f"""
SELECT hostname, COUNT(CASE WHEN event = 'host_backoff' THEN 1 END) AS backoffs, COUNT(CASE WHEN event = 'source_error' THEN 1 END) AS errors,
  COUNT(CASE WHEN event = 'source_complete' THEN 1 END) AS completed FROM {LOG_SQL} GROUP BY hostname""")
def _(b):
    return C.host_kpis(C.read_log_lines(log_lines(b)))


@query("d21_zero_yield_sources", f"""
SELECT source_name, COUNT(*) AS visits, COUNT(CASE WHEN k % 4 = 0 THEN 1 END) AS empty_visits FROM {LOG_SQL} WHERE event = 'source_complete'
GROUP BY source_name HAVING COUNT(CASE WHEN k % 4 = 0 THEN 1 END) > 0""")
def _(b):
    return C.zero_yield(C.read_log_lines(log_lines(b)))


@query("d24_run_progress", f"""
SELECT run, seq, CAST(SUM(CASE WHEN event = 'source_complete' THEN 1 ELSE 0 END) OVER w AS BIGINT) AS sources_done, CAST(SUM(CASE WHEN event = 'source_extracted' THEN k ELSE 0 END) OVER w AS BIGINT) AS events_found,
  CASE WHEN event = 'source_extract_error' THEN 'Extraction failed for ' || source_name || ': bad answer' END AS failure
FROM {LOG_SQL} WINDOW w AS (PARTITION BY run ORDER BY date_trunc('second', ts), seq ROWS UNBOUNDED PRECEDING)""")
def _(b):
    out = C.run_progress(C.read_log_lines(log_lines(b)), F.date_trunc("hour", "at"))
    return out.select("run", "seq", "sources_done", "events_found", "failure")
