"""Crawled text and extracted JSON to rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from marquesina.functions import jsons as J
from marquesina.functions.text import blank_to_null, body_after_url, leading_url, let
from marquesina.operators.crawl import MAX_CONTENT
from marquesina.operators.skew import running_total, top_per_key

# Chunk and batch sizes, the routing threshold and the length a name, venue, url may have.
EVENTS_PER_CHUNK = 50
CHUNK_CHARS = 30_000
BATCH = 30
DEFAULT_BATCHES = 3
LARGE_PAGE_EVENTS = 50
NAME_CHARS, VENUE_CHARS, URL_CHARS = 500, 255, 2000
# An event heading in markdown, and the patterns an event count is guessed from.
MARKER = r"(?md)^[^\S\n]*(?:\d+\.[^\S\n]*###[^\S\n]*\[|### \[)"
COUNTED_MARKER = r"(?md)^\s*\d+\.\s*###\s*\[|^###\s*\["
MONTHS = "January|February|March|April|May|June|July|August|September|October|November|December"
DATE_PATTERN = rf"(?i)(?:{MONTHS})\s+\d{{1,2}}"
VIEW_PATTERN = r"(?i)View\s+Event|View\s+Details|More\s+Info"
EVENT_URL_PATTERN = r"/events?/[^/\s\"']+"
LISTING_URL_PATTERN = r"/listings?/[^/\s\"']+"
# Log kinds and the line fragments that carry nothing.
LOG_KINDS = ["source_complete", "source_error", "source_extracted", "source_extract_error", "host_backoff"]
NOISE = ["RequestsDependencyWarning", "VIRTUAL_ENV", "deprecated", "net::ERR_", "[ERROR]...", "Invalid URL:"]


def combine_url_contents(url_results: DataFrame, block: Column) -> DataFrame:
    """``url\\ncontent`` of the successful urls of a result, numbered in creation order (A10).

    The combined text is the pieces read in order of ``place``; kept as rows, it may be of any size.
    """
    good = url_results.filter("status = 'crawled'").withColumn("content", F.concat("url", F.lit("\n"), "content"))
    return running_total(good, ["crawl_result_id"], block, ["created_at", "id"], {"place": F.lit(1)}).select("crawl_result_id", "place", "content")


def fit_or_raw(fit: Column, raw: Column) -> Column:
    """The condensed page text, or the raw one when that is under 500 characters (A10)."""
    return F.when(F.length(fit) >= 500, fit).otherwise(raw)


def profile_documents(posts: DataFrame, block: Column) -> DataFrame:
    """Profile header (number 0) and numbered posts with their given fields, one text each.

    ``posts``: profile, full_name, bio, seq, posted_at, location_name, caption, url.
    """
    numbered = running_total(posts, ["profile"], block, ["seq"], {"number": F.lit(1)})
    def line(label: str, c: str) -> Column:
        return F.concat(F.lit(f"  {label}: "), blank_to_null(F.col(c)))
    piece = F.concat_ws(
        "\n", F.concat(F.lit("Post "), F.col("number").cast("string"), F.lit(":")), line("Date", "posted_at"),
        line("Location", "location_name"), line("Caption", "caption"), line("URL", "url"), F.lit(""))
    totals = posts.groupBy("profile").agg(
        F.count("*").alias("posts"), F.max("full_name").alias("full_name"), F.max("bio").alias("bio"))
    header = F.concat_ws(
        "\n", F.concat(F.lit("Instagram Profile: @"), "profile"), F.concat(F.lit("Name: "), blank_to_null(F.col("full_name"))),
        F.concat(F.lit("Bio: "), blank_to_null(F.col("bio"))), F.concat(F.lit("Posts harvested: "), F.col("posts").cast("string")),
        F.lit(""), F.lit("---"), F.lit(""))
    heads = totals.select("profile", F.lit(0).cast("long").alias("number"), header.alias("content"))
    return heads.unionByName(numbered.select("profile", F.col("number").cast("long").alias("number"), piece.alias("content")))


def harvested_posts(posts: DataFrame, limit: int) -> DataFrame:
    """One row per (profile, code), the first ``limit`` codes of each profile."""
    once = posts.groupBy("profile", "code").agg(F.min("seq").alias("seq"))
    return top_per_key(once, ["profile"], [F.col("seq"), F.col("code")], limit)


def extracted_rows(contents: DataFrame, done: DataFrame) -> DataFrame:
    """Event rows from extracted JSON, for results that have none yet."""
    todo = contents.join(done.select("crawl_result_id").distinct(), "crawl_result_id", "left_anti")
    events = todo.select("crawl_result_id", F.posexplode(J.response_events(F.col("extracted_content"))).alias("position", "e"))
    e = F.col("e")
    get = lambda path: F.try_variant_get(e, path, "string")
    raw = lambda path: F.try_variant_get(e, path, "variant")
    kind = lambda path: F.coalesce(F.schema_of_variant(raw(path)), F.lit("NONE"))
    # A key that is present wins over its fallback even when it is null or empty.
    place = F.when(kind("$.location") != "NONE", raw("$.location")).otherwise(raw("$.location_name"))
    inner = lambda p: F.try_variant_get(place, p, "string")
    name_of_place = F.when(
        F.schema_of_variant(place).startswith("OBJECT"),
        F.when(F.schema_of_variant(F.try_variant_get(place, "$.venue_name", "variant")).isNotNull(), inner("$.venue_name")).otherwise(inner("$.name")),
    ).otherwise(F.try_variant_get(place, "$", "string"))
    text = lambda c: F.coalesce(c, F.lit(""))
    tags = F.when(kind("$.tags") != "NONE", raw("$.tags")).otherwise(raw("$.hashtags"))
    return events.filter(F.schema_of_variant(e).startswith("OBJECT")).select(
        "crawl_result_id", "position",
        F.substring(text(get("$.name")), 1, NAME_CHARS).alias("name"),
        F.substring(text(name_of_place), 1, VENUE_CHARS).alias("location_name"),
        F.substring(text(get("$.sublocation")), 1, VENUE_CHARS).alias("sublocation"),
        text(get("$.description")).alias("description"),
        F.substring(text(get("$.url")), 1, URL_CHARS).alias("url"),
        F.coalesce(F.to_json(raw("$.occurrences")), F.lit("[]")).alias("occurrences"),
        F.when(F.schema_of_variant(tags).isin("VOID"), "[]").otherwise(F.coalesce(F.to_json(tags), F.lit("[]"))).alias("tags"),
        text(get("$.emoji")).alias("emoji"),
    )


def api_events(payloads: DataFrame, callback: str | None = None, path: str | None = None) -> DataFrame:
    """One row per event of a (possibly wrapped) nested payload, repeated keys resolved."""
    text = J.at_path(J.strip_jsonp(F.col("payload"), callback), path)
    entries = J.last_per_key(F.map_entries(F.from_json(text, J.API_PAYLOAD)))
    return payloads.select("payload_id", F.explode(entries).alias("x")).select(
        "payload_id", F.col("x.key").alias("event_id"), F.col("x.value").alias("event"))


def api_event_rows(events: DataFrame) -> DataFrame:
    """One row per event and named venue that has dated shows (K4)."""
    e = F.col("event")
    classes = J.class_names(e)
    venues = events.select("*", F.posexplode(J.last_per_key(F.map_entries(e["lugares"]))).alias("venue_position", "v"))
    venue = F.col("v.value")
    shaped = venues.withColumn("occurrences", J.show_occurrences(venue)).filter(
        (F.col("v.value.nombre") != "") & (F.size("occurrences") > 0))
    listed = F.array_join(classes, ", ")
    return shaped.select(
        "payload_id", "event_id", "venue_position",
        F.coalesce(e["titulo"], F.concat(F.lit("Event "), "event_id")).alias("name"),
        F.col("v.value.nombre").alias("location"), "occurrences",
        F.when(F.size(classes) > 0, F.concat(listed, F.lit(" en "), F.col("v.value.nombre"), F.lit(".")))
        .otherwise(F.concat(F.lit("Evento en "), F.col("v.value.nombre"), F.lit("."))).alias("description"),
        F.concat(F.lit(J.SHOW_SITE), blank_to_null(e["url"])).alias("url"),
        F.when(F.size(classes) > 0, classes).otherwise(F.array(F.lit("Teatro"))).alias("hashtags"),
        J.class_emoji(e).alias("emoji"),
    )


# Text columns.


def event_count_estimate(text: Column) -> Column:
    """Guess of the number of events on a page."""
    count = lambda p: F.regexp_count(text, F.lit(p))
    half = lambda c: F.floor(c / 2).cast("int")
    return F.greatest(half(count(DATE_PATTERN)), count(VIEW_PATTERN), half(count(EVENT_URL_PATTERN)), half(count(LISTING_URL_PATTERN)))


def marker_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(COUNTED_MARKER))


def is_large_page(text: Column) -> Column:
    """Whether a page takes the two-step way."""
    return (event_count_estimate(text) > LARGE_PAGE_EVENTS) | (F.length(text) > 2 * CHUNK_CHARS)


def chunk_by_events(text: Column, per_chunk: int = EVENTS_PER_CHUNK) -> Column:
    """Chunks of at most ``per_chunk`` marked events; text before the first event joins the first (L1)."""
    def of(pieces: Column, lead: Column) -> Column:
        chunks = F.greatest(F.ceil((F.size(pieces) - lead) / per_chunk).cast("int"), F.lit(1))
        def chunk(k: Column) -> Column:
            start = F.when(k == 0, 1).otherwise(k * per_chunk + lead + 1)
            end = (k + 1) * per_chunk + lead
            body = F.array_join(F.slice(pieces, start, end - start + 1), "")
            return F.when(k < chunks - 1, F.regexp_replace(body, r"\n\z", "")).otherwise(body)
        return F.transform(F.sequence(F.lit(0), chunks - 1), chunk)
    # The text is cut once and the pieces are named, not once for every chunk.
    lead = lambda pieces: F.when(F.get(pieces, F.lit(0)).rlike(rf"\A(?:{MARKER})"), 0).otherwise(1)
    return let(F.split(text, rf"(?={MARKER})"), lambda pieces: let(lead(pieces), lambda n: of(pieces, n)))


def _greedy(items: Column, limit: int, joiner: str, extra: int, oversize=None) -> Column:
    """Pack texts into chunks in order; ``oversize`` splits an item that alone passes the limit."""
    texts = "array<string>"
    start = F.struct(
        F.array().cast(texts).alias("done"), F.lit(None).cast("string").alias("open"), F.lit(0).alias("size"))
    def opened(s: Column) -> Column:
        return F.when(s["open"].isNotNull(), F.array(s["open"])).otherwise(F.array().cast(texts))
    def state(done: Column, open_: Column, size: Column) -> Column:
        return F.struct(done.alias("done"), open_.cast("string").alias("open"), size.cast("int").alias("size"))
    def step(s: Column, item: Column) -> Column:
        weight = F.length(item) + extra
        full = (s["size"] + weight > limit) & s["open"].isNotNull()
        out = F.when(full, state(F.concat(s["done"], opened(s)), item, weight)).otherwise(
            state(s["done"], F.concat(F.coalesce(F.concat(s["open"], F.lit(joiner)), F.lit("")), item), s["size"] + weight))
        if oversize is not None:
            out = F.when(weight > limit, state(F.concat(s["done"], opened(s), oversize(item)), F.lit(None), F.lit(0))).otherwise(out)
        return out
    return F.aggregate(items, start, step, lambda s: F.concat(s["done"], opened(s)))


def chunk_by_size(text: Column, limit: int = CHUNK_CHARS) -> Column:
    """Chunks of whole paragraphs up to ``limit`` characters, long paragraphs by line (L2)."""
    lines = lambda p: _greedy(F.split(p, "\n"), limit, "\n", 1)
    return F.when(F.length(text) <= limit, F.array(text)).otherwise(
        _greedy(F.split(text, r"\n\n+"), limit, "\n\n", 2, lines))


def chunk(text: Column, per_chunk: int = EVENTS_PER_CHUNK, limit: int = CHUNK_CHARS) -> Column:
    """Chunks and the way they were cut: events, single or size (L3)."""
    def of(by_events: Column) -> Column:
        several = F.size(by_events) > 1
        return F.struct(
            F.when(several, by_events).when(F.length(text) <= limit, F.array(text)).otherwise(chunk_by_size(text, limit)).alias("chunks"),
            F.when(several, "events").when(F.length(text) <= limit, "single").otherwise("size").alias("method"),
        )
    return let(chunk_by_events(text, per_chunk), of)


def prompt_inputs(contents: DataFrame, results: DataFrame, sources: DataFrame, configs: DataFrame, known: DataFrame, day: Column) -> DataFrame:
    """Per crawled page what an extraction request is made of; no request is sent (L4)."""
    page = F.col("crawled_content")
    body = F.substring(body_after_url(page), 1, MAX_CONTENT)
    pages = contents.filter(F.length("crawled_content") >= 500).select(
        F.col("crawl_result_id").alias("id"), F.coalesce(leading_url(page), F.lit("")).alias("url"), body.alias("page_text"))
    return (
        pages.join(results.select("id", "source_id"), "id")
        .join(sources.select(F.col("id").alias("source_id"), "name"), "source_id", "left")
        .join(configs.select("source_id", "notes"), "source_id", "left")
        .join(known.groupBy("source_id").agg(F.count("*").alias("known_events")), "source_id", "left")
        .select("id", "source_id", "name", "notes", "url", F.date_format(day, "yyyy-MM-dd").alias("day"), "page_text",
                F.coalesce("known_events", F.lit(0)).alias("known_events"), is_large_page(F.col("page_text")).alias("two_step"))
    )


def batches(events: DataFrame, block: Column, max_batches: int = DEFAULT_BATCHES) -> DataFrame:
    """Batch number of each event of a result in page order, rows beyond the cap dropped."""
    placed = running_total(events, ["crawl_result_id"], block, ["position"], {"place": F.lit(1)})
    return placed.filter(F.col("place") <= max_batches * BATCH).withColumn("batch", F.floor((F.col("place") - 1) / BATCH).cast("int"))


def enriched(events: DataFrame, extras: DataFrame) -> DataFrame:
    """Second-step attributes by exact name, with defaults."""
    last = extras.groupBy("name").agg(F.max_by(F.struct("description", "hashtags", "emoji"), "seq").alias("x"))
    return events.join(last, "name", "left").select(
        *events.columns,
        F.coalesce("x.description", F.concat(F.lit("Event at "), "location")).alias("description"),
        F.coalesce("x.hashtags", F.array(F.lit("Event"))).alias("hashtags"), F.coalesce("x.emoji", F.lit("📅")).alias("emoji"))


def extraction_quality(contents: DataFrame, text: str = "extracted_content") -> DataFrame:
    """Verdict, event and occurrence counts of extracted JSON."""
    events = J.response_events(F.col(text))
    missing = F.length(F.trim(F.coalesce(F.col(text), F.lit("")))) == 0
    return contents.select(
        "crawl_result_id",
        F.when(missing, "empty").when(~J.is_valid_json(F.col(text)), "invalid").when(F.size(events) == 0, "no_events").otherwise("ok").alias("verdict"),
        F.size(events).alias("event_count"), J.occurrence_total(events).alias("occurrence_count"))


# Crawl log.


def read_log_lines(lines: DataFrame) -> DataFrame:
    """Typed log records from JSON lines, noise dropped."""
    quiet = ~F.col("value").rlike("|".join("\\Q" + n + "\\E" for n in NOISE))
    record = F.from_json("value", "event string, run string, seq long, at timestamp_ntz, source_name string, hostname string, "
                                  "event_count int, events_extracted int, content_bytes long, tier int, error string, cooldown_seconds double, cost_usd double")
    return lines.filter(quiet & F.col("value").startswith('{"event":')).select(record.alias("r")).select("r.*").filter("event IS NOT NULL")


def log_kpis(log: DataFrame) -> DataFrame:
    """Error rate and totals per tier."""
    runs = F.col("event").isin("source_complete", "source_error")
    return log.groupBy("tier").agg(
        F.count_if(F.col("event") == "source_complete").alias("completed"),
        F.count_if(F.col("event") == "source_error").alias("errors"),
        F.count_if(F.col("event") == "host_backoff").alias("backoffs"),
        F.count_if((F.col("event") == "source_complete") & (F.col("event_count") == 0)).alias("zero_yield"),
        F.sum(F.when(F.col("event") == "source_complete", F.col("event_count"))).alias("throughput"),
        F.round(F.avg(F.when(runs, (F.col("event") == "source_error").cast("double"))), 6).alias("error_rate"))


def host_kpis(log: DataFrame) -> DataFrame:
    """Back-offs, errors and completed sources per host."""
    n = lambda kind, name: F.count_if(F.col("event") == kind).alias(name)
    return log.groupBy("hostname").agg(n("host_backoff", "backoffs"), n("source_error", "errors"), n("source_complete", "completed"))


def zero_yield(log: DataFrame) -> DataFrame:
    """Sources with visits that found no event, and how many."""
    visits = log.filter("event = 'source_complete'").groupBy("source_name").agg(
        F.count("*").alias("visits"), F.count_if(F.col("event_count") == 0).alias("empty_visits"))
    return visits.filter("empty_visits > 0")


def run_progress(log: DataFrame, block: Column) -> DataFrame:
    """Completed sources and extracted events so far, at each log line of a run."""
    done = F.when(F.col("event") == "source_complete", 1).otherwise(0)
    found = F.when(F.col("event") == "source_extracted", F.coalesce("events_extracted", F.lit(0))).otherwise(0)
    out = running_total(log, ["run"], block, ["at", "seq"], {"sources_done": done, "events_found": found})
    failure = F.concat(F.lit("Extraction failed for "), F.coalesce("source_name", F.lit("")), F.lit(": "), F.substring(F.coalesce("error", F.lit("")), 1, 80))
    return out.withColumn("failure", F.when(F.col("event") == "source_extract_error", failure))
