"""Writing decisions, archiving and consolidating golden events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from marquesina.functions.dates import GRACE_DAYS
from marquesina.functions.jsons import parse_occurrences, parse_tags
from marquesina.functions.text import blank_to_null, first_emoji, short_name
from marquesina.operators.lifecycle import get_or_create, numbered
from marquesina.operators.matching import Index, match_batch, with_place
from marquesina.session import materialize

NAME, SHORT, EMOJI, SUB, URL, TAG = 500, 255, 10, 255, 2000, 100


def prepare_rows(extracted: DataFrame, resolved: DataFrame) -> DataFrame:
    """Rows with venue, short name and emoji (M2). ``resolved``: id, location_id, venue_name."""
    out = extracted.drop("location_id").join(resolved, "id", "left")
    return out.withColumn("short_name", short_name(F.col("name"), F.col("venue_name"))).withColumn(
        "emoji", F.coalesce(first_emoji(F.col("name")), F.col("emoji") if "emoji" in extracted.columns else F.lit(None)))


def result_status(results: DataFrame, extracted: DataFrame) -> DataFrame:
    """Extracted results become processed, or failed when they hold no event (M2)."""
    counts = extracted.groupBy(F.col("crawl_result_id").alias("id")).agg(F.count("*").alias("n"))
    todo = F.col("status") == "extracted"
    return results.join(counts, "id", "left").withColumn(
        "error_message", F.when(todo & F.col("n").isNull(), "0 ExtractedEvents — extraction returned no results (likely an API error or empty page)").otherwise(F.col("error_message"))
    ).withColumn("status", F.when(todo, F.when(F.col("n").isNull(), "failed").otherwise("processed")).otherwise(F.col("status"))).drop("n")


def unprocessed(extracted: DataFrame, results: DataFrame, links: DataFrame) -> DataFrame:
    """Extracted events of processed results that no golden event is linked to (C4)."""
    done = results.filter("status = 'processed'").select(F.col("id").alias("crawl_result_id"), "source_id")
    return extracted.join(done, "crawl_result_id").join(links.select(F.col("extracted_event_id").alias("id")), "id", "left_anti")


def screened(rows: DataFrame, today: Column) -> DataFrame:
    """Named rows with their valid occurrences and, where they cannot be matched, the reason (M3)."""
    occ = rows.filter(F.length("name") > 0).select(
        "id", "name", "location_id", "source_id", parse_occurrences(F.col("occurrences"), today).alias("occ"))
    return occ.withColumn("skip", F.when(F.col("location_id").isNull(), "skipped_no_location").when(F.size("occ") == 0, "skipped_no_occurrences"))


def decide(rows: DataFrame, locations: DataFrame, index: Index, today: Column) -> DataFrame:
    """One decision per named row: created, merged or skipped (M3).

    ``rows``: id, name, location_id, source_id, occurrences (JSON text).
    """
    parsed = materialize(screened(rows, today), "parsed")
    days = parsed.filter("skip IS NULL").select(
        "id", "name", "location_id", "source_id", F.explode(F.array_distinct(F.transform("occ", lambda o: o["start_date"]))).alias("day"))
    decided = match_batch(with_place(days, locations), index)
    status = F.coalesce("skip", F.when(F.col("level") == 0, "created").otherwise("merged"))
    return parsed.join(decided, "id", "left").select("id", "source_id", status.alias("status"), "is_new", "e", "level")


def with_event_ids(decisions: DataFrame, last_id: int) -> DataFrame:
    """Decisions with the golden event id each row ends in; new ids follow ``last_id`` in row order (M4)."""
    made = numbered(decisions.filter("status = 'created'").select("id"), ["id"], last_id, "new_id").select(F.col("id").alias("e"), "new_id", F.lit(True).alias("is_new"))
    out = decisions.join(made, ["e", "is_new"], "left")
    return out.withColumn("event_id", F.when(F.col("is_new"), F.col("new_id")).otherwise(F.col("e"))).drop("new_id")


def created_tables(decisions: DataFrame, rows: DataFrame, today: Column) -> dict[str, DataFrame]:
    """New events with their occurrences, urls, tags and primary links."""
    new = decisions.filter("status = 'created'").select("id", "event_id", "source_id")
    full = new.join(rows.drop("source_id"), "id")
    cut = lambda c, n: F.substring(blank_to_null(F.col(c)), 1, n)
    return {
        "events": full.select(
            F.col("event_id").alias("id"), F.substring("name", 1, NAME).alias("name"), cut("short_name", SHORT).alias("short_name"), "description",
            cut("emoji", EMOJI).alias("emoji"), "location_id", cut("sublocation", SUB).alias("sublocation"), F.lit("active").alias("status")),
        "occurrences": full.select("event_id", F.inline(parse_occurrences(F.col("occurrences"), today))),
        "urls": full.filter(F.length("url") > 0).select("event_id", F.substring("url", 1, URL).alias("url")),
        "tags": full.select("event_id", F.explode(parse_tags(F.col("tags"))).alias("t")).select("event_id", F.substring("t", 1, TAG).alias("name")).distinct(),
        "links": new.select("event_id", F.col("id").alias("extracted_event_id"), "source_id", F.lit(True).alias("is_primary")),
    }


def merged_tables(decisions: DataFrame, rows: DataFrame, events: DataFrame, urls: DataFrame, new_urls: DataFrame) -> dict[str, DataFrame]:
    """Effect of merged rows on their events: revived, new urls, filled venue, further links (M5)."""
    hit = decisions.filter("status = 'merged'").select("id", "event_id", "source_id")
    full = hit.join(rows.select("id", "url", "location_id"), "id")
    place = full.groupBy(F.col("event_id").alias("id")).agg(F.min_by("location_id", "id").alias("_place"), F.lit(True).alias("_hit"))
    held = urls.select("event_id", "url").union(new_urls.select("event_id", "url")).distinct()
    return {
        "events": events.join(place, "id", "left").withColumn("location_id", F.coalesce("location_id", "_place")).withColumn(
            "status", F.when(F.col("_hit") & (F.col("status") == "archived") & F.col("deleted_at").isNull(), "active").otherwise(F.col("status"))).select(events.columns),
        "urls": full.filter(F.length("url") > 0).select("event_id", F.substring("url", 1, URL).alias("url")).distinct().join(held, ["event_id", "url"], "left_anti"),
        "links": hit.select("event_id", F.col("id").alias("extracted_event_id"), "source_id", F.lit(False).alias("is_primary")),
    }


def tag_links(dimension: DataFrame, event_tags: DataFrame, last_id: int) -> tuple[DataFrame, DataFrame]:
    """Tag table with missing names added, and (event_id, tag_id) links (M8)."""
    tags = get_or_create(dimension, event_tags.select("name"), last_id)
    return tags, event_tags.join(tags.withColumnRenamed("id", "tag_id"), "name").select("event_id", "tag_id").distinct()


def audit_log(decisions: DataFrame) -> DataFrame:
    """One line per decision (M7)."""
    message = F.when(F.col("status") == "merged", F.concat(F.lit("Merged with existing event "), F.col("event_id").cast("string"))).when(
        F.col("status") == "created", F.concat(F.lit("Created new event "), F.col("event_id").cast("string"))).when(
        F.col("status") == "skipped_no_location", "No location_id on extracted event").otherwise("No valid future occurrences")
    return decisions.select(F.col("id").alias("extracted_event_id"), "status", "event_id", message.alias("message"))


def latest_results(results: DataFrame) -> DataFrame:
    """Newest processed or extracted result per source."""
    return results.filter(F.col("status").isin("processed", "extracted")).groupBy("source_id").agg(F.max("id").alias("crawl_result_id"))


def outdated(events: DataFrame, links: DataFrame, extracted: DataFrame, results: DataFrame, occurrences: DataFrame, today: Column, sources: DataFrame | None = None) -> DataFrame:
    """Events to archive with their next date, if one is still to come.

    An event stays when the newest result of any of its sources lists it, or when it has a date 14 days
    ahead or later.
    """
    linked = links.filter("source_id IS NOT NULL").select("event_id", "source_id", "extracted_event_id")
    touched = linked if sources is None else linked.join(sources.select("source_id").distinct(), "source_id", "left_semi")
    live = events.filter((F.col("status") == "active") & F.col("deleted_at").isNull()).select(F.col("id").alias("event_id"), "name")
    listed = extracted.select(F.col("id").alias("extracted_event_id"), "crawl_result_id").join(latest_results(results), "crawl_result_id")
    seen = linked.join(listed.select("source_id", "extracted_event_id"), ["source_id", "extracted_event_id"], "left_semi").select("event_id")
    ahead = occurrences.filter(F.col("start_date") >= F.date_add(today, GRACE_DAYS)).select("event_id")
    gone = live.join(touched, "event_id", "left_semi").join(seen, "event_id", "left_anti").join(ahead, "event_id", "left_anti")
    upcoming = occurrences.filter(F.col("start_date") > today).groupBy("event_id").agg(F.min("start_date").alias("next_date"))
    return gone.join(upcoming, "event_id", "left").select("event_id", "name", "next_date")


def archive(events: DataFrame, gone: DataFrame) -> DataFrame:
    hit = gone.select(F.col("event_id").alias("id"), F.lit(True).alias("_hit"))
    return events.join(hit, "id", "left").withColumn("status", F.when(F.col("_hit"), "archived").otherwise(F.col("status"))).select(events.columns)


def duplicate_map(events: DataFrame, links: DataFrame) -> DataFrame:
    """(duplicate, canonical) over live events of one name and location: most links, then lowest id."""
    counts = links.groupBy(F.col("event_id").alias("id")).agg(F.count("*").alias("n"))
    live = events.filter("deleted_at IS NULL").select("id", "name", "location_id").join(counts, "id", "left")
    best = live.groupBy("name", "location_id").agg(
        F.min_by("id", F.struct(-F.coalesce("n", F.lit(0)), "id")).alias("canonical"), F.count("*").alias("copies")).filter("copies > 1")
    same = live["name"].eqNullSafe(best["name"]) & live["location_id"].eqNullSafe(best["location_id"])
    return live.join(best, same).filter("id <> canonical").select(F.col("id").alias("duplicate"), "canonical")


def _moved(rows: DataFrame, mapping: DataFrame) -> DataFrame:
    return rows.join(mapping.withColumnRenamed("duplicate", "event_id"), "event_id").drop("event_id").withColumnRenamed("canonical", "event_id")


def new_to_canonical(occurrences: DataFrame, mapping: DataFrame) -> DataFrame:
    """Occurrences of duplicates that the canonical event lacks, nulls compared as equal."""
    cols = ["event_id", "start_date", "start_time", "end_date", "end_time"]
    moved, held = _moved(occurrences.select(cols), mapping).alias("m"), occurrences.select(cols).distinct().alias("h")
    # The equal keys carry the join; the nullable fields are compared null-safe beside them.
    same = (F.col("m.event_id") == F.col("h.event_id")) & (F.col("m.start_date") == F.col("h.start_date"))
    for c in cols[2:]:
        same = same & F.col(f"m.{c}").eqNullSafe(F.col(f"h.{c}"))
    return moved.join(held, same, "left_anti")


def consolidate(events: DataFrame, links: DataFrame, urls: DataFrame, occurrences: DataFrame, tags: DataFrame, at: Column) -> dict[str, DataFrame]:
    """Fold exact duplicates into their canonical event (M9).

    ``report`` holds the counts a dry run names: urls are counted as the reference moves them, every one
    of them; the tables themselves come out without repeats.
    """
    mapping = materialize(duplicate_map(events, links), "duplicates")
    link_cols = ["event_id", "extracted_event_id"]
    moved_links = _moved(links, mapping).dropDuplicates(link_cols).join(links.select(link_cols), link_cols, "left_anti")
    moved_occ = new_to_canonical(occurrences, mapping)
    moved_urls = _moved(urls, mapping)
    keep = lambda df: df.join(mapping.select(F.col("duplicate").alias("event_id")), "event_id", "left_anti")
    gone = mapping.select(F.col("duplicate").alias("id"), F.lit(True).alias("_gone"))
    count = lambda df, n: df.groupBy(F.col("event_id").alias("canonical")).agg(F.count("*").alias(n))
    report = mapping.groupBy("canonical").agg(F.count("*").alias("copies"))
    for df, n in ((moved_links, "links"), (moved_urls, "urls"), (moved_occ, "occurrences")):
        report = report.join(count(df, n), "canonical", "left").withColumn(n, F.coalesce(n, F.lit(0)))
    return {
        "mapping": mapping, "report": report,
        "events": events.join(gone, "id", "left").withColumn("deleted_at", F.when(F.col("_gone"), at).otherwise(F.col("deleted_at"))).select(events.columns),
        "links": links.unionByName(moved_links),
        "urls": keep(urls).unionByName(moved_urls).distinct(),
        "occurrences": keep(occurrences).unionByName(moved_occ.distinct(), allowMissingColumns=True),
        "tags": keep(tags).unionByName(_moved(tags, mapping)).distinct(),
    }
