"""Term search through a trigram index.

A folded text holds a term exactly if it holds all the term's letter triples next to each other. The index keeps a row
for each different triple of a text, sorted by triple, so that a lookup reads the few files and row groups of the
term's rarest triples; only the texts they name are then read and tested. The last letters of a text stand as
shorter pieces, so every place of a text begins a piece and a term of one or two letters is found by its beginning.
Many items share a text, so the index is over different texts, each named by the lowest of its keys.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from marquesina.functions.text import normalize_for_search
from marquesina.session import materialize

GRAM = 3
# Triples of a term that are intersected, the rarest first; the test of the texts needs no more.
PROBES = 2
# Rows of one file of the index.
FILE_ROWS = 2_000_000


class TermIndex(NamedTuple):
    """``postings``: (gram, first), sorted by gram; ``words``: (first, text), the different folded texts; ``texts``: (key, text)."""

    postings: DataFrame
    words: DataFrame
    texts: DataFrame


def joined_text(*fields: Column) -> Column:
    """Search text of an item: its non-empty fields, folded, with a space between."""
    return F.array_join(F.filter(F.array(*[normalize_for_search(f) for f in fields]), lambda t: t != ""), " ")


def place_texts(locations: DataFrame, location_tags: DataFrame) -> DataFrame:
    """(key, text) of each location: name, short name and tags in order, so that a term may span them."""
    tags = location_tags.filter("tag <> ''").select("location_key", "tag").distinct()
    listed = tags.groupBy("location_key").agg(F.sort_array(F.collect_list("tag")).alias("_tags"))
    rows = locations.join(listed, "location_key", "left")
    return rows.select(F.col("location_key").alias("key"), joined_text(F.col("name"), F.col("short_name"), F.array_join("_tags", " ")).alias("text"))


def event_texts(events: DataFrame, key: str = "event_id") -> DataFrame:
    """(key, text) of each event."""
    fields = [F.col(c) for c in ("name", "short_name", "description", "location", "sublocation")]
    return events.select(F.col(key).alias("key"), joined_text(*fields).alias("text"))


def grams(texts: DataFrame) -> DataFrame:
    """(gram, key): the different pieces of each text."""
    letters = texts.filter("text <> ''").select("key", F.split("text", "").alias("_letters"))
    piece = F.transform("_letters", lambda c, i: F.concat_ws("", c, *[F.get("_letters", i + k) for k in range(1, GRAM)]))
    return letters.select(F.explode(F.array_distinct(piece)).alias("gram"), "key")


def build_index(texts: DataFrame, path: str | None = None) -> TermIndex:
    """Index of (key, text) rows, written below ``path`` or, without one, to the folder of this run.

    The key belongs to the order too, so a piece that most texts have spreads over files.
    """
    put = materialize if path is None else lambda df, label: _written(df, f"{path}/{label.removeprefix('search-')}")
    kept = put(texts.select("key", "text"), "search-texts")
    words = put(kept.groupBy("text").agg(F.min("key").alias("first")).select("first", "text"), "search-words")
    found = grams(words.withColumnRenamed("first", "key")).withColumnRenamed("key", "first")
    parts = int(words.agg(F.sum(F.length("text"))).first()[0] or 0) // FILE_ROWS + 1
    ordered = found.repartitionByRange(parts, "gram", "first").sortWithinPartitions("gram", "first")
    return TermIndex(put(ordered, "search-postings"), words, kept)


def postings_by_key(index: TermIndex) -> DataFrame:
    """(gram, key) of every key, not only of the first that has a text."""
    keys = index.texts.join(index.words, "text").select("first", "key")
    return index.postings.join(keys, "first").select("gram", "key").distinct()


def _written(df: DataFrame, path: str) -> DataFrame:
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def open_index(spark: SparkSession, path: str) -> TermIndex:
    """An index written by :func:`build_index`."""
    return TermIndex(*[spark.read.parquet(f"{path}/{part}") for part in TermIndex._fields])


def folded(spark: SparkSession, term: str) -> str:
    return spark.range(1).select(normalize_for_search(F.lit(term))).first()[0]


def keys_with(index: TermIndex, term: str) -> DataFrame:
    """Distinct keys whose text holds the term, folded; every key for an empty term.

    What the driver sees are the counts of the term's own pieces.
    """
    needle = folded(index.texts.sparkSession, term)
    if not needle:
        return index.texts.select("key").distinct()
    return index.texts.join(_texts_with(index, needle), "text", "left_semi").select("key").distinct()


def _texts_with(index: TermIndex, needle: str) -> DataFrame:
    """The different texts that hold the folded term."""
    if len(needle) < GRAM:
        near = index.postings.filter(F.startswith("gram", F.lit(needle)))
    else:
        pieces = sorted({needle[i : i + GRAM] for i in range(len(needle) - GRAM + 1)})
        named = index.postings.filter(F.col("gram").isin(pieces))
        held = {r["gram"]: r["n"] for r in named.groupBy("gram").agg(F.count("*").alias("n")).collect()}
        rare = sorted(pieces, key=lambda g: (held.get(g, 0), g))[:PROBES]
        near = index.postings.filter(F.col("gram").isin(rare)).groupBy("first").agg(F.count("*").alias("n")).filter(F.col("n") == len(rare))
    return index.words.join(near, "first", "left_semi").filter(F.contains("text", F.lit(needle))).select("text")


def events_of_term(events: DataFrame, places: TermIndex, texts: TermIndex, term: str) -> DataFrame:
    """All events of locations where the location's text or tags or any event's text has the term.

    ``texts`` is the index of event ids; their locations are looked up for the few events found.
    """
    by_event = events.select("event_id", "location_key").join(keys_with(texts, term).select(F.col("key").alias("event_id")), "event_id", "left_semi")
    keys = keys_with(places, term).select(F.col("key").alias("location_key")).union(by_event.select("location_key"))
    return events.join(keys.distinct(), "location_key", "left_semi")
