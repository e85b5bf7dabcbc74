"""Readers and writers of the engine's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from marquesina.operators.feed import document_lines


def edges_of(objects: DataFrame) -> DataFrame:
    """(tag, related, weight) from JSON objects ``tag: [[related, weight], ...]`` in column ``value``."""
    table = F.from_json("value", "map<string,array<array<string>>>")
    return objects.select(F.explode(table).alias("tag", "near")).select("tag", F.explode("near").alias("n")).select(
        "tag", F.get("n", F.lit(0)).alias("related"), F.get("n", F.lit(1)).cast("double").alias("weight"))


def settings_of(objects: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Geographic tags and (emoji, colour) pairs from JSON objects in column ``value``."""
    parsed = objects.select(F.from_json("value", "struct<geotags:array<string>,markerColors:map<string,string>>").alias("s"))
    return parsed.select(F.explode("s.geotags").alias("tag")), parsed.select(F.explode("s.markerColors").alias("emoji", "colour"))


def related_tag_edges(spark: SparkSession, path: str) -> DataFrame:
    """Edges of the file of related tags, one object."""
    return edges_of(spark.read.text(path, wholetext=True))


def tag_settings(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Geographic tags and marker colours of the tag settings file, one object."""
    return settings_of(spark.read.text(path, wholetext=True))


FEED_EDGES = ("[", "]")
GEOJSON_EDGES = ('{"type":"FeatureCollection","features":[', "]}")


def write_document(lines: DataFrame, order: list[str], edges: tuple[str, str], path: str) -> None:
    """Write JSON lines as one document (A13, A15): its parts, joined in the order of their names, are valid JSON.

    Ranges of the order go to different tasks and files; nothing is brought together.
    """
    document_lines(lines, order, *edges).orderBy("part", "at", "copy").select("value").write.mode("overwrite").text(path)


def read_document(spark: SparkSession, path: str, edges: tuple[str, str]) -> DataFrame:
    """The elements (value) of a written document, without their commas."""
    lines = spark.read.text(path).filter(~F.col("value").isin(*edges))
    return lines.select(F.regexp_replace("value", "^,", "").alias("value"))
