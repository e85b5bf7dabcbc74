"""Dirty JSON to typed columns.

Arrays of mixed elements are read as variants, so one bad element never costs the whole row.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from marquesina.functions.dates import FUTURE_DAYS, parse_date, parse_time_text, twelve_hour
from marquesina.functions.text import blank_to_null, strip

OCCURRENCE = "struct<start_date:date,start_time:string,end_date:date,end_time:string>"

# Shape of the nested show API: event -> venues -> shows, all keyed by id.
SHOW = "struct<dia:string,hora:string,proxima_fecha:string>"
VENUE = f"struct<nombre:string,direccion:string,zona:string,funciones:map<string,{SHOW}>>"
API_EVENT = (
    "struct<titulo:string,url:string,url_entradas:string,"
    f"clasificaciones:map<string,struct<descripcion:string>>,lugares:map<string,{VENUE}>>"
)
API_PAYLOAD = f"map<string,{API_EVENT}>"

# Class names and the emoji shown for them.
CLASS_EMOJI = {
    "teatro": "🎭", "danza": "💃", "música": "🎵", "musica": "🎵", "humor": "🤣", "circo": "🎪",
    "infantil": "🧸", "títeres": "🎭", "titeres": "🎭", "stand up": "🎤", "comedia musical": "🎶",
    "unipersonal": "🎭", "monólogo": "🎤", "monologo": "🎤", "improvisación": "🎭",
    "improvisacion": "🎭", "ópera": "🎶", "opera": "🎶", "clown": "🤡", "varieté": "🎪",
    "variete": "🎪", "performance": "🎭", "biodrama": "🎬", "poesía": "📖", "poesia": "📖",
}
NO_CLASS_EMOJI = "📅"
OTHER_CLASS_EMOJI = "🎭"
SHOW_SITE = "https://www.alternativateatral.com/"


def _kind(v: Column) -> Column:
    return F.schema_of_variant(v)


def strict_json(text: Column) -> Column:
    """Variant of text that is one JSON value and nothing else, null otherwise.

    The parser alone would ignore text after the first value.
    """
    wrapped = F.try_parse_json(F.concat(F.lit("["), text, F.lit("]")))
    return F.when(F.size(wrapped.cast("array<variant>")) == 1, F.try_variant_get(wrapped, "$[0]", "variant"))


def json_container(text: Column) -> Column:
    """Variant of a JSON object or array; scalars and broken text are null (K1)."""
    v = strict_json(text)
    return F.when(_kind(v).rlike("^(ARRAY|OBJECT)"), v)


def json_elements(text: Column) -> Column:
    """Array of variants, null unless the text is a JSON array."""
    v = strict_json(text)
    return F.when(_kind(v).startswith("ARRAY"), v).cast("array<variant>")


def _text_only(v: Column, path: str) -> Column:
    """A field as text, only when it is a JSON string."""
    field = F.try_variant_get(v, path, "variant")
    return F.when(_kind(field) == "STRING", F.try_variant_get(v, path, "string"))


def parse_tags(text: Column) -> Column:
    """Trimmed non-empty strings of a JSON array, everything else dropped (K2)."""
    strings = F.filter(F.coalesce(json_elements(text), F.array().cast("array<variant>")), lambda v: _kind(v) == "STRING")
    return F.filter(F.transform(strings, lambda v: strip(v.cast("string"))), lambda t: F.length(t) > 0)


def parse_occurrences(text: Column, today: Column, days: int = FUTURE_DAYS) -> Column:
    """Occurrences that start within ``days`` from ``today``; malformed entries dropped."""
    objects = F.filter(
        F.coalesce(json_elements(text), F.array().cast("array<variant>")), lambda v: _kind(v).startswith("OBJECT")
    )
    parsed = F.transform(objects, lambda v: F.struct(
        parse_date(F.try_variant_get(v, "$.start_date", "string")).alias("start_date"),
        parse_time_text(_text_only(v, "$.start_time")).alias("start_time"),
        parse_date(F.try_variant_get(v, "$.end_date", "string")).alias("end_date"),
        parse_time_text(_text_only(v, "$.end_time")).alias("end_time"),
    ))
    return F.filter(parsed, lambda o: F.coalesce(o["start_date"].between(today, F.date_add(today, days)), F.lit(False)))


def response_events(text: Column) -> Column:
    """Event variants of ``{"events": [...]}`` or a bare array, else an empty array (K3)."""
    v = strict_json(text)
    inner = F.try_variant_get(v, "$.events", "variant")
    chosen = F.when(_kind(v).startswith("ARRAY"), v).when(_kind(inner).startswith("ARRAY"), inner)
    return F.coalesce(chosen.cast("array<variant>"), F.array().cast("array<variant>"))


def is_valid_json(text: Column) -> Column:
    return strict_json(text).isNotNull()


def occurrence_total(events: Column) -> Column:
    """Number of occurrences over all event variants."""
    def size_of(v: Column) -> Column:
        field = F.try_variant_get(v, "$.occurrences", "variant")
        return F.coalesce(F.size(F.when(_kind(field).startswith("ARRAY"), field).cast("array<variant>")), F.lit(0))
    return F.aggregate(events, F.lit(0), lambda total, v: total + size_of(v))


def strip_jsonp(text: Column, callback: str | None = None) -> Column:
    """JSON inside a callback wrapper, or the text itself."""
    body = strip(F.regexp_replace(text, r"^\x{feff}", ""))
    generic = r"(?s)^[a-zA-Z_]\w*\s*\((.*)\)\s*;?\s*$"
    out = F.when(body.rlike(generic), F.regexp_extract(body, generic, 1)).otherwise(body)
    if callback:
        prefix = callback + "("
        tail = F.regexp_replace(F.substr(body, F.lit(len(prefix) + 1)), r"(?U);*\s*$", "")
        named = F.regexp_replace(tail, r"\)$", "")
        out = F.when(body.startswith(prefix), named).otherwise(out)
    return out


def at_path(text: Column, dotted: str | None) -> Column:
    """JSON text under a dotted path."""
    return F.get_json_object(text, "$." + dotted) if dotted else text


def last_per_key(entries: Column) -> Column:
    """Entries of a JSON object with repeated keys: the last one counts, at the first one's place."""
    keys = F.array_distinct(F.transform(entries, lambda e: e["key"]))
    return F.transform(keys, lambda k: F.element_at(F.filter(entries, lambda e: e["key"] == k), -1))


def _entries(m: Column) -> Column:
    return last_per_key(F.map_entries(m))


def _values(m: Column, kind: str) -> Column:
    return F.coalesce(F.transform(_entries(m), lambda e: e["value"]), F.array().cast(f"array<{kind}>"))


def class_names(event: Column) -> Column:
    return F.filter(
        F.transform(_values(event["clasificaciones"], "struct<descripcion:string>"), lambda c: c["descripcion"]),
        lambda d: F.coalesce(d != "", F.lit(False)),
    )


def class_emoji(event: Column) -> Column:
    """Emoji of the first known class; without any class map a calendar."""
    table = F.create_map(*[F.lit(x) for pair in CLASS_EMOJI.items() for x in pair])
    known = F.filter(F.transform(class_names(event), lambda d: table[strip(F.lower(d))]), lambda e: e.isNotNull())
    return F.when(event["clasificaciones"].isNull(), NO_CLASS_EMOJI).otherwise(F.coalesce(F.get(known, F.lit(0)), F.lit(OTHER_CLASS_EMOJI)))


def show_occurrences(venue: Column) -> Column:
    """Dated shows of a venue as occurrences with a 12-hour clock."""
    dated = F.filter(_values(venue["funciones"], SHOW), lambda s: blank_to_null(s["proxima_fecha"]).isNotNull())
    def occurrence(s: Column) -> Column:
        at = s["proxima_fecha"]
        cut = F.instr(at, " ")
        return F.struct(
            F.substring_index(at, " ", 1).alias("start_date"),
            F.when(cut > 0, blank_to_null(twelve_hour(F.substr(at, cut + 1)))).alias("start_time"),
            F.lit(None).cast("string").alias("end_date"),
            F.lit(None).cast("string").alias("end_time"),
        )
    return F.filter(F.transform(dated, occurrence), lambda o: o["start_date"] != "")


def has_show_in_window(event: Column, now: Column, days: int = 30) -> Column:
    """No readable date at all, or one within ``days`` from ``now``."""
    shows = F.flatten(F.transform(_values(event["lugares"], VENUE), lambda v: _values(v["funciones"], SHOW)))
    at = F.filter(
        F.transform(shows, lambda s: F.try_to_timestamp(s["proxima_fecha"], F.lit("y-M-d H:m"))),
        lambda t: t.isNotNull(),
    )
    return (F.size(at) == 0) | F.exists(at, lambda t: t.between(now, now + F.make_dt_interval(days=F.lit(days))))


def markdown_digest(event_id: Column, event: Column) -> Column:
    """One event as markdown lines."""
    def line(label: str, text: Column) -> Column:
        return F.when(F.coalesce(text, F.lit("")) != "", F.array(F.concat(F.lit(label), text))).otherwise(F.array().cast("array<string>"))
    def given(*cols: Column) -> Column:
        return F.filter(F.array(*cols), lambda t: F.coalesce(t != "", F.lit(False)))
    def show_line(s: Column) -> Column:
        text = F.array_join(given(s["dia"], s["hora"]), " ")
        text = F.concat(text, F.coalesce(F.concat(F.lit(" (next: "), blank_to_null(s["proxima_fecha"]), F.lit(")")), F.lit("")))
        return line("- ", strip(text))
    def venue_lines(v: Column) -> Column:
        return F.concat(
            line("**Venue:** ", v["nombre"]),
            line("**Address:** ", F.array_join(given(v["direccion"], v["zona"]), ", ")),
            F.flatten(F.transform(_values(v["funciones"], SHOW), show_line)),
        )
    return F.array_join(F.concat(
        F.array(F.concat(F.lit("## "), F.coalesce(event["titulo"], F.concat(F.lit("Event "), event_id)))),
        line("**Tags:** ", F.array_join(class_names(event), ", ")),
        F.flatten(F.transform(_values(event["lugares"], VENUE), venue_lines)),
        line("**URL:** " + SHOW_SITE, event["url"]),
        line("**Tickets:** ", event["url_entradas"]),
        F.array(F.lit("")),
    ), "\n")
