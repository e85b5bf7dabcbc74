import datetime as dt

import pytest
from pyspark.sql import functions as F

from marquesina.functions import dates as D, geo as G, jsons as J, names as N, tags as TG, text as T, venues as V
from marquesina.operators import browse as B, content as C


def values(spark, items, expr, kind="string"):
    df = spark.createDataFrame([(i, x) for i, x in enumerate(items)], f"i int, x {kind}")
    return [r.y for r in df.select("i", expr(F.col("x")).alias("y")).orderBy("i").collect()]


def test_normalized_names(spark):
    got = values(spark, ["Café Noël", "Alice/Bob", "foo___bar", " a\t b\n", "ﬁne ½", "Ｆｕｌｌ", None], T.normalize_name)
    assert got == ["cafe noel", "alice bob", "foobar", "a b", "fine 1 2", "full", None]


def test_stems(spark):
    words = ["dinner", "dining", "tues", "residency", "residence", "stories", "boxes", "creation", "decision", "cat", "is", "as", "sing"]
    assert values(spark, words, N.stem) == ["dine", "dine", "tuesday", "residenc", "residenc", "story", "box", "creat", "decis", "cat", "is", "as", "sing"]


def test_titles(spark):
    assert values(spark, ["[member-only] Sewing", "fido Coffee Bark"], N.strip_prefixes) == ["Sewing", "Coffee Bark"]
    names = ["Manhattan Theatre Club Presents The Monsters", "Lincoln Center Presents: Jazz at Midnight", "The Monsters: a Sibling Love Story", "ABC: Long Title Here", "Hosted by Jane: Talk"]
    assert values(spark, names, N.core_title) == ["The Monsters", "Jazz at Midnight", "The Monsters", "ABC: Long Title Here", "Talk"]


PAIRS = [
    ("Knicks Men's Game", "Knicks Women's Game", True, False), ("Podcast Live Ep. 1", "Podcast Live Ep. 2", True, False),
    ("Jazz Night | 6:00 PM", "Jazz Night | 8:00 PM", True, False), ("Jam Session Set 1", "Jam Session Set 2", True, False),
    ("Knicks vs Lakers", "Knicks vs Celtics", True, False), ("Comedy Show Early Set", "Comedy Show Late Set", True, False),
    ("Café Jazz", "cafe jazz", False, True), ("[member-only] Sewing Machines", "Sewing Machines", False, True),
    ("Jazz at Lincoln Center", "Jazz at Lincoln Center Tonight", False, True),
    ("Manhattan Theatre Club Presents The Monsters", "The Monsters", False, True),
    ("Brooklyn Jazz Night Downtown", "Brooklyn Jazz Night Uptown", False, True),
    ("The Residency Program", "The Residence Program", False, True), ("Backstage Pass: Duran Duran", "Backstage Pass: Arctic Monkeys", False, False),
]


def test_pairs(spark):
    df = spark.createDataFrame([(i, a, b) for i, (a, b, _, _) in enumerate(PAIRS)], "i int, a string, b string")
    df = N.add_name_features(N.add_name_features(df, "a", "fa"), "b", "fb")
    got = df.select("i", N.false_positive(F.col("fa"), F.col("fb")).alias("f"), N.similar(F.col("fa"), F.col("fb")).alias("s")).orderBy("i").collect()
    assert [(r.f, r.s) for r in got] == [(f, s) for _, _, f, s in PAIRS]


def test_occurrences_and_tags(spark):
    day = F.lit("2026-04-10").cast("date")
    raw = ['[{"start_date":"2026-04-15","start_time":" 7 PM ","end_date":"garbage"},"x",{},null,{"start_date":"2020-01-01"},{"start_date":"2026-4-16"},{"start_date":"2099-01-01"}]', "42", "not json", None, '{"a":1}', "[1] tail"]
    got = values(spark, raw, lambda c: J.parse_occurrences(c, day))
    assert [tuple(o) for o in got[0]] == [(dt.date(2026, 4, 15), "7 PM", None, None), (dt.date(2026, 4, 16), None, None, None)]
    assert got[1:] == [[], [], [], [], []]
    assert values(spark, ['["Music","",null,42,"  Art  "]', "not json", '{"a":1}', None], J.parse_tags) == [["Music", "Art"], [], [], []]


def test_jsonp(spark):
    texts = ['cb({"a":1});', 'other( {"a":1} )', '﻿cb({"a":1})', '{"a":1}']
    assert [t.strip() for t in values(spark, texts, lambda c: J.strip_jsonp(c, "cb"))] == ['{"a":1}'] * 4


def test_clock_and_instants(spark):
    got = values(spark, ["7:30 PM", "19:00", "", None, "12am", "noon"], D.clock)
    assert [(r.hours, r.minutes) for r in got] == [(19, 30), (19, 0), (12, 0), (12, 0), (0, 0), (12, 0)]
    assert values(spark, ["20:00", "09:05", "soon"], D.twelve_hour) == ["8:00 PM", "9:05 AM", "soon"]


def test_emoji_and_short_names(spark):
    texts = ["🎭 Show", "⬜ 🎵 x", "a 🎵 x", "⬜ x", "plain"]
    assert values(spark, texts, T.first_emoji) == ["🎭", "🎵", "🎵", None, None]
    assert values(spark, texts, T.without_leading_emoji) == ["Show", "x", "a 🎵 x", "⬜ x", "plain"]
    assert values(spark, ["Exhibition: Art - at Hall", "Art"], lambda c: T.short_name(c, F.lit("Hall"))) == ["Art", "Art"]


def test_venue_keys(spark):
    assert values(spark, ["Virtual", "The Grand Old Theatre!", "The Bar", None], V.venue_key) == ["", "grand old theatre", "the bar", ""]


def test_city_and_distance(spark):
    pts = spark.createDataFrame([(10.48, -66.9), (10.6, -66.9), (10.48, -66.7), (10.55, -66.9)], "y double, x double")
    assert [r[0] for r in pts.select(G.in_city(F.col("y"), F.col("x"))).collect()] == [True, False, False, True]
    d = pts.limit(1).select(G.haversine_m(F.lit(10.48), F.lit(-66.9), F.lit(10.489), F.lit(-66.9))).first()[0]
    assert 800 < d < 1200


def test_tag_processing(spark):
    df = spark.createDataFrame([(["rock", "Rock ", "bad", "Jazz"],)], "t array<string>")
    rewrites = F.create_map(F.lit("rock"), F.lit("Rock Music"))
    got = df.select(TG.process_tags(TG.clean_tag_list(F.col("t")), rewrites, F.array(F.lit("bad")), F.array(F.lit("Extra"), F.lit("jazz")))).first()[0]
    assert got == ["Extra", "jazz", "Rock Music"]


def greedy(text, limit):
    """Plain packing of paragraphs, lines where a paragraph alone is too long."""
    import re

    def pack(items, join, extra, split=None):
        out, cur, size = [], [], 0
        for item in items:
            if split and len(item) + extra > limit:
                if cur:
                    out.append(join.join(cur))
                out, cur, size = out + split(item), [], 0
                continue
            if size + len(item) + extra > limit and cur:
                out.append(join.join(cur))
                cur, size = [], 0
            cur.append(item)
            size += len(item) + extra
        return out + ([join.join(cur)] if cur else [])

    return [text] if len(text) <= limit else pack(re.split(r"\n\n+", text), "\n\n", 2, lambda p: pack(p.split("\n"), "\n", 1))


def test_chunks_by_size(spark):
    texts = ["short", "a" * 30 + "\n\n" + "b" * 30 + "\n\n\n" + "c" * 10, "\n".join("line%d" % i for i in range(40)) + "\n\nend", "x" * 200]
    assert values(spark, texts, lambda c: C.chunk_by_size(c, 50)) == [greedy(t, 50) for t in texts]


def test_chunks_by_event(spark):
    text = "intro\n" + "\n".join(f"{i}. ### [E{i}]\nbody" for i in range(5))
    got = values(spark, [text, "none"], lambda c: C.chunk_by_events(c, 2))
    assert [c.count("###") for c in got[0]] == [2, 2, 1] and "\n".join(got[0]) == text and got[1] == ["none"]


CLOCKS = [None, "", "7:30 PM", "19:00", "12am", "12:15 am", "7 pamm", "25:00", "10:75", "9:", "8 : 5 : x", "99999999999", "noon", " 7 ", "13 pm"]


def test_clock_reads_a_text_once(spark):
    """However often its parts are used, a pattern runs once: one look for each of hour and minute."""
    rows = spark.createDataFrame([(dt.date(2026, 4, 1), c) for c in CLOCKS], "d date, c string")
    made = rows.select(D.day_instant(F.col("d"), F.col("c")).alias("a"), D.event_instant(F.date_format("d", "yyyy-MM-dd"), F.col("c")).alias("b"), "c")
    plan = rows.select(D.day_instant(F.col("d"), F.col("c")).alias("a"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract") == 2 and plan.count("regexp_replace") == 1
    got = {r.c: (r.a, r.b) for r in made.collect()}
    at = lambda h, m: dt.datetime(2026, 4, 1) + dt.timedelta(hours=h + 4, minutes=m)
    want = dict.fromkeys(CLOCKS, at(12, 0)) | {
        "7:30 PM": at(19, 30), "19:00": at(19, 0), "12am": at(0, 0), "12:15 am": at(0, 15), "25:00": None, "10:75": None, "9:": at(9, 0), "8 : 5 : x": at(8, 5), " 7 ": at(7, 0), "13 pm": at(13, 0)}
    assert got == {c: (t, t) for c, t in want.items()}


def test_stored_ends_equal_bound_ends(spark):
    starts = [dt.datetime(2026, 4, 1, h, 0) for h in (3, 4, 12, 23)]
    rows = spark.createDataFrame([(s, s + dt.timedelta(minutes=m)) for s in starts for m in (0, 90, 300, 900, 2000)] + [(starts[0], None)], "s timestamp, e timestamp")
    made = rows.select(D.effective_end(F.col("s"), F.col("e")).alias("a"), D.effective_end_of(F.col("s"), F.col("e")).alias("b"), "e").collect()
    assert all(r.a == r.b for r in made) and any(r.a != r.e for r in made)


def test_days_around_a_range_keep_ends_that_cannot_be_read(spark):
    day = dt.date
    rows = [(1, day(2026, 4, 10), None, day(2026, 4, 1), "25:00"), (2, day(2026, 4, 1), None, None, None), (3, day(2026, 4, 1), None, day(2026, 4, 10), None)]
    occurrences = spark.createDataFrame(rows, "event_id long, start_date date, start_time string, end_date date, end_time string")
    near = B.around_days(occurrences, day(2026, 4, 9), day(2026, 4, 11))
    assert {r.event_id for r in near.collect()} == {1, 3}
