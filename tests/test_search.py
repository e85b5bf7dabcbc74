"""Trigram index and tag bitmaps next to brute force."""

import random

from pyspark.sql import functions as F

from marquesina.operators import browse as B, search as X
from marquesina.sources.tables import related_tag_edges, tag_settings


def texts_of(spark, rows):
    return spark.createDataFrame(rows, "key long, text string")


def test_terms_are_found_exactly_where_the_text_holds_them(spark, tmp_path):
    r = random.Random(4)
    rows = [(i, "".join(r.choice("abc d") for _ in range(r.randrange(12)))) for i in range(300)] + [(300, "x" * 5000 + "yz"), (301, "日本語 テキスト"), (301, "dé"), (302, "")]
    index = X.build_index(texts_of(spark, rows), str(tmp_path / "index"))
    again = X.open_index(spark, str(tmp_path / "index"))
    for term in ["a", "bc", "ab", "abc", "a b", "b d a", "xyz", "xxyz", "語 テ", "zz", "", "cab c", "dddd"]:
        want = {k for k, t in rows if term in t}
        assert {x.key for x in X.keys_with(index, term).collect()} == want, term
        assert {x.key for x in X.keys_with(again, term.upper()).collect()} == want, term


def test_lookup_reads_the_index_by_piece(spark, tmp_path):
    index = X.build_index(texts_of(spark, [(1, "urgent show 3"), (2, "low show 4")]), str(tmp_path / "index"))
    plan = X.keys_with(index, "show 3")._jdf.queryExecution().toString()
    assert "In(gram" in plan or "EqualTo(gram" in plan
    assert "StartsWith(gram" in X.keys_with(index, "lo")._jdf.queryExecution().toString()


def test_places_are_found_by_tag_and_across_fields(spark):
    tags = spark.createDataFrame([("Live Jazz", "a"), ("jazz club", "a"), ("rock", "b"), (None, "b")], "tag string, location_key string")
    places = spark.createDataFrame([("a", "Hall", "One"), ("b", "Café two", None), ("c", "jazz bar", None)], "location_key string, name string, short_name string")
    index = X.build_index(X.place_texts(places, tags))
    keys = lambda term: {r.key for r in X.keys_with(index, term).collect()}
    assert keys("JAZZ") == {"a", "c"} and keys("one live") == {"a"} and keys("cafe Two rock") == {"b"} and keys("jazz jazz") == {"a"}
    fields = "event_id long, location_key string, name string, short_name string, description string, location string, sublocation string"
    events = spark.createDataFrame([(1, "a", "x", None, "", "Hall", None), (2, "b", "x", None, "", "Hall", None), (3, "c", "Rock!", None, "", "Bar", None), (4, "c", "x", None, "", "", "")], fields)
    found = lambda term: {r.event_id for r in X.events_of_term(events, index, X.build_index(X.event_texts(events)), term).collect()}
    assert found("live jazz") == {1} and found("rock") == {2, 3, 4} and found("hall") == {1, 2}


def test_tag_filters_over_bitmaps(spark):
    r = random.Random(7)
    ids = [1, 2, 32_768, 32_769, 65_536, 1_000_000, 10_000_000_000] + r.sample(range(3, 200_000), 150)
    tags = {i: set(r.sample("abcdef", r.randrange(5))) for i in ids}
    index = spark.createDataFrame([(t, i) for i in ids for t in sorted(tags[i])], "tag string, event_id long")
    events = spark.createDataFrame([(i, "x") for i in ids], "event_id long, bucket string")
    def want(some=(), every=(), bad=()):
        return {i for i in ids if set(every) <= tags[i] and (every or not some or set(some) & tags[i]) and not set(bad) & tags[i]}
    for some, every, bad in [("ab", "", "f"), ("a", "bc", "d"), ("", "a", ""), ("", "", "e"), ("", "", ""), ("z", "", ""), ("", "az", "")]:
        states = {**dict.fromkeys(some, "selected"), **dict.fromkeys(every, "required"), **dict.fromkeys(bad, "forbidden")}
        rows = B.with_matching(events, index, states)
        assert rows.columns == ["event_id", "bucket", "matching"] and rows.count() == len(ids)
        assert {x.event_id for x in rows.filter("matching").collect()} == want(some, every, bad)
        assert {x.event_id for x in B.filter_by_tags(events, index, index, events, states).collect()} == want(some, every, bad)
    counts = B.tag_counts(index).groupBy("tag").agg(F.sum("events").alias("n"))
    assert {x.tag: x.n for x in counts.collect()} == {t: sum(t in s for s in tags.values()) for t in "abcdef"}


def test_readers_of_tag_files(spark, tmp_path):
    (tmp_path / "related.json").write_text('{\n "jazz": [["blues", 0.5], ["soul", 1]],\n "rock": []\n}')
    (tmp_path / "tags.json").write_text('{"geotags": ["North"], "markerColors": {"🎵": "#123"}, "other": 1}')
    assert {tuple(r) for r in related_tag_edges(spark, str(tmp_path / "related.json")).collect()} == {("jazz", "blues", 0.5), ("jazz", "soul", 1.0)}
    tags, colours = tag_settings(spark, str(tmp_path / "tags.json"))
    assert [r.tag for r in tags.collect()] == ["North"] and [tuple(r) for r in colours.collect()] == [("🎵", "#123")]


def test_points_without_a_place_stay(spark):
    points = spark.createDataFrame([(1, None, 1.0), (2, 50.0, 60.0)], "point_id long, lat double, lng double")
    features = spark.createDataFrame([("a", 0.0, 0.0), ("b", None, 1.0)], "location_key string, at_lat double, at_lng double")
    assert {tuple(r) for r in B.nearest_feature(points, features, 0.01).collect()} == {(1, None), (2, "a")}
    assert {tuple(r) for r in B.nearest_feature(points, features.filter("location_key = 'b'"), 0.01).collect()} == {(1, None), (2, None)}


def test_index_is_over_different_texts(spark):
    """Copies of a text add no postings, and every key of a text is found."""
    index = X.build_index(texts_of(spark, [(k, "urgent show") for k in range(7, 57)] + [(3, "low show")]))
    assert index.postings.count() == len("urgent show") + len("low show")
    assert {(r.first, r.text) for r in index.words.collect()} == {(7, "urgent show"), (3, "low show")}
    found = lambda term: {r.key for r in X.keys_with(index, term).collect()}
    assert found("gent") == found("ur") == set(range(7, 57)) and found("show") == {3, *range(7, 57)}
    assert X.postings_by_key(index).filter("gram = 'urg'").count() == 50
