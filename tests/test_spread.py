import random
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import functions as F

from marquesina.operators import browse as B, rules as R, skew as K, venues as V
from marquesina.operators.lifecycle import numbered, upsert
from marquesina.streaming import limits as N


def hot_rows(spark, n=400):
    r = random.Random(1)
    data = [("hot" if r.random() < 0.6 else f"k{r.randint(0, 3)}", i, r.randint(0, 50), r.randint(1, 9)) for i in range(n)]
    return data, spark.createDataFrame(data, "k string, seq long, at long, v long")


def test_running_values_equal_plain_ones(spark):
    data, df = hot_rows(spark)
    block = F.floor(F.col("at") / 7)
    total = K.running_total(df, ["k"], block, ["at", "seq"], {"s": F.col("v")})
    got = {r.seq: r.s for r in total.collect()}
    prev = {r.seq: r.p for r in K.previous_value(df, ["k"], block, ["at", "seq"], F.col("v"), "p").collect()}
    top = {r.seq: r.m for r in K.running_max(df, ["k"], block, ["at", "seq"], F.col("v"), "m").collect()}
    pdf = pd.DataFrame(data, columns=["k", "seq", "at", "v"]).sort_values(["at", "seq"])
    for _, g in pdf.groupby("k"):
        run, last, best = 0, None, None
        for row in g.itertuples():
            assert prev[row.seq] == last and top[row.seq] == best
            run, last, best = run + row.v, row.v, max(best or 0, row.v)
            assert got[row.seq] == run


def test_ids_are_dense_and_ordered(spark):
    df = spark.range(0, 100, 1, 7).select((F.col("id") * 37 % 101).alias("x"))
    got = sorted((r.x, r.id) for r in numbered(df, ["x"], 500).collect())
    assert [i for _, i in got] == list(range(501, 601))


def test_upsert(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "k long, v string")
    new = spark.createDataFrame([(2, "x"), (3, "y")], "k long, v string")
    assert sorted(map(tuple, upsert(old, new, ["k"], ["v"]).collect())) == [(1, "a"), (2, "x"), (3, "y")]
    assert sorted(map(tuple, upsert(old, new, ["k"]).collect())) == [(1, "a"), (2, "b"), (3, "y")]


WORDS = ["teatro municipal", "teatro municipall", "teatro munciipal", "gran sala caracas", "gran sala de caracas", "sala grande", "cine", "cines", "abc", "abcd", "centro cultural chacao", "centro cultural de chacao"]


def test_fuzzy_pairs_are_complete(spark):
    keys = spark.createDataFrame([(w,) for w in WORDS], "key string")
    got = {(r.key, r.venue) for r in V.fuzzy_pairs(keys, keys.withColumnRenamed("key", "venue")).collect()}
    assert got == {(k, v) for k in WORDS for v in WORDS if SequenceMatcher(None, v, k).ratio() >= 0.85}


def test_few_fuzzy_pairs_reach_the_ratio(spark):
    r = random.Random(3)
    names = sorted({"teatro " + "".join(r.choice("abcdefghilmnoprstuv") for _ in range(r.randint(5, 12))) for _ in range(600)})
    names += [n[:-1] + "x" for n in names[:20]]
    keys = spark.createDataFrame([(n,) for n in names], "key string")
    pairs = keys.crossJoin(keys.withColumnRenamed("key", "venue"))
    full = pairs.withColumn("kl", V._letters(F.col("key"))).withColumn("kp", V._bigrams(F.col("key"))).withColumn("vl", V._letters(F.col("venue"))).withColumn("vp", V._bigrams(F.col("venue")))
    assert V._within_bounds(full).count() < 0.02 * len(names) ** 2
    got = {(x.key, x.venue) for x in V.fuzzy_pairs(keys, keys.withColumnRenamed("key", "venue")).collect()}
    assert all((n, n[:-1] + "x") in got for n in names[:20])
    sample = r.sample(names, 60)
    want = {(k, v) for k in sample for v in sample if SequenceMatcher(None, v, k).ratio() >= 0.85}
    assert want == {p for p in got if p[0] in sample and p[1] in sample}


def test_venue_steps(spark):
    loc = spark.createDataFrame([(1, "Teatro Chacao", None, None), (2, "Sala Uno", "Calle 1", None), (3, "Old", None, "x")], "id long, name string, address string, deleted_at string")
    alias = spark.createDataFrame([(1, "Teatro Municipal de Chacao")], "location_id long, alternate_name string")
    rows = spark.createDataFrame([
        (1, "teatro chacao", None), (2, "Teatro Chacao!", None), (3, "teatro municipal de chacao", None), (4, "Teatro Chacaoo", None), (5, "Nowhere", None), (6, None, None), (7, "Sala Uno", "Calle 2")],
        "id long, location_name string, sublocation string").withColumn("site_name", F.lit("Sala Uno")).withColumn("event_name", F.lit("Show"))
    got = {r.id: (r.location_id, r.level) for r in V.resolve_existing(rows, loc, alias).collect()}
    assert got == {1: (1, 0), 2: (1, 1), 3: (1, 2), 4: (1, 3), 5: (2, 4), 7: (2, 1)}


def test_window_load_in_batch_and_stream(spark, tmp_path):
    r = random.Random(5)
    rows = [("a" if r.random() < 0.8 else "b", 1000 + i // 3) for i in range(300)]
    df = spark.createDataFrame(rows, "key string, t long").select("key", F.timestamp_seconds("t").alias("at"))
    want = {}
    for k, t in rows:
        want[k, t // 5 * 5] = want.get((k, t // 5 * 5), 0) + 1
    read = lambda d: {(x.key, x.start): (x.requests, x.over) for x in d.select("key", F.unix_seconds("window_start").alias("start"), "requests", "over").collect()}
    assert read(N.window_load(df, (4, 5))) == {k: (n, max(n - 4, 0)) for k, n in want.items()}
    df.repartition(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")).withWatermark("at", "1 minute")
    q = N.window_load(stream, (4, 5)).writeStream.format("memory").queryName("load").outputMode("complete").option(
        "checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert read(spark.table("load")) == read(N.window_load(df, (4, 5)))


def test_a_crowded_key_gives_the_same_answer_as_a_small_one(spark):
    tags = [(1, f"t{i}") for i in range(25_000)] + [(1, "jazz"), (1, "bad"), (2, "jazz"), (2, "bad"), (3, "jazz"), (4, "x")]
    index = spark.createDataFrame(tags, "event_id long, tag string")
    events = spark.createDataFrame([(i,) for i in range(1, 6)], "event_id long")
    matching = lambda states: {r.event_id for r in B.with_matching(events, index, states).filter("matching").collect()}
    assert matching({"jazz": "selected"}) == {1, 2, 3}
    assert matching({"jazz": "selected", "bad": "forbidden"}) == {3}
    assert matching({"jazz": "required", "bad": "required"}) == {1, 2}
    rules = spark.createDataFrame([("rewrite", "jazz", "Jazz!"), ("exclude", "x", None), ("remove", "bad", None)], "rule_type string, key string, replacement string")
    rows = index.select("event_id", F.lit(1).alias("group"), F.col("tag").alias("at"), "tag")
    done, removed = R.apply_tag_rules(rows, "event_id", rules)
    assert {r.event_id: r.n for r in done.groupBy("event_id").agg(F.count("*").alias("n")).collect()} == {1: 25_002, 2: 2, 3: 1}
    assert {r.event_id for r in done.filter("tag = 'Jazz!'").collect()} == {1, 2, 3} and {r.event_id for r in removed.collect()} == {1, 2}


def test_nearest_feature_equals_brute_force(spark):
    r = random.Random(2)
    features = [(f"f{i}", r.uniform(0, 3), r.uniform(0, 3)) for i in range(60)] + [("far", 40.0, 40.0)]
    points = [(i, r.uniform(-1, 4), r.uniform(-1, 4)) for i in range(200)] + [(200, 39.0, 41.0)]
    got = {x.point_id: x.location_key for x in B.nearest_feature(
        spark.createDataFrame(points, "point_id long, lat double, lng double"), spark.createDataFrame(features, "location_key string, at_lat double, at_lng double"), 0.01).collect()}
    assert got == {i: min(((x - lng) ** 2 + (y - lat) ** 2, k) for k, y, x in features)[1] for i, lat, lng in points}


def test_best_of_names_that_differ_in_a_number(spark):
    r = random.Random(7)
    venues = [f"customer{n:09d}" for n in r.sample(range(3000), 500)] + ["furniture hall peru", "furniture hall iran"]
    keys = [f"customer{n:09d}" for n in r.sample(range(3000), 40)] + [f"customer{n:09d} iran" for n in r.sample(range(3000), 10)] + ["furniture hal peru", "customer00000012", "cus"]
    asked, held = (spark.createDataFrame([(x,) for x in xs], f"{c} string") for xs, c in ((sorted(set(keys) - set(venues)), "key"), (venues, "venue")))
    want = set()
    for (k,) in asked.collect():
        scores = {v: SequenceMatcher(None, v, k).ratio() for v in venues}
        want |= {(k, v) for v, x in scores.items() if x == max(scores.values()) >= 0.85}
    assert {(x.key, x.venue) for x in V.best_fuzzy(asked, held).collect()} == want
    floors = V._scored(V._near(asked, held)).filter("score >= 0.85").groupBy("key").agg(F.max("score").alias("floor"))
    left = V._candidates(asked.join(floors, "key").select("key", "floor"), held, True)
    assert floors.count() > 30 and left.count() < 0.01 * floors.count() * len(venues)


def test_feed_children_are_made_of_lines_of_shown_events_only(spark):
    from marquesina.plans.bindings import Bound
    from marquesina.plans.listings import feed

    read = feed(Bound(spark, "/root/testdata/sf0.001")).inputFiles()
    assert not [f for f in read if "lineitem" in f] and [f for f in read if "feed-lines" in f]


def test_a_written_step_leaves_no_shuffle_files(spark):
    import time

    from marquesina.session import materialize

    key, files = "spark.sql.classic.shuffleDependency.fileCleanup.enabled", lambda: {
        f for f in spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().mkString("\n").split("\n") if "/shuffle_" in f}
    before, held = files(), spark.conf.get(key)
    out = materialize(spark.range(10_000).groupBy((F.col("id") % 100).alias("k")).count(), "counts")
    until = time.time() + 20
    while files() - before and time.time() < until:
        time.sleep(0.2)
    assert files() - before == set() and spark.conf.get(key) == held
    assert out.count() == 100
