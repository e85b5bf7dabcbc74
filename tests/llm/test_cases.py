"""Empty tables, clashing columns, the pipeline and the registered queries."""

import os

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline
from check import rows_of
from marquesina.llm import decontaminate, html, language, lines, packing, private, quality, simhash, substrings, toxicity
from tests.llm.test_operators import SCHEMA, brute_groups, brute_leaks, brute_lines, brute_quality, check_packing, corpus, frame, leaking, ordered  # noqa: F401

FOLDER = "/root/testdata/sf0.001"

PER_DOCUMENT = {
    "quality": quality.ledger, "simhash": simhash.near_duplicates, "lines": lines.removed_lines, "packing": packing.packed,
    "private": private.pseudonymised, "substrings": substrings.repeated_spans, "language": language.scores,
    "toxicity": lambda d: toxicity.score(d, toxicity.train([], [])),
    "leaks": lambda d: decontaminate.contaminated(d, d.select(F.col("doc_id").alias("item_id"), "text")),
}


@pytest.mark.parametrize("name", PER_DOCUMENT)
def test_empty_table(spark, name):
    assert PER_DOCUMENT[name](spark.createDataFrame([], SCHEMA)).collect() == []


@pytest.mark.parametrize("name", PER_DOCUMENT)
def test_columns_that_clash_are_not_read(spark, name):
    rows = [(1, "a b c d e f g h i j k"), (2, "a b c d e f g h i j k"), (None, None), (3, "")]
    plain = frame(spark, rows)
    names = "h root fp t key n_words failures kept score piece length offset block start end line_no part a b u v node _m _k".split()
    crowded = plain.select("*", *[F.lit("x").alias(n) for n in names])
    run = PER_DOCUMENT[name]
    assert ordered(map(tuple, run(crowded).collect())) == ordered(map(tuple, run(plain).collect()))


def test_empty_pages_and_labels(spark):
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    assert html.main_text(pages, html.Labeller.fresh()).collect() == []
    assert toxicity.sample(spark.createDataFrame([], SCHEMA), spark.createDataFrame([], "doc_id long, quality int, toxic int")) == ([], [])


def write(spark, folder, rows, items):
    frame(spark, rows).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")


def test_pipeline(spark, corpus, tmp_path):  # noqa: F811
    rows, items = leaking(corpus)
    write(spark, tmp_path, rows, items)
    failed = lambda t: brute_quality(t)[0] < 10 or 100 * brute_quality(t)[4] > 20 * brute_quality(t)[0]
    kept = [(d, t) for d, t in rows if t and not failed(t) and sum(c.isupper() for c in t) * 2 <= brute_quality(t)[1]]
    gone, _ = brute_lines(kept)
    kept = [(d, t if d is None else "\n".join(x for k, x in enumerate(t.split("\n")) if (d, k) not in gone)) for d, t in kept]
    kept = [r for r, (d, _, first) in zip(kept, brute_groups(kept)) if d is None or d == first]
    kept = [r for r in kept if not brute_leaks([r], items)]
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r["doc_id"] for r in got} == {d for d, _ in kept} and len(kept) > 50
    check_packing(kept, got)


def test_pipeline_on_an_empty_table(spark, tmp_path):
    write(spark, tmp_path, [], [(1, "a b c d e f")])
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []


def test_registered():
    names = entry.queries()
    assert [sum(n.startswith(f"op{i}_") for n in names) for i in range(1, 14)] == [1] * 13 and "pipeline" in names
    assert set(entry.oracle_sql()) <= set(names)


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test data")
def test_quality_next_to_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{FOLDER}/documents.parquet'")
    df = entry.queries()["op4_quality_ledger"](spark, FOLDER)
    cur = con.execute(entry.oracle_sql()["op4_quality_ledger"])
    assert rows_of(df.columns, [tuple(r) for r in df.collect()]) == rows_of([d[0] for d in cur.description], cur.fetchall())
