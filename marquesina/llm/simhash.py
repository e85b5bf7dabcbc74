"""SimHash near-duplicates by covering locality-sensitive hashing.

A fingerprint bit is the majority of that bit over the hashes of the text's shingles. Two fingerprints
are linked when they differ in at most ``RADIUS`` bits. The 64 bit positions are dealt the non-zero
vectors of five bits in turn; table ``v`` keeps the bits whose vector has an odd product with ``v``. The
vectors of four differing bits span at most four of the five dimensions, so some ``v`` is orthogonal to
all of them and its table drops every differing bit: each linked pair collides in one of 31 tables, with
certainty. Every table keeps about half of the bits, so chance collisions stay rare as rows grow.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from marquesina.llm.common import components, map_texts, raw_texts, stage, table

RADIUS = 4
SHINGLE = 4
SEED = 42
# Buckets of up to this many distinct fingerprints are compared inside a task (one row of links per member
# at most); larger ones are linked through midpoints instead, which needs no comparison of pairs.
IN_TASK = 4_096


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def covering_masks(radius: int = RADIUS) -> list[int]:
    """Masks of the 2^(radius+1) - 1 tables, as signed 64-bit integers."""
    top = 1 << (radius + 1)
    vectors = [i % (top - 1) + 1 for i in range(64)]
    return [_signed(sum(1 << i for i, x in enumerate(vectors) if (x & v).bit_count() % 2)) for v in range(1, top)]


def fingerprint(text: bytes) -> int:
    """Majority bits over the 4-word shingles of a lower-cased text, as a signed 64-bit integer."""
    words = text.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = np.concatenate([[0], ends[:-1]])
    n = max(1, len(words) - SHINGLE + 1)
    ends = (ends[SHINGLE - 1 :] if len(words) >= SHINGLE else ends[-1:]) - 1
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter(
        (digest(joined[a:b], SEED) for a, b in zip(starts[:n].tolist(), ends.tolist())), dtype=np.uint64, count=n
    )
    counts = np.zeros(64, dtype=np.int64)
    for at in range(0, n, 65_536):
        part = hashes[at : at + 65_536].astype("<u8").view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(part, axis=1, bitorder="little").sum(0, dtype=np.int64)
    return _signed(int.from_bytes(np.packbits(counts * 2 > n, bitorder="little").tobytes(), "little"))


def fingerprints(docs: DataFrame, *kept: str) -> DataFrame:
    """``(doc_id, fp)`` per document, and the columns ``kept``; a null or blank text has fingerprint zero."""
    columns = ["doc_id", *kept]
    schema = docs.select(F.col("doc_id").cast("long"), *kept).schema.add("fp", "long")

    def make():
        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            fps = pa.array([fingerprint(t) for t in raw_texts(batch)], pa.int64())
            ids = batch.column("doc_id").cast(pa.int64())
            return pa.RecordBatch.from_arrays([ids, *[batch.column(c) for c in kept], fps], [*columns, "fp"])

        return work

    return map_texts(docs, [*columns, "text"], make, schema)


def _spanning(table_: pa.Table) -> pa.Table:
    """Links that join each bucket's near fingerprints into one tree per group."""
    t, key, fp = (table_.column(c).to_numpy() for c in ("t", "key", "fp"))
    order = np.lexsort((fp, key, t))
    t, key, fp = t[order], key[order], fp[order]
    cuts = np.flatnonzero((t[1:] != t[:-1]) | (key[1:] != key[:-1])) + 1
    left, right = [], []
    for values in np.split(fp, cuts):
        bits = values.view(np.uint64)
        waiting = np.ones(len(bits), dtype=bool)
        while waiting.any():
            front = [int(np.argmax(waiting))]
            waiting[front[0]] = False
            while front:
                at = front.pop()
                near = np.flatnonzero(waiting & (np.bitwise_count(bits ^ bits[at]) <= RADIUS))
                waiting[near] = False
                left += [int(values[at])] * len(near)
                right += values[near].tolist()
                front += near.tolist()
    return pa.table({"a": pa.array(left, pa.int64()), "b": pa.array(right, pa.int64())})


def near_links(distinct: DataFrame) -> DataFrame:
    """Links ``(a, b)`` whose connected groups are those of all pairs within the radius.

    ``distinct`` holds each fingerprint once in ``fp``. Buckets are first counted (combined before the
    shuffle), so a crowded bucket is known before any of its rows meet. Buckets of two are decided from
    their smallest and largest member, larger ones inside a task up to ``IN_TASK``. Members of buckets
    beyond that are sent to all fingerprints within two bits: two members within four bits share such a
    midpoint, and two that share one are within four bits, so each midpoint's members all link to its
    smallest one. That is linear in the members whatever the bucket's size.
    """
    spark = distinct.sparkSession
    masks = covering_masks()
    cells = F.explode(F.array(*[
        F.struct(F.lit(i).alias("t"), F.col("fp").bitwiseAND(F.lit(m).cast("long")).alias("key")) for i, m in enumerate(masks)
    ]))
    rows = distinct.select("fp", cells.alias("c")).select("fp", "c.t", "c.key")
    sizes = stage(
        rows.groupBy("t", "key").agg(F.count("*").alias("n"), F.min("fp").alias("a"), F.max("fp").alias("b")).filter("n > 1"), "buckets"
    )
    near = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= RADIUS
    pairs = sizes.filter("n = 2").filter(near).select("a", "b")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    some = rows.join(sizes.filter(f"n > 2 AND n <= {IN_TASK}").select("t", "key"), ["t", "key"])
    inside = (
        some.withColumn("part", F.pmod(F.xxhash64("t", "key"), F.lit(parts * 8)))
        .groupBy("part").applyInArrow(_spanning, "a long, b long")
    )
    crowded = rows.join(sizes.filter(f"n > {IN_TASK}").select("t", "key"), ["t", "key"]).select("fp").distinct()
    one = [1 << i for i in range(64)]
    flips = [0, *one, *[x | y for i, x in enumerate(one) for y in one[:i]]]
    flip = F.explode(F.array(*[F.lit(_signed(x)).cast("long") for x in flips]))
    around = crowded.select("fp", flip.alias("x")).select(F.col("fp").bitwiseXOR(F.col("x")).alias("mid"), "fp")
    low = around.groupBy("mid").agg(F.min("fp").alias("a"), F.count("*").alias("n")).filter("n > 1")
    through = around.join(low, "mid").select("a", F.col("fp").alias("b")).filter("a <> b")
    return pairs.unionByName(inside).unionByName(through.distinct())


def _labels(prints: DataFrame) -> DataFrame:
    """``(fp, root, component_id)`` of the staged fingerprints: the group's smallest fingerprint and its smallest document id."""
    distinct = stage(prints.groupBy("fp").agg(F.min("doc_id").alias("first")), "distinct")
    roots = components(near_links(distinct.select("fp")))
    member = distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = member.groupBy("root").agg(F.min("first").alias("component_id"))
    return stage(member.join(least, "root").select("fp", "root", "component_id"), "groups")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """``(doc_id, fp, component_id)`` per document, the component being the smallest id reachable.

    Copies have one fingerprint and are one node. Repeated rows get a row each, and so do different texts with one
    id, each in the group of its text. Rows without an id belong to the group of their text; a group without any id
    has a null component. Null and blank texts form one group (with whatever lies within four bits of zero). A very
    long text is read whole, in one task.
    """
    prints = stage(fingerprints(docs), "fingerprints")
    return prints.join(_labels(prints).drop("root"), "fp").select("doc_id", "fp", "component_id")


def first_of_group(docs: DataFrame) -> DataFrame:
    """One document per group, the one with the smallest id. Rows without an id cannot be named, so they stay.

    A document is told by its id and its text: of different texts with one id each is judged in its own group, and if
    several of a group have the smallest id, one of them stays.
    """
    keyed = docs.withColumn("_text_key", F.xxhash64("text"))
    prints = stage(fingerprints(keyed, "_text_key"), "fingerprints")
    named = prints.filter("doc_id IS NOT NULL").join(_labels(prints), "fp").filter("doc_id = component_id")
    first = named.groupBy("root", "doc_id").agg(F.min("_text_key").alias("_text_key")).drop("root").distinct()
    stays = keyed.filter("doc_id IS NOT NULL").join(first, ["doc_id", "_text_key"], "left_semi").dropDuplicates(["doc_id", "_text_key"])
    return stays.select(*docs.columns).unionByName(docs.filter("doc_id IS NULL"))


def op10_simhash_groups(spark, folder: str) -> DataFrame:
    rows = near_duplicates(table(spark, folder, "documents"))
    return rows.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
