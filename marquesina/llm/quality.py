"""Quality rules as a bitmask ledger.

Every rule is evaluated once per document. The ledger keeps the measurements and one integer whose
bit ``i`` says that rule ``i`` failed. A policy is a named, versioned mask of rules; applying one, or
asking what each rule of it costs, is bit arithmetic over the ledger and never reads a text again.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from marquesina.llm.common import WordHash, gram_hashes, keep_rows, map_texts, raw_texts, table

SYMBOLS = b"#*$%&|<>"
SPACES = b" \t\n\x0b\x0c\r"
CONTINUATION = bytes(range(0x80, 0xC0))
UPPER = bytes(range(65, 91))
WINDOW = 5

MEASURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_exclaim", "n_upper"]

# Bit i is rule i. Each rule is written once, as an expression both Spark and plain Python evaluate.
RULES = [
    ("few_words", "n_words < 10"),
    ("repeated_words", "100 * n_repeat_words > 20 * n_words"),
    ("symbols", "10 * n_symbols > n_words"),
    ("repeated_lines", "10 * n_dup_lines > 5 * n_lines"),
    ("shouting", "10 * n_exclaim > 3 * n_words"),
    ("capitals", "2 * n_upper > word_chars"),
    ("short_words", "word_chars < 2 * n_words"),
    ("long_words", "word_chars > 30 * n_words"),
]
BIT = {name: 1 << i for i, (name, _) in enumerate(RULES)}


@dataclass(frozen=True)
class Policy:
    """The rules that count, under a version that stays readable when the set changes."""

    version: str
    rules: tuple[str, ...]

    @property
    def mask(self) -> int:
        return sum(BIT[r] for r in self.rules)


BASE = Policy("base-1", ("few_words", "repeated_words"))
CURRENT = Policy("clean-1", tuple(BIT))


def measure(text: bytes, hashes: WordHash) -> tuple[int, ...]:
    words = text.split()
    n = len(words)
    repeated = 0
    if n >= WINDOW:
        grams = gram_hashes(hashes.of(words), WINDOW)
        order = np.sort(grams)
        twice = order[1:][order[1:] == order[:-1]]
        if len(twice):
            starts = np.flatnonzero(np.isin(grams, twice))
            change = np.zeros(n + 1, dtype=np.int64)
            np.add.at(change, starts, 1)
            np.add.at(change, starts + WINDOW, -1)
            repeated = int((np.cumsum(change[:n]) > 0).sum())
    lines = [x for x in text.split(b"\n") if x.strip()]
    return (
        n,
        len(text.translate(None, SPACES + CONTINUATION)),
        len(text) - len(text.translate(None, SYMBOLS)),
        len(lines) - len(set(lines)),
        repeated,
        len(lines),
        text.count(b"!"),
        len(text) - len(text.translate(None, UPPER)),
    )


def failure_bits() -> Column:
    """Failure bits from the columns of measurements."""
    bits = F.lit(0).cast("long")
    for i, (_, rule) in enumerate(RULES):
        bits = bits.bitwiseOR(F.when(F.expr(rule), F.lit(1 << i).cast("long")).otherwise(F.lit(0).cast("long")))
    return bits


def ledger(docs: DataFrame) -> DataFrame:
    """One row per document: ``doc_id``, the measurements and ``failures``.

    A null text measures as the empty text and fails ``few_words``; repeated rows get a row each; a null
    id is carried along. Only ``doc_id`` and ``text`` are read, so further columns cannot clash. Windows
    are compared by 64-bit hashes.
    """

    def make():
        hashes = WordHash()

        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            rows = [measure(x, hashes) for x in raw_texts(batch)]
            columns = list(zip(*rows)) if rows else [()] * len(MEASURES)
            return pa.RecordBatch.from_arrays(
                [batch.column("doc_id").cast(pa.int64()), *[pa.array(c, pa.int64()) for c in columns]], ["doc_id", *MEASURES]
            )

        return work

    rows = map_texts(docs, ["doc_id", "text"], make, "doc_id long, " + ", ".join(f"{m} long" for m in MEASURES))
    return rows.withColumn("failures", failure_bits())


def verdict(policy: Policy) -> Column:
    """True where a ledger row passes the policy."""
    return F.col("failures").bitwiseAND(F.lit(policy.mask)) == 0


def ablations(rows: DataFrame, policy: Policy = CURRENT) -> DataFrame:
    """What each rule of a policy does: documents it fails, fails alone, and that are kept without it.

    The ledger is first counted per distinct bit pattern (combined before the shuffle, at most two to the
    number of rules rows); the rest is bit arithmetic on those counts.
    """
    patterns = rows.groupBy(F.col("failures").bitwiseAND(F.lit(policy.mask)).alias("bits")).agg(F.count("*").alias("n"))
    rules = F.explode(F.array(*[F.struct(F.lit(r).alias("rule"), F.lit(BIT[r]).cast("long").alias("bit")) for r in policy.rules]))
    hit = F.col("bits").bitwiseAND(F.col("r.bit")) != 0
    alone = F.col("bits") == F.col("r.bit")
    return (
        patterns.select("bits", "n", rules.alias("r"))
        .groupBy(F.col("r.rule").alias("rule"))
        .agg(
            F.sum(F.when(hit, F.col("n")).otherwise(0)).alias("failed"),
            F.sum(F.when(alone, F.col("n")).otherwise(0)).alias("failed_alone"),
            F.sum(F.when((F.col("bits") == 0) | alone, F.col("n")).otherwise(0)).alias("kept_without"),
        )
        .withColumn("policy", F.lit(policy.version))
    )


def passes(policy: Policy) -> Callable[[], Callable[[list[bytes]], list[bool]]]:
    """Batch test of whole texts against a policy, for filtering documents in place."""
    chosen = [compile(rule, name, "eval") for name, rule in RULES if name in policy.rules]

    def make():
        hashes = WordHash()

        def one(text: bytes) -> bool:
            values = dict(zip(MEASURES, measure(text, hashes)))
            return not any(eval(rule, {}, values) for rule in chosen)

        return lambda texts: [one(t) for t in texts]

    return make


def accepted(docs: DataFrame, policy: Policy = CURRENT) -> DataFrame:
    """Documents that pass ``policy``, with their columns unchanged."""
    return keep_rows(docs, passes(policy))


def op4_quality_ledger(spark, folder: str) -> DataFrame:
    rows = ledger(table(spark, folder, "documents"))
    return rows.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        (~verdict(BASE)).alias("base_failed"), verdict(CURRENT).alias("kept"), "failures",
    )


OP4_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents
), pos AS (
  SELECT rid, w, p FROM (SELECT rid, unnest(words) AS w, generate_subscripts(words, 1) AS p FROM d)
), win AS (
  SELECT rid, p, w || ' ' || lead(w, 1) OVER o || ' ' || lead(w, 2) OVER o || ' ' || lead(w, 3) OVER o || ' ' || lead(w, 4) OVER o AS g
  FROM pos WINDOW o AS (PARTITION BY rid ORDER BY p)
), twice AS (
  SELECT rid, p FROM (SELECT rid, p, count(*) OVER (PARTITION BY rid, g) AS n FROM win WHERE g IS NOT NULL) WHERE n > 1
), rep AS (
  SELECT rid, count(DISTINCT p + k) AS n_repeat_words FROM twice, range(5) r(k) GROUP BY rid
), lines AS (
  SELECT rid, x FROM (SELECT rid, unnest(string_split(text, chr(10))) AS x FROM d) WHERE regexp_matches(x, '[^\x20\x09-\x0D]')
), line AS (
  SELECT rid, count(*) AS n_lines, count(*) - count(DISTINCT x) AS n_dup_lines FROM lines GROUP BY rid
), m AS (
  SELECT doc_id, len(words) AS n_words, length(array_to_string(words, '')) AS word_chars,
         length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols, coalesce(n_dup_lines, 0) AS n_dup_lines,
         coalesce(n_repeat_words, 0) AS n_repeat_words, coalesce(n_lines, 0) AS n_lines,
         length(regexp_replace(text, '[^!]', '', 'g')) AS n_exclaim, length(regexp_replace(text, '[^A-Z]', '', 'g')) AS n_upper
  FROM d LEFT JOIN rep USING (rid) LEFT JOIN line USING (rid)
), f AS (
  SELECT *, (CASE WHEN n_words < 10 THEN 1 ELSE 0 END) + (CASE WHEN 100 * n_repeat_words > 20 * n_words THEN 2 ELSE 0 END)
          + (CASE WHEN 10 * n_symbols > n_words THEN 4 ELSE 0 END) + (CASE WHEN 10 * n_dup_lines > 5 * n_lines THEN 8 ELSE 0 END)
          + (CASE WHEN 10 * n_exclaim > 3 * n_words THEN 16 ELSE 0 END) + (CASE WHEN 2 * n_upper > word_chars THEN 32 ELSE 0 END)
          + (CASE WHEN word_chars < 2 * n_words THEN 64 ELSE 0 END) + (CASE WHEN word_chars > 30 * n_words THEN 128 ELSE 0 END) AS failures
  FROM m
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (failures & 3) <> 0 AS base_failed, failures = 0 AS kept, failures FROM f
"""
