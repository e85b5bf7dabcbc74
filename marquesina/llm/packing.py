"""Best-fit packing of token sequences by exact-complement hashing.

Only lengths matter to packing, and there are at most ``CAPACITY`` of them, so the plan is made from a
histogram whose size does not depend on the corpus: single lengths, sums of two and sums of three are
indexed, the combinations that exactly fill the gap beside a length are consumed as often as the counts
allow, and what is left is placed best-fit. The plan is a short list of patterns with multiplicities. The
pieces are then numbered within their length, in parallel, and each takes the place its number has in
the plan.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from marquesina.llm.common import map_texts, stage, table

CAPACITY = 1024
END = 2
TOKENIZER, RANKS = "byte_bpe_50k.json", "byte_bpe_50k.tiktoken"


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Encoder:
    """Little-endian 32-bit token ids of whole texts.

    The ids are those of ``tokenizers`` for the vocabulary at ``path``. Texts of Latin letters without special
    tokens are given to ``tiktoken`` with the ranks of the same vocabulary, which yields the same ids in a
    third of the time; all other texts, where the two libraries' character classes might differ, are not.
    """

    def __init__(self, path: str, ranks: str):
        import base64
        import os
        import re

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(ranks, "rb") as lines:
            table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={})
        self.other = re.compile(r"[^\t\n\r\x20-\x7e\xa1-\u024f]|<\|").search

    def encode(self, text: str) -> bytes:
        if self.other(text):
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()
        return np.array(self.fast.encode_ordinary(text), dtype="<u4").tobytes()


def pieces(docs: DataFrame, path: str | None = None, ranks: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """``(doc_id, piece, start, length, ids_crc32)``: token counts of documents, cut where longer than ``capacity``.

    The shorter piece of a cut document comes first. A null text is the empty text: one piece holding the end
    token. Repeated rows are packed once each; null ids are carried along.
    """
    end = np.array([END], dtype="<u4").tobytes()
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long"

    def make():
        encoder = Encoder(path or tokenizer_path(), ranks or tokenizer_path(RANKS))

        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            out: list[list] = [[], [], [], [], []]
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                ids = encoder.encode(text or "") + end
                n = len(ids) // 4
                first = n % capacity or capacity
                cuts = [0, *range(first, n + 1, capacity)]
                for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
                    for column, value in zip(out, (doc, k, a, b - a, zlib.crc32(ids[4 * a : 4 * b]))):
                        column.append(value)
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds)], ["doc_id", "piece", "start", "length", "ids_crc32"])

        return work

    return map_texts(docs, ["doc_id", "text"], make, schema)


def _fill(gap: int, top: int, counts: np.ndarray, most: int) -> tuple[int, ...] | None:
    """Up to ``most`` available lengths, none above ``top``, that exactly fill ``gap``: fewest first, then largest first."""
    if gap <= top and counts[gap]:
        return (gap,)

    def pair(total: int, limit: int) -> tuple[int, int] | None:
        a = np.arange(min(limit, total - 1), (total + 1) // 2 - 1, -1)
        b = total - a
        ok = (counts[a] > 0) & (counts[b] > (a == b))
        return (int(a[np.argmax(ok)]), int(b[np.argmax(ok)])) if ok.any() else None

    if most >= 2 and gap >= 2 and (two := pair(gap, top)):
        return two
    for a in range(min(top, gap - 2), (gap + 2) // 3 - 1, -1) if most >= 3 else ():
        if counts[a]:
            counts[a] -= 1
            two = pair(gap - a, a)
            counts[a] += 1
            if two:
                return (a, *two)
    return None


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, tuple[int, ...]]]:
    """Patterns ``(sequences, lengths)`` that use up the histogram, the shortest of a few plans.

    Exact complements are consumed for singles, then pairs, then triples, meeting the widest gaps or the
    narrowest first; which of these is best depends on how many short pieces there are, and trying all
    costs milliseconds on a histogram. Every pattern exhausts a length or closes a class of open sequences,
    so their number is bounded by the number of lengths, not of pieces.
    """
    half = capacity // 2
    wide = [*range(half + 1, capacity), *range(half, 0, -1)]
    narrow = list(range(capacity - 1, 0, -1))
    plans = [_plan(histogram, capacity, order, most) for order in (wide, narrow) for most in (3, 2, 1)]
    return min(plans, key=lambda p: sum(n for n, _ in p))


def _plan(histogram: dict[int, int], capacity: int, order: list[int], most: int) -> list[tuple[int, tuple[int, ...]]]:
    counts = np.zeros(capacity + 1, dtype=np.int64)
    for length, n in histogram.items():
        counts[length] = n
    out: list[tuple[int, tuple[int, ...]]] = []
    if counts[capacity]:
        out.append((int(counts[capacity]), (capacity,)))
        counts[capacity] = 0
    for size in range(1, most + 1):
        for length in order:
            while counts[length]:
                counts[length] -= 1
                rest = _fill(capacity - length, min(length, capacity - length), counts, size)
                counts[length] += 1
                if rest is None:
                    break
                use = {x: (length, *rest).count(x) for x in {length, *rest}}
                times = min(int(counts[x]) // k for x, k in use.items())
                for x, k in use.items():
                    counts[x] -= k * times
                out.append((times, (length, *rest)))
    open_: dict[int, list[tuple[int, tuple[int, ...]]]] = {}
    for length in range(capacity, 0, -1):
        while counts[length]:
            left = int(counts[length])
            gap = min((g for g in open_ if g >= length), default=None)
            if gap is None:
                each = capacity // length
                full, rest = divmod(left, each)
                for n, k in ((full, each), (1, rest)):
                    if n and k:
                        open_.setdefault(capacity - k * length, []).append((n, (length,) * k))
                counts[length] = 0
            else:
                n, pattern = open_[gap].pop()
                fit = min(n, left)
                if n > fit:
                    open_[gap].append((n - fit, pattern))
                if not open_[gap]:
                    del open_[gap]
                open_.setdefault(gap - length, []).append((fit, (*pattern, length)))
                counts[length] -= fit
    return out + [p for patterns in open_.values() for p in patterns]


def places(patterns: list[tuple[int, tuple[int, ...]]]) -> list[tuple[int, int, int, int, int]]:
    """Rows ``(length, from_rank, to_rank, first_sequence, offset)`` of a plan."""
    used: dict[int, int] = {}
    rows, sequence = [], 0
    for n, lengths in patterns:
        offset = 0
        for length in lengths:
            at = used.get(length, 0)
            rows.append((length, at, at + n, sequence, offset))
            used[length] = at + n
            offset += length
        sequence += n
    return rows


def pack(rows: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to pieces with a ``length`` of at most ``capacity``.

    Pieces are numbered within (length, share), the shares being hash classes as many as there are shuffle
    partitions, so that even a length held by a third of all pieces is numbered by many tasks. Driver and
    tasks see the histogram and the plan, whose sizes are bounded by the capacity.
    """
    spark = rows.sparkSession
    rows = stage(rows, "pieces")
    shares = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.withColumn("_share", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(shares)))
    cells = stage(dealt.groupBy("length", "_share").agg(F.count("*").alias("_n")), "cells")
    histogram = {r[0]: r[1] for r in cells.groupBy("length").agg(F.sum("_n")).collect()}
    before = Window.partitionBy("length").orderBy("_share").rowsBetween(Window.unboundedPreceding, -1)
    offsets = cells.select("length", "_share", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    within = Window.partitionBy("length", "_share").orderBy("doc_id", "piece")
    ranked = (
        dealt.withColumn("_row", F.row_number().over(within) - 1)
        .join(offsets, ["length", "_share"]).withColumn("_rank", F.col("_row") + F.col("_before"))
    )
    spots = places(plan(histogram, capacity))
    # Bounded by the capacity (see plan), whatever the number of pieces.
    steps = F.broadcast(spark.createDataFrame(spots, "length long, _from long, _to long, _first long, offset long"))
    fits = (ranked["length"] == steps["length"]) & (ranked["_rank"] >= steps["_from"]) & (ranked["_rank"] < steps["_to"])
    return ranked.join(steps, fits).select(
        *[ranked[c] for c in rows.columns], (F.col("_first") + F.col("_rank") - F.col("_from")).alias("sequence_id"), "offset"
    )


def packed(docs: DataFrame, path: str | None = None, ranks: str | None = None) -> DataFrame:
    """Pieces of all documents with their places in sequences of ``CAPACITY`` tokens."""
    return pack(pieces(docs, path, ranks))


def op3_packed_sequences(spark, folder: str) -> DataFrame:
    return packed(table(spark, folder, "documents"))
