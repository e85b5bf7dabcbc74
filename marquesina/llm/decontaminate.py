"""Benchmark decontamination by size-partitioned MinHash containment search.

Test items are short and documents long, so their Jaccard similarity is near zero; what counts is the
share of an item's shingles that a document contains. Items are partitioned by their number of distinct
shingles, in powers of two. All items of a partition keep a bottom-k MinHash sketch of one size: the k
smallest shingle hashes, where k exceeds the number of shingles that the largest item of the partition
may miss at the threshold. A document that contains enough of an item must then hold at least one hash
of its sketch, so the search misses nothing; each candidate is verified by exact shingle containment.

The test items are the query set. They are sent to the tasks in blocks of bounded size (``BLOCK_BYTES``);
a benchmark of any size is searched block after block, each against all documents.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from marquesina.llm.common import WordHash, gram_hashes, keep_rows, map_texts, raw_texts, table

SHINGLE = 5
THRESHOLD = 0.8
# Most text of test items in one block, and with it in the closure of a task.
BLOCK_BYTES = 8_000_000

# Letters lower-cased, ASCII punctuation as space, so that re-wrapped or re-punctuated passages still match.
FOLD = bytes(
    (c + 32 if 65 <= c < 91 else c if c >= 128 or 48 <= c < 58 or 97 <= c < 123 else 32) for c in range(256)
)


def words_of(text: bytes) -> list[bytes]:
    return text.translate(FOLD).split()


def shingles_of(words: list[bytes], n: int = SHINGLE) -> list[bytes]:
    """Runs of ``n`` words; none if there are fewer."""
    return [b" ".join(words[i : i + n]) for i in range(len(words) - n + 1)]


class ItemIndex:
    """Sketches of one block of test items."""

    def __init__(self, items: list[tuple[int, bytes]], threshold: float = THRESHOLD):
        hashes = WordHash()
        self.ids: list[int] = []
        self.grams: list[np.ndarray] = []
        self.texts: list[set[bytes]] = []
        self.need: list[int] = []
        # Runs of words to take of a document: those of a shingle, and the lengths of all shorter items.
        self.runs = {SHINGLE}
        for item, text in items:
            words = words_of(text)
            if words:
                n = min(SHINGLE, len(words))
                self.runs.add(n)
                self.ids.append(item)
                self.grams.append(np.unique(gram_hashes(hashes.of(words), n)))
                self.texts.append(set(shingles_of(words, n)))
                self.need.append(int(np.ceil(round(threshold * len(self.texts[-1]), 6))))
        # k of a size partition: one more than the most shingles that any item of it may miss.
        sizes = [len(x).bit_length() for x in self.texts]
        k: dict[int, int] = {}
        for size, texts, need in zip(sizes, self.texts, self.need):
            k[size] = max(k.get(size, 1), len(texts) - need + 1)
        pairs = sorted((int(h), i) for i, (size, grams) in enumerate(zip(sizes, self.grams)) for h in grams[: k[size]])
        self.sketch, self.first = np.unique(np.array([h for h, _ in pairs], dtype=np.uint64), return_index=True)
        self.owner = [i for _, i in pairs]
        self.first = np.append(self.first, len(pairs))
        self.sieve = np.zeros(1 << 20, dtype=bool)
        self.sieve[self.sketch >> np.uint64(44)] = True

    def matches(self, text: bytes, hashes: WordHash) -> list[tuple[int, int, int]]:
        """(item number, shared shingles, shingles of the item) of every item contained in the text."""
        words = words_of(text)
        runs = [n for n in self.runs if n <= len(words)]
        if not runs or not len(self.sketch):
            return []
        hashed = hashes.of(words)
        grams = np.concatenate([gram_hashes(hashed, n) for n in runs])
        some = np.unique(grams[self.sieve[grams >> np.uint64(44)]])
        hit = self.sketch[np.searchsorted(self.sketch, some) % len(self.sketch)] == some
        if not hit.any():
            return []
        rows = np.searchsorted(self.sketch, some[hit])
        candidates = sorted({self.owner[x] for r in rows for x in range(self.first[r], self.first[r + 1])})
        own = np.unique(grams)
        out, exact = [], None
        for i in candidates:
            if np.isin(self.grams[i], own, assume_unique=True).sum() >= self.need[i]:
                exact = {x for n in runs for x in shingles_of(words, n)} if exact is None else exact
                shared = len(self.texts[i] & exact)
                if shared >= self.need[i]:
                    out.append((i, shared, len(self.texts[i])))
        return out


def item_blocks(benchmark: DataFrame, block_bytes: int = BLOCK_BYTES):
    """Blocks of test items of bounded size, in order of their ids; the driver holds one block at a time."""
    block, size = [], 0
    for row in benchmark.select(F.col("item_id").cast("long"), "text").filter("text IS NOT NULL").orderBy("item_id", "text").toLocalIterator():
        block.append((row[0], row[1].encode()))
        size += len(block[-1][1])
        if size >= block_bytes:
            yield block
            block, size = [], 0
    if block:
        yield block


def contaminated(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``(doc_id, item_id, shared, shingles)`` of every document that contains a test item.

    Texts are folded to words of letters and digits; an item of fewer than five words is one shingle of all its
    words, looked for among the runs of as many words of every document. Null or blank items and texts match nothing;
    a very long text is searched whole, in one task.
    Repeated documents or items give a row each; null ids are carried along. Empty tables give no rows.
    """
    parts = []
    for block in item_blocks(benchmark):
        parts.append(map_texts(docs, ["doc_id", "text"], _searcher(block, threshold), "doc_id long, item_id long, shared long, shingles long"))
    if not parts:
        return docs.select(F.col("doc_id").cast("long"), F.lit(0).cast("long").alias("item_id"), F.lit(0).cast("long").alias("shared"), F.lit(0).cast("long").alias("shingles")).filter("false")
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def _searcher(block: list[tuple[int, bytes]], threshold: float) -> Callable:
    def make():
        index, hashes = ItemIndex(block, threshold), WordHash()

        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            ids = batch.column("doc_id").to_pylist()
            rows = [(d, index.ids[i], shared, n) for d, t in zip(ids, raw_texts(batch)) for i, shared, n in index.matches(t, hashes)]
            columns = list(zip(*rows)) if rows else [(), (), (), ()]
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["doc_id", "item_id", "shared", "shingles"])

        return work

    return make


def clean(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Documents that contain no test item, with their columns unchanged; nothing is shuffled."""

    def tester(block: list[tuple[int, bytes]]):
        def make():
            index, hashes = ItemIndex(block, threshold), WordHash()
            return lambda texts: [not index.matches(t, hashes) for t in texts]

        return make

    for block in item_blocks(benchmark):
        docs = keep_rows(docs, tester(block))
    return docs


def op1_benchmark_leaks(spark, folder: str) -> DataFrame:
    rows = contaminated(table(spark, folder, "documents"), table(spark, folder, "benchmark"))
    return rows.select("doc_id", "item_id", "shared", "shingles", (F.col("shared") / F.col("shingles")).alias("containment"))
