"""Corpus-wide lookups of hashed keys, exchanged in blocks.

A count over all word pairs of a corpus has about as many keys as the corpus has words. One row per key
would cost tens of bytes and a join of that size; here documents are dealt to blocks of bounded size, a
block asks once for each distinct key it holds, and the questions of a block to one share of the key
space travel as a single packed value:

    documents by block  --ask-->  (block, share, keys)  --answer per share-->  (block, share, reply)

The reply comes back in the order of the question, so the block can look its keys up by position. Every
key is asked once per block however often it occurs, so a frequent key does not crowd a share. Blocks,
shares and the tasks that hold them grow in number with the bytes of the input, not in size.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from marquesina.llm.common import stage

# Text per block; a document is never divided, so one of this size or more has a block of its own.
BLOCK_BYTES = 6_000_000


# Text whose keys one share holds, and blocks or shares that one task takes, one after the other.
SHARE_BYTES = 12_000_000
IN_TASK = 3


def text_bytes(docs: DataFrame) -> int:
    return int(docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0)


def _tasks(df: DataFrame, groups: int) -> int:
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), groups // IN_TASK + 1)


def shares_of(docs: DataFrame, total: int) -> int:
    """Number of shares for ``total`` bytes of text, one a task at least."""
    return max(_tasks(docs, 0), total // SHARE_BYTES + 1)


def in_blocks(docs: DataFrame, total: int, *columns: Column | str, kind: Column | None = None, size: int = BLOCK_BYTES) -> DataFrame:
    """Deal ``total`` bytes of documents to blocks by a hash of id and text; ``kind`` keeps groups of documents in blocks of their own."""
    blocks = total // size + 1
    kind = F.lit(0) if kind is None else kind
    dealt = docs.select((F.pmod(F.xxhash64("doc_id", "text"), F.lit(blocks)) * 4 + kind).alias("block"), *columns)
    return dealt.repartition(_tasks(docs, blocks), "block")


def pack6(keys: np.ndarray) -> bytes:
    """Low six bytes of each key; the share a key belongs to is known besides."""
    return keys.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6].tobytes()


def unpack6(data: bytes) -> np.ndarray:
    out = np.zeros((len(data) // 6, 8), dtype=np.uint8)
    out[:, :6] = np.frombuffer(data, dtype=np.uint8).reshape(-1, 6)
    return out.view("<u8").ravel()


def share_cuts(keys: np.ndarray, shares: int) -> tuple[np.ndarray, np.ndarray]:
    """Order of the keys by share, then by key, and where each share starts in it."""
    share = (keys >> np.uint64(32)) * np.uint64(shares) >> np.uint64(32)
    order = np.lexsort((keys & np.uint64((1 << 48) - 1), share))
    return order, np.searchsorted(share[order], np.arange(shares + 1))


def answered(blocks: DataFrame, shares: int, ask: Callable[[pa.Table], pa.Table], asks: str, answer: Callable[[pa.Table], pa.Table], label: str) -> DataFrame:
    """Replies ``(block, share, reply)``, written to the shared folder.

    ``ask`` turns one block's documents into questions with columns ``block``, ``share`` and whatever
    ``asks`` lists besides; ``answer`` sees all questions of one share.
    """
    questions = blocks.groupBy("block").applyInArrow(ask, asks).repartition(_tasks(blocks, shares), "share")
    return stage(questions.groupBy("share").applyInArrow(answer, "block long, share int, reply binary"), label)


def with_replies(blocks: DataFrame, total: int, replies: DataFrame, finish: Callable[[pa.Table, pa.Table], pa.Table], schema: str) -> DataFrame:
    """Each block's documents together with its replies; ``total`` as for the blocks."""
    met = replies.repartition(_tasks(blocks, total // BLOCK_BYTES + 1), "block")
    return blocks.groupBy("block").cogroup(met.groupBy("block")).applyInArrow(finish, schema)
