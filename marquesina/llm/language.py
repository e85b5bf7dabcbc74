"""Language-model scores by deleted interpolation.

The probability of a token after its predecessor mixes three estimates: the relative frequency of the
pair, the relative frequency of the token, and a uniform share for what was never seen. The mixture
weights depend on how often the predecessor was seen (in powers of two) and are learned by expectation
maximisation on held-out counts: pairs of the training documents in the ``TUNE`` part are predicted from
the counts of all others, with their own counts deleted.

All counts cover the whole corpus; tokens and pairs are counted by 64- and 54-bit hashes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from marquesina.llm.common import MIX, WordHash, crc_mod, table
from marquesina.llm.exchange import answered, in_blocks, pack6, share_cuts, shares_of, text_bytes, unpack6, with_replies

FOLDS = 7
HELD_OUT = 2
TUNE = 3
LEVELS = 40
GRID = 8.0
ROUNDS = 60

START, END = np.uint64(1), np.uint64(2)
# Kinds of document, each in blocks of its own.
LEARN, TUNED, SCORED = 0, 1, 2


def tokens(texts: list[bytes], hashes: WordHash) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all tokens, an end after each text, and the number of tokens per text."""
    parts, sizes = [], []
    for text in texts:
        words = text.lower().split()
        parts.append(hashes.of(words))
        parts.append(np.array([END], dtype=np.uint64))
        sizes.append(len(words) + 1)
    return (np.concatenate(parts) if parts else np.zeros(0, np.uint64)), np.array(sizes, dtype=np.int64)


def pair_keys(words: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Predecessor of every token and the key of the pair."""
    before = np.roll(words, 1)
    before[np.concatenate([[0], np.cumsum(sizes)[:-1]])] = START
    keys = (before ^ (words * MIX)) * MIX
    return before, keys ^ (keys >> np.uint64(31))


class Block:
    """Distinct tokens and pairs of one block of documents, in the order in which they are asked for."""

    def __init__(self, docs: pa.Table, shares: int):
        texts = [t or b"" for t in docs.column("text").cast(pa.large_binary()).to_pylist()]
        self.words, self.sizes = tokens(texts, WordHash())
        self.before, pairs = pair_keys(self.words, self.sizes)
        self.one, self.one_at, self.one_n = np.unique(self.words, return_inverse=True, return_counts=True)
        self.two, self.two_at, self.two_n = np.unique(pairs, return_inverse=True, return_counts=True)
        self.one_order, self.one_cuts = share_cuts(self.one, shares)
        self.two_order, self.two_cuts = share_cuts(self.two, shares)

    def answers(self, replies: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        """(all, tuned) counts of the distinct tokens and pairs."""
        one, two = np.zeros((2, len(self.one)), np.int64), np.zeros((2, len(self.two)), np.int64)
        for share, reply in zip(replies.column("share").to_pylist(), replies.column("reply").to_pylist()):
            a, b = self.one_cuts[share : share + 2]
            c, d = self.two_cuts[share : share + 2]
            n1, n2 = b - a, d - c
            counts = _unpack_counts(reply, 2 * (n1 + n2))
            one[:, self.one_order[a:b]] = counts[: 2 * n1].reshape(2, n1)
            two[:, self.two_order[c:d]] = counts[2 * n1 :].reshape(2, n2)
        return one, two


def _pack_counts(counts: np.ndarray) -> bytes:
    """A byte per count; counts of 255 and more follow as (position, count)."""
    small = np.minimum(counts, 255).astype(np.uint8)
    at = np.flatnonzero(counts >= 255)
    return small.tobytes() + np.stack([at, counts[at]], axis=1).astype("<i8").tobytes()


def _unpack_counts(data: bytes, n: int) -> np.ndarray:
    counts = np.frombuffer(data, dtype=np.uint8, count=n).astype(np.int64)
    at, value = np.frombuffer(data, dtype="<i8", offset=n).reshape(-1, 2).T if len(data) > n else ([], [])
    counts[np.asarray(at, dtype=np.int64)] = value
    return counts


def _asker(shares: int):
    def ask(docs: pa.Table) -> pa.Table:
        number = docs.column("block")[0].as_py()
        block = Block(docs, shares)
        learned = number % 4 != SCORED
        rows = []
        for share in range(shares):
            one = block.one_order[block.one_cuts[share] : block.one_cuts[share + 1]]
            two = block.two_order[block.two_cuts[share] : block.two_cuts[share + 1]]
            if len(one) or len(two):
                counts = _pack_counts(np.concatenate([block.one_n[one], block.two_n[two]])) if learned else b""
                rows.append((number, share, block.one[one].astype("<u8").tobytes(), pack6(block.two[two]), counts))
        columns = list(zip(*rows)) if rows else [()] * 5
        kinds = [pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary()]
        return pa.table([pa.array(c, k) for c, k in zip(columns, kinds)], names=["block", "share", "one", "two", "counts"])

    return ask


def _answer(questions: pa.Table) -> pa.Table:
    """Sum the counts of one share over all blocks and reply to each block in its own order."""
    numbers = questions.column("block").to_pylist()
    asked = []
    for name, read in (("one", lambda x: np.frombuffer(x, dtype="<u8")), ("two", unpack6)):
        asked.append([read(x) for x in questions.column(name).to_pylist()])
    kept = questions.column("counts").to_pylist()
    sums = []
    for k in (0, 1):
        keys, at = np.unique(np.concatenate(asked[k]), return_inverse=True)
        total = np.zeros((2, len(keys)), np.int64)
        start = 0
        for i, number in enumerate(numbers):
            n = len(asked[k][i])
            if number % 4 != SCORED:
                n1, n2 = len(asked[0][i]), len(asked[1][i])
                counts = _unpack_counts(kept[i], n1 + n2)
                mine = counts[:n1] if k == 0 else counts[n1:]
                np.add.at(total[0], at[start : start + n], mine)
                if number % 4 == TUNED:
                    np.add.at(total[1], at[start : start + n], mine)
            start += n
        sums.append((total, at, np.concatenate([[0], np.cumsum([len(x) for x in asked[k]])])))
    replies = []
    for i in range(len(numbers)):
        parts = [total[:, at[cuts[i] : cuts[i + 1]]].ravel() for total, at, cuts in sums]
        replies.append(_pack_counts(np.concatenate(parts)))
    learned, tuned = sums[0][0]
    distinct = np.array([(learned > 0).sum(), learned.sum(), tuned.sum()], dtype="<i8").tobytes()
    # One more row, for block -1, tells how many token kinds, tokens and tuning tokens of this share were learned.
    share = questions.column("share")[0].as_py()
    return pa.table([
        pa.array([*numbers, -1], pa.int64()), pa.array([share] * (len(numbers) + 1), pa.int32()), pa.array([*replies, distinct], pa.binary())
    ], names=["block", "share", "reply"])


def _level(seen: np.ndarray) -> np.ndarray:
    """Bucket of a context by its frequency: powers of two, 0 for never."""
    return np.minimum(np.frexp(seen.astype(np.float64))[1], LEVELS - 1)


def _estimates(block: Block, replies: pa.Table, deleted: bool, starts: tuple[int, int]):
    """Counts behind each token: of itself, its context and the pair; with the tuned part taken out if ``deleted``."""
    one, two = block.answers(replies)
    one, two = (one[0] - one[1], two[0] - two[1]) if deleted else (one[0], two[0])
    begun = starts[0] - starts[1] if deleted else starts[0]
    token, pair = one[block.one_at], two[block.two_at]
    context = np.roll(token, 1)
    context[np.concatenate([[0], np.cumsum(block.sizes)[:-1]])] = begun
    return token, context, pair


def _tuner(shares: int, total: int, kinds: int, starts: tuple[int, int]):
    """Held-out tokens as a histogram over context level and the two log frequencies, on a fixed grid."""
    def cells(key, docs: pa.Table, replies: pa.Table) -> pa.Table:
        if not docs.num_rows:
            return pa.table([pa.array([], pa.int64())] * 4, names=["level", "p1", "p2", "n"])
        token, context, pair = _estimates(Block(docs, shares), replies, True, starts)
        with np.errstate(divide="ignore", invalid="ignore"):
            p1 = np.where(token > 0, np.rint(-np.log2(token / total) * GRID), -1).astype(np.int64)
            p2 = np.where(pair > 0, np.rint(-np.log2(pair / context) * GRID), -1).astype(np.int64)
        rows, n = np.unique(np.stack([_level(context), p1, p2], axis=1), axis=0, return_counts=True)
        return pa.table([*[pa.array(rows[:, k], pa.int64()) for k in range(3)], pa.array(n, pa.int64())], names=["level", "p1", "p2", "n"])

    return cells


def mixture(cells: list[tuple[int, int, int, int]], kinds: int, rounds: int = ROUNDS) -> np.ndarray:
    """Weights (pair, token, uniform) per context level by expectation maximisation over the histogram."""
    weights = np.tile([0.3, 0.6, 0.1], (LEVELS, 1))
    if cells:
        level, p1, p2, n = np.array(cells, dtype=np.int64).T
        given = np.stack([
            np.where(p2 >= 0, np.exp2(-p2 / GRID), 0.0), np.where(p1 >= 0, np.exp2(-p1 / GRID), 0.0), np.full(len(n), 1 / (kinds + 1)),
        ], axis=1)
        for _ in range(rounds):
            part = weights[level] * given
            part *= (n / part.sum(1))[:, None]
            sums = np.stack([np.bincount(level, part[:, k], LEVELS) for k in range(3)], axis=1) + [0.01, 0.05, 0.01]
            weights = sums / sums.sum(1, keepdims=True)
    weights[0] = [0.0, *(weights[0, 1:] / weights[0, 1:].sum())]
    return weights


def _scorer(shares: int, total: int, kinds: int, starts: tuple[int, int], weights: np.ndarray):
    names = ["doc_id", "n_tokens", "n_known", "base_score", "score"]

    def finish(key, docs: pa.Table, replies: pa.Table) -> pa.Table:
        types = [pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64()]
        if not docs.num_rows:
            return pa.table([pa.array([], t) for t in types], names=names)
        block = Block(docs, shares)
        token, context, pair = _estimates(block, replies, False, starts)
        mix = weights[_level(context)]
        p = mix[:, 0] * pair / np.maximum(context, 1) + mix[:, 1] * token / max(total, 1) + mix[:, 2] / (kinds + 1)
        cuts = np.concatenate([[0], np.cumsum(block.sizes)[:-1]])
        base = np.log10((token + 1.0) / (total + kinds + 1))
        columns = [
            docs.column("doc_id").cast(pa.int64()), block.sizes, np.add.reduceat((token > 0).astype(np.int64), cuts),
            np.add.reduceat(base, cuts), np.add.reduceat(np.log10(p), cuts),
        ]
        return pa.table([c if isinstance(c, pa.ChunkedArray) else pa.array(c, t) for c, t in zip(columns, types)], names=names)

    return finish


def scores(docs: DataFrame) -> DataFrame:
    """Per document: tokens, known tokens, training tokens, unigram score and interpolated score.

    Null texts are empty (their end token is scored); repeated rows are learned and scored once each; a null
    id belongs to fold 0. An empty table gives no rows; without training documents all estimates but the
    uniform one are zero.
    """
    size = text_bytes(docs)
    shares = shares_of(docs, size)
    fold = F.coalesce(crc_mod(F.col("doc_id"), FOLDS), F.lit(0))
    kind = F.when(fold == HELD_OUT, SCORED).when(fold == TUNE, TUNED).otherwise(LEARN)
    blocks = in_blocks(docs, size, "doc_id", F.col("text").cast("binary").alias("text"), kind=kind)
    replies = answered(blocks, shares, _asker(shares), "block long, share int, one binary, two binary, counts binary", _answer, "counts")
    learned = np.zeros(3, np.int64)
    for row in replies.filter("block = -1").select("reply").toLocalIterator():
        learned += np.frombuffer(row[0], dtype="<i8")
    kinds, total, tuning = (int(x) for x in learned)
    begun = docs.agg(F.count_if(fold != HELD_OUT), F.count_if(fold == TUNE)).first()
    starts, replies = (int(begun[0]), int(begun[1])), replies.filter("block >= 0")
    tuned = F.col("block") % 4 == TUNED
    rest = max(1, total - tuning)
    histogram = with_replies(blocks.filter(tuned), size, replies.filter(tuned), _tuner(shares, rest, kinds, starts), "level long, p1 long, p2 long, n long")
    # Bounded by the grid: levels times the possible rounded log frequencies, whatever the corpus.
    cells = [tuple(r) for r in histogram.groupBy("level", "p1", "p2").agg(F.sum("n")).collect()]
    weights = mixture(cells, kinds)
    out = with_replies(blocks, size, replies, _scorer(shares, total, kinds, starts, weights), "doc_id long, n_tokens long, n_known long, base_score double, score double")
    return out.withColumn("train_tokens", F.lit(total).cast("long"))


def op6_language_scores(spark, folder: str) -> DataFrame:
    rows = scores(table(spark, folder, "documents"))
    held = F.coalesce(crc_mod(F.col("doc_id"), FOLDS) == HELD_OUT, F.lit(False))
    return rows.select("doc_id", held.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
