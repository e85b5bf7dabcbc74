"""Substring dedup by hashing lines and the parts of lines.

A text is cut into units: lines, and within a line the runs of words between anchors, which a hash of a
word and the one before it selects. A passage is therefore cut alike wherever it stands, on lines of its own or
inside another line. Units are normalised (letters lower-cased, punctuation at word ends dropped, white
space ignored) and their digests grouped over the corpus; the occurrence in the smallest document id,
there the first, is kept. A later stretch of units that all occur earlier, most of them in one document,
is removed once it is ``MIN_WORDS`` long. Spans are reported as offsets into the original text.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from marquesina.llm.common import MEMO, MIX, table
from marquesina.llm.exchange import answered, in_blocks, share_cuts, shares_of, text_bytes, with_replies

# Words a removed stretch must have from one earlier document.
MIN_WORDS = 20
# One word in so many ends a unit; units of fewer than SHORT words prove nothing and follow their neighbours.
ANCHOR = 4
SHORT = 3
NO_ID = np.iinfo(np.int64).max

_IS_SPACE = np.zeros(256, dtype=bool)
_IS_SPACE[[32, *range(9, 14)]] = True
_EDGES = b".,;:!?\"'()[]"


class NormalHash(dict):
    """Hash of a word without case and outer punctuation."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > MEMO:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word.lower().strip(_EDGES), 5)
        return h


class Units:
    """Units of one text: digest, number of words, first and last byte."""

    def __init__(self, text: bytes, hashes: NormalHash):
        raw = np.frombuffer(text, dtype=np.uint8)
        space = np.concatenate([[True], _IS_SPACE[raw], [True]])
        starts = np.flatnonzero(space[:-1] & ~space[1:])
        ends = np.flatnonzero(~space[:-1] & space[1:])
        words = np.fromiter(map(hashes.__getitem__, text.split()), dtype=np.uint64, count=len(starts))
        if not len(words):
            self.digest, self.words, self.start, self.end = words, *(np.zeros(0, np.int64) for _ in range(3))
            return
        breaks = np.cumsum(raw == 10)
        pairs = (np.concatenate([words[:1], words[:-1]]) * MIX + words) * MIX
        last = (pairs >> np.uint64(40)) % np.uint64(ANCHOR) == 0
        last[:-1] |= breaks[starts[1:]] > breaks[ends[:-1] - 1]
        last[-1] = True
        close = np.flatnonzero(last)
        open_ = np.concatenate([[0], close[:-1] + 1])
        self.words, self.start, self.end = close - open_ + 1, starts[open_], ends[close]
        place = np.arange(len(words)) - np.repeat(open_, self.words)
        mixed = words * (np.uint64(2) * place.astype(np.uint64) + np.uint64(3))
        mixed ^= mixed >> np.uint64(32)
        digest = np.add.reduceat(mixed * MIX, open_) * MIX
        self.digest = digest ^ (digest >> np.uint64(29))


class Block:
    """Units of one block's documents, in order of document id, with their distinct digests."""

    def __init__(self, docs: pa.Table, shares: int):
        rows = list(zip(docs.column("doc_id").to_pylist(), docs.column("text").cast(pa.large_binary()).to_pylist()))
        self.rows = sorted(((NO_ID if d is None else d, t or b"") for d, t in rows))
        hashes = NormalHash()
        self.units = [Units(t, hashes) for _, t in self.rows]
        self.sizes = np.array([len(u.words) for u in self.units], dtype=np.int64)
        empty = [np.zeros(0, np.uint64)]
        digest = np.concatenate([u.digest for u in self.units] or empty)
        words = np.concatenate([u.words for u in self.units] or empty).astype(np.int64)
        doc = np.repeat(np.array([d for d, _ in self.rows], dtype=np.int64), self.sizes)
        self.asked = np.flatnonzero(words >= SHORT)
        self.keys, self.first, self.at = np.unique(digest[self.asked], return_index=True, return_inverse=True)
        self.first_doc = doc[self.asked[self.first]]
        self.order, self.cuts = share_cuts(self.keys, shares)


def _asker(shares: int):
    def ask(docs: pa.Table) -> pa.Table:
        number, block = docs.column("block")[0].as_py(), Block(docs, shares)
        rows = []
        for share in range(shares):
            some = block.order[block.cuts[share] : block.cuts[share + 1]]
            if len(some):
                rows.append((number, share, block.keys[some].astype("<u8").tobytes(), block.first_doc[some].astype("<i8").tobytes()))
        columns = list(zip(*rows)) if rows else [()] * 4
        return pa.table([pa.array(c, k) for c, k in zip(columns, [pa.int64(), pa.int32(), pa.binary(), pa.binary()])], names=["block", "share", "keys", "docs"])

    return ask


def _answer(questions: pa.Table) -> pa.Table:
    """Tell each block which of its keys are first seen elsewhere, and in which document."""
    numbers = questions.column("block").to_pylist()
    keys = [np.frombuffer(x, dtype="<u8") for x in questions.column("keys").to_pylist()]
    docs = np.concatenate([np.frombuffer(x, dtype="<i8") for x in questions.column("docs").to_pylist()])
    sizes = np.array([len(k) for k in keys])
    owner = np.repeat(np.array(numbers, dtype=np.int64), sizes)
    values, at = np.unique(np.concatenate(keys), return_inverse=True)
    order = np.lexsort((owner, docs, at))
    lead = order[np.concatenate([[True], at[order][1:] != at[order][:-1]])]
    elsewhere = owner[lead][at] != owner
    found = docs[lead][at]
    cuts = np.concatenate([[0], np.cumsum(sizes)])
    replies = []
    for a, b in zip(cuts, cuts[1:]):
        flags = elsewhere[a:b]
        replies.append(np.packbits(flags).tobytes() + found[a:b][flags].astype("<i8").tobytes())
    share = questions.column("share")[0].as_py()
    return pa.table([pa.array(numbers, pa.int64()), pa.array([share] * len(numbers), pa.int32()), pa.array(replies, pa.binary())], names=["block", "share", "reply"])


def _stretches(units: Units, seen: np.ndarray, first: np.ndarray, min_words: int) -> list[tuple[int, int, int]]:
    """(first unit, last unit, earlier document) of the stretches to remove."""
    short = units.words < SHORT
    if not (units.words[seen].sum() >= min_words):
        return []
    out, at, n = [], 0, len(seen)
    marks = np.flatnonzero(seen)
    while at < len(marks):
        stop = at
        while stop + 1 < len(marks) and short[marks[stop] + 1 : marks[stop + 1]].all():
            stop += 1
        inside = marks[at : stop + 1]
        docs, slot = np.unique(first[inside], return_inverse=True)
        words = np.bincount(slot, units.words[inside])
        if words.max() >= min_words:
            out.append((int(inside[0]), int(inside[-1]), int(docs[np.argmax(words)])))
        at = stop + 1
    return out


def _finisher(shares: int, min_words: int, whole: bool = False):
    def finish(key, docs: pa.Table, replies: pa.Table) -> pa.Table:
        rows: list[tuple] = []
        if docs.num_rows:
            block = Block(docs, shares)
            elsewhere, found = np.zeros(len(block.keys), bool), block.first_doc.copy()
            for share, reply in zip(replies.column("share").to_pylist(), replies.column("reply").to_pylist()):
                some = block.order[block.cuts[share] : block.cuts[share + 1]]
                size = (len(some) + 7) // 8
                flags = np.unpackbits(np.frombuffer(reply, np.uint8, size), count=len(some)).astype(bool)
                elsewhere[some] = flags
                found[some[flags]] = np.frombuffer(reply, "<i8", offset=size)
            later = np.ones(len(block.asked), bool)
            later[block.first] = False
            total = int(block.sizes.sum())
            seen, first = np.zeros(total, bool), np.zeros(total, np.int64)
            seen[block.asked] = elsewhere[block.at] | later
            first[block.asked] = found[block.at]
            cuts = np.concatenate([[0], np.cumsum(block.sizes)])
            for (doc, text), units, a, b in zip(block.rows, block.units, cuts, cuts[1:]):
                doc, spans = None if doc == NO_ID else doc, []
                for x, y, earlier in _stretches(units, seen[a:b], first[a:b], min_words):
                    lead = len(text[: units.start[x]].decode())
                    size = len(text[units.start[x] : units.end[y]].decode())
                    spans.append((lead, lead + size, int(units.words[x : y + 1].sum()), None if earlier == NO_ID else earlier))
                if whole:
                    rows.append((doc, without_spans(text.decode(), [x[:2] for x in spans]), [{"start": x[0], "end": x[1]} for x in spans]))
                else:
                    rows += [(doc, *x) for x in spans]
        if whole:
            kinds = {"doc_id": pa.int64(), "text": pa.string(), "spans": pa.list_(pa.struct({"start": pa.int64(), "end": pa.int64()}))}
        else:
            kinds = {name: pa.int64() for name in ("doc_id", "start", "end", "n_words", "first_doc_id")}
        columns = list(zip(*rows)) if rows else [()] * len(kinds)
        return pa.table([pa.array(c, k) for c, k in zip(columns, kinds.values())], names=list(kinds))

    return finish


def without_spans(text: str, spans: list[tuple[int, int]]) -> str:
    """The text with ordered spans taken out."""
    cuts = [0, *[x for span in spans for x in span], len(text)]
    return "".join(text[a:b] for a, b in zip(cuts[::2], cuts[1::2]))


def _run(docs: DataFrame, min_words: int, whole: bool, schema: str) -> DataFrame:
    total = text_bytes(docs)
    shares = shares_of(docs, total)
    blocks = in_blocks(docs, total, "doc_id", F.col("text").cast("binary").alias("text"))
    replies = answered(blocks, shares, _asker(shares), "block long, share int, keys binary, docs binary", _answer, "first-units")
    return with_replies(blocks, total, replies, _finisher(shares, min_words, whole), schema)


def repeated_spans(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """``(doc_id, start, end, n_words, first_doc_id)`` of every stretch that repeats an earlier one.

    Offsets count code points of the original text, ``end`` exclusive. Null and blank texts have no units.
    Documents without an id come after all others; repeated rows repeat each other. An empty table gives no rows.
    """
    return _run(docs, min_words, False, "doc_id long, start long, end long, n_words long, first_doc_id long")


def deduplicated(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """Every document without its repeated stretches: ``doc_id``, ``text`` (empty for null) and the removed ``spans``."""
    return _run(docs, min_words, True, "doc_id long, text string, spans array<struct<start: long, end: long>>")


def op5_repeated_passages(spark, folder: str) -> DataFrame:
    return repeated_spans(table(spark, folder, "documents"))
