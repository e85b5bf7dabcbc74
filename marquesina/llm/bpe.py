"""Byte-level BPE: a queue of merge ranks over a linked list of symbols, and decoding by joining vocabulary strings.

A text is cut at special tokens, then into pieces (contractions, letters, numbers, other marks, white space),
and every piece is a doubly linked list of byte symbols. All neighbours that some merge joins wait in a priority
queue ordered by the rank of the merge, then by place. Joining two symbols makes older entries about them stale;
those are recognised when they come up and skipped. A piece of n bytes so takes n log n steps, however long it is.

Ids equal those of ``tokenizers`` for the same file. What counts as a letter, a number or white space depends on the
Unicode version that library was built with, so the classes are read off its pre-tokenizer once, on the driver.
"""

from __future__ import annotations

import functools
import heapq
import json
import re
import struct
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from marquesina.llm.common import MEMO, small_batches, table

TOKENIZER = "byte_bpe_50k.json"
# Pieces of more characters are not remembered; results do not depend on it.
REMEMBERED = 64
# Ids and texts of one Arrow batch; a single document may have more.
BATCH_BYTES = 16_000_000
# The endings that are cut off as pieces of their own; fixed by the tokenizer's kind.
CONTRACTIONS = "'s|'t|'re|'ve|'m|'ll|'d"


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def byte_letters() -> list[str]:
    """The printable character that stands for each byte: itself where it prints, else the next ones from U+0100."""
    own = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(0x100, 0x200))
    return [chr(b if b in own else next(spare)) for b in range(256)]


def _ranges(points: list[int]) -> str:
    """Members of a character class for ``re``."""
    out, p = [], np.array(points)
    for run in np.split(p, np.flatnonzero(np.diff(p) > 1) + 1) if len(p) else ():
        out.append(f"\\U{run[0]:08x}-\\U{run[-1]:08x}")
    return "".join(out)


@functools.cache
def piece_pattern(path: str) -> str:
    """Pattern of the pieces, with the classes of the pre-tokenizer at ``path``.

    A character is a letter if it stays with a letter before it, a number if it stays with a digit, another mark if
    it stays with an exclamation mark, and white space otherwise.
    """
    from tokenizers import Tokenizer

    cut = Tokenizer.from_file(path).pre_tokenizer.pre_tokenize_str
    kinds: dict[str, list[int]] = {"a": [], "1": [], "!": [], "": []}
    for start in range(0, 0x110000, 0x100):
        points = [p for p in range(start, start + 0x100) if not 0xD800 <= p < 0xE000]
        # Most blocks are of one kind and stay together, so that one of their characters tells the kind of all.
        alike = len(cut("".join(map(chr, points)))) == 1
        asked = points[:1] if alike else points
        # A line break after each probe starts a new piece, so probes do not touch.
        starts = {a for _, (a, _) in cut("".join(f"a{chr(p)}\n1{chr(p)}\n!{chr(p)}\n" for p in asked))}
        for k, p in enumerate(asked):
            stays = [mark for i, mark in enumerate("a1!") if 9 * k + 3 * i + 1 not in starts]
            kinds[stays[0] if stays else ""].extend(points if alike else [p])
    letters, numbers, space = (_ranges(kinds[k]) for k in ("a", "1", ""))
    return f"{CONTRACTIONS}| ?[{letters}]+| ?[{numbers}]+| ?[^{space}{letters}{numbers}]+|[{space}]+(?![^{space}])|[{space}]+"


def narrowed(pattern: str, top: int) -> str:
    """The pattern for texts whose characters do not pass ``top``: its classes without the ranges beyond, which are slow to test."""
    def cut(run: re.Match) -> str:
        first, last = int(run[1], 16), min(int(run[2], 16), top)
        return f"\\U{first:08x}-\\U{last:08x}" if first <= top else ""
    return re.sub(r"\\U([0-9a-f]{8})-\\U([0-9a-f]{8})", cut, pattern)


class Codec:
    """Encodes and decodes with the vocabulary, merges and special tokens of a file of ``tokenizers``."""

    def __init__(self, path: str, pattern: str):
        with open(path, encoding="utf-8") as file:
            content = json.load(file)
        vocabulary, merges = content["model"]["vocab"], content["model"]["merges"]
        letters = byte_letters()
        byte_of = {c: b for b, c in enumerate(letters)}
        self.first = [vocabulary[c] for c in letters]
        self.join = {}
        for rank, pair in enumerate(merges):
            left, right = pair.split(" ") if isinstance(pair, str) else pair
            self.join[vocabulary[left], vocabulary[right]] = (rank, vocabulary[left + right])
        self.strings = {i: bytes(byte_of[c] for c in token) for token, i in vocabulary.items()}
        self.special = {t["content"]: t["id"] for t in content.get("added_tokens", [])}
        self.strings.update({i: content.encode() for content, i in self.special.items()})
        self.cut_special = re.compile("|".join(map(re.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        self.wide = re.compile("[\U00010000-\U0010ffff]").search
        self.cuts = [re.compile(narrowed(pattern, top)).findall for top in (0x7F, 0xFFFF, 0x10FFFF)]
        self.memo: dict[str, bytes] = {}

    def merged(self, piece: bytes) -> list[int]:
        """Ids of one piece."""
        ids = [self.first[b] for b in piece]
        n, join = len(ids), self.join
        before, after = list(range(-1, n - 1)), [*range(1, n), -1]
        queue = [(found[0], at, found[1]) for at, pair in enumerate(zip(ids, ids[1:])) if (found := join.get(pair))]
        heapq.heapify(queue)
        while queue:
            _, at, new = heapq.heappop(queue)
            right = after[at]
            # Stale: the symbol was taken into its left neighbour, or it or its right neighbour has changed since.
            if ids[at] < 0 or right < 0 or join.get((ids[at], ids[right]), (0, -1))[1] != new:
                continue
            ids[at], ids[right] = new, -1
            after[at] = beyond = after[right]
            if beyond >= 0:
                before[beyond] = at
                if found := join.get((new, ids[beyond])):
                    heapq.heappush(queue, (found[0], at, found[1]))
            left = before[at]
            if left >= 0 and (found := join.get((ids[left], new))):
                heapq.heappush(queue, (found[0], left, found[1]))
        return [i for i in ids if i >= 0]

    def pieces(self, text: str) -> list[str]:
        """Pieces of a text, by the narrowest classes that know all its characters."""
        return self.cuts[0 if text.isascii() else 2 if self.wide(text) else 1](text)

    def _piece(self, piece: str) -> bytes:
        ids = self.merged(piece.encode())
        out = struct.pack(f"<{len(ids)}I", *ids)
        if len(piece) <= REMEMBERED:
            if len(self.memo) > MEMO:
                self.memo.clear()
            self.memo[piece] = out
        return out

    def _plain(self, text: str) -> bytes:
        known, make = self.memo.get, self._piece
        return b"".join([known(p) or make(p) for p in self.pieces(text)])

    def encode(self, text: str) -> bytes:
        """Little-endian unsigned 32-bit ids of a whole text; special tokens written in it count as such."""
        out, at = [], 0
        for hit in self.cut_special.finditer(text) if self.cut_special else ():
            out += [self._plain(text[at : hit.start()]), np.array([self.special[hit[0]]], dtype="<u4").tobytes()]
            at = hit.end()
        return b"".join([*out, self._plain(text[at:])])

    def decode(self, ids: bytes) -> str:
        """Text of packed ids; ids outside the vocabulary are skipped, bytes that are no UTF-8 become U+FFFD."""
        numbers = np.frombuffer(ids, dtype="<u4").tolist()
        try:
            joined = b"".join(map(self.strings.__getitem__, numbers))
        except KeyError:
            joined = b"".join(self.strings.get(i, b"") for i in numbers)
        return joined.decode("utf-8", "replace")


def _rows(rows: DataFrame, source: str, added: list[tuple[str, str, pa.DataType]], work: Callable[[Codec, object], tuple], path: str | None) -> DataFrame:
    """Replace column ``source`` by the columns ``added``, which ``work`` makes of each value, in batches of bounded bytes."""
    path = path or tokenizer_path()
    pattern = piece_pattern(path)
    small_batches(rows.sparkSession)
    kept = [c for c in rows.columns if c != source]
    schema = rows.select(*kept).schema
    for name, kind, _ in added:
        schema = schema.add(name, kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(path, pattern)
        for batch in batches:
            carried = batch.select(kept)
            made, size, start = [], 0, 0
            for at, value in enumerate(batch.column(source)):
                made.append(work(codec, value.as_py()))
                size += sum(len(v) for v in made[-1] if isinstance(v, (bytes, str)))
                if size > BATCH_BYTES or at == batch.num_rows - 1:
                    columns = [pa.array(c, kind) for c, (_, _, kind) in zip(zip(*made), added)]
                    part = carried.slice(start, len(made))
                    yield pa.RecordBatch.from_arrays([*part.columns, *columns], names=schema.names)
                    made, size, start = [], 0, at + 1

    return rows.mapInArrow(run, schema)


def encoded(docs: DataFrame, path: str | None = None) -> DataFrame:
    """``(doc_id, n_tokens, ids)`` of every whole text, ids packed as little-endian unsigned 32-bit integers.

    A null text is the empty text and has no ids. Ids of documents may be null or repeat: each row is encoded for
    itself. Very long texts are pieces like any other; a piece without a break takes n log n steps. An empty table
    gives no rows, and further columns are not read.
    """
    def work(codec: Codec, text: str | None):
        ids = codec.encode(text or "")
        return len(ids) // 4, ids

    return _rows(docs.select("doc_id", "text"), "text", [("n_tokens", "long", pa.int64()), ("ids", "binary", pa.binary())], work, path)


def decoded(rows: DataFrame, path: str | None = None) -> DataFrame:
    """Rows with packed ``ids`` and the ``text`` they spell; null ids are none. Other columns stay."""
    def work(codec: Codec, ids: bytes | None):
        return ids, codec.decode(ids or b"")

    return _rows(rows, "ids", [("ids", "binary", pa.binary()), ("text", "string", pa.string())], work, path)


def op13_bpe_round_trip(spark, folder: str) -> DataFrame:
    """Digests of the ids of every document and of the text decoded from them."""
    both = decoded(encoded(table(spark, folder, "documents")))
    return both.select(
        "doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("text").cast("binary"), 256).alias("decoded_sha256")
    )
