"""Source divergence audit: how the sources of a language differ in their words, over a minimal acyclic transducer.

A language keeps the terms that occur in enough of its documents. The kept terms are sorted and cut into runs; each
run becomes a minimal acyclic transducer that maps a term to its lexicographic ordinal and back. All text is streamed
through the transducers again, which counts the kept terms of every (language, source); from then on a term is its
ordinal, also where ties are broken, and only the terms reported are spelled out again.

Runs have a bounded number of terms. Text reaches a run as sorted words with their counts, collected over many
documents, so a frequent word is a few entries of a task; a run that would still receive much is given to several
tasks, each with a copy of its transducer. What the driver holds is the first term and the size of each run.

Shares are p = 1 + floor(10^9 (count + 1) / (N + V)); the divergence of two shares is floor((p - q)^2 / q). A sum over
all V terms is taken over occurring ones only: for terms in both sources the difference to what the sum over each
source alone says, the latter from the histogram of a source's shares, and V times the value of two absent terms.
"""

from __future__ import annotations

import io
import os.path
import re
import zlib
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from marquesina.llm.common import small_batches, small_or_joined, stage, table

LEAST_DOCS = 3
TOP = 200
SCALE = 1_000_000_000
# Terms of one transducer.
RUN_TERMS = 50_000
# Entries a task collects before it hands them on; results do not depend on it.
ENTRIES = 400_000
# Entries of the first count per run and copy of its transducer, and cells a recounting task keeps.
RUN_ENTRIES, CELLS = 2_000_000, 4_000_000
# Counts of one task of the comparison and pairs it holds at once.
CHUNK, PAIRS = 200_000, 1_000_000

_WORDS = re.compile(rb"[A-Za-z\x80-\xff]+").findall


def words_of(text: bytes) -> list[bytes]:
    """Runs of ASCII letters and characters beyond ASCII, A-Z in lower case."""
    return _WORDS(text.lower())


class Builder:
    """Minimal acyclic transducer of terms added in byte order; its size follows the distinct endings, not the terms."""

    def __init__(self):
        self.known: dict[tuple, int] = {}
        self.states: list[tuple[bool, bytes, tuple[int, ...]]] = []
        self.counts: list[int] = []
        # States on the path of the last term that may still change: [final, labels, targets].
        self.path: list[list] = [[False, bytearray(), []]]
        self.last, self.size, self.first = b"", 0, None

    def _freeze(self, depth: int) -> None:
        while len(self.path) > depth + 1:
            node = self.path.pop()
            self.path[-1][2][-1] = self._state(node)

    def _state(self, node: list) -> int:
        key = (node[0], bytes(node[1]), tuple(node[2]))
        found = self.known.get(key)
        if found is None:
            found = self.known[key] = len(self.states)
            self.states.append(key)
            self.counts.append(node[0] + sum(self.counts[t] for t in node[2]))
        return found

    def add(self, term: bytes) -> None:
        shared = len(os.path.commonprefix([self.last, term]))
        self._freeze(shared)
        for byte in term[shared:]:
            self.path[-1][1].append(byte)
            self.path[-1][2].append(-1)
            self.path.append([False, bytearray(), []])
        self.path[-1][0] = True
        self.first = term if self.first is None else self.first
        self.last, self.size = term, self.size + 1

    def packed(self) -> bytes:
        self._freeze(0)
        root = self._state(self.path[0])
        labels, targets, skips, starts = bytearray(), [], [], [0]
        for final, own, to in self.states:
            before = int(final)
            for t in to:
                skips.append(before)
                before += self.counts[t]
            labels += own
            targets += to
            starts.append(len(targets))
        out = io.BytesIO()
        np.savez(
            out, root=np.array([root]), labels=np.frombuffer(bytes(labels), dtype=np.uint8), targets=np.array(targets, dtype=np.int32),
            skips=np.array(skips, dtype=np.int64), starts=np.array(starts, dtype=np.int64), finals=np.array([s[0] for s in self.states], dtype=bool),
        )
        return out.getvalue()


class Transducer:
    """Ordinals of terms and terms of ordinals."""

    def __init__(self, packed: bytes):
        data = np.load(io.BytesIO(packed))
        self.root = int(data["root"][0])
        self.labels, self.targets, self.skips, self.starts, self.finals = (data[k] for k in ("labels", "targets", "skips", "starts", "finals"))
        state = np.repeat(np.arange(len(self.finals), dtype=np.int64), np.diff(self.starts))
        # Rising, as states follow each other and the labels of a state are sorted; the last entry matches nothing.
        self.steps = np.append(state * 256 + self.labels, np.iinfo(np.int64).max)

    def ordinals(self, words: list[bytes]) -> np.ndarray:
        """Ordinal of each word, -1 for words that are no term; all words take a step at a time."""
        out = np.full(len(words), -1, dtype=np.int64)
        sizes = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        data = np.frombuffer(b"".join(words), dtype=np.uint8)
        at = np.cumsum(sizes) - sizes
        live, state, total = np.arange(len(words)), np.full(len(words), self.root, dtype=np.int64), np.zeros(len(words), dtype=np.int64)
        depth = 0
        while len(live):
            done = sizes[live] == depth
            ends = live[done & self.finals[state]]
            out[ends] = total[done & self.finals[state]]
            live, state, total = live[~done], state[~done], total[~done]
            key = state * 256 + data[at[live] + depth]
            step = np.searchsorted(self.steps, key)
            ok = self.steps[step] == key
            live, step = live[ok], step[ok]
            state, total = self.targets[step].astype(np.int64), total[ok] + self.skips[step]
            depth += 1
        return out

    def term(self, ordinal: int) -> bytes:
        out, state = bytearray(), self.root
        while not (self.finals[state] and ordinal == 0):
            a, b = self.starts[state], self.starts[state + 1]
            step = a + int(np.searchsorted(self.skips[a:b], ordinal, "right")) - 1
            out.append(self.labels[step])
            ordinal -= int(self.skips[step])
            state = int(self.targets[step])
        return bytes(out)


def _texts(batch: pa.RecordBatch, names: list[str]) -> Iterator[tuple]:
    return zip(*(batch.column(n).cast(pa.binary()).to_pylist() for n in names))


def _plain(docs: DataFrame) -> DataFrame:
    return docs.select(*[F.coalesce(c, F.lit("")).alias(c) for c in ("lang", "source", "text")])


def _document_counts(docs: DataFrame) -> DataFrame:
    """``(lang, term, docs)``, several rows for a term."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[bytes, Counter] = {}

        def hand_on() -> pa.RecordBatch:
            rows = [(lang, term, n) for lang, terms in held.items() for term, n in terms.items()]
            held.clear()
            lang, term, n = zip(*rows) if rows else ((), (), ())
            text = [pa.array(c, pa.binary()).cast(pa.string()) for c in (lang, term)]
            return pa.RecordBatch.from_arrays([*text, pa.array(n, pa.int64())], ["lang", "term", "docs"])

        for batch in batches:
            for lang, text in _texts(batch, ["lang", "text"]):
                held.setdefault(lang, Counter()).update(set(words_of(text)))
                if sum(map(len, held.values())) > ENTRIES:
                    yield hand_on()
        yield hand_on()

    return docs.select("lang", "text").mapInArrow(run, "lang string, term string, docs long")


def kept_terms(docs: DataFrame, least: int = LEAST_DOCS) -> DataFrame:
    """``(lang, term, entries)`` of the terms in at least ``least`` documents of a language, staged.

    ``entries`` tells how many tasks' collections named the term.
    """
    counted = _document_counts(docs).groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.count("*").alias("entries"))
    return stage(counted.filter(F.col("docs") >= least).select("lang", "term", "entries"), "kept-terms")


def transducers(terms: DataFrame, size: int = RUN_TERMS) -> DataFrame:
    """``(lang, first, terms, entries, packed)``: one transducer for each run of at most ``size`` terms, staged."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def row() -> pa.RecordBatch:
            values = ([lang], [own.first.decode()], [own.size], [entries], [own.packed()])
            kinds = (pa.string(), pa.string(), pa.int64(), pa.int64(), pa.binary())
            return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(values, kinds)], ["lang", "first", "terms", "entries", "packed"])

        lang, own, entries = None, None, 0
        for batch in batches:
            for its, term, n in zip(*(c.to_pylist() for c in batch.columns)):
                if own is not None and (its != lang or own.size == size):
                    yield row()
                    own = None
                if own is None:
                    lang, own, entries = its, Builder(), 0
                own.add(term.encode())
                entries += n
        if own is not None:
            yield row()

    parts = terms.count() // size + 1
    # Strings sort by their UTF-8 bytes, as the builder needs.
    ordered = terms.repartitionByRange(parts, "lang", "term").sortWithinPartitions("lang", "term")
    return stage(ordered.mapInArrow(run, "lang string, first string, terms long, entries long, packed binary"), "transducers")


class Runs:
    """Where each run of terms starts: in its language, and in the numbering of all terms."""

    def __init__(self, rows: list[tuple[str, str, int, int]]):
        rows = sorted((lang.encode(), first.encode(), n, entries) for lang, first, n, entries in rows)
        self.base = np.cumsum([0, *[n for _, _, n, _ in rows]])
        self.copies = [1 + entries // RUN_ENTRIES for _, _, _, entries in rows]
        self.firsts: dict[bytes, list[bytes]] = {}
        self.number: dict[bytes, int] = {}
        for at, (lang, first, _, _) in enumerate(rows):
            self.number.setdefault(lang, at)
            self.firsts.setdefault(lang, []).append(first)

    def cut(self, lang: bytes, words: list[bytes]) -> Iterator[tuple[int, int, int]]:
        """``(run, from, to)`` of sorted words."""
        firsts = self.firsts[lang]
        at = bisect_left(words, firsts[0])
        while at < len(words):
            run = bisect_right(firsts, words[at]) - 1
            to = bisect_left(words, firsts[run + 1]) if run + 1 < len(firsts) else len(words)
            yield self.number[lang] + run, at, to
            at = to


STREAM = "run long, copy int, kind int, lang string, source string, words binary, counts binary"


def _streams(docs: DataFrame, runs: Runs) -> DataFrame:
    """Sorted words with counts of each (lang, source), cut by runs."""
    names = [f.split(" ")[0] for f in STREAM.split(", ")]
    kinds = [pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[bytes, bytes], Counter] = {}

        def hand_on() -> pa.RecordBatch:
            rows = []
            for (lang, source), found in held.items():
                words = sorted(found)
                for number, a, b in runs.cut(lang, words):
                    joined = b"\n".join(words[a:b])
                    counts = np.fromiter(map(found.__getitem__, words[a:b]), dtype="<u4", count=b - a).tobytes()
                    rows.append((number, zlib.crc32(joined) % runs.copies[number], 1, lang, source, joined, counts))
            held.clear()
            columns = [pa.array(c, k) for c, k in zip(zip(*rows) if rows else [()] * 7, kinds)]
            columns[3:5] = [c.cast(pa.string()) for c in columns[3:5]]
            return pa.RecordBatch.from_arrays(columns, names)

        for batch in batches:
            for lang, source, text in _texts(batch, ["lang", "source", "text"]):
                if lang in runs.firsts:
                    held.setdefault((lang, source), Counter()).update(words_of(text))
                    if sum(map(len, held.values())) > ENTRIES:
                        yield hand_on()
        yield hand_on()

    return docs.mapInArrow(run, STREAM)


def recounted(docs: DataFrame, built: DataFrame, runs: Runs) -> tuple[DataFrame, DataFrame]:
    """``(lang, source, ordinal, n)``, the text streamed through the transducers, and the numbered transducers, both staged.

    A count may come in several rows.
    """
    spark = docs.sparkSession
    numbers = spark.createDataFrame(
        [(lang.decode(), first.decode(), runs.number[lang] + k, runs.copies[runs.number[lang] + k]) for lang, firsts in runs.firsts.items() for k, first in enumerate(firsts)],
        "lang string, first string, run long, copies int",
    )
    numbered = stage(built.join(F.broadcast(numbers), ["lang", "first"]), "numbered-transducers")
    copies = numbered.select(
        "run", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)).alias("copy"), F.lit(0).alias("kind"), "lang",
        F.lit("").alias("source"), F.col("packed").alias("words"), F.lit(b"").alias("counts"),
    )
    rows = copies.unionByName(_streams(docs, runs)).repartition("run", "copy").sortWithinPartitions("run", "copy", "kind")
    base = runs.base

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, number, lang, held = None, -1, "", {}

        def hand_on() -> Iterator[pa.RecordBatch]:
            for source, counts in held.items():
                at = np.flatnonzero(counts)
                same = [pa.DictionaryArray.from_arrays(pa.array(np.zeros(len(at), dtype=np.int32)), [v]).cast(pa.string()) for v in (lang, source)]
                yield pa.RecordBatch.from_arrays([*same, pa.array(at + base[number]), pa.array(counts[at])], ["lang", "source", "ordinal", "n"])
            held.clear()

        for batch in batches:
            for its, kind, its_lang, source, words, counts in zip(*(batch.column(c).to_pylist() for c in ("run", "kind", "lang", "source", "words", "counts"))):
                if kind == 0:
                    yield from hand_on()
                    own, number, lang = Transducer(words), its, its_lang
                    continue
                if source not in held:
                    if (len(held) + 1) * (base[number + 1] - base[number]) > CELLS:
                        yield from hand_on()
                    held[source] = np.zeros(base[number + 1] - base[number], dtype=np.int64)
                at = own.ordinals(words.split(b"\n"))
                # The words of one row differ, so no cell is met twice.
                held[source][at[at >= 0]] += np.frombuffer(counts, dtype="<u4")[at >= 0]
        yield from hand_on()

    return stage(rows.mapInArrow(run, "lang string, source string, ordinal long, n long"), "recounts"), numbered


def share(count: np.ndarray, whole: np.ndarray) -> np.ndarray:
    """1 + floor(10^9 (count + 1) / whole), divided three digits at a time so that 64 bits suffice."""
    rest, out = count + 1, np.zeros_like(count)
    out, rest = rest // whole, rest % whole
    for _ in range(3):
        rest = rest * 1000
        out, rest = out * 1000 + rest // whole, rest % whole
    return out + 1


def gap(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) ** 2 // q


def gap_sql(p: str, q: str) -> Column:
    return F.expr(f"(({p} - {q}) * ({p} - {q})) div {q}")


def _summed(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys, kind="stable")
    keys, values = keys[order], values[order]
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, dtype=np.int64)
    return keys[first], np.add.reduceat(values, first) if len(first) else values


def _compared(rows: pa.Table, base: np.ndarray) -> pa.Table:
    """Part sums of a share of the terms: common terms of two sources, histogram of shares, leading terms with their run."""
    names = pa.StructArray.from_arrays([rows.column(c).combine_chunks() for c in ("lang", "source")], ["lang", "source"]).to_pylist()
    code: dict[tuple[str, str], int] = {}
    group = np.array([code.setdefault((r["lang"], r["source"]), len(code)) for r in names], dtype=np.int64)
    known = list(code)
    ordinal, n, whole, all_ = (rows.column(c).to_numpy() for c in ("ordinal", "n", "whole", "lang_whole"))
    order = np.lexsort((group, ordinal))
    group, ordinal, n, whole, all_ = (x[order] for x in (group, ordinal, n, whole, all_))
    new = np.flatnonzero(np.append(True, (ordinal[1:] != ordinal[:-1]) | (group[1:] != group[:-1])))
    n = np.add.reduceat(n, new)
    group, ordinal, whole, all_ = (x[new] for x in (group, ordinal, whole, all_))
    p, absent = share(n, whole), share(np.zeros_like(n), whole)
    start = np.flatnonzero(np.append(True, ordinal[1:] != ordinal[:-1]))
    size = np.diff(np.append(start, len(ordinal)))
    q = share(np.repeat(np.add.reduceat(n, start), size), all_)
    out: list[tuple[str, np.ndarray, list | np.ndarray, np.ndarray]] = []
    lead = np.flatnonzero(p > q)
    value = gap(p[lead], q[lead])
    order = np.lexsort((ordinal[lead], -value, group[lead]))
    lead, value = lead[order], value[order]
    place = np.arange(len(lead)) - np.searchsorted(group[lead], group[lead])
    lead, value = lead[place < TOP], value[place < TOP]
    out.append(("term", group[lead], ordinal[lead], value))
    top = int(p.max()) + 1
    cells, counts = _summed(group * top + p, np.ones_like(p))
    out.append(("share", cells // top, cells % top, counts))
    # Ordered pairs of sources with a term in common, a bounded number at a time.
    partners, first = np.repeat(size, size), np.repeat(start, size)
    ends = np.cumsum(partners)
    keys, sums, at = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), 0
    while at < len(p):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + PAIRS, "right")))
        own = np.repeat(np.arange(at, to), partners[at:to])
        other = np.arange(len(own)) - np.repeat(ends[at:to] - partners[at:to] - (ends[at - 1] if at else 0), partners[at:to]) + first[own]
        own, other = own[own != other], other[own != other]
        both = gap(p[own], p[other]) - gap(p[own], absent[other]) - gap(absent[own], p[other]) + gap(absent[own], absent[other])
        keys, sums = _summed(np.append(keys, group[own] * len(known) + group[other]), np.append(sums, both))
        at = to
    out.append(("pair", keys // len(known), keys % len(known), sums))
    parts = []
    for part, who, what, value in out:
        lang, source = ([known[g][k] for g in who.tolist()] for k in (0, 1))
        others = [known[g][1] for g in what.tolist()] if part == "pair" else [None] * len(who)
        numbers = what if part != "pair" else np.full(len(who), -1)
        runs = np.searchsorted(base, numbers, "right") - 1 if part == "term" else np.full(len(who), -1)
        parts.append(pa.table([pa.array([part] * len(who), pa.string()), pa.array(lang, pa.string()), pa.array(source, pa.string()), pa.array(others, pa.string()), pa.array(numbers, pa.int64()), pa.array(value, pa.int64()), pa.array(runs, pa.int64())], ["part", "lang", "source", "other", "number", "value", "run"]))
    return pa.concat_tables(parts)


def _spelled(top: DataFrame, numbered: DataFrame, runs: Runs) -> DataFrame:
    """Terms of the ordinals in ``number``, told by the transducer of their run."""
    base = runs.base

    def spell(rows: pa.Table, own: pa.Table) -> pa.Table:
        if not rows.num_rows:
            return pa.table({"lang": pa.array([], pa.string()), "source": pa.array([], pa.string()), "item": pa.array([], pa.string()), "value": pa.array([], pa.int64()), "rank": pa.array([], pa.int32())})
        terms = Transducer(own.column("packed")[0].as_py())
        told = {o: terms.term(o - int(base[rows.column("run")[0].as_py()])).decode() for o in set(rows.column("number").to_pylist())}
        item = pa.array([told[o] for o in rows.column("number").to_pylist()], pa.string())
        return pa.table([rows.column("lang"), rows.column("source"), item, rows.column("value"), rows.column("rank")], ["lang", "source", "item", "value", "rank"])

    return top.groupBy("run").cogroup(numbered.select("run", "packed").groupBy("run")).applyInArrow(spell, "lang string, source string, item string, value long, rank int")


def divergence(docs: DataFrame, least: int = LEAST_DOCS, top: int = TOP) -> DataFrame:
    """``(lang, source, part, item, value, rank)``: part ``pair`` against each other source of the language, part ``term``
    the up to ``top`` terms (at most ``TOP``) in which a source exceeds its language most.

    Null texts, languages and sources are empty ones and count as such; every row is a document, also if it repeats.
    Sources without terms have pairs; a language without kept terms gives pairs of value 0. Ties are ranked by the
    bytes of the item. Terms and texts may be of any length. An empty table gives no rows; further columns are not read.
    """
    spark = docs.sparkSession
    small_batches(spark)
    plain = _plain(docs)
    terms = kept_terms(plain, least)
    built = transducers(terms)
    runs = Runs([tuple(r) for r in built.select("lang", "first", "terms", "entries").collect()])
    counts, numbered = recounted(plain, built, runs)
    sizes = counts.groupBy("lang", "source").agg(F.sum("n").alias("n"))
    vocabulary = built.groupBy("lang").agg(F.sum("terms").alias("v"))
    groups = plain.select("lang", "source").distinct().join(sizes, ["lang", "source"], "left").join(vocabulary, "lang", "left")
    groups = groups.select("lang", "source", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("v", F.lit(0)).alias("v"))
    langs = groups.groupBy("lang").agg((F.sum("n") + F.max("v")).alias("lang_whole"))
    whole = F.col("n") + F.col("v")
    groups = groups.join(langs, "lang").select("lang", "source", "v", whole.alias("whole"), "lang_whole", F.when(whole > 0, F.expr(f"1 + {SCALE} div (n + v)")).otherwise(1).alias("absent"))
    groups = stage(groups, "source-sizes")
    few = small_or_joined(groups)
    chunks, base = counts.count() // CHUNK + 1, runs.base
    dealt = counts.join(few.select("lang", "source", "whole", "lang_whole"), ["lang", "source"]).withColumn("chunk", F.pmod(F.xxhash64("ordinal"), F.lit(chunks)))
    parts = dealt.groupBy("chunk").applyInArrow(lambda t: _compared(t, base), "part string, lang string, source string, other string, number long, value long, run long")
    parts = stage(parts, "source-parts")
    # A source's shares against those of absent terms, both ways, then the terms that neither has.
    shares = parts.filter("part = 'share'").groupBy("lang", "source", F.col("number").alias("p")).agg(F.sum("value").alias("times"))
    shares = shares.join(few.select("lang", "source", F.col("absent").alias("own")), ["lang", "source"])
    facing = few.select("lang", F.col("source").alias("other"), F.col("absent").alias("its"), F.col("v").alias("its_v"))
    met = shares.join(facing, "lang").filter("source <> other")
    forth = met.select("lang", "source", "other", (F.col("times") * (gap_sql("p", "its") - gap_sql("own", "its"))).alias("value"))
    back = met.select("lang", F.col("other").alias("source"), F.col("source").alias("other"), (F.col("times") * (gap_sql("its", "p") - gap_sql("its", "own"))).alias("value"))
    bare = groups.join(facing, "lang").filter("source <> other").select("lang", "source", "other", (F.col("v") * gap_sql("absent", "its")).alias("value"))
    pairs = bare.unionByName(forth).unionByName(back).unionByName(parts.filter("part = 'pair'").select("lang", "source", "other", "value"))
    pairs = pairs.groupBy("lang", "source", F.col("other").alias("item")).agg(F.sum("value").alias("value"))
    by_value = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    pairs = pairs.withColumn("rank", F.row_number().over(by_value))
    by_ordinal = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "number")
    lead = parts.filter("part = 'term'").select("lang", "source", "number", "value", "run").withColumn("rank", F.row_number().over(by_ordinal)).filter(F.col("rank") <= top)
    lead = _spelled(lead, numbered, runs)
    columns = lambda df, part: df.select("lang", "source", F.lit(part).alias("part"), "item", "value", "rank")
    return columns(pairs, "pair").unionByName(columns(lead, "term"))


def op12_source_divergence(spark, folder: str) -> DataFrame:
    return divergence(table(spark, folder, "documents"))


OP12_SQL = r"""
WITH docs AS (
  SELECT row_number() OVER () AS id, coalesce(text, '') AS text, coalesce(lang, '') AS lang, coalesce(source, '') AS source FROM documents
), found AS (
  SELECT id, lang, source, translate(unnest(regexp_extract_all(text, '[A-Za-z\x{80}-\x{10FFFF}]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS term
  FROM docs
), kept AS (
  SELECT lang, term FROM found GROUP BY ALL HAVING count(DISTINCT id) >= 3
), counted AS (
  SELECT lang, source, term, count(*) AS n FROM found JOIN kept USING (lang, term) GROUP BY ALL
), groups AS (
  SELECT DISTINCT lang, source FROM docs
), cells AS (
  SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n FROM groups g JOIN kept k USING (lang) LEFT JOIN counted c USING (lang, source, term)
), shares AS (
  SELECT lang, source, term, n, (1 + (1000000000::HUGEINT * (n + 1)) // (sum(n) OVER w + count(*) OVER w))::BIGINT AS p
  FROM cells WINDOW w AS (PARTITION BY lang, source)
), totals AS (
  SELECT lang, term, sum(n) AS n FROM cells GROUP BY ALL
), whole AS (
  SELECT lang, term, (1 + (1000000000::HUGEINT * (n + 1)) // (sum(n) OVER w + count(*) OVER w))::BIGINT AS q
  FROM totals WINDOW w AS (PARTITION BY lang)
), sums AS (
  SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // b.p) AS value
  FROM shares a JOIN shares b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL
), rows AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(s.value, 0)::BIGINT AS value
  FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN sums s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
  UNION ALL
  SELECT s.lang, s.source, 'term', s.term, ((s.p - w.q) * (s.p - w.q)) // w.q
  FROM shares s JOIN whole w ON s.lang = w.lang AND s.term = w.term WHERE s.n > 0 AND s.p > w.q
)
SELECT * FROM (
  SELECT *, (row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item))::INTEGER AS rank FROM rows
) WHERE part = 'pair' OR rank <= 200
"""
