"""Conversation repair, source divergence and BPE next to brute force, SQL and the tokenizers library."""

import collections
import hashlib
import os
import random
import re
import zlib

import duckdb
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from check import rows_of
from marquesina.llm import bpe, dialogue, divergence
from tests.llm.test_operators import frame, ordered

# ---- conversations

TALK = "conv_id long, turn long, role string, text string"


def talks(rng, n, longest):
    rows = []
    for conv in range(n):
        for turn in range(rng.randrange(1, longest)):
            role = rng.choice(["user", "assistant"] * 4 + ["system", "tool", None, ""])
            text = rng.choice(["Yes.", "No!", "Well", " ", "", None, "Why?\n", f"It is {rng.randrange(9)}.", f"and {turn}"])
            rows.append((conv, None if rng.random() < 0.05 else turn + rng.randrange(2), role, text))
    return rows


def brute_damage(rows):
    """Rows after damage and all conversation ids."""
    out = []
    for conv, turn, role, text in rows:
        role, text = (" " if x is None else x for x in (role, text))
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if kind == 1:
            text = ""
        if kind == 2:
            text = re.sub("[.!?]", "", text)
        if kind == 4:
            role = "user"
        out += [(conv, turn, role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    return out, {r[0] for r in rows}


def brute_repair(rows):
    """Every cheapest way by one pass that keeps whole audits, over rows ``(turn, role, text)`` in order."""
    ways = {"": (0, "", ())}  # by the last role initial, "" at the start
    follows = {"": "su", "s": "u", "u": "a", "a": "u"}
    full = {"u": "user", "a": "assistant"}

    def better(found, key, way):
        if key not in found or way[:2] < found[key][:2]:
            found[key] = way

    def insert(ways):
        found = dict(ways)
        for _ in range(3):
            for last, (cost, audit, turns) in list(found.items()):
                for role in follows[last].replace("s", ""):
                    better(found, role, (cost + 5, audit + "I", (*turns, (full[role], ""))))
        return found

    seen, faults, illegal, previous = set(), collections.Counter(), 0, None
    for _, role, text in rows:
        bare = text.strip(" \t\n\x0b\x0c\r")
        fault = "blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else ""
        seen.add((role, text))
        faults[fault] += 1
        illegal += previous is not None and previous + role[:1] not in ("su", "ua", "au")
        previous = role[:1]
        found = {}
        for last, (cost, audit, turns) in insert(ways).items():
            better(found, last, (cost + 2, audit + "D", turns))
            if fault not in ("blank", "duplicate"):
                more = 5 * (fault == "truncated")
                if role and role[0] in follows[last]:
                    better(found, role[0], (cost + more, audit + "K", (*turns, (role, text))))
                for new in follows[last].replace("s", ""):
                    better(found, new, (cost + more + 1, audit + "R", (*turns, (full[new], text))))
        ways = found
    cost, audit, turns = min(way for last, way in insert(ways).items() if last in ("", "a"))
    numbers = [r[0] for r in rows if r[0] is not None]
    gaps = max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0
    return gaps, faults["blank"], faults["duplicate"], faults["truncated"], illegal, cost, audit, list(turns)


def brute_audits(rows):
    import xxhash

    damaged, ids = brute_damage(rows)
    out = []
    for conv in ids:
        own = [r[1:] for r in damaged if r[0] == conv]
        signed = lambda h: h - (1 << 64 if h >> 63 else 0)
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], signed(xxhash.xxh64_intdigest(r[2].encode(), 42))))
        *numbers, turns = brute_repair(own)
        out.append((conv, *numbers, hashlib.sha256("\n".join(f"{r}:{t}" for r, t in turns).encode()).hexdigest()))
    return out


def test_divide_and_conquer_equals_one_pass():
    rng = random.Random(5)
    for n in range(400):
        rows = [(k, r or " ", t or " ") for k, (_, _, r, t) in enumerate(talks(rng, 1, 3 + n // 10))]
        numbers, audit, turns = dialogue.solved([(k, r, t, (r, t)) for k, r, t in rows])
        assert (*numbers, audit, turns) == brute_repair(rows)


@pytest.mark.parametrize("held", [50_000, 7])
def test_conversations_next_to_brute_force(spark, monkeypatch, held):
    """With one partition after another, and with every long conversation and every border solved in stretches."""
    monkeypatch.setattr(dialogue, "HELD_ROWS", held)
    monkeypatch.setattr(dialogue, "LEAST_BYTES", 500)
    rng = random.Random(held)
    rows = [*talks(rng, 40, 9), *[(100, t, r, x) for _, t, r, x in talks(rng, 1, 300)], (None, 0, "user", "Hi."), (None, None, "assistant", "Hi."), (7, None, None, None)]
    rows += [r for r in rows if r[0] == 3]
    rows += [(200 + k, k, "user", "Lost.") for k in range(30)]
    docs = spark.createDataFrame(rows, TALK).repartition(3)
    got = dialogue.audited(dialogue.damaged(docs))
    assert ordered(map(tuple, got.collect())) == ordered(brute_audits(rows))
    turns = collections.defaultdict(list)
    for r in sorted(dialogue.repaired(dialogue.damaged(docs)).collect(), key=lambda r: r["place"]):
        turns[r["conv_id"]].append(f"{r['role']}:{r['text']}")
    digests = {r["conv_id"]: r["repaired_sha256"] for r in got.collect()}
    assert {c: hashlib.sha256("\n".join(turns[c]).encode()).hexdigest() for c in digests} == digests


def test_one_long_conversation_in_stretches(spark, monkeypatch):
    monkeypatch.setattr(dialogue, "LEAST_BYTES", 2_000)
    rng = random.Random(2)
    rows = [(1, t, r, x) for _, t, r, x in talks(rng, 1, 4000)] + [(1, 9, "user", "x" * 200_000 + ".")]
    got = dialogue.audited(dialogue.damaged(spark.createDataFrame(rows, TALK))).collect()
    assert ordered(map(tuple, got)) == ordered(brute_audits(rows))


def test_conversations_empty_and_crowded(spark):
    assert dialogue.audited(dialogue.damaged(spark.createDataFrame([], TALK))).collect() == []
    rows = talks(random.Random(1), 5, 6)
    docs = spark.createDataFrame(rows, TALK)
    crowded = docs.select("*", *[F.lit("x").alias(n) for n in "pos block word state code digest open lost_rows _h _at _kind _copy".split()])
    assert ordered(dialogue.audited(dialogue.damaged(crowded)).collect()) == ordered(dialogue.audited(dialogue.damaged(docs)).collect())


# ---- sources

def texts(rng, n):
    terms = ["a", "ab", "abc", "b", "bé", "éa", "ζ", "中文", "word", "words", "wording", "lord", "lording"] + [f"t{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in range(60)]
    rows = []
    for i in range(n):
        text = " ".join(rng.choice(terms[: rng.randrange(2, len(terms))]).upper() if rng.random() < 0.1 else rng.choice(terms) for _ in range(rng.randrange(30)))
        rows.append((i if i % 9 else None, text if i % 13 else None, rng.choice(["en", "de", "xx", None]), rng.choice(["s1", "s2", "s3", "é", "", None]), 1))
    return [*rows, rows[5], rows[5], (0, "", "only", "one", 0), (1, "", "bare", "p", 0), (2, "zz", "bare", "q", 0), (3, "É" * 3000 + "a" * 5000, "en", "s1", 0)]


DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def test_divergence_next_to_sql(spark, monkeypatch, tmp_path):
    """Runs of few terms, several copies of a transducer and hand-overs at every turn give what SQL gives."""
    monkeypatch.setattr(divergence, "ENTRIES", 50)
    monkeypatch.setattr(divergence, "RUN_ENTRIES", 20)
    monkeypatch.setattr(divergence, "CELLS", 10)
    monkeypatch.setattr(divergence, "CHUNK", 100)
    monkeypatch.setattr(divergence, "PAIRS", 7)
    monkeypatch.setattr(divergence, "transducers", lambda terms, make=divergence.transducers: make(terms, 5))
    docs = spark.createDataFrame(texts(random.Random(4), 400), DOCS).repartition(4)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = divergence.op12_source_divergence(spark, str(tmp_path))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    cur = con.execute(divergence.OP12_SQL)
    assert rows_of(got.columns, [tuple(r) for r in got.collect()]) == rows_of([d[0] for d in cur.description], cur.fetchall())


def test_divergence_of_nothing_and_clashing_columns(spark):
    assert divergence.divergence(spark.createDataFrame([], DOCS)).collect() == []
    docs = spark.createDataFrame(texts(random.Random(6), 60), DOCS)
    crowded = docs.select("*", *[F.lit("x").alias(n) for n in "term n run copy kind words counts part item value rank ordinal whole chunk".split()])
    assert ordered(divergence.divergence(crowded).collect()) == ordered(divergence.divergence(docs).collect())


def test_transducer_numbers_terms_and_is_minimal():
    rng = random.Random(8)
    terms = sorted({"".join(rng.choice("abcé") for _ in range(rng.randrange(1, 9))).encode() for _ in range(3000)} | {b"a" * 20_000})
    own = divergence.Builder()
    for t in terms:
        own.add(t)
    made = divergence.Transducer(own.packed())
    assert made.ordinals(terms).tolist() == list(range(len(terms)))
    assert [made.term(k) for k in range(len(terms))] == terms
    known = set(terms)
    others = [t for t in ((x + b"b")[1:] for x in terms) if t not in known]
    assert set(made.ordinals(others + [b"", b"a" * 30_000]).tolist()) == {-1}
    # States of a minimal automaton differ in what may follow.
    assert len(set(own.states)) == len(own.states)


# ---- BPE

def hard_texts():
    rng = random.Random(9)
    out = ["", " ", "a  b", "<|endoftext|>", "x <|endoftext|>y<|endoftext|><|endoftext", "I'll don't 'S\r\n\n  x", "\x1c\x1d \x85 　x", "ab" * 30_000, "é" * 5_000]
    classes = ["abcXYZ", "  \n\t", "0123½٣", ".,'!?<|>", "éßζд中あ", "́‍😀 ", "'s't're"]
    return out + ["".join(rng.choice(rng.choice(classes)) for _ in range(rng.randrange(1, 120))) for _ in range(400)]


def test_bpe_equals_the_library(spark):
    library = Tokenizer.from_file(bpe.tokenizer_path())
    rows = [*enumerate(hard_texts()), (None, "no id"), (3, None), (3, None)]
    docs = frame(spark, rows)
    docs = docs.select("*", *[F.lit("x").alias(n) for n in ("ids", "n_tokens", "decoded")])
    got = bpe.decoded(bpe.encoded(docs)).collect()
    want = []
    for doc, text in rows:
        ids = library.encode(text or "", add_special_tokens=False).ids
        want.append((doc, len(ids), b"".join(i.to_bytes(4, "little") for i in ids), library.decode(ids, skip_special_tokens=False)))
    assert ordered((r["doc_id"], r["n_tokens"], bytes(r["ids"]), r["text"]) for r in got) == ordered(want)
    assert bpe.encoded(frame(spark, [])).collect() == []


def test_every_character_is_cut_as_by_the_library():
    path = bpe.tokenizer_path()
    library, own = Tokenizer.from_file(path).pre_tokenizer, re.compile(bpe.piece_pattern(path))
    for start in range(0, 0x110000, 0x400):
        text = "".join(f"a{c}1{c}!{c} {c}{c}" for c in map(chr, (p for p in range(start, start + 0x400) if not 0xD800 <= p < 0xE000)))
        if start < 0x3400 or start % 0x4000 == 0:
            assert [m.span() for m in own.finditer(text)] == [span for _, span in library.pre_tokenize_str(text)]


def test_bpe_decodes_any_ids():
    path = bpe.tokenizer_path()
    codec, library = bpe.Codec(path, bpe.piece_pattern(path)), Tokenizer.from_file(path)
    rng = random.Random(1)
    for _ in range(300):
        ids = [rng.randrange(50_300) for _ in range(rng.randrange(12))]
        assert codec.decode(b"".join(i.to_bytes(4, "little") for i in ids)) == library.decode(ids, skip_special_tokens=False)


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no test data")
def test_bpe_query(spark):
    library = Tokenizer.from_file(bpe.tokenizer_path())
    folder = "/root/testdata/sf0.001"
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    for r in bpe.op13_bpe_round_trip(spark, folder).collect():
        ids = library.encode(texts[r["doc_id"]], add_special_tokens=False).ids
        packed = b"".join(i.to_bytes(4, "little") for i in ids)
        said = library.decode(ids, skip_special_tokens=False).encode()
        assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == (len(ids), hashlib.sha256(packed).hexdigest(), hashlib.sha256(said).hexdigest())


def test_bpe_pieces_by_narrow_classes():
    """The classes used for a text know no characters beyond its kind, and cut as the whole pattern does."""
    path = bpe.tokenizer_path()
    pattern = bpe.piece_pattern(path)
    codec, whole = bpe.Codec(path, pattern), re.compile(pattern).findall
    assert not re.search(r"\\U(0000(00[89a-f]|0[1-9a-f]|[1-9a-f])|000[1-9]|0010)", bpe.narrowed(pattern, 0x7F))
    assert bpe.narrowed(pattern, 0x10FFFF) == pattern
    r = random.Random(3)
    kinds = ["aZ09 \n\t'!.-", "aé日٣ 　²'s ¿͸￿", "a1 𝒳𝟗😀𐒠 é'll \U0010ffff"]
    for kind in kinds:
        for text in ["", *("".join(r.choice(kind) for _ in range(r.randrange(40))) for _ in range(400))]:
            assert codec.pieces(text) == whole(text)
