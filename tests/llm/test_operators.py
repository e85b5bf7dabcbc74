"""Operators of the llm package next to brute force, round trips and held-out accuracy."""

import collections
import random
import re
import zlib
from itertools import combinations

import numpy as np
import pytest
import xxhash

from marquesina.llm import decontaminate, html, language, lines, packing, private, quality, simhash, substrings, toxicity

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def words(rng, n, size=400):
    return " ".join(f"word{rng.randrange(size):x}" if rng.random() < 0.8 else rng.choice(("of", "the", "a")) for _ in range(n))


def frame(spark, rows):
    return spark.createDataFrame([(d, t, "en", "s", len(t or "")) for d, t in rows], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def corpus():
    """Documents with copies, near copies, shared lines and passages, nulls, blanks and a repeated row."""
    rng = random.Random(3)
    rows = [(i, "\n".join(words(rng, rng.randrange(5, 40)) for _ in range(rng.randrange(1, 6)))) for i in range(120)]
    for i in range(120, 150):
        rows.append((i, rows[rng.randrange(100)][1]))
    for i in range(150, 190):
        w = rows[rng.randrange(100)][1].split(" ")
        w[rng.randrange(len(w))] = "changed"
        rows.append((i, " ".join(w)))
    line = words(rng, 12)
    for i in range(190, 200):
        rows.append((i, f"{words(rng, 20)}\n{line if i % 2 else line.replace('w', 'W', 1) + '!'}\n{words(rng, 20)}"))
    return [*rows, (200, None), (201, ""), (202, " \n\t "), (203, "one two"), (203, "one two"), (None, rows[5][1]), (None, None)]


def unsigned(x):
    return x & ((1 << 64) - 1)


def grouped(n, pairs):
    parent = list(range(n))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def brute_fingerprint(text):
    w = (text or "").encode().lower().split()
    grams = [b" ".join(w[i : i + 4]) for i in range(max(1, len(w) - 3))] if w else []
    h = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h)) if h else 0


def brute_groups(rows):
    fps = [brute_fingerprint(t) for _, t in rows]
    roots = grouped(len(rows), [(a, b) for a, b in combinations(range(len(rows)), 2) if (fps[a] ^ fps[b]).bit_count() <= 4])
    least = {}
    for root, (d, _) in zip(roots, rows):
        if d is not None:
            least[root] = min(d, least.get(root, d))
    return [(d, fp, least.get(root)) for (d, _), fp, root in zip(rows, fps, roots)]


def ordered(rows):
    return sorted(rows, key=repr)


def test_covering_masks_meet_every_pair_within_the_radius():
    masks = [unsigned(m) for m in simhash.covering_masks()]
    assert len(masks) == 31
    rng = random.Random(1)
    for _ in range(3000):
        diff = sum(1 << i for i in rng.sample(range(64), rng.randrange(1, 5)))
        assert any(m & diff == 0 for m in masks)


def test_near_duplicates(spark, corpus):
    got = [(r[0], unsigned(r[1]), r[2]) for r in simhash.near_duplicates(frame(spark, corpus)).collect()]
    assert ordered(got) == ordered(brute_groups(corpus))


@pytest.mark.parametrize("limit", [3, 4096])
def test_crowded_buckets_give_the_same_groups(spark, monkeypatch, limit):
    rng = random.Random(8)
    base = rng.getrandbits(64)
    fps = list({base ^ sum(1 << i for i in rng.sample(range(64), rng.randrange(0, 4))) for _ in range(60)} | {rng.getrandbits(64) for _ in range(40)})
    monkeypatch.setattr(simhash, "IN_TASK", limit)
    df = spark.createDataFrame([(x - (1 << 64) if x >> 63 else x,) for x in fps], "fp long")
    at = {x: i for i, x in enumerate(fps)}
    links = [(at[unsigned(r[0])], at[unsigned(r[1])]) for r in simhash.near_links(df).collect()]
    assert all((fps[a] ^ fps[b]).bit_count() <= 4 for a, b in links)
    want = [(a, b) for a, b in combinations(range(len(fps)), 2) if (fps[a] ^ fps[b]).bit_count() <= 4]
    assert grouped(len(fps), links) == grouped(len(fps), want)


def brute_quality(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    grams = collections.Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    covered = {i + k for i in range(len(w) - 4) if grams[tuple(w[i : i + 5])] > 1 for k in range(5)}
    ls = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), len(ls) - len(set(ls)), len(covered)


def test_quality_ledger(spark, corpus):
    rows = [*corpus, (300, "a b c d e f a b c d e x"), (301, "é" * 3 + " # | é"), (302, ("x y z q v\n" * 9)), (303, "!!! " * 30)]
    got = quality.ledger(frame(spark, rows)).collect()
    assert ordered(tuple(r[:6]) for r in got) == ordered((d, *brute_quality(t)) for d, t in rows)
    kept = sum(r["failures"] == 0 for r in got)
    table = {r["rule"]: r for r in quality.ablations(spark.createDataFrame(got)).collect()}
    for name, bit in quality.BIT.items():
        assert table[name]["kept_without"] == sum(r["failures"] & ~bit == 0 for r in got)
        assert table[name]["failed"] == sum(r["failures"] & bit != 0 for r in got)
    assert quality.accepted(frame(spark, rows)).count() == kept


def plain_words(text):
    """Words of letters and digits, ASCII letters in lower case, other characters as they are."""
    return "".join(c.lower() if c.isascii() and c.isalnum() else c if not c.isascii() else " " for c in text or "").split(" ")


def word_runs(text, n):
    w = [x for x in plain_words(text) if x]
    return {tuple(w[k : k + n]) for k in range(len(w) - n + 1)}


def brute_leaks(rows, items):
    out = []
    for d, t in rows:
        for i, x in items:
            n = min(5, sum(map(bool, plain_words(x))))
            want, have = word_runs(x, n) if n else set(), word_runs(t, n)
            if want and len(want & have) >= 0.8 * len(want) - 1e-9:
                out.append((d, i, len(want & have), len(want)))
    return out


def leaking(corpus):
    rng = random.Random(4)
    items = [(i, words(rng, rng.randrange(3, 60), 5000)) for i in range(40)] + [(90, None), (91, ""), (92, "one two"), (93, "What is: two plus?"), (94, "oneword"), (7, words(rng, 30, 5000))]
    rows = [*corpus, (300, f"{words(rng, 200)} so what is two plus, then {words(rng, 9000)}"), (301, "what is two minus plus"), (302, "oneword"), (303, "One, two")]
    for i, t in items[:20]:
        w = t.split(" ")
        if i % 3 == 0:
            w[0] = "other"
        rows.append((400 + i, f"{words(rng, 30)} {' '.join(w).upper()}, {words(rng, 300)}"))
    return rows, items


def test_benchmark_leaks(spark, corpus, monkeypatch):
    rows, items = leaking(corpus)
    bench = spark.createDataFrame(items, "item_id long, text string")
    for size in (8_000_000, 500):
        monkeypatch.setattr(decontaminate.item_blocks, "__defaults__", (size,))
        got = [tuple(r) for r in decontaminate.contaminated(frame(spark, rows), bench).collect()]
        assert ordered(got) == ordered(brute_leaks(rows, items)) and len(got) > 15
    left = decontaminate.clean(frame(spark, rows), bench)
    assert left.count() == len(rows) - sum(bool(brute_leaks([r], items)) for r in rows)


def brute_lines(rows):
    """{(doc, line): first occurrence} by comparing all lines of five words and more with each other."""
    occurrences = collections.defaultdict(list)
    for d, t in rows:
        for k, x in enumerate((t or "").split("\n")):
            w = tuple(y for y in x.lower().translate({9: 32, 13: 32}).split(" ") if y)
            if w:
                occurrences[w].append(((lines.LAST if d is None else d), k))
    keys = list(occurrences)
    bags = [collections.Counter(w) for w in keys]

    def near(a, b):
        x, y = keys[a], keys[b]
        most = int(max(len(x), len(y)) * 0.2 + 1e-9)
        if abs(len(x) - len(y)) > most or max(len(x), len(y)) - (bags[a] & bags[b]).total() > most:
            return False  # words without a partner have to be edited
        row = list(range(len(y) + 1))
        for i, c in enumerate(x, 1):
            last, row = row, [i]
            for j, e in enumerate(y, 1):
                row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (c != e)))
        return row[-1] <= most

    pairs = [(a, b) for a, b in combinations([i for i, w in enumerate(keys) if len(w) >= 5], 2) if near(a, b)]
    groups = collections.defaultdict(list)
    for w, root in zip(keys, grouped(len(keys), pairs)):
        groups[root] += occurrences[w]
    return {place: min(g) for g in groups.values() for place in g if place != min(g)}, len(pairs)


def test_line_dedup(spark, corpus):
    rng = random.Random(5)
    base = words(rng, 60).split()
    rows = list(corpus)
    for i in range(500, 540):  # one line in many variants: a crowded bucket
        w = list(base)
        w[rng.randrange(60)] = f"v{i}"
        rows.append((i, " ".join(w)))
    want, links = brute_lines(rows)
    got = {(lines.LAST if r[0] is None else r[0], r[1]): (lines.LAST if r[2] is None else r[2], r[3]) for r in lines.removed_lines(frame(spark, rows)).collect()}
    assert got == want and links > 20
    cleaned = {r["doc_id"]: r for r in lines.without_repeated_lines(frame(spark, rows)).filter("doc_id IS NOT NULL").collect()}
    for d, t in rows:
        if d is not None:
            left = None if t is None else "\n".join(x for k, x in enumerate(t.split("\n")) if (d, k) not in want)
            assert cleaned[d]["text"] == left and cleaned[d]["n_chars"] == len(left or "")


def test_near_misses_of_a_large_group_are_not_written_as_pairs(spark, monkeypatch):
    rng = random.Random(6)
    base = words(rng, 60).split()
    rows = []
    for i in range(300):  # variants of one line, and as many lines that are a little too far from all of them
        w = list(base)
        for k in rng.sample(range(60), 1 if i < 150 else 14):
            w[k] = f"v{i}x{k}"
        rows.append((i, " ".join(w)))
    written, keep = [], lines.stage
    monkeypatch.setattr(lines, "stage", lambda df, label: written.append((keep(df, label), label)) or written[-1][0])
    monkeypatch.setattr(lines, "drop_materialized", lambda *frames: None)
    got = {(r[0], r[1]): (r[2], r[3]) for r in lines.removed_lines(frame(spark, rows)).collect()}
    assert got == brute_lines(rows)[0] and len(got) == 149
    assert max(df.count() for df, _ in written) <= 2 * lines.ANCHORS * len(rows)


def test_short_lines_repeat_exactly(spark):
    rows = [(1, "Yes.\n}\n一行中文没有空格"), (2, "no\n yes. \n\n"), (3, "}\t\n一行中文没有空格\nnew")]
    got = ordered(tuple(r) for r in lines.removed_lines(frame(spark, rows)).collect())
    assert got == [(2, 1, 1, 0), (3, 0, 1, 1), (3, 1, 1, 2)]


def test_lines_of_other_texts_with_the_same_id_stay(spark):
    shared = "one two three four five six seven"
    rows = [(2, f"only here one\n{shared}"), (2, f"{shared}\nonly here two"), (5, "alpha"), (5, "beta"), (5, "beta")]
    left = lines.without_repeated_lines(frame(spark, rows))
    assert ordered((r["doc_id"], r["text"]) for r in left.collect()) == [(2, f"{shared}\nonly here two"), (2, "only here one"), (5, "alpha"), (5, "beta"), (5, "beta")]


def test_near_duplicates_keep_other_texts_with_the_same_id(spark):
    rng = random.Random(12)
    a, b, c = (words(rng, 60) for _ in range(3))
    rows = [(5, a), (5, b), (6, a), (7, b), (8, c), (8, c), (None, a)]
    left = simhash.first_of_group(frame(spark, rows))
    assert ordered((r["doc_id"], r["text"]) for r in left.collect()) == ordered([(5, a), (5, b), (8, c), (None, a)])


def line_recall(spark, cases, n=200):
    """Of pairs of lines ``(size, edits)`` with that many words replaced, dropped or added, the share that ends in one group."""
    rng = random.Random(2)
    rows, word = [], lambda: f"w{rng.randrange(10**7):07d}"
    for i in range(len(cases) * n):
        size, edits = cases[i // n]
        w = [word() for _ in range(size)]
        v = [[x] for x in w]
        for k in rng.sample(range(size), edits):
            v[k] = rng.choice(([word()], [word()], [word()], [], [w[k], word()]))
        v = [x for part in v for x in part]
        alike = edits <= int(max(size, len(v)) * 0.2 + 1e-9) and len(v) >= 5
        rows += [(2 * i, " ".join(w)), (2 * i + 1, " ".join(v if alike else w))]
    found = lines.removed_lines(frame(spark, rows)).collect()
    assert all(r["doc_id"] == r["first_doc_id"] + 1 and r["first_doc_id"] % 2 == 0 for r in found)
    hits = collections.Counter(r["first_doc_id"] // 2 // n for r in found)
    return {case: hits[k] / n for k, case in enumerate(cases)}


def test_recall_of_fuzzy_lines_next_to_all_pairs(spark):
    """The figures of README: every likeness of short lines is found, nearly every one of long lines."""
    sizes = (5, 7, 10, 12, 15, 20, 30, 50, 100, 200)
    recall = line_recall(spark, [(n, d) for n in sizes for d in sorted({0, 1, n // 10, n // 5})])
    print("recall by words and edits:", recall)
    for (size, edits), share in recall.items():
        assert share == 1.0 if size <= 10 or not edits else share >= 0.9


def check_packing(rows, got):
    from tokenizers import Tokenizer

    encoder = Tokenizer.from_file(packing.tokenizer_path())
    by, sequences = collections.defaultdict(list), collections.defaultdict(list)
    for r in got:
        by[r["doc_id"], r["piece"]].append(r)
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for d, t in rows:
        ids = np.array(encoder.encode(t or "", add_special_tokens=False).ids + [2], dtype="<u4")
        at, piece = 0, 0
        while at < len(ids):
            n = len(ids) % 1024 or 1024 if piece == 0 else 1024
            want = (at, n, zlib.crc32(ids[at : at + n].tobytes()))
            assert any((r["start"], r["length"], r["ids_crc32"]) == want for r in by[d, piece])
            at, piece = at + n, piece + 1
    for spans in sequences.values():
        at = 0
        for offset, n in sorted(spans):
            assert offset == at
            at += n
        assert at <= 1024
    return len(sequences), -(-sum(r["length"] for r in got) // 1024)


def test_packing(spark, corpus):
    rng = random.Random(6)
    rows = [*corpus, (600, words(rng, 3000)), (601, " lead  and\n\n space "), (602, "a b\t c 's don't <|endoftext|> x"), (603, "é" * 500)]
    used, bound = check_packing(rows, packing.packed(frame(spark, rows)).collect())
    assert used <= bound + 1


def test_plan_uses_every_piece_once_and_fills_exactly():
    rng = random.Random(7)
    for size in (10, 400, 5000):
        histogram = collections.Counter(min(1024, 1 + int(rng.expovariate(1 / 300))) for _ in range(size))
        plan = packing.plan(histogram)
        used = collections.Counter()
        for n, lengths in plan:
            assert sum(lengths) <= 1024
            for x in lengths:
                used[x] += n
        assert used == histogram
        total = sum(k * v for k, v in histogram.items())
        assert sum(n for n, _ in plan) <= -(-total // 1024) * 1.01 + 1


def test_toxicity_knows_unseen_misspellings():
    rng = random.Random(9)
    bad = ["scoundrelly", "blatherskite", "numbskulled"]

    def text(toxic, vocabulary):
        w = [f"{rng.choice('bcdfglmnprst')}{rng.choice('aeiou')}{rng.choice('lnrst')}{rng.choice('aeiou')}" for _ in range(60)]
        if toxic:
            w[rng.randrange(60)] = rng.choice(vocabulary)
        return " ".join(w).encode()

    labels = [i % 2 for i in range(400)]
    model = toxicity.train([text(y, bad) for y in labels], labels, steps=20)
    misspelt = ["scoundrellly", "blatherskyte", "numbskuled"]
    score = lambda t: model.pooled(np.array([model.word(w) for w in t.split()]))
    assert np.mean([score(text(1, misspelt)) >= 0.5 for _ in range(100)]) > 0.9
    assert np.mean([score(text(0, bad)) >= 0.5 for _ in range(100)]) < 0.1


def test_toxicity_learns_only_the_kept_fold(spark):
    docs = frame(spark, [(i, f"text number {i}") for i in range(60)] + [(None, "x"), (61, None)])
    labels = spark.createDataFrame([(i, 1, i % 2) for i in range(60)] + [(None, 1, 1), (61, 1, 0), (3, 1, None)], "doc_id long, quality int, toxic int")
    texts, marks = toxicity.sample(docs, labels)
    learned = {int(t.split()[-1]) for t in texts}
    assert learned == {i for i in range(60) if zlib.crc32(str(i).encode()) % 5}
    assert all(int(t.split()[-1]) % 2 == y for t, y in zip(texts, marks))


def test_language_scores(spark, corpus):
    rows = corpus
    got = collections.defaultdict(list)
    for r in language.scores(frame(spark, rows)).collect():
        got[r["doc_id"]].append(r)
    fold = lambda d: 0 if d is None else zlib.crc32(str(d).encode()) % 7
    tokens = [(d, (t or "").encode().lower().split() + [None]) for d, t in rows]
    count = collections.Counter(w for d, x in tokens if fold(d) != 2 for w in x)
    total, kinds = sum(count.values()), len(count)
    for d, x in tokens:
        base = sum(np.log10((count[w] + 1) / (total + kinds + 1)) for w in x)
        assert any(r["n_tokens"] == len(x) and r["n_known"] == sum(w in count for w in x) and abs(r["base_score"] - base) < 1e-6 and r["train_tokens"] == total for r in got[d])
    learned = [r for d, rs in got.items() if fold(d) != 2 for r in rs]
    assert sum(r["score"] for r in learned) > sum(r["base_score"] for r in learned)


def test_mixture_finds_the_weights_that_made_the_counts():
    # Pair frequency 1/2, token frequency 1/32; half of the tokens are explained by the pair, the rest by the token alone.
    cells = [(5, 160, 8, 500), (5, 40, -1, 500)]
    weights = language.mixture(cells, 1000)
    assert weights[5, 0] == pytest.approx(0.5, abs=0.02) and np.allclose(weights.sum(1), 1)
    assert weights[0, 0] == 0


def test_substrings_find_planted_passages(spark):
    rng = random.Random(10)
    passages = [words(rng, 70, 100_000) for _ in range(5)]
    rows = []
    for i in range(200):
        w = words(rng, rng.randrange(40, 200), 100_000).split(" ")
        if i % 4 == 0:
            at = rng.randrange(len(w))
            w[at:at] = [passages[i // 4 % 5].upper().replace(" ", "  ", 9) if i % 12 == 0 else passages[i // 4 % 5]]
        rows.append((i, " ".join(w)))
    rows += [(200, None), (201, ""), (None, passages[0]), (202, "é " * 3 + passages[1])]
    spans = collections.defaultdict(list)
    for r in substrings.repeated_spans(frame(spark, rows)).collect():
        spans[r["doc_id"]].append(r)
    planted = {i for i in range(200) if i % 4 == 0} - {0, 4, 8, 12, 16}
    assert planted | {None, 202} == set(spans)
    text = dict(rows)
    for d in planted:
        cut = sum(len(text[d][r["start"] : r["end"]].split()) for r in spans[d])
        assert 50 <= cut <= 70 and {r["first_doc_id"] for r in spans[d]} <= {0, 4, 8, 12, 16}
    cleaned = {r["doc_id"]: r for r in substrings.deduplicated(frame(spark, rows)).collect()}
    for d, t in rows:
        cuts = [(r["start"], r["end"]) for r in sorted(spans[d], key=lambda r: r["start"])] if d in spans else []
        assert cleaned[d]["text"] == substrings.without_spans(t or "", cuts)


def luhn(digits):
    return sum(d if i % 2 == 0 else d * 2 - 9 * (d > 4) for i, d in enumerate(map(int, reversed(digits)))) % 10 == 0


def test_pseudonyms_keep_format_validity_and_links(spark):
    rng = random.Random(11)
    cards = []
    while len(cards) < 30:
        c = "4" + "".join(rng.choice("0123456789") for _ in range(15))
        if luhn(c):
            cards.append(c)
    mails = [f"{''.join(rng.choice('abcdefgh') for _ in range(5))}.{i}@Example.org" for i in range(30)]
    ips = [f"10.{i}.0.{i + 1}" for i in range(30)]
    dates = [f"19{70 + i}-0{1 + i % 9}-28" for i in range(30)]
    rows = [(i, f"x {c}, {m}; {ip} é {d}. Also {c[:4]}-{c[4:8]}-{c[8:12]}-{c[12:]} +1 (555) 555-01{i:02d} v1.2.3 4111111111111112 2023-02-30") for i, (c, m, ip, d) in enumerate(zip(cards, mails, ips, dates))]
    out = {r[0]: r for r in private.pseudonymised(frame(spark, [*rows, (40, None), (41, ""), (42, "no 12 data 3.4")])).collect()}
    fresh = []
    for i, t in rows:
        got = out[i]["text"]
        m = re.fullmatch(r"x (\d{16}), ([a-z]{5}\.\d+@Example\.org); (\d+\.\d+\.\d+\.\d+) é (\d{4}-\d\d-\d\d)\. Also (\d{4}-\d{4}-\d{4}-\d{4}) \+1 \((\d{3})\) (\d{3})-(\d{4}) v1\.2\.3 4111111111111112 2023-02-30", got)
        assert m and out[i]["n_found"] == 6 and luhn(m[1]) and m[5].replace("-", "") == m[1] and m[1] != cards[i]
        assert all(0 <= int(x) < 256 for x in m[3].split("."))
        fresh.append(m.groups())
    for column in zip(*fresh):
        if len(set(column)) > 1:
            assert len(set(column)) >= 28  # a permutation: different values stay different, up to the parts shared here
    assert len({f[0] for f in fresh}) == len({f[1] for f in fresh}) == len({f[2] for f in fresh}) == len({f[3] for f in fresh}) == 30
    assert out[40]["text"] is None and out[41]["text"] == "" and out[42]["text"] == "no 12 data 3.4" and out[42]["n_found"] == 0


def test_private_data_beside_other_numbers(spark):
    card, iban = "4111 1111 1111 1111", "DE89 3704 0044 0532 0130 00"
    rows = dict(enumerate([
        f"{card} 12/27", "4111111111111111 123", f"12 {card}", f"12 34 5678 {card}", f"{card} {card}", f"{card} 4012 8888 8888 1881 555-123-4567", f"{card} 10.0.0.1",
        f"pay {iban} now", f"{iban} {card}", f"AT61 1904 3002 3457 3201 {card}", "born 12/05/1990.", "on 05/23/1990, 23.5.1990", "7 May 1990 and March 31, 2001", "1990/02/28 4111111111111112",
        " ".join(["12"] * 1000) + f" {card}", "99/99/1990 31 Feb 1990",
    ]))
    out = {r[0]: r for r in private.pseudonymised(frame(spark, list(rows.items()))).collect()}
    assert [out[i]["n_found"] for i in rows if i != 14] == [1, 1, 1, 1, 2, 3, 2, 1, 2, 2, 1, 2, 2, 1, 0]
    moved = re.match(r"[\d ]{19}", out[0]["text"])[0]
    assert luhn(moved.replace(" ", "")) and moved != card and out[0]["text"] == f"{moved} 12/27" and out[1]["text"] == f"{moved.replace(' ', '')} 123"
    assert out[2]["text"] == f"12 {moved}" and out[3]["text"] == f"12 34 5678 {moved}" and out[4]["text"] == f"{moved} {moved}" and out[14]["text"].endswith(f"12 {moved}")
    other = re.fullmatch(r"pay (DE\d\d(?: \d{4}){4} \d\d) now", out[7]["text"])[1]
    assert other != iban and int((other[4:] + "1314" + other[2:4]).replace(" ", "")) % 97 == 1 and out[8]["text"] == f"{other} {moved}" and out[9]["text"].endswith(moved)
    for i, form in ((10, r"born \d\d/\d\d/\d{4}\."), (11, r"on \d\d/(?:1[3-9]|[23]\d)/\d{4}, \d\d?\.\d\d?\.\d{4}"), (12, r"\d\d? [A-Z][a-z]+ \d{4} and [A-Z][a-z]+ \d\d?, \d{4}"), (13, r"\d{4}/\d\d/\d\d 4111111111111112")):
        assert re.fullmatch(form, out[i]["text"]) and out[i]["text"] != rows[i] and out[i]["kinds"] == ["date"]
    assert out[15]["text"] == rows[15]


def test_small_permutation_is_complete(spark):
    df = spark.range(1000).select(private.permuted_digits(private.F.lpad(private.F.col("id").cast("string"), 3, "0"), "k", private.F.lit("t")).alias("x"))
    assert len({r[0] for r in df.collect()}) == 1000


def test_html_labeller(spark):
    rng = random.Random(12)
    texts = [words(rng, rng.randrange(6, 40), 3000).capitalize() + "." for _ in range(60)]
    made, labels = html.composed(texts, 260, seed=1)
    reader = html.Reader()
    model = html.Labeller.fresh().fit([reader.page(p) for p in made], labels, epochs=12)
    test, truth = html.composed(texts, 80, seed=2)
    found = model.label([reader.page(p) for p in test])
    assert np.mean(np.concatenate([(p >= 0.5) == (y > 0.5) for p, y in zip(found, truth)])) > 0.97
    page = (
        "<html><head><title>T</title><script>var x='</p>';</script></head><body><nav><ul><li><a href=/a>Menu</a></li></ul></nav>"
        "<article><h1>Head &amp; line</h1><p><b>One<br><p>Two  <i>t</i>hree</p></article><footer>&copy; me</footer>"
    )
    rows = [(1, "u", page), (1, "u", page), (2, None, None), (None, "v", ""), (3, "w", "plain < text")]
    out = html.main_text(spark.createDataFrame(rows, "page_id long, url string, html string"), model).collect()
    assert [r["text"] for r in out if r["page_id"] == 1] == ["Head & line One Two three"] * 2
    assert all(r["n_chars"] == len(r["text"]) for r in out) and len(out) == 5
    assert [r["text"] for r in out if r["page_id"] in (2, None)] == ["", ""]


def test_leaves_of_pages_with_open_and_self_closing_elements():
    said = lambda page: [b.text for b in html.leaves(page)]
    assert said("<html><head><title>T</title><meta charset=x><body><p>Text") == ["Text"]
    assert said("<head><title>T</title><script>x</script><p>One</p><p>Two") == ["One", "Two"]
    assert [x[0] for b in html.leaves("<head><link rel=a><div><p>One") for x in b.path] == ["div", "p"]
    assert said('<p>One<svg viewBox="0"/> two</p><iframe src="a"/><p>Three</p><canvas/><p>Four') == ["One two", "Three", "Four"]
    assert said("<p>Sum <math><mi>x</mi><mo>+</mo><mn>1</mn></math> here</p>") == ["Sum x+1 here"]
    assert said("<p>One</p><svg><path d='x'><p>Two</p>") == ["One", "Two"] and said("<p>One</p><script>var x") == ["One"]
    assert said("<select><option>A</select><p>One <textarea>t</textarea>end") == ["One end"]
    marks = " ".join(f"u{k}" for k in range(30))
    assert "sidebar" in html.leaves(f'<div class="{marks} sidebar">x</div>')[0].path[0]
    assert len(said("<p>word</p>" * 50_000)) == 50_000


def test_leaves_close_and_drop_what_is_not_text():
    page = "<div class='a b-c'>x<!-- y --><style>z</style><ul><li>1<li>2</ul>w &lt;</div>tail"
    assert [(b.text, b.path[-1:]) for b in html.leaves(page)] == [
        ("x", [("div", "a", "b", "c")]), ("1", [("li",)]), ("2", [("li",)]), ("w <", [("div", "a", "b", "c")]), ("tail", []),
    ]
