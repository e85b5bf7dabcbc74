"""Conversation structure repair: the cheapest edits that make roles alternate, by Hirschberg's divide and conquer.

The roles of a repaired conversation read (s?(ua)+)?, an automaton of four states. A row is a step from state to
state: some inserted turns, then keep, rerole or delete. Forward costs from the start and backward costs to the end
meet in the middle of a conversation; the state with the least sum is crossed, both halves are solved alike, and no
more than two vectors of four are held a level. The forward vector also ranks the audits of its four states: audits of
the same rows are never prefixes of each other, so the order of two audits never changes by what follows, and of
equally cheap crossings the one of the least rank is the one of the least audit.

A stretch of rows is itself a step, with a cost and a rank for each pair of states. A conversation that does not lie
within one sorted partition is solved that way: stretches in parallel, the same divide and conquer over the stretches
to find where they are crossed, then every stretch by itself. Only what the result demands is sequential, the digest
over the repaired text of a conversation, which is streamed.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from marquesina.llm.common import small_batches, stage, table

REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
SPACE, ENDS = " \t\n\x0b\x0c\r", ".!?"
# Text of a sorted partition at most, and the least for which one is opened.
PART_BYTES, LEAST_BYTES = 64_000_000, 4_000_000
# Text and rows of one conversation a task holds; a longer one is solved in stretches.
HELD_BYTES, HELD_ROWS = 16_000_000, 50_000

# States: nothing yet, after system, after user, after assistant; and what a turn of each role leads to.
START, AFTER = 0, {"s": {0: 1}, "u": {0: 2, 1: 2, 3: 2}, "a": {2: 3}}
NEXT = {0: "user", 1: "user", 2: "assistant", 3: "user"}
FINE, CUT, REPEAT, BLANK = range(4)
NEVER = 1 << 60
Step = list[list[tuple[int, object, int]]]


def _step(initial: str, fault: int) -> Step:
    """For each state the ways out ``(cost, audit, state after)``, the best for each state after."""
    out: Step = []
    for state in range(4):
        best: dict[int, tuple[int, str]] = {}
        at, word = state, ""
        # After two inserted turns a third only repeats the first.
        for inserted in range(3):
            ways = [(DELETE, "D", at)]
            if fault in (FINE, CUT):
                extra = TRUNCATED if fault == CUT else 0
                ways.append((REROLE + extra, "R", AFTER[NEXT[at][0]][at]))
                if at in AFTER.get(initial, {}):
                    ways.append((extra, "K", AFTER[initial][at]))
            for cost, letter, after in ways:
                best[after] = min(best.get(after, (NEVER, "")), (cost + INSERT * inserted, word + letter))
            at, word = AFTER[NEXT[at][0]][at], word + "I"
        out.append([(cost, word, after) for after, (cost, word) in best.items()])
    return out


STEPS = [_step(initial, fault) for initial in ("s", "u", "a", "") for fault in range(4)]
# Inserted turns that end a conversation in each state.
TAILS = ["", "II", "I", ""]
GOAL = [INSERT * len(t) for t in TAILS]


def code_of(role: str, fault: int) -> int:
    """Number of the step of a row; a role that starts with none of s, u, a is never kept."""
    return "sua".find(role[0]) % 4 * 4 + fault if role else 12 + fault


def _forward(steps: Sequence[Step], start: int) -> tuple[list[int], list[int]]:
    """Least costs from ``start`` to each state, and the ranks of their audits."""
    cost, rank = [NEVER] * 4, [0] * 4
    cost[start] = 0
    for step in steps:
        best: list = [(NEVER,)] * 4
        for state in range(4):
            if cost[state] < NEVER:
                for price, word, after in step[state]:
                    way = (cost[state] + price, rank[state], word)
                    if way < best[after]:
                        best[after] = way
        order = sorted((way[1:], after) for after, way in enumerate(best) if len(way) > 1)
        cost = [way[0] for way in best]
        for place, (_, after) in enumerate(order):
            rank[after] = place
    return cost, rank


def _backward(steps: Sequence[Step], goal: list[int]) -> list[int]:
    for step in reversed(steps):
        goal = [min([price + goal[after] for price, _, after in ways], default=NEVER) for ways in step]
    return goal


def crossings(steps: Sequence[Step], start: int, goal: list[int]) -> list[tuple[object, int]]:
    """Audit and state after each step on the cheapest way from ``start``, of equally cheap ways the audit-least."""
    if not steps:
        return []
    if len(steps) == 1:
        _, word, after = min((price + goal[after], word, after) for price, word, after in steps[0][start])
        return [(word, after)]
    half = len(steps) // 2
    left, right = steps[:half], steps[half:]
    cost, rank = _forward(left, start)
    rest = _backward(right, goal)
    at = min((s for s in range(4) if cost[s] < NEVER), key=lambda s: (cost[s] + rest[s], rank[s]))
    return crossings(left, start, [0 if s == at else NEVER for s in range(4)]) + crossings(right, at, goal)


def stretch(steps: Sequence[Step]) -> Step:
    """Many steps as one; the audits are told by their ranks."""
    out = []
    for start in range(4):
        cost, rank = _forward(steps, start)
        out.append([(cost[s], rank[s], s) for s in range(4) if cost[s] < NEVER])
    return out


def turns_of(word: str, state: int, role: str, text: str) -> Iterator[tuple[str, str]]:
    """Turns ``(role, text)`` that the audit of one row leaves."""
    for letter in word:
        if letter == "I":
            yield NEXT[state], ""
            state = AFTER[NEXT[state][0]][state]
        elif letter == "R":
            yield NEXT[state], text
            state = AFTER[NEXT[state][0]][state]
        elif letter == "K":
            yield role, text


def bare_fault(text: str) -> int:
    end = text.rstrip(SPACE)
    return BLANK if not end else FINE if end[-1] in ENDS else CUT


class Tally:
    """Counts over rows in order: gaps, faults, pairs of roles that do not follow each other. Tallies can be joined."""

    def __init__(self):
        self.faults, self.illegal, self.distinct = [0, 0, 0, 0], 0, 0
        self.first = self.last = None
        self.turns: tuple | None = None

    def add(self, turn: int | None, initial: str, fault: int) -> None:
        self.join([0] * 4, 0, int(turn is not None), initial, initial, None if turn is None else (turn, turn))
        self.faults[fault] += 1

    def join(self, faults: list[int], illegal: int, distinct: int, first: str | None, last: str | None, turns: tuple | None) -> None:
        self.faults = [a + b for a, b in zip(self.faults, faults)]
        self.illegal += illegal
        if first is not None:
            if self.last is not None and self.last + first not in ("su", "ua", "au"):
                self.illegal += 1
            self.first, self.last = first if self.first is None else self.first, last
        # Rows come by turn, nulls first, so that equal turns meet at the seam.
        self.distinct += distinct - bool(self.turns and turns and self.turns[1] == turns[0])
        if turns:
            self.turns = (self.turns[0] if self.turns else turns[0], turns[1])

    def gaps(self) -> int:
        return self.turns[1] - self.turns[0] + 1 - self.distinct if self.turns else 0


NUMBERS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]


def _numbers(tally: Tally, cost: int) -> list[int]:
    return [tally.gaps(), tally.faults[BLANK], tally.faults[REPEAT], tally.faults[CUT], tally.illegal, cost]


def solved(rows: list[tuple]) -> tuple[list[int], str, list[tuple[str, str]]]:
    """Numbers, audit and repaired turns of one conversation's rows ``(turn, role, text, digest)``."""
    tally, seen, steps = Tally(), set(), []
    for turn, role, text, digest in rows:
        fault = bare_fault(text)
        if fault != BLANK and digest in seen:
            fault = REPEAT
        seen.add(digest)
        tally.add(turn, role[:1], fault)
        steps.append(STEPS[code_of(role, fault)])
    way = crossings(steps, START, GOAL) if steps else []
    audit, turns, state = [], [], START
    for (word, after), (_, role, text, _) in zip(way, rows):
        turns += turns_of(word, state, role, text)
        audit.append(word)
        state = after
    turns += turns_of(TAILS[state], state, "", "")
    whole = "".join(audit) + TAILS[state]
    return _numbers(tally, _backward(steps, GOAL)[START]), whole, turns


def _line(role: str, text: str) -> bytes:
    return f"{role}:{text}".encode()


REPORT = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
# The columns of rows that are passed on, and what they are called beside those of finished conversations.
OPEN = "conv_id long, pos long, turn long, role string, text string, digest binary, lost boolean"
_BESIDE = OPEN.replace("conv_id", "open_id").replace("role", "open_role").replace("text", "open_text")
_KINDS = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary(), "boolean": pa.bool_(), "int": pa.int32()}


def _arrow(ddl: str) -> pa.Schema:
    return pa.schema([(name, _KINDS[kind]) for name, kind in (f.split(" ") for f in ddl.split(", "))])


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows) if rows else [()] * len(schema), schema)], schema=schema)


def _walk(ordered: DataFrame, whole: str, finish) -> DataFrame:
    """Rows of conversations in order: ``finish`` gives the rows of schema ``whole`` for those that lie within a partition.

    Rows of the first and the last conversation of a partition, which may go on in others, and of long ones are passed
    on as they are, in the columns of ``OPEN``; ``open`` tells the two apart.
    """
    columns = f"open boolean, {whole}, {_BESIDE}"
    schema, done, left = _arrow(columns), len(_arrow(whole)), len(_arrow(OPEN))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pos = TaskContext.get().partitionId() << 33
        conv, rows, bytes_, passed, out, size = None, [], 0, True, [], 0

        def pass_on() -> None:
            nonlocal size
            for row in rows:
                out.append((True, *[None] * done, *row))
                size += len(row[4])
            rows.clear()

        started = False
        for batch in batches:
            for its, turn, role, text, lost in zip(*(c.to_pylist() for c in batch.columns)):
                if not started or its != conv:
                    if started and not passed:
                        for row in finish(conv, [r[2:6] for r in rows if not r[6]]):
                            out.append((False, *row, *[None] * left))
                            size += sum(len(v) for v in row if isinstance(v, str))
                        rows.clear()
                    else:
                        pass_on()
                    # The first conversation of a partition may have begun in the one before.
                    conv, bytes_, passed, started = its, 0, not started, True
                digest = xxhash.xxh128_digest(f"{its}\0{role}\0{text}".encode())
                rows.append((its, pos, turn, role, text, digest, lost))
                pos += 1
                bytes_ += len(text)
                if bytes_ > HELD_BYTES or len(rows) > HELD_ROWS:
                    passed = True
                if passed:
                    pass_on()
                if size > HELD_BYTES or len(out) > HELD_ROWS:
                    yield _batch(out, schema)
                    out, size = [], 0
        pass_on()
        yield _batch(out, schema)

    return ordered.mapInArrow(run, columns)


def in_order(rows: DataFrame) -> DataFrame:
    """Conversations sorted across partitions of bounded size: by turn, nulls first, then role, then a hash of the text."""
    total = rows.agg(F.sum(F.octet_length("text") + 20)).first()[0] or 0
    spread = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = max(total // PART_BYTES + 1, min(total // LEAST_BYTES + 1, spread))
    # The last key only parts equal rows.
    keys = ["conv_id", "turn", "role", "_h", "_at"]
    keyed = rows.withColumn("_h", F.xxhash64("text")).withColumn("_at", F.monotonically_increasing_id())
    ordered = keyed.repartitionByRange(int(parts), *keys).sortWithinPartitions(*keys)
    return ordered.select("conv_id", "turn", "role", "text", "lost")


def _plain(rows: DataFrame) -> DataFrame:
    lost = F.coalesce("lost", F.lit(False)) if "lost" in rows.columns else F.lit(False)
    text = lambda c: F.coalesce(c, F.lit(" ")).alias(c)
    return rows.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), text("role"), text("text"), lost.alias("lost"))


MARKS = "conv_id long, pos long, turn long, initial string, code int"
SUMMARY = (
    "conv_id long, block long, price array<long>, place array<int>, faults array<long>, illegal long, seen long, first string, last string, low long, high long"
)
CROSSED = "conv_id long, block long, enter int, leave int, final boolean, gaps long, blank long, duplicate long, truncated long, illegal long, cost long"
WAYS = "pos long, word string, state int"


def _runs(rows: pa.Table) -> Iterator[list[dict]]:
    """Rows of each conversation in a block, in order."""
    held: list[dict] = []
    for row in rows.sort_by("pos").to_pylist():
        if held and held[-1]["conv_id"] != row["conv_id"]:
            yield held
            held = []
        held.append(row)
    if held:
        yield held


def _summaries(rows: pa.Table) -> pa.Table:
    out = []
    for run in _runs(rows):
        tally = Tally()
        for r in run:
            tally.add(r["turn"], r["initial"], r["code"] % 4)
        price, place = [NEVER] * 16, [0] * 16
        for start, ways in enumerate(stretch([STEPS[r["code"]] for r in run])):
            for cost, rank, after in ways:
                price[4 * start + after], place[4 * start + after] = cost, rank
        low, high = tally.turns or (None, None)
        out.append((run[0]["conv_id"], run[0]["pos"] >> 33, price, place, tally.faults, tally.illegal, tally.distinct, tally.first, tally.last, low, high))
    kinds = [pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.int64()), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64()]
    names = [f.split(" ")[0] for f in SUMMARY.split(", ")]
    return pa.table([pa.array(c, k) for c, k in zip(zip(*out) if out else [()] * 11, kinds)], names)


def _crossed(rows: pa.Table) -> pa.Table:
    """Where the stretches of one conversation are entered and left; one row a partition it lies in."""
    blocks = rows.sort_by("block").to_pylist()
    tally, steps = Tally(), []
    for b in blocks:
        tally.join(b["faults"], b["illegal"], b["seen"], b["first"], b["last"], None if b["low"] is None else (b["low"], b["high"]))
        steps.append([[(b["price"][4 * x + z], b["place"][4 * x + z], z) for z in range(4) if b["price"][4 * x + z] < NEVER] for x in range(4)])
    numbers = _numbers(tally, _backward(steps, GOAL)[START])
    out, state = [], START
    for k, (b, (_, after)) in enumerate(zip(blocks, crossings(steps, START, GOAL))):
        out.append((b["conv_id"], b["block"], state, after, k == len(blocks) - 1, *numbers))
        state = after
    return pa.Table.from_batches([_batch(out, _arrow(CROSSED))])


def _ways(rows: pa.Table, crossed: pa.Table) -> pa.Table:
    """The audit of each row of a block."""
    known = {c["conv_id"]: c for c in crossed.to_pylist()}
    out = []
    for run in _runs(rows):
        at = known[run[0]["conv_id"]]
        state = at["enter"]
        way = crossings([STEPS[r["code"]] for r in run], state, [0 if s == at["leave"] else NEVER for s in range(4)])
        for k, (r, (word, after)) in enumerate(zip(run, way)):
            tail = TAILS[after] if at["final"] and k == len(run) - 1 else ""
            out.append((r["pos"], word + tail, state))
            state = after
    return pa.Table.from_batches([_batch(out, _arrow(WAYS))])


def _open_rows(walked: DataFrame) -> DataFrame:
    return walked.filter("open").select(F.col("open_id").alias("conv_id"), "pos", "turn", F.col("open_role").alias("role"), F.col("open_text").alias("text"), "digest", "lost")


def _by_stretches(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """For rows as in ``OPEN``: the rows with the audit of each, and where stretches are crossed; both staged."""
    seen = rows.groupBy("digest").agg(F.min("pos").alias("_first"), F.count("*").alias("_n")).filter("_n > 1").select("digest", "_first")
    end = F.rtrim("text", F.lit(SPACE))
    own = F.when(end == "", BLANK).when(F.contains(F.lit(ENDS), F.right(end, F.lit(1))), FINE).otherwise(CUT)
    bare = rows.select("conv_id", "pos", "turn", F.left("role", F.lit(1)).alias("initial"), "digest", own.alias("own"))
    fault = F.when((F.col("own") != BLANK) & (F.col("pos") > F.col("_first")), REPEAT).otherwise(F.col("own"))
    kind = F.when(F.col("initial") == "s", 0).when(F.col("initial") == "u", 1).when(F.col("initial") == "a", 2).otherwise(3)
    marks = bare.join(seen, "digest", "left").select("conv_id", "pos", "turn", "initial", (kind * 4 + fault).alias("code"))
    marks = stage(marks.withColumn("block", F.shiftright("pos", 33)), "dialogue-marks")
    columns = [marks[c.split(" ")[0]] for c in MARKS.split(", ")]
    summaries = marks.select("block", *columns).groupBy("block").applyInArrow(lambda t: _summaries(t), SUMMARY)
    crossed = stage(summaries.groupBy("conv_id").applyInArrow(lambda t: _crossed(t), CROSSED), "dialogue-crossings")
    ways = marks.groupBy("block").cogroup(crossed.groupBy("block")).applyInArrow(lambda a, b: _ways(a, b), WAYS)
    return rows.join(ways, "pos").select("conv_id", "pos", "word", "state", "role", "text"), crossed


def _folded(ways: DataFrame) -> DataFrame:
    """``(conv_id, audit, repaired_sha256)``, each conversation streamed in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = _arrow("conv_id long, audit string, repaired_sha256 string")
        conv, digest, audit, lines = None, None, [], 0
        for batch in batches:
            for its, _, word, state, role, text in zip(*(c.to_pylist() for c in batch.columns)):
                if digest is None or its != conv:
                    if digest is not None:
                        yield _batch([(conv, "".join(audit), digest.hexdigest())], schema)
                    conv, digest, audit, lines = its, hashlib.sha256(), [], 0
                audit.append(word)
                for turn in turns_of(word, state, role, text):
                    digest.update((b"\n" if lines else b"") + _line(*turn))
                    lines += 1
        if digest is not None:
            yield _batch([(conv, "".join(audit), digest.hexdigest())], schema)

    return ways.repartition("conv_id").sortWithinPartitions("conv_id", "pos").mapInArrow(run, "conv_id long, audit string, repaired_sha256 string")


def audited(conversations: DataFrame) -> DataFrame:
    """One row for each conversation: its gaps and faults, the cost and audit of its repair and the digest of the result.

    Rows marked in a column ``lost`` only name their conversation; one without other rows has zeros, an empty audit and
    the digest of nothing. Null roles and texts are one space, null turns come first, null ids are one conversation.
    Rows of one turn go by role, then by a hash of the text. A blank row is no duplicate. Roles are told by their first
    character; others than s, u and a cannot be kept. Texts and conversations may be of any length; the audit and the
    digest of one conversation are made in one task, which streams its text. An empty table gives no rows, and further
    columns are not read.
    """
    def report(conv: int | None, rows: list[tuple]) -> list[tuple]:
        numbers, audit, turns = solved(rows)
        return [(conv, *numbers, audit, hashlib.sha256(b"\n".join(_line(*t) for t in turns)).hexdigest())]

    small_batches(conversations.sparkSession)
    walked = stage(_walk(in_order(_plain(conversations)), REPORT, report), "dialogues")
    names = [f.split(" ")[0] for f in REPORT.split(", ")]
    rows = _open_rows(walked)
    ways, crossed = _by_stretches(rows.filter("NOT lost"))
    numbers = crossed.filter("final").select(F.col("conv_id").alias("_a"), *NUMBERS)
    folded = _folded(ways).select(F.col("conv_id").alias("_b"), "audit", "repaired_sha256")
    long = rows.select("conv_id").distinct().join(numbers, F.col("conv_id").eqNullSafe(F.col("_a")), "left").join(folded, F.col("conv_id").eqNullSafe(F.col("_b")), "left")
    nothing = hashlib.sha256().hexdigest()
    long = long.select("conv_id", *[F.coalesce(n, F.lit(0).cast("long")).alias(n) for n in NUMBERS], F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(nothing)).alias("repaired_sha256"))
    return walked.filter("NOT open").select(*names).unionByName(long)


def repaired(conversations: DataFrame) -> DataFrame:
    """``(conv_id, place, role, text)``: the turns of the repaired conversations, ``place`` rising within each; see :func:`audited`."""
    schema = "conv_id long, place long, role string, text string"

    def turns(conv: int | None, rows: list[tuple]) -> list[tuple]:
        return [(conv, k, *t) for k, t in enumerate(solved(rows)[2])]

    small_batches(conversations.sparkSession)
    walked = stage(_walk(in_order(_plain(conversations)), schema, turns), "dialogues")
    ways, _ = _by_stretches(_open_rows(walked).filter("NOT lost"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = zip(*(c.to_pylist() for c in batch.columns))
            # A row leaves at most its own turn and two on either side of it.
            yield _batch([(conv, pos * 8 + k, *t) for conv, pos, word, state, role, text in rows for k, t in enumerate(turns_of(word, state, role, text))], _arrow(schema))

    return walked.filter("NOT open").select("conv_id", "place", "role", "text").unionByName(ways.mapInArrow(run, schema))


def damaged(conversations: DataFrame) -> DataFrame:
    """Conversations with faults by the checksum of conversation and turn: lost, emptied, without ends, repeated, or of role user.

    Lost rows stay, marked in ``lost``, so that no conversation vanishes.
    """
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(text("conv_id"), F.lit(":"), text("turn")).cast("binary")) % 20
    rows = conversations.select("conv_id", "turn", text("role").alias("role"), text("text").alias("text"), kind.alias("_kind"))
    rows = rows.withColumn("_copy", F.explode(F.when(F.col("_kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))))
    return rows.select(
        "conv_id", "turn", F.when(F.col("_kind") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(F.col("_kind") == 1, "").when(F.col("_kind") == 2, F.translate("text", ENDS, "")).otherwise(F.col("text")).alias("text"),
        (F.col("_kind") == 0).alias("lost"),
    )


def op11_dialogue_repair(spark, folder: str) -> DataFrame:
    return audited(damaged(table(spark, folder, "conversations")))
