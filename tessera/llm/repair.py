"""Cheapest repair of a conversation's turn structure.

A row has a role and a fault (blank, duplicate, truncated, none), in that order
of precedence. Edits: keep a row (K, cost 0), give it the role user or assistant
(R, 1), delete it (D, 2; required for blank and duplicate rows), insert an empty
user or assistant row anywhere (I, 5). A truncated row that stays adds 5. The
repaired roles must be nothing, or an optional system row followed by one or
more user/assistant pairs; roles count by their first letter.

Method: a row is one of nine symbols, and a symbol is a 4 x 4 min-plus matrix
over the states of that pattern (nothing yet, after system, after user, after
assistant). Equal symbols in a row form a run, which a binary power of its
matrix crosses in one go. Matrices are associative, so a conversation of any
length is cut into segments wherever the sort cuts it:

1. Narrow rows (a digest in place of the text; equal rows as one with a count)
   are sorted over range partitions by conversation and turn. A conversation
   may span many partitions. Each stretch becomes one segment: its runs, the
   product of its matrices, counts, and its edge values.
2. Per conversation the segments' products, not their rows, are chained from
   the end; each segment then knows the cost to go behind it.
3. Each segment unrolls its edits for every state it may start in; the chain
   picks one. Ties take the ASCII-least audit: D, I, K, R. An audit letter and
   the state fix the next state, so the first letter that keeps to the least
   cost is right.
4. Texts meet their conversation's audit in one sorted stream, which holds one
   audit and one row at a time.

Defined cases: NULL in any column counts as one space, but NULL conversations
stay one conversation without id and NULL turns come first; rows of the same
turn are ordered by role, then by digest of the text (equal rows are adjacent);
repeated rows are duplicates; an empty table gives no rows; a conversation
without rows has zero counts and no audit; other columns are ignored. A
conversation's audit is one text value, and a digest of its whole repaired text
is a chain over its rows, so these two pass through one task per conversation,
as a stream.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence
from functools import lru_cache

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import stage_derived

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5
#: Rows of a segment at most.
SEGMENT_ROWS = 50_000

#: States: nothing yet, after system, after user, after assistant.
START, SYSTEM, USER, ASSISTANT = range(4)
FAR = 1 << 50
Matrix = tuple[tuple[int, ...], ...]
#: What an inserted or re-roled row makes of a state, and its role.
NEXT = (USER, USER, ASSISTANT, USER)
ROLE = {USER: "user", ASSISTANT: "assistant"}
#: Symbols are twice the role (system, user, assistant, other), plus 1 if truncated; or this one for rows that must go.
GONE = 8
OTHER = 3
LAST = (0, FAR, FAR, 0)


def kept_state(role: int, state: int) -> int | None:
    """State after a kept row, None where its role cannot stand there."""
    if role == 0:
        return SYSTEM if state == START else None
    if role == 1:
        return USER if state != USER else None
    return ASSISTANT if role == 2 and state == USER else None


def edits(symbol: int, state: int) -> list[tuple[str, int, int]]:
    """Edits of one row: letter, cost, next state; letters in ASCII order."""
    out = [("D", DELETE, state)]
    if symbol == GONE:
        return out
    extra = TRUNCATED * (symbol & 1)
    kept = kept_state(symbol >> 1, state)
    if kept is not None:
        out.append(("K", KEEP + extra, kept))
    return [*out, ("R", REROLE + extra, NEXT[state])]


def times(a: Matrix, b: Matrix) -> Matrix:
    """Min-plus product."""
    columns = tuple(zip(*b))
    return tuple(tuple(min(FAR, min(x + y for x, y in zip(row, c))) for c in columns) for row in a)


def apply(a: Matrix, v: Sequence[int]) -> tuple[int, ...]:
    return tuple(min(FAR, min(x + y for x, y in zip(row, v))) for row in a)


def _inserts() -> Matrix:
    """Cheapest insertions from state to state."""
    one = [[0 if i == j else INSERT if NEXT[i] == j else FAR for j in range(4)] for i in range(4)]
    return times(tuple(map(tuple, one)), tuple(map(tuple, one)))


INSERTS = _inserts()
UNIT: Matrix = tuple(tuple(0 if i == j else FAR for j in range(4)) for i in range(4))
#: Cost to go behind a conversation's last row.
END = apply(INSERTS, LAST)


@lru_cache(maxsize=None)  # nine symbols by the bits of a run's length
def power(symbol: int, bit: int) -> Matrix:
    """The symbol's matrix to the power 2 ** bit."""
    if bit:
        half = power(symbol, bit - 1)
        return times(half, half)
    rows = [[FAR] * 4 for _ in range(4)]
    for state in range(4):
        for _, cost, after in edits(symbol, state):
            rows[state][after] = min(rows[state][after], cost)
    return times(INSERTS, tuple(map(tuple, rows)))


@lru_cache(maxsize=1 << 12)
def run_matrix(symbol: int, length: int) -> Matrix:
    """A run's matrix from the cached binary powers."""
    out = UNIT
    for bit in range(length.bit_length()):
        if length >> bit & 1:
            out = times(out, power(symbol, bit))
    return out


@lru_cache(maxsize=1 << 14)
def _product(a: Matrix, b: Matrix) -> Matrix:
    return times(a, b)


def segment_matrix(runs: Sequence[tuple[int, int]]) -> Matrix:
    out = UNIT
    for symbol, length in runs:
        out = _product(out, run_matrix(symbol, length))
    return out


@lru_cache(maxsize=1 << 14)
def _unroll_run(symbol: int, length: int, after: tuple[int, ...], state: int) -> tuple[int, str]:
    """Edits of one run from a state, given the cost to go behind it (least cost 0)."""
    one, to_go = power(symbol, 0), [after]
    for _ in range(length):
        to_go.append(apply(one, to_go[-1]))
    out = []
    for rest in range(length, 0, -1):
        here, behind = to_go[rest], to_go[rest - 1]
        while True:
            options = [(letter, following) for letter, cost, following in edits(symbol, state) if cost + behind[following] == here[state]]
            if here[state] == INSERT + here[NEXT[state]]:
                options.append(("I", NEXT[state]))
            letter, state = min(options)
            out.append(letter)
            if letter != "I":
                break
    return state, "".join(out)


def unroll(runs: Sequence[tuple[int, int]], after: tuple[int, ...], state: int, last: bool) -> tuple[int, str]:
    """Cheapest edits of a segment from a start state, ASCII-least on ties; its end state."""
    behind = [after]
    for symbol, length in reversed(runs):
        behind.append(apply(run_matrix(symbol, length), behind[-1]))
    out = []
    if behind[-1][state] >= FAR:
        return state, ""
    for (symbol, length), values in zip(runs, reversed(behind[:-1])):
        least = min(values)
        state, letters = _unroll_run(symbol, length, tuple(min(FAR, v - least) if v < FAR else FAR for v in values), state)
        out.append(letters)
    while last and LAST[state]:
        out.append("I")
        state = NEXT[state]
    return state, "".join(out)


# rows and segments


def spaced(name: str) -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(" "))


def plain_rows(conversations: DataFrame) -> DataFrame:
    """The four columns, NULL role and text as one space."""
    return conversations.select("conv_id", F.col("turn").cast("long"), spaced("role").alias("role"), spaced("text").alias("text"))


def damaged(conversations: DataFrame) -> DataFrame:
    """Rows dropped, emptied, stripped of stops, repeated or re-roled by a hash of conversation and turn."""
    key = F.concat(spaced("conv_id"), F.lit(":"), spaced("turn"))
    rows = plain_rows(conversations).withColumn("fate", F.crc32(key.cast("binary")) % 20).filter("fate <> 0")
    text = F.when(F.col("fate") == 1, "").when(F.col("fate") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("fate") == 4, "user").otherwise(F.col("role"))
    copies = F.when(F.col("fate") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(copies).alias("copy")).drop("copy")


def _digest() -> Column:
    return F.unhex(F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")), 256))


def _narrow_rows(rows: DataFrame) -> DataFrame:
    """Equal rows as one: count, role letter, symbol of the first copy and of the others."""
    end = F.rtrim(F.col("text"), F.lit(" \t\n\x0b\f\r"))
    marked = rows.select(
        "conv_id", "turn", "role", _digest().alias("digest"), (end == "").alias("blank"),
        (~F.right(end, F.lit(1)).isin(".", "!", "?")).alias("cut"),
    )
    equal = stage_derived(marked.groupBy(*marked.columns).agg(F.count("*").alias("copies")))
    firsts = equal.groupBy("conv_id", "digest").agg(F.min(F.struct("turn")).alias("least"))
    firsts = firsts.select(F.col("conv_id").alias("c"), F.col("digest").alias("d"), F.col("least.turn").alias("first_turn"))
    # a digest is known to every row, so it carries the join; NULL conversations meet by <=>
    seen = equal.join(firsts, (F.col("digest") == F.col("d")) & F.col("conv_id").eqNullSafe(F.col("c")))
    letter = F.substring("role", 1, 1)
    kind = F.when(letter == "s", 0).when(letter == "u", 1).when(letter == "a", 2).otherwise(OTHER)
    first = F.col("turn").eqNullSafe(F.col("first_turn"))
    symbol = F.when(F.col("blank") | ~first, GONE).otherwise(2 * kind + F.col("cut").cast("int"))
    return seen.select(
        "conv_id", "turn", "role", "digest", "blank", "copies", letter.alias("letter"), symbol.cast("int").alias("symbol")
    )


_SEGMENT = [
    ("segment", pa.int64()), ("symbols", pa.binary()), ("lengths", pa.list_(pa.int64())), ("matrix", pa.list_(pa.int64())),
    ("first_letter", pa.string()), ("last_letter", pa.string()), ("blank", pa.int64()), ("duplicate", pa.int64()),
    ("truncated", pa.int64()), ("illegal", pa.int64()), ("turns", pa.int64()), ("first_turn", pa.int64()), ("last_turn", pa.int64()),
    ("least_turn", pa.int64()),
]
_SEGMENT_SCHEMA = (
    "segment long, symbols binary, lengths array<long>, matrix array<long>, first_letter string, last_letter string, "
    "blank long, duplicate long, truncated long, illegal long, turns long, first_turn long, last_turn long, least_turn long"
)
LEGAL = frozenset({"su", "ua", "au"})


class _Segment:
    """Runs and counts of consecutive rows of one conversation."""

    def __init__(self, conv_id, turn, letter: str):
        self.conv_id, self.first_turn, self.first_letter = conv_id, turn, letter
        self.turn, self.letter, self.least = turn, None, turn
        self.rows = self.blank = self.duplicate = self.truncated = self.illegal = 0
        self.turns = int(turn is not None)
        self.runs: list[list[int]] = []

    def _run(self, symbol: int, length: int) -> None:
        if self.runs and self.runs[-1][0] == symbol:
            self.runs[-1][1] += length
        elif length:
            self.runs.append([symbol, length])

    def add(self, turn, letter: str, symbol: int, blank: bool, copies: int) -> None:
        if self.letter is not None and self.letter + letter not in LEGAL:
            self.illegal += 1
        if copies > 1 and letter + letter not in LEGAL:
            self.illegal += copies - 1
        if turn != self.turn:
            self.turns += 1
            self.least = turn if self.least is None else self.least
        self.turn, self.letter = turn, letter
        self.blank += copies if blank else 0
        self.duplicate += 0 if blank else copies - (symbol != GONE)
        self.truncated += int(symbol != GONE and symbol & 1)
        self._run(symbol, 1)
        self._run(GONE, copies - 1)
        self.rows += copies

    def values(self, number: int) -> tuple:
        runs = [tuple(r) for r in self.runs]
        return (
            self.conv_id, number, bytes(s for s, _ in runs), [n for _, n in runs], [x for r in segment_matrix(runs) for x in r],
            self.first_letter, self.letter, self.blank, self.duplicate, self.truncated, self.illegal, self.turns,
            self.first_turn, self.turn, self.least,
        )


def segments(rows: DataFrame, segment_rows: int = SEGMENT_ROWS) -> DataFrame:
    """Conversations cut where the sort's partitions end, or a segment is full.

    Segment numbers rise along a conversation. A row with more copies than a
    segment holds is still one run of two symbols.
    """
    kind = rows.schema["conv_id"].dataType
    order = ["conv_id", "turn", "role", "digest"]
    narrow = _narrow_rows(rows).repartitionByRange(*order).sortWithinPartitions(*order)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number, now, done, conv_type = TaskContext.get().partitionId(), 0, None, [], None

        def batch_of(found: list[tuple]) -> pa.RecordBatch:
            columns = list(zip(*found))
            arrays = [pa.array(columns[0], conv_type), *[pa.array(c, t) for c, (_, t) in zip(columns[1:], _SEGMENT)]]
            return pa.RecordBatch.from_arrays(arrays, ["conv_id", *[n for n, _ in _SEGMENT]])

        for batch in batches:
            conv_type = batch.schema.field("conv_id").type
            for conv_id, turn, letter, symbol, blank, copies in zip(*(c.to_pylist() for c in batch.columns)):
                if now is None or now.conv_id != conv_id or now.rows >= segment_rows:
                    if now is not None:
                        done.append(now.values(part << 32 | number))
                        number += 1
                    now = _Segment(conv_id, turn, letter)
                now.add(turn, letter, symbol, blank, copies)
                if len(done) >= 1000:
                    yield batch_of(done)
                    done = []
        if now is not None:
            done.append(now.values(part << 32 | number))
        if done:
            yield batch_of(done)

    schema = f"conv_id {kind.simpleString()}, {_SEGMENT_SCHEMA}"
    return narrow.select("conv_id", "turn", "letter", "symbol", "blank", "copies").mapInArrow(work, schema)


def _square(flat: Sequence[int]) -> Matrix:
    return tuple(tuple(flat[i : i + 4]) for i in range(0, 16, 4))


def chains(found: DataFrame) -> DataFrame:
    """Counts and cost of every conversation, and the cost to go behind each of its segments.

    Groups hold one small row per segment, without its runs.
    """
    edges = ["segment", "matrix", "first_letter", "last_letter", "blank", "duplicate", "truncated", "illegal", "turns", "first_turn", "last_turn", "least_turn"]
    grouped = found.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct(*edges))).alias("parts"))
    kind = found.schema["conv_id"].dataType.simpleString()

    def one(parts: list[dict]) -> tuple:
        total = {c: sum(p[c] for p in parts) for c in ("blank", "duplicate", "truncated", "illegal", "turns")}
        for before, after in zip(parts, parts[1:]):
            total["illegal"] += before["last_letter"] + after["first_letter"] not in LEGAL
            total["turns"] -= before["last_turn"] is not None and before["last_turn"] == after["first_turn"]
        least = next((p["least_turn"] for p in parts if p["least_turn"] is not None), None)
        gaps = 0 if least is None else parts[-1]["last_turn"] - least + 1 - total["turns"]
        values, ends = END, []
        for i in range(len(parts) - 1, -1, -1):
            ends.append({"segment": parts[i]["segment"], "after": list(values), "first": i == 0, "last": i == len(parts) - 1})
            values = apply(_square(parts[i]["matrix"]), values)
        return (gaps, total["blank"], total["duplicate"], total["truncated"], total["illegal"], values[START], ends)

    names = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    end_type = pa.struct([("segment", pa.int64()), ("after", pa.list_(pa.int64())), ("first", pa.bool_()), ("last", pa.bool_())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = list(zip(*[one(p) for p in batch.column(1).to_pylist()])) or [[]] * 7
            arrays = [batch.column(0), *[pa.array(c, pa.int64()) for c in columns[:6]], pa.array(columns[6], pa.list_(end_type))]
            yield pa.RecordBatch.from_arrays(arrays, ["conv_id", *names, "ends"])

    ends = "array<struct<segment: long, after: array<long>, first: boolean, last: boolean>>"
    return grouped.mapInArrow(work, f"conv_id {kind}, {', '.join(f'{n} long' for n in names)}, ends {ends}")


def audits(found: DataFrame, chained: DataFrame) -> DataFrame:
    """``conv_id`` and ``audit``: every segment unrolled, the pieces picked from state to state."""
    ends = chained.select(F.explode("ends").alias("e")).select("e.*")
    runs = found.select("conv_id", "segment", "symbols", "lengths").join(ends, "segment")
    kind = found.schema["conv_id"].dataType.simpleString()
    path = pa.list_(pa.struct([("state", pa.int32()), ("audit", pa.string())]))

    def unrolled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            paths = []
            for symbols, lengths, after, first, last in zip(*(batch.column(i).to_pylist() for i in range(2, 7))):
                own = list(zip(symbols, lengths))
                starts = (START,) if first else range(4)
                paths.append([dict(zip(("state", "audit"), unroll(own, tuple(after), s, last))) for s in starts])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(paths, path)], ["conv_id", "segment", "paths"])

    def picked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for parts in batch.column(1).to_pylist():
                state, letters = START, []
                for p in parts:
                    step = p["paths"][state]
                    state = step["state"]
                    letters.append(step["audit"])
                out.append("".join(letters))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string())], ["conv_id", "audit"])

    schema = f"conv_id {kind}, segment long, paths array<struct<state: int, audit: string>>"
    pieces = runs.select("conv_id", "segment", "symbols", "lengths", "after", "first", "last").mapInArrow(unrolled, schema)
    grouped = pieces.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("segment", "paths"))).alias("parts"))
    return grouped.mapInArrow(picked, f"conv_id {kind}, audit string")


def repaired_rows(rows: DataFrame, audit: DataFrame) -> DataFrame:
    """``conv_id``, ``position``, ``role``, ``text`` of the repaired rows, in order within a task."""
    kind = rows.schema["conv_id"].dataType.simpleString()
    nothing = F.lit(None)
    texts = rows.select("conv_id", F.lit(1).alias("kind"), "turn", "role", _digest().alias("digest"), "text")
    notes = audit.select(
        "conv_id", F.lit(0).alias("kind"), nothing.cast("long").alias("turn"), F.lit("").alias("role"),
        nothing.cast("binary").alias("digest"), F.col("audit").alias("text"),
    )
    order = ["conv_id", "kind", "turn", "role", "digest"]
    stream = texts.unionByName(notes).repartition("conv_id").sortWithinPartitions(*order)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        letters, at, state, position, here = "", 0, START, 0, None
        for batch in batches:
            out: list[tuple] = []

            def inserted() -> None:
                nonlocal at, state, position
                while at < len(letters) and letters[at] == "I":
                    state, at, position = NEXT[state], at + 1, position + 1
                    out.append((here, position, ROLE[state], ""))

            for conv_id, kind_of, role, text in zip(*(c.to_pylist() for c in batch.columns)):
                if kind_of == 0:
                    inserted()  # what the conversation before still lacks
                    letters, at, state, position, here = text, 0, START, 0, conv_id
                    continue
                inserted()
                edit, at = letters[at], at + 1
                if edit == "D":
                    continue
                if edit == "R":
                    state = NEXT[state]
                    role = ROLE[state]
                else:
                    state = {"s": SYSTEM, "u": USER}.get(role[:1], ASSISTANT)
                position += 1
                out.append((conv_id, position, role, text))
            # inserts behind a conversation's last row wait for the next row or for the end
            columns = list(zip(*out)) or [()] * 4
            types = [batch.schema.field("conv_id").type, pa.int64(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], ["conv_id", "position", "role", "text"])
            conv_type = types[0]
        tail = []
        while at < len(letters):
            state, at, position = NEXT[state], at + 1, position + 1
            tail.append((here, position, ROLE[state], ""))
        if tail:
            types = [conv_type, pa.int64(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*tail), types)], ["conv_id", "position", "role", "text"])

    return stream.select("conv_id", "kind", "role", "text").mapInArrow(work, f"conv_id {kind}, position long, role string, text string")


def text_digests(repaired: DataFrame) -> DataFrame:
    """SHA-256 of ``role:text`` lines of each conversation, from rows that come in order (see ``repaired_rows``)."""
    kind = repaired.schema["conv_id"].dataType.simpleString()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state, here, conv_type = None, None, None
        for batch in batches:
            conv_type = batch.schema.field("conv_id").type
            out: list[tuple] = []
            for conv_id, position, role, text in zip(*(c.to_pylist() for c in batch.columns)):
                if position == 1:
                    if state is not None:
                        out.append((here, state.hexdigest()))
                    state, here = hashlib.sha256(), conv_id
                else:
                    state.update(b"\n")
                state.update(role.encode())
                state.update(b":")
                state.update(text.encode())
            columns = list(zip(*out)) or [(), ()]
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], conv_type), pa.array(columns[1], pa.string())], ["conv_id", "repaired_sha256"])
        if state is not None:
            yield pa.RecordBatch.from_arrays([pa.array([here], conv_type), pa.array([state.hexdigest()], pa.string())], ["conv_id", "repaired_sha256"])

    return repaired.mapInArrow(work, f"conv_id {kind}, repaired_sha256 string")


def repair(rows: DataFrame, segment_rows: int = SEGMENT_ROWS) -> tuple[DataFrame, DataFrame]:
    """Report per conversation (counts, cost, audit) and the repaired rows (eager jobs).

    ``rows`` holds conv_id, turn, role and text without NULL role or text (see ``plain_rows``).
    """
    found = stage_derived(segments(rows, segment_rows))
    chained = stage_derived(chains(found))
    audit = stage_derived(audits(found, chained))
    same = F.col("conv_id").eqNullSafe(F.col("c"))
    report = chained.drop("ends").join(audit.withColumnRenamed("conv_id", "c"), same).drop("c")
    return report, repaired_rows(rows, audit)


def damage_report(conversations: DataFrame) -> DataFrame:
    """Every conversation of the table: faults, cost and audit after damage, and the digest of its repaired text."""
    rows = damaged(conversations)
    report, repaired = repair(rows)
    digest = text_digests(repaired).withColumnRenamed("conv_id", "c")
    known = conversations.select(F.col("conv_id").alias("o")).distinct()
    out = known.join(report, F.col("o").eqNullSafe(F.col("conv_id")), "left").join(digest, F.col("o").eqNullSafe(F.col("c")), "left")
    counts = [F.coalesce(n, F.lit(0).cast("long")).alias(n) for n in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    empty = hashlib.sha256(b"").hexdigest()
    return out.select(
        F.col("o").alias("conv_id"), *counts, F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.lit(empty)).alias("repaired_sha256"),
    )
