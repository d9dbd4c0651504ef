"""Conversation structure repair (operator 13): the cheapest edits that make a conversation alternate.

A repaired conversation is empty or an optional system turn followed by pairs of a user and an assistant turn, judged
by the first letter of each role. Edits: K keeps a turn (0), R gives it the role user or assistant (2), D deletes it
(3), I inserts a turn with empty text (2). Blank turns and turns that repeat an earlier one (role and text) must be
deleted; a truncated turn that stays costs 1 more. Of the cheapest edits those whose letters are least in ASCII order
are taken.

Rows are dealt by conversation and sorted by turn; a Python task streams them and carries the state of a dynamic
program from one Arrow batch to the next. There are four states (nothing yet, after system, after user, after
assistant), and since a letter and a state allow one next state only, no cheapest way to a state is a beginning of
another one to the same state: the least string to each state can be kept as a rank, and a step costs the same however
long the conversation is. Conversations of at most ``held`` rows and ``held_bytes`` of text are decided in the task.
Of giant ones the task writes each row with its backpointers (24 bits, for all four states) to a table in the shared
folder; they are read from the last turn to the first, which decides, and then in turn order again. No task holds more
than a batch of a giant conversation, but one task streams it, as each of its edits depends on all its turns.

Cases: a null role or text is one space; an empty role is no role; rows of one turn are ordered by role and text, a
null turn is first; a null conversation id is one conversation; a conversation without rows left has one row with a
null edit; repeated rows are duplicates; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from slotforge.llm import textops

BLANKS = " \t\n\x0b\x0c\r"
START, SYSTEM, USER, ASSISTANT = range(4)
#: The state that an inserted turn, or one of a new role, leads to.
NEXT = (USER, USER, ASSISTANT, USER)
NAME = {USER: "user", ASSISTANT: "assistant"}
LETTERS = "DIKR"
#: A state dearer than the cheapest one by more than this can be on no cheapest way: seven is the most that it saves.
SLACK = 8

MARKED = "conv_id long, turn long, role string, text string, fault string"
EDITS = "conv_id long, seq long, edit string, turn long, role_before string, role string, text string, fault string, cost long"
DIGEST = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


def _schema(ddl: str) -> pa.Schema:
    return pa.schema([(c.split()[0], pa.string() if c.split()[1] == "string" else pa.int64()) for c in ddl.split(", ")])


def _rows(ddl: str, rows: list[tuple]) -> pa.RecordBatch:
    schema = _schema(ddl)
    columns = list(zip(*rows, strict=True)) or [[]] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, schema.types, strict=True)], schema=schema)


# --- the dynamic program: a way to a state is (cost, rank of its letters up to the last turn, inserts since then)


def _closed(ways: dict[int, tuple]) -> dict[int, tuple]:
    """The ways with inserts after them, as far as those are cheaper than what leads to the same state already."""
    ways, todo = dict(ways), list(ways)
    while todo:
        state = todo.pop()
        cost, rank, inserts, source = ways[state]
        new, to = (cost + 2, rank, inserts + 1, source), NEXT[state]
        if to not in ways or new[:3] < ways[to][:3]:
            ways[to] = new
            todo.append(to)
    return ways


OPEN = tuple(sorted((s, w[:3]) for s, w in _closed({START: (0, 0, 0, START)}).items()))
#: How each state is reached before the first turn.
FIRST = tuple((s, (START, "", w[2])) for s, w in sorted(_closed({START: (0, 0, 0, START)}).items()))


@lru_cache(maxsize=1 << 16)
def step(live: tuple, role: str, fault: str) -> tuple[tuple, int, tuple]:
    """(ways after a turn, cost of the cheapest one, backpointers) from the ways before it, whose cheapest costs nothing.

    ``role`` is a role's first letter. A backpointer is (state before, letter, inserts after) of the way to a state.
    """
    best: dict[int, tuple] = {}

    def offer(to: int, cost: int, before: int, way: tuple, letter: str) -> None:
        key = (way[0] + cost, way[1], "I" * way[2] + letter)
        if to not in best or key < best[to][0]:
            best[to] = (key, before, letter)

    stays = fault == "truncated"
    for state, way in live:
        offer(state, 3, state, way, "D")
        if fault not in ("blank", "duplicate"):
            offer(NEXT[state], 2 + stays, state, way, "R")
            if role == "s" and state == START:
                offer(SYSTEM, stays, state, way, "K")
            if role and role == {USER: "u", ASSISTANT: "a"}[NEXT[state]]:
                offer(NEXT[state], stays, state, way, "K")
    order = {s: n for n, s in enumerate(sorted(best, key=lambda s: best[s][0][1:]))}
    ways = _closed({s: (best[s][0][0], order[s], 0, s) for s in best})
    least = min(w[0] for w in ways.values())
    kept = {s: w for s, w in sorted(ways.items()) if w[0] <= least + SLACK}
    pointers = tuple((s, (best[w[3]][1], best[w[3]][2], w[2])) for s, w in kept.items())
    return tuple((s, (w[0] - least, w[1], w[2])) for s, w in kept.items()), least, pointers


def last_state(live: tuple) -> int:
    """The state that the cheapest, and of those least, whole way ends in."""
    return min((w, s) for s, w in live if s in (START, ASSISTANT))[1]


def _packed(pointers: tuple) -> int:
    """Backpointers as a number: two bits each for state before, letter and inserts, for each of four states."""
    return sum((before | (LETTERS.index(letter) if letter else 0) << 2 | inserts << 4) << 6 * state for state, (before, letter, inserts) in pointers)


def _unpacked(number: int, state: int) -> tuple[int, str, int]:
    bits = number >> 6 * state
    return bits & 3, LETTERS[bits >> 2 & 3], bits >> 4 & 3


def _letter(role: str) -> str:
    return role[:1]


def _no_turns(conv) -> tuple:
    return (conv, 0, *[None] * 6, 0)


def _edits(conv, decided: Iterable[tuple], seq: int = 0) -> Iterator[tuple]:
    """Rows of EDITS of one conversation, from (turn's row or None, state before, letter, inserts after) in turn order."""
    for row, state, letter, inserts in decided:
        if row is not None:
            turn, role, text, fault = row
            after = {"D": state, "R": NEXT[state]}.get(letter) if letter in "DR" else SYSTEM if _letter(role) == "s" else NEXT[state]
            cost = {"D": 3, "R": 2, "K": 0}[letter] + (letter != "D" and fault == "truncated")
            yield conv, seq, letter, turn, role, NAME[after] if letter == "R" else role, text, fault, cost
            seq, state = seq + 1, after
        for _ in range(inserts):
            state = NEXT[state]
            yield conv, seq, "I", None, None, NAME[state], "", "", 2
            seq += 1


class Conversation:
    """A conversation whose turns come one by one and are held until the last one decides."""

    def __init__(self, conv):
        self.conv, self.live, self.turns, self.pointers = conv, OPEN, [], []

    def add(self, turn, role: str, text: str, fault: str) -> None:
        self.live, _, pointers = step(self.live, _letter(role), fault)
        self.turns.append((turn, role, text, fault))
        self.pointers.append(dict(pointers))

    def end(self) -> list[tuple]:
        if not self.turns:
            return [_no_turns(self.conv)]
        state, decided = last_state(self.live), []
        for row, pointers in zip(reversed(self.turns), reversed(self.pointers), strict=True):
            decided.append((row, *pointers[state]))
            state = pointers[state][0]
        decided.append((None, *dict(FIRST)[state]))
        return list(_edits(self.conv, reversed(decided)))


# --- Spark


def damage(turns: DataFrame) -> DataFrame:
    """The turns with the faults that the query plants, by a checksum of conversation and turn; ``dropped`` rows are gone."""
    key = F.concat_ws(":", F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")), F.coalesce(F.col("turn").cast("string"), F.lit(" ")))
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    rows = read(turns).withColumn("kind", F.crc32(key) % 20)
    rows = rows.withColumns({"text": text, "role": F.when(F.col("kind") == 4, "user").otherwise(F.col("role")), "dropped": F.col("kind") == 0})
    return rows.withColumn("copy", F.explode(F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))).drop("kind", "copy")


def read(turns: DataFrame, *, conv_column: str = "conv_id", turn_column: str = "turn", role_column: str = "role", text_column: str = "text") -> DataFrame:
    """(conv_id, turn, role, text, dropped) of a table of turns."""
    rows = textops.keyed(turns, {"conv_id": conv_column, "turn": turn_column, "role": role_column, "text": text_column})
    space = F.lit(" ")
    return rows.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.coalesce("role", space).alias("role"), F.coalesce("text", space).alias("text"), F.lit(False).alias("dropped"))


def mark(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, fault), dealt by conversation and in turn order; a dropped row has no fault and no text.

    Duplicates are numbered by a window, which sorts on disk: no task holds the texts of a conversation.
    """
    last = F.right(F.rtrim("text", F.lit(BLANKS)), F.lit(1))
    copies = Window.partitionBy("conv_id", "dropped", "role", "text").orderBy("turn")
    fault = F.when(F.col("dropped"), None).when(last == "", "blank").when(F.col("nth") > 1, "duplicate").when(~last.isin(".", "!", "?"), "truncated").otherwise("")
    marked = rows.repartition("conv_id").withColumn("nth", F.row_number().over(copies)).withColumn("fault", fault)
    return marked.sortWithinPartitions("conv_id", "turn", "role", "text", "nth").select("conv_id", "turn", "role", F.when(F.col("dropped"), "").otherwise(F.col("text")).alias("text"), "fault")


def _conversations(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """(conv, row) of each row, the rows of MARKED one by one."""
    for batch in batches:
        for part in textops.slices(batch, 3, 1 << 20):
            yield from zip(part.column(0).to_pylist(), zip(*[part.column(i).to_pylist() for i in range(1, part.num_columns)], strict=True), strict=True)


def _packs(ddl: str, rows: Iterator[tuple], most: int = 2000) -> Iterator[pa.RecordBatch]:
    """Rows as batches of at most ``most`` rows and about 1 MB of text."""
    out, size = [], 0
    for row in rows:
        out.append(row)
        size += sum(len(x) for x in row if isinstance(x, str))
        if len(out) >= most or size >= 1 << 20:
            yield _rows(ddl, out)
            out, size = [], 0
    yield _rows(ddl, out)


def _decide(marked: DataFrame) -> DataFrame:
    """Edits of conversations that a task may hold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def edits() -> Iterator[tuple]:
            now = None
            for conv, (turn, role, text, fault) in _conversations(batches):
                if now is None or now.conv != conv:
                    yield from now.end() if now else ()
                    now = Conversation(conv)
                if fault is not None:
                    now.add(turn, role, text, fault)
            yield from now.end() if now else ()

        yield from _packs(EDITS, edits())

    return marked.mapInArrow(textops.releasing(run), EDITS)


_SPILLED = f"{MARKED}, pos long, pointers long"


def _spill(marked: DataFrame) -> DataFrame:
    """Each row of giant conversations with its place and backpointers; a last row, without a fault, has the last state."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            conv = live = None
            pos = 0
            for own, (turn, role, text, fault) in _conversations(batches):
                if live is None or own != conv:
                    if live is not None:
                        yield conv, None, None, "", None, pos + 1, last_state(live)
                    conv, live, pos = own, OPEN, 0
                if fault is not None:
                    live, _, pointers = step(live, _letter(role), fault)
                    pos += 1
                    yield conv, turn, role, text, fault, pos, _packed(pointers)
            if live is not None:
                yield conv, None, None, "", None, pos + 1, last_state(live)

        yield from _packs(_SPILLED, rows())

    return textops.cut(marked.mapInArrow(textops.releasing(run), _SPILLED))


def _trace(spilled: DataFrame) -> DataFrame:
    """(conv_id, pos, state, letter, inserts) of each row, from the last to the first; without a turn, a null letter."""
    schema = "conv_id long, pos long, state long, letter string, inserts long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            state = None
            for batch in batches:
                for conv, pos, pointers, ends in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                    if ends:
                        state = pointers
                        if pos == 1:
                            yield conv, 0, START, None, 0
                        continue
                    before, letter, inserts = _unpacked(pointers, state)
                    yield conv, pos, before, letter, inserts
                    state = before
                    if pos == 1:
                        yield conv, 0, START, "", dict(FIRST)[state][2]

        yield from _packs(schema, rows())

    compact = spilled.select("conv_id", "pos", "pointers", F.col("fault").isNull().alias("ends"))
    return compact.repartition("conv_id").sortWithinPartitions("conv_id", F.desc("pos")).mapInArrow(textops.releasing(run), schema)


def _decide_giants(marked: DataFrame) -> DataFrame:
    """Edits of giant conversations, in turn order."""
    spilled = _spill(marked)
    traced = textops.cut(_trace(spilled))
    turns = spilled.where("fault IS NOT NULL").select(F.col("conv_id").alias("__conv"), F.col("pos").alias("__pos"), "turn", "role", "text", "fault")
    same = F.col("conv_id").eqNullSafe(F.col("__conv")) & (F.col("pos") == F.col("__pos"))
    whole = traced.join(turns, same, "left").select("conv_id", "turn", "role", "text", "fault", "state", "letter", "inserts", "pos")
    whole = whole.withColumn("text", F.coalesce("text", F.lit(""))).repartition("conv_id").sortWithinPartitions("conv_id", "pos")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def edits() -> Iterator[tuple]:
            seq = 0
            for conv, (turn, role, text, fault, state, letter, inserts, pos) in _conversations(batches):
                seq = 0 if pos == 0 else seq
                if letter is None:
                    yield _no_turns(conv)
                    continue
                for row in _edits(conv, [((turn, role, text, fault) if pos else None, state, letter, inserts)], seq):
                    yield row
                    seq += 1

        yield from _packs(EDITS, edits())

    return whole.mapInArrow(textops.releasing(run), EDITS)


def repair(rows: DataFrame, *, held: int = 4096, held_bytes: int = 32 << 20) -> DataFrame:
    """The edits (EDITS) of every conversation of ``read`` or ``damage``; those of one follow each other in order.

    A deleted turn has its role and text; an inserted one has no turn and no role before.
    """
    size = rows.groupBy("conv_id").agg(F.count("*").alias("n"), F.sum(F.octet_length("text")).alias("bytes"))
    giant = textops.cut(size.where((F.col("n") > held) | (F.col("bytes") > held_bytes)).select(F.col("conv_id").alias("__giant"), F.lit(True).alias("__is")))
    giants = giant.count()
    if not giants:
        return _decide(mark(rows))
    same = F.col("conv_id").eqNullSafe(F.col("__giant"))
    giant = F.broadcast(giant) if giants <= 100_000 else giant  # ids of 8 bytes: 1 MB at most
    split = rows.join(giant, same, "left")
    few = split.where("__is IS NULL").select(*rows.columns)
    return _decide(mark(few)).unionByName(_decide_giants(mark(split.where("__is").select(*rows.columns))))


def digest(edits: DataFrame) -> DataFrame:
    """Faults, cost, letters and a digest of the repaired turns of each conversation, from its edits as ``repair`` orders them."""

    class State:
        def __init__(self, conv):
            self.conv, self.turns, self.low, self.high, self.turn = conv, 0, None, None, None
            self.faults, self.illegal, self.cost, self.role = dict.fromkeys(("blank", "duplicate", "truncated"), 0), 0, 0, None
            self.audit, self.sha, self.any = [], hashlib.sha256(), False

        def add(self, edit: str, turn, before, role: str, text: str, fault: str, cost: int) -> None:
            self.audit.append(edit)
            self.cost += cost
            if edit != "I":
                if fault:
                    self.faults[fault] += 1
                if self.role is not None and self.role + _letter(before) not in ("su", "ua", "au"):
                    self.illegal += 1
                self.role = _letter(before)
                if turn is not None:
                    self.turns += turn != self.turn
                    self.low, self.high, self.turn = turn if self.low is None else self.low, turn, turn
            if edit != "D":
                self.sha.update(("\n" * self.any + f"{role}:{text}").encode())
                self.any = True

        def row(self) -> tuple:
            gaps = 0 if self.low is None else self.high - self.low + 1 - self.turns
            return self.conv, gaps, *self.faults.values(), self.illegal, self.cost, "".join(self.audit), self.sha.hexdigest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            now = None
            for batch in batches:
                for conv, _, edit, *rest in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                    if now is None or now.conv != conv:
                        if now:
                            yield now.row()
                        now = State(conv)
                    if edit is not None:
                        now.add(edit, *rest)
            if now:
                yield now.row()

        yield from _packs(DIGEST, rows())

    return edits.mapInArrow(textops.releasing(run), DIGEST)
