"""Chat formatting in budgeted windows (operator 10).

A conversation's turns, in order, become windows of a token budget. Running (prefix) sums of turn tokens choose spans
aligned with turns; each window opens with the system turn, repeats at most ``history`` tokens of the turns before its
span, and masks what it repeats, so each assistant text is a target once. Where a turn does not fit beside the history,
the oldest repeated turns give way, so a window is above the budget only if the system turn and one more turn alone
are. The template is::

    ### <Role>:\\n<text></turn>\\n

In texts and roles a backslash is doubled, and ``### `` and ``</turn>`` get one before them, so a text can hold no
mark of the template and is read back exactly. Turns are tokenized where they lie; then conversations are dealt by id
and read in turn order as a stream: a task holds the turns of one window, never a whole conversation, so one that has
a third of all rows stays bounded. Its digests run over all its turns in order, so one task has to stream them.

Cases: null text is empty and a null role is the empty role; rows of one (conversation, turn) are ordered by role and
text, repeated rows are turns of their own; a null conversation id is one conversation; a turn above the budget is a
window of its own with what it must repeat; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slotforge.llm import textops
from slotforge.llm.packing import Tokenizer

WINDOW = "conv_id long, window long, n_repeated int, text string, loss_starts array<long>, loss_ends array<long>"
DIGEST = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_windows long"
_CONTROL = re.compile(r"\\|### |</turn>")
_BACK = re.compile(r"\\(\\|### |</turn>)")
#: A turn of the template; marks that a backslash stands before are text.
_TURN = re.compile(r"### ((?:[^\\:]++|\\.)*+):\n((?:[^\\<]++|\\(?:\\|### |</turn>)|<(?!/turn>))*+)</turn>\n", re.DOTALL)


def escape(text: str) -> str:
    return _CONTROL.sub(lambda m: "\\" + m[0], text)


def unescape(text: str) -> str:
    return _BACK.sub(r"\1", text)


def _role_out(role: str) -> str:
    return escape(role).replace(":", "\\:")


def _role_in(role: str) -> str:
    return unescape(role.replace("\\:", ":"))


def render(role: str, text: str) -> tuple[str, int]:
    """(formatted turn, where its text starts)."""
    head = f"### {_role_out(role)}:\n"
    return f"{head}{escape(text)}</turn>\n", len(head)


def parse(text: str) -> list[tuple[str, str, int, int]]:
    """(role, text, start and end of the escaped text) of each turn."""
    out, at = [], 0
    while at < len(text):
        m = _TURN.match(text, at)
        if not m:
            raise ValueError(f"not a turn at {at}")
        end = m.end() - len("</turn>\n")
        start = text.index(":\n", at + 4 + len(m[1])) + 2
        out.append((_role_in(m[1]), unescape(text[start:end]), start, end))
        at = m.end()
    return out


class Writer:
    """Windows of one conversation, from its turns one by one."""

    def __init__(self, conv, budget: int, history: int):
        self.conv, self.budget, self.history = conv, budget, history
        self.system, self.span, self.recent, self.windows = None, [], [], 0
        self.total = self.begin = 0  # prefix sums: of all turns, and where the span begins

    def add(self, role: str, text: str, tokens: int) -> Iterator[dict]:
        if self.span and self._fixed() + self.total + tokens - self.begin > self.budget:
            yield self._close()
        while not self.span and self.recent and self._fixed() + tokens > self.budget:
            self.recent.pop(0)
        self.span.append((role, text, tokens))
        self.total += tokens

    def _repeated(self) -> list[tuple]:
        return ([self.system] if self.system else []) + self.recent

    def _fixed(self) -> int:
        return sum(t[2] for t in self._repeated())

    def end(self) -> Iterator[dict]:
        if self.span:
            yield self._close()

    def _close(self) -> dict:
        out, starts, ends = [], [], []
        repeated, at = self._repeated(), 0
        for k, (role, text, _) in enumerate(repeated + self.span):
            piece, head = render(role, text)
            if role == "assistant" and k >= len(repeated):
                starts.append(at + head)
                ends.append(at + len(piece) - len("</turn>\n"))
            out.append(piece)
            at += len(piece)
        row = {"conv_id": self.conv, "window": self.windows, "n_repeated": len(repeated), "text": "".join(out), "loss_starts": starts, "loss_ends": ends}
        turns = self.span
        if self.windows == 0 and turns[0][0] == "system":
            self.system, turns = turns[0], turns[1:]
        kept, size = [], 0
        for turn in reversed(self.recent + turns):
            size += turn[2]
            if size > self.history:
                break
            kept.append(turn)
        self.recent, self.span, self.begin = kept[::-1], [], self.total
        self.windows += 1
        return row


def format_windows(
    turns: DataFrame, tokenizer_path: str, *, conv_column: str = "conv_id", turn_column: str = "turn", role_column: str = "role",
    text_column: str = "text", ranks_path: str | None = None, budget: int = 1024, history: int = 256,
) -> DataFrame:
    """The windows of every conversation, with the places of their targets; rows of a conversation follow each other."""
    rows = textops.keyed(turns, {"conv_id": conv_column, "turn": turn_column, "role": role_column, "text": text_column})
    rows = rows.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = Tokenizer(tokenizer_path, ranks_path)
        for batch in batches:
            sizes = [len(encode(render(r, t)[0])) // 4 for r, t in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(sizes, pa.int64())], [*batch.schema.names, "tokens"])

    counted = rows.mapInArrow(textops.releasing(count), "conv_id long, turn long, role string, text string, tokens long")
    counted = counted.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer, schema = None, pa.schema([("conv_id", pa.int64()), ("window", pa.int64()), ("n_repeated", pa.int32()), ("text", pa.string()), ("loss_starts", pa.list_(pa.int64())), ("loss_ends", pa.list_(pa.int64()))])
        for batch in batches:
            for part in textops.slices(batch, 3, 1 << 20):
                out = []
                for c, r, t, n in zip(*[part.column(i).to_pylist() for i in (0, 2, 3, 4)], strict=True):
                    if writer is None or writer.conv != c:
                        out += writer.end() if writer else ()
                        writer = Writer(c, budget, history)
                    out += writer.add(r, t, n)
                yield pa.RecordBatch.from_pylist(out, schema)
        if writer:
            yield pa.RecordBatch.from_pylist(list(writer.end()), schema)

    return counted.mapInArrow(textops.releasing(run), WINDOW)


def read_back(windows: DataFrame) -> DataFrame:
    """Digests of each conversation, read from its formatted windows, which lie together and in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [c.split()[0] for c in DIGEST.split(", ")]
        kinds = [pa.string() if "string" in c else pa.int64() for c in DIGEST.split(", ")]
        conv, state = None, None

        def rows(found: list) -> pa.RecordBatch:
            columns = list(zip(*found, strict=True)) or [[]] * len(names)
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

        def done() -> tuple:
            return (conv, state["turns"], state["all"].hexdigest(), state["chars"], state["loss"].hexdigest(), state["formatted"], state["windows"])

        for batch in batches:
            out = []
            for row in batch.to_pylist():
                if state is None or row["conv_id"] != conv:
                    out += [done()] if state else []
                    conv = row["conv_id"]
                    state = {"turns": 0, "all": hashlib.sha256(), "chars": 0, "loss": hashlib.sha256(), "formatted": 0, "windows": 0}
                for role, text, _, _ in parse(row["text"])[row["n_repeated"] :]:
                    state["all"].update(f"{role}\n{text}\n".encode())
                    state["turns"] += 1
                for a, b in zip(row["loss_starts"], row["loss_ends"], strict=True):
                    target = unescape(row["text"][a:b])
                    state["loss"].update(target.encode())
                    state["chars"] += len(target)
                state["formatted"] += len(row["text"])
                state["windows"] += 1
            yield rows(out)
        if state:
            yield rows([done()])

    return windows.mapInArrow(textops.releasing(run), DIGEST)


def with_probe(turns: DataFrame) -> DataFrame:
    """The turns and a conversation -7 whose texts hold the template's own marks."""
    text = r"\### Assistant: </turn> ok"
    probe = turns.sparkSession.createDataFrame([(-7, 0, "user", text), (-7, 1, "assistant", text)], "conv_id long, turn long, role string, text string")
    return turns.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text").union(probe)


def digest(turns: DataFrame, tokenizer_path: str, **options) -> DataFrame:
    return read_back(format_windows(with_probe(turns), tokenizer_path, **options))
