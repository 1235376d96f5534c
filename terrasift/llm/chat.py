"""Chat formatting into budgeted windows.

A turn is rendered as ``### role: text</turn>`` and a newline.  Inside roles and texts a
backslash goes before every backslash, ``#``, ``<`` and ``:``, so no control string can
appear there and removing the backslashes gives the source back.

Windows: running sums of the turns' tokens (words plus the template's OVERHEAD) choose
spans of whole turns within the budget; a turn over the budget has a window of its own,
never cut.  A conversation's first turn, if its role is ``system``, heads every window;
of the turns before the window the last ones within ``history`` tokens are repeated after
it.  The loss mask covers the texts of assistant turns where they are new, so repeated
targets are masked.  A window is one output row: text, loss spans in code points, and how
many leading turns are repeats.

Execution: turns are shuffled by conversation, sorted, and streamed; memory is that of a
window, whatever the length of a conversation.  One conversation is one task's work, as
its digest is a running hash over its turns.

Nulls, ties, repeats: null texts and roles are empty; a null turn comes first; equal turn
numbers are ordered by role and text; repeated rows are turns of their own; a null
conv_id is a conversation; an empty table gives no windows; other columns are not read.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from terrasift.llm.common import prepare

BUDGET, HISTORY, OVERHEAD = 512, 96, 4
_SPECIAL = re.compile(r"[\\#<:]")
_TURN = re.compile(r"### ((?:[^\\:]|\\.)*): ((?:[^\\<]|\\.)*)</turn>\n", re.S)
_ESCAPED = re.compile(r"\\(.)", re.S)
LOSS = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))
WINDOW = pa.struct([("start", pa.int64()), ("end", pa.int64())])


def escape(text: str) -> str:
    return _SPECIAL.sub(r"\\\g<0>", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def render(role: str, text: str) -> tuple[str, int]:
    """The turn as formatted, and where its text begins."""
    head = f"### {escape(role)}: "
    return f"{head}{escape(text)}</turn>\n", len(head)


def parse(formatted: str) -> list[tuple[str, str]]:
    """The turns of a formatted window; an error if anything else is in it."""
    out, at = [], 0
    while at < len(formatted):
        m = _TURN.match(formatted, at)
        if not m:
            raise ValueError(f"not a turn at {at}")
        out.append((unescape(m[1]), unescape(m[2])))
        at = m.end()
    return out


class Windows:
    """Windows of one conversation, turn by turn."""

    def __init__(self, budget: int, history: int) -> None:
        self.budget, self.history = budget, history
        self.system: tuple[str, str, int] | None = None
        self.repeated: list[tuple[str, str, int]] = []
        self.new: list[tuple[str, str, int]] = []
        self.past: list[tuple[str, str, int]] = []
        self.used, self.number = 0, 0

    def add(self, role: str, text: str):
        """The window that this turn closes, if it does."""
        turn = (role, text, len(text.split()) + OVERHEAD)
        closed = None
        if self.new and self.used + turn[2] > self.budget:
            closed = self.close()
            self.repeated = [self.system] if self.system else []
            room = min(self.history, self.budget - turn[2] - sum(t[2] for t in self.repeated))
            kept: list[tuple[str, str, int]] = []
            for old in reversed(self.past):
                room -= old[2]
                if room < 0:
                    break
                kept.append(old)
            self.repeated += kept[::-1]
            self.used = sum(t[2] for t in self.repeated)
        if self.number == 0 and not self.new and closed is None and role == "system":
            self.system = turn
        else:
            self.past.append(turn)
            held = sum(t[2] for t in self.past)
            while len(self.past) > 1 and held > self.history + turn[2]:
                held -= self.past.pop(0)[2]
        self.new.append(turn)
        self.used += turn[2]
        return closed

    def close(self):
        text, spans = [], []
        at = 0
        for i, (role, body, _) in enumerate(self.repeated + self.new):
            shown, head = render(role, body)
            if i >= len(self.repeated) and role == "assistant":
                spans.append({"start": at + head, "end": at + len(shown) - len("</turn>\n")})
            text.append(shown)
            at += len(shown)
        out = (self.number, "".join(text), spans, len(self.repeated))
        self.number, self.new = self.number + 1, []
        return out


def format_windows(turns: DataFrame, budget: int = BUDGET, history: int = HISTORY) -> DataFrame:
    """conv_id, window, text, loss (array of start, end), repeated."""
    prepare(turns.sparkSession)
    schema = turns.select("conv_id").schema.add("window", "long").add("text", "string").add("loss", LOSS).add("repeated", "long")
    rows = turns.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")

    def run(batches):
        conv, windows, kind = None, None, None

        def out(found):
            arrays = [pa.array([c for c, _ in found], kind), *(pa.array([w[i] for _, w in found], t) for i, t in enumerate((pa.int64(), pa.string(), pa.list_(WINDOW), pa.int64())))]
            return pa.RecordBatch.from_arrays(arrays, names=["conv_id", "window", "text", "loss", "repeated"])

        for batch in batches:
            kind, found = batch.column(0).type, []
            for c, role, text in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), batch.column(3), strict=True):
                if windows is None or c != conv:
                    if windows is not None:
                        found.append((conv, windows.close()))
                    conv, windows = c, Windows(budget, history)
                closed = windows.add(role, text.as_py())
                if closed:
                    found.append((conv, closed))
            yield out(found)
        if windows is not None:
            yield out([(conv, windows.close())])

    return rows.mapInArrow(run, schema)


def read_back(windows: DataFrame) -> DataFrame:
    """What the windows hold of each conversation: counts and digests, from the formatted text alone."""
    prepare(windows.sparkSession)
    names = ["n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "n_windows"]
    schema = windows.select("conv_id", *[F.lit("" if "sha" in n else 0).cast("string" if "sha" in n else "long").alias(n) for n in names]).schema
    rows = windows.select("conv_id", "window", "text", "loss", "repeated").repartition("conv_id").sortWithinPartitions("conv_id", "window")

    def run(batches):
        conv, state, kind = None, None, None

        def done():
            n, turns, chars, loss, shown, count = state
            values = ([conv], [n], [turns.hexdigest()], [chars], [loss.hexdigest()], [shown], [count])
            return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(values, (kind, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()), strict=True)], names=["conv_id", *names])

        for batch in batches:
            kind = batch.column(0).type
            for c, text, spans, repeated in zip(batch.column(0).to_pylist(), batch.column(2), batch.column(3).to_pylist(), batch.column(4).to_pylist(), strict=True):
                if state is None or c != conv:
                    if state is not None:
                        yield done()
                    conv, state = c, [0, hashlib.sha256(), 0, hashlib.sha256(), 0, 0]
                shown = text.as_py()
                for role, body in parse(shown)[repeated:]:
                    state[0] += 1
                    state[1].update(f"{role}\n{body}\n".encode())
                for span in spans:
                    target = unescape(shown[span["start"] : span["end"]])
                    state[2] += len(target)
                    state[3].update(target.encode())
                state[4] += len(shown)
                state[5] += 1
        if state is not None:
            yield done()

    return rows.mapInArrow(run, schema)
