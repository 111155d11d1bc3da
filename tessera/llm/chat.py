"""Chat formatting with a loss mask, by incremental black-box rendering.

A template is only ever called: successive prefixes of a conversation are rendered and consecutive
outputs compared. What a turn adds is its span; two probes of one character each locate its text in the
span. A template whose output for a longer prefix does not begin with that for the shorter one
rewrites history; such conversations are found and kept apart.

A template may state that a turn depends on few turns before it. Then prefixes start with those turns,
which makes rendering linear, and the statement is put to the proof: the spans must join to what the
template gives for the whole prefix of 1, 2, 4, 8, ... and all turns.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from typing import NamedTuple, Protocol

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import bounded, importable, table, work_path

Turn = tuple[str, str]
#: Characters after which a part of a long conversation is written out; parts end at turns.
PART_CHARS = 1_000_000
FORMATTED = "conv_id long, part long, text string, loss array<struct<start:long,end:long>>, rewritten boolean"


class Template(Protocol):
    """Renders whole conversations. `context` is the number of preceding turns on which a turn's
    output is said to depend; None means all of them, and then every whole prefix is rendered."""

    context: int | None

    def render(self, turns: list[Turn]) -> str: ...


class MarkedTurns:
    """`<turn ROLE>`, line feed, text, `</turn>`, line feed; turns do not depend on each other.

    A backslash goes before every backslash in a text and before the `<` of a control string, so that
    texts come back exactly and can't open or close turns; roles escape every `<` and `>` as well.
    """

    context: int | None = 0

    def render(self, turns: list[Turn]) -> str:
        return "".join(f"<turn {_ROLE.sub(_escaped, role)}>\n{_TEXT.sub(_escaped, text)}</turn>\n" for role, text in turns)

    @staticmethod
    def unescape(text: str) -> str:
        return _ESCAPE.sub(r"\1", text)

    @classmethod
    def parse(cls, text: str) -> Iterator[Turn]:
        """The turns of a rendered text."""
        at = 0
        while at < len(text):
            opened = _OPEN.match(text, at)
            closed = opened and next((m for m in _CLOSE.finditer(text, opened.end()) if m[1] is None), None)
            if not closed:
                raise ValueError(f"no turn at {at}")
            yield cls.unescape(opened[1]), cls.unescape(text[opened.end() : closed.start()])
            at = closed.end()


_escaped = r"\\\g<0>"
_TEXT, _ROLE = re.compile(r"\\|<(?=/?turn)"), re.compile(r"[\\<>]")
_ESCAPE, _OPEN, _CLOSE = re.compile(r"\\(.)", re.S), re.compile(r"<turn ((?:[^\\>]|\\.)*)>\n", re.S), re.compile(r"\\(.)|</turn>\n", re.S)


class Span(NamedTuple):
    """What a turn has added to the output, and where its text lies in that; text_start is -1 if it can't be told."""

    added: str
    text_start: int
    text_end: int


class Renderer:
    """Renders one conversation turn by turn, on prefixes that start `context` turns before, one at least; None: whole ones."""

    def __init__(self, template: Template, context: int | None):
        self.template = template
        self.keep = None if context is None else max(1, context)
        self.window: list[Turn] = []
        self.before = self.opening = template.render([])
        self.rewritten = False

    def add(self, role: str, text: str) -> Span | None:
        """The span of the next turn; None if the template has rewritten what it gave before."""
        after = self._with(role, text)
        span = self._span(after, self._with(role, "x"), self._with(role, "y"))
        self.rewritten |= span is None
        self.window.append((role, text))
        if self.keep is None or len(self.window) <= self.keep:
            self.before = after
        else:
            self.window = self.window[-self.keep :]
            self.before = self.template.render(self.window)
        return span

    def _with(self, role: str, text: str) -> str:
        return self.template.render([*self.window, (role, text)])

    def _span(self, after: str, x: str, y: str) -> Span | None:
        if not after.startswith(self.before):
            return None
        added, x, y = (s[len(self.before) :] for s in (after, x, y))
        start = next((i for i, (a, b) in enumerate(zip(x, y, strict=False)) if a != b), -1)
        end = len(added) - (len(x) - start - 1)
        told = start >= 0 and len(x) == len(y) and start <= end and added[:start] == x[:start] and added[end:] == x[start + 1 :]
        return Span(added, start, end) if told else Span(added, -1, -1)


def format_conversations(
    turns: DataFrame, out: str, template: Template | None = None, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", learn_role: str = "assistant",
) -> None:
    """Writes the formatted conversations with their loss masks as parquet parts to the folder `out`.

    Columns: conv_id, part (from 0), text, loss (spans of the texts of learn_role in the part, in
    order), rewritten. Parts end at turns and are joined by nothing.

    * Turns are ordered by turn, those that tie by role and text; repeated rows are turns each. Nulls
      come first; a null role or text is empty; rows without conv_id are one conversation.
    * A conversation is one task's, which holds its turns and parts until its last turn, as the stated context is put to the
      proof on all of it. Texts may have any length; a turn is rendered as a whole.
    * Where a stated context proves wrong, whenever that is, all whole prefixes of the conversation are rendered.
    * Of a template that rewrites history only the last rendering of the conversation is written, as
      one part without a mask, rewritten set. A text that can't be located in its span has no mask.
    * An empty table gives no parts; other columns are not read.
    """
    importable(turns.sparkSession)
    template = template or MarkedTurns()
    names = ("conv_id", "role", "text")
    rows = turns.select(F.col(conv_col).cast("bigint").alias("conv_id"), F.col(turn_col).cast("bigint").alias("turn"), *(F.col(c).alias(n) for c, n in ((role_col, "role"), (text_col, "text"))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        chars = 0
        for row in _formatted(_rows(batches, names), template, learn_role):
            held.append(row)
            chars += len(row[2])
            if chars >= PART_CHARS:
                yield _parts(held)
                held, chars = [], 0
        if held:
            yield _parts(held)

    ordered = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    ordered.mapInArrow(bounded(run), FORMATTED).write.parquet(out)


def _rows(batches: Iterator[pa.RecordBatch], names: tuple[str, ...]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(batch.column(n).to_pylist() for n in names), strict=True)


def _parts(rows: list[tuple]) -> pa.RecordBatch:
    loss = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    types = {"conv_id": pa.int64(), "part": pa.int64(), "text": pa.string(), "loss": loss, "rewritten": pa.bool_()}
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types.values(), strict=True)], list(types))


class _Conversation:
    """The parts of one conversation, as its turns come in."""

    def __init__(self, conv_id: int | None, template: Template, learn_role: str):
        self.conv_id, self.template, self.learn_role = conv_id, template, learn_role
        self.turns: list[Turn] = []
        self._start(template.context)

    def _start(self, context: int | None) -> None:
        self.context, self.renderer = context, Renderer(self.template, context)
        self.parts: list[tuple[str, list[dict]]] = []  # complete ones
        self.texts, self.loss, self.size = [self.renderer.opening], [], len(self.renderer.opening)

    def add(self, role: str, text: str) -> None:
        self.turns.append((role, text))
        self._render(role, text)
        n = len(self.turns)
        if self.context is not None and (self.renderer.rewritten or not n & (n - 1)):
            self._prove()

    def _render(self, role: str, text: str) -> None:
        if span := self.renderer.add(role, text):
            if role == self.learn_role and span.text_start >= 0:
                self.loss.append({"start": self.size + span.text_start, "end": self.size + span.text_end})
            self.texts.append(span.added)
            self.size += len(span.added)
        if self.size >= PART_CHARS:
            self.parts.append(("".join(self.texts), self.loss))
            self.texts, self.loss, self.size = [], [], 0

    def _prove(self) -> None:
        """Holds all joined spans against the whole prefix, and renders all whole prefixes if they differ."""
        if self.renderer.rewritten or "".join([*(text for text, _ in self.parts), *self.texts]) != self.template.render(self.turns):
            self._start(None)
            for turn in self.turns:
                self._render(*turn)

    def close(self) -> Iterator[tuple]:
        if self.context is not None:
            self._prove()
        if self.renderer.rewritten:
            yield self.conv_id, 0, self.renderer.before, [], True
            return
        if self.texts:
            self.parts.append(("".join(self.texts), self.loss))
        for part, (text, loss) in enumerate(self.parts):
            yield self.conv_id, part, text, loss, False


def _formatted(turns: Iterator[tuple], template: Template, learn_role: str) -> Iterator[tuple]:
    """Parts of all conversations of a sorted stream of (conv_id, role, text)."""
    now = None
    for conv_id, role, text in turns:
        if now is None or conv_id != now.conv_id:
            if now:
                yield from now.close()
            now = _Conversation(conv_id, template, learn_role)
        now.add(role or "", text or "")
    if now:
        yield from now.close()


def digest_formatted(spark: SparkSession, out: str, template: type[MarkedTurns] = MarkedTurns) -> DataFrame:
    """Parses what format_conversations() has written: per conversation the digests of its turns and of the text under its mask."""
    importable(spark)
    schema = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    names = [c.split()[0] for c in schema.split(", ")]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, conv, state = [], None, None

        def total() -> tuple:
            n, turns, loss_chars, loss, chars = state
            return conv, n, turns.hexdigest(), loss_chars, loss.hexdigest(), chars

        for conv_id, text, loss in _rows(batches, ("conv_id", "text", "loss")):
            if state is None or conv_id != conv:
                if state:
                    rows.append(total())
                conv, state = conv_id, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
            for role, said in template.parse(text):
                state[0] += 1
                state[1].update(f"{role}\n{said}\n".encode())
            for span in loss:
                learnt = template.unescape(text[span["start"] : span["end"]])
                state[2] += len(learnt)
                state[3].update(learnt.encode())
            state[4] += len(text)
            if len(rows) >= 5000:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)
                rows = []
        if state:
            rows.append(total())
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    parts = spark.read.schema(FORMATTED).parquet(out)
    return parts.select("conv_id", "part", "text", "loss").repartition("conv_id").sortWithinPartitions("conv_id", "part").mapInArrow(bounded(run), schema)


#: A conversation that says the control strings themselves.
CONTROL_TEXT = r"\### Assistant: </turn> ok"


def op4_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Formats all conversations and one of control strings, and reads the output back."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    control = spark.range(2).select(F.lit(-7).cast("bigint").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(CONTROL_TEXT).alias("text"))
    out = work_path(spark, "chat")
    format_conversations(turns.unionByName(control), out)
    return digest_formatted(spark, out)


OP4_SQL = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
), e AS (
  SELECT *, replace(replace(replace(text, '\', '\\'), '<turn', '\<turn'), '</turn', '\</turn') AS shown,
         replace(replace(replace(role, '\', '\\'), '<', '\<'), '>', '\>') AS shown_role
  FROM t
)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
       sha256(string_agg(CASE WHEN role = 'assistant' THEN text ELSE '' END, '' ORDER BY turn, role, text)) AS loss_sha256,
       CAST(sum(length(shown) + length(shown_role) + 16) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id
"""
