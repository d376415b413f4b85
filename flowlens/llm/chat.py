"""Operator 6: chat formatting by incremental black-box rendering.

A template is any function from turns to text. Nothing is known about its inside: the renderings of
successive turn prefixes are compared. Where one rendering starts with the one before it, the rest is
the new turn's span; where it does not, the template has rewritten history and the conversation is
marked. Inside a span the text's place is found by rendering the last turn with two probe texts and
taking their common prefix and suffix, so that marks and headers stay out of the loss mask.

The bundled template marks turns with ``### role:`` and ``</turn>`` and puts a backslash before every
backslash and control string inside roles and texts, which is undone by dropping one backslash from
each pair. It appends only, so earlier turns never change.

Every prefix is rendered, whatever the length, as a template may rewrite at any of them; the work grows with the square
of the turns. A template may declare that it only appends (``appends_only``), as the bundled one does, which joins what
it makes of each turn. Its conversations of more than CHECKED turns are rendered by prefixes up to there, and later turns
after their predecessor alone, so that the work grows with the turns. The declaration is still checked: each early span
must be the same either way, and the spans put together must equal the rendering of the whole conversation and of each
prefix whose length is CHECKED times a power of two. If any of these comparisons fails, all prefixes are rendered.

Conversations are dealt out by id and streamed in turn order; a task holds one conversation at a
time, the one row that its result needs whole. Defined results: null role or text counts as empty; rows with equal
turn are ordered by role and text, null turns first; repeated rows are turns of their own; rows of null
conversation id form one conversation. Other columns are not read, whatever their names. No rows: no conversations.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Turn = tuple[str, str]
Template = Callable[[list[Turn]], str]

#: Turns up to which every prefix of a conversation is rendered even where the template declares that it only appends.
CHECKED = 32
SPAN = "struct<role:string,start:bigint,end:bigint,text_start:bigint,text_end:bigint>"
SCHEMA = f"conv_id bigint, formatted string, spans array<{SPAN}>, rewrites array<int>"
CONTROL = re.compile(r"\\|###|</turn>")
IN_ROLE = re.compile(r"\\|###|</turn>|:|\n")
ESCAPED = re.compile(r"\\(.)", re.S)
TURN = re.compile(r"### ((?:\\.|[^\\:])*):\n((?:\\.|[^\\])*?)\n</turn>\n", re.S)


def escape(text: str, control: re.Pattern = CONTROL) -> str:
    return control.sub(lambda m: "\\" + m[0], text)


def unescape(text: str) -> str:
    return ESCAPED.sub(r"\1", text)


def appends_only(template: Template) -> Template:
    """Declare that a template never changes what it has made of earlier turns."""
    template.appends_only = True
    return template


@appends_only
def marked_turns(turns: list[Turn]) -> str:
    """The bundled template."""
    return "".join(f"### {escape(role, IN_ROLE)}:\n{escape(text)}\n</turn>\n" for role, text in turns)


def read_turns(formatted: str) -> list[Turn]:
    """Roles and texts of what ``marked_turns`` has written; anything else is an error."""
    out, at = [], 0
    while at < len(formatted):
        m = TURN.match(formatted, at)
        if m is None:
            raise ValueError(f"no turn at character {at}")
        out.append((unescape(m[1]), unescape(m[2])))
        at = m.end()
    return out


def common_prefix(a: str, b: str) -> int:
    return len(os.path.commonprefix([a, b]))


Span = tuple[str, int, int, int, int]


def _step(before: str, turns: list[Turn], template: Template) -> tuple[str, int, int] | None:
    """(what the last turn adds to ``before``, start and end of its text in that); nothing if history is rewritten."""
    now = template(turns)
    if not now.startswith(before):
        return None
    probes = [template([*turns[:-1], (turns[-1][0], p)]) for p in ("a", "b")]
    tail = common_prefix(probes[0][::-1], probes[1][::-1])
    return now[len(before) :], common_prefix(*probes) - len(before), len(now) - tail - len(before)


def by_prefixes(turns: list[Turn], template: Template) -> tuple[str, list[Span], list[int]]:
    """What ``render`` returns, by the rendering of every prefix."""
    before, spans, rewrites = template([]), [], []
    for i, (role, _) in enumerate(turns):
        found = _step(before, turns[: i + 1], template)
        if found is None:
            rewrites.append(i)
            before = template(turns[: i + 1])
        else:
            added, lo, hi = found
            spans.append((role, len(before), len(before) + len(added), len(before) + lo, len(before) + hi))
            before += added
    return before, [] if rewrites else spans, rewrites


def by_neighbours(turns: list[Turn], template: Template, checked: int) -> tuple[str, list[Span], list[int]] | None:
    """What ``render`` returns, later turns rendered after their predecessor alone; nothing if a comparison fails."""
    text, spans, rewrites = by_prefixes(turns[:checked], template)
    if rewrites:
        return None
    parts, size, next_check = [text], len(text), 2 * checked
    for i in range(1, len(turns)):
        found = _step(template(turns[i - 1 : i]), turns[i - 1 : i + 1], template)
        if found is None:
            return None
        added, lo, hi = found
        if i < checked:
            _, start, end, text_start, text_end = spans[i]
            if (text[start:end], text_start - start, text_end - start) != (added, lo, hi):
                return None
            continue
        spans.append((turns[i][0], size, size + len(added), size + lo, size + hi))
        parts.append(added)
        size += len(added)
        if i + 1 in (next_check, len(turns)):
            next_check *= 2
            if template(turns[: i + 1]) != "".join(parts):
                return None
    return "".join(parts), spans, []


def render(turns: list[Turn], template: Template = marked_turns, checked: int = CHECKED) -> tuple[str, list[Span], list[int]]:
    """(formatted text, spans, turns whose rendering changed what stood before).

    A span is (role, start, end, text start, text end). With rewrites, offsets into earlier output
    mean nothing, so that there are no spans then.
    """
    found = by_neighbours(turns, template, checked) if len(turns) > checked and getattr(template, "appends_only", False) else None
    return found or by_prefixes(turns, template)


def _conversations(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[int | None, list[Turn]]]:
    """(id, turns) from rows that are sorted by id."""
    turns: list[Turn] = []
    current: int | None = None
    for batch in batches:
        for key, role, text in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            if turns and key != current:
                yield current, turns
                turns = []
            current = key
            turns.append((role, text))
    if turns:
        yield current, turns


def format_conversations(df: DataFrame, template: Template = marked_turns) -> DataFrame:
    """One row for each conversation: its text, the spans of its turns, and the rewriting turns."""
    rows = df.select(F.col("conv_id").cast("bigint").alias("conv_id"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"), "turn")
    dealt = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").select("conv_id", "role", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("conv_id", pa.int64()), ("formatted", pa.string()), ("spans", pa.list_(pa.struct([("role", pa.string()), *((n, pa.int64()) for n in ("start", "end", "text_start", "text_end"))]))), ("rewrites", pa.list_(pa.int32()))])
        names = ("role", "start", "end", "text_start", "text_end")
        held, size = [], 0
        for key, turns in _conversations(batches):
            text, spans, rewrites = render(turns, template)
            held.append({"conv_id": key, "formatted": text, "spans": [dict(zip(names, s, strict=True)) for s in spans], "rewrites": rewrites})
            size += len(text)
            if size > 4_000_000:
                yield pa.RecordBatch.from_pylist(held, schema=schema)
                held, size = [], 0
        if held:
            yield pa.RecordBatch.from_pylist(held, schema=schema)

    return dealt.mapInArrow(run, SCHEMA)


def read_back(formatted: DataFrame, loss_role: str = "assistant") -> DataFrame:
    """Digests of what the formatted text holds, read from that text and its spans alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                text = row["formatted"]
                turns = read_turns(text)
                whole = "".join(f"{role}\n{said}\n" for role, said in turns)
                loss = "".join(unescape(text[s["text_start"] : s["text_end"]]) for s in row["spans"] if s["role"] == loss_role)
                out.append((row["conv_id"], len(turns), hashlib.sha256(whole.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(), len(text)))
            columns = zip(*out, strict=True) if out else [[]] * 6
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)], names=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

    return formatted.select("conv_id", "formatted", "spans").mapInArrow(run, "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint")
