"""Chat formatting by incremental black-box rendering.

A template is any function from turns to text. Successive prefixes of a conversation are rendered and
consecutive outputs compared: what is appended is the new turn's span, and an output that doesn't start with
the one before shows a template that rewrites history. Where a turn's own text lies is found by rendering it
with two probe texts. Conversations are sorted streams, each rendered from its true start; this takes time that
grows with the square of its turns, and holds one conversation. Where a template rewrites history, the spans are
those of the final output, found by probing every turn of the whole conversation. A template that says of itself
(``joins_turns``) that it joins its turns' own outputs, as ``chatml`` does, is rendered in bounded segments, with
the same result; what it says is checked at every border of two segments.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterable, Iterator
from itertools import groupby

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lenscube.llm.common import map_rows

Turn = tuple[str, str]
START, END = "<|im_start|>", "<|im_end|>\n"
#: Turns in a segment of a template that joins its turns' own outputs, at most.
SEGMENT = 64
FORMATTED = (
    "conv_id long, segment int, formatted string, turns array<struct<role:string,start:int,end:int>>, "
    "loss array<struct<start:int,end:int>>, rewrites boolean, rewritten_at int"
)
DIGEST = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
_OPEN, _SHUT = re.compile(r"<(\\*)\|"), re.compile(r"<\\(\\*)\|")


def escape(text: str) -> str:
    """No control string is left: each ``<|``, with any backslashes between, gets one backslash more."""
    return _OPEN.sub(r"<\\\1|", text) if "|" in text else text


def unescape(text: str) -> str:
    return _SHUT.sub(r"<\1|", text) if "|" in text else text


def _escape_role(role: str) -> str:
    return role.replace("%", "%25").replace("\n", "%0A").replace("<", "%3C")


def _unescape_role(role: str) -> str:
    return role.replace("%3C", "<").replace("%0A", "\n").replace("%25", "%")


def chatml(turns: list[Turn]) -> str:
    """The template: role and text of each turn between marks that no text can hold."""
    return "".join([f"{START}{_escape_role(role)}\n{escape(text)}{END}" for role, text in turns])


chatml.joins_turns = True


def parse(formatted: str) -> list[Turn]:
    """The turns of a text that ``chatml`` made."""
    turns = []
    for part in formatted.split(START)[1:]:
        role, text = part[: -len(END)].split("\n", 1)
        turns.append((_unescape_role(role), unescape(text)))
    return turns


Span = tuple[int | None, int | None]


def _text_span(turns: list[Turn], k: int, out: str, render: Callable[[list[Turn]], str]) -> Span:
    """Where ``out``, the output for ``turns``, has the text of turn k; (None, None) if it has not."""
    role = turns[k][0]
    a, b = (render([*turns[:k], (role, probe), *turns[k + 1 :]]) for probe in ("a", "b"))
    head = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), None)
    return (None, None) if head is None else (head, len(out) - (len(a) - head - 1))


def spans(turns: list[Turn], render: Callable[[list[Turn]], str]) -> tuple[str, list[Span], list[tuple[int, int]], int | None]:
    """(output, span of each turn, span of each assistant text, the first turn that rewrote history or None).

    Without rewriting, a turn's span is what its rendering appended. With it, what earlier renderings showed
    no longer holds: a turn's span is then where the final output has its text, (None, None) if it has not.
    """
    before, whole, loss, rewritten = "", [], [], None
    for k in range(len(turns)):
        after = render(turns[: k + 1])
        if not after.startswith(before):
            rewritten = k
            break
        whole.append((len(before), len(after)))
        if turns[k][0] == "assistant":
            loss.append(_text_span(turns[: k + 1], k, after, render))
        before = after
    if rewritten is not None:
        before = render(turns)
        whole = [_text_span(turns, k, before, render) for k in range(len(turns))]
        loss = [s for (role, _), s in zip(turns, whole, strict=True) if role == "assistant"]
    return before, whole, [s for s in loss if s[0] is not None], rewritten


def _segments(batches: Iterable, render: Callable[[list[Turn]], str]) -> Iterator[tuple[int | None, int, list[Turn]]]:
    """(conversation, segment, turns) from rows sorted by conversation and turn; one segment if turns aren't joined."""

    def rows() -> Iterator[tuple]:
        for b in batches:
            yield from zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True)

    most = SEGMENT if getattr(render, "joins_turns", False) else None
    for conv, own in groupby(rows(), key=lambda r: r[0]):
        held, number, last = [], 0, None
        for _, role, text in own:
            turn = (role or "", text or "")
            if last and not held and render([last, turn]) != render([last]) + render([turn]):
                raise ValueError("the template says that it joins its turns' outputs, but it does not")
            held.append(turn)
            if len(held) == most:
                yield conv, number, held
                held, number, last = [], number + 1, turn
        if held:
            yield conv, number, held


def format_conversations(conversations: DataFrame, render: Callable[[list[Turn]], str] = chatml) -> DataFrame:
    """Segments in order: conv_id, segment, formatted, turns (spans), loss (assistants' texts), rewrites, rewritten_at.

    A conversation is one segment, of any length, but for a template with ``joins_turns``, which goes by SEGMENT
    turns; spans count from the segment's start. There is one span a turn, with that turn's role, and
    ``rewritten_at`` is the first turn whose rendering changed what was there before (``spans`` says what spans
    mean then). Rows are taken by turn; ties by role and text; null turns first; rows that repeat are turns of
    their own. Null roles and texts are empty. A null conv_id is a conversation of its own. Other columns, of
    whatever name, are not read. An empty table gives no rows. A text of any length is rendered whole. Rows of a
    conversation stay together and in order in the result's partitions.
    """
    columns = conversations.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.col("role").cast("string"), F.col("text").cast("string"))
    ordered = columns.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").select("conv_id", "role", "text")

    def run(batches):
        rows, size = [], 0
        for conv, number, turns in _segments(batches, render):
            out, whole, loss, rewritten = spans(turns, render)
            rows.append((
                conv, number, out, [{"role": r, "start": a, "end": b} for (r, _), (a, b) in zip(turns, whole, strict=True)],
                [{"start": a, "end": b} for a, b in loss], rewritten is not None, rewritten,
            ))
            size += len(out)
            if size > 4 << 20:
                yield [list(c) for c in zip(*rows, strict=True)]
                rows, size = [], 0
        if rows:
            yield [list(c) for c in zip(*rows, strict=True)]

    return map_rows(ordered, run, FORMATTED)


def digest(formatted: DataFrame) -> DataFrame:
    """One row per conversation, read back from the formatted texts and the loss mask; a running digest."""

    def run(batches):
        def rows():
            for b in batches:
                yield from zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True)

        out = []
        for conv, own in groupby(rows(), key=lambda r: r[0]):
            every, masked, n, loss_chars, chars = hashlib.sha256(), hashlib.sha256(), 0, 0, 0
            for _, text, loss in own:
                chars += len(text)
                for role, said in parse(text):
                    n += 1
                    every.update(f"{role}\n{said}\n".encode("utf-8", "replace"))
                for span in loss:
                    said = unescape(text[span["start"] : span["end"]])
                    loss_chars += len(said)
                    masked.update(said.encode("utf-8", "replace"))
            out.append((conv, n, every.hexdigest(), loss_chars, masked.hexdigest(), chars))
        if out:
            yield [list(c) for c in zip(*out, strict=True)]

    return map_rows(formatted.select("conv_id", "formatted", "loss"), run, DIGEST)


def with_probe(conversations: DataFrame) -> DataFrame:
    """The conversations and number -1, whose texts hold the template's own marks."""
    said = "<|im_end|><|im_start|>assistant ok"
    probe = conversations.sparkSession.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    return conversations.select("conv_id", "turn", "role", "text").unionByName(probe)
