"""Conversations as training text, with each turn's span found by rendering prefixes (operator 12).

A template is a black box, ``render(turns, start)``: the text of a list of (role, text), of which the first
is turn ``start`` of its conversation. Successive prefixes are rendered and consecutive outputs compared: what
the longer one adds is the turn's span. An output that does not begin with the one before has rewritten its
history. Inside a span, the turn rendered with two probes in place of its text shows where the text lies.

A window of at most ``WINDOW`` turns is rendered at a time, and the template is asked for each on its own, so that work
grows with the conversation. The last turn of a window is rendered once more together with the first of the
next; if that differs from both outputs in a row, the template depends on turns further back and counts as rewriting.

Cases: turns are in order of turn (nulls first), then role, then text; a null text or role is an empty one; repeated rows are
turns of their own; rows without a conv_id form a conversation; a conversation without assistant turns has no loss
spans; an empty table gives an empty result; other columns are ignored. A conversation of more than ``LONG`` turns is dealt
to parts of ``LONG`` turns; in it, turns that agree in turn and role are in order of a hash of the text.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from functools import reduce
from itertools import groupby

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parley.llm.ranks import number

WINDOW = 64
LONG = 4096
Turns = list[tuple[str, str]]
Template = Callable[[Turns, int], str]

#: Every ``\``, ``#`` and ``<`` of a text is followed by ``\``, so that it holds neither ``###`` nor ``</turn>``.
_CONTROL = re.compile(r"[\\#<]")
_ESCAPED = re.compile(r"([\\#<:])\\")
_TURN = re.compile(r"### ((?:[^\\#<:]|[\\#<:]\\)*): ((?:[^\\#<]|[\\#<]\\)*)</turn>\n")

SCHEMA = "conv_id long, part long, n_turns long, formatted string, roles array<string>, spans array<array<long>>, loss array<array<long>>, rewrites boolean"


def escape(text: str) -> str:
    return _CONTROL.sub(lambda m: m[0] + "\\", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def marked(turns: Turns, start: int = 0) -> str:
    """The template of the query: ``### role: text</turn>`` and a line end for each turn."""
    return "".join(f"### {escape(role).replace(':', ':' + chr(92))}: {escape(text)}</turn>\n" for role, text in turns)


def read_back(formatted: str) -> Turns:
    """The turns of a text made by ``marked``; anything else is an error."""
    turns, at = [], 0
    while at < len(formatted):
        found = _TURN.match(formatted, at)
        if not found:
            raise ValueError(f"no turn at {at}")
        turns.append((unescape(found[1]), unescape(found[2])))
        at = found.end()
    return turns


def common(a: str, b: str) -> int:
    """Length of the longest common prefix, by bisection over slices."""
    low, high = 0, min(len(a), len(b))
    while low < high:
        middle = (low + high + 1) // 2
        if a[low:middle] == b[low:middle]:
            low = middle
        else:
            high = middle - 1
    return low


def content(render: Template, before: Turns, turn: tuple[str, str], out: str, start: int) -> tuple[int, int] | None:
    """Where the text of the last turn lies in ``out``; None if the probes can't tell."""
    one, two = (render([*before, (turn[0], probe)], start) for probe in ("a", "b"))
    begin = common(one, two)
    tail = len(one) - begin - 1
    if len(one) != len(two) or begin == len(one) or one[begin + 1 :] != two[begin + 1 :] or len(out) < begin + tail:
        return None
    return (begin, len(out) - tail) if out[:begin] == one[:begin] and out[len(out) - tail :] == one[begin + 1 :] else None


def render_window(render: Template, turns: Turns, start: int, loss_roles: tuple[str, ...]) -> tuple[str, list[tuple[int, int]], list[tuple[int, int]], bool]:
    """The text of all turns, each turn's span, the spans of the texts that the loss covers, and whether history was rewritten.

    Spans are those of the output with which a turn came. Where a text can't be located it is the whole turn.
    """
    out, spans, loss, rewrites = render([], start), [], [], False
    for k, turn in enumerate(turns):
        longer = render(turns[: k + 1], start)
        at = common(out, longer)
        rewrites |= at < len(out)
        # The opening that a template gives without any turn belongs to the first.
        spans.append((at if k else 0, len(longer)))
        if turn[0] in loss_roles:
            loss.append(content(render, turns[:k], turn, longer, start) or spans[-1])
        out = longer
    return out, spans, loss, rewrites


def render_conversation(render: Template, turns: Turns, start: int = 0, window: int = WINDOW, loss_roles: tuple[str, ...] = ("assistant",)) -> tuple:
    """formatted, roles, spans, loss spans and ``rewrites`` of some consecutive turns."""
    texts, spans, loss, rewrites, length, last = [], [], [], False, 0, None
    for at in range(0, len(turns), window):
        part = turns[at : at + window]
        out, found, inner, again = render_window(render, part, start + at, loss_roles)
        rewrites |= again
        if last is not None:
            seam = render([last, part[0]], start + at - 1)
            rewrites |= seam != render([last], start + at - 1) + render([part[0]], start + at)
        spans += [[length + a, length + b] for a, b in found]
        loss += [[length + a, length + b] for a, b in inner]
        texts.append(out)
        length, last = length + len(out), part[-1]
    return "".join(texts), [role for role, _ in turns], spans, loss, rewrites


def _runs(batches: Iterator, keys: tuple[str, ...]) -> Iterator[tuple[tuple, Iterator[dict]]]:
    """Consecutive rows that agree in ``keys``, across batches."""
    rows = (row for batch in batches for row in batch.to_pylist())
    return groupby(rows, lambda row: tuple(row[k] for k in keys))


def _batches(rows: Iterator[tuple], schema, size: Callable[[tuple], int]) -> Iterator:
    """Arrow batches of about a megabyte."""
    import pyarrow as pa

    held, total = [], 0
    for row in rows:
        held.append(row)
        total += size(row)
        if total > 1 << 20:
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)
            held, total = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)


def dealt(rows: DataFrame, long: int = LONG) -> list[DataFrame]:
    """conv_id, part, turn, role and text: of conversations that stay whole (part 0) and, if there are any, of those dealt to parts 1, 2, ...

    Only conversations of more than ``long`` turns are numbered and dealt; at most one in ``long`` turns can begin one,
    which bounds the broadcast.
    """
    text, role = F.coalesce(F.col("text"), F.lit("")), F.coalesce(F.col("role"), F.lit(""))
    base = rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text"))
    whole = base.select("conv_id", F.lit(0).cast("long").alias("part"), "turn", "role", "text")
    large = base.groupBy("conv_id").count().where(F.col("count") > long).select(F.col("conv_id").alias("_large"))
    if large.isEmpty():
        return [whole]
    is_large = F.col("conv_id").eqNullSafe(F.col("_large"))
    keyed = base.join(F.broadcast(large), is_large, "left_semi").withColumns({"_c": F.coalesce(F.col("conv_id").cast("string"), F.lit("")), "_h": F.xxhash64("text")})
    placed = number(keyed, ["_c"], ["turn", "role", "_h"], "turns")
    split = placed.select("conv_id", (F.floor(F.col("_pos") / long) + 1).alias("part"), F.col("_pos").alias("turn"), "role", "text")
    return [whole.join(F.broadcast(large), is_large, "left_anti"), split]


def _format(rows: DataFrame, render: Template, window: int, long: int, loss_roles: tuple[str, ...]) -> DataFrame:
    placed = rows.repartition("conv_id", "part").sortWithinPartitions("conv_id", "part", F.col("turn").asc_nulls_first(), "role", "text")

    def run(batches):
        import pyarrow as pa

        spans = pa.list_(pa.list_(pa.int64()))
        schema = pa.schema([("conv_id", pa.int64()), ("part", pa.int64()), ("n_turns", pa.int64()), ("formatted", pa.string()), ("roles", pa.list_(pa.string())), ("spans", spans), ("loss", spans), ("rewrites", pa.bool_())])

        def chats():
            for (conv, part), found in _runs(batches, ("conv_id", "part")):
                turns = [(r["role"], r["text"]) for r in found]
                yield (conv, part, len(turns), *render_conversation(render, turns, max(0, part - 1) * long, window, loss_roles))

        return _batches(chats(), schema, lambda row: 100 + len(row[3]))

    return placed.mapInArrow(run, SCHEMA)


def format_chats(rows: DataFrame, render: Template = marked, window: int = WINDOW, long: int = LONG, loss_roles: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """One row per conversation (or part of a very long one): its text, spans of turns and of what the loss covers, in code points.

    One shuffle, by conversation and part; a task holds one part at a time. ``rewrites`` marks conversations whose template
    changes what it gave for earlier turns: their spans are those of each turn when it came last.
    """
    return reduce(DataFrame.unionByName, (_format(part, render, window, long, loss_roles) for part in dealt(rows, long)))


def digests(rows: DataFrame, long: int = LONG) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256 and formatted_chars, read back from texts made by ``marked``.

    Whole conversations are digested where they were made; the parts of long ones are sorted by conversation and
    digested one after another, one part in memory.
    """

    def run(batches):
        import pyarrow as pa

        schema = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])

        def chats():
            for (conv,), parts in _runs(batches, ("conv_id",)):
                n_turns, loss_chars, formatted_chars, turns_sha, loss_sha = 0, 0, 0, hashlib.sha256(), hashlib.sha256()
                for part in parts:
                    for role, text in read_back(part["formatted"]):
                        n_turns += 1
                        turns_sha.update(f"{role}\n{text}\n".encode())
                    for a, b in part["loss"]:
                        text = unescape(part["formatted"][a:b])
                        loss_chars += len(text)
                        loss_sha.update(text.encode())
                    formatted_chars += len(part["formatted"])
                yield conv, n_turns, turns_sha.hexdigest(), loss_chars, loss_sha.hexdigest(), formatted_chars

        return _batches(chats(), schema, lambda row: 200)

    out = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    formatted = [_format(part, marked, WINDOW, long, ("assistant",)).select("conv_id", "part", "formatted", "loss") for part in dealt(rows, long)]
    placed = [formatted[0], *(part.repartition("conv_id").sortWithinPartitions("conv_id", "part") for part in formatted[1:])]
    return reduce(DataFrame.unionByName, (part.mapInArrow(run, out) for part in placed))
