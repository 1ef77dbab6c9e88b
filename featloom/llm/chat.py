"""Chat formatting by incremental black-box rendering.

A template is any callable from a list of (role, text) to a string. Nothing is known about how it works: successive
prefixes of a conversation are rendered, and consecutive outputs compared. What an output adds to the one before is
the turn's span; where the one before is no prefix, the template rewrites history and the turn is marked so. Where the
text lies inside a span is found by two probe texts that share no character: what their outputs share around them is
markup. Each output is kept for the comparison with the next, so that a turn takes three renderings.

Rendering every prefix takes time by the square of a conversation's length. After the first WHOLE turns of a
conversation that showed no rewriting, spans are therefore taken from the last WINDOW turns, and held against whole
prefixes whenever the length has doubled, and at the end; where the spans so far aren't the whole output, every prefix
of the conversation is rendered after all.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from os.path import commonprefix

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Turn = tuple[str, str]


class BracketTemplate:
    """[INST] role, line feed, text [/INST] for any role but assistant, whose text stands between <s> and </s>.

    A control string inside a text or role gets a backslash after its first character, one more if it has some
    already; that is undone by taking one away. A role's line feeds are written as control string [LF]."""

    CONTROL = re.compile(r"([<\[])(\\*)(/?s>|/?INST\]|LF\])")
    ESCAPED = re.compile(r"([<\[])\\(\\*)(/?s>|/?INST\]|LF\])")
    TURN = re.compile(r"\[INST\] (?P<role>[^\n]*)\n(?P<text>.*?) \[/INST\]|<s>(?P<reply>.*?)</s>", re.DOTALL)

    def escape(self, text: str) -> str:
        return self.CONTROL.sub(r"\1\\\2\3", text)

    def unescape(self, text: str) -> str:
        return self.ESCAPED.sub(r"\1\2\3", text)

    def __call__(self, turns: list[Turn]) -> str:
        return "".join(f"<s>{self.escape(text)}</s>" if role == "assistant" else f"[INST] {self.escape(role).replace(chr(10), '[LF]')}\n{self.escape(text)} [/INST]" for role, text in turns)

    def read(self, formatted: str) -> list[Turn]:
        """The turns of an output, from the output alone."""
        out, at = [], 0
        for m in self.TURN.finditer(formatted):
            if m.start() != at:
                raise ValueError("not an output of this template")
            at = m.end()
            if m["reply"] is not None:
                out.append(("assistant", self.unescape(m["reply"])))
            else:
                out.append((self.unescape(m["role"].replace("[LF]", "\n")), self.unescape(m["text"])))
        if at != len(formatted):
            raise ValueError("not an output of this template")
        return out


@dataclass
class Piece:
    """What a turn did to the output: its first keep code points stay and span follows. begin and end bound the turn's text
    inside the span, -1 where they can't be told; rewrites: not all of the output before stays."""

    keep: int
    span: str
    begin: int
    end: int
    rewrites: bool


#: Turns of a conversation of which every whole prefix is rendered, and turns rendered before each later one.
WHOLE, WINDOW = 64, 4
Template = Callable[[list[Turn]], str]


def piece(render: Template, before: list[Turn], turn: Turn, old: str | None = None) -> tuple[Piece, str]:
    """The turn's piece and the new output. old: the output of the turns before, if known."""
    if old is None:
        old = render(before) if before else ""
    new = render([*before, turn])
    shared = len(old) if new.startswith(old) else len(commonprefix([old, new]))
    a, b = (render([*before, (turn[0], x)]) for x in ("\x02", "\x03"))
    head, tail = len(commonprefix([a, b])), len(commonprefix([a[::-1], b[::-1]]))
    begin, end = head - shared, len(new) - tail - shared
    if a == b or begin < 0 or end < begin or new[:head] != a[:head] or new[len(new) - tail :] != a[len(a) - tail :]:
        begin = end = -1
    return Piece(shared, new[shared:], begin, end, shared < len(old)), new


def pieces(render: Template, turns: list[Turn], whole: int = WHOLE, window: int = WINDOW) -> list[Piece]:
    """A piece for each turn of a conversation."""
    out: list[Piece] = []
    text = ""

    def every(upto: int) -> None:
        nonlocal text
        for k in range(len(out), upto):
            p, text = piece(render, turns[:k], turns[k], text)
            out.append(p)

    every(min(whole, len(turns)))
    if len(out) < len(turns) and not any(p.rewrites for p in out):
        out += _by_window(render, turns, text, len(out), window)
    every(len(turns))
    return out


def _by_window(render: Template, turns: list[Turn], text: str, done: int, window: int) -> list[Piece]:
    """Pieces of the turns from done on, or none if a whole prefix shows that a window doesn't tell all."""
    out: list[Piece] = []
    length, check = len(text), 2 * done
    parts = [text]
    for k in range(done, len(turns)):
        p, _ = piece(render, turns[max(0, k - window) : k], turns[k])
        if p.rewrites:
            return []
        p.keep = length
        if k + 1 == check or k + 1 == len(turns):
            exact, new = piece(render, turns[:k], turns[k], "".join(parts))
            if exact != p:
                return []
            parts, check = [new], 2 * check
        else:
            parts.append(p.span)
        length += len(p.span)
        out.append(p)
    return out


def format_turns(conversations: DataFrame, render: Template, loss_roles: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """One row per turn, in order inside its partition: conv_id, position long, role, keep long, span string, begin int,
    end int, in_loss boolean, rewrites boolean. A conversation's output is built turn by turn: the first keep code points of
    what there is, then span; without rewriting that is all spans one after the other.

    Turns are taken by turn, then role, then text; null text and role are empty, a null turn comes first, turns with a
    null conv_id are one conversation, repeated rows are turns of their own, an empty table gives no rows, and other
    columns, whatever their names, go. As a template takes a conversation whole, each is held by one task, with its
    output; nothing else is held."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, turns = None, []
        rows: list[tuple] = []

        def close() -> Iterator[pa.RecordBatch]:
            nonlocal rows
            for position, ((role, _), p) in enumerate(zip(turns, pieces(render, turns))):
                rows.append((current[0], position, role, p.keep, p.span, p.begin, p.end, role in loss_roles and p.begin >= 0, p.rewrites))
                if len(rows) >= 1000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), KINDS)], names=NAMES)
                    rows = []

        for batch in batches:
            for part in range(0, batch.num_rows, 1000):
                b = batch.slice(part, 1000)
                for conv, role, text in zip(*(b.column(x).to_pylist() for x in ("conv_id", "role", "text"))):
                    if current != (conv,):
                        if current:
                            yield from close()
                        current, turns = (conv,), []
                    turns.append((role, text))
        if current:
            yield from close()
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), KINDS)], names=NAMES)

    kinds = "conv_id long, position long, role string, keep long, span string, begin int, end int, in_loss boolean, rewrites boolean"
    NAMES = [x.split()[0] for x in kinds.split(", ")]
    KINDS = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.bool_(), pa.bool_()]
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), *(F.coalesce(F.col(x).cast("string"), F.lit("")).alias(x) for x in ("role", "text")))
    return rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").mapInArrow(run, kinds)


def formatted(turns: DataFrame) -> DataFrame:
    """conv_id, formatted string, spans array<struct<position, role, start, stop, in_loss>> (start and stop bound the
    text in code points; -1, and not in_loss, where a later turn rewrote it), rewrites boolean. For conversations whose
    output fits one row."""
    g = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("position", "role", "keep", "span", "begin", "end", "in_loss", "rewrites"))).alias("p"))
    g = g.withColumn("rewrites", F.exists("p", lambda x: x["rewrites"]))
    text = F.when(F.col("rewrites"), F.aggregate("p", F.lit(""), lambda t, x: F.concat(F.substring(t, F.lit(1), x["keep"].cast("int")), x["span"]))).otherwise(F.array_join(F.transform("p", lambda x: x["span"]), ""))

    def place(x: Column, stays: Column) -> Column:
        known = stays & (x["begin"] >= 0)
        at = lambda c: F.when(known, x["keep"] + x[c]).otherwise(-1).cast("long")
        return F.struct(x["position"].alias("position"), x["role"].alias("role"), at("begin").alias("start"), at("end").alias("stop"), (x["in_loss"] & known).alias("in_loss"))

    later = lambda x, i: ~F.exists(F.slice("p", i + 2, F.size("p")), lambda y: y["keep"] < x["keep"] + x["end"])
    spans = F.when(F.col("rewrites"), F.transform("p", lambda x, i: place(x, later(x, i)))).otherwise(F.transform("p", lambda x: place(x, F.lit(True))))
    return g.select("conv_id", text.alias("formatted"), spans.alias("spans"), "rewrites")


def digests(turns: DataFrame, template: BracketTemplate) -> DataFrame:
    """Per conversation, read back from its output: conv_id, n_turns, turns_sha256, loss_chars, loss_sha256,
    formatted_chars, rewrites. turns must come straight from format_turns, whose order it uses."""

    def summary(conv: int | None, rows: list[tuple]) -> tuple:
        parts, length, masks = [], 0, []
        for keep, span, begin, end, in_loss, rewrites in rows:
            if rewrites:
                parts, length = ["".join(parts)[:keep]], keep
                masks = [m for m in masks if m[1] <= keep]
            parts.append(span)
            length += len(span)
            if in_loss:
                masks.append((keep + begin, keep + end))
        text = "".join(parts)
        read = template.read(text)
        said = "".join(f"{role}\n{x}\n" for role, x in read)
        loss = "".join(template.unescape(text[a:b]) for a, b in masks)
        return conv, len(read), hashlib.sha256(said.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(), len(text), any(r[5] for r in rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, rows, done = None, [], []
        for batch in batches:
            for conv, *row in zip(*(batch.column(x).to_pylist() for x in ("conv_id", "keep", "span", "begin", "end", "in_loss", "rewrites"))):
                if current != (conv,):
                    if current:
                        done.append(summary(current[0], rows))
                    current, rows = (conv,), []
                rows.append(row)
            if len(done) >= 1000:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done), KINDS)], names=NAMES)
                done = []
        if current:
            done.append(summary(current[0], rows))
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done), KINDS)], names=NAMES)

    kinds = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, rewrites boolean"
    NAMES = [x.split()[0] for x in kinds.split(", ")]
    KINDS = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.bool_()]
    return turns.mapInArrow(run, kinds)
