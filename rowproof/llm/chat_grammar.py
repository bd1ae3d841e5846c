r"""Chat formatting by a grammar round trip.

A conversation is rendered by the template below, the text is parsed again by a deterministic parser, and
the turns it recovers are compared with the source; turns that came back differently are escaped, until all
are identical.

    conversation: <s> turn*
    turn:         [SYS] text [/SYS]   |   [INST] text [/INST]   |   " " text </s>   (an assistant's)
                  |   [ROLE] name [TEXT] text [/ROLE]                               (any other role)

with one space between a mark and the text inside (none before </s>).  An escaped text has one backslash
more after the first character of every mark and of every mark with backslashes there, so taking one away
gives the text back.  A mark begins with a character that no mark holds elsewhere and never crosses the
border of a turn, so turns conflict on their own and rounds end after one escape at most.

Rows are shuffled once by conversation and sorted by turn; tasks stream over them.  A conversation comes out
as parts of whole turns, of PART characters or one turn: a task never holds more than a part, even where one
conversation has a third of all rows.  Nearly every conversation is a single part.

Edge cases: a null text or role is empty; turns go by (turn, role, text), nulls first, and repeated rows are
repeated turns; a null conversation id is a conversation of its own; a conversation without rows cannot
occur, an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructField, StructType

#: Marks of the template; assistants' texts stand between a space and END.
BEGIN, END = "<s>", "</s>"
SYSTEM, USER = ("[SYS]", "[/SYS]"), ("[INST]", "[/INST]")
OTHER = ("[ROLE]", "[TEXT]", "[/ROLE]")
MARKS = (BEGIN, END, *SYSTEM, *USER, *OTHER)
#: Characters of a part; a longer conversation has several.
PART = 1 << 20

_MARK = re.compile("(" + "|".join(map(re.escape, MARKS)) + ")")
_LIKE = "|".join(re.escape(m[0]) + r"\\{}" + re.escape(m[1:]) for m in MARKS)
_ESCAPE, _ESCAPED = re.compile(_LIKE.replace("{}", "*")), re.compile(_LIKE.replace("{}", "+"))

Turn = tuple[str, str]


class NotInGrammar(ValueError):
    """The rendered text is not a sentence of the grammar."""


def escape(text: str) -> str:
    return _ESCAPE.sub(lambda m: m[0][0] + "\\" + m[0][1:], text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(lambda m: m[0][0] + m[0][2:], text)


def render_turn(role: str, text: str) -> tuple[str, int]:
    """A turn as rendered, and where in it the text starts (it ends before the closing mark)."""
    if role == "assistant":
        return f" {text}{END}", 1
    if role in ("system", "user"):
        first, last = SYSTEM if role == "system" else USER
        return f"{first} {text} {last}", len(first) + 1
    head = f"{OTHER[0]} {role} {OTHER[1]} "
    return f"{head}{text} {OTHER[2]}", len(head)


def parse(text: str, begins: bool = True) -> list[Turn]:
    """The turns of a rendered text, unescaped.  begins: it starts with BEGIN, as all but later parts do."""
    pieces = _MARK.split(text)  # content, mark, content, mark, ..., content
    at, turns = 0, []

    def mark(wanted: str) -> None:
        nonlocal at
        if at + 1 >= len(pieces) or pieces[at + 1] != wanted:
            raise NotInGrammar(wanted)
        at += 2

    def spaced(after: bool = True) -> str:
        """The text inside a pair of marks."""
        content = pieces[at]
        if not content.startswith(" ") or after and (len(content) < 2 or not content.endswith(" ")):
            raise NotInGrammar("space")
        return unescape(content[1:-1] if after else content[1:])

    if begins:
        if pieces[0]:
            raise NotInGrammar(BEGIN)
        mark(BEGIN)
    while at < len(pieces) - 1:
        if pieces[at]:
            turns.append(("assistant", spaced(after=False)))
            mark(END)
            continue
        opening = pieces[at + 1]
        mark(opening)
        if opening in (SYSTEM[0], USER[0]):
            turns.append(("system" if opening == SYSTEM[0] else "user", spaced()))
            mark(SYSTEM[1] if opening == SYSTEM[0] else USER[1])
        elif opening == OTHER[0]:
            name = spaced()
            mark(OTHER[1])
            turns.append((name, spaced()))
            mark(OTHER[2])
        else:
            raise NotInGrammar(opening)
    if pieces[at]:
        raise NotInGrammar("rest")
    return turns


def _recovered(text: str, begins: bool) -> list[Turn] | None:
    try:
        return parse(text, begins)
    except NotInGrammar:
        return None


def settle(turns: list[Turn], begins: bool = True) -> tuple[str, list[tuple[int, int]], int]:
    """Renders turns so that parsing gives them back: the text, the places of assistants' texts, escaped turns."""
    shown, escaped = list(turns), [False] * len(turns)
    while True:
        pieces, loss, at = [BEGIN] if begins else [], [], len(BEGIN) if begins else 0
        for role, text in shown:
            piece, start = render_turn(role, text)
            if role == "assistant":
                loss.append((at + start, at + start + len(text)))
            pieces.append(piece)
            at += len(piece)
        rendered = "".join(pieces)
        if _recovered(rendered, begins) == turns:
            return rendered, loss, sum(escaped)
        lost = [i for i, t in enumerate(turns) if not escaped[i] and _recovered(render_turn(*t)[0], False) != [t]]
        if not lost:
            raise NotInGrammar("turns conflict with each other")  # excluded by the marks
        for i in lost:
            escaped[i], shown[i] = True, (escape(turns[i][0]), escape(turns[i][1]))


def _stream(df: DataFrame, order: list[str], schema: StructType, each: Callable[[Iterator[tuple]], Iterator[tuple]]) -> DataFrame:
    """Applies a generator over rows to each task's rows, which must have been partitioned and sorted."""
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for b in batches:
                for at in range(0, b.num_rows, 1024):
                    yield from zip(*(c.to_pylist() for c in b.slice(at, 1024).columns))

        def batch(held: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), arrow)], schema=arrow)

        held, size = [], 0
        for row in each(rows()):
            held.append(row)
            size += sum(len(v) for v in row if isinstance(v, str))
            if size >= 4 * PART or len(held) >= 4096:
                yield batch(held)
                held, size = [], 0
        if held:
            yield batch(held)

    return df.select(*order).mapInArrow(run, schema)


def _sorted(df: DataFrame, key: str, *order: str) -> DataFrame:
    return df.repartition(key).sortWithinPartitions(*(F.col(c).asc_nulls_first() for c in (key, *order)))


def format_chat(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", part_chars: int = PART) -> DataFrame:
    """conv, part (from 0), formatted, loss (start and stop of each assistant's text in it), escaped (turns).

    Rows of a conversation stand together in one partition, in order of part.
    """
    slim = rows.select(F.col(conv_col).alias("conv"), F.col(turn_col).alias("turn"), F.col(role_col).alias("role"), F.col(text_col).alias("text"))
    conv = StructField("conv", slim.schema["conv"].dataType)
    schema = StructType([conv, *StructType.fromDDL("part int, formatted string, loss array<struct<start:long,stop:long>>, escaped int").fields])

    def each(source: Iterator[tuple]) -> Iterator[tuple]:
        turns, size, part, now = [], 0, 0, None

        def out() -> tuple:
            text, loss, escaped = settle(turns, part == 0)
            return (now, part, text, [{"start": a, "stop": b} for a, b in loss], escaped)

        for c, role, text in source:
            if turns and (c != now or size >= part_chars):
                yield out()
                part = part + 1 if c == now else 0
                turns, size = [], 0
            now = c
            turns.append((role or "", text or ""))
            size += len(text or "")
        if turns:
            yield out()

    return _stream(_sorted(slim, "conv", "turn", "role", "text"), ["conv", "role", "text"], schema, each)


def chat_digest(formatted: DataFrame) -> DataFrame:
    """Reads format_chat's rows back: conv, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars.

    Turns come from the parser, the loss text from the mask; digests run over the parts one after another.
    formatted must hold each conversation's parts together and in order, as format_chat gives them.
    """
    schema = StructType([formatted.schema["conv"], *StructType.fromDDL("n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long").fields])

    def each(source: Iterator[tuple]) -> Iterator[tuple]:
        now, state = None, None
        for c, part, text, loss in source:
            if part == 0:
                if state:
                    yield (now, state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), state[4])
                now, state = c, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
            for role, said in parse(text, part == 0):
                state[0] += 1
                state[1].update(f"{role}\n{said}\n".encode())
            for span in loss:
                said = unescape(text[span["start"] : span["stop"]])
                state[2] += len(said)
                state[3].update(said.encode())
            state[4] += len(text)
        if state:
            yield (now, state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), state[4])

    return _stream(formatted, ["conv", "part", "formatted", "loss"], schema, each)


def read_chat(formatted: DataFrame) -> DataFrame:
    """The turns that the parser finds: conv, part, position (in the part), role, text."""
    schema = StructType([formatted.schema["conv"], *StructType.fromDDL("part int, position int, role string, text string").fields])

    def each(source: Iterator[tuple]) -> Iterator[tuple]:
        for c, part, text in source:
            for i, (role, said) in enumerate(parse(text, part == 0)):
                yield c, part, i, role, said

    return _stream(formatted, ["conv", "part", "formatted"], schema, each)
