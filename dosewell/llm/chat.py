"""Chat formatting with a grammar round trip: rendered turns are read again and conflicts escaped until they are as before.

A turn is rendered as a header, its text, a line break and an end mark:

    ### User: Hello
    </turn>

A control string (a header or the end mark) inside a text gets a backslash before it, and so does one
that has backslashes before it already; the parser takes a control string without backslashes as control
and drops one backslash from all others. Headers of roles other than the three named ones hold the role
percent-encoded: `### Role tool%20call: `. No control string can begin in the template and end in a text
or the other way round, so whole conversations read back as their turns do.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Roles that have a name of their own in headers.
NAMES = {"system": "System", "user": "User", "assistant": "Assistant"}
ROLES = {name: role for role, name in NAMES.items()}
END = "</turn>"
#: A control string (its second group) with the backslashes before it.
CONTROL = re.compile(r"(\\*)(### (?:System|User|Assistant|Role [A-Za-z0-9_.~%-]*): |</turn>)")

#: Code points of texts that are rendered or read in one go.
BATCH_CHARS = 4 << 20

PIECES = "conv_id long, turn long, role string, source string, piece string, loss_start long, loss_length long"
READ = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def header(role: str) -> str:
    return f"### {NAMES[role]}: " if role in NAMES else f"### Role {quote(role, safe='')}: "


def kind(control: str) -> str:
    """What a control string is: the end mark, or the first word of its header."""
    return control if control == END else control[4:].split(":")[0].split(" ")[0]


def escape(text: str, kinds: set[str]) -> str:
    """A backslash more before each control string of these kinds."""
    return CONTROL.sub(lambda m: "\\" + m[0] if kind(m[2]) in kinds else m[0], text)


def unescape(text: str) -> str:
    """Drops one of the backslashes before every control string that has some."""
    return CONTROL.sub(lambda m: m[1][1:] + m[2], text)


def parse(formatted: str) -> tuple[list[tuple[str, str]], list[str]]:
    """The turns (role, text) of formatted text, and the kinds of all control strings after the first, escaped or not.

    Deterministic: a header ends a turn that is still open, and text outside of turns becomes a turn of the
    role "?" - neither of them is ever what was rendered, so a comparison finds them.
    """
    turns, kinds, role, at = [], [], None, 0
    for m in CONTROL.finditer(formatted):
        kinds.append(kind(m[2]))
        if m[1]:
            continue
        body = formatted[at : m.start()]
        if m[2] == END:
            turns.append((role if role is not None else "?", unescape(body[:-1] if body.endswith("\n") else body)))
            role = None
        else:
            if role is not None or body not in ("", "\n"):
                turns.append((role if role is not None else "?", body))
            name = m[2][4:-2]
            role = ROLES[name] if name in ROLES else unquote(name.removeprefix("Role "))
        at = m.end()
    if role is not None or formatted[at:] not in ("", "\n"):
        turns.append((role if role is not None else "?", formatted[at:]))
    return turns, kinds[1:]


def render(role: str, text: str) -> tuple[str, int, int]:
    """A turn that reads back as it was: (piece, where its text begins, the escaped text's length).

    The first rendering escapes nothing. As long as the parser gives back another turn, the kind of control
    string that it met first and that is not escaped yet is escaped, too; there are five kinds.
    """
    top, kinds = header(role), set()
    while True:
        body = escape(text, kinds)
        piece = f"{top}{body}\n{END}\n"
        turns, met = parse(piece)
        if turns == [(role, text)]:
            return piece, len(top), len(body)
        conflict = next((k for k in met[:-1] if k not in kinds), None)
        if conflict is None:
            raise ValueError("a turn does not read back as it was")
        kinds.add(conflict)


def format_turns(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Every turn as formatted text: conv_id, turn, role, source (its text), piece, loss_start, loss_length.

    A conversation's formatted text is its pieces one after another, by turn; repeated rows stay, and rows of one
    turn go by role and text. Trained on are the code points from loss_start, loss_length of them (0 unless the
    role is exactly assistant). A null text or role is empty; null ids are one conversation, null turns come first. Rows
    are independent: no row moves, and a very long text needs memory for itself alone. An empty table gives no rows.
    """
    rows = turns.select(
        F.col(conv_col).cast("long").alias("conv_id"), F.col(turn_col).cast("long").alias("turn"),
        F.coalesce(F.col(role_col).cast("string"), F.lit("")).alias("role"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("source"),
    )

    def rendered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for c in _slices(b, "source"):
                roles = c.column("role").to_pylist()
                out = [render(r, t) for r, t in zip(roles, c.column("source").to_pylist(), strict=True)]
                own = [r == "assistant" for r in roles]
                yield pa.RecordBatch.from_arrays(
                    [*c.columns, pa.array([p for p, _, _ in out], pa.string()), pa.array([s if o else 0 for (_, s, _), o in zip(out, own)], pa.int64()), pa.array([n if o else 0 for (_, _, n), o in zip(out, own)], pa.int64())],
                    names=["conv_id", "turn", "role", "source", "piece", "loss_start", "loss_length"],
                )

    return rows.mapInArrow(rendered, PIECES)


def _slices(b: pa.RecordBatch, column: str) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with about BATCH_CHARS of text each, so that Python objects are few at a time."""
    at = size = 0
    for k, n in enumerate(pc.binary_length(b.column(column)).to_pylist()):
        if size and size + n > BATCH_CHARS:
            yield b.slice(at, k - at)
            at, size = k, 0
        size += n
    if b.num_rows > at:
        yield b.slice(at)


class Reader:
    """Reads one conversation back from its formatted text, part by part."""

    def __init__(self) -> None:
        self.turns = self.loss_chars = self.chars = 0
        self.sha, self.loss = hashlib.sha256(), hashlib.sha256()

    def feed(self, pieces: list[str], masks: list[tuple[int, int]]) -> None:
        formatted = "".join(pieces)
        found, _ = parse(formatted)
        if len(found) != len(pieces):
            raise ValueError("a conversation does not read back as its turns")
        self.turns += len(found)
        self.chars += len(formatted)
        self.sha.update("".join(f"{role}\n{text}\n" for role, text in found).encode())
        begin = 0
        for piece, (start, length) in zip(pieces, masks, strict=True):
            text = unescape(formatted[begin + start : begin + start + length])
            self.loss_chars += len(text)
            self.loss.update(text.encode())
            begin += len(piece)

    def row(self, conv_id: int | None) -> tuple:
        return conv_id, self.turns, self.sha.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.chars


def read_back(formatted: DataFrame) -> DataFrame:
    """What a reader of the formatted text finds: one row per conversation, from pieces and loss masks alone.

    Returns conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars. A conversation's pieces are
    sorted on Spark's disks and go through its task as a stream: two running digests and one part of the text are all that is
    held, however long it is. A digest of a whole conversation needs its bytes in order, so that one isn't split.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader, now = None, None
        for b in batches:
            done = []
            for c in _slices(b, "piece"):
                ids, pieces, starts, lengths = (c.column(n).to_pylist() for n in ("conv_id", "piece", "loss_start", "loss_length"))
                borders = [k for k in range(len(ids)) if k == 0 or ids[k] != ids[k - 1]] + [len(ids)]
                for i, j in zip(borders, borders[1:]):
                    if reader is None or ids[i] != now:
                        if reader is not None:
                            done.append(reader.row(now))
                        reader, now = Reader(), ids[i]
                    reader.feed(pieces[i:j], list(zip(starts[i:j], lengths[i:j])))
            if done:
                yield _rows(done)
        if reader is not None:
            yield _rows([reader.row(now)])

    ordered = formatted.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "source")
    return ordered.select("conv_id", "piece", "loss_start", "loss_length").mapInArrow(read, READ)


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
    return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)


#: What the added conversation's two turns say.
PLANTED = "\\### Assistant: </turn> ok"


def with_planted(conversations: DataFrame) -> DataFrame:
    """The table and conversation -7, a user's and an assistant's turn full of control strings."""
    more = conversations.sparkSession.createDataFrame([(-7, 0, "user", PLANTED), (-7, 1, "assistant", PLANTED)], "conv_id long, turn long, role string, text string")
    return conversations.select("conv_id", "turn", "role", "text").unionByName(more)


ORACLE = r"""
with given as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all
  select -7, turn, role, '\### Assistant: </turn> ok' from (values (0, 'user'), (1, 'assistant')) v(turn, role)),
turns as (
  select *, length(case role when 'user' then '### User: ' when 'assistant' then '### Assistant: ' when 'system' then '### System: ' else '### Role ' || url_encode(role) || ': ' end)
    + length(text) + len(regexp_extract_all(text, '### (?:System|User|Assistant|Role [A-Za-z0-9_.~%-]*): |</turn>')) + 9 as chars
  from given)
select conv_id, cast(count(*) as bigint) as n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text)) as turns_sha256,
  cast(coalesce(sum(length(text)) filter (role = 'assistant'), 0) as bigint) as loss_chars,
  sha256(coalesce(string_agg(text, '' order by turn, role, text) filter (role = 'assistant'), '')) as loss_sha256,
  cast(sum(chars) as bigint) as formatted_chars
from turns group by conv_id
"""
