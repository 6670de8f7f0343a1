"""Chat formatting: a finite-state machine over roles emits text segments with loss flags.

The template is data: for each role the marks around a text and whether the text is trained on.
Control strings inside texts are broken by an escape character and come back exactly on reading.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from floodgauge.llm.common import table

#: role: (mark before, mark after, loss on the text); "*" is any other role, named in its mark.
TEMPLATE = {
    "system": ("<<SYS>>\n", "\n<</SYS>>\n", False),
    "user": ("<s>[INST] ", " [/INST]", False),
    "assistant": (" ", "</s>", True),
    "*": ("<<ROLE:{}>>\n", "\n<</ROLE>>\n", False),
}
#: The strings that structure the marks; in a text they are escaped.
CONTROL = tuple(dict.fromkeys(t for before, after, _ in TEMPLATE.values() for t in re.findall(r"<+/?\w+[:>]+|\[/?\w+\]", before + after)))
#: Roles that may follow each state; the first state is "".
TURNS = {"": {"system", "user"}, "system": {"user"}, "user": {"assistant"}, "assistant": {"user"}}
#: What ends the name of a role in its mark.
_NAME_END = TEMPLATE["*"][0].partition("{}")[2]
_ESCAPE = re.compile("|".join([r"\\", *map(re.escape, CONTROL), re.escape(_NAME_END)]))
_UNESCAPE = re.compile(r"\\(\\?)")


def _reader(template: dict[str, tuple[str, str, bool]]) -> tuple[re.Pattern, list[str]]:
    """A pattern of one formatted turn, and the roles of its alternatives: group name_i is the role's
    name in its mark, text_i the text."""
    parts = []
    for i, (before, after, _) in enumerate(template.values()):
        mark = re.escape(before).replace(re.escape("{}"), f"(?P<name_{i}>.*?)")
        parts.append(f"{mark}(?P<text_{i}>.*?){re.escape(after)}")
    return re.compile("|".join(parts), re.S), list(template)


_TURN, _ROLES = _reader(TEMPLATE)
SEGMENTS = "conv_id long, turn_no long, valid boolean, text string, loss boolean"


def escape(text: str) -> str:
    """A backslash is doubled; a control string gets one after its first character."""
    return _ESCAPE.sub(lambda m: "\\\\" if m[0] == "\\" else f"{m[0][0]}\\{m[0][1:]}", text)


def unescape(text: str) -> str:
    return _UNESCAPE.sub(r"\1", text)


def turn_segments(role: str, text: str) -> list[tuple[str, bool]]:
    before, after, loss = TEMPLATE.get(role) if role in TEMPLATE and role != "*" else TEMPLATE["*"]
    before = before.format(escape(role)) if "{}" in before else before
    body = escape(text)
    return [(before, False), (body, True), (after, False)] if loss else [(before + body + after, False)]


def read_turn(formatted: str) -> tuple[str, str]:
    """Role and text of one formatted turn."""
    m = _TURN.fullmatch(formatted)
    if m is None:
        raise ValueError(f"not a turn: {formatted[:80]!r}")
    i = next(i for i in range(len(_ROLES)) if m[f"text_{i}"] is not None)
    return unescape(m[f"name_{i}"]) if _ROLES[i] == "*" else _ROLES[i], unescape(m[f"text_{i}"])


def format_conversations(rows: DataFrame) -> DataFrame:
    """Segments of all conversations, in order within each partition: conv_id, turn_no (from 0),
    valid (the turn order up to here is the machine's), text, loss.

    Null text counts as empty, a null or unknown role gets the general mark and makes the rest of its
    conversation invalid (no row is dropped). Ties and repeated rows of a turn stand in order of role
    and text. Rows of one conversation stream through one task, holding one batch at a time; a very long
    text is one segment, an empty table gives none, other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, state, number, valid, begun = None, "", 0, True, False
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                part, out = batch.slice(at, 2000), []
                for conv_id, role, text in zip(*(part.column(n).to_pylist() for n in ("conv_id", "role", "text"))):
                    if not begun or conv_id != conv:
                        conv, state, number, valid, begun = conv_id, "", 0, True, True
                    role = role or ""
                    valid = valid and role in TURNS.get(state, ())
                    state = role
                    out += [(conv_id, number, valid, t, loss) for t, loss in turn_segments(role, text or "")]
                    number += 1
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.int64(), pa.bool_(), pa.string(), pa.bool_()))], names=["conv_id", "turn_no", "valid", "text", "loss"])

    ordered = rows.select("conv_id", "turn", "role", "text").repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return ordered.mapInArrow(run, SEGMENTS)


class _Fold:
    """Digests of one conversation, fed segment by segment; holds one turn at a time."""

    def __init__(self, conv_id: int | None):
        self.conv_id, self.turns, self.chars, self.loss_chars, self.valid = conv_id, 0, 0, 0, True
        self.all, self.loss, self.number, self.parts = hashlib.sha256(), hashlib.sha256(), None, []

    def add(self, number: int, valid: bool, text: str, loss: bool) -> None:
        if number != self.number:
            self.close()
            self.number = number
        self.parts.append(text)
        self.chars += len(text)
        self.valid = valid
        if loss:
            plain = unescape(text)
            self.loss_chars += len(plain)
            self.loss.update(plain.encode())

    def close(self) -> None:
        if self.number is not None:
            role, text = read_turn("".join(self.parts))
            self.all.update(f"{role}\n{text}\n".encode())
            self.turns += 1
            self.parts = []

    def row(self) -> tuple:
        self.close()
        return self.conv_id, self.turns, self.all.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.chars, self.valid


def read_conversations(segments: DataFrame) -> DataFrame:
    """One row per conversation, from the segments as format_conversations() orders them."""
    schema = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, valid boolean"
    arrow = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.bool_())
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fold: _Fold | None = None
        out: list[tuple] = []
        for batch in batches:
            for conv_id, number, valid, text, loss in zip(*(c.to_pylist() for c in batch.columns)):
                if fold is None or fold.conv_id != conv_id:
                    if fold is not None:
                        out.append(fold.row())
                    fold = _Fold(conv_id)
                fold.add(number, valid, text, loss)
            if len(out) > 2000:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), arrow)], names=names)
                out = []
        if fold is not None:
            out.append(fold.row())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), arrow)], names=names)

    return segments.mapInArrow(run, schema)


#: A conversation of nothing but control strings, kept in the query to show that they survive.
PROBE = "</s>[INST] ok [/INST]"


def op9_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = spark.createDataFrame([(-7, 0, "user", PROBE), (-7, 1, "assistant", PROBE)], "conv_id long, turn long, role string, text string")
    return read_conversations(format_conversations(rows.unionByName(probe)))


_BROKEN = " + ".join(f"(length(text) - length(replace(text, '{c}', ''))) // {len(c)}" for c in CONTROL)
_MARKS = " ".join(f"WHEN '{role}' THEN {len(before) + len(after)}" for role, (before, after, _) in TEMPLATE.items() if role != "*")
_OTHER = len(TEMPLATE["*"][0]) - 2 + len(TEMPLATE["*"][1])
_TRAINED = ", ".join(f"'{role}'" for role, (_, _, loss) in TEMPLATE.items() if loss)
_VALID = " ".join(f"WHEN '{state}' THEN role IN ({', '.join(repr(r) for r in sorted(roles))})" for state, roles in TURNS.items())
SQL = rf"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-7, 0, 'user', '{PROBE}'), (-7, 1, 'assistant', '{PROBE}')),
e AS (
  SELECT *, lag(role, 1, '') OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS last,
         length(replace(text, '\', '\\')) + {_BROKEN} + CASE role {_MARKS} ELSE {_OTHER} + length(role) END AS chars
  FROM c)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(sum(CASE WHEN role IN ({_TRAINED}) THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role IN ({_TRAINED})), '')) AS loss_sha256,
       CAST(sum(chars) AS BIGINT) AS formatted_chars,
       bool_and(CASE last {_VALID} ELSE false END) AS valid
FROM e GROUP BY conv_id
"""
