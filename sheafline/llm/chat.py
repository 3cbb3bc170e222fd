"""Chat formatting with an exact way back.

The grammar of a formatted conversation:

    conversation: turn*
    turn:         "### " name ": " body "\n</turn>\n"
    name:         User | Assistant | System | a role as a JSON string
    body:         any text in which each control string ("### " or "</turn>") has a backslash before it

In a body, a control string behind k > 0 backslashes stands for one behind k - 1 of
them. A turn is rendered as it is and parsed again; where the parser does not give
back the same role and text, the control strings of the text are escaped and the
turn is parsed once more. Turns are context-free, so what holds for each
holds for the whole conversation, which the reader parses as a whole in the end.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

NAMES = {"user": "User", "assistant": "Assistant", "system": "System"}
#: The role whose texts a model learns from.
LEARNED = "assistant"
#: A conversation longer than this many code points is written in pieces of whole turns.
PIECE = 1 << 20

_ROLES = {name: role for role, name in NAMES.items()}
_HEAD = re.compile(r'### (?:(User|Assistant|System)|("(?:[^"\\]|\\.)*")): ')
_CONTROL = re.compile(r"(\\*)(### |</turn>)")
_END = "\n</turn>\n"


def escape(text: str, level: int) -> str:
    """Level 0 is the text itself; on level 1 each control string gets one more backslash."""
    return _CONTROL.sub(r"\\\1\2", text) if level else text


def parse(rendered: str) -> list[tuple[str, str, int, int]] | None:
    """The turns of a formatted text, as role, text, and where the body starts and ends; None if it does not follow the grammar."""
    turns, at = [], 0
    while at < len(rendered):
        head = _HEAD.match(rendered, at)
        if not head:
            return None
        start = look = head.end()
        text: list[str] = []
        while True:
            control = _CONTROL.search(rendered, look)
            if not control:
                return None
            slashes, mark = control.groups()
            if slashes:
                text += rendered[look : control.start()], slashes[1:], mark
                look = control.end()
                continue
            end = control.start() - 1
            if mark == "### " or end < look or not rendered.startswith(_END, end):
                return None
            text.append(rendered[look:end])
            break
        try:
            role = _ROLES[head[1]] if head[1] else json.loads(head[2], strict=False)
        except ValueError:
            return None
        turns.append((role, "".join(text), start, end))
        at = end + len(_END)
    return turns


def render(role: str, text: str) -> tuple[str, int, int]:
    """One formatted turn from which ``parse`` gives back role and text, and where its body starts and ends."""
    head = f"### {NAMES.get(role) or json.dumps(role, ensure_ascii=False)}: "
    for level in (0, 1):
        turn = head + escape(text, level) + _END
        back = parse(turn)
        if back and len(back) == 1 and back[0][:2] == (role, text):
            return turn, back[0][2], back[0][3]
    raise ValueError("the grammar cannot hold this turn")


_PIECES = "conv_id long, piece long, formatted string, learned array<struct<start:int,end:int>>"


def format_conversations(conversations: DataFrame, longest: int = PIECE) -> DataFrame:
    """The text of each conversation in the grammar of this module, and the parts that a model learns from.

    Returns conv_id, piece (from 0), formatted and learned: start and end, in code
    points within the piece, of each assistant body, as it is written. The pieces of a
    conversation follow each other in their partition, so that a reader may stream them;
    a piece is closed at the first turn that brings it to ``longest`` code points.

    Turns are ordered by turn, a null one first; rows that share a turn by their
    rendered text, so repeated rows all stay. A null text or role is empty. Rows with a
    null conv_id form one conversation, with a null id. An empty table gives no
    rows. Other columns are ignored. Turns are rendered and checked where they
    are read; only rendered turns are shuffled and sorted, and a conversation of any
    length passes through its task as a stream, a piece at a time.
    """

    def turns(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            roles, texts = (batch.column(i).to_pylist() for i in (2, 3))
            made = [render(role or "", text or "") for role, text in zip(roles, texts, strict=True)]
            places = [(start, end) if role == LEARNED else (None, None) for role, (_, start, end) in zip(roles, made, strict=True)]
            columns = [batch.column(0), batch.column(1), pa.array([m[0] for m in made], pa.string()), *(pa.array([p[i] for p in places], pa.int32()) for i in (0, 1))]
            yield pa.RecordBatch.from_arrays(columns, ["conv_id", "turn", "rendered", "start", "end"])

    def joined(batches: Iterator) -> Iterator:
        import pyarrow as pa

        kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
        names = ["conv_id", "piece", "formatted", "learned"]
        empty = True
        conv, piece, length, parts, learned = None, 0, 0, [], []
        for batch in batches:
            done: list[tuple] = []
            for conv_id, _, rendered, start, end in zip(*(column.to_pylist() for column in batch.columns), strict=True):
                if not empty and (conv_id != conv or length >= longest):
                    done.append((conv, piece, "".join(parts), learned))
                    piece = piece + 1 if conv_id == conv else 0
                    length, parts, learned = 0, [], []
                empty, conv = False, conv_id
                if start is not None:
                    learned.append({"start": length + start, "end": length + end})
                parts.append(rendered)
                length += len(rendered)
            if done:
                ids, pieces, texts, places = zip(*done, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(pieces, pa.int64()), pa.array(texts, pa.string()), pa.array(places, kind)], names)
        if not empty:
            yield pa.RecordBatch.from_arrays([pa.array([conv], pa.int64()), pa.array([piece], pa.int64()), pa.array(["".join(parts)], pa.string()), pa.array([learned], kind)], names)

    rows = conversations.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.col("role").cast("string"), F.col("text").cast("string"))
    rendered = rows.mapInArrow(turns, "conv_id long, turn long, rendered string, start int, end int")
    return rendered.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "rendered").mapInArrow(joined, _PIECES)


_READ = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def read_back(pieces: DataFrame) -> DataFrame:
    """What a reader gets out of formatted conversations: a row for each, from the formatted text and its learned parts alone.

    ``pieces`` are as ``format_conversations`` leaves them; saved ones must be
    brought into order by conv_id and piece first. Returns conv_id, n_turns,
    turns_sha256 (of role, line feed, text, line feed of each turn), loss_chars
    and loss_sha256 (code points and digest of the learned texts, unescaped) and
    formatted_chars. Text that does not follow the grammar raises an error, as does
    a learned part that is not the body of a turn.
    """

    def read(batches: Iterator) -> Iterator:
        import pyarrow as pa

        conv, state = None, None

        def rows(done: list) -> pa.RecordBatch:
            columns = list(zip(*((c, n, turns.hexdigest(), chars, loss.hexdigest(), length) for c, n, turns, chars, loss, length in done), strict=True))
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

        for batch in batches:
            done = []
            for conv_id, piece, formatted, learned in zip(*(column.to_pylist() for column in batch.columns), strict=True):
                if state is None or conv_id != conv or piece == 0:
                    if state is not None:
                        done.append((conv, *state))
                    conv, state = conv_id, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                turns = parse(formatted)
                if turns is None:
                    raise ValueError(f"conversation {conv_id} does not follow the grammar")
                bodies = {(start, end): text for _, text, start, end in turns}
                state[0] += len(turns)
                for role, text, _, _ in turns:
                    state[1].update(f"{role}\n{text}\n".encode())
                for place in learned:
                    text = bodies[place["start"], place["end"]]
                    state[2] += len(text)
                    state[3].update(text.encode())
                state[4] += len(formatted)
            if done:
                yield rows(done)
        if state is not None:
            yield rows([(conv, *state)])

    return pieces.select("conv_id", "piece", "formatted", "learned").mapInArrow(read, _READ)


#: A conversation whose texts hold every control string, one of them escaped already.
TRIAL = r"\### Assistant: </turn> ok"


def with_trial(conversations: DataFrame) -> DataFrame:
    """The conversations and one with id -7, a user and an assistant who both say ``TRIAL``."""
    trial = conversations.sparkSession.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(TRIAL).alias("text"))
    return conversations.select("conv_id", "turn", "role", "text").unionByName(trial)


#: The same from the conversations themselves; the length of the formatted text is that of heads, escaped bodies and ends.
SQL = r"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok')
SELECT conv_id, count(*)::BIGINT AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST)) AS turns_sha256,
    coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
    sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
    sum(4 + CASE WHEN role IN ('user', 'assistant', 'system') THEN length(role) ELSE length(to_json(role)::VARCHAR) END + 2 + length(regexp_replace(text, '(\\*)(### |</turn>)', '\\\1\2', 'g')) + 9)::BIGINT AS formatted_chars
FROM c GROUP BY conv_id
"""
