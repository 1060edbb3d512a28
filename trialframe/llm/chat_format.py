"""Chat formatting by schema fingerprint.

Layouts of conversation data are registered with the nested field paths they have. The hash of a table's or a JSON record's
known paths selects the declarative mapping (SQL text) to canonical turns. A template then marks the turns. Backslash, ``<``
and ``[`` inside texts are escaped with a backslash, so no text can hold a control string and the text comes back exactly.
The formatted output is kept as one piece per turn, so that no conversation, however long, has to fit into one row.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trialframe.llm.common import stored, text_or_empty

#: name: (field paths, SQL of an array of (role, text) in order). The first layout has one row per turn and needs no array.
LAYOUTS: dict[str, tuple[tuple[str, ...], str]] = {
    "turn_rows": (("conv_id", "turn", "role", "text"), ""),
    "messages": (("conv_id", "messages[].role", "messages[].content"), "transform(messages, m -> struct(m.role as role, m.content as text))"),
    "from_value": (("conv_id", "conversations[].from", "conversations[].value"), "transform(conversations, m -> struct(CASE m.from WHEN 'human' THEN 'user' WHEN 'gpt' THEN 'assistant' ELSE m.from END as role, m.value as text))"),
    "prompt_response": (("conv_id", "prompt", "response"), "array(struct('user' as role, prompt as text), struct('assistant' as role, response as text))"),
    "instruction": (("conv_id", "instruction", "input", "output"), "array(struct('user' as role, concat_ws('\\n\\n', instruction, nullif(input, '')) as text), struct('assistant' as role, output as text))"),
}

#: Opening and closing mark of a turn by role; any other role is named in its opening mark.
MARKS = {"user": ("[INST] ", " [/INST]"), "assistant": ("<answer> ", " </s>"), "system": ("<<SYS>> ", " <</SYS>>")}
OTHER = ("[ROLE ", "] ", " [/ROLE]")
BEGIN = "<s>"
TURN = "conv_id bigint, turn bigint, role string, text string"


def field_paths(kind: T.DataType, at: str = "") -> list[str]:
    """Nested field paths; ``[]`` stands for an array's elements."""
    if isinstance(kind, T.StructType):
        return [p for f in kind.fields for p in field_paths(f.dataType, f"{at}.{f.name}" if at else f.name)]
    if isinstance(kind, T.ArrayType):
        return field_paths(kind.elementType, f"{at}[]")
    return [at]


def fingerprint(paths: list[str] | tuple[str, ...]) -> str:
    """Hash of the paths as a set."""
    return hashlib.sha256("\n".join(sorted(set(paths))).encode()).hexdigest()[:16]


def layout_of(paths: list[str]) -> str:
    """The layout registered for these paths. Unknown paths don't count; if several layouts are contained, the one with most paths."""
    known = {p for need, _ in LAYOUTS.values() for p in need}
    prints = {fingerprint(need): name for name, (need, _) in LAYOUTS.items()}
    own = [p for p in paths if p in known]
    if (hit := prints.get(fingerprint(own))) is not None:
        return hit
    inside = [n for n, (need, _) in LAYOUTS.items() if set(need) <= set(own)]
    if not inside:
        raise ValueError(f"no mapping for the fields {sorted(paths)}")
    return max(inside, key=lambda n: len(LAYOUTS[n][0]))


def _exploded(df: DataFrame, turns: str) -> DataFrame:
    return df.selectExpr("conv_id", f"posexplode({turns}) as (turn, m)").selectExpr(
        "cast(conv_id as bigint) conv_id", "cast(turn as bigint) turn", "cast(m.role as string) role", "cast(m.text as string) text")


def turns_of(df: DataFrame) -> DataFrame:
    """conv_id, turn, role, text of a table in any registered layout; a null or empty array has no turns."""
    name = layout_of(field_paths(df.schema))
    if name == "turn_rows":
        return df.selectExpr("cast(conv_id as bigint) conv_id", "cast(turn as bigint) turn", "cast(role as string) role", "cast(text as string) text")
    return _exploded(df, LAYOUTS[name][1])


def turns_of_json(df: DataFrame, column: str = "record") -> DataFrame:
    """The same for JSON texts whose layouts may differ from row to row.

    Each record's nested paths are read from its variant schema; texts that aren't JSON or have no known layout are left
    out of the turns (``unknown_json`` returns them).
    """
    parsed = df.select(F.col(column).alias("record"), _json_layout(column).alias("layout"))
    out = None
    for name, (need, turns) in LAYOUTS.items():
        schema = _schema_text(need)
        rows = parsed.where(F.col("layout") == name).select(F.from_json("record", schema).alias("r")).select("r.*")
        rows = rows.selectExpr("conv_id", "turn", "role", "text") if name == "turn_rows" else _exploded(rows, turns)
        out = rows if out is None else out.unionByName(rows)
    return out


def unknown_json(df: DataFrame, column: str = "record") -> DataFrame:
    return df.where(_json_layout(column).isNull())


def _json_layout(column: str) -> Column:
    """Name of the layout whose top-level fields and element fields the record has."""
    shape = F.schema_of_variant(F.try_parse_json(F.col(column)))
    out = F.lit(None).cast("string")
    for name, (need, _) in sorted(LAYOUTS.items(), key=lambda x: len(x[1][0])):
        has = F.lit(True)
        for p in need:
            array, _, leaf = p.partition("[].")
            pattern = rf"[<, ]{array}: ARRAY<OBJECT<[^<>]*\b{leaf}: " if leaf else rf"[<, ]{array}: "
            has = has & shape.rlike(pattern)
        out = F.when(has, F.lit(name)).otherwise(out)
    return out


def _schema_text(need: tuple[str, ...]) -> str:
    parts: dict[str, list[str]] = {}
    for p in need:
        array, _, leaf = p.partition("[].")
        parts.setdefault(array, []).extend([leaf] if leaf else [])
    kinds = {"conv_id": "bigint", "turn": "bigint"}
    return ", ".join(f"`{a}` array<struct<{', '.join(f'`{x}`: string' for x in leaves)}>>" if leaves else f"`{a}` {kinds.get(a, 'string')}" for a, leaves in parts.items())


def escaped(c: Column) -> Column:
    return F.regexp_replace(c, r"([\\<\[\]])", r"\\$1")


def formatted(turns: DataFrame) -> DataFrame:
    """conv_id, turn, seq, piece, loss_from, loss_to: a conversation's text is its pieces by (seq, turn, piece).

    Piece 0 is the begin mark, then one piece per turn; the loss span counts code points within its piece and holds an
    assistant's escaped text. Null texts are empty, a null role is the empty role, a null conv_id is a conversation of its own,
    null turns come first; repeated rows are turns of their own; an empty table has no pieces.
    """
    role, text = F.coalesce("role", F.lit("")), escaped(text_or_empty())
    opening = F.concat(F.lit(OTHER[0]), escaped(role), F.lit(OTHER[1]))
    closing = F.lit(OTHER[2])
    for name, (a, b) in MARKS.items():
        opening = F.when(role == name, F.lit(a)).otherwise(opening)
        closing = F.when(role == name, F.lit(b)).otherwise(closing)
    assistant = role == "assistant"
    rows = turns.select(
        "conv_id", "turn", F.lit(1).alias("seq"), F.concat(opening, text, closing).alias("piece"),
        F.when(assistant, F.length(opening)).alias("loss_from"), F.when(assistant, F.length(opening) + F.length(text)).alias("loss_to"))
    none = F.lit(None).cast("int")
    begin = turns.select("conv_id").distinct().select(
        "conv_id", F.lit(None).cast("bigint").alias("turn"), F.lit(0).alias("seq"), F.lit(BEGIN).alias("piece"), none.alias("loss_from"), none.alias("loss_to"))
    return rows.unionByName(begin)


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.S)


def parse_piece(piece: str) -> tuple[str, str]:
    """Role and text of a turn's piece."""
    for role, (a, b) in MARKS.items():
        if piece.startswith(a) and piece.endswith(b):
            return role, unescape(piece[len(a):len(piece) - len(b)])
    head, _, rest = re.split(r"((?<!\\)(?:\\\\)*\] )", piece[len(OTHER[0]):], maxsplit=1)
    mark = piece[len(OTHER[0]) + len(head):]
    slashes = len(mark) - len(mark.lstrip("\\"))
    return unescape(head + mark[:slashes]), unescape(rest[:len(rest) - len(OTHER[2])])


def read_back(pieces: DataFrame) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars from the formatted output alone.

    Conversations are streamed in order through running digests: a task holds one piece at a time, however long the
    conversation is.
    """
    schema = "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint"

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: list[tuple] = []
        key, state = None, None

        def close():
            done.append((key, state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), state[4]))

        def flush():
            cols = list(zip(*done, strict=True)) if done else [()] * 6
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            batch = pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(cols, kinds, strict=True)], names=[x.split()[0] for x in schema.split(", ")])
            done.clear()
            return batch

        for b in batches:
            for conv, seq, piece, a, z in zip(*(b.column(i).to_pylist() for i in range(5)), strict=True):
                if state is None or conv != key:
                    if state is not None:
                        close()
                    key, state = conv, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                state[4] += len(piece)
                if seq:
                    role, text = parse_piece(piece)
                    state[0] += 1
                    state[1].update(f"{role}\n{text}\n".encode())
                    if a is not None:
                        loss = unescape(piece[a:z])
                        state[2] += len(loss)
                        state[3].update(loss.encode())
            yield flush()
        if state is not None:
            close()
        yield flush()

    order = pieces.repartition("conv_id").sortWithinPartitions("conv_id", "seq", "turn", "piece")
    return order.select("conv_id", "seq", "piece", "loss_from", "loss_to").mapInArrow(digest, schema)


def format_and_read(turns: DataFrame) -> DataFrame:
    """Write the formatted pieces to the shared folder and read them back."""
    return read_back(stored(formatted(turns), "chat-formatted"))
