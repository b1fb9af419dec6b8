"""Chat formatting: layouts are recognised by a fingerprint of their field paths.

A record's nested field paths (``messages[].role``), reduced to those that any
mapping names, sorted and hashed, select a declarative mapping that turns the
record into canonical turns (conv_id, turn, role, text). Fields no mapping names
never change the fingerprint. The schema of a DataFrame gives the layouts that it
holds whole, and each row's non-null paths the one it has (``canonical_turns``); the
same is done for a single JSON record (``turns_of_record``).

The template writes a turn as ``<|im_start|>role\\ntext<|im_end|>\\n``. Inside
roles and texts a backslash becomes two and ``<|`` becomes ``<\\|``; in a role a
line end becomes backslash and n. So a control string in a text never is one in
the output, and the output gives back role and text exactly.

The loss mask covers what assistants say, as escaped: spans of code points in
the piece, so that the text under the mask is each assistant text once.

Null text and null role count as empty. Rows of a conversation follow turn (null
first), then role, then text, so repeated rows have a fixed place. A null conv_id
is a conversation of its own. An empty table gives no pieces. Very long texts are pieces
of that length; no conversation is held as a whole. A table that holds a layout whole
may have columns of any other name, those of other layouts included.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from factloom.llm.common import Rows, prepare, values

START, END = "<|im_start|>", "<|im_end|>"
LOSS_ROLES = ("assistant",)

# layout -> (path of the turns or None, [(role, field) ...]); a role that starts with @ names the field it is read from
MAPPINGS: dict[str, tuple[str | None, list[tuple[str, str]]]] = {
    "rows": (None, [("@role", "text")]),
    "messages": ("messages", [("@role", "content")]),
    "conversations": ("conversations", [("@from", "value")]),
    "prompt_response": (None, [("user", "prompt"), ("assistant", "response")]),
    "prompt_completion": (None, [("user", "prompt"), ("assistant", "completion")]),
    "instruction_output": (None, [("user", "instruction"), ("assistant", "output")]),
    "instruction_input_output": (None, [("user", "instruction"), ("user", "input"), ("assistant", "output")]),
    "system_prompt_response": (None, [("system", "system"), ("user", "prompt"), ("assistant", "response")]),
}
ROLE_NAMES = {"human": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant"}


def _paths_of(layout: str) -> set[str]:
    at, fields = MAPPINGS[layout]
    head = f"{at}[]." if at else ""
    return {head + f for _, f in fields} | {head + r[1:] for r, _ in fields if r.startswith("@")}


def fingerprint(paths: set[str]) -> str:
    return hashlib.sha256("\n".join(sorted(paths)).encode()).hexdigest()[:16]


BY_FINGERPRINT = {fingerprint(_paths_of(name)): name for name in MAPPINGS}
KNOWN_PATHS = set().union(*(_paths_of(name) for name in MAPPINGS))


def layout_of(paths: set[str]) -> str:
    """By the fingerprint of all known paths, else the whole layout of most fields among them."""
    return BY_FINGERPRINT.get(fingerprint(paths & KNOWN_PATHS)) or layouts_in(paths)[0]


def schema_paths(kind: T.DataType, head: str = "") -> set[str]:
    if isinstance(kind, T.StructType):
        return set().union(set(), *(schema_paths(f.dataType, f"{head}.{f.name}" if head else f.name) for f in kind.fields))
    if isinstance(kind, T.ArrayType):
        return schema_paths(kind.elementType, head + "[]")
    return {head}


def record_paths(value: object, head: str = "") -> set[str]:
    if isinstance(value, dict):
        return set().union(set(), *(record_paths(v, f"{head}.{k}" if head else k) for k, v in value.items()))
    if isinstance(value, list):
        return set().union(set(), *(record_paths(v, head + "[]") for v in value))
    return {head}


def turns_of_record(record: dict | str) -> list[tuple[str, str]]:
    """(role, text) of one nested record or its JSON."""
    record = json.loads(record) if isinstance(record, str) else record
    at, fields = MAPPINGS[layout_of(record_paths(record))]
    out = []
    for item in record[at] if at else [record]:
        for role, field in fields:
            if field == "input" and not item.get(field):
                continue
            role = (item.get(role[1:]) or "") if role.startswith("@") else role
            out.append((ROLE_NAMES.get(role, role), item.get(field) or ""))
    return out


def layouts_in(paths: set[str]) -> list[str]:
    """The layouts all of whose fields are among ``paths``, those of most fields first."""
    found = [name for name in MAPPINGS if _paths_of(name) <= paths]
    if not found:
        raise ValueError(f"no mapping for fields {sorted(paths & KNOWN_PATHS)}")
    return sorted(found, key=lambda name: -len(_paths_of(name)))


def row_layout(layouts: list[str]) -> Column:
    """The layout of each row: the first whose fingerprint the row's own non-null fields give.

    A row that is complete in none (a null text, say) takes the first of which it has a field, or the first.
    """
    def shown(name: str) -> list[Column]:
        return [F.when(F.col(f"`{p.split('[]')[0]}`").isNotNull(), F.lit(p)) for p in sorted(_paths_of(name))]

    complete = [F.when(F.substring(F.sha2(F.concat_ws("\n", *shown(n)), 256), 1, 16) == fingerprint(_paths_of(n)), F.lit(n)) for n in layouts]
    partly = [F.when(F.coalesce(*shown(n)).isNotNull(), F.lit(n)) for n in layouts]
    return F.coalesce(*complete, *partly, F.lit(layouts[0]))


def canonical_turns(df: DataFrame) -> DataFrame:
    """Turns of a table in any known layout, or of several, row by row: conv_id, turn, role, text.

    The schema gives the layouts that can occur, and each row's fingerprint its own.
    Other columns play no part, whatever their names. Raises ValueError if no layout is whole.
    """
    names = F.create_map(*(F.lit(x) for pair in ROLE_NAMES.items() for x in pair))
    layouts = layouts_in(schema_paths(df.schema))
    text = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    number = F.col("turn").cast("bigint") if "turn" in df.columns else F.lit(None).cast("bigint")

    def turn_of(item, role, field):
        said = text(item[role[1:]]) if role.startswith("@") else F.lit(role)
        return F.struct(F.coalesce(names[said], said).alias("role"), text(item[field]).alias("text"))

    def turns_in(layout: str) -> Column:
        at, fields = MAPPINGS[layout]
        if layout == "rows":
            return F.array(F.struct(number.alias("turn"), text(F.col("role")).alias("role"), text(F.col("text")).alias("text")))
        if at:
            ((role, field),) = fields
            turns = F.coalesce(F.transform(at, lambda item: turn_of(item, role, field)), F.array().cast("array<struct<role: string, text: string>>"))
        else:
            row = {f: F.col(f"`{f}`") for _, f in fields}
            turns = F.array(*(turn_of(row, r, f).withField("skip", F.lit(f == "input")) for r, f in fields))
            turns = F.filter(turns, lambda t: ~(t["skip"] & (t["text"] == "")))
        return F.transform(turns, lambda t, i: F.struct(i.cast("bigint").alias("turn"), t["role"].alias("role"), t["text"].alias("text")))

    conv = F.col("conv_id").cast("bigint").alias("conv_id")
    if layouts == ["rows"]:
        return df.select(conv, number.alias("turn"), text(F.col("role")).alias("role"), text(F.col("text")).alias("text"))
    said = turns_in(layouts[0]) if len(layouts) == 1 else F.coalesce(*(F.when(row_layout(layouts) == n, turns_in(n)) for n in layouts))
    return df.select(conv, F.explode(said).alias("said")).select("conv_id", "said.turn", "said.role", "said.text")


def escape(text: str) -> str:
    return text.replace("\\", "\\\\").replace("<|", "<\\|")


def escape_role(role: str) -> str:
    return escape(role).replace("\n", "\\n")


_ESCAPED = re.compile(r"\\(.)", re.S)


def unescape(text: str) -> str:
    return _ESCAPED.sub(lambda m: "\n" if m[1] == "n" else m[1], text)


def format_turn(role: str, text: str, loss_roles: tuple[str, ...] = LOSS_ROLES) -> tuple[str, int, int]:
    """The piece of a turn and its span under the loss mask (empty if none), in code points."""
    head, body = f"{START}{escape_role(role)}\n", escape(text)
    spans = (len(head), len(head) + len(body)) if role in loss_roles else (0, 0)
    return f"{head}{body}{END}\n", *spans


def parse_piece(piece: str) -> tuple[str, str]:
    """Role and text of a formatted turn; raises ValueError if it isn't exactly one."""
    if not piece.startswith(START) or not piece.endswith(END + "\n") or piece.count("<|") != 2:
        raise ValueError("not a formatted turn")
    role, _, text = piece[len(START) : -len(END) - 1].partition("\n")
    return unescape(role), unescape(text)


PIECES = "conv_id bigint, piece bigint, formatted string, loss_from bigint, loss_to bigint"


def format_chat(turns: DataFrame) -> DataFrame:
    """A row per turn, in order within its partition: conv_id, piece, formatted, loss_from, loss_to.

    A conversation's sample is its pieces, one after another. One shuffle by
    conv_id; rows stream through in order, no conversation is held as a whole.
    """
    prepare(turns.sparkSession)
    schema = pa.schema([("conv_id", pa.int64()), ("piece", pa.int64()), ("formatted", pa.string()), ("loss_from", pa.int64()), ("loss_to", pa.int64())])

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, current, piece = Rows(schema), (), 0
        for batch in batches:
            for conv_id, role, text in values(batch, "conv_id", "role", "text"):
                piece = piece + 1 if (conv_id,) == current else 0
                current = (conv_id,)
                formatted, lo, hi = format_turn(role, text)
                out.add((conv_id, piece, formatted, lo, hi), len(formatted))
                if out.full():
                    yield out.take()
        yield out.take()

    return turns.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").mapInArrow(write, PIECES)


def read_chat(pieces: DataFrame) -> DataFrame:
    """What the formatted output holds, per conversation: the digests of its turns and of the text under the mask.

    ``pieces`` must be ordered within partitions as ``format_chat`` gives them.
    """
    schema = pa.schema([
        ("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64()),
    ])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, state = Rows(schema), None
        done = lambda s: (s[0], s[1], s[2].hexdigest(), s[3], s[4].hexdigest(), s[5])
        for batch in batches:
            for conv_id, piece, formatted, lo, hi in values(batch, "conv_id", "piece", "formatted", "loss_from", "loss_to"):
                if piece == 0:
                    if state:
                        out.add(done(state))
                    state = [conv_id, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                role, text = parse_piece(formatted)
                under = unescape(formatted[lo:hi])
                state[1] += 1
                state[2].update(f"{role}\n{text}\n".encode())
                state[3] += len(under)
                state[4].update(under.encode())
                state[5] += len(formatted)
                if out.full():
                    yield out.take()
        if state:
            out.add(done(state))
        yield out.take()

    return pieces.mapInArrow(read, "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint")
