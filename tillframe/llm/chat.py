"""Chat formatting of heterogeneous records, in DataFrame operations only.

The layout of a record is recognised by a fingerprint: a hash of its nested
field paths. A table of declarative mappings, keyed by fingerprint, says where
the turns are; records of any known layout become canonical turns, which are
written in a ChatML template. Control strings inside texts are escaped, so the
output can be read back without loss.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, StructType

START, END = "<|im_start|>", "<|im_end|>"  # fixed values: the marks of the template
TRAINED = "assistant"

# Roles that layouts use, and the canonical ones; others are kept as they are.
ROLE_NAMES = {"human": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant"}


# --- fingerprints and mappings -------------------------------------------------


def schema_paths(kind: DataType, prefix: str = "") -> list[str]:
    """Dotted paths of the leaves; ``[]`` stands for the elements of an array."""
    if isinstance(kind, StructType):
        return [p for f in kind.fields for p in schema_paths(f.dataType, f"{prefix}.{f.name}" if prefix else f.name)]
    if isinstance(kind, ArrayType):
        return schema_paths(kind.elementType, f"{prefix}[]")
    return [prefix]


def fingerprint(paths: Sequence[str]) -> str:
    """Hash of a set of field paths, whatever their order."""
    return hashlib.sha256("\n".join(sorted(set(paths))).encode()).hexdigest()


@dataclass(frozen=True)
class Mapping:
    """Where a layout keeps its turns.

    ``turns`` names an array and its (role, text) fields; ``parts`` lists
    (role, fields) in order, the fields joined by an empty line, empty ones left
    out; ``rows`` names (conversation, order, role, text) of one row per turn.
    """

    paths: tuple[str, ...]
    turns: tuple[str, str, str] | None = None
    parts: tuple[tuple[str, tuple[str, ...]], ...] = ()
    rows: tuple[str, str, str, str] | None = None


LAYOUTS = {
    "rows": Mapping(("conv_id", "role", "text", "turn"), rows=("conv_id", "turn", "role", "text")),
    "messages": Mapping(("messages[].content", "messages[].role"), turns=("messages", "role", "content")),
    "share": Mapping(("conversations[].from", "conversations[].value"), turns=("conversations", "from", "value")),
    "dialog": Mapping(("dialog[].speaker", "dialog[].text"), turns=("dialog", "speaker", "text")),
    "prompt": Mapping(("completion", "prompt"), parts=(("user", ("prompt",)), ("assistant", ("completion",)))),
    "response": Mapping(("prompt", "response"), parts=(("user", ("prompt",)), ("assistant", ("response",)))),
    "question": Mapping(("answer", "question"), parts=(("user", ("question",)), ("assistant", ("answer",)))),
    "instruction": Mapping(
        ("input", "instruction", "output"), parts=(("user", ("instruction", "input")), ("assistant", ("output",)))
    ),
    "instruction_only": Mapping(
        ("instruction", "output"), parts=(("user", ("instruction",)), ("assistant", ("output",)))
    ),
    "system_instruction": Mapping(
        ("input", "instruction", "output", "system"),
        parts=(("system", ("system",)), ("user", ("instruction", "input")), ("assistant", ("output",))),
    ),
}
BY_FINGERPRINT = {fingerprint(m.paths): name for name, m in LAYOUTS.items()}

TURNS = "array<struct<role: string, text: string>>"


def canonical_role(role: Column) -> Column:
    lower = F.lower(F.trim(role))
    result = role
    for name, canonical in ROLE_NAMES.items():
        result = F.when(lower == name, F.lit(canonical)).otherwise(result)
    return F.coalesce(result, F.lit(""))


def _turn(role: Column, text: Column) -> Column:
    return F.struct(F.coalesce(role, F.lit("")).alias("role"), F.coalesce(text, F.lit("")).alias("text"))


def _mapped(mapping: Mapping, field) -> Column:
    """Turns of a record; ``field(name)`` gives a field of the record."""
    if mapping.turns:
        array, role, text = mapping.turns
        made = F.transform(field(array), lambda t: _turn(canonical_role(t[role]), t[text]))
        return F.coalesce(made, F.array().cast(TURNS))
    turns = []
    for role, fields in mapping.parts:
        filled = F.filter(F.array(*[field(f) for f in fields]), lambda x: x.isNotNull() & (x != ""))
        turns.append((F.lit(role), F.array_join(filled, "\n\n")))
    # A system turn, unlike a question or an answer, is there only if it says something.
    every = F.array(*[_turn(r, t) for r, t in turns])
    return F.filter(every, lambda t: (t["role"] != "system") | (t["text"] != ""))


def layout_of(df: DataFrame, ignore: Sequence[str] = ()) -> str | None:
    """Name of the layout of a table's columns, those in ``ignore`` left out; None if it is unknown."""
    paths = [p for f in df.schema.fields if f.name not in ignore for p in schema_paths(f.dataType, f.name)]
    return BY_FINGERPRINT.get(fingerprint(paths))


def json_layout(record: Column) -> Column:
    """Name of the layout of a JSON text, by the hash of its field paths; null if unknown or not JSON.

    The paths are taken from the record's own keys: of the top level, and of the
    first element of an array of objects.
    """
    keys = F.json_object_keys(record)
    inner = F.transform(
        keys,
        lambda k: F.struct(
            k.alias("key"),
            F.from_json(
                F.call_function("get_json_object", record, F.concat(F.lit("$['"), k, F.lit("'][0]"))), "map<string,string>"
            ).alias("of"),
        ),
    )
    paths = F.flatten(
        F.transform(
            inner,
            lambda e: F.when(e["of"].isNull(), F.array(e["key"])).otherwise(
                F.transform(F.map_keys(e["of"]), lambda k: F.concat(e["key"], F.lit("[]."), k))
            ),
        )
    )
    digest = F.sha2(F.array_join(F.array_sort(F.array_distinct(paths)), "\n"), 256)
    name = F.lit(None).cast("string")
    for print_, layout in BY_FINGERPRINT.items():
        if LAYOUTS[layout].rows is None:
            name = F.when(digest == print_, F.lit(layout)).otherwise(name)
    return name


def json_turns(records: DataFrame, record: str = "record") -> DataFrame:
    """Add ``layout`` and ``turns`` to rows of JSON texts of any known layout.

    A record that is null, not JSON or of an unknown layout has a null layout and
    no turns. Extra fields make another layout: nothing is guessed.
    """
    text = F.col(record)
    named = records.withColumn("layout", json_layout(text))
    turns = F.array().cast(TURNS)
    for name, mapping in LAYOUTS.items():
        if mapping.turns:
            array, role, said = mapping.turns
            one = F.from_json(text, f"struct<`{array}`: array<struct<`{role}`: string, `{said}`: string>>>")
        elif mapping.parts:
            fields = sorted({f for _, fs in mapping.parts for f in fs})
            one = F.from_json(text, f"struct<{', '.join(f'`{f}`: string' for f in fields)}>")
        else:
            continue
        made = _mapped(mapping, lambda f, one=one: one[f])
        turns = F.when(F.col("layout") == name, made).otherwise(turns)
    return named.withColumn("turns", turns)


def turn_rows(df: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text) rows of a table of one row per turn, mapped by its schema's fingerprint.

    Columns beyond the mapping's are left out before the fingerprint is taken, so
    extra columns do not matter as long as the four are there.
    """
    names = [f.name for f in df.schema.fields]
    for layout, mapping in LAYOUTS.items():
        if mapping.rows and layout_of(df, ignore=[n for n in names if n not in mapping.rows]) == layout:
            conv, turn, role, text = mapping.rows
            return df.select(
                F.col(conv).cast("long").alias("conv_id"),
                F.col(turn).cast("long").alias("turn"),
                F.coalesce(F.col(role), F.lit("")).alias("role"),
                F.coalesce(F.col(text), F.lit("")).alias("text"),
            )
    raise ValueError(f"no layout of one row per turn has the columns {names}")


def numbered_turns(df: DataFrame, turns: str = "turns") -> DataFrame:
    """(conv_id, turn, role, text) rows of a table with conv_id and an array of canonical turns."""
    rows = df.select(F.col("conv_id").cast("long").alias("conv_id"), F.posexplode(turns).alias("turn", "t"))
    return rows.select("conv_id", F.col("turn").cast("long").alias("turn"), "t.role", "t.text")


# --- template ------------------------------------------------------------------


def escape(text: Column) -> Column:
    """``<|`` becomes ``<\\|``, and with backslashes between them gets one more: no control string is left."""
    return F.regexp_replace(text, r"<(\\*)\|", r"<\\$1|")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*)\|", r"<$1|")


def escape_role(role: Column) -> Column:
    """A role is one line: backslashes and line breaks are written as two characters."""
    line = F.replace(F.replace(role, F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n"))
    return F.replace(line, F.lit("<|"), F.lit("\\<\\|"))


def unescape_role(role: Column) -> Column:
    line = F.replace(role, F.lit("\\<\\|"), F.lit("<|"))
    parts = F.transform(F.split(line, r"\\\\"), lambda p: F.replace(p, F.lit("\\n"), F.lit("\n")))
    return F.array_join(parts, "\\")


def format_turns(rows: DataFrame) -> DataFrame:
    """(conv_id, formatted, loss_spans) per conversation of ``rows`` (conv_id, turn, role, text).

    Turns are ordered by number, equal numbers by role and text, null numbers
    first. ``loss_spans`` are (start, length) in code points of the texts of the
    assistant turns inside ``formatted``: what a model is trained on. An empty
    text has a span of length 0. Rows without conv_id are one conversation of
    that null id. A conversation is one value of the output, so its rows meet in
    one task; the rest is spread by conversation.
    """
    head = F.concat(F.lit(START), escape_role(F.col("role")), F.lit("\n"))
    pieces = rows.select("conv_id", "turn", "role", "text", head.alias("head"), escape(F.col("text")).alias("body"))
    whole = F.concat("head", "body", F.lit(END + "\n"))
    pieces = pieces.select(
        "conv_id", F.struct("turn", "role", "text").alias("place"), whole.alias("piece"),
        F.length("head").alias("before"), F.length("body").alias("inside"), (F.col("role") == TRAINED).alias("trained"),
    )
    order = Window.partitionBy("conv_id").orderBy("place")
    until = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = pieces.withColumn("at", F.row_number().over(order)).withColumn("end", F.sum(F.length("piece")).over(until))
    start = F.col("end") - F.length("piece") + F.col("before")
    span = F.struct(start.alias("start"), F.col("inside").cast("long").alias("length"))
    grouped = placed.groupBy("conv_id").agg(
        F.sort_array(F.collect_list(F.struct("at", "piece"))).alias("pieces"),
        F.sort_array(F.collect_list(F.when(F.col("trained"), span))).alias("loss_spans"),
    )
    text = F.array_join(F.transform("pieces", lambda p: p["piece"]), "")
    return grouped.select("conv_id", text.alias("formatted"), "loss_spans")


def read_back(formatted: Column) -> Column:
    """The turns of a formatted conversation: no text holds the marks, so they cut it exactly."""
    pieces = F.slice(F.split(formatted, r"<\|im_start\|>"), 2, 1 << 30)

    def turn(piece: Column) -> Column:
        line = F.instr(piece, "\n")
        text = F.substring(piece, line + 1, F.length(piece) - line - len(END + "\n"))
        return _turn(unescape_role(F.substring(piece, F.lit(1), line - 1)), unescape(text))

    return F.transform(pieces, turn)


def loss_text(formatted: Column, spans: Column) -> Column:
    """All text under the loss mask, unescaped span by span."""
    parts = F.transform(spans, lambda s: unescape(F.substring(formatted, (s["start"] + 1).cast("int"), s["length"].cast("int"))))
    return F.array_join(parts, "")
