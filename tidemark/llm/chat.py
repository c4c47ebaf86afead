"""Chat formatting: layouts told apart by a fingerprint of their nested field paths, one template for all.

A layout is a declarative mapping: the field paths it is known by, and where its turns are. The paths of
a record, less those that no layout knows (ids, names and the like), are hashed, and the hash picks the
mapping that makes turns of it. Records come as a table with a row for each turn (one fingerprint, from
its schema) or as JSON strings (one for each row, from the record itself). The template marks turns with
control strings; where a text holds such a string, a backslash is put into it, and reading takes it out
again.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import materialize

#: Fixed values of the template.
START, END, LINE = "<|im_start|>", "<|im_end|>", "\n"
LOSS_ROLE = "assistant"


@dataclass(frozen=True)
class Layout:
    """paths: nested fields below the record, [] for array items. Turns are the items of ``items`` (with
    the fields ``role`` and ``text``), the fixed list ``turns`` of (role, path), or, in a table with a row
    for each turn, the columns ``row`` (conversation, turn, role, text)."""

    name: str
    paths: tuple[str, ...]
    items: str = ""
    role: str = ""
    text: str = ""
    turns: tuple[tuple[str, str], ...] = ()
    roles: dict[str, str] = field(default_factory=dict)
    row: tuple[str, ...] = ()


def _items(name: str, items: str, role: str, text: str, roles: dict[str, str] | None = None) -> Layout:
    return Layout(name, (f"{items}[]", f"{items}[].{role}", f"{items}[].{text}"), items=items, role=role, text=text, roles=roles or {})


def _fixed(name: str, *turns: tuple[str, str]) -> Layout:
    return Layout(name, tuple(p for _, p in turns), turns=turns)


def _rows(name: str, *columns: str) -> Layout:
    return Layout(name, columns, row=columns)


LAYOUTS = [
    _items("messages", "messages", "role", "content"),
    _items("turns", "turns", "role", "text"),
    _items("from_value", "conversations", "from", "value", {"human": "user", "gpt": "assistant"}),
    _fixed("instruction", ("user", "instruction"), ("assistant", "output")),
    _fixed("instruction_input", ("user", "instruction"), ("user", "input"), ("assistant", "output")),
    _fixed("prompt_completion", ("user", "prompt"), ("assistant", "completion")),
    _fixed("prompt_response", ("user", "prompt"), ("assistant", "response")),
    _fixed("system_prompt_response", ("system", "system"), ("user", "prompt"), ("assistant", "response")),
    _fixed("question_answer", ("user", "question"), ("assistant", "answer")),
]
ROW_LAYOUTS = [
    _rows("rows", "conv_id", "turn", "role", "text"),
    _rows("message_rows", "conversation_id", "message_index", "role", "content"),
    _rows("speaker_rows", "dialogue_id", "position", "speaker", "utterance"),
]


def fingerprint(paths: tuple[str, ...] | list[str]) -> str:
    return hashlib.sha256("\n".join(sorted(paths)).encode()).hexdigest()


def schema_paths(schema: T.DataType, at: str = "") -> list[str]:
    """Nested field paths of a type, down to what is neither struct nor array."""
    if isinstance(schema, T.StructType):
        return [p for f in schema for p in schema_paths(f.dataType, f"{at}.{f.name}" if at else f.name)]
    if isinstance(schema, T.ArrayType):
        return schema_paths(schema.elementType, f"{at}[]")
    return [at]


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\|", r"<\\$1|")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*)\|", r"<$1|")


def _escape_role(role: Column) -> Column:
    return escape(F.regexp_replace(F.regexp_replace(role, r"\\", r"\\\\"), "\n", r"\\n"))


def _unescape_role(role: Column) -> Column:
    """Undoes the pair in one pass from the left: halves of the text between doubled backslashes hold only line marks."""
    parts = F.split(unescape(role), r"\\\\")
    return F.array_join(F.transform(parts, lambda p: F.regexp_replace(p, r"\\n", "\n")), "\\")


def _known_paths(layouts: list[Layout]) -> list[str]:
    return sorted({p for layout in layouts for p in layout.paths})


def _has(path: str) -> Column:
    """Whether the record v (a variant) has a path of at most one array."""
    if not path.endswith("[]") and "[]." not in path:
        return F.expr(f"variant_get(v, '$.{path}') IS NOT NULL")
    outer, _, inner = path.partition("[]")
    items = f"try_variant_get(v, '$.{outer}', 'array<variant>')"
    return F.expr(f"{items} IS NOT NULL" if not inner else f"exists({items}, x -> variant_get(x, '${inner}') IS NOT NULL)")


def _turns_by(layout: Layout) -> Column:
    turn = "struct(cast({n} as long) as turn, {role} as role, {text} as text)"
    if layout.items:
        role = f"try_variant_get(x, '$.{layout.role}', 'string')"
        for name, said in layout.roles.items():
            role = f"if({role} = '{name}', '{said}', {role})"
        text = f"try_variant_get(x, '$.{layout.text}', 'string')"
        return F.expr(f"transform(try_variant_get(v, '$.{layout.items}', 'array<variant>'), (x, i) -> {turn.format(n='i', role=role, text=text)})")
    return F.expr("array(" + ", ".join(turn.format(n=i, role=f"'{r}'", text=f"try_variant_get(v, '$.{p}', 'string')") for i, (r, p) in enumerate(layout.turns)) + ")")


def records_to_turns(records: DataFrame, id_col: str, json_col: str) -> DataFrame:
    """conv_id, turn, role, text, layout of JSON records, each by the layout with the fingerprint of its field paths.

    Fields that no layout knows do not count. Where the fields known are those of no layout alone, the
    first layout that has all of its fields in the record is taken. A list without items, which shows no
    fields below it, gives no turns: its conversation is one row with its layout and no turn. So is, with
    layout null, a record that is null, is no JSON object or fits no layout, so no record is lost
    unseen. Missing texts are null.
    """
    paths = _known_paths(LAYOUTS)
    parsed = records.select(F.col(f"`{id_col}`").alias("conv_id"), F.try_parse_json(F.col(f"`{json_col}`").cast("string")).alias("v"))
    found = F.filter(F.array(*[F.when(_has(p), F.lit(p)) for p in paths]), lambda p: p.isNotNull())
    shaped = parsed.select("conv_id", "v", found.alias("found")).withColumn("shape", F.sha2(F.array_join("found", "\n"), 256))
    chosen, loose = F.lit(None).cast("string"), F.lit(None).cast("string")
    for layout in reversed(LAYOUTS):
        known = [fingerprint(layout.paths)] + ([fingerprint([f"{layout.items}[]"])] if layout.items else [])
        chosen = F.when(F.col("shape").isin(known), F.lit(layout.name)).otherwise(chosen)
        loose = F.when(F.size(F.array_except(F.array(*map(F.lit, layout.paths)), "found")) == 0, F.lit(layout.name)).otherwise(loose)
    named = shaped.withColumn("layout", F.coalesce(chosen, loose))
    turns = F.lit(None).cast("array<struct<turn:bigint,role:string,text:string>>")
    for layout in LAYOUTS:
        turns = F.when(F.col("layout") == layout.name, _turns_by(layout)).otherwise(turns)
    return named.select("conv_id", "layout", F.explode_outer(turns).alias("t")).select("conv_id", "t.turn", "t.role", "t.text", "layout")


def rows_to_turns(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, layout of a table with one row for each turn, by the layout with the fingerprint of its columns.

    Columns that no such layout knows do not count. A table that fits no layout, or two, is refused.
    """
    known = set(_known_paths(ROW_LAYOUTS))
    shape = fingerprint([p for p in schema_paths(rows.schema) if p in known])
    layout = {fingerprint(x.paths): x for x in ROW_LAYOUTS}.get(shape)
    if layout is None:
        raise ValueError(f"columns {rows.columns} fit no layout of turns")
    names = ("conv_id", "turn", "role", "text")
    return rows.select(*[F.col(f"`{c}`").alias(n) for c, n in zip(layout.row, names, strict=True)], F.lit(layout.name).alias("layout"))


def format_chat(turns: DataFrame) -> DataFrame:
    """One row per conversation: conv_id, formatted string, loss_spans array of (start, length) in code points.

    Turns are ordered by turn, then role and text where turns tie; repeated rows stay. Null roles and
    texts are empty, a null turn comes first, and rows with a null conv_id are one conversation. The
    loss mask covers the texts of the assistant. No turns give no rows. A conversation is one row of
    the result, so it has to fit into one; conversations are otherwise independent.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    marked = turns.select("conv_id", "turn", role.alias("role"), text.alias("text"))
    head, body = F.concat(F.lit(START), _escape_role(F.col("role")), F.lit(LINE)), escape(F.col("text"))
    marked = marked.select("conv_id", "turn", "role", "text", head.alias("head"), body.alias("body"), (F.length(head) + F.length(body) + len(END) + 1).alias("chars"))
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    placed = marked.withColumn("at", F.row_number().over(order)).withColumn("start", F.sum("chars").over(order.rowsBetween(Window.unboundedPreceding, -1)))
    start = (F.coalesce("start", F.lit(0)) + F.length("head")).cast("long")
    span = F.when(F.col("role") == LOSS_ROLE, F.struct(start.alias("start"), F.length("body").cast("long").alias("length")))
    segment = F.struct("at", F.concat("head", "body", F.lit(END + LINE)).alias("text"), span.alias("span"))
    gathered = placed.groupBy("conv_id").agg(F.sort_array(F.collect_list(segment)).alias("parts"))
    spans = F.filter(F.transform("parts", lambda p: p["span"]), lambda s: s.isNotNull())
    return gathered.select("conv_id", F.array_join(F.transform("parts", lambda p: p["text"]), "").alias("formatted"), spans.alias("loss_spans"))


def read_chat(formatted: DataFrame) -> DataFrame:
    """conv_id, turns array of (role, text), loss_texts array of strings, formatted: what format_chat's rows say."""
    parts = F.slice(F.split("formatted", r"<\|im_start\|>"), 2, 1 << 30)

    def turn(part: Column) -> Column:
        inner = F.regexp_replace(part, r"<\|im_end\|>\n\z", "")
        header = F.substring_index(inner, LINE, 1)
        return F.struct(_unescape_role(header).alias("role"), unescape(F.substring(inner, F.length(header) + 2, F.length(inner))).alias("text"))

    masked = F.transform("loss_spans", lambda s: unescape(F.substring(F.col("formatted"), (s["start"] + 1).cast("int"), s["length"].cast("int"))))
    return formatted.select("conv_id", F.transform(parts, turn).alias("turns"), masked.alias("loss_texts"), "formatted")


def chat_digest(turns: DataFrame) -> DataFrame:
    """Format, write, read back, and return the figures of each conversation as read."""
    back = read_chat(materialize(format_chat(turns), "chat"))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = F.array_join("loss_texts", "")
    return back.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(said.cast("binary"), 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss.cast("binary"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )
