"""Chat formatting: find a record's layout by its fingerprint, map it to turns, render a template."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, StructType

TURNS = "array<struct<role:string,text:string>>"

#: Template: a turn is ``### role: text</turn>`` and a line feed.
OPEN, MIDDLE, CLOSE = "### ", ": ", "</turn>\n"
#: Control strings and how they are written inside roles and texts, in this order.
ESCAPES = (("\\", "\\s"), ("### ", "\\h"), ("</turn>", "\\e"), (": ", "\\c"))
#: Texts may hold ``: ``: only the first one of a turn, after the role, is read as control string.
TEXT_ESCAPES = ESCAPES[:3]

# --- layouts ---------------------------------------------------------------------------------


def paths_of(schema: DataType) -> str:
    """Nested field paths of a schema, types left out, in the form that ``schema_of_variant`` gives."""
    if isinstance(schema, StructType):
        inner = sorted((f.name, paths_of(f.dataType)) for f in schema.fields)
        return "OBJECT<" + ", ".join(f"{n}: {p}" if p else n for n, p in inner) + ">"
    if isinstance(schema, ArrayType):
        return f"ARRAY<{paths_of(schema.elementType)}>"
    return ""


def record_paths(record: Column) -> Column:
    """The same of a variant: objects list their fields by name; scalar types are left out."""
    scalar = r"(: )?\b(STRING|VOID|BOOLEAN|BIGINT|DOUBLE|FLOAT|DATE|DECIMAL\(\d+,\d+\))(?=[,>]|$)"
    return F.regexp_replace(F.schema_of_variant(record), scalar, "")


def fingerprint(paths: Column) -> Column:
    return F.md5(paths)


def _messages(field: str, role: str, text: str) -> str:
    return (
        f"transform(try_variant_get(record, '$.{field}', 'array<variant>'), m -> named_struct("
        f"'role', try_variant_get(m, '$.{role}', 'string'), "
        f"'text', try_variant_get(m, '$.{text}', 'string')))"
    )


def _fields(*parts: tuple[str, str]) -> str:
    turns = ", ".join(
        f"named_struct('role', '{role}', 'text', try_variant_get(record, '$.{field}', 'string'))"
        for role, field in parts
    )
    return f"filter(array({turns}), t -> t.text is not null)"


@dataclass(frozen=True)
class Mapping:
    """A layout's required field paths, and the SQL expression of its turns over ``record``. Other
    fields may be there as well; optional ones are named in the expression only."""

    required: tuple[str, ...]
    turns: str


#: Declarative mappings of records. Of several that fit, the one with the most required paths is
#: taken, then the first.
MAPPINGS = (
    Mapping(("messages[].role", "messages[].content"), _messages("messages", "role", "content")),
    Mapping(("messages[].role", "messages[].text"), _messages("messages", "role", "text")),
    Mapping(
        ("conversations[].from", "conversations[].value"), _messages("conversations", "from", "value")
    ),
    Mapping(
        ("prompt", "completion"),
        _fields(("system", "system"), ("user", "prompt"), ("assistant", "completion")),
    ),
    Mapping(
        ("prompt", "response"),
        _fields(("system", "system"), ("user", "prompt"), ("assistant", "response")),
    ),
    Mapping(
        ("instruction", "output"),
        _fields(
            ("system", "system"), ("user", "instruction"), ("user", "input"), ("assistant", "output")
        ),
    ),
    Mapping(("question", "answer"), _fields(("user", "question"), ("assistant", "answer"))),
)
#: Other names of the roles.
ROLE_NAMES = {"human": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant"}


def _has(path: str) -> str:
    """SQL: has ``record`` the field path? A list without elements has every path below it."""
    head, _, rest = path.partition("[].")
    if not rest:
        return f"variant_get(record, '$.{head}', 'variant') is not null"
    items = f"try_variant_get(record, '$.{head}', 'array<variant>')"
    inner = f"try_variant_get(m, '$.{rest}', 'variant') is not null"
    return f"coalesce(size({items}) = 0 or exists({items}, m -> {inner}), false)"


def select_mapping(records: DataFrame, required: Sequence[tuple[str, ...]]) -> DataFrame:
    """Adds ``mapping``, the number of the mapping that the record's ``layout`` selects.

    All records of a layout have the same nested field paths, so one of each stands for it: the
    distinct layouts, by their hash, are matched with the required paths, and the result is joined
    back on the hash.
    """
    order = sorted(range(len(required)), key=lambda i: (-len(required[i]), i))
    fits = [
        F.when(F.expr(" and ".join(_has(p) for p in required[i])), F.lit(i)) for i in order
    ]
    layouts = records.where("layout is not null").groupBy("layout").agg(F.first("record").alias("record"))
    chosen = layouts.select("layout", F.coalesce(*fits).alias("mapping"))
    return records.join(chosen, "layout", "left")


def canonical_turns(
    records: DataFrame,
    json_col: str = "record",
    mappings: Sequence[Mapping] = MAPPINGS,
    role_names: dict[str, str] = ROLE_NAMES,
) -> DataFrame:
    """Parse a JSON column of mixed layouts into ``turns``; adds ``layout`` (fingerprint) as well.

    The layout of each record is the hash of its nested field paths; it selects the mapping whose
    required paths are all among them, so that extra fields, missing optional ones and empty lists
    do not lose a record. Text that is no JSON object and layouts without a mapping get null turns
    and keep their fingerprint, so that they can be counted. All other columns are kept; columns
    named turns, layout, mapping or record are replaced.
    """
    own = ("turns", "layout", "mapping", "record")
    kept = [F.col(f"`{c}`") for c in records.columns if c not in own]
    parsed = records.select(*kept, F.try_parse_json(json_col).alias("record"))
    parsed = parsed.withColumn("layout", fingerprint(record_paths(F.col("record"))))
    parsed = select_mapping(parsed, [m.required for m in mappings])
    turns = F.lit(None).cast(TURNS)
    for i, mapping in enumerate(mappings):
        turns = F.when(F.col("mapping") == i, F.expr(mapping.turns).cast(TURNS)).otherwise(turns)
    names = F.create_map(*[F.lit(x) for pair in role_names.items() for x in pair])
    named = F.transform(
        turns,
        lambda t: F.struct(
            F.coalesce(names[t["role"]], t["role"]).alias("role"), t["text"].alias("text")
        ),
    )
    return parsed.withColumn("turns", named).drop("record", "mapping")


#: Mappings of records that are one turn each: the fields that hold conversation, order, role, text.
ROW_MAPPINGS = (
    ("conv_id", "turn", "role", "text"),
    ("conversation_id", "index", "role", "content"),
)


def turns_of_rows(
    rows: DataFrame, mappings: Sequence[tuple[str, str, str, str]] = ROW_MAPPINGS
) -> DataFrame:
    """Turns of a table with one row per turn: (conversation id, turns).

    Each row is a record; the hash of its field paths selects the mapping, as in
    :func:`canonical_turns`, so extra columns of any name are left out. Rows are put in order by
    turn, then role, then text, nulls first; a repeated row is a turn again. Rows of a null id are
    one conversation. A conversation is one record: it is gathered whole, in one cell, and must fit
    into the memory of a task (and the 2 GiB of a cell).
    """
    able = [m for m in mappings if set(m) <= set(rows.columns)]
    if not able:
        raise ValueError(f"no mapping for the layout {paths_of(rows.schema)}")
    record = F.to_variant_object(F.struct(*[F.col(f"`{c}`") for c in rows.columns]))
    named = {c: F.col(f"`{c}`") for m in able for c in m}
    packed = rows.select(record.alias("record"), F.struct(*named.values()).alias("row"))
    packed = packed.withColumn("layout", fingerprint(record_paths(F.col("record"))))
    packed = select_mapping(packed, able)

    def field(place: int) -> Column:
        value = F.lit(None)
        for i, mapping in enumerate(able):
            value = F.when(F.col("mapping") == i, F.col("row")[mapping[place]]).otherwise(value)
        return value

    turn = F.struct(field(1).alias("order"), field(2).alias("role"), field(3).alias("text"))
    gathered = packed.where("mapping is not null").groupBy(field(0).alias(able[0][0])).agg(
        F.sort_array(F.collect_list(turn)).alias("turns")
    )
    return gathered.withColumn(
        "turns",
        F.transform(
            "turns",
            lambda t: F.struct(
                t["role"].cast("string").alias("role"), t["text"].cast("string").alias("text")
            ),
        ),
    )


# --- template --------------------------------------------------------------------------------


def _escape(column: Column, escapes) -> Column:
    out = F.coalesce(column, F.lit(""))
    for raw, written in escapes:
        out = F.replace(out, F.lit(raw), F.lit(written))
    return out


def _unescape(column: Column, escapes) -> Column:
    out = column
    for raw, written in reversed(escapes):
        out = F.replace(out, F.lit(written), F.lit(raw))
    return out


def format_turns(df: DataFrame, turns: str = "turns") -> DataFrame:
    """Adds ``formatted``, the rendered conversation, and ``loss_spans`` (start, end; code points,
    end exclusive), the places of the assistants' texts in it. Null roles and texts are empty; null
    turns give an empty string without spans. Columns named formatted or loss_spans are replaced, and
    ``_turn_parts`` is a reserved name."""
    parts = F.transform(
        F.coalesce(F.col(turns), F.array().cast(TURNS)),
        lambda t: F.struct(
            F.concat(F.lit(OPEN), _escape(t["role"], ESCAPES), F.lit(MIDDLE)).alias("head"),
            _escape(t["text"], TEXT_ESCAPES).alias("body"),
            F.coalesce(t["role"] == "assistant", F.lit(False)).alias("loss"),
        ),
    )
    spans = F.aggregate(
        "_turn_parts",
        F.struct(
            F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("spans")
        ),
        lambda acc, p: F.struct(
            (acc["at"] + F.length(p["head"]) + F.length(p["body"]) + len(CLOSE)).alias("at"),
            F.when(
                p["loss"],
                F.concat(
                    acc["spans"],
                    F.array(
                        F.struct(
                            (acc["at"] + F.length(p["head"])).alias("start"),
                            (acc["at"] + F.length(p["head"]) + F.length(p["body"])).alias("end"),
                        )
                    ),
                ),
            )
            .otherwise(acc["spans"])
            .alias("spans"),
        ),
        lambda acc: acc["spans"],
    )
    joined = F.array_join(
        F.transform("_turn_parts", lambda p: F.concat(p["head"], p["body"], F.lit(CLOSE))), ""
    )
    return (
        df.withColumn("_turn_parts", parts)
        .withColumns({"formatted": joined, "loss_spans": spans})
        .drop("_turn_parts")
    )


def parse_formatted(formatted: Column) -> Column:
    """The turns that a formatted string holds."""
    parts = F.split(formatted, CLOSE)
    heads = F.transform(
        F.slice(parts, 1, F.size(parts) - 1), lambda p: F.substring(p, len(OPEN) + 1, 1 << 30)
    )
    return F.transform(
        heads,
        lambda p: F.struct(
            _unescape(F.substring_index(p, MIDDLE, 1), ESCAPES).alias("role"),
            _unescape(
                F.substring(p, F.instr(p, MIDDLE) + len(MIDDLE), F.lit(1 << 30)), TEXT_ESCAPES
            ).alias("text"),
        ),
    )


def masked_texts(formatted: Column, spans: Column) -> Column:
    """The unescaped texts under the loss mask, cut out of the formatted string."""
    return F.transform(
        spans,
        lambda s: _unescape(
            F.substring(formatted, s["start"] + 1, s["end"] - s["start"]), TEXT_ESCAPES
        ),
    )
