"""Conversations in any known layout to canonical turns, and turns to one marked-up text.

A layout is known by its fingerprint: the sha256 of its sorted nested field paths, array steps
included, without the fields that the layout does not know. A fingerprint selects a declarative mapping:
which path holds the turns, or which fields become which turns in which order. Records of
different layouts in one column are told apart row by row. All of it is column expressions.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


@dataclass(frozen=True)
class Mapping:
    """How one layout becomes turns.

    `fields` lists (role, path) in order for one record per conversation; `turns` is
    (path of the list, role field, text field). `table` is (conversation, order, role, text)
    for tables with one turn per row. `required` and `optional` paths make the fingerprints.
    """

    name: str
    required: tuple[str, ...]
    optional: tuple[str, ...] = ()
    fields: tuple[tuple[str, str], ...] = ()
    turns: tuple[str, str, str] | None = None
    table: tuple[str, str, str, str] | None = None


MAPPINGS = (
    Mapping("turn rows", ("conv_id", "role", "text", "turn"), table=("conv_id", "turn", "role", "text")),
    Mapping("messages", ("messages", "messages[]", "messages[].content", "messages[].role"),
            ("system",), (("system", "system"),), turns=("messages", "role", "content")),
    Mapping("from and value", ("conversations", "conversations[]", "conversations[].from", "conversations[].value"),
            ("system",), (("system", "system"),), turns=("conversations", "from", "value")),
    Mapping("instruction", ("instruction", "output"), ("input", "system"),
            (("system", "system"), ("user", "instruction"), ("user", "input"), ("assistant", "output"))),
    Mapping("prompt", ("completion", "prompt"), ("system",),
            (("system", "system"), ("user", "prompt"), ("assistant", "completion"))),
    Mapping("prompt and response", ("prompt", "response"), ("system",),
            (("system", "system"), ("user", "prompt"), ("assistant", "response"))),
    Mapping("question", ("answer", "question"), ("context",),
            (("user", "context"), ("user", "question"), ("assistant", "answer"))),
)
#: Names that other layouts give the canonical roles (fixed values).
ROLES = {"human": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant"}
TURN = "struct<role: string, text: string>"


def fingerprint(paths: Sequence[str]) -> str:
    return hashlib.sha256("\n".join(sorted(paths)).encode()).hexdigest()


def fingerprints(mappings: Sequence[Mapping] = MAPPINGS) -> dict[str, Mapping]:
    """Every fingerprint a mapping answers to: its required paths with any of the optional ones."""
    out = {}
    for mapping in mappings:
        for mask in range(1 << len(mapping.optional)):
            more = [p for k, p in enumerate(mapping.optional) if mask >> k & 1]
            out[fingerprint([*mapping.required, *more])] = mapping
    return out


def known_paths(mappings: Sequence[Mapping] = MAPPINGS) -> list[str]:
    return sorted({p for m in mappings for p in (*m.required, *m.optional)})


def schema_paths(kind: T.DataType, prefix: str = "") -> list[str]:
    """Nested field paths of a schema; `[]` is a step into a list."""
    if isinstance(kind, T.ArrayType):
        return [f"{prefix}[]", *schema_paths(kind.elementType, f"{prefix}[]")]
    if isinstance(kind, T.StructType):
        out = []
        for f in kind.fields:
            path = f"{prefix}.{f.name}" if prefix else f.name
            out += [path, *schema_paths(f.dataType, path)]
        return out
    return []


def table_mapping(df: DataFrame, mappings: Sequence[Mapping] = MAPPINGS) -> Mapping:
    """The mapping of a table's own columns. Columns that no layout knows do not count."""
    paths = set(schema_paths(df.schema))
    for mapping in mappings:
        known = {*mapping.required, *mapping.optional}
        found = fingerprints([mapping]).get(fingerprint([p for p in paths if p in known]))
        if found:
            return found
    raise ValueError(f"no layout has the fields {sorted(paths)}")


def turns_of_table(df: DataFrame, mappings: Sequence[Mapping] = MAPPINGS) -> DataFrame:
    """`conv_id, turn, role, text` of a table with one turn per row; null texts are empty."""
    conv, turn, role, text = table_mapping(df, mappings).table
    return df.select(
        F.col(conv).alias("conv_id"), F.col(turn).alias("turn"),
        F.coalesce(F.col(role), F.lit("")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text"),
    )


def record_paths(record: Column, mappings: Sequence[Mapping] = MAPPINGS) -> Column:
    """Known paths that a variant record really has: null fields do not count, a list has those of any element."""
    held = []
    for path in known_paths(mappings):
        outer, _, inner = path.partition("[]")
        if outer == path:
            there = _is_there(record, f"$.{path}")
        else:
            elements = F.try_variant_get(record, f"$.{outer}", "array<variant>")
            there = F.exists(elements, lambda x: _is_there(x, f"${inner}".replace("[]", "[0]")))
        held.append(F.when(there, F.lit(path)))
    return F.array_compact(F.array(*held))


def _is_there(record: Column, path: str) -> Column:
    kind = F.schema_of_variant(F.try_variant_get(record, path, "variant"))
    return F.coalesce(kind != "VOID", F.lit(False))


def record_fingerprint(paths: Column, mapping: Mapping) -> Column:
    """Fingerprint of a record's paths among those that `mapping` knows, in the order of their names."""
    own = sorted({*mapping.required, *mapping.optional})
    return F.sha2(F.array_join(F.filter(paths, lambda p: p.isin(own)), "\n"), 256)


def turns_of_records(df: DataFrame, json: str, key: str, mappings: Sequence[Mapping] = MAPPINGS) -> DataFrame:
    """`conv_id, turn, role, text, layout` of JSON records of mixed layouts.

    A record that is no JSON or that no mapping answers gives one row with null turn and layout.
    """
    record = F.try_parse_json(F.col(json))
    base = df.select(F.col(key).alias("conv_id"), record.alias("_r"))
    base = base.withColumn("_p", record_paths(F.col("_r"), mappings))
    layout, turns = F.lit(None).cast("string"), F.lit(None).cast(f"array<{TURN}>")
    for mapping in reversed(mappings):  # the first that answers is the one, as in a table
        if mapping.table:
            continue
        marks = list(fingerprints([mapping]))
        parts = [
            F.filter(
                F.array(*[
                    F.struct(F.lit(role).alias("role"),
                             F.try_variant_get("_r", f"$.{path}", "string").alias("text"))
                    for role, path in mapping.fields
                ]),
                lambda t: F.coalesce(t["text"], F.lit("")) != "",
            )
        ] if mapping.fields else []
        if mapping.turns:
            path, role, text = mapping.turns
            listed = F.try_variant_get("_r", f"$.{path}", f"array<struct<{role}: string, {text}: string>>")
            parts.append(F.transform(listed, lambda t: F.struct(
                F.coalesce(t[role], F.lit("")).alias("role"), F.coalesce(t[text], F.lit("")).alias("text"))))
        hit = record_fingerprint(F.col("_p"), mapping).isin(marks)
        turns = F.when(hit, F.concat(*[p.cast(f"array<{TURN}>") for p in parts])).otherwise(turns)
        layout = F.when(hit, F.lit(mapping.name)).otherwise(layout)
    out = base.select("conv_id", layout.alias("layout"), F.posexplode_outer(turns).alias("turn", "_t"))
    names = F.create_map(*[F.lit(x) for pair in ROLES.items() for x in pair])
    return out.select(
        "conv_id", F.col("turn").cast("bigint").alias("turn"),
        F.coalesce(F.try_element_at(names, F.lower("_t.role")), F.col("_t.role")).alias("role"),
        F.col("_t.text").alias("text"), "layout",
    )


@dataclass(frozen=True)
class Template:
    """Marks of a turn. Texts and roles hold none of `control` unescaped."""

    begin: str = "<s>"
    role_open: str = "[ROLE] "
    role_close: str = " [/ROLE]"
    end: str = "</s>"
    learned: tuple[str, ...] = ("assistant",)
    more: tuple[str, ...] = field(default=(
        "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "[ROLE]", "[/ROLE]", "<|im_start|>", "<|im_end|>",
        "<|endoftext|>",
    ))

    @property
    def pattern(self) -> str:
        """First and remaining characters of any control string."""
        marks = sorted({self.begin, self.end, *self.more}, key=len, reverse=True)
        return "(?:" + "|".join(f"(?<=(?=\\Q{m}\\E).)" for m in marks) + ")"

    def escape(self, text: Column) -> Column:
        """A backslash after the first character of a control string; backslashes are doubled."""
        return F.regexp_replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), self.pattern, r"\\")

    @staticmethod
    def unescape(text: Column) -> Column:
        return F.regexp_replace(text, r"\\(\\?)", "$1")


def format_turns(turns: DataFrame, template: Template = Template()) -> DataFrame:
    """`conv_id`, `formatted` and `loss_spans` (start, size in characters) of each conversation.

    Turns are ordered by turn (null first), then role and text, so ties have one order; repeated
    rows are repeated turns. A null conv_id is a conversation like any other. Spans cover the
    escaped texts of learned roles and nothing else.
    """
    t = template
    head = F.concat(F.lit(t.begin + t.role_open), t.escape(F.col("role")), F.lit(t.role_close))
    order = ["turn", "role", "text"]
    whole = turns.select("conv_id", *order, head.alias("_head"), t.escape(F.col("text")).alias("_body"))
    before = Window.partitionBy("conv_id").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    size = F.char_length("_head") + F.char_length("_body") + len(t.end)
    placed = whole.withColumn("_at", F.coalesce(F.sum(size).over(before), F.lit(0)))
    gathered = placed.groupBy("conv_id").agg(
        F.array_sort(F.collect_list(F.struct("_at", "_head", "_body", "role"))).alias("_t")
    )
    learned = F.filter("_t", lambda x: x["role"].isin(*t.learned))
    return gathered.select(
        "conv_id",
        F.array_join(F.transform("_t", lambda x: F.concat(x["_head"], x["_body"], F.lit(t.end))), "").alias("formatted"),
        F.transform(learned, lambda x: F.struct(
            (x["_at"] + F.char_length(x["_head"])).alias("start"), F.char_length(x["_body"]).alias("size"),
        )).alias("loss_spans"),
    )


def read_turns(formatted: Column, template: Template = Template()) -> Column:
    """The turns (role, text) of a formatted conversation, unescaped."""
    t = template
    pieces = F.filter(F.split(formatted, "\\Q" + t.end + "\\E", -1), lambda p: p != "")
    at = F.lit(len(t.begin + t.role_open) + 1)

    def turn(piece: Column) -> Column:
        close = F.instr(piece, t.role_close)
        return F.struct(
            t.unescape(F.substr(piece, at, close - at)).alias("role"),
            t.unescape(F.substr(piece, close + len(t.role_close))).alias("text"),
        )

    return F.transform(pieces, turn)


def read_loss(formatted: Column, spans: Column, template: Template = Template()) -> Column:
    """All text under the loss mask, unescaped, end to end."""
    return F.array_join(
        F.transform(spans, lambda s: template.unescape(F.substr(formatted, (s["start"] + 1).cast("int"), s["size"]))), ""
    )


def digests(formatted: DataFrame, template: Template = Template()) -> DataFrame:
    """What the formatted conversations hold, read back from them."""
    read = formatted.select(
        "conv_id", read_turns(F.col("formatted"), template).alias("_turns"),
        read_loss(F.col("formatted"), F.col("loss_spans"), template).alias("_loss"),
        F.char_length("formatted").cast("bigint").alias("formatted_chars"),
    )
    whole = F.array_join(F.transform("_turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(
        "conv_id", F.size("_turns").cast("bigint").alias("n_turns"),
        F.sha2(whole, 256).alias("turns_sha256"),
        F.char_length("_loss").cast("bigint").alias("loss_chars"),
        F.sha2("_loss", 256).alias("loss_sha256"), "formatted_chars",
    )
