"""Drift of raw responses from their declared schema: unknown, retyped and missing fields as rows.

A response's shape is the schema of its variant. Shapes are counted before they are taken
apart, so what moves is one row per group and distinct shape, however many responses there are.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, DataType, NumericType, StructType, VariantType

NOT_JSON = "not json"
_NUMBERS = ("BIGINT", "DECIMAL", "DOUBLE", "FLOAT", "INT", "SMALLINT", "TINYINT")
#: Parts of a shape: a field's name, the start of an object or list, their end, a plain type.
_PART = r"(`(?:[^`]|``)*`: |[A-Za-z0-9_]+: |OBJECT<|ARRAY<|>|[A-Z_]+(?:\([0-9, ]+\))?)"
_FOUND = "array<struct<path:string,parent:string,kind:string>>"


def declared_fields(schema: str) -> dict[str, str]:
    """Kind by path of a declared schema: `$` is the response, `[]` a list's elements.

    Kinds are object, list, number, boolean, text, and any for a variant, below which nothing is
    checked.
    """
    out: dict[str, str] = {}

    def walk(path: str, kind: DataType) -> None:
        if isinstance(kind, StructType):
            out[path] = "object"
            for f in kind.fields:
                walk(f"{path}.{_quoted(f.name)}", f.dataType)
        elif isinstance(kind, ArrayType):
            out[path] = "list"
            walk(f"{path}[]", kind.elementType)
        else:
            out[path] = (
                "any" if isinstance(kind, VariantType) else "number" if isinstance(kind, NumericType)
                else "boolean" if isinstance(kind, BooleanType) else "text"
            )

    walk("$", StructType.fromDDL(schema))
    return out


def _quoted(name: str) -> str:
    plain = name.isascii() and name.replace("_", "a").isalnum() and not name.isdigit()
    return name if plain else "`" + name.replace("`", "``") + "`"


def observed_fields(responses: DataFrame, by: Sequence[str] = (), raw: str = "raw") -> DataFrame:
    """`*by, path, parent, kind, responses`: how many responses hold a field of that kind.

    A list's elements are one field, `mixed` where one response has several kinds there. Text
    that is no JSON, null and empty text included, counts at `$` as `not json`.
    """
    shapes = (
        responses.select(*by, F.schema_of_variant(F.try_parse_json(F.col(raw))).alias("_shape"))
        .groupBy(*by, "_shape").agg(F.count(F.lit(1)).alias("_responses"))
    )
    return (
        shapes.select(*by, "_responses", F.inline(_fields(F.col("_shape"))))
        .groupBy(*by, "path", "parent", "kind").agg(F.sum("_responses").alias("responses"))
    )


def _fields(shape: Column) -> Column:
    """The fields of a shape, by one walk over its parts with the open containers as a stack."""
    part_of = F.regexp_extract_all(F.coalesce(shape, F.lit("")), F.lit(_PART), F.lit(1))
    start = F.struct(
        F.array().cast("array<string>").alias("open"), F.lit("$").alias("at"), F.array().cast(_FOUND).alias("found")
    )

    def step(state: Column, part: Column) -> Column:
        inside, at = F.try_element_at(state["open"], F.lit(-1)), state["at"]
        named, ends = part.endswith(": "), part == ">"
        listed, opened = part == "ARRAY<", part.isin("OBJECT<", "ARRAY<")
        field = F.struct(at.alias("path"), inside.alias("parent"), _kind(part).alias("kind"))
        return F.struct(
            F.when(opened, F.concat(state["open"], F.array(at)))
            .when(ends, F.slice(state["open"], 1, F.greatest(F.size(state["open"]) - 1, F.lit(0))))
            .otherwise(state["open"]).alias("open"),
            F.when(named, F.concat(inside, F.lit("."), F.regexp_replace(part, ": $", "")))
            .when(listed, F.concat(at, F.lit("[]"))).otherwise(at).alias("at"),
            F.when(named | ends, state["found"]).otherwise(F.concat(state["found"], F.array(field))).alias("found"),
        )

    none = F.array(F.struct(F.lit("$").alias("path"), F.lit(None).cast("string").alias("parent"), F.lit(NOT_JSON).alias("kind")))
    return F.when(shape.isNull(), none).otherwise(F.aggregate(part_of, start, step, lambda s: s["found"]))


def _kind(part: Column) -> Column:
    plain = F.regexp_replace(part, r"\(.*$", "")
    return (
        F.when(part == "OBJECT<", "object").when(part == "ARRAY<", "list")
        .when(plain.isin(*_NUMBERS), "number").when(plain == "STRING", "text")
        .when(plain == "BOOLEAN", "boolean").when(plain == "VOID", "null").otherwise("mixed")
    )


def drift(responses: DataFrame, schema: str, by: Sequence[str] = (), raw: str = "raw") -> DataFrame:
    """`*by, finding, path, declared, observed, responses`, a row for every departure.

    `unknown`: a field that its declared object does not name; what lies below it is not listed.
    `retyped`: a declared field of another kind. Null fits every kind, a number fits text (such
    fields are read as text); `mixed` fits none. `missing`: a declared field that no response of
    the group holds although its object or list is held; `responses` is 0 and `observed` null.
    A table without rows has no findings.
    """
    fields = declared_fields(schema)
    known = F.create_map(*[F.lit(x) for pair in fields.items() for x in pair])
    seen = observed_fields(responses, by, raw).withColumn("declared", F.try_element_at(known, F.col("path")))
    kind, declared = F.col("kind"), F.col("declared")
    fits = (declared == kind) | (kind == "null") | (declared == "any") | ((declared == "text") & (kind == "number"))
    named = (F.try_element_at(known, F.col("parent")) == "object") & ~F.col("path").endswith("[]")
    finding = F.when(declared.isNull(), F.when(named, "unknown")).when(~fits, "retyped")
    departures = seen.withColumn("finding", finding).where(F.col("finding").isNotNull()).select(
        *by, "finding", "path", "declared", kind.alias("observed"), "responses"
    )
    # At most the declared paths of a group meet here.
    held = seen.where(declared.isNotNull()).groupBy(*by).agg(
        F.collect_set("path").alias("_paths"),
        F.collect_set(F.when(kind == declared, F.col("path"))).alias("_fit"),
    )
    parents = {p: p[:-2] if p.endswith("[]") else _parent(p) for p in fields if p != "$"}
    expected = F.array(*[
        F.struct(F.lit(p).alias("path"), F.lit(up).alias("parent"), F.lit(fields[p]).alias("declared"))
        for p, up in parents.items()
    ])
    absent = F.filter(
        expected,
        lambda e: ~F.array_contains("_paths", e["path"]) & F.array_contains("_fit", e["parent"]) & ~e["path"].endswith("[]"),
    )
    missing = held.select(*by, F.inline(absent)).select(
        *by, F.lit("missing").alias("finding"), "path", "declared",
        F.lit(None).cast("string").alias("observed"), F.lit(0).cast("bigint").alias("responses"),
    )
    return departures.unionByName(missing)


def _parent(path: str) -> str:
    """The object that holds a named field."""
    if path.endswith("`"):
        depth = path[:-1].replace("``", "\0\0").rindex("`")
        return path[: depth - 1]
    return path[: path.rindex(".")]
