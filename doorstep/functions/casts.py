"""Tolerant casts: provider text becomes a value or NULL, never a stand-in zero."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from doorstep.functions.text import stripped

# The accepted spellings.
TRUE_TOKENS = ("true", "t", "yes", "y", "1")
FALSE_TOKENS = ("false", "f", "no", "n", "0")


def digits_only(value: Column) -> Column:
    """A count, accepted only when the text is nothing but ASCII digits."""
    return F.when(value.rlike("^[0-9]+$"), value.try_cast("int"))


def as_float(value: Column) -> Column:
    return F.trim(value.cast("string")).try_cast("double")


def as_int(value: Column) -> Column:
    """Whole number; a decimal spelling is truncated towards zero."""
    text = F.trim(value.cast("string"))
    return F.coalesce(text.try_cast("bigint"), text.try_cast("double").try_cast("bigint"))


def as_flag(value: Column) -> Column:
    """Tri-state: unrecognised text is unknown, not false."""
    token = F.lower(F.trim(value.cast("string")))
    return F.when(token.isin(*TRUE_TOKENS), True).when(token.isin(*FALSE_TOKENS), False)


def as_list(value: Column) -> Column:
    """JSON text holding a list, an object or a bare text, as display strings.

    Lists keep their non-blank entries; objects become `key: value` in key order; other
    text is one entry.
    """
    trimmed = F.trim(value)
    blank = F.array().cast("array<string>")
    listed = F.filter(
        F.transform(F.from_json(trimmed, "array<string>"), stripped), lambda item: item != ""
    )
    pairs = F.from_json(trimmed, "map<string,string>")
    mapped = F.transform(
        F.array_sort(F.map_keys(pairs)),
        lambda key: F.concat(key, F.lit(": "), F.try_element_at(pairs, key)),
    )
    quoted = F.from_json(F.concat(F.lit("["), trimmed, F.lit("]")), "array<string>")
    return (
        F.when(trimmed.isNull() | (trimmed == ""), blank)
        .when(trimmed.startswith("["), F.coalesce(listed, F.array(trimmed)))
        .when(trimmed.startswith("{"), F.coalesce(mapped, F.array(trimmed)))
        .when(trimmed.startswith('"'), F.coalesce(quoted, F.array(trimmed)))
        .otherwise(F.array(trimmed))
    )


def yes_no(value: Column) -> Column:
    """yes / no / NULL."""
    return F.when(value, "yes").when(~value, "no")


def joined(values: Column) -> Column:
    """Non-blank entries joined with `; `; NULL when nothing is left."""
    kept = F.filter(F.transform(values, stripped), lambda item: item != "")
    return F.nullif(F.array_join(kept, "; "), F.lit(""))
