"""Joining one value per key to rows, however many rows a key has."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A key with more than one in so many rows is dealt out; there are fewer such keys than this.
SHARE = 1000


def attach(rows: DataFrame, values: DataFrame, key: str, how: str = "left") -> DataFrame:
    """`rows` with the columns of `values`, which has one row per `key`; null is a key like any other.

    Keys with more than a thousandth of all rows are fewer than a thousand. They are named in the
    plan, so no join looks them up, and their rows are dealt over copies of their value in
    proportion to the share, so no task gets more than about a thousandth of the rows by way of one
    key. `rows` is read twice: pass a stored table or a cheap one.
    """
    copies = _copies(rows, key)
    others = [c for c in rows.columns if c != key]
    slot = F.pmod(F.xxhash64(*(others or [key])), copies).cast("int")
    dealt = rows.select(*rows.columns, slot.alias("slot"))
    laid = values.select(
        F.col(key).alias("value_key"), *[c for c in values.columns if c != key],
        F.explode(F.sequence(F.lit(0), copies - 1)).alias("value_slot"),
    )
    same = F.col(key).eqNullSafe(F.col("value_key")) & (F.col("slot") == F.col("value_slot"))
    return dealt.join(laid, same, how).drop("value_key", "value_slot", "slot")


def _copies(rows: DataFrame, key: str) -> Column:
    """Among how many copies of its value a key's rows are dealt: its share in thousandths, up to a power of two."""
    total = rows.count()
    counts = rows.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    levels: dict[int, list] = {}
    for value, n in counts.where(F.col("n") * SHARE > total).select(key, "n").collect():
        levels.setdefault((-(-n * SHARE // total) - 1).bit_length(), []).append(value)
    out = F.lit(1)
    for level, found in levels.items():
        named = [v for v in found if v is not None]
        here = F.lit(False)
        if named:
            here = F.coalesce(F.col(key).isin(named), F.lit(False))
        if len(named) < len(found):
            here = here | F.col(key).isNull()
        out = F.when(here, F.lit(1 << level)).otherwise(out)
    return out
