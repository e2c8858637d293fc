"""Coverage, growth and movement between two points in time."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from doorstep.operators.ordering import with_previous

BAND_ORDER = ("small", "medium", "large")


def coverage(records: DataFrame, by: Sequence[str], asof: Column) -> DataFrame:
    """Found, new in the latest run, and days since the last sweep, per area and category.

    `records` has first_seen_at, swept_at and in_last_run.
    """
    return records.groupBy(*by).agg(
        F.count(F.lit(1)).alias("found"),
        F.count_if("in_last_run").alias("new_in_last_run"),
        F.datediff(asof, F.max("swept_at")).alias("days_since_swept"),
    )


def growth(series: DataFrame, key: str, value: str) -> DataFrame:
    """Change of a known value against the observation before it, per business.

    Observations whose value does not parse are no point of the series.
    """
    points = series.where(F.col(value).isNotNull())
    order = [F.col("fetched_at"), F.col("id")]
    return with_previous(points, [key], order, {"previous": value}).withColumn(
        "change", F.col(value) - F.col("previous")
    )


def growth_summary(points: DataFrame, key: str, value: str) -> DataFrame:
    """First, last and largest single rise of each business's series."""
    place = F.struct("fetched_at", "id")
    return points.groupBy(key).agg(
        F.count(F.lit(1)).alias("observations"),
        F.min_by(value, place).alias("first_value"),
        F.max_by(value, place).alias("last_value"),
        F.max("change").alias("largest_rise"),
    )


def snapshot_diff(
    before: DataFrame, after: DataFrame, key: str, compared: Sequence[str]
) -> DataFrame:
    """What happened to each key between two snapshots, and which columns changed."""
    old = before.select(F.col(key).alias("_old_key"), *[F.col(c).alias(f"_old_{c}") for c in compared])
    new = after.select(F.col(key).alias("_new_key"), *[F.col(c).alias(f"_new_{c}") for c in compared])
    both = old.join(new, F.col("_old_key") == F.col("_new_key"), "full_outer")
    changed = F.array_compact(
        F.array(
            *[F.when(~F.col(f"_old_{c}").eqNullSafe(F.col(f"_new_{c}")), c) for c in compared]
        )
    )
    action = (
        F.when(F.col("_old_key").isNull(), "found")
        .when(F.col("_new_key").isNull(), "gone")
        .when(F.size(changed) > 0, "changed")
        .otherwise("same")
    )
    return both.select(
        F.coalesce("_new_key", "_old_key").alias(key),
        action.alias("action"),
        F.when(action == "changed", changed).otherwise(F.array().cast("array<string>")).alias("columns"),
        *[F.col(f"_old_{c}").alias(f"old_{c}") for c in compared],
        *[F.col(f"_new_{c}").alias(f"new_{c}") for c in compared],
    )


def band_movement(old: Column, new: Column, order: Sequence[str] = BAND_ORDER) -> Column:
    """up, down, same; NULL where either side is not one of the bands."""

    def level(band: Column) -> Column:
        found = F.lit(None).cast("int")
        for i, name in enumerate(order):
            found = F.when(band == name, i).otherwise(found)
        return found

    return (
        F.when(level(new) > level(old), "up")
        .when(level(new) < level(old), "down")
        .when(level(new) == level(old), "same")
    )
