"""Where to search: scopes, gazetteer lookups, country checks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from doorstep.functions.geo import composed, radius_for
from doorstep.functions.text import compact, squeezed


def scope_targets(scopes: DataFrame, scope_id: str = "scope_id") -> DataFrame:
    """One target per distinct area of a scope, or one city-wide target when it names none.

    `scopes` has city, state, country and an array of areas. Areas that normalise alike keep
    the first spelling. The array stays in its row, so nothing is shuffled.
    """
    named = F.filter(
        F.transform(F.coalesce("areas", F.array().cast("array<string>")), squeezed),
        lambda a: a != "",
    )
    keys = F.transform(named, compact)
    first = F.filter(named, lambda a, i: F.array_position(keys, compact(a)) == i + 1)
    return (
        scopes.select("*", F.explode_outer(first).alias("area"))
        .select(
            scope_id, "area", "city", "state", "country",
            F.when(F.col("area").isNull(), "city").otherwise("area").alias("precision"),
            composed(F.col("area"), F.col("city"), F.col("state"), F.col("country")).alias("query"),
        )
        .withColumn("radius_m", radius_for(F.col("precision")))
    )


def resolve_targets(targets: DataFrame, keys: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(resolved, unresolved): targets against gazetteer keys.

    Everything the query states after the area and city must be something the entry is.
    An unresolved target is reported; it never gets a default point.
    """
    parts = F.filter(
        F.transform(F.split("query", ","), squeezed), lambda p: p != ""
    )
    area_wide = F.col("precision") == "area"
    staged = targets.select(
        "*",
        F.when(area_wide, compact(F.try_element_at(parts, F.lit(1)))).otherwise("").alias("_area"),
        F.when(area_wide, compact(F.try_element_at(parts, F.lit(2))))
        .otherwise(compact(F.try_element_at(parts, F.lit(1))))
        .alias("_city"),
        F.transform(
            F.slice(parts, F.when(area_wide, 3).otherwise(2), F.size(parts) + 1), compact
        ).alias("_tail"),
    )
    entries = keys.select(
        F.col("precision").alias("_precision"), "area_key", "city_key",
        F.col("area").alias("_e_area"), F.col("city").alias("_e_city"),
        F.col("state").alias("_e_state"), F.col("country").alias("_e_country"),
        "gl", "lat", "lng",
    )
    joined = staged.join(
        entries,
        (F.col("precision") == F.col("_precision"))
        & (F.col("_area") == F.col("area_key"))
        & (F.col("_city") == F.col("city_key")),
        "left",
    )
    allowed = F.filter(
        F.transform(
            F.array("_e_state", "_e_country", "gl"), lambda v: compact(v)
        ),
        lambda v: v != "",
    )
    agrees = F.col("_precision").isNotNull() & (
        F.size(F.array_except("_tail", allowed)) == 0
    )
    flagged = joined.withColumn("_agrees", F.coalesce(agrees, F.lit(False)))
    resolved = flagged.where("_agrees").select(
        *targets.columns,
        composed(
            F.col("_e_area"), F.col("_e_city"), F.col("_e_state"), F.col("_e_country")
        ).alias("label"),
        "lat", "lng", "gl",
    )
    unresolved = flagged.where(~F.col("_agrees")).select(*targets.columns)
    return resolved, unresolved


def country_check(resolved: DataFrame, declared: str = "declared_gl", found: str = "gl") -> DataFrame:
    """Adds `wrong_country`: both codes are known and differ."""
    return resolved.withColumn(
        "wrong_country",
        F.coalesce(
            (F.nullif(F.col(declared), F.lit("")) != F.nullif(F.col(found), F.lit(""))),
            F.lit(False),
        ),
    )


def run_scopes(runs: DataFrame, goals: DataFrame) -> DataFrame:
    """Run to goal, with the scope fields read out of the goal's JSON."""
    scope = {
        name: F.get_json_object("spec", f"$.{name}") for name in ("city", "state", "country")
    }
    areas = F.from_json(F.get_json_object("spec", "$.areas"), "array<string>")
    return runs.join(
        goals.select(F.col("id").alias("goal_id"), "spec"), "goal_id"
    ).select(
        F.col("id").alias("run_id"), "goal_id",
        *[value.alias(name) for name, value in scope.items()],
        areas.alias("areas"),
    )
