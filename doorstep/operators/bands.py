"""Audience bands against the (category, city) cohort."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from doorstep.functions.casts import digits_only
from doorstep.operators.ordering import (
    join_groups,
    latest_per_key,
    running_totals,
    tile,
)

MIN_COHORT = 30
SMALL_BELOW, MEDIUM_TO = 100, 500


def latest_scores(scores: DataFrame) -> DataFrame:
    return latest_per_key(
        scores, "business_id", ["scored_at", "id"],
        ["audience_index", "scorer_version", "total", "scored_at"],
    )


def latest_reviews(
    observations: DataFrame,
    rows: Column,
    reviews: Column,
) -> DataFrame:
    """Review count of the latest counting observation; NULL when it does not parse."""
    latest = latest_per_key(
        observations.where(rows).select(
            "business_id", "fetched_at", "id", reviews.alias("_text")
        ),
        "business_id", ["fetched_at", "id"], ["_text"],
    )
    return latest.select("business_id", digits_only(F.col("_text")).alias("reviews"))


def cohort_members(
    businesses: DataFrame, scores: DataFrame, reviews: DataFrame
) -> DataFrame:
    """Every business with its latest score and review count, scored or not."""
    return (
        businesses.select(F.col("id").alias("business_id"), "name", "niche_id", "city", "search_area")
        .join(scores, "business_id", "left")
        .join(reviews, "business_id", "left")
    )


def with_cohort_rank(members: DataFrame) -> DataFrame:
    """`cohort_size` (rankable members) and `cohort_rank` (rank among them).

    Unrankable members sort last, so the ranks of the rankable ones are unaffected by them
    and one sort serves both columns.
    """
    unranked = F.col("audience_index").isNull()
    order = [unranked, F.coalesce("audience_index", F.lit(0.0)), F.col("business_id")]
    rankable = (~unranked).cast("bigint")
    return running_totals(
        members, ["niche_id", "city"], order, {"cohort_rank": rankable}, {"cohort_size": rankable}
    )


def cohort_bands(
    members: DataFrame,
    min_cohort: int = MIN_COHORT,
) -> DataFrame:
    """Band and method per business: tiles in a large enough cohort, thresholds otherwise."""
    ranked = with_cohort_rank(members)
    relative = F.col("cohort_size") >= min_cohort
    third = tile(F.col("cohort_rank"), F.col("cohort_size"), 3)
    band = (
        F.when(F.col("audience_index").isNull(), "unknown")
        .when(relative, F.when(third == 1, "small").when(third == 2, "medium").otherwise("large"))
        .when(F.col("reviews").isNull(), "unknown")
        .when(F.col("reviews") < SMALL_BELOW, "small")
        .when(F.col("reviews") <= MEDIUM_TO, "medium")
        .otherwise("large")
    )
    return ranked.select(
        "business_id", "name", "niche_id", "city", "search_area", "audience_index", "reviews",
        "total", "scorer_version", "scored_at", "cohort_size",
        F.when(relative, "relative").otherwise("absolute").alias("banding_method"),
        band.alias("audience_band"),
    )
