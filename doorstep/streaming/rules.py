"""The streaming rules."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from doorstep.operators.qualify import state_of


def latest_observations(
    observations: DataFrame, key: Sequence[str], newest: Sequence[str], values: Sequence[str]
) -> DataFrame:
    """Running latest row per key; kept by `compacted`, or logged by `changelog`."""
    place = F.struct(*newest)
    return observations.groupBy(*key).agg(
        *[F.max_by(v, place).alias(v) for v in values]
    )


def first_listings(
    listings: DataFrame, at: str, horizon: str, key: Sequence[str] = ("dedupe_key",)
) -> DataFrame:
    """Listings without repeats of a key inside the horizon, as they arrive.

    Which of several is kept is up to arrival; `cells.first_rows` keeps the earliest.
    """
    return listings.withWatermark(at, horizon).dropDuplicatesWithinWatermark(list(key))


def windowed_counts(
    observations: DataFrame, at: str, lateness: str, by: Sequence[str], length: str,
    slide: str | None = None,
) -> DataFrame:
    """Counts per time window; rows later than the watermark are dropped."""
    window = F.window(at, length, slide) if slide else F.window(at, length)
    counted = (
        observations.withWatermark(at, lateness)
        .groupBy(window.alias("w"), *by)
        .agg(F.count(F.lit(1)).alias("n"))
    )
    return counted.select(
        F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), *by, "n"
    )


def running_niche_status(
    passes: DataFrame, niche: str, qualified: Column, rejected: Column
) -> DataFrame:
    """Running totals and verification state per category, state from the totals."""
    sums = passes.groupBy(niche).agg(
        F.sum(qualified).alias("qualified"), F.sum(rejected).alias("rejected")
    )
    return sums.withColumn("state", state_of(F.col("qualified"), F.col("rejected")))
