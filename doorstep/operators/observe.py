"""Observation tables: rows, freshness, the miss ladder, lookups due, usage counts."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Questions, the sources that answer them, days until asked again, miss ladder.
SOURCES_BY_QUESTION = {
    "website": ("tinyfish_web", "firecrawl_web"),
    "instagram_handle": ("instagram_handle",),
    "ad_library": ("ad_library",),
}
TTL_DAYS = {"website": 30, "instagram_handle": 30, "ad_library": 14}
BACKOFF_DAYS = (30, 90, 180)


def observation_rows(
    sightings: DataFrame, values: Sequence[str], source: str, run_id: str | None = None,
    keep: Sequence[str] = (),
) -> DataFrame:
    """One observation per sighting: `ok` when any value is known, else `no_data`."""
    known = F.coalesce(*[F.col(v).cast("string") for v in values]).isNotNull()
    return sightings.select(
        *keep,
        F.lit(source).alias("source"),
        F.when(known, "ok").otherwise("no_data").alias("status"),
        F.to_json(F.struct(*values), {"ignoreNullFields": "false"}).alias("data"),
        "source_url",
        F.lit(run_id).cast("string").alias("run_id"),
    )


def question_of(
    source: Column, mapping: Mapping[str, Sequence[str]] = SOURCES_BY_QUESTION
) -> Column:
    found = F.lit(None).cast("string")
    for question, sources in mapping.items():
        found = F.when(source.isin(*sources), question).otherwise(found)
    return found


def freshness(
    observations: DataFrame, mapping: Mapping[str, Sequence[str]] = SOURCES_BY_QUESTION
) -> DataFrame:
    """Latest `ok` observation per business and question."""
    return (
        observations.where(F.col("status") == "ok")
        .select("business_id", question_of(F.col("source"), mapping).alias("question"), "fetched_at")
        .where(F.col("question").isNotNull())
        .groupBy("business_id", "question")
        .agg(F.max("fetched_at").alias("last_ok_at"))
    )


def retry_after(misses: Column, last_miss_at: Column, backoff_days: Sequence[int]) -> Column:
    """When to ask again after so many misses; NULL beyond the last step."""
    days = F.try_element_at(F.array(*[F.lit(d) for d in backoff_days]), misses.cast("int"))
    return last_miss_at + F.make_dt_interval(days)


def miss_ladder(
    observations: DataFrame,
    mapping: Mapping[str, Sequence[str]] = SOURCES_BY_QUESTION,
    backoff_days: Sequence[int] = BACKOFF_DAYS,
) -> DataFrame:
    """Consecutive empty answers since the last good one, and when to ask again.

    Blocked and failed lookups say nothing about the business and do not count. Two
    aggregates and one join on (business, question): no ordering of a whole history.
    """
    facts = observations.where(F.col("status").isin("ok", "no_data")).select(
        "business_id",
        question_of(F.col("source"), mapping).alias("question"),
        F.struct("fetched_at", "id").alias("_at"),
        "fetched_at",
        (F.col("status") == "ok").alias("_ok"),
    ).where(F.col("question").isNotNull())
    keys = ["business_id", "question"]
    good = facts.where("_ok").groupBy(*keys).agg(F.max("_at").alias("_last_ok"))
    misses = (
        facts.where(~F.col("_ok"))
        .join(good, keys, "left")
        .where(F.col("_last_ok").isNull() | (F.col("_at") > F.col("_last_ok")))
        .groupBy(*keys)
        .agg(F.count(F.lit(1)).alias("misses"), F.max("fetched_at").alias("last_miss_at"))
    )
    again = retry_after(F.col("misses"), F.col("last_miss_at"), backoff_days)
    return misses.select(*keys, "misses", "last_miss_at", again.alias("retry_after"))


def lookups(
    wanted: DataFrame, ladder: DataFrame, fresh: DataFrame, asof: Column,
    ttl_days: Mapping[str, int] = TTL_DAYS,
) -> DataFrame:
    """Adds `skip_reason` to (business, question) rows; NULL means the lookup is due.

    A ladder row decides alone: past its date the lookup is due however fresh the last
    good answer is.
    """
    keys = ["business_id", "question"]
    ttl = F.lit(None).cast("int")
    for question, days in ttl_days.items():
        ttl = F.when(F.col("question") == question, days).otherwise(ttl)
    laddered = F.coalesce(F.col("misses") >= 1, F.lit(False))
    reason = (
        F.when(laddered & F.col("retry_after").isNull(), "negative_cache_exhausted")
        .when(laddered & (asof < F.col("retry_after")), "negative_cache")
        .when(laddered, None)
        .when(asof < F.col("last_ok_at") + F.make_dt_interval(ttl), "fresh")
    )
    return (
        wanted.join(ladder.select(*keys, "misses", "retry_after"), keys, "left")
        .join(fresh, keys, "left")
        .select(*wanted.columns, reason.alias("skip_reason"))
    )


def observation_counts(observations: DataFrame, measures: Mapping[str, Column]) -> DataFrame:
    """Counts of every value of several measures in one pass: (measure, value, n)."""
    rows = F.array(
        *[
            F.struct(F.lit(name).alias("measure"), value.cast("string").alias("value"))
            for name, value in measures.items()
        ]
    )
    return (
        observations.select(F.inline(rows))
        .where(F.col("value").isNotNull())
        .groupBy("measure", "value")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def provider_usage(calls: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Calls and failures per slot and the share that fell back, from a call log.

    `calls` has slot (primary, fallback) and failed.
    """
    primary, fallback = F.col("slot") == "primary", F.col("slot") == "fallback"
    return calls.groupBy(*by).agg(
        F.count_if(primary).alias("attempts"),
        F.count_if(primary).alias("primary_calls"),
        F.count_if(primary & F.col("failed")).alias("primary_failures"),
        F.count_if(fallback).alias("fallback_calls"),
        F.count_if(fallback & F.col("failed")).alias("fallback_failures"),
    ).withColumn(
        "fallback_rate",
        F.when(
            F.col("attempts") > 0, F.round(F.col("fallback_calls") / F.col("attempts"), 4)
        ).otherwise(0.0),
    )


def rescoring_inputs(
    businesses: DataFrame, verdicts: DataFrame, observations: DataFrame,
    source: Column, statuses: Sequence[str] | None = None,
) -> DataFrame:
    """Business, verdict and latest listing observation of any status.

    Bands count only `ok` observations, re-scoring takes whatever came last; pass
    `statuses` to narrow.
    """
    rows = source if statuses is None else source & F.col("status").isin(*statuses)
    latest = observations.where(rows).groupBy("business_id").agg(
        F.max_by("data", F.struct("fetched_at", "id")).alias("listing_data")
    )
    return (
        businesses.join(verdicts.select("business_id", "my_verdict"), "business_id", "left")
        .join(latest, "business_id", "left")
        .withColumn("listing_data", F.coalesce("listing_data", F.lit("{}")))
    )


def effective_website(verdict: Column, confirmed: Column, listed: Column) -> Column:
    """What re-scoring should see: confirmed overrides, unknown keeps, none clears."""
    return (
        F.when(F.coalesce(verdict, F.lit("unknown")) == "unknown", listed)
        .when(verdict == "none", None)
        .otherwise(F.coalesce(F.nullif(confirmed, F.lit("")), listed))
    )
