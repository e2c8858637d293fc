"""Summaries of observations by stretch of days that merge without reading history again.

A summary says, per business and question and for the days `since` to `until`: the last good
answer, the empty answers after it, and the last of those. Summaries of stretches that do not
overlap merge into one of the longer stretch, in any order and any grouping, so each day is
summed up once. Observations without a time belong to no day and are left out.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from doorstep.operators.observe import BACKOFF_DAYS, SOURCES_BY_QUESTION, question_of, retry_after

KEYS = ("business_id", "question")


def daily(observations: DataFrame, mapping: Mapping[str, Sequence[str]] = SOURCES_BY_QUESTION) -> DataFrame:
    """`business_id, question, since, until, last_ok, misses, last_miss_at`, a row per day with answers."""
    day = F.col("fetched_at").cast("date")
    facts = observations.where(F.col("status").isin("ok", "no_data") & F.col("fetched_at").isNotNull()).select(
        "business_id", question_of(F.col("source"), mapping).alias("question"), day.alias("since"),
        F.struct("fetched_at", "id").alias("at"), (F.col("status") == "ok").alias("ok"),
    ).where(F.col("question").isNotNull())
    single = facts.select(
        *KEYS, "since", F.col("since").alias("until"), F.when(F.col("ok"), F.col("at")).alias("last_ok"),
        F.when(~F.col("ok"), F.col("at")).alias("miss"),
    )
    good = single.groupBy(*KEYS, "since").agg(F.max("last_ok").alias("last_ok"))
    keys = [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in (*KEYS, "since")]
    after = F.col("a.miss").isNotNull() & (F.col("b.last_ok").isNull() | (F.col("a.miss") > F.col("b.last_ok")))
    return (
        single.alias("a").join(good.alias("b"), keys[0] & keys[1] & keys[2])
        .groupBy(*[F.col(f"a.{c}").alias(c) for c in (*KEYS, "since", "until")])
        .agg(
            F.max("b.last_ok").alias("last_ok"), F.count_if(after).alias("misses"),
            F.max(F.when(after, F.col("a.miss.fetched_at"))).alias("last_miss_at"),
        )
    )


def merge(summaries: DataFrame) -> DataFrame:
    """One summary per business and question over all stretches, which must not overlap.

    Stretches that end before the day of the last good answer add nothing. Two aggregates and
    one join over summaries, never over observations.
    """
    good = summaries.groupBy(*KEYS).agg(
        F.max("last_ok").alias("last_ok"), F.min("since").alias("since"), F.max("until").alias("until")
    )
    counts = F.col("b.last_ok").isNull() | (F.col("a.until") >= F.col("b.last_ok.fetched_at").cast("date"))
    same = F.col("a.business_id").eqNullSafe(F.col("b.business_id")) & F.col("a.question").eqNullSafe(F.col("b.question"))
    return (
        summaries.alias("a").join(good.alias("b"), same)
        .groupBy(*[F.col(f"b.{c}").alias(c) for c in (*KEYS, "since", "until", "last_ok")])
        .agg(
            F.sum(F.when(counts, F.col("a.misses")).otherwise(0)).alias("misses"),
            F.max(F.when(counts, F.col("a.last_miss_at"))).alias("last_miss_at"),
        )
    )


def ladder(summary: DataFrame, backoff_days: Sequence[int] = BACKOFF_DAYS) -> DataFrame:
    """What `miss_ladder` gives over the observations behind `summary`, a merged one."""
    again = retry_after(F.col("misses"), F.col("last_miss_at"), backoff_days)
    return summary.where("misses > 0").select(*KEYS, "misses", "last_miss_at", again.alias("retry_after"))


def freshness(summary: DataFrame) -> DataFrame:
    """What `observe.freshness` gives over the observations behind `summary`, a merged one."""
    return summary.where(F.col("last_ok").isNotNull()).select(*KEYS, F.col("last_ok.fetched_at").alias("last_ok_at"))
