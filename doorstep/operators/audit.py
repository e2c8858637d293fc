"""Table rules as one pass of violation counts."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Request and state vocabularies, and length limits.
VERDICTS = ("high", "medium", "low", "skip")
OUTCOMES = (
    "not_contacted", "shortlisted", "contacted", "replied", "follow_up", "not_interested",
    "converted",
)
STATES = ("unverified", "verified", "starved")
PURPOSES = ("discover", "refresh")
MAX_TEXT, MAX_NOTES, MAX_AREAS, MAX_LIMIT = 160, 5000, 25, 500


def score_rules() -> dict[str, Column]:
    index = F.col("audience_index")
    return {"audience_index_range": index.isNull() | index.between(0, 1)}


def budget_rules() -> dict[str, Column]:
    return {
        "used_non_negative": F.col("used") >= 0,
        "limit_non_negative": F.col("limit_total") >= 0,
        "used_within_limit": F.col("used") <= F.col("limit_total"),
        "purpose_known": F.col("purpose").isin(*PURPOSES),
        "fingerprint_is_digest": (F.col("key_fingerprint") == "")
        | F.col("key_fingerprint").rlike("^[0-9a-f]{12}$"),
    }


def niche_status_rules() -> dict[str, Column]:
    kind = F.schema_of_variant(F.try_parse_json("rejected_types"))
    return {
        "state_known": F.col("state").isin(*STATES),
        "counts_non_negative": (F.col("qualified") >= 0) & (F.col("rejected") >= 0),
        "rejected_types_is_object": F.coalesce(kind.startswith("OBJECT"), F.lit(False)),
    }


def verdict_rules() -> dict[str, Column]:
    verdict, outcome = F.col("my_verdict"), F.col("outcome")
    return {
        "verdict_known": verdict.isNull() | verdict.isin(*VERDICTS),
        "outcome_known": outcome.isNull() | outcome.isin(*OUTCOMES),
        "notes_length": F.coalesce(F.length("notes"), F.lit(0)) <= MAX_NOTES,
    }


def violations(df: DataFrame, rules: Mapping[str, Column]) -> DataFrame:
    """(rule, broken) for every rule, from one scan. A NULL test is no violation."""
    counted = df.agg(
        *[F.count_if(~F.coalesce(test, F.lit(True))).alias(name) for name, test in rules.items()]
    )
    rows = F.array(
        *[F.struct(F.lit(n).alias("rule"), F.col(n).alias("broken")) for n in rules]
    )
    return counted.select(F.inline(rows))


def broken_rows(df: DataFrame, rules: Mapping[str, Column]) -> DataFrame:
    """Rows breaking any rule, with the names of those they break."""
    names = F.array_compact(
        F.array(*[F.when(~F.coalesce(t, F.lit(True)), n) for n, t in rules.items()])
    )
    return df.select("*", names.alias("broken_rules")).where(F.size("broken_rules") > 0)


def duplicate_keys(df: DataFrame, key: Sequence[str]) -> DataFrame:
    """Keys that occur more than once; NULL keys are distinct from each other."""
    known = df
    for c in key:
        known = known.where(F.col(c).isNotNull())
    return known.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)
