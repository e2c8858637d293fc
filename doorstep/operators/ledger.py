"""Budgets, call logs, run logs."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from doorstep.operators.ordering import latest_per_key, rank_within


def remaining(budget: DataFrame, keys: DataFrame, by: Sequence[str]) -> DataFrame:
    """Allowance left per key over all purposes; NULL (not 0) where none is configured."""
    left = budget.groupBy(*by).agg(
        F.sum(F.col("limit_total") - F.col("used")).alias("remaining"),
        F.count(F.lit(1)).alias("purposes"),
    )
    return keys.select(*by).distinct().join(left, list(by), "left").select(
        *by, "remaining", F.coalesce("purposes", F.lit(0)).alias("purposes")
    )


def over_allocated(budget: DataFrame, allowances: DataFrame, by: Sequence[str]) -> DataFrame:
    """Keys whose ceilings together exceed their allowance."""
    return (
        budget.groupBy(*by)
        .agg(F.sum("limit_total").alias("granted"))
        .join(allowances, list(by))
        .where(F.col("granted") > F.col("allowance"))
    )


def split_allowance(totals: DataFrame, shares: Mapping[str, float], total: str = "total") -> DataFrame:
    """Whole parts of each total by the largest remainder; ties go to the first name.

    The shares are few and known, so the split is an array inside the row.
    """
    if abs(sum(shares.values()) - 1.0) > 1e-9:
        raise ValueError("shares must sum to 1")
    parts = F.array(
        *[
            F.struct(
                F.floor(F.col(total) * share).cast("bigint").alias("part"),
                (F.col(total) * share - F.floor(F.col(total) * share)).alias("rest"),
                F.lit(name).alias("name"),
            )
            for name, share in sorted(shares.items())
        ]
    )
    floors = F.aggregate(parts, F.lit(0).cast("bigint"), lambda acc, p: acc + p["part"])
    ranked = F.array_sort(
        F.transform(parts, lambda p: F.struct((-p["rest"]).alias("o"), p["name"], p["part"]))
    )
    keep = totals.columns
    return totals.select("*", (F.col(total) - floors).alias("_short"), F.posexplode(ranked).alias("_i", "_p")).select(
        *keep,
        F.col("_p.name").alias("purpose"),
        (F.col("_p.part") + F.when(F.col("_i") < F.col("_short"), 1).otherwise(0)).alias("part"),
    )


def merged_stats(entries: DataFrame, run: str, order: Sequence[str]) -> DataFrame:
    """Key-wise merge of a run's stat entries, last writer wins, as one map per run."""
    latest = latest_per_key(entries, [run, "key"], order, ["value"])
    return latest.groupBy(run).agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("key", "value")))).alias("stats")
    )


def cached_answers(calls: DataFrame) -> DataFrame:
    """The first good answer of every prompt; errors never are one."""
    return (
        calls.where((F.col("status") == "ok") & F.col("response").isNotNull())
        .groupBy("prompt_hash")
        .agg(F.min_by(F.struct("id", "provider", "model", "response"), "id").alias("a"))
        .select(
            "prompt_hash", F.col("a.id").alias("call_id"), "a.provider", "a.model", "a.response"
        )
    )


def unpaid_prompts(prompts: DataFrame, answers: DataFrame) -> DataFrame:
    """Prompts no answer is recorded for."""
    return prompts.join(answers.select("prompt_hash"), "prompt_hash", "left_anti")


def numbered_events(events: DataFrame, run: str, order: Sequence) -> DataFrame:
    """Adds the 1-based `seq` of every event within its run."""
    return rank_within(
        events, [run], [F.col(c) if isinstance(c, str) else c for c in order], "seq",
    )


def call_costs(calls: DataFrame, by: Sequence[str]) -> DataFrame:
    """Calls, tokens, cost and latency percentiles per group."""
    return calls.groupBy(*by).agg(
        F.count(F.lit(1)).alias("calls"),
        F.sum("tokens").alias("tokens"),
        F.sum("cost").alias("cost"),
        F.percentile("latency", F.lit(0.5)).alias("latency_p50"),
        F.percentile("latency", F.lit(0.95)).alias("latency_p95"),
    )


def open_steps(
    events: DataFrame, step: Sequence[str], order: Sequence[str], terminal: Sequence[str]
) -> DataFrame:
    """Last event of every step that never reached a terminal one."""
    done = F.max(F.col("type").isin(*terminal)).alias("_done")
    place = F.struct(*order)
    return (
        events.groupBy(*step)
        .agg(
            F.max_by(F.struct("type", *order), place).alias("_last"),
            F.count(F.lit(1)).alias("events"), done,
        )
        .where(~F.col("_done"))
        .select(
            *step, "events", F.col("_last.type").alias("last_type"),
            *[F.col("_last")[c].alias(f"last_{c}") for c in order],
        )
    )
