"""Exact percentiles of whole numbers in bounded memory, by histograms refined digit by digit.

A group's values are counted by their highest 16 bits; only the bucket that holds a wanted rank
is counted by its next 16 bits, and so on: four rounds, after which the bucket is the value. A
group never has more than 65,536 counters a bucket, however many distinct values it holds.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from doorstep.session import written

DIGIT = 16


def exact_percentiles(df: DataFrame, by: Sequence[str], value: str, points: Mapping[str, float]) -> DataFrame:
    """`by`, `n` and each of `points` (name: share of the way from least to greatest), interpolated.

    `value` is a whole number (null: not counted; a group without values gets nulls). Groups may
    have nulls in `by`. Names of the caller's other columns do not matter.
    """
    group = F.struct(*[F.col(f"`{c}`").alias(f"g{i}") for i, c in enumerate(by)], F.lit(0).alias("all"))
    rows = written(df.select(group.alias("g"), F.col(f"`{value}`").cast("bigint").alias("v")), "values")
    groups = written(rows.groupBy("g").agg(F.count("v").alias("n")), "groups")
    known = rows.where(F.col("v").isNotNull())

    place = {name: F.lit(float(p)) * (F.col("n") - 1) for name, p in points.items()}
    wanted = F.array_distinct(F.flatten(F.array(*[F.array(F.floor(h), F.ceil(h)) for h in place.values()])))
    ranks = groups.where("n > 0").select("g", F.explode(wanted).alias("rank"))
    ranks = ranks.select("g", "rank", F.col("rank").alias("left"), F.lit(0).cast("bigint").alias("bucket"))
    for shift in range(64 - DIGIT, -1, -DIGIT):
        first = shift == 64 - DIGIT
        ranks = written(ranks, "ranks")
        above = F.lit(0).cast("bigint") if first else F.shiftright("v", shift + DIGIT)
        counted = known.select("g", above.alias("bucket"), F.shiftright("v", shift).alias("next"))
        counted = counted.join(ranks.select("g", "bucket").distinct(), ["g", "bucket"], "left_semi")
        counted = counted.groupBy("g", "bucket", "next").agg(F.count(F.lit(1)).alias("size"))
        upto = F.sum("size").over(Window.partitionBy("g", "bucket").orderBy("next"))
        ranks = ranks.join(counted.withColumn("upto", upto), ["g", "bucket"]).where(
            (F.col("left") < F.col("upto")) & (F.col("left") >= F.col("upto") - F.col("size"))
        ).select("g", "rank", (F.col("left") - F.col("upto") + F.col("size")).alias("left"), F.col("next").alias("bucket"))
    found = ranks.groupBy("g").agg(F.map_from_entries(F.collect_list(F.struct("rank", "bucket"))).alias("at"))

    def between(h):
        low, high = (F.element_at("at", f(h)).cast("double") for f in (F.floor, F.ceil))
        return low + (h - F.floor(h)) * (high - low)

    return groups.join(found, "g", "left").select(
        *[F.col(f"g.g{i}").alias(c) for i, c in enumerate(by)], "n",
        *[between(h).alias(name) for name, h in place.items()],
    )
