"""Mixing sources to target weights by Poisson replication.

A source's share of the mix over its share of the corpus is its mean repetition rate. Every
document draws its count from the Poisson distribution of that mean, by inverting the
distribution at a number hashed from the seed and its id: the same document always draws the
same count, whatever the partitions. Documents are exploded by their counts and dealt out by a
hashed key. Column expressions only.
"""

from __future__ import annotations

import math
from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from doorstep.llm.store import packed

REST = ""


def unit(seed: int, *parts: Column) -> Column:
    """A number in [0, 1) from 52 bits of an md5."""
    text = F.concat_ws(":", F.lit(str(seed)), *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") / float(1 << 52)


#: Beyond this mean a count is worked out from the normal quantile, not looked up.
LOOKED_UP = float(1 << 20)
#: Standard deviations on both sides of the mean that a looked-up distribution spans: outside
#: lies less than 1e-30 of it.
SPAN = 12


def _log_factorial(k: Column) -> Column:
    """ln k!, by the factors up to 32 and by Stirling's series beyond."""
    x = k.cast("double") + 1
    series = (
        (x - 0.5) * F.log(x) - x + 0.5 * math.log(2 * math.pi)
        + 1 / (12 * x) - 1 / (360 * F.pow(x, F.lit(3))) + 1 / (1260 * F.pow(x, F.lit(5)))
    )
    small = F.element_at(F.array(*[F.lit(math.lgamma(n + 1)) for n in range(33)]), F.least(k, F.lit(32)).cast("int") + 1)
    return F.when(k <= 32, small).otherwise(series)


def rates(docs: DataFrame, weights: Mapping[str, float], size: float = 1.0) -> DataFrame:
    """Per pool: `rate`, its mean repetition, `first`, and `steps`, the distribution from count `first` on.

    A pool is a source with a weight; sources without one form the rest, with what weight is
    left of 1. Rows: at most one per weight and one more. Sizes are characters; `size` is the
    mix's size over the corpus's. A pool without any characters has no rate and no steps.
    `steps` covers SPAN standard deviations on both sides of the mean, at most some 25,000
    numbers; it is empty where the rate is 0 and where counts are worked out instead.
    """
    pool = pool_of(weights)
    chars = F.char_length(F.coalesce("text", F.lit(""))).cast("bigint")
    sums = docs.select(pool.alias("pool"), chars.alias("c")).groupBy("pool").agg(F.sum("c").alias("chars"))
    left = max(0.0, 1.0 - sum(weights.values()))
    target = F.lit(left)
    for name, weight in weights.items():
        target = F.when(F.col("pool") == name, F.lit(float(weight))).otherwise(target)
    total = F.sum("chars").over(Window.partitionBy(F.lit(0)))
    rated = sums.select(
        "pool", F.when(F.col("chars") > 0, target * size * total / F.col("chars")).alias("rate")
    )
    wide = SPAN * F.sqrt("rate") + 30
    rated = rated.select(
        "pool", "rate", F.greatest(F.lit(0), F.floor(F.col("rate") - wide)).cast("bigint").alias("first"),
        F.ceil(F.col("rate") + wide).cast("bigint").alias("last"),
    )
    looked_up = (F.col("rate") > 0) & (F.col("rate") <= LOOKED_UP)
    terms = rated.where(looked_up).select("pool", "rate", F.explode(F.sequence("first", "last")).alias("k"))
    power = F.when(F.col("k") == 0, 0.0).otherwise(F.col("k") * F.log("rate"))
    terms = terms.withColumn("p", F.exp(power - F.col("rate") - _log_factorial(F.col("k"))))
    order = Window.partitionBy("pool").orderBy("k")
    steps = terms.withColumn("below", F.sum("p").over(order)).groupBy("pool").agg(
        F.sort_array(F.collect_list("below")).alias("steps")
    )
    return rated.join(steps, "pool", "left").select("pool", "rate", "first", "steps")


def normal_quantile(u: Column) -> Column:
    """The standard normal quantile, by Acklam's rational approximations (relative error 1.2e-9)."""
    # fixed values of the approximation
    a = (-3.969683028665376e01, 2.209460984245205e02, -2.759285104469687e02, 1.383577518672690e02, -3.066479806614716e01, 2.506628277459239e00)
    b = (-5.447609879822406e01, 1.615858368580409e02, -1.556989798598866e02, 6.680131188771972e01, -1.328068155288572e01, 1.0)
    c = (-7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e00, -2.549732539343734e00, 4.374664141464968e00, 2.938163982698783e00)
    d = (7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e00, 3.754408661907416e00, 1.0)

    def poly(values: tuple[float, ...], x: Column) -> Column:
        return reduce(lambda acc, v: acc * x + v, values[1:], F.lit(values[0]))

    u = F.greatest(F.least(u, F.lit(1 - 2.0**-53)), F.lit(2.0**-53))
    q = u - 0.5
    low, high = F.sqrt(-2 * F.log(u)), F.sqrt(-2 * F.log(1 - u))
    return (
        F.when(u < 0.02425, poly(c, low) / poly(d, low))
        .when(u > 1 - 0.02425, -poly(c, high) / poly(d, high))
        .otherwise(q * poly(a, q * q) / poly(b, q * q))
    )


def large_count(rate: Column, u: Column) -> Column:
    """The Poisson count at `u` for a large mean, by the Cornish-Fisher expansion of its quantile."""
    z, root = normal_quantile(u), F.sqrt(rate)
    return F.floor(rate + root * z + (z * z - 1) / 6 + (z - z * z * z) / (72 * root) + 0.5).cast("bigint")


def pool_of(weights: Mapping[str, float]) -> Column:
    return F.when(F.col("source").isin(*weights), F.col("source")).otherwise(F.lit(REST)) if weights else F.lit(REST)


def mix(docs: DataFrame, weights: Mapping[str, float], size: float = 1.0, seed: int = 17) -> DataFrame:
    """Rows of `docs`, each as often as it drew, plus `copy` (from 1) and `place`.

    Rows are dealt to partitions by `place`, a hash of seed, id, text and copy, and sorted by it
    inside: reading partitions in turn is a global shuffle, and a source with most rows is
    spread like any other. Null sources belong to the rest; null ids draw by their text, so equal
    texts without an id draw alike. A pool whose texts are all null or empty can give no
    characters to any share: its rows stay, once each. Columns `copy` and `place` of the input
    are replaced; all others pass unchanged, whatever their names.
    """
    base = docs.drop("copy", "place")
    draw = unit(seed, F.col("doc_id"), F.when(F.col("doc_id").isNull(), F.col("text")))
    rows = packed(
        base, u=draw, pool=pool_of(weights), key=F.coalesce(F.col("doc_id").cast("string"), F.col("text"))
    )
    # One row per weight and one more, each of at most some 25,000 numbers.
    table = F.broadcast(rates(base, weights, size))
    found = F.col("first") + F.size(F.filter("steps", lambda s: s <= F.col("u")))
    times = (
        F.when(F.col("rate").isNull(), F.lit(1))
        .when(F.col("rate") <= 0, F.lit(0))
        .when(F.col("rate") > LOOKED_UP, large_count(F.col("rate"), F.col("u")))
        .otherwise(found)
    )
    drawn = rows.join(table, "pool").select("row", "key", times.cast("bigint").alias("n")).where("n > 0")
    copies = drawn.select("row", "key", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("n"))).alias("copy"))
    place = F.md5(F.concat_ws(":", F.lit(str(seed)), F.lit("place"), "key", F.col("copy").cast("string")))
    dealt = copies.select("row", F.col("copy").cast("int").alias("copy"), place.alias("place"))
    return dealt.repartition("place").sortWithinPartitions("place").select("row.*", "copy", "place")
