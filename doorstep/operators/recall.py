"""Nearest memories by cosine: exactly, or through an index of random hyperplanes.

The index gives every memory a sketch, the signs of its products with many random directions,
and a bucket, the first signs of the sketch. A scope has as many buckets as its size asks for, one
where it is small, so that no scope is one task. A question probes the buckets nearest to its
own, its candidates are the memories whose sketches differ from its own in the fewest places, and only
those are scored exactly. Directions are the rows of rotations made of random signs and Hadamard
steps, so that a sketch costs n log n and stays in column expressions.
"""

from __future__ import annotations

import json
import math
import random
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from doorstep.operators.ordering import first_n_within


def once(value: Column, body) -> Column:
    """`body` of `value`, which is worked out once however often the body reads it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def unit(vector: Column) -> Column:
    """The vector scaled to length one, as doubles; NULL for the zero vector."""
    wide = F.transform(vector, lambda x: x.cast("double"))

    def scaled(w: Column) -> Column:
        norm = F.sqrt(F.aggregate(w, F.lit(0.0), lambda acc, x: acc + x * x))
        return once(norm, lambda n: F.when(n > 0, F.transform(w, lambda x: x / n)))

    return once(wide, scaled)


def dot(left: Column, right: Column) -> Column:
    return F.aggregate(
        F.zip_with(left, right, lambda a, b: a * b), F.lit(0.0), lambda acc, x: acc + x
    )


def nearest(
    memories: DataFrame, asked: DataFrame, k: int, asof: Column | None = None
) -> DataFrame:
    """The `k` closest unexpired memories of each question's scope.

    Memories and questions meet on the scope. Each task keeps its own best `k` per question
    before the shuffle, so pairs are never written out; the questions are the small side and
    whether they are broadcast is left to their measured size.
    """
    live = memories if asof is None else memories.where(
        F.col("expires_at").isNull() | (F.col("expires_at") > asof)
    )
    stored = live.select("scope", F.col("id").alias("memory_id"), unit(F.col("embedding")).alias("_m"))
    wanted = asked.select("scope", "question_id", unit(F.col("embedding")).alias("_q"))
    scored = stored.join(wanted, "scope").select(
        "question_id", "memory_id", "scope", dot(F.col("_m"), F.col("_q")).alias("similarity")
    )
    ranked = first_n_within(
        scored, ["question_id"], [F.desc_nulls_last("similarity"), F.asc("memory_id")], k
    )
    # Zero vectors rank last; dropping them here keeps the product out of the join condition.
    return ranked.where(F.col("similarity").isNotNull())


@dataclass(frozen=True)
class Sketch:
    """How memories are sketched and dealt to buckets; an index and its questions share it.

    `rotations` times the vectors' length (filled up to a power of two) is the number of signs.
    `bucket_rows` is the size that buckets are made for. A question probes the buckets that differ
    from its own in so many signs as a memory of cosine `near` exceeds with odds of 1 - `sure`.
    """

    length: int
    rotations: int = 16
    bucket_rows: int = 65_536
    near: float = 0.6
    sure: float = 0.95
    seed: int = 11

    @property
    def wide(self) -> int:
        return 1 << max(0, (self.length - 1).bit_length())

    @property
    def words(self) -> int:
        return -(-self.rotations * self.wide // 64)

    def signs(self) -> Column:
        """Two rows of random signs per rotation, the same in every session."""
        draw = random.Random(self.seed)
        table = [[[draw.choice((-1, 1)) for _ in range(self.wide)] for _ in (0, 1)] for _ in range(self.rotations)]
        return F.from_json(F.lit(json.dumps(table)), "array<array<array<double>>>")

    def of(self, vector: Column) -> Column:
        """The sketch of a vector of doubles, as 64-bit numbers; null for null."""
        filled = F.concat(vector, F.array_repeat(F.lit(0.0), self.wide - self.length)) if self.wide > self.length else vector

        def turned(v: Column, signs: Column) -> Column:
            for step in (0, 1):
                v = _hadamard(F.zip_with(v, F.get(signs, F.lit(step)), lambda x, s: x * s), self.wide)
            return F.transform(v, lambda x: F.when(x > 0, F.lit(1)).otherwise(F.lit(0)).cast("bigint"))

        def numbers(every: Column) -> Column:
            return F.transform(
                F.sequence(F.lit(0), F.lit(self.words - 1)),
                lambda w: F.aggregate(
                    F.slice(every, w * 64 + 1, 64), F.lit(0).cast("bigint"),
                    lambda acc, b: F.shiftleft(acc, 1).bitwiseOR(b),
                ),
            )

        every = once(filled, lambda v: F.flatten(F.transform(self.signs(), lambda signs: turned(v, signs))))
        return F.when(vector.isNotNull(), once(every, numbers))

    def reach(self, bits: int) -> int:
        """Differing signs, of so many, that a question's probes go to."""
        p = math.acos(self.near) / math.pi
        covered, k = 0.0, -1
        while k < bits and covered < self.sure:
            k += 1
            covered += math.comb(bits, k) * p**k * (1 - p) ** (bits - k)
        return k


#: Signs that name a bucket at most.
BUCKET_BITS = 40


def _hadamard(vector: Column, wide: int) -> Column:
    """Sums and differences in log2(wide) steps: products with all rows of a Hadamard matrix."""
    step = 1
    while step < wide:
        vector = _butterfly(vector, step)
        step *= 2
    return vector


def _butterfly(vector: Column, step: int) -> Column:
    def one(v: Column) -> Column:
        def at(x: Column, i: Column) -> Column:
            return F.when(i.bitwiseAND(F.lit(step)) == 0, x + F.get(v, i + step)).otherwise(F.get(v, i - step) - x)

        return F.transform(v, at)

    return once(vector, one)


def bits_apart(left: Column, right: Column) -> Column:
    """How many signs of two sketches differ."""
    return F.aggregate(
        F.zip_with(left, right, lambda a, b: F.bit_count(a.bitwiseXOR(b))), F.lit(0), lambda acc, x: acc + x
    )


def _bucket(sketch: str, bits: str) -> Column:
    return F.expr(f"CASE WHEN {bits} = 0 THEN 0L ELSE shiftrightunsigned({sketch}[0], 64 - {bits}) END")


def build_index(memories: DataFrame, path: str, how: Sketch) -> None:
    """Write the index of `memories` (scope, id, embedding, expires_at if there) under `path`.

    `rows` holds a line per memory with its unit vector and sketch, dealt by (scope, bucket);
    `buckets` a line per bucket with its count. Memories without a scope, and null or zero vectors, can
    be near to nothing and are left out; so are vectors of another length.
    """
    expires = F.col("expires_at") if "expires_at" in memories.columns else F.lit(None).cast("timestamp")
    kept = memories.where(F.col("scope").isNotNull() & (F.size("embedding") == how.length)).select(
        "scope", F.col("id").alias("memory_id"), expires.alias("expires_at"), unit(F.col("embedding")).alias("unit")
    ).where("unit IS NOT NULL")
    # Only scopes of more than one bucket are in the table joined here.
    wide = (
        memories.where(F.col("scope").isNotNull()).groupBy("scope").agg(F.count(F.lit(1)).alias("n"))
        .where(F.col("n") > how.bucket_rows)
        .select("scope", F.least(F.ceil(F.log2(F.col("n") / how.bucket_rows)), F.lit(BUCKET_BITS)).cast("int").alias("bits"))
    )
    rows = (
        kept.withColumn("sketch", how.of(F.col("unit"))).join(wide, "scope", "left")
        .withColumn("bits", F.coalesce("bits", F.lit(0))).withColumn("bucket", _bucket("sketch", "bits"))
    )
    rows.repartition("scope", "bucket").sortWithinPartitions("scope", "bucket").write.mode("overwrite").parquet(f"{path}/rows")
    (
        rows.sparkSession.read.parquet(f"{path}/rows").groupBy("scope", "bits", "bucket")
        .agg(F.count(F.lit(1)).alias("n")).write.mode("overwrite").parquet(f"{path}/buckets")
    )


def candidates(
    spark: SparkSession, path: str, asked: DataFrame, rescored: int, how: Sketch, asof: Column | None = None
) -> DataFrame:
    """Per question the `rescored` unexpired memories of its probed buckets with the nearest sketches."""
    buckets = spark.read.parquet(f"{path}/buckets")
    rows = spark.read.parquet(f"{path}/rows")
    if asof is not None:
        rows = rows.where(F.col("expires_at").isNull() | (F.col("expires_at") > asof))
    wanted = asked.where(F.size("embedding") == how.length).select(
        "scope", "question_id", unit(F.col("embedding")).alias("asked_unit")
    ).where("asked_unit IS NOT NULL").withColumn("asked_sketch", how.of(F.col("asked_unit")))
    reach = F.element_at(F.lit([how.reach(b) for b in range(BUCKET_BITS + 1)]), F.col("bits") + 1)
    own = _bucket("asked_sketch", "bits")
    probes = (
        wanted.join(buckets.select("scope", "bits", "bucket"), "scope")
        .where(F.bit_count(own.bitwiseXOR(F.col("bucket"))) <= reach).drop("bits")
    )
    met = rows.select("scope", "bucket", "memory_id", "unit", "sketch").join(probes, ["scope", "bucket"]).select(
        "question_id", "memory_id", "scope", "unit", "asked_unit", bits_apart(F.col("sketch"), F.col("asked_sketch")).alias("apart")
    )
    return first_n_within(met, ["question_id"], [F.asc("apart"), F.asc("memory_id")], rescored, "place")


def nearest_indexed(
    spark: SparkSession, path: str, asked: DataFrame, k: int, how: Sketch, rescored: int | None = None,
    asof: Column | None = None,
) -> DataFrame:
    """As `nearest`, through an index: the `k` closest of the `rescored` (default 5 k) nearest by sketch."""
    scored = candidates(spark, path, asked, rescored or 5 * k, how, asof).select(
        "question_id", "memory_id", "scope", dot(F.col("unit"), F.col("asked_unit")).alias("similarity")
    )
    return first_n_within(scored, ["question_id"], [F.desc("similarity"), F.asc("memory_id")], k)
