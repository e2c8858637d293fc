"""The index over memories against the exact answer."""

import math
import random

import pytest
from pyspark.sql import functions as F

from doorstep.operators import recall
from doorstep.session import fresh_path

TYPE = "scope int, id long, embedding array<float>, expires_at timestamp"


def asked_of(memories):
    return memories.groupBy("scope").agg(F.min("id").alias("question_id"), F.min_by("embedding", "id").alias("embedding"))


def found(rows):
    out = {}
    for r in rows.collect():
        out.setdefault(r.question_id, {})[r["rank"]] = (r.memory_id, r.similarity)
    return out


def test_recall_and_work_on_given_vectors(spark):
    e = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    memories = e.select(F.col("label").alias("scope"), F.col("vec_id").alias("id"), "embedding")
    asked, how, path = asked_of(memories), recall.Sketch(64), fresh_path(spark, "memories")
    recall.build_index(memories, path, how)
    exact = found(recall.nearest(memories, asked, 10))
    pairs = memories.join(asked.select("scope"), "scope").count()
    few = recall.candidates(spark, path, asked, 19, how).count()
    got = found(recall.nearest_indexed(spark, path, asked, 10, how, rescored=19))
    hits = sum(len({m for m, _ in exact[q].values()} & {m for m, _ in got[q].values()}) for q in exact)
    assert few < pairs / 10 and hits >= 0.9 * sum(map(len, exact.values()))
    for q, rows in got.items():
        scores = dict(exact[q].values())
        assert [s for _, s in (rows[k] for k in sorted(rows))] == sorted((s for _, s in rows.values()), reverse=True)
        assert all(scores.get(m, s) == pytest.approx(s, abs=1e-12) for m, s in rows.values())


def test_a_hot_scope_is_many_buckets(spark):
    draw = random.Random(5)
    centres = [[draw.gauss(0, 1) for _ in range(20)] for _ in range(40)]
    rows = []
    for k in range(3000):
        near = [x + draw.gauss(0, 0.2) for x in centres[k % 40]]
        rows.append((1 if k % 100 else 2, k, near, None))
    memories = spark.createDataFrame(rows, TYPE)
    how, path = recall.Sketch(20, bucket_rows=64), fresh_path(spark, "memories")
    recall.build_index(memories, path, how)
    buckets = spark.read.parquet(f"{path}/buckets").collect()
    hot = [b.n for b in buckets if b.scope == 1]
    assert {b.bits for b in buckets if b.scope == 2} == {0} and len(hot) > 10 and max(hot) < 600
    asked = memories.where("id % 150 = 1").select("scope", F.col("id").alias("question_id"), "embedding")
    exact, got = found(recall.nearest(memories, asked, 5)), found(recall.nearest_indexed(spark, path, asked, 5, how))
    hits = sum(len({m for m, _ in exact[q].values()} & {m for m, _ in got.get(q, {}).values()}) for q in exact)
    assert hits >= 0.9 * sum(map(len, exact.values()))


def test_odd_memories(spark):
    when = "2024-01-01 00:00:00"
    rows = [(1, 1, [1.0, 0.0], None), (1, 2, [0.0, 0.0], None), (1, 3, None, None), (None, 4, [1.0, 0.0], None),
            (1, 5, [1.0, 0.1], None), (1, 6, [1.0], None), (1, 5, [1.0, 0.1], None), (2, 7, [0.0, 1.0], None)]
    memories = spark.createDataFrame(rows, TYPE).withColumn(
        "expires_at", F.when(F.col("id") == 5, F.lit(when).cast("timestamp"))
    )
    asked = spark.createDataFrame([(1, 10, [2.0, 0.0]), (2, 11, [0.0, 0.0]), (3, 12, [1.0, 1.0]), (2, 13, [1.0, 0.0])],
                                  "scope int, question_id long, embedding array<float>")
    how, path = recall.Sketch(2), fresh_path(spark, "memories")
    recall.build_index(memories, path, how)
    got = found(recall.nearest_indexed(spark, path, asked, 3, how))
    assert {q: [m for m, _ in v.values()] for q, v in got.items()} == {10: [1, 5, 5], 13: [7]}
    later = F.lit("2025-01-01 00:00:00").cast("timestamp")
    assert [m for m, _ in found(recall.nearest_indexed(spark, path, asked, 3, how, asof=later))[10].values()] == [1]
    recall.build_index(memories.limit(0), path, how)
    assert recall.nearest_indexed(spark, path, asked, 3, how).count() == 0


def test_signs_follow_the_angle(spark):
    draw = random.Random(9)
    how = recall.Sketch(48)
    rows = []
    for k in range(60):
        a = [draw.gauss(0, 1) for _ in range(48)]
        b = [x + draw.gauss(0, 0.2 * (k % 6)) for x in a]
        rows.append((a, b))
    df = spark.createDataFrame(rows, "a array<double>, b array<double>")
    apart = recall.bits_apart(how.of(F.col("a")), how.of(F.col("b"))).alias("n")
    cosine = recall.dot(recall.unit(F.col("a")), recall.unit(F.col("b"))).alias("c")
    for r in df.select(apart, cosine).collect():
        assert abs(r.n / (how.rotations * how.wide) - math.acos(max(-1, min(1, r.c))) / math.pi) < 0.08
