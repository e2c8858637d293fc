"""Ranks and running sums, with one group holding most rows and with the hot path forced."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from doorstep.operators import ordering


@pytest.fixture(scope="module")
def skewed(spark):
    rng = random.Random(7)
    rows = [
        (None if rng.random() < 0.05 else ("hot" if rng.random() < 0.6 else rng.choice("abc")),
         rng.randint(0, 20), i, rng.randint(0, 9))
        for i in range(3000)
    ]
    return spark.createDataFrame(rows, "g string, v int, id int, w int")


@pytest.mark.parametrize("by", [["g"], []])
def test_running_totals_equal_the_window(skewed, by):
    order = [F.col("v"), F.col("id")]
    window = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    want = skewed.select(
        "*", F.row_number().over(Window.partitionBy(*by).orderBy(*order)).cast("long").alias("rank"),
        F.sum("w").over(window).alias("through"), F.sum("w").over(Window.partitionBy(*by)).alias("all"),
    )
    totals = {"rank": F.lit(1).cast("long"), "through": F.col("w")}
    got = ordering.running_totals(skewed, by, order, totals, {"all": F.col("w")})
    assert got.columns == want.columns
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_a_group_with_nearly_all_rows_is_many_pieces(spark):
    spread = spark.range(20_000).select(
        F.when(F.col("id") % 100 == 0, F.col("id")).alias("g"), F.xxhash64("id").alias("v"), "id"
    )
    order = [F.col("v"), F.col("id")]
    pieces = ordering._Pieces(spread, ["g"], order, {}).rows.groupBy("_rt_piece").count().collect()
    count = int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert len(pieces) == count and max(r["count"] for r in pieces) < 2.5 * 20_000 / count
    want = spread.withColumn("rank", F.row_number().over(Window.partitionBy("g").orderBy(*order)).cast("long"))
    got = ordering.rank_within(spread, ["g"], order)
    assert got.exceptAll(want).isEmpty() and got.count() == 20_000


def test_order_of_texts_nulls_and_empty_tables(spark):
    texts = [None, "", "a", "B", "ä", "z" * 300, "\U0001f600", "aa", "A"]
    df = spark.createDataFrame([(t, n) for n, t in enumerate(texts * 30)], "t string, n int")
    order = [F.col("t"), -F.col("n")]
    want = df.withColumn("rank", F.row_number().over(Window.orderBy(*order)).cast("long"))
    assert ordering.rank_within(df, [], order).exceptAll(want).isEmpty()
    assert ordering.rank_within(df.limit(0), [], order).count() == 0
    assert ordering.with_previous(df.limit(0), ["t"], [F.col("n")], {"p": "n"}).count() == 0
    assert ordering.rank_within(df.limit(1), ["t"], order).first()["rank"] == 1


@pytest.mark.parametrize("by", [["g"], []])
def test_previous_row(skewed, by):
    order = [F.col("v"), F.col("id")]
    window = Window.partitionBy(*by).orderBy(*order)
    want = skewed.select("*", F.lag("id").over(window).alias("before"), F.lag("g").over(window).alias("group_before"))
    got = ordering.with_previous(skewed, by, order, {"before": "id", "group_before": "g"})
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_no_window_runs_over_all_rows(skewed):
    plan = ordering.rank_within(skewed, [], [F.col("v"), F.col("id")])._jdf.queryExecution().executedPlan().toString()
    windows = [line for line in plan.splitlines() if "Window [" in line and "_rt_o0" in line]
    assert windows and all("_rt_piece" in line for line in windows)


def test_tiles_equal_ntile(spark):
    for size in (1, 2, 3, 4, 7, 40):
        df = spark.range(size).select((F.col("id") + 1).alias("r"))
        w = Window.orderBy("r")
        got = df.select(
            ordering.tile(F.col("r"), F.lit(size), 3).alias("a"), F.ntile(3).over(w).alias("b")
        ).collect()
        assert all(x.a == x.b for x in got)
