"""Attaching values to keys with many rows."""

import pytest

from doorstep.llm.spread import attach


@pytest.mark.parametrize("heavy", [7, None])
@pytest.mark.parametrize("how", ["left", "inner"])
def test_heavy_keys_are_dealt_without_a_join_of_their_own(spark, heavy, how):
    rows = [(i, heavy) for i in range(3000)] + [(9000 + i, i % 500 + 100) for i in range(1000)] + [(5, 9), (6, 9)]
    values = [(heavy, "heavy")] + [(k, f"v{k}") for k in range(100, 500)] + [(8, "unused")]
    df = spark.createDataFrame(rows, "id long, k long").cache()
    got = attach(df, spark.createDataFrame(values, "k long, v string"), "k", how)
    of = dict(values)
    want = [(i, k, of.get(k)) for i, k in rows if how == "left" or k in of]
    assert sorted(map(str, (tuple(r) for r in got.select("id", "k", "v").collect()))) == sorted(map(str, want))
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join ") == 1


def test_a_row_of_nothing_but_its_key_and_no_rows(spark):
    values = spark.createDataFrame([("a", 1), (None, 2)], "k string, v int")
    keys = spark.createDataFrame([("a",)] * 3000 + [(None,)] * 2000 + [("b",)], "k string")
    got = attach(keys, values, "k")
    assert {tuple(r) for r in got.groupBy("k", "v").count().collect()} == {("a", 1, 3000), (None, 2, 2000), ("b", None, 1)}
    assert attach(keys.limit(0), values, "k").count() == 0
