"""Merged summaries equal the rules over all observations, however the days are grouped."""

from doorstep.operators import observe, summaries


def rows_of(df):
    return sorted(map(str, df.collect()))


def test_thirty_days_merge_in_any_grouping(spark):
    rows = [
        (f"o{k}", f"b{k % 11}" if k % 97 else None, ["tinyfish_web", "instagram_handle", "ad_library", "other"][k * 7 % 4],
         ["ok", "no_data", "no_data", "blocked", "no_data", "error"][(k * k + k // 5) % 6],
         f"2024-01-{k * 13 % 30 + 1:02d} {k % 24:02d}:00:00")
        for k in range(1500)
    ]
    text = spark.createDataFrame(rows, "id string, business_id string, source string, status string, fetched_at string")
    seen = text.withColumn("fetched_at", text.fetched_at.cast("timestamp"))
    seen = seen.where("business_id is not null")
    days = summaries.daily(seen)
    once = summaries.merge(days)
    parts = [summaries.merge(days.where(f"day(since) between {a} and {b}")) for a, b in ((1, 4), (5, 17), (18, 30))]
    twice = summaries.merge(summaries.merge(parts[2].unionByName(parts[0].limit(0))).unionByName(
        summaries.merge(parts[1].unionByName(parts[0]))))
    for merged in (once, twice):
        assert rows_of(summaries.ladder(merged)) == rows_of(observe.miss_ladder(seen))
        assert rows_of(summaries.freshness(merged)) == rows_of(observe.freshness(seen))


def test_none(spark):
    schema = "id string, business_id string, source string, status string, fetched_at timestamp"
    empty = summaries.merge(summaries.daily(spark.createDataFrame([], schema)))
    assert summaries.ladder(empty).collect() == [] and summaries.freshness(empty).collect() == []
