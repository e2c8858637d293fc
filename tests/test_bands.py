"""Boundary cases of the cohort bands."""

import pytest

from doorstep.operators import bands


def band_rows(spark, reviews, scored=None):
    """One cohort: reviews per business, and which of them are scored (default all)."""
    rows = []
    for i, r in enumerate(reviews):
        on = scored is None or scored[i]
        rows.append((i, f"b{i}", "salon", "Pune", "Area", (i + 1) / 1000 if on else None,
                     "v1", 50, None, r))
    members = spark.createDataFrame(
        rows,
        "business_id int, name string, niche_id string, city string, search_area string, "
        "audience_index double, scorer_version string, total int, scored_at timestamp, reviews int",
    )
    out = bands.cohort_bands(members).orderBy("business_id").collect()
    return [(r.audience_band, r.banding_method, r.cohort_size) for r in out]


def test_thresholds_in_a_small_cohort(spark):
    got = band_rows(spark, [10, 99, 100, 500, 501])
    assert [g[0] for g in got] == ["small", "small", "medium", "medium", "large"]
    assert {g[1:] for g in got} == {("absolute", 5)}


@pytest.mark.parametrize("size,method", [(29, "absolute"), (30, "relative")])
def test_method_changes_at_thirty(spark, size, method):
    assert {g[1] for g in band_rows(spark, [200] * size)} == {method}


def test_forty_split_in_near_equal_tiles(spark):
    got = [g[0] for g in band_rows(spark, [200] * 40)]
    assert got == ["small"] * 14 + ["medium"] * 13 + ["large"] * 13


def test_unscored_take_no_tile(spark):
    scored = [i % 9 != 0 for i in range(45)]
    got = band_rows(spark, [200] * 45, scored)
    assert {g[2] for g in got} == {40}
    names = [g[0] for g in got]
    assert [names.count(n) for n in ("small", "medium", "large", "unknown")] == [14, 13, 13, 5]


def test_unreadable_reviews_are_unknown(spark):
    observed = spark.createDataFrame(
        [(1, 1, "unavailable", "2024-01-02"), (2, 1, "340", "2024-01-01"), (3, 2, "99", "2024-01-01")],
        "id int, business_id int, reviews string, fetched_at string",
    )
    from pyspark.sql import functions as F

    got = bands.latest_reviews(observed, F.lit(True), F.col("reviews")).collect()
    assert {r.business_id: r.reviews for r in got} == {1: None, 2: 99}


def test_latest_score_wins_and_unscored_stays(spark):
    scores = spark.createDataFrame(
        [(1, 1, "2024-01-01", 0.1), (2, 1, "2024-01-01", 0.9)],
        "id int, business_id int, scored_at string, audience_index double",
    ).selectExpr("*", "'v' as scorer_version", "10 as total")
    businesses = spark.createDataFrame(
        [(1, "a"), (2, "b")], "id int, name string"
    ).selectExpr("*", "'n' as niche_id", "'c' as city", "null as search_area")
    members = bands.cohort_members(
        businesses, bands.latest_scores(scores),
        spark.createDataFrame([], "business_id int, reviews int"),
    )
    got = {r.business_id: r for r in bands.cohort_bands(members).collect()}
    assert got[1].audience_index == 0.9
    assert got[2].audience_band == "unknown" and len(got) == 2
