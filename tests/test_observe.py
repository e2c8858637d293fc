"""Miss ladder, lookups due, offers."""

import datetime as dt

from pyspark.sql import functions as F

from doorstep.operators import observe, offers

T0 = dt.datetime(2024, 1, 1)


def observations(spark, rows):
    return spark.createDataFrame(
        [(i, 1, s, st, T0 + dt.timedelta(days=d)) for i, (s, st, d) in enumerate(rows)],
        "id int, business_id int, source string, status string, fetched_at timestamp",
    )


def test_ladder_lengths(spark):
    for misses, days in ((1, 30), (2, 90), (3, 180), (4, None)):
        df = observations(spark, [("ad_library", "no_data", d) for d in range(misses)])
        (row,) = observe.miss_ladder(df).collect()
        assert row.misses == misses
        want = None if days is None else T0 + dt.timedelta(days=misses - 1 + days)
        assert row.retry_after == want


def test_failures_do_not_count_and_success_clears(spark):
    df = observations(spark, [
        ("tinyfish_web", "no_data", 0), ("firecrawl_web", "ok", 1), ("tinyfish_web", "blocked", 2),
        ("firecrawl_web", "no_data", 3), ("tinyfish_web", "error", 4),
    ])
    (row,) = observe.miss_ladder(df).collect()
    assert (row.question, row.misses) == ("website", 1)


def test_ladder_decides_before_freshness(spark):
    df = observations(spark, [("ad_library", "ok", 40), ("ad_library", "no_data", 41)])
    wanted = spark.createDataFrame([(1, "ad_library"), (1, "website")], "business_id int, question string")

    def reason(day):
        out = observe.lookups(
            wanted, observe.miss_ladder(df), observe.freshness(df), F.lit(T0 + dt.timedelta(days=day))
        )
        return {r.question: r.skip_reason for r in out.collect()}

    assert reason(45) == {"ad_library": "negative_cache", "website": None}
    assert reason(71) == {"ad_library": None, "website": None}
    fresh = observe.lookups(
        wanted, observe.miss_ladder(df.where("status = 'ok'")), observe.freshness(df), F.lit(T0 + dt.timedelta(days=53))
    )
    assert {r.question: r.skip_reason for r in fresh.collect()} == {"ad_library": "fresh", "website": None}


def test_offers_need_every_signal_and_the_category(spark):
    df = spark.createDataFrame(
        [(1, "salon", ["no booking link"]), (2, "preschool", ["no booking link"]),
         (3, "preschool", ["no booking link", "manual enquiry flow"]),
         (4, "unheard", ["runs meta ads", "no landing page", "no booking link"]), (5, "salon", [])],
        "business_id int, niche_id string, signals array<string>",
    )
    want = {(1, "appointment_booking"), (3, "enrolment_scheduling"), (4, "lead_capture")}
    assert {(r.business_id, r.offer_id) for r in offers.firing(df).collect()} == want
    rows = df.select("business_id", F.explode("signals").alias("signal"))
    divided = offers.firing_from_rows(rows.union(rows), df.select("business_id", "niche_id"))
    assert {(r.business_id, r.offer_id) for r in divided.collect()} == want


def test_no_row_no_claim(spark):
    df = spark.createDataFrame(
        [(1, "none", None, 7, True, 8), (2, "own_site", ["enquiry"], 9, None, None),
         (3, "none", ["ordering"], None, True, None), (4, None, ["ordering"], 5, False, 6)],
        "business_id int, website_verdict string, gaps array<string>, web_row int, runs_ads boolean, ads_row int",
    )
    got = {(r.business_id, r.signal, r.observation_id) for r in offers.observed_signals(df).collect()}
    assert got == {
        (1, "no landing page", 7), (1, "runs meta ads", 8), (2, "no booking link", 9),
        (2, "no enquiry form", 9), (2, "manual enquiry flow", 9),
    }
