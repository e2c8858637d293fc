"""Whole passes on small hand-written responses."""

import json

from doorstep.plans.discovery import discover
from doorstep.plans.enrichment import enrich
from doorstep.sources import payloads
from doorstep.sources.registry import Offer, Profile

SALON = Profile("salon", "Salon", include_types=("hair_salon",), exclude_types=("cafe",), terms=("blush", "aura", "known", "unnamed"), strict=True, demand=21, budget=16, offer="booking")
CAFE = Profile("cafe", "Cafe", include_types=("cafe", "coffee_shop"), demand=20, budget=13, offer="menu")


def place(i, title, kind, **more):
    return {"position": i, "title": title, "type": kind, "types": [kind], "place_id": f"P{i}", **more}


def page(*places, **envelope):
    return json.dumps({"search_metadata": {"id": "x"}, **envelope, "local_results": list(places)})


RESPONSES = [
    (1, "salon", "Pune", page(
        place(1, "Blush Hair", "Hair salon", phone="080 1", reviews=99, rating="4.5", gps_coordinates={"latitude": 1.5, "longitude": 2.5}),
        place(2, "Bean", "Cafe"), place(3, "Known Salon", "Hair salon"), place(4, None, "Hair salon", website="x.example"),
        place(5, "Quiet", "Hair salon"))),
    (2, "salon", "Pune", page(place(1, "Blush Hair", "Hair salon", website="https://blush.example"), place(6, "Aura Salon", "Hair salon"))),
    (3, "cafe", "Pune", page(place(2, "Bean", "Café"), place(7, "Bun", "Bakery"))),
    (4, "cafe", "Pune", json.dumps({"search_information": {"n": 0}})),
    (5, "cafe", "Pune", "<html>proxy</html>"),
    (6, "cafe", "Pune", json.dumps({"error": "no"})),
    (7, "cafe", "Pune", json.dumps({"search_metadata": {}, "local_results": {"a": 1}})),
]


def test_discovery(spark):
    responses = spark.createDataFrame(RESPONSES, "search_no int, niche_id string, city string, raw string")
    stored = spark.createDataFrame([("P3", "other"), (None, "provider|p99")], "place_id string, dedupe_key string")
    got = discover(responses, stored, (SALON, CAFE), limit=60, run_id="r1")

    found = {r.provider_id: r for r in got.new_businesses.collect()}
    assert set(found) == {"P1", "P2", "P6"}
    blush = found["P1"]
    assert (blush.phone, blush.website, blush.lat, blush.merged_rows, blush.reviews) == ("080 1", "https://blush.example", 1.5, 2, 99)

    scores = {r.dedupe_key: r for r in got.scores.collect()}
    assert (scores["provider|p1"].website_gap, scores["provider|p1"].reachability, scores["provider|p1"].audience_index) == (8, 20, 0.5)
    assert scores["provider|p2"].signals == ["cafe match", "no website"] and scores["provider|p2"].audience_index is None

    status = {r.dedupe_key: (r.status, r.data, r.source_url) for r in got.observations.collect()}
    assert status["provider|p1"] == ("ok", '{"reviews":99,"rating":4.5}', "https://www.google.com/maps/place/?q=place_id:P1")
    assert status["provider|p2"][0] == "no_data"

    outcomes = {r.niche_id: r for r in got.outcomes.collect()}
    salon = outcomes["salon"]
    assert (salon.searches, salon.candidates, salon.qualified, salon.new_businesses, salon.already_stored, salon.name_gate_rejected) == (2, 6, 4, 2, 1, 1)
    assert outcomes["cafe"].state == "verified"
    assert outcomes["cafe"].searches == 2  # the empty page counts
    assert {(r.slug, r.times) for r in got.rejected_types.collect()} == {("cafe", 1), ("bakery", 1)}
    assert {r.search_no for r in got.rejected_pages.collect()} == {5, 6, 7}


def test_no_page_is_lost(spark):
    raws = [page(place(1, "A", "x")), page(), page(place(1, "A", "x"), 5), page(None), "[1]", None,
            json.dumps({"search_metadata": {}, "local_results": "x"}),
            page(place(1, "A", "x", reviews="nan"), place(2, "B", "x", reviews=1e30, gps_coordinates="none"))]
    df = spark.createDataFrame(list(enumerate(raws)), "i int, raw string")
    rows = [(r.i, r.position, r.reviews) for r in payloads.listing_rows(df, keep=("i",)).collect()]
    assert sorted(rows, key=str) == [(0, 1, None), (7, 1, None), (7, 2, None)]
    assert sorted(r.i for r in payloads.rejected_pages(df).collect()) == [2, 3, 4, 5, 6]


def test_no_fetch_is_lost(spark):
    good = {"url": "u", "text": "t"}
    cases = [{"results": [good], "errors": [{"url": "v", "error": "e"}]}, {"results": []}, {"results": [good, 5]},
             {"results": [{"text": "t"}]}, {"results": [{"url": "u"}]}, {"results": "x"}, {}, [1],
             {"results": [good], "errors": "x"}]
    df = spark.createDataFrame([(i, json.dumps(c)) for i, c in enumerate(cases)] + [(9, "<html>"), (10, None)], "i int, raw string")
    assert [(r.i, r.url, r.text, r.ok) for r in payloads.fetched_rows(df, keep=("i",)).collect()] == [
        (0, "u", "t", True), (0, "v", None, False)]
    assert sorted(r.i for r in payloads.rejected_fetches(df).collect()) == list(range(1, 11))


def test_listing_fields(spark):
    df = spark.createDataFrame([(page({"title": " ", "type": None, "types": ["A", " ", "B "], "reviews": "1,2", "gps_coordinates": None}),)], "raw string")
    (row,) = payloads.listing_rows(df).collect()
    assert (row.name, row.category, row.raw_categories, row.reviews, row.lat, row.provider_id, row.source_url) == (
        payloads.UNNAMED, "", ["A", "B"], None, None, None, None)


PROFILE = {"data": {"user": {"username": "b", "biography": " Cakes ", "external_url": "", "category_name": "Bakery", "is_private": False,
           "edge_followed_by": {"count": 5421}, "edge_follow": {"count": True}, "edge_owner_to_timeline_media": {"count": "7"}}}}


def test_profile_statuses(spark):
    cases = [
        ("Blush", json.dumps(PROFILE), "ok"), ("blush", '{"message": "User not found", "status": "fail"}', "no_data"),
        ("blush", "<html>Please wait a few minutes</html>", "blocked"), ("blush", "<html>hello</html>", "error"),
        ("blush", json.dumps(PROFILE)[:40], "error"), ("blush", "  ", "error"), ("blush", None, "error"), ("explore", json.dumps(PROFILE), "error"),
        ("blush", "[1]", "error"), ("blush", '{"message": "checkpoint_required"}', "blocked"), ("blush", '{"data": {"user": null}}', "error"),
    ]
    df = spark.createDataFrame([(i, h, r) for i, (h, r, _) in enumerate(cases)], "i int, handle string, raw string")
    rows = payloads.profile_rows(df).orderBy("i").collect()
    assert [r.status for r in rows] == [c[2] for c in cases]
    ok = rows[0]
    assert (ok.handle, ok.followers, ok.following, ok.posts, ok.bio, ok.external_url, ok.is_private, ok.category) == (
        "blush", 5421, None, None, "Cakes", None, False, "Bakery")


def test_enrichment(spark):
    businesses = spark.createDataFrame(
        [(1, "Sweet Corner", "cafe", "080", None, None, True), (2, "Blue Lotus", "salon", None, "bluelotus.example", None, True), (3, "Green Leaf", "cafe", None, "x.example", None, False)],
        "business_id int, name string, niche_id string, phone string, listed_website string, listed_handle string, searched boolean")
    results = spark.createDataFrame(
        [(1, 1, "https://justdial.com/sweet-corner", "call instagram.com/sweet.corner"), (1, 2, "https://instagram.com/SweetCorner_", ""), (1, 3, "https://random.example", ""),
         (2, 1, "https://www.facebook.com/bluelotus", "")],
        "business_id int, position int, url string, snippet string")
    text = "<html><head></head>" + "Owner: Asha Rao, asha@bluelotus.example\n" + "Menu of the day. " * 20 + "instagram.com/blue.lotus"
    pages = spark.createDataFrame([(2, "bluelotus.example", text, 77)], "business_id int, url string, text string, observation_id long")
    ads = spark.createDataFrame([(1, True, 88)], "business_id int, runs_ads boolean, observation_id long")
    worth = spark.createDataFrame([(1, "high"), (2, "medium"), (3, "low")], "business_id int, my_verdict string")
    offers = (Offer("ads", "Ads", (), ("runs meta ads", "public phone"), 1.0), Offer("order", "Order", ("salon",), ("no online ordering",), 1.0), Offer("all", "All", ("cafe",), ("has website",), 1.0))
    got = enrich(businesses, results, pages, ads, worth, offers)

    verdicts = {r.business_id: (r.verdict, r.status, r.confidence) for r in got.verdicts.collect()}
    assert verdicts == {1: ("social_only", "ok", "high"), 2: ("own_site", "ok", "high"), 3: ("unknown", "error", "high")}
    handles = {r.business_id: (r.handle, r.origin, r.confidence, r.candidates) for r in got.handles.collect()}
    assert handles == {1: ("sweetcorner_", "search", "high", 2), 2: ("blue.lotus", "own_site", "high", 1)}
    assert [(r.name, r.role, r.email) for r in got.contacts.collect()] == [("Asha Rao", "owner", "asha@bluelotus.example")]
    assert {r.business_id: r.website for r in got.websites.collect()} == {1: "https://instagram.com/SweetCorner_", 2: "bluelotus.example", 3: "x.example"}
    signals = {(r.business_id, r.signal) for r in got.signals.collect()}
    assert (2, "no online ordering") in signals and (1, "runs meta ads") in signals and not any(b == 3 for b, _ in signals)
    assert {(r.business_id, r.offer_id) for r in got.offers.collect()} == {(1, "ads"), (2, "order")}
    assert {(r.offer_id, r.signal, r.observation_id) for r in got.evidence.collect()} == {("ads", "runs meta ads", 88), ("ads", "public phone", None), ("order", "no online ordering", 77)}
