"""Column functions on hand-written values."""

import pytest
from pyspark.sql import functions as F

from doorstep.functions import casts, geo, pages, scoring, secrets, text, urls
from doorstep.operators import qualify, sheet
from doorstep.sources.registry import Profile


def column(spark, values, expression, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r.o for r in df.orderBy("i").select(expression(F.col("v")).alias("o")).collect()]


def test_slugs_drop_accents(spark):
    got = column(spark, ["Café", "Cafe", "Coffee  shop!", "ﬁsh ½ bar", "Ｈａｉｒ", "—", None, "Ünïon_é", "straße", "№ 5"], text.slug)
    assert got == ["cafe", "cafe", "coffee_shop", "fish_1_2_bar", "hair", "", "", "union_e", "stra_e", "no_5"]


def test_hosts(spark):
    values = ["HTTPS://User:pw@www.Shop.example:8080/a?b", "shop.example/x", "", None, "http://a b/c", "mailto:x"]
    assert column(spark, values, urls.host) == ["www.shop.example", "shop.example", "", "", "a b", "mailto"]
    assert column(spark, values[:1], urls.authority) == ["user:pw@www.shop.example:8080"]


@pytest.mark.parametrize("url,kind,identity", [
    ("https://instagram.com/sweetcorner/", "social", "sweetcorner"),
    ("https://sweetcorner.wixsite.com/cakes", "free_builder", "sweetcorner cakes"),
    ("https://www.thecakestory.co.in/menu", "other", "thecakestory"),
    ("https://www.justdial.com/Pune/Sweet-Corner", "third_party", ""),
    ("https://notinstagram.com/x", "other", "notinstagram"),
    ("https://sites.google.com/view/shop", "free_builder", "view"),
    ("m.shop.example.org", "other", "shop.example"),
    ("https://com/", "other", "com"),
    ("https://www/", "other", ""),
])
def test_kind_and_identity(spark, url, kind, identity):
    df = spark.createDataFrame([(url,)], "u string")
    k = urls.host_kind(urls.host(F.col("u")))
    row = df.select(k.alias("k"), urls.identity(F.col("u"), k).alias("d")).first()
    assert (row.k, row.d) == (kind, identity)


@pytest.mark.parametrize("identity,name,want", [
    ("sweetcorner", "Sweet Corner Bakery", True), ("bakerywala", "Sweet Corner Bakery", False),
    ("smartsolutions", "Art House Corner", False), ("sweet", "Sweet Corner", False),
    ("bluelotus", "Blue Lotus Wellness", False), ("bluewellness", "Blue Lotus Wellness", True), ("", "Any Name", False), ("cafe", "The Cafe", False),
    ("thecafe", "The Cafe", True), ("x", "", False),
])
def test_name_match(spark, identity, name, want):
    row = spark.createDataFrame([(identity, name)], "a string, b string").select(
        urls.name_match(F.col("a"), F.col("b")).alias("m")
    ).first()
    assert row.m is want


def test_site_grade_tri_state(spark):
    filler = "lorem ipsum " * 20
    got = column(spark, [
        "# Shop\nMenu and contact " + filler,
        "<html><meta name='viewport' content='width=device-width'>order now " + filler,
        "<html><body>hello " + filler, "menu", None,
    ], pages.site_grade)
    first, second, third, fourth, fifth = got
    assert (first.mobile_friendly, first.score, first.gaps) == (None, 79, ["ordering"])
    assert (second.mobile_friendly, second.score) == (True, 45)
    assert (third.mobile_friendly, third.score) == (False, 0)
    assert fourth is None and fifth is None


def test_ad_page_order_of_checks(spark):
    pad = " library page text" * 10
    got = column(spark, [
        "~14 results" + pad, "No ads match your search criteria. 3 results" + pad,
        "Please log in. 40 results" + pad, "nothing here" + pad, "short", "1,200+ results" + pad, None,
    ], pages.ad_page)
    assert [(g.status, g.runs_ads, g.ad_count) for g in got] == [
        ("ok", True, 14), ("ok", False, 0), ("blocked", None, None), ("no_data", None, None),
        ("blocked", None, None), ("ok", True, 1200), ("blocked", None, None),
    ]


def test_handles(spark):
    assert column(spark, [" @Blush.Salon/ ", "explore", "a b", "...", "x" * 31, None], pages.clean_handle) == [
        "blush.salon", None, None, None, None, None,
    ]
    assert column(spark, [
        "https://www.instagram.com/Blush/", "https://instagram.com/p/abc", "https://example.com/blush", "instagram.com",
    ], pages.handle_of_url) == ["blush", None, None, None]
    assert column(spark, ["see instagram.com/One, https://www.instagram.com/two and instagram.com/one; instagram.com/reel"], pages.handles_in_text) == [["one", "two"]]
    assert column(spark, ["@blush.salon", "www.instagram.com/blush/", "https://instagram.com/", "https://x.example/a", " ", None], pages.profile_link) == [
        "https://www.instagram.com/blush.salon/", "https://www.instagram.com/blush/", None, "https://x.example/a", None, None,
    ]


def test_audience_index(spark):
    df = spark.createDataFrame(
        [(9999, None, None), (None, None, None), (0, None, None), (99, 999, 0.05), (None, None, 3.0)],
        "r int, f int, e double",
    )
    got = [r.x for r in df.select(scoring.audience_index(F.col("r"), F.col("f"), F.col("e")).alias("x")).collect()]
    assert got[0] == 1.0 and got[1] is None and got[2] == 0.0 and got[4] == 1.0
    assert abs(got[3] - (0.4 * 0.5 + 0.3 * 0.6 + 0.2 * 0.5) / 0.9) < 1e-12


def test_casts(spark):
    assert column(spark, ["340", "4.7", " 12 ", "n/a", "", None], casts.as_int) == [340, 4, 12, None, None, None]
    assert column(spark, ["12", "-3", "1e3", "unavailable"], casts.digits_only) == [12, None, None, None]
    assert column(spark, ["Yes", " F ", "maybe", None], casts.as_flag) == [True, False, None, None]
    assert column(spark, ['["a", " b ", ""]', '{"b": 2, "a": "x"}', "plain", "", None, '"quoted"'], casts.as_list) == [
        ["a", "b"], ["a: x", "b: 2"], ["plain"], [], [], ["quoted"],
    ]
    assert column(spark, [["a,b", " ", "c "], [], None], casts.joined, "array<string>") == ["a,b; c", None, None]


def test_locations(spark):
    df = spark.createDataFrame([(" Indira  nagar", "Delhi", "DELHI", None), (None, "Delhi", "", "India")], "a string, b string, c string, d string")
    got = [r.q for r in df.select(geo.composed(*[F.col(c) for c in "abcd"]).alias("q")).collect()]
    assert got == ["Indira nagar, Delhi", "Delhi, India"]
    assert column(spark, ["India", "u.k.", "SG", "Atlantis", None], geo.country_code) == ["in", "gb", "sg", None, None]


def test_redaction(spark):
    key = "sk_live_" + "9f3c7a" * 4
    got = column(spark, [
        f"quota exceeded for key {key} today", "see https://x.example/?api_key=abc now", "Bearer abc.def ok",
        "token: abc", "a secret garden and automation_opportunities_table", "password = hunter2!",
    ], secrets.redacted)
    assert got == [
        "quota exceeded for key [redacted] today", "see [redacted] now", "Bearer [redacted] ok",
        "token=[redacted]", "a secret garden and automation_opportunities_table", "password=[redacted]",
    ]


def test_scrub(spark):
    assert column(spark, ["https://x/?q=1&API_KEY=abc&token", "no query", "a?b"], secrets.scrubbed_query) == [
        "https://x/?q=1&API_KEY=REDACTED&token=REDACTED", "no query", "a?b",
    ]
    got = column(spark, ['{"search_parameters":{"api_key":"abc","q":"k1"},"u":"http://x/?a=1&key=zz&b=2","n":"has k1"}'],
                 lambda c: secrets.scrubbed_json(c, known_key="k1"))
    assert got == ['{"search_parameters":{"api_key":"REDACTED","q":"REDACTED"},"u":"http://x/?a=1&key=REDACTED&b=2","n":"has REDACTED"}']


def test_scrub_takes_nested_values_whole(spark):
    cases = [
        ('{"token":[["s1","s2"]],"a":1}', '{"token":"REDACTED","a":1}'),
        ('{"token":{"x":{"y":"SECRET","z":"S2"}}}', '{"token":"REDACTED"}'),
        ('{"a":[{"Key" : [{"b":"]}\\"S"}, 3]},{"key":null}],"c":{}}', '{"a":[{"Key" : "REDACTED"},{"key":"REDACTED"}],"c":{}}'),
        ('{"keys":[1,[2]],"n":"token"}', '{"keys":[1,[2]],"n":"token"}'),
    ]
    assert column(spark, [c for c, _ in cases], secrets.scrubbed_json) == [w for _, w in cases]


def test_reach_order(spark):
    row = spark.createDataFrame(
        [("98", "Ann", "h", "080", "e", "f"), ("", None, None, "080", "e", None), (None,) * 6, (None, None, None, None, None, "f"), ("98", None, "h", None, None, None)],
        "a string, b string, c string, d string, e string, f string",
    )
    got = [(r.r.channel, r.r.value) for r in row.select(sheet.reach_channel(*[F.col(c) for c in "abcdef"]).alias("r")).collect()]
    assert got == [("mobile", "98"), ("phone", "080"), ("none", None), ("email", "f"), ("mobile", "98")]


SALON = Profile("salon", "Salon", include_types=("hair_salon",), exclude_types=("cafe",), exclude_suffixes=("_store",), terms=("salon", "barber"), strict=True)
MAKER = Profile("maker", "Maker", include_suffixes=("_manufacturer",), exclude_types=("warehouse",), terms=("works", "pvt ltd"), strict=True, allow_name_only=True)


@pytest.mark.parametrize("name,category,labels,niches", [
    ("Blush Salon", "Hair salon", ["Hair salon"], ["salon"]),
    ("Blush", "Hair salon", [], ["salon"]),
    ("Blush", "Beauty", ["x"], []),
    ("Blush Salon", "Hair salon", ["Cafe"], []),
    ("Blush Salon", "Hair salon", ["Book store"], []),
    ("Balaji-Works", "Company", None, ["maker"]),
    ("Balaji Works", "Warehouse", [], []),
    ("Balaji", "Chair manufacturer", ["Pvt_Ltd"], ["maker"]),
])
def test_qualification(spark, name, category, labels, niches):
    df = spark.createDataFrame([(name, category, labels)], "name string, category string, raw_categories array<string>")
    assert [r.niche_id for r in qualify.qualifying(df, (SALON, MAKER)).collect()] == niches


def test_niche_states(spark):
    df = spark.createDataFrame([(0, 20), (0, 19), (1, 20)], "q int, r int")
    got = [r.s for r in df.select(qualify.state_of(F.col("q"), F.col("r")).alias("s")).collect()]
    assert got == ["starved", "unverified", "verified"]
