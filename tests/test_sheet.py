"""Sheet order, sinks, read-back, reconcile, write-back."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from doorstep.operators import sheet
from doorstep.plans.lead_sheet import lead_sheet, stored_tables, write_back
from doorstep.session import fresh_path
from doorstep.sources import tables
from doorstep.sources.schemas import TABLES

T0 = dt.datetime(2024, 5, 1)


def test_layout():
    assert len(sheet.COLUMNS) == 39 and len(sheet.COLUMN_GROUPS) == 8
    assert len(TABLES) == 21


def test_order(spark):
    rows = [
        (1, "indiranagar", 10, "b"), (2, "Indiranagar", 40, "a"), (3, None, 99, "c"), (4, " ", 1, "d"),
        (5, "Adyar", None, "e"), (6, "Adyar", 0, "f"), (7, "Indiranagar", 10, "A"), (8, "straße", 1, "x"),
        (9, "STRASSE", 2, "y"),
    ]
    df = spark.createDataFrame(rows, "business_id int, search_area string, total_score int, business_name string")
    got = sheet.ordered_sheet(df).orderBy("sheet_row").collect()
    assert [r.business_id for r in got] == [6, 5, 2, 7, 1, 9, 8, 3, 4]
    assert [r.sheet_row for r in got] == list(range(1, 10))


@pytest.fixture(scope="module")
def stored(spark):
    folder = fresh_path(spark, "stored")

    def put(name, rows):
        tables.write_table(spark.createDataFrame(rows, tables.table_schema(name)), folder, name)

    def business(i, name, area, **over):
        base = dict(id=f"b{i}", place_id=f"P{i}", name=name, niche_id="salon", city="Pune", search_area=area)
        return tuple({**base, **over}.get(f) for f in tables.table_schema("businesses").names)

    put("businesses", [business(1, "Blush", "Adyar", phone=" 080 "), business(2, "Aura", None, website=""),
                       business(3, "Zen", "adyar", instagram_handle="@zen.spa")])
    put("enrichments", [
        (1, "b1", "google_maps", "ok", '{"reviews": 340, "rating": "4.6", "type": "Salon"}', "https://g/1", T0, None),
        (2, "b1", "google_maps", "error", "{}", "https://g/2", T0 + dt.timedelta(1), None),
        (3, "b1", "ad_library", "ok", '{"runs_ads": true}', None, T0, None),
        (4, "b3", "instagram_profile", "ok", '{"followers": 1200, "engagement_rate": 0.05}', None, T0, None),
    ])
    put("scores", [
        (1, "b1", "google-only", 60, 1, 1, 1, 1, '["no website"]', "{}", T0, 0.5),
        (2, "b1", "enriched", 70, 1, 1, 1, 1, '{"b": 1, "a": 2}', '{"ai_summary": "good"}', T0, 0.9),
        (3, "b3", "google-only", 80, 1, 1, 1, 1, "[]", "{}", T0, None),
    ])
    put("contacts", [(1, "b1", "Ann", "owner", None, None, "website", None, 0.8, T0), (2, "b1", "Bob", "manager", None, None, "website", None, 0.6, T0)])
    put("verdicts", [("b1", "high", "call", None, None, None, T0)])
    put("outreach", [(1, "b1", "website_pitch", "email", "old", "{}", T0), (2, "b1", "website_pitch", "email", "new", "{}", T0)])
    put("automation_opportunities", [(1, "b1", "z_offer", 1.0, "[]", "{}", T0), (2, "b1", "a_offer", 1.0, "[]", "{}", T0), (3, "b1", "top", 2.0, "[]", "{}", T0)])
    return stored_tables(spark, folder)


def test_sheet_from_stored_tables(spark, stored):
    labels = spark.createDataFrame([("salon", "Salon")], "niche_id string, label string")
    rows = lead_sheet(stored, labels).orderBy("sheet_row").collect()
    assert [r.business_id for r in rows] == ["b3", "b1", "b2"]
    blush = rows[1]
    assert (blush.niche, blush.phone, blush.reviews, blush.rating, blush.runs_ads) == ("Salon", "080", 340, 4.6, "yes")
    assert (blush.total_score, blush.audience_band, blush.banding_method) == (70, "medium", "absolute")
    assert (blush.signals, blush.ai_summary, blush.website_pitch) == ("a: 2; b: 1", "good", "new")
    assert (blush.contact_name, blush.automation_opportunities) == ("Ann", "top; a_offer; z_offer")
    assert blush.sources == {"reviews": "https://g/1", "rating": "https://g/1", "peak_hours": "https://g/1"}
    assert rows[0].sources["followers"] == "https://www.instagram.com/zen.spa/"
    assert rows[2].website is None and rows[2].audience_band == "unknown"


def test_csv_round_trip_and_blank_cells(spark, stored):
    path = fresh_path(spark, "sheet")
    cells = lead_sheet(stored).drop("sources", "sheet_row", "listing_url", "profile_url")
    tables.write_sheet(cells, path)
    back = {r.place_id: r for r in tables.read_sheet(spark, path).collect()}
    assert back["P1"].website_pitch == "new" and back["P2"].phone is None
    assert set(sheet.COLUMNS) <= set(back["P1"].asDict())


def test_snapshot_rewrites_one_day(spark):
    path = fresh_path(spark, "snap")
    first = spark.createDataFrame([("P1", "a"), ("P2", "b")], "place_id string, v string")
    for day, df in (("2024-05-01", first), ("2024-05-02", first), ("2024-05-02", first.limit(1))):
        tables.write_snapshot(df, path, F.lit(day).cast("date"))
    assert [tables.read_snapshot(spark, path, d).count() for d in ("2024-05-01", "2024-05-02")] == [2, 1]


def test_operator_columns_survive_and_blanks_clear_nothing(spark, stored):
    typed = spark.createDataFrame(
        [("P1", 1, None, "again", None, None, ""), ("P1", 2, "", "", "2024-06-01", None, "replied"), (" ", 3, "low", None, None, None, None),
         ("P2", 4, None, None, "2024-06-01", "call", None), ("P3", 5, "medium", None, None, None, None), ("P9", 6, "low", None, None, None, None)],
        "place_id string, row_number int, my_verdict string, notes string, contacted_on string, channel string, outcome string",
    )
    got = {r.business_id: r for r in write_back(stored, typed, F.lit(T0)).collect()}
    assert set(got) == {"b1", "b3"}
    assert (got["b1"].my_verdict, got["b1"].notes, got["b1"].outcome, str(got["b1"].contacted_on)) == ("high", "call", "replied", "2024-06-01")

    master = spark.createDataFrame([("P1", "old", "mine"), ("P2", "kept", None)], "place_id string, name string, my_verdict string")
    batch = spark.createDataFrame([("P1", None, "theirs"), ("P3", "new", "seen")], master.schema)
    rows = {tuple(r) for r in sheet.reconcile(master, batch, ["name"], ["my_verdict"]).collect()}
    assert rows == {("P1", None, "mine", "updated"), ("P2", "kept", None, "untouched"), ("P3", "new", "seen", "appended")}
