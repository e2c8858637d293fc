"""Keyed state of streams: many keys to a call, exact keys, null columns."""

import datetime as dt

import pytest

from doorstep.session import fresh_path
from doorstep.streaming import cells, tables
from tests.test_streams import LADDER, T0, feed, run


@pytest.fixture(scope="module", autouse=True)
def store(spark):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", cells.ROCKSDB)


def test_first_rows_of_many_keys_in_one_slot(spark, monkeypatch):
    monkeypatch.setattr(cells, "SLOTS", 1)
    hours = lambda h: T0 + dt.timedelta(hours=h)
    big = (1 << 60) + 1
    rows = [
        # Keys apart by their last bit, a null key, a null column, and names that run into each other.
        [(1, big, "a", hours(1), None), (2, big - 1, "a", hours(2), 5), (3, None, "a", hours(3), None), (4, 1, "1:a", hours(2), 7)],
        [(5, big, "a", hours(0), 9), (6, None, "a", hours(4), 1), (7, 1, None, hours(5), 2)],
        [(8, 2, "late", hours(60), 3)],
        [(9, big, "a", hours(61), 4), (10, None, "a", hours(61), 4)],
    ]
    folder = fresh_path(spark, "feed")
    schema = "id long, k long, s string, at timestamp, note int"
    for part in rows:
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(folder)
    stream = tables.read_stream(spark, folder, spark.read.parquet(folder).schema, files_per_batch=1)
    out = run(spark, tables.append, cells.first_rows(stream, "at", "12 hours", ["k", "s"], ["id"]))
    got = {tuple(r) for r in spark.read.parquet(out).collect()}
    assert got == {(5, big, "a", hours(0), 9), (2, big - 1, "a", hours(2), 5), (3, None, "a", hours(3), None), (4, 1, "1:a", hours(2), 7), (7, 1, None, hours(5), 2)}


def test_ladders_of_many_keys_in_one_slot(spark, monkeypatch):
    monkeypatch.setattr(cells, "SLOTS", 1)
    hours = lambda h: T0 + dt.timedelta(hours=h)
    rows = [
        (1, 1, "website", "no_data", hours(5)), (2, 1, "website", "ok", hours(4)), (3, None, "website", "no_data", hours(1)),
        (4, 2, "website", "no_data", hours(2)), (4, 2, "website", "no_data", hours(2)), (5, 2, "ad_library", "no_data", hours(2)),
        (6, 1, "website", "no_data", hours(100)), (7, 2, "website", "blocked", hours(100)), (8, 2, "ad_library", "ok", hours(101)),
        (9, None, "website", "no_data", hours(101)),
    ]
    _, stream = feed(spark, rows, LADDER, 5, None)
    out = run(spark, tables.changelog, cells.miss_ladders(stream, "10 hours"))
    got = {(r.business_id, r.question): (r.misses, r.last_miss_at) for r in tables.current(spark, out, ["business_id", "question"]).collect()}
    assert got == {
        (1, "website"): (2, hours(100)), (None, "website"): (2, hours(101)), (2, "website"): (1, hours(2)),
        (2, "ad_library"): (0, None),
    }


def test_a_batch_calls_python_by_slot_not_by_key(spark, monkeypatch):
    """500 keys of one batch leave one state entry each of two slots."""
    monkeypatch.setattr(cells, "SLOTS", 2)
    rows = [(i, i, "website", "no_data", T0 + dt.timedelta(minutes=i)) for i in range(500)]
    _, stream = feed(spark, rows, LADDER, 1, None)
    out = fresh_path(spark, "out")
    query = tables.changelog(cells.miss_ladders(stream, "10 days"), f"{out}/data", f"{out}/log")
    query.awaitTermination()
    entries = [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"]]
    assert 0 < max(entries) <= 20
    assert tables.current(spark, f"{out}/data", ["business_id", "question"]).where("misses = 1").count() == 500
