"""Streams fed in several batches equal their batch form."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from doorstep.operators import observe
from doorstep.operators.cells import cell_history
from doorstep.operators.ordering import latest_per_key
from doorstep.session import fresh_path
from doorstep.streaming import cells, rules, tables

T0 = dt.datetime(2024, 1, 1)


@pytest.fixture(scope="module", autouse=True)
def store(spark):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", cells.ROCKSDB)


def feed(spark, rows, schema, batches, at):
    """Rows in order of a column, or as they come, one file per batch."""
    folder = fresh_path(spark, "feed")
    rows = rows if at is None else sorted(rows, key=lambda r: r[at])
    step = -(-len(rows) // batches)
    for i in range(batches):
        part = rows[i * step:(i + 1) * step]
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(folder)
    return folder, tables.read_stream(spark, folder, spark.read.parquet(folder).schema, files_per_batch=1)


def run(spark, start, df):
    out = fresh_path(spark, "out")
    start(df, f"{out}/data", f"{out}/log").awaitTermination()
    return f"{out}/data"


def test_latest_and_rerun(spark):
    rng = random.Random(1)
    rows = [(i, rng.randint(0, 9), rng.choice("ab"), T0 + dt.timedelta(minutes=i)) for i in range(300)]
    folder, stream = feed(spark, rows, "id int, b int, s string, at timestamp", 3, 3)
    out = run(spark, tables.changelog, rules.latest_observations(stream, ["b", "s"], ["at", "id"], ["id"]))
    got = tables.current(spark, out, ["b", "s"])
    want = latest_per_key(spark.read.parquet(folder), ["b", "s"], ["at", "id"], ["id"])
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_late_rows_are_dropped(spark):
    folder = fresh_path(spark, "late")
    # A batch drops what is later than the watermark of the batch before it.
    parts = [[0, 300], [301], [1, 540], [541]]
    for part in parts:
        rows = [(T0 + dt.timedelta(minutes=m), "ok") for m in part]
        spark.createDataFrame(rows, "at timestamp, status string").coalesce(1).write.mode("append").parquet(folder)
    stream = tables.read_stream(spark, folder, spark.read.parquet(folder).schema, files_per_batch=1)
    out = run(spark, tables.append, rules.windowed_counts(stream, "at", "1 hour", ["status"], "1 hour"))
    got = {(r.window_start, r.n) for r in spark.read.parquet(out).collect()}
    assert got == {(T0, 1), (T0 + dt.timedelta(hours=5), 2)}


def test_cells_equal_their_batch_form(spark):
    rng = random.Random(5)
    rows = []
    for cell in range(6):
        at = T0
        for _ in range(20):
            at += dt.timedelta(days=rng.choice([1, 29, 31, 33]), hours=cell)
            rows.append((cell, at, rng.choice([0, 0, 0, 3, 6]), rng.randint(0, 9)))
    folder, stream = feed(spark, rows, "cell_id long, searched_at timestamp, new_count long, total_count long", 4, 1)
    out = run(spark, tables.append, cells.cell_states(stream, "0 seconds"))
    got = spark.read.parquet(out)
    timers = got.where("status = 'pending'").count()
    columns = ["cell_id", "searched_at", "status", "next_page", "new_yield", "total_yield"]
    want = cell_history(spark.read.parquet(folder)).select(*columns)
    rows_of = lambda df: sorted(map(tuple, df.select(*columns).collect()))
    assert rows_of(got.where("status <> 'pending'")) == rows_of(want)
    assert timers > 0


def test_ladders_equal_their_batch_form(spark):
    rng = random.Random(6)
    rows = [(i, rng.randint(0, 8), "ad_library", rng.choice(["ok", "no_data", "no_data", "blocked"]), T0 + dt.timedelta(hours=i)) for i in range(120)]
    rng.shuffle(rows)
    folder, stream = feed(spark, rows, "id long, business_id long, source string, status string, fetched_at timestamp", 10, None)
    asked = stream.withColumn("question", observe.question_of(F.col("source")))
    out = run(spark, tables.changelog, cells.miss_ladders(asked, "30 days"))
    got = tables.current(spark, out, ["business_id", "question"]).where("misses > 0")
    want = observe.miss_ladder(spark.read.parquet(folder))
    assert sorted(map(str, got.select(*want.columns).collect())) == sorted(map(str, want.collect()))


LADDER = "id long, business_id long, question string, status string, fetched_at timestamp"


def test_an_answer_followed_by_refusals_leaves_no_time(spark):
    rows = [(1, 7, "website", "no_data", T0), (2, 7, "website", "ok", T0 + dt.timedelta(hours=1)),
            (3, 7, "website", "blocked", T0 + dt.timedelta(days=40)), (4, 7, "website", "error", T0 + dt.timedelta(days=41)),
            (5, 8, "website", "blocked", T0)]
    _, stream = feed(spark, rows, LADDER, 5, 4)
    out = run(spark, tables.changelog, cells.miss_ladders(stream, "1 hour"))
    got = {r.business_id: (r.misses, r.last_miss_at, r.retry_after) for r in tables.current(spark, out, ["business_id", "question"]).collect()}
    assert got == {7: (0, None, None), 8: (0, None, None)}


def test_a_ladder_goes_on_from_the_batch_form(spark):
    history = spark.createDataFrame([(1, "website", 2, T0), (2, "website", 1, T0)], "business_id long, question string, misses long, last_miss_at timestamp")
    rows = [(1, 1, "website", "no_data", T0 + dt.timedelta(days=2)), (2, 2, "website", "ok", T0 + dt.timedelta(days=2)),
            (3, 3, "website", "no_data", T0 + dt.timedelta(days=1)), (3, 3, "website", "no_data", T0 + dt.timedelta(days=1))]
    _, stream = feed(spark, rows, LADDER, 2, 1)
    out = run(spark, tables.changelog, cells.miss_ladders(stream, "10 days", history))
    got = {r.business_id: (r.misses, r.last_miss_at) for r in tables.current(spark, out, ["business_id", "question"]).collect()}
    assert got == {1: (3, T0 + dt.timedelta(days=2)), 2: (0, None), 3: (1, T0 + dt.timedelta(days=1))}


def test_the_earliest_row_is_kept_in_any_order(spark):
    rng = random.Random(8)
    rows = [(i, f"k{rng.randint(0, 30)}", T0 + dt.timedelta(hours=i // 2), None if i % 3 else "x") for i in range(400)]
    # Up to ten hours out of order, over eight days.
    rows.sort(key=lambda r: (r[2] + dt.timedelta(hours=rng.randint(0, 10)), r[0]))
    folder, stream = feed(spark, rows, "id int, dedupe_key string, at timestamp, note string", 8, None)
    out = run(spark, tables.append, cells.first_rows(stream, "at", "12 hours", ["dedupe_key"], ["id"]))
    want = {}
    for r in sorted(rows, key=lambda r: (r[2], r[0])):
        want.setdefault(r[1], r)
    last = max(r[2] for r in rows) - dt.timedelta(hours=12)
    got = {tuple(r) for r in spark.read.parquet(out).select("id", "dedupe_key", "at", "note").collect()}
    assert got == {r for r in want.values() if r[2] < last}


def test_compacted_state_follows_the_keys_not_the_batches(spark, tmp_path):
    rows = [(b, k, b * 100 + k) for b in range(12) for k in range(40)]
    _, stream = feed(spark, rows, "batch int, key int, value int", 12, 1)
    latest = rules.latest_observations(stream, ["key"], ["batch"], ["value"])
    data = str(tmp_path / "state")
    query = tables.compacted(latest, data, str(tmp_path / "log"), ["key"], buckets=4)
    query.awaitTermination()
    want = {(k, 1100 + k) for k in range(40)}
    assert {tuple(r) for r in tables.current_rows(spark, data).select("key", "value").collect()} == want
    # Two versions a bucket at most, whatever the batches.
    versions = tables._versions(spark, data)
    assert set(versions) == {0, 1, 2, 3} and all(len(v) <= 2 for v in versions.values())
    assert tables.current_rows(spark, data).count() == 40


def test_a_replayed_or_broken_batch_changes_nothing(spark, tmp_path):
    data = str(tmp_path / "state")
    folder, stream = feed(spark, [(1, 1), (2, 2), (3, 3)], "key int, value int", 1, 1)
    tables.compacted(rules.latest_observations(stream, ["key"], ["value"], ["value"]), data, str(tmp_path / "a"), ["key"], 2).awaitTermination()
    before = sorted(map(tuple, tables.current_rows(spark, data).collect()))
    # The same rows as batch 0 of another query: a replay under the same number.
    tables.compacted(rules.latest_observations(stream, ["key"], ["value"], ["value"]), data, str(tmp_path / "b"), ["key"], 2).awaitTermination()
    assert sorted(map(tuple, tables.current_rows(spark, data).collect())) == before
    # A batch that broke off has no mark of success and is not read.
    spark.createDataFrame([(1, 99, 0)], "key int, value int, bucket int").write.partitionBy("bucket").parquet(f"{data}/batch=000000000007")
    (tmp_path / "state" / "batch=000000000007" / "_SUCCESS").unlink()
    assert sorted(map(tuple, tables.current_rows(spark, data).collect())) == before


def test_repeats_within_the_horizon(spark):
    rows = [(i, f"k{i % 7}", T0 + dt.timedelta(minutes=i)) for i in range(60)]
    _, stream = feed(spark, rows, "id int, dedupe_key string, at timestamp", 3, 2)
    out = run(spark, tables.append, rules.first_listings(stream, "at", "2 days"))
    assert spark.read.parquet(out).count() == 7
