"""Streaming rules run over the given tables to the end, against their batch form in SQL."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from doorstep.checks import check
from doorstep.checks.domain import Domain
from doorstep.checks.observations import _ladder_sql
from doorstep.checks.planning import _MACHINE
from doorstep.session import fresh_path, written
from doorstep.streaming import cells, rules, tables

def _events(d: Domain):
    schema = d.table("events").schema
    stream = tables.read_stream(d.spark, d.folder, schema, only="events.parquet")
    return tables.as_instant(stream, "ts")


def _finish(d: Domain, start, df, *key):
    """Run a stream over everything there is and read its result.

    Every batch runs a task per partition of the state, with rows or without, and nothing joins small
    ones: there are as many as tasks run at once. The query keeps the number it starts with.
    """
    configured = d.spark.conf.get("spark.sql.shuffle.partitions")
    slots = d.spark.sparkContext.defaultParallelism
    d.spark.conf.set("spark.sql.shuffle.partitions", min(int(configured), slots))
    try:
        return _finished(d, start, df, *key)
    finally:
        d.spark.conf.set("spark.sql.shuffle.partitions", configured)


def _finished(d: Domain, start, df, *key):
    out = fresh_path(d.spark, "stream")
    if start is tables.compacted:
        start(df, f"{out}/data", f"{out}/log", key, buckets=8).awaitTermination()
        return tables.current_rows(d.spark, f"{out}/data")
    start(df, f"{out}/data", f"{out}/log").awaitTermination()
    if start is tables.changelog:
        return tables.current(d.spark, f"{out}/data", key)
    return d.spark.read.parquet(f"{out}/data")


def _in_parts(d: Domain, df, parts: int):
    """Rows in no order, in as many files, read as a stream of one file a batch."""
    return _files(d, df.withColumn("part", F.pmod(F.xxhash64("id", F.lit(3)), F.lit(parts))), parts)


def _files(d: Domain, df, parts: int):
    """Rows in the order of `part`, one file each, read as a stream of one file a batch."""
    out = fresh_path(d.spark, "parts")
    rows = written(df, "rows")
    for part in range(parts):
        rows.where(F.col("part") == part).drop("part").repartition(1).write.mode("append").parquet(out)
    return tables.read_stream(d.spark, out, rows.drop("part").schema, files_per_batch=1)


def _ranked(rows, *order):
    """`rank` of every row from 0; only the sizes of the sorted parts meet in one place."""
    place = written(rows.sort(*order).withColumn("place", F.monotonically_increasing_id()), "ordered")
    # A place is the part's number and, in the lower 33 bits, the row's in it.
    place = place.withColumn("chunk", F.shiftright("place", 33))
    sizes = place.groupBy("chunk").agg(F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranked = place.join(F.broadcast(sizes.select("chunk", before.alias("before"))), "chunk")
    return ranked.withColumn("rank", F.col("before") + F.col("place").bitwiseAND(F.lit((1 << 33) - 1))).drop("chunk", "place", "before")


def _naive(df, *columns):
    for c in columns:
        df = df.withColumn(c, F.col(c).cast("timestamp_ntz"))
    return df


@check(
    "stream_latest_observation", "X-S1",
    """SELECT user_id, event_type, arg_max(event_id, (ts, event_id)) AS event_id, arg_max(value, (ts, event_id)) AS value
       FROM events GROUP BY 1, 2""",
)
def _(d: Domain):
    latest = rules.latest_observations(
        _events(d), ["user_id", "event_type"], ["ts", "event_id"], ["event_id", "value"]
    )
    return _finish(d, tables.compacted, latest, "user_id", "event_type")


@check(
    "stream_latest_in_batches", "X-S1",
    """SELECT user_id, event_type, arg_max(event_id, (ts, event_id)) AS id, arg_max(value, (ts, event_id)) AS value
       FROM events GROUP BY 1, 2""",
)
def _(d: Domain):
    """The same over ten batches in no order, every one of which rewrites the buckets it touches."""
    rows = d.table("events").select("user_id", "event_type", "ts", F.col("event_id").alias("id"), "value")
    latest = rules.latest_observations(_in_parts(d, rows, 10), ["user_id", "event_type"], ["ts", "id"], ["id", "value"])
    return _finish(d, tables.compacted, latest, "user_id", "event_type")


@check("stream_first_listings", "X-S2",
       "SELECT DISTINCT user_id, event_type FROM events")
def _(d: Domain):
    """One listing per key within the horizon; which of equals is kept is up to arrival."""
    unique = rules.first_listings(_events(d), "ts", "60 days", ["user_id", "event_type"])
    return _finish(d, tables.append, unique.select("user_id", "event_type"))


@check("stream_earliest_listings", "X-S2 W8",
       """SELECT user_id, event_type, arg_min(event_id, (ts, event_id)) AS id, min(ts) AS ts FROM events GROUP BY 1, 2
          HAVING min(ts) <= (SELECT max(ts) FROM events) - INTERVAL 2 DAY""")
def _(d: Domain):
    """The earliest listing of each key, from files whose rows lie up to two days out of order."""
    rows = d.table("events").select("user_id", "event_type", F.col("event_id").alias("id"), F.col("ts").cast("timestamp"))
    # Rows arrive up to 36 hours after their time; eight files hold them in order of arrival.
    rows = rows.withColumn("arrived", F.unix_timestamp("ts") + F.pmod(F.xxhash64("id"), F.lit(36)) * 3600)
    step = max(1, -(-rows.count() // 8))
    part = F.floor(F.col("rank") / step)
    _with_rocksdb(d)
    stream = _files(d, _ranked(rows, "arrived", "id").withColumn("part", part).drop("arrived", "rank"), 8)
    first = cells.first_rows(stream, "ts", "2 days", ["user_id", "event_type"], ["id"])
    return _naive(_finish(d, tables.append, first), "ts")


@check(
    "stream_hourly_status_counts", "X-S4",
    """SELECT date_trunc('hour', ts) AS window_start, date_trunc('hour', ts) + INTERVAL 1 HOUR AS window_end, event_type, count(*) AS n
       FROM events WHERE date_trunc('hour', ts) + INTERVAL 1 HOUR <= (SELECT max(ts) FROM events) - INTERVAL 10 MINUTE GROUP BY ALL""",
)
def _(d: Domain):
    counted = rules.windowed_counts(_events(d), "ts", "10 minutes", ["event_type"], "1 hour")
    return _naive(_finish(d, tables.append, counted), "window_start", "window_end")


@check(
    "stream_sliding_status_counts", "X-S4",
    """SELECT s AS window_start, s + INTERVAL 1 HOUR AS window_end, event_type, count(*) AS n FROM (
         SELECT event_type, time_bucket(INTERVAL 30 MINUTE, ts) - to_minutes(30 * i) AS s FROM events, (VALUES (0), (1)) v(i))
       WHERE s + INTERVAL 1 HOUR <= (SELECT max(ts) FROM events) - INTERVAL 10 MINUTE GROUP BY ALL""",
)
def _(d: Domain):
    counted = rules.windowed_counts(
        _events(d), "ts", "10 minutes", ["event_type"], "1 hour", "30 minutes"
    )
    return _naive(_finish(d, tables.append, counted), "window_start", "window_end")


@check(
    "stream_niche_status", "X-S5",
    """SELECT user_id, count(*) FILTER (WHERE event_type = 'purchase' AND value > 150) AS qualified,
              count(*) FILTER (WHERE NOT (event_type = 'purchase' AND value > 150)) AS rejected,
              CASE WHEN count(*) FILTER (WHERE event_type = 'purchase' AND value > 150) > 0 THEN 'verified' WHEN count(*) >= 20 THEN 'starved' ELSE 'unverified' END AS state
       FROM events GROUP BY 1""",
)
def _(d: Domain):
    hit = (F.col("event_type") == "purchase") & (F.col("value") > 150)
    status = rules.running_niche_status(
        _events(d), "user_id", hit.cast("bigint"), (~hit).cast("bigint")
    )
    return _finish(d, tables.compacted, status, "user_id")


def _with_rocksdb(d: Domain):
    d.spark.conf.set("spark.sql.streaming.stateStore.providerClass", cells.ROCKSDB)


@check(
    "stream_cell_states", "X-S3 W7",
    "SELECT cell_id, searched_at, status, next_page, new_yield, total_yield, revived FROM ("
    + _MACHINE.replace("@REVIVE", "m.status = 'exhausted' AND m.exhausted_at < p.searched_at - INTERVAL 1 DAY")
    + ")",
)
def _(d: Domain):
    """Passes go in one by one as appended rows; timer rows (back to pending) are left out."""
    out = fresh_path(d.spark, "passes")
    d.passes.select("cell_id", "searched_at", "new_count", "total_count").write.parquet(out)
    stored = d.spark.read.parquet(out)
    _with_rocksdb(d)
    states = cells.cell_states(
        tables.read_stream(d.spark, out, stored.schema), "0 seconds", revive_after_days=1
    )
    history = _finish(d, tables.append, states)
    return _naive(history.where(F.col("status") != "pending"), "searched_at")


@check(
    "stream_miss_ladder", "X-S3 W6",
    _ladder_sql("""SELECT DISTINCT n.business_id, n.question, coalesce(l.misses, 0) AS misses, l.last_miss_at, l.retry_after
                   FROM facts n LEFT JOIN ladder2 l ON l.business_id = n.business_id AND l.question = n.question"""),
)
def _(d: Domain):
    """All statuses, in ten batches in no order; blocked and failed lookups are seen and do not count."""
    _with_rocksdb(d)
    e = tables.as_instant(d.table("events"), "ts")
    users = d.table("events").agg((F.max("user_id") + 1).alias("n")).first()[0]
    k = F.get_json_object("props", "$.k").cast("bigint")
    facts = e.select(
        (F.col("user_id") + users * (F.col("event_id") % 10)).alias("business_id"),
        F.when(F.col("event_type") == "error", "website").when(F.col("event_type") == "signup", "instagram_handle")
        .when(F.col("event_type") == "purchase", "ad_library").alias("question"),
        F.when(k % 10 < 5, "ok").when(k % 10 < 8, "no_data").when(k % 10 == 8, "blocked").otherwise("error").alias("status"),
        F.col("ts").alias("fetched_at"), F.col("event_id").alias("id"),
    ).where(F.col("question").isNotNull())
    ladders = cells.miss_ladders(_in_parts(d, facts, 10), "400 days")
    ladder = _finish(d, tables.compacted, ladders, "business_id", "question")
    return _naive(ladder, "last_miss_at", "retry_after")
