"""Dedupe keys, merges, upserts and known-place checks."""

from pyspark.sql import functions as F

from doorstep.checks import check
from doorstep.checks.domain import Domain, compact_sql, sql
from doorstep.functions.text import first_present
from doorstep.operators import identity
from doorstep.session import fresh_path
from doorstep.sources import current

_AUTHORITY = (
    "lower(regexp_extract(CASE WHEN contains(website, '://') THEN website "
    "ELSE 'https://' || website END, '^[^:/?#]+://([^/?#]*)', 1))"
)
_KEY_SQL = f"""
SELECT id, provider_id, CASE
    WHEN provider_id <> '' THEN 'provider|' || {compact_sql('provider_id')}
    WHEN contact <> '' THEN 'contact|' || {compact_sql('name')} || '|' || contact
    WHEN {compact_sql('address')} <> '' THEN 'address|' || {compact_sql('name')} || '|' || {compact_sql('address')}
    ELSE 'location|' || {compact_sql('name')} || '|' ||
         coalesce(CAST(CAST(round_even(lat * 100000, 0) AS BIGINT) AS VARCHAR) || '|' ||
                  CAST(CAST(round_even(lng * 100000, 0) AS BIGINT) AS VARCHAR), '')
    END AS dedupe_key
FROM (SELECT *, CASE WHEN email IS NOT NULL THEN place_id ELSE '' END AS provider_id,
             {compact_sql("coalesce(nullif(phone, ''), nullif(" + _AUTHORITY + ", ''))")} AS contact
      FROM businesses)"""


def _staged(d: Domain):
    return d.businesses.withColumn(
        "provider_id", F.when(F.col("email").isNotNull(), F.col("place_id")).otherwise("")
    )


def _key():
    return identity.dedupe_key(
        *[F.col(c) for c in ("name", "provider_id", "phone", "website", "address", "lat", "lng")]
    )


@check("dedupe_keys", "P1", sql(_KEY_SQL, "businesses"))
def _(d: Domain):
    return _staged(d).select("id", "provider_id", _key().alias("dedupe_key"))


@check(
    "dedupe_key_tiers", "P1",
    sql(f"SELECT split_part(dedupe_key, '|', 1) AS tier, count(*) AS n FROM ({_KEY_SQL}) GROUP BY 1",
        "businesses"),
)
def _(d: Domain):
    return (
        _staged(d).select(F.split_part(_key(), F.lit("|"), F.lit(1)).alias("tier"))
        .groupBy("tier").agg(F.count(F.lit(1)).alias("n"))
    )


@check(
    "richness", "P2",
    sql("""SELECT id, (coalesce(address, '') <> '')::INT + (coalesce(phone, '') <> '')::INT
             + (coalesce(website, '') <> '')::INT + (coalesce(facebook_url, '') <> '')::INT
             + (coalesce(place_id, '') <> '')::INT + (lat IS NOT NULL AND lng IS NOT NULL)::INT AS richness
           FROM businesses""", "businesses"),
)
def _(d: Domain):
    return d.businesses.select(
        "id",
        identity.richness(
            *[F.col(c) for c in ("address", "phone", "website", "facebook_url", "place_id", "lat", "lng")]
        ).alias("richness"),
    )


_SIGHTINGS = """
  SELECT 'part|' || CAST(l_partkey AS VARCHAR) AS dedupe_key,
         l_orderkey * 10 + l_linenumber AS ordinal, l_orderkey, l_linenumber,
         'N' || CAST(l_suppkey AS VARCHAR) AS name, l_returnflag AS category, l_linestatus AS city,
         CASE WHEN l_quantity > 45 THEN 'A' || CAST(l_orderkey AS VARCHAR) ELSE '' END AS address,
         CASE WHEN l_discount >= 0.1 THEN 'T' || CAST(l_suppkey AS VARCHAR) END AS phone,
         CASE WHEN l_tax >= 0.08 THEN 'W' || CAST(l_orderkey AS VARCHAR) END AS website,
         CASE WHEN l_quantity <= 4 THEN 'S' || CAST(l_orderkey AS VARCHAR) END AS source_url,
         CASE WHEN l_extendedprice > 90000 THEN 'Q' || CAST(l_orderkey AS VARCHAR) END AS provider_id,
         CASE WHEN l_quantity BETWEEN 20 AND 24 THEN l_quantity END AS lat,
         CASE WHEN l_quantity BETWEEN 22 AND 26 THEN l_quantity END AS lng,
         [l_returnflag, l_linestatus || CAST(l_linenumber AS VARCHAR)] AS raw_categories,
         [l_linestatus] AS matched_niches
  FROM lineitem"""
_TEXTS = ("name", "category", "city", "address", "phone", "website", "source_url", "provider_id")


def _rich(t: str) -> str:
    return " + ".join(
        f"(coalesce({t}.{c}, '') <> '')::INT"
        for c in ("address", "phone", "website", "source_url", "provider_id")
    ) + f" + ({t}.lat IS NOT NULL AND {t}.lng IS NOT NULL)::INT"


def _fold_sql() -> str:
    def pick(c: str, blank: bool) -> str:
        a, b = (f"nullif(f.{c}, '')", f"nullif(s.{c}, '')") if blank else (f"f.{c}", f"s.{c}")
        return f"CASE WHEN {_rich('s')} > {_rich('f')} THEN coalesce({b}, {a}) ELSE coalesce({a}, {b}) END"

    picks = ", ".join(pick(c, True) for c in _TEXTS) + f", {pick('lat', False)}, {pick('lng', False)}"
    cols = ", ".join(_TEXTS)
    return f"""
WITH RECURSIVE sightings AS ({_SIGHTINGS}),
s AS (SELECT *, row_number() OVER (PARTITION BY dedupe_key ORDER BY ordinal) AS n,
             count(*) OVER (PARTITION BY dedupe_key) AS total FROM sightings),
fold(dedupe_key, ordinal, n, total, {cols}, lat, lng) AS (
  SELECT dedupe_key, ordinal, n, total, {cols}, lat, lng FROM s WHERE n = 1
  UNION ALL
  SELECT f.dedupe_key, f.ordinal, s.n, f.total, {picks}
  FROM fold f JOIN s ON s.dedupe_key = f.dedupe_key AND s.n = f.n + 1),
cats AS (
  SELECT dedupe_key, string_agg(item, ',' ORDER BY place) AS raw_categories FROM (
    SELECT dedupe_key, item, min(ordinal * 10 + pos) AS place
    FROM (SELECT dedupe_key, ordinal, unnest(raw_categories) AS item, unnest([0, 1]) AS pos FROM sightings)
    GROUP BY 1, 2) GROUP BY 1),
niches AS (
  SELECT dedupe_key, string_agg(item, ',' ORDER BY place) AS matched_niches FROM (
    SELECT dedupe_key, matched_niches[1] AS item, min(ordinal) AS place FROM sightings GROUP BY 1, 2) GROUP BY 1)
SELECT f.dedupe_key, f.ordinal, f.total AS merged_rows,
       {", ".join(f"nullif(f.{c}, '') AS {c}" for c in _TEXTS)}, f.lat, f.lng,
       c.raw_categories, m.matched_niches
FROM fold f JOIN cats c USING (dedupe_key) JOIN niches m USING (dedupe_key)
WHERE f.n = f.total"""


def _sightings(d: Domain):
    q, o, s = F.col("l_quantity"), F.col("l_orderkey").cast("string"), F.col("l_suppkey").cast("string")

    def tag(letter: str, value):
        return F.concat(F.lit(letter), value)

    return d.spread("lineitem", "l_orderkey", "l_linenumber").select(
        tag("part|", F.col("l_partkey").cast("string")).alias("dedupe_key"),
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("ordinal"),
        "l_orderkey", "l_linenumber",
        tag("N", s).alias("name"), F.col("l_returnflag").alias("category"),
        F.col("l_linestatus").alias("city"),
        F.when(q > 45, tag("A", o)).otherwise("").alias("address"),
        F.when(F.col("l_discount") >= 0.1, tag("T", s)).alias("phone"),
        F.when(F.col("l_tax") >= 0.08, tag("W", o)).alias("website"),
        F.when(q <= 4, tag("S", o)).alias("source_url"),
        F.when(F.col("l_extendedprice") > 90000, tag("Q", o)).alias("provider_id"),
        F.when(q.between(20, 24), q).alias("lat"),
        F.when(q.between(22, 26), q).alias("lng"),
        F.array("l_returnflag", F.concat("l_linestatus", F.col("l_linenumber").cast("string"))).alias("raw_categories"),
        F.array("l_linestatus").alias("matched_niches"),
    )


@check("merged_duplicates", "A1 U2", _fold_sql())
def _(d: Domain):
    merged = identity.merge_duplicates(_sightings(d))
    return merged.select(
        "dedupe_key", "ordinal", "merged_rows", *_TEXTS, "lat", "lng",
        F.array_join("raw_categories", ",").alias("raw_categories"),
        F.array_join("matched_niches", ",").alias("matched_niches"),
    )


_UPSERT_SQL = """
WITH both_ AS (
  SELECT CASE WHEN c_acctbal >= 0 THEN 'K' || CAST(c_custkey AS VARCHAR) END AS dedupe_key, 0 AS g,
         c_custkey AS seq, c_name AS name, c_mktsegment AS phone, CAST(c_nationkey AS VARCHAR) AS notes,
         TIMESTAMP '2024-01-01' AS seen_at FROM customer
  UNION ALL
  SELECT CASE WHEN o_orderpriority <> '5-LOW' THEN 'K' || CAST(o_custkey * 2 AS VARCHAR) END, 1, o_orderkey,
         'Order ' || CAST(o_orderkey AS VARCHAR),
         CASE WHEN o_orderstatus = 'F' THEN 'T' || CAST(o_orderkey AS VARCHAR) END,
         CASE o_orderstatus WHEN 'O' THEN '' WHEN 'P' THEN o_orderpriority END, o_orderdate FROM orders)
SELECT dedupe_key, arg_max(name, g * 1000000000 + seq) AS name,
       arg_max(phone, g * 1000000000 + seq) FILTER (WHERE phone IS NOT NULL) AS phone,
       arg_max(notes, g * 1000000000 + seq) FILTER (WHERE notes <> '') AS notes,
       arg_min(seen_at, g * 1000000000 + seq) AS first_seen_at,
       arg_max(seen_at, g * 1000000000 + seq) AS last_seen_at
FROM both_ WHERE dedupe_key IS NOT NULL GROUP BY dedupe_key
UNION ALL
SELECT dedupe_key, name, phone, nullif(notes, ''), seen_at, seen_at FROM both_ WHERE dedupe_key IS NULL"""


def _upserts(d: Domain):
    stored = d.table("customer").select(
        F.when(F.col("c_acctbal") >= 0, F.concat(F.lit("K"), F.col("c_custkey").cast("string"))).alias("dedupe_key"),
        F.col("c_custkey").alias("_seq"), F.col("c_name").alias("name"),
        F.col("c_mktsegment").alias("phone"), F.col("c_nationkey").cast("string").alias("notes"),
        F.lit("2024-01-01").cast("timestamp_ntz").alias("seen_at"),
    )
    status, key = F.col("o_orderstatus"), F.col("o_orderkey").cast("string")
    incoming = d.table("orders").select(
        F.when(F.col("o_orderpriority") != "5-LOW", F.concat(F.lit("K"), (F.col("o_custkey") * 2).cast("string"))).alias("dedupe_key"),
        F.col("o_orderkey").alias("_seq"), F.concat(F.lit("Order "), key).alias("name"),
        F.when(status == "F", F.concat(F.lit("T"), key)).alias("phone"),
        F.when(status == "O", "").when(status == "P", F.col("o_orderpriority")).alias("notes"),
        F.col("o_orderdate").alias("seen_at"),
    )
    return stored, incoming


@check("upserted_businesses", "A3", _UPSERT_SQL)
def _(d: Domain):
    merged = identity.upsert(
        *_upserts(d), "dedupe_key", replace=["name"], keep_known=["phone"],
        keep_present=["notes"], first={"first_seen_at": "seen_at"}, last={"last_seen_at": "seen_at"},
    )
    return merged.withColumn("notes", first_present(F.col("notes")))


@check("upserted_businesses_by_bucket", "A3", _UPSERT_SQL)
def _(d: Domain):
    """The stored table as hashed buckets, the orders merged in by three ranges of their keys."""
    stored, incoming = (df.withColumn("first_seen_at", F.col("seen_at")).withColumnRenamed("seen_at", "last_seen_at")
                        for df in _upserts(d))
    path = fresh_path(d.spark, "businesses")
    current.begin(stored.drop("_seq"), path, ["dedupe_key"], 64)
    for batch, part in enumerate(_in_ranges(incoming, "_seq", 3), 1):
        current.merge(d.spark, path, batch, part, lambda held, new: identity.upsert(
            held, new, "dedupe_key", replace=["name"], keep_known=["phone"], keep_present=["notes"],
            first={"first_seen_at": "first_seen_at"}, last={"last_seen_at": "last_seen_at"},
        ))
    return current.rows(d.spark, path).withColumn("notes", first_present(F.col("notes")))


def _in_ranges(df, column: str, n: int):
    """`df` in `n` parts that together are all of it, cut at quantiles of a column without nulls."""
    cuts = df.select(F.percentile_approx(column, [i / n for i in range(1, n)])).first()[0] or []
    value = F.col(column)
    bounds = [None, *sorted(set(cuts)), None]
    for low, high in zip(bounds, bounds[1:]):
        above = F.lit(True) if low is None else value > low
        yield df.where(above if high is None else above & (value <= high))


_CELLS_SQL = """SELECT c_custkey AS cell, c_mktsegment AS status FROM customer
       UNION ALL
       SELECT DISTINCT o_custkey * 2, 'pending' FROM orders
       WHERE NOT EXISTS (SELECT 1 FROM customer WHERE c_custkey = o_custkey * 2)"""


@check("cells_inserted_by_bucket", "A17", _CELLS_SQL)
def _(d: Domain):
    stored, incoming = _cells(d)
    path = fresh_path(d.spark, "cells")
    current.begin(stored, path, ["cell"], 64)
    for batch, part in enumerate(_in_ranges(incoming, "cell", 3), 1):
        current.merge(d.spark, path, batch, part, lambda held, new: identity.insert_if_absent(held, new, ["cell"]))
    return current.rows(d.spark, path)


def _cells(d: Domain):
    stored = d.table("customer").select(F.col("c_custkey").alias("cell"), F.col("c_mktsegment").alias("status"))
    return stored, d.table("orders").select((F.col("o_custkey") * 2).alias("cell"), F.lit("pending").alias("status"))


@check("cells_inserted_if_absent", "A17", _CELLS_SQL)
def _(d: Domain):
    return identity.insert_if_absent(*_cells(d), ["cell"])


_CANDIDATES = """
candidates AS (
  SELECT o_orderkey AS id, o_orderstatus AS niche_id,
         CASE WHEN o_orderpriority = '1-URGENT' THEN '' ELSE 'P' || lpad(CAST(o_custkey * 2 AS VARCHAR), 9, '0') END AS place_id,
         'name|' || CAST(o_custkey * 5 AS VARCHAR) AS dedupe_key FROM orders),
flagged AS (
  SELECT c.*, EXISTS (SELECT 1 FROM customer WHERE 'P' || lpad(CAST(c_custkey AS VARCHAR), 9, '0') = c.place_id)
           OR EXISTS (SELECT 1 FROM customer WHERE 'name|' || CAST(c_custkey AS VARCHAR) = c.dedupe_key) AS known
  FROM candidates c)"""


def _candidates(d: Domain):
    candidates = d.table("orders").select(
        F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("niche_id"),
        F.when(F.col("o_orderpriority") == "1-URGENT", "").otherwise(
            F.concat(F.lit("P"), F.lpad((F.col("o_custkey") * 2).cast("string"), 9, "0"))
        ).alias("place_id"),
        F.concat(F.lit("name|"), (F.col("o_custkey") * 5).cast("string")).alias("dedupe_key"),
    )
    key = F.col("c_custkey").cast("string")
    stored = d.table("customer").select(
        F.concat(F.lit("P"), F.lpad(key, 9, "0")).alias("place_id"),
        F.concat(F.lit("name|"), key).alias("dedupe_key"),
    )
    return candidates, stored


@check("known_places", "J4",
       f"WITH {_CANDIDATES} SELECT niche_id, known, count(*) AS n FROM flagged GROUP BY ALL")
def _(d: Domain):
    return identity.mark_known(*_candidates(d)).groupBy("niche_id", "known").agg(F.count(F.lit(1)).alias("n"))


@check("new_places", "J4",
       f"WITH {_CANDIDATES} SELECT id, niche_id, place_id, dedupe_key FROM flagged WHERE NOT known")
def _(d: Domain):
    return identity.only_new(*_candidates(d))


@check(
    "first_sightings", "W8",
    """SELECT l_partkey, l_orderkey, l_linenumber FROM (
         SELECT *, row_number() OVER (PARTITION BY l_partkey ORDER BY l_orderkey, l_linenumber) AS rn FROM lineitem)
       WHERE rn = 1""",
)
def _(d: Domain):
    return identity.first_sightings(
        d.table("lineitem").select("l_partkey", "l_orderkey", "l_linenumber"),
        "l_partkey", ["l_orderkey", "l_linenumber"],
    )


@check(
    "credited_per_cell", "W8",
    """SELECT l_orderkey, count(*) AS sightings, count(*) FILTER (WHERE rn = 1) AS credited FROM (
         SELECT *, row_number() OVER (PARTITION BY l_partkey ORDER BY l_orderkey, l_linenumber) AS rn FROM lineitem)
       GROUP BY l_orderkey""",
)
def _(d: Domain):
    lines = d.table("lineitem").select("l_partkey", "l_orderkey", "l_linenumber")
    credited = (
        identity.first_sightings(lines, "l_partkey", ["l_orderkey", "l_linenumber"])
        .groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("credited"))
    )
    return (
        lines.groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("sightings"))
        .join(credited, "l_orderkey", "left")
        .select("l_orderkey", "sightings", F.coalesce("credited", F.lit(0)).alias("credited"))
    )
