"""Scopes, gazetteer, grid planning, cell yields and quotas."""

import math

from pyspark.sql import functions as F

from doorstep.checks import check
from doorstep.checks.domain import PROFILES, QUALIFY, Domain, compact_sql, sql
from doorstep.checks.qualification import assessed
from doorstep.functions import geo
from doorstep.operators import cells, identity, places, qualify
from doorstep.sources import gazetteer

COUNTRIES = ("India", "U.S.A.", "Singapore", "UK", "Atlantis")
CODES = ("in", "us", "sg", "gb", "xx")

_N = compact_sql
_SCOPES = f"""
scopes AS (
  SELECT c_custkey AS scope_id, CASE WHEN c_acctbal > 8000 THEN 'city-' || CAST(n_nationkey AS VARCHAR) ELSE n_name END AS city,
         CASE WHEN c_acctbal > 6000 THEN ' ' ELSE r_name END AS state,
         ['India', 'U.S.A.', 'Singapore', 'UK', 'Atlantis'][r_regionkey + 1] AS country,
         CASE WHEN c_acctbal < 1000 THEN [] WHEN c_acctbal < 4000 THEN ['Area  ' || CAST(CAST(floor(c_acctbal / 1000) AS BIGINT) AS VARCHAR), 'AREA-' || CAST(CAST(floor(c_acctbal / 1000) AS BIGINT) AS VARCHAR), ' ']
              ELSE [n_name, c_mktsegment] END AS areas
  FROM customer JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey),
picked AS (
  SELECT scope_id, city, trim(state) AS state, country, trim(regexp_replace(a, '\\s+', ' ', 'g')) AS area, {_N('a')} AS akey, min(pos) AS pos FROM (
    SELECT *, unnest(areas) AS a, generate_subscripts(areas, 1) AS pos FROM scopes) WHERE trim(a) <> '' GROUP BY ALL),
chosen AS (
  SELECT scope_id, city, state, country, arg_min(area, pos) AS area FROM picked GROUP BY scope_id, city, state, country, akey
  UNION ALL SELECT scope_id, city, trim(state), country, NULL FROM scopes WHERE len(areas) = 0),
targets AS (
  SELECT scope_id, area, city, state, country, CASE WHEN area IS NULL THEN 'city' ELSE 'area' END AS precision,
         concat_ws(', ', area, CASE WHEN area IS NULL OR {_N('area')} <> {_N('city')} THEN city END, nullif(state, ''), country) AS query,
         CASE WHEN area IS NULL THEN 15000 ELSE 3000 END AS radius_m
  FROM chosen)"""


def scopes(d: Domain):
    bal, level = F.col("c_acctbal"), F.floor(F.col("c_acctbal") / 1000).cast("string")
    joined = (
        d.table("customer")
        .join(d.table("nation"), F.col("n_nationkey") == F.col("c_nationkey"))
        .join(d.table("region"), F.col("r_regionkey") == F.col("n_regionkey"))
    )
    return joined.select(
        F.col("c_custkey").alias("scope_id"),
        F.when(bal > 8000, F.concat(F.lit("city-"), F.col("n_nationkey").cast("string"))).otherwise(F.col("n_name")).alias("city"),
        F.when(bal > 6000, " ").otherwise(F.col("r_name")).alias("state"),
        F.element_at(F.array(*[F.lit(c) for c in COUNTRIES]), F.col("r_regionkey") + 1).alias("country"),
        F.when(bal < 1000, F.array().cast("array<string>"))
        .when(bal < 4000, F.array(F.concat(F.lit("Area  "), level), F.concat(F.lit("AREA-"), level), F.lit(" ")))
        .otherwise(F.array("n_name", "c_mktsegment")).alias("areas"),
    )


def targets(d: Domain):
    return places.scope_targets(scopes(d)).withColumn("state", F.trim("state"))


@check("scope_targets", "P24 P19", f"WITH {_SCOPES} SELECT * FROM targets")
def _(d: Domain):
    return targets(d)


@check(
    "location_strings", "P19",
    f"""WITH {_SCOPES} SELECT scope_id, query, CASE WHEN precision = 'area' AND {_N('area')} <> {_N('city')} THEN city
           WHEN precision = 'area' THEN CASE WHEN state <> '' THEN state ELSE country END ELSE city END AS city_of_query FROM targets""",
)
def _(d: Domain):
    return targets(d).select("scope_id", "query", geo.city_of(F.col("query"), F.col("precision")).alias("city_of_query"))


_KEYS = f"""
gaz_city AS (SELECT n_name AS city, 'City ' || CAST(n_nationkey AS VARCHAR) AS alias, r_name AS state,
             ['India', 'U.S.A.', 'Singapore', 'UK', 'Atlantis'][r_regionkey + 1] AS country, ['in', 'us', 'sg', 'gb', 'xx'][r_regionkey + 1] AS gl,
             CAST(n_nationkey AS DOUBLE) AS lat, CAST(r_regionkey AS DOUBLE) AS lng FROM nation JOIN region ON r_regionkey = n_regionkey),
city_spell AS (SELECT *, unnest([{_N('city')}, {_N('alias')}]) AS city_key FROM gaz_city),
gaz_area AS (SELECT DISTINCT 'Area ' || CAST(CAST(floor(c_acctbal / 1000) AS BIGINT) AS VARCHAR) AS area, n_name AS city FROM customer JOIN nation ON n_nationkey = c_nationkey WHERE c_acctbal >= 0),
keys AS (
  SELECT 'city' AS precision, '' AS area_key, city_key, NULL AS area, city, state, country, gl, lat, lng FROM city_spell
  UNION ALL
  SELECT 'area', {_N('a.area')}, s.city_key, a.area, s.city, s.state, s.country, s.gl, s.lat, s.lng FROM gaz_area a JOIN city_spell s ON s.city = a.city)"""


def place_keys(d: Domain):
    region_at = F.col("r_regionkey") + 1
    cities = d.table("nation").join(d.table("region"), F.col("r_regionkey") == F.col("n_regionkey")).select(
        F.col("n_name").alias("city"),
        F.array(F.concat(F.lit("City "), F.col("n_nationkey").cast("string"))).alias("aliases"),
        F.col("r_name").alias("state"),
        F.element_at(F.array(*[F.lit(c) for c in COUNTRIES]), region_at).alias("country"),
        F.element_at(F.array(*[F.lit(c) for c in CODES]), region_at).alias("gl"),
        F.col("n_nationkey").cast("double").alias("lat"), F.col("r_regionkey").cast("double").alias("lng"),
    )
    named = (
        d.table("customer").where(F.col("c_acctbal") >= 0)
        .join(d.table("nation"), F.col("n_nationkey") == F.col("c_nationkey"))
        .select(F.concat(F.lit("Area "), F.floor(F.col("c_acctbal") / 1000).cast("string")).alias("area"), F.col("n_name").alias("city"))
        .distinct()
    )
    areas = named.join(cities.drop("aliases"), "city").select(
        "area", "city", F.array().cast("array<string>").alias("aliases"), "state", "country", "gl", "lat", "lng"
    )
    return gazetteer.place_keys(cities, areas)


@check("gazetteer_keys", "S5", f"WITH {_KEYS} SELECT * FROM keys")
def _(d: Domain):
    return place_keys(d)


@check("clashing_gazetteer_keys", "S5",
       f"WITH {_KEYS} SELECT precision, area_key, city_key, count(DISTINCT (city, state)) AS entries FROM (SELECT precision, area_key, left(city_key, 7) AS city_key, city, state FROM keys) GROUP BY ALL HAVING count(DISTINCT (city, state)) > 1")
def _(d: Domain):
    """Keys cut to seven characters, so that different cities do collide."""
    cut = place_keys(d).withColumn("city_key", F.left("city_key", F.lit(7)))
    return gazetteer.clashing_keys(cut)


_LOOKUP = f"""
looked AS (
  SELECT t.*, CASE WHEN precision = 'area' THEN {_N("string_split(query, ', ')[1]")} ELSE '' END AS ak,
         CASE WHEN precision = 'area' THEN {_N("string_split(query, ', ')[2]")} ELSE {_N("string_split(query, ', ')[1]")} END AS ck,
         list_transform(string_split(query, ', ')[CASE WHEN precision = 'area' THEN 3 ELSE 2 END:], lambda x: regexp_replace(lower(x), '[^a-z0-9]+', '', 'g')) AS tail FROM targets t),
hits AS (
  SELECT l.*, k.area AS karea, k.city AS kcity, k.state AS kstate, k.country AS kcountry, k.lat, k.lng, k.gl,
         k.precision IS NOT NULL AND len(list_filter(l.tail, lambda x: x NOT IN ({_N('k.state')}, {_N('k.country')}, {_N('k.gl')}))) = 0 AS agrees
  FROM looked l LEFT JOIN keys k ON k.precision = l.precision AND k.area_key = l.ak AND k.city_key = l.ck)"""


@check("resolved_locations", "J9",
       f"WITH {_SCOPES},{_KEYS},{_LOOKUP} SELECT scope_id, area, query, concat_ws(', ', karea, kcity, kstate, kcountry) AS label, lat, lng, gl, radius_m FROM hits WHERE agrees")
def _(d: Domain):
    resolved, _ = places.resolve_targets(targets(d), place_keys(d))
    return resolved.select("scope_id", "area", "query", "label", "lat", "lng", "gl", "radius_m")


@check("unresolved_locations", "J9",
       f"WITH {_SCOPES},{_KEYS},{_LOOKUP} SELECT scope_id, area, query FROM hits WHERE NOT agrees")
def _(d: Domain):
    _, unresolved = places.resolve_targets(targets(d), place_keys(d))
    return unresolved.select("scope_id", "area", "query")


@check(
    "country_checks", "J10",
    f"""WITH {_SCOPES},{_KEYS},{_LOOKUP}
        SELECT declared_gl, gl, declared_gl IS NOT NULL AND gl IS NOT NULL AND declared_gl <> gl AS wrong_country, count(*) AS n
        FROM (SELECT *, CASE country WHEN 'India' THEN 'in' WHEN 'U.S.A.' THEN 'us' WHEN 'Singapore' THEN 'sg' WHEN 'UK' THEN 'gb' END AS declared_gl,
                     CASE WHEN scope_id > 100 THEN gl ELSE 'us' END AS gl FROM (SELECT * FROM hits WHERE agrees)) GROUP BY ALL""".replace("SELECT *, CASE country", "SELECT * EXCLUDE (gl), CASE country"),
)
def _(d: Domain):
    resolved, _ = places.resolve_targets(targets(d), place_keys(d))
    staged = resolved.withColumn("declared_gl", geo.country_code(F.col("country"))).withColumn(
        "gl", F.when(F.col("scope_id") > 100, F.col("gl")).otherwise("us")
    )
    return places.country_check(staged).groupBy("declared_gl", "gl", "wrong_country").agg(F.count(F.lit(1)).alias("n"))


@check(
    "run_scopes", "J15",
    """SELECT o_orderkey AS run_id, o_custkey AS goal_id, n_name AS city, CASE WHEN c_acctbal > 0 THEN c_mktsegment END AS state,
              NULL::VARCHAR AS country, c_mktsegment || ',x' AS areas
       FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey""",
)
def _(d: Domain):
    goals = d.table("customer").join(d.table("nation"), F.col("n_nationkey") == F.col("c_nationkey")).select(
        F.col("c_custkey").alias("id"),
        F.to_json(
            F.struct(
                F.col("n_name").alias("city"),
                F.when(F.col("c_acctbal") > 0, F.col("c_mktsegment")).alias("state"),
                F.array("c_mktsegment", F.lit("x")).alias("areas"),
            )
        ).alias("spec"),
    )
    runs = d.table("orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("goal_id"))
    return places.run_scopes(runs, goals).withColumn("areas", F.array_join("areas", ","))


_CELLS = f"""
lattice AS (
  SELECT row_number() OVER (ORDER BY round(sqrt(e * e + n * n), 3), round(atan2(n, e), 6)) - 1 AS tile, e AS east, n AS north FROM (
    SELECT {1200 * math.sqrt(3)!r}::DOUBLE * (q + r / 2.0::DOUBLE) AS e, {1200 * math.sqrt(3) * math.sqrt(3) / 2!r}::DOUBLE * r AS n
    FROM (SELECT unnest(range(-2, 3)) AS q), (SELECT unnest(range(-2, 3)) AS r) WHERE abs(q + r) <= 2)),
t AS (SELECT s_suppkey, 10 + s_nationkey + s_acctbal / 70000 AS lat, 70 + s_acctbal / 30000 AS lng FROM supplier),
q AS (SELECT * FROM (VALUES {', '.join(f"('{p.id}', '{v}')" for p in PROFILES for v in dict.fromkeys(p.queries[:5]))}) v(niche_id, query_variant))"""


@check(
    "planned_cells", "P23 S6",
    f"""WITH {_CELLS} SELECT s_suppkey, niche_id, CAST(tile AS INTEGER) AS tile, round(lat + north / 111320.0::DOUBLE, 6) AS tile_lat,
          round(lng + east / (111320.0::DOUBLE * cos(radians(lat))), 6) AS tile_lng, 1200 AS tile_radius_m, query_variant
        FROM t, lattice, q WHERE tile < 13""",
)
def _(d: Domain):
    bal = F.col("s_acctbal")
    profiles = F.array(
        *[
            F.struct(F.lit(p.id).alias("niche_id"), F.array(*[F.lit(q) for q in p.queries]).alias("queries"))
            for p in PROFILES
        ]
    )
    wanted = d.table("supplier").select(
        "s_suppkey", (10 + F.col("s_nationkey") + bal / 70000).alias("lat"),
        (70 + bal / 30000).alias("lng"), F.lit(3000).alias("radius_m"), F.inline(profiles),
    )
    return cells.plan_cells(wanted, cells.DEEP_SWEEP)


@check(
    "plan_costs", "P26",
    f"""WITH {_SCOPES} SELECT scope_id, count(*) AS locations, count(*) * 4 * 195 AS deep_cost, count(*) * 4 AS cost,
             count(*) * 4 > 6 AS over_allowance FROM targets GROUP BY scope_id""",
)
def _(d: Domain):
    n = F.col("locations")
    return (
        targets(d).groupBy("scope_id").agg(F.count(F.lit(1)).alias("locations"))
        .select(
            "scope_id", "locations",
            cells.plan_cost(n, len(PROFILES), cells.DEEP_SWEEP).alias("deep_cost"),
            cells.plan_cost(n, len(PROFILES), cells.BREADTH_FIRST).alias("cost"),
            (cells.plan_cost(n, len(PROFILES), cells.BREADTH_FIRST) > 6).alias("over_allowance"),
        )
    )


@check(
    "lookup_keys", "P20",
    """SELECT c_custkey, '"' || c_name || '" ' || n_name AS phrase,
         'https://ads.example/?active_status=active&ad_type=all&country=IN&media_type=all&q=' || replace(url_encode(c_name || ' & ' || n_name), '%20', '+') || '&search_type=keyword_unordered' AS ad_url,
         '@' || CAST(n_nationkey AS VARCHAR) || ',' || CAST(n_regionkey AS VARCHAR) || ',' || CAST(least(5000, greatest(62, c_custkey)) AS VARCHAR) || 'm' AS point
       FROM customer JOIN nation ON n_nationkey = c_nationkey""",
)
def _(d: Domain):
    joined = d.table("customer").join(d.table("nation"), F.col("n_nationkey") == F.col("c_nationkey"))
    return joined.select(
        "c_custkey", geo.search_phrase(F.col("c_name"), F.col("n_name")).alias("phrase"),
        geo.ad_search_url(
            "https://ads.example/", F.concat("c_name", F.lit(" & "), "n_name"), F.lit("in")
        ).alias("ad_url"),
        geo.point_parameter(F.col("n_nationkey"), F.col("n_regionkey"), F.col("c_custkey"), 62, 5000).alias("point"),
    )


_MACHINE = """
WITH RECURSIVE passes AS (
  SELECT user_id AS cell_id, CAST(CAST(ts AS DATE) AS TIMESTAMP) AS searched_at,
         count(*) FILTER (WHERE event_type = 'purchase') AS new_count, count(*) AS total_count FROM events GROUP BY 1, 2),
p AS (SELECT *, row_number() OVER (PARTITION BY cell_id ORDER BY searched_at) AS n FROM passes),
m(cell_id, n, searched_at, new_count, total_count, status, next_page, new_yield, total_yield, revived, exhausted_at) AS (
  SELECT cell_id, n, searched_at, new_count, total_count,
         CASE WHEN new_count >= 5 THEN 'hot' WHEN new_count > 0 THEN 'cooling' ELSE 'struck' END,
         CASE WHEN new_count > 0 THEN 2 ELSE 1 END::BIGINT, new_count, total_count::BIGINT, false, NULL::TIMESTAMP
  FROM p WHERE n = 1
  UNION ALL
  SELECT p.cell_id, p.n, p.searched_at, p.new_count, p.total_count,
         CASE WHEN p.new_count >= 5 THEN 'hot' WHEN p.new_count > 0 THEN 'cooling'
              WHEN e.st IN ('struck', 'exhausted') THEN 'exhausted' ELSE 'struck' END,
         e.pg + CASE WHEN p.new_count > 0 THEN 1 ELSE 0 END, p.new_count, m.total_yield + p.total_count, e.rv,
         CASE WHEN p.new_count = 0 AND e.st IN ('struck', 'exhausted') THEN p.searched_at END
  FROM m JOIN p ON p.cell_id = m.cell_id AND p.n = m.n + 1,
       LATERAL (SELECT @REVIVE AS rv) r0,
       LATERAL (SELECT r0.rv AS rv, CASE WHEN r0.rv THEN 'pending' ELSE m.status END AS st, CASE WHEN r0.rv THEN 1 ELSE m.next_page END AS pg) e)
SELECT cell_id, searched_at, new_count, total_count, status, next_page, new_yield, total_yield, revived, exhausted_at FROM m"""


def _history(d: Domain, days):
    passes = d.table("events").groupBy(
        F.col("user_id").alias("cell_id"),
        F.col("ts").cast("date").cast("timestamp_ntz").alias("searched_at"),
    ).agg(
        F.count_if(F.col("event_type") == "purchase").alias("new_count"),
        F.count(F.lit(1)).alias("total_count"),
    )
    return cells.cell_history(passes, revive_after_days=days)


@check("cell_history", "W7", _MACHINE.replace("@REVIVE", "false"))
def _(d: Domain):
    return _history(d, None)


@check("cell_history_with_revival", "W7",
       _MACHINE.replace("@REVIVE", "m.status = 'exhausted' AND m.exhausted_at < p.searched_at - INTERVAL 1 DAY"))
def _(d: Domain):
    return _history(d, 1)


_ORDER_CELLS = """
cells AS (
  SELECT o_orderkey AS id, o_orderpriority AS area, 'niche ' || CAST(o_custkey % 10 AS VARCHAR) AS niche_id,
         ['pending', 'hot', 'cooling', 'struck', 'exhausted'][CAST(floor(o_totalprice) AS BIGINT) % 5 + 1] AS status,
         CAST(floor(o_totalprice) AS BIGINT) % 7 AS new_yield, CAST(floor(o_totalprice) AS BIGINT) % 4 + 1 AS next_page,
         'q' || CAST(o_custkey % 3 AS VARCHAR) AS query_variant, CASE WHEN o_orderstatus <> 'P' THEN o_orderdate END AS exhausted_at,
         CASE o_orderstatus WHEN 'F' THEN 3 ELSE 1 END AS priority FROM orders)"""


def _order_cells(d: Domain):
    whole = F.floor("o_totalprice")
    states = F.array(*[F.lit(s) for s in ("pending", "hot", "cooling", "struck", "exhausted")])
    return d.table("orders").select(
        F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("area"),
        F.concat(F.lit("niche "), (F.col("o_custkey") % 10).cast("string")).alias("niche_id"),
        F.element_at(states, (whole % 5 + 1).cast("int")).alias("status"),
        (whole % 7).alias("new_yield"), (whole % 4 + 1).alias("next_page"),
        F.concat(F.lit("q"), (F.col("o_custkey") % 3).cast("string")).alias("query_variant"),
        F.when(F.col("o_orderstatus") != "P", F.col("o_orderdate")).alias("exhausted_at"),
        F.when(F.col("o_orderstatus") == "F", 3).otherwise(1).alias("priority"),
    )


@check(
    "live_cells", "F5",
    f"""WITH {_ORDER_CELLS} SELECT id, CASE WHEN x THEN 'pending' ELSE status END AS status, CASE WHEN x THEN 1 ELSE next_page END AS next_page,
          CASE WHEN x THEN 0 ELSE new_yield END AS new_yield, CASE WHEN x THEN NULL ELSE exhausted_at END AS exhausted_at, x OR status <> 'exhausted' AS live
        FROM (SELECT *, coalesce(status = 'exhausted' AND exhausted_at < TIMESTAMP '1998-01-31' - INTERVAL 30 DAY, false) AS x FROM cells)""",
)
def _(d: Domain):
    return cells.live_cells(_order_cells(d), F.lit("1998-01-31").cast("timestamp_ntz")).select(
        "id", "status", "next_page", "new_yield", "exhausted_at", "live"
    )


@check(
    "selected_cells", "T3",
    f"""WITH {_ORDER_CELLS}, k AS (SELECT *, CASE status WHEN 'hot' THEN 0 WHEN 'pending' THEN 1 WHEN 'cooling' THEN 2 ELSE 3 END AS sr FROM cells WHERE status <> 'exhausted'),
        g AS (SELECT *, row_number() OVER (PARTITION BY area, niche_id ORDER BY -priority, -new_yield, sr, id, query_variant) AS group_rank FROM k)
        SELECT id, area, niche_id, group_rank, row_number() OVER (ORDER BY -priority, -new_yield, sr, id, query_variant) AS queue_rank FROM g WHERE group_rank <= 13""",
)
def _(d: Domain):
    chosen = cells.select_cells(_order_cells(d), ["area", "niche_id"], 13, F.col("priority"))
    return chosen.select("id", "area", "niche_id", "group_rank", "queue_rank")


@check(
    "kept_within_quota", "W5",
    sql("""SELECT id, niche_id, kept_rank FROM (SELECT *, row_number() OVER (PARTITION BY niche_id ORDER BY search_id, id) AS kept_rank
           FROM assessed WHERE qualifies) WHERE kept_rank <= 15""", *QUALIFY),
)
def _(d: Domain):
    hits = assessed(d).where("qualifies")
    return cells.within_quota(
        hits, "niche_id", [F.col("search_id"), F.col("id")], cells.quota(60, len(PROFILES))
    ).select("id", "niche_id", "kept_rank")


@check(
    "cells_within_scan_cap", "W5",
    sql("""SELECT search_id, niche_id, n, before AS candidates_before FROM (
             SELECT *, sum(n) OVER (PARTITION BY niche_id ORDER BY search_id) - n AS before FROM (
               SELECT search_id, niche_id, count(*) AS n FROM assessed GROUP BY ALL)) WHERE before < 200""", *QUALIFY),
)
def _(d: Domain):
    counts = assessed(d).groupBy("search_id", "niche_id").agg(F.count(F.lit(1)).alias("n"))
    return cells.within_scan_cap(counts, "niche_id", [F.col("search_id")], "n", cells.scan_cap(100, 3))


@check(
    "niche_outcomes", "A13",
    sql("""SELECT t.niche_id, t.searches, t.candidates, t.qualified, coalesce(k.fresh, 0) AS new_businesses, coalesce(k.old, 0) AS already_stored,
             t.gate AS name_gate_rejected, CASE WHEN t.qualified > 0 THEN 'verified' WHEN t.candidates - t.qualified >= 20 THEN 'starved' ELSE 'unverified' END AS state
           FROM (SELECT niche_id, count(DISTINCT search_id) AS searches, count(*) AS candidates, count(*) FILTER (WHERE qualifies) AS qualified,
                        count(*) FILTER (WHERE NOT qualifies AND type_ok AND NOT fatal) AS gate FROM assessed GROUP BY 1) t
           LEFT JOIN (SELECT niche_id, count(*) FILTER (WHERE NOT known) AS fresh, count(*) FILTER (WHERE known) AS old FROM (
               SELECT niche_id, EXISTS (SELECT 1 FROM supplier s WHERE s.s_suppkey * 3 = a.id OR s.s_suppkey * 5 = a.id) AS known FROM assessed a WHERE qualifies) GROUP BY 1) k USING (niche_id)""",
        *QUALIFY),
)
def _(d: Domain):
    rows = assessed(d)
    key = F.col("id").cast("string")
    candidates = rows.where("qualifies").select("niche_id", key.alias("place_id"), key.alias("dedupe_key"))
    stored = d.table("supplier").select(
        (F.col("s_suppkey") * 3).cast("string").alias("place_id"),
        (F.col("s_suppkey") * 5).cast("string").alias("dedupe_key"),
    )
    counts = qualify.telemetry(rows, ["search_id"], 60)
    return qualify.outcome_report(counts, identity.mark_known(candidates, stored))
