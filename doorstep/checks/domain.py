"""The given tables read as domain tables, in Spark and as SQL common table expressions."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from doorstep.session import prepare
from doorstep.sources.registry import Offer, Profile
from doorstep.sources.tables import read_spread

# A registry and an offer catalogue for the words the given tables hold.
PROFILES = (
    Profile(
        "ring_shop", "Ring Shop", queries=("ring shop", "ring studio", "ring shop"),
        aliases=("rings", "jewel corner"), include_types=("small_ring", "new_ring"),
        exclude_types=("old_ring", "large"), include_suffixes=("_ring",),
        exclude_suffixes=("_anvil",), demand=20, budget=13, offer="ring catalogue",
    ),
    Profile(
        "metal_works", "Metal Works", queries=("metal works", "rod mill"), aliases=("metal",),
        include_suffixes=("_bolt", "_rod", "_plate"), exclude_types=("economy", "cold_rod"),
        terms=("hot", "large", "promo"), strict=True, demand=18, budget=20,
        offer="quotation requests", scan_multiplier=3,
    ),
    Profile(
        "gear_dealer", "Gear Dealer", queries=("gear dealer",), aliases=("gears",),
        include_types=("new_gear",), exclude_types=("promo",), exclude_suffixes=("_widget",),
        terms=("gear", "gizmo"), strict=True, allow_name_only=True, demand=22, budget=16,
        offer="gear finder", scan_multiplier=2,
    ),
    Profile(
        "promo_house", "Promo House", queries=("promo house", "event promo"),
        include_types=("promo", "small"), demand=24, budget=24, offer="campaign pages",
    ),
)
OFFERS = (
    Offer("watchful", "Watchful", (), ("view", "error"), 2.0),
    Offer("buyer_care", "Buyer care", ("building", "machinery"), ("purchase",), 3.0),
    Offer("full_funnel", "Full funnel", ("household", "furniture", "building"),
          ("signup", "click", "purchase"), 4.0),
    Offer("greeting", "Greeting", ("automobile",), ("signup",), 1.0),
)


def slug_sql(value: str) -> str:
    return (
        f"regexp_replace(regexp_replace(lower(strip_accents({value})), '[^a-z0-9]+', '_', 'g'), "
        "'^_+|_+$', '', 'g')"
    )


def compact_sql(value: str) -> str:
    return f"regexp_replace(lower(coalesce(CAST({value} AS VARCHAR), '')), '[^a-z0-9]+', '', 'g')"


def _quoted(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def _values(rows: list[tuple]) -> str:
    def cell(v) -> str:
        if v is None:
            return "NULL"
        if isinstance(v, bool):
            return "TRUE" if v else "FALSE"
        return _quoted(v) if isinstance(v, str) else repr(v)

    return "VALUES " + ", ".join("(" + ", ".join(cell(v) for v in r) + ")" for r in rows)


CTES = {
    "businesses": """
  SELECT c.c_custkey AS id, c.c_custkey AS business_id,
         'P' || lpad(CAST(c.c_custkey AS VARCHAR), 9, '0') AS place_id,
         c.c_name AS name, lower(c.c_mktsegment) AS niche_id,
         'Country ' || CAST(r.r_regionkey AS VARCHAR) AS country,
         r.r_name AS state, n.n_name AS city,
         CASE WHEN c.c_acctbal < 0 THEN NULL WHEN c.c_acctbal < 500 THEN '  '
              WHEN c.c_acctbal < 5000 THEN 'Area ' || CAST(CAST(floor(c.c_acctbal / 1000) AS BIGINT) AS VARCHAR)
              ELSE 'AREA ' || CAST(CAST(floor(c.c_acctbal / 2000) AS BIGINT) AS VARCHAR) END AS search_area,
         CASE WHEN c.c_acctbal < 2000 THEN '' ELSE 'No. ' || CAST(c.c_custkey AS VARCHAR) || ', ' || n.n_name END AS address,
         CASE WHEN c.c_acctbal >= 0 THEN 10 + n.n_nationkey + c.c_acctbal / 100000 END AS lat,
         CASE WHEN c.c_acctbal >= 100 THEN 70 + r.r_regionkey + c.c_acctbal / 50000 END AS lng,
         CASE WHEN c.c_acctbal >= 3000 THEN '080-' || lpad(CAST(c.c_custkey AS VARCHAR), 7, '0') END AS phone,
         CASE WHEN c.c_acctbal >= 8000 THEN 'info' || CAST(c.c_custkey AS VARCHAR) || '@example.com' END AS email,
         CASE WHEN c.c_acctbal >= 1500 THEN p.url END AS website,
         CASE WHEN c.c_acctbal >= 9000 THEN 'shop.' || CAST(c.c_custkey AS VARCHAR) END AS instagram_handle,
         CAST(NULL AS VARCHAR) AS facebook_url,
         TIMESTAMP '2024-01-01 00:00:00' + to_minutes(c.c_custkey) AS first_seen_at
  FROM customer c
  JOIN nation n ON n.n_nationkey = c.c_nationkey
  JOIN region r ON r.r_regionkey = n.n_regionkey
  LEFT JOIN pages p ON p.page_id = c.c_custkey % (SELECT max(page_id) + 1 FROM pages)""",
    "observations": """
  SELECT event_id AS id,
         user_id + (SELECT max(user_id) + 1 FROM events) * (event_id % 10) AS business_id,
         CASE event_type WHEN 'view' THEN 'google_maps' WHEN 'click' THEN 'instagram_profile'
              WHEN 'signup' THEN 'instagram_handle' WHEN 'purchase' THEN 'ad_library'
              ELSE 'tinyfish_web' END AS source,
         CASE WHEN k % 10 < 5 THEN 'ok' WHEN k % 10 < 8 THEN 'no_data'
              WHEN k % 10 = 8 THEN 'blocked' ELSE 'error' END AS status,
         '{"type":"' || event_type || '","reviews":'
           || CASE WHEN k % 7 = 0 THEN '"unavailable"' ELSE CAST(k * 8 AS VARCHAR) END
           || ',"rating":' || CAST(k % 5 AS VARCHAR) || ',"followers":' || CAST(k * 300 AS VARCHAR)
           || ',"runs_ads":' || CASE WHEN k % 2 = 0 THEN 'true' ELSE 'false' END
           || ',"handle":"shop_' || CAST(user_id AS VARCHAR) || '"}' AS data,
         'https://listing.example/' || CAST(event_id AS VARCHAR) AS source_url,
         ts AS fetched_at, user_id AS run_id, event_type, k, value
  FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events)""",
    "scores": """
  SELECT o_orderkey AS id, o_custkey AS business_id, o_orderstatus AS scorer_version,
         CAST(floor(o_totalprice) AS BIGINT) % 101 AS total,
         CAST(floor(o_totalprice) AS BIGINT) % 31 AS demand,
         CAST(floor(o_totalprice) AS BIGINT) % 26 AS website_gap,
         CAST(floor(o_totalprice) AS BIGINT) % 21 AS reachability,
         '["' || o_orderpriority || '"," public phone ",""]' AS signals,
         '{"ai_summary":" Summary ' || CAST(o_orderkey AS VARCHAR) || ' "}' AS evidence,
         o_orderdate AS scored_at,
         CASE WHEN o_orderpriority <> '4-NOT SPECIFIED'
              THEN round(log10(1 + o_totalprice) / 6, 6) END AS audience_index
  FROM orders""",
    "contacts": """
  SELECT o_orderkey AS id, o_custkey AS business_id,
         'Person ' || CAST(o_orderkey AS VARCHAR) AS name,
         CASE o_orderstatus WHEN 'F' THEN 'owner' WHEN 'O' THEN 'manager' ELSE 'unknown' END AS role,
         CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN '98' || CAST(o_orderkey AS VARCHAR) END AS phone,
         CASE WHEN o_orderpriority = '3-MEDIUM' THEN 'p' || CAST(o_orderkey AS VARCHAR) || '@example.com' END AS email,
         'website' AS source,
         CASE o_orderpriority WHEN '1-URGENT' THEN 0.8 WHEN '2-HIGH' THEN 0.6 ELSE 0.4 END AS confidence,
         o_orderdate AS found_at
  FROM orders""",
    "outreach": """
  SELECT o_orderkey AS id, o_custkey AS business_id,
         CASE o_orderstatus WHEN 'F' THEN 'website_pitch' WHEN 'O' THEN 'automation_pitch' ELSE 'note' END AS kind,
         'Draft ' || CAST(o_orderkey AS VARCHAR) AS body, o_orderdate AS created_at
  FROM orders""",
    "opportunities": """
  SELECT business_id, opportunity_id, max_by(confidence, id) AS confidence
  FROM (SELECT business_id, event_type AS opportunity_id, k / 100.0 AS confidence, id FROM observations)
  GROUP BY business_id, opportunity_id""",
    "verdicts": """
  SELECT c_custkey AS business_id,
         CASE WHEN c_acctbal >= 7000 THEN 'high' WHEN c_acctbal >= 4000 THEN 'medium'
              WHEN c_acctbal >= 1000 THEN 'low' WHEN c_acctbal >= 0 THEN 'skip' END AS my_verdict,
         CASE WHEN c_acctbal < 3000 THEN '' WHEN c_acctbal < 6000 THEN ' see again ' END AS notes,
         CASE WHEN c_acctbal >= 6000 THEN '2024-02-01' END AS contacted_on,
         CASE WHEN c_acctbal >= 6000 THEN 'call' END AS channel,
         CASE WHEN c_acctbal >= 8000 THEN 'replied' END AS outcome
  FROM customer""",
    "listings": f"""
  SELECT p_partkey AS id, p_name AS name, p_type AS category,
         [p_type, p_name, p_brand] AS raw_categories,
         CASE WHEN p_size <= 10 THEN NULL WHEN p_size <= 20 THEN 'https://instagram.com/x' || CAST(p_partkey AS VARCHAR)
              WHEN p_size <= 30 THEN 'shop' || CAST(p_partkey AS VARCHAR) || '.blogspot.com'
              ELSE 'https://shop' || CAST(p_partkey AS VARCHAR) || '.example.com' END AS website,
         CASE WHEN p_retailprice >= 930 THEN '080' || CAST(p_partkey AS VARCHAR) END AS phone,
         CASE WHEN p_retailprice < 970 THEN 'https://listing.example/' || CAST(p_partkey AS VARCHAR) END AS source_url,
         p_brand AS search_id, p_size, p_retailprice,
         [{slug_sql('p_type')}, {slug_sql('p_name')}, {slug_sql('p_brand')}] AS types,
         lower(p_name || ' ' || p_type || ' ' || p_type || ' ' || p_name || ' ' || p_brand) AS evidence
  FROM part""",
    "profiles": "SELECT * FROM ("
    + _values(
        [(i, p.id, p.label, p.strict, p.allow_name_only, p.demand, p.budget, p.offer,
          p.scan_multiplier) for i, p in enumerate(PROFILES)]
    )
    + ") AS v(position, niche_id, label, strict, name_only, demand, budget, offer, scan_multiplier)",
    "rules": "SELECT * FROM ("
    + _values(
        [
            (p.id, kind, v)
            for p in PROFILES
            for kind, vs in (
                ("include", p.include_types), ("exclude", p.exclude_types),
                ("include_suffix", p.include_suffixes), ("exclude_suffix", p.exclude_suffixes),
                ("term", p.terms),
            )
            for v in vs
        ]
    )
    + ") AS v(niche_id, kind, value)",
    "slug_verdicts": """
  SELECT l.id, p.niche_id, s.slug,
         CASE WHEN EXISTS (SELECT 1 FROM rules r WHERE r.niche_id = p.niche_id AND r.kind = 'include' AND r.value = s.slug) THEN 1
              WHEN EXISTS (SELECT 1 FROM rules r WHERE r.niche_id = p.niche_id AND r.kind = 'exclude' AND r.value = s.slug) THEN -1
              WHEN EXISTS (SELECT 1 FROM rules r WHERE r.niche_id = p.niche_id AND r.kind = 'exclude_suffix' AND ends_with(s.slug, r.value)) THEN -1
              WHEN EXISTS (SELECT 1 FROM rules r WHERE r.niche_id = p.niche_id AND r.kind = 'include_suffix' AND ends_with(s.slug, r.value)) THEN 1
              ELSE 0 END AS verdict
  FROM listings l CROSS JOIN profiles p, LATERAL (SELECT unnest(l.types) AS slug) s""",
    "assessed": """
  SELECT l.id, l.name, l.search_id, p.niche_id, p.position,
         v.type_ok, v.fatal,
         EXISTS (SELECT 1 FROM rules r WHERE r.niche_id = p.niche_id AND r.kind = 'term' AND contains(l.evidence, r.value)) AS name_ok,
         NOT v.fatal AND CASE WHEN NOT p.strict THEN v.type_ok
                              WHEN p.name_only THEN EXISTS (SELECT 1 FROM rules r WHERE r.niche_id = p.niche_id AND r.kind = 'term' AND contains(l.evidence, r.value))
                              ELSE v.type_ok AND EXISTS (SELECT 1 FROM rules r WHERE r.niche_id = p.niche_id AND r.kind = 'term' AND contains(l.evidence, r.value)) END AS qualifies
  FROM listings l CROSS JOIN profiles p
  JOIN (SELECT id, niche_id, bool_or(verdict = 1) AS type_ok, bool_or(verdict = -1) AS fatal
        FROM slug_verdicts GROUP BY id, niche_id) v ON v.id = l.id AND v.niche_id = p.niche_id""",
    "latest_score": """
  SELECT business_id, audience_index, scorer_version, total, scored_at, signals, evidence FROM (
    SELECT *, row_number() OVER (PARTITION BY business_id ORDER BY scored_at DESC, id DESC) AS rn FROM scores)
  WHERE rn = 1""",
    "latest_reviews": """
  SELECT business_id, CASE WHEN regexp_matches(txt, '^[0-9]+$') THEN CAST(txt AS INTEGER) END AS reviews FROM (
    SELECT business_id, json_extract_string(data, '$.reviews') AS txt,
           row_number() OVER (PARTITION BY business_id ORDER BY fetched_at DESC, id DESC) AS rn
    FROM observations WHERE source = 'google_maps' AND status = 'ok')
  WHERE rn = 1""",
    "cohort": """
  SELECT b.id AS business_id, b.name, b.niche_id, b.{city} AS city, b.search_area, ls.audience_index,
         ls.scorer_version, ls.total, ls.scored_at, lr.reviews,
         count(ls.audience_index) OVER (PARTITION BY b.niche_id, b.{city}) AS cohort_size
  FROM businesses b LEFT JOIN latest_score ls ON ls.business_id = b.id
  LEFT JOIN latest_reviews lr ON lr.business_id = b.id""",
    "ranked": """
  SELECT business_id, ntile(3) OVER (PARTITION BY niche_id, city ORDER BY audience_index, business_id) AS tile
  FROM cohort WHERE audience_index IS NOT NULL""",
    "lead_bands": """
  SELECT c.*, CASE WHEN c.cohort_size >= 30 THEN 'relative' ELSE 'absolute' END AS banding_method,
         CASE WHEN c.audience_index IS NULL THEN 'unknown'
              WHEN c.cohort_size >= 30 THEN CASE r.tile WHEN 1 THEN 'small' WHEN 2 THEN 'medium' ELSE 'large' END
              WHEN c.reviews IS NULL THEN 'unknown' WHEN c.reviews < 100 THEN 'small'
              WHEN c.reviews <= 500 THEN 'medium' ELSE 'large' END AS audience_band
  FROM cohort c LEFT JOIN ranked r ON r.business_id = c.business_id""",
    "passes": """
  SELECT user_id AS cell_id, CAST(ts AS DATE) AS day, CAST(CAST(ts AS DATE) AS TIMESTAMP) AS searched_at,
         count(*) FILTER (WHERE event_type = 'purchase') AS new_count, count(*) AS total_count
  FROM events GROUP BY user_id, CAST(ts AS DATE)""",
}


def sql(body: str, *names: str, city: str = "city") -> str:
    """`body` with the named common table expressions before it."""
    parts = [f"{name} AS ({CTES[name].replace('{city}', city)})" for name in names]
    return ("WITH " + ",\n".join(parts) + "\n" if parts else "") + body


COHORT = ("businesses", "observations", "scores", "latest_score", "latest_reviews", "cohort",
          "ranked", "lead_bands")
QUALIFY = ("listings", "profiles", "rules", "slug_verdicts", "assessed")


class Domain:
    """The given tables of one folder, by name and as domain tables."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark = prepare(spark)
        self.folder = folder

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def spread(self, name: str, *keys: str) -> DataFrame:
        return read_spread(self.spark, f"{self.folder}/{name}.parquet", *keys)

    @cached_property
    def businesses(self) -> DataFrame:
        c, n, r, p = (self.table(t) for t in ("customer", "nation", "region", "pages"))
        bal, key = F.col("c_acctbal"), F.col("c_custkey")
        text = key.cast("string")
        pages = p.agg((F.max("page_id") + 1).alias("n")).scalar()
        joined = (
            c.join(n, F.col("n_nationkey") == F.col("c_nationkey"))
            .join(r, F.col("r_regionkey") == F.col("n_regionkey"))
            .withColumn("_page", key % pages)
            .join(p.select("page_id", "url"), F.col("_page") == F.col("page_id"), "left")
        )
        return joined.select(
            key.alias("id"), key.alias("business_id"),
            F.concat(F.lit("P"), F.lpad(text, 9, "0")).alias("place_id"),
            F.col("c_name").alias("name"), F.lower("c_mktsegment").alias("niche_id"),
            F.concat(F.lit("Country "), F.col("r_regionkey").cast("string")).alias("country"),
            F.col("r_name").alias("state"), F.col("n_name").alias("city"),
            F.when(bal < 0, None).when(bal < 500, "  ")
            .when(bal < 5000, F.concat(F.lit("Area "), F.floor(bal / 1000).cast("string")))
            .otherwise(F.concat(F.lit("AREA "), F.floor(bal / 2000).cast("string")))
            .alias("search_area"),
            F.when(bal < 2000, "").otherwise(
                F.concat(F.lit("No. "), text, F.lit(", "), F.col("n_name"))
            ).alias("address"),
            F.when(bal >= 0, 10 + F.col("n_nationkey") + bal / 100000).alias("lat"),
            F.when(bal >= 100, 70 + F.col("r_regionkey") + bal / 50000).alias("lng"),
            F.when(bal >= 3000, F.concat(F.lit("080-"), F.lpad(text, 7, "0"))).alias("phone"),
            F.when(bal >= 8000, F.concat(F.lit("info"), text, F.lit("@example.com"))).alias("email"),
            F.when(bal >= 1500, F.col("url")).alias("website"),
            F.when(bal >= 9000, F.concat(F.lit("shop."), text)).alias("instagram_handle"),
            F.lit(None).cast("string").alias("facebook_url"),
            (F.lit("2024-01-01").cast("timestamp_ntz") + F.make_dt_interval(mins=key.cast("int"))).alias("first_seen_at"),
        )

    @cached_property
    def observations(self) -> DataFrame:
        e = self.table("events")
        users = e.agg((F.max("user_id") + 1).alias("n")).scalar()
        k = F.col("k")

        def text(value: Column) -> Column:
            return value.cast("string")

        data = F.concat(
            F.lit('{"type":"'), F.col("event_type"), F.lit('","reviews":'),
            F.when(k % 7 == 0, '"unavailable"').otherwise(text(k * 8)),
            F.lit(',"rating":'), text(k % 5), F.lit(',"followers":'), text(k * 300),
            F.lit(',"runs_ads":'), F.when(k % 2 == 0, "true").otherwise("false"),
            F.lit(',"handle":"shop_'), text(F.col("user_id")), F.lit('"}'),
        )
        kind = F.col("event_type")
        return e.withColumn("k", F.get_json_object("props", "$.k").cast("bigint")).select(
            F.col("event_id").alias("id"),
            (F.col("user_id") + users * (F.col("event_id") % 10)).alias("business_id"),
            F.when(kind == "view", "google_maps").when(kind == "click", "instagram_profile")
            .when(kind == "signup", "instagram_handle").when(kind == "purchase", "ad_library")
            .otherwise("tinyfish_web").alias("source"),
            F.when(k % 10 < 5, "ok").when(k % 10 < 8, "no_data").when(k % 10 == 8, "blocked")
            .otherwise("error").alias("status"),
            data.alias("data"),
            F.concat(F.lit("https://listing.example/"), text(F.col("event_id"))).alias("source_url"),
            F.col("ts").alias("fetched_at"), F.col("user_id").alias("run_id"),
            "event_type", "k", "value",
        )

    @cached_property
    def scores(self) -> DataFrame:
        whole = F.floor("o_totalprice")
        return self.table("orders").select(
            F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("business_id"),
            F.col("o_orderstatus").alias("scorer_version"), (whole % 101).alias("total"),
            (whole % 31).alias("demand"), (whole % 26).alias("website_gap"),
            (whole % 21).alias("reachability"),
            F.concat(F.lit('["'), F.col("o_orderpriority"), F.lit('"," public phone ",""]')).alias("signals"),
            F.concat(F.lit('{"ai_summary":" Summary '), F.col("o_orderkey").cast("string"), F.lit(' "}')).alias("evidence"),
            F.col("o_orderdate").alias("scored_at"),
            F.when(
                F.col("o_orderpriority") != "4-NOT SPECIFIED",
                F.round(F.log10(1 + F.col("o_totalprice")) / 6, 6),
            ).alias("audience_index"),
        )

    @cached_property
    def contacts(self) -> DataFrame:
        key, priority, status = F.col("o_orderkey").cast("string"), F.col("o_orderpriority"), F.col("o_orderstatus")
        return self.table("orders").select(
            F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("business_id"),
            F.concat(F.lit("Person "), key).alias("name"),
            F.when(status == "F", "owner").when(status == "O", "manager").otherwise("unknown").alias("role"),
            F.when(priority.isin("1-URGENT", "2-HIGH"), F.concat(F.lit("98"), key)).alias("phone"),
            F.when(priority == "3-MEDIUM", F.concat(F.lit("p"), key, F.lit("@example.com"))).alias("email"),
            F.lit("website").alias("source"),
            F.when(priority == "1-URGENT", 0.8).when(priority == "2-HIGH", 0.6).otherwise(0.4).alias("confidence"),
            F.col("o_orderdate").alias("found_at"),
        )

    @cached_property
    def outreach(self) -> DataFrame:
        status = F.col("o_orderstatus")
        return self.table("orders").select(
            F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("business_id"),
            F.when(status == "F", "website_pitch").when(status == "O", "automation_pitch")
            .otherwise("note").alias("kind"),
            F.concat(F.lit("Draft "), F.col("o_orderkey").cast("string")).alias("body"),
            F.col("o_orderdate").alias("created_at"),
        )

    @cached_property
    def opportunities(self) -> DataFrame:
        return (
            self.observations.groupBy("business_id", F.col("event_type").alias("opportunity_id"))
            .agg(F.max_by(F.col("k") / 100.0, "id").alias("confidence"))
        )

    @cached_property
    def verdicts(self) -> DataFrame:
        bal = F.col("c_acctbal")
        return self.table("customer").select(
            F.col("c_custkey").alias("business_id"),
            F.when(bal >= 7000, "high").when(bal >= 4000, "medium").when(bal >= 1000, "low")
            .when(bal >= 0, "skip").alias("my_verdict"),
            F.when(bal < 3000, "").when(bal < 6000, " see again ").alias("notes"),
            F.when(bal >= 6000, "2024-02-01").alias("contacted_on"),
            F.when(bal >= 6000, "call").alias("channel"),
            F.when(bal >= 8000, "replied").alias("outcome"),
        )

    @cached_property
    def listings(self) -> DataFrame:
        key, size, price = F.col("p_partkey").cast("string"), F.col("p_size"), F.col("p_retailprice")
        return self.table("part").select(
            F.col("p_partkey").alias("id"), F.col("p_name").alias("name"),
            F.col("p_type").alias("category"),
            F.array("p_type", "p_name", "p_brand").alias("raw_categories"),
            F.when(size <= 10, None).when(size <= 20, F.concat(F.lit("https://instagram.com/x"), key))
            .when(size <= 30, F.concat(F.lit("shop"), key, F.lit(".blogspot.com")))
            .otherwise(F.concat(F.lit("https://shop"), key, F.lit(".example.com"))).alias("website"),
            F.when(price >= 930, F.concat(F.lit("080"), key)).alias("phone"),
            F.when(price < 970, F.concat(F.lit("https://listing.example/"), key)).alias("source_url"),
            F.col("p_brand").alias("search_id"), "p_size", "p_retailprice",
        )

    @cached_property
    def passes(self) -> DataFrame:
        return (
            self.table("events")
            .groupBy(F.col("user_id").alias("cell_id"), F.col("ts").cast("date").alias("day"))
            .agg(
                F.count_if(F.col("event_type") == "purchase").alias("new_count"),
                F.count(F.lit(1)).alias("total_count"),
            )
            .withColumn("searched_at", F.col("day").cast("timestamp"))
        )
