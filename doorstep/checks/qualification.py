"""Slugs, category qualification, telemetry, verification state."""

from pyspark.sql import functions as F

from doorstep.checks import check
from doorstep.checks.domain import PROFILES, QUALIFY, Domain, sql
from doorstep.functions.text import slugs
from doorstep.operators import qualify
from doorstep.sources import registry


def assessed(d: Domain):
    return qualify.assess(d.listings, PROFILES)


@check("type_slugs", "P3", sql("SELECT id, array_to_string(types, ',') AS types FROM listings", "listings"))
def _(d: Domain):
    return d.listings.select(
        "id", F.array_join(slugs(F.col("category"), F.col("raw_categories")), ",").alias("types")
    )


@check(
    "page_word_slugs", "P3",
    """SELECT slug, count(*) AS n FROM (
         SELECT regexp_replace(regexp_replace(lower(strip_accents(w)), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g') AS slug
         FROM (SELECT unnest(string_split(text, ' ')) AS w FROM documents))
       WHERE slug <> '' GROUP BY slug""",
)
def _(d: Domain):
    """Slugs of all words, each distinct word made one once; a condition on `slug` itself would be moved below and make it again."""
    from doorstep.functions.text import slug

    return (
        d.table("documents").select(F.explode(F.split("text", " ")).alias("w"))
        .groupBy("w").agg(F.count(F.lit(1)).alias("m"))
        .select(slug(F.col("w")).alias("slug"), "m")
        .groupBy("slug").agg(F.sum("m").alias("n"), F.max(F.length("slug")).alias("chars"))
        .where(F.col("chars") > 0).drop("chars")
    )


@check("qualification", "J5 S6 F3",
       sql("SELECT id, niche_id, type_ok, fatal, name_ok, qualifies FROM assessed", *QUALIFY))
def _(d: Domain):
    return assessed(d).select("id", "niche_id", "type_ok", "fatal", "name_ok", "qualifies")


@check(
    "registry_rule_hits", "S6",
    sql("""SELECT r.niche_id, r.kind, r.value, count(DISTINCT l.id) AS listings
           FROM rules r JOIN (SELECT id, unnest(types) AS slug FROM listings) l
             ON (r.kind IN ('include', 'exclude') AND l.slug = r.value)
             OR (r.kind IN ('include_suffix', 'exclude_suffix') AND ends_with(l.slug, r.value))
           GROUP BY ALL""", "listings", "rules"),
)
def _(d: Domain):
    """Listings hit by each type rule: slugs and their tails meet the rules by equality."""
    rules = registry.rule_table(d.spark, PROFILES).where(F.col("kind") != "term")
    typed = d.listings.select(
        "id", F.explode(slugs(F.col("category"), F.col("raw_categories"))).alias("slug")
    )
    parts = F.split("slug", "_")
    tails = F.transform(
        F.sequence(F.lit(2), F.greatest(F.size(parts), F.lit(2))),
        lambda i: F.concat(F.lit("_"), F.array_join(F.slice(parts, i, F.size(parts)), "_")),
    )
    whole = typed.select("id", F.lit(False).alias("tail"), F.col("slug").alias("value"))
    ends = typed.select("id", F.lit(True).alias("tail"), F.explode(tails).alias("value"))
    reached = whole.unionByName(ends).join(
        F.broadcast(rules.withColumn("tail", F.col("kind").endswith("_suffix"))), ["tail", "value"]
    )
    return (
        reached.select("niche_id", "kind", "value", "id").distinct()
        .groupBy("niche_id", "kind", "value").agg(F.count(F.lit(1)).alias("listings"))
    )


_FALLBACK = """
tagged AS (SELECT id, CASE WHEN p_size > 40 THEN ['gear_dealer', 'no_such'] WHEN p_size > 35 THEN ['no_such'] ELSE [] END AS tags FROM listings),
ids AS (
  SELECT l.id, CASE WHEN p_size > 40 THEN ['gear_dealer'] ELSE coalesce(q.ids, []) END AS profile_ids
  FROM listings l LEFT JOIN (SELECT id, list(niche_id ORDER BY position) AS ids FROM assessed WHERE qualifies GROUP BY id) q ON q.id = l.id)"""


def with_profiles(d: Domain):
    size = F.col("p_size")
    tags = F.when(size > 40, F.array(F.lit("gear_dealer"), F.lit("no_such"))).when(
        size > 35, F.array(F.lit("no_such"))
    )
    return qualify.matched_profiles(d.listings.withColumn("matched_niches", tags), PROFILES)


@check("registry_fallback", "J6",
       sql("SELECT id, array_to_string(profile_ids, ',') AS profile_ids FROM ids", *QUALIFY).replace(
           "\nSELECT id, array_to_string", "," + _FALLBACK + "\nSELECT id, array_to_string"))
def _(d: Domain):
    return with_profiles(d).select("id", F.array_join("profile_ids", ",").alias("profile_ids"))


_TELEMETRY = """SELECT search_id, niche_id, count(*) AS returned,
    count(*) FILTER (WHERE qualifies) AS qualified, count(*) FILTER (WHERE NOT qualifies) AS rejected,
    count(*) FILTER (WHERE NOT qualifies AND type_ok AND NOT fatal) AS name_gate_rejected,
    count(*) >= 20 AS has_more, greatest(count(*) FILTER (WHERE qualifies) - 5, 0) AS truncated
  FROM assessed GROUP BY search_id, niche_id"""


@check("search_telemetry", "A2 F3", sql(_TELEMETRY, *QUALIFY))
def _(d: Domain):
    return qualify.telemetry(assessed(d), ["search_id"], limit=5)


_REJECTED = """SELECT a.search_id, a.niche_id, v.slug, count(*) AS times
  FROM assessed a JOIN slug_verdicts v ON v.id = a.id AND v.niche_id = a.niche_id
  WHERE NOT a.qualifies AND v.verdict <> 1 GROUP BY ALL"""


@check("rejected_types", "A2", sql(_REJECTED, *QUALIFY))
def _(d: Domain):
    return qualify.rejected_types(assessed(d), PROFILES, ["search_id"])


@check(
    "nameless_listings_left_out", "F3",
    sql("""SELECT niche_id, count(*) AS hits, count(*) FILTER (WHERE name <> 'small ring') AS named
           FROM assessed WHERE qualifies GROUP BY niche_id""", *QUALIFY),
)
def _(d: Domain):
    """The placeholder name leaves `qualified` and nothing else."""
    from doorstep.sources.payloads import UNNAMED

    staged = assessed(d).withColumn(
        "name", F.when(F.col("name") == "small ring", UNNAMED).otherwise(F.col("name"))
    )
    counts = qualify.telemetry(staged.withColumn("all", F.lit(1)), ["all"], limit=0)
    return counts.where(F.col("truncated") > 0).select(
        "niche_id", F.col("truncated").alias("hits"), F.col("qualified").alias("named")
    )


_STATUS = """
per_pass AS (
  SELECT CAST(user_id AS VARCHAR) AS niche_id, CAST(ts AS DATE) AS day,
         count(*) FILTER (WHERE event_type = 'purchase' AND value > 150) AS qualified,
         count(*) FILTER (WHERE NOT (event_type = 'purchase' AND value > 150)) AS rejected,
         count(*) FILTER (WHERE event_type = 'error') AS name_gate_rejected
  FROM events GROUP BY 1, 2),
slugs AS (SELECT CAST(user_id AS VARCHAR) AS niche_id, event_type AS slug, count(*) AS times
          FROM events WHERE event_type <> 'purchase' GROUP BY 1, 2),
totals AS (SELECT niche_id, sum(qualified)::BIGINT AS qualified, sum(rejected)::BIGINT AS rejected,
                  sum(name_gate_rejected)::BIGINT AS name_gate_rejected FROM per_pass GROUP BY 1),
status AS (SELECT *, CASE WHEN qualified > 0 THEN 'verified' WHEN rejected >= 20 THEN 'starved' ELSE 'unverified' END AS state FROM totals)"""


def niche_status(d: Domain):
    e = d.table("events").withColumn("niche_id", F.col("user_id").cast("string"))
    day = F.col("ts").cast("date")
    hit = (F.col("event_type") == "purchase") & (F.col("value") > 150)
    per_pass = e.groupBy("niche_id", day.alias("seen_at")).agg(
        F.count_if(hit).alias("qualified"), F.count_if(~hit).alias("rejected"),
        F.count_if(F.col("event_type") == "error").alias("name_gate_rejected"),
    )
    per_slug = e.where(F.col("event_type") != "purchase").groupBy(
        "niche_id", F.col("event_type").alias("slug")
    ).agg(F.count(F.lit(1)).alias("times"))
    return qualify.merged_status(per_pass, per_slug)


@check(
    "niche_status", "A4 U1",
    f"""WITH {_STATUS}
    SELECT s.niche_id, s.state, s.qualified, s.rejected, s.name_gate_rejected,
           coalesce(m.slugs, '') AS rejected_types
    FROM status s LEFT JOIN (SELECT niche_id, string_agg(slug || '=' || CAST(times AS VARCHAR), ',' ORDER BY slug) AS slugs FROM slugs GROUP BY 1) m USING (niche_id)""",
)
def _(d: Domain):
    pairs = F.transform(
        F.map_entries("rejected_types"),
        lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string")),
    )
    return niche_status(d).select(
        "niche_id", "state", "qualified", "rejected", "name_gate_rejected",
        F.array_join(F.array_sort(pairs), ",").alias("rejected_types"),
    )


_WORST = "row_number() OVER (PARTITION BY s.niche_id ORDER BY s.times DESC, s.slug) AS rank"


@check("worst_rejected_types", "T6",
       f"WITH {_STATUS} SELECT s.niche_id, t.state, {_WORST}, s.slug, s.times FROM slugs s JOIN status t USING (niche_id)")
def _(d: Domain):
    return qualify.worst_types(niche_status(d))


@check("starved_niches", "F7",
       f"WITH {_STATUS} SELECT s.niche_id, t.state, {_WORST}, s.slug, s.times FROM slugs s JOIN status t USING (niche_id) WHERE t.state = 'starved'")
def _(d: Domain):
    return qualify.starved(niche_status(d))


@check(
    "registry_with_state", "J13",
    sql("""SELECT p.position, p.niche_id, p.label, coalesce(s.state, 'unverified') AS state
           FROM profiles p LEFT JOIN (
             SELECT niche_id, CASE WHEN count(*) FILTER (WHERE qualifies) > 0 THEN 'verified'
                    WHEN count(*) >= 20 THEN 'starved' ELSE 'unverified' END AS state
             FROM assessed WHERE niche_id <> 'promo_house' GROUP BY niche_id) s USING (niche_id)""", *QUALIFY),
)
def _(d: Domain):
    counts = qualify.telemetry(
        assessed(d).where(F.col("niche_id") != "promo_house").withColumn("all", F.lit(1)), ["all"], 0
    )
    status = counts.select(
        "niche_id", qualify.state_of(F.col("qualified"), F.col("rejected")).alias("state")
    )
    return qualify.with_state(registry.profile_table(d.spark, PROFILES), status).select(
        "position", "niche_id", "label", "state"
    )


_ALIASES = """
requested AS (SELECT o_orderkey AS request_id, 1 AS position, o_orderpriority AS value FROM orders
              UNION ALL SELECT o_orderkey, 2, lower(o_orderpriority) || '!' FROM orders
              UNION ALL SELECT o_orderkey, 3, CASE o_orderstatus WHEN 'F' THEN 'urgent' ELSE 'n/a' END FROM orders),
aliases AS (SELECT * FROM (VALUES ('1urgent', 'top'), ('urgent', 'top'), ('2high', 'top'), ('3medium', 'mid'), ('5low', 'low')) v(k, niche_id)),
joined AS (SELECT r.*, a.niche_id FROM requested r LEFT JOIN aliases a ON a.k = regexp_replace(lower(r.value), '[^a-z0-9]+', '', 'g'))"""


def _requested(d: Domain):
    o = d.table("orders")
    rows = F.array(
        F.struct(F.lit(1).alias("position"), F.col("o_orderpriority").alias("value")),
        F.struct(F.lit(2).alias("position"), F.concat(F.lower("o_orderpriority"), F.lit("!")).alias("value")),
        F.struct(
            F.lit(3).alias("position"),
            F.when(F.col("o_orderstatus") == "F", "urgent").otherwise("n/a").alias("value"),
        ),
    )
    aliases = d.spark.createDataFrame(
        [("top", "1-Urgent"), ("top", "URGENT"), ("top", "2 high"), ("mid", "3-medium"), ("low", "5_low")],
        "niche_id string, spelling string",
    )
    return qualify.resolve_aliases(o.select(F.col("o_orderkey").alias("request_id"), F.inline(rows)), aliases)


@check("resolved_aliases", "J16",
       f"WITH {_ALIASES} SELECT request_id, niche_id, min(position) AS position FROM joined WHERE niche_id IS NOT NULL GROUP BY ALL")
def _(d: Domain):
    return _requested(d)[0]


@check("unsupported_aliases", "J16",
       f"WITH {_ALIASES} SELECT request_id, position, value FROM joined WHERE niche_id IS NULL")
def _(d: Domain):
    return _requested(d)[1].select("request_id", "position", "value")
