"""Sheet records, cells, order, listing reads and the reconcile."""

from pyspark.sql import functions as F

from doorstep.checks import check
from doorstep.checks.bands import band_table
from doorstep.checks.domain import COHORT, Domain, sql
from doorstep.operators import sheet
from doorstep.session import fresh_path
from doorstep.sources import current

_LATEST = """
obs AS (SELECT *, row_number() OVER (PARTITION BY business_id, source ORDER BY fetched_at DESC, id DESC) AS rn FROM observations WHERE status = 'ok'),
g AS (SELECT * FROM obs WHERE source = 'google_maps' AND rn = 1), ih AS (SELECT * FROM obs WHERE source = 'instagram_handle' AND rn = 1),
ip AS (SELECT * FROM obs WHERE source = 'instagram_profile' AND rn = 1), ad AS (SELECT * FROM obs WHERE source = 'ad_library' AND rn = 1),
ct AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY business_id ORDER BY confidence DESC, found_at DESC, id DESC) AS rn FROM contacts) WHERE rn = 1),
ol AS (SELECT business_id, string_agg(opportunity_id, '; ' ORDER BY confidence DESC, opportunity_id) AS ids FROM opportunities GROUP BY 1),
dr AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY business_id, kind ORDER BY created_at DESC, id DESC) AS rn FROM outreach) WHERE rn = 1),
records AS (
  SELECT b.id AS business_id, b.place_id, b.name AS business_name, b.niche_id AS niche, json_extract_string(g.data, '$.type') AS business_type,
    b.country, b.state, b.city, b.search_area, b.address, b.lat, b.lng, b.phone, b.email, b.website,
    coalesce(b.instagram_handle, json_extract_string(ih.data, '$.handle')) AS instagram_handle, b.facebook_url,
    ct.name AS contact_name, ct.role AS contact_role, ct.phone AS contact_phone, ct.email AS contact_email, ct.source AS contact_source,
    CAST(lb.reviews AS BIGINT) AS reviews, CAST(json_extract_string(g.data, '$.rating') AS DOUBLE) AS rating,
    CAST(json_extract_string(ip.data, '$.followers') AS BIGINT) AS followers, CAST(NULL AS DOUBLE) AS engagement_rate,
    CASE json_extract_string(ad.data, '$.runs_ads') WHEN 'true' THEN 'yes' WHEN 'false' THEN 'no' END AS runs_ads, CAST(NULL AS VARCHAR) AS peak_hours,
    lb.total AS total_score, lb.audience_band, lb.banding_method,
    json_extract_string(ls.signals, '$[0]') || '; public phone' AS signals, trim(json_extract_string(ls.evidence, '$.ai_summary')) AS ai_summary,
    wp.body AS website_pitch, ol.ids AS automation_opportunities, ap.body AS automation_pitch,
    v.my_verdict, nullif(trim(v.notes), '') AS notes, v.contacted_on, v.channel, v.outcome,
    g.source_url AS listing_url, coalesce(ip.source_url, ih.source_url) AS profile_url
  FROM businesses b LEFT JOIN lead_bands lb ON lb.business_id = b.id LEFT JOIN verdicts v ON v.business_id = b.id
  LEFT JOIN ct ON ct.business_id = b.id LEFT JOIN g ON g.business_id = b.id LEFT JOIN ih ON ih.business_id = b.id
  LEFT JOIN ip ON ip.business_id = b.id LEFT JOIN ad ON ad.business_id = b.id LEFT JOIN latest_score ls ON ls.business_id = b.id
  LEFT JOIN ol ON ol.business_id = b.id LEFT JOIN dr wp ON wp.business_id = b.id AND wp.kind = 'website_pitch'
  LEFT JOIN dr ap ON ap.business_id = b.id AND ap.kind = 'automation_pitch'),
cells AS (
  SELECT * REPLACE (nullif(trim(search_area), '') AS search_area, nullif(trim(address), '') AS address) FROM records)"""
_NAMES = (*COHORT, "contacts", "opportunities", "outreach", "verdicts")


def _sheet_sql(select: str) -> str:
    return sql("\n@@" + select, *_NAMES, city="state").replace("\n\n@@", "," + _LATEST + "\n")


def records(d: Domain):
    return sheet.lead_records(
        d.businesses, band_table(d, "state"), d.verdicts, d.contacts, d.observations, d.scores,
        d.opportunities, d.outreach,
    )


@check("lead_sheet", "J2 P14 S10 A8 T7 P15", _sheet_sql("SELECT * FROM cells"))
def _(d: Domain):
    return sheet.sheet_cells(records(d))


@check(
    "sheet_order", "T2",
    _sheet_sql("""SELECT business_id, row_number() OVER (ORDER BY coalesce(search_area, '') = '', lower(coalesce(search_area, '')), total_score IS NULL,
                    -coalesce(total_score, 0), lower(coalesce(business_name, '')), business_id) AS sheet_row FROM cells"""),
)
def _(d: Domain):
    return sheet.ordered_sheet(sheet.sheet_cells(records(d))).select("business_id", "sheet_row")


@check(
    "evidence_sources", "P16",
    _sheet_sql("""SELECT business_id, concat_ws(',', CASE WHEN p IS NOT NULL THEN 'engagement_rate=' || p END, CASE WHEN p IS NOT NULL THEN 'followers=' || p END,
                    CASE WHEN listing_url IS NOT NULL THEN 'peak_hours=' || listing_url END, CASE WHEN listing_url IS NOT NULL THEN 'rating=' || listing_url END,
                    CASE WHEN listing_url IS NOT NULL THEN 'reviews=' || listing_url END) AS sources
                  FROM (SELECT *, coalesce(profile_url, 'https://www.instagram.com/' || instagram_handle || '/') AS p FROM records)"""),
)
def _(d: Domain):
    rows = sheet.evidence_sources(records(d))
    pairs = F.transform(F.map_entries("sources"), lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    return rows.select("business_id", F.array_join(F.array_sort(pairs), ",").alias("sources"))


@check(
    "reach_channels", "P12",
    _sheet_sql("""SELECT business_id, CASE WHEN contact_phone <> '' THEN 'mobile' WHEN instagram_handle <> '' THEN 'instagram' WHEN phone <> '' THEN 'phone'
                     WHEN contact_email <> '' OR email <> '' THEN 'email' ELSE 'none' END AS channel,
                   coalesce(contact_phone, instagram_handle, phone, contact_email, email) AS value,
                   CASE WHEN contact_phone <> '' THEN 'published for a named contact (for ' || contact_name || ') -- likely personal'
                        WHEN instagram_handle <> '' THEN 'DM the business''s own account'
                        WHEN phone <> '' THEN 'the business''s listed number -- mobile or landline is not knowable from this alone'
                        WHEN contact_email <> '' THEN 'a named contact''s own address' WHEN email <> '' THEN 'a general inbox, not a named person' END AS note
                  FROM records"""),
)
def _(d: Domain):
    c = F.col
    channel = sheet.reach_channel(
        c("contact_phone"), c("contact_name"), c("instagram_handle"), c("phone"), c("contact_email"), c("email")
    )
    return records(d).select("business_id", channel.alias("r")).select("business_id", "r.channel", "r.value", "r.note")


@check("best_contacts", "T7",
       sql("SELECT business_id, name AS contact_name, role AS contact_role, phone AS contact_phone, email AS contact_email, source AS contact_source FROM ("
           "SELECT *, row_number() OVER (PARTITION BY business_id ORDER BY confidence DESC, found_at DESC, id DESC) AS rn FROM contacts) WHERE rn = 1", "contacts"))
def _(d: Domain):
    return sheet.best_contacts(d.contacts)


@check("offer_lists", "A8",
       sql("SELECT business_id, string_agg(opportunity_id, ',' ORDER BY confidence DESC, opportunity_id) AS opportunity_ids FROM opportunities GROUP BY 1",
           "observations", "opportunities"))
def _(d: Domain):
    return sheet.offer_lists(d.opportunities).select(
        "business_id", F.array_join("opportunity_ids", ",").alias("opportunity_ids")
    )


_LEADS = """SELECT b.id AS business_id, b.niche_id, b.city, lb.total AS score_total, lb.audience_band, v.my_verdict, b.first_seen_at
  FROM businesses b LEFT JOIN lead_bands lb ON lb.business_id = b.id LEFT JOIN verdicts v ON v.business_id = b.id"""


def _leads(d: Domain):
    bands = band_table(d, "state").select("business_id", F.col("total").alias("score_total"), "audience_band")
    return (
        d.businesses.join(bands, "business_id", "left")
        .join(d.verdicts.select("business_id", "my_verdict"), "business_id", "left")
        .select("business_id", "niche_id", "city", "score_total", "audience_band", "my_verdict", "first_seen_at")
    )


@check("top_leads", "T4",
       sql(f"SELECT * FROM ({_LEADS}) ORDER BY score_total DESC NULLS LAST, first_seen_at, business_id LIMIT 500", *COHORT, "verdicts", city="state"))
def _(d: Domain):
    return sheet.top_leads(_leads(d), 500)


@check("leads_in_city_and_niches", "F1",
       sql(f"SELECT * FROM ({_LEADS}) WHERE lower(city) = lower('nation_7') AND niche_id IN ('building', 'machinery')", *COHORT, "verdicts", city="state"))
def _(d: Domain):
    return sheet.in_scope(_leads(d), city="nation_7", niche_ids=["building", "machinery"])


@check("leads_of_run", "F1 J3",
       sql(f"SELECT * FROM ({_LEADS}) WHERE business_id IN (SELECT business_id FROM observations WHERE run_id = 7)", *COHORT, "verdicts", city="state"))
def _(d: Domain):
    return sheet.in_scope(_leads(d), observations=d.observations, run_id=7)


@check("businesses_seen_by_any_run", "J3",
       sql("SELECT id, name FROM businesses WHERE id IN (SELECT business_id FROM observations)", "businesses", "observations"))
def _(d: Domain):
    return d.businesses.join(d.observations.select("business_id"), "business_id", "left_semi").select("id", "name")


@check("leads_with_and_without_scores", "J1",
       sql("""SELECT b.id AS business_id, count(s.id) AS scores, count(o.business_id) > 0 AS observed FROM businesses b
              LEFT JOIN scores s ON s.business_id = b.id LEFT JOIN (SELECT DISTINCT business_id FROM observations WHERE status = 'ok') o ON o.business_id = b.id GROUP BY 1""",
           "businesses", "scores", "observations"))
def _(d: Domain):
    counted = d.scores.groupBy("business_id").agg(F.count(F.lit(1)).alias("scores"))
    seen = d.observations.where(F.col("status") == "ok").select("business_id").distinct().withColumn("observed", F.lit(True))
    return (
        d.businesses.select("business_id").join(counted, "business_id", "left").join(seen, "business_id", "left")
        .select("business_id", F.coalesce("scores", F.lit(0)).alias("scores"), F.coalesce("observed", F.lit(False)).alias("observed"))
    )


@check("top_runs", "T5",
       "SELECT o_orderkey AS id, o_orderstatus AS status, started_at FROM (SELECT *, CASE WHEN o_orderpriority <> '5-LOW' THEN o_orderdate END AS started_at FROM orders) ORDER BY started_at DESC NULLS LAST, o_orderkey DESC LIMIT 200")
def _(d: Domain):
    runs = d.table("orders").select(
        F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("status"),
        F.when(F.col("o_orderpriority") != "5-LOW", F.col("o_orderdate")).alias("started_at"),
    )
    return sheet.top_runs(runs, 1000)


_TYPED = """
typed AS (
  SELECT CASE WHEN l_quantity > 48 THEN '  ' ELSE ' P' || CAST(l_suppkey AS VARCHAR) || ' ' END AS place_id,
         l_orderkey * 10 + l_linenumber AS row_number, l_returnflag AS my_verdict, l_linestatus AS notes FROM lineitem)"""


@check("sheet_read_back", "S9",
       f"""WITH {_TYPED} SELECT place_id, row_number, my_verdict, notes FROM (
            SELECT trim(place_id) AS place_id, row_number, my_verdict, notes, row_number() OVER (PARTITION BY trim(place_id) ORDER BY row_number DESC) AS rn
            FROM typed WHERE trim(place_id) <> '') WHERE rn = 1""")
def _(d: Domain):
    rows = d.table("lineitem").select(
        F.when(F.col("l_quantity") > 48, "  ").otherwise(
            F.concat(F.lit(" P"), F.col("l_suppkey").cast("string"), F.lit(" "))
        ).alias("place_id"),
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("row_number"),
        F.col("l_returnflag").alias("my_verdict"), F.col("l_linestatus").alias("notes"),
    )
    return sheet.sheet_rows_by_place(rows)


_MASTER = """
master AS (SELECT place_id, name AS business_name, phone, city, v.my_verdict, v.notes FROM businesses b JOIN verdicts v ON v.business_id = b.id WHERE v.my_verdict IS NOT NULL),
batch AS (SELECT place_id, name || '!' AS business_name, CASE WHEN email IS NULL THEN phone END AS phone, state AS city, 'batch' AS my_verdict, niche_id AS notes FROM businesses WHERE website IS NOT NULL AND lat IS NOT NULL)"""


def _master_and_batch(d: Domain):
    keep = ["place_id", F.col("name").alias("business_name"), "phone", "city", "my_verdict", "notes"]
    master = d.businesses.join(d.verdicts, "business_id").where(F.col("my_verdict").isNotNull()).select(*keep)
    batch = d.businesses.where(F.col("website").isNotNull() & F.col("lat").isNotNull()).select(
        "place_id", F.concat("name", F.lit("!")).alias("business_name"),
        F.when(F.col("email").isNull(), F.col("phone")).alias("phone"), F.col("state").alias("city"),
        F.lit("batch").alias("my_verdict"), F.col("niche_id").alias("notes"),
    )
    # Businesses without a master row are appended, so half of the batch is given new places.
    shifted = batch.withColumn(
        "place_id", F.when(F.col("phone").isNull(), F.concat("place_id", F.lit("n"))).otherwise(F.col("place_id"))
    )
    return master, shifted


_AGENT, _OPERATOR = ["business_name", "phone", "city"], ["my_verdict", "notes"]


def _reconciled(d: Domain):
    return sheet.reconcile(*_master_and_batch(d), _AGENT, _OPERATOR)


_RECONCILED = f"""{_MASTER},
shifted AS (SELECT * REPLACE (CASE WHEN phone IS NULL THEN place_id || 'n' ELSE place_id END AS place_id) FROM batch),
done AS (SELECT coalesce(n.place_id, m.place_id) AS place_id,
  CASE WHEN n.place_id IS NULL THEN m.business_name ELSE n.business_name END AS business_name, CASE WHEN n.place_id IS NULL THEN m.phone ELSE n.phone END AS phone,
  CASE WHEN n.place_id IS NULL THEN m.city ELSE n.city END AS city, CASE WHEN m.place_id IS NULL THEN n.my_verdict ELSE m.my_verdict END AS my_verdict,
  CASE WHEN m.place_id IS NULL THEN n.notes ELSE m.notes END AS notes,
  CASE WHEN m.place_id IS NOT NULL AND n.place_id IS NOT NULL THEN 'updated' WHEN n.place_id IS NOT NULL THEN 'appended' ELSE 'untouched' END AS action
  FROM master m FULL JOIN shifted n ON n.place_id = m.place_id)"""


@check("reconciled_master", "J11", sql("\n@@SELECT * FROM done", "businesses", "verdicts").replace("\n\n@@", "," + _RECONCILED + "\n"))
def _(d: Domain):
    return _reconciled(d)


@check("reconciled_master_by_bucket", "J11",
       sql("\n@@SELECT * EXCLUDE (action) FROM done", "businesses", "verdicts").replace("\n\n@@", "," + _RECONCILED + "\n"))
def _(d: Domain):
    """The master as hashed buckets; the batch is merged into those it has places of."""
    master, batch = _master_and_batch(d)
    path = fresh_path(d.spark, "master")
    current.begin(master.select("place_id", *_AGENT, *_OPERATOR), path, ["place_id"], 64)
    current.merge(d.spark, path, 1, batch, lambda held, new: sheet.reconcile(held, new, _AGENT, _OPERATOR))
    return current.rows(d.spark, path)


@check("reconcile_counts", "J11", sql("\n@@SELECT action, count(*) AS n FROM done GROUP BY 1", "businesses", "verdicts").replace("\n\n@@", "," + _RECONCILED + "\n"))
def _(d: Domain):
    return _reconciled(d).groupBy("action").agg(F.count(F.lit(1)).alias("n"))


@check("verdicts_from_sheet", "J12",
       sql("""SELECT b.id AS business_id, v.my_verdict, nullif(v.notes, '') AS notes, v.contacted_on, v.channel, v.outcome FROM businesses b JOIN verdicts v ON v.business_id = b.id
              WHERE coalesce(v.my_verdict, '') <> '' OR coalesce(v.notes, '') <> '' OR coalesce(v.outcome, '') <> ''""", "businesses", "verdicts"))
def _(d: Domain):
    rows = d.businesses.select("business_id", "place_id").join(d.verdicts, "business_id").drop("business_id")
    return sheet.verdicts_from_sheet(rows, d.businesses)
