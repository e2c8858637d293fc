"""Listing score, audience index, pitch and offers."""

from pyspark.sql import functions as F

from doorstep.checks import check
from doorstep.checks.domain import OFFERS, PROFILES, QUALIFY, Domain, sql
from doorstep.checks.qualification import _FALLBACK, with_profiles
from doorstep.functions import scoring as fs
from doorstep.operators import offers, qualify, sheet

_SCORED = """
facts AS (
  SELECT l.*, i.profile_ids, len(i.profile_ids) AS np,
         (SELECT max(p.demand) FROM profiles p WHERE list_contains(i.profile_ids, p.niche_id)) AS db,
         (SELECT max(p.budget) FROM profiles p WHERE list_contains(i.profile_ids, p.niche_id)) AS bb,
         (SELECT string_agg(lower(p.label) || ' match', ';' ORDER BY p.position) FROM profiles p WHERE list_contains(i.profile_ids, p.niche_id)) AS match_signals,
         CASE WHEN l.website IS NULL THEN 'no website' WHEN contains(l.website, 'instagram.com') THEN 'social-only'
              WHEN contains(l.website, 'blogspot') THEN 'weak/free website' ELSE 'has website' END AS site
  FROM listings l JOIN ids i ON i.id = l.id),
scored AS (
  SELECT *, least(30, CASE WHEN np > 0 THEN db + 4 + CASE WHEN np > 1 THEN 2 ELSE 0 END ELSE 12 END + 2) AS demand,
    CASE site WHEN 'no website' THEN 25 WHEN 'social-only' THEN 23 WHEN 'weak/free website' THEN 18 ELSE 8 END AS website_gap,
    least(25, CASE WHEN np > 0 THEN bb ELSE 10 END + 2 + CASE WHEN site = 'social-only' THEN 2 ELSE 0 END
      + CASE WHEN phone IS NOT NULL THEN 2 ELSE 0 END + CASE WHEN source_url IS NOT NULL THEN 1 ELSE 0 END) AS budget,
    least(20, 6 + CASE WHEN phone IS NOT NULL THEN 10 ELSE 0 END + CASE WHEN website IS NOT NULL THEN 4 ELSE 0 END) AS reachability,
    concat_ws(';', match_signals, CASE WHEN np > 1 THEN 'multiple service fit' END, 'detailed business listing', site,
      CASE WHEN phone IS NOT NULL THEN 'public phone' END, CASE WHEN website IS NOT NULL THEN 'public web link' END) AS signals
  FROM facts)"""


def scored_sql(select: str) -> str:
    return sql("\n@@" + select, *QUALIFY).replace("\n\n@@", "," + _FALLBACK + "," + _SCORED + "\n")


def scored(d: Domain):
    return qualify.scored(with_profiles(d), PROFILES)


@check("listing_scores", "P4",
       scored_sql("""SELECT id, demand::INT AS demand, website_gap::INT AS website_gap, budget::INT AS budget,
           reachability::INT AS reachability, (demand + website_gap + budget + reachability)::INT AS total, signals FROM scored"""))
def _(d: Domain):
    return scored(d).select(
        "id", "score.demand", "score.website_gap", "score.budget", "score.reachability",
        "score.total", F.array_join("score.signals", ";").alias("signals"),
    )


@check("lead_rank", "T1",
       scored_sql("""SELECT search_id, id, row_number() OVER (PARTITION BY search_id ORDER BY
           demand + website_gap + budget + reachability DESC, reachability DESC, website_gap DESC, demand DESC, id) AS lead_rank
         FROM scored"""))
def _(d: Domain):
    rows = scored(d).select("search_id", "id", "score.*").drop("signals")
    return sheet.ranked_leads(rows, ["search_id"], "id").select("search_id", "id", "lead_rank")


_ANGLE = """CASE WHEN what_site IN ('no website', 'social-only') THEN 'Pitch ' || offer || ' through a focused mobile-first website.'
   WHEN what_site = 'weak/free website' THEN 'Pitch replacing the weak website with ' || offer || '.'
   ELSE 'Pitch a conversion upgrade focused on ' || offer || '.' END"""


def _pitched(d: Domain):
    rows = scored(d)
    table = {p.id: p for p in PROFILES}
    first = F.try_element_at("profile_ids", F.lit(1))

    def of(attr: str):
        pairs = [F.lit(x) for p in table.values() for x in (p.id, getattr(p, attr))]
        return F.try_element_at(F.create_map(*pairs), F.coalesce(first, F.lit("")))

    angle = fs.pitch_angle(F.col("score.signals"), first, of("offer"))
    offer = F.coalesce(of("offer"), angle)
    label = F.coalesce(of("label"), F.col("category"))
    return rows.select(
        "id", angle.alias("pitch_angle"),
        fs.qualification_summary(F.col("name"), label, F.col("search_id"), F.col("score.signals"), offer).alias("summary"),
        fs.outreach_message(
            F.col("name"), F.coalesce(F.lower(of("label")), F.col("category")), F.col("search_id"), offer, "Ana"
        ).alias("message"),
    )


@check(
    "pitches", "P13",
    scored_sql(f"""SELECT id, angle AS pitch_angle,
        name || ' is a ' || coalesce(label, category) || ' lead in ' || search_id || '. Observed signals are '
          || replace(signals, ';', ', ') || '. The recommended offer is ' || coalesce(first_offer, angle) || '.' AS summary,
        'Hi ' || name || ',' || chr(10) || chr(10) || 'I came across your ' || coalesce(lower(label), category) || ' listing in ' || search_id
          || '. I help local businesses set up practical online systems for ' || coalesce(first_offer, angle)
          || ', so customer enquiries are easier to convert and manage.' || chr(10) || chr(10)
          || 'Would you like me to send a short three-point audit based only on your current public listing?'
          || chr(10) || chr(10) || 'Best,' || chr(10) || 'Ana' AS message
      FROM (SELECT *, {_ANGLE} AS angle FROM (
        SELECT s.*, s.site AS what_site, p.label, p.offer AS first_offer,
               coalesce(p.offer, 'clear services, lead capture, and automated follow-up') AS offer
        FROM (SELECT * EXCLUDE (offer_) FROM (SELECT *, NULL AS offer_ FROM scored)) s
        LEFT JOIN profiles p ON p.niche_id = s.profile_ids[1]))"""),
)
def _(d: Domain):
    return _pitched(d)


def _index_sql(parts: dict[str, tuple[str, str]]) -> str:
    weights = {"reviews": 0.40, "followers": 0.30, "engagement_rate": 0.20, "popular_times_density": 0.10}
    earned = " + ".join(
        f"CASE WHEN {m} IS NOT NULL THEN {weights[n]}::DOUBLE * least(1.0, greatest(0.0, {v})) ELSE 0 END"
        for n, (m, v) in parts.items()
    )
    weight = " + ".join(f"CASE WHEN {m} IS NOT NULL THEN {weights[n]}::DOUBLE ELSE 0 END" for n, (m, _) in parts.items())
    return f"round(CASE WHEN {weight} > 0 THEN ({earned}) / ({weight}) END, 6)"


@check(
    "audience_index", "P5",
    f"""SELECT event_id, {_index_sql({
        'reviews': ('reviews', 'log10(1 + greatest(reviews, 0)) / 4.0'),
        'followers': ('followers', 'log10(1 + greatest(followers, 0)) / 5.0'),
        'engagement_rate': ('rate', 'rate / 0.10::DOUBLE'),
        'popular_times_density': ('density', 'density / 100.0'),
    })} AS audience_index
    FROM (SELECT event_id,
            CASE WHEN event_type IN ('view', 'click') THEN k * 90 END AS reviews,
            CASE WHEN event_type IN ('click', 'signup') THEN k * 2000 END AS followers,
            CASE WHEN event_type = 'signup' THEN value / 5000 END AS rate,
            CASE WHEN event_type = 'purchase' THEN value / 3 END AS density
          FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events))""",
)
def _(d: Domain):
    k, kind = F.get_json_object("props", "$.k").cast("bigint"), F.col("event_type")
    index = fs.audience_index(
        reviews=F.when(kind.isin("view", "click"), k * 90),
        followers=F.when(kind.isin("click", "signup"), k * 2000),
        engagement_rate=F.when(kind == "signup", F.col("value") / 5000),
        popular_times_density=F.when(kind == "purchase", F.col("value") / 3),
    )
    return d.table("events").select("event_id", F.round(index, 6).alias("audience_index"))


@check(
    "audience_index_of_orders", "P5",
    f"SELECT o_orderkey, {_index_sql({'reviews': ('o_totalprice', 'log10(1 + greatest(o_totalprice, 0)) / 4.0')})} AS audience_index FROM orders",
)
def _(d: Domain):
    return d.table("orders").select(
        "o_orderkey", F.round(fs.audience_index(reviews=F.col("o_totalprice")), 6).alias("audience_index")
    )


@check(
    "threshold_bands", "X7",
    """SELECT event_id, CASE WHEN base IS NULL THEN 'unknown' WHEN lvl <= 0 THEN 'small' WHEN lvl = 1 THEN 'medium' ELSE 'large' END AS band
       FROM (SELECT *, base + CASE WHEN rate >= 0.06 THEN 1 WHEN rate < 0.01 THEN -1 ELSE 0 END + CASE WHEN dense THEN 1 ELSE 0 END AS lvl
         FROM (SELECT event_id, value / 5000 AS rate, k > 80 AS dense,
                 CASE WHEN r IS NULL AND f IS NULL THEN NULL WHEN coalesce(r, 0) > 500 OR coalesce(f, 0) > 15000 THEN 2
                      WHEN coalesce(r, 0) >= 100 OR coalesce(f, 0) >= 2000 THEN 1 ELSE 0 END AS base
           FROM (SELECT *, CASE WHEN event_type IN ('view', 'click') THEN k * 8 END AS r,
                        CASE WHEN event_type IN ('click', 'signup') THEN k * 300 END AS f
                 FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events))))""",
)
def _(d: Domain):
    k, kind = F.get_json_object("props", "$.k").cast("bigint"), F.col("event_type")
    band = fs.threshold_band(
        F.when(kind.isin("view", "click"), k * 8), F.when(kind.isin("click", "signup"), k * 300),
        F.col("value") / 5000, k > 80, promote_at=0.06, demote_at=0.01,
    )
    return d.table("events").select("event_id", band.alias("band"))


_OFFER_CTES = "offers AS (SELECT * FROM (VALUES " + ", ".join(
    f"('{o.id}', '{s}', {len(o.signals)}, {i}, [{', '.join(repr(n) for n in o.niches)}]::VARCHAR[])"
    for i, o in enumerate(OFFERS) for s in o.signals
) + """) v(offer_id, signal, needed, position, niches)),
held AS (SELECT DISTINCT business_id, event_type AS signal FROM observations),
fired AS (
  SELECT h.business_id, b.niche_id, o.offer_id FROM held h JOIN offers o ON o.signal = h.signal
  JOIN businesses b ON b.id = h.business_id
  WHERE len(o.niches) = 0 OR list_contains(o.niches, b.niche_id)
  GROUP BY h.business_id, b.niche_id, o.offer_id, o.needed HAVING count(DISTINCT h.signal) = o.needed)"""


def _offer_sql(select: str) -> str:
    return sql("\n@@" + select, "businesses", "observations").replace("\n\n@@", ",\n" + _OFFER_CTES + "\n")


def _observed(d: Domain):
    return d.observations.select(
        "business_id", F.col("event_type").alias("signal"), F.col("id").alias("observation_id")
    )


def _fired(d: Domain):
    return offers.firing_from_rows(_observed(d), d.businesses.select("business_id", "niche_id"), OFFERS)


@check("offers_that_fire", "J7 S7", _offer_sql("SELECT business_id, niche_id, offer_id FROM fired"))
def _(d: Domain):
    return _fired(d)


@check("offers_from_signal_arrays", "J7", _offer_sql("SELECT business_id, offer_id FROM fired"))
def _(d: Domain):
    """The same division when each business carries its signals as an array."""
    held = d.observations.groupBy("business_id").agg(F.collect_set("event_type").alias("signals"))
    staged = d.businesses.select("business_id", "niche_id").join(held, "business_id")
    return offers.firing(staged, offers=OFFERS).select("business_id", "offer_id")


@check(
    "offer_evidence", "A9",
    _offer_sql("""SELECT f.business_id, f.offer_id, o.signal, b.id AS observation_id
      FROM fired f JOIN offers o ON o.offer_id = f.offer_id
      JOIN observations b ON b.business_id = f.business_id AND b.event_type = o.signal"""),
)
def _(d: Domain):
    return offers.evidence_rows(_fired(d), _observed(d), OFFERS)


@check(
    "offers_for_niche", "S7 J7",
    sql("""SELECT id, concat_ws(',', 'watchful', CASE WHEN niche_id IN ('building', 'machinery') THEN 'buyer_care' END,
             CASE WHEN niche_id IN ('household', 'furniture', 'building') THEN 'full_funnel' END,
             CASE WHEN niche_id = 'automobile' THEN 'greeting' END) AS offers FROM businesses""", "businesses"),
)
def _(d: Domain):
    return d.businesses.select(
        "id", F.array_join(offers.offers_for(F.col("niche_id"), OFFERS), ",").alias("offers")
    )


@check(
    "missing_signals", "U3",
    _offer_sql("""SELECT b.business_id, concat_ws(',',
        CASE WHEN NOT list_contains(b.s, 'signup') THEN 'signup' END, CASE WHEN NOT list_contains(b.s, 'click') THEN 'click' END,
        CASE WHEN NOT list_contains(b.s, 'purchase') THEN 'purchase' END) AS missing
      FROM (SELECT business_id, list(signal) AS s FROM held GROUP BY 1) b"""),
)
def _(d: Domain):
    held = d.observations.groupBy("business_id").agg(F.collect_set("event_type").alias("s"))
    return held.select(
        "business_id", F.array_join(offers.missing_signals(OFFERS[2], F.col("s")), ",").alias("missing")
    )


@check(
    "known_signal_union", "U4",
    _offer_sql("""SELECT b.business_id, array_to_string(list_sort(list_filter(list_distinct(list_concat(
        list_concat([niche_id, 'view'], s), ['click'])), lambda x: x IN ('view', 'click', 'purchase', 'building'))), ',') AS signals
      FROM (SELECT business_id, list(signal) AS s FROM held GROUP BY 1) h JOIN businesses b ON b.id = h.business_id"""),
)
def _(d: Domain):
    held = d.observations.groupBy("business_id").agg(F.collect_set("event_type").alias("s"))
    joined = d.businesses.select("business_id", "niche_id").join(held, "business_id")
    union = offers.all_signals(
        F.array("niche_id", F.lit("view")), F.array_union("s", F.array(F.lit("click"))),
        ("view", "click", "purchase", "building"),
    )
    return joined.select("business_id", F.array_join(F.array_sort(union), ",").alias("signals"))


@check(
    "eligible_for_offers", "F2",
    sql("""SELECT b.id, b.niche_id FROM businesses b JOIN verdicts v ON v.business_id = b.id
           WHERE v.my_verdict IN ('high', 'medium')""", "businesses", "verdicts"),
)
def _(d: Domain):
    return offers.eligible(d.businesses, d.verdicts).select("id", "niche_id")
