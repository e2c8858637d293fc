"""Observation rows, freshness, miss ladder, lookups due, usage."""

from pyspark.sql import functions as F

from doorstep.checks import check
from doorstep.checks.domain import Domain, sql
from doorstep.operators import observe, offers, summaries
from doorstep.operators.ordering import latest_per_key

_ASOF = "2024-02-20 00:00:00"
_QUESTION = """CASE source WHEN 'tinyfish_web' THEN 'website' WHEN 'instagram_handle' THEN 'instagram_handle'
      WHEN 'ad_library' THEN 'ad_library' END"""
_LADDER = f"""
facts AS (SELECT *, {_QUESTION} AS question FROM observations WHERE {_QUESTION} IS NOT NULL),
numbered AS (
  SELECT *, sum(CASE WHEN status = 'ok' THEN 1 ELSE 0 END) OVER (PARTITION BY business_id, question
           ORDER BY fetched_at DESC, id DESC) AS oks_after FROM facts WHERE status IN ('ok', 'no_data')),
ladder AS (
  SELECT business_id, question, count(*) AS misses, max(fetched_at) AS last_miss_at
  FROM numbered WHERE status = 'no_data' AND oks_after = 0 GROUP BY 1, 2),
ladder2 AS (
  SELECT *, last_miss_at + to_days(CASE misses WHEN 1 THEN 30 WHEN 2 THEN 90 WHEN 3 THEN 180 END) AS retry_after FROM ladder),
fresh AS (SELECT business_id, question, max(fetched_at) AS last_ok_at FROM facts WHERE status = 'ok' GROUP BY 1, 2)"""


def _ladder_sql(select: str, *names: str) -> str:
    return sql("\n@@" + select, "observations", *names).replace("\n\n@@", "," + _LADDER + "\n")


@check("miss_ladder", "W6",
       _ladder_sql("SELECT business_id, question, misses, last_miss_at, retry_after FROM ladder2"))
def _(d: Domain):
    return observe.miss_ladder(d.observations)


@check(
    "miss_ladder_lengths", "W6",
    _ladder_sql("SELECT question, misses, retry_after IS NULL AS exhausted, count(*) AS n FROM ladder2 GROUP BY ALL"),
)
def _(d: Domain):
    return (
        observe.miss_ladder(d.observations)
        .groupBy("question", "misses", F.col("retry_after").isNull().alias("exhausted"))
        .agg(F.count(F.lit(1)).alias("n"))
    )


@check("freshness", "A6", _ladder_sql("SELECT business_id, question, last_ok_at FROM fresh"))
def _(d: Domain):
    return observe.freshness(d.observations)


def _merged(d: Domain):
    """Summaries by day; the days before a cut and from it on merged by themselves, then together."""
    days, cut = summaries.daily(d.observations), F.lit("2024-02-01").cast("date")
    early, late = (summaries.merge(days.where(part)) for part in (F.col("since") < cut, F.col("since") >= cut))
    return summaries.merge(early.unionByName(late))


@check("miss_ladder_of_summaries", "W6",
       _ladder_sql("SELECT business_id, question, misses, last_miss_at, retry_after FROM ladder2"))
def _(d: Domain):
    return summaries.ladder(_merged(d))


@check("freshness_of_summaries", "A6", _ladder_sql("SELECT business_id, question, last_ok_at FROM fresh"))
def _(d: Domain):
    return summaries.freshness(_merged(d))


@check(
    "lookups_due", "F4",
    _ladder_sql(
        f"""SELECT b.id AS business_id, q.question, CASE
              WHEN l.misses >= 1 AND l.retry_after IS NULL THEN 'negative_cache_exhausted'
              WHEN l.misses >= 1 AND TIMESTAMP '{_ASOF}' < l.retry_after THEN 'negative_cache'
              WHEN l.misses >= 1 THEN NULL
              WHEN TIMESTAMP '{_ASOF}' < f.last_ok_at + to_days(q.ttl) THEN 'fresh' END AS skip_reason
            FROM businesses b CROSS JOIN (VALUES ('website', 30), ('instagram_handle', 30), ('ad_library', 14)) q(question, ttl)
            LEFT JOIN ladder2 l ON l.business_id = b.id AND l.question = q.question
            LEFT JOIN fresh f ON f.business_id = b.id AND f.question = q.question""", "businesses",
    ),
)
def _(d: Domain):
    questions = F.array(*[F.lit(q) for q in observe.SOURCES_BY_QUESTION])
    wanted = d.businesses.select(F.col("id").alias("business_id"), F.explode(questions).alias("question"))
    return observe.lookups(
        wanted, observe.miss_ladder(d.observations), observe.freshness(d.observations),
        F.lit(_ASOF).cast("timestamp_ntz"),
    )


@check(
    "observation_counts", "A5",
    sql("""SELECT 'status' AS measure, status AS value, count(*) AS n FROM observations GROUP BY status
           UNION ALL SELECT 'source', source, count(*) FROM observations GROUP BY source
           UNION ALL SELECT 'handle', 'found', count(*) FROM observations WHERE source = 'instagram_handle' AND status = 'ok'
           UNION ALL SELECT 'advertiser', 'found', count(*) FROM observations WHERE source = 'ad_library' AND status = 'ok' AND k % 2 = 0""",
        "observations"),
)
def _(d: Domain):
    ok, source = F.col("status") == "ok", F.col("source")
    ads = F.get_json_object("data", "$.runs_ads") == "true"
    return observe.observation_counts(
        d.observations,
        {
            "status": F.col("status"), "source": source,
            "handle": F.when(ok & (source == "instagram_handle"), "found"),
            "advertiser": F.when(ok & (source == "ad_library") & ads, "found"),
        },
    )


_USAGE = """count(*) FILTER (WHERE slot = 'primary') AS attempts, count(*) FILTER (WHERE slot = 'primary') AS primary_calls,
   count(*) FILTER (WHERE slot = 'primary' AND failed) AS primary_failures,
   count(*) FILTER (WHERE slot = 'fallback') AS fallback_calls,
   count(*) FILTER (WHERE slot = 'fallback' AND failed) AS fallback_failures,
   CASE WHEN count(*) FILTER (WHERE slot = 'primary') > 0 THEN
     round(count(*) FILTER (WHERE slot = 'fallback') / count(*) FILTER (WHERE slot = 'primary'), 4) ELSE 0 END AS fallback_rate
 FROM (SELECT *, CASE WHEN event_type IN ('signup', 'error') THEN 'fallback' ELSE 'primary' END AS slot,
              status IN ('blocked', 'error') AS failed, CAST(fetched_at AS DATE) AS day FROM observations)"""


def _calls(d: Domain):
    return d.observations.select(
        F.when(F.col("event_type").isin("signup", "error"), "fallback").otherwise("primary").alias("slot"),
        F.col("status").isin("blocked", "error").alias("failed"), "status",
        F.col("fetched_at").cast("date").alias("day"),
    )


@check("provider_usage", "A7", sql(f"SELECT {_USAGE}", "observations"))
def _(d: Domain):
    return observe.provider_usage(_calls(d))


@check("provider_usage_by_day", "A7", sql(f"SELECT day, {_USAGE} GROUP BY day", "observations"))
def _(d: Domain):
    return observe.provider_usage(_calls(d), ["day"])


@check(
    "provider_error_codes", "A7",
    sql("SELECT 'error_code' AS measure, status AS value, count(*) AS n FROM observations WHERE status IN ('blocked', 'error') GROUP BY 2",
        "observations"),
)
def _(d: Domain):
    return observe.observation_counts(
        _calls(d), {"error_code": F.when(F.col("failed"), F.col("status"))}
    )


@check(
    "observation_rows", "P25",
    sql("""SELECT business_id, 'google_maps' AS source, CASE WHEN reviews IS NULL AND rating IS NULL THEN 'no_data' ELSE 'ok' END AS status,
             '{"reviews":' || coalesce(CAST(reviews AS VARCHAR), 'null') || ',"rating":' || coalesce(CAST(rating AS VARCHAR), 'null') || '}' AS data,
             source_url, 'run-1' AS run_id
           FROM (SELECT *, CASE WHEN k % 7 > 2 THEN k * 8 END AS reviews, CASE WHEN k % 3 = 0 THEN k % 5 END AS rating FROM observations)""",
        "observations"),
)
def _(d: Domain):
    k = F.col("k")
    staged = d.observations.select(
        "business_id", "source_url",
        F.when(k % 7 > 2, k * 8).alias("reviews"), F.when(k % 3 == 0, k % 5).alias("rating"),
    )
    return observe.observation_rows(staged, ["reviews", "rating"], "google_maps", "run-1", ["business_id"])


_RESCORE = """SELECT b.id AS business_id, v.my_verdict, coalesce(l.data, '{{}}') AS listing_data
  FROM businesses b LEFT JOIN verdicts v ON v.business_id = b.id
  LEFT JOIN (SELECT business_id, data FROM (SELECT *, row_number() OVER (PARTITION BY business_id ORDER BY fetched_at DESC, id DESC) AS rn
             FROM observations WHERE source = 'google_maps' {extra}) WHERE rn = 1) l ON l.business_id = b.id"""


@check("rescoring_inputs", "J14", sql(_RESCORE.format(extra=""), "businesses", "verdicts", "observations"))
def _(d: Domain):
    return observe.rescoring_inputs(
        d.businesses, d.verdicts, d.observations, F.col("source") == "google_maps"
    ).select("business_id", "my_verdict", "listing_data")


@check("rescoring_inputs_good_only", "J14",
       sql(_RESCORE.format(extra="AND status = 'ok'"), "businesses", "verdicts", "observations"))
def _(d: Domain):
    return observe.rescoring_inputs(
        d.businesses, d.verdicts, d.observations, F.col("source") == "google_maps", ["ok"]
    ).select("business_id", "my_verdict", "listing_data")


_FINDINGS = """
findings AS (
  SELECT business_id, id AS web_row, CASE k % 5 WHEN 0 THEN 'own_site' WHEN 1 THEN 'none' WHEN 2 THEN 'social_only' WHEN 3 THEN 'unknown' ELSE 'free_builder' END AS verdict,
         CASE WHEN k % 3 = 0 THEN ['ordering', 'enquiry'] WHEN k % 3 = 1 THEN ['catalogue', 'enquiry'] ELSE ['ordering'] END AS gaps,
         CASE WHEN k % 4 = 0 THEN id END AS ads_row, k % 2 = 0 AS runs_ads, source_url
  FROM (SELECT *, row_number() OVER (PARTITION BY business_id ORDER BY fetched_at DESC, id DESC) AS rn FROM observations) WHERE rn = 1)"""


def _findings(d: Domain):
    k = F.col("k")
    latest = latest_per_key(
        d.observations, "business_id", ["fetched_at", "id"], ["id", "k", "source_url"]
    )
    verdict = (
        F.when(k % 5 == 0, "own_site").when(k % 5 == 1, "none").when(k % 5 == 2, "social_only")
        .when(k % 5 == 3, "unknown").otherwise("free_builder")
    )
    gaps = (
        F.when(k % 3 == 0, F.array(F.lit("ordering"), F.lit("enquiry")))
        .when(k % 3 == 1, F.array(F.lit("catalogue"), F.lit("enquiry")))
        .otherwise(F.array(F.lit("ordering")))
    )
    return latest.select(
        "business_id", F.col("id").alias("web_row"), verdict.alias("website_verdict"),
        gaps.alias("gaps"), F.when(k % 4 == 0, F.col("id")).alias("ads_row"),
        (k % 2 == 0).alias("runs_ads"), "source_url",
    )


@check(
    "effective_website", "P17",
    sql("\n@@SELECT b.id, CASE WHEN coalesce(f.verdict, 'unknown') = 'unknown' THEN b.website WHEN f.verdict = 'none' THEN NULL ELSE f.source_url END AS website"
        " FROM businesses b LEFT JOIN findings f ON f.business_id = b.id", "businesses", "observations").replace("\n\n@@", "," + _FINDINGS + "\n"),
)
def _(d: Domain):
    joined = d.businesses.join(
        _findings(d).select("business_id", "website_verdict", F.col("source_url").alias("confirmed")),
        "business_id", "left",
    )
    return joined.select(
        "id",
        observe.effective_website(F.col("website_verdict"), F.col("confirmed"), F.col("website")).alias("website"),
    )


@check(
    "observed_signals", "P18",
    sql("""\n@@SELECT business_id, 'no landing page' AS signal, web_row AS observation_id FROM findings
             WHERE verdict IN ('none', 'social_only') OR (list_contains(gaps, 'catalogue') AND list_contains(gaps, 'enquiry'))
           UNION ALL SELECT business_id, 'no online ordering', web_row FROM findings WHERE list_contains(gaps, 'ordering')
           UNION ALL SELECT business_id, s, web_row FROM findings, (VALUES ('no booking link'), ('no enquiry form'), ('manual enquiry flow')) v(s)
             WHERE list_contains(gaps, 'enquiry')
           UNION ALL SELECT business_id, 'runs meta ads', ads_row FROM findings WHERE runs_ads AND ads_row IS NOT NULL""",
        "observations").replace("\n\n@@", "," + _FINDINGS + "\n"),
)
def _(d: Domain):
    return offers.observed_signals(_findings(d))


@check(
    "tolerant_casts", "P15",
    """SELECT event_id, TRY_CAST(v AS BIGINT) AS whole, TRY_CAST(v AS DOUBLE) AS number,
              CASE WHEN lower(w) IN ('true', 't', 'yes', 'y', '1') THEN true WHEN lower(w) IN ('false', 'f', 'no', 'n', '0') THEN false END AS flag,
              CASE WHEN regexp_matches(v, '^[0-9]+$') THEN CAST(v AS INTEGER) END AS strict
       FROM (SELECT event_id, CASE WHEN event_type = 'view' THEN 'x' || json_extract_string(props, '$.k')
                              WHEN event_type = 'click' THEN '-' || json_extract_string(props, '$.k') ELSE json_extract_string(props, '$.k') END AS v,
                    CASE event_type WHEN 'view' THEN 'Yes' WHEN 'error' THEN 'F' WHEN 'click' THEN 'maybe' ELSE json_extract_string(props, '$.k') END AS w FROM events)""",
)
def _(d: Domain):
    from doorstep.functions import casts

    k, kind = F.get_json_object("props", "$.k"), F.col("event_type")
    v = F.when(kind == "view", F.concat(F.lit("x"), k)).when(kind == "click", F.concat(F.lit("-"), k)).otherwise(k)
    w = F.when(kind == "view", "Yes").when(kind == "error", "F").when(kind == "click", "maybe").otherwise(k)
    return d.table("events").select(
        "event_id", casts.as_int(v).alias("whole"), casts.as_float(v).alias("number"),
        casts.as_flag(w).alias("flag"), casts.digits_only(v).alias("strict"),
    )
