"""Raw responses: the given tables written as payload text by Spark and read back."""

from pyspark.sql import functions as F

from doorstep.checks import check
from doorstep.checks.domain import Domain, sql
from doorstep.sources import drift, payloads
from doorstep.sources.schemas import SEARCH_RESPONSE


def _pages(d: Domain):
    b = d.businesses
    reviews = (F.col("id") % 600)
    place = F.struct(
        F.when(F.col("lat").isNull(), F.lit(" ")).otherwise(F.col("name")).alias("title"),
        F.col("place_id"), F.struct(F.col("lat").alias("latitude"), F.col("lng").alias("longitude")).alias("gps_coordinates"),
        F.when(F.col("phone").isNotNull(), reviews).alias("reviews"), F.col("niche_id").alias("type"),
        F.array("niche_id", F.lit(" "), "state").alias("types"), F.col("address"), F.col("phone"), F.col("website"),
    )
    body = (
        F.when(F.col("email").isNotNull(), F.to_json(F.struct(F.struct(F.lit("q1").alias("id")).alias("search_metadata"))))
        .when(F.col("lng").isNull(), F.concat(F.lit('{"error":"'), F.col("name"), F.lit('"}')))
        .when(F.col("lat").isNull(), F.lit("<html>proxy error</html>"))
        .otherwise(F.to_json(F.struct(F.array(place, place).alias("local_results"))))
    )
    return b.select(F.col("id").alias("page_id"), body.alias("raw"))


_GOOD = "FROM businesses, (VALUES (1), (2)) v(position) WHERE email IS NULL AND lng IS NOT NULL AND lat IS NOT NULL"


@check(
    "listing_page_rows", "S1",
    sql(f"""SELECT id AS page_id, position, name, niche_id AS category, niche_id || ',' || state AS raw_categories, coalesce(address, '') AS address,
              lat, lng, phone, website, place_id AS provider_id, 'https://www.google.com/maps/place/?q=place_id:' || place_id AS source_url,
              CASE WHEN phone IS NOT NULL THEN id % 600 END AS reviews, NULL::DOUBLE AS rating {_GOOD}""", "businesses"),
)
def _(d: Domain):
    return payloads.listing_rows(_pages(d), keep=("page_id",)).withColumn(
        "raw_categories", F.array_join("raw_categories", ",")
    )


@check("rejected_listing_pages", "S1",
       sql("SELECT id AS page_id FROM businesses WHERE email IS NULL AND (lng IS NULL OR lat IS NULL)", "businesses"))
def _(d: Domain):
    return payloads.rejected_pages(_pages(d)).select("page_id")


def _searches(d: Domain):
    p = d.table("pages").withColumn("title", F.regexp_extract("html", "<title>([^<]*)</title>", 1))
    first = F.struct(F.lit(1).alias("position"), "title", F.col("url"))
    second = F.struct(
        F.lit(2).alias("position"), F.lit("second").alias("title"),
        F.when(F.col("page_id") % 5 == 0, F.lit("")).otherwise(F.concat("url", F.lit("/more"))).alias("url"),
    )
    return p.select(
        "page_id",
        F.to_json(F.struct(F.col("title").alias("query"), F.array(first, second).alias("results"))).alias("raw"),
    )


@check(
    "search_result_rows", "S2",
    """SELECT page_id, t AS query, v.n AS result_no, CASE v.n WHEN 1 THEN url ELSE url || '/more' END AS url, CASE v.n WHEN 1 THEN t ELSE 'second' END AS title
       FROM (SELECT page_id, url, regexp_extract(html, '<title>([^<]*)</title>', 1) AS t FROM pages), (VALUES (1), (2)) v(n) WHERE page_id % 5 <> 0""",
)
def _(d: Domain):
    return payloads.search_rows(_searches(d), keep=("page_id",)).select("page_id", "query", "result_no", "url", "title")


@check("rejected_search_responses", "S2", "SELECT page_id FROM pages WHERE page_id % 5 = 0")
def _(d: Domain):
    return payloads.rejected_searches(_searches(d)).select("page_id")


@check(
    "fetched_page_rows", "S3",
    """SELECT doc_id, 'https://site.example/' || CAST(doc_id AS VARCHAR) AS url, sha256(text) AS digest, NULL::VARCHAR AS error, true AS ok FROM documents WHERE lang <> 'de'
       UNION ALL SELECT doc_id, 'https://site.example/' || CAST(doc_id AS VARCHAR), NULL, 'status ' || source, false FROM documents WHERE lang IN ('de', 'fr')""",
)
def _(d: Domain):
    rows = payloads.fetched_rows(_fetches(d, errors_only=False), keep=("doc_id",))
    return rows.select("doc_id", "url", F.sha2("text", 256).alias("digest"), "error", "ok")


@check("rejected_fetch_responses", "S3", "SELECT doc_id FROM documents WHERE lang = 'de'")
def _(d: Domain):
    """A response that has errors but no list of results is malformed."""
    return payloads.rejected_fetches(_fetches(d, errors_only=True)).select("doc_id")


def _fetches(d: Domain, errors_only: bool):
    url = F.concat(F.lit("https://site.example/"), F.col("doc_id").cast("string"))
    ok = F.struct(url.alias("url"), F.col("text"))
    bad = F.struct(url.alias("url"), F.concat(F.lit("status "), "source").alias("error"), F.lit(403).alias("status"))
    lang = F.col("lang")
    none = [] if errors_only else [F.array().cast("array<string>").alias("results")]
    raw = F.when(
        lang == "de", F.to_json(F.struct(*none, F.array(bad).alias("errors")))
    ).when(
        lang == "fr", F.to_json(F.struct(F.array(ok).alias("results"), F.array(bad).alias("errors")))
    ).otherwise(F.to_json(F.struct(F.array(ok).alias("results"))))
    return d.table("documents").select("doc_id", raw.alias("raw"))


@check(
    "profile_rows", "S4",
    """SELECT event_id, 'shop_' || CAST(user_id AS VARCHAR) AS handle,
         CASE event_type WHEN 'view' THEN 'ok' WHEN 'click' THEN 'no_data' WHEN 'signup' THEN 'blocked' WHEN 'error' THEN 'error' ELSE CASE WHEN k % 2 = 0 THEN 'blocked' ELSE 'error' END END AS status,
         CASE WHEN event_type = 'view' THEN k * 300 END AS followers, CASE WHEN event_type = 'view' AND k % 3 <> 0 THEN k END AS posts,
         CASE WHEN event_type = 'view' AND k % 4 <> 0 THEN 'bio ' || CAST(k AS VARCHAR) END AS bio, CASE WHEN event_type = 'view' THEN k % 2 = 0 END AS is_private
       FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events)""",
)
def _(d: Domain):
    k, kind = F.get_json_object("props", "$.k").cast("bigint"), F.col("event_type")
    text = k.cast("string")
    user = F.concat(
        F.lit('{"data":{"user":{"edge_followed_by":{"count":'), (k * 300).cast("string"),
        F.lit('},"edge_owner_to_timeline_media":{"count":'), F.when(k % 3 == 0, F.concat(F.lit('"'), text, F.lit('"'))).otherwise(text),
        F.lit('},"biography":"'), F.when(k % 4 == 0, "  ").otherwise(F.concat(F.lit(" bio "), text)),
        F.lit('","is_private":'), F.when(k % 2 == 0, "true").otherwise("false"), F.lit("}}}"),
    )
    raw = (
        F.when(kind == "view", user)
        .when(kind == "click", '{"message":"User not found","status":"fail"}')
        .when(kind == "signup", "<html><p>Please wait a few minutes</p></html>")
        .when(kind == "error", F.left(user, F.length(user) - 4))
        .otherwise(F.when(k % 2 == 0, '{"message":"checkpoint_required"}').otherwise('{"message":3}'))
    )
    responses = d.table("events").select(
        "event_id", F.concat(F.lit(" @Shop_"), F.col("user_id").cast("string"), F.lit("/")).alias("handle"), raw.alias("raw")
    )
    return payloads.profile_rows(responses).select(
        "event_id", "handle", "status", "followers", "posts", "bio", "is_private"
    )


_DRIFT_SQL = """
WITH r AS (SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS month, o_orderpriority AS p, o_orderstatus AS s FROM orders),
listed AS (SELECT month FROM r WHERE p NOT IN ('1-URGENT', '2-HIGH') GROUP BY 1)
SELECT month, 'retyped' AS finding, '$' AS path, 'object' AS declared, 'not json' AS observed, count(*) AS responses FROM r WHERE p = '1-URGENT' GROUP BY 1
UNION ALL SELECT month, 'retyped', '$.results', 'list', 'object', count(*) FROM r WHERE p = '2-HIGH' GROUP BY 1
UNION ALL SELECT month, 'unknown', '$.results[].score', NULL, 'number', count(*) FROM r WHERE p = '3-MEDIUM' GROUP BY 1
UNION ALL SELECT month, 'unknown', '$.`next page`', NULL, 'object', count(*) FROM r WHERE p = '3-MEDIUM' GROUP BY 1
UNION ALL SELECT month, 'retyped', '$.results[].title', 'text', 'object', count(*) FROM r WHERE p = '5-LOW' AND s = 'F' GROUP BY 1
UNION ALL SELECT month, 'retyped', '$.results[].title', 'text', 'mixed', count(*) FROM r WHERE p = '4-NOT SPECIFIED' AND s = 'F' GROUP BY 1
UNION ALL SELECT month, 'missing', '$.results[].' || f, CASE f WHEN 'position' THEN 'number' ELSE 'text' END, NULL, 0
  FROM listed, (VALUES ('position'), ('site_name'), ('snippet'), ('date')) v(f)"""


@check("search_payload_drift", "S2", _DRIFT_SQL)
def _(d: Domain):
    """Search responses by month, of which each order priority departs in its own way."""
    key, priority = F.col("o_orderkey"), F.col("o_orderpriority")
    plain = F.struct(key.cast("string").alias("url"), key.alias("title"))
    nested = F.struct(key.cast("string").alias("url"), F.struct(priority.alias("text")).alias("title"))
    scored = F.struct(key.cast("string").alias("url"), priority.alias("title"), F.lit(1.5).alias("score"))

    def body(*results, more=""):
        listed = F.concat_ws(",", *[F.to_json(r) for r in results])
        return F.concat(F.lit('{"query":"'), priority, F.lit('","results":['), listed, F.lit(f"]{more}}}"))

    final = F.col("o_orderstatus") == "F"
    raw = (
        F.when(priority == "1-URGENT", F.concat(F.lit("<html>"), priority))
        .when(priority == "2-HIGH", F.concat(F.lit('{"query":"'), priority, F.lit('","results":{"items":[]}}')))
        .when(priority == "3-MEDIUM", body(scored, scored, more=',"next page":{"at":2}'))
        .when((priority == "5-LOW") & final, body(nested))
        .when(final, body(plain, nested)).otherwise(body(plain))
    )
    month = F.date_trunc("month", "o_orderdate").cast("date").alias("month")
    return drift.drift(d.table("orders").select(month, raw.alias("raw")), SEARCH_RESPONSE, ["month"])
