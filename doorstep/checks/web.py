"""URLs, sites, ad pages, handles and contacts read from page text."""

from pyspark.sql import functions as F

from doorstep.checks import check
from doorstep.checks.domain import Domain
from doorstep.functions.contacts import ContactRules
from doorstep.functions.pages import AdPageMarkers, ProfileSite, SiteMarkers, ad_page, site_grade
from doorstep.functions.urls import HostLists, host
from doorstep.operators import web

# Domain lists and words that the given pages hold.
LISTS = HostLists(
    social=("example.org",), builder=("tiontion.example.com",), builder_markers=("spam",),
    third_party=("example.net",), tld_labels=("com", "example"),
)
GENERIC = ("the", "and", "was")

_HOST = "lower(regexp_extract(url, '^[^:/?#]+://([^/?#]*)', 1))"
_KINDS = f"""
hosts AS (SELECT *, {_HOST} AS host, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title FROM pages),
kinds AS (
  SELECT *, CASE WHEN host = '' THEN 'other' WHEN host = 'example.org' OR ends_with(host, '.example.org') THEN 'social'
                 WHEN host = 'tiontion.example.com' OR ends_with(host, '.tiontion.example.com') OR contains(host, 'spam') THEN 'free_builder'
                 WHEN host = 'example.net' OR ends_with(host, '.example.net') THEN 'third_party' ELSE 'other' END AS kind FROM hosts),
idents AS (
  SELECT *, CASE kind
      WHEN 'third_party' THEN ''
      WHEN 'other' THEN regexp_replace(regexp_replace(host, '^((www|m|mobile)\\.)+', ''), '(\\.(com|example))+$', '')
      ELSE trim(CASE WHEN ends_with(host, '.example.org') THEN left(host, length(host) - 12)
                     WHEN ends_with(host, '.tiontion.example.com') THEN left(host, length(host) - 21) ELSE '' END
                || ' ' || coalesce(list_filter(string_split(regexp_extract(url, '^[^:/?#]+://[^/?#]*([^?#]*)', 1), '/'), lambda x: x <> '')[1], ''))
      END AS identity FROM kinds)"""


def _match_sql(name: str, identity: str = "identity") -> str:
    """SQL of the name-match rule, as a select list over (name, identity)."""
    return f"""
  SELECT *, len(wanted) > 0 AND hay <> '' AND len(list_filter(wanted, lambda w: contains(hay, w))) >= greatest(1, ceil(len(wanted) * 0.6::DOUBLE))
            AND contains(hay, list_filter(wanted, lambda w: length(w) = list_max(list_transform(wanted, lambda z: length(z))))[1]) AS matched_
  FROM (SELECT *, CASE WHEN len(strong) > 0 THEN strong ELSE every_ END AS wanted,
               regexp_replace(lower({identity}), '[^a-z0-9]+', '', 'g') AS hay
        FROM (SELECT *, list_filter(every_, lambda w: length(w) >= 3 AND w NOT IN ('the', 'and', 'was')) AS strong
              FROM (SELECT *, regexp_extract_all(lower({name}), '[a-z0-9]+') AS every_ FROM @T)))"""


def _pages(d: Domain):
    return d.spread("pages", "page_id").withColumn("title", F.regexp_extract("html", "<title>([^<]*)</title>", 1))


@check("url_kinds", "P6",
       f"WITH {_KINDS} SELECT page_id, host, kind FROM kinds")
def _(d: Domain):
    return web.classified_urls(_pages(d), name="title", lists=LISTS, generic=GENERIC).select("page_id", "host", "kind")


@check("url_kind_counts", "P6", f"WITH {_KINDS} SELECT kind, count(*) AS n, count(DISTINCT host) AS hosts FROM kinds GROUP BY kind")
def _(d: Domain):
    rows = web.classified_urls(_pages(d), name="title", lists=LISTS, generic=GENERIC)
    return rows.groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("host").alias("hosts"))


@check("url_identity", "P7",
       f"WITH {_KINDS}, m AS ({_match_sql('title').replace('@T', 'idents')}) SELECT page_id, identity, coalesce(matched_, false) AS matched FROM m")
def _(d: Domain):
    return web.classified_urls(_pages(d), name="title", lists=LISTS, generic=GENERIC).select(
        "page_id", "identity", "matched"
    )


@check(
    "url_name_matches", "P7",
    f"""WITH {_KINDS}, named AS (SELECT *, regexp_extract(url, '://(m\\.|blog\\.)?([a-z]+)', 2) || ' the ' || CASE WHEN length(html) % 2 = 0 THEN 'shop' ELSE '' END AS nm FROM idents),
        m AS ({_match_sql('nm').replace('@T', 'named')})
        SELECT page_id, nm, kind, coalesce(matched_, false) AS matched FROM m""",
)
def _(d: Domain):
    named = d.table("pages").withColumn(
        "nm",
        F.concat(
            F.regexp_extract("url", r"://(m\.|blog\.)?([a-z]+)", 2), F.lit(" the "),
            F.when(F.length("html") % 2 == 0, "shop").otherwise(""),
        ),
    )
    return web.classified_urls(named, name="nm", lists=LISTS, generic=GENERIC).select("page_id", "nm", "kind", "matched")


_DOMAINS = ("example.com", "tiontion.example.com", "example.net", "spam-farm.example.org")


@check(
    "domains_above_hosts", "J8",
    f"""SELECT p.page_id, v.domain FROM (SELECT *, {_HOST} AS host FROM pages) p
        JOIN (VALUES {', '.join(f"('{x}')" for x in _DOMAINS)}) v(domain) ON p.host = v.domain OR ends_with(p.host, '.' || v.domain)""",
)
def _(d: Domain):
    domains = d.spark.createDataFrame([(x,) for x in _DOMAINS], "domain string")
    return web.suffix_join(d.table("pages").select("page_id", "url"), domains).select("page_id", "domain")


_VERDICTS = f"""
WITH {_KINDS},
biz AS (
  SELECT s_suppkey AS business_id, regexp_extract(p.url, '://(m\\.|blog\\.)?([a-z]+)', 2) AS name, s_acctbal >= 500 AS searched,
         CASE WHEN s_acctbal > 7000 THEN p.url END AS listed_website
  FROM supplier LEFT JOIN pages p ON p.page_id = s_suppkey % (SELECT max(page_id) + 1 FROM pages)),
stated AS (
  SELECT page_id % (SELECT max(s_suppkey) + 1 FROM supplier) AS business_id, page_id + 1 AS position, host, kind, identity, url FROM idents
  UNION ALL
  SELECT b.business_id, 0, i.host, i.kind, i.identity, i.url FROM biz b JOIN idents i ON i.page_id = b.business_id % (SELECT max(page_id) + 1 FROM pages) WHERE b.listed_website IS NOT NULL),
joined AS (SELECT s.*, b.name FROM stated s JOIN biz b USING (business_id) WHERE b.searched AND s.host <> ''),
m AS ({_match_sql('name').replace('@T', 'joined')}),
best AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY business_id ORDER BY CASE kind WHEN 'other' THEN 1 WHEN 'free_builder' THEN 2 ELSE 3 END, position) AS rn
                 FROM m WHERE coalesce(matched_, false) AND kind <> 'third_party') WHERE rn = 1),
agg AS (SELECT business_id, count(*) FILTER (WHERE kind = 'other' AND NOT coalesce(matched_, false)) AS near, count(*) FILTER (WHERE position > 0) AS seen FROM m GROUP BY 1),
v AS (
  SELECT b.*, x.url, x.host, a.near, a.seen, CASE WHEN NOT b.searched THEN 'unknown' WHEN x.kind = 'other' THEN 'own_site' WHEN x.kind = 'free_builder' THEN 'free_builder'
              WHEN x.kind = 'social' THEN 'social_only' ELSE 'none' END AS verdict
  FROM biz b LEFT JOIN best x USING (business_id) LEFT JOIN agg a USING (business_id))
SELECT business_id, CASE verdict WHEN 'unknown' THEN 'error' WHEN 'none' THEN 'no_data' ELSE 'ok' END AS status, verdict, url, host,
       CASE WHEN verdict = 'none' AND coalesce(near, 0) > 0 THEN 'medium' ELSE 'high' END AS confidence,
       coalesce(seen, 0) AS results_seen, listed_website IS NULL AND verdict IN ('own_site', 'free_builder') AS contradicts_listing
FROM v"""


@check("website_verdicts", "A16", _VERDICTS)
def _(d: Domain):
    pages, suppliers = d.table("pages"), d.table("supplier")
    n_pages = pages.agg((F.max("page_id") + 1).alias("n")).scalar()
    n_suppliers = suppliers.agg((F.max("s_suppkey") + 1).alias("n")).scalar()
    businesses = (
        suppliers.withColumn("_page", F.col("s_suppkey") % n_pages)
        .join(pages.select("page_id", "url"), F.col("_page") == F.col("page_id"), "left")
        .select(
            F.col("s_suppkey").alias("business_id"),
            F.regexp_extract("url", r"://(m\.|blog\.)?([a-z]+)", 2).alias("name"),
            (F.col("s_acctbal") >= 500).alias("searched"),
            F.when(F.col("s_acctbal") > 7000, F.col("url")).alias("listed_website"),
        )
    )
    results = pages.select(
        (F.col("page_id") % n_suppliers).alias("business_id"),
        (F.col("page_id") + 1).alias("position"), "url",
    )
    return web.website_verdicts(results, businesses, lists=LISTS, generic=GENERIC)


MARKERS = SiteMarkers(
    catalogue=("attion", "mentre"), enquiry=("spam-farm", "token"), ordering=("ciónme", "einsch"),
    viewport=r"(?i)<meta[^>]+charset=[^>]*>", device_width="(?i)utf-8", media_query="(?i)@media",
)
_TEXTS = """(SELECT 'page' AS origin, page_id AS id, html AS text FROM pages
   UNION ALL SELECT 'document', doc_id, text FROM documents)"""


@check(
    "site_grades", "P8",
    f"""SELECT origin, id, mobile_friendly, catalogue, enquiry, ordering, CAST(round_even(100 * earned / measured, 0) AS INTEGER) AS score, signals, gaps FROM (
      SELECT *, CASE WHEN catalogue THEN 0.3::DOUBLE ELSE 0 END + CASE WHEN enquiry THEN 0.25::DOUBLE ELSE 0 END
                + CASE WHEN ordering THEN 0.15::DOUBLE ELSE 0 END + CASE WHEN mobile_friendly THEN 0.3::DOUBLE ELSE 0 END AS earned,
             0.3::DOUBLE + 0.25::DOUBLE + 0.15::DOUBLE + CASE WHEN mobile_friendly IS NOT NULL THEN 0.3::DOUBLE ELSE 0 END AS measured,
             concat_ws(',', CASE WHEN catalogue THEN 'catalogue' END, CASE WHEN enquiry THEN 'enquiry' END, CASE WHEN ordering THEN 'ordering' END, CASE WHEN mobile_friendly THEN 'mobile_friendly' END) AS signals,
             concat_ws(',', CASE WHEN NOT catalogue THEN 'catalogue' END, CASE WHEN NOT enquiry THEN 'enquiry' END, CASE WHEN NOT ordering THEN 'ordering' END, CASE WHEN NOT mobile_friendly THEN 'mobile_friendly' END) AS gaps
      FROM (SELECT *, contains(lower(text), 'attion') OR contains(lower(text), 'mentre') AS catalogue,
                   contains(lower(text), 'spam-farm') OR contains(lower(text), 'token') AS enquiry,
                   contains(lower(text), 'ciónme') OR contains(lower(text), 'einsch') AS ordering,
                   CASE WHEN regexp_matches(text, '(?i)<\\s*(!doctype|html|head|meta|body|div)\\b')
                        THEN regexp_matches(regexp_extract(text, '(?i)<meta[^>]+charset=[^>]*>'), '(?i)utf-8') OR regexp_matches(text, '(?i)@media') END AS mobile_friendly
            FROM {_TEXTS} WHERE length(regexp_replace(text, '^\\s+|\\s+$', '', 'g')) >= 200))""",
)
def _(d: Domain):
    pages = d.spread("pages", "page_id").select(F.lit("page").alias("origin"), F.col("page_id").alias("id"), F.col("html").alias("text"))
    documents = d.spread("documents", "doc_id").select(F.lit("document").alias("origin"), F.col("doc_id").alias("id"), "text")
    graded = pages.unionByName(documents).withColumn("g", site_grade(F.col("text"), MARKERS))
    return graded.where(F.col("g").isNotNull()).select(
        "origin", "id", "g.mobile_friendly", "g.catalogue", "g.enquiry", "g.ordering", "g.score",
        F.array_join("g.signals", ",").alias("signals"), F.array_join("g.gaps", ",").alias("gaps"),
    )


AD_MARKERS = AdPageMarkers(
    blocked=("token", "spam"), empty=("einsch", "ciónme"), count=r"~?\s*([\d,]+)\s*", min_chars=120
)


@check(
    "ad_pages", "P9",
    """SELECT doc_id, CASE WHEN o IN ('empty', 'counted') THEN 'ok' ELSE o END AS status,
              CASE o WHEN 'empty' THEN false WHEN 'counted' THEN n > 0 END AS runs_ads,
              CASE o WHEN 'empty' THEN 0 WHEN 'counted' THEN n END AS ad_count
       FROM (SELECT *, TRY_CAST(replace(c, ',', '') AS BIGINT) AS n,
                CASE WHEN length(regexp_replace(text, '^\\s+|\\s+$', '', 'g')) < 120 OR contains(lower(text), 'token') OR contains(lower(text), 'spam') THEN 'blocked'
                     WHEN contains(lower(text), 'einsch') OR contains(lower(text), 'ciónme') THEN 'empty' WHEN c <> '' THEN 'counted' ELSE 'no_data' END AS o
             FROM (SELECT *, regexp_extract(lower(text), '~?\\s*([\\d,]+)\\s*', 1) AS c FROM documents))""",
)
def _(d: Domain):
    return d.spread("documents", "doc_id").select("doc_id", ad_page(F.col("text"), AD_MARKERS).alias("a")).select(
        "doc_id", "a.status", "a.runs_ads", "a.ad_count"
    )


SITE = ProfileSite(
    hosts=("example.com",), in_text=r'(?i)href="/([A-Za-z0-9._]{1,30})"', reserved=("the", "and", "of"),
)
_CLEAN = "CASE WHEN regexp_matches({h}, '^[a-z0-9._]{{1,30}}$') AND regexp_matches({h}, '[a-z0-9]') AND {h} NOT IN ('the', 'and', 'of') THEN {h} END"
_HANDLES = f"""
WITH base AS (SELECT page_id, url, html, regexp_extract(html, '<title>([^<]*)</title>', 1) AS name, {_HOST} AS host FROM pages),
mentions AS (
  SELECT page_id, name, 1 AS origin_rank, pos, lower(h) AS h FROM (
    SELECT page_id, name, unnest(regexp_extract_all(html, '(?i)href="/([A-Za-z0-9._]{{1,30}})"', 1)) AS h, generate_subscripts(regexp_extract_all(html, '(?i)href="/([A-Za-z0-9._]{{1,30}})"', 1), 1) AS pos FROM base)
  UNION ALL
  SELECT page_id, name, 2, 0, lower(list_filter(string_split(regexp_extract(url, '^[^:/?#]+://[^/?#]*([^?#]*)', 1), '/'), lambda x: x <> '')[1]) FROM base WHERE host = 'example.com' OR ends_with(host, '.example.com')),
valid AS (SELECT page_id, name, origin_rank, pos, {_CLEAN.format(h='h')} AS handle FROM mentions),
cand AS (SELECT page_id, name, handle, min(origin_rank * 100000 + pos) AS place FROM valid WHERE handle IS NOT NULL GROUP BY ALL),
m AS ({_match_sql('name', "replace(replace(handle, '.', ' '), '_', ' ')").replace('@T', 'cand')})"""


def _handles(d: Domain):
    base = _pages(d)
    return web.handle_candidates(
        base.select("page_id", F.col("title").alias("name"), F.lit(None).cast("string").alias("listed_handle")),
        base.select("page_id", F.col("html").alias("text")),
        base.select("page_id", F.lit(1).alias("position"), "url", F.col("title").alias("snippet")),
        business="page_id", site=SITE, generic=GENERIC,
    )


@check("handle_candidates", "P10",
       f"{_HANDLES} SELECT page_id, handle, CASE WHEN place < 200000 THEN 'own_site' ELSE 'search' END AS origin, coalesce(matched_, false) AS matched FROM m")
def _(d: Domain):
    return _handles(d).select("page_id", "handle", "origin", "matched")


@check(
    "best_handles", "P10",
    f"""{_HANDLES} SELECT page_id, handle, CASE WHEN place < 200000 THEN 'own_site' ELSE 'search' END AS origin,
        CASE WHEN place < 200000 OR coalesce(matched_, false) THEN 'high' ELSE 'low' END AS confidence, candidates
      FROM (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY coalesce(matched_, false) DESC, place) AS rn, count(*) OVER (PARTITION BY page_id) AS candidates FROM m) WHERE rn = 1""",
)
def _(d: Domain):
    return web.best_handles(_handles(d), "page_id")


# Names, roles and details in the shapes the given documents hold.
RULES = ContactRules(
    roles=((r"\btoken\b", "owner"), (r"\b(?:License|license)\b", "manager"), (r"\bthat\b", "marketing")),
    labels=r"\b(?:token|License|license|that)\b",
    title="", name=r"([A-Z][a-z]{2,}\s+[a-z]{2,})", not_names=("the", "and", "was"),
)
_LINE = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}]"
_NAME = r"([A-Z][a-z]{2,}\s+[a-z]{2,})"
_NOT_NAME = "len(list_filter(regexp_split_to_array(lower({c}), '\\s+'), lambda w: w IN ('the', 'and', 'was'))) = 0"
_CONTACTS = f"""
WITH lines AS (
  SELECT doc_id, pos, regexp_replace(raw, '^\\s+|\\s+$', '', 'g') AS line FROM (
    SELECT doc_id, unnest(regexp_split_to_array(text, '{_LINE}')) AS raw, generate_subscripts(regexp_split_to_array(text, '{_LINE}'), 1) AS pos FROM documents)),
written AS (SELECT doc_id, line, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS n FROM lines WHERE line <> '' AND NOT regexp_matches(line, '^#{{1,6}}\\s')),
det AS (
  SELECT *, CASE WHEN regexp_matches(line, '\\btoken\\b') THEN 'owner' WHEN regexp_matches(line, '\\b(?:License|license)\\b') THEN 'manager' WHEN regexp_matches(line, '\\bthat\\b') THEN 'marketing' END AS role,
    nullif(regexp_extract(line, '[A-Za-z0-9._%+\\-]+@[A-Za-z0-9.\\-]+\\.[A-Za-z]{{2,}}'), '') AS email,
    trim(list_filter(regexp_extract_all(line, '\\+?\\d[\\d\\-\\s]{{5,16}}\\d'), lambda r: length(regexp_replace(r, '[^0-9]', '', 'g')) BETWEEN 7 AND 13)[1]) AS phone
  FROM written),
facts AS (
  SELECT *, CASE WHEN coalesce(role, email, phone) IS NOT NULL THEN
        list_filter(regexp_extract_all(regexp_replace(line, '\\b(?:token|License|license|that)\\b', ' ', 'g'), '{_NAME}', 1), lambda c: {_NOT_NAME.format(c='c')})[1] END AS name,
    CASE WHEN coalesce(role, email, phone) IS NULL AND length(line) <= 40 AND regexp_matches(line, '^{_NAME}\\.?$')
          AND {_NOT_NAME.format(c=f"regexp_extract(line, '^{_NAME}', 1)")} THEN regexp_extract(line, '^{_NAME}\\.?$', 1) END AS bare
  FROM det),
cards AS (
  SELECT f.doc_id, f.n, f.bare AS name,
         coalesce(CASE WHEN a.bare IS NULL THEN a.role END, CASE WHEN a.bare IS NULL AND b.bare IS NULL THEN b.role END) AS role,
         coalesce(CASE WHEN a.bare IS NULL THEN a.phone END, CASE WHEN a.bare IS NULL AND b.bare IS NULL THEN b.phone END) AS phone,
         coalesce(CASE WHEN a.bare IS NULL THEN a.email END, CASE WHEN a.bare IS NULL AND b.bare IS NULL THEN b.email END) AS email
  FROM facts f LEFT JOIN facts a ON a.doc_id = f.doc_id AND a.n = f.n + 1 LEFT JOIN facts b ON b.doc_id = f.doc_id AND b.n = f.n + 2
  WHERE f.bare IS NOT NULL),
every_ AS (
  SELECT doc_id, 1 AS pass, n, name, role, phone, email FROM facts WHERE name IS NOT NULL
  UNION ALL SELECT doc_id, 2, n, name, role, phone, email FROM cards WHERE coalesce(role, phone, email) IS NOT NULL),
firsts AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, lower(name) ORDER BY pass, n) AS rn FROM every_) WHERE rn = 1)
SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY pass, n) AS INTEGER) AS contact_no, name, coalesce(role, 'unknown') AS role, phone, email,
       'website' AS source, 0.8::DOUBLE AS confidence
FROM firsts"""


@check("named_contacts", "P11", _CONTACTS)
def _(d: Domain):
    return web.extracted_contacts(d.spread("documents", "doc_id"), keep=("doc_id",), rules=RULES)


@check(
    "contact_details", "P11",
    r"""SELECT doc_id, nullif(regexp_extract(text, '[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}'), '') AS email,
        trim(list_filter(regexp_extract_all(text, '\+?\d[\d\-\s]{5,16}\d'), lambda r: length(regexp_replace(r, '[^0-9]', '', 'g')) BETWEEN 7 AND 13)[1]) AS phone
        FROM documents""",
)
def _(d: Domain):
    from doorstep.functions import contacts

    return d.table("documents").select(
        "doc_id", contacts.email_in(F.col("text"), RULES).alias("email"),
        contacts.phone_in(F.col("text"), RULES).alias("phone"),
    )


@check("hosts", "P6", f"SELECT {_HOST} AS host, count(*) AS pages FROM pages GROUP BY 1")
def _(d: Domain):
    return d.table("pages").groupBy(host(F.col("url")).alias("host")).agg(F.count(F.lit(1)).alias("pages"))
