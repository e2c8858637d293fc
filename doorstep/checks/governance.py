"""Rules, secrets, budgets, call and run logs."""

from pyspark.sql import functions as F

from doorstep.checks import check
from doorstep.checks.domain import Domain, sql
from doorstep.functions import secrets
from doorstep.operators import audit, ledger, percentiles

_BUDGET = """
budget AS (
  SELECT c_mktsegment AS provider, CASE WHEN c_acctbal < 0 THEN 'other' WHEN c_acctbal < 5000 THEN 'discover' ELSE 'refresh' END AS purpose,
         CASE WHEN c_acctbal > 9000 THEN '' WHEN c_acctbal > 8000 THEN upper(substr(sha256(c_name), 1, 12)) ELSE substr(sha256(CAST(c_nationkey AS VARCHAR)), 1, 12) END AS key_fingerprint,
         CAST(floor(c_acctbal) AS BIGINT) AS limit_total, CAST(floor(c_acctbal) AS BIGINT) % 4000 AS used FROM customer)"""


def _budget(d: Domain):
    bal, whole = F.col("c_acctbal"), F.floor("c_acctbal")
    return d.table("customer").select(
        F.col("c_mktsegment").alias("provider"),
        F.when(bal < 0, "other").when(bal < 5000, "discover").otherwise("refresh").alias("purpose"),
        F.when(bal > 9000, "").when(bal > 8000, F.upper(secrets.key_fingerprint(F.col("c_name"))))
        .otherwise(secrets.key_fingerprint(F.col("c_nationkey").cast("string"))).alias("key_fingerprint"),
        whole.alias("limit_total"), (whole % 4000).alias("used"),
    )


@check(
    "budget_rule_violations", "F6",
    f"""WITH {_BUDGET}
      SELECT 'used_non_negative' AS rule, count(*) FILTER (WHERE used < 0) AS broken FROM budget
      UNION ALL SELECT 'limit_non_negative', count(*) FILTER (WHERE limit_total < 0) FROM budget
      UNION ALL SELECT 'used_within_limit', count(*) FILTER (WHERE used > limit_total) FROM budget
      UNION ALL SELECT 'purpose_known', count(*) FILTER (WHERE purpose NOT IN ('discover', 'refresh')) FROM budget
      UNION ALL SELECT 'fingerprint_is_digest', count(*) FILTER (WHERE NOT (key_fingerprint = '' OR regexp_matches(key_fingerprint, '^[0-9a-f]{{12}}$'))) FROM budget""",
)
def _(d: Domain):
    return audit.violations(_budget(d), audit.budget_rules())


@check(
    "rows_breaking_rules", "F6",
    sql("""SELECT business_id, concat_ws(',', CASE WHEN my_verdict IS NOT NULL AND my_verdict NOT IN ('high', 'medium', 'low', 'skip') THEN 'verdict_known' END,
              CASE WHEN outcome IS NOT NULL AND outcome NOT IN ('not_contacted', 'shortlisted', 'contacted', 'replied', 'follow_up', 'not_interested', 'converted') THEN 'outcome_known' END,
              CASE WHEN length(coalesce(notes, '')) > 5000 THEN 'notes_length' END) AS broken_rules
           FROM (SELECT business_id, CASE WHEN notes = '' THEN 'HIGH' ELSE my_verdict END AS my_verdict, notes, CASE WHEN outcome IS NULL THEN channel ELSE outcome END AS outcome FROM verdicts)
           WHERE broken_rules <> ''""".replace("WHERE broken_rules <> ''", "WHERE my_verdict = 'HIGH' OR outcome = 'call'"), "verdicts"),
)
def _(d: Domain):
    staged = d.verdicts.withColumn(
        "my_verdict", F.when(F.col("notes") == "", "HIGH").otherwise(F.col("my_verdict"))
    ).withColumn("outcome", F.coalesce("outcome", "channel"))
    return audit.broken_rows(staged, audit.verdict_rules()).select(
        "business_id", F.array_join("broken_rules", ",").alias("broken_rules")
    )


@check(
    "niche_status_rule_violations", "F6",
    """SELECT 'state_known' AS rule, count(*) FILTER (WHERE event_type NOT IN ('view', 'click')) AS broken FROM events
       UNION ALL SELECT 'counts_non_negative', count(*) FILTER (WHERE value < 10) FROM events
       UNION ALL SELECT 'rejected_types_is_object', count(*) FILTER (WHERE event_type = 'error') FROM events""",
)
def _(d: Domain):
    kind = F.col("event_type")
    staged = d.table("events").select(
        F.when(kind == "view", "verified").when(kind == "click", "starved").otherwise(kind).alias("state"),
        F.when(F.col("value") < 10, -1).otherwise(1).alias("qualified"), F.lit(0).alias("rejected"),
        F.when(kind == "error", F.concat(F.lit("["), "props", F.lit("]"))).otherwise(F.col("props")).alias("rejected_types"),
    )
    return audit.violations(staged, audit.niche_status_rules())


@check(
    "score_index_violations", "F6",
    "SELECT 'audience_index_range' AS rule, count(*) FILTER (WHERE o_totalprice / 400000 > 1) AS broken FROM orders",
)
def _(d: Domain):
    staged = d.table("orders").select((F.col("o_totalprice") / 400000).alias("audience_index"))
    return audit.violations(staged, audit.score_rules())


@check("duplicate_keys", "F6",
       "SELECT l_orderkey, l_suppkey, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def _(d: Domain):
    return audit.duplicate_keys(d.table("lineitem"), ["l_orderkey", "l_suppkey"])


@check("prompt_digests", "P21",
       "SELECT doc_id, sha256(text) AS prompt_hash, substr(sha256(source), 1, 12) AS fingerprint FROM documents")
def _(d: Domain):
    return d.table("documents").select(
        "doc_id", secrets.prompt_digest(F.col("text")).alias("prompt_hash"),
        secrets.key_fingerprint(F.col("source")).alias("fingerprint"),
    )


@check(
    "redacted_documents", "P22",
    r"""WITH r1 AS (SELECT doc_id, text, regexp_replace(text, '[a-zA-Z][a-zA-Z0-9+.\-]*://[^\s"''<>{}\\]+', '[redacted]', 'g') AS t FROM documents),
        r2 AS (SELECT *, regexp_replace(t, '(?i)\b(bearer|basic)\s+\S+', '\1 [redacted]', 'g') AS t2 FROM r1),
        r3 AS (SELECT *, regexp_replace(t2, '(?i)\b(api[_-]?key|apikey|access[_-]?token|auth[_-]?token|token|secret|password|authorization|x-api-key)\b\s*[=:]\s*\S+', '\1=[redacted]', 'g') AS t3 FROM r2),
        r4 AS (SELECT *, list_filter(regexp_extract_all(t3, '\b[A-Za-z0-9_\-]{20,}\b'), lambda x: regexp_matches(x, '[0-9]') AND regexp_matches(x, '[A-Za-z]')) AS runs FROM r3),
        r5 AS (SELECT *, list_reduce(list_prepend(t3, runs), lambda a, b: replace(a, b, '[redacted]')) AS t4 FROM r4)
        SELECT doc_id, t4 <> text AS changed, length(t4) AS chars, sha256(t4) AS digest FROM r5""",
)
def _(d: Domain):
    clean = d.spread("documents", "doc_id").select("doc_id", "text", secrets.redacted(F.col("text")).alias("t"))
    return clean.select(
        "doc_id", (F.col("t") != F.col("text")).alias("changed"),
        F.length("t").cast("bigint").alias("chars"), F.sha2("t", 256).alias("digest"),
    )


@check(
    "scrubbed_urls", "S12",
    """SELECT page_id, scrubbed, scrubbed <> url AS changed FROM (SELECT page_id, url, CASE WHEN contains(url, '?') AND contains(url, '=')
         THEN regexp_extract(url, '^([^?]*\\?)', 1) || array_to_string(list_transform(string_split(substr(url, strpos(url, '?') + 1), '&'),
              lambda p: CASE WHEN lower(split_part(p, '=', 1)) IN ('ref', 'utm_source') THEN split_part(p, '=', 1) || '=REDACTED' ELSE p END), '&') ELSE url END AS scrubbed FROM pages)""",
)
def _(d: Domain):
    clean = secrets.scrubbed_query(F.col("url"), ("ref", "utm_source"))
    return d.table("pages").select("page_id", clean.alias("scrubbed"), (clean != F.col("url")).alias("changed"))


@check(
    "scrubbed_payloads", "S12",
    """SELECT event_id, CASE WHEN event_type IN ('view', 'click') THEN '{"api_key":"REDACTED","n":1}' ELSE '{"id":"' || event_type || '","url":"http://x/?a=1&token=REDACTED&b=2"}' END AS payload FROM events""",
)
def _(d: Domain):
    kind = F.col("event_type")
    payload = F.when(
        kind.isin("view", "click"), F.concat(F.lit('{"api_key":'), "props", F.lit(',"n":1}'))
    ).otherwise(
        F.concat(
            F.lit('{"id":"'), kind, F.lit('","url":"http://x/?a=1&token='),
            F.col("event_id").cast("string"), F.lit('&b=2"}'),
        )
    )
    return d.table("events").select("event_id", secrets.scrubbed_json(payload).alias("payload"))


@check(
    "budget_remaining", "A10",
    f"""WITH {_BUDGET}, keys AS (SELECT DISTINCT provider, purpose AS key_fingerprint FROM budget UNION SELECT DISTINCT provider, key_fingerprint FROM budget)
      SELECT k.provider, k.key_fingerprint, CAST(sum(b.limit_total - b.used) AS BIGINT) AS remaining, count(b.provider) AS purposes
      FROM keys k LEFT JOIN budget b ON b.provider = k.provider AND b.key_fingerprint = k.key_fingerprint GROUP BY ALL""",
)
def _(d: Domain):
    budget = _budget(d)
    keys = budget.select("provider", F.col("purpose").alias("key_fingerprint")).unionByName(
        budget.select("provider", "key_fingerprint")
    )
    return ledger.remaining(budget, keys, ["provider", "key_fingerprint"])


_SHARES = {"discover": 0.7, "refresh": 0.2, "audit": 0.1}


@check(
    "split_allowances", "A10",
    """WITH parts AS (SELECT c_custkey, total, v.name, total * v.share - floor(total * v.share) AS rest, CAST(floor(total * v.share) AS BIGINT) AS part
          FROM (SELECT c_custkey, CAST(floor(abs(c_acctbal)) AS BIGINT) AS total FROM customer), (VALUES ('discover', 0.7::DOUBLE), ('refresh', 0.2::DOUBLE), ('audit', 0.1::DOUBLE)) v(name, share)),
        s AS (SELECT *, total - sum(part) OVER (PARTITION BY c_custkey) AS short, row_number() OVER (PARTITION BY c_custkey ORDER BY rest DESC, name) AS rn FROM parts)
        SELECT c_custkey, total, name AS purpose, part + CASE WHEN rn <= short THEN 1 ELSE 0 END AS part FROM s""",
)
def _(d: Domain):
    totals = d.table("customer").select("c_custkey", F.floor(F.abs("c_acctbal")).alias("total"))
    return ledger.split_allowance(totals, _SHARES)


@check(
    "over_allocated_keys", "A11",
    f"""WITH {_BUDGET} SELECT provider, key_fingerprint, CAST(sum(limit_total) AS BIGINT) AS granted, 40000::BIGINT AS allowance
        FROM budget GROUP BY 1, 2 HAVING sum(limit_total) > 40000""",
)
def _(d: Domain):
    budget = _budget(d)
    allowances = budget.select("provider", "key_fingerprint").distinct().withColumn(
        "allowance", F.lit(40000).cast("bigint")
    )
    return ledger.over_allocated(budget, allowances, ["provider", "key_fingerprint"])


@check(
    "merged_run_stats", "A12",
    """SELECT user_id AS run_id, string_agg(event_type || '=' || v, ',' ORDER BY event_type) AS stats FROM (
         SELECT user_id, event_type, json_extract_string(props, '$.k') AS v, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS rn FROM events)
       WHERE rn = 1 GROUP BY 1""",
)
def _(d: Domain):
    entries = d.table("events").select(
        F.col("user_id").alias("run_id"), F.col("event_type").alias("key"),
        F.get_json_object("props", "$.k").alias("value"), "ts", "event_id",
    )
    pairs = F.transform(F.map_entries("stats"), lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    return ledger.merged_stats(entries, "run_id", ["ts", "event_id"]).select(
        "run_id", F.array_join(F.array_sort(pairs), ",").alias("stats")
    )


_CALLS = """
calls AS (SELECT doc_id AS id, sha256(text) AS prompt_hash, source AS provider, lang AS model, CASE WHEN lang IN ('en', 'de') THEN 'ok' ELSE 'error' END AS status,
                 CASE WHEN n_chars > 300 THEN 'R' || CAST(doc_id AS VARCHAR) END AS response FROM documents)"""


def _calls(d: Domain):
    return d.table("documents").select(
        F.col("doc_id").alias("id"), secrets.prompt_digest(F.col("text")).alias("prompt_hash"),
        F.col("source").alias("provider"), F.col("lang").alias("model"),
        F.when(F.col("lang").isin("en", "de"), "ok").otherwise("error").alias("status"),
        F.when(F.col("n_chars") > 300, F.concat(F.lit("R"), F.col("doc_id").cast("string"))).alias("response"),
    )


@check(
    "cached_answers", "A14",
    f"""WITH {_CALLS} SELECT prompt_hash, id AS call_id, provider, model, response FROM (SELECT *, row_number() OVER (PARTITION BY prompt_hash ORDER BY id) AS rn
        FROM calls WHERE status = 'ok' AND response IS NOT NULL) WHERE rn = 1""",
)
def _(d: Domain):
    return ledger.cached_answers(_calls(d))


@check(
    "unpaid_prompts", "A14",
    f"WITH {_CALLS} SELECT id, prompt_hash FROM calls c WHERE NOT EXISTS (SELECT 1 FROM calls x WHERE x.prompt_hash = c.prompt_hash AND x.status = 'ok' AND x.response IS NOT NULL)",
)
def _(d: Domain):
    calls = _calls(d)
    return ledger.unpaid_prompts(calls.select("id", "prompt_hash"), ledger.cached_answers(calls))


@check("numbered_events", "W9",
       "SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS seq FROM events")
def _(d: Domain):
    return ledger.numbered_events(
        d.table("events").select("event_id", "user_id", "ts"), "user_id", ["ts", "event_id"]
    ).select("event_id", "user_id", "seq")


@check(
    "call_costs", "X4",
    """SELECT l_returnflag AS provider, l_linestatus AS model, CAST(l_shipdate AS DATE) AS day, count(*) AS calls, sum(l_quantity) AS tokens,
              round(sum(l_extendedprice), 2) AS cost, quantile_cont(l_quantity, 0.5) AS latency_p50, round(quantile_cont(l_quantity, 0.95), 6) AS latency_p95
       FROM lineitem GROUP BY 1, 2, 3""",
)
def _(d: Domain):
    calls = d.table("lineitem").select(
        F.col("l_returnflag").alias("provider"), F.col("l_linestatus").alias("model"),
        F.col("l_shipdate").cast("date").alias("day"), F.col("l_quantity").alias("tokens"),
        F.col("l_extendedprice").alias("cost"), F.col("l_quantity").alias("latency"),
    )
    return ledger.call_costs(calls, ["provider", "model", "day"]).withColumn(
        "cost", F.round("cost", 2)
    ).withColumn("latency_p95", F.round("latency_p95", 6))


@check(
    "call_latency_percentiles", "X4",
    """SELECT l_returnflag AS provider, count(*) AS n, round(quantile_cont(cents, 0.5), 3) AS p50, round(quantile_cont(cents, 0.95), 3) AS p95
       FROM (SELECT l_returnflag, CAST(round(l_extendedprice * 100) AS BIGINT) AS cents FROM lineitem) GROUP BY 1""",
)
def _(d: Domain):
    calls = d.table("lineitem").select(
        F.col("l_returnflag").alias("provider"), F.round(F.col("l_extendedprice") * 100).cast("bigint").alias("cents")
    )
    found = percentiles.exact_percentiles(calls, ["provider"], "cents", {"p50": 0.5, "p95": 0.95})
    return found.withColumns({c: F.round(c, 3) for c in ("p50", "p95")})


@check(
    "open_steps", "X6",
    """SELECT user_id, day, count(*) AS events, arg_max(event_type, event_id) AS last_type, max(ts) AS last_ts, max(event_id) AS last_event_id
       FROM (SELECT *, CAST(ts AS DATE) AS day FROM events) GROUP BY 1, 2 HAVING NOT bool_or(event_type IN ('purchase', 'signup'))""",
)
def _(d: Domain):
    events = d.table("events").select(
        "user_id", F.col("ts").cast("date").alias("day"), F.col("event_type").alias("type"), "ts", "event_id"
    )
    return ledger.open_steps(events, ["user_id", "day"], ["ts", "event_id"], ["purchase", "signup"])
