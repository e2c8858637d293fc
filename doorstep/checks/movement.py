"""Coverage, growth, snapshot differences, memory recall."""

from pyspark.sql import functions as F

from doorstep.checks import check
from doorstep.checks.domain import Domain, sql
from doorstep.operators import recall, trends
from doorstep.session import fresh_path
from doorstep.sources import snapshots


@check(
    "coverage", "X1",
    """SELECT c_nationkey, c_mktsegment, count(*) AS found, count(*) FILTER (WHERE c_acctbal > 5000) AS new_in_last_run,
              CAST(date_diff('day', max(last_order), DATE '2003-01-01') AS INTEGER) AS days_since_swept
       FROM customer LEFT JOIN (SELECT o_custkey, max(CAST(o_orderdate AS DATE)) AS last_order FROM orders GROUP BY 1) ON o_custkey = c_custkey GROUP BY 1, 2""",
)
def _(d: Domain):
    swept = d.table("orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max("o_orderdate").alias("swept_at"))
    records = d.table("customer").join(swept, "c_custkey", "left").withColumn("in_last_run", F.col("c_acctbal") > 5000)
    return trends.coverage(records, ["c_nationkey", "c_mktsegment"], F.lit("2003-01-01").cast("date"))


_SERIES = """
series AS (
  SELECT business_id, id, fetched_at, reviews, lag(reviews) OVER (PARTITION BY business_id ORDER BY fetched_at, id) AS previous FROM (
    SELECT business_id, id, fetched_at, CASE WHEN k % 7 <> 0 THEN CAST(k * 8 AS INTEGER) END AS reviews FROM observations WHERE source = 'google_maps')
  WHERE reviews IS NOT NULL)"""


def _growth(d: Domain):
    from doorstep.functions.casts import digits_only

    series = d.observations.where(F.col("source") == "google_maps").select(
        "business_id", "id", "fetched_at", digits_only(F.get_json_object("data", "$.reviews")).alias("reviews")
    )
    return trends.growth(series, "business_id", "reviews")


@check("review_growth", "X2",
       sql("\n@@SELECT business_id, id, fetched_at, reviews, previous, reviews - previous AS change FROM series", "observations").replace("\n\n@@", "," + _SERIES + "\n"))
def _(d: Domain):
    return _growth(d)


@check("review_growth_summary", "X2",
       sql("""\n@@SELECT business_id, count(*) AS observations, arg_min(reviews, (fetched_at, id)) AS first_value, arg_max(reviews, (fetched_at, id)) AS last_value,
              max(reviews - previous) AS largest_rise FROM series GROUP BY 1""", "observations").replace("\n\n@@", "," + _SERIES + "\n"))
def _(d: Domain):
    return trends.growth_summary(_growth(d), "business_id", "reviews")


_BAND = "CASE WHEN max(o_totalprice) < 200000 THEN 'small' WHEN max(o_totalprice) < 350000 THEN 'medium' ELSE 'large' END"
_SNAPSHOTS = f"""
old AS (SELECT o_custkey AS k, {_BAND} AS band, min(o_orderpriority) AS priority FROM orders WHERE o_orderdate < TIMESTAMP '1996-01-01' GROUP BY 1),
new AS (SELECT o_custkey AS k, {_BAND} AS band, min(o_orderpriority) AS priority FROM orders WHERE o_orderdate >= TIMESTAMP '1996-01-01' AND o_orderstatus <> 'P' GROUP BY 1),
diff AS (
  SELECT coalesce(n.k, o.k) AS business_id, CASE WHEN o.k IS NULL THEN 'found' WHEN n.k IS NULL THEN 'gone'
           WHEN o.band IS DISTINCT FROM n.band OR o.priority IS DISTINCT FROM n.priority THEN 'changed' ELSE 'same' END AS action,
         o.band AS old_band, n.band AS new_band, o.priority AS old_priority, n.priority AS new_priority
  FROM old o FULL JOIN new n ON n.k = o.k),
level AS (SELECT * FROM (VALUES ('small', 0), ('medium', 1), ('large', 2)) v(band, l))"""


def _snapshots(d: Domain):
    orders = d.table("orders")
    top = F.max("o_totalprice")
    band = F.when(top < 200000, "small").when(top < 350000, "medium").otherwise("large")

    def snapshot(rows):
        return rows.groupBy(F.col("o_custkey").alias("business_id")).agg(
            band.alias("band"), F.min("o_orderpriority").alias("priority")
        )

    cut = F.lit("1996-01-01").cast("timestamp_ntz")
    before = snapshot(orders.where(F.col("o_orderdate") < cut))
    return before, snapshot(orders.where((F.col("o_orderdate") >= cut) & (F.col("o_orderstatus") != "P")))


def _diff(d: Domain):
    return trends.snapshot_diff(*_snapshots(d), "business_id", ["band", "priority"])


@check("snapshot_changes", "S11 X3",
       f"""WITH {_SNAPSHOTS} SELECT *, CASE WHEN action = 'changed' THEN concat_ws(',', CASE WHEN old_band IS DISTINCT FROM new_band THEN 'band' END,
             CASE WHEN old_priority IS DISTINCT FROM new_priority THEN 'priority' END) ELSE '' END AS columns FROM diff WHERE action <> 'same'""")
def _(d: Domain):
    path, days, tables = fresh_path(d.spark, "days"), ("1996-01-01", "1998-12-31"), _snapshots(d)
    for day, rows in zip(days, tables):
        snapshots.write_day(rows, path, day, "business_id", 64)
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in tables[0].schema)
    diff = snapshots.changes(d.spark, path, *days, schema, "business_id", ["band", "priority"])
    return diff.withColumn("columns", F.array_join("columns", ","))


@check("snapshot_differences", "X3",
       f"""WITH {_SNAPSHOTS} SELECT *, CASE WHEN action = 'changed' THEN concat_ws(',', CASE WHEN old_band IS DISTINCT FROM new_band THEN 'band' END,
             CASE WHEN old_priority IS DISTINCT FROM new_priority THEN 'priority' END) ELSE '' END AS columns FROM diff""")
def _(d: Domain):
    return _diff(d).withColumn("columns", F.array_join("columns", ","))


@check("band_movements", "X3",
       f"""WITH {_SNAPSHOTS} SELECT action, CASE WHEN b.l > a.l THEN 'up' WHEN b.l < a.l THEN 'down' WHEN b.l = a.l THEN 'same' END AS movement, count(*) AS n
           FROM diff LEFT JOIN level a ON a.band = old_band LEFT JOIN level b ON b.band = new_band GROUP BY ALL""")
def _(d: Domain):
    movement = trends.band_movement(F.col("old_band"), F.col("new_band"))
    return _diff(d).groupBy("action", movement.alias("movement")).agg(F.count(F.lit(1)).alias("n"))


@check(
    "memory_recall", "X5",
    """WITH asked AS (SELECT label AS scope, min(vec_id) AS question_id FROM embeddings GROUP BY 1),
       q AS (SELECT a.scope, a.question_id, e.embedding AS qv FROM asked a JOIN embeddings e ON e.vec_id = a.question_id),
       s AS (SELECT q.question_id, m.vec_id AS memory_id, m.label AS scope, list_cosine_similarity(m.embedding::DOUBLE[], q.qv::DOUBLE[]) AS sim FROM embeddings m JOIN q ON q.scope = m.label)
       SELECT question_id, memory_id, scope, round(sim, 6) AS similarity, rank FROM (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY sim DESC, memory_id) AS rank FROM s) WHERE rank <= 10""",
)
def _(d: Domain):
    return recall.nearest(*_memories(d), 10).withColumn("similarity", F.round("similarity", 6))


def _memories(d: Domain):
    e = d.table("embeddings")
    memories = e.select(F.col("vec_id").alias("id"), F.col("label").alias("scope"), "embedding")
    asked = e.groupBy(F.col("label").alias("scope")).agg(
        F.min("vec_id").alias("question_id"), F.min_by("embedding", "vec_id").alias("embedding")
    )
    return memories, asked


#: Small buckets, so that the given tables fill several and are probed across them.
SKETCH = recall.Sketch(64, bucket_rows=100)


def _indexed(d: Domain, **options):
    memories, asked = _memories(d)
    path = fresh_path(d.spark, "memories")
    recall.build_index(memories, path, SKETCH)
    return recall.nearest_indexed(d.spark, path, asked, 10, SKETCH, **options)


@check("memory_recall_indexed", "X5")
def _(d: Domain):
    """The same questions through the index."""
    return _indexed(d).withColumn("similarity", F.round("similarity", 6))


@check("memory_recall_of_index", "X5",
       """SELECT count(DISTINCT label) AS questions, true AS at_least_nine_tenths FROM embeddings WHERE label IS NOT NULL""")
def _(d: Domain):
    """How much of the exact answer the index finds."""
    exact = recall.nearest(*_memories(d), 10)
    found = _indexed(d).select("question_id", "memory_id", F.lit(True).alias("found"))
    return exact.join(found, ["question_id", "memory_id"], "left").agg(
        F.countDistinct("question_id").alias("questions"),
        (F.count("found") >= 0.9 * F.count(F.lit(1))).alias("at_least_nine_tenths"),
    )
