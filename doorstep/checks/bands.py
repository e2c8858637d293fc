"""Cohort bands and latest rows."""

from pyspark.sql import functions as F

from doorstep.checks import check
from doorstep.checks.domain import COHORT, Domain, sql
from doorstep.operators import bands
from doorstep.operators.ordering import latest_per_key, rank_within


def band_table(d: Domain, city: str = "city"):
    """Bands of all businesses, with cohorts by city or by state."""
    businesses = d.businesses.withColumn("city", F.col(city))
    members = bands.cohort_members(
        businesses,
        bands.latest_scores(d.scores),
        bands.latest_reviews(
            d.observations,
            (F.col("source") == "google_maps") & (F.col("status") == "ok"),
            F.get_json_object("data", "$.reviews"),
        ),
    )
    return bands.cohort_bands(members)


_OUT = """SELECT business_id, name, niche_id, city, search_area, audience_index, reviews, total,
 scorer_version, scored_at, cohort_size, banding_method, audience_band FROM lead_bands"""


@check("cohort_bands_small_cohorts", "W1 W2 W3 W4 J1 A15 P15 S8", sql(_OUT, *COHORT))
def _(d: Domain):
    return band_table(d)


@check("cohort_bands_large_cohorts", "W1 W2 W3 W4 J1 A15", sql(_OUT, *COHORT, city="state"))
def _(d: Domain):
    return band_table(d, "state")


@check(
    "band_counts", "W4",
    sql(
        """SELECT niche_id, city, banding_method, audience_band, count(*) AS businesses
           FROM lead_bands GROUP BY ALL""", *COHORT, city="state",
    ),
)
def _(d: Domain):
    return (
        band_table(d, "state")
        .groupBy("niche_id", "city", "banding_method", "audience_band")
        .agg(F.count(F.lit(1)).alias("businesses"))
    )


@check(
    "cohort_sizes", "W2 A15",
    sql(
        "SELECT business_id, cohort_size FROM cohort",
        "businesses", "observations", "scores", "latest_score", "latest_reviews", "cohort",
        city="state",
    ),
)
def _(d: Domain):
    members = bands.cohort_members(
        d.businesses.withColumn("city", F.col("state")), bands.latest_scores(d.scores),
        d.observations.select("business_id", F.lit(None).cast("int").alias("reviews")).where("false"),
    )
    return bands.with_cohort_rank(members).select("business_id", "cohort_size")


@check(
    "tiles_of_three", "W3",
    sql("""SELECT id, ntile(3) OVER (PARTITION BY scorer_version ORDER BY audience_index, id) AS tile
           FROM scores WHERE audience_index IS NOT NULL""", "scores"),
)
def _(d: Domain):
    from doorstep.operators.ordering import tile

    scored = d.scores.where(F.col("audience_index").isNotNull())
    ranked = rank_within(scored, ["scorer_version"], [F.col("audience_index"), F.col("id")])
    sizes = scored.groupBy("scorer_version").agg(F.count(F.lit(1)).alias("n"))
    return ranked.join(sizes, "scorer_version").select("id", tile(F.col("rank"), F.col("n"), 3).alias("tile"))


@check(
    "latest_score", "W1",
    sql("SELECT business_id, audience_index, scorer_version, total, scored_at FROM latest_score",
        "scores", "latest_score"),
)
def _(d: Domain):
    return bands.latest_scores(d.scores)


@check(
    "latest_observation", "W1",
    sql("""SELECT business_id, source, id, status, fetched_at FROM (
             SELECT *, row_number() OVER (PARTITION BY business_id, source ORDER BY fetched_at DESC, id DESC) AS rn
             FROM observations) WHERE rn = 1""", "observations"),
)
def _(d: Domain):
    return latest_per_key(
        d.observations, ["business_id", "source"], ["fetched_at", "id"], ["id", "status", "fetched_at"]
    )
