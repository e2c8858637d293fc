"""From raw listing pages to new, scored businesses of one pass."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from doorstep.functions.scoring import audience_index
from doorstep.operators import cells, identity, observe, qualify
from doorstep.sources import payloads
from doorstep.sources.registry import Profile


@dataclass(frozen=True)
class Discovery:
    """The tables one pass produces."""

    new_businesses: DataFrame
    scores: DataFrame
    observations: DataFrame
    outcomes: DataFrame
    rejected_types: DataFrame
    rejected_pages: DataFrame


def discover(
    responses: DataFrame,
    stored: DataFrame,
    profiles: tuple[Profile, ...],
    limit: int = 60,
    run_id: str | None = None,
) -> Discovery:
    """One pass over responses carrying search_no (sweep order), niche_id, city and raw.

    `profiles` are the categories that the pass asks for; they share `limit`.
    Qualify, drop placeholders, merge duplicates, keep what is not stored, cap per category,
    score and record the evidence.
    """
    keep = ("search_no", "niche_id", "city")
    listings = payloads.listing_rows(responses, keep=keep).withColumnRenamed("niche_id", "asked")
    assessed = qualify.assess(listings, profiles).where(F.col("niche_id") == F.col("asked"))
    asked = payloads.listing_pages(responses).where("page_ok").where(
        F.col("niche_id").isin([p.id for p in profiles])
    )
    counts = qualify.telemetry(assessed, ["search_no"], limit, asked)

    named = assessed.where("qualifies").where(F.col("name") != payloads.UNNAMED)
    c = F.col
    keyed = named.withColumn(
        "dedupe_key",
        identity.dedupe_key(
            c("name"), c("provider_id"), c("phone"), c("website"), c("address"), c("lat"), c("lng")
        ),
    ).withColumn(
        # Both are whole numbers of 32 bits, so no two places share an ordinal.
        "ordinal", F.shiftleft(c("search_no").cast("bigint"), 32) + c("position"),
    )
    records = keyed.withColumn("matched_niches", F.array("niche_id"))
    merged = identity.merge_duplicates(records)
    credited = identity.first_sightings(
        keyed.select("dedupe_key", "ordinal", "niche_id", "reviews", "rating"),
        "dedupe_key", ["ordinal"],
    ).drop("ordinal")
    candidates = merged.join(credited, "dedupe_key").withColumn("place_id", c("provider_id"))
    flagged = identity.mark_known(candidates, stored)
    fresh = cells.within_quota(
        flagged.where(~c("known")), "niche_id", [c("ordinal")], cells.quota(limit, len(profiles))
    )

    graded = qualify.scored(qualify.matched_profiles(fresh, profiles), profiles)
    scores = graded.select(
        "dedupe_key", F.lit("google-only").alias("scorer_version"), "score.*",
        audience_index(reviews=c("reviews")).alias("audience_index"),
    )
    return Discovery(
        new_businesses=fresh.drop("known", "kept_rank"),
        scores=scores,
        observations=observe.observation_rows(
            fresh, ["reviews", "rating"], "google_maps", run_id, ["dedupe_key"]
        ),
        outcomes=qualify.outcome_report(counts, flagged),
        rejected_types=qualify.rejected_types(assessed, profiles, ["search_no"]),
        rejected_pages=payloads.rejected_pages(responses),
    )
