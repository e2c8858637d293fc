"""Which offers apply to which business, and on what evidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from doorstep.sources.registry import OBSERVED_SIGNALS, OFFERS, SCORER_SIGNALS, Offer

ELIGIBLE_VERDICTS = ("high", "medium")
KNOWN_SIGNALS = SCORER_SIGNALS + tuple(OBSERVED_SIGNALS)


def offers_for(niche: Column, offers: tuple[Offer, ...] = OFFERS) -> Column:
    """Ids of the offers on the table for a category, in catalogue order."""
    return F.array_compact(
        F.array(
            *[
                F.when(niche.isin(*o.niches), o.id) if o.niches else F.lit(o.id)
                for o in offers
            ]
        )
    )


def missing_signals(offer: Offer, observed: Column) -> Column:
    """Required signals that were not observed, in declared order."""
    required = F.array(*[F.lit(s) for s in offer.signals])
    return F.filter(required, lambda s: ~F.array_contains(observed, s))


def firing(
    businesses: DataFrame,
    niche: str = "niche_id",
    signals: str = "signals",
    offers: tuple[Offer, ...] = OFFERS,
) -> DataFrame:
    """One row per offer that fires, from a signals array per business. Shuffle-free."""
    held = F.col(signals)
    hits = F.array_compact(
        F.array(
            *[
                F.when(
                    (F.col(niche).isin(*o.niches) if o.niches else F.lit(True))
                    & (F.size(missing_signals(o, held)) == 0),
                    F.struct(
                        F.lit(i).alias("position"), F.lit(o.id).alias("offer_id"),
                        F.array(*[F.lit(s) for s in o.signals]).alias("required"),
                    ),
                )
                for i, o in enumerate(offers)
            ]
        )
    )
    return businesses.select("*", F.inline(hits))


def firing_from_rows(
    observed: DataFrame, niches: DataFrame, offers: tuple[Offer, ...] = OFFERS,
    business: str = "business_id",
) -> DataFrame:
    """Relational division: (business, offer) whose every required signal was observed.

    `observed` has one row per business and signal observation, `niches` one row per
    business. Signals are made distinct first, which also folds a hot business per task.
    """
    spark = observed.sparkSession
    needs = spark.createDataFrame(
        [(o.id, s, len(o.signals), list(o.niches)) for o in offers for s in o.signals],
        "offer_id string, signal string, needed int, limited_to array<string>",
    )
    held = observed.select(business, "signal").distinct()
    complete = (
        held.join(F.broadcast(needs), "signal")
        .groupBy(business, "offer_id", "needed", "limited_to")
        .agg(F.count(F.lit(1)).alias("_held"))
        .where(F.col("_held") == F.col("needed"))
    )
    return complete.join(niches, business).where(
        (F.size("limited_to") == 0) | F.array_contains("limited_to", F.col("niche_id"))
    ).select(business, "niche_id", "offer_id")


def evidence_rows(
    fired: DataFrame, observed: DataFrame, offers: tuple[Offer, ...] = OFFERS,
    business: str = "business_id",
) -> DataFrame:
    """One row per fired offer, required signal and distinct observation behind it."""
    spark = fired.sparkSession
    needs = spark.createDataFrame(
        [(o.id, s) for o in offers for s in o.signals], "offer_id string, signal string"
    )
    claims = fired.select(business, "offer_id").join(F.broadcast(needs), "offer_id")
    rows = observed.select(business, "signal", "observation_id").distinct()
    return claims.join(rows, [business, "signal"]).select(
        business, "offer_id", "signal", "observation_id"
    )


def all_signals(
    scorer: Column, observed: Column, known: tuple[str, ...] = KNOWN_SIGNALS
) -> Column:
    """Union of both families, limited to the known vocabulary."""
    vocabulary = F.array(*[F.lit(s) for s in known])
    blank = F.array().cast("array<string>")
    return F.array_intersect(
        F.array_union(F.coalesce(scorer, blank), F.coalesce(observed, blank)), vocabulary
    )


def eligible(
    businesses: DataFrame, verdicts: DataFrame, values: tuple[str, ...] = ELIGIBLE_VERDICTS,
    business: str = "business_id",
) -> DataFrame:
    """Businesses the operator judged worth an offer."""
    worth = verdicts.where(F.col("my_verdict").isin(*values)).select(business)
    return businesses.join(worth, business, "left_semi")


def observed_signals(
    findings: DataFrame, business: str = "business_id"
) -> DataFrame:
    """Website verdict, grade gaps and ads to signals with the observation behind each.

    Columns: website_verdict, gaps (array), web_row, runs_ads, ads_row. No row id, no claim.
    """
    web, ads = F.col("web_row"), F.col("ads_row")
    gaps = F.coalesce("gaps", F.array().cast("array<string>"))

    def gap(name: str) -> Column:
        return F.array_contains(gaps, name)

    def claim(signal: str, when: Column, row: Column) -> Column:
        return F.when(
            F.coalesce(when, F.lit(False)) & row.isNotNull(),
            F.struct(F.lit(signal).alias("signal"), row.alias("observation_id")),
        )

    unsited = F.col("website_verdict").isin("none", "social_only")
    told = F.col("website_verdict").isNotNull()
    # Which finding asserts which signal.
    claims = F.array_compact(
        F.array(
            claim("no landing page", unsited | (gap("catalogue") & gap("enquiry") & told), web),
            claim("no online ordering", gap("ordering") & told, web),
            claim("no booking link", gap("enquiry") & told, web),
            claim("no enquiry form", gap("enquiry") & told, web),
            claim("manual enquiry flow", gap("enquiry") & told, web),
            claim("runs meta ads", F.col("runs_ads"), ads),
        )
    )
    return findings.select(business, F.inline(claims))
