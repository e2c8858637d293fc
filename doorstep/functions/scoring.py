"""Listing score, audience index and pitch angle as Column expressions."""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column
from pyspark.sql import functions as F

from doorstep.functions.text import any_marker, present
from doorstep.functions.urls import (
    FREE_BUILDER_MARKERS,
    SOCIAL_DOMAINS,
    authority,
    under_any,
)

# Points per part of the listing score, and each part's ceiling.
DEMAND_CEILING, BUDGET_CEILING, REACH_CEILING = 30, 25, 20
DEMAND_UNMATCHED, BUDGET_UNMATCHED = 12, 10

# Weight and full mark of each audience component.
AUDIENCE_WEIGHTS = {
    "reviews": 0.40,
    "followers": 0.30,
    "engagement_rate": 0.20,
    "popular_times_density": 0.10,
}


def website_class(
    website: Column,
    social: tuple[str, ...] = SOCIAL_DOMAINS,
    markers: tuple[str, ...] = FREE_BUILDER_MARKERS,
) -> Column:
    """`no website`, `social-only`, `weak/free website` or `has website`."""
    return (
        F.when(present(website).isNull(), "no website")
        .when(under_any(authority(website), social), "social-only")
        .when(any_marker(F.lower(website), markers), "weak/free website")
        .otherwise("has website")
    )


def listing_score(
    *,
    profile_count: Column,
    demand_base: Column,
    budget_base: Column,
    profile_signals: Column,
    label_count: Column,
    website: Column,
    phone: Column,
    source_url: Column,
    social: tuple[str, ...] = SOCIAL_DOMAINS,
    markers: tuple[str, ...] = FREE_BUILDER_MARKERS,
) -> Column:
    """Struct of demand, website_gap, budget, reachability, total and ordered signals.

    `demand_base` and `budget_base` are the best of the matched profiles; `profile_signals`
    names each matched profile.
    """
    matched = profile_count > 0
    several = profile_count > 1
    detailed = label_count > 1
    site = website_class(website, social, markers)
    has_phone = present(phone).isNotNull()
    has_site = present(website).isNotNull()

    def points(condition: Column, value: int) -> Column:
        return F.when(condition, value).otherwise(0)

    demand = F.least(
        F.lit(DEMAND_CEILING),
        F.when(matched, demand_base + 4 + points(several, 2)).otherwise(DEMAND_UNMATCHED)
        + points(detailed, 2),
    )
    gap = (
        F.when(site == "no website", 25)
        .when(site == "social-only", 23)
        .when(site == "weak/free website", 18)
        .otherwise(8)
    )
    budget = F.least(
        F.lit(BUDGET_CEILING),
        F.when(matched, budget_base).otherwise(BUDGET_UNMATCHED)
        + points(detailed, 2)
        + points(site == "social-only", 2)
        + points(has_phone, 2)
        + points(present(source_url).isNotNull(), 1),
    )
    reach = F.least(F.lit(REACH_CEILING), 6 + points(has_phone, 10) + points(has_site, 4))
    signals = F.array_distinct(
        F.concat(
            F.when(matched, profile_signals).otherwise(F.array().cast("array<string>")),
            F.array_compact(
                F.array(
                    F.when(matched & several, "multiple service fit"),
                    F.when(detailed, "detailed business listing"),
                    site,
                    F.when(has_phone, "public phone"),
                    F.when(has_site, "public web link"),
                )
            ),
        )
    )
    return F.struct(
        demand.cast("int").alias("demand"),
        gap.cast("int").alias("website_gap"),
        budget.cast("int").alias("budget"),
        reach.cast("int").alias("reachability"),
        (demand + gap + budget + reach).cast("int").alias("total"),
        signals.alias("signals"),
    )


def audience_index(
    reviews: Column | None = None,
    followers: Column | None = None,
    engagement_rate: Column | None = None,
    popular_times_density: Column | None = None,
) -> Column:
    """Audience size in [0, 1]; weights renormalise over what is known, NULL for nothing."""

    def heavy_tail(count: Column, decades: float) -> Column:
        return F.log10(1 + F.greatest(count, F.lit(0))) / decades

    parts = {}
    if reviews is not None:
        parts["reviews"] = (reviews, heavy_tail(reviews, 4.0))
    if followers is not None:
        parts["followers"] = (followers, heavy_tail(followers, 5.0))
    if engagement_rate is not None:
        parts["engagement_rate"] = (engagement_rate, engagement_rate / 0.10)
    if popular_times_density is not None:
        parts["popular_times_density"] = (popular_times_density, popular_times_density / 100.0)

    earned, weight = [], []
    for name, (measured, value) in parts.items():
        share = F.lit(AUDIENCE_WEIGHTS[name])
        clamped = F.least(F.lit(1.0), F.greatest(F.lit(0.0), value))
        earned.append(F.when(measured.isNotNull(), share * clamped).otherwise(0.0))
        weight.append(F.when(measured.isNotNull(), share).otherwise(0.0))
    total = reduce(add, weight)
    return F.when(total > 0, reduce(add, earned) / total)


def pitch_angle(signals: Column, profile_id: Column, offer: Column) -> Column:
    """What to pitch, from the first profile and the website signal."""
    # The wordings.
    what = F.coalesce(offer, F.lit("clear services, lead capture, and automated follow-up"))
    unsited = F.array_contains(signals, "no website") | F.array_contains(signals, "social-only")
    weak = F.array_contains(signals, "weak/free website")
    return (
        F.when(
            F.coalesce(profile_id.isin("bakery", "cake_shop"), F.lit(False)) & unsited,
            "Pitch a catalog + advance payment order system for structured custom orders.",
        )
        .when(unsited, F.format_string("Pitch %s through a focused mobile-first website.", what))
        .when(weak, F.format_string("Pitch replacing the weak website with %s.", what))
        .otherwise(F.format_string("Pitch a conversion upgrade focused on %s.", what))
    )


def qualification_summary(
    name: Column, niche: Column, place: Column, signals: Column, offer: Column
) -> Column:
    """Third-person summary of one record; states validated fields only."""
    # The wordings.
    seen = F.coalesce(
        F.nullif(F.array_join(signals, ", "), F.lit("")), F.lit("limited public listing data")
    )
    return F.format_string(
        "%s is a %s lead in %s. Observed signals are %s. The recommended offer is %s.",
        name, niche, place, seen, offer,
    )


def outreach_message(
    name: Column, niche: Column, place: Column, offer: Column, sender: str = ""
) -> Column:
    """Deterministic first message to a business."""
    # The wordings.
    body = F.format_string(
        "Hi %s,\n\n"
        "I came across your %s listing in %s. I help local businesses set up practical online "
        "systems for %s, so customer enquiries are easier to convert and manage.\n\n"
        "Would you like me to send a short three-point audit based only on your current public "
        "listing?",
        name, niche, place, offer,
    )
    return F.concat(body, F.lit(f"\n\nBest,\n{sender}")) if sender else body


def threshold_band(
    reviews: Column, followers: Column, engagement_rate: Column, dense_times: Column,
    promote_at: float, demote_at: float,
) -> Column:
    """Fixed-threshold band, moved one step by engagement and one up by dense times."""
    # 100 and 500 reviews, 2,000 and 15,000 followers.
    seen_reviews, seen_followers = F.coalesce(reviews, F.lit(0)), F.coalesce(followers, F.lit(0))
    base = (
        F.when(reviews.isNull() & followers.isNull(), None)
        .when((seen_reviews > 500) | (seen_followers > 15000), 2)
        .when((seen_reviews >= 100) | (seen_followers >= 2000), 1)
        .otherwise(0)
    )
    step = F.when(engagement_rate >= promote_at, 1).when(engagement_rate < demote_at, -1)
    moved = base + F.coalesce(step, F.lit(0)) + F.when(dense_times, 1).otherwise(0)
    level = F.least(F.lit(2), F.greatest(F.lit(0), moved))
    return (
        F.when(base.isNull(), "unknown")
        .when(level == 0, "small")
        .when(level == 1, "medium")
        .otherwise("large")
    )
