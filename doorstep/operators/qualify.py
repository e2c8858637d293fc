"""Which listings belong to which business category, and what the misses say."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from doorstep.functions.scoring import listing_score
from doorstep.functions.text import any_marker, compact, slugs
from doorstep.sources.payloads import FULL_PAGE, UNNAMED
from doorstep.sources.registry import Profile

STARVED_AT = 20
NAME_GATE = "_name_gate"


def slug_verdict(profile: Profile, slug: Column) -> Column:
    """1 qualifies, -1 disqualifies, 0 neutral.

    Exact include, exact exclude, exclude suffix, include suffix, in that order.
    """

    def member(values: tuple[str, ...]) -> Column:
        return slug.isin(*values) if values else F.lit(False)

    def ends(values: tuple[str, ...]) -> Column:
        return reduce(or_, [slug.endswith(v) for v in values], F.lit(False))

    return (
        F.when(member(profile.include_types), 1)
        .when(member(profile.exclude_types) | ends(profile.exclude_suffixes), -1)
        .when(ends(profile.include_suffixes), 1)
        .otherwise(0)
    )


def _assessment(profile: Profile, types: Column, evidence: Column) -> Column:
    """Struct of one category's verdict on one listing."""
    type_ok = F.exists(types, lambda s: slug_verdict(profile, s) == 1)
    fatal = F.exists(types, lambda s: slug_verdict(profile, s) == -1)
    name_ok = any_marker(evidence, profile.terms)
    if not profile.strict:
        matches = type_ok
    elif profile.allow_name_only:
        matches = name_ok
    else:
        matches = type_ok & name_ok
    return F.struct(
        F.lit(profile.id).alias("niche_id"),
        type_ok.alias("type_ok"),
        fatal.alias("fatal"),
        name_ok.alias("name_ok"),
        (~fatal & matches).alias("qualifies"),
    )


def assess(
    listings: DataFrame,
    profiles: tuple[Profile, ...],
    name: str = "name",
    category: str = "category",
    labels: str = "raw_categories",
) -> DataFrame:
    """Every listing against every category: `types` plus one verdict row per category.

    The registry is a parameter of the plan, so the whole theta join is a projection: no
    row leaves its task.
    """
    evidence = F.regexp_replace(
        F.lower(
            F.concat_ws(" ", F.array(name, category), F.coalesce(labels, F.array().cast("array<string>")))
        ),
        r"[_\-.]+", " ",
    )
    staged = listings.select(
        "*", slugs(F.col(category), F.col(labels)).alias("types"), evidence.alias("_evidence")
    )
    verdicts = F.array(*[_assessment(p, F.col("types"), F.col("_evidence")) for p in profiles])
    kept = [c for c in staged.columns if c != "_evidence"]
    return staged.select(*kept, F.inline(verdicts))


def qualifying(listings: DataFrame, profiles: tuple[Profile, ...], **columns: str) -> DataFrame:
    """(listing, category) pairs that match."""
    return assess(listings, profiles, **columns).where("qualifies")


def matched_profiles(
    listings: DataFrame,
    profiles: tuple[Profile, ...],
    matched: str = "matched_niches",
    name: str = "name",
    category: str = "category",
    labels: str = "raw_categories",
) -> DataFrame:
    """Adds `profile_ids`: the tagged categories that exist, else all that qualify."""
    known = [p.id for p in profiles]
    evidence = F.regexp_replace(
        F.lower(
            F.concat_ws(" ", F.array(name, category), F.coalesce(labels, F.array().cast("array<string>")))
        ),
        r"[_\-.]+", " ",
    )
    types = slugs(F.col(category), F.col(labels))
    tagged = F.filter(
        F.coalesce(matched, F.array().cast("array<string>")), lambda n: n.isin(*known)
    )
    staged = listings.select("*", types.alias("_types"), evidence.alias("_evidence"))
    fallback = F.array_compact(
        F.array(
            *[
                F.when(
                    _assessment(p, F.col("_types"), F.col("_evidence"))["qualifies"], F.lit(p.id)
                )
                for p in profiles
            ]
        )
    )
    return staged.withColumn(
        "profile_ids", F.when(F.size(tagged) > 0, tagged).otherwise(fallback)
    ).drop("_types", "_evidence")


def scored(
    listings: DataFrame, profiles: tuple[Profile, ...], labels: str = "raw_categories"
) -> DataFrame:
    """Adds the `score` struct to listings carrying `profile_ids`."""
    ids = F.col("profile_ids")

    def best(points: dict[str, int]) -> Column:
        table = F.create_map(*[F.lit(x) for pair in points.items() for x in pair])
        return F.array_max(F.transform(ids, lambda i: F.try_element_at(table, i)))

    names = F.create_map(*[F.lit(x) for p in profiles for x in (p.id, f"{p.label.lower()} match")])
    return listings.withColumn(
        "score",
        listing_score(
            profile_count=F.size(ids),
            demand_base=best({p.id: p.demand for p in profiles}),
            budget_base=best({p.id: p.budget for p in profiles}),
            profile_signals=F.transform(ids, lambda i: F.try_element_at(names, i)),
            label_count=F.size(F.coalesce(labels, F.array().cast("array<string>"))),
            website=F.col("website"),
            phone=F.col("phone"),
            source_url=F.col("source_url"),
        ),
    )


def telemetry(
    assessed: DataFrame, search: list[str], limit: int, searches: DataFrame | None = None
) -> DataFrame:
    """Per search and category: returned, qualified, rejected, named, gate misses, page hints.

    `qualified` leaves out nameless placeholders; `rejected` does not notice them. `searches`
    has `search` and niche_id of every good page: with it, a search without any place is a
    row of zeros too.
    """
    hit = F.col("qualifies")
    gated = ~hit & F.col("type_ok") & ~F.col("fatal")
    counts = assessed.groupBy(*search, "niche_id").agg(
        F.count(F.lit(1)).alias("returned"),
        F.count_if(hit).alias("_hits"),
        F.count_if(hit & (F.col("name") == UNNAMED)).alias("_nameless"),
        F.count_if(gated).alias("name_gate_rejected"),
    )
    if searches is not None:
        keys = [*search, "niche_id"]
        counts = searches.select(*keys).distinct().join(counts, keys, "left").fillna(
            0, ["returned", "_hits", "_nameless", "name_gate_rejected"]
        )
    return counts.select(
        *search, "niche_id", "returned",
        (F.col("_hits") - F.col("_nameless")).alias("qualified"),
        (F.col("returned") - F.col("_hits")).alias("rejected"),
        "name_gate_rejected",
        (F.col("returned") >= FULL_PAGE).alias("has_more"),
        F.greatest(F.col("_hits") - limit, F.lit(0)).alias("truncated"),
    )


def rejected_types(
    assessed: DataFrame, profiles: tuple[Profile, ...], search: list[str]
) -> DataFrame:
    """Per search and category: slug of refused listings that does not itself qualify, count."""
    verdict = F.lit(0)
    for p in profiles:
        verdict = F.when(F.col("niche_id") == p.id, slug_verdict(p, F.col("slug"))).otherwise(verdict)
    return (
        assessed.where(~F.col("qualifies"))
        .select(*search, "niche_id", F.explode("types").alias("slug"))
        .where(verdict != 1)
        .groupBy(*search, "niche_id", "slug")
        .agg(F.count(F.lit(1)).alias("times"))
    )


def state_of(qualified: Column, rejected: Column) -> Column:
    return (
        F.when(qualified > 0, "verified")
        .when(rejected >= STARVED_AT, "starved")
        .otherwise("unverified")
    )


def merged_status(totals: DataFrame, slug_counts: DataFrame) -> DataFrame:
    """Niche status over any number of passes: totals, state, per-slug counts as a map.

    `totals` has niche_id, qualified, rejected, name_gate_rejected, seen_at per pass;
    `slug_counts` has niche_id, slug, times per pass. Counts stay rows until they are summed;
    the map holds one entry per distinct slug.
    """
    sums = totals.groupBy("niche_id").agg(
        F.sum("qualified").alias("qualified"),
        F.sum("rejected").alias("rejected"),
        F.sum("name_gate_rejected").alias("name_gate_rejected"),
        F.max("seen_at").alias("last_seen_at"),
    )
    per_slug = slug_counts.groupBy("niche_id", "slug").agg(F.sum("times").alias("times"))
    maps = per_slug.groupBy("niche_id").agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("slug", "times")))).alias(
            "rejected_types"
        )
    )
    return sums.join(maps, "niche_id", "left").select(
        "niche_id",
        state_of(F.col("qualified"), F.col("rejected")).alias("state"),
        "qualified", "rejected", "name_gate_rejected",
        F.coalesce("rejected_types", F.create_map().cast("map<string,bigint>")).alias(
            "rejected_types"
        ),
        "last_seen_at",
    )


def worst_types(status: DataFrame) -> DataFrame:
    """Rejected slugs per niche, biggest count first, name-gate key left out, with rank."""
    entries = F.filter(F.map_entries("rejected_types"), lambda e: ~e["key"].startswith("_"))
    ordered = F.array_sort(
        F.transform(entries, lambda e: F.struct((-e["value"]).alias("n"), e["key"].alias("slug")))
    )
    return status.select("niche_id", "state", F.posexplode(ordered).alias("pos", "e")).select(
        "niche_id", "state",
        (F.col("pos") + 1).cast("bigint").alias("rank"),
        F.col("e.slug").alias("slug"),
        (-F.col("e.n")).alias("times"),
    )


def starved(status: DataFrame) -> DataFrame:
    return worst_types(status.where(F.col("state") == "starved"))


def with_state(profile_table: DataFrame, status: DataFrame) -> DataFrame:
    """The registry with each category's verification state; none recorded is unverified."""
    return profile_table.join(status.select("niche_id", "state"), "niche_id", "left").select(
        *profile_table.columns, F.coalesce("state", F.lit("unverified")).alias("state")
    )


def resolve_aliases(requested: DataFrame, aliases: DataFrame, value: str = "value",
                    position: str = "position", order: str = "place") -> tuple[DataFrame, DataFrame]:
    """(resolved, rejected): requested spellings to category ids, first mention only.

    A spelling registered twice belongs to its last registration by the aliases' `order`
    column, or to the greatest id where they have none.
    """
    registered = [F.col(c) for c in (order, "niche_id") if c in aliases.columns]
    known = aliases.groupBy(compact(F.col("spelling")).alias("_key")).agg(
        F.max_by("niche_id", F.struct(*registered)).alias("niche_id")
    )
    joined = requested.join(known, compact(F.col(value)) == F.col("_key"), "left").drop("_key")
    others = [c for c in requested.columns if c not in (value, position)]
    resolved = joined.where(F.col("niche_id").isNotNull()).groupBy(*others, "niche_id").agg(
        F.min(position).alias(position)
    )
    return resolved, joined.where(F.col("niche_id").isNull()).drop("niche_id")


def outcome_report(counts: DataFrame, flagged: DataFrame, niche: str = "niche_id") -> DataFrame:
    """Per category of one pass: searches, candidates, qualified, new, already stored, state.

    `counts` is `telemetry` (one row per search and category), `flagged` the qualified
    records with `known`.
    """
    spent = counts.groupBy(niche).agg(
        F.count(F.lit(1)).alias("searches"),
        F.sum(F.col("qualified") + F.col("rejected")).alias("candidates"),
        F.sum("qualified").alias("qualified"),
        F.sum("rejected").alias("_rejected"),
        F.sum("name_gate_rejected").alias("name_gate_rejected"),
    )
    gained = flagged.groupBy(niche).agg(
        F.count_if(~F.col("known")).alias("new_businesses"),
        F.count_if(F.col("known")).alias("already_stored"),
    )
    return spent.join(gained, niche, "left").select(
        niche, "searches", "candidates", "qualified",
        F.coalesce("new_businesses", F.lit(0)).alias("new_businesses"),
        F.coalesce("already_stored", F.lit(0)).alias("already_stored"),
        "name_gate_rejected",
        state_of(F.col("qualified"), F.col("_rejected")).alias("state"),
    )
