"""The operator's sheet: records, cells, order, and the reconcile with what was typed in."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from doorstep.functions.casts import as_flag, as_float, as_int, as_list, joined, yes_no
from doorstep.functions.pages import profile_link
from doorstep.functions.text import folded, present, trimmed
from doorstep.operators.ordering import (
    latest_per_key,
    latest_per_source,
    rank_within,
)

# The sheet's columns by group.
COLUMN_GROUPS = {
    "identity": ("business_name", "niche", "business_type"),
    "geography": ("country", "state", "city", "search_area", "address", "lat", "lng"),
    "contact": ("phone", "email", "website", "instagram_handle", "facebook_url"),
    "people": (
        "contact_name", "contact_role", "contact_phone", "contact_email", "contact_source",
    ),
    "evidence": ("reviews", "rating", "followers", "engagement_rate", "runs_ads", "peak_hours"),
    "agent": (
        "total_score", "audience_band", "banding_method", "signals", "ai_summary",
        "website_pitch",
    ),
    "automation": ("automation_opportunities", "automation_pitch"),
    "operator": ("my_verdict", "notes", "contacted_on", "channel", "outcome"),
}
COLUMNS = tuple(name for names in COLUMN_GROUPS.values() for name in names)
OPERATOR_COLUMNS = COLUMN_GROUPS["operator"]
LISTING_EVIDENCE = ("reviews", "rating", "peak_hours")
PROFILE_EVIDENCE = ("followers", "engagement_rate")


def best_contacts(contacts: DataFrame) -> DataFrame:
    """Most trusted contact of each business, newest as the tiebreak."""
    best = latest_per_key(
        contacts, "business_id", ["confidence", "found_at", "id"],
        ["name", "role", "phone", "email", "source"],
    )
    return best.select(
        "business_id", *[F.col(c).alias(f"contact_{c}") for c in ("name", "role", "phone", "email", "source")]
    )


def offer_lists(opportunities: DataFrame) -> DataFrame:
    """Offer ids of each business, most confident first. Offers are few per business."""
    ordered = F.array_sort(
        F.collect_list(F.struct((-F.col("confidence")).alias("o"), "opportunity_id"))
    )
    return opportunities.groupBy("business_id").agg(
        F.transform(ordered, lambda e: e["opportunity_id"]).alias("opportunity_ids")
    )


def latest_drafts(outreach: DataFrame) -> DataFrame:
    """Latest website and automation pitch of each business, in one aggregate."""
    picked = latest_per_source(
        outreach, "business_id", ["created_at", "id"],
        {
            "_wp": (F.col("kind") == "website_pitch", ["body"]),
            "_ap": (F.col("kind") == "automation_pitch", ["body"]),
        },
    )
    return picked.select(
        "business_id",
        F.col("_wp.body").alias("website_pitch"),
        F.col("_ap.body").alias("automation_pitch"),
    )


def latest_observations(observations: DataFrame, sources: dict[str, str]) -> DataFrame:
    """Latest good payload and url per business and source; one scan for all sources."""
    good = F.col("status") == "ok"
    return latest_per_source(
        observations, "business_id", ["fetched_at", "id"],
        {
            name: (good & (F.col("source") == source), ["data", "source_url"])
            for name, source in sources.items()
        },
    )


def lead_records(
    businesses: DataFrame,
    bands: DataFrame,
    verdicts: DataFrame,
    contacts: DataFrame,
    observations: DataFrame,
    scores: DataFrame,
    opportunities: DataFrame,
    outreach: DataFrame,
    niche_labels: DataFrame | None = None,
) -> DataFrame:
    """Every business with all its sheet fields, untrimmed and typed.

    Each child table is folded to one row per business and joined on the business, so all
    joins share one partitioning.
    """
    seen = latest_observations(
        observations,
        {"g": "google_maps", "ih": "instagram_handle", "ip": "instagram_profile", "ad": "ad_library"},
    )
    drafted = latest_per_key(scores, "business_id", ["scored_at", "id"], ["signals", "evidence"])
    record = (
        businesses.join(
            bands.select(
                "business_id", "reviews", "total", "audience_band", "banding_method"
            ),
            "business_id", "left",
        )
        .join(verdicts.select("business_id", *OPERATOR_COLUMNS), "business_id", "left")
        .join(best_contacts(contacts), "business_id", "left")
        .join(seen, "business_id", "left")
        .join(drafted, "business_id", "left")
        .join(offer_lists(opportunities), "business_id", "left")
        .join(latest_drafts(outreach), "business_id", "left")
    )
    niche = F.col("niche_id")
    if niche_labels is not None:
        record = record.join(niche_labels.select("niche_id", "label"), "niche_id", "left")
        niche = F.coalesce("label", "niche_id")

    def said(struct: str, key: str) -> Column:
        return F.get_json_object(F.col(f"{struct}.data"), f"$.{key}")

    handle = F.coalesce("instagram_handle", said("ih", "handle"))
    values = {
        "business_name": F.col("name"), "niche": niche, "business_type": said("g", "type"),
        "lat": as_float(F.col("lat")), "lng": as_float(F.col("lng")),
        "instagram_handle": handle,
        "reviews": as_int(F.col("reviews")), "rating": as_float(said("g", "rating")),
        "followers": as_int(said("ip", "followers")),
        "engagement_rate": as_float(said("ip", "engagement_rate")),
        "runs_ads": as_flag(said("ad", "runs_ads")), "peak_hours": said("g", "peak_hours"),
        "total_score": as_int(F.col("total")), "signals": as_list(F.col("signals")),
        "ai_summary": F.get_json_object("evidence", "$.ai_summary"),
        "automation_opportunities": F.coalesce(
            "opportunity_ids", F.array().cast("array<string>")
        ),
    }
    return record.select(
        "business_id", "place_id",
        *[values.get(c, F.col(c)).alias(c) for c in COLUMNS],
        F.col("g.source_url").alias("listing_url"),
        F.coalesce("ip.source_url", "ih.source_url").alias("profile_url"),
    )


def sheet_cells(records: DataFrame) -> DataFrame:
    """Typed records to the sheet's cells: trimmed text, joined lists, yes/no, NULL for blank."""
    numbers = {"lat", "lng", "reviews", "rating", "followers", "engagement_rate", "total_score"}
    cells = {
        "runs_ads": yes_no(F.col("runs_ads")),
        "signals": joined(F.col("signals")),
        "automation_opportunities": joined(F.col("automation_opportunities")),
    }

    def cell(name: str) -> Column:
        if name in cells:
            return cells[name]
        if name in numbers:
            return F.col(name)
        return trimmed(F.col(name).cast("string"))

    others = [c for c in records.columns if c not in COLUMNS]
    return records.select(*others, *[cell(c).alias(c) for c in COLUMNS])


def evidence_sources(records: DataFrame, extra: Column | None = None) -> DataFrame:
    """Adds `sources`: sheet column to the url where its value can be checked."""

    def spread(columns: Sequence[str], url: Column) -> list[Column]:
        return [
            F.when(present(url).isNotNull(), F.struct(F.lit(c).alias("key"), url.alias("value")))
            for c in columns
        ]

    profile = F.coalesce(
        present(F.col("profile_url")), profile_link(F.col("instagram_handle"))
    )
    base = F.map_from_entries(
        F.array_compact(
            F.array(*spread(LISTING_EVIDENCE, F.col("listing_url")), *spread(PROFILE_EVIDENCE, profile))
        )
    )
    if extra is not None:
        stated = F.map_filter(extra, lambda _, url: present(url).isNotNull())
        base = F.map_concat(F.map_filter(base, lambda k, _: ~F.map_contains_key(stated, k)), stated)
    return records.withColumn("sources", base)


def reach_channel(
    contact_phone: Column, contact_name: Column, handle: Column, business_phone: Column,
    contact_email: Column, business_email: Column,
) -> Column:
    """Struct of the best channel, its value and a note; ranked by where it was published."""
    # The channels and notes.
    person = F.when(
        present(contact_name).isNotNull(),
        F.format_string(
            "published for a named contact (for %s) -- likely personal", contact_name
        ),
    ).otherwise("published for a named contact -- likely personal")

    def option(channel: str, value: Column, note: Column) -> Column:
        return F.when(
            present(value).isNotNull(),
            F.struct(
                F.lit(channel).alias("channel"), value.alias("value"), note.alias("note")
            ),
        )

    return F.coalesce(
        option("mobile", contact_phone, person),
        option("instagram", handle, F.lit("DM the business's own account")),
        option(
            "phone", business_phone,
            F.lit("the business's listed number -- mobile or landline is not knowable from this alone"),
        ),
        option("email", contact_email, F.lit("a named contact's own address")),
        option("email", business_email, F.lit("a general inbox, not a named person")),
        F.struct(
            F.lit("none").alias("channel"), F.lit(None).cast("string").alias("value"),
            F.lit(None).cast("string").alias("note"),
        ),
    )


def sheet_order(tie: str) -> list[Column]:
    """No area last; areas case-folded; unscored last in an area; best score first; name."""
    area = F.coalesce(trimmed(F.col("search_area")), F.lit(""))
    return [
        area == "", folded(area), F.col("total_score").isNull(),
        -F.coalesce("total_score", F.lit(0)),
        folded(F.coalesce(trimmed(F.col("business_name")), F.lit(""))), F.col(tie),
    ]


def ordered_sheet(records: DataFrame, tie: str = "business_id") -> DataFrame:
    """Adds `sheet_row`, the row's place in the whole sheet."""
    return rank_within(records, [], sheet_order(tie), "sheet_row")


def ranked_leads(scored: DataFrame, by: Sequence[str], tie: str) -> DataFrame:
    """Adds `lead_rank`: total, reachability, website gap, demand, all descending."""
    order = [-F.col(c) for c in ("total", "reachability", "website_gap", "demand")]
    return rank_within(scored, by, [*order, F.col(tie)], "lead_rank")


def clamp(value: int, low: int, high: int) -> int:
    return max(low, min(high, value))


def top_leads(leads: DataFrame, limit: int = 500, most: int = 2000) -> DataFrame:
    """The listing: best total first, then longest known."""
    return leads.orderBy(
        F.desc_nulls_last("score_total"), F.asc_nulls_last("first_seen_at"), F.asc("business_id")
    ).limit(clamp(limit, 1, most))


def top_runs(runs: DataFrame, limit: int = 50, most: int = 200) -> DataFrame:
    return runs.orderBy(F.desc_nulls_last("started_at"), F.desc("id")).limit(clamp(limit, 1, most))


def in_scope(
    leads: DataFrame,
    city: str | None = None,
    niche_ids: Sequence[str] | None = None,
    observations: DataFrame | None = None,
    run_id: object | None = None,
) -> DataFrame:
    """Optional scope: a parameter left out adds no predicate at all."""
    scoped = leads
    if city is not None:
        scoped = scoped.where(F.lower("city") == city.lower())
    if niche_ids is not None:
        scoped = scoped.where(F.col("niche_id").isin(*niche_ids))
    if run_id is not None:
        seen = observations.where(F.col("run_id") == run_id).select("business_id")
        scoped = scoped.join(seen, "business_id", "left_semi")
    return scoped


def sheet_rows_by_place(rows: DataFrame, row_number: str = "row_number") -> DataFrame:
    """Read-back rows keyed by place: blank places dropped, the last duplicate wins."""
    keyed = rows.withColumn("place_id", trimmed(F.col("place_id"))).where(
        F.col("place_id").isNotNull()
    )
    rest = [c for c in keyed.columns if c != "place_id"]
    return latest_per_key(keyed, "place_id", [row_number], rest)


def reconcile(
    master: DataFrame, batch: DataFrame, agent_columns: Sequence[str],
    operator_columns: Sequence[str] = OPERATOR_COLUMNS,
) -> DataFrame:
    """Master sheet after a batch: agent columns replaced, operator columns kept.

    Adds `action`: updated, appended or untouched.
    """
    columns = [*agent_columns, *operator_columns]
    old = master.select(F.col("place_id").alias("_old"), *[F.col(c).alias(f"_o_{c}") for c in columns])
    new = batch.select(F.col("place_id").alias("_new"), *[F.col(c).alias(f"_n_{c}") for c in columns])
    both = old.join(new, F.col("_old") == F.col("_new"), "full_outer")
    stored, sent = F.col("_old").isNotNull(), F.col("_new").isNotNull()
    return both.select(
        F.coalesce("_new", "_old").alias("place_id"),
        *[F.when(sent, F.col(f"_n_{c}")).otherwise(F.col(f"_o_{c}")).alias(c) for c in agent_columns],
        *[F.when(stored, F.col(f"_o_{c}")).otherwise(F.col(f"_n_{c}")).alias(c) for c in operator_columns],
        F.when(stored & sent, "updated").when(sent, "appended").otherwise("untouched").alias("action"),
    )


def verdicts_from_sheet(rows: DataFrame, businesses: DataFrame) -> DataFrame:
    """Sheet rows with a verdict, notes or outcome, as verdict rows by business."""
    said = (
        present(F.col("my_verdict")).isNotNull()
        | present(F.col("notes")).isNotNull()
        | present(F.col("outcome")).isNotNull()
    )
    return rows.where(said).join(
        businesses.select("place_id", "business_id"), "place_id"
    ).select("business_id", *[present(F.col(c).cast("string")).alias(c) for c in OPERATOR_COLUMNS])
