"""From search results and page texts to findings, signals and offers of one pass."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from doorstep.functions.pages import site_grade
from doorstep.functions.scoring import website_class
from doorstep.operators import observe, offers, web
from doorstep.sources.registry import OFFERS, Offer


@dataclass(frozen=True)
class Enrichment:
    """The tables one pass produces."""

    verdicts: DataFrame
    handles: DataFrame
    contacts: DataFrame
    websites: DataFrame
    signals: DataFrame
    offers: DataFrame
    evidence: DataFrame


def enrich(
    businesses: DataFrame,
    results: DataFrame,
    pages: DataFrame,
    ads: DataFrame,
    operator_verdicts: DataFrame,
    catalogue: tuple[Offer, ...] = OFFERS,
) -> Enrichment:
    """Read one pass's answers.

    `businesses`: business_id, name, niche_id, phone, listed_website, listed_handle, searched.
    `results`: business_id, position, url, snippet. `pages`: business_id, url, text,
    observation_id. `ads`: business_id, runs_ads, observation_id.
    """
    verdicts = web.website_verdicts(results, businesses)
    site_texts = pages.join(verdicts.select("business_id", "url"), ["business_id", "url"])
    handles = web.best_handles(web.handle_candidates(businesses, site_texts, results))
    contacts = web.extracted_contacts(site_texts, keep=("business_id", "url"))
    grades = site_texts.select(
        "business_id", F.col("observation_id").alias("web_row"),
        site_grade(F.col("text")).alias("grade"),
    )
    findings = (
        businesses.select("business_id", "phone", "listed_website")
        .join(verdicts, "business_id")
        .join(grades, "business_id", "left")
        .join(
            ads.select("business_id", "runs_ads", F.col("observation_id").alias("ads_row")),
            "business_id", "left",
        )
    )
    observed = offers.observed_signals(
        findings.select(
            "business_id", F.col("verdict").alias("website_verdict"),
            F.col("grade.gaps").alias("gaps"), "web_row", "runs_ads", "ads_row",
        )
    )
    website = observe.effective_website(F.col("verdict"), F.col("url"), F.col("listed_website"))
    websites = findings.select("business_id", website.alias("website"), "phone")
    stated = websites.select(
        "business_id",
        F.explode(
            F.array_compact(
                F.array(
                    website_class(F.col("website")),
                    F.when(F.coalesce("phone", F.lit("")) != "", "public phone"),
                    F.when(F.coalesce("website", F.lit("")) != "", "public web link"),
                )
            )
        ).alias("signal"),
        F.lit(None).cast("bigint").alias("observation_id"),
    )
    worth = offers.eligible(
        observed.select("business_id", "signal", F.col("observation_id").cast("bigint")).unionByName(stated),
        operator_verdicts,
    )
    fired = offers.firing_from_rows(worth, businesses.select("business_id", "niche_id"), catalogue)
    return Enrichment(
        verdicts=verdicts,
        handles=handles,
        contacts=contacts,
        websites=websites,
        signals=observed,
        offers=fired,
        evidence=offers.evidence_rows(fired, worth, catalogue),
    )
