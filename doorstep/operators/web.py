"""What search results and page text say about a business."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from doorstep.functions.contacts import (
    SOURCE_CONFIDENCE,
    ContactRules,
    contacts_from_facts,
    line_facts,
)
from doorstep.functions.pages import ProfileSite, clean_handle, handle_of_url, handles_in_text
from doorstep.functions.text import present
from doorstep.functions.urls import (
    DEFAULT_HOSTS,
    FREE_BUILDER,
    GENERIC_NAME_WORDS,
    OTHER,
    SOCIAL,
    HostLists,
    host,
    host_kind,
    identity,
    name_match,
    parent_domains,
)


def classified_urls(
    results: DataFrame,
    url: str = "url",
    name: str = "name",
    lists: HostLists = DEFAULT_HOSTS,
    generic: tuple[str, ...] = GENERIC_NAME_WORDS,
) -> DataFrame:
    """Adds host, kind, identity and whether the identity is the business's own name."""
    return (
        results.withColumn("host", host(F.col(url)))
        .withColumn("kind", host_kind(F.col("host"), lists))
        .withColumn("identity", identity(F.col(url), F.col("kind"), lists))
        .withColumn("matched", name_match(F.col("identity"), F.col(name), generic))
    )


def website_verdicts(
    results: DataFrame,
    businesses: DataFrame,
    business: str = "business_id",
    lists: HostLists = DEFAULT_HOSTS,
    generic: tuple[str, ...] = GENERIC_NAME_WORDS,
) -> DataFrame:
    """Whether each business has a website of its own, from its search results.

    `businesses` has name, listed_website and searched (False: the search failed);
    `results` has business, position (from 1) and url. The listed url stands before all
    results. Own domain, then free builder, then social; none of them is a finding only
    when the search ran.
    """
    listed = businesses.where(present(F.col("listed_website")).isNotNull()).select(
        business, F.lit(0).alias("position"), F.col("listed_website").alias("url")
    )
    stated = listed.unionByName(results.select(business, F.col("position").cast("int"), "url"))
    candidates = classified_urls(
        stated.where(present(F.col("url")).isNotNull()).join(
            businesses.where("searched").select(business, "name"), business
        ),
        lists=lists, generic=generic,
    ).where(F.col("host") != "")
    place = (
        F.when(F.col("kind") == OTHER, 1).when(F.col("kind") == FREE_BUILDER, 2)
        .when(F.col("kind") == SOCIAL, 3)
    )
    counts = F.col("matched") & place.isNotNull()
    found = candidates.groupBy(business).agg(
        F.min_by(
            F.when(counts, F.struct("kind", "url", "host")),
            F.when(counts, F.struct(place.alias("p"), F.col("position"))),
        ).alias("best"),
        F.count_if((F.col("kind") == OTHER) & ~F.col("matched")).alias("_near"),
        F.count_if(F.col("position") > 0).alias("results_seen"),
    )
    kind = F.col("best.kind")
    verdict = (
        F.when(~F.col("searched"), "unknown")
        .when(kind == OTHER, "own_site")
        .when(kind == FREE_BUILDER, "free_builder")
        .when(kind == SOCIAL, "social_only")
        .otherwise("none")
    )
    judged = businesses.join(found, business, "left").withColumn("verdict", verdict)
    silent = F.col("verdict") == "none"
    return judged.select(
        business,
        F.when(F.col("verdict") == "unknown", "error").when(silent, "no_data").otherwise("ok").alias("status"),
        "verdict",
        F.col("best.url").alias("url"),
        F.col("best.host").alias("host"),
        F.when(silent & (F.coalesce("_near", F.lit(0)) > 0), "medium").otherwise("high").alias("confidence"),
        F.coalesce("results_seen", F.lit(0)).alias("results_seen"),
        (
            present(F.col("listed_website")).isNull()
            & F.col("verdict").isin("own_site", "free_builder")
        ).alias("contradicts_listing"),
    )


def suffix_join(
    urls: DataFrame, domains: DataFrame, url: str = "url", domain: str = "domain"
) -> DataFrame:
    """URLs with every listed domain their host is or lies under, as an equality join.

    For domain lists too long for a literal: the host's few parents are exploded and meet
    the list by hash, where a suffix comparison would be a nested loop.
    """
    parents = urls.select("*", F.explode(parent_domains(host(F.col(url)))).alias("_parent"))
    return parents.join(domains, parents["_parent"] == domains[domain]).drop("_parent")


# Where a handle was read, most trusted first.
ORIGINS = ("listing", "own_site", "search", "snippet")


def handle_candidates(
    businesses: DataFrame,
    site_texts: DataFrame,
    results: DataFrame,
    business: str = "business_id",
    site: ProfileSite = ProfileSite(),
    generic: tuple[str, ...] = GENERIC_NAME_WORDS,
) -> DataFrame:
    """Every distinct handle per business with its first origin and whether it names it.

    `businesses` has name and listed_handle, `site_texts` business and text, `results`
    business, position, url and snippet.
    """

    def rows(df: DataFrame, origin: str, position, values) -> DataFrame:
        return df.select(
            business, F.lit(ORIGINS.index(origin)).alias("origin_rank"),
            position.cast("bigint").alias("at"), F.posexplode(values).alias("within", "handle"),
        )

    listed = F.array_compact(F.array(clean_handle(F.col("listed_handle"), site)))
    every = (
        rows(businesses, "listing", F.lit(0), listed)
        .unionByName(rows(site_texts, "own_site", F.lit(0), handles_in_text(F.col("text"), site)))
        .unionByName(
            rows(results, "search", F.col("position"),
                 F.array_compact(F.array(handle_of_url(F.col("url"), site))))
        )
        .unionByName(
            rows(results, "snippet", F.col("position"), handles_in_text(F.col("snippet"), site))
        )
    )
    first = every.groupBy(business, "handle").agg(
        F.min(F.struct("origin_rank", "at", "within")).alias("first")
    )
    spelled = F.translate("handle", "._", "  ")
    return first.join(businesses.select(business, "name"), business).select(
        business, "handle",
        F.element_at(F.array(*[F.lit(o) for o in ORIGINS]), F.col("first.origin_rank") + 1).alias("origin"),
        "first",
        name_match(spelled, F.col("name"), generic).alias("matched"),
    )


def best_handles(candidates: DataFrame, business: str = "business_id") -> DataFrame:
    """One handle per business: name-matched ones first, then by origin and position."""
    best = candidates.groupBy(business).agg(
        F.min_by(
            F.struct("handle", "origin", "matched"), F.struct(~F.col("matched"), F.col("first"))
        ).alias("b"),
        F.count(F.lit(1)).alias("candidates"),
    )
    return best.select(
        business, F.col("b.handle").alias("handle"), F.col("b.origin").alias("origin"),
        F.when(F.col("b.origin").isin("listing", "own_site") | F.col("b.matched"), "high")
        .otherwise("low").alias("confidence"),
        "candidates",
    )


def extracted_contacts(
    documents: DataFrame,
    text: str = "text",
    keep: tuple[str, ...] = (),
    source: str = "website",
    rules: ContactRules = ContactRules(),
) -> DataFrame:
    """One row per named contact in each document's text."""
    found = documents.select(*keep, line_facts(F.col(text), rules).alias("_facts")).select(
        *keep, contacts_from_facts(F.col("_facts")).alias("_found")
    )
    names = F.transform("_found", lambda c: F.lower(c["name"]))
    first = F.filter(
        "_found", lambda c, i: F.array_position(names, F.lower(c["name"])) == i + 1
    )
    return found.select(*keep, F.posexplode(first).alias("contact_no", "c")).select(
        *keep,
        (F.col("contact_no") + 1).cast("int").alias("contact_no"),
        "c.name", "c.role", "c.phone", "c.email",
        F.lit(source).alias("source"),
        F.lit(SOURCE_CONFIDENCE[source]).alias("confidence"),
    )
