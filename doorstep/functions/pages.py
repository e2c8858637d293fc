"""Reading fetched page text: site grade, ad page, profile handles."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from doorstep.functions.text import any_marker, let, stripped
from doorstep.functions.urls import host, path_parts, under_any


@dataclass(frozen=True)
class SiteMarkers:
    """What a site is graded on. Parameters with the usual words as defaults."""

    # The marker words and weights.
    catalogue: tuple[str, ...] = (
        "menu", "our menu", "catalogue", "catalog", "price list", "pricelist", "our products",
        "products", "our services", "packages", "collections", "shop now",
    )
    enquiry: tuple[str, ...] = (
        "contact us", "contact", "enquiry", "enquire", "inquiry", "get in touch", "book now",
        "book a table", "appointment", "request a quote", "call us", "mailto:", "tel:",
        "wa.me", "whatsapp",
    )
    ordering: tuple[str, ...] = (
        "order online", "order now", "add to cart", "buy now", "checkout", "shopping cart",
        "place your order", "pay now", "razorpay", "payu", "swiggy", "zomato",
    )
    viewport: str = r"""(?i)<meta[^>]+name=["']?viewport["']?[^>]*>"""
    device_width: str = r"(?i)width\s*=\s*device-width"
    media_query: str = r"(?i)@media[^{]*\(\s*(max|min)-width"
    html: str = r"(?i)<\s*(!doctype|html|head|meta|body|div)\b"
    weights: tuple[tuple[str, float], ...] = (
        ("catalogue", 0.30), ("enquiry", 0.25), ("ordering", 0.15), ("mobile_friendly", 0.30),
    )
    min_chars: int = 200


def site_grade(text: Column, markers: SiteMarkers = SiteMarkers()) -> Column:
    """Struct of the four graded traits, score, signals and gaps; NULL when ungradeable.

    `mobile_friendly` is NULL for text without markup: not measured is not "no".
    """
    width = F.regexp_extract(text, f"({markers.viewport})", 1)
    traits = let(
        F.lower(text),
        lambda lowered: F.struct(
            any_marker(lowered, markers.catalogue).alias("catalogue"),
            any_marker(lowered, markers.enquiry).alias("enquiry"),
            any_marker(lowered, markers.ordering).alias("ordering"),
            F.when(
                text.contains("<") & text.rlike(markers.html),
                width.rlike(markers.device_width) | text.rlike(markers.media_query),
            ).alias("mobile_friendly"),
        ),
    )
    readable = F.length(stripped(text)) >= markers.min_chars
    return F.when(readable, let(traits, lambda t: _graded(t, dict(markers.weights))))


def _graded(traits: Column, weights: dict[str, float]) -> Column:
    """Score, signals and gaps of measured traits; weights renormalise over those measured."""

    def total(test: Callable[[Column], Column]) -> Column:
        parts = (F.when(test(traits[n]), F.lit(w)).otherwise(0.0) for n, w in weights.items())
        return sum(parts, F.lit(0.0))

    def named(test: Callable[[Column], Column]) -> Column:
        return F.array_compact(F.array(*[F.when(test(traits[n]), n) for n in weights]))

    return F.struct(
        *[traits[n].alias(n) for n in ("mobile_friendly", "catalogue", "enquiry", "ordering")],
        F.rint(100 * total(lambda t: t) / total(lambda t: t.isNotNull())).cast("int").alias("score"),
        named(lambda t: t).alias("signals"),
        named(lambda t: ~t).alias("gaps"),
    )


@dataclass(frozen=True)
class AdPageMarkers:
    """How an ad-library page says blocked, empty or how many."""

    # The page's own wordings.
    blocked: tuple[str, ...] = (
        "log in to continue", "you must log in", "log into facebook", "please log in",
        "create new account", "javascript is required", "enable javascript",
        "you're temporarily blocked", "sorry, something went wrong",
        "this content isn't available", "checkpoint required", "security check",
        "are you a robot",
    )
    empty: tuple[str, ...] = (
        "no ads match your search criteria", "no results found", "0 results",
        "we couldn't find any ads", "we could not find any ads",
        "try changing or removing your filters",
    )
    count: str = r"~?\s*([\d,]+)\s*\+?\s*results?\b"
    min_chars: int = 120


def ad_page(text: Column, markers: AdPageMarkers = AdPageMarkers()) -> Column:
    """Struct of status, runs_ads (tri-state) and ad_count."""
    short = text.isNull() | (
        F.length(stripped(text)) < markers.min_chars
    )

    def read(lowered: Column) -> Column:
        stated = F.regexp_extract(lowered, markers.count, 1)
        return (
            F.when(any_marker(lowered, markers.blocked), "blocked")
            .when(any_marker(lowered, markers.empty), "0")
            .when(stated != "", F.replace(stated, F.lit(","), F.lit("")))
            .otherwise("no_data")
        )

    answer = F.when(short, "blocked").otherwise(let(F.lower(text), read))

    def finding(said: Column) -> Column:
        count = said.try_cast("bigint")
        return F.struct(
            F.when(said.isin("blocked", "no_data"), said).otherwise("ok").alias("status"),
            (count > 0).alias("runs_ads"),
            count.alias("ad_count"),
        )

    return let(answer, finding)


@dataclass(frozen=True)
class ProfileSite:
    """The platform whose profile handles are read out of text and URLs."""

    # Hosts, the handle shape and first path parts that are not profiles.
    hosts: tuple[str, ...] = ("instagram.com", "instagr.am", "ig.me", "cdninstagram.com")
    in_text: str = r"(?i)(?:https?://)?(?:www\.|m\.)?instagram\.com/([A-Za-z0-9._]{1,30})"
    reserved: tuple[str, ...] = (
        "p", "reel", "reels", "tv", "stories", "s", "explore", "directory", "accounts",
        "about", "developer", "developers", "legal", "privacy", "terms", "help", "web",
        "graphql", "ajax", "api", "oauth", "challenge", "sessions", "emails", "session",
        "download", "topics", "locations", "direct", "your_activity", "lite", "static",
        "images", "favicon.ico", "popular",
    )
    profile_url: str = "https://www.instagram.com/%s/"


def clean_handle(raw: Column, site: ProfileSite = ProfileSite()) -> Column:
    """A valid lower-case handle, or NULL."""
    handle = F.lower(
        F.regexp_replace(F.regexp_replace(F.trim(raw), "^@+", ""), "/+$", "")
    )
    return F.when(
        handle.rlike(r"^[a-z0-9._]{1,30}$") & handle.rlike("[a-z0-9]")
        & ~handle.isin(*site.reserved),
        handle,
    )


def handle_of_url(url: Column, site: ProfileSite = ProfileSite()) -> Column:
    """The handle in a profile URL, or NULL when it is not one."""
    return F.when(
        under_any(host(url), site.hosts),
        clean_handle(F.try_element_at(path_parts(url), F.lit(1)), site),
    )


def handles_in_text(text: Column, site: ProfileSite = ProfileSite()) -> Column:
    """Distinct valid handles mentioned in a text, in order."""
    raw = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(site.in_text), F.lit(1))
    return F.array_distinct(
        F.filter(F.transform(raw, lambda h: clean_handle(h, site)), lambda h: h.isNotNull())
    )


def profile_link(handle: Column) -> Column:
    """Canonical profile page of a handle or profile URL; other URLs pass unchanged."""
    cleaned = F.regexp_replace(
        F.regexp_replace(F.trim(handle), "^@+", ""), "^/+|/+$", ""
    )
    bare = F.regexp_replace(cleaned, r"^.*?://", "")
    site_host = F.lower(F.regexp_extract(bare, "^([^/]*)", 1))
    path = F.regexp_replace(F.regexp_replace(bare, "^[^/]*/?", ""), "^/+|/+$", "")
    link = ProfileSite().profile_url
    return (
        F.when(F.coalesce(cleaned, F.lit("")) == "", None)
        .when(
            site_host.isin("instagram.com", "www.instagram.com"),
            F.when(path != "", F.format_string(link, path)),
        )
        .when(cleaned.contains("://"), F.trim(handle))
        .otherwise(F.format_string(link, cleaned))
    )
