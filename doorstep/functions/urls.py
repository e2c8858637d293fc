"""URL parts, host classification and name matching as Column expressions."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

from doorstep.functions.text import any_marker, words

OTHER, SOCIAL, FREE_BUILDER, THIRD_PARTY = "other", "social", "free_builder", "third_party"

# Hosts that carry a presence but no website of one's own.
SOCIAL_DOMAINS = (
    "instagram.com", "facebook.com", "fb.com", "wa.me", "whatsapp.com", "linktr.ee", "bit.ly",
)
EXTRA_SOCIAL_DOMAINS = (
    "linkedin.com", "twitter.com", "x.com", "pinterest.com", "youtube.com", "youtu.be",
    "threads.net", "taplink.cc", "beacons.ai", "linkin.bio", "zaap.bio", "t.me", "snapchat.com",
)

# Default domains of free site builders.
FREE_BUILDER_DOMAINS = (
    "wixsite.com", "wix.com", "blogspot.com", "blogspot.in", "sites.google.com",
    "business.site", "weebly.com", "webnode.com", "webnode.page", "godaddysites.com",
    "wordpress.com", "tumblr.com", "carrd.co", "strikingly.com", "mystrikingly.com",
    "square.site", "myshopify.com", "mydukaan.io", "dukaan.app", "webflow.io", "netlify.app",
    "vercel.app", "github.io", "jimdosite.com", "yolasite.com", "site123.me", "simdif.com",
    "ucraft.site", "zohosites.in", "instamojo.com", "glideapp.io",
)
FREE_BUILDER_MARKERS = ("wixsite", "blogspot", "sites.google", "business.site")

# Directories, marketplaces, registries and news.
THIRD_PARTY_DOMAINS = (
    "justdial.com", "indiamart.com", "sulekha.com", "tradeindia.com", "exportersindia.com",
    "quikr.com", "olx.in", "yellowpages.in", "asklaila.com", "grotal.com",
    "connect2india.com", "zomato.com", "swiggy.com", "dineout.co.in", "eazydiner.com",
    "magicpin.in", "tripadvisor.com", "tripadvisor.in", "yelp.com", "bookmyshow.com",
    "makemytrip.com", "goibibo.com", "booking.com", "agoda.com", "airbnb.co.in", "practo.com",
    "urbancompany.com", "urbanclap.com", "lybrate.com", "credihealth.com", "nearbuy.com",
    "wedmegood.com", "weddingwire.in", "shaadisaga.com", "99acres.com", "magicbricks.com",
    "housing.com", "nobroker.in", "commonfloor.com", "zaubacorp.com", "tofler.in",
    "thecompanycheck.com", "indiafilings.com", "glassdoor.co.in", "ambitionbox.com",
    "mouthshut.com", "amazon.in", "amazon.com", "flipkart.com", "meesho.com", "snapdeal.com",
    "google.com", "goo.gl", "wikipedia.org", "medium.com", "quora.com", "reddit.com",
    "foursquare.com", "mapquest.com", "trustpilot.com", "bing.com", "yahoo.com",
    "archive.org", "scribd.com", "slideshare.net", "indiatimes.com", "hindustantimes.com",
    "thehindu.com", "ndtv.com", "news18.com", "deccanherald.com", "indianexpress.com",
    "livemint.com", "telegraphindia.com", "firstpost.com", "yourstory.com",
)

# Trailing host labels that name nobody, and leading ones that are transport.
TLD_LABELS = (
    "com", "co", "in", "net", "org", "io", "ai", "biz", "info", "shop", "store", "site",
    "online", "app", "dev", "me", "us", "uk", "xyz", "live", "cafe", "restaurant", "company",
    "services", "tech", "digital", "agency", "studio", "pro", "edu", "gov", "ac", "web",
    "page", "link", "bio",
)
LEADING_LABELS = ("www", "m", "mobile")

# Words too common in business names to identify one.
GENERIC_NAME_WORDS = (
    "the", "and", "of", "for", "at", "by", "pvt", "private", "ltd", "limited", "llp", "inc",
    "co", "company", "india", "indian", "bakery", "bakers", "cafe", "coffee", "restaurant",
    "kitchen", "salon", "spa", "studio", "clinic", "dental", "hospital", "store", "shop",
    "stores", "boutique", "gym", "fitness", "hotel", "sweets", "foods", "food", "services",
    "service", "solutions", "enterprises", "traders", "centre", "center", "house", "point",
    "world", "hub", "zone", "best", "new", "official", "home", "online",
)
NAME_MATCH_COVERAGE = 0.6


@dataclass(frozen=True)
class HostLists:
    """Which domains count as what. Parameters, so a caller can bring their own."""

    social: tuple[str, ...] = SOCIAL_DOMAINS + EXTRA_SOCIAL_DOMAINS
    builder: tuple[str, ...] = FREE_BUILDER_DOMAINS
    builder_markers: tuple[str, ...] = FREE_BUILDER_MARKERS
    third_party: tuple[str, ...] = THIRD_PARTY_DOMAINS
    tld_labels: tuple[str, ...] = field(default=TLD_LABELS)


DEFAULT_HOSTS = HostLists()


def _with_scheme(url: Column) -> Column:
    return F.when(url.contains("://"), url).otherwise(F.concat(F.lit("https://"), url))


def authority(url: Column) -> Column:
    """Lower-case authority part including user and port; empty for none."""
    found = F.regexp_extract(_with_scheme(url), r"^[^:/?#]+://([^/?#]*)", 1)
    return F.lower(F.coalesce(found, F.lit("")))


def host(url: Column) -> Column:
    """Lower-case host without user and port; empty for none."""
    return F.regexp_extract(authority(url), r"([^@:]*)(?::[^@]*)?$", 1)


def path_parts(url: Column) -> Column:
    """Non-empty path segments."""
    path = F.regexp_extract(_with_scheme(url), r"^[^:/?#]+://[^/?#]*([^?#]*)", 1)
    return F.filter(F.split(F.coalesce(path, F.lit("")), "/"), lambda part: part != "")


def parent_domains(host_: Column) -> Column:
    """A host and each of its parents: `a.b.c` -> [`a.b.c`, `b.c`, `c`]."""
    labels = F.split(host_, r"\.")
    count = F.size(labels)
    return F.transform(
        F.sequence(F.lit(1), count),
        lambda start: F.array_join(F.slice(labels, start, count), "."),
    )


def under_any(host_: Column, domains: tuple[str, ...]) -> Column:
    """Whether the host is one of the domains or below one.

    A suffix test of one host against many domains is a nested loop; testing the host's few
    parents for set membership is not.
    """
    if not domains:
        return F.lit(False)
    return F.exists(parent_domains(host_), lambda parent: parent.isin(*domains))


def listed_domain(host_: Column, domains: tuple[str, ...]) -> Column:
    """The listed domain the host belongs to, or NULL."""
    if not domains:
        return F.lit(None).cast("string")
    hits = F.filter(parent_domains(host_), lambda parent: parent.isin(*domains))
    return F.try_element_at(hits, F.lit(1))


def host_kind(host_: Column, lists: HostLists = DEFAULT_HOSTS) -> Column:
    """social, then free_builder, then third_party, then other."""
    return (
        F.when(F.coalesce(host_, F.lit("")) == "", OTHER)
        .when(under_any(host_, lists.social), SOCIAL)
        .when(
            under_any(host_, lists.builder) | any_marker(host_, lists.builder_markers),
            FREE_BUILDER,
        )
        .when(under_any(host_, lists.third_party), THIRD_PARTY)
        .otherwise(OTHER)
    )


def own_label(host_: Column, tld_labels: tuple[str, ...] = TLD_LABELS) -> Column:
    """The part of a host that could be a name: `www.mistydoor.co.in` -> `mistydoor`."""
    lead = "|".join(LEADING_LABELS)
    tail = "|".join(tld_labels)
    tidy = F.regexp_replace(F.regexp_replace(host_, r"\.{2,}", "."), r"^\.|\.$", "")
    headless = F.regexp_replace(tidy, rf"^(?:(?:{lead})(?:\.|$))+", "")
    return F.regexp_replace(headless, rf"^([^.]+(?:\.[^.]+)*?)(?:\.(?:{tail}))+$", "$1")


def identity(url: Column, kind: Column, lists: HostLists = DEFAULT_HOSTS) -> Column:
    """The text in a URL that could be a business's own name.

    Ordinary hosts give their label. Platform hosts give what stands before the platform's
    domain plus the first path part. Third-party hosts give nothing.
    """
    name = host(url)
    platform = F.coalesce(listed_domain(name, lists.social), listed_domain(name, lists.builder))
    before = F.when(
        platform.isNotNull() & (name != platform),
        F.substring(name, F.lit(1), F.length(name) - F.length(platform) - 1),
    ).otherwise("")
    first = F.coalesce(F.try_element_at(path_parts(url), F.lit(1)), F.lit(""))
    return (
        F.when(name == "", "")
        .when(kind.isin(SOCIAL, FREE_BUILDER), F.trim(F.concat_ws(" ", before, first)))
        .when(kind == THIRD_PARTY, "")
        .otherwise(own_label(name, lists.tld_labels))
    )


def naming_words(name: Column, generic: tuple[str, ...] = GENERIC_NAME_WORDS) -> Column:
    """The words that identify a business; all of its words when none does."""
    every = words(name)
    strong = F.filter(every, lambda word: (F.length(word) >= 3) & ~word.isin(*generic))
    return F.when(F.size(strong) > 0, strong).otherwise(every)


def name_match(
    identity_: Column,
    name: Column,
    generic: tuple[str, ...] = GENERIC_NAME_WORDS,
    coverage: float = NAME_MATCH_COVERAGE,
) -> Column:
    """Enough of the name's words, and its first longest one, occur in the identity."""
    wanted = naming_words(name, generic)
    haystack = F.regexp_replace(F.lower(F.coalesce(identity_, F.lit(""))), "[^a-z0-9]+", "")
    hits = F.size(F.filter(wanted, lambda word: F.contains(haystack, word)))
    needed = F.greatest(F.lit(1), F.ceil(F.size(wanted) * F.lit(coverage)))
    width = F.array_max(F.transform(wanted, F.length))
    longest = F.try_element_at(
        F.filter(wanted, lambda word: F.length(word) == width), F.lit(1)
    )
    return (
        (F.size(wanted) > 0)
        & (haystack != "")
        & (hits >= needed)
        & F.coalesce(F.contains(haystack, longest), F.lit(False))
    )
