"""Business categories (profiles) and offers as parameters and as dimension tables."""

from __future__ import annotations

import json
from dataclasses import dataclass
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


@dataclass(frozen=True)
class Profile:
    """One business category: what to search for, what counts as a match, what to offer."""

    id: str
    label: str
    queries: tuple[str, ...] = ()
    aliases: tuple[str, ...] = ()
    include_types: tuple[str, ...] = ()
    exclude_types: tuple[str, ...] = ()
    include_suffixes: tuple[str, ...] = ()
    exclude_suffixes: tuple[str, ...] = ()
    terms: tuple[str, ...] = ()
    strict: bool = False
    allow_name_only: bool = False
    demand: int = 18
    budget: int = 12
    offer: str = ""
    scan_multiplier: int = 1


@dataclass(frozen=True)
class Offer:
    """One offer: the categories it is for (none means all) and the signals it needs."""

    id: str
    label: str
    niches: tuple[str, ...]
    signals: tuple[str, ...]
    hours: float
    pitch: str = ""


def load_profiles(path: str) -> tuple[Profile, ...]:
    """Profiles from a JSON list of objects with the fields of `Profile`, in registry order."""
    entries = json.loads(Path(path).read_text(encoding="utf-8"))
    return tuple(
        Profile(**{k: tuple(v) if isinstance(v, list) else v for k, v in entry.items()})
        for entry in entries
    )


def load_offers(path: str) -> tuple[Offer, ...]:
    entries = json.loads(Path(path).read_text(encoding="utf-8"))
    return tuple(
        Offer(**{k: tuple(v) if isinstance(v, list) else v for k, v in entry.items()})
        for entry in entries
    )


# Category, label, demand, budget, strict, name alone suffices, scan priority.
# The type vocabulary of each category (some 700 slugs, suffixes and terms) is a parameter:
# bring it as JSON and read it with `load_profiles`.
PROFILE_BASES = (
    ("cafe", "Cafe", 20, 13, False, False, 1),
    ("bakery", "Bakery", 23, 15, False, False, 1),
    ("cake_shop", "Cake Shop", 23, 15, False, False, 1),
    ("cloud_kitchen", "Cloud Kitchen", 24, 14, True, True, 3),
    ("catering", "Catering", 23, 18, True, False, 1),
    ("salon", "Salon", 21, 16, True, False, 2),
    ("spa", "Spa", 20, 18, True, False, 2),
    ("fitness_gym", "Fitness/Gym", 22, 16, True, False, 1),
    ("dental_clinic", "Dental Clinic", 22, 20, True, False, 1),
    ("clinic", "Clinic", 21, 19, True, False, 1),
    ("veterinary", "Veterinary", 20, 17, True, False, 1),
    ("auto_service", "Auto Service", 20, 17, True, False, 1),
    ("preschool", "Preschool", 21, 18, True, False, 1),
    ("tutor_class", "Tutor/Class", 21, 13, True, False, 2),
    ("driving_school", "Driving School", 19, 14, True, False, 1),
    ("photographer", "Photographer", 24, 16, True, False, 1),
    ("event_planner", "Event Planner", 23, 19, True, False, 1),
    ("interior_designer", "Interior Designer", 22, 21, True, False, 1),
    ("real_estate", "Real Estate", 21, 20, True, False, 1),
    ("travel_agency", "Travel Agency", 22, 17, True, False, 1),
    ("professional_services", "Professional Services", 19, 22, True, False, 1),
    ("boutique", "Boutique", 20, 16, True, False, 1),
    ("home_decor", "Home Decor", 19, 17, True, False, 1),
    ("manufacturer", "Manufacturer", 18, 20, True, True, 3),
)

# The signals a score asserts, and those an observation asserts by source.
SCORER_SIGNALS = (
    "no website", "social-only", "weak/free website", "has website", "public phone",
    "public web link", "detailed business listing", "multiple service fit",
)
OBSERVED_SIGNALS = {
    "no online ordering": "firecrawl_site",
    "no booking link": "firecrawl_site",
    "no enquiry form": "firecrawl_site",
    "no landing page": "firecrawl_site",
    "manual enquiry flow": "firecrawl_site",
    "high review count": "google_maps",
    "owner replies absent": "google_maps",
    "active social presence": "instagram",
    "instagram-only catalogue": "instagram",
    "dm ordering": "instagram",
    "runs meta ads": "meta_ads",
}

# The offer catalogue, in catalogue order.
OFFERS = (
    Offer("order_intake", "Order intake", ("cafe", "bakery", "cake_shop", "cloud_kitchen"),
          ("no online ordering", "active social presence"), 6.0),
    Offer("appointment_booking", "Appointment booking and reminders",
          ("salon", "spa", "fitness_gym", "dental_clinic", "clinic", "veterinary"),
          ("no booking link",), 5.0),
    Offer("enrolment_scheduling", "Enrolment and batch scheduling",
          ("tutor_class", "preschool", "driving_school"),
          ("no booking link", "manual enquiry flow"), 4.0),
    Offer("quotation_handling", "Quotation handling",
          ("manufacturer", "home_decor", "interior_designer", "event_planner"),
          ("no enquiry form",), 4.0),
    Offer("enquiry_routing", "Enquiry capture and routing",
          ("catering", "photographer", "real_estate", "travel_agency",
           "professional_services"),
          ("manual enquiry flow", "public phone"), 3.5),
    Offer("catalog_whatsapp", "Catalogue and WhatsApp checkout",
          ("boutique", "bakery", "home_decor"),
          ("instagram-only catalogue", "dm ordering"), 5.0),
    Offer("service_reminders", "Service-due reminders",
          ("auto_service", "dental_clinic", "veterinary"),
          ("no booking link", "public phone"), 2.5),
    Offer("review_response", "Review response", (),
          ("high review count", "owner replies absent"), 2.0),
    Offer("lead_capture", "Ad lead capture", (),
          ("runs meta ads", "no landing page"), 3.0),
)


def profile_table(spark: SparkSession, profiles: tuple[Profile, ...]) -> DataFrame:
    """One row per category, in registry order."""
    rows = [
        (i, p.id, p.label, p.strict, p.allow_name_only, p.demand, p.budget, p.offer,
         p.scan_multiplier)
        for i, p in enumerate(profiles)
    ]
    return spark.createDataFrame(
        rows,
        "position int, niche_id string, label string, strict boolean, allow_name_only boolean, "
        "demand int, budget int, offer string, scan_multiplier int",
    )


def rule_table(spark: SparkSession, profiles: tuple[Profile, ...]) -> DataFrame:
    """One row per rule: category, kind (include, exclude, either as suffix, term), value."""
    rows = []
    for p in profiles:
        for kind, values in (
            ("include", p.include_types), ("exclude", p.exclude_types),
            ("include_suffix", p.include_suffixes), ("exclude_suffix", p.exclude_suffixes),
            ("term", p.terms),
        ):
            rows += [(p.id, kind, value) for value in values]
    return spark.createDataFrame(rows, "niche_id string, kind string, value string")


def query_table(spark: SparkSession, profiles: tuple[Profile, ...]) -> DataFrame:
    rows = [(p.id, i, q) for p in profiles for i, q in enumerate(p.queries)]
    return spark.createDataFrame(rows, "niche_id string, position int, query string")


def alias_table(spark: SparkSession, profiles: tuple[Profile, ...]) -> DataFrame:
    """Every accepted spelling of a category, with where it stands in the registry."""
    rows = [
        (p.id, spelling) for p in profiles for spelling in (p.id, p.label, *p.aliases)
    ]
    return spark.createDataFrame(rows, "niche_id string, spelling string")


def offer_table(spark: SparkSession, offers: tuple[Offer, ...] = OFFERS) -> DataFrame:
    rows = [(i, o.id, o.label, o.pitch, o.hours) for i, o in enumerate(offers)]
    return spark.createDataFrame(
        rows, "position int, offer_id string, label string, pitch string, hours double"
    )


def offer_niche_table(spark: SparkSession, offers: tuple[Offer, ...] = OFFERS) -> DataFrame:
    """Categories an offer is limited to; an offer for all has no rows."""
    rows = [(o.id, n) for o in offers for n in o.niches]
    return spark.createDataFrame(rows, "offer_id string, niche_id string")


def offer_signal_table(spark: SparkSession, offers: tuple[Offer, ...] = OFFERS) -> DataFrame:
    rows = [(o.id, i, s) for o in offers for i, s in enumerate(o.signals)]
    return spark.createDataFrame(rows, "offer_id string, position int, signal string")


def profile_payload(spark: SparkSession, profiles: tuple[Profile, ...]) -> DataFrame:
    """The registry as one flat row per category, types in alphabetical order."""
    rows = [
        (p.id, p.label, list(p.queries), sorted(p.include_types), sorted(p.exclude_types),
         list(p.include_suffixes), list(p.exclude_suffixes))
        for p in profiles
    ]
    return spark.createDataFrame(
        rows,
        "id string, label string, queries array<string>, include_types array<string>, "
        "exclude_types array<string>, include_suffixes array<string>, "
        "exclude_suffixes array<string>",
    )


def offer_payload(spark: SparkSession, offers: tuple[Offer, ...] = OFFERS) -> DataFrame:
    """The offer catalogue as one flat row per offer."""
    rows = [(o.id, o.label, list(o.niches), list(o.signals), o.pitch, o.hours) for o in offers]
    return spark.createDataFrame(
        rows,
        "id string, label string, niches array<string>, required_signals array<string>, "
        "pitch_line string, est_hours_saved_weekly double",
    )
