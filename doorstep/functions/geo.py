"""Location strings, country codes, radii and spherical offsets."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from doorstep.functions.text import compact, squeezed

# Radius per precision, metres per degree, key precision, search radius range.
AREA_RADIUS_METERS = 3000
CITY_RADIUS_METERS = 15000
METERS_PER_DEGREE = 111_320.0
COORDINATE_PLACES = 6

# Country names as typed, to two-letter codes.
COUNTRY_CODES = {
    "india": "in", "bharat": "in", "unitedstates": "us", "unitedstatesofamerica": "us",
    "usa": "us", "america": "us", "unitedkingdom": "gb", "uk": "gb", "greatbritain": "gb",
    "england": "gb", "unitedarabemirates": "ae", "uae": "ae", "singapore": "sg",
    "canada": "ca", "australia": "au", "srilanka": "lk", "bangladesh": "bd", "nepal": "np",
}


def composed(*parts: Column) -> Column:
    """Parts most specific first; blanks and repeats of the previous kept part drop out."""
    cleaned = F.filter(F.array(*[squeezed(part) for part in parts]), lambda p: p != "")
    kept = F.filter(
        cleaned,
        lambda p, i: (i == 0) | (compact(p) != compact(F.get(cleaned, i - 1))),
    )
    return F.array_join(kept, ", ")


def city_of(query: Column, precision: Column) -> Column:
    """The city inside a composed query: second part for an area, first for a city."""
    parts = F.filter(F.transform(F.split(query, ","), lambda p: F.trim(p)), lambda p: p != "")
    wanted = F.when(precision == "area", 2).otherwise(1)
    return F.coalesce(F.try_element_at(parts, wanted), F.try_element_at(parts, F.lit(1)))


def country_code(country: Column, codes: dict[str, str] | None = None) -> Column:
    """Two-letter code of a country name, or NULL: an unknown name is not guessed."""
    key = compact(country)
    known = F.lit(None).cast("string")
    for name, code in (codes or COUNTRY_CODES).items():
        known = F.when(key == name, code).otherwise(known)
    return F.coalesce(known, F.when(key.rlike("^[a-z]{2}$"), key))


def radius_for(precision: Column) -> Column:
    return F.when(precision == "area", AREA_RADIUS_METERS).when(
        precision == "city", CITY_RADIUS_METERS
    )


def moved_lat(lat: Column, north: Column) -> Column:
    return F.round(lat + north / METERS_PER_DEGREE, COORDINATE_PLACES)


def moved_lng(lat: Column, lng: Column, east: Column) -> Column:
    scale = F.cos(F.radians(lat))
    step = F.when(F.abs(scale) < 1e-9, 0.0).otherwise(
        F.try_divide(east, F.lit(METERS_PER_DEGREE) * scale)
    )
    return F.round(lng + step, COORDINATE_PLACES)


def tile_spacing(radius: Column) -> Column:
    """Hex-lattice spacing at which circles of this radius cover the plane."""
    return radius * math.sqrt(3.0)


def point_parameter(
    lat: Column, lng: Column, radius: Column, low: int, high: int
) -> Column:
    """`@lat,lng,<r>m` with the radius clamped to what the search accepts."""
    clamped = F.greatest(F.lit(low), F.least(F.lit(high), radius.cast("int")))
    return F.concat(
        F.lit("@"), lat.cast("string"), F.lit(","), lng.cast("string"), F.lit(","),
        clamped.cast("string"), F.lit("m"),
    )


def search_phrase(name: Column, city: Column) -> Column:
    """Quoted name and city."""
    return F.trim(
        F.concat(
            F.lit('"'), F.trim(F.coalesce(name, F.lit(""))), F.lit('" '),
            F.trim(F.coalesce(city, F.lit(""))),
        )
    )


def ad_search_url(base: str, name: Column, country: Column) -> Column:
    """Ad-library search URL; `+` for spaces, everything else percent-encoded."""
    # The query parameters.
    return F.concat(
        F.lit(base + "?active_status=active&ad_type=all&country="),
        F.url_encode(F.upper(country)),
        F.lit("&media_type=all&q="),
        F.replace(F.url_encode(F.trim(name)), F.lit("*"), F.lit("%2A")),
        F.lit("&search_type=keyword_unordered"),
    )
