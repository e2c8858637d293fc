"""Who is who: dedupe keys, merging duplicates, upserts, known-place checks."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from doorstep.functions.text import compact, first_present, present
from doorstep.functions.urls import authority

# The record fields that a merge fills, and those that count as richness.
SCALAR_FIELDS = (
    "name", "category", "address", "city", "phone", "website", "source_url", "provider_id",
)
RICH_FIELDS = ("address", "phone", "website", "source_url", "provider_id")
LIST_FIELDS = ("raw_categories", "matched_niches")


def coordinate_key(value: Column) -> Column:
    """Coordinate at five decimals as a scaled whole number."""
    return F.rint(value * 100000).cast("bigint").cast("string")


def dedupe_key(
    name: Column, provider_id: Column, phone: Column, website: Column, address: Column,
    lat: Column, lng: Column,
) -> Column:
    """First tier that yields anything: provider, contact, address, location."""
    who = compact(name)
    contact = compact(first_present(phone, authority(website)))
    where = compact(address)
    point = F.when(
        lat.isNotNull() & lng.isNotNull(),
        F.concat_ws("|", coordinate_key(lat), coordinate_key(lng)),
    ).otherwise("")
    return (
        F.when(present(provider_id).isNotNull(), F.concat(F.lit("provider|"), compact(provider_id)))
        .when(contact != "", F.concat_ws("|", F.lit("contact"), who, contact))
        .when(where != "", F.concat_ws("|", F.lit("address"), who, where))
        .otherwise(F.concat_ws("|", F.lit("location"), who, point))
    )


def richness(
    address: Column, phone: Column, website: Column, source_url: Column, provider_id: Column,
    lat: Column, lng: Column,
) -> Column:
    """How many of the identifying fields are filled."""
    filled = [present(c).isNotNull() for c in (address, phone, website, source_url, provider_id)]
    filled.append(lat.isNotNull() & lng.isNotNull())
    return sum((flag.cast("int") for flag in filled), F.lit(0))


def merge_duplicates(records: DataFrame, key: str = "dedupe_key", ordinal: str = "ordinal") -> DataFrame:
    """One record per key, as if the duplicates were folded together in arrival order.

    In the fold a record takes the lead when it fills more identifying fields than
    everything before it taken together; leading records override, others only fill blanks.
    What stands before a record is known from the first arrival of each field, so the fold
    becomes two aggregates: no group is gathered or sorted in one place.
    """
    firsts = records.groupBy(key).agg(
        *[
            F.min(F.when(present(F.col(f)).isNotNull(), F.col(ordinal))).alias(f"_first_{f}")
            for f in SCALAR_FIELDS
        ],
        F.min(F.when(F.col("lat").isNotNull(), F.col(ordinal))).alias("_first_lat"),
        F.min(F.when(F.col("lng").isNotNull(), F.col(ordinal))).alias("_first_lng"),
        F.min(ordinal).alias("_first"),
        F.count(F.lit(1)).alias("merged_rows"),
    )
    seen = records.select(key, ordinal, *SCALAR_FIELDS, "lat", "lng").join(firsts, key)

    def earlier(field: str) -> Column:
        return F.coalesce(F.col(f"_first_{field}") < F.col(ordinal), F.lit(False))

    before = sum((earlier(f).cast("int") for f in RICH_FIELDS), F.lit(0)) + (
        earlier("lat") & earlier("lng")
    ).cast("int")
    own = richness(*[F.col(c) for c in (*RICH_FIELDS, "lat", "lng")])
    leads = (F.col(ordinal) == F.col("_first")) | (own > before)
    opens = reduce(
        or_, [F.coalesce(F.col(ordinal) == F.col(f"_first_{f}"), F.lit(False)) for f in (*SCALAR_FIELDS, "lat", "lng")]
    )

    # Only leading records and first fillers can reach the result: a handful per key.
    marked = (
        seen.select(
            key, ordinal, "merged_rows", *SCALAR_FIELDS, "lat", "lng",
            leads.alias("_leads"), opens.alias("_opens"),
        ).where(F.col("_leads") | F.col("_opens"))
    )

    # At most seven leads and ten first fillers by construction, so the list is short.
    fields = [*SCALAR_FIELDS, "lat", "lng"]
    gathered = marked.groupBy(key).agg(
        F.first("merged_rows").alias("merged_rows"),
        F.array_sort(
            F.collect_list(
                F.struct(
                    ordinal, "_leads",
                    *[present(F.col(f)).alias(f) for f in SCALAR_FIELDS], "lat", "lng",
                )
            )
        ).alias("_rows"),
    )

    def merged(field: str) -> Column:
        has = F.filter("_rows", lambda r: r[field].isNotNull())
        led = F.filter(has, lambda r: r["_leads"])
        return F.coalesce(
            F.try_element_at(led, F.lit(-1))[field], F.try_element_at(has, F.lit(1))[field]
        ).alias(field)

    scalars = gathered.select(
        key, F.get("_rows", F.lit(0))[ordinal].alias(ordinal), "merged_rows",
        *[merged(f) for f in fields],
    )
    return scalars.join(_ordered_unions(records, key, ordinal), key, "left").select(
        key, ordinal, "merged_rows", *SCALAR_FIELDS, "lat", "lng",
        *[F.coalesce(F.col(f), F.array().cast("array<string>")).alias(f) for f in LIST_FIELDS],
    )


def _ordered_unions(records: DataFrame, key: str, ordinal: str) -> DataFrame:
    """Distinct entries of the list columns per key, in order of first appearance.

    First appearance is (record, position), whatever their sizes; every task folds its entries
    before the shuffle.
    """

    def tagged(field: str) -> Column:
        return F.transform(
            F.coalesce(F.col(field), F.array().cast("array<string>")),
            lambda item, pos: F.struct(
                F.lit(field).alias("list"), pos.alias("pos"), item.alias("item")
            ),
        )

    entries = records.select(key, ordinal, F.inline(F.concat(*[tagged(f) for f in LIST_FIELDS])))
    place = F.struct(ordinal, "pos")
    firsts = entries.groupBy(key, "list", "item").agg(F.min(place).alias("place"))

    def listed(field: str) -> Column:
        mine = F.collect_list(F.when(F.col("list") == field, F.struct("place", "item")))
        return F.transform(F.array_sort(mine), lambda e: e["item"]).alias(field)

    return firsts.groupBy(key).agg(*[listed(f) for f in LIST_FIELDS])


def upsert(
    stored: DataFrame,
    incoming: DataFrame,
    key: str,
    replace: Sequence[str] = (),
    keep_known: Sequence[str] = (),
    keep_present: Sequence[str] = (),
    first: Mapping[str, str] | None = None,
    last: Mapping[str, str] | None = None,
    order: str = "_seq",
) -> DataFrame:
    """Snapshot after merging `incoming` into `stored`.

    `replace` takes the newest value even when NULL, `keep_known` the newest known value,
    `keep_present` the newest value that is neither NULL nor empty. `first` and `last` map an
    output column to the column whose oldest or newest value it takes. `order` breaks ties
    within `incoming`. A NULL key never merges.
    """
    columns = [key, *replace, *keep_known, *keep_present,
               *dict(first or {}).values(), *dict(last or {}).values()]
    columns = list(dict.fromkeys(columns))

    def staged(df: DataFrame, generation: int) -> DataFrame:
        tie = F.col(order) if order in df.columns else F.lit(0)
        return df.select(
            *columns, F.struct(F.lit(generation).alias("g"), tie.cast("bigint").alias("s")).alias("_at")
        )

    both = staged(stored, 0).unionByName(staged(incoming, 1))

    def newest(field: str, value: Column) -> Column:
        known = value.isNotNull()
        return F.max_by(F.when(known, value), F.when(known, F.col("_at"))).alias(field)

    aggregates = [
        *[F.max_by(F.col(f), F.col("_at")).alias(f) for f in replace],
        *[newest(f, F.col(f)) for f in keep_known],
        *[newest(f, present(F.col(f))) for f in keep_present],
        *[F.min_by(F.col(s), F.col("_at")).alias(o) for o, s in dict(first or {}).items()],
        *[F.max_by(F.col(s), F.col("_at")).alias(o) for o, s in dict(last or {}).items()],
    ]
    merged = both.where(F.col(key).isNotNull()).groupBy(key).agg(*aggregates)
    loose = both.where(F.col(key).isNull()).select(
        key, *replace, *keep_known, *keep_present,
        *[F.col(s).alias(o) for o, s in dict(first or {}).items()],
        *[F.col(s).alias(o) for o, s in dict(last or {}).items()],
    )
    return merged.unionByName(loose)


def insert_if_absent(
    stored: DataFrame, incoming: DataFrame, keys: Sequence[str], order: Sequence[str] = ()
) -> DataFrame:
    """Stored rows untouched, plus the first incoming row of every key that is not stored yet.

    `order` says which incoming row is first; rows equal there go by their values. A key with
    a NULL in it equals no other, so all such rows are inserted.
    """
    columns = stored.columns
    fresh = incoming.join(stored.select(*keys), list(keys), "left_anti")
    keyed = reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys])
    row = F.struct(*columns)
    first = fresh.where(keyed).groupBy(*keys).agg(
        F.min_by(row, F.struct(*order, *columns)).alias("_row")
    )
    return (
        stored.unionByName(first.select("_row.*").select(*columns))
        .unionByName(fresh.where(~keyed).select(*columns))
    )


def mark_known(candidates: DataFrame, stored: DataFrame) -> DataFrame:
    """Adds `known`: the place id or the dedupe key is already stored.

    Two equality joins; one join on either key could not be hashed.
    """
    places = stored.where(F.col("place_id").isNotNull()).select(
        F.col("place_id").alias("_place")
    ).distinct()
    keys = stored.where(F.col("dedupe_key").isNotNull()).select(
        F.col("dedupe_key").alias("_key")
    ).distinct()
    return (
        candidates.join(places, F.nullif(candidates["place_id"], F.lit("")) == places["_place"], "left")
        .join(keys, candidates["dedupe_key"] == keys["_key"], "left")
        .withColumn("known", F.col("_place").isNotNull() | F.col("_key").isNotNull())
        .drop("_place", "_key")
    )


def only_new(candidates: DataFrame, stored: DataFrame) -> DataFrame:
    """Candidates that are stored under neither key."""
    return mark_known(candidates, stored).where(~F.col("known")).drop("known")


def first_sightings(sightings: DataFrame, key: str, order: Sequence[str]) -> DataFrame:
    """The sighting each key is credited to: the earliest by `order`."""
    rest = [c for c in sightings.columns if c != key and c not in order]
    picked = sightings.groupBy(key).agg(
        F.min_by(F.struct(*order, *rest), F.struct(*order)).alias("_row")
    )
    return picked.select(key, *[F.col("_row")[c].alias(c) for c in (*order, *rest)])
