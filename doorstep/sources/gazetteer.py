"""Known cities and areas as lookup rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from doorstep.functions.text import compact

CITY_SCHEMA = (
    "array<struct<city string, aliases array<string>, state string, country string, "
    "gl string, lat double, lng double>>"
)
AREA_SCHEMA = (
    "array<struct<area string, city string, aliases array<string>, state string, "
    "country string, gl string, lat double, lng double>>"
)


def read_gazetteer(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(cities, areas) from one JSON document with both lists."""
    document = spark.read.schema(f"cities {CITY_SCHEMA}, areas {AREA_SCHEMA}").json(
        path, multiLine=True
    )
    return (
        document.select(F.inline("cities")),
        document.select(F.inline("areas")),
    )


def _spellings(name: str):
    """Distinct comparison keys of a name and its aliases, blank ones dropped."""
    every = F.concat(
        F.array(F.col(name)), F.coalesce("aliases", F.array().cast("array<string>"))
    )
    return F.array_distinct(F.filter(F.transform(every, compact), lambda k: k != ""))


def place_keys(cities: DataFrame, areas: DataFrame) -> DataFrame:
    """One row per spelling an entry answers to.

    `precision`, `area_key` (empty for a city), `city_key`, then the entry. An area answers
    together with every spelling of its city.
    """
    city_keys = cities.select(
        compact(F.col("city")).alias("_city"), F.explode(_spellings("city")).alias("city_key")
    )
    columns = ("city", "state", "country", "gl", "lat", "lng")
    by_city = cities.select(
        F.lit("city").alias("precision"),
        F.lit("").alias("area_key"),
        F.explode(_spellings("city")).alias("city_key"),
        F.lit(None).cast("string").alias("area"),
        *columns,
    )
    named = areas.select(
        F.explode(_spellings("area")).alias("area_key"),
        compact(F.col("city")).alias("_own"),
        "area",
        *columns,
    )
    by_area = (
        named.join(city_keys, named["_own"] == city_keys["_city"], "left")
        .select(
            F.lit("area").alias("precision"),
            "area_key",
            F.coalesce("city_key", "_own").alias("city_key"),
            "area",
            *[named[c] for c in columns],
        )
    )
    return by_city.unionByName(by_area)


def clashing_keys(keys: DataFrame) -> DataFrame:
    """Spellings two different entries answer to: an editing mistake."""
    return (
        keys.groupBy("precision", "area_key", "city_key")
        .agg(F.countDistinct(F.struct("area", "city", "state", "lat", "lng")).alias("entries"))
        .where(F.col("entries") > 1)
    )
