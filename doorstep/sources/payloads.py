"""Raw responses to rows: listing pages, search results, fetched pages, profiles.

Every reader takes a text column of whole responses and splits good rows from rejects with
the built-in JSON functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from doorstep.functions.casts import as_float
from doorstep.functions.pages import clean_handle
from doorstep.functions.text import let, present, stripped, trimmed
from doorstep.sources.schemas import FETCH_RESPONSE, LISTING_PLACE, SEARCH_RESPONSE

# The sentinel name, the listing link and the envelope keys.
UNNAMED = "Unnamed business"
PLACE_LINK = "https://www.google.com/maps/place/?q=place_id:"
ENVELOPE_KEYS = ("search_metadata", "search_parameters", "search_information")
FULL_PAGE = 20


def read_responses(spark: SparkSession, path: str) -> DataFrame:
    """One row per response file: `path` and the whole text as `raw`."""
    return spark.read.text(path, wholetext=True).select(
        F.col("_metadata.file_path").alias("path"), F.col("value").alias("raw")
    )


# Every part of an envelope as its raw text, from one pass over the response.
_ENVELOPE = ", ".join(f"{key} string" for key in ("local_results", *ENVELOPE_KEYS))


def _all_objects(entries: Column) -> Column:
    return entries.isNotNull() & ~F.exists(
        entries, lambda e: e.isNull() | ~F.ltrim(e).startswith("{")
    )


def listing_pages(responses: DataFrame, raw: str = "raw") -> DataFrame:
    """Adds `results` (raw text of each) and `page_ok`.

    A good page has a list of objects, or an envelope without one. Every response is either
    good (perhaps empty) or in `rejected_pages`.
    """
    results = F.col("_envelope.local_results")
    entries = F.from_json(results, "array<string>")
    enveloped = F.coalesce(*[F.col(f"_envelope.{key}") for key in ENVELOPE_KEYS]).isNotNull()
    return (
        responses.withColumn("_envelope", F.from_json(raw, _ENVELOPE))
        .withColumn(
            "page_ok",
            F.coalesce(
                F.when(results.isNull(), enveloped).otherwise(
                    F.ltrim(results).startswith("[") & _all_objects(entries)
                ),
                F.lit(False),
            ),
        )
        .withColumn("results", entries)
        .drop("_envelope")
    )


def rejected_pages(responses: DataFrame, raw: str = "raw") -> DataFrame:
    return listing_pages(responses, raw).where(~F.col("page_ok")).drop("page_ok", "results")


def listing_rows(responses: DataFrame, raw: str = "raw", keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per place of every good page, with its position."""
    pages = listing_pages(responses, raw).where("page_ok")
    places = pages.select(*keep, F.posexplode("results").alias("pos", "e")).select(
        *keep, "pos", F.from_json("e", LISTING_PLACE).alias("p")
    )
    place_id = trimmed(F.col("p.place_id"))
    return places.select(
        *keep,
        (F.col("pos") + 1).alias("position"),
        F.coalesce(trimmed(F.col("p.title")), F.lit(UNNAMED)).alias("name"),
        F.coalesce(trimmed(F.col("p.type")), F.lit("")).alias("category"),
        F.filter(
            F.transform(
                F.coalesce(F.col("p.types"), F.array().cast("array<string>")),
                stripped,
            ),
            lambda t: t != "",
        ).alias("raw_categories"),
        F.coalesce(trimmed(F.col("p.address")), F.lit("")).alias("address"),
        as_float(F.col("p.gps_coordinates.latitude")).alias("lat"),
        as_float(F.col("p.gps_coordinates.longitude")).alias("lng"),
        trimmed(F.col("p.phone")).alias("phone"),
        trimmed(F.col("p.website")).alias("website"),
        place_id.alias("provider_id"),
        F.concat(F.lit(PLACE_LINK), place_id).alias("source_url"),
        as_float(F.col("p.reviews")).try_cast("bigint").alias("reviews"),
        as_float(F.col("p.rating")).alias("rating"),
    )


def search_rows(responses: DataFrame, raw: str = "raw", keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per search result; a response holding a result without url is left out."""
    parsed = responses.select(*keep, F.from_json(raw, SEARCH_RESPONSE).alias("r"))
    good = parsed.where(
        F.col("r.results").isNotNull()
        & ~F.exists("r.results", lambda x: x.isNull() | present(x["url"]).isNull())
    )
    return good.select(
        *keep, F.col("r.query").alias("query"), F.posexplode("r.results").alias("pos", "x")
    ).select(
        *keep,
        "query",
        (F.col("pos") + 1).alias("result_no"),
        F.col("x.position").alias("position"),
        F.col("x.url").alias("url"),
        F.coalesce(F.col("x.title"), F.lit("")).alias("title"),
        F.coalesce(F.col("x.snippet"), F.lit("")).alias("snippet"),
        F.coalesce(F.col("x.site_name"), F.lit("")).alias("site_name"),
        F.col("x.date").alias("date"),
    )


def rejected_searches(responses: DataFrame, raw: str = "raw") -> DataFrame:
    parsed = responses.withColumn("_r", F.from_json(raw, SEARCH_RESPONSE))
    return parsed.where(
        F.col("_r.results").isNull()
        | F.exists("_r.results", lambda x: x.isNull() | present(x["url"]).isNull())
    ).drop("_r")


def _fetched(responses: DataFrame, raw: str) -> DataFrame:
    """Adds `_r` and `_good`: a list of results that are objects with url and text.

    Errors are a list or absent, and a response without results and errors is no good.
    """
    parsed = responses.withColumn("_r", F.from_json(raw, FETCH_RESPONSE)).withColumn(
        "_list", F.from_json(F.get_json_object(raw, "$.results"), "array<string>")
    )
    whole = ~F.exists(
        "_r.results", lambda x: x.isNull() | present(x["url"]).isNull() | x["text"].isNull()
    )
    errors = F.get_json_object(raw, "$.errors")
    some = (F.size("_list") > 0) | (F.coalesce(F.size("_r.errors"), F.lit(0)) > 0)
    good = (
        F.col("_r.results").isNotNull() & _all_objects(F.col("_list")) & whole & some
        & F.coalesce(errors.startswith("["), F.lit(True))
    )
    return parsed.withColumn("_good", F.coalesce(good, F.lit(False))).drop("_list")


def rejected_fetches(responses: DataFrame, raw: str = "raw") -> DataFrame:
    """Responses of which `fetched_rows` gives nothing because they are malformed."""
    return _fetched(responses, raw).where(~F.col("_good")).drop("_r", "_good")


def fetched_rows(responses: DataFrame, raw: str = "raw", keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per requested url of every good response: fetched text, or the error it met."""
    parsed = _fetched(responses, raw).where("_good").select(*keep, F.col("_r").alias("r"))
    empty_ok = "array<struct<url:string,text:string,error:string,ok:boolean>>"
    fetched = F.transform(
        "r.results",
        lambda x: F.struct(
            x["url"].alias("url"), x["text"].alias("text"),
            F.lit(None).cast("string").alias("error"), x["text"].isNotNull().alias("ok"),
        ),
    )
    failed = F.transform(
        "r.errors",
        lambda x: F.struct(
            x["url"].alias("url"), F.lit(None).cast("string").alias("text"),
            x["error"].alias("error"), F.lit(False).alias("ok"),
        ),
    )
    none = F.array().cast(empty_ok)
    both = F.concat(F.coalesce(fetched, none), F.coalesce(failed, none))
    return parsed.select(*keep, F.inline(both)).where(present(F.col("url")).isNotNull())


# Wordings of gated and missing profiles.
GATED = (
    "(?i)checkpoint_required|challenge_required|challenge required|please wait a few minutes"
    "|unusual activity|rate limit|try again later|restrict certain content"
)
MISSING = "(?i)not found|no longer available|doesn't exist|does not exist|user not found"


def profile_rows(responses: DataFrame, raw: str = "raw", handle: str = "handle",
                 gated: str = GATED, missing: str = MISSING) -> DataFrame:
    """Adds status, reason and the profile's fields; any text gives a row, none fails."""
    kept = [c for c in responses.columns if c not in (raw, handle)]
    text = F.col(raw)
    finding = let(
        F.try_parse_json(text),
        lambda body: let(
            _profile_reason(text, body, clean_handle(F.col(handle)), gated, missing),
            lambda reason: _profile(body, reason),
        ),
    )
    return responses.select(
        *kept, F.coalesce(clean_handle(F.col(handle)), F.col(handle)).alias("handle"),
        finding.alias("_finding"),
    ).select(*kept, "handle", "_finding.*")


def _kind(body: Column, path: str) -> Column:
    """JSON type at a path, as a schema string; NULL where nothing is."""
    return F.schema_of_variant(F.try_variant_get(body, path, "variant"))


def _profile_reason(text: Column, body: Column, name: Column, gated: str, missing: str) -> Column:
    """Why a response holds no profile; NULL when it does."""
    message = F.when(
        _kind(body, "$.message") == "STRING", F.try_variant_get(body, "$.message", "string")
    ).otherwise("")
    return (
        F.when(name.isNull(), "not a valid handle")
        .when(trimmed(text).isNull(), "empty response")
        .when(body.isNull() & text.rlike(gated), "challenge or rate-limit page")
        .when(body.isNull(), "response was not valid JSON")
        .when(~F.coalesce(_kind(body, "$").startswith("OBJECT"), F.lit(False)), "unexpected shape")
        .when(F.coalesce(_kind(body, "$.data.user").startswith("OBJECT"), F.lit(False)), None)
        .when(text.rlike(gated), "challenge or rate-limit response")
        .when(message.rlike(missing), "account not found")
        .otherwise("no user data")
    )


def _profile(body: Column, reason: Column) -> Column:
    """Struct of status, reason and the profile's fields."""

    def user(path: str, kind: str, as_type: str) -> Column:
        at = f"$.data.user.{path}"
        fits = reason.isNull() & (_kind(body, at) == kind)
        return F.when(fits, F.try_variant_get(body, at, as_type))

    status = (
        F.when(reason.isNull(), "ok")
        .when(reason.startswith("challenge"), "blocked")
        .when(reason == "account not found", "no_data")
        .otherwise("error")
    )
    return F.struct(
        status.alias("status"),
        reason.alias("reason"),
        user("edge_followed_by.count", "BIGINT", "bigint").alias("followers"),
        user("edge_follow.count", "BIGINT", "bigint").alias("following"),
        user("edge_owner_to_timeline_media.count", "BIGINT", "bigint").alias("posts"),
        trimmed(user("biography", "STRING", "string")).alias("bio"),
        trimmed(user("external_url", "STRING", "string")).alias("external_url"),
        user("is_private", "BOOLEAN", "boolean").alias("is_private"),
        trimmed(user("category_name", "STRING", "string")).alias("category"),
    )
