"""From the stored tables to the operator's sheet, and back."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from doorstep.operators import bands, identity, sheet
from doorstep.sources.tables import read_table

PARTS = (
    "businesses", "enrichments", "scores", "contacts", "verdicts", "outreach",
    "automation_opportunities",
)


def stored_tables(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    return {name: read_table(spark, folder, name) for name in PARTS}


def lead_bands(tables: Mapping[str, DataFrame], min_cohort: int = bands.MIN_COHORT) -> DataFrame:
    """Audience band of every stored business, computed per read and never stored."""
    good = (F.col("source") == "google_maps") & (F.col("status") == "ok")
    members = bands.cohort_members(
        tables["businesses"],
        bands.latest_scores(tables["scores"]),
        bands.latest_reviews(
            tables["enrichments"], good, F.get_json_object("data", "$.reviews")
        ),
    )
    return bands.cohort_bands(members, min_cohort)


def lead_sheet(
    tables: Mapping[str, DataFrame], niche_labels: DataFrame | None = None
) -> DataFrame:
    """The sheet's rows with keys, source urls and their place in the sheet."""
    records = sheet.lead_records(
        tables["businesses"].withColumn("business_id", F.col("id")),
        lead_bands(tables), tables["verdicts"], tables["contacts"], tables["enrichments"],
        tables["scores"], tables["automation_opportunities"], tables["outreach"], niche_labels,
    )
    return sheet.ordered_sheet(sheet.sheet_cells(sheet.evidence_sources(records)))


def write_back(tables: Mapping[str, DataFrame], typed_rows: DataFrame, asof) -> DataFrame:
    """Verdict table after what the operator typed; blanks never clear anything."""
    businesses = tables["businesses"].select("place_id", F.col("id").alias("business_id"))
    incoming = sheet.verdicts_from_sheet(sheet.sheet_rows_by_place(typed_rows), businesses)
    incoming = incoming.withColumn("contacted_on", F.col("contacted_on").try_cast("date")).withColumn(
        "updated_at", asof
    )
    return identity.upsert(
        tables["verdicts"], incoming, "business_id",
        keep_known=["my_verdict", "contacted_on", "channel", "outcome"],
        keep_present=["notes"], last={"updated_at": "updated_at"},
    )
