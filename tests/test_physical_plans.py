"""Shapes of physical plans that must not get worse."""

import pytest

from doorstep.checks import load_all
from doorstep.operators import ordering
from doorstep.session import written

FOLDER = "/root/testdata/sf0.001"
CHECKS = load_all()


def plan_of(spark, name):
    df = CHECKS[name].run(spark, FOLDER)
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture()
def no_broadcast(spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


@pytest.mark.parametrize("name", [
    "cohort_bands_large_cohorts", "known_places", "merged_duplicates", "resolved_locations",
    "website_verdicts", "offers_that_fire", "lookups_due", "memory_recall", "domains_above_hosts",
    "reconciled_master", "planned_cells", "lead_sheet",
])
def test_every_join_has_a_key(spark, no_broadcast, name):
    plan = plan_of(spark, name)
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan
    assert "PythonUDF" not in plan and "InPandas" not in plan


@pytest.mark.parametrize("name", [
    "qualification", "listing_scores", "type_slugs", "planned_cells", "url_kinds",
    "scrubbed_urls", "split_allowances", "profile_rows",
])
def test_row_work_is_not_shuffled(spark, name):
    plan = plan_of(spark, name)
    # The one exchange allowed spreads a table that is smaller than the task slots.
    assert "ENSURE_REQUIREMENTS" not in plan


@pytest.mark.parametrize("name", ["kept_within_quota", "memory_recall"])
def test_top_n_is_trimmed_before_the_shuffle(spark, name):
    assert plan_of(spark, name).count("WindowGroupLimit") >= 2


def test_chosen_cells_are_trimmed_before_they_are_ranked(spark, monkeypatch):
    """Ranks over the whole queue are of rows written before; what is written is trimmed first."""
    plans = []

    def kept(df, label):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return written(df, label)

    monkeypatch.setattr(ordering, "written", kept)
    plan_of(spark, "selected_cells")
    assert plans[0].count("WindowGroupLimit") >= 2


def test_latest_rows_read_few_columns_and_fold_before_the_shuffle(spark):
    plan = plan_of(spark, "latest_score")
    assert "Window" not in plan and "partial_max_by" in plan
    plan = plan_of(spark, "hosts")
    assert "ReadSchema: struct<url:string>" in plan


def test_filters_reach_the_scan(spark):
    from pyspark.sql import functions as F

    from doorstep.checks.domain import Domain
    from doorstep.operators.sheet import in_scope

    leads = Domain(spark, FOLDER).table("customer").withColumnRenamed("c_mktsegment", "niche_id")
    plan = in_scope(leads, niche_ids=["BUILDING"]).select(F.col("c_custkey"))
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(c_mktsegment,BUILDING)" in text or "In(c_mktsegment" in text


def test_sheet_reads_each_child_table_once_per_use(spark):
    plan = plan_of(spark, "lead_sheet")
    assert "max_by" in plan and plan.count("WindowGroupLimit") == 0
