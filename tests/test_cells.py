"""Cell yields, revival, selection and the hex lattice."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from doorstep.operators import cells

DAY0 = dt.datetime(2024, 1, 1)


def walk(passes, revive):
    """The state machine written out, one pass after the other."""
    status, page, total, last = "pending", 1, 0, None
    out = []
    for at, new, seen in passes:
        revived = status == "exhausted" and revive is not None and last < at - dt.timedelta(days=revive)
        if revived:
            status, page = "pending", 1
        if new:
            status, page = ("hot" if new >= 5 else "cooling"), page + 1
        else:
            status = "exhausted" if status in ("struck", "exhausted") else "struck"
        total, last = total + seen, at
        out.append((at, status, page, new, total, revived, at if status == "exhausted" else None))
    return out


@pytest.mark.parametrize("revive", [30, None])
def test_history_equals_the_machine(spark, revive):
    rng = random.Random(3)
    rows, want = [], {}
    for cell in range(12):
        at, passes = DAY0, []
        for _ in range(120 if cell == 0 else rng.randint(1, 25)):
            at += dt.timedelta(days=rng.choice([1, 2, 29, 30, 31, 40]), seconds=rng.randint(0, 1))
            passes.append((at, rng.choice([0, 0, 0, 0, 0, 2, 7]), rng.randint(0, 20)))
        rows += [(cell, *p) for p in passes]
        want[cell] = walk(passes, revive)
    df = spark.createDataFrame(
        rows, "cell_id int, searched_at timestamp, new_count int, total_count int"
    )
    got = cells.cell_history(df, revive_after_days=revive).orderBy("searched_at")
    by_cell = {}
    for r in got.collect():
        by_cell.setdefault(r.cell_id, []).append(
            (r.searched_at, r.status, r.next_page, r.new_yield, r.total_yield, r.revived, r.exhausted_at)
        )
    assert by_cell == want
    assert any(r[5] for rows in want.values() for r in rows) == (revive is not None)


def test_expired_cells_reset_but_undated_ones_do_not(spark):
    rows = [
        (1, "exhausted", 4, 0, DAY0), (2, "exhausted", 4, 0, DAY0 + dt.timedelta(days=9)),
        (3, "exhausted", 4, 0, None), (4, "hot", 2, 9, None),
    ]
    df = spark.createDataFrame(
        rows, "id int, status string, next_page int, new_yield int, exhausted_at timestamp"
    )
    got = cells.live_cells(df, F.lit(DAY0 + dt.timedelta(days=31))).orderBy("id").collect()
    assert [(r.status, r.next_page, r.live) for r in got] == [
        ("pending", 1, True), ("exhausted", 4, False), ("exhausted", 4, False), ("hot", 2, True),
    ]


def test_lattice_is_nearest_first():
    points = cells.hex_offsets(13, 1000.0)
    assert points[0] == (0.0, 0.0) and len(set(points)) == 13
    spans = [round((x * x + y * y) ** 0.5) for x, y in points]
    assert spans == sorted(spans) and spans[1:7] == [1000] * 6 and spans[7] == 1732


def test_policies_and_quotas():
    assert cells.BREADTH_FIRST.searches == 1 and cells.DEEP_SWEEP.searches == 195
    assert cells.quota(60, 7) == 9 and cells.quota(0, 3) == 1
    assert (cells.scan_cap(20, 1), cells.scan_cap(5, 3), cells.scan_cap(20, 3), cells.scan_cap(90, 3)) == (20, 50, 60, 200)


def test_breadth_first_plans_one_cell(spark):
    targets = spark.createDataFrame(
        [("a", 12.9716, 77.5946, 3000, ["best", "next"])],
        "area string, lat double, lng double, radius_m int, queries array<string>",
    )
    got = cells.plan_cells(targets, cells.BREADTH_FIRST).collect()
    assert [(r.tile_lat, r.tile_lng, r.tile_radius_m, r.query_variant) for r in got] == [
        (12.9716, 77.5946, 3000, "best")
    ]
    assert cells.plan_cells(targets, cells.DEEP_SWEEP).count() == 26
