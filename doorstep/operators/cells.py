"""Search cells: planning the grid, measuring yields, choosing what to search next."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from doorstep.functions.geo import moved_lat, moved_lng
from doorstep.operators.ordering import (
    first_n_within,
    rank_within,
    running_totals,
)

# Yield thresholds, days until an exhausted cell is tried again, scan range.
HOT_AT = 5
REVIVE_AFTER_DAYS = 30
STATUS_ORDER = ("hot", "pending", "cooling", "struck", "exhausted")
WIDENED_SCAN = (50, 200)


@dataclass(frozen=True)
class SweepPolicy:
    """How much of the grid one pass may search per area and category."""

    name: str
    tiles: int = 1
    variants: int = 1
    pages: int = 1
    tile_radius_m: int | None = None

    @property
    def searches(self) -> int:
        return self.tiles * self.variants * self.pages


# The two policies.
BREADTH_FIRST = SweepPolicy("breadth_first")
DEEP_SWEEP = SweepPolicy("deep_sweep", tiles=13, variants=5, pages=3, tile_radius_m=1200)


def hex_offsets(count: int, spacing: float) -> list[tuple[float, float]]:
    """(east, north) metres of the first `count` hex-lattice points, nearest first."""
    rings = math.ceil((math.sqrt(12 * count - 3) - 3) / 6) if count > 1 else 0
    side = range(-rings, rings + 1)
    lattice = [
        (spacing * (a + b / 2), spacing * math.sqrt(3) / 2 * b)
        for a in side for b in side if abs(a + b) <= rings
    ]
    lattice.sort(
        key=lambda p: (round(math.hypot(*p), 3), round(math.atan2(p[1], p[0]), 6))
    )
    return lattice[:count]


def plan_cells(targets: DataFrame, policy: SweepPolicy, queries: str = "queries") -> DataFrame:
    """Cells of every (area, category) target: tiles times distinct query variants.

    `targets` has lat, lng, radius_m and an array of queries, best first. The lattice is a
    literal of the policy, so planning is a projection.
    """
    if policy.tiles == 1:
        offsets = [(0.0, 0.0)]
    else:
        offsets = hex_offsets(policy.tiles, policy.tile_radius_m * math.sqrt(3))
    tiles = F.array(
        *[
            F.struct(F.lit(i).alias("tile"), F.lit(e).alias("east"), F.lit(n).alias("north"))
            for i, (e, n) in enumerate(offsets)
        ]
    )
    size = F.size(queries)
    wanted = F.transform(
        F.sequence(F.lit(0), F.lit(policy.variants - 1)),
        lambda i: F.get(F.col(queries), (i % size).cast("int")),
    )
    radius = F.lit(policy.tile_radius_m) if policy.tile_radius_m else F.col("radius_m")
    keep = [c for c in targets.columns if c not in (queries, "lat", "lng", "radius_m")]
    placed = targets.where(size > 0).select(
        *keep, "lat", "lng", radius.cast("int").alias("tile_radius_m"),
        F.array_distinct(wanted).alias("_variants"), F.inline(tiles),
    )
    return placed.select(
        *keep, "tile",
        moved_lat(F.col("lat"), F.col("north")).alias("tile_lat"),
        moved_lng(F.col("lat"), F.col("lng"), F.col("east")).alias("tile_lng"),
        "tile_radius_m",
        F.explode("_variants").alias("query_variant"),
    )


def plan_cost(locations: int | Column, niches: int | Column, policy: SweepPolicy) -> Column:
    """Upper bound of searches a plan may buy."""
    as_column = [x if isinstance(x, Column) else F.lit(x) for x in (locations, niches)]
    return as_column[0] * as_column[1] * policy.searches


def _status(new: Column, exhausted: Column) -> Column:
    return (
        F.when(new >= HOT_AT, "hot")
        .when(new > 0, "cooling")
        .when(exhausted, "exhausted")
        .otherwise("struck")
    )


def cell_history(
    passes: DataFrame,
    cell: Sequence[str] = ("cell_id",),
    at: str = "searched_at",
    new: str = "new_count",
    total: str = "total_count",
    revive_after_days: int | None = REVIVE_AFTER_DAYS,
) -> DataFrame:
    """State after every pass: status, next_page, new_yield, total_yield.

    Two empty passes in a row exhaust a cell; an exhausted cell whose last pass is older than
    `revive_after_days` starts over at page 1 (None: never). A pass can revive a cell when
    the one before it repeated an empty pass and is old enough, unless that one had itself
    just revived the cell. So along passes that all could, every second one does, and the
    state machine becomes a matter of counting.
    """
    cell = list(cell)
    base = passes.select(
        "*",
        F.greatest(F.col(new), F.lit(0)).alias("_new"),
        F.greatest(F.col(total), F.lit(0)).cast("bigint").alias("_total"),
        F.col(at).alias("_at"),
    )
    # A group is the passes of one cell, one for each time the planner chose it.
    passed = Window.partitionBy(*cell).orderBy("_at")
    through = passed.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    zero = F.col("_new") == 0
    prior = base.select("*", F.lag("_new").over(passed).alias("_prev_new"), F.lag("_at").over(passed).alias("_prev_at"))
    prev_zero = F.coalesce(F.col("_prev_new") == 0, F.lit(False))
    if revive_after_days is None:
        late = F.lit(False)
    else:
        late = F.coalesce(
            F.col("_prev_at") < F.col("_at") - F.make_dt_interval(F.lit(revive_after_days)),
            F.lit(False),
        )
    staged = prior.select("*", (zero & prev_zero).alias("_repeat"), late.alias("_late"))
    able = F.col("_late") & F.coalesce(F.lag("_repeat").over(passed), F.lit(False))
    counted = staged.select("*", able.alias("_able")).select(
        "*",
        F.count(F.lit(1)).over(through).alias("_n"),
        F.sum((~zero).cast("bigint")).over(through).alias("_full"),
        F.sum("_total").over(through).alias("total_yield"),
        F.sum((~F.col("_able")).cast("bigint")).over(through).alias("_chain"),
    )
    # A chain is one pass that could not revive the cell and those right after it that could.
    head = F.min("_n").over(Window.partitionBy(*cell, "_chain"))
    revived = F.col("_able") & ((F.col("_n") - head) % 2 == 1)
    final = counted.select("*", revived.alias("revived"))
    final = final.select("*", F.sum(F.col("revived").cast("bigint")).over(through).alias("_life"))
    before = F.col("_full") - F.when(zero, 0).otherwise(1)
    paged = final.select("*", F.min(before).over(Window.partitionBy(*cell, "_life")).alias("_full_before"))
    exhausted = F.col("_repeat") & ~F.col("revived")
    return paged.select(
        *passes.columns,
        _status(F.col("_new"), exhausted).alias("status"),
        (1 + F.col("_full") - F.col("_full_before")).alias("next_page"),
        F.col("_new").alias("new_yield"),
        "total_yield",
        "revived",
        F.when(zero & exhausted, F.col(at)).alias("exhausted_at"),
    )


def live_cells(cells: DataFrame, asof: Column) -> DataFrame:
    """Cells after the expiry rule: long-exhausted ones reset, the rest as they are.

    Adds `live`: not exhausted. An exhausted cell without a date cannot prove its time.
    """
    expired = (F.col("status") == "exhausted") & F.coalesce(
        F.col("exhausted_at") < asof - F.make_dt_interval(F.lit(REVIVE_AFTER_DAYS)), F.lit(False)
    )
    reset = {
        "status": F.when(expired, "pending").otherwise(F.col("status")),
        "next_page": F.when(expired, 1).otherwise(F.col("next_page")),
        "new_yield": F.when(expired, 0).otherwise(F.col("new_yield")),
        "exhausted_at": F.when(expired, None).otherwise(F.col("exhausted_at")),
    }
    after = cells.select(*[reset[c].alias(c) if c in reset else F.col(c) for c in cells.columns])
    return after.withColumn("live", F.col("status") != "exhausted")


def selection_order(priority: Column) -> list[Column]:
    """Scarce credits go to priority, then measured yield, then status, id and query."""
    rank = F.lit(len(STATUS_ORDER))
    for place, status in enumerate(STATUS_ORDER):
        rank = F.when(F.col("status") == status, place).otherwise(rank)
    return [
        -priority, -F.col("new_yield"), rank, F.coalesce("id", F.lit(0)), F.col("query_variant")
    ]


def select_cells(
    cells: DataFrame, group: Sequence[str], per_group: int, priority: Column,
) -> DataFrame:
    """The best cells of each (area, category), with their place in the whole queue."""
    order = selection_order(priority)
    chosen = first_n_within(
        cells.where(F.col("status") != "exhausted"), group, order, per_group, "group_rank"
    )
    return rank_within(chosen, [], order, "queue_rank")


def quota(limit: int, niches: int) -> int:
    return max(1, math.ceil(max(1, limit) / niches))


def scan_cap(per_niche: int, scan_multiplier: int) -> int:
    """How many candidates are worth reading for a category."""
    if scan_multiplier <= 1:
        return per_niche
    low, high = WIDENED_SCAN
    return min(high, max(low, per_niche * scan_multiplier))


def within_quota(
    fresh: DataFrame, niche: str, order: Sequence[Column], per_niche: int
) -> DataFrame:
    """At most `per_niche` new records per category, in sweep order."""
    return first_n_within(fresh, [niche], order, per_niche, "kept_rank")


def within_scan_cap(
    cells: DataFrame, niche: str, order: Sequence[Column], candidates: str, cap: int,
) -> DataFrame:
    """Cells that are still read: candidates seen before them stay under the cap."""
    counted = running_totals(
        cells, [niche], order, {"_through": F.col(candidates).cast("bigint")}
    )
    before = F.col("_through") - F.col(candidates)
    return counted.where(before < cap).select(*cells.columns, before.alias("candidates_before"))


__all__ = [
    "BREADTH_FIRST", "DEEP_SWEEP", "SweepPolicy", "cell_history",
    "hex_offsets", "live_cells", "plan_cells", "plan_cost", "quota", "scan_cap",
    "select_cells", "selection_order", "within_quota", "within_scan_cap",
]
