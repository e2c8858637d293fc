"""Latest rows, ranks and running totals that hold up when one group has most of the rows.

A window puts a whole group into one task, and a window over all rows puts the table there. So
rows are cut into pieces along group and order: every piece is ranked by itself, and pieces
are joined up by their totals.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from doorstep.session import written


def latest_per_key(
    df: DataFrame,
    key: str | Sequence[str],
    newest: Sequence[str | Column],
    values: Sequence[str],
) -> DataFrame:
    """One row per key: `values` of the row that is greatest by `newest`.

    An aggregate, not a window: each task folds its rows to one per key before the shuffle,
    so a key with most of the rows costs no more than any other.
    """
    keys = [key] if isinstance(key, str) else list(key)
    order = F.struct(*[F.col(c) if isinstance(c, str) else c for c in newest])
    picked = df.groupBy(*keys).agg(F.max_by(F.struct(*values), order).alias("_row"))
    return picked.select(*keys, *[F.col("_row")[v].alias(v) for v in values])


def latest_per_source(
    df: DataFrame,
    key: str,
    newest: Sequence[str],
    picks: Mapping[str, tuple[Column, Sequence[str]]],
) -> DataFrame:
    """Several latest rows per key from one scan and one shuffle.

    `picks` maps an output struct name to (which rows count, columns to keep).
    """
    order = F.struct(*newest)
    aggregates = [
        F.max_by(F.when(rows, F.struct(*columns)), F.when(rows, order)).alias(name)
        for name, (rows, columns) in picks.items()
    ]
    wanted = reduce(lambda a, b: a | b, [rows for rows, _ in picks.values()])
    return df.where(wanted).groupBy(key).agg(*aggregates)


def join_groups(left: DataFrame, right: DataFrame, by: Sequence[str], how: str = "left") -> DataFrame:
    """Join per-group values to rows; NULL is a group like any other."""
    renamed = right.select(
        *[F.col(c).alias(f"_g_{c}") for c in by], *[c for c in right.columns if c not in by]
    )
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_g_{c}")) for c in by])
    return left.join(renamed, same, how).drop(*[f"_g_{c}" for c in by])


def upto(value: Column, sorted_values: Column) -> Column:
    """How many entries of a sorted array are not above the value, by halving steps."""
    steps = F.filter(F.array(*[F.lit(1 << s) for s in range(30, -1, -1)]), lambda s: s <= F.size(sorted_values))
    return F.aggregate(
        steps, F.lit(0),
        lambda at, s: F.when(
            (at + s <= F.size(sorted_values)) & (F.get(sorted_values, at + s - 1) <= value), at + s
        ).otherwise(at),
    )


class _Pieces:
    """Rows written once and cut into pieces along group and order.

    Splitters are quantiles of a sample that merges from task to task: of all rows whose key hashes
    into one of SAMPLES slots per piece, the one with the smallest second hash. The piece of a row
    follows from its key and the splitters alone, so a lost task cuts its rows as before. A piece is
    about one in `spark.sql.shuffle.partitions` of all rows, however they fall into groups; a
    piece that ends within a group is joined up with the next by its totals.
    """

    SAMPLES = 16

    def __init__(
        self, df: DataFrame, by: Sequence[str], order: Sequence[Column], extra: Mapping[str, Column],
    ):
        self.columns = df.columns
        self.names = [f"_rt_o{i}" for i in range(len(order))]
        self.group = list(by) or ["_rt_all"]
        self.within = [*self.group, "_rt_piece"]
        keyed = df.select(
            "*", *([] if by else [F.lit(0).alias("_rt_all")]),
            *[e.alias(n) for n, e in zip(self.names, order)], *[e.alias(n) for n, e in extra.items()],
        )
        rows = written(keyed, "ordered")
        count = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        key = [*self.group, *self.names]
        slot = F.pmod(F.xxhash64(*key), F.lit(count * self.SAMPLES))
        sample = rows.groupBy(slot.alias("slot")).agg(
            F.min(F.struct(F.xxhash64(F.lit(1), *key).alias("h"), F.struct(*key).alias("key"))).alias("least")
        ).agg(F.sort_array(F.collect_list("least.key")).alias("keys"))
        splitters = sample.select(F.filter(
            F.transform(F.sequence(F.lit(1), F.lit(max(count - 1, 1))), lambda i: F.get("keys", (i * F.size("keys") / count).cast("int"))),
            lambda k: k.isNotNull(),
        ).alias("splitters"))
        cut = rows.withColumn("_rt_splitters", splitters.scalar())
        self.rows = cut.withColumn("_rt_piece", upto(F.struct(*key), F.col("_rt_splitters"))).drop("_rt_splitters")

    def by_piece(self, *aggregates: Column) -> DataFrame:
        return self.rows.groupBy(*self.within).agg(*aggregates)

    def inside(self) -> Window:
        return Window.partitionBy(*self.within).orderBy(*self.names)

    def across(self) -> Window:
        return Window.partitionBy(*self.group).orderBy("_rt_piece")


def running_totals(
    df: DataFrame,
    by: Sequence[str],
    order: Sequence[Column],
    totals: Mapping[str, Column],
    whole: Mapping[str, Column] | None = None,
) -> DataFrame:
    """`df` plus inclusive running sums of `totals` along `order` within each group.

    `order` lists ascending expressions that leave no ties. Negate numbers for descending. `whole`
    adds sums over the whole group. Every piece of the rows is summed up by itself, and pieces of a
    group are joined up by their totals: one plan, whatever the sizes of rows and groups.
    """
    whole = whole or {}
    every = {**totals, **whole}
    pieces = _Pieces(df, by, order, {f"_rt_t_{n}": e for n, e in every.items()})
    sums = pieces.by_piece(*[F.sum(f"_rt_t_{n}").alias(f"_rt_p_{n}") for n in every])
    before = pieces.across().rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(
        *pieces.within,
        *[F.coalesce(F.sum(f"_rt_p_{n}").over(before), F.lit(0)).alias(f"_rt_p_{n}") for n in totals],
        *[F.sum(f"_rt_p_{n}").over(Window.partitionBy(*pieces.group)).alias(f"_rt_p_{n}") for n in whole],
    )
    through = pieces.inside().rowsBetween(Window.unboundedPreceding, Window.currentRow)
    local = pieces.rows.select("*", *[F.sum(f"_rt_t_{n}").over(through).alias(f"_rt_l_{n}") for n in totals])
    return join_groups(local, offsets, pieces.within).select(
        *pieces.columns,
        *[(F.col(f"_rt_l_{n}") + F.col(f"_rt_p_{n}")).alias(n) for n in totals],
        *[F.col(f"_rt_p_{n}").alias(n) for n in whole],
    )


def rank_within(
    df: DataFrame, by: Sequence[str], order: Sequence[Column], name: str = "rank"
) -> DataFrame:
    """`df` plus a 1-based row number along `order` within each group."""
    return running_totals(df, by, order, {name: F.lit(1).cast("bigint")})


def with_previous(
    df: DataFrame, by: Sequence[str], order: Sequence[Column], previous: Mapping[str, str]
) -> DataFrame:
    """`df` plus columns of the row before it in its group; `previous` maps new to source."""
    pieces = _Pieces(df, by, order, {})
    row = F.struct(*[F.col(s).alias(n) for n, s in previous.items()])
    lasts = pieces.by_piece(F.max_by(row, F.struct(*pieces.names)).alias("_rt_last"))
    ahead = lasts.select(*pieces.within, F.lag("_rt_last").over(pieces.across()).alias("_rt_ahead"))
    local = pieces.rows.select("*", F.lag(row).over(pieces.inside()).alias("_rt_before"))
    # Only a piece's first row has none before it inside.
    before = F.coalesce("_rt_before", "_rt_ahead")
    return join_groups(local, ahead, pieces.within).select(
        *pieces.columns, *[before[n].alias(n) for n in previous]
    )


def first_n_within(
    df: DataFrame, by: Sequence[str], order: Sequence[Column], n: int, name: str = "rank"
) -> DataFrame:
    """The first `n` rows of each group.

    Spark trims each task to `n` rows per group before the shuffle, so a hot group sends
    `n` rows per task, not all of them.
    """
    window = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn(name, F.row_number().over(window).cast("bigint")).where(
        F.col(name) <= n
    )


def tile(rank: Column, size: Column, tiles: int) -> Column:
    """Which of `tiles` near-equal tiles a rank falls into; the first ones take the rest."""
    each = F.floor(size / tiles)
    wide = size % tiles
    edge = wide * (each + 1)
    return (
        F.when(rank <= edge, F.floor((rank - 1) / (each + 1)) + 1)
        .otherwise(wide + F.floor((rank - 1 - edge) / F.greatest(each, F.lit(1))) + 1)
        .cast("int")
    )
