"""Window-style operators that never need a whole partition key in one task.

A plain ``Window.partitionBy(key).orderBy(...)`` sorts each key in one task, and a
window without keys sorts the whole table in one task.  Here rows are first cut into
ranges ("slices") of (keys, order).  A slice holds part of a hot key, or many small
keys, and only slice totals, at most one row per (key, slice), cross slices.

``order`` is a list of column names; a leading ``-`` means descending.  Unless said
otherwise the order must be unique within the keys.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from lakeops.session import settle

SLICE = "_slice"
CARRY = "_carry"


def parse_order(order: Sequence[str]) -> list[tuple[str, bool]]:
    """``["-ts", "id"]`` -> ``[("ts", False), ("id", True)]`` (True = ascending)."""
    return [(c[1:], False) if c.startswith("-") else (c, True) for c in order]


def sort_columns(order: Sequence[str]) -> list[Column]:
    return [F.col(c).asc() if up else F.col(c).desc() for c, up in parse_order(order)]


def default_slices(df: DataFrame) -> int:
    """As many as a shuffle has partitions, and a few per core, so that uneven ones even out."""
    spark = df.sparkSession
    return max(8, 2 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))


def with_slice(df: DataFrame, keys: Sequence[str], order: Sequence[str], slices: int | None = None) -> DataFrame:
    """Add ``_slice``: a number that rises with (keys, order); equal rows share a slice.

    One range shuffle, whose cuts Spark samples and keeps on its own; the partition's number
    is the slice.  The rows are written with it, so all later reads see the same cuts.
    """
    ranged = df.repartitionByRange(slices or default_slices(df), *sort_columns([*keys, *order]))
    return settle(ranged.withColumn(SLICE, F.spark_partition_id()), "slices")


def running(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    sums: dict[str, Column],
    totals: dict[str, Column] | None = None,
    slices: int | None = None,
    settle_input: bool = False,
) -> DataFrame:
    """Running sums in ``order`` within ``keys``, plus whole-key ``totals`` of expressions.

    The input is read by the range shuffle, which samples it first; ``settle_input`` writes a
    costly derived input down once for these two reads.  Slice totals and the result come
    from the written slices.

    Each slice is summed on its own.  One carrier row per (key, slice) sorts first in the
    slice and brings the sum of all earlier slices, so no join back is needed.
    """
    totals = totals or {}
    keys = list(keys)
    columns = df.columns
    if settle_input:
        df = settle(df, "ordered")
    values = {f"_v_{k}": F.coalesce(v, F.lit(0)) for k, v in sums.items()}
    parts = {f"_t_{k}": v for k, v in totals.items()}
    sliced = with_slice(df.withColumns({**values, **parts}), keys, order, slices)
    per_slice = sliced.groupBy(*keys, SLICE).agg(*[F.sum(c).alias(c) for c in [*values, *parts]])
    earlier = Window.partitionBy(*keys).orderBy(SLICE).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*keys)
    carriers = per_slice.select(
        *keys,
        SLICE,
        F.lit(True).alias(CARRY),
        *[F.coalesce(F.sum(v).over(earlier), F.lit(0)).alias(v) for v in values],
        *[F.sum(p).over(whole).alias(p) for p in parts],
    )
    both = sliced.withColumn(CARRY, F.lit(False)).unionByName(carriers, allowMissingColumns=True)
    w = (
        Window.partitionBy(SLICE, *keys)
        .orderBy(F.col(CARRY).desc(), *sort_columns(order))
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    outs = {k: F.sum(f"_v_{k}").over(w) for k in sums}
    outs |= {k: F.first(f"_t_{k}").over(w) for k in totals}
    return both.withColumns(outs).where(~F.col(CARRY)).select(*columns, *outs)


def row_numbers(df, keys, order, name="rn", total=None, slices=None, settle_input=False) -> DataFrame:
    """ROW_NUMBER per key; ``total`` also adds the number of rows of the key."""
    one = F.lit(1).cast("long")
    return running(df, keys, order, {name: one}, {total: one} if total else {}, slices, settle_input)


def ntile(df, keys, order, tiles: int, name="tile", slices=None, settle_input=False) -> DataFrame:
    """NTILE(tiles): larger tiles first, as in SQL."""
    numbered = row_numbers(df, keys, order, "_rn", "_n", slices, settle_input)
    at = F.col("_rn") - 1
    small = F.floor(F.col("_n") / tiles)
    big_tiles = F.col("_n") % tiles
    in_big = big_tiles * (small + 1)
    tile = F.when(at < in_big, F.floor(at / (small + 1))).otherwise(
        big_tiles + F.floor((at - in_big) / F.greatest(small, F.lit(1)))
    )
    return numbered.withColumn(name, (tile + 1).cast("long")).drop("_rn", "_n")


def same(left: Column, right: Column) -> Column:
    return left.eqNullSafe(right)


def attach(rows: DataFrame, per_key: DataFrame, keys: Sequence[str], how: str = "left") -> DataFrame:
    """Join one row per key back onto ``rows``; NULL keys match.

    A hot key is on the ``rows`` side only, so AQE's skew join can split it.
    """
    lk = per_key.select(*[F.col(k).alias(f"_k_{k}") if k in keys else F.col(k) for k in per_key.columns])
    on = reduce(lambda a, b: a & b, [same(F.col(k), F.col(f"_k_{k}")) for k in keys])
    return rows.join(lk, on, how).drop(*[f"_k_{k}" for k in keys])


def rank_columns(df, keys, order, outs: dict[str, str], slices=None) -> DataFrame:
    """RANK, DENSE_RANK, PERCENT_RANK and CUME_DIST; ties are expected.

    ``outs`` maps an output name to ``rank``, ``dense_rank``, ``percent_rank`` or
    ``cume_dist``.  Ties are counted before any ordering, so one order value that holds
    a third of the table is one row in the ordered step.
    """
    names = [c for c, _ in parse_order(order)]
    values = df.groupBy(*keys, *names).agg(F.count(F.lit(1)).alias("_n"))
    pos = running(
        values,
        keys,
        order,
        {"_upto": F.col("_n"), "_dense": F.lit(1).cast("long")},
        {"_total": F.col("_n")},
        slices,
        settle_input=True,
    )
    rank = F.col("_upto") - F.col("_n") + 1
    forms = {
        "rank": rank,
        "dense_rank": F.col("_dense"),
        "percent_rank": F.when(F.col("_total") == 1, F.lit(0.0)).otherwise(
            (rank - 1).cast("double") / (F.col("_total") - 1)
        ),
        "cume_dist": F.col("_upto").cast("double") / F.col("_total"),
    }
    per_value = pos.select(*keys, *names, *[forms[f].alias(o) for o, f in outs.items()])
    return attach(df, per_value, [*keys, *names])


def row_frames(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    preceding: int,
    following: int,
    build: Callable[[WindowSpec, WindowSpec], dict[str, Column]],
    block_rows: int = 100_000,
    slices: int | None = None,
    settle_input: bool = False,
) -> DataFrame:
    """Expressions over a bounded row frame (LAG, LEAD, moving averages).

    Rows are numbered, cut into blocks of ``block_rows`` and the few rows next to a block
    border are copied into the neighbour block, so a window never spans more than a block.
    ``build(frame, ordered)`` gets the framed window and the plain ordered one.
    """
    if max(preceding, following) > block_rows:
        raise ValueError("frame is larger than a block")
    numbered = row_numbers(df, keys, order, "_rn", slices=slices, settle_input=settle_input)
    block = F.floor((F.col("_rn") - 1) / block_rows)
    at = (F.col("_rn") - 1) % block_rows
    own = F.struct(block.alias("b"), F.lit(True).alias("own"))
    after = F.struct((block + 1).alias("b"), F.lit(False).alias("own"))
    before = F.struct((block - 1).alias("b"), F.lit(False).alias("own"))
    copies = F.array_compact(
        F.array(own, F.when(at >= block_rows - preceding, after), F.when(at < following, before))
    )
    spread = numbered.withColumn("_c", F.explode(copies)).withColumns(
        {"_block": F.col("_c.b"), "_own": F.col("_c.own")}
    )
    ordered = Window.partitionBy(*keys, "_block").orderBy("_rn")
    outs = build(ordered.rowsBetween(-preceding, following), ordered)
    return spread.withColumns(outs).where("_own").select(*df.columns, *outs)


def first_last(df, keys, order, outs: dict[str, tuple[str, str]]) -> DataFrame:
    """FIRST_VALUE / LAST_VALUE over the whole key: name -> ("first" | "last", column).

    Uses one aggregate with map-side combine; ``order`` must be ascending.
    """
    items = parse_order(order)
    if not all(up for _, up in items):
        raise ValueError("first_last takes ascending order columns")
    at = F.struct(*[F.col(c) for c, _ in items])
    pick = {"first": F.min_by, "last": F.max_by}
    per_key = df.groupBy(*keys).agg(*[pick[kind](F.col(c), at).alias(o) for o, (kind, c) in outs.items()])
    return attach(df, per_key, keys)


def key_totals(df, keys, outs: dict[str, Column]) -> DataFrame:
    """Aggregates of the whole key beside each row (``SUM(x) OVER (PARTITION BY k)``)."""
    return attach(df, df.groupBy(*keys).agg(*[v.alias(k) for k, v in outs.items()]), keys)


def top_k(df, keys, order, k: int, name="rn") -> DataFrame:
    """First ``k`` rows per key.  Spark keeps k rows per key and map task before the
    shuffle (WindowGroupLimit), so a hot key arrives already cut to k rows per task."""
    w = Window.partitionBy(*keys).orderBy(*sort_columns(order))
    return df.withColumn(name, F.row_number().over(w)).where(F.col(name) <= k)


def latest(df, keys, order) -> DataFrame:
    """One row per key, the last in ascending ``order``; an aggregate with map-side combine."""
    at = F.struct(*[F.col(c) for c in order])
    row = F.struct(*[F.col(c) for c in df.columns])
    return df.groupBy(*keys).agg(F.max_by(row, at).alias("_row")).select("_row.*")
