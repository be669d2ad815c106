"""Joins that Spark has no direct form for: interval overlap, listed or counted, and as-of."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lakeops.operators.ordered import SLICE, running, sort_columns, with_slice


def overlap_join(df: DataFrame, keys: Sequence[str], row_id: str, start: str, end: str) -> DataFrame:
    """Pairs of rows with equal ``keys`` whose half-open intervals [start, end) of whole numbers overlap.

    Output: ``first_id < second_id`` plus the keys.  Of two that overlap, the later start lies in the
    other interval.  An interval is placed in the cells it touches of a width that follows its own
    length, at most six, and each start is looked up in its one cell of every width that occurs; widths
    are powers of 16, so that a start is copied for few of them.  So
    minutes and years meet without a common bucket: a start is paired with few intervals that do not
    hold it, and a pair comes out once.  Empty intervals overlap what strictly surrounds them.
    """
    # The width is the power of 16 above a quarter of the length, given by its exponent to the base 2.
    length = F.col(end) - F.col(start)
    power = F.greatest(F.ceil((F.length(F.bin(length)) - 2) / 4).cast("int") * 4, F.lit(0))
    rows = df.where(F.col(start).isNotNull() & F.col(end).isNotNull())
    holders = rows.where(length > 0).withColumn("_p", power)
    # At most 17 numbers.
    powers = sorted(r[0] for r in holders.select("_p").distinct().collect())

    def cell(at, p):
        return F.call_function("shiftright", at, p)

    holders = holders.withColumn("_c", F.explode(F.sequence(cell(F.col(start), F.col("_p")), cell(F.col(end) - 1, F.col("_p")))))
    holders = holders.select(*keys, "_p", "_c", F.col(row_id).alias("_a"), F.col(start).alias("_s1"), F.col(end).alias("_e1"))
    starts = rows.withColumn("_p", F.explode(F.array(*[F.lit(p) for p in powers]).cast("array<int>")))
    starts = starts.select(*keys, "_p", cell(F.col(start), F.col("_p")).alias("_c"), F.col(row_id).alias("_b"), F.col(start).alias("_s2"), F.col(end).alias("_e2"))
    # Of equal starts, the smaller id counts as the earlier one.
    earlier = (F.col("_s1") < F.col("_s2")) | ((F.col("_s1") == F.col("_s2")) & (F.col("_a") < F.col("_b")))
    hit = earlier & (F.col("_s2") < F.col("_e1")) & (F.col("_s1") < F.col("_e2")) & (F.col("_a") != F.col("_b"))
    pairs = holders.join(starts, [*keys, "_p", "_c"]).where(hit)
    return pairs.select(*keys, F.least("_a", "_b").alias("first_id"), F.greatest("_a", "_b").alias("second_id"))


def overlap_counts(df: DataFrame, keys: Sequence[str], row_id: str, start: str, end: str, name: str = "overlaps") -> DataFrame:
    """How many rows of equal ``keys`` each half-open interval [start, end) overlaps: keys, row_id, ``name``.

    The same overlaps as ``overlap_join``, counted without listing them, so the work does not grow
    with their number.  An interval overlaps all that start before its end, but for those that end by
    its start and itself; both are running counts over starts and ends in order of time, spread
    over ranges of time within a key.  An empty interval overlaps what strictly surrounds it.
    Rows with a null key or bound, or that end before they start, are left out; ``row_id`` is unique.
    """
    sound = F.col(start) <= F.col(end)
    for k in keys:
        sound &= F.col(k).isNotNull()
    one, none = F.lit(1).cast("long"), F.lit(0).cast("long")

    def mark(at, step, opens, ends, plus, minus, own):
        """A row at a time: what it adds to both counts, and how it uses them (``own``: itself among them)."""
        parts = {"_at": at, "_step": F.lit(step), "_o": opens, "_e": ends, "_plus": plus, "_minus": minus, "_own": own}
        return F.struct(*[v.alias(k) for k, v in parts.items()])

    # At one time: ends, then empty intervals that ask, then those that count, then starts.
    s, e = F.col(start), F.col(end)
    full = F.array(mark(e, 0, none, one, one, none, none), mark(s, 3, one, none, none, one, one))
    empty = F.array(mark(s, 1, none, none, one, one, none), mark(s, 2, one, one, none, none, none))
    marks = df.where(sound).select(*keys, F.col(row_id), F.inline(F.when(s < e, full).otherwise(empty)))
    counted = running(marks, keys, ["_at", "_step"], {"_starts": F.col("_o"), "_ends": F.col("_e")}, settle_input=True)
    share = F.col("_plus") * F.col("_starts") - F.col("_minus") * F.col("_ends") - F.col("_own")
    return counted.groupBy(*keys, row_id).agg(F.sum(share).alias(name))


def as_of_join(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str],
    at: str,
    take: Sequence[str],
    tie: str,
    slices: int | None = None,
) -> DataFrame:
    """Each left row with the last right row of its key at or before its time.

    Both sides are put in one table and the last right row is carried forward.  The table
    is cut into (key, time) slices; a carrier row brings the last right row of earlier
    slices, so a hot key is spread over many tasks.  (key, at) is unique on the right.
    ``tie`` is a left column that makes left rows unique.
    """
    keys = list(keys)
    value = F.struct(*take)
    # _side: right rows (0) come before left rows (1) at the same time.
    both = right.select(*keys, at, value.alias("_value"), F.lit(0).alias("_side")).unionByName(
        left.withColumn("_side", F.lit(1)), allowMissingColumns=True
    )
    order = [at, "_side", tie]
    sliced = with_slice(both, keys, order, slices)
    per_slice = sliced.groupBy(*keys, SLICE).agg(
        F.max_by("_value", F.when(F.col("_side") == 0, F.col(at))).alias("_value")
    )
    earlier = Window.partitionBy(*keys).orderBy(SLICE).rowsBetween(Window.unboundedPreceding, -1)
    carriers = per_slice.select(
        *keys, SLICE, F.last("_value", ignorenulls=True).over(earlier).alias("_value"), F.lit(-1).alias("_side")
    )
    w = (
        Window.partitionBy(SLICE, *keys)
        .orderBy((F.col("_side") == -1).desc(), *sort_columns(order))
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    filled = sliced.unionByName(carriers, allowMissingColumns=True).withColumn(
        "_value", F.last("_value", ignorenulls=True).over(w)
    )
    return filled.where(F.col("_side") == 1).select(*left.columns, *[F.col("_value")[c].alias(c) for c in take])
