"""File layout jobs: compaction, z-order clustering, reports."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeops.operators.ordered import running


def write_partitioned(df: DataFrame, path: str, by: Sequence[str], mode: str = "overwrite", fmt: str = "parquet") -> None:
    """Write partitions; REBALANCE groups rows by partition and lets AQE split hot ones."""
    df.hint("rebalance", *by).write.mode(mode).partitionBy(*by).format(fmt).save(path)


def replace_partitions(df: DataFrame, path: str, by: Sequence[str]) -> None:
    """Overwrite only the partitions that ``df`` holds."""
    df.hint("rebalance", *by).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


def compact(spark: SparkSession, source: str, target: str, by: Sequence[str] = (), where: Column | None = None) -> None:
    """Rewrite small files as files of the advisory size; ``where`` picks partitions.

    AQE sizes the output tasks (spark.sql.adaptive.advisoryPartitionSizeInBytes), so
    the file count follows the data, whatever its volume.
    """
    df = spark.read.parquet(source)
    if where is not None:
        df = df.where(where)
    if by:
        write_partitioned(df, target, by)
    else:
        df.hint("rebalance").write.mode("overwrite").parquet(target)


def z_value(columns: Sequence[str], bits: int) -> Column:
    """Interleave the low ``bits`` bits of integer columns, first column most significant."""
    out = F.lit(0).cast("long")
    n = len(columns)
    for b in range(bits):
        for i, c in enumerate(columns):
            bit = F.shiftright(F.col(c), b).bitwiseAND(1).cast("long")
            out = out.bitwiseOR(F.shiftleft(bit, b * n + (n - 1 - i)))
    return out


def as_number(df: DataFrame, column: str) -> Column:
    """A column's value as a double of the same order; text by its first six bytes."""
    kind = df.schema[column].dataType.typeName()
    c = F.col(column)
    if kind.startswith(("timestamp", "date")):
        return c.cast("timestamp").cast("double")
    if kind == "string":
        return F.conv(F.rpad(F.hex(F.substring(c.cast("binary"), 1, 6)), 12, "0"), 16, 10).cast("double")
    return c.cast("double")


def z_order(df: DataFrame, columns: Sequence[str], bits: int = 4) -> DataFrame:
    """Cluster rows along a z-curve over equal-frequency ranges of each column.

    The number of files follows the bytes: AQE joins small neighbouring ranges up to
    spark.sql.adaptive.advisoryPartitionSizeInBytes.
    """
    cuts = [i / 2**bits for i in range(1, 2**bits)]
    bounds = df.agg(*[F.percentile_approx(as_number(df, c), cuts).alias(f"b{i}") for i, c in enumerate(columns)]).first()
    out = df
    for i, c in enumerate(columns):
        # At most 2^bits cuts per column, whatever the size of the table.
        below = [F.when(as_number(df, c) > F.lit(float(b)), 1).otherwise(0) for b in bounds[i] or []]
        out = out.withColumn(f"_z{i}", reduce(lambda x, y: x + y, below, F.lit(0)))
    ranks = [f"_z{i}" for i in range(len(columns))]
    out = out.withColumn("_z", z_value(ranks, bits)).drop(*ranks)
    # The other columns spread rows of one curve cell, so a full cell can still be split.
    spread = out.repartitionByRange("_z", *columns)
    return spread.sortWithinPartitions("_z").drop("_z")


def group_stats(df: DataFrame, group: str | Column, column: str) -> DataFrame:
    """Rows, min and max of a column per file or batch."""
    return df.groupBy(F.col(group) if isinstance(group, str) else group).agg(
        F.count("*").alias("n_rows"),
        F.min(column).alias("lo"),
        F.max(column).alias("hi"),
        F.count_if(F.col(column).isNull()).alias("nulls"),
    )


def overlap_counts(stats: DataFrame, group: str) -> DataFrame:
    """How many other files have a value range that meets this one's.

    others = all - 1 - (files that end before this starts) - (files that start after this
    ends).  Both come from one sorted pass over the range ends, with no pairing of files.
    At equal values a start sorts before an end, so touching ranges overlap.
    """
    one, zero = F.lit(1).cast("long"), F.lit(0).cast("long")
    ends = F.array(
        F.struct(F.col("lo").alias("v"), F.lit(0).alias("kind")), F.struct(F.col("hi").alias("v"), F.lit(1).alias("kind"))
    )
    points = stats.select(group, F.explode(ends).alias("p")).select(group, "p.v", "p.kind")
    seen = running(
        points,
        [],
        ["v", "kind", group],
        {"started": F.when(F.col("kind") == 0, one).otherwise(zero), "ended": F.when(F.col("kind") == 1, one).otherwise(zero)},
        {"files": F.when(F.col("kind") == 0, one).otherwise(zero)},
        settle_input=True,
    )
    per = seen.groupBy(group).agg(
        F.max(F.when(F.col("kind") == 0, F.col("ended"))).alias("ended_before"),
        F.max(F.when(F.col("kind") == 1, F.col("files") - F.col("started"))).alias("start_after"),
        F.max("files").alias("files"),
    )
    return per.select(group, (F.col("files") - 1 - F.col("ended_before") - F.col("start_after")).alias("overlaps"))


def partition_skew(df: DataFrame, by: Sequence[str], tiny_share: float, hot_share: float) -> DataFrame:
    """Rows and share per partition, flagged tiny or hot."""
    per = df.groupBy(*by).agg(F.count("*").alias("n_rows"))
    whole = per.agg(F.sum("n_rows")).scalar()
    share = F.col("n_rows") / whole
    flag = F.when(share < tiny_share, "tiny").when(share > hot_share, "hot").otherwise("ok")
    return per.withColumns({"share": share}).withColumn("flag", flag)


def bloom_options(df: DataFrame, columns: Sequence[str]) -> dict[str, str]:
    """Parquet writer options that add bloom filters for point lookups, sized by the columns' distinct values."""
    distinct = df.agg(*[F.approx_count_distinct(c).alias(c) for c in columns]).first()
    pairs = [
        (f"parquet.bloom.filter.{k}#{c}", v) for c in columns for k, v in (("enabled", "true"), ("expected.ndv", str(max(1, distinct[c]))))
    ]
    return dict(pairs)


def union_all(frames: Sequence[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), frames)
