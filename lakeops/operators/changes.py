"""UPDATE, DELETE and MERGE as DataFrame -> DataFrame functions."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakeops.operators.ordered import latest

ACTION = "_action"


def holds(condition: Column) -> Column:
    """A condition as SQL applies it to rows: NULL counts as not met."""
    return F.coalesce(condition, F.lit(False))


def update(df: DataFrame, where: Column, values: dict[str, Column]) -> DataFrame:
    """UPDATE SET ... WHERE; all expressions see the old row."""
    hit = holds(where)
    types = {f.name: f.dataType for f in df.schema.fields}
    return df.withColumns({c: F.when(hit, v.cast(types[c])).otherwise(F.col(c)) for c, v in values.items()})


def delete(df: DataFrame, where: Column) -> DataFrame:
    """DELETE WHERE; rows for which the condition is NULL stay."""
    return df.where(~holds(where))


def update_passes(df: DataFrame, passes: Sequence[tuple[Column, dict[str, Column]]]) -> DataFrame:
    """Several UPDATEs in order, each seeing the result of the one before."""
    return reduce(lambda d, p: update(d, *p), passes, df)


@dataclass(frozen=True)
class Branch:
    """One WHEN branch.  ``kind`` is update, delete or insert; ``values`` maps target
    columns to expressions over ``t.<column>`` and ``s.<column>``."""

    kind: str
    when: Column | None = None
    values: dict[str, Column] = field(default_factory=dict)


def unique_source(source: DataFrame, on: Sequence[str]) -> DataFrame:
    """The source, failing at run time if two rows share a key (an ambiguous MERGE).

    The grouping uses the same keys as the merge join, which then needs no new shuffle.
    """
    rest = [c for c in source.columns if c not in on]
    row = F.struct(*rest) if rest else F.struct(F.lit(1).alias("_"))
    grouped = source.groupBy(*on).agg(F.count(F.lit(1)).alias("_n"), F.any_value(row).alias("_r"))
    checked = F.when(F.col("_n") > 1, F.raise_error(F.lit("MERGE source has duplicate keys"))).otherwise(F.col("_r"))
    return grouped.withColumn("_r", checked).select(*on, *[F.col("_r")[c].alias(c) for c in rest])


def merge_actions(
    target: DataFrame,
    source: DataFrame,
    on: Sequence[str],
    matched: Sequence[Branch] = (),
    not_matched: Sequence[Branch] = (),
    not_matched_by_source: Sequence[Branch] = (),
    unique_target: bool = True,
) -> DataFrame:
    """MERGE with an ``_action`` column: keep, update, delete or insert.

    Branches are tried in order; the first whose condition holds wins.  Source rows
    with no insert branch do not appear.  With unique target keys one full outer join
    is enough, as no key can be hot.  Otherwise a left join (whose left side AQE can
    split) is unioned with the source rows that have no target key.
    """
    columns = target.columns
    t = target.withColumn("_in_t", F.lit(True)).alias("t")
    s = unique_source(source, on).withColumn("_in_s", F.lit(True)).alias("s")
    cond = reduce(lambda a, b: a & b, [F.col(f"t.{k}") == F.col(f"s.{k}") for k in on])
    joined = t.join(s, cond, "full" if not_matched and unique_target else "left")
    in_t, in_s = F.col("t._in_t").isNotNull(), F.col("s._in_s").isNotNull()
    sides = [(in_t & in_s, matched), (in_t & ~in_s, not_matched_by_source), (~in_t & in_s, not_matched)]
    chain: list[tuple[Column, Branch]] = []
    for side, branches in sides:
        for b in branches:
            chain.append((side if b.when is None else side & holds(b.when), b))

    def choose(pick, default: Column) -> Column:
        out = None
        for test, b in chain:
            out = F.when(test, pick(b)) if out is None else out.when(test, pick(b))
        return default if out is None else out.otherwise(default)

    action = choose(lambda b: F.lit(b.kind), F.when(in_t, F.lit("keep")))
    types = {f.name: f.dataType for f in target.schema.fields}

    def value(c: str) -> Column:
        def pick(b: Branch) -> Column:
            if c in b.values:
                return b.values[c].cast(types[c])
            if b.kind == "insert":
                return F.lit(None).cast(types[c])
            return F.col(f"t.{c}")

        return choose(pick, F.col(f"t.{c}"))

    out = joined.select(action.alias(ACTION), *[value(c).alias(c) for c in columns])
    if not_matched and not unique_target:
        nulls = [F.lit(None).cast(f.dataType).alias(f.name) for f in target.schema.fields]
        fresh = source.join(target.select(*on).distinct(), list(on), "left_anti")
        packed = unique_source(fresh, on).select(
            F.struct(*nulls, F.lit(None).cast("boolean").alias("_in_t")).alias("t"),
            F.struct(*on, *[c for c in source.columns if c not in on], F.lit(True).alias("_in_s")).alias("s"),
        )
        out = out.unionByName(packed.select(action.alias(ACTION), *[value(c).alias(c) for c in columns]))
    return out.where(F.col(ACTION).isNotNull())


def merge(target, source, on, matched=(), not_matched=(), not_matched_by_source=(), unique_target=True) -> DataFrame:
    """The table after a MERGE; see ``merge_actions``."""
    acted = merge_actions(target, source, on, matched, not_matched, not_matched_by_source, unique_target)
    return acted.where(F.col(ACTION) != "delete").drop(ACTION)


def affected(acted: DataFrame) -> DataFrame:
    """Rows touched per action (the count a MERGE statement reports)."""
    return acted.where(F.col(ACTION) != "keep").groupBy(F.col(ACTION).alias("action")).agg(F.count("*").alias("n_rows"))


def upsert(target, source, on) -> DataFrame:
    """MERGE: matched rows take the source values, others are inserted."""
    values = {c: F.col(f"s.{c}") for c in target.columns}
    return merge(target, source, on, [Branch("update", None, values)], [Branch("insert", None, values)])


def merge_partitions(target, source, on, partition: str) -> tuple[DataFrame, DataFrame]:
    """Upsert that only joins the partitions the source names: (rewritten, untouched).

    The partition list has one row per partition and reaches the target scan as a
    dynamic partition filter when the target is stored by that column.
    """
    touched = source.select(partition).distinct()
    rewritten = upsert(target.join(touched, partition, "left_semi"), source, on)
    return rewritten, target.join(touched, partition, "left_anti")


def scd2(dim: DataFrame, changes: DataFrame, key: str, tracked: Sequence[str], effective: str) -> DataFrame:
    """Type 2 dimension: close the current row of a changed key and add its new version.

    ``dim`` has key, tracked columns, valid_from, valid_to and is_current (0/1).
    ``changes`` has one row per key.  A change equal to the current row does nothing.
    """
    current = dim.where("is_current = 1").select(key, *[F.col(c).alias(f"_old_{c}") for c in tracked], F.lit(True).alias("_known"))
    differs = reduce(lambda a, b: a | b, [~F.col(c).eqNullSafe(F.col(f"_old_{c}")) for c in tracked])
    news = (
        unique_source(changes.select(key, *tracked, effective), [key])
        .join(current, key, "left")
        .where(F.col("_known").isNull() | differs)
        .select(key, *tracked, effective)
    )
    ends = news.select(key, F.col(effective).alias("_end"))
    closing = (F.col("is_current") == 1) & F.col("_end").isNotNull()
    closed = dim.join(ends, key, "left").withColumns(
        {
            "valid_to": F.when(closing, F.col("_end")).otherwise(F.col("valid_to")),
            "is_current": F.when(closing, F.lit(0)).otherwise(F.col("is_current")),
        }
    )
    added = news.select(
        key,
        *tracked,
        F.col(effective).alias("valid_from"),
        F.lit(None).cast(dim.schema["valid_to"].dataType).alias("valid_to"),
        F.lit(1).alias("is_current"),
    )
    return closed.drop("_end").unionByName(added)


def dedup_then_upsert(target, source, on, order) -> DataFrame:
    """Keep the latest source row per key, then upsert."""
    return upsert(target, latest(source, on, order), on)


def equality_deletes(df: DataFrame, deletes: DataFrame) -> DataFrame:
    """Remove rows that equal some delete row in all of its columns (NULL equals NULL)."""
    keys = deletes.distinct().select(*[F.col(c).alias(f"_d_{c}") for c in deletes.columns])
    cond = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_d_{c}")) for c in deletes.columns])
    return df.join(keys, cond, "left_anti")


def position_deletes(df: DataFrame, deletes: DataFrame, file="file_name", pos="row_index") -> DataFrame:
    """Remove rows by (file, row position); ``df`` carries both columns."""
    return df.join(deletes.select(file, pos).distinct(), [file, pos], "left_anti")


def append_only_violations(old: DataFrame, new: DataFrame, key: Sequence[str]) -> DataFrame:
    """Old rows that the new table lost (``deleted``) or holds differently (``updated``)."""
    rest = [c for c in old.columns if c not in key]
    o = old.select(*key, F.struct(*rest).alias("_old"))
    n = new.select(*key, F.struct(*rest).alias("_new"), F.lit(True).alias("_there"))
    joined = o.join(n, list(key), "left")
    kind = F.when(F.col("_there").isNull(), "deleted").when(~F.col("_old").eqNullSafe(F.col("_new")), "updated")
    return joined.withColumn("violation", kind).where("violation IS NOT NULL").select(*key, "violation")
