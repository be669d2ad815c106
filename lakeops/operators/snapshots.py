"""Versions of a table kept as a change log: one row per change, with a version number.

A log has key columns, payload columns, ``version``, ``seq`` (order inside a version),
``op`` (``upsert`` or ``delete``) and ``commit_ts``.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakeops.operators.ordered import latest, row_frames, row_numbers, running

META = ["version", "seq", "op", "commit_ts"]


def payload(log: DataFrame, keys: Sequence[str]) -> list[str]:
    return [c for c in log.columns if c not in META and c not in keys]


def _state(log: DataFrame, keys: Sequence[str]) -> DataFrame:
    last = latest(log, keys, ["version", "seq"])
    return last.where("op <> 'delete'").select(*keys, *payload(log, keys))


def as_of_version(log: DataFrame, keys: Sequence[str], version: int) -> DataFrame:
    """The table at a version: last change per key, deleted keys dropped.

    The version filter reaches the scan; ``latest`` is an aggregate with map-side combine.
    """
    return _state(log.where(F.col("version") <= version), keys)


def as_of_time(log: DataFrame, keys: Sequence[str], at: Column) -> DataFrame:
    return _state(log.where(F.col("commit_ts") <= at), keys)


def _paired(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Full outer pairing of two snapshots; keys are unique in each."""
    cols = [c for c in old.columns if c not in keys]
    a = old.select(*keys, F.struct(*cols).alias("before"))
    b = new.select(*keys, F.struct(*cols).alias("after"))
    return a.join(b, list(keys), "full")


def modified(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys in both snapshots whose rows differ, with old_ and new_ columns."""
    cols = [c for c in old.columns if c not in keys]
    a = old.select(*keys, *[F.col(c).alias(f"old_{c}") for c in cols])
    b = new.select(*keys, *[F.col(c).alias(f"new_{c}") for c in cols])
    differs = reduce(lambda x, y: x | y, [~F.col(f"old_{c}").eqNullSafe(F.col(f"new_{c}")) for c in cols])
    return a.join(b, list(keys)).where(differs)


def change_feed(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Typed change rows between snapshots: insert, delete, update_preimage, update_postimage."""
    cols = [c for c in old.columns if c not in keys]
    before, after = F.col("before"), F.col("after")
    rows = (
        F.when(before.isNull(), F.array(F.struct(F.lit("insert").alias("k"), after.alias("r"))))
        .when(after.isNull(), F.array(F.struct(F.lit("delete").alias("k"), before.alias("r"))))
        .when(
            ~before.eqNullSafe(after),
            F.array(
                F.struct(F.lit("update_preimage").alias("k"), before.alias("r")),
                F.struct(F.lit("update_postimage").alias("k"), after.alias("r")),
            ),
        )
    )
    fed = _paired(old, new, keys).withColumn("_c", F.explode(rows))
    return fed.select(*keys, F.col("_c.k").alias("change_type"), *[F.col("_c.r")[c].alias(c) for c in cols])


def restore(log: DataFrame, keys: Sequence[str], to: int, as_version: int, where: Column | None = None) -> DataFrame:
    """Log rows of a new version that bring the table (or the part ``where`` selects) back to ``to``."""
    old, now = as_of_version(log, keys, to), _state(log, keys)
    if where is not None:
        old, now = old.where(where), now.where(where)
    cols = payload(log, keys)
    before, after = F.col("before"), F.col("after")
    changed = _paired(now, old, keys).where(~before.eqNullSafe(after))
    op = F.when(after.isNull(), "delete").otherwise("upsert")
    row = F.when(after.isNull(), before).otherwise(after)
    return changed.select(*keys, *[row[c].alias(c) for c in cols], F.lit(as_version).alias("version"), op.alias("op"))


def history(log: DataFrame) -> DataFrame:
    """One row per version: when, and how many rows were written or deleted."""
    return log.groupBy("version").agg(
        F.max("commit_ts").alias("commit_ts"),
        F.count_if(F.col("op") != "delete").alias("upserts"),
        F.count_if(F.col("op") == "delete").alias("deletes"),
    )


def validity(log: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Each change with ``next_version``, the version that superseded it (NULL = still valid)."""

    def build(frame, w):
        return {"next_version": F.lead("version").over(w)}

    return row_frames(log, keys, ["version", "seq"], 0, 1, build)


def rows_per_version(log: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Row count of every version, from one pass over the log instead of one read per version."""
    live = validity(log, keys).where("op <> 'delete' AND (next_version IS NULL OR next_version > version)")
    steps = F.array(
        F.struct(F.col("version").alias("v"), F.lit(1).cast("long").alias("d")),
        F.struct(F.col("next_version").alias("v"), F.lit(-1).cast("long").alias("d")),
    )
    deltas = live.select(F.explode(steps).alias("s")).where("s.v IS NOT NULL")
    # Versions without a net change still get a row.
    versions = log.select("version").distinct().select("version", F.lit(0).cast("long").alias("d"))
    per = deltas.select(F.col("s.v").alias("version"), F.col("s.d").alias("d")).unionByName(versions)
    net = per.groupBy("version").agg(F.sum("d").alias("d"))
    return running(net, [], ["version"], {"n_rows": F.col("d")}, settle_input=True).drop("d")


def retention(log: DataFrame, keys: Sequence[str], keep_from: int) -> DataFrame:
    """Per version: log rows, how many are superseded, and whether the version may be dropped."""
    marked = validity(log, keys)
    return marked.groupBy("version").agg(
        F.count("*").alias("log_rows"),
        F.count_if(F.col("next_version").isNotNull()).alias("superseded"),
        F.count_if(F.col("next_version") <= keep_from).alias("removable"),
    ).withColumn("outside_window", F.col("version") < keep_from)


def lineage(log: DataFrame, keys: Sequence[str]) -> DataFrame:
    """All changes of every record, numbered in order."""
    return row_numbers(log, keys, ["version", "seq"], "change_no", total="changes")


def compare_to_good(log: DataFrame, keys: Sequence[str], bad_version: int) -> DataFrame:
    """Keys written by a bad version: value before it and value now, where they differ."""
    touched = log.where(F.col("version") == bad_version).select(*keys).distinct()
    good = as_of_version(log, keys, bad_version - 1).join(touched, list(keys), "left_semi")
    now = _state(log, keys).join(touched, list(keys), "left_semi")
    return _paired(good, now, keys).where(~F.col("before").eqNullSafe(F.col("after")))
