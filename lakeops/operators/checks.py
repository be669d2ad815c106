"""Data checks as DataFrames: rows of (check_name, severity, expected, actual, result)."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

COLUMNS = ["check_name", "severity", "expected", "actual", "result"]


@dataclass(frozen=True)
class Check:
    """``measure`` is an aggregate; it is compared with ``expected`` by ``op`` (=, >=, <=).

    ``expected`` may also be an aggregate of the same table.  ``tolerance`` widens =.
    """

    name: str
    measure: Column
    op: str
    expected: float | int | Column
    tolerance: float = 0.0
    severity: str = "error"


def run_checks(df: DataFrame, checks: Sequence[Check]) -> DataFrame:
    """All checks in one pass over ``df``; a NULL measure fails."""
    aggs = []
    for i, k in enumerate(checks):
        expected = k.expected if isinstance(k.expected, Column) else F.lit(k.expected)
        aggs += [k.measure.cast("double").alias(f"a{i}"), expected.cast("double").alias(f"e{i}")]

    def verdict(i: int, k: Check) -> Column:
        a, e = F.col(f"a{i}"), F.col(f"e{i}")
        test = {"=": F.abs(a - e) <= k.tolerance, ">=": a >= e, "<=": a <= e}[k.op]
        return F.when(test, "PASS").otherwise(F.when(F.lit(k.severity == "warning"), "WARN").otherwise("FAIL"))

    rows = F.array(
        *[
            F.struct(
                F.lit(k.name).alias("check_name"),
                F.lit(k.severity).alias("severity"),
                F.col(f"e{i}").alias("expected"),
                F.col(f"a{i}").alias("actual"),
                verdict(i, k).alias("result"),
            )
            for i, k in enumerate(checks)
        ]
    )
    return df.agg(*aggs).select(F.explode(rows).alias("r")).select("r.*")


def value_where(column: str, where: Column) -> Column:
    """The value of the row(s) that meet a condition (the largest, if several)."""
    return F.max(F.when(where, F.col(column)))


def number(text: Column) -> Column:
    """Text such as ``1,234.50`` as a number."""
    return F.replace(text, F.lit(","), F.lit("")).try_cast("double")


def missing_rows(df: DataFrame, expected: DataFrame) -> DataFrame:
    """Expected tuples that the result lacks."""
    have = df.select(*expected.columns).distinct()
    renamed = have.toDF(*[f"_h_{c}" for c in expected.columns])
    cond = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_h_{c}")) for c in expected.columns])
    return expected.join(renamed, cond, "left_anti")


def orphans(child: DataFrame, parent: DataFrame, child_key: str, parent_key: str) -> DataFrame:
    """Child rows whose key is set but has no parent."""
    keys = parent.select(F.col(parent_key).alias("_pk")).distinct()
    rows = child.where(F.col(child_key).isNotNull())
    return rows.join(keys, F.col(child_key) == F.col("_pk"), "left_anti")


def failures(results: Sequence[DataFrame]) -> DataFrame:
    """All check rows whose result starts with FAIL."""
    every = reduce(lambda a, b: a.unionByName(b), [r.select(*COLUMNS) for r in results])
    return every.where(F.col("result").startswith("FAIL"))
