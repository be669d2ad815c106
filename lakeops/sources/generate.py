"""Row generators: numbered rows, date spines and rule-driven tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def series(spark: SparkSession, first: int, last: int, name: str = "value") -> DataFrame:
    """Integers first..last, produced in parallel."""
    return spark.range(first, last + 1).withColumnRenamed("id", name)


def day_spine(df: DataFrame, column: str, name: str = "day") -> DataFrame:
    """Every day between the first and last date of a column."""
    ends = df.agg(F.min(F.to_date(column)).alias("lo"), F.max(F.to_date(column)).alias("hi"))
    return ends.select(F.explode(F.sequence("lo", "hi")).alias(name))


def rule_column(rule: dict, i: Column) -> Column:
    """One column of a generated table; ``i`` counts rows from 0.

    row_index: i + start.  id_sequence: prefix + zero-padded (i + start).
    cyclic_lookup: values in turn, at i * offset_multiplier.  padded_hash:
    i * multiplier mod modulo, zero-padded.  arithmetic: the same plus offset, as integer.
    double: min + (i mod modulo) / divisor.  date: base + (i * multiplier mod modulo) days.
    timestamp: base_micros + i * step_micros.  boolean_cond: i mod modulo = eq (or <> ne).
    """
    kind = rule["type"]
    step = i * rule.get("multiplier", 1) % rule["modulo"] if "modulo" in rule else i
    if kind == "row_index":
        return i + rule.get("start", 0)
    if kind == "id_sequence":
        number = (i + rule.get("start", 0)).cast("string")
        return F.concat(F.lit(rule.get("prefix", "")), F.lpad(number, rule["pad"], "0"))
    if kind == "cyclic_lookup":
        values = rule["values"]
        at = i * rule.get("offset_multiplier", 1) % len(values)
        return F.get(F.array(*[F.lit(v) for v in values]), at.cast("int"))
    if kind == "padded_hash":
        return F.lpad(step.cast("string"), rule["pad"], "0")
    if kind == "arithmetic":
        return step + rule.get("offset", 0)
    if kind == "double":
        return F.lit(float(rule["min"])) + step / F.lit(float(rule["divisor"]))
    if kind == "date":
        return F.date_add(F.lit(rule["base"]).cast("date"), step.cast("int"))
    if kind == "timestamp":
        return F.timestamp_micros(F.lit(rule["base_micros"]).cast("long") + i * rule["step_micros"])
    if kind == "boolean_cond":
        return step == rule["eq"] if "eq" in rule else step != rule["ne"]
    raise ValueError(f"unknown rule type {kind!r}")


def generate_table(spark: SparkSession, n: int, rules: Sequence[dict]) -> DataFrame:
    """``n`` rows, one column per rule.  Rows are made where they are used: no shuffle."""
    i = F.col("id")
    return spark.range(n).select(*[rule_column(r, i).alias(r["name"]) for r in rules])
