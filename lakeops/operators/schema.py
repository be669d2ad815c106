"""Schema changes, row rules and column statistics."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def add_columns(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """New columns, NULL in existing rows: name -> type."""
    return df.withColumns({c: F.lit(None).cast(t) for c, t in columns.items()})


def reorder(df: DataFrame, column: str, after: str | None = None) -> DataFrame:
    """Move a column to the front, or behind another one."""
    rest = [c for c in df.columns if c != column]
    at = 0 if after is None else rest.index(after) + 1
    return df.select(*rest[:at], column, *rest[at:])


def meeting_type(spark: SparkSession, types: Sequence[str]) -> str:
    """The type Spark gives to a value that may be of any of ``types``; text if there is none.

    Text meets any other type as text: it may hold what no number or date can.
    """
    kinds = list(dict.fromkeys(t for t in types if t != "void"))
    if len(kinds) < 2 or "string" in kinds:
        return "string" if "string" in kinds else (kinds or ["void"])[0]
    try:
        return spark.range(0).select(F.coalesce(*[F.lit(None).cast(t) for t in kinds]).alias("v")).dtypes[0][1]
    except AnalysisException:
        return "string"


def widen(df: DataFrame, types: dict[str, str]) -> DataFrame:
    """Cast columns to a wider type; a type that does not hold all old values is refused."""
    have = dict(df.dtypes)
    for c, t in types.items():
        if meeting_type(df.sparkSession, [have[c], t]) != t:
            raise ValueError(f"{c}: {have[c]} to {t} is not a widening")
    return df.withColumns({c: F.col(c).cast(t) for c, t in types.items()})


def widest_union(frames: Sequence[DataFrame]) -> DataFrame:
    """UNION ALL of frames with different columns and types; absent columns are NULL."""
    seen: dict[str, list[str]] = {}
    for name, kind in (field for df in frames for field in df.dtypes):
        seen.setdefault(name, []).append(kind)
    types = {name: meeting_type(frames[0].sparkSession, kinds) for name, kinds in seen.items()}
    rows = [df.select(*[F.col(f"`{c}`").cast(types[c]).alias(c) for c in df.columns]) for df in frames]
    return reduce(lambda x, y: x.unionByName(y, allowMissingColumns=True), rows).select(*[F.col(f"`{c}`") for c in types])


def map_columns(df: DataFrame, names: dict[str, str]) -> DataFrame:
    """Physical to logical names; columns outside the mapping are dropped."""
    return df.select(*[F.col(p).alias(n) for p, n in names.items()])


def validate(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """Add ``violations``: names of the rules a row breaks.  As with CHECK, NULL passes."""
    broken = [F.when(~F.coalesce(test, F.lit(True)), F.lit(name)) for name, test in rules.items()]
    return df.withColumn("violations", F.array_compact(F.array(*broken)))


def split_valid(df: DataFrame, rules: dict[str, Column]) -> tuple[DataFrame, DataFrame]:
    """(valid rows, rejected rows with their rule names)."""
    marked = validate(df, rules)
    ok = F.size("violations") == 0
    return marked.where(ok).drop("violations"), marked.where(~ok)


def violation_counts(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """(rule, violations, n_rows) from one pass."""
    counts = [F.count_if(~F.coalesce(test, F.lit(True))).alias(n) for n, test in rules.items()]
    one = df.agg(F.count(F.lit(1)).alias("n_rows"), *counts)
    return one.unpivot(["n_rows"], list(rules), "rule", "violations").select("rule", "violations", "n_rows")


def with_defaults(df: DataFrame, defaults: dict[str, Column]) -> DataFrame:
    return df.withColumns({c: F.coalesce(F.col(c), v) for c, v in defaults.items()})


def _facts(one_row: DataFrame, columns: Sequence[str], facts: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Turn aggregate columns ``<column>__<fact>`` into one row per column."""
    per_column = F.array(
        *[F.struct(F.lit(c).alias("column_name"), *[F.col(f"{c}__{f}").alias(f) for f in facts]) for c in columns]
    )
    return one_row.select(*by, F.explode(per_column).alias("r")).select(*by, "r.*")


#: Sketches of 2^14 slots; the standard error of a count of distinct values is about 0.8 %.
SKETCH_BITS = 14


def _sketch(c: str, bits: int) -> Column:
    # Sketches take whole numbers and text; a type's text tells its values apart.
    return F.hll_sketch_agg(F.col(c).cast("string"), F.lit(bits))


def distinct_sketches(df: DataFrame, columns: Sequence[str], by: Sequence[str] = (), bits: int = SKETCH_BITS) -> DataFrame:
    """One row per ``by`` (a file, a day) with a sketch of each column's distinct values.

    Sketches are of fixed size, take one pass for any number of columns, and can be kept and merged
    later, so that new files need no second look at the old ones.
    """
    return df.groupBy(*by).agg(*[_sketch(c, bits).alias(c) for c in columns])


def distinct_of_sketches(sketches: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column_name, distinct_values) that the merged sketches of all rows estimate; NULL is no value."""
    merged = sketches.agg(*[F.coalesce(F.hll_sketch_estimate(F.hll_union_agg(c)), F.lit(0)).alias(c) for c in columns])
    return merged.unpivot([], list(columns), "column_name", "distinct_values")


def distinct_exact(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column_name, distinct_values), counted exactly: one aggregate per column, so no row is multiplied."""
    one = [df.agg(F.lit(c).alias("column_name"), F.countDistinct(c).alias("distinct_values")) for c in columns]
    return reduce(DataFrame.unionByName, one)


def column_profile(
    df: DataFrame, columns: Sequence[str] | None = None, distinct: bool = True, by: Sequence[str] = (), sketch_bits: int | None = None
) -> DataFrame:
    """Per column: rows, nulls, distinct values, min and max as text.

    Exact distinct counts multiply each row by the number of columns, in tasks that have an equal share
    of the rows; with ``sketch_bits`` they are estimates, made in the same pass as the rest.
    """
    columns = list(columns or [c for c in df.columns if c not in by])
    if distinct and sketch_bits is None:
        # Dealt to all tasks, so that the one that reads a file does not hold all its values.
        df = df.select(*dict.fromkeys([*by, *columns])).repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    facts = ["n_rows", "nulls", *(["distinct_values"] if distinct else []), "min_value", "max_value"]
    aggs = []
    for c in columns:
        aggs += [
            F.count(F.lit(1)).alias(f"{c}__n_rows"),
            F.count_if(F.col(c).isNull()).alias(f"{c}__nulls"),
            F.min(c).cast("string").alias(f"{c}__min_value"),
            F.max(c).cast("string").alias(f"{c}__max_value"),
        ]
        if distinct:
            number = F.countDistinct(c) if sketch_bits is None else F.hll_sketch_estimate(_sketch(c, sketch_bits))
            aggs.append(number.alias(f"{c}__distinct_values"))
    return _facts(df.groupBy(*by).agg(*aggs), columns, facts, by)


def null_profile(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Per column: NULLs and fill rate, from one pass."""
    aggs = []
    for c in columns:
        aggs += [
            F.count_if(F.col(c).isNull()).alias(f"{c}__nulls"),
            (F.count(c).cast("double") / F.count(F.lit(1))).alias(f"{c}__fill_rate"),
        ]
    return _facts(df.agg(*aggs), columns, ["nulls", "fill_rate"])


def text_profile(df: DataFrame, columns: Sequence[str], long_over: int = 32, prefix: int = 4) -> DataFrame:
    """Per text column: shortest, longest, count over a length, distinct prefixes."""
    aggs = []
    for c in columns:
        aggs += [
            F.min(F.length(c)).cast("long").alias(f"{c}__min_length"),
            F.max(F.length(c)).cast("long").alias(f"{c}__max_length"),
            F.count_if(F.length(c) > long_over).alias(f"{c}__long_values"),
            F.countDistinct(F.substring(c, 1, prefix)).alias(f"{c}__prefixes"),
        ]
    return _facts(df.agg(*aggs), columns, ["min_length", "max_length", "long_values", "prefixes"])


def overflow_watch(df: DataFrame, columns: Sequence[str], limit: int = 2**31 - 1) -> DataFrame:
    """Largest absolute value per column, its share of a type limit, and a risk tier."""
    one = df.agg(*[F.max(F.abs(F.col(c).cast("double"))).alias(c) for c in columns])
    rows = one.unpivot([], list(columns), "column_name", "largest")
    pct = F.col("largest") * 100.0 / limit
    tier = F.when(pct >= 80, "critical").when(pct >= 50, "warning").otherwise("safe")
    return rows.withColumns({"pct_of_limit": pct, "risk": tier})


def column_catalog(tables: dict[str, DataFrame]) -> DataFrame:
    """(table, position, column, type, filled): the declared columns and how many values each holds."""
    parts = []
    for name, df in tables.items():
        counted = df.agg(*[F.count(c).alias(c) for c in df.columns])
        rows = F.array(
            *[
                F.struct(
                    F.lit(name).alias("table_name"),
                    F.lit(i + 1).alias("position"),
                    F.lit(c).alias("column_name"),
                    F.lit(t).alias("data_type"),
                    F.col(c).alias("filled"),
                )
                for i, (c, t) in enumerate(df.dtypes)
            ]
        )
        parts.append(counted.select(F.explode(rows).alias("r")).select("r.*"))
    return reduce(lambda a, b: a.unionByName(b), parts)


