"""Column statistics by sketches."""

from pyspark.sql import functions as F

from lakeops.operators import schema as c
from lakeops.sources.files import detect_schema


def test_distinct_sketches_merge_without_expanding_rows(spark):
    wide = spark.range(60_000).select(
        F.col("id"), *[(F.col("id") % (300 * (i + 1))).alias(f"v{i}") for i in range(40)], F.lit(None).cast("double").alias("none"), (F.col("id") % 7).alias("part")
    )
    names = [n for n in wide.columns if n != "part"]
    exact = {"id": 60_000, "none": 0} | {f"v{i}": 300 * (i + 1) for i in range(40)}
    per_part = c.distinct_sketches(wide, names, ["part"])
    told = {r["column_name"]: r["distinct_values"] for r in c.distinct_of_sketches(per_part, names).collect()}
    assert told.keys() == exact.keys() and all(abs(told[n] - exact[n]) <= 0.04 * exact[n] for n in names)
    profile = c.column_profile(wide, names, sketch_bits=c.SKETCH_BITS)
    assert "Expand" not in profile._jdf.queryExecution().executedPlan().toString()
    rows = {r["column_name"]: r for r in profile.collect()}
    assert all(abs(rows[n]["distinct_values"] - exact[n]) <= 0.04 * exact[n] for n in names)
    assert rows["none"]["nulls"] == 60_000 and rows["v1"]["max_value"] == "599"
    some = names[:3]
    assert {r["column_name"]: r["distinct_values"] for r in c.distinct_exact(wide, some).collect()} == {n: exact[n] for n in some}
    empty = c.distinct_of_sketches(c.distinct_sketches(wide.limit(0), some, ["part"]), some).collect()
    assert [r["distinct_values"] for r in empty] == [0, 0, 0]


def test_detected_schema_with_sketches(spark):
    df = spark.range(5_000).select("id", (F.col("id") % 90).cast("string").alias("s"), F.when(F.col("id") < 10, F.col("id") * 0.5).alias("d"))
    found = detect_schema(df, sketch_bits=14)
    assert "Expand" not in found._jdf.queryExecution().executedPlan().toString()
    got = {r["column_name"]: (r["data_type"], r["nulls"], r["distinct_values"]) for r in found.collect()}
    assert got["s"] == ("string", 0, 90) and got["d"] == ("double", 4_990, 10) and abs(got["id"][2] - 5_000) <= 200
    assert {r["column_name"]: r["distinct_values"] for r in detect_schema(df).collect()} == {"id": 5_000, "s": 90, "d": 10}


def test_exact_profile_deals_its_rows(spark):
    df = spark.createDataFrame([(1, "a"), (2, "a"), (None, "b")], "x int, y string").coalesce(1)
    found = c.column_profile(df)
    assert "RoundRobinPartitioning" in found._jdf.queryExecution().executedPlan().toString()
    assert {r["column_name"]: (r["n_rows"], r["nulls"], r["distinct_values"]) for r in found.collect()} == {"x": (3, 1, 2), "y": (3, 0, 2)}
