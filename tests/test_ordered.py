"""Ordered operators against pandas, with one key that holds most rows, NULL keys and many slices."""

import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from lakeops.operators.joins import overlap_counts, overlap_join
from lakeops.operators import ordered as o


@pytest.fixture(scope="module")
def rows():
    rnd = random.Random(1)
    out = []
    for i in range(700):
        k = "hot" if i % 3 else rnd.choice(["a", "b", "c", None])
        out.append((i, k, rnd.randrange(40), rnd.randrange(1000)))
    return pd.DataFrame(out, columns=["id", "k", "o", "v"])


@pytest.fixture(scope="module")
def df(spark, rows):
    return spark.createDataFrame(rows.astype(object).where(rows.notna(), None).values.tolist(), "id long, k string, o long, v long").cache()


def got(df, col):
    return {r["id"]: r[col] for r in df.collect()}


def groups(rows):
    return rows.sort_values(["o", "id"], ascending=[False, True]).groupby("k", dropna=False)


def test_row_numbers_and_running(df, rows):
    out = o.running(df, ["k"], ["-o", "id"], {"rn": F.lit(1).cast("long"), "s": F.col("v")}, {"n": F.lit(1).cast("long")}, slices=13).cache()
    g = groups(rows)
    assert got(out, "rn") == dict(zip(rows.id, (g.cumcount() + 1).reindex(rows.index)))
    assert got(out, "s") == dict(zip(rows.id, g.v.cumsum().reindex(rows.index)))
    assert got(out, "n") == dict(zip(rows.id, g.v.transform("size").reindex(rows.index)))


def test_ranks(df, rows):
    out = o.rank_columns(df, ["k"], ["o"], {"r": "rank", "d": "dense_rank", "p": "percent_rank", "c": "cume_dist"}, slices=7).cache()
    g = rows.groupby("k", dropna=False).o
    n = g.transform("size")
    assert got(out, "r") == dict(zip(rows.id, g.rank(method="min").astype(int)))
    assert got(out, "d") == dict(zip(rows.id, g.rank(method="dense").astype(int)))
    assert got(out, "p") == pytest.approx(dict(zip(rows.id, (g.rank(method="min") - 1) / (n - 1))))
    assert got(out, "c") == pytest.approx(dict(zip(rows.id, g.rank(method="max") / n)))


def test_ntile(df, spark):
    df.createOrReplaceTempView("ordered_rows")
    want = spark.sql("SELECT id, ntile(6) OVER (PARTITION BY k ORDER BY o, id) t FROM ordered_rows")
    assert got(o.ntile(df, ["k"], ["o", "id"], 6, slices=9), "tile") == got(want, "t")


def test_row_frames_across_blocks(df, spark):
    def build(frame, w):
        return {"m": F.sum("v").over(frame), "b": F.lag("v", 2).over(w), "a": F.lead("v").over(w)}

    out = o.row_frames(df, ["k"], ["o", "id"], 2, 1, build, block_rows=11, slices=9).cache()
    df.createOrReplaceTempView("ordered_rows")
    want = spark.sql(
        """SELECT id, sum(v) OVER (PARTITION BY k ORDER BY o, id ROWS BETWEEN 2 PRECEDING AND 1 FOLLOWING) m, lag(v, 2) OVER w b, lead(v) OVER w a
           FROM ordered_rows WINDOW w AS (PARTITION BY k ORDER BY o, id)"""
    ).cache()
    for c in "mba":
        assert got(out, c) == got(want, c)
    assert out.count() == df.count()


def test_global_order(df, rows):
    out = o.row_numbers(df, [], ["v", "id"], slices=5)
    want = rows.sort_values(["v", "id"]).id.tolist()
    assert got(out, "rn") == {k: i + 1 for i, k in enumerate(want)}


def test_hot_key_is_spread_over_slices(df):
    per = o.with_slice(df, ["k"], ["o", "id"], 10).where("k = 'hot'").groupBy(o.SLICE).count().collect()
    assert len(per) >= 5 and max(r["count"] for r in per) < 200


def test_many_cuts(df):
    few, many = o.with_slice(df, ["k"], ["-o", "id"], 10), o.with_slice(df, ["k"], ["-o", "id"], 60)
    both = few.withColumnRenamed(o.SLICE, "few").join(many.select("id", o.SLICE), "id")
    # Both rise with the same order, so a finer slice never lies in two places of the coarse order.
    spread = both.groupBy("few").agg(F.min(o.SLICE).alias("lo"), F.max(o.SLICE).alias("hi")).orderBy("few").collect()
    assert len(spread) == 10 and all(a["hi"] <= b["lo"] for a, b in zip(spread, spread[1:]))
    out = o.row_numbers(df, ["k"], ["-o", "id"], slices=60)
    assert got(out, "rn") == got(o.row_numbers(df, ["k"], ["-o", "id"], slices=3), "rn")


def test_overlaps_of_minutes_and_years(spark):
    rnd = random.Random(3)
    rows = [(i, i % 2, s, s + rnd.choice([0, 1, 5, 60, 5_000, 400_000])) for i, s in enumerate(rnd.choices([*range(0, 500), *range(0, 500_000, 700)], k=160))]
    rows += [(1000, 0, -90, 600_000), (1001, 1, -(2**40), 2**40), (1002, 0, None, 5), (1003, 1, 5, None)]
    df = spark.createDataFrame(rows, "id long, k int, s long, e long")
    got = [(r["k"], r["first_id"], r["second_id"]) for r in overlap_join(df, ["k"], "id", "s", "e").collect()]
    whole = [r for r in rows if None not in r]
    want = {(a[1], a[0], b[0]) for a in whole for b in whole if a[0] < b[0] and a[1] == b[1] and a[2] < b[3] and b[2] < a[3]}
    assert len(got) == len(set(got)) and set(got) == want
    assert overlap_join(df.limit(0), ["k"], "id", "s", "e").count() == 0


def test_overlap_counts_match_brute_force(spark):
    rows = [(i, "hot" if i % 3 else "x", (i * 37) % 50, (i * 37) % 50 + (i * 7) % 12) for i in range(150)]
    bad = [(900, None, 1, 5), (901, "x", None, 5), (902, "x", 9, 4)]
    df = spark.createDataFrame(rows + bad, "id long, k string, s long, e long")
    want = {
        (a[1], a[0], sum(a[0] != b[0] and a[1] == b[1] and a[2] < b[3] and b[2] < a[3] for b in rows)) for a in rows
    }
    assert any(a[2] == a[3] for a in rows)
    got = overlap_counts(df, ["k"], "id", "s", "e").collect()
    assert {(r["k"], r["id"], r["overlaps"]) for r in got} == want and len(got) == len(want)
    pairs = overlap_join(df.where("id < 900"), ["k"], "id", "s", "e").count()
    assert 2 * pairs == sum(n for *_, n in want)
    assert overlap_counts(df.limit(0), ["k"], "id", "s", "e").count() == 0


def test_top_k_cuts_keys_before_the_shuffle_for_large_k(spark):
    from lakeops.operators.ordered import top_k

    df = spark.range(5000).selectExpr("id", "id % 2 AS k")
    top = top_k(df, ["k"], ["-id"], 2000)
    assert "WindowGroupLimit" in top._jdf.queryExecution().executedPlan().toString()
    assert top.count() == 4000 and top.where("k = 0").agg(F.min("id")).first()[0] == 4998 - 2 * 1999


def test_overlap_starts_are_copied_for_few_widths(spark):
    rows = [(i, "k", 1000 * i, 1000 * i + 2**i) for i in range(30)]
    df = spark.createDataFrame(rows, "id long, k string, s long, e long")
    pairs = overlap_join(df, ["k"], "id", "s", "e")
    assert "[0,4,8,12,16,20,24,28]" in pairs._jdf.queryExecution().optimizedPlan().toString()
    want = sorted((a[0], b[0]) for a in rows for b in rows if a[0] < b[0] and a[2] < b[3] and b[2] < a[3])
    assert sorted((r["first_id"], r["second_id"]) for r in pairs.collect()) == want
