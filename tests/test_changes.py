import pytest
from pyspark.sql import functions as F

from lakeops.operators import changes as c
from lakeops.operators import joins
from lakeops.operators import snapshots as s


@pytest.fixture(scope="module")
def tables(spark):
    t = spark.createDataFrame([(1, "a", 10), (2, "b", 20), (3, "c", 30), (4, "d", None)], "k long, n string, v long")
    f = spark.createDataFrame([(2, "B", 5), (3, "C", 99), (7, "G", 70)], "k long, n string, v long")
    return t, f


def branches():
    return (
        [c.Branch("update", F.col("s.v") > 50, {"v": F.col("s.v")}), c.Branch("delete")],
        [c.Branch("insert", None, {x: F.col(f"s.{x}") for x in ("k", "n", "v")})],
        [c.Branch("update", F.col("t.v") > 5, {"n": F.lit("gone")})],
    )


@pytest.mark.parametrize("unique", [True, False])
def test_merge_branches(tables, unique):
    out = c.merge(*tables, ["k"], *branches(), unique_target=unique).orderBy("k").collect()
    assert [tuple(r) for r in out] == [(1, "gone", 10), (3, "c", 99), (4, "d", None), (7, "G", 70)]


def test_affected_counts(tables):
    rows = c.affected(c.merge_actions(*tables, ["k"], *branches())).collect()
    assert {r["action"]: r["n_rows"] for r in rows} == {"update": 2, "delete": 1, "insert": 1}


def test_duplicate_source_keys_fail(tables):
    t, f = tables
    with pytest.raises(Exception, match="duplicate keys"):
        c.upsert(t, f.unionAll(f), ["k"]).collect()


def test_delete_keeps_null_conditions(tables):
    assert [r["k"] for r in c.delete(tables[0], F.col("v") > 15).orderBy("k").collect()] == [1, 4]


def test_scd2_closes_and_opens(spark):
    dim = spark.createDataFrame([(1, "x", "d1", None, 1), (2, "y", "d1", None, 1)], "k long, a string, valid_from string, valid_to string, is_current int")
    new = spark.createDataFrame([(1, "x", "d2"), (2, "z", "d2"), (3, "w", "d2")], "k long, a string, d string")
    out = {tuple(r) for r in c.scd2(dim, new, "k", ["a"], "d").collect()}
    assert out == {(1, "x", "d1", None, 1), (2, "y", "d1", "d2", 0), (2, "z", "d2", None, 1), (3, "w", "d2", None, 1)}


def test_restore_brings_state_back(spark):
    log = spark.createDataFrame(
        [(1, "a", 1, 1, "upsert"), (2, "b", 1, 2, "upsert"), (1, "z", 2, 3, "upsert"), (2, "b", 3, 4, "delete"), (3, "c", 3, 5, "upsert")],
        "k long, p string, version int, seq long, op string",
    ).withColumn("commit_ts", F.current_timestamp())
    want = {tuple(r) for r in s.as_of_version(log, ["k"], 1).collect()}
    back = s.restore(log, ["k"], 1, 4).withColumns({"seq": F.lit(9).cast("long"), "commit_ts": F.current_timestamp()})
    after = log.unionByName(back)
    assert {tuple(r) for r in s.as_of_version(after, ["k"], 4).collect()} == want
    per = {r["version"]: r["n_rows"] for r in s.rows_per_version(log, ["k"]).collect()}
    assert per == {1: 2, 2: 2, 3: 2}


def test_overlap_join_matches_brute_force(spark):
    rows = [(i, "hot" if i % 3 else "x", (i * 37) % 100, (i * 37) % 100 + (i * 7) % 30) for i in range(120)]
    df = spark.createDataFrame(rows, "id long, k string, s long, e long")
    want = {
        (a[0], b[0]) for a in rows for b in rows if a[0] < b[0] and a[1] == b[1] and a[2] < b[3] and b[2] < a[3]
    }
    got = joins.overlap_join(df, ["k"], "id", "s", "e").collect()
    assert {(r["first_id"], r["second_id"]) for r in got} == want and len(got) == len(want)


def test_as_of_join_across_slices(spark):
    left = [(i, "hot" if i % 4 else "b", (i * 13) % 97) for i in range(200)]
    right = [("hot", t, t * 10) for t in range(5, 97, 7)] + [("b", 50, 1)]
    out = joins.as_of_join(
        spark.createDataFrame(left, "id long, k string, at long"), spark.createDataFrame(right, "k string, at long, rate long"), ["k"], "at", ["rate"], "id", 9
    ).collect()
    for r in out:
        ok = [x for k, t, x in right if k == r["k"] and t <= r["at"]]
        assert r["rate"] == (max(ok) if r["k"] == "hot" and ok else (ok[0] if ok else None))
    assert len(out) == 200
