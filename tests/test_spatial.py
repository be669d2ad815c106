import math
import random

from pyspark.sql import functions as F

from lakeops.operators import spatial as sp


def haversine(a, b, c, d):
    p, q = math.radians(a), math.radians(c)
    h = math.sin((q - p) / 2) ** 2 + math.cos(p) * math.cos(q) * math.sin(math.radians(d - b) / 2) ** 2
    return 2 * 6371000.0 * math.asin(min(1, math.sqrt(h)))


def places(n, seed, spread):
    rnd = random.Random(seed)
    rows = []
    for i in range(n):
        lat, lng = (rnd.uniform(-89, 89), rnd.uniform(-180, 180)) if i % 3 == 0 else (rnd.gauss(37.7, spread), rnd.gauss(-122.4, spread))
        rows.append((i, max(-90.0, min(90.0, lat)), lng))
    return rows


def test_known_distances(spark):
    row = spark.sql("SELECT 1.2644D a, 103.82D b, 33.74D c, -118.26D d, 51.9055D e, 4.47D f, 51.95D g, 1.3D h").select(
        F.round(sp.distance("a", "b", "c", "d") / 1000, 0), F.round(sp.distance("e", "f", "g", "h") / 1000, 0), sp.distance_ellipsoid("e", "f", "g", "h")
    ).first()
    assert row[0] == 14146 and row[1] == 217 and abs(row[2] - 217_800) < 1500


def test_nearest_site_is_exact(spark):
    pts, sites = places(120, 1, 0.3), places(40, 2, 0.5)
    got = sp.nearest_site(
        spark.createDataFrame(pts, "p long, lat double, lng double"),
        spark.createDataFrame(sites, "s long, s_lat double, s_lng double"), "p", "s", 8,
    ).collect()
    want = {p: min((haversine(a, b, c, d), s) for s, c, d in sites) for p, a, b in pts}
    assert len(got) == len(pts)
    for r in got:
        assert r["s"] == want[r["p"]][1] and abs(r["distance_m"] - want[r["p"]][0]) < 1e-3


def nearest(spark, pts, sites, **how):
    return sp.nearest_site(
        spark.createDataFrame(pts, "p long, lat double, lng double"),
        spark.createDataFrame(sites, "s long, s_lat double, s_lng double"), "p", "s", **how,
    )


def test_nearest_site_of_dense_towns_poles_and_the_date_line(spark):
    rnd = random.Random(7)
    towns = [(10.0, 20.0), (-40.0, 179.99), (88.5, -60.0)]

    def spread(n, first, wide):
        out = []
        for i in range(n):
            lat, lng = towns[i % 3]
            out.append((first + i, lat + rnd.uniform(-wide, wide), (lng + rnd.uniform(-wide, wide) + 180) % 360 - 180))
        return out

    sites = spread(300, 0, 0.02) + [(900, 10.0, 20.0), (901, 10.0, 20.0), (902, None, 1.0)]
    pts = spread(90, 0, 0.05) + [(1000, 90.0, 0.0), (1001, -90.0, 5.0), (1002, 10.0, 20.0), (1003, 0.0, -180.0), (1004, None, 0.0)]
    got = {r["p"]: r for r in nearest(spark, pts, sites, leaf=4).collect()}
    assert set(got) == {p for p, a, _ in pts if a is not None}
    for p, a, b in pts:
        if a is not None:
            m, s = min((haversine(a, b, c, d), s) for s, c, d in sites if c is not None)
            assert abs(got[p]["distance_m"] - m) < 1e-3 and (got[p]["s"] == s or m == 0)
    assert got[1002]["s"] == 900


def test_nearest_site_has_few_candidates_in_towns(spark):
    rnd = random.Random(8)
    near = lambda n: [(i, (50.0 if i % 2 else -20.0) + rnd.uniform(0, 0.02), 9.0 + rnd.uniform(0, 0.02)) for i in range(n)]
    # Two towns, 7,800 km apart: all pairs within a town would be 1,000 a point.
    sites = spark.createDataFrame(near(2000), "s long, s_lat double, s_lng double")
    points = spark.createDataFrame(near(400), "p long, lat double, lng double")
    nodes, listed = sp.site_tree(sites, 16)
    assert nodes.where("is_leaf").agg(F.max("n")).first()[0] <= 16 and listed.count() == 2000
    most = sp.leaves_near(points, nodes, "p").join(listed, "_cell").groupBy("p").count().agg(F.max("count"), F.count("*")).first()
    assert most[0] <= 9 * 16 and most[1] == 400


def test_nearest_site_without_sites_or_with_one(spark):
    pts = [(1, 1.0, 2.0), (2, -80.0, 170.0)]
    assert nearest(spark, pts, []).collect() == []
    assert {(r["p"], r["s"]) for r in nearest(spark, pts, [(5, 0.0, 0.0)]).collect()} == {(1, 5), (2, 5)}
    assert nearest(spark, [], [(5, 0.0, 0.0)]).collect() == []


def test_within_radius_is_exact(spark):
    pts, sites = places(150, 3, 0.2), places(60, 4, 0.2)
    got = sp.within_radius(
        spark.createDataFrame(pts, "p long, lat double, lng double"),
        spark.createDataFrame(sites, "s long, s_lat double, s_lng double"), 30000.0, 10,
    ).collect()
    want = {(p, s) for p, a, b in pts for s, c, d in sites if haversine(a, b, c, d) <= 30000.0}
    assert {(r["p"], r["s"]) for r in got} == want and len(got) == len(want) > 50


def test_cells_round_trip(spark):
    df = spark.createDataFrame(places(200, 5, 1.0), "p long, lat double, lng double").withColumn("c", sp.cell("lat", "lng", 12))
    out = df.select(
        sp.cell_valid("c").alias("v"), (sp.text_cell(sp.cell_text("c")) == F.col("c")).alias("t"),
        (sp.parent("c", 9) == sp.cell("lat", "lng", 9)).alias("p"), F.array_contains(sp.children(sp.parent("c", 10), 12), F.col("c")).alias("k"),
        F.size(sp.disk("c", 1)).alias("n"), F.size(sp.ring_cells("c", 2)).alias("r"),
        (sp.grid_distance("c", F.element_at(sp.ring_cells("c", 2), 1))).alias("g"), (sp.cell(sp.cell_lat("c"), sp.cell_lng("c"), 12) == F.col("c")).alias("m"),
    ).collect()
    assert all(r["v"] and r["t"] and r["p"] and r["k"] and r["m"] for r in out)
    assert {r["n"] for r in out} <= {6, 9} and {r["g"] for r in out} == {2}


def test_containment_and_area(spark):
    wkt = "POLYGON((0 0, 4 0, 4 4, 2 1, 0 4, 0 0))"
    df = spark.createDataFrame([(wkt, 0.5, 2.0), (wkt, 3.0, 2.0), (wkt, 3.0, 0.2), (wkt, -1.0, 1.0)], "w string, lat double, lng double")
    got = [r[0] for r in df.select(sp.contains(sp.ring("w"), F.col("lat"), F.col("lng"))).collect()]
    assert got == [True, False, True, False]
    box = spark.createDataFrame([("POLYGON((0 0, 1 0, 1 1, 0 1, 0 0))",)], "w string").select(sp.area(sp.ring("w"))).first()[0]
    exact = 6371000.0**2 * math.radians(1) * math.sin(math.radians(1))
    assert abs(box - exact) / exact < 1e-4


def in_rings(rings, lat, lng):
    odd = False
    for r in rings:
        for (ax, ay), (bx, by) in zip(r, r[1:]):
            odd ^= (ay > lat) != (by > lat) and lng < (bx - ax) * (lat - ay) / (by - ay) + ax
    return odd


def circle(lng, lat, size, n):
    at = [(lng + size * math.cos(2 * math.pi * i / n), lat + size * math.sin(2 * math.pi * i / n)) for i in range(n)]
    return [*at, at[0]]


def text(rings):
    return ", ".join("(" + ", ".join(f"{x!r} {y!r}" for x, y in r) + ")" for r in rings)


COUNTRY = [circle(10.0, 45.0, 9.0, 300), circle(12.0, 46.0, 2.0, 40)]
BLOCK = [[(12.0, 46.0), (12.002, 46.0), (12.002, 46.001), (12.0, 46.001), (12.0, 46.0)]]
ISLANDS = [circle(-30.0, -10.0, 3.0, 7), circle(-31.0, -10.5, 0.5, 9), circle(-20.0, -12.0, 1.0, 5)]
SHAPES = {
    "country": (f"POLYGON ({text(COUNTRY)})", COUNTRY),
    "block": (f"POLYGON({text(BLOCK)})", BLOCK),
    "islands": (f"MULTIPOLYGON((({text(ISLANDS[:2])[1:-1]})), (({text(ISLANDS[2:])[1:-1]})))", ISLANDS),
    # The same box on both sides of the date line, as the map has it.
    "strait": (
        "POLYGON((178 -20, -177 -20, -177 -16, 178 -16, 178 -20), (179.5 -19, -179.5 -19, -179.5 -18, 179.5 -18, 179.5 -19))",
        [
            [(178 + d, -20), (183 + d, -20), (183 + d, -16), (178 + d, -16), (178 + d, -20)] for d in (0, -360)
        ] + [[(179.5 + d, -19), (180.5 + d, -19), (180.5 + d, -18), (179.5 + d, -18), (179.5 + d, -19)] for d in (0, -360)],
    ),
}


def shapes(spark):
    rows = [(k, v[0]) for k, v in SHAPES.items()] + [("none", "POLYGON EMPTY"), ("null", None)]
    return spark.createDataFrame(rows, "name string, wkt string").withColumn("edges", sp.outline("wkt"))


def test_points_in_polygons_with_holes_parts_and_date_line(spark):
    rnd = random.Random(9)
    spots = [(rnd.uniform(-22, 56), rnd.uniform(-180, 179.99)) for _ in range(300)]
    spots += [(rnd.uniform(-21, -15), rnd.choice([-1, 1]) * rnd.uniform(176, 179.999)) for _ in range(200)]
    spots += [(rnd.uniform(45.999, 46.002), rnd.uniform(11.999, 12.003)) for _ in range(200)]
    spots += [(rnd.uniform(35, 55), rnd.uniform(0, 20)) for _ in range(300)]
    spots += [(rnd.uniform(-14, -6), rnd.uniform(-34, -18)) for _ in range(300)]
    points = spark.createDataFrame([(i, *p) for i, p in enumerate(spots)], "id long, lat double, lng double")
    got = [(r["id"], r["name"]) for r in sp.points_in_polygons(points, shapes(spark), "edges").collect()]
    want = {(i, k) for i, p in enumerate(spots) for k, (_, rings) in SHAPES.items() if in_rings(rings, *p)}
    assert len(got) == len(set(got)) and set(got) == want
    assert {k for _, k in want} == set(SHAPES)
    assert sp.points_in_polygons(points, shapes(spark).limit(0), "edges").count() == 0


def test_cover_takes_few_cells_of_mixed_levels(spark):
    rows = sp.cover(shapes(spark), "edges", 5).select("name", "cell", "inner", F.size("edges").alias("n"), sp.cell_level("cell").alias("level")).collect()
    per = {k: [r for r in rows if r["name"] == k] for k in SHAPES}
    assert max(r["level"] for r in per["country"]) < min(r["level"] for r in per["block"])
    for cells in per.values():
        assert len(cells) < 1500 and len({r["cell"] for r in cells}) == len(cells)
        assert all(r["n"] == 0 for r in cells if r["inner"])
    # A border cell has a small part of the outline, and the country has cells inside.
    assert max(r["n"] for r in per["country"]) < 100 and any(r["inner"] for r in per["country"])


def test_polyfill_is_the_cells_whose_centres_lie_inside(spark):
    got = {(r["name"], r["cell"]) for r in sp.polyfill(shapes(spark).where("name IN ('islands', 'strait')"), "edges", 9).select("name", "cell").collect()}
    side, want = 2**9, set()
    for name in ("islands", "strait"):
        for row in range(side):
            for column in range(side):
                if in_rings(SHAPES[name][1], (row + 0.5) / side * 180.0 - 90.0, (column + 0.5) / side * 360.0 - 180.0):
                    want.add((name, (9 << 56) + (row << 28) + column))
    assert got == want and len({n for n, _ in got}) == 2


def test_area_subtracts_holes(spark):
    got = {r["name"]: r["m"] for r in shapes(spark).select("name", sp.polygon_area("wkt").alias("m")).collect()}
    ring = {k: sp.EARTH_M**2 * math.radians(w) * (math.sin(math.radians(n)) - math.sin(math.radians(s))) for k, w, s, n in [("out", 5, -20, -16), ("hole", 1, -19, -18)]}
    assert abs(got["strait"] / (ring["out"] - ring["hole"]) - 1) < 2e-3
    assert got["none"] == 0.0 and got["null"] is None and 0 < got["block"] < got["islands"] < got["country"]


def test_long_grid_path_is_planned_once_per_row_and_spread(spark, tmp_path):
    from lakeops.plans import load_all

    a, b = (sp.pack(16, F.lit(r), F.lit(c)) for r, c in ((40, 900), (10, 5)))
    row = spark.range(1).select(sp.grid_path(a, b).alias("p"), sp.grid_path(a, a).alias("own"), sp.grid_path(F.lit(None).cast("long"), b).alias("none")).first()
    n = 895
    want = [(16 << 56) + ((40 + math.floor(-30 * (i / n) + 0.5)) << 28) + 900 + math.floor(-895 * (i / n) + 0.5) for i in range(n + 1)]
    assert row["p"] == want and len(row["own"]) == 1 and row["none"] is None
    spark.createDataFrame([(1, 0), (90_000, 0), (7, None)], "c_custkey long, c_nationkey int").write.parquet(str(tmp_path / "customer.parquet"))
    spark.createDataFrame([(0, "N")], "n_nationkey int, n_name string").write.parquet(str(tmp_path / "nation.parquet"))
    df = load_all()["spatial_grid_distance_path"](spark, str(tmp_path))
    assert "RoundRobinPartitioning" in df._jdf.queryExecution().executedPlan().toString()
    assert {r["id"]: r["steps"] + 1 == r["path_cells"] for r in df.collect()} == {1: True, 90_000: True}


def test_grid_paths_are_worked_out_as_arrays_in_several_batches(spark):
    """A path's cells went through an interpreted function one by one."""
    rnd = random.Random(12)
    ends = [[(16 << 56) + (rnd.randrange(1 << 16) << 28) + rnd.randrange(1 << 16) for _ in "ab"] for _ in range(8)]
    ends += [[(16 << 56) + (rnd.randrange(300) << 28) + rnd.randrange(300) for _ in "ab"] for _ in range(40)]
    ends += [[ends[0][0]] * 2, [None, ends[0][0]], [ends[1][0], None], [None, None], [(3 << 56) + (7 << 28) + 1, (3 << 56) + (1 << 28) + 7]]
    rnd.shuffle(ends)
    df = spark.createDataFrame([(i, *e) for i, e in enumerate(ends)], "i int, a long, b long").coalesce(1).withColumn("p", sp.grid_path("a", "b"))
    assert "ArrowEvalPython" in df._jdf.queryExecution().executedPlan().toString()
    found = {r["i"]: r["p"] for r in df.collect()}

    def path(a, b):
        if a is None or b is None:
            return None
        (r, c), (dr, dc) = (a >> 28 & (1 << 28) - 1, a & (1 << 28) - 1), ((b >> 28 & (1 << 28) - 1) - (a >> 28 & (1 << 28) - 1), (b & (1 << 28) - 1) - (a & (1 << 28) - 1))
        n = max(abs(dr), abs(dc))
        return [(a >> 56 << 56) + (r + math.floor(dr * (i / max(n, 1)) + 0.5) << 28) + c + math.floor(dc * (i / max(n, 1)) + 0.5) for i in range(n + 1)]

    assert sum(len(p) for p in found.values() if p) > 2 * sp.PATH_CELLS
    assert all(found[i] == path(a, b) for i, (a, b) in enumerate(ends))


def test_a_point_on_the_centre_has_no_share_of_distances(spark, tmp_path):
    from lakeops.plans import load_all

    spark.createDataFrame([(1, 0), (2, 0), (3, None)], "c_custkey long, c_nationkey int").write.parquet(str(tmp_path / "customer.parquet"))
    spark.createDataFrame([(0, "N")], "n_nationkey int, n_name string").write.parquet(str(tmp_path / "nation.parquet"))
    rows = load_all()["spatial_distance_ellipsoid"](spark, str(tmp_path)).collect()
    assert {r["id"]: (r["vincenty"] == 0, r["agrees"]) for r in rows} == {1: (True, False), 2: (False, True)}
