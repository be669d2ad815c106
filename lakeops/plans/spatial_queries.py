"""Spatial queries.  Customers are points, suppliers are sites and nations are zones, placed in
city boxes by a low-discrepancy formula of their key.  1,500 points and 100 sites make a city
and the next ones a city beside it, so that density does not grow with the data; the zones
lie in the first city."""

from __future__ import annotations

from pyspark.sql import functions as F

from lakeops.functions.common import ieee_divide
from lakeops.operators import spatial as sp
from lakeops.plans.registry import query
from lakeops.session import settle

LEVEL = 16
LAT = "37.7D + 0.12D * (({k} * {a}D) % 1.0D) - 0.3D * (floor({k} / {n}D) % 100.0D)"
LNG = "-122.52D + 0.17D * (({k} * {b}D) % 1.0D) + 0.4D * (floor({k} / {n}00.0D) % 700.0D)"
POINT = ("0.618033988749895", "0.381966011250105", "1500")
SITE = ("0.754877666246693", "0.569840290998053", "100")
# A five-cornered, dented zone around each centre: (latitude, longitude) offsets.
CORNERS = [(-0.012, -0.015), (-0.010, 0.014), (0.003, 0.006), (0.013, 0.012), (0.011, -0.013)]


def place(key: str, ab, engine: str = "spark") -> tuple[str, str]:
    k = f"CAST({key} AS DOUBLE)"
    lat, lng = LAT.format(k=k, a=ab[0], n=ab[2]), LNG.format(k=k, b=ab[1], n=ab[2])
    if engine == "duckdb":
        import re

        lat, lng = (re.sub(r"([0-9.]+)D\b", r"\1::DOUBLE", x) for x in (lat, lng))
    return lat, lng


def points(t):
    lat, lng = place("c_custkey", POINT)
    return t.customer.select(F.col("c_custkey").alias("id"), F.expr(lat).alias("lat"), F.expr(lng).alias("lng"), F.col("c_nationkey").alias("nation"))


def sites(t):
    lat, lng = place("s_suppkey", SITE)
    return t.supplier.select(F.col("s_suppkey").alias("site"), F.expr(lat).alias("s_lat"), F.expr(lng).alias("s_lng"))


def zones(t):
    """Zones with their centre, WKT outline and its edges."""
    lat, lng = place("n_nationkey + 1", POINT)
    base = t.nation.select("n_nationkey", F.col("n_name").alias("zone"), F.expr(lat).alias("z_lat"), F.expr(lng).alias("z_lng"))
    corners = [F.concat((F.col("z_lng") + b).cast("string"), F.lit(" "), (F.col("z_lat") + a).cast("string")) for a, b in [*CORNERS, CORNERS[0]]]
    wkt = F.concat(F.lit("POLYGON(("), F.concat_ws(", ", *corners), F.lit("))"))
    return base.withColumn("wkt", wkt).withColumn("edges", sp.outline("wkt"))


_p, _s, _z = place("c_custkey", POINT, "duckdb"), place("s_suppkey", SITE, "duckdb"), place("n_nationkey + 1", POINT, "duckdb")
P = f"p AS MATERIALIZED (SELECT c_custkey AS id, {_p[0]} AS lat, {_p[1]} AS lng, c_nationkey AS nation FROM customer)"
S = f"s AS MATERIALIZED (SELECT s_suppkey AS site, {_s[0]} AS s_lat, {_s[1]} AS s_lng FROM supplier)"
Z = f"z AS MATERIALIZED (SELECT n_nationkey, n_name AS zone, {_z[0]} AS z_lat, {_z[1]} AS z_lng FROM nation)"
EDGES = "g AS MATERIALIZED (" + " UNION ALL ".join(
    f"SELECT zone, z_lat + {a[0]}::DOUBLE AS lat1, z_lng + {a[1]}::DOUBLE AS lng1, z_lat + {b[0]}::DOUBLE AS lat2, z_lng + {b[1]}::DOUBLE AS lng2 FROM z"
    for a, b in zip(CORNERS, CORNERS[1:] + CORNERS[:1])
) + ")"
IN_ZONE = """i AS MATERIALIZED (SELECT p.id, g.zone FROM p JOIN g ON (lat1 > lat) <> (lat2 > lat) AND lng < (lng2 - lng1) * (lat - lat1) / (lat2 - lat1) + lng1
  GROUP BY 1, 2 HAVING COUNT(*) % 2 = 1)"""
ZG = f"WITH {P}, {Z}, {EDGES}, {IN_ZONE}"


def dist(a, b, c, d):
    return f"""(2 * 6371000.0::DOUBLE * asin(sqrt(least(pow(sin((radians({c}) - radians({a})) / 2), 2)
      + cos(radians({a})) * cos(radians({c})) * pow(sin(radians({d} - {b}) / 2), 2), 1.0::DOUBLE))))"""


def azim(a, b, c, d):
    y = f"sin(radians({d} - {b})) * cos(radians({c}))"
    x = f"(cos(radians({a})) * sin(radians({c})) - sin(radians({a})) * cos(radians({c})) * cos(radians({d} - {b})))"
    return f"(CASE WHEN atan2({y}, {x}) < 0 THEN atan2({y}, {x}) + 2 * pi() ELSE atan2({y}, {x}) END)"


ENDS = ("lat", "lng", "z_lat", "z_lng")


def to_zone(t):
    """Each point with the centre of its own nation's zone."""
    return points(t).join(zones(t).drop("edges", "wkt"), F.col("nation") == F.col("n_nationkey"))


TO_ZONE = "p JOIN z ON nation = n_nationkey"


@query(
    "spatial_distance",
    "G01 G03",
    f"""WITH {P}, {Z} SELECT id, round({dist(*ENDS)}, 2) AS metres,
        round(sqrt(pow((lat - z_lat) * 111.0::DOUBLE, 2) + pow((lng - z_lng) * 111.0::DOUBLE * cos(radians((lat + z_lat) / 2)), 2)), 4) AS planar_km FROM {TO_ZONE}""",
)
def _(t):
    return to_zone(t).select(
        "id", F.round(sp.distance(*ENDS), 2).alias("metres"), F.round(sp.distance_planar_km(*ENDS), 4).alias("planar_km")
    )


# Twelve steps of the longitude on the auxiliary sphere, then the length; fixed values of WGS84.
VINCENTY = f"""WITH RECURSIVE {P}, {Z}, q AS (SELECT id, atan((1 - 1 / 298.257223563::DOUBLE) * tan(radians(lat))) AS u1, atan((1 - 1 / 298.257223563::DOUBLE) * tan(radians(z_lat))) AS u2,
    radians(z_lng - lng) AS l, {dist(*ENDS)} AS sphere FROM {TO_ZONE}),
  w(id, u1, u2, l, sphere, step, lam) AS (SELECT id, u1, u2, l, sphere, 0, l FROM q UNION ALL
    SELECT id, u1, u2, l, sphere, step + 1, l + (1 - k) * f * sa * (sigma + k * ss * (cm + k * cs * (2 * cm * cm - 1))) FROM (
      SELECT *, f / 16 * ca * (4 + f * (4 - 3 * ca)) AS k FROM (SELECT *, CASE WHEN ca = 0 THEN 0 ELSE cs - 2 * sin(u1) * sin(u2) / ca END AS cm FROM (
        SELECT *, 1 - sa * sa AS ca FROM (SELECT *, atan2(ss, cs) AS sigma, CASE WHEN ss = 0 THEN 0 ELSE cos(u1) * cos(u2) * sin(lam) / ss END AS sa FROM (
          SELECT *, 1 / 298.257223563::DOUBLE AS f, sqrt(pow(cos(u2) * sin(lam), 2) + pow(cos(u1) * sin(u2) - sin(u1) * cos(u2) * cos(lam), 2)) AS ss,
                 sin(u1) * sin(u2) + cos(u1) * cos(u2) * cos(lam) AS cs FROM w WHERE step < 12)))))),
  e AS (SELECT id, sphere, ss, cs, atan2(ss, cs) AS sigma, ca, CASE WHEN ca = 0 THEN 0 ELSE cs - 2 * s12 / ca END AS cm,
               ca * (pow(6378137.0::DOUBLE, 2) - pow(b, 2)) / pow(b, 2) AS uu, b FROM (
    SELECT *, 1 - pow(CASE WHEN ss = 0 THEN 0 ELSE cos(u1) * cos(u2) * sin(lam) / ss END, 2) AS ca, sin(u1) * sin(u2) AS s12, 6378137.0::DOUBLE * (1 - 1 / 298.257223563::DOUBLE) AS b FROM (
      SELECT *, sqrt(pow(cos(u2) * sin(lam), 2) + pow(cos(u1) * sin(u2) - sin(u1) * cos(u2) * cos(lam), 2)) AS ss,
             sin(u1) * sin(u2) + cos(u1) * cos(u2) * cos(lam) AS cs FROM w WHERE step = 12))),
  m AS (SELECT id, sphere, CASE WHEN ss = 0 THEN 0 ELSE b * big_a * (sigma - big_b * ss * (cm + big_b / 4 * (cs * (2 * cm * cm - 1) - big_b / 6 * cm * (4 * ss * ss - 3) * (4 * cm * cm - 3)))) END AS metres
        FROM (SELECT *, 1 + uu / 16384 * (4096 + uu * (-768 + uu * (320 - 175 * uu))) AS big_a, uu / 1024 * (256 + uu * (-128 + uu * (74 - 47 * uu))) AS big_b FROM e))
  SELECT id, round(metres, 2) AS vincenty, abs(metres / sphere - 1) < 0.006 AS agrees FROM m"""


@query("spatial_distance_ellipsoid", "G02", VINCENTY)
def _(t):
    rows = to_zone(t).withColumns({"vincenty": sp.distance_ellipsoid(*ENDS), "sphere": sp.distance(*ENDS)})
    # A point on the centre itself has 0 / 0, which agrees with nothing.
    share = ieee_divide("vincenty", "sphere")
    return rows.select("id", F.round("vincenty", 2).alias("vincenty"), (F.abs(share - 1) < 0.006).alias("agrees"))


@query(
    "spatial_bearings",
    "G04",
    f"""WITH {P}, {Z} SELECT id, round(degrees({azim(*ENDS)}), 4) AS bearing, round({azim(*ENDS)}, 6) AS azimuth,
        round((degrees({azim('z_lat', 'z_lng', 'lat', 'lng')}) + 180)::DOUBLE - CASE WHEN degrees({azim('z_lat', 'z_lng', 'lat', 'lng')}) + 180 >= 360 THEN 360 ELSE 0 END, 4) AS final_bearing FROM {TO_ZONE}""",
)
def _(t):
    return to_zone(t).select(
        "id",
        F.round(sp.bearing(*ENDS), 4).alias("bearing"),
        F.round(sp.azimuth(*ENDS), 6).alias("azimuth"),
        F.round(sp.final_bearing(*ENDS), 4).alias("final_bearing"),
    )


@query("spatial_points_in_zones", "J15 G05", ZG + " SELECT id, zone FROM i")
def _(t):
    return sp.points_in_polygons(points(t), zones(t), "edges").select("id", "zone")


@query(
    "spatial_point_text",
    "G06",
    f"WITH {S} SELECT site, s_lng AS x, s_lat AS y, true AS begins FROM s",
)
def _(t):
    wkt = sites(t).withColumn("w", sp.make_point("s_lng", "s_lat"))
    return wkt.select("site", sp.point_x("w").alias("x"), sp.point_y("w").alias("y"), F.col("w").startswith("POINT(-122.").alias("begins"))


@query(
    "spatial_zone_area",
    "G07",
    f"""WITH {Z}, {EDGES} SELECT zone, round(abs(SUM(radians(lng2 - lng1) * (2 + sin(radians(lat1)) + sin(radians(lat2))))) * (6371000.0::DOUBLE * 6371000.0::DOUBLE / 2) / 1000000, 4) AS km2
        FROM g GROUP BY 1""",
)
def _(t):
    return zones(t).select("zone", F.round(sp.polygon_area("wkt") / 1_000_000, 4).alias("km2"))


SIDE = 2**LEVEL
ROW, COL = f"CAST(floor((lat + 90.0::DOUBLE) / 180.0::DOUBLE * {SIDE}) AS BIGINT)", f"CAST(floor((lng + 180.0::DOUBLE) / 360.0::DOUBLE * {SIDE}) AS BIGINT)"


def pack_sql(r, c, level=LEVEL):
    return f"(CAST({level * 2**56} AS BIGINT) + ({r}) * 268435456 + ({c}))"


CELL = pack_sql(ROW, COL)


@query(
    "spatial_cell_index",
    "G08",
    f"""WITH {P}, c AS (SELECT id, {CELL} AS cell, {ROW} AS r, {COL} AS k FROM p) SELECT id, cell, lower(to_hex(cell)) AS cell_text, {LEVEL} AS level, true AS valid,
        (r + 0.5::DOUBLE) / {SIDE}.0::DOUBLE * 180.0::DOUBLE - 90.0::DOUBLE AS lat, round(6371000.0::DOUBLE * 6371000.0::DOUBLE * radians(360.0::DOUBLE / {SIDE})
          * (sin(radians((r + 1) / {SIDE}.0::DOUBLE * 180.0::DOUBLE - 90)) - sin(radians(r / {SIDE}.0::DOUBLE * 180.0::DOUBLE - 90))) / 1000000, 4) AS km2, true AS boxed FROM c""",
)
def _(t):
    c = points(t).withColumn("cell", sp.cell("lat", "lng", LEVEL))
    inside = sp.contains(sp.ring(sp.cell_boundary("cell")), sp.cell_lat("cell"), sp.cell_lng("cell"))
    return c.select(
        "id",
        "cell",
        sp.cell_text("cell").alias("cell_text"),
        sp.cell_level("cell").alias("level"),
        (sp.cell_valid("cell") & (sp.text_cell(sp.cell_text("cell")) == F.col("cell"))).alias("valid"),
        sp.cell_lat("cell").alias("lat"),
        F.round(sp.cell_area("cell") / 1_000_000, 4).alias("km2"),
        inside.alias("boxed"),
    )


POLYFILL = f"""f AS MATERIALIZED (SELECT q.zone, q.r, q.k FROM (SELECT zone, unnest(generate_series(CAST(floor((lo + 90.0::DOUBLE) / 180.0::DOUBLE * {SIDE}) AS BIGINT), CAST(floor((hi + 90.0::DOUBLE) / 180.0::DOUBLE * {SIDE}) AS BIGINT))) AS r, w, e
      FROM (SELECT zone, MIN(lat1) AS lo, MAX(lat1) AS hi, MIN(lng1) AS w, MAX(lng1) AS e FROM g GROUP BY 1)) b,
      LATERAL (SELECT b.zone, b.r, unnest(generate_series(CAST(floor((b.w + 180.0::DOUBLE) / 360.0::DOUBLE * {SIDE}) AS BIGINT), CAST(floor((b.e + 180.0::DOUBLE) / 360.0::DOUBLE * {SIDE}) AS BIGINT))) AS k) q
    JOIN g ON g.zone = q.zone AND (lat1 > (q.r + 0.5::DOUBLE) / {SIDE} * 180 - 90) <> (lat2 > (q.r + 0.5::DOUBLE) / {SIDE} * 180 - 90)
      AND (q.k + 0.5::DOUBLE) / {SIDE} * 360 - 180 < (lng2 - lng1) * ((q.r + 0.5::DOUBLE) / {SIDE} * 180 - 90 - lat1) / (lat2 - lat1) + lng1
    GROUP BY 1, 2, 3 HAVING COUNT(*) % 2 = 1)"""
FILL = f"WITH {P}, {Z}, {EDGES}, {POLYFILL}"


@query("spatial_polygon_cover", "G09", f"{FILL} SELECT zone, {pack_sql('r', 'k')} AS cell FROM f")
def _(t):
    return sp.polyfill(zones(t).select("zone", "edges"), "edges", LEVEL).select("zone", "cell")


@query(
    "spatial_cell_join",
    "J14",
    f"{FILL} SELECT id, zone FROM p JOIN f ON f.r = {ROW} AND f.k = {COL}",
)
def _(t):
    cover = sp.polyfill(zones(t).select("zone", "edges"), "edges", LEVEL).select("zone", "cell")
    return points(t).withColumn("cell", sp.cell("lat", "lng", LEVEL)).join(cover, "cell").select("id", "zone")


@query(
    "spatial_cell_hierarchy",
    "G10",
    f"""WITH {P}, c AS (SELECT DISTINCT {ROW} AS r, {COL} AS k FROM p), q AS (SELECT r // 4 AS r, k // 4 AS k, COUNT(*) AS used FROM c GROUP BY 1, 2)
        SELECT {pack_sql('r', 'k', LEVEL - 2)} AS parent, used, 16 AS children, {pack_sql('r * 4', 'k * 4')} AS first_child, {pack_sql('r * 4 + 2', 'k * 4 + 2')} AS center_child FROM q""",
)
def _(t):
    cells = points(t).select(sp.cell("lat", "lng", LEVEL).alias("cell")).distinct()
    up = cells.groupBy(sp.parent("cell", LEVEL - 2).alias("parent")).agg(F.count("*").alias("used"))
    kids = sp.children("parent", LEVEL)
    return up.select(
        "parent",
        "used",
        F.size(kids).alias("children"),
        F.array_min(kids).alias("first_child"),
        sp.center_child("parent", LEVEL).alias("center_child"),
    )


@query(
    "spatial_neighbourhood",
    "G11",
    f"""WITH {P}, c AS MATERIALIZED (SELECT {ROW} AS r, {COL} AS k, COUNT(*) AS n FROM p GROUP BY 1, 2)
        SELECT {pack_sql('a.r', 'a.k')} AS cell, CAST(SUM(b.n) AS BIGINT) AS in_disk, CAST(COALESCE(SUM(b.n) FILTER (WHERE greatest(abs(a.r - b.r), abs(a.k - b.k)) = 2), 0) AS BIGINT) AS in_ring
        FROM c a JOIN c b ON abs(a.r - b.r) <= 2 AND abs(a.k - b.k) <= 2 GROUP BY 1""",
)
def _(t):
    per = points(t).groupBy(sp.cell("lat", "lng", LEVEL).alias("near")).agg(F.count("*").alias("n"))
    around = per.select(F.col("near").alias("cell"), F.explode(sp.disk("near", 2)).alias("near"))
    counted = around.join(per, "near")
    far = F.when(sp.grid_distance("cell", "near") == 2, F.col("n")).otherwise(0)
    return counted.groupBy("cell").agg(F.sum("n").alias("in_disk"), F.sum(far).alias("in_ring"))


@query(
    "spatial_grid_distance_path",
    "G12",
    f"""WITH {P}, {Z}, q AS (SELECT id, {ROW} AS r1, {COL} AS k1, {ROW.replace('lat', 'z_lat')} AS r2, {COL.replace('lng', 'z_lng')} AS k2 FROM {TO_ZONE})
        SELECT id, greatest(abs(r1 - r2), abs(k1 - k2)) AS steps, greatest(abs(r1 - r2), abs(k1 - k2)) + 1 AS path_cells, {pack_sql('r2', 'k2')} AS goal FROM q""",
)
def _(t):
    rows = to_zone(t).select("id", sp.cell("lat", "lng", LEVEL).alias("a"), sp.cell("z_lat", "z_lng", LEVEL).alias("b"))
    # Paths are up to half the grid long, so rows are dealt to all tasks; ``inline`` keeps one path per row.
    dealt = rows.repartition(4 * t.spark.sparkContext.defaultParallelism)
    paths = dealt.select("id", "a", "b", F.inline(F.array(F.struct(sp.grid_path("a", "b").alias("path")))))
    return paths.select(
        "id",
        sp.grid_distance("a", "b").alias("steps"),
        F.size(F.array_distinct("path")).cast("long").alias("path_cells"),
        F.element_at("path", -1).alias("goal"),
    )


@query(
    "spatial_density_top",
    "G13",
    f"""WITH {P} SELECT {pack_sql(f'({ROW}) // 8', f'({COL}) // 8', LEVEL - 3)} AS cell, COUNT(*) AS visits, COUNT(DISTINCT nation) AS nations FROM p
        GROUP BY 1 ORDER BY visits DESC, cell LIMIT 10""",
)
def _(t):
    per = points(t).groupBy(sp.cell("lat", "lng", LEVEL - 3).alias("cell")).agg(
        F.count("*").alias("visits"), F.countDistinct("nation").alias("nations")
    )
    return per.orderBy(F.col("visits").desc(), "cell").limit(10)


@query(
    "spatial_reconciliation",
    "G14",
    ZG + """ SELECT COUNT(*) AS total, COUNT(*) FILTER (WHERE id IN (SELECT id FROM i)) AS inside, COUNT(*) FILTER (WHERE id NOT IN (SELECT id FROM i)) AS outside,
         (SELECT COUNT(*) FROM i) AS pairs FROM p""",
)
def _(t):
    inside = settle(sp.points_in_polygons(points(t), zones(t), "edges").select("id", "zone"))
    hit = inside.groupBy("id").agg(F.count("*").alias("k"))
    rows = points(t).join(hit, "id", "left")
    return rows.agg(
        F.count("*").alias("total"),
        F.count("k").alias("inside"),
        F.count_if(F.col("k").isNull()).alias("outside"),
        F.sum("k").alias("pairs"),
    )


@query(
    "spatial_nearest_site",
    "J12",
    f"""WITH {P}, {S}, d AS (SELECT id, site, {dist('lat', 'lng', 's_lat', 's_lng')} AS m FROM p, s)
        SELECT id, arg_min(site, (m, site)) AS site, round(MIN(m), 2) AS metres FROM d GROUP BY id""",
)
def _(t):
    near = sp.nearest_site(points(t), sites(t), "id", "site")
    return near.select("id", "site", F.round("distance_m", 2).alias("metres"))


@query(
    "spatial_radius_join",
    "J13",
    f"WITH {P}, {S}, d AS (SELECT id, site, {dist('lat', 'lng', 's_lat', 's_lng')} AS m FROM p, s) SELECT id, site, round(m, 2) AS metres FROM d WHERE m <= 3000",
)
def _(t):
    return sp.within_radius(points(t), sites(t), 3000.0, 13).select("id", "site", F.round("distance_m", 2).alias("metres"))
