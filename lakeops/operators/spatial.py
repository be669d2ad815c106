"""Spatial functions and joins on a hierarchical latitude/longitude grid.

A cell at level L is one of 2^L x 2^L boxes of the world; its id packs the level and the
two indices into a long.  Joins look for candidates by cell (an equi-join) and then apply
the exact test, so no join compares every point with every site.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lakeops.functions.common import col
from lakeops.session import settle

EARTH_M = 6371000.0
INDEX_BITS = 28
MAX_LEVEL = 27
#: More than the rounding error of a distance, in metres.
SLACK_M = 1.0


# --- measures -----------------------------------------------------------------------


def distance(lat1, lng1, lat2, lng2) -> Column:
    """Great-circle (haversine) distance in metres."""
    a, b = F.radians(col(lat1)), F.radians(col(lat2))
    half_lat, half_lng = (b - a) / 2, F.radians(col(lng2) - col(lng1)) / 2
    h = F.pow(F.sin(half_lat), F.lit(2)) + F.cos(a) * F.cos(b) * F.pow(F.sin(half_lng), F.lit(2))
    return F.lit(2 * EARTH_M) * F.asin(F.sqrt(F.least(h, F.lit(1.0))))


def distance_planar_km(lat1, lng1, lat2, lng2) -> Column:
    """Equirectangular approximation with 111 km per degree."""
    dy = (col(lat1) - col(lat2)) * 111.0
    dx = (col(lng1) - col(lng2)) * 111.0 * F.cos(F.radians((col(lat1) + col(lat2)) / 2))
    return F.sqrt(dy * dy + dx * dx)


@F.pandas_udf(T.DoubleType())
def distance_ellipsoid(lat1: pd.Series, lng1: pd.Series, lat2: pd.Series, lng2: pd.Series) -> pd.Series:
    """Vincenty's inverse distance on the WGS84 ellipsoid, in metres, whole batches at a time."""
    a, f = 6378137.0, 1 / 298.257223563  # fixed values of WGS84
    b = a * (1 - f)
    u1, u2 = np.arctan((1 - f) * np.tan(np.radians(lat1))), np.arctan((1 - f) * np.tan(np.radians(lat2)))
    big_l = np.radians(lng2 - lng1)
    s1, c1, s2, c2 = np.sin(u1), np.cos(u1), np.sin(u2), np.cos(u2)
    lam = big_l.copy()
    with np.errstate(divide="ignore", invalid="ignore"):
        for _ in range(40):
            sl, cl = np.sin(lam), np.cos(lam)
            ss = np.sqrt((c2 * sl) ** 2 + (c1 * s2 - s1 * c2 * cl) ** 2)
            cs = s1 * s2 + c1 * c2 * cl
            sigma = np.arctan2(ss, cs)
            sa = np.where(ss == 0, 0.0, c1 * c2 * sl / ss)
            ca = 1 - sa**2
            cm = np.where(ca == 0, 0.0, cs - 2 * s1 * s2 / ca)
            k = f / 16 * ca * (4 + f * (4 - 3 * ca))
            lam = big_l + (1 - k) * f * sa * (sigma + k * ss * (cm + k * cs * (2 * cm**2 - 1)))
        uu = ca * (a**2 - b**2) / b**2
        big_a = 1 + uu / 16384 * (4096 + uu * (-768 + uu * (320 - 175 * uu)))
        big_b = uu / 1024 * (256 + uu * (-128 + uu * (74 - 47 * uu)))
        d = big_b * ss * (cm + big_b / 4 * (cs * (2 * cm**2 - 1) - big_b / 6 * cm * (4 * ss**2 - 3) * (4 * cm**2 - 3)))
    return pd.Series(np.where(ss == 0, 0.0, b * big_a * (sigma - d)))


def azimuth(lat1, lng1, lat2, lng2) -> Column:
    """Initial direction from the first point to the second, radians clockwise from north, 0 .. 2 pi."""
    a, b, dl = F.radians(col(lat1)), F.radians(col(lat2)), F.radians(col(lng2) - col(lng1))
    y = F.sin(dl) * F.cos(b)
    x = F.cos(a) * F.sin(b) - F.sin(a) * F.cos(b) * F.cos(dl)
    raw = F.atan2(y, x)
    return F.when(raw < 0, raw + 2 * np.pi).otherwise(raw)


def bearing(lat1, lng1, lat2, lng2) -> Column:
    """Initial bearing in degrees."""
    return F.degrees(azimuth(lat1, lng1, lat2, lng2))


def final_bearing(lat1, lng1, lat2, lng2) -> Column:
    """Bearing on arrival, in degrees."""
    back = bearing(lat2, lng2, lat1, lng1) + 180.0
    return F.when(back >= 360.0, back - 360.0).otherwise(back)


def make_point(lng, lat) -> Column:
    """WKT point, longitude first."""
    return F.concat(F.lit("POINT("), col(lng).cast("string"), F.lit(" "), col(lat).cast("string"), F.lit(")"))


def point_x(wkt) -> Column:
    return F.regexp_extract(col(wkt), r"\(\s*(\S+)\s+(\S+?)\s*\)", 1).cast("double")


def point_y(wkt) -> Column:
    return F.regexp_extract(col(wkt), r"\(\s*(\S+)\s+(\S+?)\s*\)", 2).cast("double")


def _points(text: Column) -> Column:
    """``lng lat, lng lat, ...`` as an array of (lng, lat) structs."""
    return F.transform(
        F.split(text, r"\s*,\s*"),
        lambda p: F.struct(
            F.split(F.trim(p), r"\s+")[0].cast("double").alias("lng"), F.split(F.trim(p), r"\s+")[1].cast("double").alias("lat")
        ),
    )


def ring(wkt) -> Column:
    """Outer ring of a WKT polygon as an array of (lng, lat) structs, closed as given."""
    return _points(F.regexp_extract(col(wkt), r"\(\(([^)]*)\)", 1))


def parts(wkt) -> Column:
    """All polygons of a WKT POLYGON or MULTIPOLYGON, each the array of its rings, the outer one first."""
    texts = F.split(col(wkt), r"\)\s*\)\s*,\s*\(\s*\(")
    return F.transform(texts, lambda t: F.transform(F.regexp_extract_all(t, F.lit(r"([^()]*\d[^()]*)")), _points))


def edges_of(points: Column) -> Column:
    """Consecutive point pairs of a closed ring."""
    return F.zip_with(
        F.slice(points, F.lit(1), F.size(points) - 1), F.slice(points, F.lit(2), F.size(points) - 1), lambda a, b: F.struct(a.alias("a"), b.alias("b"))
    )


def _turn(e: Column) -> Column:
    """Turns of the world that an edge makes where it crosses the date line: -1, 0 or 1."""
    d = e["b"]["lng"] - e["a"]["lng"]
    return F.when(d > 180, -1).when(d < -180, 1).otherwise(0)


def _shifted(points: Column, turns) -> Column:
    return F.transform(points, lambda p: F.struct((p["lng"] + 360.0 * turns).alias("lng"), p["lat"].alias("lat")))


def _on_map(points: Column) -> Column:
    """A ring as the rings it makes on the map: one that crosses the date line is drawn whole on both sides."""
    crossings = F.filter(F.transform(edges_of(points), lambda e, i: F.struct(i.alias("at"), _turn(e).alias("turn"))), lambda c: c["turn"] != 0)

    def moved(p, i):
        turns = F.aggregate(crossings, F.lit(0), lambda n, c: n + F.when(c["at"] < i, c["turn"]).otherwise(0))
        return F.struct((p["lng"] + 360.0 * turns).alias("lng"), p["lat"].alias("lat"))

    whole = F.transform(points, moved)
    lngs = whole["lng"]
    beside = F.when(F.array_max(lngs) > 180, F.array(whole, _shifted(whole, -1))).when(F.array_min(lngs) < -180, F.array(whole, _shifted(whole, 1)))
    return F.when(F.size(crossings) == 0, F.array(points)).otherwise(F.coalesce(beside, F.array(whole)))


def outline(wkt) -> Column:
    """Edges of all rings of a WKT polygon or multipolygon, ready for ``inside`` and ``cover``.

    A point in a hole crosses an even number of them.  Rings may cross the date line, but not hold a
    pole.  A null or empty text has no edges.
    """
    rings = F.flatten(F.transform(F.flatten(parts(wkt)), _on_map))
    return F.coalesce(F.flatten(F.transform(rings, edges_of)), F.array().cast("array<struct<a:struct<lng:double,lat:double>,b:struct<lng:double,lat:double>>>"))


def inside(edges: Column, lat: Column, lng: Column) -> Column:
    """Ray cast: true if an odd number of edges lie east of the point."""

    def crosses(e):
        straddles = (e["a"]["lat"] > lat) != (e["b"]["lat"] > lat)
        x = (e["b"]["lng"] - e["a"]["lng"]) * (lat - e["a"]["lat"]) / (e["b"]["lat"] - e["a"]["lat"]) + e["a"]["lng"]
        # Level edges never straddle; CASE keeps them from being divided.
        return F.when(straddles, F.when(lng < x, 1).otherwise(0)).otherwise(0)

    return F.aggregate(edges, F.lit(0), lambda n, e: n + crosses(e)) % 2 == 1


def contains(points: Column, lat: Column, lng: Column) -> Column:
    """Ray cast against one ring."""
    return inside(edges_of(points), lat, lng)


def area(points: Column) -> Column:
    """Area of a ring on the sphere, square metres."""

    def part(s, e):
        dl = F.radians(e["b"]["lng"] - e["a"]["lng"] + 360.0 * _turn(e))
        return s + dl * (2 + F.sin(F.radians(e["a"]["lat"])) + F.sin(F.radians(e["b"]["lat"])))

    return F.abs(F.aggregate(edges_of(points), F.lit(0.0), part)) * F.lit(EARTH_M * EARTH_M / 2)


def polygon_area(wkt) -> Column:
    """Square metres of a WKT polygon or multipolygon without its holes."""

    def whole(rings):
        holes = F.aggregate(F.slice(rings, F.lit(2), F.greatest(F.size(rings) - 1, F.lit(0))), F.lit(0.0), lambda s, r: s + area(r))
        return area(F.get(rings, F.lit(0))) - holes

    # An empty polygon has no rings.
    return F.aggregate(parts(wkt), F.lit(0.0), lambda s, rings: s + F.coalesce(whole(rings), F.lit(0.0)))


# --- cells --------------------------------------------------------------------------


def pack(level, row: Column, column: Column) -> Column:
    level = F.lit(level) if isinstance(level, int) else level
    high = F.shiftleft(level.cast("long"), 2 * INDEX_BITS)
    return high + F.shiftleft(row.cast("long"), INDEX_BITS) + column.cast("long")


def cell_level(cell) -> Column:
    return F.shiftright(col(cell), 2 * INDEX_BITS).cast("int")


def cell_row(cell) -> Column:
    return F.shiftright(col(cell), INDEX_BITS).bitwiseAND(F.lit(2**INDEX_BITS - 1).cast("long"))


def cell_column(cell) -> Column:
    return col(cell).bitwiseAND(F.lit(2**INDEX_BITS - 1).cast("long"))


def _side(level) -> Column:
    level = F.lit(level) if isinstance(level, int) else level
    return F.pow(F.lit(2.0), level.cast("double"))


def lat_row(lat, level) -> Column:
    return F.least(F.floor((col(lat) + 90.0) / 180.0 * _side(level)), _side(level).cast("long") - 1)


def lng_column(lng, level) -> Column:
    """Column index, not wrapped."""
    return F.floor((col(lng) + 180.0) / 360.0 * _side(level))


def wrap(column: Column, level) -> Column:
    return F.pmod(column, _side(level).cast("long"))


def cell(lat, lng, level: int) -> Column:
    """Cell of a point."""
    return pack(level, lat_row(lat, level), wrap(lng_column(lng, level), level))


def cell_text(c) -> Column:
    return F.lower(F.hex(col(c)))


def text_cell(text) -> Column:
    return F.conv(col(text), 16, 10).cast("long")


def cell_valid(c) -> Column:
    side = _side(cell_level(c))
    ok = cell_level(c).between(0, MAX_LEVEL) & (cell_row(c) < side) & (cell_column(c) < side)
    return F.coalesce(ok & (col(c) >= 0), F.lit(False))


def cell_bounds(c) -> dict[str, Column]:
    side = _side(cell_level(c))
    return {
        "south": cell_row(c) / side * 180.0 - 90.0,
        "north": (cell_row(c) + 1) / side * 180.0 - 90.0,
        "west": cell_column(c) / side * 360.0 - 180.0,
        "east": (cell_column(c) + 1) / side * 360.0 - 180.0,
    }


def cell_lat(c) -> Column:
    return (cell_row(c) + 0.5) / _side(cell_level(c)) * 180.0 - 90.0


def cell_lng(c) -> Column:
    return (cell_column(c) + 0.5) / _side(cell_level(c)) * 360.0 - 180.0


def cell_boundary(c) -> Column:
    """Cell outline as a WKT polygon."""
    b = {k: v.cast("string") for k, v in cell_bounds(c).items()}
    corners = [("west", "south"), ("east", "south"), ("east", "north"), ("west", "north"), ("west", "south")]
    points = [F.concat(b[x], F.lit(" "), b[y]) for x, y in corners]
    return F.concat(F.lit("POLYGON(("), F.concat_ws(", ", *points), F.lit("))"))


def cell_area(c) -> Column:
    """Square metres: R^2 * width * (sin north - sin south)."""
    b = cell_bounds(c)
    width = F.radians(b["east"] - b["west"])
    return F.lit(EARTH_M * EARTH_M) * width * (F.sin(F.radians(b["north"])) - F.sin(F.radians(b["south"])))


def cell_edge_m(level: int) -> float:
    """North-south edge of a cell in metres."""
    return np.pi * EARTH_M / 2**level


def parent(c, level: int) -> Column:
    """The enclosing cell at a lower level."""
    by = cell_level(c) - level
    return pack(level, F.call_function("shiftright", cell_row(c), by), F.call_function("shiftright", cell_column(c), by))


def children(c, level: int) -> Column:
    """Array of the cells at a higher level that make up a cell."""
    n = F.call_function("shiftleft", F.lit(1), F.lit(level) - cell_level(c)).cast("long")
    rows = F.sequence(cell_row(c) * n, cell_row(c) * n + n - 1)
    columns = F.sequence(cell_column(c) * n, cell_column(c) * n + n - 1)
    return F.flatten(F.transform(rows, lambda r: F.transform(columns, lambda k: pack(level, r, k))))


def center_child(c, level: int) -> Column:
    """The child north-east of the centre."""
    n = F.call_function("shiftleft", F.lit(1), F.lit(level) - cell_level(c)).cast("long")
    half = F.floor(n / 2)
    return pack(level, cell_row(c) * n + half, cell_column(c) * n + half)


def disk(c, k: int) -> Column:
    """Array of the cells at most ``k`` steps away (king's moves), the cell itself included."""
    level, side = cell_level(c), _side(cell_level(c)).cast("long")
    offsets = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in range(-k, k + 1) for j in range(-k, k + 1)])
    inside = F.filter(offsets, lambda o: (cell_row(c) + o["i"]).between(F.lit(0), side - 1))
    cells = F.transform(inside, lambda o: pack(level, cell_row(c) + o["i"], F.pmod(cell_column(c) + o["j"], side)))
    return F.array_distinct(cells)


def ring_cells(c, k: int) -> Column:
    """Array of the cells exactly ``k`` steps away."""
    return disk(c, k) if k == 0 else F.array_except(disk(c, k), disk(c, k - 1))


def grid_distance(a, b) -> Column:
    """Steps between two cells of one level, across the date line if shorter."""
    side = _side(cell_level(a)).cast("long")
    dx = F.abs(cell_column(a) - cell_column(b))
    return F.greatest(F.abs(cell_row(a) - cell_row(b)), F.least(dx, side - dx))


#: Cells of paths that are worked out at a time, and sent as one batch.
PATH_CELLS = 1 << 17


def _span(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns from cell a to cell b."""
    mask = 2**INDEX_BITS - 1
    return ((b >> INDEX_BITS) & mask) - ((a >> INDEX_BITS) & mask), (b & mask) - (a & mask)


def _paths(a: np.ndarray, b: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Cells of the paths of ``n`` steps from ``a`` to ``b``, one path after the other."""
    rows, columns = _span(a, b)
    sizes = n + 1
    share = (np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)) / np.repeat(np.maximum(n, 1), sizes)
    cells = np.floor(np.repeat(rows.astype(np.float64), sizes) * share + 0.5).astype(np.int64)
    cells <<= INDEX_BITS
    cells += np.floor(np.repeat(columns.astype(np.float64), sizes) * share + 0.5).astype(np.int64)
    cells += np.repeat(a, sizes)
    return cells


@F.arrow_udf(T.ArrayType(T.LongType()))
def _grid_paths(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    for ends in batches:
        null = ~np.logical_and(*(x.is_valid().to_numpy(zero_copy_only=False) for x in ends))
        a, b = (np.where(null, 0, x.fill_null(0).to_numpy(zero_copy_only=False)) for x in ends)
        n = np.max(np.abs(_span(a, b)), axis=0)
        at, lo = np.concatenate([[0], np.cumsum(n + 1)]), 0
        while lo < len(a):
            hi = max(lo + 1, int(np.searchsorted(at, at[lo] + PATH_CELLS, "right")) - 1)
            cells = _paths(a[lo:hi], b[lo:hi], n[lo:hi])
            yield pa.ListArray.from_arrays(pa.array((at[lo : hi + 1] - at[lo]).astype(np.int32)), pa.array(cells), mask=pa.array(null[lo:hi]))
            lo = hi


def grid_path(a, b) -> Column:
    """Array of cells from a to b, one step at a time (not across the date line).

    Paths of a long way have tens of thousands of cells, so they are worked out as arrays and
    cross to Spark some at a time.
    """
    return _grid_paths(col(a), col(b))


#: Degrees by which a cell is taken as larger, so that rounding cannot put a point beside its cell.
SLACK = 1e-9


def _touches(e: Column, box: dict[str, Column]) -> Column:
    """True if an edge meets a box: their extents do, and the corners are not all on one side of its line."""
    ax, ay, bx, by = e["a"]["lng"], e["a"]["lat"], e["b"]["lng"], e["b"]["lat"]
    near = (F.least(ax, bx) <= box["east"]) & (F.greatest(ax, bx) >= box["west"])
    near = near & (F.least(ay, by) <= box["north"]) & (F.greatest(ay, by) >= box["south"])
    sides = [(bx - ax) * (box[y] - ay) - (by - ay) * (box[x] - ax) for x in ("west", "east") for y in ("south", "north")]
    return near & (F.least(*sides) <= 0) & (F.greatest(*sides) >= 0)


def cover(df: DataFrame, edges: str, steps: int = 5, level: int = MAX_LEVEL) -> DataFrame:
    """Cells of mixed levels that cover each polygon: the columns of ``df``, ``cell`` and ``inner``.

    A polygon starts with the at most four cells of its own size, down to ``level``.  A cell that an
    edge meets is cut in four, ``steps`` times; one that none meets is wholly inside (``inner``) or
    left out.  So a country and a city block take about as many cells each.  ``edges`` becomes the
    part of the outline that a point in that cell can have to its east; inner cells need none.
    """
    lats, lngs = F.col(edges)["a"]["lat"], F.col(edges)["a"]["lng"]
    share = F.greatest((F.array_max(lats) - F.array_min(lats)) / 180.0, (F.array_max(lngs) - F.array_min(lngs)) / 360.0, F.lit(2.0**-level))
    start = F.greatest(F.lit(0), F.least(F.lit(level), F.floor(-F.log2(share)))).cast("int")
    last = _side(F.col("_start")).cast("long") - 1

    def span(low, high):
        return F.explode(F.sequence(F.greatest(low, F.lit(0).cast("long")), F.least(high, last)))

    rows = df.where(F.size(edges) > 0).withColumn("_start", start)
    rows = rows.withColumn("_row", span(lat_row(F.array_min(lats), F.col("_start")), lat_row(F.array_max(lats), F.col("_start"))))
    rows = rows.withColumn("_col", span(lng_column(F.array_min(lngs), F.col("_start")), lng_column(F.array_max(lngs), F.col("_start"))))
    rows = rows.withColumn("_cells", F.array(pack(F.col("_start"), F.col("_row"), F.col("_col")))).drop("_start", "_row", "_col")
    # The same columns serve all steps, as they refer to the row by name.
    judged = _judged(F.col("_cells"), F.col(edges))
    found = {"cell": F.col("_found.cell"), "inner": F.col("_found.inner"), edges: F.col("_found.edges")}
    rows = rows.withColumn("_found", F.explode(judged)).withColumns(found)
    here, row, column = cell_level("cell"), cell_row("cell") * 2, cell_column("cell") * 2
    quarters = F.array(*[pack(here + 1, row + i, column + j) for i in (0, 1) for j in (0, 1)])
    same = F.array(F.struct("cell", "inner", F.col(edges).alias("edges")))
    cut = F.explode(F.when(F.col("inner") | (here >= level), same).otherwise(judged))
    for _ in range(steps):
        rows = rows.withColumn("_cells", quarters).withColumn("_found", cut).withColumns(found)
    return rows.drop("_found", "_cells")


def _judged(cells: Column, edges: Column) -> Column:
    """(cell, inner, edges) of those cells of an array that are not wholly outside.

    Each transform names what the next one uses more than once.
    """

    def box_of(c):
        b = cell_bounds(c)
        return F.struct(c.alias("cell"), *[(b[k] + F.lit(SLACK if k in ("north", "east") else -SLACK)).alias(k) for k in b])

    def to_east(e, b):
        lat1, lat2, lng1, lng2 = e["a"]["lat"], e["b"]["lat"], e["a"]["lng"], e["b"]["lng"]
        return (F.least(lat1, lat2) <= b["north"]) & (F.greatest(lat1, lat2) >= b["south"]) & (F.greatest(lng1, lng2) >= b["west"])

    def side(b):
        box = {k: b["box"][k] for k in ("south", "north", "west", "east")}
        whole = inside(b["edges"], cell_lat(b["box"]["cell"]), cell_lng(b["box"]["cell"]))
        return F.when(F.exists(b["edges"], lambda e: _touches(e, box)), "border").when(whole, "inner")

    trimmed = F.transform(F.transform(cells, box_of), lambda b: F.struct(b.alias("box"), F.filter(edges, lambda e: to_east(e, b)).alias("edges")))
    told = F.transform(trimmed, lambda b: F.struct(b["box"]["cell"].alias("cell"), side(b).alias("side"), b["edges"].alias("edges")))

    def result(b):
        inner = b["side"] == "inner"
        # What is known to be inside needs no outline.
        return F.struct(b["cell"].alias("cell"), inner.alias("inner"), F.when(inner, F.slice(b["edges"], 1, 0)).otherwise(b["edges"]).alias("edges"))

    return F.transform(F.filter(told, lambda b: b["side"].isNotNull()), result)


def polyfill(df: DataFrame, edges: str, level: int, steps: int = 5) -> DataFrame:
    """One row per cell of a level whose centre lies in the polygon: the columns of ``df`` plus ``cell``.

    The cover's cells are cut down to the level row by row, so no list of a polygon's cells is made.
    """
    rows = cover(df, edges, steps, level).withColumn("_n", F.call_function("shiftleft", F.lit(1).cast("long"), F.lit(level) - cell_level("cell")))
    for name, at in (("_row", cell_row("cell")), ("_col", cell_column("cell"))):
        rows = rows.withColumn(name, F.explode(F.sequence(at * F.col("_n"), at * F.col("_n") + F.col("_n") - 1)))
    rows = rows.withColumn("cell", pack(level, F.col("_row"), F.col("_col")))
    return rows.where(F.col("inner") | inside(F.col(edges), cell_lat("cell"), cell_lng("cell"))).drop("inner", "_n", "_row", "_col")


# --- joins --------------------------------------------------------------------------


def points_in_polygons(points: DataFrame, polygons: DataFrame, edges: str, steps: int = 5) -> DataFrame:
    """Points (lat, lng in [-180, 180)) with the polygons that contain them, without ``edges``.

    Polygons are listed under the cells of their cover; a point looks under its cell at each of the
    cover's levels.  A polygon's cells do not overlap, so a pair comes out once; in inner cells it
    needs no test, in others the ray cast against that cell's edges decides.
    """
    listed = settle(cover(polygons, edges, steps).withColumnsRenamed({"cell": "_cell", "inner": "_inner", edges: "_edges"}), "cover")
    # At most MAX_LEVEL + 1 numbers.
    levels = [r[0] for r in listed.select(cell_level("_cell")).distinct().collect()] or [0]
    placed = points.withColumn("_cell", F.explode(F.array(*[cell("lat", "lng", n) for n in sorted(levels)])))
    hit = F.col("_inner") | inside(F.col("_edges"), F.col("lat"), F.col("lng"))
    return placed.join(listed, "_cell").where(hit).drop("_cell", "_inner", "_edges")


def within_radius(points: DataFrame, sites: DataFrame, metres: float, level: int) -> DataFrame:
    """Pairs of points and sites (lat, lng -> s_lat, s_lng) at most ``metres`` apart.

    A site is listed under every cell its circle's bounding box touches.  Near a pole the
    box spans all longitudes.
    """
    reach = float(np.degrees(metres / EARTH_M)) * (1 + 1e-9)
    south, north = F.col("s_lat") - reach, F.col("s_lat") + reach
    ratio = F.lit(float(np.sin(metres / EARTH_M))) / F.cos(F.radians("s_lat"))
    polar = (south <= -90.0) | (north >= 90.0) | (ratio >= 1.0)
    half = F.when(polar, F.lit(180.0)).otherwise(F.degrees(F.asin(F.least(ratio, F.lit(1.0)))) * (1 + 1e-9))
    rows = F.sequence(lat_row(F.greatest(south, F.lit(-90.0)), level), lat_row(F.least(north, F.lit(90.0)), level))
    columns = F.sequence(lng_column(F.col("s_lng") - half, level), lng_column(F.col("s_lng") + half, level))
    listed = sites.withColumn("_row", F.explode(rows)).withColumn("_col", F.explode(F.array_distinct(F.transform(columns, lambda k: wrap(k, level)))))
    placed = points.withColumns({"_row": lat_row("lat", level), "_col": wrap(lng_column("lng", level), level)})
    pairs = placed.join(listed, ["_row", "_col"]).withColumn("distance_m", distance("lat", "lng", "s_lat", "s_lng"))
    return pairs.where(F.col("distance_m") <= metres).drop("_row", "_col")


def box_distance(lat, lng, box: dict[str, Column]) -> Column:
    """Least great-circle distance in metres from a point to a latitude/longitude box.

    On every parallel the nearest place of the box has the least longitude difference, so it lies on
    the point's own meridian or on the nearer side; on that meridian it is one end, or the foot of the
    perpendicular where the box holds it.
    """
    lat, lng = col(lat), col(lng)
    width = box["east"] - box["west"]
    turn = F.lit(360.0)
    gap = F.least(F.pmod(box["west"] - lng, turn), F.pmod(lng - box["east"], turn))
    aside = F.when(F.pmod(lng - box["west"], turn) <= width, F.lit(0.0)).otherwise(gap)
    foot = F.degrees(F.atan2(F.sin(F.radians(lat)), F.cos(F.radians(lat)) * F.cos(F.radians(aside))))
    near = F.greatest(box["south"], F.least(box["north"], foot))
    return F.least(*[distance(lat, F.lit(0.0), y, aside) for y in (box["south"], box["north"], near)])


#: Levels of the site tree: each node has up to 16 children.
TREE_LEVELS = tuple(range(0, 25, 2))


def site_tree(sites: DataFrame, leaf: int) -> tuple[DataFrame, DataFrame]:
    """An adaptive quadtree over sites: (nodes, listed sites), both written tables.

    A cell is split while it holds more than ``leaf`` sites.  Nodes have their parent, the tight box
    of their sites, one of their sites and whether they are leaves; cells without sites have no node.
    Listed sites have their leaf as ``_cell``.
    """
    paths = F.explode(F.array(*[cell("s_lat", "s_lng", n) for n in TREE_LEVELS]))
    placed = sites.withColumn("_cell", paths)
    box = {"south": F.min("s_lat"), "north": F.max("s_lat"), "west": F.min("s_lng"), "east": F.max("s_lng")}
    cells = placed.groupBy("_cell").agg(
        F.count("*").alias("n"), F.min(F.struct("s_lat", "s_lng")).alias("one"), *[v.alias(k) for k, v in box.items()]
    )
    level = cell_level("_cell")
    above = pack(level - 2, F.shiftright(cell_row("_cell"), 2), F.shiftright(cell_column("_cell"), 2))
    cells = settle(
        cells.withColumns({"level": level, "parent": F.when(level > 0, above), "is_leaf": (F.col("n") <= leaf) | (level == TREE_LEVELS[-1])}),
        "site-cells",
    )
    split = cells.where("NOT is_leaf").select(F.col("_cell").alias("parent"))
    nodes = settle(cells.where("level = 0").unionByName(cells.where("level > 0").join(split, "parent", "left_semi")), "site-nodes")
    leaves = nodes.where("is_leaf").select("_cell")
    return nodes, settle(placed.join(leaves, "_cell", "left_semi"), "site-leaves")


def leaves_near(points: DataFrame, nodes: DataFrame, point_id: str) -> DataFrame:
    """The leaves of a site tree that may hold the nearest site of each point: point_id, lat, lng, _cell.

    Points go down the tree level by level.  Of a node's children a point keeps those whose box is no
    farther than the nearest site known so far, so dense towns in a wide area are opened only by the
    points that they may serve.  There is one round a level that has a node to split.
    """
    # One row a level, at most 13.
    count = [F.count("*").alias("n"), F.count_if(~F.col("is_leaf")).alias("split"), F.max("_cell").alias("one")]
    levels = {r["level"]: r for r in nodes.groupBy("level").agg(*count).collect()}
    start = points.where("lat IS NOT NULL AND lng IS NOT NULL").select(point_id, "lat", "lng")
    if not levels:
        return start.withColumn("_cell", F.lit(None).cast("long")).limit(0)
    # Down to the first level with several nodes there is nothing to choose.
    level = max(n for n in levels if all(levels[m]["n"] == 1 for m in levels if m <= n))
    live = start.select("*", F.lit(levels[level]["one"]).alias("_cell"), F.lit(float("inf")).alias("_bound"))
    if not levels[level]["split"]:
        return live.drop("_bound")
    done = []
    while level in levels and levels[level]["split"]:
        below = nodes.where(F.col("level") == level + 2).select(
            F.col("parent").alias("_parent"), F.col("_cell").alias("_child"), "one", "south", "north", "west", "east", "is_leaf"
        )
        seen = live.join(below, F.col("_cell") == F.col("_parent"))
        box = {k: F.col(k) for k in ("south", "north", "west", "east")}
        seen = seen.withColumn("_least", box_distance("lat", "lng", box)).where(F.col("_least") <= F.col("_bound") + SLACK_M)
        seen = seen.withColumn("_most", F.least("_bound", distance("lat", "lng", F.col("one.s_lat"), F.col("one.s_lng"))))
        bound = F.min("_most").over(Window.partitionBy(point_id))
        kept = seen.withColumn("_bound", bound).where(F.col("_least") <= F.col("_bound") + SLACK_M)
        state = settle(kept.select(point_id, "lat", "lng", F.col("_child").alias("_cell"), "_bound", "is_leaf"), "site-round")
        done.append(state.where("is_leaf").drop("is_leaf", "_bound"))
        live = state.where("NOT is_leaf").drop("is_leaf")
        level += 2
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out


def nearest_site(points: DataFrame, sites: DataFrame, point_id: str, site_id: str, leaf: int = 16) -> DataFrame:
    """Nearest site per point (ties: smallest site id): point_id, site_id, distance_m.

    A point is compared with the sites of the few leaves that ``leaves_near`` gives it, wherever the
    sites lie.  ``point_id`` is unique; points and sites without a place are left out.
    """
    # Sites at one place can only be told apart by id, so the smallest stands for all.
    known = sites.where("s_lat IS NOT NULL AND s_lng IS NOT NULL")
    nodes, listed = site_tree(settle(known.groupBy("s_lat", "s_lng").agg(F.min(site_id).alias(site_id)), "sites"), leaf)
    pairs = leaves_near(points, nodes, point_id).join(listed, "_cell")
    best = pairs.groupBy(point_id).agg(F.min(F.struct(distance("lat", "lng", "s_lat", "s_lng").alias("d"), site_id)).alias("b"))
    return best.select(point_id, F.col(f"b.{site_id}").alias(site_id), F.col("b.d").alias("distance_m"))
