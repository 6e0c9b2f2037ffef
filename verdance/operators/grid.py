"""Grids: sameness, resampling onto another grid, and polygons to pixels."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Grid:
    """A north-up raster grid: cell (y, x) begins at (left + x * dx, top + y * dy)."""

    height: int
    width: int
    left: float
    top: float
    dx: float
    dy: float
    crs: str = ""

    def same(self, other: Grid) -> bool:
        return self == other

    def centre(self, y: Column, x: Column) -> tuple[Column, Column]:
        """Coordinates (easting, northing) of a cell's middle."""
        return F.lit(self.left) + (x + F.lit(0.5)) * F.lit(self.dx), F.lit(self.top) + (y + F.lit(0.5)) * F.lit(self.dy)

    def place(self, east: Column, north: Column) -> tuple[Column, Column]:
        """Fractional row and column of coordinates; whole numbers are cells' edges."""
        return (north - F.lit(self.top)) / F.lit(self.dy), (east - F.lit(self.left)) / F.lit(self.dx)


def mismatched(grids: DataFrame, keys: list[str]) -> DataFrame:
    """keys, n: those whose bands lie on n different grids."""
    place = F.struct(*[c for c in ("height", "width", "left", "top", "dx", "dy", "crs") if c in grids.columns])
    return grids.groupBy(*keys).agg(F.count_distinct(place).alias("n")).where("n > 1")


def require_same(grids: DataFrame, keys: list[str]) -> None:
    """Fail if a scene's bands lie on different grids."""
    if (row := mismatched(grids, keys).first()) is not None:
        raise ValueError(f"bands are not on one grid: {row.asDict()}")


def cells(scenes: DataFrame, grid: Grid) -> DataFrame:
    """All cells of the grid for each scene."""
    return lines(scenes, grid).select("*", F.explode(F.sequence(F.lit(0), F.lit(grid.width - 1))).alias("x"))


def lines(scenes: DataFrame, grid: Grid) -> DataFrame:
    """All rows of the grid for each scene, dealt to as many tasks as a shuffle has."""
    n = int(scenes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return scenes.select("*", F.explode(F.sequence(F.lit(0), F.lit(grid.height - 1))).alias("y")).repartition(n, "y")


def _geographic(crs: str) -> bool:
    return crs == "EPSG:4326"


def _zone(crs: str) -> tuple[int, bool] | None:
    """Zone and whether it is southern, of UTM on WGS 84."""
    code = int(crs[5:]) if crs.startswith("EPSG:") and crs[5:].isdigit() else 0
    return (code % 100, code // 100 == 327) if code // 100 in (326, 327) and 1 <= code % 100 <= 60 else None


def reprojected(east: Column, north: Column, source: str, target: str) -> tuple[Column, Column]:
    """Coordinates of one reference system in another: degrees or UTM, both on WGS 84.

    Systems that are not named on both sides are taken to be the same; others are refused.
    """
    if source == target or not source or not target:
        return east, north
    if not all(_geographic(c) or _zone(c) for c in (source, target)):
        raise ValueError(f"cannot project {source} to {target}")
    if (zone := _zone(source)) is not None:
        east, north = from_utm(east, north - F.lit(1e7) if zone[1] else north, zone[0])
    if (zone := _zone(target)) is not None:
        east, north = utm(east, north, zone[0])
        north = north + F.lit(1e7) if zone[1] else north
    return east, north


def _sought(source: Grid, target: Grid) -> tuple[Column, Column]:
    """Fractional row and column of the source at each target cell's middle."""
    return source.place(*reprojected(*target.centre(F.col("y"), F.col("x")), target.crs, source.crs))


def aligned(px: DataFrame, source: Grid, target: Grid, by: list[str], bands: list[str], unfilled: list[str] | None = None) -> DataFrame:
    """The pixels on the target grid: as they are if it is the same, else the nearest; 0 or false outside, NULL for unfilled."""
    if source.same(target):
        return px
    return nearest(px, source, target, by, bands, unfilled=unfilled)


def nearest(px: DataFrame, source: Grid, target: Grid, by: list[str], bands: list[str], fill: float = 0.0, unfilled: list[str] | None = None) -> DataFrame:
    """Values of the source cells that target cells' middles fall into; fill outside, NULL for unfilled columns."""
    scenes = px.select(*by).distinct()
    r, c = _sought(source, target)
    want = cells(scenes, target).withColumns({"sy": F.floor(r).cast("int"), "sx": F.floor(c).cast("int")})
    kinds, rest = dict(px.dtypes), unfilled or []
    have = px.select(*by, F.col("y").alias("sy"), F.col("x").alias("sx"), *bands, *rest, F.lit(True).alias("there"))
    out = want.join(have, [*by, "sy", "sx"], "left")
    return out.select(*by, "y", "x", *[F.when(F.col("there").isNull(), F.lit(fill).cast(kinds[b])).otherwise(F.col(b)).alias(b) for b in bands], *rest)


#: Columns of a stretch of two source rows that target cells read together.
STRETCH = 16


def bilinear(px: DataFrame, source: Grid, target: Grid, by: list[str], bands: list[str]) -> DataFrame:
    """Weighted means of the four source cells around target cells' middles.

    Missing neighbours leave the others' weights to count for all; NULL if there are none.
    Unless the reference systems differ, a target row lies between two source rows: stretches
    of those meet the target's rows, and its cells are made after that join.
    """
    if source.crs and target.crs and source.crs != target.crs:
        return _bilinear_by_points(px, source, target, by, bands)
    scenes = px.select(*by).distinct()
    r, c = _sought(source, target)
    low = lambda f: F.floor(f - F.lit(0.5)).cast("int")
    share = lambda f: f - F.lit(0.5) - low(f)
    across = px.sparkSession.range(target.width).select(F.col("id").cast("int").alias("x")).select("x", low(c).alias("x0"), share(c).alias("wx"))
    across = across.withColumn("part", F.floor(F.col("x0") / STRETCH).cast("int"))
    of_part = across.groupBy("part").agg(F.collect_list(F.struct("x", "x0", "wx")).alias("xs"))
    want = lines(scenes, target).select(*by, "y", low(r).alias("y0"), share(r).alias("wy")).crossJoin(F.broadcast(across.select("part").distinct()))
    # each pixel goes to the stretches of the cells on either side of its middle
    parts = F.array_distinct(F.array(*[F.floor((F.col("x") - j) / STRETCH).cast("int") for j in (0, 1)]))
    have = px.select(*by, "y", "x", *bands, F.explode(parts).alias("part")).select(*by, "x", "part", *bands, F.inline(F.array(*[F.struct((F.col("y") - i).cast("int").alias("y0"), F.lit(i).alias("i")) for i in (0, 1)])))
    slot = lambda x, i: (x - F.col("part") * STRETCH) * 2 + i
    have = have.repartition(*by, "y0", "part").groupBy(*by, "y0", "part", slot(F.col("x"), F.col("i")).cast("int").alias("slot"))
    sums = have.agg(*[f(F.col(b).cast("double")).alias(f"{k}{n}") for n, b in enumerate(bands) for k, f in (("s", F.sum), ("n", F.count))])
    cells_ = F.map_from_entries(F.collect_list(F.struct("slot", F.struct(*[f"{k}{n}" for n in range(len(bands)) for k in "sn"]))))
    stretches = sums.groupBy(*by, "y0", "part").agg(cells_.alias("cells"))
    joined = want.join(stretches, [*by, "y0", "part"], "left").join(F.broadcast(of_part), "part")
    cell = joined.select(*by, "y", "wy", "part", "cells", F.inline("xs"))
    corners = [(F.col("wy") if i else 1 - F.col("wy")) * (F.col("wx") if j else 1 - F.col("wx")) for i in (0, 1) for j in (0, 1)]
    cell = cell.select(*by, "y", "x", *[w.alias(f"w{k}") for k, w in enumerate(corners)], *[F.try_element_at("cells", slot(F.col("x0") + k % 2, k // 2).cast("int")).alias(f"c{k}") for k in range(4)])

    def total(what: str) -> Column:
        each = [F.coalesce(F.when(F.col(f"w{k}") > 0, F.col(f"c{k}")[what] * F.col(f"w{k}")), F.lit(0.0)) for k in range(4)]
        return each[0] + each[1] + each[2] + each[3]

    return cell.select(*by, "y", "x", *[F.try_divide(total(f"s{n}"), total(f"n{n}")).cast("float").alias(b) for n, b in enumerate(bands)])


def _bilinear_by_points(px: DataFrame, source: Grid, target: Grid, by: list[str], bands: list[str]) -> DataFrame:
    """bilinear() by a join of the four cells of each target cell, wherever they lie."""
    scenes = px.select(*by).distinct()
    r, c = _sought(source, target)
    want = cells(scenes, target).withColumns({"fr": r - F.lit(0.5), "fc": c - F.lit(0.5)})
    want = want.withColumns({"y0": F.floor("fr").cast("int"), "x0": F.floor("fc").cast("int")}).withColumns({"wy": F.col("fr") - F.col("y0"), "wx": F.col("fc") - F.col("x0")})
    corner = lambda i, j: F.struct((F.col("y0") + i).alias("sy"), (F.col("x0") + j).alias("sx"), ((F.col("wy") if i else 1 - F.col("wy")) * (F.col("wx") if j else 1 - F.col("wx"))).alias("w"))
    four = want.select(*by, "y", "x", F.inline(F.array(*[corner(i, j) for i in (0, 1) for j in (0, 1)]))).where("w > 0")
    have = px.select(*by, F.col("y").alias("sy"), F.col("x").alias("sx"), *bands)
    joined = four.join(have, [*by, "sy", "sx"], "left")
    mean = lambda b: F.try_divide(F.sum(F.col(b).cast("double") * F.col("w")), F.sum(F.when(F.col(b).isNotNull(), F.col("w")))).cast("float").alias(b)
    return joined.groupBy(*by, "y", "x").agg(*[mean(b) for b in bands])


#: Polygons and pixels meet in square tiles of so many cells.
TILE = 256


def polygons_to_pixels(polygons: DataFrame, grid: Grid, px: DataFrame, group: str = "group_id", order: str = "feature") -> DataFrame:
    """y, x and the group of the last polygon, by order, that holds the pixel's middle.

    polygons: group, order and edges, array<struct<x1,y1,x2,y2>>, rings of any
    number.  Even-odd rule, half-open edges.  Pixels outside all are left out.
    px: distinct (y, x).
    """
    lo = lambda k: F.array_min(F.transform("edges", lambda e: F.least(e[f"{k}1"], e[f"{k}2"])))
    hi = lambda k: F.array_max(F.transform("edges", lambda e: F.greatest(e[f"{k}1"], e[f"{k}2"])))
    (r0, c0), (r1, c1) = grid.place(lo("x"), lo("y")), grid.place(hi("x"), hi("y"))
    box = polygons.where(F.size("edges") > 0).select(group, order, "edges", *[F.floor(f(a, b) / TILE).cast("int").alias(n) for n, f, a, b in (("ty0", F.least, r0, r1), ("ty1", F.greatest, r0, r1), ("tx0", F.least, c0, c1), ("tx1", F.greatest, c0, c1))])
    tiled = box.withColumn("ty", F.explode(F.sequence("ty0", "ty1"))).withColumn("tx", F.explode(F.sequence("tx0", "tx1"))).select(group, order, "edges", "ty", "tx")
    east, north = grid.centre(F.col("y"), F.col("x"))
    points = px.select("y", "x", F.floor(F.col("y") / TILE).cast("int").alias("ty"), F.floor(F.col("x") / TILE).cast("int").alias("tx"), east.alias("px"), north.alias("py"))
    near = points.join(tiled, ["ty", "tx"])
    crosses = F.filter("edges", lambda e: ((e["y1"] > F.col("py")) != (e["y2"] > F.col("py"))) & (F.col("px") < (e["x2"] - e["x1"]) * (F.col("py") - e["y1"]) / F.when(e["y2"] != e["y1"], e["y2"] - e["y1"]) + e["x1"]))
    inside = near.where(F.size(crosses) % 2 == 1)
    return inside.groupBy("y", "x").agg(F.max_by(group, order).alias(group))


def utm(lon: Column, lat: Column, zone: int) -> tuple[Column, Column]:
    """Easting and northing on the WGS 84 ellipsoid by Krueger's series to third order; northern hemisphere."""
    import math

    f = 1 / 298.257223563
    n = f / (2 - f)
    a = 6378137.0 / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    alpha = (n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16, 13 * n**2 / 48 - 3 * n**3 / 5, 61 * n**3 / 240)
    e = 2 * math.sqrt(n) / (1 + n)
    phi, lam = F.radians(lat), F.radians(lon - F.lit(zone * 6.0 - 183.0))
    t = F.sinh(F.atanh(F.sin(phi)) - F.lit(e) * F.atanh(F.lit(e) * F.sin(phi)))
    xi, eta = F.atan2(t, F.cos(lam)), F.atanh(F.sin(lam) / F.sqrt(1 + t * t))
    k0 = 0.9996
    east, north = eta, xi
    for j, c in enumerate(alpha, 1):
        east = east + F.lit(c) * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
        north = north + F.lit(c) * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
    return F.lit(500_000.0) + F.lit(k0 * a) * east, F.lit(k0 * a) * north


def from_utm(east: Column, north: Column, zone: int) -> tuple[Column, Column]:
    """Longitude and latitude of easting and northing, by the inverse series."""
    import math

    f = 1 / 298.257223563
    n = f / (2 - f)
    a = 6378137.0 / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    beta = (n / 2 - 2 * n**2 / 3 + 37 * n**3 / 96, n**2 / 48 + n**3 / 15, 17 * n**3 / 480)
    delta = (2 * n - 2 * n**2 / 3 - 2 * n**3, 7 * n**2 / 3 - 8 * n**3 / 5, 56 * n**3 / 15)
    xi, eta = north / F.lit(0.9996 * a), (east - F.lit(500_000.0)) / F.lit(0.9996 * a)
    xi1, eta1 = xi, eta
    for j, b in enumerate(beta, 1):
        xi1 = xi1 - F.lit(b) * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
        eta1 = eta1 - F.lit(b) * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
    chi = F.asin(F.sin(xi1) / F.cosh(eta1))
    phi = chi
    for j, d in enumerate(delta, 1):
        phi = phi + F.lit(d) * F.sin(2 * j * chi)
    lam = F.atan2(F.sinh(eta1), F.cos(xi1))
    return F.degrees(lam) + F.lit(zone * 6.0 - 183.0), F.degrees(phi)


def edges_to_utm(edges: Column, zone: int) -> Column:
    """Polygon sides in degrees as sides in metres of a UTM zone."""
    def side(e: Column) -> Column:
        (x1, y1), (x2, y2) = utm(e["x1"], e["y1"], zone), utm(e["x2"], e["y2"], zone)
        return F.struct(x1.alias("x1"), y1.alias("y1"), x2.alias("x2"), y2.alias("y2"))

    return F.transform(edges, side)
