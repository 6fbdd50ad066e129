"""Points in regions: a spatial join of positions with spherical polygons.

A region is covered by cells whose size suits its own, so that it has some hundred of them whatever its size. Points meet
regions by an equi-join on cells; those in a cell that lies wholly in the region are done, and only those in a cell on its
border take the exact test of the edges.

Cells of level l: 2^l rows of latitude, each cut into about as many columns as make them square, down to one at the poles.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows of cells over a region's height; levels at most.
ACROSS, LEVELS = 16, 20
#: As in the exact test: ten times the spacing of doubles at 1.
TINY = 10 * 2.0**-52


def _vector(lat: Column, lon: Column) -> Column:
    a, b = F.radians(lat), F.radians(lon)
    return F.struct((F.cos(a) * F.cos(b)).alias("x"), (F.cos(a) * F.sin(b)).alias("y"), F.sin(a).alias("z"))


def _cross(a: Column, b: Column) -> Column:
    n = [a["y"] * b["z"] - a["z"] * b["y"], a["z"] * b["x"] - a["x"] * b["z"], a["x"] * b["y"] - a["y"] * b["x"]]
    return F.struct(*(v.alias(k) for v, k in zip(n, "xyz", strict=True)))


def _dot(a: Column, b: Column) -> Column:
    return a["x"] * b["x"] + a["y"] * b["y"] + a["z"] * b["z"]


def _edges(corners: Column) -> Column:
    """Normals of the edges of a polygon: a point is on the right of an edge, or on it, if its product with the normal is
    below TINY."""
    return F.transform(corners, lambda c, i: _cross(F.when(i == 0, F.element_at(corners, -1)).otherwise(F.get(corners, i - 1)), c))


def pieces(regions: DataFrame, id_col: str, corners_col: str) -> DataFrame:
    """region, pieces (each the normals of a convex polygon), cap (x, y, z, and rho: degrees from there to the furthest corner).

    corners_col: an array of (lat, lon), clockwise, of a convex polygon in less than a hemisphere, or of a quadrangle with one
    reflex corner, which is cut there into two triangles; one that is turned the other way, as of edges that cross, holds nothing.
    Regions of fewer than three corners, or with a null in one, are none.
    """
    given = regions.filter((F.size(corners_col) >= 3) & ~F.exists(corners_col, lambda c: c["lat"].isNull() | c["lon"].isNull()))
    df = given.select(F.col(id_col).alias("region"), F.transform(corners_col, lambda c: _vector(c["lat"], c["lon"])).alias("c"))
    at = lambda k: F.get("c", F.lit(k % 4))
    turn = lambda k: _dot(at(k - 1), _cross(at(k), at(k + 1)))
    reflex = F.when(F.size("c") == 4, F.coalesce(*(F.when(turn(k) >= TINY, F.lit(k % 4)) for k in (1, 2, 3, 4))))
    df = df.withColumn("k", reflex)
    turned = lambda step: F.get("c", (F.col("k") + step) % 4)
    halves = F.array(F.array(turned(0), turned(1), turned(2)), F.array(turned(0), turned(2), turned(3)))
    halves = F.filter(halves, lambda t: _dot(t[0], _cross(t[1], t[2])) < TINY)
    df = df.withColumn("parts", F.when(F.col("k").isNull(), F.array("c")).otherwise(halves))
    total = F.aggregate("c", F.struct(*(F.lit(0.0).alias(k) for k in "xyz")), lambda a, v: F.struct(*((a[k] + v[k]).alias(k) for k in "xyz")))
    df = df.withColumn("m", total)
    size = F.sqrt(_dot(F.col("m"), F.col("m")))
    df = df.withColumn("m", F.struct(*((F.col("m")[k] / size).alias(k) for k in "xyz")))
    far = F.degrees(F.array_max(F.transform("c", lambda v: F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), _dot(F.col("m"), v)))))))
    return df.select("region", F.transform("parts", _edges).alias("pieces"), F.struct("m.x", "m.y", "m.z", far.alias("rho")).alias("cap"))


def _columns(level: Column, row: Column) -> Column:
    """Columns of a row: cells as wide as high where the row is nearest to the equator."""
    edge = F.least(F.abs(row / F.pow(2.0, level) * 180 - 90), F.abs((row + 1) / F.pow(2.0, level) * 180 - 90))
    edge = F.when((row / F.pow(2.0, level) * 180 - 90) * ((row + 1) / F.pow(2.0, level) * 180 - 90) < 0, 0.0).otherwise(edge)
    return F.greatest(F.lit(1), F.ceil(F.pow(2.0, level + 1) * F.cos(F.radians(edge))))


def _row(level: Column, lat: Column) -> Column:
    return F.least(F.pow(2.0, level).cast("long") - 1, F.greatest(F.lit(0), F.floor((lat + 90) / 180 * F.pow(2.0, level))))


def _turns(lon: Column) -> Column:
    """Longitude as a part of a turn, from 0 up to 1."""
    return F.pmod(lon + 180, F.lit(360.0)) / 360


def _cell(level: Column, row: Column, col: Column) -> Column:
    return F.shiftleft(level.cast("long"), 56) + F.shiftleft(row.cast("long"), 28) + col.cast("long")


def _level() -> Column:
    """The level of a region's cells."""
    return F.greatest(F.lit(0), F.least(F.lit(LEVELS), F.floor(F.log2(180 * ACROSS / (2 * (F.col("cap.rho") + 1e-9)))))).cast("int")


def covering(found: DataFrame) -> DataFrame:
    """region, level, cell, whole (it lies in one piece) and pieces (null where it does) of the cells that regions (of pieces) meet; a
    cell may only just miss."""
    rho = F.col("cap.rho") + 1e-9
    df = found.withColumn("level", _level())
    lat, lon = F.degrees(F.asin(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.col("cap.z"))))), F.degrees(F.atan2("cap.y", "cap.x"))
    df = df.withColumns({"_lat": lat, "_lon": lon, "_row": F.explode(F.sequence(_row(F.col("level"), lat - rho), _row(F.col("level"), lat + rho)))})
    polar = F.abs("_lat") + rho >= 90
    half = F.when(polar, 180.0).otherwise(F.degrees(F.asin(F.least(F.lit(1.0), F.sin(F.radians(rho)) / F.cos(F.radians("_lat"))))) + 1e-9)
    df = df.withColumns({"_n": _columns(F.col("level"), F.col("_row")), "_half": half})
    first, last = (F.floor((F.col("_lon") + 180 + s * F.col("_half")) / 360 * F.col("_n")) for s in (-1, 1))
    df = df.withColumn("_col", F.explode(F.sequence(first, F.least(last, first + F.col("_n") - 1)))).withColumn("_col", F.pmod("_col", "_n"))
    high = 180 / F.pow(2.0, "level")
    mid_lat, mid_lon = (F.col("_row") + 0.5) * high - 90, (F.col("_col") + 0.5) / F.col("_n") * 360 - 180
    near = F.greatest(F.abs(mid_lat) - high / 2, F.lit(0.0))
    reach = F.radians(high / 2) + F.radians(180 / F.col("_n")) * F.cos(F.radians(near)) + 1e-12
    df = df.withColumns({"_mid": _vector(mid_lat, mid_lon), "_reach": reach})
    off = lambda n: _dot(F.col("_mid"), n) / F.greatest(F.sqrt(_dot(n, n)), F.lit(1e-300))
    whole = F.exists("pieces", lambda p: F.forall(p, lambda n: (off(n) < -F.col("_reach")) | (_dot(n, n) == 0)))
    some = F.exists("pieces", lambda p: F.forall(p, lambda n: off(n) <= F.col("_reach")))
    return df.filter(some).select("region", "level", _cell(F.col("level"), F.col("_row"), F.col("_col")).alias("cell"), whole.alias("whole"), F.when(~whole, F.col("pieces")).alias("pieces"))


def inside(position: Column, pieces_: Column) -> Column:
    """The exact test: whether a vector is on the right of, or on, all edges of one of the pieces."""
    return F.exists(pieces_, lambda p: F.forall(p, lambda n: _dot(position, n) < TINY))


def points_in_regions(points: DataFrame, regions: DataFrame, region: str = "region", corners: str = "corners", lat: str = "lat", lon: str = "lon") -> DataFrame:
    """points with ``region``: a row for each region that a point lies in, its border included; points in none are left out.

    Points with a null or an impossible position are in none; longitudes may be of any turn. Repeated points and regions
    (told apart by their ids) give a row each. A column of points that is named as ``region`` is replaced.

    Points and cells are shuffled once, by cell; border cells bring the edges along, so pairs are not shuffled again. A broadcast is no
    choice of the planner's: it takes all cells of the regions for as few bytes as the regions' numbers have.
    """
    n = int(regions.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    found = pieces(regions.repartition(n, region), region, corners)  # few bytes, and a hundred cells of each
    levels = sorted(r[0] for r in found.select(_level().alias("level")).distinct().collect())  # LEVELS + 1 at most
    points = points.drop(region)
    known = F.col(lat).between(-90, 90) & F.col(lon).isNotNull() & ~F.isnan(F.col(lon).cast("double"))
    level = F.explode(F.array(*map(F.lit, levels)).cast("array<int>"))
    placed = points.filter(known).select("*", level.alias("_level"))
    row = _row(F.col("_level"), F.col(lat))
    n = _columns(F.col("_level"), row)
    placed = placed.withColumn("_cell", _cell(F.col("_level"), row, F.least(n - 1, F.floor(_turns(F.col(lon)) * n))))
    cells = covering(found).select(F.col("cell").alias("_cell"), F.col("region").alias("_region"), "whole", "pieces")
    met = placed.hint("merge").join(cells, "_cell")
    exact = met.filter(F.col("whole") | inside(_vector(F.col(lat), F.col(lon)), F.col("pieces")))
    return exact.select(*points.columns, F.col("_region").alias(region))
