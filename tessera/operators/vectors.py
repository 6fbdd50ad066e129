"""Segments (coastlines and the like): a table of points (seg, pos, lat, lon), and one of the segments' bounds.

Stored segments hold their first point and the steps from point to point in units of 2^-10 degrees.
"""

from __future__ import annotations

import math

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ..functions.geodesy import RADIUS_KM
from ..functions.scalar import normal_lon
from ..plans.definitions import GridDef, MapDef
from .cells import rounded
from .chains import chain
from .folds import folded
from .transform import only, with_place, with_uv, within

UNIT = 1024.0
ORDERS = {"lat_max": ("lat_max", False), "lon_max": ("lon_max", False), "lat_min": ("lat_min", True), "lon_min": ("lon_min", True), "id": ("seg", True)}


def by_segment() -> Window:
    return Window.partitionBy("seg").orderBy("pos")


def decode(deltas: DataFrame) -> DataFrame:
    """seg, pos, lat, lon from seg, pos, lat0, lon0 (units) and dlat, dlon (units; 0 for the first point)."""
    run = by_segment().rowsBetween(Window.unboundedPreceding, Window.currentRow)
    place = lambda c: ((F.col(f"{c}0") + F.sum(f"d{c}").over(run)) / UNIT).alias(c)
    return deltas.select("seg", "pos", place("lat"), place("lon"))


def encode(points: DataFrame) -> DataFrame:
    """The deltas of points: what decode reads. Positions are rounded to units before they are subtracted."""
    units = points.withColumns({"ilat": rounded(F.col("lat") * UNIT), "ilon": rounded(F.greatest(F.lit(-180.0), F.least(F.lit(180.0), F.col("lon"))) * UNIT)})
    w, first = by_segment(), by_segment().rowsBetween(Window.unboundedPreceding, Window.currentRow)
    step = lambda c: (F.col(c) - F.coalesce(F.lag(c).over(w), F.col(c)))
    return units.select("seg", "pos", F.first("ilat").over(first).alias("lat0"), F.first("ilon").over(first).alias("lon0"), step("ilat").alias("dlat"), step("ilon").alias("dlon"))


def bounds(points: DataFrame) -> DataFrame:
    """The index: seg, number of points and bounds."""
    return points.groupBy("seg").agg(F.count("*").alias("n"), F.min("lat").alias("lat_min"), F.max("lat").alias("lat_max"), F.min("lon").alias("lon_min"), F.max("lon").alias("lon_max"))


def extents(index: DataFrame) -> DataFrame:
    """The largest height and width of a segment."""
    return index.agg(F.max(F.col("lat_max") - F.col("lat_min")).alias("lat_extent"), F.max(F.col("lon_max") - F.col("lon_min")).alias("lon_extent"))


def sort_index(index: DataFrame, order: str = "lon_min") -> DataFrame:
    name, up = ORDERS[order]
    return index.orderBy(F.col(name).asc() if up else F.col(name).desc(), "seg")


def overlaps(south: float, north: float, west: float, east: float) -> Column:
    """Whether a segment's bounds meet a box, which may straddle the date line."""
    lat = (F.col("lat_max") >= south) & (F.col("lat_min") <= north)
    if west <= east:
        return lat & (F.col("lon_max") >= west) & (F.col("lon_min") <= east)
    return lat & ((F.col("lon_max") >= west) | (F.col("lon_min") <= east))


def scan(index: DataFrame, start: float, stop: float, order: str = "lon_min", extent: float = 0.0) -> DataFrame:
    """Segments whose key lies in [start - extent, stop], in order: a range filter that Parquet prunes by. A range of
    longitudes over the date line (start above stop) is two."""
    name, up = ORDERS[order]
    key = F.col(name)
    if order.startswith("lon") and start > stop:
        hit = (key >= start - extent) | (key <= stop)
    elif up:
        hit = key.between(start - extent, stop)
    else:
        hit = key.between(start, stop + extent)
    return sort_index(index.filter(hit), order)


def strokes(points: DataFrame, g: GridDef, style: int = 1) -> DataFrame:
    """seg, pos, style, x1, y1, x2, y2: lines between neighbours whose second point is on the grid and in the map.

    The pen moves with every point that projects, drawn or not.
    """
    on = with_place(points, g, "lat", "lon", ("_c", "_r", "on_grid"))
    placed = with_uv(on, g.map, "lat", "lon", ("x", "y")).withColumns({"_in": F.col("on_grid") & within(g.map, F.col("lat"), F.col("lon")), "_is": F.col("x").isNotNull()})
    w = by_segment()
    lines = only(placed, "_is", ["x", "y", "_in"]).withColumns({"x1": F.lag("x").over(w), "y1": F.lag("y").over(w)})
    return lines.filter("_in and x1 is not null").select("seg", "pos", F.lit(style).alias("style"), "x1", "y1", F.col("x").alias("x2"), F.col("y").alias("y2"))


def clip(points: list[DataFrame], south: float, north: float, west: float, east: float) -> DataFrame:
    """Segments of several tables whose bounds meet the box, whole; ``source`` numbers their tables."""
    out = None
    for k, p in enumerate(points):
        keep = bounds(p).filter(overlaps(south, north, west, east)).select("seg")
        one = p.join(keep, "seg").withColumn("source", F.lit(k))
        out = one if out is None else out.unionByName(one)
    return out


def reverse(points: DataFrame) -> DataFrame:
    """Points of each segment from its end to its start."""
    return points.withColumn("pos", F.max("pos").over(Window.partitionBy("seg")) - F.col("pos"))


def split_at_date_line(points: DataFrame) -> DataFrame:
    """Segments cut where they cross 180 degrees, with interpolated points at both ends of the cut: seg, part, pos, lat, lon. One shuffle
    and one sort of the points: places in a part are counted from the row in which it begins."""
    w = by_segment()
    run = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    p = points.select("seg", "pos", "lat", "lon").withColumns({"_plat": F.lag("lat").over(w), "_plon": F.lag("lon").over(w), "_n": F.row_number().over(w)})
    p = p.withColumn("_cut", F.coalesce((F.abs(F.col("lon") - F.col("_plon")) > 180).cast("int"), F.lit(0)))
    p = p.withColumns({"part": F.sum("_cut").over(run), "_begin": F.max(F.when(F.col("_cut") == 1, F.col("_n"))).over(run)})
    p = p.withColumn("_own", F.coalesce(F.col("_n") - F.col("_begin") + 1, F.col("_n") - 1)).withColumn("_last", F.lag("_own").over(w))
    side = F.when(F.col("_plon") > 0, 180.0).otherwise(-180.0)
    f = F.try_divide(side - F.col("_plon"), F.col("lon") + 2 * side - F.col("_plon"))
    lat = F.col("_plat") + f * (F.col("lat") - F.col("_plat"))
    row = lambda part, pos, lat, lon: F.struct(part.alias("part"), pos.cast("int").alias("pos"), lat.alias("lat"), lon.alias("lon"))
    own = row(F.col("part"), F.col("_own"), F.col("lat"), F.col("lon"))
    ends = row(F.col("part") - 1, F.col("_last") + 1, lat, side), row(F.col("part"), F.lit(0), lat, -side)
    return p.select("seg", F.explode(F.when(F.col("_cut") == 1, F.array(*ends, own)).otherwise(F.array(own))).alias("_p")).select("seg", "_p.*")


def every_nth(points: DataFrame, n: int, least: int = 10) -> DataFrame:
    """Every nth point of segments with more than ``least`` points, and their last."""
    size, last = F.count("*").over(Window.partitionBy("seg")), F.max("pos").over(Window.partitionBy("seg"))
    return points.withColumns({"_n": size, "_last": last}).filter((F.col("_n") <= least) | (F.col("pos") % n == 0) | (F.col("pos") == F.col("_last"))).drop("_n", "_last")


def prepare(points: DataFrame, ranks: list[int] | None = None, box: tuple[float, float, float, float] | None = None, nth: int = 1) -> DataFrame:
    """An import of raw segments (seg, pos, lat, lon, rank): those of the ranks whose bounds meet the box (south, north,
    west, east), every nth point of them, cut at the date line. seg, part, pos, lat, lon."""
    points = points if ranks is None else points.filter(F.col("rank").isin(ranks))
    points = points.select("seg", "pos", "lat", "lon")
    points = points if box is None else clip([points], *box).drop("source")
    return split_at_date_line(every_nth(points, nth) if nth > 1 else points)


def _around(lat0: float, lon0: float, lat: float, lon: float) -> tuple[float, float]:
    """x, y in km on an equal-area map around (lat0, lon0)."""
    p0, p, dl = math.radians(lat0), math.radians(lat), math.radians(lon - lon0)
    c = math.sin(p0) * math.sin(p) + math.cos(p0) * math.cos(p) * math.cos(dl)
    k = RADIUS_KM * math.sqrt(2 / (1 + c)) if c > -1 else math.inf
    return k * math.cos(p) * math.sin(dl), k * (math.cos(p0) * math.sin(p) - math.sin(p0) * math.cos(p) * math.cos(dl))


def _off(lat0: float, lon0: float, lat: float, lon: float, lat2: float, lon2: float, unit: float) -> bool:
    """Whether a point is off the line from the last kept point to the next point by a unit, or by half of one if it lies two
    units away, measured on a map around the last kept point."""
    x, y = _around(lat0, lon0, lat, lon)
    nx, ny = _around(lat0, lon0, lat2, lon2)
    long = math.hypot(nx, ny)
    off = abs(x * ny - y * nx) / long if long else 0.0
    return off >= unit or (math.hypot(x, y) >= 2 * unit and off > unit / 2)


class Thinning:
    """A fold over points of segments: the ends stay, and the points that are off the line. The state is the last kept point,
    and one point that waits for the next to be judged by."""

    def __init__(self, unit: float, kind: pa.DataType):
        self.unit, self.kind = unit, kind
        self.seg, self.kept, self.waits, self.pos = None, None, None, 0

    def _keep(self, out: list, point: tuple) -> None:
        out.append((self.seg, self.pos, *point))
        self.kept, self.pos = point, self.pos + 1

    def _made(self, out: list) -> pa.RecordBatch:
        kinds = (self.kind, pa.int32(), pa.float64(), pa.float64())
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate(kinds)], ["seg", "pos", "lat", "lon"])

    def rows(self, batch, new):
        out: list = []
        for seg, lat, lon, first in zip(*(batch.column(c).to_pylist() for c in ("seg", "lat", "lon")), new.tolist(), strict=True):
            point = (lat, lon)
            if first:
                if self.waits:
                    self._keep(out, self.waits)
                self.seg, self.pos, self.waits = seg, 0, None
                self._keep(out, point)
            else:
                if self.waits and _off(*self.kept, *self.waits, *point, self.unit):
                    self._keep(out, self.waits)
                self.waits = point
        return self._made(out)

    def end(self):
        out: list = []
        if self.waits:
            self._keep(out, self.waits)
        return self._made(out)


def thin(points: DataFrame, km: float) -> DataFrame:
    """Segments simplified to a tolerance: seg, pos (from 0), lat, lon; below 0.09 km they stay as they are. Points are streamed in
    order, so a segment of any length passes in constant memory; it is one task's, as each point depends on the one kept."""
    if km < 0.09:
        return points
    kind = points.schema["seg"].dataType
    return folded(points.select("seg", "pos", "lat", "lon"), ["seg"], ["pos", "lat", "lon"], lambda: Thinning(km / 3, to_arrow_type(kind)), f"seg {kind.simpleString()}, pos int, lat double, lon double")


def join_ends(points: DataFrame, km: float) -> DataFrame:
    """Segments chained where their ends lie within ``km``: seg (of the chain's first segment), pos, lat, lon, from_seg.

    Greedy, in the order of seg (whole numbers): see chains.chain.
    """
    return chain(points, km)


def graticules(sheets: DataFrame, id_col: str, step: float = 1.0) -> DataFrame:
    """Points of parallels and meridians of each sheet (id_col, south, north, west, east, lat_interval, lon_interval; east may be
    over 180): id_col, seg, pos, lat, lon, each ``step`` degrees apart. Nothing comes of a sheet with a null."""

    def lines(kind: str, low: str, high: str, every: str, begin: str, end: str, fixed: str, moving: str) -> DataFrame:
        known = sheets.dropna(subset=[low, high, every, begin, end])
        count = F.floor((F.col(high) - F.col(low)) / F.col(every)).cast("int")
        ids = known.withColumn("_k", F.explode(F.sequence(F.lit(0), count)))
        each = ids.withColumn("pos", F.explode(F.sequence(F.lit(0), F.floor((F.col(end) - F.col(begin)) / step).cast("int"))))
        each = each.withColumns({fixed: F.col(low) + F.col("_k") * F.col(every), moving: F.col(begin) + F.col("pos") * step, "seg": F.concat(F.lit(kind), F.col("_k").cast("string"))})
        return each.select(id_col, "seg", "pos", F.col("lat").cast("double").alias("lat"), normal_lon(F.col("lon").cast("double")).alias("lon"))

    return lines("lat", "south", "north", "lat_interval", "west", "east", "lat", "lon").unionByName(lines("lon", "west", "east", "lon_interval", "south", "north", "lon", "lat"))


def graticule(spark: SparkSession, m: MapDef, step: float = 1.0) -> DataFrame:
    """The graticule of a map at its intervals: seg, pos, lat, lon."""
    row = (m.south, m.north, m.west, m.east + (360 if m.straddles else 0), m.lat_interval, m.lon_interval)
    sheet = spark.createDataFrame([tuple(map(float, row))], "south double, north double, west double, east double, lat_interval double, lon_interval double")
    return graticules(sheet.withColumn("_sheet", F.lit(0)), "_sheet", step).drop("_sheet")
