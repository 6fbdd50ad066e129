"""Registered queries and, where SQL can express them, their DuckDB SQL.

The tables hold no positions: points are made of the keys of lineitem by whole-number arithmetic, which any engine does
alike, and results are rounded to whole numbers of a small unit, because sines differ in the last bit between engines.
"""

from __future__ import annotations

import math
from fractions import Fraction
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import geodesy
from .functions.projections import forward_xy, inverse_xy
from .functions.scalar import Ctes, Sql, Steps, both, finite, where
from .operators import accuracy, cells, extract, gridding, models, regions, resample, vectors
from .operators import transform as T
from .plans.definitions import GridDef, MapDef
from .plans.state import new_folder
from .sources import cells as stroke_files
from .sources import points as point_files
from .sources import raster as raster_files
from .sources import segments as segment_files
from .sources.parts import joined

QUERIES: dict = {}
SQL: dict[str, str] = {}

KEY = ["l_orderkey", "l_linenumber"]
#: What tells lines apart: orders repeat line numbers.
ROW = [*KEY, "l_partkey", "l_suppkey"]
POINTS = """(SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(l_quantity AS DOUBLE) AS v,
 CAST((l_orderkey * 7919 + l_linenumber * 104729) % 179000 AS DOUBLE) / 1000e0 - 89.4863e0 AS lat,
 CAST((l_partkey * 7907 + l_suppkey * 611953) % 359000 AS DOUBLE) / 1000e0 - 179.4863e0 AS lon FROM lineitem)"""

#: A definition for each projection; regional ones have bounds.
MAPS = {
    "azimuthal_equal_area": MapDef("Azimuthal Equal-Area", lat0=52, lon0=10, south=-60),
    "azimuthal_equal_area_polar": MapDef("Azimuthal Equal-Area", lat0=90, lon0=0, south=0),
    "azimuthal_equal_area_ellipsoid": MapDef("Azimuthal Equal-Area Ellipsoid", lat0=-40, lon0=100, south=-89, north=40),
    "cylindrical_equal_area": MapDef("Cylindrical Equal-Area", lat0=0, lon0=0, lat1=30, scale=25.0675),
    "cylindrical_equal_area_ellipsoid": MapDef("Cylindrical Equal-Area Ellipsoid", lat0=0, lon0=-70, lat1=30),
    "cylindrical_equidistant": MapDef("Cylindrical Equidistant", lat0=0, lon0=20, lat1=40),
    "mercator": MapDef("Mercator", lat0=0, lon0=-30, south=-85, north=85),
    "mollweide": MapDef("Mollweide", lat0=0, lon0=15),
    "orthographic": MapDef("Orthographic", lat0=35, lon0=-100),
    "polar_stereographic": MapDef("Polar Stereographic", lat0=90, lon0=-45, lat1=70, south=20),
    "polar_stereographic_ellipsoid": MapDef("Polar Stereographic Ellipsoid", lat0=-90, lon0=0, lat1=-70, north=-20, equatorial_radius=6378.273, eccentricity=0.081816153),
    "sinusoidal": MapDef("Sinusoidal", lat0=0, lon0=60),
    "lambert_conic_conformal_ellipsoid": MapDef("Lambert Conic Conformal Ellipsoid", lat0=33, lat1=45, lon0=-96, center_lat=23, center_lon=-96, south=-20, north=85, west=-170, east=-20),
    "interrupted_homolosine": MapDef("Goode Homolosine", lat0=0, lon0=0),
    "albers_conic_equal_area": MapDef("Albers Conic Equal-Area", lat0=29.5, lat1=45.5, lon0=-96, center_lat=23, center_lon=-96),
    "albers_conic_equal_area_ellipsoid": MapDef("Albers Conic Equal-Area Ellipsoid", lat0=-45.5, lat1=-29.5, lon0=96, center_lat=-23, center_lon=96, south=-85, north=60),
    "integerized_sinusoidal": MapDef("Integerized Sinusoidal"),
    "transverse_mercator": MapDef("Transverse Mercator", lat0=0, lon0=-75, center_scale=0.9996),
    "transverse_mercator_ellipsoid": MapDef("Transverse Mercator Ellipsoid", lat0=0, lon0=-75, center_scale=0.9996, west=-90, east=-60),
    "universal_transverse_mercator": MapDef("UTM", utm_zone=18, west=-90, east=-60),
}
WORLD = GridDef(MapDef("Cylindrical Equal-Area", lat0=0, lon0=0, lat1=30, scale=25.0675), 346, 147, 0.25, None, 172.5, 73.0)
NORTH = GridDef(MapDef("Azimuthal Equal-Area", lat0=90, lon0=0, scale=200.5402, south=0), 91, 91, 1.0, None, 45.0, 45.0)
COARSE = GridDef(MapDef("Azimuthal Equal-Area", lat0=90, lon0=0, scale=200.5402, south=0), 30, 30, 1 / 3, None, 14.5, 14.5)
TURNED = MapDef("Polar Stereographic", lat0=90, lon0=-45, lat1=70, rotation=30, scale=10, south=20)


def query(name: str, sql: str | None = None):
    def put(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return put


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    c = F.col
    lat = ((c("l_orderkey") * 7919 + c("l_linenumber") * 104729) % 179000).cast("double") / 1000.0 - 89.4863
    lon = ((c("l_partkey") * 7907 + c("l_suppkey") * 611953) % 359000).cast("double") / 1000.0 - 179.4863
    return t.select(*KEY, "l_partkey", "l_suppkey", c("l_quantity").cast("double").alias("v"), lat.alias("lat"), lon.alias("lon"))


def q(c: Column, unit: float = 1e-6) -> Column:
    return F.floor(c * (1 / unit) + 0.5).cast("bigint")


def qs(c, unit: float = 1e-6) -> str:
    c = c.sql if isinstance(c, Sql) else c
    return f"CAST(floor(({c}) * {1 / unit!r} + 0.5e0) AS BIGINT)"


def unit_of(m: MapDef) -> float:
    return 1e-6 if m.Rg < 1e5 else 1e-3


def _projection_queries(name: str, m: MapDef) -> None:
    unit = unit_of(m)

    def forward(spark, sf_dir):
        s = Steps(T.filter_within(points(spark, sf_dir), m))
        x, y = forward_xy(m.math, s, F.col("lat"), F.col("lon"))
        return s.df.select(*KEY, q(x, unit).alias("x"), q(y, unit).alias("y"))

    def inverse(spark, sf_dir):
        s = Steps(T.filter_within(points(spark, sf_dir), m))
        x, y = forward_xy(m.math, s, F.col("lat"), F.col("lon"))
        x, y = s.let(F.floor(x / unit + 0.5) * unit), s.let(F.floor(y / unit + 0.5) * unit)
        lat, lon = inverse_xy(m.math, s, x, y)
        return s.df.select(*KEY, q(lat).alias("lat_q"), q(lon).alias("lon_q"))

    def start() -> Ctes:
        s = Ctes("p")
        s.ctes.append(f"p AS (SELECT * FROM {POINTS} WHERE {T.within(m, Sql('lat'), Sql('lon')).sql})")
        return s

    s = start()
    x, y = forward_xy(m.math, s, Sql("lat"), Sql("lon"))
    query(f"forward_{name}", s.query(f"l_orderkey, l_linenumber, {qs(x, unit)} AS x, {qs(y, unit)} AS y"))(forward)
    s = start()
    x, y = forward_xy(m.math, s, Sql("lat"), Sql("lon"))
    whole = lambda v: s.let(Sql(f"(floor({v.sql} / {unit!r} + 0.5e0) * {unit!r})"))
    lat, lon = inverse_xy(m.math, s, whole(x), whole(y))
    query(f"inverse_{name}", s.query(f"l_orderkey, l_linenumber, {qs(lat)} AS lat_q, {qs(lon)} AS lon_q"))(inverse)


for _name, _map in MAPS.items():
    _projection_queries(_name, _map)


def _over_points(name: str, formula, names: list[str], unit: float = 1e-6, m: MapDef | None = None, whole: bool = False) -> None:
    """A query of a formula of (steps, lat, lon, lat2, lon2) over points; lat2, lon2 is another place for each point."""
    other = ("((l_orderkey * 31 + l_linenumber * 7) % 170) - 84.7", "((l_orderkey * 17 + l_linenumber * 13) % 350) - 174.6")

    def spark_query(spark, sf_dir):
        df = points(spark, sf_dir)
        df = T.filter_within(df, m) if m else df
        df = df.withColumns({f"{k}2": F.expr(f"CAST({e.rsplit(' - ', 1)[0]} AS DOUBLE) - {float(e.rsplit(' - ', 1)[1])!r}D") for k, e in zip(("lat", "lon"), other, strict=True)})
        s = Steps(df)
        out = formula(s, *(F.col(c) for c in ("lat", "lon", "lat2", "lon2")))
        out = [s.let(v) for v in (out if isinstance(out, tuple) else (out,))]
        return s.df.select(*KEY, *((F.coalesce(v, F.lit(False)) if whole else q(v, unit)).alias(n) for v, n in zip(out, names, strict=True)))

    s = Ctes("p")
    at = f" WHERE {T.within(m, Sql('lat'), Sql('lon')).sql}" if m else ""
    cols = ", ".join(f"CAST({e.rsplit(' - ', 1)[0]} AS DOUBLE) - {float(e.rsplit(' - ', 1)[1])!r}e0 AS {k}2" for k, e in zip(("lat", "lon"), other, strict=True))
    s.ctes.append(f"p AS (SELECT *, {cols} FROM {POINTS}{at})")
    out = formula(s, *map(Sql, ("lat", "lon", "lat2", "lon2")))
    out = [s.let(v) for v in (out if isinstance(out, tuple) else (out,))]
    query(name, s.query("l_orderkey, l_linenumber, " + ", ".join((f"coalesce({v.sql}, FALSE)" if whole else qs(v, unit)) + f" AS {n}" for v, n in zip(out, names, strict=True))))(spark_query)


DATE_LINE = MapDef("Cylindrical Equidistant", lat0=0, lon0=180, west=150, east=-150, south=-50, north=50)
BOX = [(40.0, -20.0), (45.0, 60.0), (-35.0, 50.0), (10.0, 5.0)]
_over_points("map_uv", lambda s, a, b, c, d: T.map_uv(TURNED, s, a, b), ["u", "w"], m=TURNED)
_over_points("map_uv_inverse", lambda s, a, b, c, d: T.geo_of_uv(TURNED, s, a * 10.0, b * 5.0), ["lat_q", "lon_q"])
_over_points("within_map", lambda s, a, b, c, d: T.within(DATE_LINE, a, b), ["inside"], whole=True)
_over_points("max_error", lambda s, a, b, c, d: T.map_xy(MAPS["universal_transverse_mercator"], s, a, b), ["x", "y"], unit=1e-3, m=MapDef("UTM", utm_zone=18, west=-120, east=-30))
_over_points("grid_forward", lambda s, a, b, c, d: T.grid_place(NORTH, s, a, b)[:2], ["gc", "gr"], m=NORTH.map)
_over_points("grid_inverse", lambda s, a, b, c, d: (lambda lat, lon, ok: (where(ok, lat, None), where(ok, lon, None)))(*T.geo_of_place(NORTH, s, (b + 180.0) / 4.0, (a + 90.0) / 2.0)), ["lat_q", "lon_q"])
_over_points("ellipsoid_distance", lambda s, a, b, c, d: T.ellipsoid_distance(MAPS["transverse_mercator_ellipsoid"], s, a, b, c, d), ["dist"], unit=1e-3)
_over_points("flat_distance", lambda s, a, b, c, d: T.flat_distance(a, b, c, d), ["dist"])
_over_points("arc_length", lambda s, a, b, c, d: geodesy.arc_length(s, a, b, c, d), ["km"], unit=1e-3)
_over_points("west_azimuth", lambda s, a, b, c, d: geodesy.west_azimuth(s, a, b, c, d), ["azimuth"])
_over_points("bisect", lambda s, a, b, c, d: geodesy.bisect(s, a, b, c, d), ["lat_q", "lon_q"])
_over_points("rectangular", lambda s, a, b, c, d: geodesy.rectangular(s, a, b, 6378.137**2, 6356.752**2), ["x", "y", "z"], unit=1e-3)
_over_points("within_box", lambda s, a, b, c, d: geodesy.within_box(s, a, b, BOX), ["inside"], whole=True)


@query("lat_lon_text", f"SELECT l_orderkey, l_linenumber, {qs('lat')} AS lat_q, {qs('lon')} AS lon_q FROM {POINTS}")
def lat_lon_text(spark, sf_dir):
    """Positions written as text in one of three ways and read again."""
    p = points(spark, sf_dir)
    side = lambda c, plus, minus: F.when(F.col(c) < 0, minus).otherwise(plus)
    signed = F.format_string("%.4f %.4f", "lat", "lon")
    lettered = F.format_string("%.4f %s %.4f %s", F.abs("lat"), side("lat", "N", "S"), F.abs("lon"), side("lon", "E", "W"))
    text = F.when(F.col("l_linenumber") % 2 == 0, signed).otherwise(lettered)
    return p.withColumn("g", geodesy.lat_lon_of_text(text)).select(*KEY, q(F.col("g.lat")).alias("lat_q"), q(F.col("g.lon")).alias("lon_q"))


# --- rasters --------------------------------------------------------------------------------------------------------


#: Lines that a raster of the world is made of for each of its cells, about; grids are cut finer as the table grows.
LINES = 60_000
ZOOM = "(SELECT z FROM zoom)"
ZOOM_SQL = f"zoom AS (SELECT greatest(1, CAST(ceil(sqrt(count(*) / {LINES}e0)) AS INTEGER)) AS z FROM lineitem)"


def grown(spark: SparkSession, sf_dir: str, *grids: GridDef) -> list[GridDef]:
    """The grids, cut as finely as the number of lines calls for."""
    n = spark.read.parquet(f"{sf_dir}/lineitem.parquet").count()
    z = max(1, math.ceil(math.sqrt(n / LINES)))
    return [g.zoom(z) for g in grids]


def raster(spark: SparkSession, sf_dir: str, g: GridDef) -> DataFrame:
    """Lines summed by cell; cells whose value is 0 are fill, and those without a line are missing."""
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    at = {"row": (F.col("l_orderkey") * 31 + F.col("l_linenumber") * 7) % g.rows, "col": (F.col("l_partkey") * 17 + F.col("l_suppkey") * 5) % g.cols}
    return lines.groupBy(*(c.cast("int").alias(k) for k, c in at.items())).agg((F.sum(F.col("l_linenumber") * 37 + F.col("l_suppkey")) % 251).cast("double").alias("value"))


def cells_sql(g: GridDef) -> str:
    """i, j of all cells of the grid as it is cut."""
    wide = f"({g.cols} * {ZOOM})"
    return f"(SELECT CAST(id // {wide} AS INTEGER) AS i, CAST(id % {wide} AS INTEGER) AS j FROM (SELECT unnest(range({g.n_cells} * {ZOOM} * {ZOOM})) AS id))"


def raster_sql(g: GridDef) -> str:
    """i, j, v of the raster's cells."""
    return f"(SELECT CAST((l_orderkey * 31 + l_linenumber * 7) % ({g.rows} * {ZOOM}) AS INTEGER) AS i, CAST((l_partkey * 17 + l_suppkey * 5) % ({g.cols} * {ZOOM}) AS INTEGER) AS j, CAST(sum(l_linenumber * 37 + l_suppkey) % 251 AS DOUBLE) AS v FROM lineitem GROUP BY ALL)"


def coarse(c: str) -> str:
    """A place on the grid before it was cut, and back."""
    return f"(({c} + 0.5e0) / {ZOOM} - 0.5e0)"


def fine(c) -> str:
    return f"(({c.sql} + 0.5e0) * {ZOOM} - 0.5e0)"


def looked_sql(source: GridDef, target: GridDef, both_maps: bool = False, rows: str | None = None) -> list[str]:
    """CTEs from target cells (i, j, and what else rows has) to seen(i, j, r, s): the places on the source that they look at."""
    s = Ctes("c0", [ZOOM_SQL, f"c0 AS (SELECT *, {coarse('CAST(i AS DOUBLE)')} AS fi, {coarse('CAST(j AS DOUBLE)')} AS fj FROM {rows or cells_sql(target)})"])
    lat, lon, ok = T.geo_of_place(target, s, Sql("fj"), Sql("fi"))
    if both_maps:
        ok = s.let(both(ok, T.within(source.map, lat, lon)))
    r, t, on = T.grid_place(source, s, lat, lon)
    s.ctes.append(f"seen AS (SELECT i, j, {'v, ' if rows else ''}{fine(r)} AS r, {fine(t)} AS s FROM {s.last} WHERE {ok.sql} AND {on.sql})")
    return s.ctes


TRUNC = "CAST(trunc({}) AS INTEGER)"
RASTER_SQL = f"src AS (SELECT i AS si, j AS sj, v AS sv FROM {raster_sql(WORLD)} WHERE v <> 0)"


def stencil_sql(low: int, high: int, weight: str, agg: str, extra: str = "") -> str:
    """Weighted sums over the samples around seen places: num, w and n by i, j."""
    ctes = [*looked_sql(WORLD, NORTH, extra == "both"), RASTER_SQL]
    ctes.append(f"around AS (SELECT seen.i, seen.j, r, s, dr, dc, {TRUNC.format('s')} + dr AS si, {TRUNC.format('r')} + dc AS sj FROM seen, (SELECT CAST(a AS INTEGER) AS dr FROM range({low}, {high + 1}) x(a)) CROSS JOIN (SELECT CAST(b AS INTEGER) AS dc FROM range({low}, {high + 1}) y(b)))")
    ctes.append(f"each AS (SELECT i, j, si, sj, sv, {weight} AS w FROM around JOIN src USING (si, sj))")
    ctes.append("sums AS (SELECT i, j, sum(w * sv ORDER BY si, sj) AS num, sum(w ORDER BY si, sj) AS w, count(*) AS n FROM each GROUP BY i, j)")
    return "WITH " + ",\n".join(ctes) + f"\n{agg}"


LINEAR_W = "(1e0 - abs(si - s)) * (1e0 - abs(sj - r))"


def cubic_sql(d: str, k: str) -> str:
    return f"(CASE {k} WHEN -1 THEN -{d}*(1e0-{d})*(1e0-{d}) WHEN 0 THEN 1e0-2e0*{d}*{d}+{d}*{d}*{d} WHEN 1 THEN {d}*(1e0+{d}-{d}*{d}) ELSE -{d}*{d}*(1e0-{d}) END)"


CUBIC_W = cubic_sql("(s - trunc(s))", "dr") + " * " + cubic_sql("(r - trunc(r))", "dc")
MEAN_SQL = f"SELECT i AS cell_row, j AS cell_col, {qs('num / w', 1e-4)} AS value FROM sums WHERE w <> 0"
SENT = [*looked_sql(NORTH, WORLD, rows=raster_sql(WORLD)), f"dealt AS (SELECT i, j, v, r, s, {TRUNC.format('s + 0.5e0')} AS ti, {TRUNC.format('r + 0.5e0')} AS tj FROM seen WHERE v <> 0)"]
SENT_BOTH = [*looked_sql(NORTH, WORLD, True, raster_sql(WORLD)), f"dealt AS (SELECT i, j, v, r, s, {TRUNC.format('s + 0.5e0')} AS ti, {TRUNC.format('r + 0.5e0')} AS tj FROM seen WHERE v <> 0)"]


def with_sql(ctes: list[str], tail: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n" + tail


def out(df: DataFrame, unit: float = 1e-4) -> DataFrame:
    return df.filter("value is not null").select(F.col("row").alias("cell_row"), F.col("col").alias("cell_col"), q(F.col("value"), unit).alias("value"))


def _regrid(method: str, sql: str) -> None:
    def run(spark, sf_dir):
        world, north = grown(spark, sf_dir, WORLD, NORTH)
        return out(resample.regrid(raster(spark, sf_dir, world), world, north, method, fill=0.0, kernel=(2, 2), whole=False))

    query(f"regrid_{method}", sql)(run)


NEAR_SQL = f"near AS (SELECT seen.i, seen.j, sv FROM seen JOIN src ON si = {TRUNC.format('s + 0.5e0')} AND sj = {TRUNC.format('r + 0.5e0')})"
_regrid("nearest", with_sql([*looked_sql(WORLD, NORTH), RASTER_SQL, NEAR_SQL], f"SELECT i AS cell_row, j AS cell_col, {qs('sv', 1e-4)} AS value FROM near"))
_regrid("bilinear", stencil_sql(0, 1, LINEAR_W, MEAN_SQL))
_regrid("cubic", stencil_sql(-1, 2, CUBIC_W, MEAN_SQL))
_regrid("bucket", with_sql(SENT, f"SELECT ti AS cell_row, tj AS cell_col, {qs('avg(v)', 1e-4)} AS value FROM dealt WHERE ti BETWEEN 0 AND 91 * {ZOOM} - 1 AND tj BETWEEN 0 AND 91 * {ZOOM} - 1 GROUP BY ti, tj"))
_regrid("max", with_sql(SENT, f"SELECT ti AS cell_row, tj AS cell_col, {qs('max(v)', 1e-4)} AS value FROM dealt WHERE ti BETWEEN 0 AND 91 * {ZOOM} - 1 AND tj BETWEEN 0 AND 91 * {ZOOM} - 1 GROUP BY ti, tj HAVING max(v) > 0"))
_KERNEL = [
    *SENT_BOTH,
    f"k1 AS (SELECT *, unnest(range({TRUNC.format('s - 1 + 0.5e0')}, {TRUNC.format('s + 1 + 0.5e0')} + 1)) AS ki FROM dealt)",
    f"k2 AS (SELECT *, unnest(range({TRUNC.format('r - 1 + 0.5e0')}, {TRUNC.format('r + 1 + 0.5e0')} + 1)) AS kj FROM k1)",
    f"k3 AS (SELECT ki, kj, v, pow((r - kj) * (r - kj) + (s - ki) * (s - ki), 1e0) AS d FROM k2 WHERE ki BETWEEN 0 AND 91 * {ZOOM} - 1 AND kj BETWEEN 0 AND 91 * {ZOOM} - 1)",
    "k4 AS (SELECT ki, kj, v, CASE WHEN d > 0 THEN 1e0 / d ELSE 9e9 END AS w FROM k3)",
]
_regrid("idw", with_sql(_KERNEL, f"SELECT CAST(ki AS INTEGER) AS cell_row, CAST(kj AS INTEGER) AS cell_col, {qs('sum(w * v) / sum(w)', 1e-4)} AS value FROM k4 GROUP BY ki, kj"))


@query("regrid_merge", with_sql(SENT, f"SELECT ti AS cell_row, tj AS cell_col, {qs('avg(v)', 1e-4)} AS value FROM dealt WHERE ti BETWEEN 0 AND 91 * {ZOOM} - 1 AND tj BETWEEN 0 AND 91 * {ZOOM} - 1 GROUP BY ti, tj"))
def regrid_merge(spark, sf_dir):
    """Two halves of the raster's cells: the state of one is saved and the other is added."""
    world, north = grown(spark, sf_dir, WORLD, NORTH)
    odd, even = (raster(spark, sf_dir, world).filter((F.col("row") + F.col("col")) % 2 == k) for k in (1, 0))
    state = resample.regrid_state(odd, world, north, "bucket", fill=0.0)
    return out(resample.regrid(even, world, north, "bucket", fill=0.0, before=state, whole=False))


_DISTANCE = f"sqrt(({TRUNC.format('r + 0.5e0')} - r) * ({TRUNC.format('r + 0.5e0')} - r) + ({TRUNC.format('s + 0.5e0')} - s) * ({TRUNC.format('s + 0.5e0')} - s))"

@query(
    "regrid_merge_nearest",
    with_sql(
        [
            *looked_sql(WORLD, NORTH), RASTER_SQL, f"near AS (SELECT seen.i, seen.j, si + sj AS half, sv, {_DISTANCE} AS d FROM seen JOIN src ON si = {TRUNC.format('s + 0.5e0')} AND sj = {TRUNC.format('r + 0.5e0')})",
            f"later AS (SELECT seen.i, seen.j, sv + 1000e0 AS sv, {_DISTANCE} AS d FROM seen JOIN src ON si = {TRUNC.format('s + 0.5e0')} AND sj = {TRUNC.format('r + 0.5e0')} WHERE (si + sj) % 3 = 0)",
        ],
        f"SELECT i AS cell_row, j AS cell_col, {qs('CASE WHEN l.d IS NOT NULL AND (n.d IS NULL OR l.d <= n.d + 1) THEN l.sv ELSE n.sv END', 1e-4)} AS value FROM (SELECT * FROM near WHERE half % 2 = 0) n FULL JOIN later l USING (i, j)",
    ),
)
def regrid_merge_nearest(spark, sf_dir):
    """Nearest's rule between runs: a later value counts if its distance is at most the earlier one and 1."""
    world, north = grown(spark, sf_dir, WORLD, NORTH)
    cells_ = raster(spark, sf_dir, world).filter("value <> 0")
    state = resample.regrid_state(cells_.filter((F.col("row") + F.col("col")) % 2 == 0), world, north, "nearest")
    later = cells_.filter((F.col("row") + F.col("col")) % 3 == 0).withColumn("value", F.col("value") + 1000)
    return out(resample.regrid(later, world, north, "nearest", before=state, whole=False))


@query("regrid_filled", with_sql([*looked_sql(WORLD, NORTH), RASTER_SQL, NEAR_SQL], f"SELECT c.i AS cell_row, c.j AS cell_col, {qs('coalesce(sv, -1e0)', 1e-4)} AS value FROM {cells_sql(NORTH)} c LEFT JOIN near USING (i, j)"))
def regrid_filled(spark, sf_dir):
    world, north = grown(spark, sf_dir, WORLD, NORTH)
    whole = resample.regrid(raster(spark, sf_dir, world), world, north, "nearest", fill=0.0, whole=True)
    return out(whole.withColumn("value", F.coalesce(F.nullif("value", F.lit(0.0)), F.lit(-1.0))))


ROUND = "trunc({} + 0.5e0)"


def _resamp(name: str, sql: str, target: GridDef | None = None, **options) -> None:
    def run(spark, sf_dir):
        world, *other = grown(spark, sf_dir, WORLD, *([target] if target else []))
        return out(resample.resamp(raster(spark, sf_dir, world), world, *other, **options), 1.0)

    query(f"resamp_{name}", sql)(run)


def whole_sql(ctes: list[str], target: GridDef, rows: str, empty: str) -> str:
    """All cells of the target: rows has i, j, x."""
    return with_sql([*ctes, f"found AS ({rows})"], f"SELECT c.i AS cell_row, c.j AS cell_col, {qs(f'coalesce(x, {empty})', 1.0)} AS value FROM {cells_sql(target)} c LEFT JOIN found USING (i, j)")


_BOTH = [*looked_sql(WORLD, NORTH, True), RASTER_SQL]
_resamp("nearest", whole_sql([*_BOTH, NEAR_SQL], NORTH, "SELECT i, j, sv AS x FROM near", "0e0"), target=NORTH, method="nearest", fill=0.0)
_resamp("nearest_mask", whole_sql([*_BOTH, NEAR_SQL], NORTH, "SELECT i, j, CASE WHEN sv = 7 THEN 100e0 ELSE 0e0 END AS x FROM near", "0e0"), target=NORTH, method="nearest", fill=0.0, mask=7.0)
_resamp("bilinear", stencil_sql(0, 1, LINEAR_W, f", found AS (SELECT i, j, {ROUND.format('num / w')} AS x FROM sums WHERE w <> 0) SELECT c.i AS cell_row, c.j AS cell_col, {qs('coalesce(x, 0e0)', 1.0)} AS value FROM {cells_sql(NORTH)} c LEFT JOIN found USING (i, j)", "both"), target=NORTH, method="bilinear", fill=0.0)
_IN_COARSE = [*looked_sql(COARSE, WORLD, True, raster_sql(WORLD)), f"dealt AS (SELECT i, j, v, {TRUNC.format('s + 0.5e0')} AS ti, {TRUNC.format('r + 0.5e0')} AS tj FROM seen WHERE v <> 0)"]
_resamp("bucket_fast", whole_sql(_IN_COARSE, COARSE, f"SELECT ti AS i, tj AS j, {ROUND.format('avg(v)')} AS x FROM dealt GROUP BY ti, tj", "0e0"), target=COARSE, method="bucket", fill=0.0, exact=False)
#: The mean of a cell rounded after each value, in row-major order; n is the number of values so far and 1 (the start).
_FOLD = "list_reduce(list_prepend(0e0, list(v ORDER BY i, j)), lambda m, x, n: trunc((m * (n - 2) + x) / (n - 1) + 0.5e0))"
_resamp("bucket_exact", whole_sql(_IN_COARSE, COARSE, f"SELECT ti AS i, tj AS j, {_FOLD} AS x FROM dealt GROUP BY ti, tj", "0e0"), target=COARSE, method="bucket", fill=0.0, exact=True)
_resamp("bucket_mask", whole_sql(_IN_COARSE, COARSE, f"SELECT ti AS i, tj AS j, {ROUND.format(ROUND.format('avg(CASE WHEN v = 7 THEN 10000e0 ELSE 0e0 END)') + ' / 100')} AS x FROM dealt GROUP BY ti, tj", "-1e0"), target=COARSE, method="bucket", fill=0.0, mask=7.0, exact=False)
_THIRD = f"(SELECT CAST(id // ({WORLD.cols} * {ZOOM} // 3) AS INTEGER) AS i, CAST(id % ({WORLD.cols} * {ZOOM} // 3) AS INTEGER) AS j FROM (SELECT unnest(range(({WORLD.cols} * {ZOOM} // 3) * ({WORLD.rows} * {ZOOM} // 3))) AS id))"
_resamp("minification", with_sql([ZOOM_SQL, RASTER_SQL], f"SELECT c.i AS cell_row, c.j AS cell_col, {qs('coalesce(sv, 0e0)', 1.0)} AS value FROM {_THIRD} c LEFT JOIN src ON si = CAST(trunc(3 * (c.i + 0.5e0) + 0.5e0) AS INTEGER) AND sj = CAST(trunc(3 * (c.j + 0.5e0) + 0.5e0) AS INTEGER)"), method="minification", fill=0.0, factor=3)
_resamp("reduction", with_sql([ZOOM_SQL, RASTER_SQL], f"SELECT c.i AS cell_row, c.j AS cell_col, {qs('coalesce(x, 0e0)', 1.0)} AS value FROM {_THIRD} c LEFT JOIN (SELECT si // 3 AS i, sj // 3 AS j, trunc(sum(sv) / count(*) + 0.5e0) AS x FROM src GROUP BY ALL) USING (i, j)"), method="reduction", fill=0.0, factor=3)


@query(
    "resamp_distribution",
    with_sql(
        [x.replace(" FROM seen WHERE v <> 0", " FROM seen WHERE v BETWEEN 1 AND 40") for x in _IN_COARSE],
        "SELECT ti AS cell_row, tj AS cell_col, c.k AS class, CAST(trunc(100e0 * count(*) FILTER (v = c.k) / count(*) + 0.5e0) AS INTEGER) AS percent FROM dealt, (SELECT CAST(k AS INTEGER) AS k FROM range(1, 41) t(k)) c GROUP BY ti, tj, c.k",
    ),
)
def resamp_distribution(spark, sf_dir):
    world, target = grown(spark, sf_dir, WORLD, COARSE)
    d = resample.distribution(raster(spark, sf_dir, world), world, target, 1, 40, fill=0.0, whole=False)
    return d.select(F.col("row").alias("cell_row"), F.col("col").alias("cell_col"), "class", "percent")


# --- points to raster -----------------------------------------------------------------------------------------------


def placed_sql(g: GridDef) -> list[str]:
    s = Ctes("p", [f"p AS (SELECT * FROM {POINTS} WHERE v <> 0 AND {T.within(g.map, Sql('lat'), Sql('lon')).sql})"])
    r, t, _ = T.grid_place(g, s, Sql("lat"), Sql("lon"))
    s.ctes.append(f"placed AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, v, {r.sql} AS r, {t.sql} AS s, {TRUNC.format(f'{t.sql} + 0.5e0')} AS ni, {TRUNC.format(f'{r.sql} + 0.5e0')} AS nj FROM {s.last} WHERE {finite(r).sql})")
    return s.ctes


def around_sql(g: GridDef, radius: float) -> list[str]:
    w = int(2 * radius)
    return [
        *placed_sql(g),
        f"around AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, v, ni + di AS i, nj + dj AS j, sqrt((r - (nj + dj)) * (r - (nj + dj)) + (s - (ni + di)) * (s - (ni + di))) AS d FROM placed, (SELECT CAST(a AS INTEGER) AS di FROM range({-w}, {w + 1}) x(a)) CROSS JOIN (SELECT CAST(b AS INTEGER) AS dj FROM range({-w}, {w + 1}) y(b)))",
        f"near AS (SELECT * FROM around WHERE i BETWEEN 0 AND {g.rows - 1} AND j BETWEEN 0 AND {g.cols - 1})",
    ]


def _grid(method: str, tail: str, **options) -> None:
    def run(spark, sf_dir):
        df = gridding.grid_points(points(spark, sf_dir), NORTH, method, value="v", **options)
        return df.filter("value is not null").select(F.col("row").alias("cell_row"), F.col("col").alias("cell_col"), q(F.col("value"), 1e-4).alias("value"), "n")

    query(f"grid_{method}", with_sql(around_sql(NORTH, options.get("radius", 1.0)), tail))(run)


_cells = "CAST(i AS INTEGER) AS cell_row, CAST(j AS INTEGER) AS cell_col"
_grid("cressman", f"SELECT {_cells}, {qs('sum((2.25e0 - d * d) / (2.25e0 + d * d) * v) / sum((2.25e0 - d * d) / (2.25e0 + d * d))', 1e-4)} AS value, count(*) AS n FROM near WHERE d <= 1.5e0 GROUP BY i, j HAVING sum((2.25e0 - d * d) / (2.25e0 + d * d)) <> 0", radius=1.5)
_grid("idw", f"SELECT {_cells}, {qs('sum(v / (d * d)) / sum(1e0 / (d * d))', 1e-4)} AS value, count(*) AS n FROM near WHERE d <= 1e0 AND d > 0 GROUP BY i, j")
_grid("bucket", f"SELECT {_cells}, {qs('avg(v)', 1e-4)} AS value, count(*) AS n FROM near GROUP BY i, j", radius=0.4)
_NEAREST_SQL = with_sql(around_sql(NORTH, 1.0), f"SELECT {_cells}, {qs('arg_min(v, (round(d, 9), -l_orderkey, -l_linenumber, -l_partkey, -l_suppkey))', 1e-4)} AS value, count(*) AS n FROM near WHERE d <= 1e0 GROUP BY i, j")


@query("grid_nearest", _NEAREST_SQL)
def grid_nearest(spark, sf_dir):
    df = gridding.grid_points(points(spark, sf_dir), NORTH, "nearest", value="v", order=tuple(ROW))
    return df.select(F.col("row").alias("cell_row"), F.col("col").alias("cell_col"), q(F.col("value"), 1e-4).alias("value"), "n")


@query("grid_merge", with_sql(around_sql(NORTH, 0.4), f"SELECT {_cells}, {qs('avg(v)', 1e-4)} AS value, count(*) AS n FROM near GROUP BY i, j"))
def grid_merge(spark, sf_dir):
    """Sums of odd and even orders, added up."""
    p = points(spark, sf_dir)
    parts = [gridding.accumulate(p.filter(F.col("l_orderkey") % 2 == k), NORTH, method="bucket", radius=0.4, value="v") for k in (0, 1)]
    df = gridding.values(gridding.merge(*parts))
    return df.select(F.col("row").alias("cell_row"), F.col("col").alias("cell_col"), q(F.col("value"), 1e-4).alias("value"), "n")


# --- raster to points -----------------------------------------------------------------------------------------------


def extract_sql(low: int, high: int, weight: str, tail: str, keep: str = "") -> str:
    s = Ctes("p", [ZOOM_SQL, f"p AS (SELECT * FROM {POINTS})"])
    r, t, on = T.grid_place(WORLD, s, Sql("lat"), Sql("lon"))
    ctes = [*s.ctes, f"placed AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, {fine(r)} AS r, {fine(t)} AS s FROM {s.last} WHERE {on.sql})", f"src AS (SELECT i AS si, j AS sj, v AS sv FROM {raster_sql(WORLD)} WHERE v BETWEEN 1 AND 240)"]
    ctes.append(f"around AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, r, s, dr, dc, {TRUNC.format('s')} + dr AS si, {TRUNC.format('r')} + dc AS sj FROM placed, (SELECT CAST(a AS INTEGER) AS dr FROM range({low}, {high + 1}) x(a)) CROSS JOIN (SELECT CAST(b AS INTEGER) AS dc FROM range({low}, {high + 1}) y(b)))")
    ctes.append(f"each AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, si, sj, sv, {weight} AS w FROM around JOIN src USING (si, sj) {keep})")
    ctes.append(f"found AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, {tail} AS x, count(*) AS n FROM each GROUP BY l_orderkey, l_linenumber, l_partkey, l_suppkey)")
    return with_sql(ctes, f"SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, {qs('x', 1e-4)} AS value, coalesce(n, 0) AS n FROM p LEFT JOIN found USING (l_orderkey, l_linenumber, l_partkey, l_suppkey)")


def _extract(method: str, sql: str, **options) -> None:
    def run(spark, sf_dir):
        (world,) = grown(spark, sf_dir, WORLD)
        df = extract.extract(points(spark, sf_dir), raster(spark, sf_dir, world), world, ROW, method, low=1.0, high=240.0, **options)
        return df.select(*ROW, q(F.col("value"), 1e-4).alias("value"), "n")

    query(f"extract_{method}", sql)(run)


#: Sums go from row to row and from column to column, as those of cells.gathered do.
_SUM, _SUM_W = "sum(w * sv ORDER BY si, sj)", "sum(w ORDER BY si, sj)"
_D2 = "((si - s) * (si - s) + (sj - r) * (sj - r))"
_extract("bilinear", extract_sql(0, 1, LINEAR_W, f"CASE WHEN {_SUM_W} > 0 THEN {_SUM} / {_SUM_W} END"))
#: Where the weights of samples come to 0, the sum stands undivided.
_SHARE = f"CASE WHEN {_SUM_W} <> 0 THEN {_SUM} / {_SUM_W} ELSE {_SUM} END"
_extract("cubic", extract_sql(-1, 2, CUBIC_W, _SHARE))
_extract("average", extract_sql(-1, 2, "1e0", "avg(sv)", f"WHERE {_D2} <= 2.25e0"), radius=1.5)
_extract("distance", extract_sql(-1, 2, f"CASE WHEN sqrt({_D2}) <= 1.5e0 THEN 1e0 / {_D2} ELSE 0e0 END", _SHARE), radius=1.5)
_extract("nearest", extract_sql(0, 1, "1e0", "max(sv)", f"WHERE si = {TRUNC.format('s + 0.5e0')} AND sj = {TRUNC.format('r + 0.5e0')}"))

_CENTRE = Ctes("c0", [ZOOM_SQL, f"c0 AS (SELECT i, j, {coarse('CAST(i AS DOUBLE)')} AS fi, {coarse('CAST(j AS DOUBLE)')} AS fj, v FROM {raster_sql(NORTH)})"])
_lat, _lon, _ok = T.geo_of_place(NORTH, _CENTRE, Sql("fj"), Sql("fi"))
_CENTRE_SQL = _CENTRE.query(f"i AS cell_row, j AS cell_col, {qs(_lat)} AS lat_q, {qs(_lon)} AS lon_q, {qs('CASE WHEN v BETWEEN 1 AND 240 THEN v END', 1e-4)} AS value") + f" WHERE {_ok.sql} AND {_lat.sql} BETWEEN 10 AND 80 AND {_lon.sql} BETWEEN -170 AND 100"


@query("extract_centres", _CENTRE_SQL)
def extract_centres(spark, sf_dir):
    (north,) = grown(spark, sf_dir, NORTH)
    df = extract.centres(raster(spark, sf_dir, north), north, low=1.0, high=240.0, box=(10, 80, -170, 100))
    return df.select(F.col("row").alias("cell_row"), F.col("col").alias("cell_col"), q(F.col("lat")).alias("lat_q"), q(F.col("lon")).alias("lon_q"), q(F.col("value"), 1e-4).alias("value"))


_LOC = Ctes("c0", [ZOOM_SQL, f"c0 AS (SELECT i, j, v, {coarse('(i - 0.5e0)')} AS fi, {coarse('(j - 0.5e0)')} AS fj FROM {raster_sql(NORTH)})"])
_lat, _lon, _ok = T.geo_of_place(NORTH, _LOC, Sql("fj"), Sql("fi"))


@query("grid_locations", _LOC.query(f"i AS cell_row, j AS cell_col, {qs(f'CASE WHEN {_ok.sql} THEN {_lat.sql} ELSE -999e0 END')} AS lat_q, {qs(f'CASE WHEN {_ok.sql} THEN {_lon.sql} ELSE -999e0 END')} AS lon_q, {qs('v', 1e-4)} AS value"))
def grid_locations(spark, sf_dir):
    """The upper left corners of the raster's cells, beside their values."""
    (north,) = grown(spark, sf_dir, NORTH)
    df = cells.locations(spark, north, (-0.5, -0.5), -999.0).join(raster(spark, sf_dir, north), ["row", "col"])
    return df.select(F.col("row").alias("cell_row"), F.col("col").alias("cell_col"), q(F.col("lat")).alias("lat_q"), q(F.col("lon")).alias("lon_q"), q(F.col("value"), 1e-4).alias("value"))


# --- files: written to the shared folder and read again -------------------------------------------------------------


@query("file_point_text", f"SELECT {qs('lat')} AS lat_q, {qs('lon')} AS lon_q, {qs('v', 1e-4)} AS value FROM {POINTS}")
def file_point_text(spark, sf_dir):
    """Six decimals of each number."""
    path = new_folder(spark, "points")
    point_files.write_points(points(spark, sf_dir).withColumnRenamed("v", "value"), path)
    return point_files.read_points(spark, path).select(q(F.col("lat")).alias("lat_q"), q(F.col("lon")).alias("lon_q"), q(F.col("value"), 1e-4).alias("value"))


@query("file_point_binary", f"SELECT lat, lon, v AS value FROM {POINTS}")
def file_point_binary(spark, sf_dir):
    path = new_folder(spark, "points")
    point_files.write_binary_points(points(spark, sf_dir).withColumnRenamed("v", "value"), path, values=True)
    return point_files.read_binary_points(spark, path, values=True)


@query("file_raster", f"WITH {ZOOM_SQL} SELECT i AS cell_row, j AS cell_col, v AS value FROM {raster_sql(WORLD)}")
def file_raster(spark, sf_dir):
    """Sums of lines by cell, in files of 64 rows."""
    (world,) = grown(spark, sf_dir, WORLD)
    path = new_folder(spark, "raster")
    raster_files.write_flat(raster(spark, sf_dir, world), world, path, "f8", fill=-1.0, rows_per_file=64)
    spark.dataSource.register(raster_files.FlatRaster)
    whole = spark.read.format("flat_raster").options(path=path, cols=world.cols, dtype="f8", fill=-1.0).load()
    return whole.filter("value is not null").select(F.col("row").alias("cell_row"), F.col("col").alias("cell_col"), "value")


_BANDS = Ctes("c0", [ZOOM_SQL, f"c0 AS (SELECT i, j, {coarse('CAST(i AS DOUBLE)')} AS fi, {coarse('CAST(j AS DOUBLE)')} AS fj FROM {cells_sql(NORTH)})"])
_lat, _lon, _ok = T.geo_of_place(NORTH, _BANDS, Sql("fj"), Sql("fi"))
_BANDS_SQL = with_sql(
    [*_BANDS.ctes, f"l AS (SELECT i, j, {_lat.sql} AS lat, {_lon.sql} AS lon FROM {_BANDS.last} WHERE {_ok.sql})", f"v AS (SELECT * FROM {raster_sql(NORTH)})"],
    " UNION ALL ".join(f"SELECT CAST({k} AS INTEGER) AS band, i AS cell_row, j AS cell_col, {qs(c)} AS place, {qs('v', 1e-4)} AS value FROM l JOIN v USING (i, j)" for k, c in enumerate(("lat", "lon"))),
)


@query("file_locations", _BANDS_SQL)
def file_locations(spark, sf_dir):
    """Bands of latitudes and longitudes of the grid's cells, in one file, beside the raster of lines."""
    (north,) = grown(spark, sf_dir, NORTH)
    path = new_folder(spark, "bands")
    raster_files.write_locations(spark, north, path, double=True, rows_per_file=32)
    file = joined(spark, path, f"{path}.double")
    bands = raster_files.read_bands(spark, file, north, "f8", fill=-999.0).filter("value is not null").withColumnRenamed("value", "place")
    both_ = bands.join(raster(spark, sf_dir, north), ["row", "col"])
    return both_.select("band", F.col("row").alias("cell_row"), F.col("col").alias("cell_col"), q(F.col("place")).alias("place"), q(F.col("value"), 1e-4).alias("value"))


# --- segments -------------------------------------------------------------------------------------------------------

#: A segment for each order: its lines are points, some 2^-10 degrees apart.
SEGMENTS = """(SELECT l_orderkey AS seg, l_linenumber AS pos,
 CAST((l_orderkey * 7919) % 150000 - 75000 + (l_linenumber * l_linenumber * 37) % 900 AS BIGINT) AS ulat,
 CAST((l_orderkey * 611953) % 340000 - 170000 + l_linenumber * 211 AS BIGINT) AS ulon FROM lineitem)"""


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", "l_linenumber").createOrReplaceTempView("_tessera_lines")
    df = spark.sql(f"SELECT * FROM {SEGMENTS.replace('FROM lineitem', 'FROM _tessera_lines')}")
    return df.select("seg", "pos", (F.col("ulat") / 1024.0).alias("lat"), (F.col("ulon") / 1024.0).alias("lon"))


SEG_SQL = f"s AS (SELECT seg, pos, CAST(ulat AS DOUBLE) / 1024e0 AS lat, CAST(ulon AS DOUBLE) / 1024e0 AS lon FROM {SEGMENTS})"
BOUNDS_SQL = "b AS (SELECT seg, count(*) AS n, min(lat) AS lat_min, max(lat) AS lat_max, min(lon) AS lon_min, max(lon) AS lon_max FROM s GROUP BY seg)"


@query("segment_decode", with_sql([SEG_SQL], "SELECT seg, pos, lat, lon FROM s"))
def segment_decode(spark, sf_dir):
    """Points to deltas and back; all are whole units, but negative ones round toward zero when they are encoded."""
    return vectors.decode(vectors.encode(segments(spark, sf_dir).withColumns({"lat": F.col("lat") + F.when(F.col("lat") < 0, -1e-6).otherwise(0.0), "lon": F.col("lon") + F.when(F.col("lon") < 0, -1e-6).otherwise(0.0)}).withColumns({"lat": F.col("lat") - F.when(F.col("lat") < 0, 0.5 / 1024).otherwise(0.0), "lon": F.col("lon") - F.when(F.col("lon") < 0, 0.5 / 1024).otherwise(0.0)})))


@query("segment_index", with_sql([SEG_SQL, BOUNDS_SQL], "SELECT * FROM b"))
def segment_index(spark, sf_dir):
    return vectors.sort_index(vectors.bounds(segments(spark, sf_dir)), "lat_max")


@query("segment_extents", with_sql([SEG_SQL, BOUNDS_SQL], "SELECT max(lat_max - lat_min) AS lat_extent, max(lon_max - lon_min) AS lon_extent FROM b"))
def segment_extents(spark, sf_dir):
    return vectors.extents(vectors.bounds(segments(spark, sf_dir)))


@query("segment_scan", with_sql([SEG_SQL, BOUNDS_SQL], "SELECT * FROM b WHERE lon_min >= 118.5e0 OR lon_min <= -120e0"))
def segment_scan(spark, sf_dir):
    return vectors.scan(vectors.bounds(segments(spark, sf_dir)), 120.0, -120.0, "lon_min", 1.5)


@query("segment_clip", with_sql([SEG_SQL, BOUNDS_SQL], "SELECT s.* FROM s JOIN b USING (seg) WHERE lat_max >= 0 AND lat_min <= 40 AND (lon_max >= 150 OR lon_min <= -140)"))
def segment_clip(spark, sf_dir):
    return vectors.clip([segments(spark, sf_dir)], 0, 40, 150, -140).select("seg", "pos", "lat", "lon")


@query("segment_reverse", with_sql([SEG_SQL], "SELECT seg, max(pos) OVER (PARTITION BY seg) - pos AS pos, lat, lon FROM s"))
def segment_reverse(spark, sf_dir):
    return vectors.reverse(segments(spark, sf_dir)).select("seg", "pos", "lat", "lon")


@query("segment_every_nth", with_sql([SEG_SQL], "SELECT seg, pos, lat, lon FROM (SELECT *, count(*) OVER (PARTITION BY seg) AS n, max(pos) OVER (PARTITION BY seg) AS last FROM s) WHERE n <= 4 OR pos % 3 = 0 OR pos = last"))
def segment_every_nth(spark, sf_dir):
    return vectors.every_nth(segments(spark, sf_dir), 3, 4)


def _strokes_sql() -> str:
    s = Ctes("s", [SEG_SQL])
    r, t, on = T.grid_place(NORTH, s, Sql("lat"), Sql("lon"))
    u, v = T.map_uv(NORTH.map, s, Sql("lat"), Sql("lon"))
    s.ctes.append(f"k AS (SELECT seg, pos, {u.sql} AS x, {v.sql} AS y, {on.sql} AND {T.within(NORTH.map, Sql('lat'), Sql('lon')).sql} AS ok FROM {s.last} WHERE {u.sql} IS NOT NULL)")
    s.ctes.append("l AS (SELECT *, lag(x) OVER (PARTITION BY seg ORDER BY pos) AS x1, lag(y) OVER (PARTITION BY seg ORDER BY pos) AS y1 FROM k)")
    return with_sql(s.ctes, f"SELECT seg, pos, {qs('x1')} AS x1, {qs('y1')} AS y1, {qs('x')} AS x2, {qs('y')} AS y2 FROM l WHERE ok AND x1 IS NOT NULL")


@query("segment_strokes", _strokes_sql())
def segment_strokes(spark, sf_dir):
    df = vectors.strokes(segments(spark, sf_dir), NORTH)
    return df.select("seg", "pos", *(q(F.col(c)).alias(c) for c in ("x1", "y1", "x2", "y2")))


_SPLIT_SQL = with_sql(
    [
        SEG_SQL,
        "m AS (SELECT seg, pos, lat, lon - first(lon) OVER (PARTITION BY seg ORDER BY pos) + 179.5e0 + pos * 0.3e0 AS lon FROM s)",
        "w AS (SELECT seg, pos, lat, CASE WHEN lon > 180 THEN lon - 360 ELSE lon END AS lon FROM m)",
        "p AS (SELECT *, lag(lat) OVER (PARTITION BY seg ORDER BY pos) AS lat1, lag(lon) OVER (PARTITION BY seg ORDER BY pos) AS lon1 FROM w)",
        "c AS (SELECT *, CASE WHEN abs(lon - lon1) > 180 THEN 1 ELSE 0 END AS cut, CASE WHEN lon1 > 0 THEN 180e0 ELSE -180e0 END AS side FROM p)",
        "d AS (SELECT *, sum(cut) OVER (PARTITION BY seg ORDER BY pos) AS part, lat1 + (side - lon1) / (lon + 2e0 * side - lon1) * (lat - lat1) AS mid FROM c)",
        "k AS (SELECT seg, part, pos, 2 AS o, lat, lon FROM d UNION ALL SELECT seg, part - 1, pos, 0, mid, side FROM d WHERE cut = 1 UNION ALL SELECT seg, part, pos, 1, mid, -side FROM d WHERE cut = 1)",
    ],
    "SELECT seg, CAST(part AS BIGINT) AS part, CAST(row_number() OVER (PARTITION BY seg, part ORDER BY pos, o) - 1 AS INTEGER) AS pos, lat, lon FROM k",
)


@query("segment_split", _SPLIT_SQL)
def segment_split(spark, sf_dir):
    """Segments moved so that many cross the date line."""
    p = segments(spark, sf_dir)
    moved = p.withColumn("lon", F.col("lon") - F.first("lon").over(Window.partitionBy("seg").orderBy("pos")) + 179.5 + F.col("pos") * 0.3)
    return vectors.split_at_date_line(moved.withColumn("lon", F.when(F.col("lon") > 180, F.col("lon") - 360).otherwise(F.col("lon"))))


_UNITS_SQL = f"u AS (SELECT seg, row_number() OVER (PARTITION BY seg ORDER BY pos) - 1 AS pos, ulat + CAST(ulat < 0 AS INTEGER) AS a, ulon + CAST(ulon < 0 AS INTEGER) AS b FROM {SEGMENTS})"


@query("file_segments", with_sql([_UNITS_SQL], "SELECT CAST(seg AS INTEGER) AS seg, CAST(pos AS INTEGER) AS pos, a / 1024e0 AS lat, b / 1024e0 AS lon FROM u WHERE seg IN (SELECT seg FROM u GROUP BY seg HAVING min(b) >= -51200 AND min(b) < 71680 AND max(a) >= 0)"))
def file_segments(spark, sf_dir):
    """Segments in files whose indexes are sorted by western bound; the limits are looked up in the indexes. Whole negative units are
    a unit larger when they come back: the format rounds halves up by truncation."""
    path = new_folder(spark, "segments")
    segment_files.write_segment_files(segments(spark, sf_dir), path, order="lon_min", most_bytes=2**18)
    found = segment_files.read_segments(spark, path, lon_min=(-50, 70), lat_max=(0, None))
    return vectors.decode(found.filter("lon_min < 70"))


_STROKES = f"(SELECT seg, pos, CAST(floor((min(ulat) / 1024e0 + 90e0) * 36000e0 + 0.5e0) AS BIGINT) AS a, CAST(floor((min(ulon) / 1024e0 + 180e0) * 36000e0 + 0.5e0) AS BIGINT) AS b FROM {SEGMENTS} GROUP BY seg, pos)"


@query("file_strokes", f"WITH p AS {_STROKES}, s AS (SELECT seg, arg_min(a, pos) AS sa, arg_min(b, pos) AS sb FROM p GROUP BY seg) SELECT CAST((sa // 36000) * 360 + sb // 36000 AS INTEGER) AS cell, CAST(seg % 7 AS INTEGER) AS rank, a, b, count(*) AS n FROM p JOIN s USING (seg) WHERE sa // 36000 - 90 BETWEEN -20 AND 49 AND sb // 36000 - 180 BETWEEN 30 AND 119 GROUP BY ALL")
def file_strokes(spark, sf_dir):
    """Segments as strokes in one file of chained records; those of the cells in a box come back."""
    raw = segments(spark, sf_dir).distinct().withColumn("rank", F.col("seg") % 7)
    file = stroke_files.write_strokes(raw, f"{new_folder(spark, 'strokes')}/strokes")
    found = stroke_files.read_strokes(spark, file, (-20, 50, 30, 120))
    unit = lambda c, low: F.floor((F.col(c) + low) * 36000 + 0.5).alias("a" if low == 90 else "b")
    return found.select("cell", "rank", unit("lat", 90), unit("lon", 180)).groupBy("cell", "rank", "a", "b").agg(F.count("*").alias("n"))


def _thin_sql(km: float) -> str:
    """The rule as a recursion along each segment: the last kept point and the next point judge the one between."""
    unit = km / 3
    place = lambda a, b: f"cos(radians({a})) * sin(radians({b} - klon)) AS {{0}}_e, cos(radians(klat)) * sin(radians({a})) - sin(radians(klat)) * cos(radians({a})) * cos(radians({b} - klon)) AS {{0}}_n, sqrt(2 / (1 + sin(radians(klat)) * sin(radians({a})) + cos(radians(klat)) * cos(radians({a})) * cos(radians({b} - klon)))) * {geodesy.RADIUS_KM!r} AS {{0}}_k"
    return f"""WITH RECURSIVE {SEG_SQL},
p AS (SELECT seg, row_number() OVER (PARTITION BY seg ORDER BY pos, lat, lon) AS k, lat, lon, lead(lat) OVER (PARTITION BY seg ORDER BY pos, lat, lon) AS nlat, lead(lon) OVER (PARTITION BY seg ORDER BY pos, lat, lon) AS nlon FROM s),
r AS (SELECT seg, k, lat, lon, lat AS klat, lon AS klon, TRUE AS keep FROM p WHERE k = 1
 UNION ALL SELECT seg, k, lat, lon, CASE WHEN kept THEN lat ELSE klat END, CASE WHEN kept THEN lon ELSE klon END, kept FROM (
  SELECT *, nlat IS NULL OR off >= {unit!r} OR (far >= {2 * unit!r} AND off > {unit / 2!r}) AS kept FROM (
   SELECT *, abs(p_e * p_k * q_n * q_k - p_n * p_k * q_e * q_k) / nullif(sqrt(q_e * q_k * q_e * q_k + q_n * q_k * q_n * q_k), 0) AS off, sqrt(p_e * p_e + p_n * p_n) * p_k AS far FROM (
    SELECT p.*, klat, klon, {place("p.lat", "p.lon").format("p")}, {place("p.nlat", "p.nlon").format("q")} FROM r JOIN p ON p.seg = r.seg AND p.k = r.k + 1))))
SELECT seg, CAST(row_number() OVER (PARTITION BY seg ORDER BY k) - 1 AS INTEGER) AS pos, lat, lon FROM r WHERE coalesce(keep, FALSE)"""


@query("segment_thin", _thin_sql(30.0))
def segment_thin(spark, sf_dir):
    return vectors.thin(segments(spark, sf_dir), 30.0)


def coast(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments that meet: 32 orders in a row lie around one place, each line within some 8 km of it."""
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(F.col("l_orderkey").alias("seg"), F.col("l_linenumber").alias("pos"), "l_partkey", "l_suppkey").repartition("seg")
    lines = lines.groupBy("seg", "pos").agg(F.min("l_partkey").alias("a"), F.min("l_suppkey").alias("b"))
    place = F.expr("seg div 32")
    lat, lon = place * 7919 % 150000 - 75000 + F.col("a") % 79, place * 611953 % 340000 - 170000 + (F.col("b") * 7 + F.col("pos") * 13) % 83
    return lines.select("seg", "pos", (lat / 1024.0).alias("lat"), (lon / 1024.0).alias("lon"))


@query("segment_join")
def segment_join(spark, sf_dir):
    """Greedy, in the order of segments: tested against the plain sequential rule over all of the smallest tables."""
    return vectors.join_ends(coast(spark, sf_dir), 2.0)


#: A quadrangle around each supplier's place, some 1 to 12 degrees high; every third has a reflex corner.
_CORNERS = ("place_lat + h, place_lon - w", "place_lat + h, place_lon + w", "place_lat - h, place_lon + w", "place_lat - CASE WHEN s_suppkey % 3 = 0 THEN -h / 2e0 ELSE h END, place_lon - CASE WHEN s_suppkey % 3 = 0 THEN -w / 2e0 ELSE w END")
_REGIONS = "SELECT s_suppkey, CAST(s_suppkey * 7919 % 140000 AS DOUBLE) / 1000e0 - 70e0 AS place_lat, CAST(s_suppkey * 611953 % 320000 AS DOUBLE) / 1000e0 - 160e0 AS place_lon, CAST(1 + s_suppkey % 12 AS DOUBLE) / 2e0 AS h, CAST(1 + s_suppkey % 17 AS DOUBLE) AS w FROM supplier"
_PLACES = "SELECT c_custkey, CAST(c_custkey * 104729 % 179000 AS DOUBLE) / 1000e0 - 89.4863e0 AS lat, CAST(c_custkey * 7907 % 359000 AS DOUBLE) / 1000e0 - 179.4863e0 AS lon FROM customer"
_PLUMB = lambda a, b: f"[cos(radians({a})) * cos(radians({b})), cos(radians({a})) * sin(radians({b})), sin(radians({a}))]"


def _region_sql() -> str:
    """A region's first reflex corner of 1, 2, 3, 0 is where it is cut into two triangles; one that is turned the other way, as of
    edges that cross, holds nothing (its half-planes would meet on the far side of the globe)."""
    tiny = "2.220446049250313e-15"
    corner = [_PLUMB(*c.split(", ")) for c in _CORNERS]
    det = lambda p, a, b: f"({p}[1] * ({a}[2] * {b}[3] - {a}[3] * {b}[2]) + {p}[2] * ({a}[3] * {b}[1] - {a}[1] * {b}[3]) + {p}[3] * ({a}[1] * {b}[2] - {a}[2] * {b}[1]))"
    normal = lambda a, b: f"[{a}[2] * {b}[3] - {a}[3] * {b}[2], {a}[3] * {b}[1] - {a}[1] * {b}[3], {a}[1] * {b}[2] - {a}[2] * {b}[1]]"
    at = lambda k, step: f"q[(k + {step}) % 4 + 1]" if step else "q[k + 1]"
    reflex = " ".join(f"WHEN {det(f'q[{(k - 1) % 4 + 1}]', f'q[{k % 4 + 1}]', f'q[{(k + 1) % 4 + 1}]')} >= {tiny} THEN {k % 4}" for k in (1, 2, 3, 4))
    sides = lambda *c: [normal(a, b) for a, b in zip([c[-1], *c[:-1]], c, strict=True)]
    whole, halves = sides(*(f"q[{k}]" for k in (1, 2, 3, 4))), [(at("k", 0), at("k", j), at("k", j + 1)) for j in (1, 2)]
    first = [f"CASE WHEN k IS NULL THEN {w} WHEN {det(*halves[0])} < {tiny} THEN {h} END AS a{n}" for n, (w, h) in enumerate(zip(whole, 2 * sides(*halves[0])))]
    second = [f"CASE WHEN k IS NOT NULL AND {det(*halves[1])} < {tiny} THEN {h} END AS b{n}" for n, h in enumerate(sides(*halves[1]))]
    right = lambda *names: "coalesce(" + " AND ".join(f"p[1] * {n}[1] + p[2] * {n}[2] + p[3] * {n}[3] < {tiny}" for n in names) + ", FALSE)"
    return f"""WITH r AS (SELECT s_suppkey, [{", ".join(corner)}] AS q FROM ({_REGIONS})), c AS (SELECT c_custkey, {_PLUMB("lat", "lon")} AS p FROM ({_PLACES})),
cut AS (SELECT *, CASE {reflex} END AS k FROM r),
pieces AS (SELECT s_suppkey, {", ".join([*first, *second])} FROM cut)
SELECT c_custkey, s_suppkey FROM c, pieces WHERE {right("a0", "a1", "a2", "a3")} OR {right("b0", "b1", "b2")}"""


@query("points_in_regions", _region_sql())
def points_in_regions(spark, sf_dir):
    """Customers in quadrangles around suppliers."""
    for t in ("supplier", "customer"):
        spark.read.parquet(f"{sf_dir}/{t}.parquet").createOrReplaceTempView(f"_tessera_{t}")
    of = lambda sql, t: spark.sql(sql.replace(f"FROM {t}", f"FROM _tessera_{t}").replace("e0", "D"))
    quads = of(_REGIONS, "supplier").select("s_suppkey", F.expr("array(" + ", ".join("named_struct('lat', {}, 'lon', {})".format(*c.replace("e0", "D").split(", ")) for c in _CORNERS) + ")").alias("corners"))
    return regions.points_in_regions(of(_PLACES, "customer"), quads, "s_suppkey").select("c_custkey", "s_suppkey")


_SHEETS = "SELECT s_suppkey AS sheet, CAST(s_suppkey * 7 % 12 AS DOUBLE) * 5e0 AS south, CAST(s_suppkey * 7 % 12 AS DOUBLE) * 5e0 + 20e0 AS north, CAST(s_suppkey * 11 % 34 AS DOUBLE) * 10e0 - 180e0 AS west, CAST(s_suppkey * 11 % 34 AS DOUBLE) * 10e0 - 150e0 AS east, CAST(5 * (1 + s_suppkey % 2) AS DOUBLE) AS lat_interval, CAST(10 * (1 + s_suppkey % 3) AS DOUBLE) AS lon_interval FROM supplier"
_GRATICULE_SQL = f"""WITH s AS ({_SHEETS}),
p AS (SELECT sheet, 'lat' || a AS seg, south + a * lat_interval AS lat, west, east FROM (SELECT *, unnest(range(CAST(floor((north - south) / lat_interval) AS INTEGER) + 1)) AS a FROM s)),
m AS (SELECT sheet, 'lon' || a AS seg, west + a * lon_interval AS lon, south, north FROM (SELECT *, unnest(range(CAST(floor((east - west) / lon_interval) AS INTEGER) + 1)) AS a FROM s)),
g AS (SELECT sheet, seg, b AS pos, lat, west + b AS lon FROM (SELECT *, unnest(range(CAST(east - west AS INTEGER) + 1)) AS b FROM p) UNION ALL SELECT sheet, seg, b, south + b, lon FROM (SELECT *, unnest(range(CAST(north - south AS INTEGER) + 1)) AS b FROM m))
SELECT sheet, seg, CAST(pos AS INTEGER) AS pos, {qs('lat')} AS lat_q, {qs('lon')} AS lon_q FROM g"""


@query("graticule", _GRATICULE_SQL)
def graticule(spark, sf_dir):
    """The graticule of a map sheet for each supplier."""
    spark.read.parquet(f"{sf_dir}/supplier.parquet").createOrReplaceTempView("_tessera_supplier")
    sheets = spark.sql(_SHEETS.replace("FROM supplier", "FROM _tessera_supplier").replace("e0", "D"))
    return vectors.graticules(sheets, "sheet").select("sheet", "seg", "pos", q(F.col("lat")).alias("lat_q"), q(F.col("lon")).alias("lon_q"))


# --- models and accuracy --------------------------------------------------------------------------------------------

PLANE = models.Polynomial(2, 2, (1.5, -0.25, 0.125, 2.0, 0.5, -0.75, 0.0625, 0.25, -0.5))
#: Knots that a spline is fitted to on the driver, at most; more are an error.
KNOTS = 4_000_000
CUBE = models.Spline.fit(range(10), [x**3 for x in range(10)])


@query("polynomial_value", f"SELECT l_orderkey, l_linenumber, {qs('1.5e0 - 0.25e0*y + 0.125e0*y*y + x*(2e0 + 0.5e0*y - 0.75e0*y*y) + x*x*(0.0625e0 + 0.25e0*y - 0.5e0*y*y)', 1e-4)} AS value FROM (SELECT *, lat / 90e0 AS x, lon / 180e0 AS y FROM {POINTS})")
def polynomial_value(spark, sf_dir):
    return points(spark, sf_dir).select(*KEY, q(PLANE.evaluate(F.col("lat") / 90.0, F.col("lon") / 180.0), 1e-4).alias("value"))


@query("polynomial_fit", f"WITH p AS (SELECT lat / 90e0 AS x, v FROM {POINTS}) SELECT {qs('regr_intercept(v, x)', 1e-4)} AS a, {qs('regr_slope(v, x)', 1e-4)} AS b, count(*) AS n, {qs('regr_r2(v, x)', 1e-4)} AS r2 FROM p")
def polynomial_fit(spark, sf_dir):
    p = points(spark, sf_dir).withColumn("x", F.col("lat") / 90.0)
    fit = models.fit_polynomial(p, 1, "x", "v")
    t = models.test_polynomial(p, fit, "x", "v")
    return t.select(*(q(F.lit(c), 1e-4).alias(n) for c, n in zip(fit.coefficients, "ab", strict=True)), "n", q(F.col("r2"), 1e-4).alias("r2"))


@query("spline_value", f"SELECT l_orderkey, l_linenumber, {qs('x * x * x', 1e-4)} AS value FROM (SELECT *, v / 50e0 * 9e0 AS x FROM {POINTS})")
def spline_value(spark, sf_dir):
    """The spline through cubes is the cube."""
    return points(spark, sf_dir).select(*KEY, q(CUBE.evaluate(F.col("v") / 50.0 * 9.0), 1e-4).alias("value"))


@query("spline_join", f"SELECT l_orderkey, l_linenumber, {qs('x * x * x', 1e-4)} AS value FROM (SELECT *, l_partkey * 0.001e0 + 0.0003e0 AS x FROM lineitem)")
def spline_join(spark, sf_dir):
    """A spline whose knots are cubes at the parts' numbers, unevenly: it is the cube. The cubes grow with the parts' numbers until a last
    digit of a double shows in the unit, so they are given as fractions, and their trend is taken off before the fit."""
    keys = spark.read.parquet(f"{sf_dir}/part.parquet").filter("p_partkey % 7 <> 3").select("p_partkey").distinct()
    if keys.count() > KNOTS:
        raise ValueError(f"more than {KNOTS} knots")
    x = [r[0] * 0.001 for r in keys.orderBy("p_partkey").collect()]
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").withColumn("x", F.col("l_partkey") * 0.001 + 0.0003)
    return models.Spline.fit(x, lambda v: Fraction(v) ** 3, trend=True).values(lines, "x").select(*KEY, q(F.col("value"), 1e-4).alias("value"))


_PLANE_TERMS = [(i, j) for i in range(4) for j in range(4)]


@query("polynomial_surface", f"SELECT CAST(count(*) AS BIGINT) AS n, {', '.join(f'CAST({round((i * 7 - j * 5 + 3) * 1e6)} AS BIGINT) AS c{i}{j}' for i, j in _PLANE_TERMS)} FROM lineitem")
def polynomial_surface(spark, sf_dir):
    """Coefficients of a surface of order 3 in two dimensions, found again from its values at the lines' places."""
    p = points(spark, sf_dir).withColumns({"x": F.col("lat") / 90.0, "y": F.col("lon") / 180.0})
    power = models.int_power
    z = sum(((i * 7 - j * 5 + 3) * power(F.col("x"), i) * power(F.col("y"), j) for i, j in _PLANE_TERMS), F.lit(0.0))
    fit = models.fit_polynomial(p.withColumn("z", z), 3, "x", "z", "y")
    return p.agg(F.count("*").alias("n")).select("n", *(q(F.lit(c)).alias(f"c{i}{j}") for c, (i, j) in zip(fit.coefficients, _PLANE_TERMS, strict=True)))


@query("chebyshev_nodes", f"SELECT l_orderkey, l_linenumber, {qs('cos((2 * (l_linenumber - 1) + 1) * pi() / (2 * (l_suppkey % 9 + 7))) * (h - l) / 2 + (h + l) / 2')} AS node FROM (SELECT *, CAST(l_quantity AS DOUBLE) AS h, -CAST(l_partkey % 10 AS DOUBLE) AS l FROM lineitem)")
def chebyshev_nodes(spark, sf_dir):
    """Each line is a node of an interval of its own."""
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").withColumn("i", F.col("l_linenumber") - 1)
    nodes = models.chebyshev_nodes(lines, "i", F.col("l_suppkey") % 9 + 7, -(F.col("l_partkey") % 10).cast("double"), F.col("l_quantity").cast("double"))
    return nodes.select(*KEY, q(F.col("node")).alias("node"))


def _map_accuracy_sql(m: MapDef) -> str:
    s = Ctes("p", [f"p AS (SELECT lat, lon FROM {POINTS} WHERE {T.within(m, Sql('lat'), Sql('lon')).sql})"])
    back = T.geo_of_uv(m, s, *T.map_uv(m, s, Sql("lat"), Sql("lon")))
    e = s.let(geodesy.arc_length(s, Sql("lat"), Sql("lon"), *back))
    return s.query(f"CAST(count(*) AS INTEGER) AS points, CAST(count(*) FILTER ({e.sql} IS NULL) AS INTEGER) AS bad, max({e.sql}) < 1e-3 AS within_a_metre")


@query("map_accuracy", _map_accuracy_sql(MAPS["polar_stereographic_ellipsoid"]))
def map_accuracy(spark, sf_dir):
    """Over the lines' places."""
    r = accuracy.map_accuracy(spark, MAPS["polar_stereographic_ellipsoid"], points=points(spark, sf_dir))
    return r.select(F.col("points").cast("int").alias("points"), F.col("bad").cast("int").alias("bad"), (F.col("max") < 1e-3).alias("within_a_metre"))


@query("map_accuracy_values")
def map_accuracy_values(spark, sf_dir):
    """Errors in kilometres over the lines' places; they are sums of last bits, which differ between engines."""
    names, p = ("azimuthal_equal_area_polar", "mollweide", "polar_stereographic", "sinusoidal", "lambert_conic_conformal_ellipsoid", "transverse_mercator"), points(spark, sf_dir)
    return reduce(DataFrame.unionByName, (accuracy.map_accuracy(spark, MAPS[n], points=p).select(F.lit(n).alias("map"), "points", "bad", "avg", "sd", "max", "at.lat", "at.lon") for n in names))


@query("grid_accuracy_values")
def grid_accuracy_values(spark, sf_dir):
    """Errors in cells, of the cells of rasters."""
    grids = dict(zip(("north", "coarse", "world"), grown(spark, sf_dir, NORTH, COARSE, WORLD), strict=True))
    return reduce(DataFrame.unionByName, (accuracy.grid_accuracy(spark, g, raster(spark, sf_dir, g)).select(F.lit(n).alias("grid"), "points", "bad", "avg", "sd", "max", "at.row", "at.col") for n, g in grids.items()))


def _grid_accuracy_sql(g: GridDef) -> str:
    s = Ctes("c0", [ZOOM_SQL, f"c0 AS (SELECT {coarse('CAST(i AS DOUBLE)')} AS fi, {coarse('CAST(j AS DOUBLE)')} AS fj FROM {raster_sql(g)})"])
    lat, lon, ok = T.geo_of_place(g, s, Sql("fj"), Sql("fi"))
    r, t, _ = T.grid_place(g, s, lat, lon)
    e = s.let(T.flat_distance(r, t, Sql("fj"), Sql("fi")))
    return s.query(f"CAST(count(*) AS INTEGER) AS points, CAST(count(*) FILTER ({e.sql} IS NULL) AS INTEGER) AS bad, max({e.sql}) < 1e-9 AS exact") + f" WHERE {ok.sql}"


@query("grid_accuracy", _grid_accuracy_sql(NORTH))
def grid_accuracy(spark, sf_dir):
    (north,) = grown(spark, sf_dir, NORTH)
    r = accuracy.grid_accuracy(spark, north, raster(spark, sf_dir, north))
    return r.select(F.col("points").cast("int").alias("points"), F.col("bad").cast("int").alias("bad"), (F.col("max") < 1e-9).alias("exact"))


_EVENTS = """(SELECT CAST(user_id * 7919 % 179000 AS DOUBLE) / 1000e0 - 89.4863e0 AS lat, CAST((user_id * 611953 + 17) % 359000 AS DOUBLE) / 1000e0 - 179.4863e0 AS lon, 1e0 AS v FROM events)"""
_S = Ctes("p", [f"p AS (SELECT * FROM {_EVENTS} WHERE {T.within(NORTH.map, Sql('lat'), Sql('lon')).sql})"])
_r, _s2, _on = T.grid_place(NORTH, _S, Sql("lat"), Sql("lon"))
_STREAM_SQL = with_sql([*_S.ctes, f"k AS (SELECT {TRUNC.format(f'{_s2.sql} + 0.5e0')} AS i, {TRUNC.format(f'{_r.sql} + 0.5e0')} AS j FROM {_S.last} WHERE {finite(_r).sql})"], f"SELECT i AS cell_row, j AS cell_col, count(*) AS n FROM k WHERE i BETWEEN 0 AND {NORTH.rows - 1} AND j BETWEEN 0 AND {NORTH.cols - 1} GROUP BY i, j")


@query("stream_grid", _STREAM_SQL)
def stream_grid(spark, sf_dir):
    """The events table as a stream of points, gridded incrementally."""
    from .streaming.gridding import run_to_memory, stream_sums

    path = f"{sf_dir}/events.parquet"
    schema = spark.read.parquet(path).schema
    events = spark.readStream.schema(schema).parquet(f"{sf_dir}/event[s].parquet")
    p = events.select(
        ((F.col("user_id") * 7919 % 179000).cast("double") / 1000.0 - 89.4863).alias("lat"), (((F.col("user_id") * 611953 + 17) % 359000).cast("double") / 1000.0 - 179.4863).alias("lon"), F.lit(1.0).alias("value")
    )
    run_to_memory(stream_sums(p, NORTH, "bucket", radius=0.4), "tessera_stream_grid")
    return spark.table("tessera_stream_grid").select(F.col("row").alias("cell_row"), F.col("col").alias("cell_col"), "n")


@query("stream_state", _STREAM_SQL.replace("count(*) AS n FROM k", "CAST(count(*) AS DOUBLE) AS total FROM k"))
def stream_state(spark, sf_dir):
    """The events as a stream into a state table that stays between runs; the last batch is sent twice."""
    from .operators.gridding import accumulate
    from .streaming.states import StateTable, run_into

    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    events = spark.readStream.schema(schema).parquet(f"{sf_dir}/event[s].parquet")
    place = lambda c, a, b, m: ((c * a + b) % m).cast("double") / 1000.0 - (m / 2000 - 0.0137)
    p = events.select(place(F.col("user_id"), 7919, 0, 179000).alias("lat"), place(F.col("user_id"), 611953, 17, 359000).alias("lon"), F.lit(1.0).alias("value"))
    state = lambda df: accumulate(df, NORTH, method="bucket", radius=0.4).select("row", "col", F.col("num"), F.col("den").alias("beta"))
    table = StateTable(spark, new_folder(spark, "state"), "bucket")
    run_into(p, table, state, new_folder(spark, "stream"))
    run_into(p, table, state, new_folder(spark, "stream"))  # its first batch has the number of one that is in
    return table.read().select(F.col("row").alias("cell_row"), F.col("col").alias("cell_col"), F.col("num").alias("total"))
