"""Coordinate transforms: geographic (lat, lon), map (u, v) and grid (col, row) coordinates.

Each formula takes steps (functions.scalar), so the same definition makes columns of a DataFrame, text for a SQL engine
or numbers. A coordinate that can't be told is NULL.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.projections import forward_xy, inverse_xy
from ..functions.scalar import Now, Steps, absolute, both, div, either, finite, normal_lon, radians, sqrt, where
from ..plans.definitions import GridDef, MapDef


def within(m: MapDef, lat, lon):
    """Whether a point is in the bounds of the map; longitudes may straddle the date line."""
    lon = normal_lon(lon)
    in_lon = either(lon <= m.east, lon >= m.west) if m.straddles else both(lon >= m.west, lon <= m.east)
    return both(both(lat >= m.south, lat <= m.north), in_lon)


def ellipsoid_distance(m: MapDef, s, lat1, lon1, lat2, lon2):
    """Distance in map units on the ellipsoid (Meeus, Astronomical Algorithms, 11)."""
    ff, gg, ll = _square(s, lat1 + lat2), _square(s, lat1 - lat2), _square(s, lon1 - lon2)
    S = s.let(gg * (1 - ll) + (1 - ff) * ll)
    C = s.let((1 - gg) * (1 - ll) + ff * ll)
    w = s.let(s.atan(sqrt(div(S, C))))
    r = s.let(div(sqrt(S * C), w))
    d = 2 * w * m.Rg
    if m.flattening:
        d = d * (1 + m.flattening * div(3 * r - 1, 2 * C) * ff * (1 - gg) - m.flattening * div(3 * r + 1, 2 * S) * (1 - ff) * gg)
    return where(absolute(w) > 1e-12, d, 0.0)


def _square(s, v):
    """sin^2 of half an angle in degrees."""
    h = s.let(s.sin(radians(v) / 2))
    return s.let(h * h)


def flat_distance(x1, y1, x2, y2):
    return sqrt((x1 - x2) * (x1 - x2) + (y1 - y2) * (y1 - y2))


def map_xy(m: MapDef, s, lat, lon):
    """x, y; missing where the way back misses the point by more than the map's maximum error."""
    x, y = forward_xy(m.math, s, lat, lon)
    if m.maximum_error:
        lat2, lon2 = inverse_xy(m.math, s, x, y)
        near = s.let(ellipsoid_distance(m, s, lat, lon, lat2, lon2))
        ok = s.let(both(finite(near), near <= m.maximum_error))
        x, y = s.let(where(ok, x, None)), s.let(where(ok, y, None))
    return x, y


def geo_of_xy(m: MapDef, s, x, y):
    lat, lon = inverse_xy(m.math, s, x, y)
    if m.maximum_error:
        x2, y2 = forward_xy(m.math, s, lat, lon)
        near = s.let(flat_distance(x, y, x2, y2))
        ok = s.let(both(finite(near), near <= m.maximum_error))
        lat, lon = s.let(where(ok, lat, None)), s.let(where(ok, lon, None))
    return lat, lon


def map_uv(m: MapDef, s, lat, lon):
    """u, v: x, y turned by the map's rotation and moved to its origin."""
    x, y = map_xy(m, s, lat, lon)
    c, t, u0, v0 = m.rotated_origin
    return s.let(c * x + t * y - u0), s.let(c * y - t * x - v0)


def geo_of_uv(m: MapDef, s, u, v):
    c, t, u0, v0 = m.rotated_origin
    return geo_of_xy(m, s, s.let(c * (u + u0) - t * (v + v0)), s.let(t * (u + u0) + c * (v + v0)))


def _wrapped(g: GridDef, u):
    w = g.half_width
    return where(u > w, u - 2 * w, where(u < -w, u + 2 * w, u)) if w else u


def grid_place(g: GridDef, s, lat, lon):
    """Column and row (fractions of cells; off the grid too) and whether they are on the grid. A grid that is cut finer has the places
    of the grid it is cut from, to the last bit."""
    if g.cut:
        whole, factor = g.cut
        col, row, on = grid_place(whole, s, lat, lon)
        return *(s.let((c + 0.5) * float(factor) - 0.5) for c in (col, row)), on
    u, v = map_uv(g.map, s, lat, lon)
    col = s.let(g.origin_col + _wrapped(g, u) * g.cols_per_unit)
    row = s.let(g.origin_row - v * g.rows_per_unit)
    on = both(both(col >= -0.5, col < g.cols - 0.5), both(row >= -0.5, row < g.rows - 0.5))
    return col, row, s.let(both(finite(col), on))


def geo_of_place(g: GridDef, s, col, row):
    """lat, lon of a place on the grid, and whether they are within the map."""
    if g.cut:
        whole, factor = g.cut
        return geo_of_place(whole, s, *(s.let((c + 0.5) / float(factor) - 0.5) for c in (col, row)))
    u = s.let(_wrapped(g, (col - g.origin_col) / g.cols_per_unit))
    lat, lon = geo_of_uv(g.map, s, u, (g.origin_row - row) / g.rows_per_unit)
    return lat, lon, s.let(both(finite(lat), within(g.map, lat, lon)))


def _apply(df: DataFrame, formula, given: tuple[str, str], out: tuple[str, ...]) -> DataFrame:
    s = Steps(df.withColumns({f"_g{k}": F.col(c).cast("double") for k, c in enumerate(given)}))
    values = formula(s, F.col("_g0"), F.col("_g1"))
    kept = [c for c in df.columns if c not in out]
    return s.df.select(*kept, *(v.alias(c) for v, c in zip(values, out, strict=False)))


def only(df: DataFrame, flag: str, columns: list[str]) -> DataFrame:
    """Rows where flag holds, without it. The columns go through a generator: a plain filter, or one that a join infers,
    would be pushed below the steps of their formulas and repeat every step in the next, without bound."""
    others = [c for c in df.columns if c not in (*columns, flag)]
    return df.select(*others, F.explode(F.when(F.col(flag), F.array(F.struct(*columns)))).alias("_only")).select(*others, "_only.*")


def with_xy(df: DataFrame, m: MapDef, lat="lat", lon="lon", out=("x", "y")) -> DataFrame:
    """df with x, y, unrotated."""
    return _apply(df, lambda s, a, b: map_xy(m, s, a, b), (lat, lon), out)


def with_geo_of_xy(df: DataFrame, m: MapDef, x="x", y="y", out=("lat", "lon")) -> DataFrame:
    return _apply(df, lambda s, a, b: geo_of_xy(m, s, a, b), (x, y), out)


def with_uv(df: DataFrame, m: MapDef, lat="lat", lon="lon", out=("u", "v")) -> DataFrame:
    """df with map coordinates u, v."""
    return _apply(df, lambda s, a, b: map_uv(m, s, a, b), (lat, lon), out)


def with_geo_of_uv(df: DataFrame, m: MapDef, u="u", v="v", out=("lat", "lon")) -> DataFrame:
    return _apply(df, lambda s, a, b: geo_of_uv(m, s, a, b), (u, v), out)


def with_place(df: DataFrame, g: GridDef, lat="lat", lon="lon", out=("col", "row", "on_grid")) -> DataFrame:
    """df with grid coordinates and whether they are on the grid."""
    return _apply(df, lambda s, a, b: grid_place(g, s, a, b), (lat, lon), out)


def with_geo(df: DataFrame, g: GridDef, col="col", row="row", out=("lat", "lon", "in_map")) -> DataFrame:
    """df with lat, lon of grid coordinates and whether they are within the map."""
    return _apply(df, lambda s, a, b: geo_of_place(g, s, a, b), (col, row), out)


def filter_within(df: DataFrame, m: MapDef, lat="lat", lon="lon") -> DataFrame:
    """Rows in the bounds of the map: a filter on plain columns, which a scan takes."""
    return df.filter(within(m, F.col(lat), F.col(lon)))


def point_xy(m: MapDef, lat: float, lon: float) -> tuple[float, float]:
    """u, v of one point, on the driver."""
    return map_uv(m, Now(), float(lat), float(lon))


def point_geo(m: MapDef, u: float, v: float) -> tuple[float, float]:
    return geo_of_uv(m, Now(), float(u), float(v))


def point_place(g: GridDef, lat: float, lon: float) -> tuple[float, float, bool]:
    return grid_place(g, Now(), float(lat), float(lon))


def place_geo(g: GridDef, col: float, row: float) -> tuple[float, float, bool]:
    return geo_of_place(g, Now(), float(col), float(row))

