"""Spherical and ellipsoidal geometry of points, for floats, Columns and SQL text (see scalar). Angles in degrees."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .scalar import absolute, both, clamp, degrees, div, either, normal_lon, radians, sqrt, where

#: Radius of the authalic sphere (km), and ten times the spacing of doubles at 1.
RADIUS_KM, TINY = 6371.228, 10 * 2.0**-52


def arc_length(s, lat1, lon1, lat2, lon2, radius: float = RADIUS_KM):
    """Length of the great circle arc (by its cosine), in units of the radius."""
    p1, p2, dl = s.let(radians(lat1)), s.let(radians(lat2)), radians(lon1) - radians(lon2)
    c = s.let(s.cos(p1) * s.cos(p2) * s.cos(dl) + s.sin(p1) * s.sin(p2))
    return where(both(lat1 == lat2, lon1 == lon2), 0.0, radius * s.acos(clamp(c)))


def west_azimuth(s, lat1, lon1, lat2, lon2):
    """Direction from point 1 to point 2, west of north; 0 where its cosine vanishes."""
    p1, p2, dl = s.let(radians(lat1)), s.let(radians(lat2)), s.let(radians(lon1 - lon2))
    c = s.let(s.cos(p1) * s.sin(p2) - s.sin(p1) * s.cos(p2) * s.cos(dl))
    return where(c == 0, 0.0, degrees(s.atan2(s.cos(p2) * s.sin(dl), c)))


def unit_vector(s, lat, lon):
    phi, lam = s.let(radians(lat)), s.let(radians(lon))
    return s.let(s.cos(phi) * s.cos(lam)), s.let(s.cos(phi) * s.sin(lam)), s.let(s.sin(phi))


def bisect(s, lat1, lon1, lat2, lon2):
    """lat, lon of the middle of the arc; missing for opposite points."""
    x, y, z = (s.let(a + b) for a, b in zip(unit_vector(s, lat1, lon1), unit_vector(s, lat2, lon2), strict=True))
    d = s.let(sqrt(x * x + y * y + z * z))
    lat = 90.0 - degrees(s.acos(clamp(div(z, d))))
    return where(d >= TINY, lat, None), where(d >= TINY, degrees(s.atan2(y, x)), None)


def ellipsoid_radius(sin_lat, cos_lat, a2: float, b2: float):
    """Radius at a geocentric latitude, for squared semi-axes."""
    return sqrt(a2 * b2 / (a2 * sin_lat * sin_lat + b2 * cos_lat * cos_lat))


def rectangular(s, lat, lon, a2: float = 1.0, b2: float = 1.0):
    """x, y, z of a geographic position on an ellipsoid of squared semi-axes a2, b2."""
    pole, lam = s.let(absolute(lat) == 90), s.let(radians(lon))
    phi = s.let(s.atan(b2 / a2 * s.tan(radians(where(pole, 0.0, lat)))))
    r = s.let(ellipsoid_radius(s.sin(phi), s.cos(phi), a2, b2))
    z = where(lat > 0, b2**0.5, -(b2**0.5))
    return where(pole, 0.0, r * s.cos(phi) * s.cos(lam)), where(pole, 0.0, r * s.cos(phi) * s.sin(lam)), where(pole, z, r * s.sin(phi))


def _turn(s, p, q, r):
    """Sign of the scalar triple product of three vectors: 1 if r lies left of the arc from p to q."""
    v = s.let(p[0] * (q[1] * r[2] - q[2] * r[1]) + p[1] * (q[2] * r[0] - q[0] * r[2]) + p[2] * (q[0] * r[1] - q[1] * r[0]))
    return s.let(where(v >= TINY, 1.0, where(v <= -TINY, -1.0, 0.0)))


def within_polygon(s, point, corners):
    """Whether a vector lies in a convex polygon whose corners run clockwise, its edges included."""
    inside = True
    for a, b in zip([corners[-1], *corners[:-1]], corners, strict=True):
        inside = both(inside, _turn(s, point, a, b) <= 0)
    return inside


def within_box(s, lat, lon, box: list[tuple]):
    """Whether a point lies in a spherical quadrangle of (lat, lon) corners, clockwise, with one reflex corner at most
    (which splits it into two triangles)."""
    p, c = rectangular(s, lat, lon), [rectangular(s, a, b) for a, b in box]
    out = within_polygon(s, p, c)
    for k in reversed(range(4)):  # the first reflex corner counts: it is tested last
        reflex = _turn(s, c[k - 1], c[k], c[(k + 1) % 4]) > 0
        halves = either(within_polygon(s, p, [c[k], c[(k + 1) % 4], c[(k + 2) % 4]]), within_polygon(s, p, [c[k], c[(k + 2) % 4], c[k - 1]]))
        out = _choose(reflex, halves, out)
    return out


def _choose(cond, a, b):
    """a where cond, else b, for conditions."""
    no = F.coalesce(~cond, F.lit(True)) if isinstance(cond, Column) else where(cond, False, True)
    return either(both(cond, a), both(no, b))


def lat_lon_of_text(c: Column) -> Column:
    """STRUCT<lat, lon> of text: ``dd mm N ddd mm W``, ``dd.d N ddd.d W`` or two signed numbers; NULL for anything else."""
    number = r"[-+]?\d+(?:\.\d*)?"

    def value(pattern: str, first: int, minutes: bool, letter: int | None) -> Column:
        get = lambda i: F.regexp_extract(c, pattern, i)
        v = get(first).try_cast("double")
        v = v + get(first + 1).try_cast("double") / 60 if minutes else v
        return v if letter is None else F.when(F.upper(get(letter)).isin("S", "W"), -v).otherwise(v)

    both_ = rf"^\s*({number})\s+({number})\s*([NSns])[\s,]+({number})\s+({number})\s*([EWew])\s*$"
    one = rf"^\s*({number})\s*([NSns])[\s,]+({number})\s*([EWew])\s*$"
    plain = rf"^\s*({number})[\s,]+({number})\s*$"
    pair = lambda a, b: F.struct(a.alias("lat"), normal_lon(b).alias("lon"))
    return (
        F.when(c.rlike(both_), pair(value(both_, 1, True, 3), value(both_, 4, True, 6)))
        .when(c.rlike(one), pair(value(one, 1, False, 2), value(one, 3, False, 4)))
        .when(c.rlike(plain), pair(value(plain, 1, False, None), value(plain, 2, False, None)))
    )
