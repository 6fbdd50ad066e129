"""Forward projections against textbook formulas, written by hand as DuckDB SQL in other forms than those of the library.

Inverse formulas are held against the forward ones by the errors of going there and back (test_published_accuracy).
"""

import duckdb
import numpy as np
import pytest

from tessera import queries as Q
from tessera.operators import transform as T

from .test_rasters import SF

RAD = "radians(lat) AS phi, radians(((lon - ({lon0}) + 540) % 360) - 180) AS lam, radians({lat0}) AS phi0, radians({lat1}) AS phi1, {R} AS R, {e} AS e"
#: Authalic q, m and t of a latitude on the ellipsoid.
MACROS = """
CREATE MACRO q(e, p) AS (1 - e * e) * (sin(p) / (1 - e * e * sin(p) * sin(p)) + atanh(e * sin(p)) / e);
CREATE MACRO m(e, p) AS cos(p) / sqrt(1 - e * e * sin(p) * sin(p));
CREATE MACRO t(e, p) AS exp(-asinh(tan(p)) + e * atanh(e * sin(p)));
"""
CHORD = "sqrt(2 / (1 + sin(phi0) * sin(phi) + cos(phi0) * cos(phi) * cos(lam)))"
LIFT = "(cos(phi0) * sin(phi) - sin(phi0) * cos(phi) * cos(lam))"
AUTHALIC = "asin(q(e, {p}) / q(e, pi() / 2))"
#: x and y by map.
FORMULAS = {
    "azimuthal_equal_area": (f"R * {CHORD} * cos(phi) * sin(lam)", f"R * {CHORD} * {LIFT}"),
    "azimuthal_equal_area_polar": ("R * sqrt(2 * (1 - sin(phi))) * sin(lam)", "-R * sqrt(2 * (1 - sin(phi))) * cos(lam)"),
    "cylindrical_equal_area": ("R * lam * cos(phi1)", "R * sin(phi) / cos(phi1)"),
    "cylindrical_equal_area_ellipsoid": ("R * lam * m(e, phi1)", "R * q(e, phi) / (2 * m(e, phi1))"),
    "cylindrical_equidistant": ("R * lam * cos(phi1)", "R * phi"),
    "mercator": ("R * lam", "R * asinh(tan(phi))"),
    "orthographic": ("R * cos(phi) * sin(lam)", f"R * {LIFT}"),
    "polar_stereographic": ("R * (1 + sin(phi1)) * tan(pi() / 4 - phi / 2) * sin(lam)", "-R * (1 + sin(phi1)) * tan(pi() / 4 - phi / 2) * cos(lam)"),
    "polar_stereographic_ellipsoid": ("R * m(e, -phi1) * t(e, -phi) / t(e, -phi1) * sin(lam)", "R * m(e, -phi1) * t(e, -phi) / t(e, -phi1) * cos(lam)"),
    "sinusoidal": ("R * lam * cos(phi)", "R * phi"),
    "transverse_mercator": ("0.9996 * R * atanh(cos(phi) * sin(lam))", "0.9996 * R * (atan2(tan(phi), cos(lam)) - phi0)"),
}
N = "((sin(phi0) + sin(phi1)) / 2)"
RHO = f"(R * sqrt(cos(phi0) * cos(phi0) + 2 * {N} * (sin(phi0) - sin({{p}}))) / {N})"
NE = "((m(e, phi0) * m(e, phi0) - m(e, phi1) * m(e, phi1)) / (q(e, phi1) - q(e, phi0)))"
RHOE = f"(R * sqrt(m(e, phi0) * m(e, phi0) + {NE} * (q(e, phi0) - q(e, {{p}}))) / {NE})"
NC = "(ln(m(e, phi0) / m(e, phi1)) / ln(t(e, phi0) / t(e, phi1)))"
RHOC = f"(R * m(e, phi0) / {NC} * pow(t(e, {{p}}) / t(e, phi0), {NC}))"
for _name, _n, _rho, _middle in (("albers_conic_equal_area", N, RHO, 23), ("albers_conic_equal_area_ellipsoid", NE, RHOE, -23), ("lambert_conic_conformal_ellipsoid", NC, RHOC, 23)):
    _at = _rho.format(p="phi")
    FORMULAS[_name] = (f"{_at} * sin({_n} * lam)", f"{_rho.format(p=f'radians({_middle})')} - {_at} * cos({_n} * lam)")
_B, _B0 = AUTHALIC.format(p="phi"), AUTHALIC.format(p="phi0")
_D = f"(m(e, phi0) / (sqrt(q(e, pi() / 2) / 2) * cos({_B0})))"
_K = f"(R * sqrt(q(e, pi() / 2) / (1 + sin({_B0}) * sin({_B}) + cos({_B0}) * cos({_B}) * cos(lam))))"
FORMULAS["azimuthal_equal_area_ellipsoid"] = (f"{_K} * {_D} * cos({_B}) * sin(lam)", f"{_K} / {_D} * (cos({_B0}) * sin({_B}) - sin({_B0}) * cos({_B}) * cos(lam))")


@pytest.mark.parametrize("name", FORMULAS)
def test_forward(spark, name):
    m, (x, y) = Q.MAPS[name], FORMULAS[name]
    p = T.filter_within(Q.points(spark, SF), m).where(f"abs(lon - ({m.lon0})) <= 180 OR '{name}' NOT LIKE '%conic%'")  # cones are cut where the map is
    got = T.with_xy(p.select("lat", "lon"), m).filter("x IS NOT NULL").toPandas()
    con = duckdb.connect()
    con.execute(MACROS)
    given = RAD.format(lon0=m.lon0, lat0=m.lat0, lat1=m.lat1, R=repr(m.equatorial_radius / m.scale), e=repr(float(m.eccentricity or 0)))
    want = con.execute(f"SELECT {x} AS x, {y} AS y FROM (SELECT {given} FROM got)").df()
    size = m.equatorial_radius / m.scale
    assert len(got) > (400 if m.west > -180 else 1500)
    far = (np.abs(got.x) + np.abs(got.y)) / size
    for k in "xy":
        assert np.abs(got[k] - want[k]).max() / size < 1e-9 * max(1, far.max()), (name, k)
