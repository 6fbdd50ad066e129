"""Nineteen map projections, after Snyder's "Map Projections: A Working Manual" (USGS Professional Paper 1395).

A projection is made of a map definition on the driver, where its constants become numbers. ``forward(s, lat, lon)`` gives
x, y and ``inverse(s, x, y)`` gives lat, lon in degrees, before false easting and northing; s takes steps (scalar.Now,
Steps or Ctes). A third value says where the result holds.

Deviations from the textbook are results that users of these definitions rely on: see QUIRKS.
"""

from __future__ import annotations

from math import pi

from .scalar import Now, absolute, asin, both, clamp, cos, degrees, div, either, finite, floor, ln, normal_lon, normal_rad, power, radians, sign, sin, sqrt, tan, trunc, where

#: Deviations, each with a test.
QUIRKS = {
    "transverse_mercator_constants": "ellipsoidal series constants 0.1178175, 83/48 and 1097*64; strict=True takes 15/128, 29/6 and 1097/64 as derived",
    "polar_scale": "polar stereographic on the ellipsoid with true scale at the pole ignores the map scale",
    "isin_offset": "integerized sinusoidal adds false easting and northing twice, consistently",
    "cylindrical_default": "the ellipsoidal cylindrical equal-area has no default second latitude",
    "homolosine_lon0": "the interrupted homolosine ignores the reference longitude",
}

UNSET = 999.0


class Projection:
    def __init__(self, d):
        self.d, self.R = d, d.equatorial_radius / d.scale

    def lam(self, lon):
        return radians(lon - self.d.lon0)

    def lam_normal(self, lon):
        return radians(normal_lon(lon - self.d.lon0))

    def lon(self, s, lam):
        return normal_lon(s.part(degrees(lam) + self.d.lon0))


def missing(x):
    return where(x == x, None, None)


class AzimuthalEqualArea(Projection):
    def __init__(self, d):
        super().__init__(d)
        self.s1, self.c1 = sin(radians(d.lat0)), cos(radians(d.lat0))

    def forward(self, s, lat, lon):
        phi, lam = s.let(radians(lat)), s.let(self.lam(lon))
        if abs(self.d.lat0) == 90:
            south = self.d.lat0 < 0
            rho = s.let(2 * self.R * (s.cos if south else s.sin)(pi / 4 - phi / 2))
            return rho * s.sin(lam), rho * s.cos(lam) * (1.0 if south else -1.0), True
        k = s.let(self.R * sqrt(div(2.0, 1 + self.s1 * s.sin(phi) + self.c1 * s.cos(phi) * s.cos(lam))))
        return k * s.cos(phi) * s.sin(lam), k * (self.c1 * s.sin(phi) - self.s1 * s.cos(phi) * s.cos(lam)), True

    def inverse(self, s, x, y):
        rho = s.let(sqrt(x * x + y * y))
        c = s.let(2 * s.asin(rho / (2 * self.R)))
        centre = rho == 0
        phi = where(centre, radians(self.d.lat0), s.asinz(s.cos(c) * self.s1 + div(y * s.sin(c) * self.c1, rho)))
        if abs(self.d.lat0) == 90:
            lam = s.atan2(x, y if self.d.lat0 < 0 else -y)
        else:
            lam = s.atan2(x * s.sin(c), rho * self.c1 * s.cos(c) - y * self.s1 * s.sin(c))
        return degrees(phi), self.lon(s, where(centre, 0.0, lam)), True


def _q(e, sin_phi, s=Now()):  # noqa: B008
    """Authalic q of Snyder 3-12."""
    return (1 - e * e) * (sin_phi / (1 - e * e * sin_phi * sin_phi) - s.ln((1 - e * sin_phi) / (1 + e * sin_phi)) / (2 * e))


def _phi_of_q(s, e, q):
    """Latitude of q: Snyder's series 3-18 and steps of 3-16, each of which doubles the digits that are right. Up to an
    eccentricity of 0.15 the series is 1e-7 off at most, and further steps are few as well. Within 1e-6 of the pole's q it
    is the pole."""
    e2 = e * e
    at_pole = s.let(absolute(absolute(q) - _q(e, 1.0)) < 1e-6)
    beta = s.let(s.asinz(q / _q(e, 1.0)))
    e4, e6 = e2 * e2, e2**3
    phi = s.let(beta + (e2 / 3 + 31 * e4 / 180 + 517 * e6 / 5040) * s.sin(2 * beta) + (23 * e4 / 360 + 251 * e6 / 3780) * s.sin(4 * beta) + 761 * e6 / 45360 * s.sin(6 * beta))
    for _ in range(2 if e < 0.15 else 4 if e < 0.5 else 12):
        sp, c = s.let(s.sin(phi)), s.cos(phi)
        w = s.let(1 - e2 * sp * sp)
        phi = s.let(phi + w * w * div(1.0, 2 * c) * (q / (1 - e2) - sp / w + s.ln((1 - e * sp) / (1 + e * sp)) / (2 * e)))
    return where(at_pole, sign(q) * pi / 2, phi)


class AzimuthalEqualAreaEllipsoid(Projection):
    def __init__(self, d):
        super().__init__(d)
        e = self.e = d.eccentricity
        self.s1, self.c1 = sin(radians(d.lat0)), cos(radians(d.lat0))
        self.qp = _q(e, 1.0) if e else 2.0
        q1 = _q(e, self.s1) if e else 2.0
        self.Rq = self.R * sqrt(self.qp / 2)
        beta1 = radians(90.0) * sign(q1 / self.qp) if abs(q1) >= abs(self.qp) else asin(q1 / self.qp)
        self.sb, self.cb = sin(beta1), cos(beta1)
        m1 = self.c1 / sqrt(1 - e * e * self.s1 * self.s1)
        self.D = self.R * m1 / (self.Rq * self.cb)
        self.sphere = AzimuthalEqualArea(d)

    def forward(self, s, lat, lon):
        if not self.e:  # q divides by e: no result on a sphere
            return missing(lat), missing(lon), False
        lam = s.let(self.lam(lon))
        q = s.let(_q(self.e, s.let(s.sin(radians(lat))), s))
        if abs(self.d.lat0) == 90:
            at = self.qp - q if self.d.lat0 > 0 else self.qp + q
            rho = s.let(where(absolute(at) < 1e-6, 0.0, self.R * sqrt(where(at < 0, None, at))))
            return rho * s.sin(lam), rho * s.cos(lam) * (-1.0 if self.d.lat0 > 0 else 1.0), True
        beta = s.let(s.asinz(q / self.qp))
        b = s.let(self.Rq * sqrt(div(2.0, 1 + self.sb * s.sin(beta) + self.cb * s.cos(beta) * s.cos(lam))))
        return b * self.D * s.cos(beta) * s.sin(lam), b / self.D * (self.cb * s.sin(beta) - self.sb * s.cos(beta) * s.cos(lam)), True

    def inverse(self, s, x, y):
        if not self.e:
            return self.sphere.inverse(s, x, y)
        if abs(self.d.lat0) != 90:
            rho = s.let(sqrt((x / self.D) * (x / self.D) + self.D * y * self.D * y))
            ce = s.let(2 * s.asin(rho / (2 * self.Rq)))
            lam = s.atan2(x * s.sin(ce), self.D * rho * self.cb * s.cos(ce) - self.D * self.D * y * self.sb * s.sin(ce))
            q = where(absolute(rho) < 1e-6, self.qp * self.sb, self.qp * (s.cos(ce) * self.sb + div(self.D * y * s.sin(ce) * self.cb, rho)))
        else:
            g = 1.0 if self.d.lat0 > 0 else -1.0
            ce = s.let(sqrt(x * x + y * y) / self.R)
            lam, q = s.atan2(x, -g * y), g * (self.qp - ce * ce)
        lam = s.let(lam)
        return degrees(_phi_of_q(s, self.e, s.let(q))), self.lon(s, lam), True


class CylindricalEqualArea(Projection):
    def __init__(self, d):
        super().__init__(d)
        self.k = cos(radians(30.0 if d.lat1 == UNSET else d.lat1))

    def forward(self, s, lat, lon):
        return self.R * s.let(self.lam_normal(lon)) * self.k, self.R * s.sin(radians(lat)) / self.k, True

    def inverse(self, s, x, y):
        return degrees(s.asin(y * self.k / self.R)), self.lon(s, x / (self.R * self.k)), True


class CylindricalEqualAreaEllipsoid(Projection):
    def __init__(self, d):
        super().__init__(d)
        e, s1 = d.eccentricity, sin(radians(d.lat1))
        self.k = cos(radians(d.lat1)) / sqrt(1 - e * e * s1 * s1)
        self.qp = _q(e, 1.0) if e else 2.0

    def forward(self, s, lat, lon):
        q = _q(self.d.eccentricity, s.let(s.sin(radians(lat))), s)
        return self.R * self.k * s.let(self.lam_normal(lon)), self.R * q / (2 * self.k), True

    def inverse(self, s, x, y):
        e2 = self.d.eccentricity**2
        e4, e6 = e2 * e2, e2**3
        b = s.let(s.asin(2 * y * self.k / (self.R * self.qp)))
        phi = b + (e2 / 3 + 31 * e4 / 180 + 517 * e6 / 5040) * s.sin(2 * b) + (23 * e4 / 360 + 251 * e6 / 3780) * s.sin(4 * b) + 761 * e6 / 45360 * s.sin(6 * b)
        return degrees(phi), self.lon(s, x / (self.R * self.k)), True


class CylindricalEquidistant(Projection):
    def __init__(self, d):
        super().__init__(d)
        self.k = cos(radians(0.0 if d.lat1 == UNSET else d.lat1))

    def forward(self, s, lat, lon):
        return self.R * s.let(self.lam_normal(lon)) * self.k, self.R * radians(lat), True

    def inverse(self, s, x, y):
        return degrees(y / self.R), self.lon(s, x / (self.R * self.k)), True


class Mercator(Projection):
    def forward(self, s, lat, lon):
        return self.R * s.let(self.lam_normal(lon)), self.R * s.ln(s.let(s.tan(pi / 4 + radians(lat) / 2))), True

    def inverse(self, s, x, y):
        return degrees(pi / 2 - 2 * s.atan(s.exp(-y / self.R))), self.lon(s, x / self.R), True


class Mollweide(Projection):
    def forward(self, s, lat, lon):
        phi = s.let(radians(lat))
        psi, theta = s.let(pi * s.sin(phi)), phi
        for _ in range(10):  # Newton's steps from phi; 0.1 degrees from a pole ten are not enough, and results show it
            theta = s.let(theta - div(theta + s.sin(theta) - psi, 1 + s.cos(theta)))
        theta = s.let(where(absolute(s.cos(phi)) > 1e-6, theta / 2, phi))
        return 2 * 2**0.5 / pi * self.R * s.let(self.lam_normal(lon)) * s.cos(theta), 2**0.5 * self.R * s.sin(theta), True

    def inverse(self, s, x, y):
        theta = s.let(s.asin(y / (2**0.5 * self.R)))
        phi = s.asinz((2 * theta + s.sin(2 * theta)) / pi)
        lam = where(s.cos(theta) == 0, 0.0, div(pi * x, 2 * 2**0.5 * self.R * s.cos(theta)))
        return degrees(phi), self.lon(s, lam), True


class Orthographic(AzimuthalEqualArea):
    def forward(self, s, lat, lon):
        phi, lam = s.let(radians(lat)), s.let(self.lam(lon))
        near = self.s1 * s.sin(phi) + self.c1 * s.cos(phi) * s.cos(lam)
        return self.R * s.cos(phi) * s.sin(lam), self.R * (self.c1 * s.sin(phi) - self.s1 * s.cos(phi) * s.cos(lam)), near >= 0

    def inverse(self, s, x, y):
        rho = s.let(sqrt(x * x + y * y))
        sb = s.let(rho / self.R)
        cb = s.let(sqrt(1 - sb * sb))
        centre = rho == 0
        phi = where(centre, radians(self.d.lat0), s.asinz(cb * self.s1 + div(y * sb * self.c1, rho)))
        if abs(self.d.lat0) == 90:
            lam = s.atan2(x, y if self.d.lat0 < 0 else -y)
        else:
            lam = s.atan2(x * sb, rho * self.c1 * cb - y * self.s1 * sb)
        return degrees(phi), self.lon(s, where(centre, 0.0, lam)), sb <= 1


def _conformal(s, e, chi):
    """What a latitude is above its conformal latitude chi, by Snyder's series 3-5."""
    e2 = e * e
    e4, e6, e8 = e2**2, e2**3, e2**4
    return (
        s.sin(2 * chi) * (e2 / 2 + 5 * e4 / 24 + e6 / 12 + 13 * e8 / 360)
        + s.sin(4 * chi) * (7 * e4 / 48 + 29 * e6 / 240 + 811 * e8 / 11520)
        + s.sin(6 * chi) * (7 * e6 / 120 + 81 * e8 / 1120)
        + s.sin(8 * chi) * (4279 * e8 / 161280)
    )


class PolarStereographic(Projection):
    def __init__(self, d):
        super().__init__(d)
        if abs(d.lat0) != 90:
            raise ValueError(f"only polar aspects are allowed: reference latitude {d.lat0}")
        self.g = 1.0 if d.lat0 > 0 else -1.0
        self.s1 = sin(radians(d.lat0 if d.lat1 == UNSET else d.lat1))

    def forward(self, s, lat, lon):
        phi, lam = s.let(radians(lat)), s.let(self.lam(lon))
        rho = s.let(self.R * s.cos(phi) * div(1 + self.g * self.s1, 1 + self.g * s.sin(phi)))
        return rho * s.sin(lam), -self.g * rho * s.cos(lam), True

    def inverse(self, s, x, y):
        c = 2 * s.atan2(sqrt(x * x + y * y), self.R * (1 + self.g * self.s1))
        return degrees(s.asinz(self.g * s.cos(c))), self.lon(s, s.atan2(x, -self.g * y)), True


class PolarStereographicEllipsoid(PolarStereographic):
    def __init__(self, d):
        super().__init__(d)
        e, lat1 = d.eccentricity, self.g * (d.lat0 if d.lat1 == UNSET else d.lat1)
        s1 = sin(radians(lat1))
        self.true_at_pole = abs(lat1) == 90
        if self.true_at_pole:  # the map scale has no effect here
            self.per_t = 2 * self.R * d.scale / sqrt(power(1 + e, 1 + e) * power(1 - e, 1 - e))
        else:
            t1 = tan(pi / 4 - radians(lat1) / 2) / power((1 - e * s1) / (1 + e * s1), e / 2)
            self.per_t = self.R * cos(radians(lat1)) / sqrt(1 - e * e * s1 * s1) / t1

    def forward(self, s, lat, lon):
        e = self.d.eccentricity
        sp, lam = s.let(s.sin(radians(self.g * lat))), s.let(radians(self.g * (lon - self.d.lon0)))
        t = sqrt(clamp_low(div(1 - sp, 1 + sp)) * s.power((1 + e * sp) / (1 - e * sp), e))
        rho = s.let(self.per_t * t)
        return self.g * rho * s.sin(lam), -self.g * rho * s.cos(lam), True

    def inverse(self, s, x, y):
        chi = s.let(pi / 2 - 2 * s.atan(sqrt(x * x + y * y) / self.per_t))
        phi = chi + _conformal(s, self.d.eccentricity, chi)
        return degrees(self.g * phi), normal_lon(s.part(degrees(self.g * s.atan2(self.g * x, -self.g * y)) + self.d.lon0)), True


def clamp_low(x):
    """Not below 0, against rounding at the poles."""
    return where(x < 0, 0.0, x)


class Sinusoidal(Projection):
    def forward(self, s, lat, lon):
        phi = s.let(radians(lat))
        return self.R * s.let(self.lam_normal(lon)) * s.cos(phi), self.R * phi, True

    def inverse(self, s, x, y):
        phi = s.let(y / self.R)
        return degrees(phi), self.lon(s, div(x, self.R * s.cos(phi))), True


class LambertConicConformalEllipsoid(Projection):
    def __init__(self, d):
        super().__init__(d)
        s0, s1, s2 = (sin(radians(a)) for a in (d.center_lat, d.lat0, d.lat1))
        m1, m2 = (cos(radians(a)) / sqrt(1 - d.eccentricity**2 * b * b) for a, b in ((d.lat0, s1), (d.lat1, s2)))
        t0, t1, t2 = (self._t(Now(), b) for b in (s0, s1, s2))
        self.n = div(ln(m1) - ln(m2), ln(t1) - ln(t2))
        self.RF = self.R * m1 / (self.n * power(t1, self.n))
        self.rho0 = self.RF * power(t0, self.n)

    def _t(self, s, sp):
        e = self.d.eccentricity
        return sqrt(clamp_low(div(1 - sp, 1 + sp)) * s.power((1 + e * sp) / (1 - e * sp), e))

    def forward(self, s, lat, lon):
        rho = s.let(self.RF * s.power(s.let(self._t(s, s.let(s.sin(radians(lat))))), self.n))
        theta = s.let(self.n * self.lam_normal(lon))
        return rho * s.sin(theta), self.rho0 - rho * s.cos(theta), True

    def inverse(self, s, x, y):
        e, g = self.d.eccentricity, 1.0 if self.n >= 0 else -1.0
        up = s.let(self.rho0 - y)
        lam = s.let(s.atan2(g * x, g * up) / self.n)
        t = s.let(s.power(s.let(g * sqrt(x * x + up * up) / self.RF), 1 / self.n))
        chi = s.let(pi / 2 - 2 * s.atan(t))
        phi = s.let(chi + _conformal(s, e, chi))
        for _ in range(1 if e < 0.15 else 4 if e < 0.5 else 60):  # each step gains a factor of e^2
            es = s.let(e * s.sin(phi))
            phi = s.let(pi / 2 - 2 * s.atan(t * s.power((1 - es) / (1 + es), e / 2)))
        return degrees(phi), self.lon(s, lam), True


#: Fixed values of the interrupted homolosine: latitude of the seam, boundaries of lobes, and the central meridian of each lobe (radians).
SEAM = 0.710987989993
BOUNDS = (-0.698131700798, -1.74532925199, -0.349065850399, 1.3962634016)
CENTRES = (-1.74532925199, -1.74532925199, 0.523598775598, 0.523598775598, -2.79252680319, -1.0471975512, -2.79252680319, -1.0471975512, 0.349065850399, 2.44346095279, 0.349065850399, 2.44346095279)
#: Offset of the Mollweide parts (of the radius), and the lobe numbers by latitude band, from north and from west.
OFFSET = 0.0528035274542
BANDS = ((0, 2), (1, 3), (4, 5, 8, 9), (6, 7, 10, 11))


#: Cosine of the parametric latitude below which a place is the pole (0.1 mm away), and what sines may be above 1.
POLE, ABOVE = 1e-7, 1 + 1e-14


def _from_pole(s, delta):
    """v - sin(v) = pi (1 - cos(delta)) for a polar distance: by the series of its inverse, and three steps of Newton's
    from there where v is not small."""
    h = s.let(s.sin(delta / 2))
    m = s.let(2 * pi * h * h)
    u = s.let(s.power(6 * m, 1 / 3))
    u2 = s.let(u * u)
    first = v = s.let(u * (1 + u2 / 60 * (1 + u2 * 3 / 70 * (1 + u2 / 18))))
    for _ in range(3):
        v = s.let(v - div(v - s.sin(v) - m, 1 - s.cos(v)))
    return where(u < 0.1, first, v)


class InterruptedHomolosine(Projection):
    def _by_lobe(self, y, x, value):
        """value(lobe, its west and east bounds) by the lobe of (y, x) in radians."""
        b = BOUNDS
        north, south = (-pi, b[0], pi), (-pi, b[1], b[2], b[3], pi)

        def across(lobes, edges):
            out = value(lobes[-1], edges[-2], edges[-1])
            for k in reversed(range(len(lobes) - 1)):
                out = where(x <= edges[k + 1], value(lobes[k], edges[k], edges[k + 1]), out)
            return out

        return where(y >= SEAM, across(BANDS[0], north), where(y >= 0, across(BANDS[1], north), where(y >= -SEAM, across(BANDS[2], south), across(BANDS[3], south))))

    def forward(self, s, lat, lon):
        lam, phi = s.let(radians(lon)), s.let(radians(lat))
        lam0 = s.let(self._by_lobe(phi, lam, lambda k, w, e: CENTRES[k]))
        dlam = s.let(normal_rad(lam - lam0))
        middle = s.let(both(phi < SEAM, phi >= -SEAM))
        theta = s.let(pi / 2 - _from_pole(s, s.let(pi / 2 - absolute(phi))) / 2) * sign(phi)
        x = where(middle, self.R * (lam0 + dlam * s.cos(phi)), self.R * (lam0 + 2 * 2**0.5 / pi * dlam * s.cos(theta)))
        y = where(middle, self.R * phi, self.R * (2**0.5 * s.sin(theta) - OFFSET * sign(phi)))
        return x, y, True

    def inverse(self, s, x, y):
        xr, yr = s.let(x / self.R), s.let(y / self.R)
        lam0 = s.let(self._by_lobe(yr, xr, lambda k, w, e: CENTRES[k]))
        west, east = s.let(self._by_lobe(yr, xr, lambda k, w, e: w)), s.let(self._by_lobe(yr, xr, lambda k, w, e: e))
        middle = s.let(both(yr < SEAM, yr >= -SEAM))
        dx = s.let(xr - lam0)
        a = s.let((yr + OFFSET * sign(yr)) / 2**0.5)
        theta = s.let(s.asinz(a))
        b = s.let((2 * theta + s.sin(2 * theta)) / pi)
        lam = s.let(where(middle, normal_rad(s.part(lam0 + where(absolute(absolute(yr) - pi / 2) > 1e-8, div(dx, s.cos(yr)), 0.0))), where(s.cos(theta) < POLE, lam0, lam0 + div(dx, 2 * 2**0.5 / pi * s.cos(theta)))))
        phi = where(middle, yr, s.asinz(b))
        ok = both(either(middle, both(absolute(a) <= ABOVE, absolute(b) <= ABOVE)), both(lam >= west, lam <= east))
        return degrees(phi), normal_lon(degrees(lam)), ok


class AlbersConicEqualArea(Projection):
    def __init__(self, d):
        super().__init__(d)
        s0, s1 = sin(radians(d.center_lat)), sin(radians(d.lat0))
        one = d.lat1 == UNSET or d.lat0 == d.lat1
        self.n = s1 if one else (s1 + sin(radians(d.lat1))) / 2
        self.C = cos(radians(d.lat0)) ** 2 + 2 * self.n * s1
        self.rho0 = self.R * sqrt(self.C - 2 * self.n * s0) / self.n

    def _xy(self, s, rho, lon):
        theta = s.let(self.n * self.lam(lon))
        return rho * s.sin(theta), self.rho0 - rho * s.cos(theta), True

    def _polar(self, s, x, y):
        g, up = (1.0 if self.n >= 0 else -1.0), s.let(self.rho0 - y)
        return s.let(sqrt(x * x + up * up)), s.let(s.atan2(g * x, g * up) / self.n)

    def forward(self, s, lat, lon):
        return self._xy(s, s.let(self.R * sqrt(self.C - 2 * self.n * s.sin(radians(lat))) / self.n), lon)

    def inverse(self, s, x, y):
        rho, lam = self._polar(s, x, y)
        chi = s.let(rho * self.n / self.R)
        a = s.let((self.C - chi * chi) / (2 * self.n))
        return where(absolute(a) <= ABOVE, degrees(s.asinz(a)), None), self.lon(s, lam), True


class AlbersConicEqualAreaEllipsoid(AlbersConicEqualArea):
    def __init__(self, d):
        Projection.__init__(self, d)
        e = self.e = d.eccentricity
        s0, s1, s2 = (sin(radians(a)) for a in (d.center_lat, d.lat0, d.lat1))
        m1, m2 = (cos(radians(a)) / sqrt(1 - e * e * b * b) for a, b in ((d.lat0, s1), (d.lat1, s2)))
        q0, q1, q2 = (_q(e, v) if e else 2 * v for v in (s0, s1, s2))
        self.n = s1 if d.lat1 == UNSET or d.lat0 == d.lat1 else (m1 * m1 - m2 * m2) / (q2 - q1)
        self.C = m1 * m1 + self.n * q1
        self.rho0 = self.R / self.n * sqrt(self.C - self.n * q0)

    def forward(self, s, lat, lon):
        sp = s.let(s.sin(radians(lat)))
        q = s.let(_q(self.e, sp, s) if self.e else 2 * sp)
        return self._xy(s, s.let(self.R / self.n * sqrt(self.C - self.n * q)), lon)

    def inverse(self, s, x, y):
        rho, lam = self._polar(s, x, y)
        if not self.e:  # q divides by e: no result on a sphere
            return missing(x), lam, False
        q = s.let((self.C - rho * rho * self.n * self.n / (self.R * self.R)) / self.n)
        return degrees(_phi_of_q(s, self.e, q)), self.lon(s, lam), True


class IntegerizedSinusoidal(Projection):
    """Rows (zones) of equal height with a whole number of columns, found by a closed form instead of a table."""

    def __init__(self, d):
        super().__init__(d)
        self.rows, self.justify = d.isin_nzone, d.isin_justify
        half = self.rows // 2
        self.ref = radians(d.lon0) - pi
        self.ref += 2 * pi if self.ref < -pi else 0
        self.dist = 2 * pi * self.R / self._columns(Now(), half - 1.0)[0]

    def _columns(self, s, row):
        """Columns of a row counted from a pole, and the column whose left edge is at the central meridian."""
        c = s.cos(pi / 2 * (1 - (row + 0.5) / (self.rows // 2))) * self.rows
        n = floor(2 * c + 0.5) if self.justify < 2 else 2 * floor(c + 0.5)
        n = where(n < 1, 1.0, n)
        return n, floor((n + 1) / 2) if self.justify == 1 else floor(n / 2)

    def _row(self, s, phi):
        row = s.let(trunc((pi / 2 - phi) * self.rows / pi))
        row = s.let(where(row >= self.rows // 2, self.rows - 1 - row, row))
        return s.let(where(row < 0, 0.0, row))

    def forward(self, s, lat, lon):
        phi, lam = s.let(radians(lat)), s.let(radians(normal_lon(lon)))
        n, centre = self._columns(s, self._row(s, phi))
        f = s.let((lam - self.ref) / (2 * pi))
        f = s.let(where(f < 0, f + 1 - trunc(f), f))
        f = where(f > 1, f - trunc(f), f)
        x = self.dist * (s.let(n) * f - s.let(centre))
        return x + self.d.false_easting, self.R * phi + self.d.false_northing, both(lat >= -90, lat <= 90)

    def inverse(self, s, x, y):
        phi = s.let((y - self.d.false_northing) / self.R)
        n, centre = self._columns(s, self._row(s, phi))
        f = s.let(((x - self.d.false_easting) / self.dist + centre) / n)
        lam = s.let(self.ref + f * 2 * pi)
        lam = where(lam >= pi, lam - 2 * pi, where(lam < -pi, lam + 2 * pi, lam))
        ok = both(both(phi >= -pi / 2, phi <= pi / 2), both(f >= 0, f <= 1))
        return degrees(phi), normal_lon(degrees(lam)), ok


class TransverseMercator(Projection):
    def __init__(self, d):
        super().__init__(d)
        self.R = self.R * d.center_scale

    def forward(self, s, lat, lon):
        phi, lam = s.let(radians(lat)), s.let(self.lam(lon))
        b = s.let(s.cos(phi) * s.sin(lam))
        a = s.let(s.acos(clamp(s.part(div(s.cos(phi) * s.cos(lam), sqrt(1 - b * b))))))
        y = self.R * (where(lat < 0, -a, a) - radians(self.d.lat0))
        return self.R / 2 * s.ln(s.let(div(1 + b, 1 - b))), y, absolute(absolute(b) - 1) >= 1e-7

    def inverse(self, s, x, y):
        f = s.let(s.exp(x / self.R))
        sinh = s.let(0.5 * (f - div(1.0, f)))
        d = s.let(radians(self.d.lat0) + y / self.R)
        a = s.let(s.asinz(sqrt((1 - s.cos(d) * s.cos(d)) / (1 + sinh * sinh))))
        return degrees(where(d < 0, -a, a)), self.lon(s, where(both(sinh == 0, s.cos(d) == 0), 0.0, s.atan2(sinh, s.cos(d)))), True


class TransverseMercatorEllipsoid(Projection):
    def __init__(self, d):
        super().__init__(d)
        e2 = self.e2 = d.eccentricity**2
        self.esp, self.k0 = e2 / (1 - e2), d.center_scale
        third = 15 / 128 if d.strict else 0.1178175
        self.meridian = (1 - e2 / 4 * (1 + e2 / 16 * (3 + 5 * e2 / 4)), -e2 / 8 * (3 + e2 / 4 * (3 + 25 * e2 / 24)), third * e2 * e2 * (1 + 3 * e2 / 4), -35 * e2**3 / 768)
        self.m0 = self._meridian(Now(), radians(d.lat0))
        e1 = (1 - sqrt(1 - e2)) / (1 + sqrt(1 - e2))
        # sin(2m) (f1 + cos(2m) (f2 + cos(2m) (f3 + cos(2m) f4))): Snyder 3-26 with multiple angles as powers
        first, last = (29 / 6, 1 / 64) if d.strict else (83 / 48, 64.0)
        self.foot = (e1 / 2 * (3 - first * e1 * e1), e1 * e1 / 8 * (21 - 1537 * e1 * e1 / 16), 151 * e1**3 / 24, 1097 * e1**4 * last)

    def _meridian(self, s, phi):
        a, b, c, d = self.meridian
        c2 = s.cos(2 * phi)
        return self.R * (a * phi + s.sin(2 * phi) * (b + c2 * (c + c2 * d)))

    def forward(self, s, lat, lon):
        phi, lam = s.let(radians(lat)), s.let(self.lam(lon))
        m, pole = s.let(self._meridian(s, phi) - self.m0), absolute(pi / 2 - absolute(phi)) < 1e-6
        a = s.let(s.cos(phi) * lam)
        a2, c, tq = s.let(a * a), s.let(self.esp * s.cos(phi) * s.cos(phi)), s.let(s.tan(phi))
        t, n = s.let(tq * tq), s.let(self.R / sqrt(1 - self.e2 * s.sin(phi) * s.sin(phi)))
        x = n * a * (1 + a2 / 6 * (1 - t + c + a2 / 20 * (5 - 18 * t + t * t + 72 * c - 58 * self.esp)))
        y = m + n * tq * a2 * (0.5 + a2 / 24 * (5 - t + 9 * c + 4 * c * c + a2 / 30 * (61 - 58 * t + t * t + 600 * c - 330 * self.esp)))
        return where(pole, 0.0, self.k0 * x), self.k0 * where(pole, m, y), True

    def inverse(self, s, x, y):
        mu = s.let((self.m0 + y / self.k0) / (self.R * self.meridian[0]))
        f1, f2, f3, f4 = self.foot
        c2 = s.let(s.cos(2 * mu))
        phi1 = s.let(mu + s.sin(2 * mu) * (f1 + c2 * (f2 + c2 * (f3 + c2 * f4))))
        pole1 = s.let(absolute(phi1) > pi / 2 - 1e-6)
        c, tq = s.let(self.esp * s.cos(phi1) * s.cos(phi1)), s.let(s.tan(phi1))
        t, w = s.let(tq * tq), s.let(sqrt(1 - self.e2 * s.sin(phi1) * s.sin(phi1)))
        n, r = self.R / w, self.R * (1 - self.e2) / (w * w * w)
        d = s.let(x / (n * self.k0))
        d2 = s.let(d * d)
        phi = phi1 - (n * tq * d2 / r) * (0.5 - d2 / 24 * (5 + 3 * t + 10 * c - 4 * c * c - 9 * self.esp - d2 / 30 * (61 + 90 * t + 298 * c + 45 * t * t - 252 * self.esp - 3 * c * c)))
        phi = s.let(where(pole1, sign(y) * pi / 2, phi))
        pole = s.let(either(pole1, absolute(phi) > pi / 2 - 1e-6))
        lam = div(d * (1 - d2 / 6 * (1 + 2 * t + c - d2 / 20 * (5 - 2 * c + 28 * t - 3 * c * c + 8 * self.esp + 24 * t * t))), s.cos(phi1))
        return degrees(where(pole, sign(y) * pi / 2, phi)), self.lon(s, where(pole, 0.0, lam)), True


#: Standard name -> projection. A user's own projection is one more entry.
REGISTRY = {
    "AZIMUTHALEQUALAREA": AzimuthalEqualArea,
    "AZIMUTHALEQUALAREAELLIPSOID": AzimuthalEqualAreaEllipsoid,
    "CYLINDRICALEQUALAREA": CylindricalEqualArea,
    "CYLINDRICALEQUALAREAELLIPSOID": CylindricalEqualAreaEllipsoid,
    "CYLINDRICALEQUIDISTANT": CylindricalEquidistant,
    "MERCATOR": Mercator,
    "MOLLWEIDE": Mollweide,
    "ORTHOGRAPHIC": Orthographic,
    "POLARSTEREOGRAPHIC": PolarStereographic,
    "POLARSTEREOGRAPHICELLIPSOID": PolarStereographicEllipsoid,
    "SINUSOIDAL": Sinusoidal,
    "LAMBERTCONICCONFORMALELLIPSOID": LambertConicConformalEllipsoid,
    "INTERUPTEDHOMOLOSINEEQUALAREA": InterruptedHomolosine,
    "ALBERSCONICEQUALAREA": AlbersConicEqualArea,
    "ALBERSCONICEQUALAREAELLIPSOID": AlbersConicEqualAreaEllipsoid,
    "INTEGERIZEDSINUSOIDAL": IntegerizedSinusoidal,
    "TRANSVERSEMERCATOR": TransverseMercator,
    "TRANSVERSEMERCATORELLIPSOID": TransverseMercatorEllipsoid,
    "UNIVERSALTRANSVERSEMERCATOR": TransverseMercatorEllipsoid,
}


def forward_xy(projection: Projection, s, lat, lon):
    """x, y (missing where they can't be told) with false easting and northing."""
    x, y, ok = projection.forward(s, lat, lon)
    x, y = s.let(x), s.let(y)
    ok = s.let(both(ok, both(finite(x), finite(y))))
    d = projection.d
    return s.let(where(ok, x + d.false_easting, None)), s.let(where(ok, y + d.false_northing, None))


def inverse_xy(projection: Projection, s, x, y):
    """lat, lon of x, y with false easting and northing."""
    d = projection.d
    lat, lon, ok = projection.inverse(s, s.let(x - d.false_easting), s.let(y - d.false_northing))
    lat, lon = s.let(lat), s.let(lon)
    ok = s.let(both(ok, both(finite(lat), finite(lon))))
    return s.let(where(ok, lat, None)), s.let(where(ok, lon, None))


def origin(projection: Projection, lat: float, lon: float) -> tuple[float, float]:
    return forward_xy(projection, Now(), float(lat), float(lon))
