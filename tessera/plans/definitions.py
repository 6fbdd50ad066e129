"""Map and grid definitions: frozen records on the driver whose constants become literals of a plan."""

from __future__ import annotations

import math
import re
from dataclasses import dataclass, field, replace
from functools import cached_property

from ..functions.projections import REGISTRY, UNSET, Projection, origin
from .labels import Label, find_file, numbers

#: Authalic sphere and Clarke 1866 (km), WGS 84 and the sphere of the integerized sinusoidal (m).
SPHERE_KM, CLARKE_KM, CLARKE_E = 6371.228, 6378.2064, 0.082271673
WGS84_M, WGS84_E, ISIN_M = 6378137.0, 0.081819190843, 6371007.181

UTM, ISIN = "UNIVERSALTRANSVERSEMERCATOR", "INTEGERIZEDSINUSOIDAL"


#: Spellings of projections' names that are accepted besides their own, without blanks and signs.
SPELLINGS = {
    "ALBERSCONICEQUALAREA": "ALBERSCONIC ALBERSCONICEQUALAREASPHERE ALBERSEQUALAREA ALBERSEQUALAREACONIC CONICEQUALAREA EQUALAREACONIC",
    "ALBERSCONICEQUALAREAELLIPSOID": "ALBERSCONICELLIPSOID ALBERSEQUALAREACONICELLIPSOID ALBERSEQUALAREAELLIPSOID CONICEQUALAREAELLIPSOID ELLIPSOIDALBERSCONIC ELLIPSOIDALBERSCONICEQUALAREA ELLIPSOIDALBERSEQUALAREA ELLIPSOIDALBERSEQUALAREACONIC ELLIPSOIDCONICEQUALAREA ELLIPSOIDEQUALAREACONIC EQUALAREACONICELLIPSOID",
    "AZIMUTHALEQUALAREA": "AZIMUTHALEQUALAREASPHERE EQUALAREAAZIMUTHAL EQUALAREAAZIMUTHALSPHERE SPHEREAZIMUTHALEQUALAREA SPHEREEQUALAREAAZIMUTHAL",
    "AZIMUTHALEQUALAREAELLIPSOID": "ELLIPSOIDAZIMUTHALEQUALAREA ELLIPSOIDEQUALAREAAZIMUTHAL EQUALAREAAZIMUTHALELLIPSOID",
    "CYLINDRICALEQUALAREA": "EQUALAREACYLINDRICAL",
    "CYLINDRICALEQUALAREAELLIPSOID": "ELLIPSOIDCYLINDRICALEQUALAREA ELLIPSOIDEQUALAREACYLINDRICAL EQUALAREACYLINDRICALELLIPSOID",
    "CYLINDRICALEQUIDISTANT": "EQUIDISTANTCYLINDRICAL",
    "INTEGERIZEDSINUSOIDAL": "ISIN ISINUS",
    "INTERUPTEDHOMOLOSINEEQUALAREA": "GOODEHOMOLOSINE GOODEHOMOLOSINEEQUALAREA GOODEINTERRUPTEDHOMOLOSINE GOODEINTERRUPTEDHOMOLOSINEEQUALAREA GOODESHOMOLOSINE GOODESHOMOLOSINEEQUALAREA GOODESINTERRUPTEDHOMOLOSINE GOODESINTERRUPTEDHOMOLOSINEEQUALAREA GOODESINTERUPTEDHOMOLOSINE INTERRUPTEDHOMOLOSINE INTERRUPTEDHOMOLOSINEEQUALAREA INTERUPTEDHOMOLOSINE",
    "LAMBERTCONICCONFORMALELLIPSOID": "ELLIPSOIDLAMBERTCONFORMALCONIC ELLIPSOIDLAMBERTCONICCONFORMAL LAMBERTCONFORMALCONICELLIPSOID",
    "POLARSTEREOGRAPHIC": "STEREOGRAPHICPOLAR",
    "POLARSTEREOGRAPHICELLIPSOID": "ELLIPSOIDPOLARSTEREOGRAPHIC ELLIPSOIDSTEREOGRAPHICPOLAR STEREOGRAPHICPOLARELLIPSOID",
    "TRANSVERSEMERCATOR": "MERCATORTRANSVERSE",
    "TRANSVERSEMERCATORELLIPSOID": "ELLIPSOIDMERCATORTRANSVERSE ELLIPSOIDTRANSVERSEMERCATOR MERCATORTRANSVERSEELLIPSOID",
    "UNIVERSALTRANSVERSEMERCATOR": "ELLIPSOIDUNIVERSALMERCATORTRANSVERSE ELLIPSOIDUNIVERSALTRANSVERSEMERCATOR ELLIPSOIDUTM UNIVERSALMERCATORTRANSVERSE UNIVERSALMERCATORTRANSVERSEELLIPSOID UNIVERSALTRANSVERSEMERCATORELLIPSOID UTM UTMELLIPSOID",
}
ALIASES = {name: name for name in REGISTRY} | {spelling: name for name, spellings in SPELLINGS.items() for spelling in spellings.split()}


def standard_name(name: str) -> str:
    key = re.sub(r"[_ ()\-]", "", name).upper()
    return ALIASES.get(key, key)


@dataclass(frozen=True)
class MapDef:
    """A map: projection, datum, origin, rotation and bounds. Angles in degrees; None is a value to be derived."""

    projection: str
    lat0: float = UNSET
    lon0: float = UNSET
    lat1: float = UNSET
    lon1: float = UNSET
    rotation: float = 0.0
    scale: float = 1.0
    x0: float | None = None
    y0: float | None = None
    center_lat: float | None = None
    center_lon: float | None = None
    false_easting: float | None = None
    false_northing: float | None = None
    south: float = -90.0
    north: float = 90.0
    west: float = -180.0
    east: float = 180.0
    lat_interval: float = 30.0
    lon_interval: float = 30.0
    label_lat: float = 0.0
    label_lon: float = 0.0
    detail: tuple[int, int, int] = (1, 0, 0)
    equatorial_radius: float | None = None
    polar_radius: float | None = None
    eccentricity: float | None = None
    center_scale: float | None = None
    maximum_error: float | None = None
    utm_zone: int = 0
    isin_nzone: int = 86400
    isin_justify: int = 1
    strict: bool = False
    straddles: bool = field(default=False, init=False)

    def __post_init__(self):
        put = lambda k, v: object.__setattr__(self, k, v)
        put("projection", standard_name(self.projection))
        if self.projection not in REGISTRY:
            raise ValueError(f"unknown projection {self.projection}")
        utm = self.projection == UTM
        if self.projection == ISIN:
            for k in ("lat0", "lon0"):
                if getattr(self, k) == UNSET:
                    put(k, 0.0)
        if not utm and UNSET in (self.lat0, self.lon0):
            raise ValueError("Map Reference Latitude and Longitude are required")
        if (self.x0 is None) != (self.y0 is None):
            raise ValueError("Map Origin X and Y go together")
        self._datum(put)
        put("center_scale", (0.9996 if utm else 1.0) if self.center_scale is None else self.center_scale)
        put("maximum_error", (100.0 if utm else 0.0) if self.maximum_error is None else self.maximum_error)
        if utm:
            self._zone(put)
        for k, v in (("center_lat", self.lat0), ("center_lon", self.lon0)):
            if getattr(self, k) is None:
                put(k, v if self.x0 is None else UNSET)
        for k in ("false_easting", "false_northing"):
            if getattr(self, k) is None:
                put(k, 0.0)
        self._bounds(put)

    def _datum(self, put) -> None:
        a, b, e = self.equatorial_radius, self.polar_radius, self.eccentricity
        if a and b and e is None:
            e = math.sqrt(1 - b * b / (a * a))
        if b and e is not None and not a:
            a = b / math.sqrt(1 - e * e)
        if self.projection == UTM:
            a, e = a or WGS84_M, WGS84_E if e is None else e
        elif self.projection == ISIN:
            a, e = a or ISIN_M, 0.0
        elif "ELLIPSOID" in self.projection:
            a, e = a or CLARKE_KM, CLARKE_E if e is None else e
        else:
            a, e = a or SPHERE_KM, e or 0.0
            if e or (b and b != a):
                raise ValueError("eccentricity or polar radius with a spherical projection: use its Ellipsoid version")
        put("equatorial_radius", float(a))
        put("eccentricity", float(e))
        put("polar_radius", a * math.sqrt(1 - e * e))

    def _zone(self, put) -> None:
        zone = self.utm_zone
        if not -60 <= zone <= 60:
            raise ValueError("UTM zone must be -60 to 60")
        if zone == 0:
            if UNSET in (self.lat0, self.lon0):
                raise ValueError("map reference latitude and longitude are required without a UTM zone")
            lon = self.lon0 - 360 if self.lon0 >= 180 else self.lon0
            zone = int((lon + 180) / 6 + 1) * (-1 if self.lat0 < 0 else 1)
        put("utm_zone", zone)
        put("lat0", 0.0)
        put("lon0", 6 * abs(zone) - 183.0)
        if self.false_easting is None:
            put("false_easting", 500000.0)
        if self.false_northing is None:
            put("false_northing", 0.0 if zone > 0 else 1e7)

    def _bounds(self, put) -> None:
        west, east = self.west, self.east
        if not (-180 <= west <= 360 and -180 <= east <= 360) or abs(east - west) > 360:
            raise ValueError(f"illegal bounds: west={west}, east={east}")
        if east > 180 and west > 180:
            west, east = west - 360, east - 360
        put("straddles", east < west or east > 180)
        wrap = lambda v: v - 360 if v > 180 else v
        put("west", wrap(west))
        put("east", wrap(east))

    @cached_property
    def math(self) -> Projection:
        return REGISTRY[self.projection](self)

    @cached_property
    def rotated_origin(self) -> tuple[float, float, float, float]:
        """cos and sin of the rotation, and u, v of the origin."""
        t = math.radians(self.rotation)
        c, s = math.cos(t), math.sin(t)
        x0, y0 = (self.x0, self.y0) if self.x0 is not None else origin(self.math, self.center_lat, self.center_lon)
        return c, s, c * x0 + s * y0, -s * x0 + c * y0

    @property
    def Rg(self) -> float:
        return self.equatorial_radius / self.scale

    @property
    def flattening(self) -> float:
        return 1 - self.polar_radius / self.equatorial_radius

    def describe(self) -> dict:
        """Parameters of the map, for reports and logs."""
        return {k: v for k, v in self.__dict__.items() if k not in ("math", "rotated_origin")}

    @classmethod
    def parse(cls, text: str) -> MapDef:
        label = Label(text)
        name = label.string("Map Projection")
        if name is None:
            return cls._legacy(label.positional())
        e2 = label.number("Map Eccentricity Squared")
        e = label.number("Map Eccentricity")
        return cls(
            name,
            lat0=label.angle("Map Reference Latitude", UNSET), lon0=label.angle("Map Reference Longitude", UNSET),
            lat1=label.angle("Map Second Reference Latitude", UNSET), lon1=label.angle("Map Second Reference Longitude", UNSET),
            rotation=label.number("Map Rotation", 0.0), scale=label.number("Map Scale", 1.0),
            x0=label.number("Map Origin X"), y0=label.number("Map Origin Y"),
            center_lat=label.angle("Map Origin Latitude"), center_lon=label.angle("Map Origin Longitude"),
            false_easting=label.number("Map False Easting"), false_northing=label.number("Map False Northing"),
            south=label.angle("Map Southern Bound", -90.0), north=label.angle("Map Northern Bound", 90.0),
            west=label.angle("Map Western Bound", -180.0), east=label.angle("Map Eastern Bound", 180.0),
            lat_interval=label.number("Map Graticule Latitude Interval", 30.0), lon_interval=label.number("Map Graticule Longitude Interval", 30.0),
            label_lat=label.angle("Map Graticule Label Latitude", 0.0), label_lon=label.angle("Map Graticule Label Longitude", 0.0),
            detail=tuple(label.whole(f"Map {k} Detail Level", v) for k, v in (("CIL", 1), ("BDY", 0), ("RIV", 0))),
            equatorial_radius=label.number("Map Equatorial Radius") or None, polar_radius=label.number("Map Polar Radius") or None,
            eccentricity=e if e is not None else math.sqrt(e2) if e2 is not None else None,
            center_scale=label.number("Map Center Scale"), maximum_error=label.number("Map Maximum Error"), utm_zone=label.whole("Map UTM Zone", 0),
            isin_nzone=label.whole("Map ISin NZone", 86400), isin_justify=label.whole("Map ISin Justify", 1),
        )

    @classmethod
    def _legacy(cls, lines: list[str]) -> MapDef:
        """The positional format: a line each for name, reference, rotation, scale, center, latitudes, longitudes,
        graticule, label, detail and optionally radius and eccentricity. Ellipsoids default to the authalic radius."""
        if len(lines) < 10:
            raise ValueError("bad label: legacy map definitions have ten lines")
        name = re.split(r"\s{2,}|\t", lines[0])[0]
        rows = [numbers(x) for x in lines[1:]]
        get = lambda i, j, default: rows[i][j] if i < len(rows) and j < len(rows[i]) else default
        std = standard_name(name)
        a, e = (WGS84_M, WGS84_E) if std == UTM else (ISIN_M, 0.0) if std == ISIN else (SPHERE_KM, CLARKE_E if "ELLIPSOID" in std else 0.0)
        return cls(
            name, lat0=get(0, 0, 0.0), lon0=get(0, 1, 0.0), lat1=get(0, 2, UNSET), lon1=get(0, 3, UNSET), rotation=get(1, 0, 0.0), scale=get(2, 0, 1.0),
            center_lat=get(3, 0, 0.0), center_lon=get(3, 1, 0.0), south=get(4, 0, -90.0), north=get(4, 1, 90.0), west=get(5, 0, -180.0), east=get(5, 1, 180.0),
            lat_interval=get(6, 0, 30.0), lon_interval=get(6, 1, 30.0), label_lat=get(7, 0, 0.0), label_lon=get(7, 1, 0.0), detail=tuple(int(get(8, k, v)) for k, v in enumerate((1, 0, 0))),
            equatorial_radius=get(9, 0, a), eccentricity=get(10, 0, e),
        )

    @classmethod
    def load(cls, name: str, search: str = "") -> MapDef:
        return cls.parse(find_file(name, search).read_text())

    def changed(self, **values) -> MapDef:
        """A definition with other values; derived ones are derived again unless given."""
        return replace(self, **values)


@dataclass(frozen=True)
class GridDef:
    """A grid over a map: (0, 0) is the centre of the upper left cell."""

    map: MapDef
    cols: int
    rows: int
    cols_per_unit: float = 1.0
    rows_per_unit: float | None = None
    origin_col: float = 0.0
    origin_row: float = 0.0
    #: The grid that this one is cut from, and how finely: places are those of that grid, cut afterwards (see transform).
    cut: tuple[GridDef, int] | None = field(default=None, init=False, compare=False, repr=False)

    def __post_init__(self):
        if self.rows_per_unit is None:
            object.__setattr__(self, "rows_per_unit", self.cols_per_unit)

    @property
    def n_cells(self) -> int:
        return self.cols * self.rows

    @property
    def half_width(self) -> float:
        """Half the way round in map units where columns wrap (cylindrical equidistant only), else 0."""
        return self.map.Rg * math.pi if self.map.projection == "CYLINDRICALEQUIDISTANT" else 0.0

    def shrink(self, factor: int) -> GridDef:
        """Sizes, origin and scale divided by a factor; the origin without a half-cell correction."""
        return replace(self, cols=self.cols // factor, rows=self.rows // factor, origin_col=self.origin_col / factor, origin_row=self.origin_row / factor, cols_per_unit=self.cols_per_unit / factor, rows_per_unit=self.rows_per_unit / factor)

    def zoom(self, factor: int) -> GridDef:
        """Each cell cut into factor x factor cells; the area stays."""
        out = replace(self, cols=self.cols * factor, rows=self.rows * factor, origin_col=(self.origin_col + 0.5) * factor - 0.5, origin_row=(self.origin_row + 0.5) * factor - 0.5, cols_per_unit=self.cols_per_unit * factor, rows_per_unit=self.rows_per_unit * factor)
        object.__setattr__(out, "cut", (self, factor))
        return out

    def describe(self) -> dict:
        return {**{k: v for k, v in self.__dict__.items() if k not in ("map", "cut")}, **self.map.describe()}

    @classmethod
    def parse(cls, text: str, search: str = "") -> GridDef:
        label = Label(text)
        file = label.string("Grid MPP File")
        if file is None and label.string("Map Projection") is None:
            return cls._legacy(label.positional(), search)
        m = MapDef.load(file, search) if file else MapDef.parse(text)
        cols, rows = label.whole("Grid Width"), label.whole("Grid Height")
        if cols is None or rows is None:
            raise ValueError("Grid Width and Grid Height are required")
        per = label.number("Grid Cells per Map Unit", 0.0)
        if not per and (units := label.number("Grid Map Units per Cell", 0.0)):
            per = 1 / units
        per_col = per or label.number("Grid Columns per Map Unit", 0.0) or 1 / label.number("Grid Map Units per Column", 1.0)
        per_row = per or label.number("Grid Rows per Map Unit", 0.0) or 1 / label.number("Grid Map Units per Row", 1.0)
        return cls(m, cols, rows, per_col, per_row, label.number("Grid Map Origin Column", 0.0), label.number("Grid Map Origin Row", 0.0))

    @classmethod
    def _legacy(cls, lines: list[str], search: str) -> GridDef:
        m = MapDef.load(lines[0].split()[0], search)
        rows = [numbers(x) for x in lines[1:4]]
        get = lambda i, j, default: rows[i][j] if i < len(rows) and j < len(rows[i]) else default
        cols, n = int(get(0, 0, 512)), int(get(0, 1, 512))
        per = get(1, 0, 64.0)
        return cls(m, cols, n, per, get(1, 1, per), get(2, 0, cols / 2), get(2, 1, n / 2))

    @classmethod
    def load(cls, name: str, search: str = "") -> GridDef:
        return cls.parse(find_file(name, search).read_text(), search)
