import math

import pytest

from tessera.functions import projections
from tessera.functions.scalar import Now
from tessera.operators import transform as T
from tessera.plans.definitions import GridDef, MapDef, standard_name
from tessera.plans.labels import Label

from .goldens import DEFINITIONS, POINTS

CLARKE = "Map Equatorial Radius: 6378206.4\nMap Eccentricity: 0.0822719\n"


def test_label_values():
    label = Label("map projection: X ; comment\nMap Scale : 3\nMap Scale: 2.5e1 km # c\nMap Origin Latitude: 12.5S\nGrid Name: a b\nFlag: yes\nLon: -7\nW: 96w")
    assert label.string("Map Projection") == "X" and label.number("map scale") == 25
    assert label.angle("Map Origin Latitude") == -12.5 and label.angle("Lon") == -7 and label.angle("W") == -96
    assert label.boolean("Flag") and label.string("None") is None and label.string("Grid Name") == "a b"


def test_names():
    assert standard_name("Equal-Area Azimuthal (Ellipsoid)") == "AZIMUTHALEQUALAREAELLIPSOID"
    assert standard_name("goodes interrupted homolosine") == "INTERUPTEDHOMOLOSINEEQUALAREA"
    assert standard_name("UTM Ellipsoid") == standard_name("utm") == "UNIVERSALTRANSVERSEMERCATOR"
    assert standard_name("lambert_conformal_conic ellipsoid") == "LAMBERTCONICCONFORMALELLIPSOID"


def test_datums():
    m = MapDef("Mercator", lat0=0, lon0=0)
    assert m.equatorial_radius == 6371.228 and m.eccentricity == 0
    m = MapDef("Polar Stereographic Ellipsoid", lat0=90, lon0=0, equatorial_radius=6378.137, polar_radius=6356.7523)
    assert m.eccentricity == pytest.approx(0.0818192, abs=1e-6)
    assert MapDef("UTM", utm_zone=-18).false_northing == 1e7 and MapDef("UTM", lat0=40, lon0=-73.5).utm_zone == 18
    for bad in ({"eccentricity": 0.1}, {"polar_radius": 1.0, "equatorial_radius": 2.0}, {"west": -200.0}, {"x0": 1.0}):
        with pytest.raises(ValueError):
            MapDef("Mercator", lat0=0, lon0=0, **bad)
    for bad in (lambda: MapDef("Mercator"), lambda: MapDef("Nonsense", lat0=0, lon0=0), lambda: MapDef("UTM", utm_zone=61), lambda: MapDef("Polar Stereographic", lat0=80, lon0=0).math):
        with pytest.raises(ValueError):
            bad()


def test_legacy_formats(tmp_path):
    mpp = "# a comment\nCylindrical Equal-Area\t\n0.0 0.0 30.0 lat0 lon0 lat1\n0.0 rotation\n200.5402 scale (km/map unit)\n00.00 00.00 center\n-90.00 90.00\n-180.00 180.00\n30.00 30.00\n00.00 00.00\n1 0 0\n"
    (tmp_path / "m.mpp").write_text(mpp)
    (tmp_path / "g.gpd").write_text("elsewhere/m.mpp map projection parameters # x\n1383 586 columns rows\n8 cells per map unit\n691.0 292.5 origin\n")
    g = GridDef.load("g.gpd", str(tmp_path))
    assert (g.cols, g.rows, g.cols_per_unit, g.rows_per_unit, g.origin_col) == (1383, 586, 8, 8, 691)
    assert T.point_place(g, 75.0, -150.0)[:2] == pytest.approx((114.7499865, 9.0184252), abs=5e-7)
    assert T.place_geo(g, 1267.2500135, 575.9815748)[:2] == pytest.approx((-75.0, 150.0), abs=5e-7)
    with pytest.raises(FileNotFoundError):
        MapDef.load("none.mpp", str(tmp_path))


def test_grid_scales():
    m = "Map Projection: Cylindrical Equidistant\nMap Reference Latitude: 0\nMap Reference Longitude: 0\nGrid Width: 10\nGrid Height: 5\n"
    assert GridDef.parse(m).cols_per_unit == 1
    assert GridDef.parse(m + "Grid Map Units per Cell: 4\n").rows_per_unit == 0.25
    g = GridDef.parse(m + "Grid Columns per Map Unit: 2\nGrid Map Units per Row: 5\n")
    assert (g.cols_per_unit, g.rows_per_unit) == (2, 0.2)
    assert g.shrink(2).cols == 5 and g.shrink(2).rows == 2 and g.n_cells == 50
    assert g.half_width == pytest.approx(math.pi * 6371.228)
    with pytest.raises(ValueError):
        GridDef.parse("Map Projection: Mercator\nMap Reference Latitude: 0\nMap Reference Longitude: 0\n")


#: Published examples: projection label, latitude, longitude, x, y and the half unit of the last published digit.
EXAMPLES = [
    (f"Map Projection: Albers Conic Equal-Area Ellipsoid\n{CLARKE}Map Reference Latitude: 29.5\nMap Second Reference Latitude: 45.5\nMap Origin Latitude: 23.0\nMap Reference Longitude: -96.0", 35.0, -75.0, 1885472.7, 1535925.0, 0.05),
    ("Map Projection: Albers Conic Equal-Area\nMap Equatorial Radius: 1.0\nMap Reference Latitude: 29.5\nMap Second Reference Latitude: 45.5\nMap Origin Latitude: 23.0\nMap Reference Longitude: -96.0", 35.0, -75.0, 0.2952720, 0.2416774, 5e-8),
    (f"Map Projection: Azimuthal Equal-Area Ellipsoid\n{CLARKE}Map Reference Latitude: 40\nMap Reference Longitude: -100", 30.0, -110.0, -965932.1, -1056814.9, 0.05),
    ("Map Projection: Azimuthal Equal-Area Ellipsoid\nMap Equatorial Radius: 6378388.0\nMap Eccentricity: 0.0819919\nMap Reference Latitude: 90\nMap Reference Longitude: -100", 80.0, 5.0, 1077459.7, 288704.5, 0.06),
    (f"Map Projection: Cylindrical Equal-Area Ellipsoid\n{CLARKE}Map Reference Latitude: 0\nMap Reference Longitude: -75\nMap Second Reference Latitude: 5", 5.0, -78.0, -332699.8, 554248.5, 0.06),
    (f"Map Projection: Lambert Conic Conformal Ellipsoid\n{CLARKE}Map Reference Latitude: 33\nMap Second Reference Latitude: 45\nMap Origin Latitude: 23\nMap Reference Longitude: -96", 35.0, -75.0, 1894410.9, 1564649.5, 0.05),
    ("Map Projection: Polar Stereographic Ellipsoid\nMap Equatorial Radius: 6378388.0\nMap Eccentricity: 0.0819919\nMap Reference Latitude: -90\nMap Second Reference Latitude: -71\nMap Reference Longitude: -100", -75.0, 150.0, -1540033.6, -560526.4, 0.05),
    (f"Map Projection: Transverse Mercator Ellipsoid\n{CLARKE}Map Reference Latitude: 0\nMap Reference Longitude: -75\nMap Center Scale: 0.9996", 40.5, -73.5, 127106.5, 4484124.4, 0.06),
    ("Map Projection: Mercator\nMap Equatorial Radius: 1.0\nMap Reference Latitude: 0\nMap Reference Longitude: -180", 35.0, -75.0, 1.8325957, 0.6528366, 5e-8),
    ("Map Projection: Sinusoidal\nMap Equatorial Radius: 1.0\nMap Reference Latitude: 0\nMap Reference Longitude: -90", -50.0, -75.0, 0.1682814, -0.8726646, 5e-8),
    ("Map Projection: Mollweide\nMap Equatorial Radius: 1.0\nMap Reference Latitude: 0\nMap Reference Longitude: -90", -50.0, -75.0, 0.1788845, -0.9208758, 5e-7),
    ("Map Projection: Orthographic\nMap Equatorial Radius: 1.0\nMap Reference Latitude: 40\nMap Reference Longitude: -100", 30.0, -110.0, -0.1503837, -0.1651911, 5e-8),
    ("Map Projection: Transverse Mercator\nMap Equatorial Radius: 1.0\nMap Reference Latitude: 0\nMap Reference Longitude: -75", 40.5, -73.5, 0.0199077, 0.7070276, 5e-8),
    ("Map Projection: UTM\nMap Equatorial Radius: 6378206.4\nMap Eccentricity: 0.0822719\nMap UTM Zone: 18", 40.5, -73.5, 627106.5, 4484124.4, 0.06),
]


@pytest.mark.parametrize("case", EXAMPLES, ids=lambda c: c[0].split("\n")[0][16:])
def test_published_examples(case):
    label, lat, lon, x, y, tolerance = case
    m = MapDef.parse(label)
    got = T.map_xy(m, Now(), lat, lon)
    assert got == pytest.approx((x, y), abs=2 * tolerance)
    assert T.geo_of_xy(m, Now(), *got) == pytest.approx((lat, lon), abs=1e-5)


@pytest.fixture(scope="module")
def computed(tmp_path_factory):
    """The map, or grid, of each definition of goldens."""
    folder = tmp_path_factory.mktemp("definitions")
    for name, (kind, text) in DEFINITIONS.items():
        (folder / f"{name}.{kind}").write_text(text)
    return {name: (MapDef if kind == "mpp" else GridDef).load(f"{name}.{kind}", str(folder)) for name, (kind, _) in DEFINITIONS.items()}


@pytest.mark.parametrize("case", POINTS, ids=lambda c: f"{c[0]}-{c[1]}-{c[2][0]}")
def test_computed_points(case, computed):
    name, direction, given, want = case
    d = computed[name]
    kind, way = direction.split()
    m = d if isinstance(d, MapDef) else d.map
    if kind == "xy":
        got = (T.map_xy if way == "forward" else T.geo_of_xy)(m, Now(), *given)
    else:
        got = (T.grid_place if way == "forward" else T.geo_of_place)(d, Now(), *given)[:2]
    assert got == pytest.approx(want, abs=6e-7)


def test_quirks():
    """Deviations of results from the textbook, one by one (QUIRKS)."""
    plain, moved = (MapDef("Integerized Sinusoidal", false_easting=e, false_northing=n) for e, n in ((0, 0), (1000.0, -500.0)))
    x, y = T.map_xy(plain, Now(), 40.0, 20.0)
    assert T.map_xy(moved, Now(), 40.0, 20.0) == pytest.approx((x + 2000.0, y - 1000.0))  # twice
    assert T.geo_of_xy(moved, Now(), x + 2000.0, y - 1000.0) == pytest.approx((40.0, 20.0))
    sphere = MapDef("Cylindrical Equal-Area", lat0=0, lon0=0)
    assert T.map_xy(sphere, Now(), 0.0, 10.0) == pytest.approx(T.map_xy(sphere.changed(lat1=30.0), Now(), 0.0, 10.0))
    ellipsoid = MapDef("Cylindrical Equal-Area Ellipsoid", lat0=0, lon0=0)
    assert T.map_xy(ellipsoid, Now(), 0.0, 10.0) == pytest.approx(T.map_xy(ellipsoid.changed(lat1=999.0), Now(), 0.0, 10.0))
    assert T.map_xy(ellipsoid, Now(), 0.0, 10.0)[0] != pytest.approx(T.map_xy(ellipsoid.changed(lat1=30.0), Now(), 0.0, 10.0)[0])
    goode = MapDef("Goode Homolosine", lat0=0, lon0=0)
    assert T.map_xy(goode, Now(), 50.0, 20.0) == T.map_xy(goode.changed(lon0=90.0), Now(), 50.0, 20.0)


@pytest.mark.parametrize("e", [0.01, 0.0822719, 0.3, 0.8])
def test_latitudes_solve_their_equations(e):
    """Residuals of the inverse formulas, whatever the way to the solution."""
    for k in range(-899, 900, 7):
        phi = math.radians(k / 10)
        q = projections._q(e, math.sin(phi))
        assert projections._phi_of_q(Now(), e, q) == pytest.approx(phi, abs=2e-9 if abs(k) < 880 else 2e-6)
    conic = MapDef("Lambert Conic Conformal Ellipsoid", lat0=33, lat1=45, lon0=-96, center_lat=23, center_lon=-96, eccentricity=e)
    for lat in range(-70, 90, 5):
        assert T.geo_of_xy(conic, Now(), *T.map_xy(conic, Now(), float(lat), -60.0)) == pytest.approx((lat, -60.0), abs=1e-8)


def test_homolosine_solves_its_equation():
    for delta in (1e-8, 1e-6, 1e-4, 0.003, 0.01, 0.03, 0.1, 0.3, 0.6, 0.86):
        v = projections._from_pole(Now(), delta)
        size = math.pi * 2 * math.sin(delta / 2) ** 2
        left = v - math.sin(v) if v > 0.05 else v**3 / 6 - v**5 / 120 + v**7 / 5040
        assert left == pytest.approx(size, rel=1e-9)
    goode = MapDef("Goode Homolosine", lat0=0, lon0=0)
    for lat, lon in ((90.0, 20.0), (-90.0, 20.0), (90.0, -180.0), (-90.0, 180.0), (89.999999, 20.0)):
        x, y = T.map_xy(goode, Now(), lat, lon)
        assert abs(y) == pytest.approx((2**0.5 - projections.OFFSET) * goode.Rg, rel=1e-9)  # one pole in each lobe
        assert T.geo_of_xy(goode, Now(), x, y)[0] == pytest.approx(lat, abs=2e-6)


def test_series_constants():
    label = EXAMPLES[7][0].replace("Map Eccentricity: 0.0822719", "Map Eccentricity Squared: 0.00676866")
    assert T.map_xy(MapDef.parse(label), Now(), 40.5, -73.5)[1] == pytest.approx(4484124.4561541, abs=5e-7)
    strict = MapDef.parse(label).changed(strict=True)
    assert T.map_xy(strict, Now(), 40.5, -73.5)[1] == pytest.approx(4484124.4285, abs=2e-3)
    assert T.geo_of_xy(strict, Now(), *T.map_xy(strict, Now(), 40.5, -73.5)) == pytest.approx((40.5, -73.5), abs=1e-8)


def test_bounds_and_errors():
    m = MapDef("Cylindrical Equidistant", lat0=0, lon0=180, west=150, east=-150)
    assert m.straddles and T.within(m, 0.0, 170.0) and T.within(m, 0.0, -170.0) and not T.within(m, 0.0, 0.0) and T.within(m, 90.0, 510.0)
    utm = MapDef("UTM", utm_zone=18)
    assert math.isnan(T.map_xy(utm, Now(), 45.0, -30.0)[0]) and not math.isnan(T.map_xy(utm, Now(), 45.0, -74.0)[0])
    far = MapDef("Orthographic", lat0=0, lon0=0)
    assert math.isnan(T.map_xy(far, Now(), 0.0, 120.0)[0]) and math.isnan(T.geo_of_xy(far, Now(), 7000.0, 0.0)[0])
    pole = MapDef("Polar Stereographic Ellipsoid", lat0=90, lon0=0, scale=10)
    half = MapDef("Polar Stereographic Ellipsoid", lat0=90, lon0=0, scale=20)
    assert T.map_xy(pole, Now(), 80.0, 10.0) == pytest.approx(T.map_xy(half, Now(), 80.0, 10.0))  # the map scale is ignored


def test_distance():
    m = MapDef("Cylindrical Equal-Area Ellipsoid", lat0=0, lon0=0, lat1=30, equatorial_radius=6378.14, eccentricity=0.0818192)
    paris, washington = (48.836388889, 2.337222222), (38.921388889, -77.065555556)
    assert T.ellipsoid_distance(m, Now(), *paris, *washington) == pytest.approx(6181.63, abs=0.01)
    assert T.ellipsoid_distance(m, Now(), *paris, *paris) == 0


def test_words_behind_the_numbers_are_passed_over(tmp_path):
    (tmp_path / "m.mpp").write_text("Mercator\n0 -30 20 where it is true\n0 not turned\n12.5 to the inch\n0 -30 its middle\n-85 85 from south to north\n-180 180 and west to east\n15 30 lines\n0 0 names\n1 0 0 what to draw\n")
    (tmp_path / "g.gpd").write_text("m.mpp is the map\n40 20 cells\n2 to a unit\n19.5 9.5 is the origin\n")
    g = GridDef.load("g.gpd", str(tmp_path))
    assert (g.cols, g.rows, g.cols_per_unit, g.origin_col, g.origin_row) == (40, 20, 2.0, 19.5, 9.5)
    assert (g.map.projection, g.map.lon0, g.map.scale, g.map.south, g.map.lat_interval) == ("MERCATOR", -30.0, 12.5, -85.0, 15.0)
