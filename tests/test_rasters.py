import math
from fractions import Fraction

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera import queries as Q
from tessera.functions import geodesy, scalar
from tessera.functions.scalar import Now, Steps
from tessera.functions.sql import register_grid, register_map
from tessera.operators import accuracy, cells, chains, extract, gridding, models, resample, vectors
from tessera.operators import transform as T
from tessera.plans.definitions import GridDef, MapDef

SF = "/root/testdata/sf0.001"

EAST = MapDef("Cylindrical Equidistant", lat0=0, lon0=0, equatorial_radius=180 / math.pi)
FINE = GridDef(EAST, 24, 12, 1 / 15, None, 11.5, 5.5)
WIDE = GridDef(EAST, 9, 5, 1 / 40, None, 4.1, 2.2)


def table(spark, values):
    rows = [(r, c, None if np.isnan(v) else float(v)) for (r, c), v in np.ndenumerate(values)]
    return spark.createDataFrame(rows, "row int, col int, value double")


def array(df, g):
    out = np.full((g.rows, g.cols), np.nan)
    for r in df.collect():
        out[r["row"], r["col"]] = np.nan if r["value"] is None else r["value"]
    return out


@pytest.fixture(scope="module")
def values():
    v = np.random.default_rng(2).integers(0, 50, (FINE.rows, FINE.cols)).astype(float)
    v[3, 4:9] = 0
    return v


#: One of each kind; the SQL of all others is compared by the driver.
KINDS = ["azimuthal_equal_area", "mollweide", "polar_stereographic_ellipsoid", "lambert_conic_conformal_ellipsoid", "integerized_sinusoidal", "universal_transverse_mercator"]


@pytest.mark.parametrize("name", KINDS)
def test_columns_are_floats_and_come_back(spark, name):
    m = Q.MAPS[name]
    rng = np.random.default_rng(1)
    pts = [(float(a), float(b)) for a, b in zip(rng.uniform(max(m.south, -88), min(m.north, 88), 40), rng.uniform(m.west, m.east, 40), strict=True)]
    df = T.with_uv(spark.createDataFrame(pts, "lat double, lon double"), m)
    for r in T.with_geo_of_uv(df, m, out=("lat2", "lon2")).collect():
        u, v = T.point_xy(m, r.lat, r.lon)
        assert (r.u is None) == math.isnan(u)
        if r.u is not None:
            assert (r.u, r.v) == pytest.approx((u, v), rel=1e-9, abs=1e-6)
            if r.lat2 is not None:
                assert r.lat2 == pytest.approx(r.lat, abs=1e-3)


def place(g, own, i, j):
    lat, lon, ok = T.place_geo(own, float(j), float(i))
    if not ok:
        return None
    r, s, on = T.point_place(g, lat, lon)
    return (r, s) if on else None


def gather(values, offsets, weight):
    out = np.full((WIDE.rows, WIDE.cols), np.nan)
    for i in range(WIDE.rows):
        for j in range(WIDE.cols):
            if not (p := place(FINE, WIDE, i, j)):
                continue
            num = den = 0.0
            for di in offsets:
                for dj in offsets:
                    a, b = int(p[1]) + di, int(p[0]) + dj
                    if 0 <= a < FINE.rows and 0 <= b < FINE.cols and values[a, b] != 0:
                        w = weight(p[1], p[0], a, b, di, dj)
                        num, den = num + w * values[a, b], den + w
            if den:
                out[i, j] = num / den
    return out


def cubic(d, k):
    return {-1: -d * (1 - d) ** 2, 0: 1 - 2 * d * d + d**3, 1: d * (1 + d - d * d), 2: -d * d * (1 - d)}[k]


def test_regrid_stencils(spark, values):
    src = table(spark, values)
    got = array(resample.regrid(src, FINE, WIDE, "bilinear", fill=0.0), WIDE)
    want = gather(values, (0, 1), lambda s, r, a, b, di, dj: (1 - abs(s - a)) * (1 - abs(r - b)))
    np.testing.assert_allclose(got, np.nan_to_num(want))
    got = array(resample.regrid(src, FINE, WIDE, "cubic", fill=0.0), WIDE)
    np.testing.assert_allclose(got, gather(values, (-1, 0, 1, 2), lambda s, r, a, b, di, dj: cubic(s - int(s), di) * cubic(r - int(r), dj)))
    got = array(resample.regrid(src, FINE, WIDE, "nearest", fill=0.0), WIDE)
    want = np.full(got.shape, np.nan)
    for i in range(WIDE.rows):
        for j in range(WIDE.cols):
            if (p := place(FINE, WIDE, i, j)) and values[int(p[1] + 0.5), int(p[0] + 0.5)]:
                want[i, j] = values[int(p[1] + 0.5), int(p[0] + 0.5)]
    np.testing.assert_allclose(got, np.nan_to_num(want))  # cells without data hold the fill value


def dealt(values):
    out = {}
    for i in range(FINE.rows):
        for j in range(FINE.cols):
            if values[i, j] and (p := place(WIDE, FINE, i, j)):
                out.setdefault((int(p[1] + 0.5), int(p[0] + 0.5)), []).append(values[i, j])
    return out


def test_buckets(spark, values):
    src, want = table(spark, values), dealt(values)
    got = array(resample.regrid(src, FINE, WIDE, "bucket", fill=0.0, whole=False), WIDE)
    top = array(resample.regrid(src, FINE, WIDE, "max", fill=0.0, whole=False), WIDE)
    exact = array(resample.resamp(src, FINE, WIDE, "bucket", fill=0.0, exact=True), WIDE)
    once = array(resample.resamp(src, FINE, WIDE, "bucket", fill=0.0), WIDE)
    share = {(r["row"], r["col"], r["class"]): r["percent"] for r in resample.distribution(src, FINE, WIDE, 1, 9, fill=0.0).collect()}
    for i in range(WIDE.rows):
        for j in range(WIDE.cols):
            v = want.get((i, j), [])
            mean = 0.0
            for n, x in enumerate(v):
                mean = int((mean * n + x) / (n + 1) + 0.5)
            assert exact[i, j] == mean and once[i, j] == (int(np.mean(v) + 0.5) if v else 0)
            inside = [x for x in v if 1 <= x <= 9]
            for k in range(1, 10):
                assert share[i, j, k] == (int(100 * inside.count(k) / len(inside) + 0.5) if inside else -1)
            if v:
                assert got[i, j] == pytest.approx(np.mean(v)) and top[i, j] == max(v)
            else:
                assert np.isnan(got[i, j])


def test_reduction_and_minification(spark, values):
    src = table(spark, values)
    small = FINE.shrink(3)
    got, one = array(resample.resamp(src, FINE, factor=3, method="reduction"), small), array(resample.resamp(src, FINE, factor=3), small)
    for i in range(small.rows):
        for j in range(small.cols):
            assert got[i, j] == int(values[3 * i : 3 * i + 3, 3 * j : 3 * j + 3].mean() + 0.5)
            assert one[i, j] == values[int(3 * (i + 0.5) + 0.5), int(3 * (j + 0.5) + 0.5)]
    with pytest.raises(ValueError):
        resample.resamp(src, FINE)
    with pytest.raises(ValueError):
        resample.resamp(src, FINE, WIDE, "reduction")
    assert resample.choose_method(FINE, WIDE, False, False) == "bucket" and resample.choose_method(WIDE, FINE, False, False) == "bilinear"


def test_merged_states(spark, values):
    src = table(spark, values)
    half = [src.filter(F.col("col") % 2 == k) for k in (0, 1)]
    a, b = (resample.regrid_state(h, FINE, WIDE, "bucket") for h in half)
    both = resample.read_state(resample.merge_states(a, b, "bucket"), "bucket")
    np.testing.assert_allclose(array(both, WIDE), array(resample.regrid(src, FINE, WIDE, "bucket", whole=False), WIDE))
    old = spark.createDataFrame([(0, 0, 5.0, 1.2), (0, 1, 6.0, 1.0), (9, 9, 1.0, 1.0)], "row int, col int, num double, beta double")
    new = spark.createDataFrame([(0, 0, 7.0, 2.1), (0, 1, 8.0, 2.3), (3, 3, 2.0, 1.5)], "row int, col int, num double, beta double")
    got = {(r["row"], r["col"]): r["num"] for r in resample.merge_states(old, new, "nearest").collect()}
    assert got == {(0, 0): 7.0, (0, 1): 6.0, (9, 9): 1.0, (3, 3): 2.0}  # 1.1 <= 1.2, but 1.3 > 1.0


POINTS = [(10.0, 20.0, 4.0, 1), (12.0, 25.0, 6.0, 2), (-30.0, -170.0, 9.0, 3), (88.0, 179.0, 2.0, 4), (0.0, 0.0, 0.0, 5), (10.0, 20.0, 8.0, 6), (-89.9, 100.0, 3.0, 7), (None, 1.0, 1.0, 8), (1.0, 1.0, None, 9)]


@pytest.mark.parametrize("method", gridding.METHODS)
def test_points_to_cells(spark, method):
    df = spark.createDataFrame(POINTS, "lat double, lon double, value double, line int")
    got = {(r["row"], r["col"]): (r["value"], r["n"]) for r in gridding.grid_points(df, FINE, method, radius=1.5, order=("line",)).collect()}
    sums = {}
    for lat, lon, v, line in POINTS:
        if not v or lat is None:
            continue
        r, s, _ = T.point_place(FINE, lat, lon)
        for i in range(int(s + 0.5) - 3, int(s + 0.5) + 4):
            for j in range(int(r + 0.5) - 3, int(r + 0.5) + 4):
                d = math.hypot(r - j, s - i)
                if 0 <= i < FINE.rows and 0 <= j < FINE.cols and (method == "bucket" or d <= 1.5):
                    w = {"cressman": (2.25 - d * d) / (2.25 + d * d), "idw": 1 / d**2 if d else 0.0}.get(method, 1.0)
                    sums.setdefault((i, j), []).append((d, line, w, v))
    assert set(got) == set(sums)
    for k, each in sums.items():
        w = sum(x[2] for x in each)
        want = min(each, key=lambda x: (round(x[0], 9), -x[1]))[3] if method == "nearest" else sum(x[2] * x[3] for x in each) / w if w else None
        assert got[k][1] == len(each) and (got[k][0] is None if want is None else got[k][0] == pytest.approx(want))


@pytest.mark.parametrize("method", extract.METHODS)
def test_extract(spark, values, method):
    pts = [(k, lat, lon) for k, (lat, lon) in enumerate([(10.0, 20.0), (-80.0, 170.0), (0.1, -179.9), (37.5, 7.5), (95.0, 0.0)])]
    df = spark.createDataFrame(pts, "id int, lat double, lon double")
    got = {r["id"]: (r["value"], r["n"]) for r in extract.extract(df, table(spark, values), FINE, ["id"], method, radius=1.5, fill=-9.0, low=1.0).collect()}
    for k, lat, lon in pts:
        r, s, on = T.point_place(FINE, lat, lon)
        num = den = n = 0
        offsets = {"nearest": (0,), "bilinear": (0, 1)}.get(method, (-1, 0, 1, 2))
        for di in offsets:
            for dj in offsets:
                a, b = int(s + (0.5 if method == "nearest" else 0)) + di, int(r + (0.5 if method == "nearest" else 0)) + dj
                if not on or not (0 <= a < FINE.rows and 0 <= b < FINE.cols) or values[a, b] < 1:
                    continue
                d = math.hypot(r - b, s - a)
                w = {"nearest": 1.0, "average": float(d <= 1.5), "bilinear": (1 - abs(s - a)) * (1 - abs(r - b)), "distance": (d**-2 if d else 1e18) if d <= 1.5 else 0.0}.get(method)
                w = cubic(s - int(s), di) * cubic(r - int(r), dj) if w is None else w
                if method == "average" and not w:
                    continue
                num, den, n = num + w * values[a, b], den + w, n + 1
        assert got[k][1] == n
        assert got[k][0] == pytest.approx(num / den if abs(den) > 1e-12 else -9.0)


def test_extract_with_repeated_keys(spark, values):
    """Points of one key at two places, one of them twice, and one without a place."""
    rows = [(1, 10.0, 20.0), (1, -30.0, 50.0), (1, -30.0, 50.0), (2, None, 5.0)]
    df, src = spark.createDataFrame(rows, "id int, lat double, lon double"), table(spark, values)
    got = extract.extract(df, src, FINE, ["id"], "bilinear").collect()
    assert sorted((r["id"], r["lat"], r["lon"]) for r in got if r["lat"] is not None) == sorted(rows[:3]) and len(got) == 4
    for r in got:
        alone = extract.extract(df.limit(0).unionByName(spark.createDataFrame([(r["id"], r["lat"], r["lon"])], df.schema)), src, FINE, ["id"], "bilinear").first()
        assert (r["value"], r["n"]) == (alone["value"], alone["n"])


def test_accuracy(spark):
    """Every map that is not cut comes back within 20 metres (the arc length's own error near 0), each cell exactly."""
    for name in ("azimuthal_equal_area_polar", "mollweide", "polar_stereographic", "sinusoidal", "lambert_conic_conformal_ellipsoid", "transverse_mercator"):
        r = accuracy.map_accuracy(spark, Q.MAPS[name]).first()
        assert r["points"] == 320 * 320 and r["bad"] == 0 and 0 <= r["avg"] <= r["max"] < 0.02 and r["sd"] < 0.002
    for g in (Q.NORTH, Q.COARSE, Q.WORLD.zoom(2)):
        r = accuracy.grid_accuracy(spark, g).first()
        assert r["bad"] == 0 and 0 < r["avg"] <= r["max"] < 1e-12
    assert all(r["bad"] == 0 and r["max"] < 0.02 for r in Q.map_accuracy_values(spark, SF).collect())
    assert all(r["bad"] == 0 and r["max"] < 1e-12 for r in Q.grid_accuracy_values(spark, SF).collect())


def test_zoom():
    """A grid that is cut finer has its corners where they were."""
    fine = Q.WORLD.zoom(4)
    assert (fine.cols, fine.rows) == (1384, 588) and Q.WORLD.zoom(1) == Q.WORLD
    for row, col in ((30.0, 40.0), (12.5, 99.5)):
        at = T.point_place(Q.WORLD, *T.geo_of_place(Q.WORLD, Now(), col, row)[:2])[:2]
        assert T.point_place(fine, *T.geo_of_place(Q.WORLD, Now(), col, row)[:2])[:2] == pytest.approx([(x + 0.5) * 4 - 0.5 for x in at], abs=1e-6)


def test_cells_and_locations(spark):
    rows = cells.locations(spark, WIDE, undefined=-999.0).collect()
    assert len(rows) == WIDE.n_cells and [(r["row"], r["col"]) for r in rows[:10]] == [(0, j) for j in range(9)] + [(1, 0)]
    assert sum(r["lat"] == -999.0 for r in rows) == sum(not T.place_geo(WIDE, float(j), float(i))[2] for i in range(5) for j in range(9))
    assert cells.all_locations(spark, {"a": WIDE, "b": FINE}).groupBy("grid").count().collect() != [] and cells.all_locations(spark, {"a": WIDE, "b": FINE}).count() == WIDE.n_cells + FINE.n_cells
    filled = cells.filled(spark.createDataFrame([(0, 0, 1.0), (0, 1, None)], "row int, col int, value double"), WIDE, -1.0)
    assert filled.count() == 45 and filled.filter("value = -1").count() == 44


def test_sql_functions(spark):
    register_map(spark, "world", Q.MAPS["cylindrical_equal_area"])
    register_grid(spark, "north", Q.NORTH)
    r = spark.sql("SELECT world_u(10D, 20D) AS u, world_lat(world_u(10D, 20D), world_v(10D, 20D)) AS lat, north_col(60D, 30D) AS c").first()
    assert r.u == pytest.approx(T.point_xy(Q.MAPS["cylindrical_equal_area"], 10, 20)[0]) and r.lat == pytest.approx(10)
    assert r.c == pytest.approx(T.point_place(Q.NORTH, 60, 30)[0])
    with pytest.raises(ValueError):
        register_map(spark, "goode", Q.MAPS["interrupted_homolosine"])


def test_geodesy(spark):
    assert geodesy.arc_length(Now(), 0.0, 0.0, 0.0, 90.0) == pytest.approx(math.pi / 2 * 6371.228)
    assert geodesy.west_azimuth(Now(), 10.0, 0.0, 10.001, -0.001) == pytest.approx(44.56, abs=0.01)
    assert geodesy.bisect(Now(), 0.0, 0.0, 0.0, 90.0) == pytest.approx((0.0, 45.0))
    assert math.isnan(geodesy.bisect(Now(), 0.0, 0.0, 0.0, 180.0)[0])
    assert geodesy.rectangular(Now(), 90.0, 0.0, 4.0, 1.0) == pytest.approx((0, 0, 1))
    square = [(10.0, 0.0), (10.0, 10.0), (0.0, 10.0), (0.0, 0.0)]
    dart = [(10.0, 0.0), (2.0, 2.0), (0.0, 10.0), (0.0, 0.0)]
    inside = lambda box, a, b: bool(geodesy.within_box(Now(), a, b, box))
    assert inside(square, 5.0, 5.0) and not inside(square, 5.0, 11.0) and not inside(square, -1.0, 5.0)
    assert inside(dart, 1.0, 1.0) and not inside(dart, 5.0, 5.0) and inside(dart, 1.0, 5.0)
    text = spark.createDataFrame([("12 30 N 45 15 W",), ("12.5S, 190 E",), ("-3.5 7",), ("north",), (None,)], "t string")
    got = [None if r.g is None else (r.g.lat, r.g.lon) for r in text.select(geodesy.lat_lon_of_text(F.col("t")).alias("g")).collect()]
    assert got == [(12.5, -45.25), (-12.5, -170.0), (-3.5, 7.0), None, None]
    assert scalar.nint(-1.2) == 0 and scalar.nint(1.5) == 2 and scalar.normal_lon(540.0) == 180 and math.isnan(scalar.div(1.0, 0.0))


def test_models(spark, tmp_path):
    cube = models.Spline.fit(range(10), [x**3 for x in range(10)])
    assert cube.evaluate(2.5) == pytest.approx(15.625)
    df = spark.createDataFrame([(-1.0,), (0.0,), (2.5,), (9.0,), (10.0,)], "x double")
    assert [r.y for r in df.select(cube.evaluate(F.col("x")).alias("y")).collect()] == pytest.approx([cube.evaluate(x) for x in (-1.0, 0.0, 2.5, 9.0, 10.0)])
    cube.save(spark, str(tmp_path / "s"))
    assert models.Spline.load(spark, str(tmp_path / "s")) == cube
    assert models.Spline.fit([0, 2], [1, 5]).evaluate(1.0) == 3
    turn = models.Spline.fit([0, 1, 2, 3], [170, 179, -172, -163], "longitude")
    assert turn.evaluate(1.5) == pytest.approx(183.5)
    with pytest.raises(ValueError):
        models.Spline.fit([0, 0], [1, 2])
    pts = [(x / 7, y / 5, 1 + 2 * x / 7 - 3 * y / 5 + 0.5 * x * y / 35) for x in range(8) for y in range(6)]
    p = models.fit_polynomial(spark.createDataFrame(pts, "x double, y double, z double"), 1, "x", "z", "y")
    assert p.coefficients == pytest.approx((1, -3, 2, 0.5)) and p.evaluate(0.5, 0.5) == pytest.approx(1 + 1 - 1.5 + 0.125)
    t = models.test_polynomial(spark.createDataFrame(pts, "x double, y double, z double"), p, "x", "z", "y").first()
    assert t.sse == pytest.approx(0, abs=1e-12) and t.r2 == pytest.approx(1) and t.r2_fitted == pytest.approx(1)
    with pytest.raises(ValueError):
        models.fit_polynomial(spark.createDataFrame(pts[:2], "x double, y double, z double"), 1, "x", "z")
    a = np.array([[1.0, 0], [1, 1], [1, 2]])
    assert models.cholesky_solve(a, a @ [2, 3]) == pytest.approx([2, 3]) and models.svd_solve(a, a @ [2, 3]) == pytest.approx([2, 3])


def test_fit_by_triangular_factors(spark, monkeypatch):
    """Order 9 in two dimensions, over several levels of the tree: as numpy's from the matrix, where sums of products lose it."""
    monkeypatch.setattr(models, "FANIN", 3)
    rng = np.random.default_rng(7)
    x, y = rng.uniform(-1, 1, 6000), rng.uniform(-1, 1, 6000)
    z = np.sin(5 * x) * np.exp(y) + 0.1 * x * y
    df = spark.createDataFrame([(float(a), float(b), float(c)) for a, b, c in zip(x, y, z, strict=True)] + [(None, 1.0, 1.0), (1.0, None, 1.0), (1.0, 1.0, None), (float("nan"), 0.0, 0.0)], "x double, y double, z double").repartition(10)
    a = np.stack([x**i * y**j for i, j in models.Polynomial.exponents(2, 9)], 1)
    want = np.linalg.lstsq(a, z, rcond=None)[0]
    fit = models.fit_polynomial(df, 9, "x", "z", "y")
    assert np.abs(np.array(fit.coefficients) - want).max() < 1e-8 * np.abs(want).max()
    assert np.abs(np.linalg.solve(a.T @ a, a.T @ z) - want).max() > 1e-5
    line = models.fit_polynomial(df.dropna(), 1, "x", "z")
    assert list(line.coefficients) == pytest.approx(np.polyfit(x, z, 1)[::-1].tolist(), abs=1e-10)


def test_splines_of_many_knots(spark):
    """Uneven knots, points between, on and outside them, nulls; coefficients as of the dense system."""
    rng = np.random.default_rng(1)
    x = np.cumsum(rng.uniform(0.1, 1.0, 100_000))
    s = models.Spline.fit(x, x**3 / 1e9 + 2 * x)
    rows = [(float(v),) for v in [*rng.uniform(-5, x[-1] + 5, 500), *x[:300], x[-1], -100.0, 1e6]] + [(None,)]
    df = spark.createDataFrame(rows, "v double").selectExpr("v", "'own' AS value")
    got = {r.v: r.value for r in s.values(df, "v").collect()}
    assert len(got) == len(set(rows)) and got.pop(None) is None
    assert all(y == pytest.approx(s.evaluate(v), rel=1e-12, abs=1e-9) and y == pytest.approx(v**3 / 1e9 + 2 * v, rel=1e-6, abs=1e-5) for v, y in got.items() if -5 < v < x[-1] + 5)
    low, mid, up, r = (rng.normal(size=60) for _ in range(4))
    m = np.diag(mid + 5) + np.diag(up[:-1], 1) + np.diag(low[1:], -1)
    assert models.tridiagonal(low, mid + 5, up, r) == pytest.approx(np.linalg.solve(m, r))
    assert models.Spline.fit([0, 1, 2], [0, 1, 8]).values(df.limit(0), "v").count() == 0
    with pytest.raises(ValueError):
        s.evaluate(F.col("v"))


def test_spline_of_large_part_numbers_is_the_cube(spark, tmp_path):
    """As many as the parts are: against the query's SQL, which has the places of all parts 0.001 apart."""
    spark.range(1_000_000, 1_200_000, 1, 8).toDF("p_partkey").write.parquet(f"{tmp_path}/part.parquet")
    spark.range(1_000_000, 1_200_000, 1, 8).selectExpr("id AS l_orderkey", "1 AS l_linenumber", "id AS l_partkey").write.parquet(f"{tmp_path}/lineitem.parquet")
    got = Q.spline_join(spark, str(tmp_path)).toPandas().sort_values("l_orderkey").value.tolist()
    db = duckdb.connect()
    for name in ("part", "lineitem"):
        db.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet/*.parquet'")
    assert got == [r[0] for r in db.execute(f"SELECT value FROM ({Q.SQL['spline_join']}) ORDER BY l_orderkey").fetchall()]
    x = [k * 0.001 + 0.0003 for k in range(1_000_000, 1_200_000)]
    assert got == [math.floor(v * v * v * (1 / 1e-4) + 0.5) for v in x] and got[-1] > 1.7e13


def test_spline_with_a_trend(spark, tmp_path):
    """The same spline as without, of values that are no cubic; a cubic comes out as it is, and both are saved and loaded."""
    x = [0.0, 0.5, 0.75, 2.0, 2.25, 3.0, 4.5, 5.0]
    plain, taken = models.Spline.fit(x, np.sin(x)), models.Spline.fit(x, lambda v: Fraction(math.sin(v)), trend=True)
    at = np.linspace(-0.5, 5.5, 200).tolist()
    assert max(abs(c) for c in taken.y) > 0.01 and [taken.evaluate(v) for v in at] == pytest.approx([plain.evaluate(v) for v in at], abs=1e-13)
    df = spark.createDataFrame([(v,) for v in at], "v double")
    taken.save(spark, str(tmp_path / "s"))
    assert models.Spline.load(spark, str(tmp_path / "s")) == taken
    assert {r.v: r.value for r in taken.values(df, "v").collect()} == {v: taken.evaluate(v) for v in at}
    assert {r.v: r.value for r in df.select("v", taken.evaluate(F.col("v")).alias("value")).collect()} == {v: taken.evaluate(v) for v in at}
    cube = models.Spline.fit(x, lambda v: Fraction(v) ** 3 - 2, trend=True)
    assert cube.trend == (-2.0, 0.0, 0.0, 1.0) and not any(cube.y) and cube.evaluate(0.3) == 0.3 * 0.3 * 0.3 - 2
    assert models.Spline.fit(x[:3], math.sin, trend=True) == models.Spline.fit(x[:3], [math.sin(v) for v in x[:3]])
    with pytest.raises(ValueError):
        models.Spline.fit(x, math.sin, "longitude", trend=True)


def test_segments(spark):
    p = spark.createDataFrame([(s, k, 10.0 + s + k / 1024, 178.0 + k * 0.8 if s else 20.0 + k / 1024) for s in range(2) for k in range(6)], "seg int, pos int, lat double, lon double")
    p = p.withColumn("lon", F.when(F.col("lon") > 180, F.col("lon") - 360).otherwise(F.col("lon")))
    cut = vectors.split_at_date_line(p).orderBy("seg", "part", "pos").toPandas()
    assert cut[cut.seg == 1].part.nunique() == 2 and set(cut[(cut.seg == 1) & (cut.lon.abs() == 180)].lon) == {180.0, -180.0}
    assert (cut.groupby(["seg", "part"]).lon.apply(lambda x: x.diff().abs().max()) < 1).all()
    back = vectors.decode(vectors.encode(p.filter("seg = 0"))).orderBy("pos").collect()
    assert [r.lat for r in back] == [10.0 + k / 1024 for k in range(6)]
    raw = p.withColumn("rank", F.col("seg") + 1)
    assert vectors.prepare(raw, [1]).select("seg").distinct().collect()[0][0] == 0 and vectors.prepare(raw, box=(0, 90, 170, -170)).filter("seg = 0").isEmpty()


def test_chains(spark):
    """Pieces of a line, some backwards, a far piece and a ring: the first segment of each takes the others."""
    line = [(0.0, 0.5 * k) for k in range(17)]
    parts = [line[0:5], line[4:9][::-1], line[8:13], line[12:17][::-1]]
    ring = [[(20, 20), (21, 20)], [(21, 20), (21, 21)], [(20, 20), (21, 21)]]
    segs = dict(zip((7, 3, 9, 5), parts, strict=True)) | dict(zip((20, 21, 22), ring, strict=True)) | {1: [(50, 50), (51, 51)]}
    rows = [(s, k, float(a), float(b)) for s, pts in segs.items() for k, (a, b) in enumerate(pts)]
    got = vectors.join_ends(spark.createDataFrame(rows, "seg int, pos int, lat double, lon double"), 5.0).orderBy("seg", "pos").toPandas()
    assert len(got) == len(rows)
    by = {s: list(zip(g.lat, g.lon, strict=True)) for s, g in got.groupby("seg")}
    assert set(by) == {3, 20, 1}
    walked = [p for k, p in enumerate(by[3]) if not k or p != by[3][k - 1]]
    assert walked in (line, line[::-1])
    assert len(by[20]) == 6 and by[20][0] == by[20][-1]


def test_extension_point(spark, monkeypatch):
    """A projection of one's own is an entry of the registry."""
    from tessera.functions import projections

    class Plate(projections.Projection):
        def forward(self, s, lat, lon):
            return lon * 1.0, lat * 1.0, True

        def inverse(self, s, x, y):
            return y * 1.0, x * 1.0, True

    monkeypatch.setitem(projections.REGISTRY, "PLATE", Plate)
    m = MapDef("Plate", lat0=0, lon0=0)
    assert T.point_xy(m, 3, 4) == (4, 3)
    s = Steps(spark.createDataFrame([(1.0, 2.0)], "lat double, lon double"))
    x, y = T.map_xy(m, s, F.col("lat"), F.col("lon"))
    assert tuple(s.df.select(x, y).first()) == (2.0, 1.0)


def test_stencils_send_a_place_once(spark, values):
    """No broadcast of places times samples, whose size the planner takes for that of the places' numbers, and no sums by place."""
    src = table(spark, values)
    points_ = spark.createDataFrame([(1, 10.0, 20.0)], "id int, lat double, lon double")
    for df in (resample.regrid(src, FINE, WIDE, "cubic", whole=False), resample.regrid(src, FINE, WIDE, "bilinear", whole=False), extract.extract(points_, src, FINE, ["id"], "distance"), extract.extract(points_, src, FINE, ["id"], "average")):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "Broadcast" not in plan and "keys=[id" not in plan and "keys=[i#" not in plan and plan.count("Exchange hashpartitioning") <= 3


@pytest.mark.parametrize("low, high", [(0, 1), (-1, 2), (-2, 3)])
def test_neighbourhoods_over_tiles(spark, low, high):
    g, rng = GridDef(EAST, 150, 140, 1 / 2, None, 74.5, 69.5), np.random.default_rng(4)
    cells_ = {(int(r), int(c)): float(v) for v, (r, c) in enumerate(zip(*np.nonzero(rng.random((140, 150)) < 0.3), strict=True))}
    df = spark.createDataFrame([(r, c, v) for (r, c), v in cells_.items()], "row int, col int, value double")
    square = [(dr, dc) for dr in range(low, high + 1) for dc in range(low, high + 1)]
    want = {(r - dr, c - dc) for r, c in cells_ for dr, dc in square}
    got = cells.neighbourhoods(df, g, low, high).collect()
    assert len(got) == len(want) and {(x["_row"], x["_col"]) for x in got} == want
    assert all(x[f"_v{k}"] == cells_.get((x["_row"] + dr, x["_col"] + dc)) for x in got for k, (dr, dc) in enumerate(square))


def test_tall_factors_are_made_of_small_ones(monkeypatch):
    qr, heights, rows = np.linalg.qr, [], np.random.default_rng(5).random((10_007, 17))
    monkeypatch.setattr(models.np.linalg, "qr", lambda a, mode: heights.append(a.shape[-2]) or qr(a, mode=mode))
    r = models._factors(np.zeros((0, 17)), [rows, rows[:1], rows[:700]])
    assert max(heights) <= models.TALL
    all_rows = np.vstack([rows, rows[:1], rows[:700]])
    assert np.allclose(r.T @ r, all_rows.T @ all_rows, rtol=1e-12)
