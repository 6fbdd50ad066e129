"""Elementary functions give the same doubles in Spark and DuckDB, to the last bit."""

import math
import struct
from dataclasses import replace

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera import queries as Q
from tessera.functions.scalar import Ctes, Sql, Steps
from tessera.operators import cells
from tessera.operators import transform as T
from tessera.plans.definitions import GridDef

from .test_rasters import SF

N = 200_000
#: x of each function from a number u of 0 to 1, as SQL of either engine.
RANGES = {"sin": "u * 14 - 7", "cos": "u * 14 - 7", "tan": "u * 3 - 1.5", "atan": "(u - 0.5) / (1.0001 - u)", "asin": "u * 2 - 1", "acos": "u * 2 - 1", "exp": "u * 40 - 20", "ln": "u * u * u * 20 + 1e-9", "ln1": "0.9 + u * 0.2", "power": "u * 3", "atan2": "u * 2 - 1"}


def _of(s, name, x, other):
    if name == "power":
        return s.power(x, 1 / 3)
    return s.atan2(x, other) if name == "atan2" else getattr(s, name.rstrip("1"))(x)


@pytest.mark.parametrize("name", RANGES)
def test_same_bits(spark, name):
    given = RANGES[name].replace("14", "14e0")
    df = spark.range(N).selectExpr("id", f"CAST((id * 7919 + 13) % {N} AS DOUBLE) / {N}D AS u").selectExpr("id", f"{given} AS x", "u * u - 0.3D AS y")
    s = Steps(df.selectExpr("id", "CAST(x AS DOUBLE) AS x", "CAST(y AS DOUBLE) AS y"))
    v = s.let(_of(s, name, F.col("x"), F.col("y")))
    ours = s.df.select("id", "x", "y", v.alias("v")).toPandas().sort_values("id")
    db = duckdb.connect()
    db.register("given", ours[["id", "x", "y"]])
    c = Ctes("given")
    w = c.let(_of(c, name, Sql("x"), Sql("y")))
    theirs = db.sql(c.query(f"id, {w.sql} AS v")).df().sort_values("id")
    a, b = ours.v.to_numpy(), theirs.v.to_numpy()
    assert np.isfinite(a).all() and (a.view("i8") == b.view("i8")).all()
    x = ours.x.to_numpy().astype(np.longdouble)
    true = {"power": lambda: np.cbrt(x), "atan2": lambda: np.arctan2(x, ours.y.to_numpy().astype(np.longdouble)), "asin": lambda: np.arcsin(x), "acos": lambda: np.arccos(x), "atan": lambda: np.arctan(x), "ln": lambda: np.log(x), "ln1": lambda: np.log(x)}.get(name, lambda: getattr(np, name)(x))()
    assert (np.abs(a - true) <= (4 if name == "tan" else 2) * np.spacing(np.maximum(np.abs(a), 1.0))).all()  # and the right ones


def test_poles_and_limits(spark):
    """Where formulas go over: multiples of a right angle, 0, thresholds, and what has no result."""
    at = [0.0, 1.0, -1.0, 0.4375, 0.6875, 1.1875, 2.4375, np.pi / 2, -np.pi / 2, np.pi, -np.pi, 3 * np.pi / 2, 1e-9, 2.0**-30, 0.34657359027997264, 2.0, 0.5, 1.5, 1e17]
    s, c = Steps(spark.createDataFrame([(v,) for v in at], "x double").coalesce(1)), Ctes("given")
    names = ("sin", "cos", "atan", "asin", "acos", "exp", "ln")
    pick = lambda s, x: [s.let(getattr(s, n)(x)) for n in names[:5] + names[6:]] + [s.let(s.atan2(x, 0.0)), s.let(s.atan2(0.0, x)), s.let(s.atan2(x, x)), s.let(s.power(x, 0.5))]
    columns = pick(s, F.col("x"))
    ours = [tuple(r) for r in s.df.select(*columns).collect()]
    sql = pick(c, Sql("x"))
    bits = lambda v: v if v is None else struct.pack(">d", v + 0.0)
    theirs = duckdb.sql("WITH given AS (SELECT unnest([" + ", ".join(f"{v!r}e0" if "e" not in repr(v) else repr(v) for v in at) + "]) AS x), " + c.query(", ".join(v.sql for v in sql))[5:]).fetchall()
    assert [tuple(map(bits, r)) for r in ours] == [tuple(map(bits, r)) for r in theirs]


@pytest.mark.parametrize("name", ["inverse_azimuthal_equal_area", "inverse_mollweide", "inverse_interrupted_homolosine"])
def test_methods_are_short_enough_to_be_compiled(spark, name):
    """The JVM interprets methods of over 8,000 bytes."""
    stages = Q.QUERIES[name](spark, SF)._jdf.queryExecution().debug().codegenToSeq()
    assert max(stages.apply(i)._3().maxMethodCodeSize() for i in range(stages.size())) < 8000


def test_places_on_cut_grids(spark):
    """A grid that is cut finer has the places of its SQL, forth and back, whatever it is cut by."""
    df = spark.range(N).selectExpr("CAST(id AS INTEGER) AS i", "CAST((id * 7919) % 170000 AS DOUBLE) / 1000D - 85D AS lat", "CAST((id * 104729) % 359000 AS DOUBLE) / 1000D - 179.4863D AS lon")
    given = df.toPandas()
    for z in (1, 8, 25):
        fine = T.with_place(df, Q.WORLD.zoom(z), "lat", "lon", ("r", "s", "on"))
        ours = T.with_geo(fine, Q.NORTH.zoom(z), "i", "i", ("a", "b", "in_map")).select("r", "s", "on", "a", "b", "in_map", "i").toPandas().sort_values("i")
        c = Ctes("given")
        r, s, on = T.grid_place(Q.WORLD, c, Sql("lat"), Sql("lon"))
        a, b, ok = T.geo_of_place(Q.NORTH, c, Sql(Q.coarse("CAST(i AS DOUBLE)")), Sql(Q.coarse("CAST(i AS DOUBLE)")))
        db = duckdb.connect()
        db.register("given", given)
        db.execute(f"CREATE TABLE zoom AS SELECT {z} AS z")
        theirs = db.sql(c.query(f"i, {Q.fine(r)} AS r, {Q.fine(s)} AS s, {on.sql} AS on, {a.sql} AS a, {b.sql} AS b, {ok.sql} AS in_map") + " ORDER BY i").df()
        for k in ("r", "s", "a", "b"):
            x, y = ours[k].to_numpy(float), theirs[k].to_numpy(float)
            assert ((x.view("i8") == y.view("i8")) | (np.isnan(x) & np.isnan(y))).all(), (z, k)
        assert (ours.on.to_numpy(bool) == theirs.on.to_numpy(bool)).all() and ours.in_map.fillna(False).to_numpy(bool).sum() == theirs.in_map.fillna(False).to_numpy(bool).sum() > 40
    other = replace(Q.WORLD.zoom(25), origin_col=3.0)
    assert T.point_place(other, 10.0, 20.0) == T.point_place(GridDef(other.map, other.cols, other.rows, other.cols_per_unit, other.rows_per_unit, 3.0, other.origin_row), 10.0, 20.0)


def test_weights_of_distance(spark):
    """The weight of extract's distance method is 1 / d^2, rounded as the SQL rounds it: no root and power in between."""
    rng = np.random.default_rng(5)
    places = [(k, float(r), float(s)) for k, (r, s) in enumerate(rng.uniform(20, 90, (3000, 2)))]
    raster = spark.range(100 * 100).selectExpr("CAST(id div 100 AS INT) AS row", "CAST(id % 100 AS INT) AS col", "CAST(1 AS DOUBLE) AS value")
    grid = GridDef(Q.WORLD.map, 100, 100)
    got = {x["k"]: x["_w"] for x in cells.gathered(spark.createDataFrame(places, "k int, r double, s double"), raster, grid, "distance", 2, 1.5).collect()}
    for k, r, s in places:
        want = 0.0
        for i in range(int(s) - 1, int(s) + 3):
            for j in range(int(r) - 1, int(r) + 3):
                d2 = (i - s) * (i - s) + (j - r) * (j - r)
                want += 1.0 / d2 if math.sqrt(d2) <= 1.5 else 0.0
        assert got[k] == want
