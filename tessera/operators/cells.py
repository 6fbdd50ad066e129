"""Rasters as tables: one row (row, col, value) for each cell; a missing value is NULL."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalar import Steps
from ..plans.definitions import GridDef
from .transform import only, with_geo, with_place, within


def grid_cells(spark: SparkSession, g: GridDef) -> DataFrame:
    """row, col of every cell, in row-major order."""
    ids = spark.range(g.n_cells)
    return ids.select(F.expr(f"cast(id div {g.cols} as int)").alias("row"), F.expr(f"cast(id % {g.cols} as int)").alias("col"))


def locations(spark: SparkSession, g: GridDef, shift: tuple[float, float] = (0.0, 0.0), undefined: float | None = None) -> DataFrame:
    """row, col, lat, lon of each cell's centre, or of a point ``shift`` columns and rows away. Off the map: undefined."""
    cells = grid_cells(spark, g).withColumns({"_c": F.col("col") + F.lit(float(shift[0])), "_r": F.col("row") + F.lit(float(shift[1]))})
    found = with_geo(cells, g, "_c", "_r", ("lat", "lon", "in_map"))
    known = lambda c: F.when(F.col("in_map"), F.col(c)).otherwise(F.lit(undefined).cast("double"))
    return found.select("row", "col", known("lat").alias("lat"), known("lon").alias("lon"))


def all_locations(spark: SparkSession, grids: dict[str, GridDef]) -> DataFrame:
    """The locations of several grids: grid, row, col, lat, lon."""
    parts = [locations(spark, g).select(F.lit(name).alias("grid"), "row", "col", "lat", "lon") for name, g in grids.items()]
    return reduce(DataFrame.unionByName, parts)


def without_fill(raster: DataFrame, fill: float | None) -> DataFrame:
    """Cells with a value that is not the fill value."""
    out = raster.filter(F.col("value").isNotNull())
    return out if fill is None else out.filter(F.col("value") != F.lit(fill))


def filled(cells: DataFrame, g: GridDef, fill: float | None = None) -> DataFrame:
    """Every cell of the grid: those that ``cells`` lacks, or has no value for, get the fill value."""
    whole = grid_cells(cells.sparkSession, g).join(cells, ["row", "col"], "left")
    return whole if fill is None else whole.withColumn("value", F.coalesce("value", F.lit(fill)))


def truncated(c: Column) -> Column:
    """Toward zero, as an int."""
    return F.when(F.abs(c) < 2e9, c).cast("int")


def rounded(c: Column) -> Column:
    """Half up by truncation, so that negatives round toward zero."""
    return truncated(c + 0.5)


def on_grid(g: GridDef, row: Column, col: Column) -> Column:
    return row.between(0, g.rows - 1) & col.between(0, g.cols - 1)


def offsets(low: int, high: int) -> Column:
    """(dr, dc) over a square, as an array for explode."""
    return F.array(*(F.struct(F.lit(r).alias("dr"), F.lit(c).alias("dc")) for r in range(low, high + 1) for c in range(low, high + 1)))


def _looked(places: DataFrame, own: GridDef, other: GridDef, both_maps: bool) -> DataFrame:
    """Cells (i, j) of a grid within its map (and the other's) with their place r, s on the other grid, if they have one."""
    df = with_geo(places.withColumnsRenamed({"row": "i", "col": "j"}), own, "j", "i", ("lat", "lon", "in_map"))
    df = df.withColumn("in_map", F.col("in_map") & within(other.map, F.col("lat"), F.col("lon"))) if both_maps else df
    return only(with_place(only(df, "in_map", ["lat", "lon"]), other, "lat", "lon", ("r", "s", "on_grid")), "on_grid", ["r", "s"]).drop("lat", "lon")


def sent(raster: DataFrame, source: GridDef, target: GridDef, in_target: bool = False) -> DataFrame:
    """Source cells (i, j, value) with their place on the target."""
    return _looked(raster, source, target, in_target)


def seen(spark: SparkSession, source: GridDef, target: GridDef, in_source: bool = False) -> DataFrame:
    """Target cells (i, j) with the place on the source that they look at."""
    return _looked(grid_cells(spark, target), target, source, in_source)


#: Stencils: offsets from the truncated place, or the sample nearest to it.
NEAREST, LINEAR, CUBIC = "nearest", "linear", "cubic"


#: Rows and columns of the tiles that samples are brought together by, and cells of a grid to a partition of them.
TILE, TILED = 64, 500_000


def cubic_weights(d: Column) -> list[Column]:
    """Cubic convolution weights of the samples -1 to 2 for a fraction d."""
    return [-d * (1 - d) * (1 - d), 1 - 2 * d * d + d * d * d, d * (1 + d - d * d), -d * d * (1 - d)]


def nearest(places: DataFrame, raster: DataFrame) -> DataFrame:
    """places joined to the sample nearest to r, s: an equi-join on (row, col)."""
    return places.withColumns({"row": rounded(F.col("s")), "col": rounded(F.col("r"))}).join(raster, ["row", "col"])


def neighbourhoods(raster: DataFrame, g: GridDef, low: int, high: int) -> DataFrame:
    """_row, _col and, for each (dr, dc) from low to high, _v<k>: the sample there, of all cells with a sample so near. Samples go to
    their tile, and to those beside it that look at them, and are put together there: none is sent for each cell that looks at it."""
    n = max(int(raster.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-g.n_cells // TILED))
    tile = lambda c: F.floor(c / TILE).cast("int")
    tiles = lambda c: F.explode(F.array_distinct(F.array(*(tile(F.col(c) - k) for k in (high, low)))))
    dealt = raster.select(F.col("row"), F.col("col"), F.col("value").cast("double").alias("_v")).withColumn("_tr", tiles("row")).withColumn("_tc", tiles("col")).repartition(n, "_tr", "_tc")
    each = dealt.select("_tr", "_tc", "row", "col", "_v", F.explode(offsets(low, high)).alias("_o"))
    each = each.select("_tr", "_tc", (F.col("row") - F.col("_o.dr")).alias("_row"), (F.col("col") - F.col("_o.dc")).alias("_col"), "_o", "_v").filter((tile(F.col("_row")) == F.col("_tr")) & (tile(F.col("_col")) == F.col("_tc")))
    square = [(dr, dc) for dr in range(low, high + 1) for dc in range(low, high + 1)]
    samples = [F.max(F.when((F.col("_o.dr") == dr) & (F.col("_o.dc") == dc), F.col("_v"))).alias(f"_v{k}") for k, (dr, dc) in enumerate(square)]
    return each.groupBy("_tr", "_tc", "_row", "_col").agg(*samples).drop("_tr", "_tc")


def gathered(places: DataFrame, raster: DataFrame, g: GridDef, kind: str, width: int = 1, radius: float = 1.0, power: float = 2.0, r: str = "r", s: str = "s", every: tuple[str, ...] = ()) -> DataFrame:
    """places with _num, _w, _n and _same: sums of weight * value and of weights, numbers of samples, and the sample at the very place,
    of the samples around r, s. Sums go from row to row and from column to column, so they have one result.

    Both sides are shuffled once, a place is one row. Its columns ``every`` spread places without r, s, which stay, with 0 samples; none
    given: such places, and those without samples, are left out. A broadcast is no choice of the planner's: it takes rows of a grid
    for as few as their numbers' bytes."""
    low, high = {LINEAR: (0, 1), CUBIC: (-1, 2)}.get(kind, (1 - width, width))
    r, s = F.col(r), F.col(s)
    row, col = truncated(s), truncated(r)
    if every:
        row = F.coalesce(row, -F.lit(2) * width - 9 - F.pmod(F.hash(*every), F.lit(2**30)))
    wide = neighbourhoods(raster, g, low, high)
    met = places.withColumns({"_row": row, "_col": F.coalesce(col, F.lit(0)) if every else col}).hint("merge").join(wide, ["_row", "_col"], "left" if every else "inner")
    steps = Steps(met, "_w_")
    fr, fs = s - F.col("_row"), r - F.col("_col")
    span = range(low, high + 1)
    if kind == LINEAR:
        down, along = ([steps.let(1 - F.abs(k - f)) for k in span] for f in (fr, fs))
    elif kind == CUBIC:
        down, along = ([steps.let(w) for w in cubic_weights(steps.let(f))] for f in (fr, fs))
    else:
        ds, dr = ([steps.let((F.col(c) + k) - f) for k in span] for c, f in (("_row", s), ("_col", r)))

    def weight(i: int, j: int) -> Column:
        if kind in (LINEAR, CUBIC):
            return down[i] * along[j]
        d2 = ds[i] * ds[i] + dr[j] * dr[j]
        inside = F.sqrt(d2) <= radius if kind == "distance" else d2 <= radius * radius
        far = F.lit(1.0) if kind == "average" else F.when(d2 == 0, F.lit(float("inf"))).otherwise(F.try_divide(F.lit(1.0), d2) if power == 2 else F.pow(F.sqrt(d2), F.lit(-power)))
        return F.when(inside, far).otherwise(0.0)

    num, total, n, same = F.lit(0.0), F.lit(0.0), F.lit(0), F.lit(None).cast("double")
    for i in range(len(span)):
        for j in range(len(span)):
            v = F.col(f"_v{i * len(span) + j}")
            w = steps.let(weight(i, j)) if kind == "distance" else weight(i, j)
            known = v.isNotNull() & (w > 0) if kind == "average" else v.isNotNull()
            num, total, n = num + F.when(known, w * v).otherwise(0.0), total + F.when(known, w).otherwise(0.0), n + F.when(known, 1).otherwise(0)
            if kind == "distance":
                same = F.greatest(same, F.when(w == float("inf"), v))
        num, total, n = steps.let(num), steps.let(total), steps.let(n)
    made = steps.df.withColumns({"_num": num, "_w": total, "_n": n.cast("long"), "_same": same})
    return made.drop("_row", "_col", *(c for c in made.columns if c.startswith(("_w_", "_v"))))
