"""Points to a raster: each point is projected, dealt to the cells around it and aggregated by cell."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.definitions import GridDef
from .cells import offsets, on_grid, rounded
from .transform import filter_within, only, with_place

METHODS = ("cressman", "idw", "nearest", "bucket")


def contributions(points: DataFrame, g: GridDef, method: str = "cressman", radius: float = 1.0, power: float = 2.0, fill: float = 0.0, lat="lat", lon="lon", value="value") -> DataFrame:
    """points (within the map, value not the fill value) times the cells they count for: row, col, d, weight added.

    A point off the grid still counts for cells on it. Half-width of the square of cells: the whole part of 2 * radius.
    ``bucket`` takes the whole square with equal weights. At distance 0 the weight of ``idw`` is the fill value.
    """
    if method not in METHODS:
        raise ValueError(f"unknown method {method}")
    near = filter_within(points.filter(F.col(value).isNotNull() & (F.col(value) != F.lit(fill))), g.map, lat, lon)
    placed = with_place(near, g, lat, lon, ("_r", "_s", "_on")).withColumn("_on", F.col("_r").isNotNull())
    near = only(placed, "_on", ["_r", "_s"])
    width = int(2 * radius)
    cells = near.select("*", F.explode(offsets(-width, width)).alias("_o"))
    cells = cells.withColumns({"row": rounded(F.col("_s")) + F.col("_o.dr"), "col": rounded(F.col("_r")) + F.col("_o.dc")}).filter(on_grid(g, F.col("row"), F.col("col")))
    ds, dr = F.col("_s") - F.col("row"), F.col("_r") - F.col("col")
    cells = cells.withColumn("d", F.sqrt(dr * dr + ds * ds))
    d = F.col("d")
    if method == "bucket":
        weight = F.lit(1.0)
    else:
        cells = cells.filter(d <= radius)
        weight = {
            "cressman": F.try_divide(F.lit(radius * radius) - d * d, F.lit(radius * radius) + d * d),
            "idw": F.when(F.pow(d, F.lit(power)) > 0, F.try_divide(F.lit(1.0), F.pow(d, F.lit(power)))).otherwise(F.lit(float(fill))),
            "nearest": F.lit(1.0),
        }[method]
    return cells.withColumn("weight", weight).drop("_o", "_r", "_s")


def grid_points(points: DataFrame, g: GridDef, method: str = "cressman", radius: float = 1.0, power: float = 2.0, fill: float = 0.0, lat="lat", lon="lon", value="value", order: tuple[str, ...] = ()) -> DataFrame:
    """row, col, value and n (points counted) of the cells that any point counts for.

    Weighted means sum num and den by cell: Spark aggregates in each task before the one shuffle. ``nearest`` takes the
    point at the least distance (to a billionth of a cell), the last one by ``order`` of those at the same.
    """
    each = contributions(points, g, method, radius, power, fill, lat, lon, value)
    if method == "nearest":
        last = F.struct(F.round("d", 9), *(-F.col(c) for c in order))
        return each.groupBy("row", "col").agg(F.min_by(value, last).alias("value"), F.count("*").alias("n"))
    sums = each.groupBy("row", "col").agg(F.sum(F.col("weight") * F.col(value)).alias("num"), F.sum("weight").alias("den"), F.count("*").alias("n"))
    return sums.select("row", "col", F.try_divide("num", "den").alias("value"), "n")


def accumulate(points: DataFrame, g: GridDef, **options) -> DataFrame:
    """row, col, num, den, n: sums that can be added to those of other points (merge) and read as values later."""
    value = options.get("value", "value")
    each = contributions(points, g, **options)
    return each.groupBy("row", "col").agg(F.sum(F.col("weight") * F.col(value)).alias("num"), F.sum("weight").alias("den"), F.count("*").alias("n"))


def merge(*states: DataFrame) -> DataFrame:
    """The sum of accumulated states."""
    out = states[0]
    for s in states[1:]:
        out = out.unionByName(s)
    names = [c for c in out.columns if c not in ("row", "col")]
    return out.groupBy("row", "col").agg(*(F.sum(c).alias(c) for c in names))


def values(state: DataFrame) -> DataFrame:
    return state.withColumn("value", F.try_divide("num", "den")).drop("num", "den")
