"""Raster to points: values at given places, or the centres of cells."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import normal_lon
from ..plans.definitions import GridDef
from .cells import CUBIC, LINEAR, gathered, rounded
from .transform import only, with_geo, with_place

METHODS = ("nearest", "average", "bilinear", "cubic", "distance")


def extract(points: DataFrame, raster: DataFrame, g: GridDef, key: list[str], method: str = "nearest", radius: float = 1.0, power: float = 2.0, fill: float | None = None, low: float | None = None, high: float | None = None, lat="lat", lon="lon") -> DataFrame:
    """points with value (NULL, or the fill value, off the grid or without samples) and n samples. Points are told
    apart by ``key`` and place; equal ones get equal results.

    Samples below ``low``, above ``high`` or (nearest) equal to the fill value don't count. A point at a sample's place
    takes that sample with method ``distance``.
    """
    if method not in METHODS:
        raise ValueError(f"unknown method {method}")
    value = F.col("value")
    good = value.isNotNull()
    good = good & (value >= low) if low is not None else good
    good = good & (value <= high) if high is not None else good
    good = good & (value != fill) if fill is not None and method == "nearest" else good
    raster = raster.filter(good).select("row", "col", value.cast("double").alias("_v"))
    points, own = points.drop("value", "n"), [c for c in points.columns if c not in ("value", "n")]
    placed = with_place(points, g, lat, lon, ("_r", "_s", "_on"))
    on = F.array(F.struct(*(F.when(F.col("_on"), F.col(c)).alias(c) for c in ("_r", "_s"))))  # a generator: see transform.only
    placed = placed.select(*own, F.explode(on).alias("_at")).select(*own, "_at._r", "_at._s")
    every = tuple(dict.fromkeys([*key, lat, lon]))
    if method == "nearest":
        spread = F.coalesce(rounded(F.col("_s")), -9 - F.pmod(F.hash(*every), F.lit(2**30)))  # off the grid: no cell, and no one task for all
        met = placed.withColumns({"_row": spread, "_col": F.coalesce(rounded(F.col("_r")), F.lit(0))}).join(raster.withColumnsRenamed({"row": "_row", "col": "_col"}), ["_row", "_col"], "left")
        out = met.select(*own, F.col("_v").alias("value"), F.col("_v").isNotNull().cast("long").alias("n"))
    else:
        kind = {"bilinear": LINEAR, "cubic": CUBIC}.get(method, method)
        met = gathered(placed, raster.withColumnRenamed("_v", "value"), g, kind, max(1, math.ceil(radius)), radius, power, "_r", "_s", every)
        mean = F.when(F.col("_w") > 0, F.try_divide("_num", "_w")) if method == "bilinear" else F.when(F.col("_w") != 0, F.try_divide("_num", "_w")).otherwise(F.col("_num"))
        out = met.select(*own, F.when(F.col("_n") > 0, F.coalesce("_same", mean)).alias("value"), F.col("_n").alias("n"))
    return out if fill is None else out.withColumn("value", F.coalesce("value", F.lit(fill)))


def centres(raster: DataFrame, g: GridDef, fill: float | None = None, low: float | None = None, high: float | None = None, suppress: bool = False, box: tuple[float, float, float, float] = (-90.0, 90.0, -180.0, 180.0)) -> DataFrame:
    """lat, lon, value of each cell's centre in the box (south, north, west, east; no straddling). Cells off the map are
    left out; values out of range are missing, and left out with ``suppress``."""
    south, north, west, east = box
    value = F.col("value")
    bad = F.lit(False) if fill is None else value == fill
    bad = bad | (value < low) if low is not None else bad
    bad = bad | (value > high) if high is not None else bad
    found = only(with_geo(raster, g, "col", "row", ("lat", "lon", "in_map")), "in_map", ["lat", "lon"])
    found = found.filter(F.col("lat").between(south, north) & F.col("lon").between(normal_lon(west), normal_lon(east)))
    found = found.withColumn("value", F.when(~F.coalesce(bad, F.lit(True)), value.cast("double")))
    return found.filter("value is not null") if suppress else found
