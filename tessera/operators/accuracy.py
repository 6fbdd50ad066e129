"""Accuracy of a map or grid: the errors of going there and back, over a lattice of points or over all cells."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.geodesy import arc_length
from ..functions.scalar import Steps
from ..plans.definitions import GridDef, MapDef
from .cells import grid_cells
from .transform import filter_within, only, with_geo, with_geo_of_uv, with_place, with_uv

LATTICE = 320


def lattice(spark: SparkSession, m: MapDef, n: int = LATTICE) -> DataFrame:
    """n x n points over the bounds of a map, from edge to edge: poles and seams are among them."""
    east = m.east + (360 if m.straddles else 0)
    ids = spark.range(n * n)
    i, j = F.expr(f"id div {n}"), F.col("id") % n
    return ids.select("id", (m.south + i / (n - 1) * (m.north - m.south)).alias("lat"), (m.west + j / (n - 1) * (east - m.west)).alias("lon"))


def _summary(errors: DataFrame, where: list[str]) -> DataFrame:
    return errors.agg(
        F.count("*").alias("points"), F.count_if(F.col("err").isNull()).alias("bad"), F.avg("err").alias("avg"), F.stddev_samp("err").alias("sd"),
        F.max("err").alias("max"), F.max_by(F.struct(*where), F.struct("err", *where)).alias("at"),
    )


def map_errors(spark: SparkSession, m: MapDef, n: int = LATTICE, points: DataFrame | None = None) -> DataFrame:
    """lat, lon and err (km along the great circle) of each point (lat, lon) within the map, or else of a lattice of n x n."""
    there = with_uv(filter_within(lattice(spark, m, n) if points is None else points.select("lat", "lon"), m), m)
    back = with_geo_of_uv(there, m, out=("lat2", "lon2"))
    s = Steps(back)
    e = arc_length(s, F.col("lat"), F.col("lon"), F.col("lat2"), F.col("lon2"))
    return s.df.select("lat", "lon", e.alias("err"))


def map_accuracy(spark: SparkSession, m: MapDef, n: int = LATTICE, points: DataFrame | None = None) -> DataFrame:
    """points, bad, avg, sd, max and where the largest error is."""
    return _summary(map_errors(spark, m, n, points), ["lat", "lon"])


def grid_errors(spark: SparkSession, g: GridDef, raster: DataFrame | None = None) -> DataFrame:
    """row, col and err (cells) of each of the raster's cells, or else of all, whose centre is within the map."""
    cells = grid_cells(spark, g) if raster is None else raster.select("row", "col")
    there = only(with_geo(cells, g), "in_map", ["lat", "lon"])
    back = with_place(there, g, out=("c2", "r2", "_on"))
    return back.select("row", "col", F.sqrt((F.col("c2") - F.col("col")) * (F.col("c2") - F.col("col")) + (F.col("r2") - F.col("row")) * (F.col("r2") - F.col("row"))).alias("err"))


def grid_accuracy(spark: SparkSession, g: GridDef, raster: DataFrame | None = None) -> DataFrame:
    return _summary(grid_errors(spark, g, raster), ["row", "col"])
