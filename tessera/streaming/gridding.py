"""Streams of points: values of a raster at each, and incremental gridding.

Sums by cell are the whole state, so it is bounded by the grid and needs no watermark. Methods that depend on the order of
the points (nearest with ties) are for batches only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.cells import rounded
from ..operators.gridding import contributions
from ..operators.transform import with_place
from ..plans.definitions import GridDef


def stream_sums(points: DataFrame, g: GridDef, method: str = "bucket", **options) -> DataFrame:
    """A streaming row, col, num, den, n: write it in update or complete mode."""
    if method == "nearest":
        raise ValueError("nearest depends on the order of the points: grid it in a batch")
    value = F.col(options.get("value", "value"))
    each = contributions(points, g, method=method, **options)
    return each.groupBy("row", "col").agg(F.sum(F.col("weight") * value).alias("num"), F.sum("weight").alias("den"), F.count("*").alias("n"))


def stream_values(points: DataFrame, raster: DataFrame, g: GridDef, fill: float | None = None) -> DataFrame:
    """Each streamed point with the raster's value in its cell: a stream-static join on the cell, in append mode."""
    placed = with_place(points.drop("value"), g, "lat", "lon", ("_r", "_s", "_on")).withColumns({"row": rounded(F.col("_s")), "col": rounded(F.col("_r"))})
    out = placed.join(raster.select("row", "col", "value"), ["row", "col"], "left").drop("_r", "_s", "_on")
    return out if fill is None else out.withColumn("value", F.coalesce("value", F.lit(fill)))


def run_to_memory(df: DataFrame, name: str, mode: str = "complete") -> StreamingQuery:
    """Runs a stream over what is there now, into a table in memory."""
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination()
    return q
