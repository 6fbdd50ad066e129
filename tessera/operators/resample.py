"""Raster to raster: regrid (six methods, mergeable states) and resamp (rounded values, masks, class percentages)."""

from __future__ import annotations

import math

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.definitions import GridDef
from .cells import CUBIC, LINEAR, filled, gathered, grid_cells, nearest, on_grid, rounded, seen, sent, truncated, without_fill
from .folds import folded

REGRID = ("nearest", "bilinear", "cubic", "bucket", "max", "idw")
RESAMP = ("nearest", "bucket", "bilinear", "minification", "reduction")


def kernel_size(source: GridDef, target: GridDef) -> tuple[int, int]:
    """Rows and columns of the default kernel: (a / b / c / d) from left to right, not a ratio of cell sizes."""
    size = lambda a, b, c, d: int(a / b / c / d + 0.5)
    rows = size(target.rows_per_unit, target.map.scale, source.rows_per_unit, source.map.scale)
    cols = size(target.cols_per_unit, target.map.scale, source.cols_per_unit, source.map.scale)
    return max(rows, 1), max(cols, 1)


def regrid_state(raster: DataFrame, source: GridDef, target: GridDef, method: str = "nearest", fill: float | None = None, kernel: tuple[int, int] | None = None, power: float = 2.0) -> DataFrame:
    """row, col, num, beta of target cells with data; value is num / beta.

    For ``nearest`` num is the value and beta the distance and 1; for ``max`` beta is 1 (values above 0 only).
    """
    raster = without_fill(raster, fill).select("row", "col", F.col("value").cast("double").alias("value"))
    if method == "nearest":
        near = nearest(seen(raster.sparkSession, source, target), raster)
        dr, ds = rounded(F.col("r")) - F.col("r"), rounded(F.col("s")) - F.col("s")
        return near.select(F.col("i").alias("row"), F.col("j").alias("col"), F.col("value").alias("num"), (F.sqrt(dr * dr + ds * ds) + 1).alias("beta"))
    if method in ("bilinear", "cubic"):
        each = gathered(seen(raster.sparkSession, source, target), raster, source, LINEAR if method == "bilinear" else CUBIC)
        return each.select(F.col("i").alias("row"), F.col("j").alias("col"), F.col("_num").alias("num"), F.col("_w").alias("beta"))
    if method in ("bucket", "max"):
        each = sent(raster, source, target).withColumns({"row": rounded(F.col("s")), "col": rounded(F.col("r"))}).filter(on_grid(target, F.col("row"), F.col("col")))
        if method == "max":
            return each.filter("value > 0").groupBy("row", "col").agg(F.max("value").alias("num"), F.lit(1.0).alias("beta"))
        return each.groupBy("row", "col").agg(F.sum("value").alias("num"), F.count("*").cast("double").alias("beta"))
    if method != "idw":
        raise ValueError(f"unknown method {method}")
    rows, cols = (x // 2 for x in kernel or kernel_size(source, target))
    each = sent(raster, source, target, in_target=True)
    span = lambda c, k: F.sequence(truncated(F.col(c) - k + 0.5), truncated(F.col(c) + k + 0.5))
    each = each.withColumn("row", F.explode(span("s", rows))).withColumn("col", F.explode(span("r", cols))).filter(on_grid(target, F.col("row"), F.col("col")))
    dr, ds = F.col("r") - F.col("col"), F.col("s") - F.col("row")
    dw = F.pow(dr * dr + ds * ds, F.lit(power / 2))
    each = each.withColumn("weight", F.when(dw > 0, F.try_divide(F.lit(1.0), dw)).otherwise(9e9))
    return each.groupBy("row", "col").agg(F.sum(F.col("weight") * F.col("value")).alias("num"), F.sum("weight").alias("beta"))


def merge_states(before: DataFrame, now: DataFrame, method: str = "nearest") -> DataFrame:
    """A state that an earlier run saved and a new one. Sums add up; ``max`` keeps the larger; ``nearest`` takes the new
    value if its distance is at most the old beta (which is the old distance and 1)."""
    if method == "nearest":
        both = before.join(now.withColumnsRenamed({"num": "_num", "beta": "_beta"}), ["row", "col"], "full")
        new = F.col("beta").isNull() | (F.col("_beta") - 1 <= F.col("beta"))
        new = F.col("_beta").isNotNull() & new
        return both.select("row", "col", F.when(new, F.col("_num")).otherwise(F.col("num")).alias("num"), F.when(new, F.col("_beta")).otherwise(F.col("beta")).alias("beta"))
    how = F.max if method == "max" else F.sum
    return before.unionByName(now).groupBy("row", "col").agg(how("num").alias("num"), how("beta").alias("beta"))


def read_state(state: DataFrame, method: str = "nearest") -> DataFrame:
    """row, col, value of a state."""
    return state.select("row", "col", (F.col("num") if method in ("nearest", "max") else F.try_divide("num", "beta")).alias("value"))


def regrid(raster: DataFrame, source: GridDef, target: GridDef, method: str = "nearest", fill: float | None = None, kernel=None, power: float = 2.0, before: DataFrame | None = None, whole: bool = True) -> DataFrame:
    """row, col, value on the target grid: all cells (whole), those without data with the fill value, or only those with data."""
    state = regrid_state(raster, source, target, method, fill, kernel, power)
    out = read_state(merge_states(before, state, method) if before is not None else state, method)
    return filled(out, target, fill) if whole else out


def cell_scale(g: GridDef) -> float:
    """Size of a cell against the Earth's radius."""
    return math.hypot(g.map.scale / g.cols_per_unit, g.map.scale / g.rows_per_unit) / g.map.equatorial_radius


def choose_method(source: GridDef, target: GridDef, same_map: bool, mask: bool) -> str:
    """Same map: reduction for masks, else minification. Else bucket where cells grow over twofold, or bilinear."""
    if same_map:
        return "reduction" if mask else "minification"
    return "bucket" if cell_scale(target) / cell_scale(source) > 2 else "bilinear"


class RunningMean:
    """A fold over values by target cell: the mean so far, rounded half up by truncation after each value."""

    def __init__(self):
        self.cell, self.mean, self.n = None, 0.0, 0

    def _made(self, out: list) -> pa.RecordBatch:
        kinds = (pa.int32(), pa.int32(), pa.float64())
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate(kinds)], ["row", "col", "value"])

    def rows(self, batch, new):
        out: list = []
        for row, col, value, first in zip(*(batch.column(c).to_pylist() for c in ("row", "col", "value")), new.tolist(), strict=True):
            if first:
                if self.cell:
                    out.append((*self.cell, self.mean))
                self.cell, self.mean, self.n = (row, col), 0.0, 0
            self.mean = float(math.trunc((self.mean * self.n + value) / (self.n + 1) + 0.5))
            self.n += 1
        return self._made(out)

    def end(self):
        return self._made([(*self.cell, self.mean)] if self.cell else [])


def resamp(raster: DataFrame, source: GridDef, target: GridDef | None = None, method: str | None = None, fill: float | None = None, mask: float | None = None, factor: int = 1, exact: bool = False) -> DataFrame:
    """row, col, value on the target (or the source shrunk by ``factor``).

    bucket, bilinear and reduction round their values. ``mask``: percentages of cells with that value (100 or 0 for
    nearest and minification). bucket rounds a cell's mean once, from sums; with ``exact`` it rounds the running mean
    after each source cell in row-major order: an ordered fold that streams the cells of a target cell.
    """
    same = target is None
    target = source.shrink(factor) if same else target
    if same and factor <= 1:
        raise ValueError("identical grids with factor 1")
    method = method or choose_method(source, target, same, mask is not None)
    if method in ("minification", "reduction") and not same:
        raise ValueError(f"{method} needs the same map")
    raster = without_fill(raster, fill).select("row", "col", F.col("value").cast("double").alias("value"))
    if mask is not None:
        raster = raster.withColumn("value", F.when(F.col("value") == mask, 10000.0 if method == "bucket" else 100.0).otherwise(0.0))
    empty = -1.0 if mask is not None and method in ("bucket", "reduction") else fill
    whole = lambda df: filled(df, target, empty)
    if method == "nearest":
        return whole(nearest(seen(raster.sparkSession, source, target, in_source=True), raster).select(F.col("i").alias("row"), F.col("j").alias("col"), "value"))
    if method == "bilinear":
        sums = gathered(seen(raster.sparkSession, source, target, in_source=True), raster, source, LINEAR)
        return whole(sums.select(F.col("i").alias("row"), F.col("j").alias("col"), rounded(F.try_divide("_num", "_w")).cast("double").alias("value")))
    if method == "minification":
        wanted = grid_cells(raster.sparkSession, target).withColumnsRenamed({"row": "i", "col": "j"}).withColumns({"row": rounded(factor * (F.col("i") + F.lit(0.5))), "col": rounded(factor * (F.col("j") + F.lit(0.5)))})
        return whole(wanted.join(raster, ["row", "col"]).select(F.col("i").alias("row"), F.col("j").alias("col"), "value"))
    if method == "reduction":
        cell = lambda c: F.expr(f"cast({c} div {factor} as int)").alias(c)
        blocks = raster.groupBy(cell("row"), cell("col")).agg((F.sum("value") / F.count("*")).alias("value")).filter(on_grid(target, F.col("row"), F.col("col")))
        return whole(blocks.select("row", "col", rounded(F.col("value")).cast("double").alias("value")))
    if method != "bucket":
        raise ValueError(f"unknown method {method}")
    each = sent(raster, source, target, in_target=True).withColumns({"row": rounded(F.col("s")), "col": rounded(F.col("r"))}).filter(on_grid(target, F.col("row"), F.col("col")))
    if exact:
        out = folded(each.select("row", "col", "i", "j", "value"), ["row", "col"], ["i", "j"], RunningMean, "row int, col int, value double")
    else:
        out = each.groupBy("row", "col").agg(rounded(F.avg("value")).cast("double").alias("value"))
    if mask is not None:
        out = out.withColumn("value", rounded(F.col("value") / 100).cast("double"))
    return whole(out)


def distribution(raster: DataFrame, source: GridDef, target: GridDef, low: int, high: int, fill: float | None = None, whole: bool = True) -> DataFrame:
    """row, col, class, percent: share of each class from low to high among the target cell's values in that range,
    rounded; -1 for cells without any (whole), which are left out otherwise."""
    inside = without_fill(raster, fill).filter(F.col("value").between(low, high)).withColumn("class", F.floor(F.col("value")).cast("int"))
    each = sent(inside, source, target, in_target=True).withColumns({"row": rounded(F.col("s")), "col": rounded(F.col("r"))}).filter(on_grid(target, F.col("row"), F.col("col")))
    counts = each.groupBy("row", "col", "class").agg(F.count("*").alias("n"))
    cells = counts.groupBy("row", "col").agg(F.sum("n").alias("_total"), F.map_from_entries(F.collect_list(F.struct("class", "n"))).alias("_n"))  # a pair for each class
    classes = F.array(*map(F.lit, range(low, high + 1)))
    share = rounded(100 * F.coalesce(F.try_element_at("_n", F.col("class")), F.lit(0)) / F.col("_total"))
    rows = cells.select("row", "col", "_total", "_n", F.explode(classes).alias("class")).select("row", "col", "class", share.alias("percent"))
    if not whole:
        return rows
    cells = grid_cells(raster.sparkSession, target).select("row", "col", F.explode(F.array(*map(F.lit, range(low, high + 1)))).alias("class"))
    return cells.join(rows, ["row", "col", "class"], "left").withColumn("percent", F.coalesce("percent", F.lit(-1)))
