"""Flat rasters: headerless row-major files, as a batch data source ``flat_raster`` and as a writer.

    spark.dataSource.register(FlatRaster)
    spark.read.format("flat_raster").option("path", p).option("cols", 361).option("dtype", "u1").load()
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..plans.definitions import GridDef
from ..operators.cells import locations
from .files import file_size, is_file, read_range
from .parts import manifest, write_parts

#: Short names of cell types: kind and bytes.
DTYPES = {"i1", "u1", "i2", "u2", "i4", "u4", "f4", "f8"}
BLOCK_BYTES = 8 * 2**20


class Rows(InputPartition):
    """Rows of a file from ``first`` on; ``number`` is that of its first row among all rows."""

    def __init__(self, path: str, first: int, count: int, number: int):
        self.path, self.first, self.count, self.number = path, first, count, number


class FlatRaster(DataSource):
    """Options: path (a file, or a folder that a manifest puts in order), cols, dtype (i1 u1 i2 u2 i4 u4 f4 f8, default f4), order (<, > or =), fill (a value to read as NULL)."""

    @classmethod
    def name(cls) -> str:
        return "flat_raster"

    def schema(self) -> str:
        return "row int, col int, value double"

    def reader(self, schema):
        return FlatRasterReader(self.options)


class FlatRasterReader(DataSourceReader):
    """A partition for each block of rows; a task reads its byte range only."""

    def __init__(self, options):
        self.path, self.cols, self.fill = options["path"], int(options["cols"]), options.get("fill")
        dtype = options.get("dtype", "f4")
        if dtype not in DTYPES:
            raise ValueError(f"unknown dtype {dtype}")
        self.dtype = options.get("order", "=") + dtype

    def partitions(self):
        width = self.cols * np.dtype(self.dtype).itemsize
        out, number = [], 0
        folder = self.path.rstrip("/")
        files = [(self.path, file_size(self.path))] if is_file(self.path) else [(f"{folder}/{name}", size) for _, name, size, _ in manifest(folder)]
        for path, size in files:
            if size % width:
                raise ValueError(f"{path} has {size} bytes, not whole rows of {width}")
            rows, step = size // width, max(1, BLOCK_BYTES // width)
            out += [Rows(path, r, min(step, rows - r), number + r) for r in range(0, rows, step)]
            number += rows
        return out

    def read(self, partition):
        if partition is None:  # there are none
            return
        t = np.dtype(self.dtype)
        width = self.cols * t.itemsize
        data = np.frombuffer(read_range(partition.path, partition.first * width, partition.count * width), t).astype(float)
        ok = np.isfinite(data) if self.fill is None else np.isfinite(data) & (data != float(self.fill))
        row = np.repeat(np.arange(partition.number, partition.number + partition.count, dtype=np.int32), self.cols)
        col = np.tile(np.arange(self.cols, dtype=np.int32), partition.count)
        yield pa.RecordBatch.from_arrays([pa.array(row), pa.array(col), pa.array(data, mask=~ok)], ["row", "col", "value"])


def write_flat(raster: DataFrame, g: GridDef, path: str, dtype: str = "f4", fill: float = 0.0, rows_per_file: int = 1024) -> list[str]:
    """Writes the raster as files of ``rows_per_file`` rows below ``path`` and returns them in order; cells without a value hold
    the fill value. Whole types are rounded (halves away from 0) and must fit, or an error is raised.

    Blocks of rows are packed where they meet; the files count once all of them are written (see parts)."""
    return write_bands(raster.select(F.lit(0).alias("band"), "row", "col", "value"), g, path, 1, dtype, fill, rows_per_file)


def write_bands(raster: DataFrame, g: GridDef, path: str, bands: int, dtype: str = "f4", fill: float = 0.0, rows_per_file: int = 1024) -> list[str]:
    """Rasters (band, row, col, value) one after another, as write_flat writes one."""
    if dtype not in DTYPES:
        raise ValueError(f"unknown dtype {dtype}")
    t, blocks = np.dtype("=" + dtype), -(-g.rows // rows_per_file)

    def pack(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        place = key[0].as_py()
        band, block = divmod(place, blocks)
        rows = min(rows_per_file, g.rows - block * rows_per_file)
        data = np.full((rows, g.cols), float(fill))
        v = table.column("value").to_numpy()
        r, c = np.asarray(table.column("row")) - block * rows_per_file, np.asarray(table.column("col"))
        data[r, c] = np.where(np.isnan(v), fill, v)
        if t.kind != "f":
            data = np.where(data < 0, np.ceil(data - 0.5), np.floor(data + 0.5))
            info = np.iinfo(t)
            if data.min() < info.min or data.max() > info.max:
                raise OverflowError(f"values from {data.min()} to {data.max()} don't fit {dtype}")
        name = f"band-{band}-rows-{block * rows_per_file:09d}.{g.cols}x{rows}.{dtype}"
        return pa.table({"place": pa.array([place], pa.int64()), "name": [name], "data": pa.array([data.astype(t).tobytes()], pa.binary()), "note": pa.array([None], pa.string())})

    inside = raster.filter(F.col("band").between(0, bands - 1) & F.col("row").between(0, g.rows - 1) & F.col("col").between(0, g.cols - 1))
    nan = F.lit(float("nan"))
    spine = raster.sparkSession.range(bands * blocks).select(F.expr(f"cast(id div {blocks} as int)").alias("band"), ((F.col("id") % blocks) * rows_per_file).cast("int").alias("row"), F.lit(0).alias("col"), nan.alias("value"))
    cells = inside.select("band", "row", "col", F.coalesce(F.col("value").cast("double"), nan).alias("value"))
    whole = spine.join(cells.select("band", "row", "col"), ["band", "row", "col"], "left_anti").unionByName(cells)
    place = F.expr(f"cast(band as long) * {blocks} + row div {rows_per_file}")
    return write_parts(whole.groupBy(place.alias("place")).applyInArrow(pack, "place long, name string, data binary, note string"), path)


def write_locations(spark: SparkSession, g: GridDef, path: str, bands: tuple[str, ...] = ("lat", "lon"), shift: tuple[float, float] = (0.0, 0.0), double: bool = False, undefined: float = -999.0, rows_per_file: int = 1024) -> list[str]:
    """Latitudes and longitudes of a grid's cells as bands, one after another, of 4 or 8 bytes a value; cells off the map hold
    ``undefined``."""
    found = locations(spark, g, shift, undefined)
    each = F.inline(F.array(*(F.struct(F.lit(k).alias("band"), F.col(c).alias("value")) for k, c in enumerate(bands))))
    return write_bands(found.select("row", "col", each).select("band", "row", "col", "value"), g, path, len(bands), "f8" if double else "f4", undefined, rows_per_file)


def read_bands(spark: SparkSession, path: str, g: GridDef, dtype: str = "f4", fill: float | None = None) -> DataFrame:
    """band, row, col, value of bands, one after another, in a folder or a file."""
    spark.dataSource.register(FlatRaster)
    reader = spark.read.format("flat_raster").options(path=path, cols=g.cols, dtype=dtype)
    rows = (reader if fill is None else reader.option("fill", fill)).load()
    return rows.select(F.expr(f"cast(row div {g.rows} as int)").alias("band"), F.expr(f"cast(row % {g.rows} as int)").alias("row"), "col", "value")
