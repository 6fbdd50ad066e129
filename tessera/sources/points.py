"""Points as text (``lat lon`` or ``lat lon value``), as doubles, or as a stream of text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .files import create, file_size, read_range

#: Bytes of binary points that a task holds at a time, and that it reads.
BLOCK_BYTES, TASK_BYTES = 8 * 2**20, 128 * 2**20


def parse_points(lines: DataFrame, column: str = "value", values: bool = True) -> DataFrame:
    """lat, lon (and value) of lines of white-space separated numbers. A line that can't be read is dropped."""
    parts = F.split(F.trim(F.col(column)), r"\s+")
    number = lambda i: F.get(parts, F.lit(i)).try_cast("double")
    names = ["lat", "lon", "value"] if values else ["lat", "lon"]
    out = lines.select(*(number(i).alias(n) for i, n in enumerate(names)))
    return out.dropna()


def read_points(spark: SparkSession, path: str, values: bool = True) -> DataFrame:
    return parse_points(spark.read.text(path), values=values)


def stream_points(spark: SparkSession, path: str, values: bool = True) -> DataFrame:
    """The same for the files that come to a folder."""
    return parse_points(spark.readStream.text(path), values=values)


def read_binary_points(spark: SparkSession, path: str, values: bool = False) -> DataFrame:
    """Points stored as native doubles, two (or three) each; a last one that is not whole is left out. Tasks read byte
    ranges of whole points, BLOCK_BYTES at a time. Only in a store that pyarrow can't open a file is held by one task."""
    width = 24 if values else 16
    names = ["lat", "lon", "value"][: width // 8]
    step = max(1, BLOCK_BYTES // width) * width

    def points(data: bytes):
        import numpy as np
        import pyarrow as pa

        table = np.frombuffer(data[: len(data) // width * width], float).reshape(-1, width // 8)
        return pa.RecordBatch.from_arrays([pa.array(table[:, k]) for k in range(table.shape[1])], names)

    def whole(batches):
        for b in batches:
            yield from map(points, b.column(0).to_pylist())

    def ranges(batches):
        for b in batches:
            for name, offset, length in zip(*(c.to_pylist() for c in b.columns), strict=True):
                yield points(read_range(name, offset, length))

    files = spark.read.format("binaryFile").load(path)
    found = [(r["path"].removeprefix("file://").removeprefix("file:"), r["length"] // width * width) for r in files.select("path", "length").collect()]
    fields = ", ".join(f"{n} double" for n in names)
    try:
        for name, _ in found:
            file_size(name)
    except (OSError, ValueError):
        return files.select("content").mapInArrow(whole, fields)
    parts = spark.createDataFrame(found, "path string, size long").filter("size > 0").select("path", "size", F.explode(F.sequence(F.lit(0), F.col("size") - 1, F.lit(step))).alias("offset"))
    parts = parts.select("path", "offset", F.least(F.lit(step), F.col("size") - F.col("offset")).alias("length"))
    return parts.repartition(max(1, -(-sum(n for _, n in found) // TASK_BYTES))).mapInArrow(ranges, fields)


def write_binary_points(points: DataFrame, path: str, values: bool = False) -> None:
    """Native doubles, two (or three) a point, in files below ``path``: one for each task, or for each TASK_BYTES of it.
    Points that lack a number are left out."""
    names = ["lat", "lon", "value"][: 3 if values else 2]

    def write(batches):
        import numpy as np
        import pyarrow as pa
        from pyspark import TaskContext

        task, held, size, files = TaskContext.get().partitionId(), [], 0, 0

        def put():
            create(f"{path.rstrip('/')}/points-{task:06d}-{files:06d}.bin", b"".join(held))
            return pa.RecordBatch.from_arrays([pa.array([size])], ["bytes"])

        for b in batches:
            held.append(np.stack([np.asarray(c) for c in b.columns], 1).tobytes())
            size += len(held[-1])
            if size >= TASK_BYTES:
                yield put()
                held, size, files = [], 0, files + 1
        if size:
            yield put()

    whole = points.select(*(F.col(n).cast("double").alias(n) for n in names)).dropna()
    whole.mapInArrow(write, "bytes long").write.format("noop").mode("overwrite").save()


def point_line(lat: Column, lon: Column, value: Column, exponents: bool = False) -> Column:
    """A point as a line of text: six decimals, or 15.8 exponents."""
    return F.format_string(" ".join(["%15.8e" if exponents else "%f"] * 3), lat.cast("double"), lon.cast("double"), value.cast("double"))


def write_points(points: DataFrame, path: str, exponents: bool = False) -> None:
    points.select(point_line(F.col("lat"), F.col("lon"), F.col("value"), exponents).alias("value")).write.text(path)


def write_strokes(lines: DataFrame, path: str) -> None:
    """Lines ``style x1 y1 x2 y2`` as text."""
    lines.select(F.format_string("%d %f %f %f %f", "style", "x1", "y1", "x2", "y2").alias("value")).write.text(path)
