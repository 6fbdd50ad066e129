"""World Data Bank files: strokes by cell of one degree, in chained records.

A file is made of physical records of PHYSICAL bytes, each a number of logical ones. The first logical record is the header:
its byte 3 is the size of a logical record, byte 5 the size of a unit (1 / 3600 degree divided by it). A bitmap of the 64,800
cells follows, then a logical record for each cell, then those that records go on in. A logical record ends with four bytes:
0 or, in the last of a chain, the place of the first byte that is not used, counted from 1; and the number of the next record.

Strokes: 6 bytes (whether it goes on from the stroke before, number of points, rank or high bits of the offsets, offsets in
units from the cell's corner or from the last point) and a pair of bytes for each further point.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .files import file_size, read_range
from .parts import joined, write_parts

#: Fixed values of the format: bytes of a physical record, rows and columns of cells, biases of an offset and of a step.
PHYSICAL, ROWS, COLS, FAR, NEAR = 3072, 180, 360, 262144, 128
#: Bytes that a task reads at once, blocks that it keeps, and cells and (on average) bytes to a partition.
BLOCK, KEPT, CELLS, SHARE = 32 * PHYSICAL, 64, 2000, 4 * 2**20
#: Points, and records, to an Arrow batch.
POINTS = 10_000


class CellRange(InputPartition):
    def __init__(self, cells: list[int]):
        self.cells = cells


class Strokes(DataSource):
    """``strokes``. Options: path, and a box of whole degrees (south, north, west, east; west over east runs over the date line).
    Rows: cell, part, rank, onward (it goes on from the part before), pos, lat, lon."""

    @classmethod
    def name(cls) -> str:
        return "strokes"

    def schema(self) -> str:
        return "cell int, part int, rank int, onward boolean, pos int, lat double, lon double"

    def reader(self, schema):
        return StrokesReader(self.options)


class Records:
    """Logical records by number (from 1), read in blocks of the file of which the last few are kept."""

    def __init__(self, path: str):
        self.path, self.blocks = path, {}
        head = read_range(path, 0, 6)
        self.size, self.units = head[3], 3600.0 * head[5]
        self.full, self.per = self.size - 4, PHYSICAL // self.size
        self.first = (ROWS * COLS - 1) // (self.size * 8) + 2  # records before those of the cells

    def bitmap(self) -> np.ndarray:
        return np.flatnonzero(np.unpackbits(np.frombuffer(read_range(self.path, self.size, ROWS * COLS // 8), np.uint8)))

    def __getitem__(self, number: int) -> bytes:
        at = (number - 1) // self.per * PHYSICAL + (number - 1) % self.per * self.size
        if at // BLOCK not in self.blocks:
            while len(self.blocks) >= KEPT:
                self.blocks.pop(next(iter(self.blocks)))
            self.blocks[at // BLOCK] = read_range(self.path, at // BLOCK * BLOCK, BLOCK)
        return self.blocks[at // BLOCK][at % BLOCK : at % BLOCK + self.size]  # physical records divide blocks

    def of_cell(self, cell: int) -> bytes:
        """The bytes of a cell's strokes along its chain of records."""
        out, number, seen = bytearray(), self.first + cell + 1, set()
        while True:
            if number in seen:
                raise ValueError(f"the records of cell {cell} run in a ring")
            seen.add(number)
            record = self[number]
            if record[self.full]:
                return bytes(out + record[: record[self.full] - 1])
            out += record[: self.full]
            number = int.from_bytes(record[self.full + 1 :], "big")


def strokes(data: bytes, cell: int, units: float) -> tuple[np.ndarray, ...]:
    """The points of a cell's strokes: part, rank, onward, pos, lat, lon. Heads are found one after the other, as each says where the
    next is; the rest is done for all points at once, in whole units."""
    heads, at = [], 0
    while at + 6 <= len(data):
        heads.append(at)
        at += 6 + 2 * min(data[at] % 128 * 4 + data[at + 1] // 64, (len(data) - at - 6) // 2)
    raw, head = np.frombuffer(data, np.uint8), np.array(heads, np.int64)
    count = (np.diff(np.append(head, at)) - 6) // 2 + 1
    part = np.repeat(np.arange(len(head)), count)
    pos = np.arange(len(part)) - np.repeat(np.cumsum(count) - count, count)
    flags, low = raw[head].astype(np.int64), raw[head + 1].astype(np.int64) % 64
    onward = flags >= 128
    fresh = np.maximum.accumulate(np.where(onward, -1, np.arange(len(head)))) if len(head) else head  # the stroke that one goes on from
    rank = np.where(fresh < 0, 0, low[fresh])
    first, here, point = pos == 0, head[part], {}
    own = np.cumsum(count) - count  # the first point of each stroke
    for k, high, corner in ((0, low // 8, cell // COLS - 90), (1, low % 8, cell % COLS - 180)):
        offset = raw[head + 2 + 2 * k].astype(np.int64) * 256 + raw[head + 3 + 2 * k]
        step = raw[np.where(first, here, here + 4 + 2 * pos + k)].astype(np.int64) - NEAR
        step[own] = np.where(onward, offset + high * 65536 - FAR, 0)
        run = np.cumsum(step)
        base = np.where(fresh < 0, 0, offset[fresh] - run[own[fresh]])
        point[k] = np.where(fresh < 0, 0, corner)[part] + (run + base[part]) / units
    return part, rank[part], onward[part], pos, point[0], point[1]


class StrokesReader(DataSourceReader):
    """A partition for each CELLS cells that the bitmap has, or for fewer where these have over SHARE bytes; chains are followed wherever in the file they go."""

    def __init__(self, options):
        self.path = options["path"]
        self.box = [int(options.get(k, v)) for k, v in (("south", -90), ("north", 90), ("west", -180), ("east", 180))]

    def partitions(self):
        south, north, west, east = self.box
        cells = Records(self.path).bitmap()
        self.cells = len(cells)
        lat, lon = cells // COLS - 90, cells % COLS - 180
        inside = (lon >= west) & (lon < east) if west <= east else (lon >= west) | (lon < east)
        cells = cells[(lat >= south) & (lat < north) & inside]
        some = max(1, min(CELLS, SHARE * self.cells // max(1, file_size(self.path))))
        return [CellRange(cells[k : k + some].tolist()) for k in range(0, len(cells), some)]

    def read(self, partition):
        if partition is None:  # there are none
            return
        records = Records(self.path)
        for cell in partition.cells:
            part, rank, onward, pos, lat, lon = strokes(records.of_cell(cell), cell, records.units)
            whole = [np.full(len(part), cell), part, rank, onward, pos, lat, lon]
            for at in range(0, len(part), POINTS):
                columns = [c[at : at + POINTS] for c in whole]
                yield pa.RecordBatch.from_arrays([pa.array(c.astype(np.int32) if c.dtype == np.int64 else c) for c in columns], ["cell", "part", "rank", "onward", "pos", "lat", "lon"])


def packed(seg: np.ndarray, lat: np.ndarray, lon: np.ndarray, rank: np.ndarray, cell: int, units: int) -> bytes:
    """The points of a cell, segment by segment and in whole units from the South Pole and the date line, as bytes of strokes: a new
    one wherever a step doesn't fit in a byte or the points in the count."""
    n, at = len(seg), np.arange(len(seg))
    start = np.append(True, seg[1:] != seg[:-1])[:n]
    dlat, dlon = (np.diff(v, prepend=v[:1]) for v in (lat, lon))
    near = (-NEAR <= dlat) & (dlat < NEAR) & (-NEAR <= dlon) & (dlon < NEAR)
    run = np.maximum.accumulate(np.where(start | ~near, at, 0))  # where steps that fit began
    head = np.flatnonzero((at - run) % 512 == 0)
    onward = ~start[head]
    a = np.where(onward, dlat[head] + FAR, lat[head] - cell // COLS * units)
    b = np.where(onward, dlon[head] + FAR, lon[head] - cell % COLS * units)
    most = np.where(onward, 2 * FAR, 65536)
    if not ((0 <= a) & (a < most) & (0 <= b) & (b < most)).all():
        raise OverflowError("a stroke starts too far from its cell or from the point before")
    size = np.full(n, 2)
    size[head] = 6
    end = np.cumsum(size)
    out = np.zeros(int(size.sum()), np.uint8)
    step = np.delete(at, head)
    out[end[step] - 2], out[end[step] - 1] = dlat[step] + NEAR, dlon[step] + NEAR
    count = np.diff(np.append(head, n)) - 1
    low = np.where(onward, a // 65536 * 8 + b // 65536, rank[head] % 64)
    for k, v in enumerate((128 * onward + count // 4, count % 4 * 64 + low, a // 256 % 256, a % 256, b // 256 % 256, b % 256)):
        out[end[head] - 6 + k] = v
    return out.tobytes()


def write_strokes(points: DataFrame, path: str, size: int = 64, scale: int = 10) -> str:
    """Segments (seg, pos, lat, lon, rank from 0 to 63) as a file of strokes, each in the cell of its first point, at 3600 * scale
    units a degree. Latitudes are below 90, longitudes below 180; a null in a point leaves it out.

    A cell's bytes are packed where its segments meet, and cut into records whose numbers come of the cells' counts (64,800 at
    most); the file is put together from blocks of records (see parts)."""
    if PHYSICAL % size or not 16 <= size <= 192:
        raise ValueError(f"records of {size} bytes don't fill physical ones of {PHYSICAL}")
    spark, units = points.sparkSession, 3600 * scale
    full, first = size - 4, (ROWS * COLS - 1) // (size * 8) + 2
    known = points.dropna(subset=["seg", "pos", "lat", "lon"]).select("seg", "pos", F.floor((F.col("lat") + 90) * units + 0.5).alias("a"), F.floor((F.col("lon") + 180) * units + 0.5).alias("b"), F.coalesce("rank", F.lit(0)).alias("rank"))
    start = known.groupBy("seg").agg(F.min_by(F.struct("a", "b", "rank"), "pos").alias("s")).select("seg", F.expr(f"cast(s.a div {units} * {COLS} + s.b div {units} as int)").alias("cell"), F.col("s.rank").alias("own"))

    def of_cell(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        t = table.sort_by([("seg", "ascending"), ("pos", "ascending")])
        seg, a, b, own = (np.asarray(t.column(c)) for c in ("seg", "a", "b", "own"))
        data = packed(seg, a, b, own, key[0].as_py(), units)
        return pa.table({"cell": pa.array([key[0].as_py()], pa.int32()), "data": pa.array([data], pa.binary()), "n": pa.array([-(-len(data) // full)], pa.int32())})

    from ..plans.state import settled

    cells = settled(known.join(start, "seg").groupBy("cell").applyInArrow(of_cell, "cell int, data binary, n int"))
    counts = dict(map(tuple, cells.select("cell", "n").collect()))  # a row for each cell that has strokes
    more, extra = {}, first + ROWS * COLS + 1  # the record in which a cell goes on
    for cell in sorted(counts):
        more[cell], extra = extra, extra + counts[cell] - 1

    def records(batches):
        for batch in batches:
            for cell, data, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                last, follow = n - 1, np.arange(n) + more[cell]
                whole = np.zeros((n, size), np.uint8)
                whole[:, :full] = np.frombuffer(data.ljust(n * full, b"\0"), np.uint8).reshape(n, full)
                whole[:last, full + 1 :] = np.stack([follow[:last] >> 16, follow[:last] >> 8, follow[:last]], 1) & 255
                whole[last, full] = len(data) - last * full + 1
                number = np.append(first + cell + 1, follow[:last])
                for at in range(0, n, POINTS):
                    piece = whole[at : at + POINTS]
                    record = pa.FixedSizeBinaryArray.from_buffers(pa.binary(size), len(piece), [None, pa.py_buffer(piece.tobytes())])
                    yield pa.RecordBatch.from_arrays([pa.array(number[at : at + POINTS], pa.int64()), record.cast(pa.binary())], ["number", "record"])

    bits = np.zeros(ROWS * COLS, np.uint8)
    bits[list(counts)] = 1
    head = (bytes([0, 0, 0, size, 1, scale]).ljust(size, b"\0") + np.packbits(bits).tobytes()).ljust(first * size, b"\0")
    rows = spark.createDataFrame([(k // size + 1, bytearray(head[k : k + size])) for k in range(0, len(head), size)], "number long, record binary").unionByName(cells.mapInArrow(records, "number long, record binary"))
    per, block = PHYSICAL // size, PHYSICAL // size * 4096  # records to a physical record and to a part

    def pack(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        begin = key[0].as_py() * block
        n = -(-min(block, extra - 1 - begin) // per)
        data = np.zeros((n * per, size), np.uint8)
        known = table.filter(table.column("record").is_valid())
        if len(known):
            data[known.column("number").to_numpy() - 1 - begin] = np.frombuffer(b"".join(known.column("record").to_pylist()), np.uint8).reshape(-1, size)
        return pa.table({"place": pa.array([key[0].as_py()], pa.int64()), "name": ["records"], "data": pa.array([data.tobytes()], pa.binary()), "note": pa.array([None], pa.string())})

    spine = spark.range(-(-(extra - 1) // block)).select((F.col("id") * block + 1).alias("number"), F.lit(None).cast("binary").alias("record"))
    whole = spine.unionByName(rows).groupBy(F.expr(f"(number - 1) div {block}").alias("place")).applyInArrow(pack, "place long, name string, data binary, note string")
    write_parts(whole, f"{path}.parts")
    return joined(spark, f"{path}.parts", path)


def read_strokes(spark: SparkSession, path: str, box: tuple[int, int, int, int] | None = None) -> DataFrame:
    """The strokes of a file, or of the cells in a box (south, north, west, east): what Strokes gives."""
    spark.dataSource.register(Strokes)
    reader = spark.read.format("strokes").option("path", path)
    return (reader.options(**dict(zip(("south", "north", "west", "east"), box, strict=True))) if box else reader).load()
