"""Segment files: a header of 80 bytes, steps of 2^-10 degrees and an index, all big-endian, in one file.

Layout of the header: magic, index address and size, largest segment (bytes), rank, order, bounds and extents, then 32 bytes
of text. The data of each segment are pairs of 16-bit steps; an index entry holds id, first point, bounds, address and size.

As data sources ``segment_file`` and ``segment_file_pushed`` (a file, or a folder of them that write_segment_files has made), which
evaluate limits of seg and of bounds on the index: of a sorted index only the entries in range are read, and only segments that match.
"""

from __future__ import annotations

import json
import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, LessThan, LessThanOrEqual

from .files import create, file_size, is_file, read_range
from .parts import manifest, write_parts

#: Fixed values of the format: magic number, sizes of header, its text and an index entry.
MAGIC, HEADER, TEXT, ENTRY = 0x2E636462, 80, 32, 36
SEGMENTS = 2000
#: Orders of an index as the header numbers them: column of the entry, and whether it increases.
ORDERS = {"lat_max": (1, False), "lon_max": (2, False), "lat_min": (3, True), "lon_min": (4, True), "seg": (5, True)}
#: Columns of an index entry.
LIMITED = ("seg", "lat_max", "lon_max", "lat_min", "lon_min")
FIELDS = ("seg", "lat0", "lon0", "lat_max", "lon_max", "lat_min", "lon_min", "address", "size")
#: Gaps between segments' data that are read over rather than sought over, and bytes that are read at once (more for a longer segment).
GAP, RUN = 4096, 2**20


class Segments(InputPartition):
    def __init__(self, path: str, first: int, count: int):
        self.path, self.first, self.count = path, first, count


class SegmentFile(DataSource):
    """Options: path, and limits of seg and of the bounds, both ends included (``seg_from``, ``lat_max_to`` and so on). Rows: seg, pos,
    lat0, lon0, dlat, dlon (units of 2^-10 degrees; the first point has steps 0), and the bounds of the segment in degrees."""

    @classmethod
    def name(cls) -> str:
        return "segment_file"

    def schema(self) -> str:
        return "seg int, pos int, lat0 int, lon0 int, dlat int, dlon int, lat_max double, lon_max double, lat_min double, lon_min double"

    def reader(self, schema):
        found = []
        for f in LIMITED:
            low, high = (self.options.get(f"{f}_{end}") for end in ("from", "to"))
            if low is not None or high is not None:
                unit = 1 if f == "seg" else 1024
                found.append((f, float(low) * unit if low is not None else -np.inf, float(high) * unit if high is not None else np.inf, None))
        return SegmentReader(self.options["path"], found)


class PushedSegmentFile(SegmentFile):
    """``segment_file_pushed``: takes limits from the filters of the query. Spark plans the reading of a Python source once for a
    DataFrame and keeps it, limits included: load anew for each query with other filters, or use the options of segment_file."""

    @classmethod
    def name(cls) -> str:
        return "segment_file_pushed"

    def reader(self, schema):
        return PushingReader(self.options["path"])


def register(spark: SparkSession) -> None:
    """Makes both sources known to a session, and lets Spark push filters down to sources in Python."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(SegmentFile)
    spark.dataSource.register(PushedSegmentFile)


def read_segments(spark: SparkSession, path: str, **limits: tuple) -> DataFrame:
    """Segments of a file or a folder of files whose seg or bounds are in limits (least and most, either may be None): what
    SegmentFile gives."""
    spark.dataSource.register(SegmentFile)
    ends = {f"{f}_{end}": v for f, pair in limits.items() for end, v in zip(("from", "to"), pair, strict=True) if v is not None}
    return spark.read.format("segment_file").options(**ends).load(path)


def read_header(path: str) -> tuple[int, int, str]:
    """Index address, number of segments and text of the header."""
    magic, address, size = struct.unpack(">3i", read_range(path, 0, 12))
    if magic != MAGIC:
        raise ValueError(f"{path} is no segment file")
    if address + size > file_size(path):
        raise ValueError(f"{path} is cut off")
    return address, size // ENTRY, read_range(path, HEADER - TEXT, TEXT).rstrip(b"\0").decode("latin-1")


def _entries(path: str, first: int, count: int) -> np.ndarray:
    address, _, _ = read_header(path)
    return np.frombuffer(read_range(path, address + first * ENTRY, count * ENTRY), ">i4").reshape(-1, 9)


def _limits(f) -> tuple | None:
    """(field, low, high, values) of a filter, both ends inclusive of what may match; None where it can't be told by the index."""
    if not isinstance(f, (EqualTo, In, GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual)) or len(f.attribute) != 1 or f.attribute[0] not in LIMITED:
        return None
    unit = 1 if f.attribute[0] == "seg" else 1024  # bounds are whole units, exact as doubles
    if isinstance(f, In):
        values = sorted(v * unit for v in f.value if v is not None)
        return (f.attribute[0], values[0], values[-1], values) if values else (f.attribute[0], 1, 0, [])
    v = f.value * unit
    low = v if isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual)) else -np.inf
    high = v if isinstance(f, (EqualTo, LessThan, LessThanOrEqual)) else np.inf
    if isinstance(f, GreaterThan):
        low = np.nextafter(v, np.inf)
    if isinstance(f, LessThan):
        high = np.nextafter(v, -np.inf)
    return f.attribute[0], low, high, None


class SegmentReader(DataSourceReader):
    """A partition for each SEGMENTS entries of an index that may match. limits: (field, least, most, or values) in whole units."""

    def __init__(self, path: str, limits: list[tuple] = ()):
        self.path, self.limits = path, list(limits)

    def _between(self, field: str) -> tuple[float, float]:
        low = max((x[1] for x in self.limits if x[0] == field), default=-np.inf)
        high = min((x[2] for x in self.limits if x[0] == field), default=np.inf)
        return low, high

    def _files(self) -> list[str]:
        """The file, or the files of the folder whose own limits (notes of the manifest) may match."""
        out = []
        for _, name, _, note in manifest(self.path):
            bounds = json.loads(note)
            if all(self._between(f)[0] <= bounds[f][1] and self._between(f)[1] >= bounds[f][0] for f in bounds):
                out.append(f"{self.path.rstrip('/')}/{name}")
        return out

    def partitions(self):
        out = []
        for path in self._files() if not is_file(self.path) else [self.path]:
            order, n = struct.unpack(">i", read_range(path, 20, 4))[0], read_header(path)[1]
            ranges = [(0, n)]
            for field, (number, up) in ORDERS.items():
                if number == order:
                    key = lambda k, c=FIELDS.index(field), s=1 if up else -1: s * int(_entries(path, k, 1)[0, c])  # noqa: B023, E731
                    span = lambda low, high: (_bisect(key, n, low if up else -high, left=True), _bisect(key, n, high if up else -low, left=False))  # noqa: B023, E731
                    low, high = self._between(field)
                    listed = [x[3] for x in self.limits if x[0] == field and x[3] is not None]
                    ranges = [span(v, v) for v in listed[0] if low <= v <= high] if listed else [span(low, high)]
            out += [Segments(path, k, min(SEGMENTS, last - k)) for first, last in ranges for k in range(first, last, SEGMENTS)]
        return out

    def read(self, partition):
        if partition is None:  # there are none
            return
        entries = _entries(partition.path, partition.first, partition.count).astype(np.int64)
        keep = np.ones(len(entries), bool)
        for field, low, high, values in self.limits:
            c = entries[:, FIELDS.index(field)]
            keep &= (c >= low) & (c <= high) & (np.isin(c, values) if values is not None else True)
        entries = entries[keep]
        entries = entries[np.lexsort((entries[:, 8], entries[:, 7]))]  # a segment of one point has no data, and the address of the next one
        begin = 0
        while begin < len(entries):  # segments whose data are near each other are read at once, and are rows of one batch
            end = begin + 1
            while end < len(entries) and entries[end, 7] - entries[end - 1, 7] - entries[end - 1, 8] <= GAP and entries[end, 7] + entries[end, 8] - entries[begin, 7] < RUN:
                end += 1
            start, e = int(entries[begin, 7]), entries[begin:end]
            data = np.frombuffer(read_range(partition.path, start, int(e[-1, 7] + e[-1, 8]) - start), np.uint8)
            n = e[:, 8] // 4 + 1  # points; the first has no step
            first = np.cumsum(n) - n
            of = np.repeat(np.arange(len(e)), n)
            pos = np.arange(len(of)) - first[of]
            steps, after = np.zeros((len(of), 2), np.int32), pos > 0
            at = (e[of, 7] - start + 4 * (pos - 1))[after]
            steps[after] = data[at[:, None] + np.arange(4)].reshape(-1).view(">i2").reshape(-1, 2)
            whole = [pa.array(e[of, k].astype(np.int32)) for k in range(3)]
            bounds = [pa.array(e[of, k] / 1024) for k in range(3, 7)]
            yield pa.RecordBatch.from_arrays([whole[0], pa.array(pos.astype(np.int32)), *whole[1:], pa.array(steps[:, 0]), pa.array(steps[:, 1]), *bounds], ["seg", "pos", "lat0", "lon0", "dlat", "dlon", *FIELDS[3:7]])
            begin = end


class PushingReader(SegmentReader):
    def pushFilters(self, filters):
        for f in filters:
            limit = _limits(f)
            if limit:
                self.limits.append(limit)
            elif not (isinstance(f, IsNotNull) and f.attribute[0] in LIMITED):
                yield f


def _bisect(key, n: int, value: float, left: bool) -> int:
    """Entries whose key is below value (left), or not above it, by binary search: each step reads one entry."""
    low, high = 0, n
    if value in (-np.inf, np.inf):
        return 0 if value < 0 else n
    while low < high:
        mid = (low + high) // 2
        if key(mid) < value or (not left and key(mid) == value):
            low = mid + 1
        else:
            high = mid
    return low


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """The index as a table: seg, first point, bounds in degrees, address and size. Its size is that of the file's index."""
    rows = _entries(path, 0, read_header(path)[1]).tolist()
    table = spark.createDataFrame(rows, "seg int, lat0 int, lon0 int, lat_max int, lon_max int, lat_min int, lon_min int, address int, size int") if rows else spark.createDataFrame([], "seg int, lat0 int, lon0 int, lat_max int, lon_max int, lat_min int, lon_min int, address int, size int")
    return table.withColumns({c: F.col(c) / 1024.0 for c in ("lat_max", "lon_max", "lat_min", "lon_min")})


def packed(segs: list[tuple], text: str, rank: int, order: str) -> tuple[bytes, dict]:
    """A segment file of (seg, ilat, ilon: whole units of its points), and its limits (field: least, most)."""
    data, entries = bytearray(), []
    for seg, lat, lon in segs:
        steps = np.stack([np.diff(lat), np.diff(lon)], 1)
        if np.abs(steps).max(initial=0) > 32767:
            raise OverflowError(f"segment {seg} has a step of more than 32 degrees")
        part = steps.astype(">i2").tobytes()
        entries.append((int(seg), lat[0], lon[0], lat.max(), lon.max(), lat.min(), lon.min(), HEADER + len(data), len(part)))
        data += part
    e = np.array(entries or np.zeros((0, 9)), np.int64).reshape(-1, 9)
    number, up = ORDERS[order]
    e = e[np.lexsort((e[:, 0], e[:, FIELDS.index(order)] * (1 if up else -1)))]
    b = e if len(e) else np.zeros((1, 9), np.int64)
    limits = (b[:, 3].max(), b[:, 4].max(), b[:, 5].min(), b[:, 6].min(), (b[:, 3] - b[:, 5]).max(), (b[:, 4] - b[:, 6]).max())
    numbers = (MAGIC, HEADER + len(data), ENTRY * len(e), int(b[:, 8].max()), rank, number, *map(int, limits))
    head = struct.pack(">12i", *numbers) + text.encode("latin-1")[: TEXT - 1].ljust(TEXT, b"\0")
    ranges = {f: (int(b[:, k].min()), int(b[:, k].max())) for k, f in enumerate(FIELDS) if k in (0, 3, 4, 5, 6)}
    return bytes(head) + bytes(data) + e.astype(">i4").tobytes(), ranges


def _packer(text: str, rank: int, order: str, most_bytes: int):
    """Rows (place, name, data, note) of points in the order of segments: a whole segment file in each."""

    def run(batches):
        from pyspark import TaskContext

        task, made = TaskContext.get().partitionId(), 0
        now, held, size = None, [], 0  # the open segment's pieces, whole segments, their bytes

        def file():
            nonlocal held, size, made
            data, limits = packed(held, text, rank, order)
            row = (task << 20) + made, f"segments-{task:05d}-{made:04d}", data, json.dumps(limits)
            held, size, made = [], 0, made + 1
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, (pa.int64(), pa.string(), pa.binary(), pa.string()), strict=True)], ["place", "name", "data", "note"])

        def close():
            nonlocal now, size
            lat, lon = np.concatenate(now[1]), np.concatenate(now[2])
            if len(lat) * 4 > most_bytes:
                raise ValueError(f"segment {now[0]} has more than {most_bytes} bytes")
            out = file() if held and size + len(lat) * 4 > most_bytes else None
            held.append((now[0], lat, lon))
            size, now = size + len(lat) * 4, None
            return out

        for b in batches:
            if not b.num_rows:
                continue
            seg, lat, lon = (np.asarray(b.column(k)) for k in range(3))
            cuts = np.flatnonzero(np.diff(seg)) + 1
            for part in np.split(np.arange(len(seg)), cuts):
                if now and now[0] != seg[part[0]] and (out := close()) is not None:
                    yield out
                now = now or (int(seg[part[0]]), [], [])
                now[1].append(lat[part])
                now[2].append(lon[part])
        if now and (out := close()) is not None:
            yield out
        if held:
            yield file()

    return run


def _units(points: DataFrame) -> DataFrame:
    """seg, ilat, ilon, pos: positions in whole units, as encode rounds them."""
    from ..operators.cells import rounded

    lon = F.greatest(F.lit(-180.0), F.least(F.lit(180.0), F.col("lon")))
    return points.select(F.col("seg").cast("int").alias("seg"), rounded(F.col("lat") * 1024).cast("long").alias("ilat"), rounded(lon * 1024).cast("long").alias("ilon"), "pos")


def write_segment_files(points: DataFrame, path: str, text: str = "", rank: int = 0, order: str = "seg", most_bytes: int = 25 * 2**20, overwrite: bool = True) -> list[str]:
    """Points (seg, pos, lat, lon) as segment files of at most ``most_bytes`` of steps below ``path``, and their names in order.

    Segments are dealt by ranges of seg; each task packs and writes its own, and the files count once all have succeeded (see
    parts). A segment is in one file, so it may have no more than ``most_bytes``. No points write an empty manifest.
    """
    n = int(points.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = _units(points).repartitionByRange(n, "seg").sortWithinPartitions("seg", "pos")
    return write_parts(ordered.mapInArrow(_packer(text, rank, order, most_bytes), "place long, name string, data binary, note string"), path, overwrite)


def write_segments(points: DataFrame, path: str, text: str = "", rank: int = 0, most_bytes: int = 25 * 2**20, order: str = "seg") -> str:
    """One segment file, which the format limits to ``most_bytes``: one task packs it, and it gets its name when it is whole.
    Larger sets are for write_segment_files."""
    size = points.count() * 4
    if size > most_bytes:
        raise ValueError(f"{size} bytes of steps are more than {most_bytes}")
    pack = _packer(text, rank, order, most_bytes)

    def run(batches):
        out = list(pack(batches))
        create(path, out[0].column("data")[0].as_py() if out else packed([], text, rank, order)[0])
        return iter(())

    _units(points).coalesce(1).sortWithinPartitions("seg", "pos").mapInArrow(run, "place long").collect()
    return path
