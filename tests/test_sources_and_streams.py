import struct

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql.datasource import EqualTo, GreaterThan, GreaterThanOrEqual, In, LessThan, LessThanOrEqual

from tessera.operators import cells, vectors
from tessera.operators.gridding import grid_points
from tessera.plans.definitions import GridDef, MapDef
from tessera.sources import cells as strokes
from tessera.sources import parts, points, raster, segments
from tessera.streaming import states
from tessera.streaming.gridding import run_to_memory, stream_sums, stream_values

G = GridDef(MapDef("Cylindrical Equidistant", lat0=0, lon0=0), 40, 20, 1 / 1000, None, 19.5, 9.5)


@pytest.mark.parametrize(("dtype", "order"), [("u1", "="), ("i2", ">"), ("f4", "<")])
def test_flat_raster(spark, tmp_path, dtype, order, monkeypatch):
    monkeypatch.setattr(raster, "BLOCK_BYTES", 200)
    data = (np.arange(G.n_cells) % 250).astype(order + dtype)
    path = tmp_path / "r.bin"
    path.write_bytes(data.tobytes())
    spark.dataSource.register(raster.FlatRaster)
    df = spark.read.format("flat_raster").option("path", str(path)).option("cols", G.cols).option("dtype", dtype).option("order", order).option("fill", 7).load()
    got = {(r["row"], r["col"]): r["value"] for r in df.collect()}
    assert len(got) == G.n_cells
    assert all(got[k // G.cols, k % G.cols] == (None if v == 7 else v) for k, v in enumerate(data.tolist()))


def test_write_flat(spark, tmp_path):
    df = cells.grid_cells(spark, G).filter("row <> 5").withColumn("value", F.col("row") * 3.0 - F.col("col") * 0.5)
    files = raster.write_flat(df, G, str(tmp_path / "out"), "i2", fill=-7, rows_per_file=8)
    data = np.concatenate([np.fromfile(f, "i2") for f in files]).reshape(G.rows, G.cols)
    want = np.add.outer(np.arange(G.rows) * 3.0, np.arange(G.cols) * -0.5)
    want = np.where(want < 0, np.ceil(want - 0.5), np.floor(want + 0.5))
    want[5] = -7
    assert len(files) == 3 and (data == want).all()
    with pytest.raises(Exception, match="fit"):
        raster.write_flat(df, G, str(tmp_path / "bad"), "u1")


def test_points(spark, tmp_path):
    (tmp_path / "p.txt").write_text("1.5 -20 3\n\nbad line\n2 3\n  4\t5  6.25 extra\n")
    got = sorted(map(tuple, points.read_points(spark, str(tmp_path / "p.txt")).collect()))
    assert got == [(1.5, -20.0, 3.0), (4.0, 5.0, 6.25)]
    points.write_points(spark.createDataFrame(got, "lat double, lon double, value double"), str(tmp_path / "out"))
    assert sorted(map(tuple, points.read_points(spark, str(tmp_path / "out")).collect())) == got
    (tmp_path / "p.bin").write_bytes(struct.pack("4d", 1, 2, 3, 4))
    assert sorted(map(tuple, points.read_binary_points(spark, str(tmp_path / "p.bin")).collect())) == [(1, 2), (3, 4)]


@pytest.mark.parametrize("values", [False, True])
def test_binary_points_by_ranges(spark, tmp_path, monkeypatch, values):
    monkeypatch.setattr(points, "BLOCK_BYTES", 100)
    monkeypatch.setattr(points, "TASK_BYTES", 500)
    width, folder = 3 if values else 2, tmp_path / "some points"
    folder.mkdir()
    data = np.arange(100.0 * width).reshape(-1, width)
    for name, rows, tail in (("a.bin", data[:63], b"tail"), ("b.bin", data[63:], b""), ("empty.bin", data[:0], b"")):
        (folder / name).write_bytes(rows.tobytes() + tail)
    df = points.read_binary_points(spark, str(folder), values)
    assert sorted(map(tuple, df.collect())) == list(map(tuple, data.tolist()))
    assert df.rdd.getNumPartitions() == -(-data.nbytes // 500)


@pytest.mark.parametrize("values", [False, True])
def test_write_binary_points(spark, tmp_path, monkeypatch, values):
    monkeypatch.setattr(points, "TASK_BYTES", 1)  # a file for each batch
    width = 3 if values else 2
    rows = [(k / 8, -k / 4, float(k)) for k in range(500)]
    df = spark.createDataFrame([*rows, (None, 1.0, 1.0)], "lat double, lon double, value double").repartition(3)
    points.write_binary_points(df, str(tmp_path / "out"), values)
    monkeypatch.undo()
    files = sorted((tmp_path / "out").iterdir())
    assert len(files) >= 3 and sum(f.stat().st_size for f in files) == 500 * 8 * width
    assert sorted(map(tuple, points.read_binary_points(spark, str(tmp_path / "out"), values).collect())) == [r[:width] for r in rows]
    points.write_binary_points(df.limit(0), str(tmp_path / "none"), values)
    assert not (tmp_path / "none").exists()


def test_segment_file(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(segments, "SEGMENTS", 2)
    rows = [(s, k, (100 * s + k * k) / 1024, (5000 * s + 3 * k) / 1024) for s in range(5) for k in range(s + 2)]
    df = spark.createDataFrame(rows, "seg int, pos int, lat double, lon double")
    path = segments.write_segments(df, str(tmp_path / "s.seg"), "a coast")
    assert segments.read_header(path)[1:] == (5, "a coast")
    segments.register(spark)
    back = vectors.decode(spark.read.format("segment_file").option("path", path).load())
    assert sorted(map(tuple, back.collect())) == rows
    index = {r.seg: r for r in segments.read_index(spark, path).collect()}
    want = {r.seg: r for r in vectors.bounds(df).collect()}
    assert all(getattr(index[s], c) == getattr(want[s], c) for s in range(5) for c in ("lat_min", "lat_max", "lon_min", "lon_max"))
    with pytest.raises(ValueError):
        segments.write_segments(df, path, most_bytes=10)
    (tmp_path / "no").write_bytes(b"x" * 100)
    with pytest.raises(ValueError):
        segments.read_header(str(tmp_path / "no"))


def coast(spark, n=400):
    rows = [(s, k, ((s * 37) % 900 + k) / 16, ((s * 173) % 2800 - 1400 + k) / 8) for s in range(n) for k in range(2 + s % 40)]
    return rows, spark.createDataFrame(rows, "seg int, pos int, lat double, lon double").repartition(3)


LIMITS = [
    ([GreaterThanOrEqual(("lon_min",), 20.0), LessThan(("lon_min",), 24.0)], lambda b: 20 <= b["lon_min"] < 24),
    ([LessThanOrEqual(("lat_max",), 2.0), GreaterThan(("lat_min",), 0.5)], lambda b: b["lat_max"] <= 2 and b["lat_min"] > 0.5),
    ([EqualTo(("seg",), 77)], lambda b: b["seg"] == 77),
    ([In(("seg",), (5, 9, 1000, None))], lambda b: b["seg"] in (5, 9)),
    ([GreaterThan(("lon_min",), 1e6)], lambda b: False),
]


@pytest.mark.parametrize("order", ["seg", "lon_min", "lat_max", "lon_max", "lat_min"])
def test_limits_are_looked_up_in_the_index(spark, tmp_path, monkeypatch, order):
    """Just the segments that match come back, and where the index is in the order of the limit few bytes are read."""
    rows, df = coast(spark)
    path = segments.write_segments(df, str(tmp_path / "s.seg"), order=order)
    bounds = {}
    for s, _, lat, lon in rows:
        b = bounds.setdefault(s, {"seg": s, "lat_min": lat, "lat_max": lat, "lon_min": lon, "lon_max": lon})
        b.update(lat_min=min(b["lat_min"], lat), lat_max=max(b["lat_max"], lat), lon_min=min(b["lon_min"], lon), lon_max=max(b["lon_max"], lon))
    read, plain = [], segments.read_range
    monkeypatch.setattr(segments, "read_range", lambda path, offset=0, length=None: read.append(length) or plain(path, offset, length))
    for filters, match in LIMITS:
        read.clear()
        reader = segments.PushingReader(path)
        assert list(reader.pushFilters(filters)) == []
        got = [s for p in reader.partitions() for b in reader.read(p) for s in set(b.column(0).to_pylist())]
        assert sorted(got) == [s for s, b in bounds.items() if match(shifted(b))]
        if filters[0].attribute[0] == order and order != "lat_max":
            assert sum(read) < 0.2 * (tmp_path / "s.seg").stat().st_size


def shifted(b):
    """Bounds as the format holds them: whole units, of which negative ones come back a unit larger."""
    return {k: v if k == "seg" else (v * 1024 + (v < 0)) / 1024 for k, v in b.items()}


def test_segment_files_of_a_folder(spark, tmp_path):
    """Files of a bounded size; limits pass over whole files, and what is left is Spark's to evaluate."""
    rows, df = coast(spark)
    files = segments.write_segment_files(df, str(tmp_path / "coast"), most_bytes=4000)
    assert len(files) > 5 and all(segments.read_header(f)[1] > 0 for f in files)
    segments.register(spark)
    whole = spark.read.format("segment_file").load(str(tmp_path / "coast"))
    unit = lambda v: (v * 1024 + (v < 0)) / 1024
    want = [(s, k, unit(a), unit(b)) for s, k, a, b in rows]
    assert sorted(map(tuple, vectors.decode(whole).collect())) == want
    pushed = spark.read.format("segment_file_pushed").load(str(tmp_path / "coast"))
    some = pushed.filter("seg >= 30 AND seg < 33 AND lon_min > -1000 AND (pos = 0 OR pos = 1) AND seg IS NOT NULL")
    assert sorted((r.seg, r.pos) for r in some.collect()) == [(s, k) for s in (30, 31, 32) for k in (0, 1)]
    reader = segments.PushingReader(str(tmp_path / "coast"))
    list(reader.pushFilters([EqualTo(("seg",), 30)]))
    assert len(reader.partitions()) == 1
    limited = segments.read_segments(spark, str(tmp_path / "coast"), seg=(30, 32), lon_min=(-1000, None))
    assert limited.filter("seg <> 31").select("seg").distinct().count() == 2 and limited.select("seg").distinct().count() == 3
    assert segments.write_segment_files(df.limit(0), str(tmp_path / "none")) == []
    assert spark.read.format("segment_file").load(str(tmp_path / "none")).count() == 0
    with pytest.raises(Exception, match="more than"):
        segments.write_segment_files(df, str(tmp_path / "coast"), most_bytes=20)
    assert sorted(map(tuple, vectors.decode(whole).collect())) == want  # what was there before a failure stays


@pytest.mark.parametrize("size", [32, 64, 192])
def test_strokes_come_back(spark, tmp_path, monkeypatch, size):
    """Long strokes, far steps, single points and cells at the edges, over chains of records; in blocks smaller than the file."""
    monkeypatch.setattr(strokes, "CELLS", 3)
    rng, rows = np.random.default_rng(3), []
    for seg in range(60):
        n = int(rng.choice([1, 2, 9, 700]))
        a, b = rng.integers(100_000, 6_300_000), rng.integers(200_000, 12_000_000)
        step = rng.integers(-127, 127, (n, 2)) if seg % 3 else rng.integers(-20_000, 20_000, (n, 2))
        path = np.clip(np.cumsum(step, 0) + [a, b], 0, [6_479_999, 12_959_999])
        rows += [(seg, k, float(x) / 36000 - 90, float(y) / 36000 - 180, seg % 64) for k, (x, y) in enumerate(path)]
    rows += [(60, 0, -90.0, -180.0, 63), (61, 0, 89.9999, 179.9999, 1)]
    df = spark.createDataFrame(rows, "seg int, pos int, lat double, lon double, rank int").repartition(4)
    file = strokes.write_strokes(df, str(tmp_path / "bank"), size)
    units = lambda lat, lon: (round((lat + 90) * 36000), round((lon + 180) * 36000))
    found, lines = {}, []
    for r in strokes.read_strokes(spark, file).collect():
        found.setdefault((r.cell, r.part), []).append((r["pos"], r.rank, r.onward, *units(r.lat, r.lon)))
    for key in sorted(found):
        part = sorted(found[key])
        if not part[0][2]:
            lines.append([])
        lines[-1] += [(key[0], rank, a, b) for _, rank, _, a, b in part]
    want = {}
    for seg, _, lat, lon, rank in sorted(rows):
        want.setdefault(seg, []).append((rank, *units(lat, lon)))
    cell = lambda line: line[0][1] // 36000 * 360 + line[0][2] // 36000
    assert sorted(lines) == sorted([(cell(w), *p) for p in w] for w in want.values())
    box = strokes.read_strokes(spark, file, (-90, 0, 100, -100)).select("cell").distinct().collect()
    assert {r.cell for r in box} == {c for (c, _) in found if c // 360 < 90 and (c % 360 >= 280 or c % 360 < 80)}
    assert strokes.read_strokes(spark, file, (5, 5, 0, 1)).count() == 0
    with pytest.raises(ValueError):
        strokes.write_strokes(df, str(tmp_path / "odd"), 60)


def test_strokes_of_a_cell_come_in_one_batch(spark, tmp_path):
    """Steps too far for a byte make a stroke of every point; the reader gives them together, and the records come so as well."""
    rows = [(1, k, 10.0 + k % 7 / 10, 20.0 + k % 11 / 20, 3) for k in range(300)]
    file = strokes.write_strokes(spark.createDataFrame(rows, "seg int, pos int, lat double, lon double, rank int"), str(tmp_path / "bank"))
    reader = strokes.StrokesReader({"path": file})
    (part,) = reader.partitions()
    (batch,) = reader.read(part)
    assert batch.column("part").to_pylist() == list(range(300)) and set(batch.column("pos").to_pylist()) == {0} and set(batch.column("rank").to_pylist()) == {3}
    assert all(abs(a - r[2]) < 1e-9 and abs(b - r[3]) < 1e-9 for r, a, b in zip(rows, batch.column("lat").to_pylist(), batch.column("lon").to_pylist(), strict=True))


def test_strokes_of_a_broken_chain(tmp_path):
    """Records that run in a ring are told, not followed for ever."""
    ring = bytearray(5000 * 64)
    ring[3], ring[5] = 64, 1
    first = strokes.Records.__new__(strokes.Records)
    (tmp_path / "ring").write_bytes(bytes(ring))
    first.__init__(str(tmp_path / "ring"))
    number = first.first + 1
    ring[(number - 1) * 64 + 61 : (number - 1) * 64 + 64] = number.to_bytes(3, "big")
    (tmp_path / "ring").write_bytes(bytes(ring))
    with pytest.raises(ValueError, match="ring"):
        strokes.Records(str(tmp_path / "ring")).of_cell(0)


def test_parts_count_once(tmp_path):
    """An attempt whose message is lost leaves nothing; nor does a job that is given up; appending goes on after what is there."""
    row = lambda place, data: {"place": place, "name": "x", "data": data, "note": None}
    folder = str(tmp_path / "out")
    names = lambda: sorted(f.name for f in (tmp_path / "out").iterdir())
    writer = parts.PartsWriter(folder, True)
    writer.write(iter([row(1, b"lost"), row(2, b"lost")]))  # its executor goes
    writer.commit([writer.write(iter([row(1, b"one"), row(2, bytearray(b"two"))])), None, writer.write(iter([row(0, b"zero")]))])
    read = lambda: b"".join((tmp_path / "out" / f).read_bytes() for _, f, *_ in parts.manifest(folder))
    assert read() == b"zeroonetwo" and len(names()) == 4
    failed = parts.PartsWriter(folder, True)
    failed.abort([failed.write(iter([row(0, b"no")])), None])
    assert read() == b"zeroonetwo" and len(names()) == 4
    more = parts.PartsWriter(folder, False)
    more.commit([more.write(iter([row(0, b"three")]))])
    assert read() == b"zeroonetwothree"
    last = parts.PartsWriter(folder, True)
    last.commit([])
    assert read() == b"" and parts.manifest(str(tmp_path / "nowhere")) == []


def test_location_bands(spark, tmp_path):
    """Bands one after another, as parts and as a file, off the map undefined."""
    polar = GridDef(MapDef("Azimuthal Equal-Area", lat0=90, lon0=0, scale=400, south=0), 40, 30, 1.0, None, 19.5, 14.5)
    files = raster.write_locations(spark, polar, str(tmp_path / "bands"), bands=("lon", "lat"), shift=(0.5, -0.5), double=True, rows_per_file=7)
    assert len(files) == 10
    file = parts.joined(spark, str(tmp_path / "bands"), str(tmp_path / "one.double"), block=1000)
    data = np.fromfile(file).reshape(2, 30, 40)
    want = {(r.row, r.col): (r.lon, r.lat) for r in cells.locations(spark, polar, (0.5, -0.5), -999.0).collect()}
    assert all((data[0, i, j], data[1, i, j]) == want[i, j] for i in range(30) for j in range(40))
    assert (data == -999).any() and (data != -999).any()
    for path in (file, str(tmp_path / "bands")):
        got = {(r.band, r.row, r.col): r.value for r in raster.read_bands(spark, path, polar, "f8").collect()}
        assert len(got) == 2400 and all(got[b, i, j] == data[b, i, j] for b, i, j in got)


def test_streams(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    rng = np.random.default_rng(1)
    for k in range(3):
        (folder / f"{k}.txt").write_text("".join(f"{a:.3f} {b:.3f} {v}\n" for a, b, v in zip(rng.uniform(-80, 80, 50), rng.uniform(-170, 170, 50), rng.integers(1, 9, 50), strict=True)))
    run_to_memory(stream_sums(points.stream_points(spark, str(folder)), G, "cressman", radius=1.0), "sums")
    got = {(r["row"], r["col"]): (r["num"] / r["den"] if r["den"] else None, r["n"]) for r in spark.table("sums").collect()}
    want = {(r["row"], r["col"]): (r["value"], r["n"]) for r in grid_points(points.read_points(spark, str(folder)), G, "cressman", radius=1.0).collect()}
    assert set(got) == set(want) and all(got[k][1] == want[k][1] and got[k][0] == pytest.approx(want[k][0]) for k in want)
    with pytest.raises(ValueError):
        stream_sums(points.stream_points(spark, str(folder)), G, "nearest")
    table = cells.grid_cells(spark, G).withColumn("value", F.col("row") * 100.0 + F.col("col"))
    run_to_memory(stream_values(points.stream_points(spark, str(folder)), table, G, -1.0), "sampled", "append")
    rows = spark.table("sampled").collect()
    assert len(rows) == 150 and all(r["value"] == r["row"] * 100 + r["col"] for r in rows)


@pytest.mark.parametrize("method", ["bucket", "max", "nearest"])
def test_states_between_runs(spark, tmp_path, method):
    """A batch counts once: replayed, from another stream, or cut off before its manifest is there."""
    table = states.StateTable(spark, str(tmp_path / "state"), method)
    state = lambda rows: spark.createDataFrame(rows, states.SCHEMA)
    got = lambda: {(r.row, r.col): (r.num, r.beta) for r in table.read().collect()}
    assert got() == {} and table.values().count() == 0
    first, second = [(0, 0, 4.0, 2.0), (0, 1, 9.0, 1.2)], [(0, 0, 6.0, 1.0), (0, 1, 1.0, 2.4), (5, 5, 3.0, 1.0)]
    assert table.merge(state(first), 0) and not table.merge(state(first), 0)
    assert got() == {(0, 0): (4.0, 2.0), (0, 1): (9.0, 1.2)}
    assert table.merge(state(second), 1)
    want = {"bucket": {(0, 0): (10.0, 3.0), (0, 1): (10.0, 3.6)}, "max": {(0, 0): (6.0, 2.0), (0, 1): (9.0, 2.4)}, "nearest": {(0, 0): (6.0, 1.0), (0, 1): (9.0, 1.2)}}[method] | {(5, 5): (3.0, 1.0)}
    if method == "nearest":  # 2.4 - 1 is over 1.2
        assert got() == want
    else:
        assert {k: pytest.approx(v) for k, v in got().items()} == want
    again = states.StateTable(spark, str(tmp_path / "state"), method)
    assert not again.merge(state(second), 1) and not again.merge(state(first), 0) and again.merge(state([(7, 7, 1.0, 1.0)]), 0, "other")
    with pytest.raises(Exception, match="boom"):
        again.merge(state(first).selectExpr("row", "col", "cast(raise_error('boom') as double) as num", "beta"), 2)
    assert set(got()) == {(0, 0), (0, 1), (5, 5), (7, 7)}
    with pytest.raises(ValueError):
        states.StateTable(spark, str(tmp_path / "state"), "idw").merge(state(first), 9)


def test_contract():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert len(entry.queries()) > 100


def test_segments_of_one_point_share_an_address(spark, tmp_path):
    """The one-point segment has no data and comes later in the index than the segment whose address it has."""
    rows = [(1, 0, 5.0, 30.0), (2, 0, 1.0, 10.0), (2, 1, 2.0, 11.0), (3, 0, 6.0, 40.0), (4, 0, 7.0, 120.0), (4, 1, 7.5, 121.0), (4, 2, 8.0, 122.0)]
    path = str(tmp_path / "shared")
    segments.write_segment_files(spark.createDataFrame(rows, "seg int, pos int, lat double, lon double").coalesce(1), path, order="lon_min")
    for limits, kept in (({}, {1, 2, 3, 4}), ({"lon_min": (0, 100)}, {1, 2, 3})):
        got = vectors.decode(segments.read_segments(spark, path, **limits))
        assert sorted(map(tuple, got.collect())) == [r for r in rows if r[0] in kept]
