"""Chains of segments whose ends meet, joined greedily in the order of the segments.

The rule is sequential: the first segment takes, again and again, the nearest later segment that has an end within reach of
one of its chain's two ends; then the next segment that is left does so, and so on. Segments of different components of
the graph of ends within reach never meet, so components run beside each other: those of up to ``limit`` segments in a
task each, larger ones all together in rounds of which each takes the next step of every such component.
"""

from __future__ import annotations

import math
from itertools import chain as chain_

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.state import settled

#: Kilometres of a degree of latitude on the authalic sphere.
DEGREE_KM = 111.1989
#: Segments of a component that one task holds (some 100 bytes each).
LIMIT = 1_000_000
#: Degrees of a tile whose links are looked at together, and links that a task holds (16 bytes each).
TILE, SOME = 2, 1_000_000


def ends_of(points: DataFrame) -> DataFrame:
    """seg, n (points), alat, alon, blat, blon: the first and the last point. A segment with one point has it twice."""
    p = points.groupBy("seg").agg(F.min_by(F.struct("lat", "lon"), "pos").alias("a"), F.max_by(F.struct("lat", "lon"), "pos").alias("b"), F.count("*").alias("n"))
    return p.select("seg", "n", F.col("a.lat").alias("alat"), F.col("a.lon").alias("alon"), F.col("b.lat").alias("blat"), F.col("b.lon").alias("blon"))


def _cell(lat: Column, lon: Column, row: Column, km: float) -> Column:
    """The number of a cell, ``km`` high and at least as wide all over its row and the rows beside it."""
    pole = (F.abs((row + 0.5) * km / DEGREE_KM - 90) + 1.5 * km / DEGREE_KM).cast("double")
    wide = F.when(pole < 90, F.cos(F.radians(pole))).otherwise(0.0)
    return F.shiftleft(row.cast("long"), 32) + F.floor((lon + 180) * wide * DEGREE_KM / km)


def starred(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links (node, the least node of its component) in place of links (a, b): as many components of the same nodes, and no link more
    than they need."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y, label = at[: len(a)], at[len(a) :], np.arange(len(nodes))
    while (open_ := label[x] != label[y]).any():
        x, y = x[open_], y[open_]
        high, low = np.maximum(label[x], label[y]), np.minimum(label[x], label[y])
        np.minimum.at(label, high, low)
        while (next_ := label[label]).tobytes() != label.tobytes():
            label = next_
    other = label != np.arange(len(nodes))
    return nodes[other], nodes[label[other]]


def fewer(edges: DataFrame) -> DataFrame:
    """Edges (a, b) that link the same nodes as those of edges (a, b, tile): SOME at a time, mostly of one tile, become stars."""

    def run(batches):
        held, n = [], 0
        for batch in chain_(batches, [None]):
            if batch is not None:
                held.append(batch)
                n += batch.num_rows
            if n and (batch is None or n >= SOME):
                a, b = (np.concatenate([h.column(c).to_numpy() for h in held]) for c in (0, 1))
                yield pa.RecordBatch.from_arrays([pa.array(v) for v in starred(a, b)], ["a", "b"])
                held, n = [], 0

    return edges.repartition("tile").select("a", "b").mapInArrow(run, "a long, b long")


def roots(edges: DataFrame) -> DataFrame:
    """node, root (the least node of its component) of nodes that edges (a > b) link. Large and small stars in turn: every node's
    neighbours link to the least one, until nothing changes."""
    now = settled(edges.distinct())
    while True:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a")
        after = settled(small.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b"))).filter("a <> b").distinct())
        same = after.count() == now.count() and after.join(now, ["a", "b"], "left_anti").isEmpty()
        now = after
        if same:
            return now.withColumnsRenamed({"a": "node", "b": "root"})


def grouped(ends: DataFrame, km: float) -> DataFrame:
    """ends with comp: segments with ends in one cell or in cells beside each other are in one component, so that no two ends
    within reach are in different ones. Cells are linked, never pairs of ends: a crowded cell costs its rows only. A cell looks at the
    next one in its row and at three in the row above; the others look at it."""
    row = lambda e: F.floor((F.col(f"{e}lat") + 90) * DEGREE_KM / km)
    cell = lambda e, d=0: _cell(F.col(f"{e}lat"), F.col(f"{e}lon"), row(e) + d, km)
    tile = lambda e: (F.floor((F.col(f"{e}lat") + 90) / TILE) * 1000 + F.floor((F.col(f"{e}lon") + 180) / TILE)).cast("int")
    own = ends.select(F.explode(F.array(*(F.struct(cell(e).alias("cell"), cell(e, 1).alias("above"), tile(e).alias("tile")) for e in "ab"))).alias("p")).select("p.*").distinct()
    cells = ends.select(F.explode(F.array(cell("a"), cell("b"))).alias("b")).distinct()
    links = own.select(F.col("cell").alias("a"), "tile", F.explode(F.array(F.col("cell") + 1, *(F.col("above") + d for d in (-1, 0, 1)))).alias("b")).join(cells, "b")
    ways = ends.select("seg", F.least(cell("a"), cell("b")).alias("a"), F.greatest(cell("a"), cell("b")).alias("b"), F.coalesce(tile("a"), tile("b")).alias("tile"))
    found = roots(fewer(links.select("a", "b", "tile").unionByName(ways.filter("a <> b").select("a", "b", "tile"))))
    of = ways.select("seg", F.col("a").alias("node")).filter("node is not null").join(found, "node", "left").select("seg", F.coalesce("root", "node").alias("comp"))
    return ends.join(of, "seg")


def distance(lat: float, lon: float, lat2: float, lon2: float, km: float) -> float:
    """Kilometres between two ends, to a millimetre's thousandth, or infinity where either difference is over ``km``."""
    dy = (lat - lat2) * DEGREE_KM
    dx = (lon - lon2) * math.cos(math.radians((lat + lat2) / 2)) * DEGREE_KM
    return round(math.sqrt(dx * dx + dy * dy), 9) if abs(dx) <= km and abs(dy) <= km else math.inf


#: Ways to join in the order in which ties are told: which end of the chain (0: start), which of the candidate.
WAYS = ((0, 0), (0, 1), (1, 0), (1, 1))
LINKS = "seg long, head long, place long, back boolean, n long"


def greedy(seg: list, ends: list[tuple], km: float) -> list[tuple]:
    """(seg, head, place, back) of the segments of one component: the chain's first segment, the segment's place in the chain
    (counted from the first segment's, which has 0) and whether it runs backwards. seg in order; ends: (alat, alon, blat, blon).

    Ends are looked up in a lattice; a segment leaves it when a chain takes it.
    """
    n, size = len(seg), km / DEGREE_KM
    lattice: dict[tuple, dict] = {}
    narrow = max(math.cos(math.radians(min(90.0, max(abs(v) for e in ends for v in (e[0], e[2])) + size))), 1e-9) if n else 1.0
    wide = size / narrow  # degrees of longitude within reach, at most
    at = lambda lat, lon: (math.floor(lat / size), math.floor(lon / wide))
    for i, e in enumerate(ends):
        for k in (0, 1):
            lattice.setdefault(at(e[2 * k], e[2 * k + 1]), {})[(i, k)] = None
    gone, out = [False] * n, []

    def drop(i):
        gone[i] = True
        for k in (0, 1):
            lattice[at(ends[i][2 * k], ends[i][2 * k + 1])].pop((i, k), None)

    for h in range(n):
        if gone[h]:
            continue
        drop(h)
        tips, flips, taken = [ends[h][:2], ends[h][2:]], 0, [(h, 0, False)]
        while True:
            best = None
            for way, (mine, _) in enumerate(WAYS[::2]):
                lat, lon = tips[mine]
                r, c = at(lat, lon)
                for cell in ((r + a, c + b) for a in (-1, 0, 1) for b in (-1, 0, 1)):
                    for i, k in lattice.get(cell, ()):
                        d = distance(lat, lon, ends[i][2 * k], ends[i][2 * k + 1], km)
                        if d < math.inf and (best is None or (d, i, 2 * way + k) < best):
                            best = (d, i, 2 * way + k)
            if best is None:
                break
            _, i, way = best
            mine, its = WAYS[way]
            flips += mine == 0  # the chain is turned so that its end meets the candidate
            tips = [tips[1 - mine], ends[i][2:] if its == 0 else ends[i][:2]]
            side = flips % 2
            taken.append((i, -len(taken) if side else len(taken), (its == 1) != bool(side)))
            drop(i)
        turned = flips % 2
        out += [(seg[i], seg[h], -p if turned else p, b != bool(turned)) for i, p, b in taken]
    return out


def _in_tasks(rows: DataFrame, km: float) -> DataFrame:
    """LINKS of the segments of components that a task can hold."""

    def run(table: pa.Table) -> pa.Table:
        t = table.sort_by("seg")
        ends = list(zip(*(t.column(c).to_pylist() for c in ("alat", "alon", "blat", "blon")), strict=True))
        found = greedy(t.column("seg").to_pylist(), ends, km)
        size = dict(zip(t.column("seg").to_pylist(), t.column("n").to_pylist(), strict=True))
        kinds = {"seg": pa.int64(), "head": pa.int64(), "place": pa.int64(), "back": pa.bool_(), "n": pa.int64()}
        return pa.table({name: pa.array([(*f, size[f[0]])[k] for f in found], kind) for k, (name, kind) in enumerate(kinds.items())})

    return rows.groupBy("comp").applyInArrow(run, LINKS)


def _in_rounds(rows: DataFrame, km: float) -> DataFrame | None:
    """LINKS, but for n, of the segments of larger components: a round finds the next segment for the chain of each component (a row each,
    of which there are fewer than rows / LIMIT, so they are broadcast) in one pass over the segments that are left."""
    left = settled(rows)
    heads, done = None, []
    while True:
        if heads is None:
            fresh = left.groupBy("comp").agg(F.min_by(F.struct("seg", "alat", "alon", "blat", "blon"), "seg").alias("h"))
        else:  # components whose chain has ended start with the least segment that is left
            open_ = heads.filter("found").select("comp")
            fresh = left.join(F.broadcast(open_), "comp", "left_anti").groupBy("comp").agg(F.min_by(F.struct("seg", "alat", "alon", "blat", "blon"), "seg").alias("h"))
        fresh = settled(fresh.select("comp", F.col("h.seg").alias("head"), F.col("h.alat").alias("lat0"), F.col("h.alon").alias("lon0"), F.col("h.blat").alias("lat1"), F.col("h.blon").alias("lon1"), F.lit(0).alias("flips"), F.lit(0).cast("long").alias("step")))
        done.append(fresh.select(F.col("head").alias("seg"), "head", F.lit(0).cast("long").alias("place"), F.lit(False).alias("back")))
        going = fresh if heads is None else settled(fresh.unionByName(heads.filter("found").drop("found")))
        if going.isEmpty():
            break
        left = settled(left.join(F.broadcast(fresh.select(F.col("head").alias("seg"))), "seg", "left_anti"))
        near = left.join(F.broadcast(going), "comp")
        ways = []
        for k, (mine, its) in enumerate(WAYS):
            lat, lon, lat2, lon2 = F.col(f"lat{mine}"), F.col(f"lon{mine}"), F.col("ab"[its] + "lat"), F.col("ab"[its] + "lon")
            dy, dx = (lat - lat2) * DEGREE_KM, (lon - lon2) * F.cos(F.radians((lat + lat2) / 2)) * DEGREE_KM
            d = F.when((F.abs(dx) <= km) & (F.abs(dy) <= km), F.round(F.sqrt(dx * dx + dy * dy), 9))
            ways.append(F.when(d.isNotNull(), F.struct(d.alias("d"), F.col("seg").alias("seg"), F.lit(k).alias("way"))))
        best = near.select("comp", "alat", "alon", "blat", "blon", F.least(*ways).alias("w")).filter("w is not null").groupBy("comp").agg(F.min_by(F.struct("*"), "w").alias("b"))
        b, mine, its = F.col("b"), F.floor(F.col("b.w.way") / 2), F.col("b.w.way") % 2
        turned = F.when(mine == 0, 1).otherwise(0)
        stepped = going.join(F.broadcast(best), "comp", "left").select(
            "comp",
            "head",
            *(F.when(b.isNull(), F.col(f"{c}0")).when(mine == 0, F.col(f"{c}1")).otherwise(F.col(f"{c}0")).alias(f"{c}0") for c in ("lat", "lon")),
            *(F.when(b.isNull(), F.col(f"{c}1")).when(its == 0, F.col(f"b.b{c}")).otherwise(F.col(f"b.a{c}")).alias(f"{c}1") for c in ("lat", "lon")),
            (F.col("flips") + F.coalesce(turned, F.lit(0))).alias("flips"),
            (F.col("step") + F.when(b.isNull(), 0).otherwise(1)).alias("step"),
            b.isNotNull().alias("found"),
            F.col("b.w.seg").alias("took"),
            (its == 1).alias("other"),
        )
        stepped = settled(stepped)
        side = F.col("flips") % 2 == 1
        done.append(stepped.filter("found").select(F.col("took").alias("seg"), "head", F.when(side, -F.col("step")).otherwise(F.col("step")).alias("place"), (F.col("other") != side).alias("back")))
        done.append(stepped.filter(~F.col("found") & side).select(F.lit(None).cast("long").alias("seg"), "head", F.lit(0).cast("long").alias("place"), F.lit(True).alias("back")))
        left = settled(left.join(F.broadcast(stepped.filter("found").select(F.col("took").alias("seg"))), "seg", "left_anti"))
        heads = stepped.drop("took", "other")
        if len(done) > 60:
            done = [settled(_union(done))]
    links = settled(_union(done))
    turned = links.filter("seg is null").select("head", F.lit(True).alias("turned"))  # chains that end turned round
    out = links.filter("seg is not null").join(turned, "head", "left")
    t = F.coalesce("turned", F.lit(False))
    return out.select("seg", "head", F.when(t, -F.col("place")).otherwise(F.col("place")).alias("place"), (F.col("back") != t).alias("back"))


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def links(points: DataFrame, km: float, limit: int = LIMIT) -> DataFrame:
    """seg, head, place, back, n of every segment. See greedy."""
    ends = settled(ends_of(points).withColumn("seg", F.col("seg").cast("long")))
    rows = settled(grouped(ends, km))
    sizes = rows.groupBy("comp").agg(F.count("*").alias("size")).filter(F.col("size") > limit)
    large = settled(sizes.select("comp"))  # fewer than rows / limit
    found = _in_tasks(rows.join(F.broadcast(large), "comp", "left_anti"), km)
    if not large.isEmpty():
        most = rows.join(F.broadcast(large), "comp")
        found = found.unionByName(_in_rounds(most.select("seg", "comp", "alat", "alon", "blat", "blon"), km).join(most.select("seg", "n"), "seg"))
    return found


def chain(points: DataFrame, km: float, limit: int = LIMIT) -> DataFrame:
    """points of chains: seg (the chain's first segment), pos, lat, lon, from_seg.

    An end reaches another where neither the differences in latitude nor in longitude, in kilometres, are over ``km``; the
    nearest counts, then the earlier segment, then the start of the chain before its end. Each segment is in one chain, a
    lone one in its own; the last one too. Nothing joins across the date line. A segment's points are ordered by pos; points that are
    partitioned by seg are not shuffled for it.
    """
    found = links(points, km, limit)
    before = Window.partitionBy("head").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)  # a row for each segment
    found = settled(found.withColumn("offset", F.coalesce(F.sum("n").over(before), F.lit(0))))
    own = F.row_number().over(Window.partitionBy("seg").orderBy("pos")) - 1
    p = points.select(F.col("seg").cast("long").alias("seg"), "pos", "lat", "lon").withColumn("_at", own).join(found, "seg")
    at = F.when(F.col("back"), F.col("n") - 1 - F.col("_at")).otherwise(F.col("_at"))
    return p.select(F.col("head").alias("seg"), (F.col("offset") + at).alias("pos"), "lat", "lon", F.col("seg").alias("from_seg"))
