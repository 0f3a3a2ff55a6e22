"""p7: points near other points or inside regions, by adaptive coverage with cells.

The cells are cubes around the unit sphere, nested by halving: no poles and no date line.
A region (here a disk around a point) is covered from coarse to fine. A cell that lies wholly inside is
*interior*: an equi-join with the points of that cell accepts them without any distance. A cell that the border crosses
is split further as long as its coarse cell is crowded, and is a *boundary* cell in the end: only its matches get the exact
test. Coarse cells without any point are dropped before they are split.

Cells of all points of an Arrow batch are computed at once, in arrays. A pair is met once, from the point whose finest cell comes first (in an order in which cells of
any level are contiguous; then by id): cells before the point's own are not covered at all.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.session import parallelism

EARTH_KM = 6371.0088
#: Points in a coarse cell from which it is split; each halving makes twice as many cells of a border and saves half of its tests, so a cell of
#: ``CROWDED * 4 ** d`` points is halved ``d`` times. ``FINEST``: a bound of the halvings that the numbers can express.
CROWDED, FINEST = 16, 20
#: Slack of interior and outside decisions, far above rounding, far below any distance of interest.
SLACK = 1e-11


def usable_points(df: DataFrame, key: str, latitude: str, longitude: str) -> DataFrame:
    """``(id, lat, lon)``: distinct places with both numbers given, no NaN, within range and not both exactly 0."""
    lat, lon = F.col("lat"), F.col("lon")
    fine = lat.between(-90.0, 90.0) & lon.between(-180.0, 180.0) & ~F.isnan(lat) & ~F.isnan(lon) & ~((lat == 0) & (lon == 0))
    points = df.select(F.col(key).alias("id"), F.col(latitude).cast("double").alias("lat"), F.col(longitude).cast("double").alias("lon")).where(fine & F.col("id").isNotNull()).distinct()
    return points


def great_circle(lat1: Column, lon1: Column, lat2: Column, lon2: Column, radius: float = EARTH_KM) -> Column:
    """Haversine distance in the unit of ``radius``."""
    a, b = F.radians(lat1), F.radians(lat2)
    h = F.pow(F.sin((b - a) / 2), 2) + F.cos(a) * F.cos(b) * F.pow(F.sin((F.radians(lon2) - F.radians(lon1)) / 2), 2)
    return F.lit(2.0 * radius) * F.asin(F.sqrt(F.least(h, F.lit(1.0))))


def _coarse(xyz: np.ndarray, side: float) -> np.ndarray:
    return np.floor((xyz + 1.0) / side).astype(np.int64)


def _number(cell: np.ndarray, width: int) -> np.ndarray:
    """Coarse cells as numbers, in the order of their coordinates."""
    return (cell[..., 0] * width + cell[..., 1]) * width + cell[..., 2]


def _bounds(low: np.ndarray, size: np.ndarray, xyz: np.ndarray, reach: float) -> tuple[np.ndarray, np.ndarray]:
    """Of cells (lowest corner, side) and points: does the cell touch both disk and sphere, does it lie wholly inside the disk."""
    high = low + size[..., None]
    far = np.sqrt((np.maximum(np.abs(xyz - low), np.abs(xyz - high)) ** 2).sum(-1))
    near = np.sqrt((np.maximum(np.maximum(low - xyz, xyz - high), 0.0) ** 2).sum(-1))
    origin_far = (np.maximum(np.abs(low), np.abs(high)) ** 2).sum(-1)
    origin_near = (np.maximum(np.maximum(low, -high), 0.0) ** 2).sum(-1)
    return (near <= reach + SLACK) & (origin_far >= 1.0 - 1e-9) & (origin_near <= 1.0 + 1e-9), far <= reach - SLACK


_AROUND = np.array([(i, j, k) for i in (-1, 0, 1) for j in (-1, 0, 1) for k in (-1, 0, 1)])[13:]  # the own cell and those after it
_EIGHTH = np.array([(i, j, k) for i in (0, 1) for j in (0, 1) for k in (0, 1)])


def _xyz(batch: pa.RecordBatch) -> np.ndarray:
    lat, lon = np.radians(batch.column("lat").to_numpy()), np.radians(batch.column("lon").to_numpy())
    return np.stack([np.cos(lat) * np.cos(lon), np.cos(lat) * np.sin(lon), np.sin(lat)], 1)


def _fine(xyz: np.ndarray, cell: np.ndarray, side: float, depth: int) -> np.ndarray:
    """The number of the eighth of an eighth ... of its coarse cell that a point lies in, ``depth`` times. Halving keeps cells nested: floor(2 v) // 2 == floor(v)."""
    at = np.floor((xyz + 1.0) / side * 2.0**depth).astype(np.int64) - (cell << depth)
    out = np.zeros(len(xyz), np.int64)
    for level in range(depth - 1, -1, -1):
        bit = (at >> level) & 1
        out = (out << 3) | (bit[:, 0] << 2) | (bit[:, 1] << 1) | bit[:, 2]
    return out


def near_pairs(points: DataFrame, km: float, radius: float = EARTH_KM) -> DataFrame:
    """``(id_a, id_b)``, ``id_a < id_b``, of :func:`usable_points` at most ``km`` apart; each pair once.

    Points at one spot, at the poles and on both sides of the date line are pairs like any other. Ids of equal
    value are one point: rows that give an id several positions are compared position by position.
    """
    reach = 2.0 * math.sin(min(km / radius, math.pi) / 2.0)  # as a chord
    side = max(reach, 1e-6)
    width = int(2.0 / side) + 4
    kind = dict(points.dtypes)["id"]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.append_column("cell", pa.array(_number(_coarse(_xyz(batch), side), width)))

    def cover(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            xyz = _xyz(batch)
            cells = _coarse(xyz, side)[:, None, :] + _AROUND
            touches, _ = _bounds(cells * side - 1.0, np.full(cells.shape[:2], side), xyz[:, None, :], reach)
            at, which = np.nonzero(touches)
            yield batch.take(pa.array(at)).append_column("into", pa.array(_number(cells[at, which], width)))

    def refine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each (point, coarse cell) as cells of any level: ``level`` and ``sub``, its number within the coarse cell; ``own``: the point lies in it."""
        for whole in batches:
            for s in range(0, whole.num_rows, 2048):  # a crowded cell has many parts: few points at a time
                batch = whole.slice(s, 2048)
                xyz, depth, into = _xyz(batch), batch.column("depth").to_numpy(), batch.column("into").to_numpy()
                cell = np.stack([into // width // width, into // width % width, into % width], 1)
                home = into == batch.column("cell").to_numpy()
                own_cell = _coarse(xyz, side)
                row, at, sub, level = np.arange(len(xyz)), cell, np.zeros(len(xyz), np.int64), 0
                while len(row):
                    size = side / 2.0**level
                    touches, inside = _bounds(at * size - 1.0, np.full(len(row), size), xyz[row], reach)
                    own = np.zeros(len(row), bool)
                    for d in np.unique(depth[row]):
                        same = (depth[row] == d) & home[row]
                        if same.any() and level <= d:
                            mine = _fine(xyz[row[same]], own_cell[row[same]], side, level)
                            own[same] = sub[same] == mine
                            touches[same] &= sub[same] >= mine  # cells before the own one meet this point from their side
                    row, at, sub, inside, own = row[touches], at[touches], sub[touches], inside[touches], own[touches]
                    done = inside | (depth[row] <= level)
                    if done.any():
                        out = batch.take(pa.array(row[done])).select(["id", "lat", "lon", "fine"])
                        for name, value in (("into", into[row[done]]), ("level", np.full(done.sum(), level, np.int32)), ("sub", sub[done]), ("interior", inside[done]), ("own", own[done])):
                            out = out.append_column(name, pa.array(value))
                        yield out
                    row, at, sub = row[~done], at[~done], sub[~done]
                    row, sub = np.repeat(row, 8), np.repeat(sub, 8) * 8 + np.tile(np.arange(8), len(sub))
                    at = (2 * at[:, None, :] + _EIGHTH).reshape(-1, 3)
                    level += 1

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Adds ``fine``, the number of the finest cell of a point within its coarse cell."""
        for batch in batches:
            xyz, depth = _xyz(batch), batch.column("depth").to_numpy()
            cell, out = _coarse(xyz, side), np.zeros(len(xyz), np.int64)
            for d in np.unique(depth):
                own = depth == d
                out[own] = _fine(xyz[own], cell[own], side, int(d))
            yield batch.append_column("fine", pa.array(out))

    # a few bytes a point, but many cells and tests each: spread by number, not by size
    points = points.select("id", "lat", "lon").repartition(parallelism(points.sparkSession), "id").distinct()
    point = f"id {kind}, lat double, lon double, cell long"
    placed = points.mapInArrow(place, point)
    depth = f"least({FINEST}, greatest(0, cast(ceil(log2(n / {CROWDED}d) / 2) as int)))"
    occupied = placed.groupBy("cell").agg(F.count("*").alias("n")).selectExpr("cell", f"{depth} as depth")
    held = placed.join(occupied, "cell").select("id", "lat", "lon", "cell", "depth").mapInArrow(number, f"{point}, depth int, fine long")
    # what lies in an occupied cell is covered to that cell's depth; a point's own number only counts in its own cell
    left = held.select("id", "lat", "lon", "cell", "fine").mapInArrow(cover, f"{point}, fine long, into long")
    left = left.join(occupied.withColumnRenamed("cell", "into"), "into").select("id", "lat", "lon", "cell", "fine", "into", "depth")
    left = left.mapInArrow(refine, f"id {kind}, lat double, lon double, fine long, into long, level int, sub long, interior boolean, own boolean")
    left = left.selectExpr("id as id_a", "lat as lat_a", "lon as lon_a", "fine as fine_a", "into as cell", "level", "sub", "interior", "own")
    # a point is found under its cell of every level down to the depth of its coarse cell
    right = held.selectExpr("id as id_b", "lat as lat_b", "lon as lon_b", "fine as fine_b", "cell", "depth", "explode(sequence(0, depth)) as level")
    right = right.selectExpr("id_b", "lat_b", "lon_b", "fine_b", "cell", "level", "shiftright(fine_b, 3 * (depth - level)) as sub")
    near = great_circle(F.col("lat_a"), F.col("lon_a"), F.col("lat_b"), F.col("lon_b"), radius) <= km
    later = "not own or fine_b > fine_a or (fine_b = fine_a and id_b > id_a)"
    met = left.join(right, ["cell", "level", "sub"]).where(F.expr(later) & (F.col("interior") | near)).selectExpr("least(id_a, id_b) as id_a", "greatest(id_a, id_b) as id_b")
    return _once(met, points)


def _once(met: DataFrame, points: DataFrame) -> DataFrame:
    """Each pair once: only ids with several positions come more than once, so only their pairs are compared."""
    several = points.groupBy("id").count().where("count > 1").select("id")
    if several.isEmpty():
        return met
    marked = met.join(several.selectExpr("id as id_a", "true as a"), "id_a", "left").join(several.selectExpr("id as id_b", "true as b"), "id_b", "left")
    alone = marked.where("a is null and b is null").select("id_a", "id_b")
    return alone.union(marked.where("(a or b) and id_a <> id_b").select("id_a", "id_b").distinct())


# -- regions ------------------------------------------------------------------
def cover_polygon(ring: Sequence[tuple[float, float]], depth: int = 10, budget: int = 4096, step: int = 2) -> list[tuple[int, int, int, bool]]:
    """Cells ``(level, row, column, interior)`` of a latitude/longitude quadtree that cover a polygon given by its
    ``(lat, lon)`` corners: interior cells wholly inside, boundary cells crossed by an edge. Only every ``step``-th level has cells, so that points need
    fewer numbers. Splitting stops at ``depth`` or when ``budget`` cells are reached (then cells stay coarser; the cover stays complete)."""
    ring = list(ring)
    if len(ring) < 3:
        return []
    edges = np.array([[*ring[i], *ring[(i + 1) % len(ring)]] for i in range(len(ring))], float)
    done, queue, parts = [], [(0, 0, 0)], 2**step
    while queue:
        level, row, column = queue.pop(0)
        size = 360.0 / 2**level
        south, west = -180.0 + row * size, -180.0 + column * size
        crossed = _crosses(edges, south, west, size)
        if not crossed:
            if contains(ring, np.array([south + size / 2]), np.array([west + size / 2]))[0]:
                done.append((level, row, column, True))
        elif level + step > depth or len(done) + len(queue) >= budget:
            done.append((level, row, column, False))
        else:
            queue += [(level + step, parts * row + i, parts * column + j) for i in range(parts) for j in range(parts)]
    return done


def _crosses(edges: np.ndarray, south: float, west: float, size: float) -> bool:
    """Whether an edge meets the closed cell (Liang-Barsky clipping of all edges at once)."""
    y, x, dy, dx = edges[:, 0], edges[:, 1], edges[:, 2] - edges[:, 0], edges[:, 3] - edges[:, 1]
    lo, hi = np.zeros(len(edges)), np.ones(len(edges))
    ok = np.ones(len(edges), bool)
    for at, step, a, b in ((y, dy, south, south + size), (x, dx, west, west + size)):
        still = step == 0
        ok &= ~still | ((at >= a) & (at <= b))
        with np.errstate(divide="ignore", invalid="ignore"):
            p, q = (a - at) / step, (b - at) / step
        lo = np.where(still, lo, np.maximum(lo, np.minimum(p, q)))
        hi = np.where(still, hi, np.minimum(hi, np.maximum(p, q)))
    return bool((ok & (lo <= hi)).any())


def contains(ring: Sequence[tuple[float, float]], lat: np.ndarray, lon: np.ndarray) -> np.ndarray:
    """Even-odd containment of points; points on an edge count as inside."""
    corners = np.array(ring, float)
    return _within(np.hstack([corners, np.roll(corners, -1, 0)]), lat, lon)


def _within(edges: np.ndarray, lat: np.ndarray, lon: np.ndarray) -> np.ndarray:
    """The same for edges ``(lat1, lon1, lat2, lon2)``: those that reach none of the latitudes may be left out."""
    y1, x1, y2, x2 = edges.T
    py, px = lat[:, None], lon[:, None]
    above = (y1 > py) != (y2 > py)
    with np.errstate(divide="ignore", invalid="ignore"):
        at = (x2 - x1) * (py - y1) / (y2 - y1) + x1
    inside = (above & (px < at)).sum(1) % 2 == 1
    cross = (px - x1) * (y2 - y1) - (py - y1) * (x2 - x1)
    on = (cross == 0) & (np.minimum(x1, x2) <= px) & (px <= np.maximum(x1, x2)) & (np.minimum(y1, y2) <= py) & (py <= np.maximum(y1, y2))
    return inside | on.any(1)


def points_in_regions(points: DataFrame, regions: DataFrame, depth: int = 10) -> DataFrame:
    """``(id, region_id)``: points of :func:`usable_points` inside the polygons of ``regions(region_id, ring)``, ``ring`` an
    array of ``struct<lat,lon>`` that does not cross the date line. Null, NaN or short rings contain nothing. Interior cells
    accept through the join alone. A boundary cell carries the edges that reach its latitudes, which is all that the exact test of
    its points needs; the points of a cell are tested together. A region id with several rings is their union."""

    def covers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for region, ring in zip(batch.column(0), batch.column(1).to_pylist()):
                corners = np.array([(c["lat"], c["lon"]) for c in ring or [] if c and c["lat"] is not None and c["lon"] is not None])
                if len(corners) < 3 or not np.isfinite(corners).all():
                    continue
                edges = np.hstack([corners, np.roll(corners, -1, 0)])
                low, high = np.minimum(edges[:, 0], edges[:, 2]), np.maximum(edges[:, 0], edges[:, 2])
                cells = cover_polygon(corners.tolist(), depth)
                bands = []
                for level, row, _, interior in cells:
                    south, size = -180.0 + row * 360.0 / 2**level, 360.0 / 2**level
                    bands.append(None if interior else edges[(high >= south) & (low <= south + size)].ravel())
                columns = list(zip(*cells)) or [()] * 4
                arrays = [pa.array(columns[i], pa.int32()) for i in range(3)]
                yield pa.record_batch([pa.array([region.as_py()] * len(cells), batch.schema.types[0]), *arrays, pa.array(columns[3], pa.bool_()), pa.array(bands, pa.list_(pa.float64()))], names=["region_id", "level", "row", "column", "interior", "edges"])

    kind = dict(regions.dtypes)["region_id"]
    shaped = regions.select("region_id", F.col("ring").cast("array<struct<lat:double,lon:double>>").alias("ring"))
    cells = shaped.repartition(parallelism(points.sparkSession)).mapInArrow(covers, f"region_id {kind}, level int, row int, column int, interior boolean, edges array<double>")
    size = "(360d / pow(2d, level))"
    at = points.selectExpr("id", "lat", "lon", f"explode(sequence(0, {depth}, 2)) as level").selectExpr("*", f"cast(floor((lat + 180) / {size}) as int) as row", f"least(cast(floor((lon + 180) / {size}) as int), cast(pow(2d, level) as int) - 1) as column")
    met = at.join(cells, ["level", "row", "column"])

    def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lat, lon = batch.column("lat").to_numpy(), batch.column("lon").to_numpy()
            keep = batch.column("interior").to_numpy(zero_copy_only=False).copy()
            open_ = np.flatnonzero(~keep)
            cell = batch.column("cell").to_numpy()
            edges = batch.column("edges")
            for number in np.unique(cell[open_]):
                own = open_[cell[open_] == number]
                keep[own] = _within(edges[int(own[0])].values.to_numpy().reshape(-1, 4), lat[own], lon[own])
            yield batch.select(["id", "region_id"]).filter(pa.array(keep))

    tested = met.selectExpr("id", "region_id", "lat", "lon", "interior", "edges", "xxhash64(region_id, level, row, column, edges) as cell").mapInArrow(exact, f"id {dict(points.dtypes)['id']}, region_id {kind}")
    return tested.distinct()
