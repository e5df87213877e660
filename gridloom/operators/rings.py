"""Rings around the objects of binary rasters, stitched across tiles.

The border of a region of dual cells (see ``polygons``) is a set of directed edges with the region on
their left in map orientation (y up). At a corner that several edges leave, the border goes on with the
first one clockwise from where it came, so regions that touch in a point stay apart. Every task chains
the edges of its tiles into paths that end where a tile does; paths are linked at those corners by an
equi-join and brought into order by pointer doubling (list ranking): each round of joins doubles the
number of paths that a path sees ahead, so the rounds grow with the logarithm of the longest ring's.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.functions import geo
from gridloom.functions.shared import components, dense_ids, settle
from gridloom.operators import polygons, vector

#: Steps by direction: east, then counterclockwise by eighths of a turn, with rows counting down.
STEP_X = np.array([1, 1, 0, -1, -1, -1, 0, 1])
STEP_Y = np.array([0, -1, -1, -1, 0, 1, 1, 1])
EAST, NORTH, WEST, SOUTH = 0, 2, 4, 6
#: A path: its points but the last, where it starts and ends, and the directions there in eighths of a turn.
PATHS = "raster_id long, closed boolean, xs array<long>, ys array<long>, y0 long, x0 long, d0 double, y1 long, x1 long, d1 double"
KINDS = {"raster_id": pa.int64(), "closed": pa.bool_(), "xs": pa.list_(pa.int64()), "ys": pa.list_(pa.int64()), **{f"{c}{k}": pa.float64() if c == "d" else pa.int64() for k in (0, 1) for c in "yxd"}}


def clockwise(came: Column | np.ndarray, leaves: Column | np.ndarray):
    """Eighths of a turn, clockwise, from the way back of an edge to one that leaves its end."""
    return (came + 12 - leaves) % 8


def _edges(r: np.ndarray, c: np.ndarray, bits: np.ndarray, linked: dict[str, np.ndarray]) -> tuple[np.ndarray, ...]:
    """The cell, start (x, y) and direction of every border edge of cells."""
    ul, ur, ll, lr = (bits & b > 0 for b in (1, 2, 4, 8))
    sides = [  # where an edge is, its start's place in the cell, its direction
        (ul & ll & ~linked["left"], 0, 0, SOUTH),
        (ll & lr & ~linked["down"], 0, 1, EAST),
        (lr & ur & ~linked["right"], 1, 1, NORTH),
        (ur & ul & ~linked["up"], 1, 0, WEST),
        (~ul, 1, 0, 5),
        (~ur, 1, 1, 3),
        (~ll, 0, 0, 7),
        (~lr, 0, 1, 1),
    ]
    at = [np.flatnonzero(there) for there, *_ in sides]
    return np.concatenate(at), np.concatenate([c[i] + dx for i, (_, dx, _, _) in zip(at, sides, strict=True)]), np.concatenate([r[i] + dy for i, (_, _, dy, _) in zip(at, sides, strict=True)]), np.concatenate([np.full(len(i), d) for i, (*_, d) in zip(at, sides, strict=True)])


def turns_only(x: np.ndarray, y: np.ndarray, closed: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Points without those on a straight way from their neighbours; of an open path the first one stays."""
    dx, dy = np.sign(np.roll(x, -1) - x), np.sign(np.roll(y, -1) - y)
    slope = (np.roll(x, -1) - x) * (y - np.roll(y, 1)) - (np.roll(y, -1) - y) * (x - np.roll(x, 1))
    keep = (slope != 0) | (dx != np.roll(dx, 1)) | (dy != np.roll(dy, 1))
    if not closed:
        keep[0] = True
        keep[-1] = True
    return x[keep], y[keep]


def turned(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A ring from its topmost point on, the leftmost of several (where it touches itself by the next point)."""
    k = np.lexsort((np.roll(x, -1), np.roll(y, -1), x, y))[0] if len(x) else 0
    return np.roll(x, -k), np.roll(y, -k)


def chain(begins: np.ndarray, ends: np.ndarray, d: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> list[tuple[list[int], bool]]:
    """Directed edges as paths (edge by edge, and whether closed), by the corners (whole numbers) they begin and end at.

    d are directions in eighths of a turn; starts and stops tell the edges that begin or end a path.
    """
    order = np.argsort(begins, kind="stable")
    first, past = np.searchsorted(begins[order], ends), np.searchsorted(begins[order], ends, "right")
    follow, least = np.full(len(begins), -1), np.full(len(begins), 9.0)
    for k in range(int((past - first).max(initial=0))):
        at = np.flatnonzero(first + k < past)
        to = order[first[at] + k]
        turn = clockwise(d[at], d[to])
        better = turn < least[at]
        follow[at[better]], least[at[better]] = to[better], turn[better]
    follow[stops] = -1
    ahead, seen, out = follow.tolist(), np.zeros(len(begins), dtype=bool), []

    def walk(e: int) -> list[int]:
        way = [e]
        while (e := ahead[e]) >= 0 and e != way[0]:
            way.append(e)
        seen[way] = True
        return way

    for e in np.flatnonzero(starts).tolist():
        out.append((walk(e), False))
    for e in range(len(begins)):
        if not seen[e]:
            out.append((walk(e), True))
    return out


def _paths(cols: list[np.ndarray], side: int) -> pa.RecordBatch:
    """The paths of whole tiles, sorted by tile."""
    raster, r, c, bits, right, down, left, up = cols
    new = (np.diff(raster) != 0) | (np.diff(r // side) != 0) | (np.diff(c // side) != 0)
    cell, x, y, d = _edges(r, c, bits, {"right": right, "down": down, "left": left, "up": up})
    tile = np.concatenate(([0], np.cumsum(new)))[cell]
    ty, tx = r[cell] // side * side, c[cell] // side * side
    ex, ey = x + STEP_X[d], y + STEP_Y[d]
    corner = lambda px, py: (tile * (side + 1) + py - ty) * (side + 1) + px - tx
    # corners that other tiles may have edges at end a path
    shared = lambda px, py: ((py - ty) % side == 0) & (py > 0) | ((px - tx) % side == 0) & (px > 0)
    out: dict[str, list] = {n: [] for n in KINDS}
    for way, closed in chain(corner(x, y), corner(ex, ey), d, shared(x, y), shared(ex, ey)):
        a, z = way[0], way[-1]
        wx, wy = x[way], y[way]
        if closed:
            wx, wy = turned(*turns_only(wx, wy))
        else:
            bend = np.concatenate(([True], d[way[1:]] != d[way[:-1]]))
            wx, wy = wx[bend], wy[bend]
        for name, v in zip(out, (raster[cell[a]], closed, wx, wy, y[a], x[a], d[a], ey[z], ex[z], d[z]), strict=True):
            out[name].append(v)
    return pa.RecordBatch.from_arrays([pa.array(v, type=KINDS[n]) for n, v in out.items()], names=list(out))


def _join_paths(paths: DataFrame) -> DataFrame:
    """raster_id, xs, ys of the rings that open paths make up, in order but not yet tidied."""
    p = settle(paths.withColumn("id", F.monotonically_increasing_id()), "paths")
    starts = p.select("raster_id", F.col("y0").alias("y1"), F.col("x0").alias("x1"), "d0", F.col("id").alias("to"))
    link = p.select("id", "raster_id", "y1", "x1", "d1").join(starts, ["raster_id", "y1", "x1"])
    link = settle(link.groupBy("id").agg(F.min_by("to", clockwise(F.col("d1"), F.col("d0"))).alias("to")), "links")
    ring = components(link.select(F.col("id").alias("a"), F.col("to").alias("b"))).select(F.col("node").alias("id"), F.col("label").alias("ring"))
    ahead = link.join(ring, "id", "left").withColumn("ring", F.coalesce("ring", "id"))  # a path that meets itself is a ring
    # cut at the path that names the ring; a path's rank is how many paths lie between it and the cut
    ahead = settle(ahead.select("id", "ring", F.when(F.col("to") != F.col("ring"), F.col("to")).alias("to"), F.lit(0).cast("long").alias("rank")), "ranks")
    while not ahead.filter("to is not null").isEmpty():
        beyond = ahead.select(F.col("id").alias("to"), F.col("to").alias("next"), (F.col("rank") + 1).alias("more"))
        ahead = settle(ahead.join(beyond, "to", "left").select("id", "ring", F.col("next").alias("to"), (F.col("rank") + F.coalesce("more", F.lit(0))).alias("rank")), "ranks")
    pieces = p.join(ahead.select("id", "ring", "rank"), "id").groupBy("ring").agg(F.first("raster_id").alias("raster_id"), F.array_sort(F.collect_list(F.struct((-F.col("rank")).alias("k"), "xs", "ys"))).alias("w"))
    return pieces.select("raster_id", F.flatten(F.transform("w", lambda s: s["xs"])).alias("xs"), F.flatten(F.transform("w", lambda s: s["ys"])).alias("ys"))


def loops(x: np.ndarray, y: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """A ring as simple ones: where it passes a point again, what lies in between is a ring of its own."""
    points = list(zip(x.tolist(), y.tolist(), strict=True))
    if len(set(points)) == len(points):
        return [(x, y)]
    out, way, place = [], [], {}
    for k, p in enumerate(points):
        if p in place:
            cut = place[p]
            out.append(way[cut:])
            for q in way[cut:]:
                del place[points[q]]
            del way[cut:]
        place[p] = len(way)
        way.append(k)
    return [turned(*turns_only(x[w], y[w])) for w in [*out, way]]


def _tidy(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        done = [(raster, *loop) for raster, x, y in zip(b.column(0).to_pylist(), b.column(1), b.column(2), strict=True) for loop in loops(*turned(*turns_only(x.values.to_numpy(), y.values.to_numpy())))]
        yield pa.RecordBatch.from_arrays([pa.array([d[k] for d in done], type=t) for k, t in enumerate((pa.int64(), KINDS["xs"], KINDS["ys"]))], names=["raster_id", "xs", "ys"])


def join_all(paths: DataFrame) -> DataFrame:
    """raster_id, xs, ys of all rings of written paths, with only the points where they turn."""
    names = ["raster_id", "xs", "ys"]
    opened = paths.filter("not closed").drop("closed")
    rings = paths.filter("closed").select(*names)
    if not opened.isEmpty():
        rings = rings.unionByName(_join_paths(opened))
    return rings.mapInArrow(_tidy, "raster_id long, xs array<long>, ys array<long>")


def trace(cells: DataFrame, side: int = polygons.SIDE) -> DataFrame:
    """raster_id, ring, hole of every border of the regions of cells (raster_id, row, col, bits, right, down, left, up).

    Rings are in pixels (x a column, y a row from 0 on), begin at their topmost point (the leftmost of
    several), have the region on their left with y up, and only points where they turn; hole tells
    those that run around a gap. A ring is one row, however many tiles it crosses.
    """
    names = ["raster_id", "row", "col", "bits", "right", "down", "left", "up"]

    def run(batches):
        for cols in polygons.whole_tiles(batches, side):
            yield _paths(cols, side)

    tile = ["raster_id", F.floor(F.col("row") / side), F.floor(F.col("col") / side)]
    keyed = cells.select(F.col("raster_id").cast("long").alias("raster_id"), *names[1:])
    paths = settle(keyed.repartition(*tile).sortWithinPartitions(*tile, "row", "col").mapInArrow(run, PATHS), "ring-paths")
    rings = join_all(paths)
    p = F.zip_with("xs", "ys", lambda x, y: F.struct(x.cast("double").alias("x"), y.cast("double").alias("y")))
    return rings.select("raster_id", p.alias("ring")).withColumn("hole", vector.ring_signed_area(F.col("ring")) > 0)


def polygonize_rings(px: DataFrame, side: int = polygons.SIDE, fill: bool = True) -> DataFrame:
    """raster_id, ring, hole of the objects of a dense px (raster_id, row, col, on), as trace() gives them.

    Gaps are filled first unless fill is False; then they are rings as well. A null pixel is not set; a
    raster without an object has no row.
    """
    px = px.withColumn("on", F.coalesce("on", F.lit(False)))
    filled = polygons.fill_holes(px, side) if fill else px.filter("on").select(F.col("raster_id").cast("long").alias("raster_id"), "row", "col")
    return trace(polygons.dual_cells(filled, around=True), side)


def ring_features(rings: DataFrame, meta: DataFrame) -> DataFrame:
    """Rings in pixels as features in map units: id, raster_id, class, label, ring, area_m2, perim_m, a_diam_m, xmin .. ymax, cx, cy.

    meta: raster_id, xmin, ymin, xmax, ymax, width, height, epsg. Areas and perimeters are those of the
    ring's points in the equal-area projection around the longitude of the extent's lower left corner; box
    and centroid are in map units. Holes and rings of a raster without meta are left out; an unknown
    system gives null measures. Ids go by raster and place.
    """
    at = meta.select(F.col("raster_id").cast("long").alias("raster_id"), *[F.col(c).alias(f"gl_{c}") for c in ("xmin", "ymin", "xmax", "ymax", "width", "height", "epsg")])
    j = rings.filter(~F.col("hole")).drop("hole").join(at, "raster_id")
    extent = [F.col(f"gl_{c}") for c in ("xmin", "ymin", "xmax", "ymax", "width", "height")]
    lon0 = geo.to_lonlat(extent[0], extent[1], F.col("gl_epsg"))[0]
    point = lambda xy: F.struct(xy[0].alias("x"), xy[1].alias("y"))
    j = j.withColumn("ring", F.transform("ring", lambda p: point(geo.to_map(p["x"], p["y"], *extent))))
    j = j.withColumn("gl_m", F.transform("ring", lambda p: point(geo.to_local(p["x"], p["y"], F.col("gl_epsg"), lon0))))
    m = vector.measure_rings(j)
    area = vector.ring_area(F.col("gl_m"))
    m = m.withColumns({"area_m2": area, "perim_m": vector.ring_perimeter(F.col("gl_m")), "a_diam_m": geo.equivalent_diameter(area)})
    return dense_ids(m.drop(*[c for c in m.columns if c.startswith("gl_")]), ["raster_id", "ymax", "xmin", "ymin", "xmax", "area_m2", "cx", "cy"])


def wkt(ring: Column, digits: int | None = None) -> Column:
    """A ring as the text of a polygon, its first point repeated at the end; EMPTY without points, null for null."""
    number = lambda v: (v if digits is None else F.round(v, digits)).cast("string")
    points = F.transform(F.concat(ring, F.slice(ring, 1, 1)), lambda p: F.concat_ws(" ", number(p["x"]), number(p["y"])))
    return F.when(F.size(ring) > 0, F.concat(F.lit("POLYGON (("), F.array_join(points, ", "), F.lit("))"))).when(ring.isNotNull(), F.lit("POLYGON EMPTY"))
