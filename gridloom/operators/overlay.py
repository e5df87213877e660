"""Planar overlay of rings: dissolving overlapping ones, and repairing those that cross themselves.

Coordinates are snapped to a grid of ``quantum`` units and are whole numbers from then on, so that every
decision is exact. Segments are split where they cross, until none does any more; equal segments become
one with the sum of their directions. How often the rings wind around each side of a segment decides
whether it is a border: for a union, where one side is inside of some ring and the other of none.

``dissolve`` works in the cells of a grid, so a patch of touching rings may be as large as the table.
Vertices are even numbers and cell borders odd ones: no vertex lies on a border. What a cell needs to know
of the others is one number, the winding at its lower left corner, a running sum along its row of cells
over the segments that meet the cells' lower borders. Borders become paths in their cell and rings by
pointer doubling, as for rasters (see ``rings``).
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gridloom.functions.shared import settle
from gridloom.operators import rings, vector

#: Map units of a step of the snapping grid.
QUANTUM = 1e-6
#: Segments of a cell that are compared in pairs, and the smallest cell (in steps).
CROWD, LEAST_CELL = 1500, 64
#: Rings of a place that others are looked for in before anything is cut.
HOLDERS = 64
#: Comparisons made at a time.
BLOCK = 1 << 21
#: Coordinates inside a cell are below this bound, so that products of differences fit 64 bits.
REACH = 1 << 29


def _turn(ax, ay, bx, by, cx, cy):
    """Above zero where c lies left of the way from a to b."""
    return (bx - ax) * (cy - ay) - (by - ay) * (cx - ax)


def _merged(a: np.ndarray, b: np.ndarray, net: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Segments upwards (rightwards where level), equal ones as one; those that cancel out are none."""
    swap = (a[:, 1] > b[:, 1]) | (a[:, 1] == b[:, 1]) & (a[:, 0] > b[:, 0])
    a, b, net = np.where(swap[:, None], b, a), np.where(swap[:, None], a, b), np.where(swap, -net, net)
    some = (a != b).any(axis=1)
    ends, at = np.unique(np.hstack((a, b))[some], axis=0, return_inverse=True)
    total = np.zeros(len(ends), dtype=np.int64)
    np.add.at(total, at.ravel(), net[some])
    ends, total = ends[total != 0], total[total != 0]
    return ends[:, :2], ends[:, 2:], total


def _pairs(a: np.ndarray, b: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of segments whose boxes meet, in blocks."""
    lo, hi = np.minimum(a, b), np.maximum(a, b)
    rows = max(1, BLOCK // max(1, len(a)))
    for k in range(0, len(a), rows):
        i = slice(k, k + rows)
        meet = (lo[i, None, 0] <= hi[None, :, 0]) & (hi[i, None, 0] >= lo[None, :, 0]) & (lo[i, None, 1] <= hi[None, :, 1]) & (hi[i, None, 1] >= lo[None, :, 1])
        p, q = np.nonzero(meet)
        keep = p + k < q
        yield p[keep] + k, q[keep]


def node(a: np.ndarray, b: np.ndarray, net: np.ndarray, low: int | None = None, high: tuple[int, int] | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Segments a - b (n x 2 even numbers) split where they cross or touch, merged; crossings stay between low and high."""
    a, b, net = _merged(a, b, net)
    while True:
        own, at = [], []  # segments to be split, and where
        for i, j in _pairs(a, b):
            p, q, r, s = a[i], b[i], a[j], b[j]
            o1, o2 = _turn(*p.T, *q.T, *r.T), _turn(*p.T, *q.T, *s.T)
            o3, o4 = _turn(*r.T, *s.T, *p.T), _turn(*r.T, *s.T, *q.T)
            cross = (np.sign(o1) * np.sign(o2) < 0) & (np.sign(o3) * np.sign(o4) < 0)
            if cross.any():
                t = (o3[cross] / (o3 - o4)[cross])[:, None]
                x = 2 * np.rint((p[cross] + t * (q - p)[cross]) / 2).astype(np.int64)
                if high is not None:
                    x = np.clip(x, low + 1, np.array(high) - 1)
                own += [i[cross], j[cross]]
                at += [x, x]
            for o, seg, v, c, d in ((o1, i, r, p, q), (o2, i, s, p, q), (o3, j, p, r, s), (o4, j, q, r, s)):
                on = (o == 0) & (v >= np.minimum(c, d)).all(axis=1) & (v <= np.maximum(c, d)).all(axis=1) & (v != c).any(axis=1) & (v != d).any(axis=1)
                if on.any():
                    own.append(seg[on])
                    at.append(v[on])
        if not own:
            return a, b, net
        own, at = np.concatenate(own), np.concatenate(at)
        inner = (at != a[own]).any(axis=1) & (at != b[own]).any(axis=1)
        own, at = own[inner], at[inner]
        whole = np.setdiff1d(np.arange(len(a)), own)
        far = ((at - a[own]) * (b - a)[own]).sum(axis=1)
        order = np.lexsort((far, own))
        own, at = own[order], at[order]
        first = np.concatenate(([True], own[1:] != own[:-1]))
        last = np.concatenate((first[1:], [True]))
        start = np.where(first[:, None], a[own], np.roll(at, 1, axis=0))
        a, b, net = _merged(np.concatenate((a[whole], start, at[last])), np.concatenate((b[whole], at, b[own[last]])), np.concatenate((net[whole], net[own], net[own[last]])))


def windings(a: np.ndarray, b: np.ndarray, net: np.ndarray, corner: int = 0, border: int | None = None) -> np.ndarray:
    """How often rings wind around the left side of each segment of node().

    corner is the winding just inside the lower left corner, border the x of the left border.
    """
    mid, out = a + b, np.full(len(a), corner, dtype=np.int64)
    rows = max(1, BLOCK // max(1, len(a)))
    for k in range(0, len(a), rows):
        m = mid[k : k + rows]
        beside = (2 * a[None, :, 1] <= m[:, None, 1]) & (m[:, None, 1] < 2 * b[None, :, 1])
        left = beside & (_turn(2 * a[None, :, 0], 2 * a[None, :, 1], 2 * b[None, :, 0], 2 * b[None, :, 1], m[:, None, 0], m[:, None, 1]) < 0)
        out[k : k + rows] -= (left * net[None, :]).sum(axis=1)
        if border is not None:
            for end, sign in ((a, 1), (b, -1)):
                on = end[:, 0] == border
                out[k : k + rows] += sign * ((2 * end[None, on, 1] <= m[:, None, 1]) * net[None, on]).sum(axis=1)
    return out


def borders(a: np.ndarray, b: np.ndarray, net: np.ndarray, inside: Callable[[np.ndarray], np.ndarray], corner: int = 0, border: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of the segments between what inside(winding) says is in and out, with the inside on the left."""
    w = windings(a, b, net, corner, border)
    left, right = inside(w), inside(w - net)
    keep = left != right
    return np.where(left[keep, None], a[keep], b[keep]), np.where(left[keep, None], b[keep], a[keep])


def _chained(s: np.ndarray, e: np.ndarray, broken: Callable[[np.ndarray], np.ndarray]) -> tuple[list[tuple[list[int], bool]], np.ndarray]:
    """Paths of directed segments that end at broken corners, and the directions of all in eighths of a turn."""
    _, key = np.unique(np.concatenate((s, e)), axis=0, return_inverse=True)
    key = key.ravel()
    d = np.arctan2(e[:, 1] - s[:, 1], e[:, 0] - s[:, 0]) * (4 / math.pi)
    return rings.chain(key[: len(s)], key[len(s) :], d, broken(s), broken(e)), d


def snapped(points: np.ndarray, quantum: float) -> np.ndarray:
    return 2 * np.rint(points / quantum).astype(np.int64)


def _odd(w: np.ndarray) -> np.ndarray:
    return w % 2 == 1


def repair(points: np.ndarray) -> list[np.ndarray]:
    """The simple rings (n x 2) that a ring with crossings falls into by the even-odd rule; those around gaps run clockwise."""
    points = points[np.isfinite(points).all(axis=1)]
    if len(points) < 3:
        return []
    zero = points.min(axis=0)
    extent = float((points - zero).max())
    if not extent:
        return []
    quantum = extent / (1 << 26)
    p = snapped(points - zero, quantum)
    s, e = borders(*node(p, np.roll(p, -1, axis=0), np.ones(len(p), dtype=np.int64)), _odd)
    out = []
    for way, _ in _chained(s, e, lambda v: np.zeros(len(v), dtype=bool))[0]:
        x, y = rings.turned(*rings.turns_only(s[way, 0], s[way, 1]))
        if len(x) > 2:
            out.append(np.column_stack((x, y)) * (quantum / 2) + zero)
    return _as_given(out, points, quantum)


def _as_given(parts: list[np.ndarray], points: np.ndarray, quantum: float) -> list[np.ndarray]:
    """parts with the vertices that the input has exactly as they were."""
    known = {tuple(k): p for k, p in zip(np.rint(points / quantum).astype(np.int64).tolist(), points, strict=True)}
    near = [(0, 0), (0, 1), (1, 0), (0, -1), (-1, 0), (1, 1), (-1, -1), (1, -1), (-1, 1)]
    for part in parts:
        for i, k in enumerate(np.rint(part / quantum).astype(np.int64).tolist()):
            hit = next((known[k[0] + dx, k[1] + dy] for dx, dy in near if (k[0] + dx, k[1] + dy) in known), None)
            if hit is not None and np.abs(hit - part[i]).max() <= quantum:
                part[i] = hit
    return parts


#: Points up to which rings are looked at many at a time, and rings of one go.
SHORT, MANY = 12, 4096


def _plain(p: np.ndarray) -> np.ndarray:
    """Which of rings (n x k x 2 whole numbers) are simple without a straight angle, so that repair leaves them as they are."""
    k = p.shape[1]
    q = np.roll(p, -1, axis=1)
    turn = lambda a, b, c: _turn(a[..., 0], a[..., 1], b[..., 0], b[..., 1], c[..., 0], c[..., 1])
    fine = (turn(np.roll(p, 1, axis=1), p, q) != 0).all(axis=1)
    for i in range(k):
        for j in range(i + 2, k - (i == 0)):
            a, b, c, d = p[:, i], q[:, i], p[:, j], q[:, j]
            # sides whose boxes are apart, or one of which lies on one side of the other's line, don't meet
            apart = ((np.maximum(a, b) < np.minimum(c, d)) | (np.maximum(c, d) < np.minimum(a, b))).any(axis=1)
            apart |= np.sign(turn(a, b, c)) * np.sign(turn(a, b, d)) > 0
            apart |= np.sign(turn(c, d, a)) * np.sign(turn(c, d, b)) > 0
            fine &= apart
    return fine


def repair_many(rings_: list[np.ndarray]) -> list[list[np.ndarray]]:
    """repair() of each ring; short ones that turn out to be simple are settled many at a time."""
    out: list[list[np.ndarray] | None] = [None] * len(rings_)
    by_size: dict[int, list[int]] = {}
    cleaned: dict[int, np.ndarray] = {}
    boxes: dict[int, tuple[np.ndarray, float]] = {}
    for i, p in enumerate(rings_):
        if len(p) <= SHORT and np.isfinite(p).all():
            rest = _without_returns(p)
            if len(rest) > 2:
                cleaned[i] = rest
                boxes[i] = (p.min(axis=0), float((p - p.min(axis=0)).max()))  # snapped as repair() does
                by_size.setdefault(len(rest), []).append(i)
    for at in by_size.values():
        for k in range(0, len(at), MANY):
            some = at[k : k + MANY]
            given = np.stack([cleaned[i] for i in some])
            zero = np.stack([boxes[i][0] for i in some])[:, None]
            quantum = np.array([boxes[i][1] for i in some]) / (1 << 26)
            p = 2 * np.rint((given - zero) / quantum[:, None, None]).astype(np.int64)
            nxt = np.roll(p, -1, axis=1)
            # in halves: a difference of two products fits 64 bits
            left = (p[..., 0] * (nxt[..., 1] // 2) - (nxt[..., 0] // 2) * p[..., 1]).sum(axis=1) > 0
            for i, fine, ccw, ring, snap in zip(some, _plain(p).tolist(), left.tolist(), given, p, strict=True):
                if fine:
                    first = int(np.lexsort((snap[:, 0], snap[:, 1]))[0])
                    turned = np.roll(ring, -first, axis=0)
                    out[i] = [turned if ccw else np.roll(turned[::-1], 1, axis=0)]
    return [repair(p) if o is None else o for o, p in zip(out, rings_, strict=True)]


def _without_returns(p: np.ndarray) -> np.ndarray:
    """A ring without doubled points and spikes to a point and straight back; nothing else is left out."""
    way: list[tuple[float, float]] = []
    for v in map(tuple, p.tolist()):
        if way and v == way[-1]:
            continue
        if len(way) > 1 and v == way[-2]:
            way.pop()
            continue
        way.append(v)
    while len(way) > 1 and way[0] == way[-1]:
        way.pop()
    return np.array(way).reshape(-1, 2)


def _repair(xs: pd.Series, ys: pd.Series) -> pd.Series:
    known = [k for k, x in enumerate(xs) if x is not None]
    out: list[list[np.ndarray] | None] = [None] * len(xs)
    for k, parts in zip(known, repair_many([np.column_stack((xs.iloc[k], ys.iloc[k])).astype(np.float64) for k in known]), strict=True):
        out[k] = [p.ravel() for p in parts]
    return pd.Series(out, dtype=object)


def repair_parts(ring: Column, single_only: bool = False) -> Column:
    """The simple rings that a ring falls into, an array: outer ones counterclockwise, gaps clockwise.

    Doubled points, spikes and lines that the ring goes back on vanish; a ring without area has no part,
    null stays null, and points with a null or non-finite coordinate are left out. With single_only rings
    that fall into several outer parts are dropped altogether (no part), as some tools do with what
    isn't one polygon after repair; parts of a collection that is one polygon and lines are kept.
    """
    some = F.filter(ring, lambda p: p["x"].isNotNull() & p["y"].isNotNull())
    flat = F.pandas_udf(_repair, "array<array<double>>").asNondeterministic()(F.transform(some, lambda p: p["x"]), F.transform(some, lambda p: p["y"]))
    point = lambda r, i: F.struct(F.element_at(r, 2 * i + 1).alias("x"), F.element_at(r, 2 * i + 2).alias("y"))
    parts = F.transform(flat, lambda r: F.transform(F.sequence(F.lit(0), (F.size(r) / 2).cast("int") - 1), lambda i: point(r, i)))
    return single_parts(parts) if single_only else parts


def single_parts(parts: Column) -> Column:
    """repair_parts() of single_only, from the parts of a ring that has been repaired."""
    outer = F.size(F.filter(parts, lambda r: vector.ring_signed_area(r) > 0))
    return F.when(outer > 1, F.array().cast(f"array<{vector.POINTS}>")).otherwise(parts)


# --- dissolve ----------------------------------------------------------------------------------

SEGMENTS = "raster_id long, r long, c long, ax long, ay long, bx long, by long"


def _holder(p: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray | None] | None:
    """Lower and upper corner of a convex ring (n x 2 even numbers) and the ring from the lower one on, None where it is its box; None for other rings."""
    lo, hi = p.min(axis=0), p.max(axis=0)
    p = p[(p != np.roll(p, 1, axis=0)).any(axis=1)] - lo
    if len(p) < 3 or (hi - lo).max() >= REACH:
        return None
    if vector.signed_area(p.astype(np.float64)) < 0:
        p = p[::-1]
    d = np.roll(p, -1, axis=0) - p
    e = np.roll(d, -1, axis=0)
    turn, along = d[:, 0] * e[:, 1] - d[:, 1] * e[:, 0], (d * e).sum(axis=1)
    once = np.arctan2(turn, along).sum() < 3 * math.pi  # a star goes around twice
    if not once or not ((turn > 0) | (turn == 0) & (along > 0)).all():
        return None
    return lo, hi, None if len(p) == 4 and (d == 0).any(axis=1).all() else p


def _covered(holder: tuple[np.ndarray, np.ndarray, np.ndarray | None], some: np.ndarray, points: np.ndarray, start: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Which of some rings (numbers; the points of k are those from start[k] to start[k + 1]) lie in a holder."""
    lo, hi, p = holder
    out = (low[some] >= lo).all(axis=1) & (high[some] <= hi).all(axis=1)
    if p is None or not out.any():
        return out
    at = some[out]
    size = start[at + 1] - start[at]
    first = np.cumsum(size) - size
    v = (points[np.repeat(start[at] - first, size) + np.arange(size.sum())] - lo).T
    inside = np.ones(v.shape[1], dtype=bool)
    for a, b in zip(p, np.roll(p, -1, axis=0), strict=True):
        inside &= _turn(*a, *b, *v) >= 0
    out[out] = np.logical_and.reduceat(inside, first)
    return out


def _outermost(features: DataFrame, side: float, quantum: float) -> DataFrame:
    """features (raster_id, xs, ys) without rings that lie in a convex one: their union is the same, and where rings lie dense few are left.

    Rings are sorted by the cell (of this side) of their box's lower corner and by size, and go by in this
    order; each is looked for in up to HOLDERS of those that went by in its cell. So a task holds no more
    than these, however many rings there are, and rings in none of them stay, whatever else they lie in.
    """
    lo = [F.array_min(c) for c in ("xs", "ys")]
    size = (F.array_max("xs") - lo[0]) * (F.array_max("ys") - lo[1])
    order = ["raster_id", "gl_r", "gl_c", F.desc("gl_size")]
    placed = features.withColumns({"gl_r": F.floor(lo[1] / side), "gl_c": F.floor(lo[0] / side), "gl_size": size})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, holders = None, []
        for batch in batches:
            if not batch.num_rows:
                continue
            raster, xs, ys, *place = batch.columns
            points = snapped(np.column_stack([v.flatten().to_numpy(zero_copy_only=False) for v in (xs, ys)]), quantum)
            start = np.concatenate(([0], np.cumsum(pc.list_value_length(xs).to_numpy())))
            low, high = np.minimum.reduceat(points, start[:-1]), np.maximum.reduceat(points, start[:-1])
            key = np.column_stack([v.to_numpy() for v in (raster, *place)])
            begins = np.flatnonzero(np.concatenate(([True], (key[1:] != key[:-1]).any(axis=1))))
            keep = np.ones(len(key), dtype=bool)
            for a, z in zip(begins.tolist(), [*begins[1:].tolist(), len(key)], strict=True):
                if cell != (cell := tuple(key[a].tolist())):
                    holders = []
                some, k = np.arange(a, z), 0
                while len(some) and (k < len(holders) or k < HOLDERS and len(some) > 1):
                    if k == len(holders):
                        own, some = some[0], some[1:]
                        if (holder := _holder(points[start[own] : start[own + 1]])) is None:
                            continue
                        holders.append(holder)
                    gone = _covered(holders[k], some, points, start, low, high)
                    keep[some[gone]] = False
                    some, k = some[~gone], k + 1
            yield pa.RecordBatch.from_arrays([raster, xs, ys], names=["raster_id", "xs", "ys"]).filter(pa.array(keep))

    sorted_ = placed.repartitionByRange(*order).sortWithinPartitions(*order)
    return sorted_.select("raster_id", "xs", "ys", "gl_r", "gl_c").mapInArrow(run, features.select("raster_id", "xs", "ys").schema)


def _cut(p: np.ndarray, q: np.ndarray, cell: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A segment's pieces in the cells it passes: row and column of the cell, start, end; the same both ways."""
    if (p[1], p[0]) > (q[1], q[0]):
        rows, s, e = _cut(q, p, cell)
        return rows[::-1], e[::-1], s[::-1]
    line = lambda v: (v - 1) // cell  # noqa: E731  the cell that a coordinate is in; borders are odd
    ts, where = [], []
    for k in (0, 1):
        i, j = sorted((line(p[k]), line(q[k])))
        at = np.arange(i + 1, j + 1) * cell + 1
        ts.append((at - p[k]) / float(q[k] - p[k]) if len(at) else np.zeros(0))
        where += [(k, v) for v in at.tolist()]
    t = np.concatenate(ts)
    order = np.lexsort(([k for k, _ in where], t))
    here = [line(p[1]), line(p[0])]
    rows, ends = [list(here)], []
    for n in order.tolist():
        k, v = where[n]
        o = 1 - k
        low = here[1 - o] * cell + 1  # the other coordinate stays in its row or column of cells
        met = 2 * round((p[o] + t[n] * (q[o] - p[o])) / 2)
        point = [0, 0]
        point[k], point[o] = v, min(max(met, low + 1), low + cell - 1)
        ends.append(point)
        here[1 - k] += 1 if q[k] > p[k] else -1
        rows.append(list(here))
    points = np.array([p.tolist(), *ends, q.tolist()], dtype=np.int64)
    return np.array(rows, dtype=np.int64), points[:-1], points[1:]


def _segments(features: DataFrame, cell: int, quantum: float) -> DataFrame:
    """SEGMENTS of the rings of features (raster_id, xs, ys), counterclockwise, cut at the borders of cells."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list[np.ndarray]] = [[], [], [], []]
            for raster, x, y in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2), strict=True):
                p = snapped(np.column_stack((x.values.to_numpy(zero_copy_only=False), y.values.to_numpy(zero_copy_only=False))), quantum)
                p = p[(p != np.roll(p, 1, axis=0)).any(axis=1)]
                if len(p) < 3:
                    continue
                if vector.signed_area(p.astype(np.float64)) < 0:
                    p = p[::-1]
                q = np.roll(p, -1, axis=0)
                at, to = (p - 1) // cell, (q - 1) // cell
                one = (at == to).all(axis=1)
                pieces = [(at[one][:, ::-1], p[one], q[one]), *(_cut(p[k], q[k], cell) for k in np.flatnonzero(~one))]
                for piece in pieces:
                    for held, v in zip(out, (np.full(len(piece[0]), raster), *piece), strict=True):
                        held.append(v)
            if out[0]:
                raster, rc, s, e = (np.concatenate(v) for v in out)
                yield pa.RecordBatch.from_arrays([pa.array(v) for v in (raster, *rc.T, *s.T, *e.T)], names=[f.split()[0] for f in SEGMENTS.split(", ")])

    each = features.mapInArrow(run, SEGMENTS)
    up = F.struct("ay", "ax") < F.struct("by", "bx")
    ways = {n: F.when(up, F.col(n)).otherwise(F.col(m)) for n, m in (("ax", "bx"), ("ay", "by"), ("bx", "ax"), ("by", "ay"))}
    merged = each.select("raster_id", "r", "c", *[v.alias(n) for n, v in ways.items()], F.when(up, 1).otherwise(-1).alias("net"))
    return merged.groupBy("raster_id", "r", "c", "ax", "ay", "bx", "by").agg(F.sum("net").alias("net")).filter("net <> 0")


def _corners(segments: DataFrame, cell: int) -> DataFrame:
    """raster_id, r, c, corner: the winding just inside the lower left corner of each cell that has segments."""
    floor = F.col("r") * cell + 1
    gain = F.when(F.col("ay") == floor, -F.col("net")).otherwise(0) + F.when(F.col("by") == floor, F.col("net")).otherwise(0)
    per_cell = segments.groupBy("raster_id", "r", "c").agg(F.sum(gain).alias("gain"))
    before = Window.partitionBy("raster_id", "r").orderBy("c").rowsBetween(Window.unboundedPreceding, -1)
    return per_cell.select("raster_id", "r", "c", F.coalesce(F.sum("gain").over(before), F.lit(0)).cast("long").alias("corner"))


def _cell_paths(cell: int):
    def one(table: pa.Table) -> pa.Table:
        c = {n: table.column(n).to_numpy() for n in ("raster_id", "r", "c", "ax", "ay", "bx", "by", "net", "corner")}
        zero = np.array([c["c"][0], c["r"][0]]) * cell + 1  # the lower left corner, an odd number
        shift = zero - 1  # stays even
        a, b = np.column_stack((c["ax"], c["ay"])) - shift, np.column_stack((c["bx"], c["by"])) - shift
        s, e = borders(*node(a, b, c["net"], 1, (1 + cell, 1 + cell)), lambda w: w > 0, int(c["corner"][0]), 1)
        ways, d = _chained(s, e, lambda v: (v % 2 == 1).any(axis=1)) if len(s) else ([], np.zeros(0))
        out: dict[str, list] = {f.split()[0]: [] for f in rings.PATHS.split(", ")}
        for way, closed in ways:
            x, y = s[way, 0] + shift[0], s[way, 1] + shift[1]
            z = e[way[-1]] + shift
            row = (int(c["raster_id"][0]), closed, x, y, y[0], x[0], d[way[0]], z[1], z[0], d[way[-1]])
            for name, v in zip(out, row, strict=True):
                out[name].append(v)
        return pa.table({n: pa.array(v, type=rings.KINDS[n]) for n, v in out.items()})

    return one


def dissolve(features: DataFrame, quantum: float = QUANTUM, cell: float | None = None, crowd: int = CROWD) -> DataFrame:
    """raster_id, ring, holes, area of the parts that overlapping or touching rings unite to, by raster_id.

    features: raster_id, ring (simple; repair_parts() makes others so). Rings that touch along a side are
    united, those that touch in a point are not. Outer rings run counterclockwise, gaps (an array of
    rings) clockwise, from the lowest point on. Vertices are snapped to quantum, and a crossing lies
    within a few quanta of where it is; parts and gaps that are no wider than that are left out. Equal rings count once; null rings, those of fewer than three points
    or with a null or non-finite coordinate are left out; a null raster_id is a group of its own.

    cell is the side of a grid cell in map units; by default it starts at the mean side of the rings' boxes
    and is halved until no cell has over crowd segments, all in one cell's size: rings much longer than
    that are cut into as many pieces as they cross cells. Rings inside of another are left out before that.
    """
    spark = features.sparkSession
    xs, ys = F.transform("ring", lambda p: p["x"].cast("double")), F.transform("ring", lambda p: p["y"].cast("double"))
    bad = lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))
    key = F.coalesce(F.col("raster_id").cast("long"), F.lit(-(1 << 63)))
    f = features.select(key.alias("raster_id"), xs.alias("xs"), ys.alias("ys")).filter((F.size("xs") > 2) & ~F.exists("xs", bad) & ~F.exists("ys", bad))
    f = settle(f.distinct(), "dissolve")
    side = F.greatest(F.array_max("xs") - F.array_min("xs"), F.array_max("ys") - F.array_min("ys"))
    step = quantum / 2
    mean = f.agg(F.avg(side)).first()[0] or 1.0
    f = settle(_outermost(f, mean, quantum), "dissolve-outermost")
    size = 2 * int(max(LEAST_CELL, min(REACH, (cell if cell is not None else mean) / step)) / 2)
    while True:
        segments = settle(_segments(f, size, quantum), "dissolve-segments")
        most = segments.groupBy("raster_id", "r", "c").count().agg(F.max("count")).first()[0] or 0
        if most <= crowd or size // 2 < LEAST_CELL:
            break
        size = 2 * (size // 4)
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = segments.join(_corners(segments, size), ["raster_id", "r", "c"]).repartition(tasks, "raster_id", "r", "c")  # few bytes, much work
    paths = settle(rows.groupBy("raster_id", "r", "c").applyInArrow(_cell_paths(size), rings.PATHS), "dissolve-paths")
    found = rings.join_all(paths)
    p = F.zip_with("xs", "ys", lambda x, y: F.struct((x * step).alias("x"), (y * step).alias("y")))
    found = found.select("raster_id", p.alias("ring")).withColumn("area", vector.ring_signed_area(F.col("ring")))
    thin = F.abs("area") <= 2 * quantum * vector.ring_perimeter(F.col("ring"))
    out = with_holes(settle(found.filter(~thin), "dissolve-rings"))
    return out.withColumn("raster_id", F.when(F.col("raster_id") != -(1 << 63), F.col("raster_id")))


def with_holes(found: DataFrame) -> DataFrame:
    """raster_id, ring, holes, area of outer rings (area above zero) with the gaps (below) that lie in them.

    An outer ring names the cells that its box touches on the level where cells are at least as large, a
    gap its cell on every level that occurs, so they meet in an equi-join; of the rings around a gap
    the smallest has it. Rings never cross, so the middle of a side tells which is around which.
    """
    r = found.withColumn("id", F.monotonically_increasing_id()).withColumns(dict(zip(("xmin", "ymin", "xmax", "ymax"), vector.envelope(F.col("ring")), strict=True)))
    r = settle(r, "dissolve-found")
    outer, gaps = r.filter("area > 0"), r.filter("area < 0")
    level = F.ceil(F.log2(F.greatest(F.col("xmax") - F.col("xmin"), F.col("ymax") - F.col("ymin")))).cast("int")
    known = [x[0] for x in outer.select(level.alias("k")).distinct().collect()]  # a few dozen powers of two
    place = lambda v, k: F.floor(v / F.pow(F.lit(2.0), k)).cast("long")
    lo, hi = outer.withColumn("k", level), F.col("k")
    named = lo.withColumn("cx", F.explode(F.sequence(place(F.col("xmin"), hi), place(F.col("xmax"), hi)))).withColumn("cy", F.explode(F.sequence(place(F.col("ymin"), hi), place(F.col("ymax"), hi))))
    named = named.select("raster_id", "k", "cx", "cy", F.col("id").alias("outer"), F.col("ring").alias("around"), F.col("area").alias("size"), *[F.col(c).alias(f"o_{c}") for c in ("xmin", "ymin", "xmax", "ymax")])
    a, b = F.col("ring")[0], F.col("ring")[1]
    g = gaps.withColumns({"px": (a["x"] + b["x"]) / 2, "py": (a["y"] + b["y"]) / 2}).withColumn("k", F.explode(F.array(*[F.lit(k) for k in known]).cast("array<int>")))
    g = g.withColumns({"cx": place(F.col("px"), hi), "cy": place(F.col("py"), hi)})
    j = g.join(named, ["raster_id", "k", "cx", "cy"]).filter("px >= o_xmin and px <= o_xmax and py >= o_ymin and py <= o_ymax and size > -area")
    crossed = lambda s: (s["0"]["y"] <= F.col("py")) != (s["1"]["y"] <= F.col("py"))
    right = lambda s: s["0"]["x"] + (F.col("py") - s["0"]["y"]) / (s["1"]["y"] - s["0"]["y"]) * (s["1"]["x"] - s["0"]["x"]) > F.col("px")
    inside = F.size(F.filter(vector.ring_steps(F.col("around")), lambda s: F.when(crossed(s), right(s)).otherwise(F.lit(False)))) % 2 == 1
    owner = j.filter(inside).groupBy("id").agg(F.min_by("outer", "size").alias("outer"))
    held = gaps.join(owner, "id").groupBy("outer").agg(F.array_sort(F.collect_list("ring")).alias("holes"), F.sum("area").alias("gone"))
    out = outer.join(held.withColumnRenamed("outer", "id"), "id", "left")
    return out.select("raster_id", "ring", F.coalesce("holes", F.array().cast(f"array<{vector.POINTS}>")).alias("holes"), (F.col("area") + F.coalesce("gone", F.lit(0.0))).alias("area"))
