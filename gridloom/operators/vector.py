"""Operators on boxes (xmin, ymin, xmax, ymax) and rings (arrays of points)."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.functions.geo import equivalent_diameter, reproject

CLASS = "Tree"


def filter_by_area(features: DataFrame, limit: float, area: str = "area_m2") -> DataFrame:
    """Features of at most limit; a filter on a column of the source reaches its scan."""
    return features.filter(F.col(area) <= limit)


def ring_of_box(xmin: Column, ymin: Column, xmax: Column, ymax: Column) -> Column:
    p = lambda x, y: F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))
    return F.array(p(xmin, ymin), p(xmax, ymin), p(xmax, ymax), p(xmin, ymax))


def _sum(steps: Column, f) -> Column:
    return F.aggregate(F.transform(steps, f), F.lit(0.0), lambda a, x: a + x)


def _cross(s: Column) -> Column:
    return s["0"]["x"] * s["1"]["y"] - s["1"]["x"] * s["0"]["y"]


def _once(value: Column, f) -> Column:
    """f(value), with value worked out once however often f names it."""
    return F.element_at(F.transform(F.array(value), lambda v: f(v)), 1)


def ring_steps(ring: Column) -> Column:
    """Each point of a ring with its successor, the last with the first."""
    following = F.concat(F.slice(ring, 2, F.greatest(F.lit(0), F.size(ring) - 1)), F.slice(ring, 1, 1))
    return F.zip_with(ring, following, lambda p, q: F.struct(p.alias("0"), q.alias("1")))


def ring_signed_area(ring: Column) -> Column:
    """Above zero where a ring runs counterclockwise with y up."""
    return _sum(ring_steps(ring), _cross) / 2


def ring_area(ring: Column) -> Column:
    return F.abs(ring_signed_area(ring))


def ring_perimeter(ring: Column) -> Column:
    return _sum(ring_steps(ring), lambda s: F.sqrt((s["1"]["x"] - s["0"]["x"]) * (s["1"]["x"] - s["0"]["x"]) + (s["1"]["y"] - s["0"]["y"]) * (s["1"]["y"] - s["0"]["y"])))


def ring_centroid(ring: Column) -> tuple[Column, Column]:
    """Area-weighted centroid; null for a ring without area."""
    twice = _sum(ring_steps(ring), _cross)
    of = lambda a: F.try_divide(_sum(ring_steps(ring), lambda s: (s["0"][a] + s["1"][a]) * _cross(s)), 3 * twice)
    return of("x"), of("y")


def envelope(ring: Column) -> list[Column]:
    xs, ys = F.transform(ring, lambda p: p["x"]), F.transform(ring, lambda p: p["y"])
    return [F.array_min(xs), F.array_min(ys), F.array_max(xs), F.array_max(ys)]


def measure_rings(features: DataFrame, ring: str = "ring") -> DataFrame:
    """features with class, label, area_m2, perim_m, a_diam_m, envelope and centroid of a ring column."""
    r = F.col(ring)
    cx, cy = ring_centroid(r)
    box = dict(zip(("xmin", "ymin", "xmax", "ymax"), envelope(r), strict=True))
    out = features.withColumns({"class": F.lit(CLASS), "label": F.lit(CLASS), "area_m2": ring_area(r), "perim_m": ring_perimeter(r), "cx": cx, "cy": cy, **box})
    return out.withColumn("a_diam_m", equivalent_diameter(F.col("area_m2")))


def measure_boxes(boxes: DataFrame) -> DataFrame:
    """Detector boxes with class, label, area_m2, a_diam_m and centroid, without a perimeter."""
    w, h = F.abs(F.col("xmax") - F.col("xmin")), F.abs(F.col("ymax") - F.col("ymin"))
    out = boxes.withColumns({"class": F.lit(CLASS), "label": F.lit(CLASS), "area_m2": w * h, "cx": (F.col("xmin") + F.col("xmax")) / 2, "cy": (F.col("ymin") + F.col("ymax")) / 2})
    return out.withColumn("a_diam_m", equivalent_diameter(F.col("area_m2")))


def total_bounds(df: DataFrame, x: str = "x", y: str = "y") -> DataFrame:
    return df.agg(F.min(x).alias("xmin"), F.min(y).alias("ymin"), F.max(x).alias("xmax"), F.max(y).alias("ymax"))


def clip_ring(ring: Column, xmin: Column, ymin: Column, xmax: Column, ymax: Column) -> Column:
    """A convex ring clipped to a rectangle, side by side; an empty ring where they don't meet.

    Column expressions only, and right for convex rings only: clip_parts() takes any simple ring.
    """
    point = lambda x, y: F.struct(x.alias("x"), y.alias("y"))

    def side(r: Column, axis: str, bound: Column, keep_above: bool) -> Column:
        other = "y" if axis == "x" else "x"
        inside = (lambda p: p[axis] >= bound) if keep_above else (lambda p: p[axis] <= bound)

        def cut(s: Column) -> Column:
            p, q = s["0"], s["1"]
            t = (bound - p[axis]) / (q[axis] - p[axis])
            o = p[other] + t * (q[other] - p[other])
            met = point(bound, o) if axis == "x" else point(o, bound)
            keep = F.when(inside(p), F.array(point(p["x"], p["y"]))).otherwise(F.array().cast("array<struct<x:double,y:double>>"))
            return F.when(inside(p) != inside(q), F.concat(keep, F.array(met))).otherwise(keep)

        return F.flatten(F.transform(ring_steps(r), cut))

    for axis, bound, above in (("x", xmin, True), ("x", xmax, False), ("y", ymin, True), ("y", ymax, False)):
        ring = _once(ring, lambda r, a=axis, b=bound, k=above: side(r, a, b, k))
    return ring


def reproject_ring(ring: Column, source: Column | int, target: Column | int) -> Column:
    """Every point of a ring in another coordinate system."""

    def moved(p: Column) -> Column:
        x, y = reproject(p["x"], p["y"], source, target)
        return F.struct(x.alias("x"), y.alias("y"))

    return F.transform(ring, moved)


#: Pieces of at most this area are none.
LEAST_PIECE = 1e-12


def signed_area(ring: np.ndarray) -> float:
    p = ring - ring[0]  # near the origin, so that large coordinates lose nothing
    q = np.roll(p, -1, axis=0)
    return float((p[:, 0] * q[:, 1] - q[:, 0] * p[:, 1]).sum() / 2)


def half_plane(ring: np.ndarray, axis: int, bound: float, sign: int) -> list[np.ndarray]:
    """The parts of a simple ring (n x 2) on one side of a line; points on the line are inside.

    The ring falls into chains inside. Along the line, the places where chains begin and end lie in
    pairs with the ring's inner side between them, and each pair closes an end to a beginning.
    """
    inside = sign * (ring[:, axis] - bound) >= 0
    if inside.all():
        return [ring]
    if not inside.any():
        return []
    n, other = len(ring), 1 - axis

    def cut(i: int, j: int) -> np.ndarray:
        p, q = ring[i], ring[j]
        met = np.empty(2)
        met[axis], met[other] = bound, p[other] + (bound - p[axis]) / (q[axis] - p[axis]) * (q[other] - p[other])
        return met

    chains = []
    for i in np.flatnonzero(~inside & np.roll(inside, -1)):
        chain, j = [cut(i, (i + 1) % n)], (i + 1) % n
        while inside[j]:
            chain.append(ring[j])
            j = (j + 1) % n
        chains.append(np.array([*chain, cut((j - 1) % n, j)]))
    ends = sorted((c[k][other], k, i) for i, c in enumerate(chains) for k in (0, -1))
    begins = {}
    while ends:
        _, k, i = ends.pop(0)
        at = next(a for a, e in enumerate(ends) if e[1] != k)  # the next one, unless equal places are in disorder
        _, _, j = ends.pop(at)
        begins[j if k == 0 else i] = i if k == 0 else j
    out = []
    while begins:
        first, now = next(iter(begins.items()))
        del begins[first]
        part = [chains[first]]
        while now != first:
            part.append(chains[now])
            now = begins.pop(now)
        out.append(np.concatenate(part))
    return out


def clip(ring: np.ndarray, xmin: float, ymin: float, xmax: float, ymax: float) -> list[np.ndarray]:
    """The parts of any simple ring, concave ones included, in a rectangle; those without area are left out."""
    parts = [ring]
    for axis, bound, sign in ((0, xmin, 1), (0, xmax, -1), (1, ymin, 1), (1, ymax, -1)):
        parts = [p for r in parts for p in half_plane(r, axis, bound, sign)]
    return [p for p in parts if abs(signed_area(p)) > LEAST_PIECE]


POINTS = "array<struct<x:double,y:double>>"


def _half_planes(points: np.ndarray, starts: np.ndarray, axis: int, bound: np.ndarray, sign: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """half_plane() of many rings at once: points, where the parts start (and the end), the ring of each part, rings to be done one by one.

    Ring k is points[starts[k]:starts[k + 1]], none is empty; bound has a number for each.
    """
    n, size, other = len(starts) - 1, np.diff(starts), 1 - axis
    ring = np.repeat(np.arange(n), size)
    after = np.arange(1, len(points) + 1)
    after[starts[1:] - 1] = starts[:-1]
    line = bound[ring]
    inside = sign * (points[:, axis] - line) >= 0
    cut = inside != inside[after]
    crossed = np.bincount(ring, cut, n) > 0
    # what goes on: points inside, and behind a point the place where the line is met
    count = inside.astype(np.int64) + cut
    place = np.cumsum(count) - count
    total = int(count.sum())
    out, of, begin, end = np.empty((total, 2)), np.repeat(ring, count), np.zeros(total, dtype=bool), np.zeros(total, dtype=bool)
    out[place[inside]] = points[inside]
    at = np.flatnonzero(cut)
    p, q = points[at], points[after[at]]
    met = place[at] + inside[at]
    out[met, axis] = line[at]
    out[met, other] = p[:, other] + (line[at] - p[:, axis]) / (q[:, axis] - p[:, axis]) * (q[:, other] - p[:, other])
    begin[met], end[met] = ~inside[at], inside[at]
    first = np.ones(total, dtype=bool)
    first[1:] = of[1:] != of[:-1]
    opens = begin | (first & ~crossed[of])
    chain = np.cumsum(opens) - 1
    last = np.cumsum(np.bincount(of[opens], minlength=n).astype(np.int64)) - 1  # of each ring
    early = chain <= np.where(of > 0, last[of - 1], -1)  # those before the ring's first beginning close its last chain
    chain[early] = last[of[early]]
    along = np.arange(total) + np.where(early, total, 0)
    n_chains = int(opens.sum())
    owner = of[opens]
    follows = np.arange(n_chains)
    alone = np.zeros(n, dtype=bool)
    many = np.bincount(owner, minlength=n)[of] > 1
    ends = np.flatnonzero((begin | end) & many)
    if len(ends):
        ends = ends[np.lexsort((chain[ends], begin[ends], out[ends, other], of[ends]))]
        a, z = ends[::2], ends[1::2]  # along the line the inner side lies between every second end and the next
        wrong = begin[a] == begin[z]
        alone[of[a[wrong]]] = True
        a, z = np.where(begin[a], z, a)[~wrong], np.where(begin[a], a, z)[~wrong]
        follows[chain[a]] = chain[z]
    stays = alone[owner]
    follows[stays] = np.flatnonzero(stays)
    label, turn = np.arange(n_chains), np.zeros(n_chains, dtype=np.int64)
    now, walks = follows.copy(), np.flatnonzero(follows != np.arange(n_chains))
    # each chain walks around its part: its label is the smallest chain met, its turn the steps from there on
    step = 1
    while len(walks):
        lower = now[walks] < label[walks]
        label[walks[lower]] = now[walks[lower]]
        turn[walks[lower]] = step
        now[walks] = follows[now[walks]]
        step += 1
        walks = walks[now[walks] != walks]
    length = np.bincount(label, minlength=n_chains)
    turn = np.where(turn > 0, length[label] - turn, 0)
    order = np.lexsort((along, turn[chain], label[chain]))
    part = label[chain][order]
    new = np.flatnonzero(np.diff(part, prepend=-1))
    return out[order], np.append(new, total), owner[part[new]], alone


def clip_many(points: np.ndarray, starts: np.ndarray, boxes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """clip() of many rings of three points or more, each to its box (n x 4): points, where the parts start (and the end), the ring of each part.

    Rings with null points, and those whose ends along a side are in disorder, are done one by one.
    """
    n = len(starts) - 1
    alone = np.zeros(n, dtype=bool)
    whole = np.repeat(np.arange(n), np.diff(starts))
    alone[whole[~np.isfinite(points).all(axis=1)]] = True
    alone |= ~np.isfinite(boxes).all(axis=1)
    keep = ~alone[whole]
    now, of = points[keep], np.flatnonzero(~alone)
    at = np.concatenate(([0], np.cumsum(np.diff(starts)[of])))
    for axis, column, sign in ((0, 0, 1), (0, 2, -1), (1, 1, 1), (1, 3, -1)):
        now, at, ring, odd = _half_planes(now, at, axis, boxes[of, column], sign)
        alone[of[odd]] = True
        of = of[ring]
    if len(of):
        size = np.diff(at)
        near = now - np.repeat(now[at[:-1]], size, axis=0)
        after = np.arange(1, len(now) + 1)
        after[at[1:] - 1] = at[:-1]
        area = np.add.reduceat(near[:, 0] * near[after, 1] - near[after, 0] * near[:, 1], at[:-1]) / 2
        good = (np.abs(area) > LEAST_PIECE) & ~alone[of]
        now, of, at = now[np.repeat(good, size)], of[good], np.concatenate(([0], np.cumsum(size[good])))
    if alone.any():
        found = [(k, p) for k in np.flatnonzero(alone) for p in clip(points[starts[k] : starts[k + 1]], *boxes[k])]
        parts = [*(now[a:z] for a, z in zip(at, at[1:], strict=False)), *(p for _, p in found)]
        of = np.array([*of.tolist(), *(k for k, _ in found)], dtype=np.int64)
        order = np.argsort(of, kind="stable")
        now, of = np.concatenate([np.zeros((0, 2)), *(parts[i] for i in order)]), of[order]
        at = np.cumsum([0, *(len(parts[i]) for i in order)])
    return now, at, of


def _clip(xs: pa.Array, ys: pa.Array, xmin: pa.Array, ymin: pa.Array, xmax: pa.Array, ymax: pa.Array) -> pa.Array:
    size = pc.fill_null(pc.list_value_length(xs), 0).to_numpy().astype(np.int64)
    points = np.column_stack([c.flatten().to_numpy(zero_copy_only=False).astype(np.float64) for c in (xs, ys)])
    some = size > 2
    boxes = np.column_stack([c.to_numpy(zero_copy_only=False).astype(np.float64) for c in (xmin, ymin, xmax, ymax)])
    now, at, of = clip_many(points[np.repeat(some, size)], np.concatenate(([0], np.cumsum(size[some]))), boxes[some])
    rings = pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.StructArray.from_arrays([pa.array(now[:, 0]), pa.array(now[:, 1])], names=["x", "y"]))
    ends = np.concatenate(([0], np.cumsum(np.bincount(np.flatnonzero(some)[of], minlength=len(size))))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), rings, mask=pc.is_null(xs))


def clip_parts(ring: Column, xmin: Column, ymin: Column, xmax: Column, ymax: Column) -> Column:
    """The parts of a simple ring in a rectangle, an array of rings; empty where they don't meet, null for null."""
    # named nondeterministic so that no filter on the parts makes them a second time
    return F.arrow_udf(_clip, f"array<{POINTS}>").asNondeterministic()(F.transform(ring, lambda p: p["x"]), F.transform(ring, lambda p: p["y"]), xmin, ymin, xmax, ymax)


def parts_area(parts: Column) -> Column:
    return F.aggregate(parts, F.lit(0.0), lambda a, r: a + ring_area(r))
