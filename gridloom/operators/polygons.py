"""Binary rasters to measured objects, without tracing contours.

Objects are regions of dual cells: a 2 x 2 block of filled pixels is a unit square, one of three a
half triangle, and cells that share a side of two filled pixels belong together. Holes are filled
first: background that four-neighbour steps don't join to the raster's edge is inside.

Labelling runs in two phases, so a raster may be larger than a task: each tile is labelled by itself
in numpy, and labels that meet across tile borders are united by rounds of joins.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.functions import geo
from gridloom.functions.shared import components, dense_ids, settle

#: Side of a tile that one task labels.
SIDE = 256


def union(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest node of each node's component, of n nodes and links a - b."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        before = label.copy()
        np.minimum.at(label, label[a], low)
        np.minimum.at(label, label[b], low)
        label = label[label]
        if (label == before).all():
            return label


#: Nodes that are labelled in one go; a tile is never divided.
CHUNK = 100_000


def _label_tiles(tile: np.ndarray, r: np.ndarray, c: np.ndarray, right: np.ndarray, down: np.ndarray, side: int, diagonal: bool) -> np.ndarray:
    """For nodes sorted by tile, row and column the place of the first node of each one's component in its tile."""
    key = (tile * side + r % side) * side + c % side
    a, b = [], []
    low, end = (r + 1) % side != 0, (c + 1) % side != 0
    ways = [(right & end, 1), (down & low, side)]
    ways += [(low & end, side + 1), (low & (c % side != 0), side - 1)] if diagonal else []
    for at, step in ((np.flatnonzero(some), step) for some, step in ways):
        to = np.minimum(np.searchsorted(key, key[at] + step), len(key) - 1)
        there = key[to] == key[at] + step
        a.append(at[there])
        b.append(to[there])
    return union(len(key), np.concatenate(a), np.concatenate(b))


def whole_tiles(batches: Iterator[pa.RecordBatch], side: int) -> Iterator[list[np.ndarray]]:
    """The columns (raster_id, row, col, ...) of batches that are sorted by tile, whole tiles at a time."""
    held: list[list[np.ndarray]] = []
    n = 0
    for batch in batches:
        held.append([x.to_numpy(zero_copy_only=False) for x in batch.columns])
        n += batch.num_rows
        if n >= CHUNK:
            cols = [np.concatenate(x) for x in zip(*held, strict=True)]
            raster, r, c = cols[:3]
            last = (raster == raster[-1]) & (r // side == r[-1] // side) & (c // side == c[-1] // side)
            cut = int(np.argmax(last))
            if cut:
                yield [x[:cut] for x in cols]
            held, n = [[x[cut:] for x in cols]], len(r) - cut
    if n:
        yield [np.concatenate(x) for x in zip(*held, strict=True)]


def label(nodes: DataFrame, side: int = SIDE, diagonal: bool = False) -> DataFrame:
    """nodes (raster_id, row, col, bits, right, down: whether linked to that neighbour) with lrow, lcol.

    (lrow, lcol) names the component: its first node by row and column. A link to a neighbour that
    isn't a node is none; bits are carried along. With diagonal all nodes are linked to those diagonally
    below them, too.
    """
    schema = "raster_id long, row int, col int, bits int, right boolean, down boolean, lrow int, lcol int"
    names = ["raster_id", "row", "col", "bits", "right", "down"]

    def work(cols: list[np.ndarray]) -> pa.RecordBatch:
        raster, r, c, _, right, down = cols
        new = (np.diff(raster) != 0) | (np.diff(r // side) != 0) | (np.diff(c // side) != 0)
        first = _label_tiles(np.concatenate(([0], np.cumsum(new))), r, c, right, down, side, diagonal)
        return pa.RecordBatch.from_arrays([pa.array(x) for x in (*cols, r[first], c[first])], names=[*names, "lrow", "lcol"])

    def run(batches):
        for cols in whole_tiles(batches, side):
            yield work(cols)

    keyed = nodes.select(F.col("raster_id").cast("long").alias("raster_id"), "row", "col", "bits", "right", "down")
    tile = ["raster_id", F.floor(F.col("row") / side), F.floor(F.col("col") / side)]
    local = settle(keyed.repartition(*tile).sortWithinPartitions(*tile, "row", "col").mapInArrow(run, schema), "local-labels")
    me = F.struct("raster_id", "lrow", "lcol")
    ends = local.filter(F.col("right") & ((F.col("col") + 1) % side == 0)).select(me.alias("a"), "raster_id", "row", (F.col("col") + 1).alias("col"))
    ends = ends.unionByName(local.filter(F.col("down") & ((F.col("row") + 1) % side == 0)).select(me.alias("a"), "raster_id", (F.col("row") + 1).alias("row"), "col"))
    on_edge = (F.col("row") % side == 0) | (F.col("col") % side == 0)
    if diagonal:
        for step in (1, -1):
            beyond = ((F.col("row") + 1) % side == 0) | ((F.col("col") + int(step > 0)) % side == 0)
            ends = ends.unionByName(local.filter(beyond).select(me.alias("a"), "raster_id", (F.col("row") + 1).alias("row"), (F.col("col") + step).alias("col")))
        on_edge |= (F.col("col") + 1) % side == 0
    if ends.isEmpty():
        return local
    edge = local.filter(on_edge).select("raster_id", "row", "col", me.alias("b"))
    links = ends.join(edge, ["raster_id", "row", "col"]).select("a", "b")
    merged = components(links).select(F.col("node.raster_id").alias("raster_id"), F.col("node.lrow").alias("lrow"), F.col("node.lcol").alias("lcol"), F.col("label.lrow").alias("mrow"), F.col("label.lcol").alias("mcol"))
    out = local.join(merged, ["raster_id", "lrow", "lcol"], "left")
    return out.withColumns({"lrow": F.coalesce("mrow", "lrow"), "lcol": F.coalesce("mcol", "lcol")}).drop("mrow", "mcol")


def _linked(px: DataFrame) -> DataFrame:
    """px (raster_id, row, col) as nodes that are linked to all neighbours there are."""
    return px.select("raster_id", "row", "col", F.lit(0).alias("bits"), F.lit(True).alias("right"), F.lit(True).alias("down"))


def fill_holes(px: DataFrame, side: int = SIDE) -> DataFrame:
    """The set pixels and those of holes, of a dense px (raster_id, row, col, on)."""
    labelled = label(_linked(px.filter(~F.col("on"))), side)
    edge = px.groupBy(F.col("raster_id").cast("long").alias("raster_id")).agg(F.min("row").alias("r0"), F.max("row").alias("r1"), F.min("col").alias("c0"), F.max("col").alias("c1"))
    on_edge = (F.col("row") == F.col("r0")) | (F.col("row") == F.col("r1")) | (F.col("col") == F.col("c0")) | (F.col("col") == F.col("c1"))
    outside = labelled.join(edge, "raster_id").filter(on_edge).select("raster_id", "lrow", "lcol").distinct()
    holes = labelled.join(outside, ["raster_id", "lrow", "lcol"], "left_anti").select("raster_id", "row", "col")
    return px.filter("on").select(F.col("raster_id").cast("long").alias("raster_id"), "row", "col").unionByName(holes)


def pixel_components(px: DataFrame, side: int = SIDE) -> DataFrame:
    """Eight-connected components of set pixels (raster_id, row, col): each pixel with lrow, lcol, its component's first pixel."""
    return label(_linked(px), side, diagonal=True).select("raster_id", "row", "col", "lrow", "lcol")


def dual_cells(filled: DataFrame, around: bool = False) -> DataFrame:
    """Cells of filled pixels: raster_id, row, col (of the upper left pixel), bits (1, 2 above, 4, 8 below), n, right, down.

    right and down: whether the cell there is one and shares a side of two filled pixels. For this the
    pixels beyond are looked at as well, 16 and 32 to the right, 64 and 128 below; with around also left
    and up, from 256 and 512 to the left, 1024 and 2048 above.
    """
    places = [(0, 0, 1), (0, -1, 2), (-1, 0, 4), (-1, -1, 8), (0, -2, 16), (-1, -2, 32), (-2, 0, 64), (-2, -1, 128)]
    places += [(0, 1, 256), (-1, 1, 512), (1, 0, 1024), (1, -1, 2048)] if around else []
    spots = F.explode(F.array(*[F.struct(F.lit(dr).alias("r"), F.lit(dc).alias("c"), F.lit(bit).alias("bit")) for dr, dc, bit in places]))
    e = filled.withColumn("s", spots).select("raster_id", (F.col("row") + F.col("s.r")).alias("row"), (F.col("col") + F.col("s.c")).alias("col"), F.col("s.bit").alias("bit"))
    seen = e.groupBy("raster_id", "row", "col").agg(F.sum("bit").cast("int").alias("all"))
    within = lambda mask: F.col("all").bitwiseAND(F.lit(mask))
    beside = lambda shared, beyond: (within(shared) == shared) & (within(beyond) > 0)
    cells = {"bits": within(15), "n": F.bit_count(within(15)), "right": beside(2 | 8, 16 | 32), "down": beside(4 | 8, 64 | 128)}
    cells |= {"left": beside(1 | 4, 256 | 512), "up": beside(1 | 2, 1024 | 2048)} if around else {}
    return seen.withColumns(cells).filter("n >= 3").drop("all")


def polygonize(px: DataFrame, side: int = SIDE) -> DataFrame:
    """One row an object of a dense px (raster_id, row, col, on), measured in pixels.

    raster_id, n_cells, area, perimeter, xmin, ymin, xmax, ymax (rows count down), cx, cy. Objects of
    different rasters never meet; a raster without an object has no row.
    """
    lab = label(dual_cells(fill_holes(px, side)), side)
    square = F.col("bits") == 15
    area = F.when(square, 1.0).otherwise(0.5)
    # of a triangle the mean of its corners: the missing pixel's side weighs a third
    left = F.col("bits").bitwiseAND(F.lit(1)).cast("int") + (F.col("bits").bitwiseAND(F.lit(4)) / 4).cast("int")
    top = F.col("bits").bitwiseAND(F.lit(1)).cast("int") + (F.col("bits").bitwiseAND(F.lit(2)) / 2).cast("int")
    cx = F.col("col") + F.when(square, 0.5).otherwise((3 - left) / 3)
    cy = F.col("row") + F.when(square, 0.5).otherwise((3 - top) / 3)
    links = F.col("right").cast("int") + F.col("down").cast("int")
    out = lab.groupBy("raster_id", "lrow", "lcol").agg(
        F.count("*").alias("n_cells"),
        F.sum(area).alias("area"),
        (F.sum(F.when(square, 4).otherwise(2) - 2 * links) + F.sqrt(F.lit(2.0)) * F.sum((~square).cast("int"))).alias("perimeter"),
        F.min("col").alias("xmin"), F.min("row").alias("ymin"), (F.max("col") + 1).alias("xmax"), (F.max("row") + 1).alias("ymax"),
        (F.sum(area * cx) / F.sum(area)).alias("cx"), (F.sum(area * cy) / F.sum(area)).alias("cy"),
    )
    return out.drop("lrow", "lcol")


def measure_georeferenced(px: DataFrame, meta: DataFrame, side: int = SIDE) -> DataFrame:
    """raster_id, n_cells, area_m2, perim_m, a_diam_m, xmin .. ymax (map units) of the objects of georeferenced rasters.

    px is dense (raster_id, row, col, on); meta has a row a raster: raster_id, xmin, ymin, xmax, ymax,
    width, height, epsg (4326, 3857 or 6933). Measures are those in the equal-area projection around
    the longitude of the extent's lower left corner. It and the known systems are cylindrical: a pixel's
    width in metres is that of its raster and its height that of its row, so cells add up without
    their contours. A raster without meta has no row; an unknown system gives null measures.
    """
    lab = label(dual_cells(fill_holes(px, side)), side)
    at = meta.select(F.col("raster_id").cast("long").alias("raster_id"), *[F.col(c).alias(f"gl_{c}") for c in ("xmin", "ymin", "xmax", "ymax", "width", "height", "epsg")])
    j = lab.join(at, "raster_id")
    extent = [F.col(f"gl_{c}") for c in ("xmin", "ymin", "xmax", "ymax", "width", "height")]
    lon0 = geo.to_lonlat(extent[0], extent[1], F.col("gl_epsg"))[0]
    # a pixel's place is its row and column, as everywhere here; its width is told by the extent's, not by two far longitudes
    metres = lambda row: geo.to_local(*geo.to_map(F.lit(0), row, *extent), F.col("gl_epsg"), lon0)[1]
    east = geo.to_local((extent[2] - extent[0]) / extent[4], F.lit(0.0), F.col("gl_epsg"), F.lit(0.0))[0]
    j = j.withColumns({"w": east, "h": metres(F.col("row")) - metres(F.col("row") + 1)})
    w, h, square = F.col("w"), F.col("h"), F.col("bits") == 15
    around = F.when(square, 2 * w + 2 * h).otherwise(w + h + F.sqrt(w * w + h * h)) - F.when(F.col("right"), 2 * h).otherwise(0) - F.when(F.col("down"), 2 * w).otherwise(0)
    x, y = geo.to_map(F.col("col"), F.col("row"), *extent)
    x1, y1 = geo.to_map(F.col("col") + 1, F.col("row") + 1, *extent)
    out = j.groupBy("raster_id", "lrow", "lcol").agg(F.count("*").alias("n_cells"), F.sum(F.when(square, w * h).otherwise(w * h / 2)).alias("area_m2"), F.sum(around).alias("perim_m"), F.min(x).alias("xmin"), F.min(y1).alias("ymin"), F.max(x1).alias("xmax"), F.max(y).alias("ymax"))
    return out.drop("lrow", "lcol").withColumn("a_diam_m", geo.equivalent_diameter(F.col("area_m2")))


def features(objects: DataFrame, pixel_width: float = 1.0, pixel_height: float = 1.0) -> DataFrame:
    """Objects as features: id (from 0 by raster and place), class, label, area_m2, perim_m, a_diam_m.

    Perimeters are in map units where pixels are square; else they are scaled by the mean side.
    """
    from gridloom.functions.geo import equivalent_diameter
    from gridloom.operators.vector import CLASS

    out = objects.withColumns({"class": F.lit(CLASS), "label": F.lit(CLASS), "area_m2": F.col("area") * pixel_width * pixel_height, "perim_m": F.col("perimeter") * (pixel_width + pixel_height) / 2})
    return dense_ids(out.withColumn("a_diam_m", equivalent_diameter(F.col("area_m2"))), ["raster_id", "ymin", "xmin", "ymax", "xmax", "area", "cx", "cy"])
