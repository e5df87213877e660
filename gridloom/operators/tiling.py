"""Tile grids over map extents, and what lies in their tiles."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.operators import vector


def grid(bounds: DataFrame, n: int) -> DataFrame:
    """n x n tiles of bounds (one row: xmin, ymin, xmax, ymax), from the top left, row by row."""
    t = bounds.withColumn("tile_id", F.explode(F.sequence(F.lit(0), F.lit(n * n - 1))))
    w, h = (F.col("xmax") - F.col("xmin")) / n, (F.col("ymax") - F.col("ymin")) / n
    r, c = F.floor(F.col("tile_id") / n), F.col("tile_id") % n
    return t.select(F.col("tile_id").cast("int"), (F.col("xmin") + c * w).alias("xmin"), (F.col("ymax") - (r + 1) * h).alias("ymin"), (F.col("xmin") + (c + 1) * w).alias("xmax"), (F.col("ymax") - r * h).alias("ymax"))


def overlay_boxes(boxes: DataFrame, bounds: DataFrame, n: int) -> DataFrame:
    """The pieces of boxes in each tile, with all columns of the box; empty pieces are none.

    Each box names the tiles that it touches by arithmetic, so boxes and tiles meet in an equi-join
    on at most n * n tiles. Bounds without width or height hold no piece; an empty table gives none.
    """
    b = bounds.select(*[F.col(c).alias(f"gl_{c}") for c in ("xmin", "ymin", "xmax", "ymax")])
    j = boxes.join(F.broadcast(b))  # bounds is one row
    w, h = (F.col("gl_xmax") - F.col("gl_xmin")) / n, (F.col("gl_ymax") - F.col("gl_ymin")) / n
    at = lambda x: F.greatest(F.lit(0), F.least(F.lit(n - 1), F.floor(x).cast("int")))
    c0, c1 = at(F.try_divide(F.col("xmin") - F.col("gl_xmin"), w) - 1), at(F.try_divide(F.col("xmax") - F.col("gl_xmin"), w) + 1)
    r0, r1 = at(F.try_divide(F.col("gl_ymax") - F.col("ymax"), h) - 1), at(F.try_divide(F.col("gl_ymax") - F.col("ymin"), h) + 1)
    j = j.withColumn("gl_r", F.explode(F.sequence(r0, r1))).withColumn("gl_c", F.explode(F.sequence(c0, c1)))
    j = j.withColumn("tile_id", (F.col("gl_r") * n + F.col("gl_c")).cast("int")).select(*boxes.columns, "tile_id")
    t = grid(bounds, n).select("tile_id", *[F.col(c).alias(f"tile_{c}") for c in ("xmin", "ymin", "xmax", "ymax")])
    cut = j.join(F.broadcast(t), "tile_id") if n <= 100 else j.join(t, "tile_id")  # up to 10,000 tiles
    cut = cut.withColumns({"xmin": F.greatest("xmin", "tile_xmin"), "ymin": F.greatest("ymin", "tile_ymin"), "xmax": F.least("xmax", "tile_xmax"), "ymax": F.least("ymax", "tile_ymax")})
    return cut.filter((F.col("xmin") < F.col("xmax")) & (F.col("ymin") < F.col("ymax")))


def overlay_rings(rings: DataFrame, bounds: DataFrame, n: int, ring: str = "ring") -> DataFrame:
    """The pieces of simple rings in each tile: all columns of the ring's row, tile_id, the tile's box, parts, xmin .. ymax.

    parts holds the rings of a piece, several where a concave ring comes into a tile more than once.
    Only rings on a tile's border are clipped, in Arrow batches; of the others no point leaves the JVM.
    Null rings and those of fewer than three points have no piece.
    """
    names = ("xmin", "ymin", "xmax", "ymax")
    e = rings.drop(*names).filter(F.size(ring) > 2).withColumns(dict(zip(names, vector.envelope(F.col(ring)), strict=True)))
    e = e.withColumn("gl_box", F.struct(*names))
    o = overlay_boxes(e, bounds, n)
    tile = [F.col(f"tile_{c}") for c in names]
    within = (F.col("gl_box.xmin") >= tile[0]) & (F.col("gl_box.ymin") >= tile[1]) & (F.col("gl_box.xmax") <= tile[2]) & (F.col("gl_box.ymax") <= tile[3])
    parts = F.when(within, F.array(F.col(ring).cast(vector.POINTS))).otherwise(vector.clip_parts(F.when(~within, F.col(ring)), *tile))
    some = o.withColumn("parts", parts).filter((F.size("parts") > 0) & (vector.parts_area(F.col("parts")) > vector.LEAST_PIECE))
    return some.withColumns(dict(zip(names, vector.envelope(F.flatten("parts")), strict=True))).drop("gl_box")


def clip_pixels(px: DataFrame, height: int, width: int, n: int) -> DataFrame:
    """px with tile_id of an n x n grid over the raster (a pixel belongs where its centre lies) and its place inside."""
    r, c = F.floor((F.col("row") + 0.5) * n / height).cast("int"), F.floor((F.col("col") + 0.5) * n / width).cast("int")
    first = lambda i, size: F.ceil(i * size / n - 0.5).cast("int")
    return px.withColumns({"tile_id": r * n + c, "tile_row": F.col("row") - first(r, height), "tile_col": F.col("col") - first(c, width)})
