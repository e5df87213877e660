"""Operators on pixel tables: raster_id, row, col and one column a band.

Rasters may be as large as a mosaic of the whole table, so nothing here gathers a raster: its extrema
are aggregates that every task computes in part, and only a tile (bounded by its side) is a window.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gridloom.functions import geo

#: Side of a tile in pixels.
TILE = 256
#: A tile whose maximum is not above this is noise (fixed value).
NOISE_FLOOR = 0.05
#: Tiles beyond which a raster is reported as large (fixed value).
TILE_BUDGET = 25
# means and standard deviations of the three bands, for the height model's input (fixed values)
BAND_MEAN = (0.420, 0.411, 0.296)
BAND_STD = (0.213, 0.156, 0.143)
# weights of red, green and blue in gray (fixed values)
GRAY = (0.299, 0.587, 0.114)


def with_maximum(px: DataFrame, keys: list[str], value: str, name: str) -> DataFrame:
    """px with the maximum of value by keys: partial maxima, then a join with one row a key."""
    top = px.groupBy(*keys).agg(F.max(value).alias(name))
    return px.join(top, keys)


def threshold_global(px: DataFrame, percent: float = 15.0, value: str = "v") -> DataFrame:
    """mask: 255 where the value exceeds percent % of its raster's maximum, else 0.

    A null value is 0 and takes no part in the maximum; repeated pixels count each, null raster_ids have
    no raster and are left out, an empty table stays empty.
    """
    seen = with_maximum(px, ["raster_id"], value, "gl_max")
    return seen.withColumn("mask", F.when(F.col(value) > percent / 100 * F.col("gl_max"), 255).otherwise(0)).drop("gl_max")


def with_tiles(px: DataFrame, side: int = TILE) -> DataFrame:
    """px with tile_row and tile_col."""
    return px.withColumns({"tile_row": F.floor(F.col("row") / side).cast("int"), "tile_col": F.floor(F.col("col") / side).cast("int")})


def threshold_tiles(px: DataFrame, share: float = 0.15, floor: float = NOISE_FLOOR, side: int = TILE, value: str = "v") -> DataFrame:
    """mask by tile: negative values are 0, a tile not above the noise floor is 0, then value > share of its maximum."""
    tile = Window.partitionBy("raster_id", "tile_row", "tile_col")  # side x side pixels at most
    h = with_tiles(px, side).withColumn("h", F.greatest(F.col(value), F.lit(0.0)))
    h = h.withColumn("tile_max", F.max("h").over(tile))
    return h.withColumn("mask", F.when((F.col("tile_max") > floor) & (F.col("h") > share * F.col("tile_max")), 255).otherwise(0))


def to_byte(value: Column) -> Column:
    """Negative values as 0, the others without their fraction."""
    return F.greatest(value, F.lit(0.0)).cast("int")


def band_statistics(px: DataFrame, value: str = "v") -> DataFrame:
    """Minimum, maximum, mean and population standard deviation of each raster."""
    return px.groupBy("raster_id").agg(F.count(value).alias("n"), F.min(value).alias("v_min"), F.max(value).alias("v_max"), F.avg(value).alias("v_mean"), F.stddev_pop(value).alias("v_std"))


def dimensions(px: DataFrame) -> DataFrame:
    """Height and width of each raster, and its tiles."""
    d = px.groupBy("raster_id").agg((F.max("row") + 1).alias("height"), (F.max("col") + 1).alias("width"))
    return d


def tile_counts(dims: DataFrame, side: int = TILE) -> DataFrame:
    """Tiles a raster has, partial ones included."""
    return dims.withColumns({"tile_rows": F.ceil(F.col("height") / side).cast("int"), "tile_cols": F.ceil(F.col("width") / side).cast("int")})


def tile_windows(dims: DataFrame, side: int = TILE) -> DataFrame:
    """One row a tile: its number in column-major order, its corner and its size cut at the raster's edge."""
    t = tile_counts(dims, side).withColumn("tile", F.explode(F.sequence(F.lit(0), F.col("tile_rows") * F.col("tile_cols") - 1)))
    t = t.withColumns({"tile_col": F.floor(F.col("tile") / F.col("tile_rows")).cast("int"), "tile_row": (F.col("tile") % F.col("tile_rows")).cast("int")})
    top, left = F.col("tile_row") * side, F.col("tile_col") * side
    return t.select("raster_id", "tile", "tile_row", "tile_col", top.alias("row0"), left.alias("col0"), (F.least(top + side, F.col("height")) - top).alias("tile_height"), (F.least(left + side, F.col("width")) - left).alias("tile_width"))


def within_budget(dims: DataFrame, side: int = TILE, budget: int = TILE_BUDGET) -> DataFrame:
    """Whether a raster's whole tiles are in the budget; a raster without pixels is not."""
    n = F.floor(F.col("width") / side) * F.floor(F.col("height") / side)
    return dims.withColumns({"n_tiles": n.cast("long"), "within_budget": (F.col("width") > 0) & (F.col("height") > 0) & (n <= budget)})


def crop(px: DataFrame, meta: DataFrame, xmin: float, ymin: float, xmax: float, ymax: float) -> DataFrame:
    """The pixels whose centre is in the extent; meta: raster_id, xmin, ymin, xmax, ymax, width, height."""
    m = meta.select("raster_id", *[F.col(c).alias(f"gl_{c}") for c in ("xmin", "ymin", "xmax", "ymax", "width", "height")])
    j = px.join(m, "raster_id")
    x = F.col("gl_xmin") + (F.col("col") + 0.5) / F.col("gl_width") * (F.col("gl_xmax") - F.col("gl_xmin"))
    y = F.col("gl_ymin") + (1 - (F.col("row") + 0.5) / F.col("gl_height")) * (F.col("gl_ymax") - F.col("gl_ymin"))
    return j.filter(x.between(xmin, xmax) & y.between(ymin, ymax)).select(*px.columns)


def crop_reprojected(px: DataFrame, meta: DataFrame, box: tuple[float, float, float, float], epsg: int) -> DataFrame:
    """crop() to an extent given in another system than the rasters'; meta has their epsg as well.

    The extent is reprojected to each raster's system. A raster of an unknown system keeps no pixel.
    """
    there = geo.reproject_box([F.lit(float(c)) for c in box], epsg, F.col("epsg"))
    m = meta.withColumns({f"to_{c}": v for c, v in zip(("xmin", "ymin", "xmax", "ymax"), there, strict=True)})
    m = m.select("raster_id", *[F.col(c).alias(f"gl_{c}") for c in ("xmin", "ymin", "xmax", "ymax", "width", "height", "to_xmin", "to_ymin", "to_xmax", "to_ymax")])
    j = px.join(m, "raster_id")
    x, y = geo.to_map(F.col("col") + 0.5, F.col("row") + 0.5, *[F.col(f"gl_{c}") for c in ("xmin", "ymin", "xmax", "ymax", "width", "height")])
    return j.filter(x.between(F.col("gl_to_xmin"), F.col("gl_to_xmax")) & y.between(F.col("gl_to_ymin"), F.col("gl_to_ymax"))).select(*px.columns)


def bounding_boxes(meta: DataFrame, epsg: int) -> DataFrame:
    """raster_id and each raster's xmin, ymin, xmax, ymax in another system."""
    names = ("xmin", "ymin", "xmax", "ymax")
    return meta.select("raster_id", *[c.alias(n) for n, c in zip(names, geo.reproject_box([F.col(n) for n in names], F.col("epsg"), epsg), strict=True)])


def stretch(px: DataFrame, value: str = "v") -> DataFrame:
    """v255: the value from its raster's range to 0 .. 255; 0 in a raster of one value.

    A null value stays null where the raster has a range, and is 0 where it has none; a null raster_id is
    left out, an empty table stays empty.
    """
    r = px.groupBy("raster_id").agg(F.min(value).alias("gl_lo"), F.max(value).alias("gl_hi"))
    j = px.join(r, "raster_id")
    span = F.col("gl_hi") - F.col("gl_lo")
    return j.withColumn("v255", F.when(span > 0, (F.col(value) - F.col("gl_lo")) / span * 255).otherwise(0.0)).drop("gl_lo", "gl_hi")


def gray(r: Column, g: Column, b: Column) -> Column:
    """Rounded luma of three bands."""
    return F.floor(GRAY[0] * r + GRAY[1] * g + GRAY[2] * b + 0.5).cast("int")


def without_alpha(px: DataFrame, alpha: str = "a") -> DataFrame:
    return px.drop(alpha)


def swap_bands(px: DataFrame, one: str = "r", other: str = "b") -> DataFrame:
    """The bands' names exchanged, as between RGB and BGR."""
    return px.withColumnsRenamed({one: "gl_swap"}).withColumnRenamed(other, one).withColumnRenamed("gl_swap", other)


def transpose(px: DataFrame) -> DataFrame:
    """Rows as columns and columns as rows."""
    return swap_bands(px, "row", "col")


def unit(value: Column) -> Column:
    """0 .. 255 as 0 .. 1."""
    return value / 255.0


def full_only(value: Column) -> Column:
    """1 for 255 and 0 for less: the whole part of a 255th."""
    return F.floor(value / 255).cast("int")


def normalise_bands(*bands: Column) -> list[Column]:
    """Bands of 0 .. 255 scaled to the height model's mean and deviation."""
    return [(b / 255 - m) / s for b, m, s in zip(bands, BAND_MEAN, BAND_STD, strict=True)]


def expectation(logits: Column, lo: float = 0.001, hi: float = 10.0, scale: float = 10.0) -> Column:
    """Height from the scores of equally spaced bins: relu, + 0.1, normalised, times the bins."""
    w = F.transform(logits, lambda x: F.greatest(x.cast("double"), F.lit(0.0)) + 0.1)
    n = F.size(logits)
    weighted = F.transform(w, lambda x, i: x * (lo + (hi - lo) * i / (n - 1)))
    add = lambda c: F.aggregate(c, F.lit(0.0), lambda a, x: a + x)
    return scale * add(weighted) / add(w)


def mean_absolute_error(pairs: DataFrame, a: str, b: str) -> DataFrame:
    return pairs.agg(F.avg(F.abs(F.col(a) - F.col(b))).alias("mae"))


def zonal_maximum(px: DataFrame, value: str = "v", zone: str = "zone") -> DataFrame:
    """Maximum, mean and pixels of each zone."""
    return px.groupBy(zone).agg(F.max(value).alias("v_max"), F.avg(value).alias("v_mean"), F.count(value).alias("n"))


def resample(px: DataFrame, dims: DataFrame, scale: float, value: str = "v") -> DataFrame:
    """Bilinear resampling: each new pixel from the four old ones around its centre, edges repeated.

    Null or missing old pixels add nothing (their share is lost, and a new pixel of none is null or
    missing); a raster that shrinks to nothing, one without dims and an empty table give no row.
    """
    d = dims.select("raster_id", "height", "width", F.floor(F.col("height") * scale).cast("int").alias("gl_h"), F.floor(F.col("width") * scale).cast("int").alias("gl_w")).filter("gl_h > 0 and gl_w > 0")

    def fed(k: Column, n: Column, m: Column) -> Column:
        """The new places (of m) that old place k (of n) has a share in, with their shares."""
        lo = F.when(k <= 1, 0).otherwise(F.greatest(F.lit(0), F.floor((k - 0.5) * scale - 0.5).cast("int")))
        hi = F.when(k == n - 1, m - 1).otherwise(F.least(m - 1, F.ceil((k + 1.5) * scale - 0.5).cast("int")))

        def share(i: Column) -> Column:
            y = F.greatest(F.lit(0.0), F.least((i + 0.5) / scale - 0.5, n - 1.0))
            y0 = F.floor(y)
            first, second = y0 == k, F.least(y0 + 1, n - 1) == k
            return F.when(first | second, F.when(first, 1 - y + y0).otherwise(0.0) + F.when(second, y - y0).otherwise(0.0))

        to = F.transform(F.when(lo <= hi, F.sequence(lo, hi)), lambda i: F.struct(i.alias("to"), share(i).alias("w")))
        return F.filter(to, lambda s: s["w"].isNotNull())

    # an old pixel names the few new ones around it, so pixels are neither multiplied before a join nor joined with their places
    j = px.select("raster_id", "row", "col", F.col(value).alias("gl_v")).join(d, "raster_id")
    j = j.withColumn("gl_r", F.explode(fed(F.col("row"), F.col("height"), F.col("gl_h")))).withColumn("gl_c", F.explode(fed(F.col("col"), F.col("width"), F.col("gl_w"))))
    j = j.select("raster_id", F.col("gl_r.to").alias("row"), F.col("gl_c.to").alias("col"), (F.col("gl_r.w") * F.col("gl_c.w") * F.col("gl_v")).alias("gl_part"))
    return j.groupBy("raster_id", "row", "col").agg(F.sum("gl_part").alias(value))
