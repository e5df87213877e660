"""Whole flows composed of operators: raster to features, export of a training data set, inference."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.operators import coco, detect, polygons, raster, tiling
from gridloom.sources import files, geotiff


def raster_to_vector(px: DataFrame, meta: DataFrame, percent: float = 15.0, side: int = polygons.SIDE) -> DataFrame:
    """Georeferenced rasters (raster_id, row, col, v) to the measured features of what exceeds percent % of their maximum."""
    on = raster.threshold_global(px, percent).select("raster_id", "row", "col", (F.col("mask") > 0).alias("on"))
    return polygons.measure_georeferenced(on, meta, side)


def binary_rasters(px: DataFrame, meta: DataFrame, path: str, percent: float = 15.0, prefix: str = "mask_") -> None:
    """Rasters (raster_id, row, col, v) as files of 0 and 255, set where v exceeds percent % of the raster's maximum.

    meta: raster_id, xmin, ymin, xmax, ymax, width, height, epsg; a raster without it has no file.
    """
    m = raster.threshold_global(px, percent).select("raster_id", "row", "col", F.col("mask").alias("v"))
    geotiff.write(geotiff.encode_rasters(m, meta, dtype="uint8"), path, prefix)


def export_dataset(path: str, px: DataFrame, meta: DataFrame, rings: DataFrame, n: int, bands: tuple[str, ...] = ("v",)) -> None:
    """One raster and the features over it as n x n tiles: <path>/images holds a GeoTIFF a tile, <path>/annotations the lists.

    px is (row, col, bands) of a single raster; meta its one row (xmin, ymin, xmax, ymax, width, height,
    epsg); rings (box_id, ring) in the same system. Tiles without a pixel have an image entry but no file.
    """
    bounds = meta.select("xmin", "ymin", "xmax", "ymax")
    at = meta.select("width", "height", "epsg").first()  # one row
    tiles = tiling.grid(bounds, n)
    first = lambda i, size: F.ceil(i * size / n - 0.5).cast("int")
    r, c = F.floor(F.col("tile_id") / n), F.col("tile_id") % n
    sized = tiles.withColumns({"height": first(r + 1, at["height"]) - first(r, at["height"]), "width": first(c + 1, at["width"]) - first(c, at["width"]), "epsg": F.lit(at["epsg"])})
    inside = tiling.clip_pixels(px, at["height"], at["width"], n).select(F.col("tile_id").alias("raster_id"), F.col("tile_row").alias("row"), F.col("tile_col").alias("col"), *bands)
    geotiff.write(geotiff.encode_rasters(inside, sized.withColumnRenamed("tile_id", "raster_id"), bands), f"{path}/images")
    size = sized.select("tile_id", "height", "width")
    pieces = tiling.overlay_rings(rings, bounds, n).join(F.broadcast(size) if n <= 100 else size, "tile_id")  # up to 10,000 tiles; else a task a tile
    images = sized.select((F.col("tile_id") + 1).cast("int").alias("id"), F.concat(F.lit("tile_"), F.col("tile_id"), F.lit(".tif")).alias("file_name"), "width", "height")
    coco.write_tables(f"{path}/annotations", images, coco.ring_annotations(pieces, F.col("width"), F.col("height")))


def detect_objects(tiles: DataFrame, model: Callable[[], Callable[[pd.DataFrame], pd.DataFrame]], meta: DataFrame, path: str, prefix: str, kinds: tuple[str, ...] = tuple(files.LAYERS), score: float = detect.LEAST_SCORE) -> list[str]:
    """Tiles through a detector (rows of image_id, box_id, xmin .. ymax, score), to features, to the chosen layers."""
    boxes = detect.infer(tiles, model, "image_id int, box_id long, xmin double, ymin double, xmax double, ymax double, score double")
    return files.write_layers(detect.layer(boxes, meta, score), path, prefix, kinds)
