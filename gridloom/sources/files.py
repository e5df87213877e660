"""Sources and sinks. Everything is read by Spark's readers, so any store that Spark knows will do."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.functions.text import basename
from gridloom.operators import coco, vector

#: Result kinds of the vector sink and the endings of their layers.
LAYERS = {"polygons": "_vector", "bounding_boxes": "_vector_bb", "centroids": "_vector_centroids"}


def read_ascii_grid(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """ESRI ASCII grids: pixels (file, row, col, v; nodata is null) and one metadata row a file.

    A file is split into lines by Spark; header lines begin with a letter, and the rows of the grid
    are those with as many numbers as the header says.
    """
    lines = spark.read.text(path, wholetext=True).select(basename(F.col("_metadata.file_path")).alias("file"), F.split("value", r"\r?\n").alias("lines"))
    words = lines.select("file", F.transform(F.filter("lines", lambda s: F.trim(s) != ""), lambda s: F.split(F.trim(s), r"\s+")).alias("w"))
    head = words.select("file", F.map_from_entries(F.transform(F.filter("w", lambda a: a[0].rlike("^[A-Za-z]") & (F.size(a) == 2)), lambda a: F.struct(F.lower(a[0]), a[1].try_cast("double")))).alias("h"), "w")
    width = F.col("h")["ncols"].cast("int")
    meta = head.select("file", F.col("h")["nrows"].cast("int").alias("height"), width.alias("width"), F.coalesce(F.col("h")["cellsize"], F.col("h")["dx"]).alias("dx"), F.coalesce(F.col("h")["cellsize"], F.col("h")["dy"]).alias("dy"), F.coalesce(F.col("h")["xllcorner"], F.col("h")["xllcenter"] - F.coalesce(F.col("h")["cellsize"], F.col("h")["dx"]) / 2).alias("xmin"), F.coalesce(F.col("h")["yllcorner"], F.col("h")["yllcenter"] - F.coalesce(F.col("h")["cellsize"], F.col("h")["dy"]) / 2).alias("ymin"), F.coalesce(F.col("h")["nodata_value"], F.col("h")["nodata"]).alias("nodata"))
    grid = head.select("file", width.alias("width"), F.coalesce(F.col("h")["nodata_value"], F.col("h")["nodata"]).alias("nodata"), F.posexplode(F.filter("w", lambda a: ~a[0].rlike("^[A-Za-z]") & (F.size(a) == width))).alias("row", "cells"))
    px = grid.select("file", "row", "nodata", F.posexplode("cells").alias("col", "cell"))
    v = F.col("cell").cast("double")
    return px.select("file", "row", "col", F.when(F.col("nodata").isNull() | (v != F.col("nodata")), v).alias("v")), meta


def read_mask_list(spark: SparkSession, path: str, ending: str = ".tif") -> DataFrame:
    """Files of a folder by ending: id (place in the order of names, from 0), file_name, path, length; no content is read."""
    from gridloom.functions.shared import dense_ids

    f = spark.read.format("binaryFile").option("pathGlobFilter", f"*{ending}").load(path).select("path", "length")
    return dense_ids(f.withColumn("file_name", basename(F.col("path"))), ["file_name", "path"])


def read_coco(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """images, annotations and categories of COCO files."""
    d = spark.read.schema(coco.SCHEMA).json(path, multiLine=True)
    return {k: d.select(F.explode(k).alias("x")).select("x.*") for k in ("images", "annotations", "categories")}


def write_layers(features: DataFrame, path: str, prefix: str, kinds: tuple[str, ...] = tuple(LAYERS)) -> list[str]:
    """The chosen layers of features with xmin .. ymax, cx, cy, each in a folder of its own; existing ones stop it."""
    if not kinds or set(kinds) - set(LAYERS):
        raise ValueError(f"choose at least one of {sorted(LAYERS)}")
    measures = [c for c in features.columns if c not in ("xmin", "ymin", "xmax", "ymax", "cx", "cy", "ring")]
    columns = {"polygons": [c for c in features.columns if c not in ("cx", "cy")], "bounding_boxes": [*measures, "xmin", "ymin", "xmax", "ymax"], "centroids": [*measures, "cx", "cy"]}
    out = []
    for k in kinds:
        features.select(*columns[k]).write.mode("errorifexists").parquet(f"{path}/{prefix}{LAYERS[k]}")
        out.append(f"{path}/{prefix}{LAYERS[k]}")
    return out


def write_raster(px: DataFrame, path: str, side: int = 256, meta: DataFrame | None = None) -> None:
    """Pixels by tile, so that a later crop reads the tiles it needs; meta (extent, size, epsg) goes to <path>_meta."""
    if meta is not None:
        meta.write.mode("errorifexists").parquet(f"{path}_meta")
    tiled = px.withColumns({"tile_row": F.floor(F.col("row") / side).cast("int"), "tile_col": F.floor(F.col("col") / side).cast("int")})
    tiled.repartition("raster_id", "tile_row", "tile_col").write.mode("errorifexists").partitionBy("tile_row", "tile_col").parquet(path)


def filter_layer(spark: SparkSession, source: str, target: str, limit: float, area: str = "area_m2") -> None:
    """A stored layer without its large features, as another layer."""
    vector.filter_by_area(spark.read.parquet(source), limit, area).write.mode("errorifexists").parquet(target)


def register(spark: SparkSession, paths: list[str]) -> list[str]:
    """Stored layers as views named after their folders."""
    names = [p.rstrip("/").rpartition("/")[2] for p in paths]
    for n, p in zip(names, paths, strict=True):
        spark.read.parquet(p).createOrReplaceTempView(n)
    return names


def read_raster(spark: SparkSession, path: str, rows: tuple[int, int] | None = None, cols: tuple[int, int] | None = None, side: int = 256) -> DataFrame:
    """The pixels of write_raster() whose row and column are in the ranges (first, last); other tiles aren't read."""
    px = spark.read.parquet(path)
    for name, within in (("row", rows), ("col", cols)):
        if within is not None:
            px = px.filter(F.col(f"tile_{name}").between(within[0] // side, within[1] // side) & F.col(name).between(*within))
    return px.drop("tile_row", "tile_col")


def append_outputs(outputs: DataFrame, more: DataFrame) -> DataFrame:
    """Two lists of outputs as one, each path once."""
    return outputs.unionByName(more).dropDuplicates(["path"])
