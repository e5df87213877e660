"""Pixel, box and point tables derived from the test tables by integer arithmetic."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.functions.shared import spread


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings as 8x8 rasters: raster_id, row, col, v, zone."""
    e = spread(load(spark, sf_dir, "embeddings").select("vec_id", "label", "embedding")).select("vec_id", "label", F.posexplode("embedding").alias("p", "x"))
    return e.select(F.col("vec_id").alias("raster_id"), F.floor(F.col("p") / 8).cast("int").alias("row"), (F.col("p") % 8).cast("int").alias("col"), F.col("x").cast("double").alias("v"), F.col("label").alias("zone"))


def mosaic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All embeddings as one raster of 64 columns."""
    e = spread(load(spark, sf_dir, "embeddings").select("vec_id", "embedding")).select("vec_id", F.posexplode("embedding").alias("p", "x"))
    return e.select(F.lit(0).cast("long").alias("raster_id"), F.col("vec_id").cast("int").alias("row"), F.col("p").cast("int").alias("col"), F.col("x").cast("double").alias("v"))


def boxes(spark: SparkSession, sf_dir: str, shift: bool = False) -> DataFrame:
    """Boxes of 20 images from parts: box_id, image_id, xmin, ymin, xmax, ymax, score."""
    k = F.col("p_partkey")
    moved = k % 5 - 2 if shift else F.lit(0)
    b = spread(load(spark, sf_dir, "part").select("p_partkey", "p_size", "p_retailprice")).select(k.alias("box_id"), (k % 20).cast("int").alias("image_id"), (k * 37 % 206 + moved).cast("double").alias("xmin"), (k * 91 % 206).cast("double").alias("ymin"), F.col("p_size").cast("double").alias("w"), (1 + k % 50).cast("double").alias("h"), (F.col("p_retailprice") / 1000).alias("score"))
    return b.select("box_id", "image_id", "xmin", "ymin", (F.col("xmin") + F.col("w")).alias("xmax"), (F.col("ymin") + F.col("h")).alias("ymax"), "score")


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Longitudes and latitudes from customers: id, lon, lat."""
    k = F.col("c_custkey")
    return load(spark, sf_dir, "customer").select(k.alias("id"), ((k * 7919 % 360000) / 1000 - 180).alias("lon"), ((k * 104729 % 160000) / 1000 - 80).alias("lat"))


def notched_rings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The boxes as concave rings, with a notch from above to a quarter of their height: box_id, ring."""
    p = lambda x, y: F.struct(x.alias("x"), y.alias("y"))
    x0, y0, x1, y1 = (F.col(c) for c in ("xmin", "ymin", "xmax", "ymax"))
    return boxes(spark, sf_dir).select("box_id", F.array(p(x0, y0), p(x1, y0), p(x1, y1), p((x0 + x1) / 2, y0 + (y1 - y0) / 4), p(x0, y1)).alias("ring"))


def slanted_rings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The left halves of the notched rings, quadrilaterals with a slanted side: box_id, ring."""
    r = F.col("ring")
    return notched_rings(spark, sf_dir).select("box_id", F.array(r[0], F.struct(r[3]["x"].alias("x"), r[0]["y"].alias("y")), r[3], r[4]).alias("ring"))


def plots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes of 20 images that overlap in many places, as rings: box_id, image_id, ring."""
    p = lambda x, y: F.struct(x.alias("x"), y.alias("y"))
    b, k = boxes(spark, sf_dir), F.col("box_id")
    x0, y0 = F.col("xmin"), F.col("ymin")
    x1, y1 = x0 + (3 + k % 29), y0 + (3 + k % 17)
    return b.select("box_id", "image_id", F.array(p(x0, y0), p(x1, y0), p(x1, y1), p(x0, y1)).alias("ring"))


def damaged_rings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The boxes as rings that are whole, cross themselves, have a spike or doubled points: box_id, ring."""
    p = lambda x, y: F.struct(x.alias("x"), y.alias("y"))
    x0, y0, x1, y1, k = F.col("xmin"), F.col("ymin"), F.col("xmax"), F.col("ymax"), F.col("box_id") % 4
    plain = F.array(p(x0, y0), p(x1, y0), p(x1, y1), p(x0, y1))
    crossed = F.array(p(x0, y0), p(x1, y1), p(x1, y0), p(x0, y1))
    spiked = F.array(p(x0, y0), p(x1, y0), p(x1, y1), p(x1 + 5, y1), p(x1, y1), p(x0, y1))
    doubled = F.array(p(x0, y0), p(x0, y0), p(x1, y0), p(x1, y1), p(x1, y1), p(x0, y1), p(x0, y0))
    return boxes(spark, sf_dir).select("box_id", F.when(k == 0, plain).when(k == 1, crossed).when(k == 2, spiked).otherwise(doubled).alias("ring"))


def placed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Extents of the 8x8 rasters in three systems: raster_id, xmin, ymin, xmax, ymax, width, height, epsg."""
    i = F.col("vec_id")
    epsg = F.element_at(F.array(F.lit(4326), F.lit(3857), F.lit(6933)), (i % 3 + 1).cast("int"))
    e = load(spark, sf_dir, "embeddings").select(i.alias("raster_id"), epsg.alias("epsg"))
    i, degrees = F.col("raster_id"), F.col("epsg") == 4326
    x, y = F.when(degrees, i * 7919 % 3400 / 10 - 170).otherwise(i * 1000 - 200000), F.when(degrees, i * 104729 % 1200 / 10 - 60).otherwise(i * 700 - 100000)
    size = F.when(degrees, 0.0008).otherwise(80.0)
    return e.withColumns({"xmin": x.cast("double"), "ymin": y.cast("double")}).select("raster_id", "xmin", "ymin", (F.col("xmin") + size).alias("xmax"), (F.col("ymin") + size).alias("ymax"), F.lit(8).alias("width"), F.lit(8).alias("height"), "epsg")
