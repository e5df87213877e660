"""Annotation data sets in the COCO layout."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.functions.geo import to_pixel
from gridloom.functions.shared import dense_ids, settle
from gridloom.operators import vector

SCHEMA = "images array<struct<id:int,file_name:string,width:int,height:int>>, annotations array<struct<id:bigint,image_id:int,category_id:int,segmentation:array<array<double>>,bbox:array<double>>>, categories array<struct<id:int,name:string,supercategory:string>>"


def images(tiles: DataFrame, width: int, height: int) -> DataFrame:
    """One image a tile: its id counts from 1, its file from 0."""
    return tiles.select((F.col("tile_id") + 1).cast("int").alias("id"), F.concat(F.lit("tile_"), F.col("tile_id"), F.lit(".tif")).alias("file_name"), F.lit(width).alias("width"), F.lit(height).alias("height"))


def annotations(pieces: DataFrame, width: int, height: int, feature: str = "box_id") -> DataFrame:
    """One annotation for each piece of a feature in a tile, numbered from 1 by image and feature.

    pieces: tile_id, tile_xmin .. tile_ymax and the piece's xmin .. ymax, in map units. The ring and
    the box [left, top, width, height] are in pixels of the tile; the ring ends where it begins.
    """
    t = [F.col(f"tile_{c}") for c in ("xmin", "ymin", "xmax", "ymax")]
    x0, y0 = to_pixel(F.col("xmin"), F.col("ymin"), *t, F.lit(width), F.lit(height))
    x1, y1 = to_pixel(F.col("xmax"), F.col("ymax"), *t, F.lit(width), F.lit(height))
    p = pieces.select((F.col("tile_id") + 1).cast("int").alias("image_id"), F.col(feature).alias("feature_id"), x0.alias("x0"), y0.alias("y0"), x1.alias("x1"), y1.alias("y1"))
    ring = vector.ring_of_box(F.col("x0"), F.col("y1"), F.col("x1"), F.col("y0"))
    flat = F.flatten(F.transform(F.concat(ring, F.slice(ring, 1, 1)), lambda q: F.array(q["x"], q["y"])))
    numbered = dense_ids(p, ["image_id", "feature_id"], "id", 1)
    return numbered.select("id", "image_id", "feature_id", F.lit(1).alias("category_id"), F.array(flat).alias("segmentation"), F.array("x0", "y1", F.abs(F.col("x1") - F.col("x0")), F.abs(F.col("y1") - F.col("y0"))).alias("bbox"))


def ring_annotations(pieces: DataFrame, width: int, height: int, feature: str = "box_id") -> DataFrame:
    """annotations() of pieces with parts, as tiling.overlay_rings gives them: one list of numbers for each part."""
    t = [F.col(f"tile_{c}") for c in ("xmin", "ymin", "xmax", "ymax")]
    place = lambda x, y: to_pixel(x, y, *t, F.lit(width), F.lit(height))
    flat = lambda r: F.flatten(F.transform(F.concat(r, F.slice(r, 1, 1)), lambda q: F.array(*place(q["x"], q["y"]))))
    (x0, y0), (x1, y1) = place(F.col("xmin"), F.col("ymin")), place(F.col("xmax"), F.col("ymax"))
    p = pieces.select((F.col("tile_id") + 1).cast("int").alias("image_id"), F.col(feature).alias("feature_id"), F.transform("parts", flat).alias("segmentation"), F.array(x0, y1, F.abs(x1 - x0), F.abs(y1 - y0)).alias("bbox"))
    p = settle(p, "pieces")  # else the ranges' sample would clip all rings a second time
    return dense_ids(p, ["image_id", "feature_id"], "id", 1).select("id", "image_id", "feature_id", F.lit(1).alias("category_id"), "segmentation", "bbox")


def with_scores(annotations_: DataFrame, scored: DataFrame, feature: str = "box_id") -> DataFrame:
    """Results: annotations with the score that scored (feature, score) holds for their feature, null without one."""
    s = scored.select(F.col(feature).alias("feature_id"), "score")
    return annotations_.join(s, "feature_id", "left")


def corners(annotations_: DataFrame) -> DataFrame:
    """image_id, id, xmin, ymin, xmax, ymax of annotations with a bbox [left, top, width, height]."""
    b = [F.col("bbox")[i] for i in range(4)]
    return annotations_.select("image_id", "id", b[0].alias("xmin"), b[1].alias("ymin"), (b[0] + b[2]).alias("xmax"), (b[1] + b[3]).alias("ymax"))


def mask(annotations_: DataFrame) -> DataFrame:
    """image_id, row, col of the pixels whose centre lies in any annotation of their image."""
    from gridloom.operators.metrics import mask_union, rasterise_ring

    flat = annotations_.select("image_id", F.explode("segmentation").alias("s"))
    point = lambda i: F.struct(F.element_at("s", 2 * i + 1).alias("x"), F.element_at("s", 2 * i + 2).alias("y"))
    rings = flat.filter(F.size("s") >= 6).select("image_id", F.transform(F.sequence(F.lit(0), (F.size("s") / 2).cast("int") - 1), point).alias("ring"))
    return mask_union(rasterise_ring(rings))


def write_tables(path: str, images_: DataFrame, annotations_: DataFrame) -> None:
    """The data set as JSON lines, a folder for each list: the form that scales."""
    images_.write.json(f"{path}/images")
    annotations_.drop("feature_id").write.json(f"{path}/annotations")
    annotations_.sparkSession.createDataFrame([(1, "tree", "tree")], "id int, name string, supercategory string").write.json(f"{path}/categories")


def documents(images_: DataFrame, annotations_: DataFrame) -> DataFrame:
    """One JSON text an image: the image, its annotations and the category. A document is bounded by its image."""
    a = annotations_.groupBy("image_id").agg(F.array_sort(F.collect_list(F.struct("id", "image_id", "category_id", "segmentation", "bbox"))).alias("annotations"))
    j = images_.join(a, images_["id"] == a["image_id"], "left").withColumn("annotations", F.coalesce("annotations", F.array().cast("array<struct<id:bigint,image_id:int,category_id:int,segmentation:array<array<double>>,bbox:array<double>>>")))
    category = F.array(F.struct(F.lit(1).alias("id"), F.lit("tree").alias("name"), F.lit("tree").alias("supercategory")))
    whole = F.struct(F.array(F.struct("id", "file_name", "width", "height")).alias("images"), F.col("annotations"), category.alias("categories"))
    return j.select(F.col("id").alias("image_id"), F.to_json(whole).alias("json"))


def read_annotations(json: DataFrame, column: str = "json") -> DataFrame:
    """The annotations of COCO texts: id, image_id, file_name, category_id, left, top, width, height."""
    d = json.select(F.from_json(column, SCHEMA).alias("d"))
    a = d.select(F.explode("d.annotations").alias("a"), F.col("d.images").alias("images"))
    name = F.element_at(F.filter("images", lambda i: i["id"] == F.col("a.image_id")), 1)["file_name"]
    return a.select(F.col("a.id").alias("id"), F.col("a.image_id").alias("image_id"), name.alias("file_name"), F.col("a.category_id").alias("category_id"), *[F.col("a.bbox")[i].alias(c) for i, c in enumerate(("left", "top", "width", "height"))])


def annotations_of(images_: DataFrame, annotations_: DataFrame) -> DataFrame:
    """Each image's annotations; images without any have none."""
    return images_.select(F.col("id").alias("image_id"), "file_name").join(annotations_, "image_id")
