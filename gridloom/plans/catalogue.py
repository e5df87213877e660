"""Registry of the raster, vector, tile, annotation and score queries."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.functions import geo, text
from gridloom.functions.shared import dense_ids, settle, shared_dir, spread
from gridloom.functions.tables import boxes, damaged_rings, load, mosaic, notched_rings, pixels, placed, plots, points, slanted_rings
from gridloom.operators import coco, detect, instances, metrics, overlay, polygons, raster, rings, runs, tiling, vector
from gridloom.plans import flows
from gridloom.plans.oracles import SQL
from gridloom.sources import files, geotiff, shapes

#: Side of the mosaic's tiles in the queries, grid divisions, and pixels of an exported tile.
SIDE, DIVISIONS, EXPORT = 16, 4, 256
#: Share of a raster's maximum that the object queries cut at.
PERCENT = 15.0
#: Boxes of an image that the stand-ins for models are given at a time.
PART = 256

Query = Callable[[SparkSession, str], DataFrame]
_queries: dict[str, Query] = {}


def query(f: Query) -> Query:
    _queries[f.__name__] = f
    return f


def _r(name: str, digits: int = 6):
    return F.round(name, digits).alias(name)


def _n(c, digits: int = 6):
    """c rounded, with halves that arithmetic may miss by an ulp pushed up."""
    return F.round(c + 1e-9, digits)


# --- rasters -----------------------------------------------------------------------------------


@query
def filter_area(spark, sf):
    p = load(spark, sf, "part").select("p_partkey", "p_retailprice")
    return vector.filter_by_area(p, 1000.0, "p_retailprice")


@query
def raster_global_threshold(spark, sf):
    m = raster.threshold_global(pixels(spark, sf), PERCENT)
    return m.groupBy("raster_id").agg(F.sum(F.col("mask") / 255).cast("long").alias("n_set"))


@query
def raster_tile_threshold(spark, sf):
    m = raster.threshold_tiles(pixels(spark, sf))
    n = m.groupBy("raster_id").agg(F.sum((F.col("mask") == 255).cast("long")).alias("n_set"))
    area = n.withColumn("area_m2", F.col("n_set").cast("double"))
    return vector.filter_by_area(area, 100.0)


@query
def raster_tile_threshold_mosaic(spark, sf):
    m = raster.threshold_tiles(mosaic(spark, sf), side=SIDE)
    return m.groupBy("tile_row", "tile_col").agg(F.sum((F.col("mask") == 255).cast("long")).alias("n_set"), F.max("tile_max").alias("tile_max"))


@query
def raster_grayscale_cast(spark, sf):
    b = pixels(spark, sf).select("raster_id", raster.to_byte(F.col("v") * 100).alias("b"))
    return b.groupBy("raster_id").agg(F.sum("b").alias("total"), F.max("b").alias("top"))


@query
def raster_band_stats(spark, sf):
    s = raster.band_statistics(pixels(spark, sf))
    return s.select("raster_id", "n", "v_min", "v_max", _r("v_mean"), _r("v_std"))


@query
def raster_tile_index(spark, sf):
    return raster.tile_windows(raster.dimensions(mosaic(spark, sf)), SIDE)


@query
def raster_within_budget(spark, sf):
    return raster.within_budget(raster.dimensions(mosaic(spark, sf)), SIDE)


def _mosaic_meta(px: DataFrame) -> DataFrame:
    d = raster.dimensions(px)
    return d.select("raster_id", F.lit(0.0).alias("xmin"), F.lit(0.0).alias("ymin"), F.col("width").cast("double").alias("xmax"), F.col("height").cast("double").alias("ymax"), "width", "height")


@query
def raster_extent_crop(spark, sf):
    px = mosaic(spark, sf)
    return raster.crop(px, _mosaic_meta(px), 10.0, 20.0, 30.0, 120.0).select("row", "col", "v")


@query
def minmax_normalize(spark, sf):
    return raster.stretch(pixels(spark, sf)).select("raster_id", "row", "col", _r("v255"))


def _bands(spark, sf):
    e = load(spark, sf, "embeddings")
    band = lambda i: F.least(F.lit(255), F.abs(F.floor(F.col("embedding")[i].cast("double") * 1000))).cast("int")
    return e.select("vec_id", band(0).alias("r"), band(1).alias("g"), band(2).alias("b"))


@query
def rgb_to_gray(spark, sf):
    return _bands(spark, sf).select("vec_id", raster.gray(F.col("r"), F.col("g"), F.col("b")).alias("gray"))


@query
def band_normalize(spark, sf):
    n = raster.normalise_bands(F.col("r"), F.col("g"), F.col("b"))
    return _bands(spark, sf).select("vec_id", *[F.round(c, 6).alias(x) for c, x in zip(n, "rgb", strict=True)])


@query
def bin_expectation(spark, sf):
    e = load(spark, sf, "embeddings")
    return e.select("vec_id", F.round(raster.expectation(F.flatten(F.array_repeat("embedding", 4))), 6).alias("height"))


@query
def raster_resample(spark, sf):
    px = pixels(spark, sf)
    return raster.resample(px, raster.dimensions(px), 0.5).select("raster_id", "row", "col", _r("v"))


@query
def raster_resample_up(spark, sf):
    px = pixels(spark, sf)
    return raster.resample(px, raster.dimensions(px), 1.5).select("raster_id", "row", "col", _r("v"))


@query
def band_conversions(spark, sf):
    b = raster.swap_bands(raster.without_alpha(_bands(spark, sf).withColumn("a", F.lit(255))))
    return b.select("vec_id", "r", "b", _unit("g"), raster.full_only(F.col("r")).alias("r_full"))


def _unit(name: str):
    return F.round(raster.unit(F.col(name)), 6).alias(f"{name}_unit")


@query
def raster_transpose(spark, sf):
    return raster.transpose(pixels(spark, sf)).select("raster_id", "row", "col", "v")


@query
def mae(spark, sf):
    a = load(spark, sf, "embeddings").select(F.col("embedding")[0].cast("double").alias("a"), F.col("embedding")[1].cast("double").alias("b"))
    return raster.mean_absolute_error(a, "a", "b").select(_r("mae"))


@query
def zonal_max(spark, sf):
    return raster.zonal_maximum(pixels(spark, sf)).select("zone", "v_max", _r("v_mean"), "n")


# --- geometry ----------------------------------------------------------------------------------


def _corner():
    return [F.lit(c) for c in (100.0, 50.0, 612.0, 306.0, 256, 256)]


@query
def pos_to_coords(spark, sf):
    x, y = geo.to_map(F.col("xmin"), F.col("ymin"), *_corner())
    return boxes(spark, sf).select("box_id", F.round(x, 6).alias("x"), F.round(y, 6).alias("y"))


@query
def coords_to_pos(spark, sf):
    c, r = geo.to_pixel(F.col("xmin") + 100, F.col("ymin") + 50, *_corner())
    return boxes(spark, sf).select("box_id", F.round(c, 6).alias("col"), F.round(r, 6).alias("row"))


@query
def pixel_resolution(spark, sf):
    w = F.col("xmax") - F.col("xmin")
    return boxes(spark, sf).select("box_id", F.round(geo.resolution(w, F.lit(256)), 3).alias("resolution"))


@query
def equiv_diameter(spark, sf):
    return vector.measure_boxes(boxes(spark, sf)).select("box_id", _r("a_diam_m"))


@query
def box_measures(spark, sf):
    m = vector.measure_boxes(boxes(spark, sf))
    return dense_ids(m, ["image_id", "box_id"]).select("id", "box_id", "class", "label", "area_m2", _r("a_diam_m"), "cx", "cy")


def _rings(b: DataFrame) -> DataFrame:
    return b.select("box_id", vector.ring_of_box(*[F.col(c) for c in ("xmin", "ymin", "xmax", "ymax")]).alias("ring"))


@query
def ring_shoelace(spark, sf):
    m = vector.measure_rings(_rings(boxes(spark, sf)))
    return m.select("box_id", "area_m2", "perim_m", _r("cx"), _r("cy"), _r("a_diam_m"))


@query
def box_envelope_centroid(spark, sf):
    m = vector.measure_rings(_rings(boxes(spark, sf)))
    return m.select("box_id", "xmin", "ymin", "xmax", "ymax", _r("cx"), _r("cy"))


@query
def ring_clip(spark, sf):
    c = vector.clip_ring(F.col("ring"), F.lit(40.0), F.lit(30.0), F.lit(160.0), F.lit(170.0))
    m = vector.measure_rings(_rings(boxes(spark, sf)).withColumn("ring", c).filter(F.size("ring") > 0))
    return m.filter("area_m2 > 0").select("box_id", "area_m2", "perim_m")


@query
def ring_measures_slanted(spark, sf):
    m = vector.measure_rings(slanted_rings(spark, sf))
    return m.select("box_id", *[_n(F.col(c)).alias(c) for c in ("area_m2", "perim_m", "cx", "cy")], "xmin", "ymin", "xmax", "ymax")


@query
def ring_clip_slanted(spark, sf):
    c = vector.clip_ring(F.col("ring"), F.lit(40.0), F.lit(30.0), F.lit(160.0), F.lit(170.0))
    m = vector.measure_rings(slanted_rings(spark, sf).withColumn("ring", c).filter(F.size("ring") > 0))
    return m.filter("area_m2 > 1e-9").select("box_id", *[_n(F.col(c)).alias(c) for c in ("area_m2", "xmax", "ymax")])


@query
def project_cea(spark, sf):
    x, y = geo.cea(F.col("lon"), F.col("lat"))
    return points(spark, sf).select("id", F.round(x, 3).alias("x"), F.round(y, 3).alias("y"))


@query
def project_local_cea(spark, sf):
    x, y = geo.local_cea(F.col("lon"), F.col("lat"), 12.5)
    return points(spark, sf).select("id", F.round(x, 3).alias("x"), F.round(y, 3).alias("y"))


@query
def project_mercator_inverse(spark, sf):
    x, y = geo.mercator(F.col("lon"), F.col("lat"))
    lon, lat = geo.unmercator(x, y)
    return points(spark, sf).select("id", F.round(x, 3).alias("x"), F.round(y, 3).alias("y"), F.round(lon, 6).alias("lon"), F.round(lat, 6).alias("lat"))


@query
def project_cea_inverse(spark, sf):
    x, y = F.col("c_custkey") * 7919 % 34000 * 1000.0 - 17e6, F.col("c_custkey") * 104729 % 14000 * 1000.0 - 7e6
    lon, lat = geo.uncea(x, y)
    return load(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.round(lon, 6).alias("lon"), F.round(lat, 6).alias("lat"))


@query
def reproject_boxes(spark, sf):
    p = points(spark, sf).select(F.col("id").alias("raster_id"), F.col("lon").alias("xmin"), F.col("lat").alias("ymin"), (F.col("lon") + 0.5).alias("xmax"), (F.col("lat") + 0.25).alias("ymax"), F.lit(4326).alias("epsg"))
    b = raster.bounding_boxes(p, 3857).withColumn("epsg", F.lit(3857))
    return raster.bounding_boxes(b, 6933).select("raster_id", *[_r(c, 3) for c in ("xmin", "ymin", "xmax", "ymax")])


@query
def reproject_rings(spark, sf):
    r = _rings(boxes(spark, sf).withColumns({"ymin": F.col("ymin") / 4, "ymax": F.col("ymax") / 4}))
    m = vector.measure_rings(r.withColumn("ring", vector.reproject_ring(F.col("ring"), 4326, 6933)))
    return m.select("box_id", F.round(F.col("area_m2") / 1e6, 3).alias("area_km2"), _r("xmin", 3), _r("ymax", 3))


@query
def raster_crop_reprojected(spark, sf):
    px = mosaic(spark, sf)
    meta = _mosaic_meta(px).withColumns({"xmax": F.col("width") * 10.0, "ymax": F.col("height") * 10.0, "epsg": F.lit(3857)})
    return raster.crop_reprojected(px, meta, (0.001, 0.002, 0.004, 0.03), 4326).select("row", "col", "v")


@query
def total_bounds(spark, sf):
    return vector.total_bounds(points(spark, sf), "lon", "lat")


# --- tiles and annotations ---------------------------------------------------------------------


@query
def tile_grid(spark, sf):
    g = tiling.grid(vector.total_bounds(points(spark, sf), "lon", "lat"), DIVISIONS)
    return g.select("tile_id", *[_r(c) for c in ("xmin", "ymin", "xmax", "ymax")])


def _box_bounds(b: DataFrame) -> DataFrame:
    return b.agg(F.min("xmin").alias("xmin"), F.min("ymin").alias("ymin"), F.max("xmax").alias("xmax"), F.max("ymax").alias("ymax"))


def _pieces(spark, sf):
    b = boxes(spark, sf)
    return tiling.overlay_boxes(b, _box_bounds(b), DIVISIONS)


@query
def tile_overlay_box(spark, sf):
    return _pieces(spark, sf).select("tile_id", "box_id", "image_id", *[_r(c) for c in ("xmin", "ymin", "xmax", "ymax")])


def _ring_pieces(spark, sf):
    return tiling.overlay_rings(notched_rings(spark, sf), _box_bounds(boxes(spark, sf)), DIVISIONS)


@query
def tile_overlay_ring(spark, sf):
    return _ring_pieces(spark, sf).select("tile_id", "box_id", F.size("parts").alias("n_parts"), _n(vector.parts_area(F.col("parts"))).alias("area"), *[_n(F.col(c)).alias(c) for c in ("xmin", "ymin", "xmax", "ymax")])


@query
def tile_clip_pixels(spark, sf):
    px = mosaic(spark, sf)
    last = load(spark, sf, "embeddings").agg(F.max("vec_id")).first()[0]  # null of no rows
    t = tiling.clip_pixels(px, 1 if last is None else last + 1, 64, DIVISIONS)
    return t.groupBy("tile_id").agg(F.count("*").alias("n"), F.max("tile_row").alias("last_row"), F.max("tile_col").alias("last_col"), F.max("v").alias("v_max"))


@query
def rasterize_boxes(spark, sf):
    return metrics.rasterise_boxes(boxes(spark, sf)).groupBy("image_id").agg(F.count("*").alias("n"), F.sum("row").alias("rows"), F.sum("col").alias("cols"))


@query
def rasterize_rings(spark, sf):
    k = F.col("box_id")
    p = lambda x, y: F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))
    tri = F.array(p(k % 7, k % 5), p(k % 7 + 6 + k % 11, k % 5 + 1), p(k % 7 + 2, k % 5 + 5 + k % 13))
    r = metrics.rasterise_ring(boxes(spark, sf).select("box_id", tri.alias("ring")))
    return r.groupBy("box_id").agg(F.count("*").alias("n"), F.sum("row").alias("rows"), F.sum("col").alias("cols"))


@query
def mask_union(spark, sf):
    u = runs.combine(runs.box_runs(boxes(spark, sf)).select("image_id", "row", "a", "b"), ["image_id", "row"])
    return runs.pixels_of(u).groupBy("image_id").agg(F.count("*").alias("n"))


@query
def coco_images(spark, sf):
    i = coco.images(tiling.grid(_box_bounds(boxes(spark, sf)), DIVISIONS), EXPORT, EXPORT)
    n = _pieces(spark, sf).groupBy((F.col("tile_id") + 1).alias("id")).agg(F.count("*").alias("n_features"), F.countDistinct("image_id").alias("n_sources"))
    none = F.lit(0).cast("long")
    return i.join(n, "id", "left").select(*i.columns, F.coalesce("n_features", none).alias("n_features"), F.coalesce("n_sources", none).alias("n_sources"))


def _annotations(spark, sf):
    return coco.annotations(_pieces(spark, sf), EXPORT, EXPORT)


@query
def coco_annotations(spark, sf):
    a = _annotations(spark, sf)
    ring = F.flatten("segmentation")
    return a.select("id", "image_id", "feature_id", "category_id", *[F.round(F.col("bbox")[i], 6).alias(c) for i, c in enumerate(("left", "top", "width", "height"))], F.size(ring).alias("n_numbers"), F.round(F.aggregate(ring, F.lit(0.0), lambda x, y: x + y), 6).alias("ring_sum"))


@query
def coco_json_roundtrip(spark, sf):
    images = coco.images(tiling.grid(_box_bounds(boxes(spark, sf)), DIVISIONS), EXPORT, EXPORT)
    back = coco.read_annotations(coco.documents(images, _annotations(spark, sf)))
    return back.select("id", "image_id", "file_name", "category_id", *[_r(c) for c in ("left", "top", "width", "height")])


@query
def coco_annotations_ring(spark, sf):
    a = coco.ring_annotations(_ring_pieces(spark, sf), EXPORT, EXPORT)
    return a.select("id", "image_id", "feature_id", *[_n(F.col("bbox")[i]).alias(c) for i, c in enumerate(("left", "top", "width", "height"))], F.size("segmentation").alias("n_parts"))


#: Pixels of a tile in the queries that make masks.
MASKED = 32


@query
def coco_mask(spark, sf):
    m = coco.mask(coco.annotations(_pieces(spark, sf), MASKED, MASKED))
    return m.groupBy("image_id").agg(F.count("*").alias("n"), F.sum("row").alias("rows"), F.sum("col").alias("cols"))


@query
def coco_results(spark, sf):
    r = coco.with_scores(_annotations(spark, sf), boxes(spark, sf))
    c = coco.corners(r)
    return r.join(c, ["id", "image_id"]).select("id", "image_id", "feature_id", _r("score"), *[_r(x) for x in ("xmin", "ymin", "xmax", "ymax")])


# --- sources and sinks -------------------------------------------------------------------------


def _scratch(spark, name: str) -> str:
    return f"{shared_dir(spark)}/gridloom/{name}-{uuid.uuid4().hex}"


@query
def layers_roundtrip(spark, sf):
    path = _scratch(spark, "layers")
    f = vector.measure_rings(_rings(boxes(spark, sf)))
    names = files.register(spark, files.write_layers(f, path, "trees"))
    layers = [spark.table(n).agg(F.lit(n).alias("layer"), F.count("*").alias("n"), F.sum("area_m2").alias("area_m2")) for n in names]
    return layers[0].unionByName(layers[1]).unionByName(layers[2])


@query
def filtered_layer_roundtrip(spark, sf):
    path = _scratch(spark, "filtered")
    vector.measure_boxes(boxes(spark, sf)).write.parquet(f"{path}/all")
    files.filter_layer(spark, f"{path}/all", f"{path}/small", 400.0)
    return spark.read.parquet(f"{path}/small").select("box_id", "area_m2")


@query
def raster_roundtrip(spark, sf):
    px, path = mosaic(spark, sf), _scratch(spark, "raster")
    files.write_raster(px, path, SIDE, _mosaic_meta(px).withColumn("epsg", F.lit(3857)))
    meta = spark.read.parquet(f"{path}_meta")
    part = files.read_raster(spark, path, (20, 130), (10, 40), SIDE)
    return part.join(meta.select("raster_id", "height", "epsg"), "raster_id").select("row", "col", "v", "height", "epsg")


@query
def geotiff_roundtrip(spark, sf):
    path = _scratch(spark, "geotiff")
    geotiff.write(geotiff.encode_rasters(pixels(spark, sf), placed(spark, sf), dtype="float64"), path, "raster_")
    px, meta = geotiff.read(spark, path), geotiff.metadata(spark, path)
    s = px.groupBy("file").agg(F.count("v").alias("n"), F.max("v").alias("v_max"), F.round(F.sum(F.col("v") * (F.col("row") * 8 + F.col("col"))), 6).alias("placed"))
    return meta.join(s, "file").select("file", "height", "width", "count", "epsg", *[_r(c, 5) for c in ("xmin", "ymin", "xmax", "ymax")], "n", "v_max", "placed")


@query
def mask_folder_roundtrip(spark, sf):
    path = _scratch(spark, "masks")
    three = pixels(spark, sf).withColumn("b", F.when(F.col("v") > 0, 255).otherwise(254)).select("raster_id", "row", "col", F.col("b").alias("r"), F.col("b").alias("g"), "b")
    geotiff.write(geotiff.encode_rasters(three, placed(spark, sf), ("r", "g", "b"), "uint8"), path, "mask_")
    m = geotiff.read(spark, path, ("r", "g", "b")).withColumn("on", raster.full_only(raster.gray(F.col("r"), F.col("g"), F.col("b"))))
    return m.groupBy("file").agg(F.sum("on").alias("n_on"))


@query
def shapefile_roundtrip(spark, sf):
    path = _scratch(spark, "shapes")
    f = vector.measure_rings(slanted_rings(spark, sf)).withColumn("odd", F.col("box_id") % 2 == 1)
    for kind, ending in files.LAYERS.items():
        shapes.write(f, path, f"trees{ending}", kind, 3857)
    back = shapes.read(spark, path)
    layer = F.regexp_extract("file", "_vector([a-z_]*?)(_[0-9]+)?[.]shp$", 1)
    x0, y0, x1, y1 = vector.envelope(F.flatten("parts"))
    return back.select(F.concat(F.lit("layer"), layer).alias("layer"), "box_id", "class", "odd", *[_n(F.col(c)).alias(c) for c in ("area_m2", "perim_m")], *[_n(c).alias(n) for n, c in (("xmin", x0), ("ymin", y0), ("xmax", x1), ("ymax", y1))], F.size(F.flatten("parts")).alias("n_points"))


@query
def polygon_layer(spark, sf):
    path = _scratch(spark, "polygons")
    r = rings.ring_features(rings.polygonize_rings(_mask(spark, sf)), _unit_meta(spark, sf))
    shapes.write(r.select("id", "raster_id", "class", "ring"), path, "trees_vector", epsg=6933)
    p = shapes.as_polygons(shapes.read(spark, path))
    return p.select("raster_id", F.size("ring").alias("n_points"), _n(vector.ring_area(F.col("ring")), 3).alias("area"), _n(vector.ring_perimeter(F.col("ring")), 3).alias("perimeter"))


def _unit_meta(spark, sf):
    """Every raster as 8 x 8 units of an equal-area system."""
    e = load(spark, sf, "embeddings").select(F.col("vec_id").alias("raster_id"))
    return e.select("raster_id", F.lit(0.0).alias("xmin"), F.lit(0.0).alias("ymin"), F.lit(8.0).alias("xmax"), F.lit(8.0).alias("ymax"), F.lit(8).alias("width"), F.lit(8).alias("height"), F.lit(6933).alias("epsg"))


@query
def raster_window_read(spark, sf):
    path, px = _scratch(spark, "window"), mosaic(spark, sf)
    meta = _mosaic_meta(px).withColumn("epsg", F.lit(3857))
    geotiff.write(geotiff.encode_rasters(px.withColumn("v", F.floor(F.col("v") * 1000)), meta, dtype="int16", how=geotiff.LZW, predictor=geotiff.HORIZONTAL), path)
    w = geotiff.read(spark, path, rows=(100, 399), cols=(5, 40))
    return w.select("row", "col", F.col("v").cast("int").alias("v"))


@query
def png_folder_roundtrip(spark, sf):
    path = _scratch(spark, "png")
    three = pixels(spark, sf).withColumns({"r": F.abs(F.floor("v")) * 40 % 256, "g": F.floor(F.abs("v") * 100) % 256, "b": F.col("col") * 30})
    geotiff.write(geotiff.encode_png(three, ("r", "g", "b")), path, "image_", ".png")
    g = geotiff.read(spark, path, ("r", "g", "b"), ".png")
    s = [F.sum(F.col(c) * (F.col("row") * 8 + F.col("col"))).cast("long").alias(c) for c in "rgb"]
    return geotiff.metadata(spark, path).select("file", "height", "width", "count").join(g.groupBy("file").agg(*s), "file")


@query
def export_dataset(spark, sf):
    path, px = _scratch(spark, "export"), mosaic(spark, sf)
    meta = _mosaic_meta(px).withColumns({"xmax": F.lit(256.0), "ymax": F.lit(256.0), "epsg": F.lit(3857)})
    flows.export_dataset(path, px, meta, notched_rings(spark, sf), DIVISIONS)
    a = spark.read.schema("image_id bigint").json(f"{path}/annotations/annotations").groupBy("image_id").agg(F.count("*").alias("n_annotations"))
    i = spark.read.json(f"{path}/annotations/images").join(geotiff.metadata(spark, f"{path}/images").select("file", F.col("xmin"), F.col("ymax"), F.col("height").alias("file_height")), F.col("file_name") == F.col("file"))
    s = geotiff.read(spark, f"{path}/images").groupBy("file").agg(F.round(F.max("v"), 5).alias("v_max"))
    return i.join(a, i["id"] == a["image_id"]).join(s, "file").select("image_id", "file_name", "width", "height", "file_height", "xmin", "ymax", "n_annotations", "v_max")


# --- matching and scores -----------------------------------------------------------------------


def _images(spark, sf, table):
    return load(spark, sf, table).select(F.col("doc_id").alias("id"), F.concat(F.lit("tile_"), "doc_id", F.lit(".tif")).alias("file_name"))


@query
def match_by_file_name(spark, sf):
    p = _images(spark, sf, "labels")
    return metrics.match_by_name(_images(spark, sf, "documents"), p.unionByName(p.withColumn("id", F.col("id") + 1_000_000)))


@query
def image_annotation_lookup(spark, sf):
    images = spark.range(20).select(F.col("id").cast("int").alias("id"), F.concat(F.lit("tile_"), "id", F.lit(".tif")).alias("file_name"))
    a = coco.annotations_of(images, boxes(spark, sf))
    return a.groupBy("image_id", "file_name").agg(F.count("*").alias("n"), F.min("box_id").alias("first_box"))


@query
def segmentation_scores(spark, sf):
    m = load(spark, sf, "labels").select((F.col("doc_id") % 4).alias("pred_set"), F.col("quality").alias("target"), F.col("toxic").alias("predicted"))
    s = metrics.scores(m, ["pred_set"])
    return s.select("pred_set", "tp", "fp", "fn", *[_r(c) for c in ("dice", "precision_ref", "recall_ref", "accuracy_ref", "precision_textbook")])


@query
def segmentation_scores_pixels(spark, sf):
    p = boxes(spark, sf, True).withColumn("pred_set", F.lit("shifted"))
    q = boxes(spark, sf).withColumns({"ymin": F.col("ymin") + 3, "ymax": F.col("ymax") + 3, "pred_set": F.lit("lowered")})
    s = metrics.box_mask_scores(boxes(spark, sf), p.unionByName(q))
    return s.select("pred_set", "tp", "fp", "fn", *[_r(c) for c in ("dice", "precision_ref", "recall_ref", "accuracy_ref", "precision_textbook")])


def _ring_masks(spark, sf):
    """Targets and two sets of predictions, as rings in arrays: image_id, rings; the predictions with pred_set."""
    t = slanted_rings(spark, sf).join(boxes(spark, sf).select("box_id", "image_id"), "box_id")
    moved = lambda dx, dy: F.transform("ring", lambda p: F.struct((p["x"] + dx).alias("x"), (p["y"] + dy).alias("y")))
    sets = F.explode(F.array(F.struct(F.lit("shifted").alias("s"), moved(F.col("box_id") % 5 - 2, 0.25).alias("r")), F.struct(F.lit("lowered").alias("s"), moved(0.0, 3.0).alias("r"))))
    p = t.withColumn("m", sets).select("image_id", F.col("m.s").alias("pred_set"), F.array("m.r").alias("rings"))
    return t.select("image_id", F.array("ring").alias("rings")), p


@query
def mask_scores_rings(spark, sf):
    t, p = _ring_masks(spark, sf)
    s = runs.step_scores(settle(runs.score_steps(runs.ring_runs(t)), "steps"), settle(runs.score_steps(runs.ring_runs(p), ["pred_set"]), "steps"))
    return s.select("pred_set", "tp", "fp", "fn", *[_r(c) for c in ("dice", "precision_ref", "recall_ref", "accuracy_ref", "precision_textbook")])


@query
def mask_runs(spark, sf):
    keys = ["image_id", "row"]
    t = settle(runs.cover(runs.ring_runs(_ring_masks(spark, sf)[0]), keys), "cover")
    u, twice = (runs.combined(t, keys, k).groupBy("image_id").agg(F.sum(F.col("b") - F.col("a")).alias(n), F.count("*").alias(f"{n}_runs")) for k, n in ((1, "any"), (2, "two")))
    return u.join(twice, "image_id", "left").select("image_id", "any", "any_runs", F.coalesce("two", F.lit(0).cast("long")).alias("two"))


@query
def coco_rle_roundtrip(spark, sf):
    t = runs.ring_runs(_ring_masks(spark, sf)[0], by="col")
    sizes = t.select("image_id").distinct().withColumns({"height": F.lit(256), "width": F.lit(256)})
    packed = runs.coco_counts(t, sizes, ["image_id"]).withColumn("packed", runs.pack_counts(F.col("counts"))).drop("counts")
    back = runs.coco_runs(packed.withColumn("counts", runs.unpack_counts(F.col("packed"))))
    each = back.groupBy("image_id").agg(F.sum(F.col("b") - F.col("a")).alias("n"), F.sum(F.col("col") * (F.col("b") - F.col("a"))).alias("cols"), F.sum((F.col("a") + F.col("b") - 1) * (F.col("b") - F.col("a")) / 2).cast("long").alias("rows"))
    return each.select("image_id", "n", "rows", "cols")


def _zones(spark, sf):
    """Frames with a gap on the mosaic, from boxes: raster_id, zone_id, rings."""
    e, k = boxes(spark, sf), F.col("box_id")
    p = lambda x, y: F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))
    x, y, w = k * 7 % 50, k * 31 % 480, 6 + k % 9
    ring = lambda d: F.array(p(x + d, y + d), p(x + w - d, y + d), p(x + w - d, y + w - d), p(x + d, y + w - d))
    return e.select(F.lit(0).cast("long").alias("raster_id"), k.alias("zone_id"), F.array(ring(0), ring(2)).alias("rings"))


@query
def zonal_polygons(spark, sf):
    return runs.zonal_polygons(mosaic(spark, sf), _zones(spark, sf)).select("zone_id", "n", "v_min", "v_max", _r("v_mean"))


@query
def raster_crop_polygon(spark, sf):
    return runs.raster_crop_polygon(mosaic(spark, sf), _zones(spark, sf).filter("zone_id % 10 = 1")).select("row", "col", "v")


@query
def box_iou(spark, sf):
    a, b = boxes(spark, sf), boxes(spark, sf, True).withColumnsRenamed({c: f"p_{c}" for c in ("image_id", "xmin", "ymin", "xmax", "ymax", "score")})
    names = ("xmin", "ymin", "xmax", "ymax")
    iou = metrics.box_iou([F.col(c) for c in names], [F.col(f"p_{c}") for c in names])
    return a.join(b, "box_id").select("box_id", F.round(iou, 6).alias("iou"))


@query
def nms_boxes(spark, sf):
    return detect.suppress(boxes(spark, sf), 0.2).select("image_id", "box_id", "score")


@query
def detections_layer(spark, sf):
    meta = spark.range(20).select(F.col("id").cast("int").alias("image_id"), (F.col("id") * 1000.0).alias("xmin"), F.lit(500.0).alias("ymin"), (F.col("id") * 1000.0 + 512).alias("xmax"), F.lit(628.0).alias("ymax"), F.lit(256).alias("width"), F.lit(256).alias("height"))
    d = detect.layer(boxes(spark, sf), meta, 0.905, 0.2)
    return d.select("box_id", "class", _r("area_m2"), *[_r(c) for c in ("xmin", "ymin", "xmax", "ymax", "cx", "cy")])


def _segmenter():
    """A stand-in for weights: every box of the image's row, with a last column that is too unlikely."""
    import numpy as np

    def find(row):
        for b in row["boxes"]:
            mask = np.zeros((300, 300), dtype=np.float32)
            y0, y1, x0, x1 = int(b["ymin"]), int(b["ymax"]), int(b["xmin"]), int(b["xmax"])
            mask[y0:y1, x0:x1] = 0.95
            mask[y0:y1, x1] = 0.65
            yield (b["xmin"], b["ymin"], b["xmax"], b["ymax"]), b["score"], mask

    return find


def _image_rows(spark, sf):
    """The boxes of an image in rows of PART at most, by box_id: image_id, part, boxes."""
    listed = F.array_sort(F.collect_list(F.struct("box_id", "xmin", "ymin", "xmax", "ymax", "score")))
    part = F.floor(F.col("box_id") / (20 * PART)).alias("part")  # every twentieth number is of an image
    return spread(boxes(spark, sf).groupBy("image_id", part).agg(listed.alias("boxes")))


def _image_meta(spark, sf):
    x = F.col("image_id") * 1000.0
    return boxes(spark, sf).select("image_id").distinct().select("image_id", x.alias("xmin"), F.lit(500.0).alias("ymin"), (x + 600).alias("xmax"), F.lit(1100.0).alias("ymax"), F.lit(300).alias("width"), F.lit(300).alias("height"), F.lit(6933).alias("epsg"))


@query
def instance_polygons(spark, sf):
    found = instances.segment(_image_rows(spark, sf), _segmenter)
    p = instances.polygons(found, _image_meta(spark, sf), 0.2)
    return p.select("image_id", "instance", _r("score"), F.size("ring").alias("n_points"), *[_n(F.col(c), 3).alias(c) for c in ("xmin", "ymin", "xmax", "ymax")])


def _detector():
    """A stand-in for weights: the boxes of the images' rows, their numbers above zero."""
    import pandas as pd

    names = ["image_id", "box_id", "xmin", "ymin", "xmax", "ymax", "score"]
    return lambda b: pd.DataFrame([(i, *(x[c] for c in names[1:])) for i, found in zip(b["image_id"], b["boxes"], strict=True) for x in found], columns=names)


@query
def detect_objects(spark, sf):
    path = _scratch(spark, "detected")
    written = flows.detect_objects(_image_rows(spark, sf), _detector, _image_meta(spark, sf), path, "crowns", ("bounding_boxes", "centroids"), 0.905)
    b, c = (spark.read.parquet(p) for p in written)
    return b.join(c.select("box_id", "cx", "cy"), "box_id").select("box_id", "class", _r("area_m2"), *[_r(x) for x in ("xmin", "ymin", "xmax", "ymax", "cx", "cy")])


@query
def binary_rasters(spark, sf):
    path = _scratch(spark, "binary")
    flows.binary_rasters(pixels(spark, sf), placed(spark, sf), path, PERCENT)
    listed = files.read_mask_list(spark, path, ".tif").select("id", "file_name")
    n = geotiff.read(spark, path, ending=".tif").groupBy("file").agg(F.sum((F.col("v") == 255).cast("long")).alias("n_set"), F.count("*").alias("n"))
    return listed.join(n, listed["file_name"] == n["file"]).select("id", "file_name", "n_set", "n")


@query
def probability_cut(spark, sf):
    m = pixels(spark, sf).select(F.col("zone").alias("image_id"), "row", "col", (F.abs("v") * 2).alias("prob"))
    return detect.cut_probability(m).groupBy("image_id").agg(F.count("*").alias("n"))


# --- objects -----------------------------------------------------------------------------------


def _mask(spark, sf):
    return raster.threshold_global(pixels(spark, sf), PERCENT).select("raster_id", "row", "col", (F.col("mask") > 0).alias("on"))


@query
def mask_components(spark, sf):
    c = polygons.pixel_components(_mask(spark, sf).filter("on").select("raster_id", "row", "col"))
    return c.groupBy("raster_id", "lrow", "lcol").agg(F.count("*").alias("n"))


@query
def fill_holes(spark, sf):
    return polygons.fill_holes(_mask(spark, sf)).groupBy("raster_id").agg(F.count("*").alias("n"))


@query
def polygonize_measures(spark, sf):
    f = polygons.features(polygons.polygonize(_mask(spark, sf)))
    return f.select("id", "raster_id", "n_cells", "area_m2", _r("perim_m"), _r("a_diam_m"), "xmin", "ymin", "xmax", "ymax", _r("cx"), _r("cy"))


def _told(r: DataFrame, *names: str) -> DataFrame:
    ring = F.col("ring")
    return r.select(*names, F.size(ring).alias("n_points"), vector.ring_area(ring).alias("area"), F.round(vector.ring_perimeter(ring), 6).alias("perimeter"), rings.wkt(ring).alias("wkt"))


@query
def polygonize_rings(spark, sf):
    return _told(rings.polygonize_rings(_mask(spark, sf)), "raster_id")


@query
def polygonize_rings_mosaic(spark, sf):
    on = raster.threshold_global(mosaic(spark, sf), PERCENT).select("raster_id", "row", "col", (F.col("mask") > 0).alias("on"))
    return _told(rings.polygonize_rings(on, SIDE))


@query
def dissolve_boxes(spark, sf):
    d = overlay.dissolve(plots(spark, sf).withColumnRenamed("image_id", "raster_id"))
    x0, y0, x1, y1 = vector.envelope(F.col("ring"))
    around = vector.ring_perimeter(F.col("ring")) + F.aggregate("holes", F.lit(0.0), lambda a, r: a + vector.ring_perimeter(r))
    return d.select(F.col("raster_id").alias("image_id"), *[F.round(c, 3).alias(n) for n, c in (("area", F.col("area")), ("perimeter", around), ("xmin", x0), ("ymin", y0), ("xmax", x1), ("ymax", y1))])


@query
def repair_rings(spark, sf):
    r = damaged_rings(spark, sf).withColumn("parts", overlay.repair_parts(F.col("ring")))
    r = r.withColumn("single", overlay.single_parts(F.col("parts")))
    signed = F.aggregate("parts", F.lit(0.0), lambda a, p: a + vector.ring_signed_area(p))
    return r.select("box_id", F.size("parts").alias("n_parts"), F.size("single").alias("n_single"), F.size(F.flatten("parts")).alias("n_points"), F.round(signed, 6).alias("area"))


@query
def raster_to_vector(spark, sf):
    f = flows.raster_to_vector(pixels(spark, sf), placed(spark, sf), PERCENT)
    return f.select("raster_id", "n_cells", *[_r(c, 3) for c in ("area_m2", "perim_m", "a_diam_m")], *[_r(c, 5) for c in ("xmin", "ymin", "xmax", "ymax")])


# --- text --------------------------------------------------------------------------------------


@query
def regex_percent(spark, sf):
    e = load(spark, sf, "events").select("event_id", F.concat(F.lit("step at "), F.regexp_extract("props", r"(\d+)", 1), F.lit(".7% done")).alias("m"))
    return e.select("event_id", text.percent(F.col("m")).alias("percent"))


@query
def outputs_distinct(spark, sf):
    p = load(spark, sf, "part").select(F.concat(F.lit("/out/"), "p_brand").alias("path"))
    return files.append_outputs(p, load(spark, sf, "part").select(F.concat(F.lit("/out/"), F.lower("p_brand")).alias("path")))


@query
def output_names(spark, sf):
    p = load(spark, sf, "part").select("p_partkey", F.concat(F.lit("/out/"), F.replace("p_brand", F.lit("#"), F.lit("_")), F.lit("_"), "p_partkey", F.lit(".shp")).alias("path"), F.concat(F.lit("EPSG:"), F.col("p_partkey") % 9000).alias("crs"))
    c = F.col("path")
    return p.select("p_partkey", text.basename(c).alias("file"), text.stem(c).alias("stem"), text.sibling(c, "_bb").alias("bb"), text.epsg_number(F.col("crs")).alias("epsg"), F.contains(c, F.lit(".shp")).alias("is_vector"))


def queries() -> dict[str, Query]:
    return dict(_queries)


def oracle_sql() -> dict[str, str]:
    return {k: v for k, v in SQL.items() if k in _queries}
