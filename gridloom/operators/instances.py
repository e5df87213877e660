"""Instance segmentation: the slot for a model, and its masks as polygons.

A model gives an image's instances one by one (box, score, a mask of probabilities). A table function turns
each into a row whose mask is cut and stored as run lengths, so no image's masks are together in memory
and no pixel of them is shuffled. Suppression, rings and measures are those of ``detect`` and ``rings``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

import numpy as np
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult
from pyspark.sql.window import Window

from gridloom.functions.shared import settle
from gridloom.operators import detect, rings, runs

#: Probability above which a mask's pixel is set (fixed value).
CUT = 0.7
#: An image's instances: (xmin, ymin, xmax, ymax), score, mask (height x width); called once for each image's row.
Model = Callable[[Row], Iterable[tuple[tuple[float, float, float, float], float, np.ndarray]]]
FIELDS = "instance int, xmin double, ymin double, xmax double, ymax double, score double, height int, width int, counts array<bigint>"


def mask_counts(mask: np.ndarray) -> list[int]:
    """Run lengths of a mask column by column, beginning with the unset ones."""
    mask = np.asarray(mask, dtype=bool)
    cols, height = np.flatnonzero(mask.any(axis=0)), mask.shape[0]
    first, past = (cols[0], cols[-1] + 1) if len(cols) else (0, 0)  # the others are unset
    flat = np.concatenate(([False], mask[:, first:past].ravel(order="F"), [False]))
    ends = np.flatnonzero(flat[1:] != flat[:-1]) + first * height
    marks = ends[:-1] if len(ends) and ends[-1] == mask.size else ends
    return np.diff(np.concatenate(([0], marks, [mask.size]))).tolist()


def segment(images: DataFrame, model: Callable[[], Model], cut: float = CUT) -> DataFrame:
    """image_id and FIELDS of the instances that a model finds in images (image_id and what the model reads).

    model() is called once for each partition's worker. Instances are numbered from 0 in the order the
    model gives them; a mask's pixels above cut are set. An image without instances has no row, a null
    image_id stays null. An image too large for one row comes as several with a whole number part, and its
    instances are numbered on from part to part; part is none of the columns returned.
    """

    fields = StructType.fromDDL(FIELDS).fields  # parsed here: workers have no session
    keys = [c for c in ("image_id", "part") if c in images.columns]

    class Instances:
        def __init__(self) -> None:
            self.find = None

        @staticmethod
        def analyze(table: AnalyzeArgument) -> AnalyzeResult:
            kinds = {f.name: f.dataType for f in table.dataType.fields}
            if "image_id" not in kinds:
                raise ValueError("images need an image_id")
            own = [StructField(c, kinds[c]) for c in ("image_id", "part") if c in kinds]
            return AnalyzeResult(StructType([*own, *fields]))

        def eval(self, row: Row):
            if self.find is None:
                self.find = model()
            for k, (box, score, mask) in enumerate(self.find(row)):
                h, w = mask.shape
                yield (*[row[c] for c in keys], k, *map(float, box), float(score), h, w, mask_counts(mask > cut))

    found = F.udtf(Instances, useArrow=True)(images.asTable())
    if "part" not in keys:
        return found
    found = settle(found, "instance-parts")
    before = Window.partitionBy("image_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = found.groupBy("image_id", "part").agg(F.count("*").alias("n")).select(F.col("image_id").alias("gl_image"), F.col("part").alias("gl_part"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("gl_before"))
    j = found.join(sizes, F.col("image_id").eqNullSafe(F.col("gl_image")) & F.col("part").eqNullSafe(F.col("gl_part")))
    return j.withColumn("instance", (F.col("instance") + F.col("gl_before")).cast("int")).drop("part", "gl_image", "gl_part", "gl_before")


def polygons(instances: DataFrame, meta: DataFrame, overlap: float = detect.OVERLAP, side: int = rings.polygons.SIDE) -> DataFrame:
    """The kept instances of segment() as polygons in map units: ring_features() with image_id, instance and score.

    Of instances of an image whose boxes overlap by more than overlap the best stays; ties go to the smaller
    number. Gaps of a mask are filled; a mask in several pieces has a row for each, one without area
    none. meta: image_id, xmin, ymin, xmax, ymax, width, height, epsg; an image without meta has no row.
    """
    kept = settle(detect.suppress(instances.withColumn("box_id", F.col("instance").cast("long")), overlap).withColumn("raster_id", F.monotonically_increasing_id()), "instances")
    found = runs.coco_runs(kept.select("raster_id", "height", "counts"))  # runs of columns; as rows of the transposed mask
    px = runs.boxed(found.select("raster_id", F.col("col").alias("row"), "a", "b"), ["raster_id"])
    px = px.select("raster_id", F.col("col").cast("int").alias("row"), F.col("row").cast("int").alias("col"), "on")
    low = px.groupBy("raster_id").agg(F.min("row").alias("r0"), F.min("col").alias("c0"))  # the margin may lie left of the image
    at = px.join(low, "raster_id").select("raster_id", (F.col("row") - F.col("r0")).alias("row"), (F.col("col") - F.col("c0")).alias("col"), "on")
    moved = rings.polygonize_rings(at, side).join(low, "raster_id")
    back = F.transform("ring", lambda p: F.struct((p["x"] + F.col("c0")).alias("x"), (p["y"] + F.col("r0")).alias("y")))
    traced = moved.select("raster_id", back.alias("ring"), "hole")
    own = kept.select("raster_id", "image_id", "instance", "score")
    places = own.join(meta.select("image_id", "xmin", "ymin", "xmax", "ymax", "width", "height", "epsg"), "image_id").drop("instance", "score")
    return rings.ring_features(traced, places).join(own, "raster_id").drop("raster_id")
