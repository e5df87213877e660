"""Detections: suppression of overlapping boxes, and the slot for a model."""

from __future__ import annotations

import functools
import math
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.functions import geo
from gridloom.functions.shared import dense_ids, settle
from gridloom.operators import metrics, vector

#: Least score of a detection that becomes a feature, and the overlap that suppresses (fixed values).
LEAST_SCORE, OVERLAP = 0.98, 0.4
#: Boxes that suppression takes first, and how many times as many it has taken with the next ones.
FIRST, GROWTH = 32768, 4


_FOUR = ["xmin", "ymin", "xmax", "ymax"]


def _levelled(boxes: DataFrame) -> tuple[DataFrame, list[int]]:
    """Boxes with an area and the level of each, the power of two that is at least as large; the levels that occur."""
    side = F.greatest(F.col("xmax") - F.col("xmin"), F.col("ymax") - F.col("ymin"))
    b = boxes.filter((F.col("xmax") > F.col("xmin")) & (F.col("ymax") > F.col("ymin"))).withColumn("level", F.ceil(F.log2(side)).cast("int"))
    return b, sorted(r[0] for r in b.select("level").distinct().collect())  # powers of two, a few dozen


def _met(seek: DataFrame, own: DataFrame, known: list[int], up: int, threshold: float, hint: str | None = None) -> DataFrame:
    """Boxes of seek (as they are, with level and at) and those of own (o_id, o_gl_rank) that they overlap by more than threshold, on own's level at.

    A box belongs to the level whose cells are at least as large as it and touches at most four of them.
    It looks on its own level and on coarser ones, where its partner may live: IoU bounds how much longer
    one side may be. The cell that the overlap begins in reports the pair, so each comes once.
    """
    place = lambda v: F.floor(v / F.pow(F.lit(2.0), F.col("at"))).cast("long")
    names = ["id", "image_id", *_FOUR, "gl_rank"]

    def cells(d: DataFrame) -> DataFrame:
        d = d.withColumn("cx", F.explode(F.sequence(place(F.col("xmin")), place(F.col("xmax")))))
        return d.withColumn("cy", F.explode(F.sequence(place(F.col("ymin")), place(F.col("ymax")))))

    there = cells(own.withColumn("at", F.col("level"))).select("image_id", "at", "cx", "cy", *[F.col(c).alias(f"o_{c}") for c in names if c != "image_id"])
    levels = F.filter(F.array(*[F.lit(k) for k in known]), lambda k: (k >= F.col("level")) & (k <= F.col("level") + up))
    here = cells(seek.withColumn("at", F.explode(levels))).select("level", "at", "cx", "cy", *names)
    j = here.join(there.hint(hint) if hint else there, ["image_id", "at", "cx", "cy"])
    j = j.filter((F.col("cx") == place(F.greatest("xmin", "o_xmin"))) & (F.col("cy") == place(F.greatest("ymin", "o_ymin"))))
    return j.filter(metrics.box_iou([F.col(c) for c in _FOUR], [F.col(f"o_{c}") for c in _FOUR]) > threshold)


def _up(known: list[int], threshold: float) -> int:
    """How many levels up a partner may live."""
    return known[-1] - known[0] if threshold <= 0 else math.ceil(math.log2(1 / threshold)) + 1


def overlapping(boxes: DataFrame, threshold: float) -> DataFrame:
    """better, worse: ids of boxes (id, image_id, xmin .. ymax, gl_rank) of an image with an IoU above threshold."""
    b, known = _levelled(boxes)
    if not known:
        return boxes.select(F.col("id").alias("better"), F.col("id").alias("worse")).filter("false")
    j = _met(b, b, known, _up(known, threshold), threshold).filter((F.col("id") < F.col("o_id")) | (F.col("level") < F.col("at")) & (F.col("id") != F.col("o_id")))
    first = F.col("gl_rank") < F.col("o_gl_rank")
    return j.select(F.when(first, F.col("id")).otherwise(F.col("o_id")).alias("better"), F.when(first, F.col("o_id")).otherwise(F.col("id")).alias("worse"))


def overlapped(boxes: DataFrame, by: DataFrame, threshold: float) -> DataFrame:
    """id of the boxes (id, image_id, xmin .. ymax, gl_rank) that have an IoU above threshold with any of by (the same)."""
    (b, own), (k, its) = _levelled(boxes), _levelled(by)
    if not own or not its:
        return boxes.select("id").filter("false")
    up = _up(sorted({*own, *its}), threshold)
    low = _met(b, k, its, up, threshold, "merge").select("id")  # what is made of boxes is more than Spark reckons, too much to broadcast
    high = _met(k, b, own, up, threshold, "merge").filter("level < at").select(F.col("o_id").alias("id"))
    return low.unionByName(high).distinct()


def _best(boxes: DataFrame, threshold: float) -> DataFrame:
    """The boxes (id, image_id, xmin .. ymax, gl_rank) that suppression keeps, written.

    Rounds of joins settle the greedy order without bringing an image into one task: what no undecided
    better box overlaps stays, what it overlaps goes, and only pairs of undecided boxes are looked at
    again. There are as many rounds as the longest chain of boxes that wait for each other.
    """
    pairs = settle(overlapping(boxes, threshold), "overlaps")
    gone = []
    while not pairs.isEmpty():
        beaten = pairs.select(F.col("worse").alias("better")).distinct().withColumn("beaten", F.lit(True))
        r = pairs.join(beaten, "better", "left").withColumn("free", F.col("beaten").isNull()).drop("beaten")
        lost = r.filter("free").select("worse").distinct()
        known = r.join(lost.withColumn("worse_gone", F.lit(True)), "worse", "left").join(lost.select(F.col("worse").alias("better"), F.lit(True).alias("better_gone")), "better", "left")
        known = settle(known, "overlaps")  # one table a round: who goes, and what is still open
        gone.append(known.filter("free").select(F.col("worse").alias("id")).distinct())
        pairs = known.filter("worse_gone is null and better_gone is null").select("better", "worse")
    return settle(boxes.join(functools.reduce(DataFrame.unionByName, gone), "id", "left_anti") if gone else boxes, "kept")


def suppress(boxes: DataFrame, threshold: float = 0.4) -> DataFrame:
    """Non-maximum suppression by image: the best box stays, those above threshold IoU with a kept one go.

    Boxes are taken in the order of their ranks, FIRST of them and then GROWTH times as many as before:
    only better ones decide on a box, so what is kept of those taken is settled, and what it overlaps
    goes before it is paired with anything else. Kept boxes lie thin, so where boxes lie dense the work
    goes by their number and not by its square. Of equal boxes only the best takes part.

    Ties in score go to the smaller box_id; a null score is lower than any, a null box_id is behind all.
    Boxes without area or with a null coordinate overlap nothing and stay. An empty table stays empty.
    """
    names = boxes.columns
    b = settle(boxes.withColumn("gl_id", F.monotonically_increasing_id()), "boxes")
    score = F.coalesce(F.col("score").cast("double"), F.lit(float("-inf")))
    rank = F.struct((-score).alias("s"), F.col("box_id").isNull().alias("n"), F.col("box_id").alias("b"), F.col("gl_id").alias("i"))
    sides = {c: F.col(c).cast("double") for c in _FOUR}
    area = F.coalesce((sides["xmax"] > sides["xmin"]) & (sides["ymax"] > sides["ymin"]), F.lit(False))
    some = b.filter(area).select(F.col("gl_id").alias("id"), F.col("image_id"), *[v.alias(c) for c, v in sides.items()], rank.alias("gl_rank"))
    if threshold < 1:
        some = some.groupBy("image_id", *_FOUR).agg(F.min("gl_rank").alias("gl_rank")).withColumn("id", F.col("gl_rank.i"))
    # null images are one group, as for any grouping
    some = some.withColumn("image_id", F.struct(F.col("image_id").isNull().alias("none"), F.coalesce(F.col("image_id").cast("string"), F.lit("")).alias("name")))
    order = ["s", "n", "b", "i"]
    rest = settle(some.select("id", "image_id", *_FOUR, "gl_rank.*"), "distinct-boxes")
    n, upto, kept = rest.count(), FIRST, []
    if n > upto:
        rest = settle(dense_ids(rest, order, "gl_rank").drop(*order), "ranked-boxes")
    else:
        rest = rest.withColumn("gl_rank", F.struct(*order)).drop(*order)
    while n > upto:
        kept.append(_best(rest.filter(F.col("gl_rank") < upto), threshold))
        rest = rest.filter(F.col("gl_rank") >= upto)
        rest = settle(rest.join(overlapped(rest, kept[-1], threshold), "id", "left_anti"), "ranked-boxes")
        upto *= GROWTH
    kept.append(_best(rest, threshold))
    stay = functools.reduce(DataFrame.unionByName, [k.select(F.col("id").alias("gl_id")) for k in kept])
    return b.filter(area).join(stay, "gl_id", "left_semi").unionByName(b.filter(~area)).select(*names)


def infer(tiles: DataFrame, model: Callable[[], Callable[[pd.DataFrame], pd.DataFrame]], schema: str) -> DataFrame:
    """Rows of tiles through a model: model() is called once for each Python worker's partition, and what it returns once a batch."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        predict = model()
        for b in batches:
            yield predict(b)

    return tiles.mapInPandas(run, schema)


def cut_probability(masks: DataFrame, limit: float = 0.6) -> DataFrame:
    """Instance-mask pixels above limit, united over the instances of an image: image_id, row, col."""
    return masks.filter(F.col("prob") > limit).select("image_id", "row", "col").distinct()


def layer(boxes: DataFrame, meta: DataFrame, score: float = LEAST_SCORE, overlap: float = OVERLAP) -> DataFrame:
    """Detections in pixels as measured features in map units: those above score, suppressed, with class and sizes.

    meta has a row an image: image_id, xmin, ymin, xmax, ymax, width, height. Detections of an image
    without meta are left out.
    """
    names = ("xmin", "ymin", "xmax", "ymax", "width", "height")
    m = meta.select("image_id", *[F.col(c).alias(f"gl_{c}") for c in names])
    j = suppress(boxes.filter(F.col("score") > score), overlap).join(m, "image_id")
    extent = [F.col(f"gl_{c}") for c in names]
    (x0, y1), (x1, y0) = geo.to_map(F.col("xmin"), F.col("ymin"), *extent), geo.to_map(F.col("xmax"), F.col("ymax"), *extent)
    moved = j.withColumns({"xmin": x0, "ymin": y0, "xmax": x1, "ymax": y1}).select(*boxes.columns)
    return vector.measure_boxes(moved)
