"""Matching of images and scores of predicted masks and boxes."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType


def match_by_name(target: DataFrame, predicted: DataFrame, name: str = "file_name", key: str = "id") -> DataFrame:
    """target_id, predicted_id of images with equal names; of several predictions the first by id counts."""
    first = predicted.groupBy(name).agg(F.min(key).alias("predicted_id"))
    return target.select(F.col(name), F.col(key).alias("target_id")).join(first, name).select(name, "target_id", "predicted_id")


def rasterise_boxes(boxes: DataFrame) -> DataFrame:
    """image_id, row, col of every pixel of boxes with whole coordinates, once for each box."""
    rows = F.explode(F.sequence(F.col("ymin").cast("int"), F.col("ymax").cast("int") - 1))
    cols = F.explode(F.sequence(F.col("xmin").cast("int"), F.col("xmax").cast("int") - 1))
    some = boxes.filter((F.col("xmax") > F.col("xmin")) & (F.col("ymax") > F.col("ymin")))
    return some.withColumn("row", rows).withColumn("col", cols).drop("xmin", "ymin", "xmax", "ymax")


def rasterise_ring(rings: DataFrame, ring: str = "ring") -> DataFrame:
    """The pixels whose centre lies inside a ring by the even-odd rule, row by row."""
    ys = F.transform(ring, lambda p: p["y"])
    lines = rings.withColumn("row", F.explode(F.sequence(F.floor(F.array_min(ys)).cast("int"), F.ceil(F.array_max(ys)).cast("int"))))
    following = F.concat(F.slice(ring, 2, F.size(ring) - 1), F.slice(ring, 1, 1))
    y = F.col("row") + 0.5

    def crossing(p: Column, q: Column) -> Column:
        return F.when((p["y"] <= y) != (q["y"] <= y), p["x"] + (y - p["y"]) / (q["y"] - p["y"]) * (q["x"] - p["x"]))

    xs = F.array_sort(F.filter(F.zip_with(F.col(ring), following, crossing), lambda x: x.isNotNull()))
    spans = F.transform(F.sequence(F.lit(1), F.size("xs") - 1, F.lit(2)), lambda i: F.struct(F.ceil(F.element_at("xs", i) - 0.5).cast("int").alias("a"), (F.ceil(F.element_at("xs", i + 1) - 0.5) - 1).cast("int").alias("b")))
    s = lines.withColumn("xs", xs).filter(F.size("xs") > 1).withColumn("s", F.explode(spans)).filter("s.b >= s.a")
    return s.withColumn("col", F.explode(F.sequence(F.col("s.a"), F.col("s.b")))).drop("xs", "s", ring)


def mask_union(pixels: DataFrame) -> DataFrame:
    """The set of set pixels of an image."""
    return pixels.select("image_id", "row", "col").distinct()


def _ratios(tp: Column, fp: Column, fn: Column) -> dict[str, Column]:
    """Dice; recall in three names, as pixels with a background target are left out there; textbook precision."""
    recall = F.try_divide(tp, tp + fn)
    return {"dice": F.try_divide(2 * tp, 2 * tp + fp + fn), "precision_ref": recall, "recall_ref": recall, "accuracy_ref": recall, "precision_textbook": F.try_divide(tp, tp + fp)}


def scores(pixels: DataFrame, by: list[str], target: str = "target", predicted: str = "predicted") -> DataFrame:
    """TP, FP, FN and ratios by group of a table with two binary columns; ratios of nothing are null.

    A null or any value but 1 counts as unset; null groups are a group, an empty table gives no row.
    """
    t, p = F.coalesce(F.col(target), F.lit(0)) == 1, F.coalesce(F.col(predicted), F.lit(0)) == 1
    n = lambda c: F.sum(c.cast("long"))
    return pixels.groupBy(*by).agg(n(t & p).alias("tp"), n(~t & p).alias("fp"), n(t & ~p).alias("fn")).withColumns(_ratios(F.col("tp").cast("double"), F.col("fp"), F.col("fn")))


def mask_scores(target: DataFrame, predicted: DataFrame) -> DataFrame:
    """Scores by pred_set of sparse masks: target (image_id, row, col), predicted (pred_set, image_id, row, col).

    Images that a prediction set doesn't hold don't count.
    """
    t = mask_union(target)
    p = predicted.select("pred_set", "image_id", "row", "col").distinct()
    judged = p.select("pred_set", "image_id").distinct()
    t = t.join(judged, "image_id").withColumn("target", F.lit(1))
    both = t.join(p.withColumn("predicted", F.lit(1)), ["pred_set", "image_id", "row", "col"], "full_outer")
    known = both.join(target.select("image_id").distinct(), "image_id", "left_semi")
    return scores(known, ["pred_set"])


def box_mask_scores(target: DataFrame, predicted: DataFrame, side: int = 256) -> DataFrame:
    """mask_scores() of the masks that boxes with whole coordinates cover, without making their pixels.

    target (image_id, xmin, ymin, xmax, ymax), predicted (the same with pred_set). Boxes are cut by
    tiles of side pixels, and of each piece only the four corners go on, with which its coverage
    begins and ends. Corners are summed before they are shuffled, so a tile has at most one for each
    pixel, however many boxes there are; a task adds them up to the coverage of a tile at a time.
    Empty boxes cover nothing; an empty table gives no rows.
    """
    tile = ["image_id", "tr", "tc"]

    def corners(boxes: DataFrame, by: list[str], name: str) -> DataFrame:
        some = boxes.filter((F.col("xmax") > F.col("xmin")) & (F.col("ymax") > F.col("ymin"))).select(*by, *[F.col(c).cast("int").alias(c) for c in ("xmin", "ymin", "xmax", "ymax")])
        tiles = lambda lo, hi: F.explode(F.sequence(F.floor(F.col(lo) / side), F.floor((F.col(hi) - 1) / side)))
        pieces = some.withColumn("tr", tiles("ymin", "ymax")).withColumn("tc", tiles("xmin", "xmax"))
        local = lambda c, t: F.greatest(F.lit(0), F.least(F.lit(side), F.col(c) - F.col(t) * side)).cast("int")
        four = [F.struct(local(y, "tr").alias("r"), local(x, "tc").alias("c"), F.lit(d).alias("d")) for y, x, d in (("ymin", "xmin", 1), ("ymin", "xmax", -1), ("ymax", "xmin", -1), ("ymax", "xmax", 1))]
        return pieces.withColumn("e", F.explode(F.array(*four))).groupBy(*by, "tr", "tc", "e.r", "e.c").agg(F.sum("e.d").alias(name))

    t, p = corners(target, ["image_id"], "t"), corners(predicted, ["pred_set", "image_id"], "p")
    judged = predicted.select("pred_set", "image_id").distinct().join(target.select("image_id").distinct(), "image_id", "left_semi")
    both = t.join(judged, "image_id").select("pred_set", *tile, "r", "c", "t", F.lit(0).cast("long").alias("p"))
    both = both.unionByName(p.join(judged, ["pred_set", "image_id"], "left_semi").select("pred_set", *tile, "r", "c", F.lit(0).cast("long").alias("t"), "p"))
    schema = StructType([predicted.schema["pred_set"], *(StructField(c, LongType()) for c in ("tp", "fp", "fn"))])

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        covered = []
        for name in ("t", "p"):
            a = np.zeros((side + 1, side + 1), dtype=np.int64)
            np.add.at(a, (pdf["r"].to_numpy(), pdf["c"].to_numpy()), pdf[name].to_numpy())
            covered.append(a.cumsum(axis=0).cumsum(axis=1)[:side, :side] > 0)
        t, p = covered
        return pd.DataFrame({"pred_set": pdf["pred_set"].iloc[:1], "tp": [(t & p).sum()], "fp": [(p & ~t).sum()], "fn": [(t & ~p).sum()]})

    out = both.groupBy("pred_set", *tile).applyInPandas(one, schema).groupBy("pred_set").agg(*[F.sum(c).alias(c) for c in ("tp", "fp", "fn")])
    return out.withColumns(_ratios(F.col("tp").cast("double"), F.col("fp"), F.col("fn")))


def box_iou(a: list[Column], b: list[Column]) -> Column:
    """Intersection over union of two boxes (xmin, ymin, xmax, ymax); 0 where both are empty."""
    w = F.greatest(F.lit(0.0), F.least(a[2], b[2]) - F.greatest(a[0], b[0]))
    h = F.greatest(F.lit(0.0), F.least(a[3], b[3]) - F.greatest(a[1], b[1]))
    size = lambda x: (x[2] - x[0]) * (x[3] - x[1])
    return F.coalesce(F.try_divide(w * h, size(a) + size(b) - w * h), F.lit(0.0))
