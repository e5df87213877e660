"""What runs on unbounded input: filters and measures as they are, scores by watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.operators import metrics, vector


def measured(boxes: DataFrame, limit: float) -> DataFrame:
    """Detector boxes of a stream, measured and filtered by area: no state."""
    return vector.filter_by_area(vector.measure_boxes(boxes), limit)


def scores_by_window(pixels: DataFrame, time: str, width: str, late: str) -> DataFrame:
    """TP, FP, FN and ratios of a stream of judged pixels by time window; late rows are taken up to the watermark."""
    return metrics.scores(pixels.withWatermark(time, late).withColumn("window", F.window(time, width)), ["window"])
