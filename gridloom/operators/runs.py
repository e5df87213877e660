"""Masks as runs: united, intersected, counted and compared without their pixels, and laid over rasters.

A run is a stretch of pixels [a, b) of a row (or, in COCO's order, of a column). Several masks over a
place are a sum of steps, +1 where a run begins and -1 where it ends; equal places are summed up in
each task before they are shuffled, and a running sum along a row tells where anything covers it. So
the work goes by the borders of masks, not by their areas, and no group is larger than a row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType
from pyspark.sql.window import Window

from gridloom.functions.shared import settle, spread
from gridloom.operators.metrics import _ratios

#: Pixels of a piece of a run or row that one key of an interval join holds.
PIECE = 256
#: Crossings of rings and lines that are worked out together.
CROSSED = 1 << 20
#: Lines of an array of rings that are crossed at a time.
BAND = 4096


def _crossings(rings: pa.Array, line: str, along: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The edges of arrays of rings that reach over lines: the array each is of, its ends (4 x n: line, along, line, along), its first and last line."""
    per_row = pc.fill_null(pc.list_value_length(rings), 0).to_numpy()
    flat = rings.flatten()
    size = pc.fill_null(pc.list_value_length(flat), 0).to_numpy()
    points = flat.flatten()
    named = dict(zip((f.name for f in points.type), points.flatten(), strict=True))
    at, to = (named[c].to_numpy(zero_copy_only=False).astype(np.float64) for c in (line, along))
    after = np.arange(1, len(at) + 1)
    stops = np.cumsum(size)[size > 0]
    after[stops - 1] = stops - size[size > 0]
    ends = np.stack((at, to, at[after], to[after]))
    some = np.repeat(size > 2, size) & np.isfinite(ends[0]) & np.isfinite(ends[2]) & (ends[0] != ends[2])
    ends = ends[:, some]
    first, last = np.ceil(np.minimum(ends[0], ends[2]) - 0.5).astype(np.int64), np.ceil(np.maximum(ends[0], ends[2]) - 0.5).astype(np.int64) - 1
    over = last >= first
    return np.repeat(np.repeat(np.arange(len(rings)), per_row), size)[some][over], ends[:, over], first[over], last[over]


def _stretches_of(of: np.ndarray, ends: np.ndarray, first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, ...]:
    """Runs of what _crossings() gives: the array each is of, its line, a, b."""
    count = last - first + 1
    edge = np.repeat(np.arange(len(of)), count)
    k = np.arange(len(edge)) - np.repeat(np.cumsum(count) - count, count) + first[edge]
    p_line, p_along, q_line, q_along = ends[:, edge]
    place = np.ceil(p_along + (k + 0.5 - p_line) / (q_line - p_line) * (q_along - p_along) - 0.5)
    of = of[edge]
    order = np.lexsort((place, k, of))  # a place that is null is the last
    of, k, place = of[order], k[order], place[order]
    new = np.ones(len(of), dtype=bool)
    new[1:] = (of[1:] != of[:-1]) | (k[1:] != k[:-1])
    start = np.flatnonzero(new)
    nth = np.arange(len(of)) - np.repeat(start, np.diff(np.append(start, len(of))))
    a = np.flatnonzero((nth % 2 == 0) & np.append(~new[1:], False)[: len(new)])
    a = a[place[a + 1] > place[a]]
    return of[a], k[a].astype(np.int32), place[a].astype(np.int32), place[a + 1].astype(np.int32)


def ring_runs(shapes: DataFrame, rings: str = "rings", by: str = "row") -> DataFrame:
    """shapes with row (or col), a, b: the pixels whose centre lies inside by the even-odd rule of all rings.

    rings is an array of rings, so gaps are rings like others; the column is dropped. A null or empty
    array, rings of fewer than three points and those between two centres have no run.
    Rings are cut into bands of BAND lines; those of a batch are crossed together, within CROSSED crossings at a time.
    """
    line, along = ("y", "x") if by == "row" else ("x", "y")
    points = "array<array<struct<x:double,y:double>>>"
    if shapes.schema[rings].dataType.simpleString() != points:
        point = lambda p: F.struct(p["x"].cast("double").alias("x"), p["y"].cast("double").alias("y"))
        shapes = shapes.withColumn(rings, F.transform(rings, lambda r: F.transform(r, point)))
    others = [c for c in shapes.columns if c not in (rings, by, "a", "b")]
    places = F.flatten(F.transform(F.filter(rings, lambda r: F.size(r) > 2), lambda r: F.transform(r, lambda p: p[line])))
    first_band, last_band = (F.floor(f(places) / BAND) for f in (F.array_min, F.array_max))
    banded = shapes.withColumns({"gl_a": first_band, "gl_z": last_band}).filter("gl_z >= gl_a").withColumn("gl_band", F.explode(F.sequence("gl_a", "gl_z")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            of, ends, first, last = _crossings(batch.column(rings), line, along)
            low = batch.column("gl_band").to_numpy()[of] * BAND
            first, last = np.maximum(first, low), np.minimum(last, low + BAND - 1)
            within = last >= first
            of, ends, first, last = of[within], ends[:, within], first[within], last[within]
            if not len(of):
                continue
            own = pa.RecordBatch.from_arrays([batch.column(c) for c in others], names=others)
            upto = np.cumsum(last - first + 1)
            begins = np.flatnonzero(np.diff(of, prepend=-1))  # edges of an array stay together
            z = 0
            while z < len(of):
                a = z
                most = np.searchsorted(upto, (upto[a - 1] if a else 0) + CROSSED, side="right")
                i = np.searchsorted(begins, most, side="right")
                z = len(of) if most >= len(of) else int(begins[i - 1])
                if z <= a:  # an array with more crossings than that goes alone
                    j = np.searchsorted(begins, a, side="right")
                    z = int(begins[j]) if j < len(begins) else len(of)
                row, *found = _stretches_of(of[a:z], ends[:, a:z], first[a:z], last[a:z])
                columns = own.take(pa.array(row)).columns if others else []
                yield pa.RecordBatch.from_arrays([*columns, *map(pa.array, found)], names=[*others, by, "a", "b"])

    schema = StructType([*(shapes.schema[c] for c in others), *(StructField(c, IntegerType()) for c in (by, "a", "b"))])
    return banded.select(*others, rings, "gl_band").mapInArrow(run, schema)


def box_runs(boxes: DataFrame) -> DataFrame:
    """boxes with whole coordinates as runs: row, a, b for xmin .. ymax; empty boxes have none."""
    y0, y1 = F.col("ymin").cast("int"), F.col("ymax").cast("int") - 1
    some = boxes.withColumns({"a": F.col("xmin").cast("int"), "b": F.col("xmax").cast("int")}).filter((F.col("b") > F.col("a")) & (y1 >= y0))
    return some.withColumn("row", F.explode(F.sequence(y0, y1))).drop("xmin", "ymin", "xmax", "ymax")


def _steps(runs: DataFrame, keys: list[str], name: str) -> DataFrame:
    """keys, at, name: what is to be added to a running sum at a place."""
    ends = F.explode(F.array(F.struct(F.col("a").alias("at"), F.lit(1).alias("d")), F.struct(F.col("b").alias("at"), F.lit(-1).alias("d"))))
    return runs.filter("b > a").select(*keys, ends.alias("e")).groupBy(*keys, "e.at").agg(F.sum("e.d").alias(name))


def _stretches(steps: DataFrame, keys: list[str], names: list[str]) -> DataFrame:
    """keys, a, b and the running sums of names between two places where any of them changes."""
    along = Window.partitionBy(*keys).orderBy("at")
    upto = along.rowsBetween(Window.unboundedPreceding, 0)
    sums = {n: F.sum(n).over(upto) for n in names}
    return steps.select(*keys, F.col("at").alias("a"), F.lead("at").over(along).alias("b"), *[c.alias(n) for n, c in sums.items()]).filter("b > a")


def _joined(stretches: DataFrame, keys: list[str]) -> DataFrame:
    """keys, a, b of stretches, those that touch as one."""
    order = Window.partitionBy(*keys).orderBy("a")
    apart = F.coalesce(F.lag("b").over(order) != F.col("a"), F.lit(True)).cast("int")
    numbered = stretches.withColumn("gl_new", apart).withColumn("gl_run", F.sum("gl_new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy(*keys, "gl_run").agg(F.min("a").alias("a"), F.max("b").alias("b")).drop("gl_run")


def cover(runs: DataFrame, keys: list[str]) -> DataFrame:
    """keys, a, b, n: how many of the runs of equal keys lie over each stretch; for combined() at several levels."""
    return _stretches(_steps(runs, keys, "n"), keys, ["n"])


def combined(covered: DataFrame, keys: list[str], least: int = 1) -> DataFrame:
    """combine() of runs that cover() has counted."""
    return _joined(covered.filter(F.col("n") >= least), keys)


def combine(runs: DataFrame, keys: list[str], least: int = 1) -> DataFrame:
    """keys, a, b: where at least so many of the runs of equal keys lie, in runs that don't touch.

    least 1 is the union. To intersect n masks, unite each for itself and ask for n.
    """
    return combined(cover(runs, keys), keys, least)


def pixels_of(runs: DataFrame) -> DataFrame:
    """runs as pixels, with col (or row, whichever isn't there) for a and b."""
    name = "col" if "row" in runs.columns else "row"
    return runs.filter("b > a").withColumn(name, F.explode(F.sequence(F.col("a"), F.col("b") - 1))).drop("a", "b")


def run_scores(target: DataFrame, predicted: DataFrame) -> DataFrame:
    """Scores by pred_set of masks in runs: target (image_id, row, a, b), predicted (the same with pred_set).

    pred_set, tp, fp, fn and ratios, as of masks by pixels: runs of an image may overlap. Images that a
    prediction set doesn't hold don't count, and of images that only it holds neither; null rows or
    bounds are no run, empty tables give no rows.
    """
    return step_scores(score_steps(target), score_steps(predicted, ["pred_set"]))


def score_steps(runs: DataFrame, by: list[str] | None = None) -> DataFrame:
    """What step_scores() needs of runs (by, image_id, row, a, b), a row for each place where any begins or ends."""
    return _steps(runs.filter("row is not null"), [*(by or []), "image_id", "row"], "n")


def step_scores(target: DataFrame, predicted: DataFrame) -> DataFrame:
    """run_scores() of score_steps(). Both are read several times: settle them where it is costly to make them."""
    keys = ["pred_set", "image_id", "row"]
    zero = F.lit(0).cast("long")
    judged = predicted.select("pred_set", "image_id").distinct().join(target.select("image_id").distinct(), "image_id", "left_semi")
    st = target.join(judged, "image_id").select(*keys, "at", F.col("n").alias("t"), zero.alias("p"))
    sp = predicted.join(judged, ["pred_set", "image_id"], "left_semi").select(*keys, "at", zero.alias("t"), F.col("n").alias("p"))
    both = st.unionByName(sp).groupBy(*keys, "at").agg(F.sum("t").alias("t"), F.sum("p").alias("p"))
    s = _stretches(both, keys, ["t", "p"])
    n = lambda c: F.sum(F.when(c, F.col("b") - F.col("a")).otherwise(0)).cast("long")
    on, said = F.col("t") > 0, F.col("p") > 0
    out = s.groupBy("pred_set").agg(n(on & said).alias("tp"), n(said & ~on).alias("fp"), n(on & ~said).alias("fn"))
    return out.withColumns(_ratios(F.col("tp").cast("double"), F.col("fp"), F.col("fn")))


def boxed(runs: DataFrame, keys: list[str], margin: int = 1) -> DataFrame:
    """keys, row, col, on: every pixel of the box around the runs of equal keys and margin pixels more."""
    box = runs.filter("b > a").groupBy(*keys).agg(F.min("row").alias("r0"), F.max("row").alias("r1"), F.min("a").alias("c0"), F.max("b").alias("c1"))
    rows = F.explode(F.sequence(F.col("r0") - margin, F.col("r1") + margin))
    cols = F.explode(F.sequence(F.col("c0") - margin, F.col("c1") - 1 + margin))
    every = box.withColumn("row", rows).withColumn("col", cols).select(*keys, "row", "col")
    on = pixels_of(combine(runs, [*keys, "row"])).withColumn("on", F.lit(True))
    return every.join(on, [*keys, "row", "col"], "left").withColumn("on", F.coalesce("on", F.lit(False)))


# --- COCO run lengths --------------------------------------------------------------------------


def coco_counts(runs: DataFrame, sizes: DataFrame, keys: list[str]) -> DataFrame:
    """keys, height, width, counts of masks in runs of columns (keys, col, a, b): COCO's uncompressed lengths.

    Pixels go column by column; lengths of unset and set stretches take turns, beginning with unset. sizes
    has keys, height, width; a mask without a run is one unset stretch, runs are cut at the raster's edge.
    """
    inside = runs.join(sizes, keys).withColumns({"a": F.greatest("a", F.lit(0)), "b": F.least("b", "height")}).filter("b > a and col >= 0 and col < width")
    at = F.col("col").cast("long") * F.col("height")
    flat = combine(inside.select(*keys, (at + F.col("a")).alias("a"), (at + F.col("b")).alias("b")), keys)
    ends = flat.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("a", "b"))).alias("r"))  # one mask
    all_ = sizes.join(ends, keys, "left").withColumn("e", F.flatten(F.transform(F.coalesce("r", F.array().cast("array<struct<a:bigint,b:bigint>>")), lambda s: F.array(s["a"], s["b"]))))
    total = F.col("height").cast("long") * F.col("width")
    marks = F.concat(F.array(F.lit(0).cast("long")), "e", F.when(F.coalesce(F.element_at("e", -1), F.lit(-1)) != total, F.array(total)).otherwise(F.array().cast("array<bigint>")))
    e = all_.withColumn("m", F.when(F.size("e") > 0, marks).otherwise(F.array(F.lit(0).cast("long"), total)))
    counts = F.zip_with(F.slice("m", 2, F.size("m") - 1), F.slice("m", 1, F.size("m") - 1), lambda y, x: y - x)
    return e.select(*keys, "height", "width", counts.alias("counts"))


def coco_runs(masks: DataFrame) -> DataFrame:
    """masks (height, counts and other columns) as runs of columns: col, a, b for counts and height."""
    ends = F.aggregate("counts", F.array(F.lit(0).cast("long")), lambda acc, x: F.concat(acc, F.array(F.element_at(acc, -1) + x)))
    m = masks.withColumn("gl_e", ends)
    pair = lambda i: F.struct(F.element_at("gl_e", 2 * i).alias("s"), F.element_at("gl_e", 2 * i + 1).alias("e"))
    m = m.filter(F.size("counts") > 1).withColumn("gl_r", F.explode(F.transform(F.sequence(F.lit(1), (F.size("counts") / 2).cast("int")), pair))).filter("gl_r.e > gl_r.s")
    m = m.withColumn("col", F.explode(F.sequence(F.floor(F.col("gl_r.s") / F.col("height")), F.floor((F.col("gl_r.e") - 1) / F.col("height")))))
    top = F.col("col") * F.col("height")
    m = m.withColumns({"a": F.greatest(F.col("gl_r.s") - top, F.lit(0)).cast("int"), "b": F.least(F.col("gl_r.e") - top, F.col("height")).cast("int")})
    return m.withColumn("col", F.col("col").cast("int")).drop("gl_e", "gl_r", "counts", "height")


def _packed(counts: list[int]) -> str:
    """Lengths as COCO's text: differences to the length two before, in groups of five bits, from '0' on."""
    out = []
    for i, n in enumerate(counts):
        x = int(n) - (int(counts[i - 2]) if i > 2 else 0)
        while True:
            five, x = x & 31, x >> 5
            more = x != (-1 if five & 16 else 0)
            out.append(chr(48 + (five | 32 * more)))
            if not more:
                break
    return "".join(out)


def _unpacked(text: str) -> list[int]:
    out: list[int] = []
    x = shift = 0
    for c in text:
        n = ord(c) - 48
        x |= (n & 31) << shift
        shift += 5
        if not n & 32:
            x -= (1 << shift) if n & 16 else 0
            out.append(x + (out[-2] if len(out) > 2 else 0))
            x = shift = 0
    return out


def pack_counts(counts: Column) -> Column:
    """COCO's compressed text of an array of lengths."""
    return F.pandas_udf(lambda s: pd.Series([None if c is None else _packed(c) for c in s], dtype=object), "string")(counts)


def unpack_counts(text: Column) -> Column:
    return F.pandas_udf(lambda s: pd.Series([None if t is None else np.array(_unpacked(t), dtype=np.int64) for t in s], dtype=object), "array<bigint>")(text)


# --- rasters under polygons --------------------------------------------------------------------


def _pieces(runs: DataFrame) -> DataFrame:
    """runs with piece: the stretches of PIECE pixels of a row that they reach into."""
    return runs.withColumn("piece", F.explode(F.sequence(F.floor(F.col("a") / PIECE), F.floor((F.col("b") - 1) / PIECE))))


def under(px: DataFrame, runs: DataFrame, keep: list[str], how: str = "inner") -> DataFrame:
    """px (raster_id, row, col, ...) with the columns keep of runs (raster_id, row, a, b) that lie over it.

    Rows are joined by pieces of PIECE pixels, so that neither a pixel nor a run meets more than a piece
    of the other side; a pixel under several runs comes once for each.
    """
    r = _pieces(runs.filter("b > a")).select("raster_id", "row", "piece", F.col("a").alias("gl_a"), F.col("b").alias("gl_b"), *keep)
    p = px.withColumn("piece", F.floor(F.col("col") / PIECE))
    on = (p["raster_id"] == r["raster_id"]) & (p["row"] == r["row"]) & (p["piece"] == r["piece"]) & (p["col"] >= r["gl_a"]) & (p["col"] < r["gl_b"])
    j = p.join(r.hint("merge"), on, how)  # what is made of runs is far more than Spark reckons, too much to broadcast
    return j.select(*[p[c] for c in px.columns], *[r[c] for c in keep]) if how == "inner" else j.select(*px.columns)


def raster_crop_polygon(px: DataFrame, shapes: DataFrame, rings: str = "rings") -> DataFrame:
    """The pixels of px whose centre lies inside any shape (raster_id, rings in pixels) of its raster, each once."""
    runs = combine(ring_runs(shapes.select("raster_id", F.col(rings).alias("rings"))), ["raster_id", "row"])
    return under(px, runs, [], "left_semi")


def zonal_polygons(px: DataFrame, zones: DataFrame, zone: str = "zone_id", rings: str = "rings") -> DataFrame:
    """n, v_min, v_max, v_mean of the pixels whose centre lies inside each zone (raster_id, zone, rings in pixels).

    Zones may overlap and have gaps; a zone of several rows is united first. Null values don't count,
    and a zone over no pixel has a row with n 0 and nulls.
    """
    named = zones.select("raster_id", F.col(zone).alias(zone), F.col(rings).alias("rings"))
    keys = ["raster_id", zone]
    counted = spread(named.filter(F.col("raster_id").isNotNull() & F.col(zone).isNotNull())).withColumn("gl_n", F.count("*").over(Window.partitionBy(*keys)))
    own = ring_runs(counted.filter("gl_n = 1")).select(*keys, "row", "a", "b")  # those of one row don't overlap
    runs = own.unionByName(combine(ring_runs(counted.filter("gl_n > 1")), [*keys, "row"]))
    pieces = _pieces(runs).withColumns({"a": F.greatest(F.col("a"), F.col("piece") * PIECE).cast("int"), "b": F.least(F.col("b"), (F.col("piece") + 1) * PIECE).cast("int")})
    pieces = settle(pieces.select(*keys, "row", "a", "b"), "zone-runs")
    # equal stretches are told once, so pixels meet no more of them than a piece has, however many zones lie there
    place = ["raster_id", "row", "a", "b"]
    each = under(px.select("raster_id", "row", "col", "v"), pieces.select(*place).distinct(), ["a", "b"])
    each = each.groupBy(*place).agg(F.count("v").alias("n"), F.min("v").alias("v_min"), F.max("v").alias("v_max"), F.sum("v").alias("gl_sum"))
    s = pieces.join(each.hint("merge"), place).groupBy(*keys).agg(F.sum("n").alias("n"), F.min("v_min").alias("v_min"), F.max("v_max").alias("v_max"), F.try_divide(F.sum("gl_sum"), F.sum("n")).alias("v_mean"))
    return named.select(*keys).distinct().join(s.hint("merge"), keys, "left").withColumn("n", F.coalesce("n", F.lit(0).cast("long")))


def to_pixels(ring: Column, xmin: Column, ymin: Column, xmax: Column, ymax: Column, width: Column, height: Column) -> Column:
    """A ring in map units as one in pixels of an extent, whose upper left corner is (0, 0)."""
    from gridloom.functions import geo

    def at(p: Column) -> Column:
        x, y = geo.to_pixel(p["x"], p["y"], xmin, ymin, xmax, ymax, width, height)
        return F.struct(x.alias("x"), y.alias("y"))

    return F.transform(ring, at)
