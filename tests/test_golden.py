import math
import random
import struct

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from gridloom.functions import geo, text
from gridloom.functions.shared import components, dense_ids
from gridloom.operators import rings, coco, detect, metrics, polygons, raster, tiling, vector
from gridloom.plans import flows
from gridloom.sources import files, geotiff

R2 = math.sqrt(2)


def mask(spark, rasters):
    rows = [(i, r, c, v == "#") for i, m in rasters.items() for r, line in enumerate(m) for c, v in enumerate(line)]
    return spark.createDataFrame(rows, "raster_id long, row int, col int, on boolean")


def framed(rows):
    w = len(rows[0]) + 2
    return ["." * w, *[f".{r}." for r in rows], "." * w]


GOLDEN = {
    "block": (["###"] * 3, [(4.0, 8.0)]),
    "pixel": (["#"], []),
    "bar": (["######"], []),
    "ring": (["#####", "#####", "##.##", "#####", "#####"], [(16.0, 16.0)]),
    "shared corner": (["###..", "###..", "#####", "..###", "..###"], [(9.0, 12 + 2 * R2)]),
    "diagonal": (["###...", "###...", "###...", "...###", "...###", "...###"], [(4.0, 8.0), (4.0, 8.0)]),
    "bar link": (["###...###", "#########", "###...###"], [(5.0, 6 + 2 * R2), (5.0, 6 + 2 * R2)]),
    "triangle": (["##", "#."], [(0.5, 2 + R2)]),
}


@pytest.mark.parametrize("side", [256, 4, 3])
def test_golden_shapes(spark, side):
    names = list(GOLDEN)
    got = polygons.polygonize(mask(spark, {i: framed(GOLDEN[n][0]) for i, n in enumerate(names)}), side).collect()
    for i, n in enumerate(names):
        mine = sorted((r.area, round(r.perimeter, 9)) for r in got if r.raster_id == i)
        assert mine == [(a, round(p, 9)) for a, p in GOLDEN[n][1]], n


def test_ramp(spark):
    px = spark.createDataFrame([(1, r, c, float(c)) for r in range(10) for c in range(10)], "raster_id long, row int, col int, v double")
    s = raster.band_statistics(px).first()
    assert (s.v_min, s.v_max, s.v_mean) == (0, 9, 4.5) and math.isclose(s.v_std, 2.872281323269, rel_tol=1e-12)
    on = raster.threshold_global(px).withColumn("on", F.col("mask") > 0)
    assert on.filter("on").count() == 80
    f = polygons.features(polygons.polygonize(on)).collect()
    assert [(r.id, r.area_m2, r.perim_m) for r in f] == [(0, 63.0, 32.0)]


def flood(grid):
    """Areas and perimeters by cells, one raster, by plain search."""
    h, w = len(grid), len(grid[0])
    out, todo = set(), [(r, c) for r in range(h) for c in range(w) if (r in (0, h - 1) or c in (0, w - 1)) and not grid[r][c]]
    while todo:
        r, c = todo.pop()
        if (r, c) in out or not (0 <= r < h and 0 <= c < w) or grid[r][c]:
            continue
        out.add((r, c))
        todo += [(r + 1, c), (r - 1, c), (r, c + 1), (r, c - 1)]
    on = {(r, c) for r in range(h) for c in range(w)} - out
    cells = {}
    for r in range(-1, h):
        for c in range(-1, w):
            p = [q for q in ((r, c), (r, c + 1), (r + 1, c), (r + 1, c + 1)) if q in on]
            if len(p) >= 3:
                cells[r, c] = p
    sides = lambda k: [(a, b) for a, b in (((k[0], k[1]), (k[0], k[1] + 1)), ((k[0] + 1, k[1]), (k[0] + 1, k[1] + 1)), ((k[0], k[1]), (k[0] + 1, k[1])), ((k[0], k[1] + 1), (k[0] + 1, k[1] + 1))) if a in on and b in on]
    of = {}
    for k in cells:
        for s in sides(k):
            of.setdefault(s, []).append(k)
    seen, result = set(), []
    for k in cells:
        if k in seen:
            continue
        part, todo = set(), [k]
        while todo:
            x = todo.pop()
            if x not in part:
                part.add(x)
                todo += [y for s in sides(x) for y in of[s]]
        seen |= part
        area = sum(1 if len(cells[x]) == 4 else 0.5 for x in part)
        per = sum(1 for s in of if len(of[s]) == 1 and of[s][0] in part) + R2 * sum(len(cells[x]) == 3 for x in part)
        result.append((area, round(per, 6)))
    return sorted(result)


@pytest.mark.parametrize("side", [256, 5])
def test_random_masks_against_plain_search(spark, side):
    r = random.Random(side)
    grids = {i: [[r.random() < 0.6 for _ in range(13)] for _ in range(11)] for i in range(25)}
    px = mask(spark, {i: ["".join("#" if v else "." for v in row) for row in g] for i, g in grids.items()})
    got = polygons.polygonize(px, side).collect()
    for i, g in grids.items():
        assert sorted((x.area, round(x.perimeter, 6)) for x in got if x.raster_id == i) == flood(g)


def test_scores_and_empty_groups(spark):
    rows = [(1, 1)] * 3 + [(0, 1)] + [(1, 0)] * 2 + [(0, 0), (None, None)]
    d = spark.createDataFrame([("a", t, p) for t, p in rows] + [("b", 0, 0)], "pred_set string, target int, predicted int")
    got = {r.pred_set: r for r in metrics.scores(d, ["pred_set"]).collect()}
    a = got["a"]
    assert (a.tp, a.fp, a.fn) == (3, 1, 2) and math.isclose(a.dice, 2 / 3) and a.precision_ref == a.recall_ref == a.accuracy_ref == 0.6 and a.precision_textbook == 0.75
    assert got["b"].dice is None


def test_noise_floor(spark):
    px = spark.createDataFrame([(1, 0, 0, 0.05), (1, 0, 1, 0.01), (2, 0, 0, 0.06), (2, 0, 1, -1.0)], "raster_id long, row int, col int, v double")
    assert {(r.raster_id, r.col): r.mask for r in raster.threshold_tiles(px).collect()} == {(1, 0): 0, (1, 1): 0, (2, 0): 255, (2, 1): 0}


def test_area_filter_keeps_the_limit_and_reaches_the_scan(spark, tmp_path):
    spark.createDataFrame([(1, 99.0), (2, 100.0), (3, 100.5)], "id int, area_m2 double").write.parquet(f"{tmp_path}/a")
    d = vector.filter_by_area(spark.read.parquet(f"{tmp_path}/a"), 100.0)
    assert {r.id for r in d.collect()} == {1, 2}
    plan = d._jdf.queryExecution().toString()
    assert "LessThanOrEqual(area_m2,100.0)" in plan


def test_projection_corner_and_inverses(spark):
    d = spark.createDataFrame([(180.0, 90.0)], "lon double, lat double").select(*geo.cea(F.col("lon"), F.col("lat"))).first()
    assert abs(d[0] - 17367530.45) < 0.01 and abs(d[1] - 7342230.14) < 0.01


def test_grid_and_clipping_lose_no_area(spark):
    r = random.Random(1)
    b = [(i, x := r.random() * 90, y := r.random() * 90, x + r.random() * 10, y + r.random() * 10) for i in range(200)]
    boxes = spark.createDataFrame(b, "box_id int, xmin double, ymin double, xmax double, ymax double")
    bounds = boxes.agg(F.min("xmin").alias("xmin"), F.min("ymin").alias("ymin"), F.max("xmax").alias("xmax"), F.max("ymax").alias("ymax"))
    for n in (1, 3, 10):
        got = {x.box_id: x.a for x in tiling.overlay_boxes(boxes, bounds, n).groupBy("box_id").agg(F.sum((F.col("xmax") - F.col("xmin")) * (F.col("ymax") - F.col("ymin"))).alias("a")).collect()}
        assert all(math.isclose(got[i], (x1 - x0) * (y1 - y0), rel_tol=1e-9, abs_tol=1e-12) for i, x0, y0, x1, y1 in b)


def test_dense_ids_and_components(spark):
    d = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("k")).repartition(7)
    assert all(r.k + 1 == r.id for r in dense_ids(d, ["k"], "id", 1).collect())
    assert dense_ids(d.limit(0), ["k"]).count() == 0
    e = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101)], "a long, b long")
    assert {r.node: r.label for r in components(e).collect()} == {i: 0 for i in range(41)} | {100: 100, 101: 100}


def test_ascii_grid(spark, tmp_path):
    (tmp_path / "g.asc").write_text("NCOLS 3\nNROWS 2\nXLLCENTER 5.0\nYLLCENTER 5.0\nDX 10\nDY 10\nNODATA -9999\n0 1 2\n3 -9999 5\n")
    px, meta = files.read_ascii_grid(spark, f"{tmp_path}/g.asc")
    assert {(r.row, r.col): r.v for r in px.collect()} == {(0, 0): 0, (0, 1): 1, (0, 2): 2, (1, 0): 3, (1, 1): None, (1, 2): 5}
    m = meta.first()
    assert (m.height, m.width, m.dx, m.xmin, m.ymin) == (2, 3, 10, 0, 0)


def test_layers_masks_and_coco_files(spark, tmp_path):
    m = vector.measure_boxes(spark.createDataFrame([(1, 0.0, 0.0, 2.0, 3.0)], "box_id int, xmin double, ymin double, xmax double, ymax double"))
    paths = files.write_layers(m, str(tmp_path), "results")
    assert files.register(spark, paths) == ["results_vector", "results_vector_bb", "results_vector_centroids"]
    assert spark.table("results_vector_centroids").first().cx == 1.0
    with pytest.raises(ValueError):
        files.write_layers(m, str(tmp_path), "x", ())
    for n in ("b.tif", "a.tif", "c.txt"):
        (tmp_path / n).write_bytes(b"x")
    assert [(r.id, r.file_name) for r in files.read_mask_list(spark, str(tmp_path)).orderBy("id").collect()] == [(0, "a.tif"), (1, "b.tif")]
    tiles = tiling.grid(spark.createDataFrame([(0.0, 0.0, 4.0, 4.0)], "xmin double, ymin double, xmax double, ymax double"), 2)
    pieces = tiling.overlay_boxes(m, tiles.agg(F.min("xmin").alias("xmin"), F.min("ymin").alias("ymin"), F.max("xmax").alias("xmax"), F.max("ymax").alias("ymax")), 2)
    coco.documents(coco.images(tiles, 256, 256), coco.annotations(pieces, 256, 256)).filter("image_id = 1").select("json").write.text(f"{tmp_path}/coco")
    back = files.read_coco(spark, f"{tmp_path}/coco")
    assert back["images"].count() == 1 and back["annotations"].count() == 1
    assert back["categories"].first().name == "tree"


def test_model_slot_and_suppression(spark):
    b = spark.createDataFrame([(1, 0, 0.0, 0.0, 10.0, 10.0, 0.9), (2, 0, 1.0, 1.0, 10.0, 10.0, 0.8), (3, 0, 20.0, 20.0, 30.0, 30.0, 0.1), (4, 1, 0.0, 0.0, 10.0, 10.0, 0.2)], "box_id int, image_id int, xmin double, ymin double, xmax double, ymax double, score double")
    assert {r.box_id for r in detect.suppress(b, 0.4).collect()} == {1, 3, 4}
    out = detect.infer(b, lambda: lambda pdf: pdf.assign(score=pdf.score * 2)[["box_id", "score"]], "box_id int, score double")
    assert {r.box_id: r.score for r in out.collect()}[4] == 0.4


def test_streams(spark, tmp_path):
    from gridloom.streaming import flows

    src = spark.createDataFrame([(1, 0.0, 0.0, 2.0, 3.0), (2, 0.0, 0.0, 20.0, 30.0)], "box_id int, xmin double, ymin double, xmax double, ymax double")
    src.write.parquet(f"{tmp_path}/s")
    q = flows.measured(spark.readStream.schema(src.schema).parquet(f"{tmp_path}/s"), 100.0).writeStream.format("memory").queryName("measured").start()
    q.processAllAvailable()
    q.stop()
    assert [r.box_id for r in spark.table("measured").collect()] == [1]


def test_text(spark):
    d = spark.createDataFrame([("at 12.7% of", "EPSG:6933", "/a/b.c.shp"), ("none", "x", "plain"), (None, None, None)], "m string, c string, p string")
    got = [tuple(r) for r in d.select(text.percent(F.col("m")), text.epsg_number(F.col("c")), text.stem(F.col("p")), text.sibling(F.col("p"), "_bb")).collect()]
    assert got == [(12, 6933, "b.c", "/a/b.c_bb.shp"), (None, None, "plain", "plain_bb"), (None, None, None, None)]


def test_entry_without_the_optional_package(spark, monkeypatch):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    monkeypatch.setattr(e, "_llm", lambda: None)
    assert "raster_tile_threshold" in e.queries() and not any(q.startswith("op") for q in e.queries()) and set(e.oracle_sql()) <= set(e.queries())


def test_box_masks_score_like_their_pixels(spark):
    """Overlapping, empty and touching boxes; an image that a set or the target doesn't hold."""
    r = random.Random(7)
    def box(i):
        x, y = r.randrange(20), r.randrange(20)
        return i, float(x), float(y), float(x + r.randrange(6)), float(y + r.randrange(6))

    target = spark.createDataFrame([box(i % 4) for i in range(40)], "image_id int, xmin double, ymin double, xmax double, ymax double")
    rows = [("a", *box(i % 3)) for i in range(30)] + [("b", *box(i % 2 * 4)) for i in range(20)] + [("b", *box(3))] * 2
    predicted = spark.createDataFrame(rows, "pred_set string, image_id int, xmin double, ymin double, xmax double, ymax double")
    want = metrics.mask_scores(metrics.rasterise_boxes(target), metrics.rasterise_boxes(predicted)).collect()
    got = metrics.box_mask_scores(target, predicted)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want)) and len(want) == 2
    assert metrics.box_mask_scores(target, predicted.limit(0)).count() == 0


def test_bounds_without_a_side_hold_nothing(spark):
    box = "xmin double, ymin double, xmax double, ymax double"
    point = spark.createDataFrame([(2.0, 3.0, 2.0, 3.0)], box)
    assert tiling.overlay_boxes(point, point, 3).count() == 0
    assert tiling.overlay_boxes(point.limit(0), point, 3).count() == 0
    at = geo.to_pixel(F.lit(2.0), F.lit(3.0), *(F.col(c) for c in ("xmin", "ymin", "xmax", "ymax")), F.lit(10), F.lit(10))
    assert tuple(point.select(*at).first()) == (None, None)


def star(r, x, y):
    """A simple ring around (x, y), mostly concave."""
    n = r.randint(4, 14)
    at = [2 * math.pi * (i + r.uniform(0, 0.9)) / n for i in range(n)]
    return [(x + d * math.cos(a), y + d * math.sin(a)) for a in at for d in (r.uniform(2, 30),)]


def holds(ring, x, y):
    hit = False
    for (a, b), (c, d) in zip(ring, ring[1:] + ring[:1], strict=True):
        if (b <= y) != (d <= y) and x < a + (y - b) / (d - b) * (c - a):
            hit = not hit
    return hit


def test_clipped_parts_hold_what_ring_and_rectangle_hold():
    r = random.Random(11)
    several = 0
    for _ in range(400):
        ring = star(r, r.uniform(20, 80), r.uniform(20, 80)) if r.random() < 0.7 else [(a, b) for a, b in ((10, 10), (50, 10), (50, 60), (r.randint(25, 35), 40 - 10 * r.randint(0, 2)), (10, 60))]
        x0, y0, x1, y1 = r.choice(((30, 30, 70, 70), (0, 40, 100, 100), (30, 0, 35, 100)))
        parts = vector.clip(np.array(ring, dtype=float), x0, y0, x1, y1)
        several += len(parts) > 1
        for _ in range(60):
            x, y = r.uniform(0, 100), r.uniform(0, 100)
            want = holds(ring, x, y) and x0 < x < x1 and y0 < y < y1
            assert sum(holds([tuple(p) for p in q], x, y) for q in parts) == want
    assert several > 20


def test_tiles_share_rings_out(spark):
    r = random.Random(5)
    rings = [(i, star(r, r.uniform(20, 80), r.uniform(20, 80))) for i in range(60)]
    d = spark.createDataFrame([*rings, (100, None), (101, [(1.0, 1.0), (2.0, 2.0)])], "box_id long, ring array<struct<x:double,y:double>>").withColumn("xmin", F.lit("clash"))
    b = spark.createDataFrame([(-20.0, -20.0, 120.0, 120.0)], "xmin double, ymin double, xmax double, ymax double")
    got = {x.box_id: x.a for x in tiling.overlay_rings(d, b, 7).groupBy("box_id").agg(F.sum(vector.parts_area(F.col("parts"))).alias("a")).collect()}
    want = {i: abs(vector.signed_area(np.array(p))) for i, p in rings}
    assert got.keys() == want.keys() and all(math.isclose(got[i], want[i], rel_tol=1e-9) for i in want)
    assert tiling.overlay_rings(d.limit(0), b, 7).count() == 0


@pytest.mark.parametrize("dtype", ["uint8", "float32", "float64", "uint16"])
@pytest.mark.parametrize("deflate", [True, False])
def test_geotiff_codec(dtype, deflate):
    r = np.random.default_rng(3)
    for h, w, n in ((1, 1, 1), (5, 7, 1), (9, 4, 3)):
        px = (r.random((h, w, n)) * 200).astype(dtype)
        raw = geotiff.encode(px, (10.0, 20.0, 10.0 + w, 20.0 + 2 * h), 4326 if n == 1 else 6933, deflate) + b"\x00"
        assert (geotiff.decode(raw) == px).all()
        m = geotiff.describe("a", raw)
        assert (m["height"], m["width"], m["count"], m["epsg"]) == (h, w, n, 4326 if n == 1 else 6933)
        assert (m["xmin"], m["ymin"], m["xmax"], m["ymax"]) == (10.0, 20.0, 10.0 + w, 20.0 + 2 * h)


def test_geotiff_of_other_writers():
    """Big-endian, in tiles, with nodata: written out by hand."""
    w, h = 5, 3
    px = np.arange(w * h, dtype=">u2").reshape(h, w)
    padded = np.zeros((4, 8), dtype=">u2")
    padded[:h, :w] = px
    tiles = [padded[r : r + 2, c : c + 4].tobytes() for r in (0, 2) for c in (0, 4)]
    entries = [(256, 3, [w]), (257, 3, [h]), (258, 3, [16]), (259, 3, [1]), (277, 3, [1]), (322, 3, [4]), (323, 3, [2]), (324, 4, None), (325, 4, [16] * 4), (339, 3, [1]), (42113, 2, b"7\x00")]
    after = 8 + 2 + 12 * len(entries) + 4
    extra = b"".join(tiles)
    place, sizes = after + len(extra), after + len(extra) + 16
    at = [after + 16 * i for i in range(4)]
    raw = b"MM\x00*" + struct.pack(">IH", 8, len(entries))
    for tag, t, v in entries:
        if tag == 324:
            raw += struct.pack(">HHII", tag, t, 4, place)
        elif tag == 325:
            raw += struct.pack(">HHII", tag, t, 4, sizes)
        elif t == 2:
            raw += struct.pack(">HHI", tag, t, 2) + v + b"\x00\x00"
        else:
            raw += struct.pack(">HHIHH", tag, t, 1, v[0], 0)
    raw += b"\x00" * 4 + extra + struct.pack(">4I", *at) + struct.pack(">4I", *[16] * 4)
    assert (geotiff.decode(raw)[:, :, 0] == px).all()
    m = geotiff.describe("a", raw)
    assert m["nodata"] == 7 and m["epsg"] is None and m["xmin"] is None
    with pytest.raises(ValueError):
        geotiff.decode(b"GIF89a....")


def test_geotiff_bands_and_missing_pixels(spark, tmp_path):
    px = spark.createDataFrame([(1, 0, 0, 3.0, 4.0), (1, 1, 1, None, 5.0)], "raster_id long, row int, col int, a double, b double")
    meta = spark.createDataFrame([(1, 0.0, 0.0, 2.0, 2.0, 2, 2, None)], "raster_id long, xmin double, ymin double, xmax double, ymax double, width int, height int, epsg int")
    geotiff.write(geotiff.encode_rasters(px, meta, ("a", "b")), f"file://{tmp_path}/t")
    got = {(r.row, r.col): (r.a, r.b, r.c) for r in geotiff.read(spark, f"file://{tmp_path}/t", ("a", "b", "c")).collect()}
    assert got == {(0, 0): (3, 4, None), (0, 1): (0, 0, None), (1, 0): (0, 0, None), (1, 1): (0, 5, None)}
    m = geotiff.metadata(spark, f"file://{tmp_path}/t").first()
    assert (m.file, m.epsg, m["count"], m.dtype) == ("tile_1.tif", None, 2, "f4")


def test_detection_flow(spark, tmp_path):
    def model():
        def predict(b):
            return pd.DataFrame({"image_id": b["image_id"].astype("int32"), "box_id": b["image_id"].astype("int64"), "xmin": 8.0, "ymin": 8.0, "xmax": 24.0, "ymax": 40.0, "score": b["score"]})

        return predict

    tiles = spark.createDataFrame([(0, 0.99), (1, 0.5), (2, 1.0)], "image_id int, score double")
    meta = spark.createDataFrame([(i, 0.0, 0.0, 128.0, 128.0, 64, 64) for i in (0, 1)], "image_id int, xmin double, ymin double, xmax double, ymax double, width int, height int")
    out = flows.detect_objects(tiles, model, meta, f"file://{tmp_path}/d", "r")
    assert [p.rpartition("/")[2] for p in out] == ["r_vector", "r_vector_bb", "r_vector_centroids"]
    r = spark.read.parquet(out[1]).collect()
    assert [(x.box_id, x.xmin, x.ymin, x.xmax, x.ymax, x.area_m2) for x in r] == [(0, 16.0, 48.0, 48.0, 112.0, 2048.0)]


def test_georeferenced_measures_near_the_equator(spark):
    """A block of 2 x 2 cells of a thousandth of a degree, measured on the ellipsoid's equator."""
    px = spark.createDataFrame([(7, r, c, 1 <= r <= 3 and 1 <= c <= 3) for r in range(5) for c in range(5)], "raster_id long, row int, col int, on boolean")
    meta = spark.createDataFrame([(7, 10.0, -0.0025, 10.005, 0.0025, 5, 5, 4326)], "raster_id long, xmin double, ymin double, xmax double, ymax double, width int, height int, epsg int")
    m = polygons.measure_georeferenced(px, meta).first()
    side, up = 111.3194908, 110.5742758  # metres of a thousandth of a degree east and north at the equator
    assert math.isclose(m.area_m2, 4 * side * up, rel_tol=1e-6) and math.isclose(m.perim_m, 4 * (side + up), rel_tol=1e-6)
    assert (round(m.xmin, 6), round(m.xmax, 6), round(m.ymax, 6), round(m.ymin, 6)) == (10.001, 10.003, 0.0015, -0.0005)
    assert polygons.measure_georeferenced(px, meta.withColumn("epsg", F.lit(27700))).first().area_m2 is None


def test_measures_beyond_an_equal_area_system(spark):
    """EPSG:6933 is only scaled, also where no latitude has its ordinate (F4)."""
    px = spark.createDataFrame([(i, r, c, 1 <= r <= 3 and 1 <= c <= 3) for i in (0, 1) for r in range(5) for c in range(5)], "raster_id long, row int, col int, on boolean")
    meta = spark.createDataFrame([(i, 1e7 * i, 9e6 * i, 1e7 * i + 50, 9e6 * i + 50, 5, 5, 6933) for i in (0, 1)], "raster_id long, xmin double, ymin double, xmax double, ymax double, width int, height int, epsg int")
    near, far = polygons.measure_georeferenced(px, meta).orderBy("raster_id").collect()
    assert math.isclose(far.area_m2, 400, rel_tol=1e-9) and math.isclose(near.area_m2, 400, rel_tol=1e-9)
    assert math.isclose(far.perim_m, near.perim_m, rel_tol=1e-9)
    ring = spark.createDataFrame([(1, [(0.0, 0.0), (0.0, 5.0), (5.0, 5.0), (5.0, 0.0)], False)], "raster_id long, ring array<struct<x:double,y:double>>, hole boolean")
    assert math.isclose(rings.ring_features(ring, meta).first().area_m2, 2500, rel_tol=1e-6)


def test_resampling_equals_brute_force(spark):
    """Each new pixel from the old ones around it; missing, null and repeated ones too (F3)."""
    r = random.Random(7)
    size = {0: (5, 3), 1: (1, 1), 2: (4, 9)}
    old = [(i, a, b, r.choice([None, 1.0, r.random()])) for i, (h, w) in size.items() for a in range(h) for b in range(w) if r.random() < 0.9 or (a, b) == (h - 1, w - 1)]
    old.append(old[0])
    px = spark.createDataFrame(old, "raster_id long, row int, col int, v double")
    for scale in (0.4, 1.0, 1.5, 3.2):
        want = {}
        for i, (h, w) in size.items():
            for a in range(int(h * scale)):
                for b in range(int(w * scale)):
                    y, x = (max(0.0, min((k + 0.5) / scale - 0.5, n - 1.0)) for k, n in ((a, h), (b, w)))
                    for ay, wy in ((int(y), 1 - y + int(y)), (min(int(y) + 1, h - 1), y - int(y))):
                        for bx, wx in ((int(x), 1 - x + int(x)), (min(int(x) + 1, w - 1), x - int(x))):
                            for v in (v for j, c, d, v in old if (j, c, d) == (i, ay, bx)):
                                was = want.get((i, a, b))
                                want[i, a, b] = was if v is None else (was or 0.0) + wy * wx * v
        got = {(x.raster_id, x.row, x.col): x.v for x in raster.resample(px, raster.dimensions(px), scale).collect()}
        assert got.keys() == want.keys()
        assert [(k, got[k], want[k]) for k in want if (got[k] is None) != (want[k] is None) or want[k] is not None and not math.isclose(got[k], want[k], abs_tol=1e-12)] == [], scale


def test_small_files_are_dealt_to_many_tasks(spark, tmp_path):
    from gridloom.functions import tables

    spark.range(300).select(F.col("id").alias("vec_id"), F.array(F.lit(0.5)).alias("embedding"), F.lit(1).alias("label")).coalesce(1).write.parquet(f"{tmp_path}/embeddings.parquet")
    spark.range(300).select(F.col("id").alias("p_partkey"), F.lit(5).alias("p_size"), F.lit(900.0).alias("p_retailprice")).coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    for table in (tables.pixels, tables.mosaic, tables.boxes):
        assert table(spark, str(tmp_path)).select(F.spark_partition_id()).distinct().count() > 4


def test_annotations_make_their_pieces_once(spark, tmp_path):
    """Numbering samples its input for ranges; what made the pieces must not run for that too (F5)."""
    seen = f"{tmp_path}/seen"

    def noted(k):
        with open(seen, "a") as f:
            f.write("x")
        return k

    box = [F.lit(float(v)).alias(f"tile_{c}") for c, v in (("xmin", 0), ("ymin", 0), ("xmax", 8), ("ymax", 8))] + [F.lit(float(v)).alias(c) for c, v in (("xmin", 1), ("ymin", 1), ("xmax", 2), ("ymax", 2))]
    parts = F.expr("array(array(named_struct('x', 1D, 'y', 1D), named_struct('x', 2D, 'y', 1D), named_struct('x', 2D, 'y', 2D)))").alias("parts")
    pieces = spark.range(50).repartition(4).select(F.lit(0).alias("tile_id"), F.udf(noted, "long")("id").alias("box_id"), *box, parts)
    a = coco.ring_annotations(pieces, 8, 8).collect()
    assert sorted((x.id, x.feature_id) for x in a) == [(k + 1, k) for k in range(50)]
    with open(seen) as f:
        assert len(f.read()) == 50


def test_rings_clipped_together_are_those_clipped_one_by_one():
    r = random.Random(3)
    notch = [(0, 0), (10, 0), (10, 10), (5, 2), (0, 10)]
    rings = [np.array(star(r, r.uniform(20, 80), r.uniform(20, 80)) if i % 2 else [(x + i % 60, y + i % 55) for x, y in notch], dtype=float) for i in range(600)]
    rings[7][1, 0] = np.nan
    boxes = np.array([r.choice(((30, 30, 70, 70), (0, 40, 100, 100), (30, 0, 35, 100), (5, 5, 5.5, 5.5))) for _ in rings], dtype=float)
    points, at, of = vector.clip_many(np.concatenate(rings), np.cumsum([0, *map(len, rings)]), boxes)

    def turned(p):
        k = np.lexsort((p[:, 1], p[:, 0]))[0]
        return np.roll(p, -k, axis=0).round(9).tolist()

    got = [[] for _ in rings]
    for k, a, z in zip(of, at, at[1:], strict=False):
        got[k].append(turned(points[a:z]))
    assert sum(len(g) > 1 for g in got) > 10
    for k, (ring, box) in enumerate(zip(rings, boxes, strict=True)):
        if k != 7:
            assert sorted(got[k]) == sorted(map(turned, vector.clip(ring, *box))), k
    assert [x.tolist() for x in vector.clip_many(np.zeros((0, 2)), np.array([0]), np.zeros((0, 4)))] == [[], [0], []]


def test_overlay_clips_no_ring_by_itself(monkeypatch):
    """Concave rings over a tile's border are clipped a batch at a time."""
    def stop(*a):
        raise AssertionError("one by one")

    monkeypatch.setattr(vector, "clip", stop)
    rings = [np.array([(0, 0), (10, 0), (10, 10), (5, 2), (0, 10)], dtype=float) + i for i in range(5)]
    _, at, of = vector.clip_many(np.concatenate(rings), np.arange(0, 26, 5), np.tile([0.0, 6.5, 20.0, 20.0], (5, 1)))
    assert np.bincount(of).tolist() == [2, 2, 2, 2, 2]
