import math
import random
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from gridloom.operators import instances, metrics, runs

RINGS = "array<array<struct<x:double,y:double>>>"


def shape(r):
    n = r.randrange(3, 8)
    at = sorted(r.random() * 2 * math.pi for _ in range(n))
    x, y = r.uniform(0, 30), r.uniform(0, 30)
    return [(x + r.uniform(2, 9) * math.cos(a), y + r.uniform(2, 9) * math.sin(a)) for a in at]


def inside(rings, x, y):
    n = 0
    for ring in rings:
        for (ax, ay), (bx, by) in zip(ring, [*ring[1:], ring[0]], strict=True) if len(ring) > 2 else ():
            n += (ay <= y) != (by <= y) and ax + (y - ay) / (by - ay) * (bx - ax) <= x
    return n % 2 == 1


def pixels(rings):
    return {(r, c) for r in range(-12, 45) for c in range(-12, 45) if inside(rings, c + 0.5, r + 0.5)}


@pytest.fixture(scope="module")
def shapes():
    r = random.Random(21)
    out = [(i, i % 3, [shape(r) for _ in range(r.choice([1, 1, 2]))]) for i in range(24)]
    return [*out, (50, 0, None), (51, 0, []), (52, 1, [[(1.0, 1.0), (5.0, 5.0)]]), (53, 2, [[(0.6, 0.6), (0.9, 0.6), (0.9, 0.9)]])]


def table(spark, shapes):
    return spark.createDataFrame(shapes, f"shape_id int, image_id int, rings {RINGS}").withColumns({"a": F.lit("x"), "gl_x": F.lit(1)}).drop("a", "gl_x")


def test_runs_are_the_pixels(spark, shapes):
    for by in ("row", "col"):
        got = defaultdict(set)
        for x in runs.pixels_of(runs.ring_runs(table(spark, shapes), by=by)).collect():
            got[x.shape_id].add((x.row, x.col))
        assert got == {i: pixels(s) for i, _, s in shapes if s and pixels(s)}
    one = table(spark, [s for s in shapes if s[2] and len(s[2]) == 1])
    old = metrics.rasterise_ring(one.withColumn("ring", F.col("rings")[0])).select("shape_id", "row", "col")
    new = runs.pixels_of(runs.ring_runs(one)).select("shape_id", "row", "col")
    assert old.exceptAll(new).count() == new.exceptAll(old).count() == 0


def test_union_intersection_and_scores(spark, shapes):
    t = runs.ring_runs(table(spark, shapes))
    covered = defaultdict(lambda: defaultdict(int))
    for i, image, s in shapes:
        for p in pixels(s or []):
            covered[image][p] += 1
    for least in (1, 2, 3):
        u = runs.combine(t, ["image_id", "row"], least).collect()
        got = defaultdict(set)
        for x in u:
            assert not any((x.row, x.b) == (y.row, y.a) and x.image_id == y.image_id for y in u)
            got[x.image_id] |= {(x.row, c) for c in range(x.a, x.b)}
        assert got == {k: {p for p, n in v.items() if n >= least} for k, v in covered.items() if any(n >= least for n in v.values())}
    moved = [("m", i, image, [[(x + 1.3, y - 0.7) for x, y in r] for r in s or []]) for i, image, s in shapes if image != 2] + [("n", 0, 1, shapes[1][2]), ("n", 0, 9, shapes[1][2])]
    p = spark.createDataFrame(moved, f"pred_set string, shape_id int, image_id int, rings {RINGS}")
    pr = runs.ring_runs(p)
    want = metrics.mask_scores(runs.pixels_of(t), runs.pixels_of(pr)).orderBy("pred_set").collect()
    got = runs.run_scores(t, pr).orderBy("pred_set")
    assert [tuple(r) for r in got.collect()] == [tuple(r) for r in want] and len(want) == 2
    assert runs.run_scores(t.filter("false"), pr).collect() == runs.run_scores(t, pr.filter("false")).collect() == []
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Generate explode(sequence" in plan and "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_coco_text():
    counts = [6, 1, 40, 4, 5, 4, 5, 4, 21]
    assert runs._packed(counts) == "61X13mN000`0" and runs._unpacked("61X13mN000`0") == counts
    r = random.Random(1)
    for _ in range(50):
        c = [r.choice([0, 1, 5, 31, 32, 1000, 10**6]) for _ in range(r.randrange(20))]
        assert runs._unpacked(runs._packed(c)) == c


def test_coco_round_trip(spark, shapes):
    h, w = 20, 25
    t = runs.ring_runs(table(spark, shapes), by="col")
    sizes = spark.createDataFrame([(i, h, w) for i in (0, 1, 2, 7)], "image_id int, height int, width int")
    c = runs.coco_counts(t, sizes, ["image_id"])
    masks = {k: np.zeros((h, w), dtype=bool) for k in (0, 1, 2, 7)}
    for _, image, s in shapes:
        for r, col in pixels(s or []):
            if 0 <= r < h and 0 <= col < w:
                masks[image][r, col] = True
    got = {x.image_id: list(x.counts) for x in c.collect()}
    assert got == {k: instances.mask_counts(m) for k, m in masks.items()} and all(sum(v) == h * w for v in got.values())
    packed = c.withColumn("text", runs.pack_counts(F.col("counts"))).drop("counts").withColumn("counts", runs.unpack_counts(F.col("text")))
    back = defaultdict(set)
    for x in runs.pixels_of(runs.coco_runs(packed)).collect():
        back[x.image_id].add((x.row, x.col))
    assert back == {k: set(zip(*map(list, np.nonzero(m)), strict=True)) for k, m in masks.items() if m.any()}


def test_zones_and_crops(spark, shapes):
    r = random.Random(5)
    v = {(i, row, col): r.choice([None, r.random()]) for i in (0, 1) for row in range(30) for col in range(600 if row < 3 else 30)}
    px = spark.createDataFrame([(i, row, col, x) for (i, row, col), x in v.items()], "raster_id int, row int, col int, v double").withColumn("piece", F.lit(1)).drop("piece")
    wide = (90, 0, [[(-5.0, 0.2), (598.0, 0.2), (598.0, 2.7), (-5.0, 2.7)]])
    z = table(spark, [*shapes, wide, (90, 0, [[(1.0, 1.0), (9.0, 1.0), (9.0, 9.0)]])]).withColumnRenamed("image_id", "raster_id").withColumnRenamed("shape_id", "zone_id")
    cover = defaultdict(set)
    for i, image, s in [*shapes, wide, (90, 0, [[(1.0, 1.0), (9.0, 1.0), (9.0, 9.0)]])]:
        cover[image, i] |= ({(row, c) for row in range(3) for c in range(600) if inside(s, c + 0.5, row + 0.5)} if i == 90 and s == wide[2] else pixels(s or []))
    got = {(x.raster_id, x.zone_id): (x.n, x.v_min, x.v_max, x.v_mean) for x in runs.zonal_polygons(px, z).collect()}
    for k, places in cover.items():
        seen = [v[k[0], *p] for p in places if v.get((k[0], *p)) is not None]
        assert got[k][:3] == (len(seen), min(seen, default=None), max(seen, default=None)) and (not seen or math.isclose(got[k][3], sum(seen) / len(seen)))
    crop = {(x.raster_id, x.row, x.col) for x in runs.raster_crop_polygon(px, z).collect()}
    assert crop == {(k[0], *p) for k, places in cover.items() for p in places if (k[0], *p) in v}


# --- instances ---------------------------------------------------------------------------------


def test_instances_to_polygons(spark):
    def model():
        def find(row):
            if row["image_id"] == 3:
                return
            ring = np.zeros((20, 30))
            ring[2:9, 2:9] = 0.9
            ring[4:6, 4:6] = 0.1  # a gap, which is filled
            edge = np.zeros((20, 30))
            edge[0:4, 26:30] = 0.71
            edge[10:12, 0:5] = 0.69  # too unlikely
            yield (2, 2, 9, 9), 0.8, ring
            yield (2, 2, 9, 8), 0.7, ring  # suppressed
            yield (26, 0, 30, 4), 0.99, edge
            yield (0, 0, 1, 1), 0.5, np.zeros((20, 30))

        return find

    images = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "image_id long, other string")
    found = instances.segment(images, model)
    assert found.schema["image_id"].dataType.simpleString() == "bigint" and found.count() == 8
    meta = spark.createDataFrame([(1, 0.0, 0.0, 30.0, 20.0, 30, 20, 6933)], "image_id long, xmin double, ymin double, xmax double, ymax double, width int, height int, epsg int")
    got = sorted((r.image_id, r.instance, r.score, len(r.ring), round(r.xmin, 6), round(r.ymin, 6), round(r.xmax, 6), round(r.ymax, 6)) for r in instances.polygons(found, meta).collect())
    assert got == [(1, 0, 0.8, 4, 2.0, 12.0, 8.0, 18.0), (1, 2, 0.99, 4, 26.0, 17.0, 29.0, 20.0)]
    with pytest.raises(Exception, match="image_id"):
        instances.segment(images.select("other"), model).count()


def test_instances_are_numbered_over_the_parts_of_an_image(spark):
    def model():
        return lambda row: [((k, 0, k + 1, 1), 0.9, np.ones((2, 2))) for k in row["xs"]]

    rows = [(1, 3, [5]), (1, 0, [1, 2]), (1, 2, []), (None, 1, [7]), (None, 0, [8, 9]), (2, 6, [4])]
    found = instances.segment(spark.createDataFrame(rows, "image_id int, part long, xs array<int>"), model)
    assert found.columns == ["image_id", *(f.split()[0] for f in instances.FIELDS.split(", "))]
    got = {(x.image_id, x.instance, x.xmin) for x in found.collect()}
    assert got == {(1, 0, 1.0), (1, 1, 2.0), (1, 2, 5.0), (None, 0, 8.0), (None, 1, 9.0), (None, 2, 7.0), (2, 0, 4.0)}


def test_runs_of_a_mask():
    def plain(mask):
        out, last = [0], False
        for v in mask.T.ravel().tolist():
            if v != last:
                out.append(0)
                last = v
            out[-1] += 1
        return out

    r = np.random.default_rng(1)
    masks = [r.random((h, w)) < share for h in (1, 2, 5) for w in (1, 3, 6) for share in (0, 0.1, 0.5, 1)]
    assert [instances.mask_counts(m) for m in masks] == [plain(m) for m in masks]


def test_runs_are_never_broadcast(spark):
    """Many zones of few bytes: Spark reckons the runs as small as the zones (F1)."""
    p = lambda x, y: F.struct((F.col("id") % 3 + x).cast("double").alias("x"), F.lit(float(y)).alias("y"))
    zones = spark.range(40).select(F.lit(0).cast("long").alias("raster_id"), F.col("id").alias("zone_id"), F.array(F.array(p(0, 0), p(4, 0), p(4, 5), p(0, 5))).alias("rings"))
    px = spark.range(60).select(F.lit(0).cast("long").alias("raster_id"), F.floor(F.col("id") / 6).cast("int").alias("row"), (F.col("id") % 6).cast("int").alias("col"), F.col("id").cast("double").alias("v"))
    z = runs.zonal_polygons(px, zones)
    assert "Broadcast" not in z._jdf.queryExecution().executedPlan().toString()
    for x in z.collect():
        v = [r * 6 + c for r in range(5) for c in range(x.zone_id % 3, min(6, x.zone_id % 3 + 4))]
        assert (x.n, x.v_min, x.v_max, round(x.v_mean, 9)) == (len(v), min(v), max(v), round(sum(v) / len(v), 9))


def test_runs_in_small_portions(spark, monkeypatch):
    rings = pa.array([[[{"x": 0.0, "y": 0.0}, {"x": 9.0, "y": 0.0}, {"x": 9.0, "y": 6.0 + i}, {"x": 0.0, "y": 6.0 + i}], [{"x": 3.0, "y": 2.0}, {"x": 5.0, "y": 2.0}, {"x": 5.0, "y": 4.0}, {"x": 3.0, "y": 4.0}]] for i in range(3)] + [None, []])
    of, ends, first, last = runs._crossings(rings, "y", "x")
    row, at, a, b = runs._stretches_of(of, ends, first, last)
    got = sorted(zip(row.tolist(), at.tolist(), a.tolist(), b.tolist(), strict=True))
    assert got == sorted((i, y, *ab) for i in range(3) for y in range(6 + i) for ab in (((0, 3), (5, 9)) if 2 <= y < 4 else ((0, 9),)))
    t = spark.createDataFrame([(i, [[(0.0, 0.0), (5.0, 0.0), (5.0, 50.0 + i), (0.0, 50.0 + i)]]) for i in range(40)], "shape_id long, rings array<array<struct<x:double,y:double>>>").coalesce(1)
    monkeypatch.setattr(runs, "CROSSED", 250)  # two rings and a half
    monkeypatch.setattr(runs, "BAND", 16)
    assert runs.ring_runs(t).count() == sum(50 + i for i in range(40))


def test_box_runs_are_boxes_pixels(spark):
    b = spark.createDataFrame([(0, 1.0, 2.0, 4.0, 5.0), (0, 3.0, 3.0, 6.0, 4.0), (1, 2.0, 2.0, 2.0, 9.0), (1, 5.0, 5.0, 6.0, 5.0)], "image_id int, xmin double, ymin double, xmax double, ymax double")
    u = runs.pixels_of(runs.combine(runs.box_runs(b), ["image_id", "row"]))
    want = metrics.mask_union(metrics.rasterise_boxes(b.filter("xmax > xmin and ymax > ymin")))
    assert sorted(map(tuple, u.select("image_id", "row", "col").collect())) == sorted(map(tuple, want.collect())) != []
