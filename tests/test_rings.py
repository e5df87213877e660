import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_golden import GOLDEN, framed, mask

from gridloom.operators import overlay, polygons, rings, vector

RING = "array<struct<x:double,y:double>>"


def parity(points, q):
    """Whether each of the places q lies inside a ring."""
    c = np.zeros(len(q), dtype=int)
    for (ax, ay), (bx, by) in zip(points, np.roll(points, -1, axis=0), strict=True):
        k = (ay <= q[:, 1]) != (by <= q[:, 1])
        with np.errstate(all="ignore"):
            c += k & (ax + (q[:, 1] - ay) / (by - ay) * (bx - ax) < q[:, 0])
    return c % 2


def area(ring):
    return vector.signed_area(np.array([(p.x, p.y) for p in ring]))


def perimeter(ring):
    return sum(math.dist((p.x, p.y), (q.x, q.y)) for p, q in zip(ring, [*ring[1:], ring[0]], strict=True))


def blob(seed, h, w, share):
    r = random.Random(seed)
    return ["".join(r.choices("#.", (share, 1 - share), k=w)) for _ in range(h)]


@pytest.mark.parametrize("side", [256, 4, 3])
def test_rings_measure_as_cells_do(spark, side):
    shapes = {i: framed(GOLDEN[n][0]) for i, n in enumerate(GOLDEN)} | {100 + s: blob(s, 13, 17, p) for s, p in enumerate((0.5, 0.7, 0.85, 1.0))}
    px = mask(spark, shapes)
    got = rings.polygonize_rings(px, side).collect()
    want = polygons.polygonize(px, side).collect()
    key = lambda i, a, p, *box: (i, round(a, 6), round(p, 6), *box)
    mine = sorted(key(r.raster_id, -area(r.ring), perimeter(r.ring), min(p.x for p in r.ring), min(p.y for p in r.ring)) for r in got)
    assert mine == sorted(key(r.raster_id, r.area, r.perimeter, r.xmin, r.ymin) for r in want)
    assert not any(r.hole for r in got)
    for r in got:  # simple, only turns, from the topmost point on
        points = [(p.x, p.y) for p in r.ring]
        assert len(set(points)) == len(points) and points[0] == min(points, key=lambda p: (p[1], p[0]))
        assert all((b[0] - a[0]) * (c[1] - b[1]) != (b[1] - a[1]) * (c[0] - b[0]) for a, b, c in zip(points, [*points[1:], points[0]], [*points[2:], *points[:2]], strict=True))


def test_one_object_over_many_tiles(spark):
    snake = ["#" * 20 if r % 4 in (0, 1) else ("." * 18 + "##" if r % 8 in (2, 3) else "##" + "." * 18) for r in range(30)]
    whole = rings.polygonize_rings(mask(spark, {1: framed(snake)})).collect()
    cut = rings.polygonize_rings(mask(spark, {1: framed(snake)}), 4).collect()
    assert len(whole) == len(cut) == 1 and whole[0].ring == cut[0].ring


def test_gaps_are_rings_where_not_filled(spark):
    px = mask(spark, {1: framed(["#####", "#####", "##.##", "#####", "#####"])})
    assert [(r.hole, abs(area(r.ring))) for r in rings.polygonize_rings(px, 3).collect()] == [(False, 16.0)]
    got = rings.polygonize_rings(px, 3, fill=False).collect()
    assert sorted((r.hole, abs(area(r.ring))) for r in got) == [(False, 16.0), (True, 2.0)]


def test_nulls_empty_and_features(spark):
    px = mask(spark, {1: framed(["###"] * 3)})
    assert rings.polygonize_rings(px.filter("row < 0")).collect() == []
    assert rings.polygonize_rings(px.withColumn("on", F.lit(None).cast("boolean"))).collect() == []
    meta = spark.createDataFrame([(1, 10.0, 20.0, 10.5, 20.5, 5, 5, 6933), (2, 0.0, 0.0, 1.0, 1.0, 5, 5, 6933)], "raster_id long, xmin double, ymin double, xmax double, ymax double, width int, height int, epsg int")
    f = rings.ring_features(rings.polygonize_rings(px), meta).collect()
    m = polygons.measure_georeferenced(px, meta).first()
    assert len(f) == 1 and f[0].id == 0 and area(f[0].ring) > 0
    for c in ("area_m2", "perim_m", "a_diam_m", "xmin", "ymin", "xmax", "ymax"):
        assert math.isclose(f[0][c], m[c], rel_tol=1e-9), c
    assert spark.range(1).select(rings.wkt(F.array().cast(RING)).alias("e"), rings.wkt(F.lit(None).cast(RING)).alias("n")).first() == ("POLYGON EMPTY", None)


# --- repair ------------------------------------------------------------------------------------


def test_repair_known_cases():
    of = lambda *p: [x.tolist() for x in overlay.repair(np.array(p, dtype=float))]
    assert of((0, 0), (2, 2), (2, 0), (0, 2)) == [[[0, 0], [1, 1], [0, 2]], [[2, 0], [2, 2], [1, 1]]]
    assert of((0, 0), (4, 0), (4, 4), (6, 4), (4, 4), (0, 4), (0, 4)) == [[[0, 0], [4, 0], [4, 4], [0, 4]]]
    assert of((0, 0), (1, 1), (2, 2)) == of((0, 0), (0, 0)) == of((1, 1), (1, 1), (1, 1)) == of((0, 0), (np.nan, 1), (1, 1)) == []
    inner = of((0, 0), (9, 0), (9, 9), (0, 9), (0, 0), (3, 3), (3, 6), (6, 6), (6, 3), (3, 3))
    assert sorted(vector.signed_area(np.array(r)) for r in inner) == [-9, 81]


def test_repair_keeps_the_even_odd_inside():
    r = np.random.default_rng(7)
    for t in range(150):
        n = r.integers(3, 14)
        p = r.integers(0, 7, (n, 2)).astype(float) if t % 2 else r.random((n, 2)) * 10
        parts, q = overlay.repair(p), r.random((300, 2)) * 12 - 1
        assert (parity(p, q) == sum((parity(a, q) for a in parts), np.zeros(len(q), dtype=int)) % 2).all()
        if t % 2 == 0:  # whole again
            assert all(len(overlay.repair(a)) == 1 for a in parts if abs(vector.signed_area(a)) > 1e-6)


def test_many_rings_are_repaired_as_one_by_one():
    r = np.random.default_rng(3)
    given = [np.zeros((0, 2)), np.ones((4, 2)), np.array([[0.0, 0], [1, 0], [np.nan, 1], [1, 1]])]
    for i in range(300):
        p = r.integers(0, 7, (r.integers(3, 9), 2)) + r.integers(0, 100) * 0.37 if i % 2 else r.random((r.integers(3, 15), 2)) * 10
        p = np.insert(p, 1, p[0], axis=0) if i % 7 == 0 else p
        given.append(np.concatenate((p[:2], p[1:2] + 5, p[1:2], p[2:])) if i % 11 == 0 else p)
    for p, parts in zip(given, overlay.repair_many(given), strict=True):
        assert [x.tolist() for x in parts] == [x.tolist() for x in overlay.repair(p)]


def test_a_small_file_of_rings_is_repaired_in_many_tasks(spark, tmp_path):
    from gridloom.plans.catalogue import queries

    spark.range(400).select(F.col("id").alias("p_partkey"), F.lit(5).alias("p_size"), F.lit(900.0).alias("p_retailprice")).coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    assert queries()["repair_rings"](spark, str(tmp_path)).select(F.spark_partition_id()).distinct().count() > 4


def test_repair_column(spark):
    bow = [(0.0, 0.0), (2.0, 2.0), (2.0, 0.0), (0.0, 2.0)]
    d = spark.createDataFrame([(1, bow), (2, None), (3, []), (4, [(0.0, 0.0), (None, 1.0), (1.0, 0.0), (0.0, 1.0)])], f"i int, ring {RING}")
    got = {r.i: (r.a, r.b) for r in d.select("i", overlay.repair_parts(F.col("ring")).alias("a"), overlay.repair_parts(F.col("ring"), True).alias("b")).collect()}
    assert len(got[1][0]) == 2 and got[1][1] == [] and got[2] == (None, None) and got[3] == ([], [])
    assert [area(x) for x in got[4][0]] == [0.5] and len(got[4][1]) == 1


# --- dissolve ----------------------------------------------------------------------------------


def star(r, x, y, size, corners):
    at = np.sort(r.random(corners)) * 2 * np.pi
    far = size * (0.3 + 0.7 * r.random(corners))
    return np.column_stack((x + far * np.cos(at), y + far * np.sin(at)))


def table(spark, features):
    return spark.createDataFrame([(i, [tuple(map(float, p)) for p in ring]) for i, ring in features], f"raster_id long, ring {RING}").withColumns({"area": F.lit("x"), "holes": F.lit(1), "id": F.lit(2)})


@pytest.mark.parametrize("cell,whole", [(None, False), (1000.0, False), (0.9, False), (1.0, True)])
def test_dissolve_covers_what_any_ring_does(spark, cell, whole):
    r = np.random.default_rng(3)
    of = lambda n, far, size: [star(r, *r.random(2) * far, size, r.integers(5, 9)) for _ in range(n)]
    given = {1: of(25, 8, 1.5), 2: of(6, 20, 1.0), -5: of(12, 3, 2.0)}
    if whole:
        given = {k: [np.rint(p * 2) for p in v] for k, v in given.items()}
        given = {k: [x for p in v for x in overlay.repair(p) if vector.signed_area(x) > 0] for k, v in given.items()}
    got = overlay.dissolve(table(spark, [(k, p) for k, v in given.items() for p in v]), cell=cell, crowd=200).collect()
    q = r.random((3000, 2)) * 26 - 3
    q = q if not whole else r.random((3000, 2)) * 46 - 4
    for k, v in given.items():
        covered = np.max([parity(p, q) for p in v], axis=0)
        mine = [x for x in got if x.raster_id == k]
        inside = lambda ring: parity(np.array([(p.x, p.y) for p in ring]), q)
        each = [inside(x.ring) - sum((inside(h) for h in x.holes), np.zeros(len(q), dtype=int)) for x in mine]
        assert (np.sum(each, axis=0) == covered).mean() > 0.9995  # places within a quantum of a side aside
        assert all(x.area > 0 and math.isclose(x.area, area(x.ring) + sum(map(area, x.holes)), rel_tol=1e-9) for x in mine)
        assert all(area(h) < 0 for x in mine for h in x.holes)


def test_dissolve_known_cases(spark):
    box = lambda x, y, w, h: [(x, y), (x + w, y), (x + w, y + h), (x, y + h)]
    cases = {
        1: ([box(0, 0, 2, 2), box(1, 1, 2, 2)], [(7.0, 0)]),
        2: ([box(0, 0, 2, 2), box(2, 0, 2, 2)], [(8.0, 0)]),  # a shared side unites
        3: ([box(0, 0, 2, 2), box(2, 2, 2, 2)], [(4.0, 0), (4.0, 0)]),  # a shared corner doesn't
        4: ([box(0, 0, 6, 2), box(0, 4, 6, 2), box(0, 0, 2, 6), box(4, 0, 2, 6)], [(32.0, 1)]),
        5: ([box(0, 0, 9, 9), box(3, 3, 1, 1), box(0, 0, 9, 9)], [(81.0, 0)]),
        6: ([box(0, 0, 2, 2)[::-1], box(1, 0, 2, 2)], [(6.0, 0)]),
        7: ([box(0, 0, 9, 1), box(0, 8, 9, 1), box(0, 0, 1, 9), box(8, 0, 1, 9), box(3, 3, 3, 3)], [(9.0, 0), (32.0, 1)]),
    }
    for cell in (None, 0.5, 64.0):
        got = overlay.dissolve(table(spark, [(k, r) for k, (v, _) in cases.items() for r in v]), cell=cell).collect()
        assert {k: sorted((round(x.area, 4), len(x.holes)) for x in got if x.raster_id == k) for k in cases} == {k: sorted(w) for k, (_, w) in cases.items()}


def test_dissolve_odd_rows(spark):
    unit = [(0, 0), (1, 0), (1, 1), (0, 1)]
    d = table(spark, [(None, unit), (None, unit), (1, [(0, 0), (1, 1)]), (2, [])]).unionByName(spark.createDataFrame([(3, None), (4, [(0.0, 0.0), (1.0, float("nan")), (1.0, 1.0)]), (5, [(0.0, 0.0), (1.0, None), (1.0, 1.0)])], f"raster_id long, ring {RING}"), allowMissingColumns=True)
    got = overlay.dissolve(d).collect()
    assert [(r.raster_id, round(r.area, 6)) for r in got] == [(None, 1.0)]
    assert overlay.dissolve(d.filter("false")).collect() == []


def test_dissolve_leaves_out_rings_inside_of_others(spark, monkeypatch):
    r, written, settle = np.random.default_rng(6), {}, overlay.settle

    def counted(df, name):
        out = settle(df, name)
        written[name] = out.count()
        return out

    monkeypatch.setattr(overlay, "settle", counted)
    box = lambda x, y, w, h: [(x, y), (x + w, y), (x + w, y + h), (x, y + h)]
    rings_ = [(1, box(0, 0, w, h)) for w in range(1, 31) for h in range(1, 21)] + [(2, box(*r.integers(1, 12, 2), *r.integers(1, 9, 2))) for _ in range(400)] + [(2, box(0, 0, 20, 20))]
    rings_ += [(3, [(0, 0), (40, 0), (40, 9), (0, 30)]), (3, box(30, 10, 9, 9)), (3, box(1, 1, 9, 9)), (3, box(38, 6, 2, 8)[::-1])]  # two reach over the slanted side
    got = overlay.dissolve(table(spark, rings_)).collect()
    assert {x.raster_id: round(x.area, 3) for x in got if x.raster_id < 3} == {1: 600.0, 2: 400.0}
    three = [x for x in got if x.raster_id == 3]
    q = r.random((4000, 2)) * 42 - 1
    covered = np.max([parity(np.array(p, dtype=float), q) for k, p in rings_ if k == 3], axis=0)
    assert (sum(parity(np.array([(p.x, p.y) for p in x.ring]), q) - sum((parity(np.array([(p.x, p.y) for p in h]), q) for h in x.holes), np.zeros(len(q), dtype=int)) for x in three) == covered).all()
    assert written["dissolve"] > 800 and written["dissolve-segments"] < 300


def test_which_rings_hold_others():
    ring = lambda *p: 2 * np.array(p)
    five = [(round(1000 * np.cos(k * np.pi * 0.4)), round(1000 * np.sin(k * np.pi * 0.4))) for k in range(5)]
    assert overlay._holder(ring((0, 0), (4, 0), (4, 3), (0, 3)))[2] is None  # its box
    assert overlay._holder(ring(*five)) is not None and overlay._holder(ring(*five[::-1])) is not None
    assert overlay._holder(ring(*(five[2 * k % 5] for k in range(5)))) is None  # a star turns left only, but twice around
    assert overlay._holder(ring((0, 0), (4, 0), (1, 1), (0, 4))) is None and overlay._holder(ring((0, 0), (1 << 29, 0), (0, 4))) is None
    points = np.concatenate((ring(*five), ring((0, 0), (9, 0), (0, 9)), ring((700, 700), (800, 700), (700, 800)), ring((1000, 0), (0, 5), (0, 0))))
    start = np.array([0, 5, 8, 11, 14])
    low, high = np.minimum.reduceat(points, start[:-1]), np.maximum.reduceat(points, start[:-1])
    assert overlay._covered(overlay._holder(points[:5]), np.array([1, 2, 3]), points, start, low, high).tolist() == [True, False, True]


def test_dissolve_chain_over_many_cells(spark):
    chain = [(1, [(3 * i, 0), (3 * i + 4, 0.5), (3 * i + 4, 1.5), (3 * i, 1)]) for i in range(300)]
    got = overlay.dissolve(table(spark, chain), cell=2.5).collect()
    assert len(got) == 1 and got[0].holes == []
    q = np.column_stack((np.linspace(0.01, 903.9, 2000), np.full(2000, 0.95)))
    covered = np.max([parity(np.array(p, dtype=float), q) for _, p in chain], axis=0)
    assert (parity(np.array([(p.x, p.y) for p in got[0].ring]), q) == covered).all()


@pytest.mark.parametrize("side", [256, 4, 3])
def test_components_by_eight_neighbours(spark, side):
    shapes = {s: blob(s, 11, 14, p) for s, p in enumerate((0.25, 0.4, 0.5, 0.6))}
    px = mask(spark, shapes).filter("on").drop("on")
    want = {}
    for i, rows in shapes.items():
        left = {(r, c) for r, line in enumerate(rows) for c, v in enumerate(line) if v == "#"}
        while left:
            part, edge = set(), [min(left)]
            while edge:
                r, c = edge.pop()
                if (r, c) in left:
                    left.discard((r, c))
                    part.add((r, c))
                    edge += [(r + a, c + b) for a in (-1, 0, 1) for b in (-1, 0, 1)]
            want |= {(i, *p): min(part) for p in part}
    got = {(x.raster_id, x.row, x.col): (x.lrow, x.lcol) for x in polygons.pixel_components(px, side).collect()}
    assert got == want
