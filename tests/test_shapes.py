import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.sources import shapes

RING = "array<struct<x:double,y:double>>"
SQUARE, GAP = [(0.0, 0.0), (4.0, 0.0), (4.0, 4.0), (0.0, 4.0)], [(1.0, 1.0), (1.0, 2.0), (2.0, 2.0), (2.0, 1.0)]


def test_bytes_of_a_polygon():
    content, box = shapes.pack_shape(shapes.POLYGON, [np.array(SQUARE), np.array(GAP)])
    assert struct.unpack_from("<i4d2i2i", content) == (5, 0.0, 0.0, 4.0, 4.0, 2, 10, 0, 5) and box == [0, 0, 4, 4]
    points = np.frombuffer(content, "<f8", offset=52).reshape(-1, 2).tolist()
    assert points[:5] == [[0, 4], [4, 4], [4, 0], [0, 0], [0, 4]]  # clockwise and closed
    assert points[5:] == [[2, 1], [2, 2], [1, 2], [1, 1], [2, 1]]  # counterclockwise
    assert shapes.unpack_shape(struct.pack("<i", 0)) is None
    with pytest.raises(ValueError):
        shapes.unpack_shape(struct.pack("<i", 31))


def test_file_heads():
    layer = shapes.Layer(shapes.POINT, [shapes.Field("n", "N", 20, 0)])
    for k in range(3):
        layer.add([np.array([[k, -k]])], [k])
    f = layer.files(4326)
    assert struct.unpack_from(">7i", f["shp"])[6] * 2 == len(f["shp"]) == 100 + 3 * 28 and struct.unpack_from("<2i4d", f["shp"], 28) == (1000, 1, 0.0, -2.0, 2.0, 0.0)
    assert [struct.unpack_from(">2i", f["shx"], 100 + 8 * k) for k in range(3)] == [(50, 10), (64, 10), (78, 10)]
    fields, rows, size, width = shapes.read_fields(f["dbf"])
    assert (rows, size, width, fields[0].name, fields[0].kind) == (3, 65, 21, "n", "N") and len(f["dbf"]) == size + 3 * width + 1
    assert f["prj"].startswith(b"GEOGCS")


def test_round_trip_with_odd_rows(spark, tmp_path):
    path = f"file://{tmp_path}/l"
    rows = [(1, SQUARE, [GAP], 0.1, "Ünï", True), (2, None, None, None, None, None), (3, SQUARE[::-1], [], -1e300, "", False), (-(2**62), SQUARE, None, 1 / 3, "x" * 80, None)]
    d = spark.createDataFrame(rows, f"id long, ring {RING}, holes array<{RING}>, v double, s string, b boolean").coalesce(1)
    shapes.write(d, path, "trees", epsg=3857)
    assert sorted(p.name for p in (tmp_path / "l").iterdir()) == [f"trees.{e}" for e in ("cpg", "dbf", "prj", "shp", "shx")]
    back = shapes.read(spark, path)
    assert [tuple(r) for r in back.orderBy("record").select("file", "id", "v", "s", "b").collect()] == [("trees.shp", i, v, s or None, b) for i, _, _, v, s, b in rows]
    assert back.filter("id = 2").first().parts is None
    p = {r.id: (r.ring, r.holes) for r in shapes.as_polygons(back).collect()}
    turn = lambda r: sum(a.x * b.y - b.x * a.y for a, b in zip(r, [*r[1:], r[0]], strict=True)) / 2
    assert {k: (turn(r), [turn(h) for h in hs]) for k, (r, hs) in p.items()} == {1: (16, [-1]), 3: (16, []), -(2**62): (16, [])}
    with pytest.raises(Exception, match="already"):
        shapes.write(d, path, "trees")


def test_many_files_and_partitions(spark, tmp_path):
    path = f"file://{tmp_path}/m"
    k = F.col("id")
    d = spark.range(500).select("id", (k * 1.5).alias("cx"), (k * -0.5).alias("cy"), (k * 3).alias("xmin"), (k + 1).alias("ymin"), (k * 3 + 2).alias("xmax"), (k + 5).alias("ymax"))
    shapes.write(d.repartitionByRange(3, "id").sortWithinPartitions("id"), path, "points", "centroids", file_bytes=4000)
    names = sorted((p.name for p in (tmp_path / "m").glob("*.shp")), key=lambda n: int(n[7:-4]))
    assert len(names) > 5
    back = shapes.read(spark, path, split=1000)
    assert back.rdd.getNumPartitions() > len(names)
    got = {r.id: (r.parts[0][0].x, r.parts[0][0].y) for r in back.collect()}
    assert got == {i: (i * 1.5, i * -0.5) for i in range(500)}
    first = {n: i for n, i in back.groupBy("file").agg(F.min("id")).collect()}
    assert [first[n] for n in names] == sorted(first.values())  # files in the order of the partitions
    shapes.write(d, f"{path}2", "boxes", "bounding_boxes")
    assert shapes.read(spark, f"{path}2").select(F.size(F.col("parts")[0]).alias("n")).distinct().collect() == [(4,)]


def test_what_is_refused(spark, tmp_path):
    d = spark.createDataFrame([(1, SQUARE, "x" * 81)], f"id long, ring {RING}, s string")
    for bad, said in ((d, "no room"), (d.select("ring", F.col("id").alias("a_long_name_1")), "longer than"), (d.select("ring", F.array("id").alias("a")), "no type")):
        with pytest.raises(Exception, match=said):
            shapes.write(bad, f"file://{tmp_path}/r", "x")
    with pytest.raises(ValueError):
        shapes.write(d, f"file://{tmp_path}/r", "x", "lines")
    shapes.write(d.filter("false"), f"file://{tmp_path}/e", "x")
    with pytest.raises(Exception, match="no shapefile"):
        shapes.read(spark, f"file://{tmp_path}/e").count()


def test_small_shapes_are_packed_without_arrays(monkeypatch):
    """The bytes are those of arrays, and the writer makes no arrays of small shapes."""
    for kind in (shapes.POLYGON, shapes.LINE):
        for parts in ([[0.0, 0.0, 4.0, 0.0, 4.0, 3.0]], [[0.0, 0.0, 4.0, 3.0, 4.0, 0.0]], [[0.0, 0.0, 9.0, 0.0, 9.0, 9.0, 0.0, 9.0, 0.0, 0.0], [2.0, 2.0, 2.0, 3.0, 3.0, 3.0]], [[1.0, 1.0, 2.0, 2.0, 3.0, 3.0]], [[5.0, 5.0]], [[], []], []):
            want = shapes.pack_shape(kind, [np.array(p, dtype=np.float64).reshape(-1, 2) for p in parts])
            assert shapes.pack_small(kind, parts) == want
    layer = shapes.Layer(shapes.POLYGON, [])
    monkeypatch.setattr(shapes, "pack_shape", lambda *a: pytest.fail("made arrays"))
    layer.add([[0.0, 0.0, 4.0, 0.0, 4.0, 3.0]], [])
    assert layer.box == [0.0, 0.0, 4.0, 3.0]
