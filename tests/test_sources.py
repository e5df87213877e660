import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql.datasource import EqualTo, GreaterThan, LessThanOrEqual

from gridloom.sources import codecs, geotiff, rasters

AT = (10.0, 20.0, 30.0, 60.0)


@pytest.mark.parametrize("size", [0, 1, 300, 70_000])
def test_lzw_round_trip(size):
    r = np.random.default_rng(size)
    for data in (bytes(size), r.integers(0, 256, size).astype(np.uint8).tobytes(), (r.integers(0, 3, size) * 7).astype(np.uint8).tobytes()):
        assert codecs.lzw_decode(codecs.lzw_encode(data)) == data


def test_lzw_known_codes():
    """Seven sevens and others, of the format's description: clear, 7, 258, 8, 8, 258, 6, end in nine bits each."""
    bits = "".join(f"{c:09b}" for c in (256, 7, 258, 8, 8, 258, 6, 257))
    raw = int(bits.ljust(-(-len(bits) // 8) * 8, "0"), 2).to_bytes(-(-len(bits) // 8), "big")
    assert codecs.lzw_decode(raw) == bytes([7, 7, 7, 8, 8, 7, 7, 6]) and codecs.lzw_encode(bytes([7, 7, 7, 8, 8, 7, 7, 6])) == raw


@pytest.mark.parametrize("how,predictor,dtype", [(geotiff.LZW, 1, "float32"), (geotiff.LZW, 2, "uint8"), (geotiff.DEFLATE, 2, "int16"), (geotiff.PLAIN, 2, "uint16")])
def test_compressed_tiff(how, predictor, dtype):
    px = (np.random.default_rng(1).random((37, 11, 3)) * 200).astype(dtype)
    raw = geotiff.encode(px, AT, 3857, how=how, predictor=predictor, strip=300)
    assert len(geotiff.layout(raw).at) > 3 and (geotiff.decode(raw) == px).all()


@pytest.mark.parametrize("kind", range(5))
@pytest.mark.parametrize("dtype,n", [("uint8", 1), ("uint8", 3), ("uint16", 4), ("uint8", 2)])
def test_png_filters(kind, dtype, n):
    r = np.random.default_rng(kind)
    for h, w in ((1, 1), (7, 5), (3, 20)):
        px = r.integers(0, np.iinfo(dtype).max, (h, w, n), endpoint=True).astype(dtype)
        raw = codecs.png_encode(px, kind)
        assert (codecs.png_decode(raw) == px).all()
        assert [geotiff.describe("a", raw)[c] for c in ("height", "width", "count", "dtype")] == [h, w, n, f"u{px.dtype.itemsize}"]


def test_png_mixed_filters_bits_and_palette():
    px = np.random.default_rng(2).integers(0, 256, (40, 9, 3)).astype(np.uint8)
    lines = []
    for k in range(40):  # every row with another filter
        raw = zlib.decompress(dict(codecs.png_chunks(codecs.png_encode(px, k % 5)))[b"IDAT"])
        lines.append(raw[k * 28 : k * 28 + 28])
    chunk = lambda k, d: len(d).to_bytes(4, "big") + k + d + zlib.crc32(k + d).to_bytes(4, "big")
    head = lambda w, h, depth, colour, laced=0: chunk(b"IHDR", w.to_bytes(4, "big") + h.to_bytes(4, "big") + bytes([depth, colour, 0, 0, laced]))
    file = lambda h, data, extra=b"": codecs.SIGNATURE + h + extra + chunk(b"IDAT", zlib.compress(data)) + chunk(b"IEND", b"")
    assert (codecs.png_decode(file(head(9, 40, 8, 2), b"".join(lines))) == px).all()
    assert codecs.png_decode(file(head(10, 1, 1, 0), bytes([0, 0b10110000, 0b01000000])))[..., 0].tolist() == [[255, 0, 255, 255, 0, 0, 0, 0, 0, 255]]
    assert codecs.png_decode(file(head(3, 1, 2, 3), bytes([0, 0b00011000]), chunk(b"PLTE", bytes(range(9))))).tolist() == [[[0, 1, 2], [3, 4, 5], [6, 7, 8]]]
    with pytest.raises(ValueError):
        codecs.png_decode(file(head(3, 1, 8, 0, 1), bytes(4)))
    with pytest.raises(ValueError):
        codecs.png_decode(b"GIF89a" + bytes(20))


def folder(tmp_path):
    big = (np.arange(400 * 30) % 251).astype(np.uint8).reshape(400, 30, 1)
    (tmp_path / "big.tif").write_bytes(geotiff.encode(big, AT, 3857, how=geotiff.PLAIN, strip=600))
    small = np.arange(12, dtype=np.float32).reshape(3, 4, 1)
    for i in range(3):
        (tmp_path / f"small_{i}.tif").write_bytes(geotiff.encode(small + i, AT, None))
    (tmp_path / "_hidden.tif").write_bytes(b"x")
    return big, small


def test_large_file_in_many_partitions(spark, tmp_path):
    big, small = folder(tmp_path)
    path = f"file://{tmp_path}"
    px = rasters.load(spark, path, split=2000)
    assert px.rdd.getNumPartitions() >= 6
    got = {(r.file, r.row, r.col): r.v for r in px.collect()}
    assert got == {**{("big.tif", r, c): float(big[r, c, 0]) for r in range(400) for c in range(30)}, **{(f"small_{i}.tif", r, c): float(small[r, c, 0]) + i for i in range(3) for r in range(3) for c in range(4)}}
    assert rasters.load(spark, f"{path}/big.tif", ending=".tif").count() == 12_000
    assert sorted((r.file, r.height, r.xmin, r.epsg) for r in geotiff.metadata(spark, path).collect()) == [("big.tif", 400, 10.0, 3857), *[(f"small_{i}.tif", 3, 10.0, None) for i in range(3)]]


def test_window_leaves_strips_out(spark, tmp_path):
    big, _ = folder(tmp_path)
    path = f"file://{tmp_path}"
    w = geotiff.read(spark, path, rows=(100, 139), cols=(28, 99))
    assert {(r.row, r.col): r.v for r in w.collect()} == {(r, c): float(big[r, c, 0]) for r in range(100, 140) for c in (28, 29)}
    options = {"path": path, "split": "1000", "ending": "big.tif"}
    reader = rasters.RasterReader(options | {"row_from": "100", "row_to": "139"})
    assert [(p.files[0][1], p.files[0][2]) for p in reader.partitions()] == [(5, 6), (6, 7)]  # strips of 20 rows
    pushed = rasters.NarrowingReader(options)
    filters = [GreaterThan(("row",), 99), LessThanOrEqual(("row",), 139), EqualTo(("col",), 3), EqualTo(("v",), 1.0)]
    assert list(pushed.pushFilters(filters)) == filters and pushed.window == {"row": [100, 139], "col": [3, 3]}
    assert len(pushed.partitions()) == 2


def test_filters_reach_the_source(spark, tmp_path):
    folder(tmp_path)
    key = "spark.sql.python.filterPushdown.enabled"
    before = spark.conf.get(key)
    spark.conf.set(key, "true")
    try:
        px = rasters.load(spark, f"file://{tmp_path}/big.tif", split=1000).filter("row >= 60 and row < 80")
        assert px.rdd.getNumPartitions() == 1 and px.count() == 600
    finally:
        spark.conf.set(key, before)


def test_write_is_all_or_nothing(spark, tmp_path):
    path = f"file://{tmp_path}/out"
    rows = spark.createDataFrame([(i, bytes([i])) for i in range(20)], "raster_id int, content binary").repartition(4)
    geotiff.write(rows, path)
    assert sorted(p.name for p in (tmp_path / "out").iterdir()) == sorted(f"tile_{i}.tif" for i in range(20))
    with pytest.raises(Exception, match="two files of one name"):
        geotiff.write(rows.withColumn("raster_id", F.col("raster_id") + 19), path)
    with pytest.raises(Exception, match="two files of one name"):
        geotiff.write(rows.unionByName(rows), f"{path}2")
    assert len(list((tmp_path / "out").iterdir())) == 20 and not list((tmp_path / "out2").glob("*"))
    geotiff.write(rows.filter("false"), f"{path}3")


def test_encoding_checks_places_and_range(spark):
    meta = spark.createDataFrame([(1, 0.0, 0.0, 2.0, 2.0, 2, 2, None)], "raster_id long, xmin double, ymin double, xmax double, ymax double, width int, height int, epsg int")
    of = lambda r, v: spark.createDataFrame([(1, r, 0, v)], "raster_id long, row int, col int, v double")
    for px, dtype in ((of(2, 1.0), "uint8"), (of(-1, 1.0), "uint8"), (of(0, 300.0), "uint8"), (of(0, -1.0), "uint8")):
        with pytest.raises(Exception, match="outside|none of"):
            geotiff.encode_rasters(px, meta, dtype=dtype).collect()
    raw = geotiff.encode_rasters(of(1, 255.9), meta, dtype="uint8").first().content
    assert geotiff.decode(bytes(raw))[1, 0, 0] == 255


def test_empty_folder(spark, tmp_path):
    assert rasters.load(spark, f"file://{tmp_path}").count() == 0


def test_scratch_folder_is_removed(spark):
    from pyarrow import fs

    from gridloom.functions.shared import scratch_folder

    there = lambda p: fs.FileSystem.from_uri(p)[0].get_file_info(fs.FileSystem.from_uri(p)[1]).type != fs.FileType.NotFound
    with scratch_folder(spark, "raster") as path:
        rasters.save(spark.createDataFrame([("a.tif", geotiff.encode(np.ones((2, 2, 1), dtype=np.uint8), AT, None))], "file string, content binary"), path)
        assert there(path) and geotiff.read(spark, path).count() == 4
    assert not there(path)
    with pytest.raises(KeyError), scratch_folder(spark, "raster") as path:
        spark.range(3).write.parquet(path)
        raise KeyError
    assert not there(path)
    with scratch_folder(spark, "unused"):
        pass


def test_large_raster_is_packed_strip_by_strip(spark, tmp_path):
    h, w = 5000, 40
    meta = spark.createDataFrame([(1, 0.0, 0.0, 40.0, 5000.0, w, h, 3857), (2, 0.0, 0.0, 2.0, 1.0, 2, 1, None)], "raster_id long, xmin double, ymin double, xmax double, ymax double, width int, height int, epsg int")
    all_ = spark.range(h * w).select(F.lit(1).cast("long").alias("raster_id"), (F.col("id") / w).cast("int").alias("row"), (F.col("id") % w).cast("int").alias("col"), (F.col("id") % 30011).cast("double").alias("v"))
    px = all_.filter("row < 900 or row > 3900").unionByName(spark.createDataFrame([(2, 0, 1, 7.0), (3, 0, 0, 1.0)], all_.schema))
    e = geotiff.encode_rasters(px, meta, dtype="int16", how=geotiff.LZW, predictor=geotiff.HORIZONTAL)
    sizes = [(r.raster_id, r.piece, len(r.content)) for r in e.collect()]
    assert sorted(x[:2] for x in sizes) == [*((1, k) for k in range(8)), (2, 0)]  # strips of 819 rows, two of them without a pixel
    assert max(x[2] for x in sizes) < 2 * geotiff.STRIP
    geotiff.write(e, f"file://{tmp_path}/t")
    want = np.arange(h * w).reshape(h, w, 1) % 30011
    want[900:3901] = 0
    want = want.astype(np.int16)
    raw = (tmp_path / "t/tile_1.tif").read_bytes()
    assert raw == geotiff.encode(want, (0.0, 0.0, 40.0, 5000.0), 3857, how=geotiff.LZW, predictor=geotiff.HORIZONTAL)
    assert geotiff.decode((tmp_path / "t/tile_2.tif").read_bytes()).ravel().tolist() == [0, 7] and not (tmp_path / "t/tile_3.tif").exists()


def test_small_files_share_batches_and_many_partitions(spark, tmp_path):
    for i in range(1500):
        (tmp_path / f"s{i}.tif").write_bytes(geotiff.encode(np.full((2, 2, 1), i, dtype=np.float32), AT, None))
    reader = rasters.RasterReader({"path": f"file://{tmp_path}"})
    parts = reader.partitions()
    assert len(parts) > 1 and sum(len(p.files) for p in parts) == 1500
    assert len(list(reader.read(parts[0]))) == 1
    s = rasters.load(spark, f"file://{tmp_path}").agg(F.count("*").alias("n"), F.sum("v").alias("v")).first()
    assert (s.n, s.v) == (6000, 4 * sum(range(1500)))
