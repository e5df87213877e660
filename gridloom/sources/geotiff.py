"""GeoTIFF rasters as pixel tables and back: baseline files, plain, deflated or LZW, in strips or tiles.

Files are read and written by the source of ``rasters``, which deals the strips and tiles of a large file
to many tasks. Where only Spark can open a store, a file is decoded by one task as a whole (up to 2 GB).
"""

from __future__ import annotations

import dataclasses
import itertools
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.functions.shared import settle
from gridloom.sources import codecs, rasters

# tags, field types and keys of the file format (fixed values)
WIDTH, HEIGHT, BITS, COMPRESSION, PHOTOMETRIC, STRIPS, SAMPLES, STRIP_ROWS, STRIP_BYTES, PLANAR, PREDICTOR = 256, 257, 258, 259, 262, 273, 277, 278, 279, 284, 317
TILE_WIDTH, TILE_HEIGHT, TILES, TILE_BYTES, FORMAT, PIXEL_SCALE, TIEPOINT, GEO_KEYS, NODATA = 322, 323, 324, 325, 339, 33550, 33922, 34735, 42113
TYPES = {1: "B", 2: "s", 3: "H", 4: "I", 11: "f", 12: "d"}
MODEL_KEY, GEOGRAPHIC_KEY, PROJECTED_KEY = 1024, 2048, 3072
PLAIN, LZW, DEFLATE, OLD_DEFLATE = 1, 5, 8, 32946
HORIZONTAL = 2
KINDS = {1: "u", 2: "i", 3: "f"}

META = "file string, height int, width int, count int, dtype string, epsg int, xmin double, ymin double, xmax double, ymax double, nodata double"
#: Pixels of one Arrow batch.
BATCH = 1 << 16


def tags(content) -> tuple[str, dict[int, tuple]]:
    """The byte order and the first directory's values; content is bytes, or anything that gives slices of them."""
    order = {b"II": "<", b"MM": ">"}.get(content[:2])
    unpack = lambda form, at: struct.unpack(form, content[at : at + struct.calcsize(form)])
    if order is None or unpack(order + "H", 2)[0] != 42:
        raise ValueError("not a TIFF file")
    at = unpack(order + "I", 4)[0]
    n = unpack(order + "H", at)[0]
    entries, out = content[at + 2 : at + 2 + 12 * n], {}
    for i in range(n):
        tag, kind, count = struct.unpack_from(order + "HHI", entries, 12 * i)
        if kind in TYPES:
            form = f"{order}{count}{TYPES[kind]}"
            if struct.calcsize(form) > 4:
                out[tag] = unpack(form, struct.unpack_from(order + "I", entries, 12 * i + 8)[0])
            else:
                out[tag] = struct.unpack_from(form, entries, 12 * i + 8)
    return order, out


def describe(name: str, content) -> dict:
    """A row of META: the extent and system are null where the file has none."""
    row = dict.fromkeys(f.split()[0] for f in META.split(", ")) | {"file": name}
    if bytes(content[:8]) == codecs.SIGNATURE:
        h, w, depth, colour, _ = codecs.png_head(content)
        return row | {"height": h, "width": w, "count": 3 if colour == codecs.PALETTE else codecs.SAMPLES[colour], "dtype": "u2" if depth == 16 else "u1"}
    _, t = tags(content)
    h, w = t[HEIGHT][0], t[WIDTH][0]
    row |= {"height": h, "width": w, "count": t.get(SAMPLES, (1,))[0], "dtype": KINDS[t.get(FORMAT, (1,))[0]] + str(t.get(BITS, (1,))[0] // 8)}
    if PIXEL_SCALE in t and TIEPOINT in t:
        (sx, sy, *_), (i, j, _, x, y, *_) = t[PIXEL_SCALE], t[TIEPOINT]
        x, y = x - i * sx, y + j * sy
        row |= {"xmin": x, "ymax": y, "xmax": x + w * sx, "ymin": y - h * sy}
    keys = t.get(GEO_KEYS, ())
    found = {keys[k]: keys[k + 3] for k in range(4, len(keys) - 3, 4)}
    row["epsg"] = found.get(PROJECTED_KEY, found.get(GEOGRAPHIC_KEY))
    if NODATA in t:
        row["nodata"] = float(t[NODATA][0].rstrip(b"\x00 "))
    return row


@dataclasses.dataclass
class Layout:
    """Where a file's blocks (strips or tiles, row by row) are and how they are made."""

    height: int
    width: int
    bands: int
    block_height: int
    block_width: int
    at: tuple
    size: tuple
    dtype: np.dtype
    how: int
    predictor: int

    def place(self, k: int) -> tuple[int, int]:
        """The first row and column of block k."""
        across = -(-self.width // self.block_width)
        return k // across * self.block_height, k % across * self.block_width

    def decode(self, k: int, raw: bytes) -> np.ndarray:
        """The pixels of block k that lie in the raster, height x width x bands."""
        data = raw if self.how == PLAIN else codecs.lzw_decode(raw) if self.how == LZW else zlib.decompress(raw)
        block = np.frombuffer(data, dtype=self.dtype)
        line = self.block_width * self.bands
        block = block[: len(block) // line * line].reshape(-1, self.block_width, self.bands).astype(self.dtype.newbyteorder("="))  # the last strip may be shorter
        if self.predictor == HORIZONTAL:
            block = codecs.add_up(block)
        r, c = self.place(k)
        return block[: self.height - r, : self.width - c]


def layout(content) -> Layout:
    order, t = tags(content)
    h, w, n = t[HEIGHT][0], t[WIDTH][0], t.get(SAMPLES, (1,))[0]
    how, predictor, kind = t.get(COMPRESSION, (PLAIN,))[0], t.get(PREDICTOR, (1,))[0], KINDS[t.get(FORMAT, (1,))[0]]
    if how not in (PLAIN, LZW, DEFLATE, OLD_DEFLATE) or predictor not in (1, HORIZONTAL) or predictor == HORIZONTAL and kind == "f" or t.get(PLANAR, (1,))[0] != 1 or t.get(BITS, (1,))[0] % 8:
        raise ValueError("only plain, deflated or LZW pixels of whole bytes, band by band within a pixel, are read")
    dtype = np.dtype(f"{order}{kind}{t[BITS][0] // 8}")
    if TILES in t:
        return Layout(h, w, n, t[TILE_HEIGHT][0], t[TILE_WIDTH][0], t[TILES], t[TILE_BYTES], dtype, how, predictor)
    return Layout(h, w, n, min(t.get(STRIP_ROWS, (h,))[0], h), w, t[STRIPS], t[STRIP_BYTES], dtype, how, predictor)


def decode(content: bytes) -> np.ndarray:
    """Pixels, height x width x bands, of a TIFF or PNG file."""
    if content[:8] == codecs.SIGNATURE:
        return codecs.png_decode(content)
    y = layout(content)
    out = np.zeros((y.height, y.width, y.bands), dtype=y.dtype.newbyteorder("="))
    for k, (a, s) in enumerate(zip(y.at, y.size, strict=True)):
        part, (r, c) = y.decode(k, content[a : a + s]), y.place(k)
        out[r : r + part.shape[0], c : c + part.shape[1]] = part
    return out


#: Bytes of pixels in a strip, and of encoded pieces in one Arrow batch.
STRIP, PACKED = 1 << 16, 4 << 20


def strip_rows(height: int, width: int, bands: int, item: int, strip: int = STRIP) -> int:
    return max(1, min(height, strip // max(1, width * bands * item)))


def pack_strip(pixels: np.ndarray, how: int, predictor: int) -> bytes:
    """The bytes of a strip of pixels (rows x width x bands)."""
    little = pixels.astype(pixels.dtype.newbyteorder("<"))
    raw = (codecs.differences(little) if predictor == HORIZONTAL else little).tobytes()
    return zlib.compress(raw) if how == DEFLATE else codecs.lzw_encode(raw) if how == LZW else raw


def file_head(shape: tuple[int, int, int], dtype: np.dtype, rows: int, sizes: list[int], extent: tuple[float, float, float, float], epsg: int | None, how: int, predictor: int) -> bytes:
    """What a file of shape (height, width, bands) has before its strips of so many rows and bytes."""
    (h, w, n), (xmin, ymin, xmax, ymax) = shape, extent
    kind = {"u": 1, "i": 2, "f": 3}[dtype.kind]
    if predictor == HORIZONTAL and kind == 3:
        raise ValueError("differences are stored of whole numbers only")
    ahead = [0, *itertools.accumulate(sizes[:-1])]

    def directory(start: int) -> bytes:
        """Everything before the blocks, which begin at start."""
        fields = [
            (WIDTH, 4, (w,)), (HEIGHT, 4, (h,)), (BITS, 3, (dtype.itemsize * 8,) * n), (COMPRESSION, 3, (how,)), (PHOTOMETRIC, 3, (2 if n == 3 else 1,)),
            (STRIPS, 4, [start + x for x in ahead]), (SAMPLES, 3, (n,)), (STRIP_ROWS, 4, (rows,)), (STRIP_BYTES, 4, sizes), (PLANAR, 3, (1,)), (PREDICTOR, 3, (predictor,)),
            (FORMAT, 3, (kind,) * n), (PIXEL_SCALE, 12, ((xmax - xmin) / w, (ymax - ymin) / h, 0.0)), (TIEPOINT, 12, (0.0, 0.0, 0.0, xmin, ymax, 0.0)),
        ]
        if epsg is not None:
            flat = epsg == 4326
            fields.append((GEO_KEYS, 3, (1, 1, 0, 2, MODEL_KEY, 0, 1, 2 if flat else 1, GEOGRAPHIC_KEY if flat else PROJECTED_KEY, 0, 1, epsg)))
        body, entries, after = b"", b"", 8 + 2 + 12 * len(fields) + 4
        for tag, t, values in fields:
            raw = struct.pack(f"<{len(values)}{TYPES[t]}", *values)
            entries += struct.pack("<HHI", tag, t, len(values))
            if len(raw) > 4:
                entries += struct.pack("<I", after + len(body))
                body += raw + b"\x00" * (len(raw) % 2)
            else:
                entries += raw.ljust(4, b"\x00")
        return b"II*\x00" + struct.pack("<IH", 8, len(fields)) + entries + b"\x00" * 4 + body

    length = len(directory(0))
    if length + sum(sizes) >= 1 << 32:
        raise ValueError("a TIFF file holds less than 4 GB")
    return directory(length)


def encode(pixels: np.ndarray, extent: tuple[float, float, float, float], epsg: int | None, deflate: bool = True, how: int | None = None, predictor: int = 1, strip: int = STRIP) -> bytes:
    """A file of pixels (height x width x bands) in strips of about so many bytes.

    how is PLAIN, LZW or DEFLATE (by default what deflate says); predictor HORIZONTAL stores whole numbers
    as differences to the pixel on the left.
    """
    how = (DEFLATE if deflate else PLAIN) if how is None else how
    if predictor == HORIZONTAL and pixels.dtype.kind == "f":
        raise ValueError("differences are stored of whole numbers only")
    rows = strip_rows(*pixels.shape, pixels.dtype.itemsize, strip)
    blocks = [pack_strip(pixels[r : r + rows], how, predictor) for r in range(0, pixels.shape[0], rows)]
    return b"".join((file_head(pixels.shape, pixels.dtype, rows, [len(x) for x in blocks], extent, epsg, how, predictor), *blocks))


def _files(spark: SparkSession, path: str, ending: str) -> DataFrame:
    found = spark.read.format("binaryFile").option("pathGlobFilter", f"*{ending}").option("recursiveFileLookup", "true").load(path)
    return found.select(F.substring_index("path", "/", -1).alias("file"), "content")


def metadata(spark: SparkSession, path: str, ending: str = "") -> DataFrame:
    """A row of META for each file of a folder; only the heads of the files are read."""
    if rasters.opens(path):
        return rasters.load(spark, path, ending=ending, heads=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [describe(*r.values()) for r in b.to_pylist()]
            yield pa.RecordBatch.from_pylist(rows, schema=pa.schema([("file", pa.string()), *((c, pa.int32()) for c in ("height", "width", "count")), ("dtype", pa.string()), ("epsg", pa.int32()), *((c, pa.float64()) for c in ("xmin", "ymin", "xmax", "ymax", "nodata"))]))

    return _files(spark, path, ending).mapInArrow(run, META)


def read(spark: SparkSession, path: str, bands: tuple[str, ...] = ("v",), ending: str = "", rows: tuple[int, int] | None = None, cols: tuple[int, int] | None = None) -> DataFrame:
    """file, row, col and the first bands of the files of a folder; a band that a file lacks is null, nodata are null.

    rows and cols (first, last) make a window; strips and tiles outside it are not read.
    """
    if rasters.opens(path):
        return rasters.load(spark, path, bands, ending, rows, cols)
    names = list(bands)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                px, nodata = decode(r["content"]), describe(r["file"], r["content"])["nodata"]
                h, w, n = px.shape
                flat = px.reshape(h * w, n)
                for a in range(0, h * w, BATCH):
                    part = flat[a : a + BATCH].astype(np.float64)
                    at = np.arange(a, a + len(part))
                    none = np.ones(len(part), dtype=bool)
                    values = [pa.array(part[:, i], mask=part[:, i] == nodata) if i < n else pa.array(np.zeros(len(part)), mask=none) for i in range(len(names))]
                    yield pa.RecordBatch.from_arrays([pa.array([r["file"]] * len(part)), pa.array((at // w).astype(np.int32)), pa.array((at % w).astype(np.int32)), *values], names=["file", "row", "col", *names])

    px = _files(spark, path, ending).mapInArrow(run, "file string, row int, col int, " + ", ".join(f"{c} double" for c in names))
    for name, within in (("row", rows), ("col", cols)):
        px = px if within is None else px.filter(F.col(name).between(*within))
    return px


def _grouped(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[tuple, dict[str, np.ndarray]]]:
    """The stretches of equal keys of sorted batches, each with its key and the columns' values."""
    key, held = None, []

    def whole() -> tuple[tuple, dict[str, np.ndarray]]:
        return key, {c: np.concatenate([h[c] for h in held]) if len(held) > 1 else held[0][c] for c in held[0]}

    for b in batches:
        if not b.num_rows:
            continue
        ks = [b.column(k) for k in keys]
        apart = np.zeros(b.num_rows - 1, dtype=bool)
        for k in ks:
            apart |= pc.fill_null(pc.not_equal(k.slice(1), k.slice(0, len(k) - 1)), True).to_numpy(zero_copy_only=False)
        cuts = [0, *(np.flatnonzero(apart) + 1).tolist(), b.num_rows]
        columns = {c: b.column(c).to_numpy(zero_copy_only=False) for c in b.schema.names if c not in keys}
        for a, z in itertools.pairwise(cuts):
            now = tuple(k[a].as_py() for k in ks)
            if held and now != key:
                yield whole()
                held = []
            key = now
            held.append({c: v[a:z] for c, v in columns.items()})
    if held:
        yield whole()


def _pieces(found: Iterator[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Rows whose last value is content, as batches of about PACKED bytes."""
    rows, size = [], 0
    for row in found:
        rows.append(row)
        size += len(row[-1]) + 100
        if size > PACKED:
            yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
            rows, size = [], 0
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def _sorted(px: DataFrame, *keys: str) -> DataFrame:
    return px.repartition(int(px.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys).sortWithinPartitions(*keys)


def encode_rasters(px: DataFrame, meta: DataFrame, bands: tuple[str, ...] = ("v",), dtype: str = "float32", how: int = DEFLATE, predictor: int = 1) -> DataFrame:
    """raster_id, piece, content: a file of each raster of px (raster_id, row, col, bands), as the pieces that make it up in order.

    A raster of one strip is one piece. The strips of larger ones are packed each for itself, by any task,
    and piece 0 is the file's head; so no task holds more than a strip.
    meta: raster_id, xmin, ymin, xmax, ymax, width, height, epsg. Pixels that px lacks or that are null are 0;
    whole-number types cut decimals off. A pixel outside the raster, or a value that the type can't
    hold, stops it. how and predictor are those of encode().
    """
    kind, n = np.dtype(dtype), len(bands)
    line = F.greatest(F.lit(1), F.col("width").cast("long") * (n * kind.itemsize))
    m = meta.select("raster_id", "xmin", "ymin", "xmax", "ymax", "width", "height", "epsg").dropDuplicates(["raster_id"])
    m = m.withColumn("gl_rows", F.greatest(F.lit(1), F.least(F.col("height"), F.floor(F.lit(STRIP) / line))).cast("int"))
    whole = px.select("raster_id", "row", "col", *[F.col(c).cast("double").alias(c) for c in bands]).join(m, "raster_id")
    dealt = _sorted(whole.withColumn("gl_strip", F.floor(F.col("row") / F.col("gl_rows")).cast("int")), "raster_id", "gl_strip")
    id_type = px.schema["raster_id"].dataType.simpleString()

    def strips(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for (name, k), g in _grouped(batches, ["raster_id", "gl_strip"]):
            h, w, rows = (int(g[c][0]) for c in ("height", "width", "gl_rows"))
            r, c, v = g["row"], g["col"], np.column_stack([g[b] for b in bands])
            if not ((r >= 0) & (r < h) & (c >= 0) & (c < w)).all():
                raise ValueError(f"raster {name} has pixels outside its {h} x {w}")
            v = np.where(np.isnan(v), 0, v)
            if kind.kind != "f" and ((v <= np.iinfo(kind).min - 1) | (v >= np.iinfo(kind).max + 1)).any():
                raise ValueError(f"raster {name} has values that are none of {dtype}")
            out = np.zeros((min(rows, h - k * rows), w, n), dtype=kind)
            out[r - k * rows, c] = v
            content, count = pack_strip(out, how, predictor), -(-h // rows)
            if count == 1:
                epsg = None if np.isnan(g["epsg"][0]) else int(g["epsg"][0])
                content = file_head((h, w, n), kind, rows, [len(content)], tuple(float(g[c][0]) for c in ("xmin", "ymin", "xmax", "ymax")), epsg, how, predictor) + content
            yield name, 0 if count == 1 else k + 1, count, content

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = next(batches, None)
        if first is not None:
            schema = pa.schema([("raster_id", first.schema.field("raster_id").type), ("piece", pa.int32()), ("strips", pa.int32()), ("content", pa.binary())])
            yield from _pieces(strips(itertools.chain([first], batches)), schema)

    packed = settle(dealt.withColumn("epsg", F.col("epsg").cast("double")).mapInArrow(run, f"raster_id {id_type}, piece int, strips int, content binary"), "strips")
    names = ["raster_id", "piece", "content"]
    many = packed.filter("strips > 1")
    if many.isEmpty():
        return packed.select(names)
    large = m.join(many.select("raster_id").distinct(), "raster_id")
    blank = F.udf(lambda rows, w: pack_strip(np.zeros((rows, w, n), dtype=kind), how, predictor), "binary")
    every = large.withColumn("piece", F.explode(F.sequence(F.lit(1), F.ceil(F.col("height") / F.col("gl_rows")).cast("int"))))
    lacking = every.join(many.select("raster_id", "piece"), ["raster_id", "piece"], "left_anti")
    rows = F.least(F.col("gl_rows"), F.col("height") - (F.col("piece") - 1) * F.col("gl_rows"))
    all_ = many.select(names).unionByName(lacking.select("raster_id", "piece", blank(rows, F.col("width")).alias("content")))
    sizes = all_.groupBy("raster_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("piece", F.octet_length("content").alias("size")))), lambda s: s["size"]).alias("sizes"))  # numbers of one file's strips
    head = F.udf(lambda h, w, rows, sizes, x0, y0, x1, y1, epsg: file_head((h, w, n), kind, rows, sizes, (x0, y0, x1, y1), epsg, how, predictor), "binary")
    heads = large.join(sizes, "raster_id").select("raster_id", F.lit(0).alias("piece"), head("height", "width", "gl_rows", "sizes", *[F.col(c).cast("double") for c in ("xmin", "ymin", "xmax", "ymax")], F.col("epsg").cast("int")).alias("content"))
    return packed.filter("strips <= 1").select(names).unionByName(heads).unionByName(all_)


def encode_png(px: DataFrame, bands: tuple[str, ...] = ("v",)) -> DataFrame:
    """raster_id, content: a PNG file of 8 bits of each raster of px (raster_id, row, col, bands), which has to fit a task; null is 0."""

    def files(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for (name,), g in _grouped(batches, ["raster_id"]):
            r, c, v = g["row"], g["col"], np.column_stack([g[b] for b in bands])
            v = np.where(np.isnan(v), 0, v)
            if not ((r >= 0) & (c >= 0)).all() or (v <= -1).any() or (v >= 256).any():
                raise ValueError(f"raster {name} has places below 0 or values that 8 bits can't hold")
            out = np.zeros((r.max() + 1, c.max() + 1, len(bands)), dtype=np.uint8)
            out[r, c] = v
            yield name, codecs.png_encode(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = next(batches, None)
        if first is not None:
            yield from _pieces(files(itertools.chain([first], batches)), pa.schema([("raster_id", first.schema.field("raster_id").type), ("content", pa.binary())]))

    dealt = _sorted(px.select("raster_id", "row", "col", *[F.col(c).cast("double").alias(c) for c in bands]), "raster_id")
    return dealt.mapInArrow(run, f"raster_id {px.schema['raster_id'].dataType.simpleString()}, content binary")


def write(encoded: DataFrame, path: str, prefix: str = "tile_", ending: str = ".tif") -> None:
    """Encoded rasters as files <prefix><raster_id><ending> of a folder; an existing one stops it, and then nothing is written.

    Pieces of a raster are brought into order and written one after the other.
    """
    named = encoded.withColumn("file", F.concat(F.lit(prefix), F.col("raster_id").cast("string"), F.lit(ending)))
    if "piece" in encoded.columns:
        parts = int(encoded.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        named = named.repartition(parts, "file").sortWithinPartitions("file", "piece")
    rasters.save(named, path)
