"""Shapefiles as a data source of Spark: vector layers that other tools read, with geometry and attributes.

Reading: the record index (.shx) tells where any record lies and attribute rows (.dbf) are of one length,
so a partition is a range of records of a file, however large it is. Writing: a task keeps a file's
bodies in memory up to ``FILE_BYTES``, then writes .shp, .shx, .dbf, .cpg and, for a known system, .prj to
a hidden folder; the driver names and moves the files of the tasks that Spark counts. One file is called
<name>.shp, several <name>_0.shp, <name>_1.shp and so on, in the order of the partitions.

Rings are stored closed and clockwise, gaps counterclockwise, as the format asks; they are read back without the
repeated point. Numbers are written so that they read back as they were.
"""

from __future__ import annotations

import dataclasses
import datetime
import math
import struct
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from gridloom.operators import vector
from gridloom.sources.rasters import STAGED

NAME = "gridloom_shapes"
#: Bytes of shapes that a partition reads, and of a file that is written.
SPLIT, FILE_BYTES = 16 << 20, 256 << 20
#: Numbers of a shape up to which it is packed without arrays.
SMALL = 128
# codes, versions and widths of the format (fixed values)
FILE_CODE, VERSION, NULL, POINT, LINE, POLYGON = 9994, 1000, 0, 1, 3, 5
WHOLE, REAL, TEXT, LONGEST_NAME = 18, 24, 80, 10
# coordinate systems in their text form (fixed values)
_WGS = 'GEOGCS["GCS_WGS_1984",DATUM["D_WGS_1984",SPHEROID["WGS_1984",6378137.0,298.257223563]],PRIMEM["Greenwich",0.0],UNIT["Degree",0.0174532925199433]]'
SYSTEMS = {
    4326: _WGS,
    3857: f'PROJCS["WGS_1984_Web_Mercator_Auxiliary_Sphere",{_WGS},PROJECTION["Mercator_Auxiliary_Sphere"],PARAMETER["False_Easting",0.0],PARAMETER["False_Northing",0.0],PARAMETER["Central_Meridian",0.0],PARAMETER["Standard_Parallel_1",0.0],PARAMETER["Auxiliary_Sphere_Type",0.0],UNIT["Meter",1.0]]',
    6933: f'PROJCS["WGS_1984_NSIDC_EASE-Grid_2.0_Global",{_WGS},PROJECTION["Cylindrical_Equal_Area"],PARAMETER["False_Easting",0.0],PARAMETER["False_Northing",0.0],PARAMETER["Central_Meridian",0.0],PARAMETER["Standard_Parallel_1",30.0],UNIT["Meter",1.0]]',
}

PARTS = "array<array<struct<x:double,y:double>>>"


# --- records -----------------------------------------------------------------------------------


def head(kind: int, size: int, box: list[float]) -> bytes:
    """The 100 bytes that .shp and .shx begin with; size is that of the whole file."""
    return struct.pack(">7i", FILE_CODE, 0, 0, 0, 0, 0, size // 2) + struct.pack("<2i8d", VERSION, kind, *box, 0, 0, 0, 0)


def pack_shape(kind: int, parts: list[np.ndarray] | None) -> tuple[bytes, list[float] | None]:
    """A record's content and box; parts are n x 2, a polygon's closed here and turned (the first is outer, those of another turn are gaps)."""
    parts = [p for p in parts or [] if len(p)]
    if not parts:
        return struct.pack("<i", NULL), None
    if kind == POINT:
        x, y = parts[0][0]
        return struct.pack("<i2d", POINT, x, y), [x, y, x, y]
    if kind == POLYGON:
        first = vector.signed_area(parts[0]) < 0
        parts = [p if first else p[::-1] for p in parts]
        parts = [p if (p[0] == p[-1]).all() else np.concatenate((p, p[:1])) for p in parts]
    points = np.concatenate(parts)
    box = [*points.min(axis=0).tolist(), *points.max(axis=0).tolist()]
    starts = np.cumsum([0, *map(len, parts[:-1])])
    return struct.pack(f"<i4d2i{len(parts)}i", kind, *box, len(parts), len(points), *starts.tolist()) + points.astype("<f8").tobytes(), box


def pack_small(kind: int, parts: list[list[float]]) -> tuple[bytes, list[float] | None]:
    """pack_shape() of lines and polygons of few points, each part a list x, y, x, y ...; arrays would cost more than they save."""
    parts = [p for p in parts if p]
    if not parts:
        return struct.pack("<i", NULL), None
    if kind == POLYGON:
        p = parts[0]
        x0, y0 = p[0], p[1]
        twice = sum((p[i - 2] - x0) * (p[i + 1] - y0) - (p[i] - x0) * (p[i - 1] - y0) for i in range(0, len(p), 2))
        if not twice < 0:
            parts = [[c for i in range(len(p) - 2, -1, -2) for c in p[i : i + 2]] for p in parts]
        parts = [p if p[0] == p[-2] and p[1] == p[-1] else p + p[:2] for p in parts]
    flat = [c for p in parts for c in p]
    box = [min(flat[::2]), min(flat[1::2]), max(flat[::2]), max(flat[1::2])]
    starts, n = [], 0
    for p in parts:
        starts.append(n)
        n += len(p) // 2
    return struct.pack(f"<i4d2i{len(parts)}i{len(flat)}d", kind, *box, len(parts), n, *starts, *flat), box


def unpack_shape(content: bytes) -> list[np.ndarray] | None:
    rings = unpack_raw(content)
    return None if rings is None else [np.frombuffer(r, dtype="<f8").reshape(-1, 2) for r in rings]


def unpack_raw(content: bytes) -> list[bytes] | None:
    """The parts of a record as the bytes of their numbers, polygons without the repeated point."""
    kind = struct.unpack_from("<i", content)[0]
    if kind == NULL:
        return None
    if kind > 30 or kind % 10 not in (POINT, LINE, POLYGON):
        raise ValueError(f"shapes of kind {kind} aren't read")
    if kind % 10 == POINT:
        return [content[4:20]]
    n, m = struct.unpack_from("<2i", content, 36)
    cuts, zero = [*struct.unpack_from(f"<{n}i", content, 44), m], 44 + 4 * n
    out = [content[zero + 16 * a : zero + 16 * z] for a, z in zip(cuts, cuts[1:], strict=False)]
    twice = lambda r: len(r) > 16 and all(p == q for p, q in zip(struct.unpack_from("<2d", r), struct.unpack_from("<2d", r, len(r) - 16), strict=True))
    return [r[:-16] if kind % 10 == POLYGON and twice(r) else r for r in out]


@dataclasses.dataclass
class Field:
    """An attribute: its name, type (N, C, L), width and decimals."""

    name: str
    kind: str
    width: int
    decimals: int

    def ddl(self) -> str:
        return f"`{self.name}` " + {"C": "string", "L": "boolean", "D": "string"}.get(self.kind, "double" if self.decimals else "bigint")

    def pack(self, v) -> bytes:
        if v is None:
            return b"?" if self.kind == "L" else b" " * self.width
        if self.kind == "L":
            return b"T" if v else b"F"
        if self.kind == "C":
            raw = str(v).encode()
            out = raw.ljust(self.width)
        else:
            out = (repr(float(v)) if self.decimals else str(int(v))).encode().rjust(self.width)
        if len(out) > self.width:
            raise ValueError(f"{v!r} has no room in {self.width} bytes of {self.name}")
        return out

    def unpack(self, raw: bytes):
        if self.kind == "L":
            return {b"T": True, b"t": True, b"Y": True, b"y": True, b"F": False, b"f": False, b"N": False, b"n": False}.get(raw)
        text = raw.decode("utf-8", "replace").strip("\x00 ")
        if self.kind in "CD":
            return text or None
        if not text or text.startswith("*"):
            return None
        return float(text) if self.decimals else int(float(text)) if "." in text or "e" in text.lower() else int(text)


def table_head(fields: list[Field], rows: int) -> bytes:
    size = 32 + 32 * len(fields) + 1
    today = datetime.date(2024, 1, 1)
    out = struct.pack("<4BIHH20x", 3, today.year - 1900, today.month, today.day, rows, size, 1 + sum(f.width for f in fields))
    for f in fields:
        out += struct.pack("<11sc4xBB14x", f.name.encode(), f.kind.encode(), f.width, f.decimals)
    return out + b"\r"


def read_fields(raw: bytes) -> tuple[list[Field], int, int, int]:
    """The fields of a .dbf, and its number of rows, head's and row's bytes."""
    rows, size, row = struct.unpack_from("<IHH", raw, 4)
    out = []
    for at in range(32, size - 1, 32):
        if raw[at : at + 1] == b"\r":
            break
        name, kind, width, decimals = struct.unpack_from("<11sc4xBB", raw, at)
        out.append(Field(name.rstrip(b"\x00 ").decode("utf-8", "replace").partition("\x00")[0], kind.decode(), width, decimals))
    return out, rows, size, row


def fields_of(schema: pa.Schema, text: int = TEXT) -> list[Field]:
    out = []
    for f in schema:
        if len(f.name.encode()) > LONGEST_NAME:
            raise ValueError(f"the name {f.name} is longer than {LONGEST_NAME} bytes")
        if pa.types.is_integer(f.type):
            out.append(Field(f.name, "N", WHOLE + 2, 0))
        elif pa.types.is_floating(f.type) or pa.types.is_decimal(f.type):
            out.append(Field(f.name, "N", REAL, 15))
        elif pa.types.is_boolean(f.type):
            out.append(Field(f.name, "L", 1, 0))
        elif pa.types.is_string(f.type) or pa.types.is_large_string(f.type):
            out.append(Field(f.name, "C", text, 0))
        else:
            raise ValueError(f"{f.name} is {f.type}, which a shapefile has no type for")
    return out


class Layer:
    """One file's bodies as they grow."""

    def __init__(self, kind: int, fields: list[Field]) -> None:
        self.kind, self.fields, self.box = kind, fields, [math.inf, math.inf, -math.inf, -math.inf]
        self.shapes, self.index, self.rows, self.n = bytearray(), bytearray(), bytearray(), 0

    def add(self, parts: list[list[float]] | None, values: list) -> None:
        """A record of parts, each x, y, x, y ..., and attributes."""
        small = parts is not None and self.kind != POINT and sum(map(len, parts)) <= SMALL and all(c is not None and c == c for p in parts for c in p)
        content, box = pack_small(self.kind, parts) if small else pack_shape(self.kind, None if parts is None else [np.array(p, dtype=np.float64).reshape(-1, 2) for p in parts])
        self.n += 1
        self.index += struct.pack(">2i", (100 + len(self.shapes)) // 2, len(content) // 2)
        self.shapes += struct.pack(">2i", self.n, len(content) // 2) + content
        self.rows += b" " + b"".join(f.pack(v) for f, v in zip(self.fields, values, strict=True))
        if box:
            self.box = [min(self.box[0], box[0]), min(self.box[1], box[1]), max(self.box[2], box[2]), max(self.box[3], box[3])]

    def files(self, epsg: int | None) -> dict[str, bytes]:
        box = self.box if self.box[0] <= self.box[2] else [0.0] * 4
        out = {"shp": head(self.kind, 100 + len(self.shapes), box) + self.shapes, "shx": head(self.kind, 100 + len(self.index), box) + self.index, "dbf": table_head(self.fields, self.n) + self.rows + b"\x1a", "cpg": b"UTF-8"}
        return out | ({"prj": SYSTEMS[epsg].encode()} if epsg in SYSTEMS else {})


# --- the data source ---------------------------------------------------------------------------


@dataclasses.dataclass
class Records(InputPartition):
    """Records first to past (none included) of a file."""

    path: str
    first: int
    past: int


@dataclasses.dataclass
class Layers(WriterCommitMessage):
    """Where a task left its layers, by their number, each with its endings."""

    partition: int
    folder: str
    endings: list[list[str]]


class ShapeSource(DataSource):
    """file, record (from 0), parts and the attributes of the first file found."""

    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        store, found = _listed(self.options["path"])
        if not found:
            raise ValueError(f"no shapefile in {self.options['path']}")
        with store.open_input_file(found[0].path[:-3] + "dbf") as f:
            fields = read_fields(f.read_at(1 << 16, 0))[0]
        return ", ".join(["file string", "record bigint", f"parts {PARTS}", *(f.ddl() for f in fields)])

    def reader(self, schema) -> DataSourceReader:
        return ShapeReader(self.options["path"], int(self.options.get("split", SPLIT)), [f.name for f in schema.fields[3:]])

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        o = self.options
        return ShapeWriter(o["path"], o["layer"], int(o["kind"]), int(o["epsg"]) if o.get("epsg") else None, int(o.get("file_bytes", FILE_BYTES)))


def _listed(path: str) -> tuple[fs.FileSystem, list[fs.FileInfo]]:
    store, root = fs.FileSystem.from_uri(path)
    info = store.get_file_info(root)
    found = [info] if info.is_file else store.get_file_info(fs.FileSelector(root))
    return store, sorted((f for f in found if f.is_file and f.path.lower().endswith(".shp")), key=lambda f: f.path)


class ShapeReader(DataSourceReader):
    def __init__(self, path: str, split: int, names: list[str]) -> None:
        self.path, self.split, self.names = path, split, names

    def partitions(self) -> list[Records]:
        store, found = _listed(self.path)
        out = []
        for f in found:
            n = (store.get_file_info(f.path[:-3] + "shx").size - 100) // 8
            step = max(1, n * self.split // max(1, f.size)) if n else 1
            out += [Records(f.path, k, min(n, k + step)) for k in range(0, n, step)]
        return out

    def read(self, p: Records | None) -> Iterator[pa.RecordBatch]:
        if p is None:
            return
        store, _ = fs.FileSystem.from_uri(self.path)
        with store.open_input_file(p.path[:-3] + "shx") as f:
            index = np.frombuffer(f.read_at(8 * (p.past - p.first), 100 + 8 * p.first), dtype=">i4").reshape(-1, 2).astype(np.int64) * 2
        with store.open_input_file(p.path[:-3] + "dbf") as f:
            fields, _, size, width = read_fields(f.read_at(1 << 16, 0))
            rows = f.read_at(width * (p.past - p.first), size + width * p.first)
        with store.open_input_file(p.path) as f:
            zero = int(index[0, 0])
            shapes = f.read_at(int(index[-1].sum()) + 8 - zero, zero)
        places = np.cumsum([1, *(x.width for x in fields)])
        values: dict[str, list] = {n: [] for n in self.names}
        parts = []
        for k, (at, n) in enumerate(index.tolist()):
            parts.append(unpack_raw(shapes[at - zero + 8 : at - zero + 8 + n]))
            for x, a in zip(fields, places.tolist(), strict=False):
                if x.name in values:
                    values[x.name].append(x.unpack(rows[k * width + a : k * width + a + x.width]))
        rings = [r for found in parts for r in found or ()]
        points = np.frombuffer(b"".join(rings), dtype="<f8")
        point = pa.StructArray.from_arrays([pa.array(points[::2]), pa.array(points[1::2])], names=["x", "y"])
        upto = lambda sizes: pa.array(np.cumsum([0, *sizes]).astype(np.int32))
        ring = pa.ListArray.from_arrays(upto(len(r) // 16 for r in rings), point)
        shaped = pa.ListArray.from_arrays(upto(len(found or ()) for found in parts), ring, mask=pa.array([found is None for found in parts], type=pa.bool_()))
        kinds = {x.name: {"C": pa.string(), "D": pa.string(), "L": pa.bool_()}.get(x.kind, pa.float64() if x.decimals else pa.int64()) for x in fields}
        columns = [pa.array([p.path.rpartition("/")[2]] * len(parts)), pa.array(range(p.first, p.past), type=pa.int64()), shaped]
        columns += [pa.array(v, type=kinds[n]) if v else pa.nulls(len(parts)) for n, v in values.items()]
        yield pa.RecordBatch.from_arrays(columns, names=["file", "record", "parts", *values])


class ShapeWriter(DataSourceArrowWriter):
    """Rows of gl_parts (arrays of x, y, x, y ...) and attributes."""

    def __init__(self, path: str, layer: str, kind: int, epsg: int | None, file_bytes: int) -> None:
        self.path, self.layer, self.kind, self.epsg, self.file_bytes = path, layer, kind, epsg, file_bytes

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Layers:
        store, root = fs.FileSystem.from_uri(self.path)
        folder, endings, layer = f"{root}/{STAGED}/{uuid.uuid4().hex}", [], None

        def close() -> None:
            store.create_dir(folder)
            files = layer.files(self.epsg)
            for ending, content in files.items():
                with store.open_output_stream(f"{folder}/{len(endings)}.{ending}") as f:
                    f.write(content)
            endings.append(list(files))

        for batch in iterator:
            names = [n for n in batch.schema.names if n != "gl_parts"]
            fields = fields_of(pa.schema([batch.schema.field(n) for n in names]))
            for parts, *values in zip(*(batch.column(n).to_pylist() for n in ("gl_parts", *names)), strict=True):
                layer = layer or Layer(self.kind, fields)
                layer.add(parts, values)
                if len(layer.shapes) + len(layer.rows) > self.file_bytes:
                    close()
                    layer = None
        if layer is not None:
            close()
        return Layers(TaskContext.get().partitionId(), folder, endings)

    def commit(self, messages: list[Layers | None]) -> None:
        store, root = fs.FileSystem.from_uri(self.path)
        found = [(m.folder, k, endings) for m in sorted((m for m in messages if m), key=lambda m: m.partition) for k, endings in enumerate(m.endings)]
        names = [self.layer] if len(found) == 1 else [f"{self.layer}_{k}" for k in range(len(found))]
        there = {f.base_name for f in store.get_file_info(fs.FileSelector(root, allow_not_found=True)) if f.is_file}
        if there & {f"{n}.shp" for n in names}:
            self.abort(messages)
            raise ValueError(f"{self.path} has a layer {self.layer} already")
        store.create_dir(root)
        for name, (folder, k, endings) in zip(names, found, strict=True):
            for ending in endings:
                store.move(f"{folder}/{k}.{ending}", f"{root}/{name}.{ending}")
        self.abort(messages)

    def abort(self, messages: list[Layers | None]) -> None:
        store, root = fs.FileSystem.from_uri(self.path)
        if store.get_file_info(f"{root}/{STAGED}").type != fs.FileType.NotFound:
            store.delete_dir(f"{root}/{STAGED}")


def _flat(ring: Column) -> Column:
    return F.flatten(F.transform(ring, lambda p: F.array(p["x"].cast("double"), p["y"].cast("double"))))


def write(features: DataFrame, path: str, layer: str, geometry: str = "polygons", epsg: int | None = None, file_bytes: int = FILE_BYTES) -> None:
    """features as a layer of a folder: polygons (ring and, if there, holes), bounding_boxes (xmin .. ymax) or centroids (cx, cy).

    All other columns of a number, text or truth value are attributes, named by 10 bytes at most; columns of
    geometry aren't, others stop it. A null geometry is a null shape, a null attribute blank (an empty text
    reads back as null), texts of over 80 bytes stop it. No rows write no file; an existing layer stops
    it. Pass features in the order and partitions that the files are to have.
    """
    p = lambda x, y: F.struct(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"))
    if geometry == "polygons":
        holes = F.transform("holes", _flat) if "holes" in features.columns else F.array().cast("array<array<double>>")
        kind, parts = POLYGON, F.concat(F.array(_flat(F.col("ring"))), F.coalesce(holes, F.array().cast("array<array<double>>")))
        parts = F.when(F.col("ring").isNotNull(), parts)
    elif geometry == "bounding_boxes":
        box = [F.col(c) for c in ("xmin", "ymin", "xmax", "ymax")]
        kind, parts = POLYGON, F.when(sum(c * 0 for c in box).isNotNull(), F.array(_flat(vector.ring_of_box(*box))))
    elif geometry == "centroids":
        kind, parts = POINT, F.when((F.col("cx") + F.col("cy")).isNotNull(), F.array(_flat(F.array(p("cx", "cy")))))
    else:
        raise ValueError("a layer is of polygons, bounding_boxes or centroids")
    names = [c for c in features.columns if c not in ("ring", "holes", "xmin", "ymin", "xmax", "ymax", "cx", "cy")]
    features.sparkSession.dataSource.register(ShapeSource)
    w = features.select(parts.alias("gl_parts"), *names).write.format(NAME).mode("append").option("layer", layer).option("kind", str(kind)).option("file_bytes", str(file_bytes))
    (w if epsg is None else w.option("epsg", str(epsg))).save(path)


def read(spark: SparkSession, path: str, split: int = SPLIT) -> DataFrame:
    """file, record, parts (rings without the repeated point, or one point) and the attributes of the shapefiles of a folder, or of one."""
    spark.dataSource.register(ShapeSource)
    return spark.read.format(NAME).option("split", str(split)).load(path)


def as_polygons(layer: DataFrame) -> DataFrame:
    """The layer with ring and holes for parts; a record of several outer rings gets a row for each, gaps with the first.

    Outer rings run counterclockwise and gaps clockwise, as everywhere here.
    """
    turned = F.transform("parts", F.reverse)
    outer = F.filter(turned, lambda r: vector.ring_signed_area(r) > 0)
    gaps = F.filter(turned, lambda r: vector.ring_signed_area(r) <= 0)
    p = layer.select("*", F.posexplode(outer).alias("gl_k", "ring"), gaps.alias("holes"))
    return p.withColumn("holes", F.when(F.col("gl_k") == 0, F.col("holes")).otherwise(F.slice("holes", 1, 0))).drop("gl_k", "parts")
