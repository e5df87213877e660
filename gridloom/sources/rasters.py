"""Raster files as a data source of Spark: TIFF and PNG files as pixels, and files written with a commit.

Reading: a partition is some of the strips or tiles of one large file, or some small files. Only heads of
large files are read where partitions are made. A window (the options, or filters on row and col where
Spark hands them down) leaves out the strips and tiles that it doesn't touch. A PNG file is one piece.

Writing: a task writes its files to a hidden folder, and the driver moves those of the tasks that Spark
counts, so a repeated or lost task leaves nothing behind.

Files are opened by Arrow's file systems: local and shared folders, and the stores that Arrow knows.
"""

from __future__ import annotations

import dataclasses
import json
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual, WriterCommitMessage

NAME = "gridloom_rasters"
#: Bytes that a partition reads, and pixels of one Arrow batch.
SPLIT, BATCH = 16 << 20, 1 << 16
#: Bytes of a partition that a file counts for besides its own.
OPENING = 16 << 10
FAR = 1 << 31
STAGED = ".gridloom-staged"


def opens(path: str) -> bool:
    """Whether Arrow has a file system for a path."""
    try:
        fs.FileSystem.from_uri(path)
    except (pa.ArrowInvalid, pa.ArrowNotImplementedError, OSError):
        return False
    return True


class Ranged:
    """An open file that gives slices of its bytes, a block at a time."""

    def __init__(self, file: pa.NativeFile, block: int = 1 << 16) -> None:
        self.file, self.block, self.size, self.held = file, block, file.size(), {}

    def __getitem__(self, s: slice) -> bytes:
        a, z = s.start or 0, min(self.size, s.stop)
        if z - a > self.block:
            return self.file.read_at(z - a, a)
        out = b""
        for k in range(a // self.block, -(-z // self.block)):
            if k not in self.held:
                self.held = {k: self.file.read_at(self.block, k * self.block)}
            out += self.held[k][max(0, a - k * self.block) : z - k * self.block]
        return out


@dataclasses.dataclass
class Piece(InputPartition):
    """Files with their first block and the one behind the last (none: all)."""

    files: list[tuple[str, int, int | None]]


@dataclasses.dataclass
class Written(WriterCommitMessage):
    folder: str
    names: list[str]


class RasterSource(DataSource):
    """file, row, col and a column a band; with the option heads a row of the files' metadata instead."""

    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        from gridloom.sources.geotiff import META

        if self.options.get("heads") == "true":
            return META
        return "file string, row int, col int, " + ", ".join(f"`{c}` double" for c in json.loads(self.options.get("bands", '["v"]')))

    def reader(self, schema) -> DataSourceReader:
        return (NarrowingReader if self.options.get("narrowing") == "true" else RasterReader)(dict(self.options))

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        return RasterWriter(self.options["path"])


class RasterReader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.path, self.ending = options["path"], options.get("ending", "")
        self.heads, self.bands = options.get("heads") == "true", json.loads(options.get("bands", '["v"]'))
        self.split = int(options.get("split", SPLIT))
        self.window = {c: [int(options.get(f"{c}_from", -FAR)), int(options.get(f"{c}_to", FAR))] for c in ("row", "col")}

    def _listed(self) -> tuple[fs.FileSystem, list[fs.FileInfo]]:
        store, root = fs.FileSystem.from_uri(self.path)
        info = store.get_file_info(root)
        found = [info] if info.is_file else store.get_file_info(fs.FileSelector(root, recursive=True))
        hidden = lambda p: any(x.startswith((".", "_")) for x in p[len(root) :].split("/") if x)
        return store, sorted((f for f in found if f.is_file and f.path.endswith(self.ending) and not hidden(f.path)), key=lambda f: f.path)

    def _touched(self, y, k: int) -> bool:
        r, c = y.place(k)
        (r0, r1), (c0, c1) = self.window["row"], self.window["col"]
        return r <= r1 and r + y.block_height > r0 and c <= c1 and c + y.block_width > c0

    def partitions(self) -> list[Piece]:
        from gridloom.sources import codecs, geotiff

        store, found = self._listed()
        out, some, held = [], [], 0
        for f in found:
            if f.size > self.split and not self.heads:
                with store.open_input_file(f.path) as opened:
                    content = Ranged(opened)
                    if content[:8] != codecs.SIGNATURE:
                        y = geotiff.layout(content)
                        first, size = None, 0
                        for k in range(len(y.at) + 1):
                            ends = k == len(y.at) or not self._touched(y, k)
                            if first is not None and (ends or size + y.size[k] > self.split):
                                out.append(Piece([(f.path, first, k)]))
                                first, size = None, 0
                            if not ends:
                                first, size = k if first is None else first, size + y.size[k]
                        continue
            if some and held + f.size > self.split:
                out.append(Piece(some))
                some, held = [], 0
            some.append((f.path, 0, None))
            held += f.size + OPENING
        return [*out, Piece(some)] if some else out

    def read(self, partition: Piece | None) -> Iterator[pa.RecordBatch]:
        """Batches of about BATCH pixels or heads, of however many files and blocks."""
        if partition is None:  # Spark's way to say that there is none
            return
        held, n = [], 0
        together = self._heads if self.heads else self._together
        for found in self._found(partition):
            held.append(found)
            n += 1 if self.heads else len(found[1])
            if n >= BATCH:
                yield together(held)
                held, n = [], 0
        if held:
            yield together(held)

    def _found(self, partition: Piece) -> Iterator:
        """What the files hold: heads, or stretches of pixels."""
        from gridloom.sources import codecs, geotiff

        store, _ = fs.FileSystem.from_uri(self.path)
        for path, first, past in partition.files:
            name = path.rpartition("/")[2]
            with store.open_input_file(path) as opened:
                content = Ranged(opened)
                about = geotiff.describe(name, content)
                if self.heads:
                    yield about
                elif content[:8] == codecs.SIGNATURE:
                    yield from self._stretches(name, codecs.png_decode(opened.read_at(content.size, 0)), 0, 0, None)
                else:
                    y = geotiff.layout(content)
                    for k in range(first, len(y.at) if past is None else past):
                        if self._touched(y, k):
                            yield from self._stretches(name, y.decode(k, content[y.at[k] : y.at[k] + y.size[k]]), *y.place(k), about["nodata"])

    def _stretches(self, name: str, px: np.ndarray, r: int, c: int, nodata: float | None) -> Iterator[tuple]:
        """The pixels of a block at (r, c) that lie in the window: file, rows, columns, values by band, nodata."""
        (r0, r1), (c0, c1) = self.window["row"], self.window["col"]
        top, left = max(0, r0 - r), max(0, c0 - c)
        px = px[top : max(0, r1 - r + 1), left : max(0, c1 - c + 1)]
        h, w, n = px.shape
        flat = px.reshape(h * w, n)
        for a in range(0, h * w, BATCH):
            at = np.arange(a, min(h * w, a + BATCH))
            yield name, at // w + r + top, at % w + c + left, flat[a : a + BATCH].astype(np.float64), nodata

    def _together(self, held: list[tuple]) -> pa.RecordBatch:
        sizes = [len(x[1]) for x in held]
        files = pa.array([x[0] for x in held]).take(pa.array(np.repeat(np.arange(len(held)), sizes)))
        values = []
        for i in range(len(self.bands)):
            v = np.concatenate([x[3][:, i] if i < x[3].shape[1] else np.zeros(len(x[1])) for x in held])
            none = np.concatenate([x[3][:, i] == x[4] if i < x[3].shape[1] and x[4] is not None else np.full(len(x[1]), i >= x[3].shape[1]) for x in held])
            values.append(pa.array(v, mask=none))
        rows, cols = (pa.array(np.concatenate([x[k] for x in held]).astype(np.int32)) for k in (1, 2))
        return pa.RecordBatch.from_arrays([files, rows, cols, *values], names=["file", "row", "col", *self.bands])

    @staticmethod
    def _heads(held: list[dict]) -> pa.RecordBatch:
        return pa.RecordBatch.from_pylist(held, schema=_heads())


class NarrowingReader(RasterReader):
    """A reader that takes filters from Spark; Spark refuses it where spark.sql.python.filterPushdown.enabled is off."""

    def pushFilters(self, filters):
        """Narrow the window; Spark still applies the filters to what is read."""
        for f in filters:
            name = f.attribute[-1] if getattr(f, "attribute", None) else None
            if name in self.window and isinstance(getattr(f, "value", None), int):
                w = self.window[name]
                if isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual)):
                    w[0] = max(w[0], f.value + isinstance(f, GreaterThan))
                if isinstance(f, (EqualTo, LessThan, LessThanOrEqual)):
                    w[1] = min(w[1], f.value - isinstance(f, LessThan))
            yield f


def _heads() -> pa.Schema:
    from gridloom.sources.geotiff import META

    kinds = {"string": pa.string(), "int": pa.int32(), "double": pa.float64()}
    return pa.schema([(name, kinds[kind]) for name, kind in (f.split() for f in META.split(", "))])


class RasterWriter(DataSourceArrowWriter):
    """Rows of file, content as files of a folder; with a column piece, following rows of one file are its pieces."""

    def __init__(self, path: str) -> None:
        self.path = path

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        store, root = fs.FileSystem.from_uri(self.path)
        folder, names, last, out = f"{root}/{STAGED}/{uuid.uuid4().hex}", [], None, None
        try:
            for batch in iterator:
                pieces = batch.column("piece").to_pylist() if "piece" in batch.schema.names else [0] * batch.num_rows
                for name, piece, content in zip(batch.column("file").to_pylist(), pieces, batch.column("content"), strict=True):
                    if name is None or not content.is_valid or "/" in name or name.startswith((".", "_")):
                        raise ValueError(f"{name!r} is no name of a raster file, or it has no content")
                    if out is None or name != names[-1] or piece <= last:
                        if out is None:
                            store.create_dir(folder)
                        else:
                            out.close()
                        out = store.open_output_stream(f"{folder}/{name}")
                        names.append(name)
                    out.write(content.as_buffer())
                    last = piece
        finally:
            if out is not None:
                out.close()
        return Written(folder, names)

    def commit(self, messages: list[Written | None]) -> None:
        store, root = fs.FileSystem.from_uri(self.path)
        done = [m for m in messages if m is not None]
        names = [n for m in done for n in m.names]
        there = {f.base_name for f in store.get_file_info(fs.FileSelector(root, allow_not_found=True)) if f.is_file}
        if len(set(names)) < len(names) or there & set(names):
            self.abort(messages)
            raise ValueError(f"{self.path} would have two files of one name")
        store.create_dir(root)
        for m in done:
            for n in m.names:
                store.move(f"{m.folder}/{n}", f"{root}/{n}")
        self._clear(store, root)

    def abort(self, messages: list[Written | None]) -> None:
        self._clear(*fs.FileSystem.from_uri(self.path))

    @staticmethod
    def _clear(store: fs.FileSystem, root: str) -> None:
        if store.get_file_info(f"{root}/{STAGED}").type != fs.FileType.NotFound:
            store.delete_dir(f"{root}/{STAGED}")


def load(spark: SparkSession, path: str, bands: tuple[str, ...] = ("v",), ending: str = "", rows: tuple[int, int] | None = None, cols: tuple[int, int] | None = None, heads: bool = False, split: int = SPLIT) -> DataFrame:
    """The files of a folder (or one file) as pixels, or with heads as a row of metadata each."""
    spark.dataSource.register(RasterSource)
    r = spark.read.format(NAME).option("bands", json.dumps(list(bands))).option("ending", ending).option("heads", str(heads).lower()).option("split", str(split)).option("narrowing", spark.conf.get("spark.sql.python.filterPushdown.enabled", "false"))
    for name, within in (("row", rows), ("col", cols)):
        if within is not None:
            r = r.option(f"{name}_from", str(within[0])).option(f"{name}_to", str(within[1]))
    return r.load(path)


def save(files: DataFrame, path: str) -> None:
    """Rows of file, content (and piece, of files in several rows, which follow one another) as files of a folder, all or none."""
    files.sparkSession.dataSource.register(RasterSource)
    files.select("file", *[c for c in ("piece",) if c in files.columns], "content").write.format(NAME).mode("append").save(path)
