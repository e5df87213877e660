"""Token ids as length-delimited binary records in files, with an offset index for shuffled reads.

A record frames one serialized sequence:

    length of the payload     8 bytes, little-endian
    checksum of these bytes   4 bytes
    payload
    checksum of the payload   4 bytes
    length of the payload     8 bytes, little-endian

so that files can be walked from either end and a reader that starts at an offset of the index knows
where it is. A checksum is a CRC-32, masked (turned by 15 bits, with a constant added), since the payload
may hold checksums itself. A payload is the document's id (8 bytes), whether it has one (1 byte), the
bytes of a token id (1 byte, 2 or 4 by the vocabulary) and the ids, little-endian. The last byte of a
length is always zero; it is the line end of Spark's text sink, which writes and commits the files in
any store.

Encoding: the tokenizer splits texts before it merges, and a single space between two other characters
always begins a new piece. So each different piece is encoded once by the library and a worker keeps
what it got, up to ``KEPT`` pieces. Lines, Latin words and the marks behind them are pieces of their own;
pieces that touch other white space are joined to their neighbours first. A tokenizer that doesn't split
in this way gets whole texts.

Scale: the texts are dealt out by ranges of doc_id into files of about ``FILE_BYTES`` of text, one
shuffle of the input; equal ids of different texts are told apart by a checksum, so a repeated id is no
single range unless its texts are equal, too. Encoding follows the shuffle and is a narrow map. What
reaches the driver is a number for each file.

Defined results: a null text is an empty one and holds the end id alone; null ids come first, ties go by
the text's checksum; rows that repeat are records each; other columns are not written; an empty table
gives no records.
"""

from __future__ import annotations

import functools
import itertools
import json
import string
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gridloom.functions.shared import dense_ids
from gridloom.llm import common as C
from gridloom.llm.bpe import byte_alphabet

FILE = "byte_bpe_50k.json"
#: The id after each document, and the bytes of text that make a file.
END, FILE_BYTES = 2, 16 << 20
#: Encoded pieces that a worker keeps before it starts anew.
KEPT = 600_000
#: Code points of a piece that is kept, and pieces that the library is asked for at a time.
LONGEST, ASKED = 64, 5_000
#: Marks that may follow a word, and the last letter of the Latin ones.
MARKS, LATIN = string.punctuation, "\u024f"
# turn and constant of a masked checksum (fixed values)
TURN, ADDED = 15, 0xA282EAD8
_LENGTH, _SUM, _HEAD = struct.Struct("<Q"), struct.Struct("<I"), struct.Struct("<q?B")
INDEX = "file string, place long, at long, size long, doc_id long, n_tokens long, ids_crc32 long"


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(FILE)


def masked(data: bytes) -> int:
    """A checksum that may be stored among the data of other checksums."""
    c = zlib.crc32(data)
    return ((c >> TURN | c << 32 - TURN) + ADDED) & 0xFFFFFFFF


class Encoder:
    """Texts to ids, as packed little-endian integers of ``width`` bytes."""

    def __init__(self, content: str, end: int) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(content)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        said = json.loads(content)
        split = said["pre_tokenizer"] or {}
        plain = all(not t["lstrip"] and not t["rstrip"] and not t["single_word"] and not any(c.isspace() for c in t["content"]) for t in said["added_tokens"])
        self.in_pieces = said["normalizer"] is None and split.get("type") == "ByteLevel" and split.get("use_regex", True) and not split.get("add_prefix_space") and plain
        self.width = 2 if max(end, self.tokenizer.get_vocab_size(with_added_tokens=True) - 1) < 1 << 16 else 4
        self.shown = {b: c for b, c in enumerate(byte_alphabet()) if chr(b) != c}
        self.space = self.shown[32]
        self.merge = self.tokenizer.model.tokenize
        self.packers = [struct.Struct(f"<{n}{'H' if self.width == 2 else 'I'}").pack for n in range(33)]
        self.end = self.pack([end])
        #: What is kept of pieces at the start of a text, and of those behind a space.
        self.tables: tuple[dict[str, bytes], dict[str, bytes]] = ({}, {})
        self.line = None
        if self.in_pieces:
            ends = self._ask(["\n"])[0]
            self.line = ends if len(ends) == self.width else None

    def pack(self, ids: list[int]) -> bytes:
        return self.packers[len(ids)](*ids) if len(ids) < 33 else np.array(ids, dtype=f"<u{self.width}").tobytes()

    def _ask(self, pieces: list[str]) -> list[bytes]:
        out = []
        for k in range(0, len(pieces), ASKED):
            found = [e.ids for e in self.tokenizer.encode_batch_fast(pieces[k : k + ASKED], add_special_tokens=False)]
            ends = [0, *itertools.accumulate(self.width * len(i) for i in found)]
            flat = self.pack(list(itertools.chain.from_iterable(found)))
            out += [flat[a:z] for a, z in itertools.pairwise(ends)]
        return out

    @staticmethod
    def pieces(parts: list[str]) -> list[str]:
        """The parts between single spaces, those that have white space at an end joined to what it touches."""
        out, open_end = [""], False
        for k, p in enumerate(parts):
            if k and open_end and p and not p[0].isspace():
                out.append(p)
            else:
                out[-1] += " " * bool(k) + p
            open_end = bool(p) and not p[-1].isspace()
        return out

    def _word(self, behind: bool, word: str) -> bytes:
        """The ids of Latin letters alone, which no splitting rule cuts: the library's merges at once."""
        # the merges work on a printable character for each byte, which ASCII letters are themselves
        shown = word if word.isascii() else word.encode().decode("latin-1").translate(self.shown)
        ids = self.pack([t.id for t in self.merge(self.space + shown if behind else shown)])
        if len(word) <= LONGEST:
            self.tables[behind][word] = ids
        return ids

    def _made(self, behind: bool, piece: str) -> bytes | None:
        """The ids of a piece from those of its lines, words and marks; None if it has something else."""
        table = self.tables[behind]
        if (ids := table.get(piece)) is not None:
            return ids
        word = piece.rstrip(MARKS)
        if word.isalpha() and (word.isascii() or max(word) <= LATIN):
            ids = table.get(word) or self._word(behind, word)
            if len(word) == len(piece):
                return ids
            end = piece[len(word) :]
            marks = self.tables[False].get(end)
            if marks is None:
                marks = self.tables[False][end] = self._ask([end])[0]
            return ids + marks
        if self.line is not None and "\n" in piece:
            parts = piece.split("\n")
            if all(parts):
                lines = [self._made(behind and not n, x) for n, x in enumerate(parts)]
                return None if None in lines else self.line.join(lines)
        return None

    def _look_up(self, behind: bool, pieces: list[str]) -> list[bytes]:
        """The packed ids of pieces, with or without a space before each; those that aren't made of known parts are asked for."""
        table = self.tables[behind]
        out = list(map(table.get, pieces))
        if None not in out:
            return out
        odd = []
        made = self._made
        for k, ids in enumerate(out):
            if ids is None and (ids := made(behind, pieces[k])) is not None:
                out[k] = ids
            elif ids is None:
                odd.append(k)
        for k, ids in zip(odd, self._ask([" " * behind + pieces[k] for k in odd]), strict=True):
            out[k] = ids
            if len(pieces[k]) <= LONGEST and pieces[k].split() == [pieces[k]]:
                table[pieces[k]] = ids
        return out

    def encode(self, texts: pa.Array) -> list[bytes]:
        """The packed ids of each of texts (strings, none null), the end id behind them."""
        if not self.in_pieces:
            return [x + self.end for x in self._ask(texts.to_pylist())]
        if sum(map(len, self.tables)) > KEPT:
            self.tables = ({}, {})
        split = pc.split_pattern(texts, " ")
        coded = split.values.dictionary_encode()
        names, at = coded.dictionary.to_pylist(), coded.indices.to_numpy()
        bounds = split.offsets.to_numpy()
        # texts with pieces that have white space at an end are cut one by one; any other piece stands for itself
        loose = pc.or_(pc.not_equal(pc.utf8_trim_whitespace(coded.dictionary), coded.dictionary), pc.equal(coded.dictionary, "")).to_numpy(zero_copy_only=False)
        slow = np.flatnonzero(np.logical_or.reduceat(loose[at], bounds[:-1])).tolist() if len(names) else []
        heads = [names[k] for k in at[bounds[:-1]].tolist()]  # a piece at the start has no space before it
        cut = [self.pieces(heads[k : k + 1] + [names[j] for j in at[bounds[k] + 1 : bounds[k + 1]].tolist()]) for k in slow]
        # what to look up: names behind a space, heads, and the cut ones of both kinds; what isn't used stays empty
        if not slow:
            found = self._look_up(True, names) + self._look_up(False, heads)
        else:
            inner = [(n > 0, x) for p in cut for n, x in enumerate(p)]
            found = [b""] * (len(names) + len(heads) + len(inner))
            tight = np.ones(len(heads), dtype=bool)
            tight[slow] = False
            inner_at = range(len(names) + len(heads), len(found))
            wanted = [(True, k, names[k]) for k in np.flatnonzero(~loose).tolist()] + [(False, k + len(names), heads[k]) for k in np.flatnonzero(tight).tolist()] + [(c, k, x) for k, (c, x) in zip(inner_at, inner, strict=True)]
            for behind in (True, False):
                some = [w for w in wanted if w[0] == behind]
                for (_, k, _), ids in zip(some, self._look_up(behind, [x for _, _, x in some]), strict=True):
                    found[k] = ids
        size = np.fromiter(map(len, found), dtype=np.int64, count=len(found)) // self.width
        flat = np.frombuffer(b"".join(found), dtype=f"<u{self.width}")
        first = np.cumsum(size) - size
        order = at.astype(np.int64)
        order[bounds[:-1]] = len(names) + np.arange(len(heads))
        count = size[order]
        total = np.concatenate(([0], np.cumsum(count)))
        ids = flat[np.repeat(first[order] - total[:-1], count) + np.arange(total[-1])].tobytes()
        ends = (total[bounds] * self.width).tolist()
        out = [ids[a:z] + self.end for a, z in itertools.pairwise(ends)]
        place = len(names) + len(heads)
        for k, p in zip(slow, cut, strict=True):
            out[k] = b"".join(found[place : place + len(p)]) + self.end
            place += len(p)
        return out


@functools.lru_cache(maxsize=1)
def encoder(content: str, end: int) -> Encoder:
    """A worker's encoder, with what it has kept from task to task."""
    return Encoder(content, end)


def frame(payload: bytes) -> bytes:
    n = _LENGTH.pack(len(payload))
    return b"".join((n, _SUM.pack(masked(n)), payload, _SUM.pack(masked(payload)), n))


def serialise(doc_id: int | None, ids: bytes, width: int) -> bytes:
    return _HEAD.pack(doc_id or 0, doc_id is not None, width) + ids


def parse(payload: bytes | memoryview) -> tuple[int | None, np.ndarray]:
    """The document's id and its token ids."""
    doc_id, there, width = _HEAD.unpack_from(payload)
    return doc_id if there else None, np.frombuffer(payload, dtype=f"<u{width}", offset=_HEAD.size)


def payload_at(content: memoryview, at: int) -> memoryview:
    """The payload of the record at an offset; a damaged or missing one raises ValueError."""
    head = bytes(content[at : at + 12])
    if len(head) < 12 or _SUM.unpack_from(head, 8)[0] != masked(head[:8]):
        raise ValueError(f"no record begins at {at}")
    n = _LENGTH.unpack_from(head)[0]
    payload, rest = content[at + 12 : at + 12 + n], bytes(content[at + 12 + n : at + 24 + n])
    if len(rest) < 12 or _SUM.unpack_from(rest)[0] != masked(payload) or rest[4:] != head[:8]:
        raise ValueError(f"the record at {at} is damaged")
    return payload


def write(docs: DataFrame, path: str, tokenizer: str | None = None, end: int = END, file_bytes: int = FILE_BYTES) -> None:
    """docs (doc_id, text) as records in files below <path>/data, in ascending order of doc_id, and their index.

    Files are in order by name. The tokenizer's file is read on the driver and sent to the workers.
    """
    spark = docs.sparkSession
    with open(tokenizer or default_path(), encoding="utf-8") as f:
        content = spark.sparkContext.broadcast(f.read())
    rows = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    order = [F.col("doc_id").asc_nulls_first(), F.crc32("text")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(content.value, end)
        for b in batches:
            ids = e.encode(b.column(1))
            lines = [frame(serialise(d, i, e.width))[:-1] for d, i in zip(b.column(0).to_pylist(), ids, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(lines, type=pa.binary())], names=["value"])

    C.small_batches(spark)
    ordered = rows.repartitionByRange(max(1, -(-size // file_bytes)), *order).sortWithinPartitions(*order)
    ordered.mapInArrow(run, "value binary").select(F.col("value").cast("string")).write.option("lineSep", "\x00").text(f"{path}/data")
    C.release(spark)
    write_index(spark, path)


def _files(spark: SparkSession, path: str) -> DataFrame:
    """file, content: whole, so a file is one task's; write() bounds them."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(f"{path}/data")
    return found.select(F.substring_index("path", "/", -1).alias("file"), "content")


def scan(spark: SparkSession, path: str) -> DataFrame:
    """A row of INDEX for every record, read from the files: its place in the file, offset, size and what it holds."""

    def walk(cols: dict) -> dict:
        out: dict[str, list] = {c.split()[0]: [] for c in INDEX.split(", ")}
        for name, raw in zip(cols["file"].to_pylist(), cols["content"], strict=True):
            content, at = memoryview(raw.as_buffer()), 0
            for place in itertools.count():
                if at == len(content):
                    break
                payload = payload_at(content, at)
                doc_id, ids = parse(payload)
                size = len(payload) + 24
                for c, v in zip(out, (name, place, at, size, doc_id, len(ids), zlib.crc32(ids.astype("<u4").tobytes())), strict=True):
                    out[c].append(v)
                at += size
        return out

    return C.arrow_map(_files(spark, path), walk, INDEX)


def write_index(spark: SparkSession, path: str) -> None:
    """The offset index as a table at <path>/index: INDEX and start, the number of ids before the record in all files."""
    found = C.materialise(scan(spark, path), "record-index")
    totals = sorted(map(tuple, found.groupBy("file").agg(F.sum("n_tokens")).collect()))  # a number for each file
    before = dict(zip((f for f, _ in totals), itertools.accumulate([0] + [n for _, n in totals]), strict=False))
    table = spark.createDataFrame(list(before.items()), "file string, before long")
    earlier = F.coalesce(F.sum("n_tokens").over(Window.partitionBy("file").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    found.withColumn("earlier", earlier).join(F.broadcast(table), "file").withColumn("start", F.col("before") + F.col("earlier")).drop("before", "earlier").write.parquet(f"{path}/index")
    C.discard(found)


def read_index(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(f"{path}/index")


def read(spark: SparkSession, path: str, wanted: DataFrame) -> DataFrame:
    """The columns of wanted, doc_id and ids of the records at the offsets (file, at) of wanted, rows of the index or some of them.

    A task opens a file and goes to each offset asked for in it; records that nobody asks for are
    skipped, those that are asked for twice come twice.
    """
    extra = [c for c in wanted.columns if c not in ("file", "at", "doc_id", "ids")]
    per_file = wanted.groupBy("file").agg(F.collect_list(F.struct("at", *extra)).alias("wanted"))  # a file has bounded bytes
    kinds = ", ".join(f"`{c}` {wanted.schema[c].dataType.simpleString()}" for c in extra)
    schema = f"file string, at long, {kinds}{', ' if kinds else ''}doc_id long, ids array<int>"

    def pick(cols: dict) -> dict:
        out: dict[str, list] = {c: [] for c in ("file", "at", *extra, "doc_id", "ids")}
        for name, raw, rows in zip(cols["file"].to_pylist(), cols["content"], cols["wanted"].to_pylist(), strict=True):
            content = memoryview(raw.as_buffer())
            for r in rows:
                doc_id, ids = parse(payload_at(content, r["at"]))
                for c, v in (("file", name), ("doc_id", doc_id), ("ids", ids.astype(np.int32)), *((c, r[c]) for c in ("at", *extra))):
                    out[c].append(v)
        return out

    return C.arrow_map(_files(spark, path).join(per_file, "file"), pick, schema)


def read_shuffled(spark: SparkSession, path: str, seed: int, batch: int) -> DataFrame:
    """batch_id, slot, doc_id, ids of all records in an order that the seed decides, batch records to a batch.

    The order is made on the index alone; the records then move once, as ids.
    """
    index = read_index(spark, path).select("file", "at", F.xxhash64("file", "at", F.lit(seed)).alias("turn"))
    dealt = dense_ids(index, ["turn", "file", "at"], "n").select("file", "at", F.floor(F.col("n") / batch).cast("long").alias("batch_id"), (F.col("n") % batch).cast("int").alias("slot"))
    return read(spark, path, dealt).select("batch_id", "slot", "doc_id", "ids")


def digest(docs: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of docs, by way of files in the shared folder that are read back."""
    spark = docs.sparkSession
    path = C.scratch_path(spark, "records")
    write(docs, path)
    return read_index(spark, path).select("doc_id", "start", "n_tokens", "ids_crc32")
