"""WARC archives: writing with revisits, and a splittable reader.

Writer: pages with equal payloads (SHA-1 and length) are found first; the one with the smallest id
becomes a ``response``, the others ``revisit`` records without payload. Every record is a gzip member
of its own, and Spark's text sink appends the members: the sink's line end is the zero byte, with
which a member of less than 16 MB ends (the high byte of its size); a larger one is followed by an
empty member, which always ends so. Archives are thus committed like any Spark output, in any store.

Reader: Spark's text source scans byte ranges of the archives for the gzip magic as "line end", so a
range owns the candidates that begin inside it and reads on past its end for the last one. Every
candidate is validated by inflating it: it must end where the next candidate starts, with the right
checksum, and begin with a WARC header. A magic that happens to stand inside compressed data fails
this and is appended to the member before it; where a range ends in between, the pieces are put
together in a second pass over just these.

Scale: only ids and digests are shuffled to find equal payloads (summed up in each task first). The
list of payloads that occur twice is broadcast if Spark finds it small; beyond that the join that marks
the copies shuffles the pages once, html included, and can be split where a payload is frequent.
Reading does not shuffle.

Defined results: a null html is an empty payload; a null url has no header line; rows that repeat the
smallest id of their payload are each a response, null ids come after all others, and where all ids
are null every row is a response; other columns are not written; no rows give an empty archive.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from urllib.parse import quote, unquote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm import common as C

MAGIC = b"\x1f\x8b\x08"
DATE = "2024-01-01T00:00:00Z"
LEVEL = 6
_CRLF2 = b"\r\n\r\n"
_URN = "urn:x-page:"
#: Printable ASCII stays as it is in an URI line.
_SAFE = "".join(chr(c) for c in range(33, 127) if chr(c) != "%")


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def member(record: bytes, level: int = LEVEL) -> bytes:
    """record as a gzip member that ends with a zero byte, which is left out."""
    z = zlib.compressobj(level, zlib.DEFLATED, 31)
    out = z.compress(record) + z.flush()
    if out[-1]:
        z = zlib.compressobj(level, zlib.DEFLATED, 31)
        out += z.compress(b"") + z.flush()
    return out[:-1]


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    head = [f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}".encode(), b""]
    block = b"\r\n".join(head) + b"\r\n" + (payload if refers_to is None else b"")
    lines = ["WARC/1.0", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <{_URN}{'' if page_id is None else page_id}>", f"WARC-Date: {DATE}"]
    if url is not None:
        lines.append(f"WARC-Target-URI: {quote(url, safe=_SAFE)}")
    lines.append(f"WARC-Payload-Digest: sha1:{payload_digest(payload)}")
    if refers_to is not None:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.0/revisit/identical-payload-digest", f"WARC-Refers-To: <{_URN}{refers_to}>"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + _CRLF2 + block + _CRLF2


def mark_copies(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """page_id, url, html as bytes, refers_to (null for responses)."""
    rows = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.coalesce(F.col("html").cast("binary"), F.lit(b"")).alias("html"))
    rows = rows.withColumn("n", F.octet_length("html")).withColumn("digest", F.sha1("html"))
    copies = rows.filter(F.col("n") >= min_bytes).groupBy("n", "digest").agg(F.min("page_id").alias("least"), F.count("*").alias("copies"))
    # written out, so that the join below has an exchange on both sides and large partitions can be split
    copies = C.materialise(copies.filter("copies > 1 and least is not null").drop("copies"), "warc-copies")
    later = F.col("least").isNotNull() & (F.col("page_id").isNull() | (F.col("page_id") > F.col("least")))
    return rows.join(copies, ["n", "digest"], "left").select("page_id", "url", "html", F.when(later, F.col("least")).alias("refers_to"))


def write(pages: DataFrame, path: str, min_bytes: int = 0, level: int = LEVEL) -> None:
    """Archives of the pages below path."""
    marked = mark_copies(pages, min_bytes)

    def build(cols: dict) -> dict:
        rows = zip(*(cols[c].to_pylist() for c in ("page_id", "url", "html", "refers_to")), strict=True)
        return {"value": [member(record(*r), level) for r in rows]}

    C.arrow_map(marked, build, "value binary").select(F.col("value").cast("string")).write.option("lineSep", "\x00").text(path)


def parse(raw: bytes) -> dict | None:
    """A record's fields, or None where raw is none."""
    if not raw.startswith(b"WARC/"):
        return None
    head, found, rest = raw.partition(_CRLF2)
    if not found:
        return None
    fields = {}
    for line in head.decode("utf-8", "replace").split("\r\n")[1:]:
        k, _, v = line.partition(":")
        fields[k.strip().lower()] = v.strip()
    n = fields.get("content-length", "")
    if not n.isdigit() or len(rest) < int(n):
        return None
    http, _, payload = rest[: int(n)].partition(_CRLF2)
    said = re.search(rb"(?im)^content-length:\s*(\d+)", http)
    number = lambda v: int(m[1]) if (m := re.fullmatch(rf"<{_URN}(-?\d+)>", v or "")) else None
    kind = fields.get("warc-type")
    return {
        "record_type": kind,
        "page_id": number(fields.get("warc-record-id")),
        "url": unquote(u) if (u := fields.get("warc-target-uri")) is not None else None,
        "refers_to": number(fields.get("warc-refers-to")),
        "payload_digest": payload_digest(payload) if kind == "response" else fields.get("warc-payload-digest", "").removeprefix("sha1:") or None,
        "payload_bytes": len(payload) if kind == "response" else int(said[1]) if said else None,
        "payload": payload,
    }


class Stitcher:
    """Members from the candidates of one byte range, in their order."""

    def __init__(self) -> None:
        self.head: list[bytes] = []
        self.z = None
        self.out: list[bytes] = []

    def feed(self, candidate: bytes):
        """Yields (member, None) for each member that ends here and (None, candidate) for what is in none.

        If the open candidates turn out not to be a member, the first of them is in none, and the
        others are looked at anew.
        """
        todo = [candidate]
        while todo:
            c = todo.pop(0)
            if not self.head:
                self.z, self.out = zlib.decompressobj(31), []
            if self._inflate(c):
                self.head.append(c)
                if self.z.eof:
                    yield b"".join(self.out), None
                    self.head = []
            elif self.head:
                yield None, self.head[0]
                todo[:0] = [*self.head[1:], c]
                self.head = []
            else:
                yield None, c

    def _inflate(self, data: bytes) -> bool:
        try:
            if x := self.z.decompress(data):
                self.out.append(x)
        except zlib.error:
            return False
        begin = b"".join(self.out[:2])[:5] if self.out else b""
        return not self.z.unused_data and b"WARC/".startswith(begin)


_FIELDS = "record_type string, page_id long, url string, refers_to long, payload_digest string, payload_bytes long, payload binary"
_SCAN = f"file string, start long, seq long, piece binary, {_FIELDS}"


def _row(**x) -> dict:
    return dict.fromkeys(("file", "start", "seq", "piece", "record_type", "page_id", "url", "refers_to", "payload_digest", "payload_bytes", "payload")) | x


def _stitch(rows, whole_file: bool, with_payload: bool):
    """Records of candidates (file, start, piece), and those that their range can't settle.

    At a range's start a candidate may continue a member of the range before, at its end the open
    member may go on in the next one; with whole_file there is nothing before or after.
    """
    at, s, seq = None, None, 0

    def left():
        for i, piece in enumerate(s.head if s and not whole_file else ()):
            yield _row(file=at[0], start=at[1], seq=seq + i, piece=piece)

    for file, start, piece in rows:
        if at != (file, start):
            yield from left()
            at, s, seq = (file, start), Stitcher(), 0
        for found, none in s.feed(piece):
            if none is not None:
                if not whole_file:
                    yield _row(file=file, start=start, seq=seq, piece=none)
                    seq += 1
            elif r := parse(found):
                yield _row(**(r if with_payload else r | {"payload": None}))
    yield from left()


def _batches(rows, schema: pa.Schema):
    held, size = [], 0
    for r in rows:
        held.append(r)
        size += len(r["payload"] or b"") + len(r["piece"] or b"")
        if len(held) >= C.BATCH_ROWS or size >= C.BATCH_BYTES:
            yield pa.RecordBatch.from_pylist(held, schema=schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_pylist(held, schema=schema)


def read(spark: SparkSession, path: str, with_payload: bool = True) -> DataFrame:
    """The archives' records: record_type, page_id, url, refers_to, payload_digest, payload_bytes, payload."""
    C.small_batches(spark)
    arrow = C.arrow_schema(spark, _SCAN)
    lines = spark.read.option("lineSep", MAGIC.decode("latin-1")).option("encoding", "ISO-8859-1").text(path)
    pieces = lines.filter(F.octet_length("value") > 0).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.col("value").cast("binary").alias("piece"))

    def ranges(batches):
        rows = ((f, s, MAGIC + p) for b in batches for f, s, p in zip(*(c.to_pylist() for c in b.columns), strict=True))
        yield from _batches(_stitch(rows, False, with_payload), arrow)

    def files(batches):
        rows = ((f, 0, p) for b in batches for f, p in zip(*(c.to_pylist() for c in b.columns), strict=True))
        yield from _batches(_stitch(rows, True, with_payload), arrow)

    scanned = pieces.mapInArrow(ranges, _SCAN)
    if not with_payload:
        scanned = C.materialise(scanned, "warc-records")  # small without the payloads
    open_ends = scanned.filter("piece is not null").select("file", "start", "seq", "piece")
    if not with_payload and open_ends.isEmpty():
        return scanned.drop("file", "start", "seq", "piece")
    settled = open_ends.repartition("file").sortWithinPartitions("file", "start", "seq").select("file", "piece").mapInArrow(files, _SCAN)
    return scanned.filter("piece is null").unionByName(settled).drop("file", "start", "seq", "piece")


def digest(pages: DataFrame) -> DataFrame:
    """Pages written to archives in the shared folder and read back."""
    spark = pages.sparkSession
    path = C.scratch_path(spark, "warc")
    write(pages, path)
    C.release(spark)
    return read(spark, path, with_payload=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
