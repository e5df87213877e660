import base64
import gzip
import hashlib
import os
import random
import zlib

import pytest
from pyspark.sql import functions as F

from gridloom.llm import common as C
from gridloom.llm import warc as W


def reference(rows):
    least = {}
    for i, _, h in rows:
        if i is not None:
            least[h or ""] = min(i, least.get(h or "", i))
    out = []
    for i, _, h in rows:
        b = (h or "").encode()
        first = least.get(h or "")
        again = first is not None and (i is None or i > first)
        out.append((i, len(b), base64.b32encode(hashlib.sha1(b).digest()).decode(), "revisit" if again else "response", first if again else None))
    return sorted(out, key=str)


def make():
    r = random.Random(1)
    rows = [(i, f"http://h/{i}?é\n x%20", r.choice(["<p>same</p>", "<p>other é</p>", f"<i>{i}</i>" * r.randrange(80)])) for i in range(400)]
    return rows + [(400, None, None), (401, "u", ""), (402, None, None), (None, "n", "<p>same</p>"), (None, "n", "lonely"), (None, "n", "lonely"), (3, "again", "twice"), (3, "again", "twice"), (5, "big", "x" * 400_000)]


SCHEMA = "page_id long, url string, html string"


def test_digest(spark):
    rows = make()
    d = spark.createDataFrame(rows, SCHEMA).withColumn("n", F.lit("clash")).withColumn("digest", F.lit(1)).withColumn("least", F.lit(1))
    assert sorted(map(tuple, W.digest(d).collect()), key=str) == reference(rows)
    assert W.digest(d.limit(0)).count() == 0


@pytest.mark.parametrize("split", ["97", "1009", "20011"])
def test_any_split_reads_the_same(spark, split):
    rows = make()
    path = C.scratch_path(spark, "t")
    W.write(spark.createDataFrame(rows, SCHEMA).coalesce(2), path, level=0 if split == "97" else 6)
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", split if split != "97" else "3001")
        spark.conf.set("spark.sql.files.openCostInBytes", "0")
        got = W.read(spark, path).collect()
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    assert sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got), key=str) == reference(rows)
    urls = {i: u for i, u, _ in rows if i is not None and i not in (3, 5)}
    assert all(r.url == urls[r.page_id] for r in got if r.page_id in urls)
    assert all(len(r.payload) == r.payload_bytes for r in got if r.record_type == "response")


def test_archives_are_plain_gzip(spark):
    path = C.scratch_path(spark, "t")
    W.write(spark.createDataFrame(make(), SCHEMA).coalesce(1), path)
    local = path.removeprefix("file://")
    raw = b"".join(gzip.open(f"{local}/{f}").read() for f in os.listdir(local) if f.endswith(".txt"))
    assert raw.count(b"WARC/1.0\r\n") == len(make())


def test_large_members_end_with_zero():
    m = W.member(os.urandom(17 << 20), level=0) + b"\0"
    assert len(gzip.decompress(m)) == 17 << 20


def test_magic_inside_a_member_and_across_ranges():
    recs = [W.record(i, None, b"ab" + W.MAGIC + b"\0WARC/" + W.MAGIC * 3 + bytes([i]), None) for i in range(4)]

    def gz(b):
        z = zlib.compressobj(0, zlib.DEFLATED, 31)
        return z.compress(b) + z.flush()

    data = b"".join(map(gz, recs))
    pieces = [W.MAGIC + p for p in data.split(W.MAGIC)[1:]]
    for cut in range(len(pieces) + 1):
        rows = [("f", 0 if i < cut else 100, p) for i, p in enumerate(pieces)]
        got = list(W._stitch(rows, False, True))
        open_ends = sorted(((r["start"], r["seq"], r["piece"]) for r in got if r["piece"]), key=lambda r: r[:2])
        more = list(W._stitch([("f", 0, p) for _, _, p in open_ends], True, True))
        ids = sorted(r["page_id"] for r in got + more if r["record_type"])
        assert ids == [0, 1, 2, 3]
