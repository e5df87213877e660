import random
import tempfile
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from gridloom.llm import records as R

DOCS = "doc_id long, text string"


def library():
    t = Tokenizer.from_file(R.default_path())
    return lambda text: [*t.encode(text or "", add_special_tokens=False).ids, 2]


def odd_texts(r, n):
    bits = ["word", "Word's", "12", " ", "  ", "\n", "\t", "é", " ", "　", "<|endoftext|>", "it's", "!?", "\x1c", "日本", "", "a\nb", "x ", " y"]
    return ["".join(r.choice(bits) + r.choice(["", " ", " "]) for _ in range(r.randrange(40))) for _ in range(n)]


def test_encoder_same_as_library():
    r, want = random.Random(5), library()
    with open(R.default_path(), encoding="utf-8") as f:
        e = R.Encoder(f.read(), 2)
    assert e.in_pieces and e.width == 2
    texts = odd_texts(r, 3000) + ["", " ", "foo bar\n", "foo bar\n baz", "foo", " foo", "foo ", "a" * 5000]
    for at in range(0, len(texts), 100):
        part = texts[at : at + 100]
        assert [np.frombuffer(x, "<u2").tolist() for x in e.encode(pa.array(part, type=pa.string()))] == [want(t) for t in part]


def brute(docs):
    want, at, out = library(), 0, []
    for i, t in sorted(docs, key=lambda d: (d[0] is not None, d[0] or 0, zlib.crc32((d[1] or "").encode()))):
        ids = want(t)
        out.append((i, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    return sorted(out, key=repr)


def found(spark, docs):
    d = spark.createDataFrame(docs, DOCS).withColumns({"start": F.lit("s"), "file": F.lit(1), "ids": F.lit(2)})
    return sorted(map(tuple, R.digest(d).select("doc_id", "start", "n_tokens", "ids_crc32").collect()), key=repr)


def test_same_as_one_by_one(spark):
    r = random.Random(6)
    docs = list(enumerate(odd_texts(r, 150))) + [(7, "again"), (7, "again"), (7, "other"), (None, None), (None, "x"), (900, None), (-3, "first")]
    r.shuffle(docs)
    assert found(spark, docs) == brute(docs)


def test_many_files_and_shuffled_reads(spark):
    r = random.Random(8)
    docs = [(i, t) for i, t in enumerate(odd_texts(r, 200))] + [(5000, "long " * 100_000)]
    path = tempfile.mkdtemp() + "/out"
    R.write(spark.createDataFrame(docs, DOCS).repartition(5), path, file_bytes=2000)
    index = R.read_index(spark, path)
    assert index.select("file").distinct().count() > 3
    assert sorted((x.doc_id, x.start, x.n_tokens, x.ids_crc32) for x in index.collect()) == sorted(brute(docs))
    # files in order of their names are in order of doc_id
    assert [x.doc_id for x in index.orderBy("file", "place").collect()] == sorted(i for i, _ in docs)
    want = library()
    got = R.read_shuffled(spark, path, 1, 16).collect()
    assert {x.doc_id: list(x.ids) for x in got} == {i: want(t) for i, t in docs}
    assert sorted((x.batch_id, x.slot) for x in got) == [(k // 16, k % 16) for k in range(len(docs))]
    order = lambda rows: [x.doc_id for x in sorted(rows, key=lambda x: (x.batch_id, x.slot))]
    assert order(got) == order(R.read_shuffled(spark, path, 1, 16).collect()) != order(R.read_shuffled(spark, path, 2, 16).collect())
    some = R.read(spark, path, index.filter("doc_id % 50 = 0").select("file", "at").withColumn("why", F.lit("q")))
    assert {x.doc_id: list(x.ids) for x in some.collect()} == {i: want(t) for i, t in docs if i % 50 == 0}


def test_damage_is_found():
    f = R.frame(R.serialise(4, b"\x01\x00\x02\x00", 2))
    doc_id, ids = R.parse(R.payload_at(memoryview(f), 0))
    assert doc_id == 4 and ids.tolist() == [1, 2] and f[-1] == 0
    for at in (0, 9, 13, len(f) - 14, len(f) - 3):
        bad = bytearray(f)
        bad[at] ^= 1
        with pytest.raises(ValueError):
            R.payload_at(memoryview(bytes(bad)), 0)


def test_empty(spark):
    assert found(spark, []) == []
