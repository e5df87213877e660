import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.llm import language as L

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def test_held_out_accuracy(spark, docs):
    got = L.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert len(got) == docs.count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
    assert all(0 <= r.score <= 1 for r in got)
    held = [r for r in got if r.held_out]
    assert np.mean([r.lang == r.lang_pred for r in held]) >= 0.98


def test_one_lookup_answers_for_all_languages():
    a, b = (np.unique(L.grams(t)) for t in (b"the quick brown fox", b"der schnelle braune fuchs"))
    f = L.build({"en": a, "de": b})
    for i, h in enumerate((a, b)):
        masks = np.bitwise_and.reduce([f.slots[0][p] for p in L.places(h, f.slots.shape[1])])
        assert np.all(masks & (1 << i))
    assert L.decide(f, b"THE QUICK!")[0] == "en" and L.decide(f, "Der schnelle".encode())[0] == "de"


def test_correction_for_false_positives():
    r = np.random.default_rng(1)
    f = L.build({"big": r.integers(0, 2**63, 60_000).astype(np.uint64), "small": np.unique(L.grams(b"hello world"))}, slots=1 << 16)
    assert f.false_rate[0] > 0.5 and L.decide(f, b"hello world")[0] == "small"


def test_defined_cases(spark, docs):
    f = L.train(docs.filter(~L.held_out("doc_id")))
    rows = [(1, None), (2, ""), (3, "123 !?"), (4, "the and of that"), (4, "the and of that"), (5, "und die ich " * 50_000), (6, "日本語"), (None, "la de que")]
    d = spark.createDataFrame(rows, "doc_id long, text string").withColumn("score", F.lit("clash")).withColumn("gram", F.lit(1))
    got = sorted(L.predict(d, f).select("doc_id", "lang_pred", "score").collect(), key=lambda r: (r[0] is None, r[0]))
    assert [(r[1], r[2]) for r in got[:3]] == [("und", 0.0)] * 3
    assert got[3] == got[4] and got[3][1] == "en" and got[5][1] == "de" and got[6][1] in f.languages
    none = L.identify(docs.limit(0))
    assert none.count() == 0
    assert {r.lang_pred for r in L.identify(docs.limit(20).withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


def test_a_language_of_copies_is_learned(spark):
    """Whatever the text, and beside a language of many texts."""
    for i in range(4):
        rows = [("aa", f"lorem ipsum {i} dolor sit amet consectetur")] * 100 + [("bb", f"und die der {j} ich nicht " * 3) for j in range(60)]
        f = L.train(spark.createDataFrame(rows, "lang string, text string"), sample_docs=20)
        assert sorted(f.languages) == ["aa", "bb"] and f.languages[0] == "aa"
        assert L.decide(f, b"dolor sit amet")[0] == "aa" and L.decide(f, b"der ich nicht")[0] == "bb"


def test_more_languages_than_a_word_has_bits(spark):
    name = lambda i: "".join(chr(97 + (i * k) % 26) for k in (1, 3, 5, 7, 11)) + chr(97 + i // 26)
    rows = [(f"l{i:03}", f"{name(i)} {name(i)}x {name(i)}") for i in range(150)]
    f = L.train(spark.createDataFrame(rows, "lang string, text string"))
    assert len(f.languages) == 150 and f.slots.shape[0] == 3
    assert all(L.decide(f, t.encode())[0] == l for l, t in rows)
