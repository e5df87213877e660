import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.llm import substring as S


def brute(docs, window):
    words = [(d, re.findall("[^\x20\x09-\x0d]+", t or "")) for d, t in docs]
    least = {}
    for d, w in words:
        if d is not None:
            for i in range(len(w) - window + 1):
                k = tuple(w[i : i + window])
                least[k] = min(d, least.get(k, d))
    out = []
    for d, w in words:
        gone = set()
        for i in range(len(w) - window + 1):
            if d is not None and least[tuple(w[i : i + window])] < d:
                gone |= set(range(i, i + window))
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((d, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=str)


def make(seed, n, window):
    r = random.Random(seed)
    vocab = [f"w{i}" for i in range(50)] + ["é", "A", "a"]
    seq = lambda k: [r.choice(vocab) for _ in range(k)]
    shared = [seq(r.randrange(window - 3, 3 * window)) for _ in range(8)]
    docs = []
    for i in range(n):
        w = seq(r.randrange(0, 2 * window))
        for _ in range(r.randrange(0, 3)):
            p = list(r.choice(shared))
            if r.random() < 0.4:
                p[r.randrange(len(p))] = "edited"
            w += p + seq(r.randrange(0, window))
        docs.append((i * 3 % 101 if i % 2 else i, r.choice([" ", "\n", "  ", "\t"]).join(w)))
    docs += [(500 + i, docs[i][1]) for i in range(15)] + [docs[7], (None, docs[3][1]), (None, docs[3][1])]
    return docs + [(700, None), (701, ""), (702, " \n"), (703, "x " * 400), (704, "x " * 300), (705, "ab " * 100 + "end")]


@pytest.mark.parametrize("window,prefix,group_rows", [(10, 3, 2000), (10, 3, 5), (12, 4, 0)])
def test_matches_brute_force(spark, window, prefix, group_rows):
    docs = make(window + group_rows, 70, window)
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumn("th", F.lit("clash")).withColumn("spans", F.lit(1))
    out = S.remove_repeats(d, window, prefix, group_rows=group_rows, joined=True)
    got = out.select("doc_id", F.col("gl_n_words"), F.col("gl_n_removed"), F.sha2("text", 256)).collect()
    assert sorted(map(tuple, got), key=str) == brute(docs, window)


def test_contract_window(spark):
    docs = make(3, 40, 50)
    d = spark.createDataFrame(docs, "doc_id long, text string")
    assert sorted(map(tuple, S.digest(d).collect()), key=str) == brute(docs, 50)
    assert S.digest(d.limit(0)).count() == 0


def test_clean_texts_stay_as_they_are(spark):
    p = " ".join(f"p{i}" for i in range(60))
    docs = [(1, f"a  b\n{p}\tc "), (2, f" x\n\ny {p}  z"), (3, "left  alone\n"), (4, None)]
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumn("lang", F.lit("en"))
    got = {r.doc_id: r.text for r in S.remove_repeats(d).collect()}
    assert got == {1: docs[0][1], 2: " x\n\ny z", 3: "left  alone\n", 4: None}


def test_anchors_depend_on_the_window_alone():
    r = np.random.default_rng(1)
    h = r.integers(0, 9, 500).astype(np.uint64)
    at, _ = S.anchors(h, 50, 8)
    for i in range(len(h) - 49):
        own, _ = S.anchors(h[i : i + 50], 50, 8)
        assert len(own) and set(own + i) <= set(at)


def test_hot_passages(spark):
    """Passages in hundreds of documents, cut off at all places and edited at some: every group is beyond its bound."""
    r = random.Random(2)
    fresh = lambda k: [f"f{r.randrange(10**6)}" for _ in range(k)]
    passage, other = fresh(40), fresh(40)
    docs = []
    for i in range(400):
        p = list(passage if i % 3 else passage[:15] + other)
        if i % 5 == 0:
            p[r.randrange(len(p))] = "edited"
        docs.append((r.randrange(300), " ".join(fresh(r.randrange(20)) + p[r.randrange(12) :] + fresh(r.randrange(20)) + p[: r.randrange(40)])))
    d = spark.createDataFrame(docs, "doc_id long, text string")
    for group_rows in (3, 50):
        out = S.remove_repeats(d, 10, 3, group_rows=group_rows, joined=True)
        got = out.select("doc_id", F.col("gl_n_words"), F.col("gl_n_removed"), F.sha2("text", 256)).collect()
        assert sorted(map(tuple, got), key=str) == brute(docs, 10)


def test_lines_said_hundreds_of_times(spark):
    """Every text repeats one line, some with a slip in it: few different suffixes, many places."""
    r = random.Random(5)
    line = [f"l{i}" for i in range(7)]
    docs = []
    for i in range(30):
        w = [f"f{r.randrange(10**6)}" for _ in range(r.randrange(9))] + line * r.randrange(20, 150)
        if i % 2:
            w[r.randrange(len(w))] = "slip"
        docs.append((r.randrange(25), " ".join(w + [f"g{r.randrange(3)}"] * r.randrange(4))))
    d = spark.createDataFrame(docs, "doc_id long, text string")
    for group_rows in (0, 40, 2000):
        out = S.remove_repeats(d, 10, 3, group_rows=group_rows, joined=True)
        got = out.select("doc_id", F.col("gl_n_words"), F.col("gl_n_removed"), F.sha2("text", 256)).collect()
        assert sorted(map(tuple, got), key=str) == brute(docs, 10)


def test_equal_runs_are_found_by_words():
    words = [b"a", b"b", b"a", b"b", b"c", b"a", b"b"]
    at = np.array([0, 2, 5])
    one = [[p for p, _, _ in same] for same in S.alike(words, at, at, at + 2, np.zeros(3, dtype=np.uint64))]
    assert one == [[0, 2, 5]]
    clash = [[p for p, _, _ in same] for same in S.alike(words, np.array([0, 3, 5]), np.array([0, 3, 5]), np.array([2, 5, 7]), np.zeros(3, dtype=np.uint64))]
    assert clash == [[0, 5], [3]]
    assert S.merged(np.array([1, 4, 20]), np.array([6, 9, 25])) == ([1, 20], [9, 25])
