import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.llm import common as C
from gridloom.llm import score as S

SF = "/root/testdata/sf0.001"


def test_scores_match_a_word_by_word_sum(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    m = S.fit(docs)
    assert np.allclose(np.exp(m.table.astype(float)).sum(axis=2), 1, atol=1e-3)
    texts = {r.doc_id: r.text for r in docs.collect()}
    got = {r.doc_id: r for r in S.score(docs, m).collect()}
    assert len(got) == len(texts)
    for i in list(texts)[:60]:
        ws = C.alnum_words(texts[i].encode())
        of = lambda j: 0 if j in (-1, len(ws)) else m.words.get(ws[j], (1,))[0]  # noqa: B023, E731
        want = sum(float(m.table[of(j - 1), of(j + 1), of(j)]) + m.words.get(w, (1, m.unknown))[1] for j, w in enumerate(ws))
        assert got[i].n_words == len(ws) and math.isclose(got[i].log_prob, want, rel_tol=1e-6, abs_tol=1e-6)
        if ws:
            assert math.isclose(got[i].mean_log_prob, want / len(ws), rel_tol=1e-6)


def test_counts_cover_the_corpus(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").repartition(5)
    n = sum(len(C.alnum_words(r.text.encode())) for r in docs.collect())
    assert S.count_words(docs, "text").agg(F.sum("n")).first()[0] == n
    assert S.count_triples(docs, {}, "text").agg(F.sum("n")).first()[0] == n


def test_network_learns_both_sides():
    counts = np.zeros((S.CLASSES,) * 3)
    for l in range(2, 8):
        for r in range(2, 8):
            counts[l, r, 10 + (l + r) % 5] = 100  # neither side alone tells the middle
    t = S.train(counts, steps=400)
    hit = [t[l, r].argmax() == 10 + (l + r) % 5 for l in range(2, 8) for r in range(2, 8)]
    assert np.mean(hit) > 0.9


def test_shuffled_words_score_lower(spark):
    r = random.Random(1)
    sents = ["the cat sat on the mat", "a dog ran in the park", "the bird sang on a tree"]
    d = spark.createDataFrame([(i, " ".join(r.choice(sents) for _ in range(20))) for i in range(100)], "doc_id long, text string")
    m = S.fit(d)
    good = sents[0]


    assert m.score(good.encode())[1] > m.score(b"mat the on sat cat the")[1]


@pytest.mark.parametrize("rows", [[], [(1, None), (2, ""), (3, "one"), (3, "one"), (None, "x " * 100_000)]])
def test_defined_cases(spark, rows):
    d = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n_words", F.lit("clash")).withColumn("triple", F.lit(1))
    got = {r.doc_id: r for r in S.score(d, S.fit(d)).collect()}
    assert len(got) == len({i for i, _ in rows})
    if rows:
        assert (got[1].n_words, got[1].log_prob, got[1].mean_log_prob) == (0, 0.0, None) == (got[2].n_words, got[2].log_prob, got[2].mean_log_prob)
        assert got[None].n_words == 100_000 and "triple" in got[None]


def test_words_beyond_the_vocabulary_keep_their_counts(spark):
    rows = [(1, "the frequent sable " * 50 + "cable cable cable table"), (2, "cable"), (2, "cable"), (3, "table unseen"), (4, None)]
    d = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    full, cut = S.fit(d), S.fit(d, vocabulary=3)
    assert b"cable" in full.words and b"cable" not in cut.words and full.rest is None
    a, b = (sorted(((r.doc_id, r.n_words, round(r.log_prob, 6)) for r in S.score(d, m).collect()), key=str) for m in (full, cut))
    got = dict(((i, n), s) for i, n, s in b)
    want = {(i, n): sum(float(cut.table[c(j - 1), c(j + 1), c(j)]) + within(w) for j, w in enumerate(ws)) for i, ws, n, c, within in plain(rows, cut)}
    assert len(a) == len(b) == len(rows) and got.keys() == want.keys()
    assert all(math.isclose(got[k], want[k], rel_tol=1e-5, abs_tol=1e-5) for k in want)


def plain(rows, m):
    """Of each text its words, classes and member log-probabilities, from counts of all words."""
    texts = [(i, C.alnum_words((t or "").encode())) for i, t in rows]
    n = {}
    for _, ws in texts:
        for w in ws:
            n[w] = n.get(w, 0) + 1
    kind = lambda w: m.words[w][0] if w in m.words else S.ending(w)
    for i, ws in texts:
        of = lambda j, ws=ws: 0 if j in (-1, len(ws)) else kind(ws[j])
        within = lambda w: math.log(n[w] / (sum(k for x, k in n.items() if kind(x) == kind(w)) + (kind(w) >= 2 + S.OWN)))
        yield i, ws, len(ws), of, within


def test_second_neighbours_tell_words_apart(spark):
    r = random.Random(2)
    d = spark.createDataFrame([(i, " ".join(f"{x} is {y} and" for _ in range(30) for x, y in [r.choice((("left", "up"), ("right", "down")))])) for i in range(200)], "doc_id long, text string")
    one, two = S.fit(d), S.fit(d, window=2)
    good, bad = b"left is up and", b"left is down and"
    assert 0 < two.share < 1
    assert two.score(good)[1] - two.score(bad)[1] > one.score(good)[1] - one.score(bad)[1] + 0.5
    got = S.score(d, two).first()
    assert math.isclose(got.log_prob, two.score(got.text.encode())[1], rel_tol=1e-9)
