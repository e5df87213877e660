import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.llm import setring as R
from gridloom.llm import simhash as S


def jaccard(a, b):
    return len(a & b) / len(a | b)


def shingles(text, k=5):
    w = text.lower().split()
    return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else [])


def kept(docs, similarity=0.8):
    """Smallest ids of the components, by all pairs of different sets."""
    sets = {}
    for i, t in docs:
        s = shingles(t or "")
        sets[s] = min(i, sets.get(s, i))
    nodes = sorted(sets, key=sets.get)
    group = list(range(len(nodes)))

    def find(x):
        while group[x] != x:
            x = group[x]
        return x

    for i, a in enumerate(nodes):
        for j in range(i + 1, len(nodes)):
            b = nodes[j]
            if min(len(a), len(b)) >= similarity * max(len(a), len(b)) and jaccard(a, b) >= similarity - 1e-12:
                x, y = sorted((find(i), find(j)))
                group[y] = x
    return {sets[nodes[find(i)]] for i in range(len(nodes))}


def edited(r, words, n):
    out = list(words)
    for _ in range(n):
        at = r.randrange(len(out))
        what = r.random()
        if what < 0.6:
            out[at] = f"x{r.randrange(10**6)}"
        elif what < 0.8 and len(out) > 1:
            del out[at]
        else:
            out.insert(at, f"y{r.randrange(10**6)}")
    return out


def corpus(seed):
    """Loose families of all lengths, a large one whose copies are linked by their base alone, common lines, oddities."""
    r = random.Random(seed)
    fresh = lambda n: [f"w{r.randrange(5000)}" for _ in range(n)]
    line = [f"line{i}" for i in range(12)]
    out = []
    for n in (1, 3, 5, 6, 8, 9, 12, 15, 20, 30, 60, 150, 400):
        base = fresh(n)
        for e in range(8):
            out.append(edited(r, base, e % (2 + n // 15)))
    base = fresh(60)
    out += [edited(r, base, r.randrange(1, 3)) for _ in range(120)] + [base]
    chain = fresh(80)
    for _ in range(30):
        chain = edited(r, chain, 1)
        out.append(chain)
    out += [line + fresh(r.randrange(4, 40)) for _ in range(60)]
    r.shuffle(out)
    return [(i * 7 % 1009, " ".join(w)) for i, w in enumerate(out)]


@pytest.mark.parametrize("bounds", [{}, {"clump_rows": 10}, {"bucket_rows": 6, "clump_rows": 40}])
def test_matches_all_pairs(spark, bounds):
    docs = corpus(len(bounds))
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumn("node", F.lit("clash")).withColumn("sh", F.lit(1))
    got = S.deduplicate(d, **bounds)
    assert got.columns == d.columns
    assert {x.doc_id for x in got.collect()} == kept(docs)


def test_hubs_that_link_nothing_lose_no_links(spark):
    """A clump over its bound whose first rows are linked to few: the copies hold together by one base only."""
    r = random.Random(8)
    base = [f"w{i}" for i in range(60)]
    docs = [(i, " ".join(edited(r, base, 2))) for i in range(1, 1500)] + [(5000, " ".join(base))]
    want = kept(docs)
    d = spark.createDataFrame(docs, "doc_id long, text string")
    for bounds in ({}, {"clump_rows": 200}):
        assert {x.doc_id for x in S.deduplicate(d, **bounds).collect()} == want


@pytest.mark.parametrize("n", [1, 2, 4, 5, 6, 7, 9, 11, 14, 20, 37, 60, 100, 333, 2000])
def test_near_sets_meet_within_their_budgets(n):
    r = np.random.default_rng(n)
    lost = 0
    for _ in range(60):
        sh = np.unique(r.integers(0, 1 << 32, n, dtype=np.uint64).astype(np.uint32))
        out, new = r.integers(0, math.floor(n * 0.2) + 1), 0
        while (len(sh) - out) / (len(sh) + new + 1) >= 0.8 and r.random() < 0.9:
            new += 1
        other = np.union1d(r.permutation(sh)[out:], r.integers(0, 1 << 32, new, dtype=np.uint64).astype(np.uint32))
        (a, x), (b, y) = R.keys(sh, 0.8), R.keys(other, 0.8)
        _, i, j = np.intersect1d(a, b, return_indices=True)
        lost += not R.within(x[i], y[j]).any()
    assert not lost


def test_sets_that_share_a_line_seldom_meet():
    """Else such pairs, which grow with the square of the corpus, tie most of it into one clump."""
    r = np.random.default_rng(3)
    line = r.integers(0, 1 << 32, 10, dtype=np.uint64)
    sets = [np.unique(np.concatenate((line, r.integers(0, 1 << 32, n, dtype=np.uint64))).astype(np.uint32)) for n in r.integers(60, 200, 600)]
    found = [R.keys(s, 0.8) for s in sets]
    bucket, chain = (np.concatenate(x) for x in zip(*found, strict=True))
    rows = np.repeat(np.arange(len(sets)), [len(b) for b, _ in found])
    order = np.argsort(bucket, kind="stable")
    met = set()
    for g in np.split(order, np.flatnonzero(np.diff(bucket[order])) + 1):
        for i in range(len(g) - 1):
            met |= {(rows[g[i]], rows[j]) for j in g[i + 1 :][R.within(chain[g[i + 1 :]], chain[g[i]])]}
    assert len(met) <= 10


def test_blocks_of_a_large_rest_are_dealt_out_in_slices(spark, monkeypatch):
    """All of them at once copy a clump's sets as often as its rest has blocks."""
    r = random.Random(5)
    base = [f"w{i}" for i in range(60)]
    docs = [(i, " ".join(edited(r, base, 2))) for i in range(1, 400)]
    names, real = [], R.C.materialise
    monkeypatch.setattr(R.C, "materialise", lambda df, name: names.append(name) or real(df, name))
    d = spark.createDataFrame(docs, "doc_id long, text string")
    assert {x.doc_id for x in S.deduplicate(d, clump_rows=40).collect()} == kept(docs)
    assert names.count("slice") > 1


def test_classes_hold_every_near_size():
    for n in range(1, 400):
        mine = {c[0] for c in R.classes(n, 0.8)}
        for other in range(n, int(n / 0.8 + 1e-9) + 1):
            assert mine & {c[0] for c in R.classes(other, 0.8)}


def test_odd_rows(spark):
    long = " ".join(f"v{i}" for i in range(60_000))
    docs = [(4, "a b c"), (2, "A b  C"), (None, "a b c"), (9, None), (8, ""), (7, " \n"), (20, long), (21, long + " end"), (4, "a b c")]
    d = spark.createDataFrame(docs, "doc_id long, text string")
    assert sorted(x.doc_id for x in S.deduplicate(d).collect()) == [2, 7, 20]
    assert S.deduplicate(d.limit(0)).count() == 0
    assert S.deduplicate(d.filter("doc_id = 9")).count() == 1
