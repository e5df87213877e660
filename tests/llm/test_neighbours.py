import math
import random

import numpy as np
from pyspark.sql import functions as F

from gridloom.llm import neighbours as N

SF = "/root/testdata/sf0.01"


def ok(v):
    return v is not None and all(x is not None and math.isfinite(x) for x in v) and any(v)


def brute(queries, rows, k):
    out = set()
    for i, q in set((i, tuple(v)) for i, v in queries if ok(v) and i is not None):
        best = {}
        for j, v in rows:
            if j is not None and j != i and ok(v) and len(v) == len(q):
                dot = aa = bb = 0.0
                for x, y in zip(q, v, strict=True):
                    dot, aa, bb = dot + x * y, aa + x * x, bb + y * y
                s = dot / (math.sqrt(aa) * math.sqrt(bb))
                best[j] = max(s, best.get(j, -2))
        for r, (s, j) in enumerate(sorted(((s, j) for j, s in best.items()), key=lambda t: (-t[0], t[1]))[:k], 1):
            out.add((i, r, j, s))
    return out


def frame(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("v", F.lit("clash")).withColumn("shard", F.lit(1))


def test_exact_with_ties_copies_and_bad_vectors(spark):
    r = random.Random(2)
    hot = [0.5, -1.0, 2.0, 0.0]
    rows = [(i, [r.gauss(0, 1) for _ in range(4)]) for i in range(700)] + [(1000 + i, hot) for i in range(300)] + [(2000 + i, [2 * x for x in hot]) for i in range(3)]
    rows += [(5000, None), (5050, [0.0] * 4), (5100, [1.0, None, 2.0, 3.0]), (5150, [1.0, float("nan"), 0.0, 0.0]), (5200, [float("inf"), 1.0, 1.0, 1.0]), (5250, []), (None, [1.0] * 4), (5300, [1.0, 2.0]), (5350, [2.0, 1.0]), (7, rows[7][1])]
    d = frame(spark, rows)
    got = set(map(tuple, N.nearest(d.filter("vec_id % 50 = 0"), d, 5, shard_rows=300, query_block=7).collect()))
    assert got == brute([x for x in rows if x[0] is not None and x[0] % 50 == 0], rows, 5)


def test_clustered_trees_prune_and_stay_exact():
    r = np.random.default_rng(3)
    v = r.normal(size=(40, 8))[r.integers(0, 40, 4000)] + 0.05 * r.normal(size=(4000, 8))
    ids = np.arange(4000)
    t = N.Tree(ids, v, 6)
    i, found, score = N.top(t, ids[:50], v[:50], 5, 1.0)
    want = np.argsort(-(t.unit @ t.unit.T), axis=1)
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    want = np.argsort(-(u[:50] @ u.T), axis=1)[:, 1:6]
    assert (found.reshape(50, 5) == want).all()


def test_recall_with_a_larger_factor(spark):
    d = spark.read.parquet(f"{SF}/embeddings.parquet")
    q = d.filter("vec_id % 50 = 0")
    exact = {(r.query_id, r.vec_id) for r in N.nearest(q, d).collect()}
    loose = {(r.query_id, r.vec_id) for r in N.nearest(q, d, factor=1.5).collect()}
    assert len(exact & loose) >= 0.9 * len(exact)
    rows = [(r.vec_id, r.embedding) for r in d.collect()]
    assert {(a, c) for a, _, c, _ in brute([x for x in rows if x[0] % 50 == 0], rows, 5)} == exact
    assert N.nearest(q.limit(0), d.limit(0)).count() == 0


def test_ids_with_several_vectors(spark):
    """Neither the query's own vectors nor several of one candidate take another's place."""
    r = random.Random(6)
    near = lambda: [1 + 0.01 * r.gauss(0, 1), 0.01 * r.gauss(0, 1), 0.01 * r.gauss(0, 1)]
    rows = [(0, near()) for _ in range(9)] + [(3, near()) for _ in range(8)] + [(i, [r.gauss(0, 1) for _ in range(3)]) for i in range(10, 60)]
    d = frame(spark, rows)
    got = N.nearest(d.filter("vec_id % 50 = 0"), d, 5, shard_rows=25).collect()
    best = {}
    for i, rank, j, s in brute([x for x in rows if x[0] % 50 == 0], rows, 60):
        best[i, j] = max(s, best.get((i, j), -2))
    want = {i: sorted(((-s, j) for (q, j), s in best.items() if q == i))[:5] for i in (0, 50)}
    assert {i: sorted((-r.score, r.vec_id) for r in got if r.query_id == i) for i in want} == want


def test_blocks_fetched_or_moved_alike(spark, monkeypatch):
    r = random.Random(8)
    rows = [(i, [r.gauss(0, 1) for _ in range(r.choice([3, 3, 5]))]) for i in range(600)]
    d = frame(spark, rows)
    q = d.filter("vec_id % 10 = 0")
    find = lambda: N.nearest(q, d, 4, shard_rows=100, query_block=9)
    out = find()
    fetched = set(map(tuple, out.collect()))
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan  # trees and blocks aren't paired by a shuffle
    monkeypatch.setattr(N, "opens", lambda path: False)
    assert fetched == set(map(tuple, find().collect())) == brute([x for x in rows if x[0] % 10 == 0], rows, 4)
