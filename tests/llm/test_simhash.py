import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from gridloom.llm import graph
from gridloom.llm import simhash as S


def slow_fingerprint(text, k=3):
    t = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    w = t.encode().split()
    sh = [b" ".join(w[i : i + k]) for i in range(len(w) - k + 1)] if len(w) >= k else [b" ".join(w)] if w else []
    hs = [xxhash.xxh64_intdigest(s, 42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs)) if hs else 0


def slow_components(fps, bits):
    """fps: list of (doc_id, fp)."""
    p = list(range(len(fps)))

    def find(x):
        while p[x] != x:
            x = p[x]
        return x

    a = np.array([f for _, f in fps], dtype=np.uint64)
    for i in range(len(a)):
        for j in np.flatnonzero(np.bitwise_count(a[i + 1 :] ^ a[i]) <= bits) + i + 1:
            p[find(int(j))] = find(i)
    least = {}
    for i, (d, _) in enumerate(fps):
        r = find(i)
        if d is not None:
            least[r] = min(d, least.get(r, d))
    return [least.get(find(i)) for i in range(len(fps))]


def flips(r, f, n):
    for b in r.sample(range(64), n):
        f ^= 1 << b
    return f


def family(seed):
    r = random.Random(seed)
    out = [r.getrandbits(64) for _ in range(300)]
    for _ in range(400):
        out.append(flips(r, r.choice(out), r.randrange(0, 8)))
    hub = r.getrandbits(64)
    out += [flips(r, hub, r.randrange(0, 4)) for _ in range(300)]
    return list(enumerate(out)) + [(None, out[0]), (5000, 0), (5001, 0), (5002, 1)]


@pytest.mark.parametrize("bits", sorted(S.RINGS))
def test_every_pair_meets_in_a_table(bits):
    r = random.Random(bits)
    m, tables = S.ring(bits)
    for _ in range(3000):
        n = r.randrange(0, bits + 1)
        x = flips(r, 0, n)
        ok = [t for t, (start, mask) in enumerate(tables) if not x & mask and S.within(np.array([x], dtype=np.uint64), np.array([start]), m, bits)[0]]
        assert ok
        assert all(any(not x & d for d in S.deeper(tables[t][1], bits)) for t in ok[:1])
    assert not S.within(np.array([flips(r, 0, bits + 1)], dtype=np.uint64), np.array([0]), m, bits)[0]


@pytest.mark.parametrize("bits,limit", [(3, S.BUCKET_ROWS), (3, 20), (6, S.BUCKET_ROWS)])
def test_components_match_brute_force(spark, bits, limit):
    fps = family(bits)
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    d = spark.createDataFrame([(i, [signed(f)]) for i, f in fps], "doc_id long, fps array<long>")
    got = sorted(((r.doc_id, r.fingerprint, r.component_id) for r in S.groups(d, bits, limit).collect()), key=str)
    want = sorted(((i, signed(f), c) for (i, f), c in zip(fps, slow_components(fps, bits), strict=True)), key=str)
    assert got == want


def test_limit_deals_large_buckets_out(monkeypatch):
    r = random.Random(9)
    hub = r.getrandbits(64)
    fps = np.array(sorted({hub ^ (1 << b) for b in range(64)} | {hub}), dtype=np.uint64)
    import pyarrow as pa

    batch = pa.RecordBatch.from_arrays([pa.array(np.full(len(fps), 64 * 5 + 2, dtype=np.int64)), pa.array(fps.view(np.int64)), pa.array(fps.view(np.int64))], names=["bucket", "fp", "node"])
    rows = [x for b in S._compare(3, 10)([batch] * 400) for x in b.to_pylist()]
    assert all(x["again"] == 2 for x in rows) and len(rows) == 400 * len(fps)


def test_documents(spark):
    r = random.Random(1)
    words = [f"w{i}" for i in range(200)]
    base = " ".join(r.choice(words) for _ in range(400))
    docs = [(i, base) for i in (3, 9)] + [(12, base + " more")] + [(20 + i, " ".join(r.choice(words) for _ in range(60))) for i in range(30)]
    docs += [(90, None), (91, ""), (92, " \n"), (93, "One"), (94, "one TWO"), (95, "one two"), (96, "a " * 200_000), (None, base.upper()), (3, base)]
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumn("fp", F.lit("clash")).withColumn("fps", F.lit(1))
    got = sorted(((x.doc_id, x.fingerprint, x.component_id) for x in S.digest(d).collect()), key=str)
    fps = [(i, slow_fingerprint(t)) for i, t in docs]
    assert got == sorted(((i, f"{f:016x}", c) for (i, f), c in zip(fps, slow_components(fps, 3), strict=True)), key=str)
    assert S.digest(d.limit(0)).count() == 0


def test_long_paths_end_in_one_component(spark):
    e = [(i, i + 1) for i in range(0, 300)] + [(1000, 1001)]
    got = {r.node: r.label for r in graph.components(spark.createDataFrame(e, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(301)} | {1000: 1000, 1001: 1000}


def test_one_of_each_group_stays(spark):
    r = random.Random(3)
    words = [f"w{i}" for i in range(500)]
    base = [r.choice(words) for _ in range(600)]
    near = list(base)
    near[300] = "edited"
    docs = [(7, " ".join(base)), (4, " ".join(near)), (4, " ".join(near)), (9, " ".join(base)), (None, " ".join(base)), (1, "alone here"), (None, "no id"), (None, "no id"), (2, ""), (3, None)]
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumn("component", F.lit("clash"))
    got = sorted(((x.doc_id, x.text) for x in S.deduplicate(d).collect()), key=str)
    assert got == sorted([(4, " ".join(near)), (1, "alone here"), (None, "no id"), (2, "")], key=str)
    assert S.deduplicate(d.limit(0)).count() == 0


def test_a_repeated_line_links_no_documents(spark):
    r = random.Random(5)
    line = " ".join(f"line{i}" for i in range(12))
    own = lambda: " ".join(f"w{r.randrange(10**6)}" for _ in range(100))
    docs = [(i, f"{line} " * 100 + own()) for i in range(60)]
    docs += [(100, docs[0][1] + " one"), (101, docs[1][1] + " two")]
    d = spark.createDataFrame(docs, "doc_id long, text string")
    assert {x.doc_id for x in S.deduplicate(d).collect()} == set(range(60))
