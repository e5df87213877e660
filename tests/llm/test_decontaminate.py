import hashlib
import random
import re

from pyspark.sql import functions as F

from gridloom.llm import decontaminate as D

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def words(t):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))


def brute(docs, items, n=10):
    out = {}
    for d, t in docs:
        w, hit, found = words(t), set(), set()
        for i, text in items:
            v = words(text)
            k = min(n, len(v))
            for win in {tuple(v[j : j + k]) for j in range(len(v) - k + 1)} if v else ():
                for p in range(len(w) - k + 1):
                    if tuple(w[p : p + k]) == win:
                        hit |= set(range(p, p + k))
                        found.add(i)
        ids = sorted(str(x) for x in found if x is not None)
        out[d] = (len(w), len(hit), len(ids), hashlib.sha256(",".join(ids).encode()).hexdigest(), bool(hit))
    return out


def make(seed, n_docs=60):
    r = random.Random(seed)
    vocab = ["alpha", "Beta", "γάμμα", "d4", "e-f", "x", "y"]
    seq = lambda k: " ".join(r.choice(vocab) for _ in range(k))
    items = [(1, seq(14)), (2, seq(30)), (3, seq(12)), (10, "x y d4"), (11, None), (12, ""), (13, "..."), (2, seq(11)), (15, seq(10))]
    items.append((14, items[0][1]))
    docs = []
    for i in range(n_docs):
        t = seq(r.randrange(0, 40))
        for _ in range(r.randrange(3)):
            v = r.choice(items)[1] or ""
            a = r.randrange(0, max(1, len(v) // 2))
            t += " " + v[a:] + ", " + seq(r.randrange(5))
        docs.append((i, t))
    return docs + [(900, None), (901, ""), (902, "x" * 300_000), (903, "X y D4 " * 500)], items


def run(spark, docs, items, **kw):
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumn("gl_items", F.lit("clash"))
    i = spark.createDataFrame(items, "item_id long, text string").withColumn("item", F.lit(1))
    return {r[0]: tuple(r)[1:] for r in D.digest(D.match_items(d, i, **kw)).collect()}


def test_matches_brute_force(spark):
    docs, items = make(1)
    assert run(spark, docs, items, carry_text=False) == brute(docs, items)


def test_blocks_change_nothing(spark):
    docs, items = make(2, 20)
    assert run(spark, docs, items, block_words=25) == brute(docs, items)


def test_empty_tables(spark):
    docs, items = make(3, 5)
    assert run(spark, [], items) == {}
    assert all(v[1] == 0 and not v[4] for v in run(spark, docs, []).values())


def test_cut_text_is_clean_and_the_rest_stays(spark):
    docs = [(1, "one two. " + " ".join(f"w{i}" for i in range(12)) + "! three four " + "five " * 20), (2, "clean text"), (3, " ".join(f"w{i}" for i in range(12))), (4, None)]
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumn("n_chars", F.length("text").cast("long"))
    i = spark.createDataFrame([(1, " ".join(f"W{i}" for i in range(12)))], "item_id long, text string")
    got = {r.doc_id: (r.text, r.n_chars) for r in D.decontaminate(d, i).collect()}
    clean = "one two. ! three four " + "five " * 20
    assert got == {1: (clean, len(clean)), 2: ("clean text", 10), 4: (None, None)}
