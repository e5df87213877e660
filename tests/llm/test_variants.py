import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from gridloom.llm import variants as V


def words(docs):
    c = Counter()
    for i, t in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = "".join(chr(ord(x) + 32) if "A" <= x <= "Z" else x for x in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            c[run] += 1
    return {w: n for w, n in c.items() if len(w) >= 7 and n >= 2}


def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute(docs):
    """Every two words compared."""
    n = words(docs)
    close = {w: [x for x in n if near(w, x)] for w in n}
    form = {}
    for w, xs in close.items():
        best = min(xs, key=lambda x: (-n[x], x), default=None)
        form[w] = best if best is not None and n[best] >= 10 * n[w] else None
    out = []
    for w in n:
        root = w
        while form[root] is not None:
            root = form[root]
        out.append((w, n[w], len(close[w]), form[w], n[form[w]] if form[w] else None, root))
    return sorted(out)


def found(spark, docs):
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumns({"word": F.lit(1), "n": F.lit("n"), "id": F.lit(2), "key": F.lit(3), "root": F.lit(4)})
    return sorted(map(tuple, V.group(d).select("word", "n", "n_near", "form", "form_n", "root").collect()))


def test_same_as_all_pairs(spark):
    r = random.Random(12)
    stems = ["".join(r.choice("abÀéz") for _ in range(r.randrange(6, 10))) for _ in range(25)]

    def bent():
        w = list(r.choice(stems))
        for _ in range(r.choice([0, 0, 0, 1, 1, 2])):
            i = r.randrange(len(w))
            w[i : i + r.randrange(2)] = r.choice(["", "a", "B", "é", "aa"])
        return "".join(w)

    docs = [(i if i % 7 else None, r.choice([" ", "-", "\n"]).join(bent() for _ in range(60))) for i in range(60)] + [(3, None), (4, ""), (5, "Ünïcode straße ŁódźŁódź")]
    assert found(spark, docs) == brute(docs)


def test_chains_of_forms(spark):
    chain = ["kettenwort", "kettenworte", "kettenworten", "kettenwortens"]
    whole = lambda w: next(i for i in range(99) if zlib.crc32(f"{i}:{w}".encode()) % 31)
    docs = [(whole(w), " ".join([w] * (2 * 12**k))) for k, w in enumerate(chain)]
    got = found(spark, docs)
    assert got == brute(docs)
    assert [x[5] for x in got] == ["kettenwortens"] * 4


def test_ties_repeats_and_long_words(spark):
    long = "".join(chr(97 + i % 26) + "q" * (i % 3) for i in range(20_000))
    docs = [(1, "aaaaaaab " * 40 + "caaaaaab " * 40 + "aaaaaaa baaaaaab"), (1, "aaaaaaa"), (1, "aaaaaaa"), (2, f"{long} {long}x"), (3, f"{long} {long}x"), (4, f"{long}")]
    assert found(spark, docs) == brute(docs)


def test_empty(spark):
    assert found(spark, []) == [] and found(spark, [(1, None), (None, "a b")]) == []


@pytest.mark.parametrize("a,b", [("aab", "ab"), ("abc", "abd"), ("aaa", "aa"), ("é", "è")])
def test_near_words_share_a_key(a, b):
    owner, key = V.deletion_keys([a, b])
    assert set(key[owner == 0]) & set(key[owner == 1])
    assert len(set(key[owner == 0])) == (owner == 0).sum()  # each deletion once
