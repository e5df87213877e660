import itertools
import random
import re
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from gridloom.llm import audit as A


def fails(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    return "".join(c for c, bad in zip("ABCD", (len(w) < 100, 100 * len(set(w)) < 80 * len(w), 100 * len(re.findall("[A-Z]", text)) > 10 * len(text), re.search(r"[#$%&*|]", text)), strict=True) if bad)


def brute(docs, labels):
    """Row by row through every order."""
    least = {}
    for i, _, t in docs:
        t = t or ""
        if i is not None:
            least[t] = min(least.get(t, i), i)
    good, toxic = ({i for i, *v in labels if v[k] == 1 and i is not None} for k in (0, 1))
    out, shapley = defaultdict(Counter), Counter()
    for i, lang, t in docs:
        t = t or ""
        f = fails(t) + ("E" if i is not None and i > least[t] else "")
        for order in map("".join, itertools.permutations("ABCDE")):
            gone = False
            for k, own in enumerate(order, 1):
                c = out[lang or "", order, k]
                hit = own in f
                c["kept"] += not gone and not hit
                c["redundant"] += gone and hit
                c["unique"] += f == own
                if hit and not gone:
                    gone = True
                    c["removed"] += 1
                    c["good"] += i in good
                    c["toxic"] += i in toxic
                    shapley[lang or "", own] += 1
    return sorted((p, o, k, c["kept"], c["removed"], c["redundant"], c["unique"], c["good"], c["toxic"], shapley[p, o[k - 1]]) for (p, o, k), c in out.items())


def found(spark, docs, labels):
    d = spark.createDataFrame(docs, "doc_id long, lang string, text string").withColumns({"mask": F.lit("x"), "part": F.lit(1), "digest": F.lit(2), "first": F.lit(3), "n": F.lit(4)})
    t = spark.createDataFrame(labels, "doc_id long, quality int, toxic int").withColumn("good", F.lit("?"))
    return sorted(map(tuple, A.audit(d, t).select("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley").collect()))


def test_same_as_every_order(spark):
    r = random.Random(11)
    text = lambda: " ".join(r.choice(["aa", "bb", "CCC", "d#", "é%", "x\ty", "w\xa0v"]) + str(r.randrange(r.choice([3, 2000]))) for _ in range(r.choice([0, 5, 99, 100, 101, 130])))
    kept = [text() for _ in range(25)]
    docs = [(r.choice([*range(40), None]), r.choice(["en", "de", "", None]), r.choice([*kept, "", None, " \n"])) for _ in range(120)]
    docs += [(5, "en", "same"), (5, "de", "same"), (5, "en", "same"), (9, "en", "same"), (None, "en", "same")]
    labels = [(r.choice([*range(40), None]), r.choice([0, 1, None]), r.choice([0, 1, None])) for _ in range(30)]
    assert found(spark, docs, labels) == brute(docs, labels)


def test_transform_is_inverted(spark):
    r = random.Random(3)
    masks = [(r.choice("pq"), r.random() < 0.5, r.random() < 0.2, r.randrange(32)) for _ in range(500)]
    got = {x.part: x for x in A.cells(spark.createDataFrame(masks, "part string, good boolean, toxic boolean, mask int")).collect()}
    for p in "pq":
        for name, keep in (("n", lambda m: True), ("good", lambda m: m[1]), ("toxic", lambda m: m[2])):
            c = Counter(m[3] for m in masks if m[0] == p and keep(m))
            assert list(got[p][name]) == [c[k] for k in range(32)]


def test_long_text_and_limits(spark):
    exact = " ".join(map(str, range(1000, 1080))) + " 1000" * 20  # 100 words, 80 different
    tenth = "A" + "b" * 9
    docs = [(1, "a", "Zz " * 300_000), (2, "a", exact), (3, "a", exact + " 1000"), (4, "b", tenth), (5, "b", "A" + tenth), (6, "b", "é" * 9 + "A")]
    assert found(spark, docs, []) == brute(docs, [])


def test_empty_tables(spark):
    assert found(spark, [], []) == []
    assert len(found(spark, [(1, "en", "x")], [])) == 600
