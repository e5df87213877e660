import re

import corpus_pipeline as P
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from gridloom.llm import bpe, language
from gridloom.llm import common as C

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def steps(spark):
    docs = C.load(spark, SF, "documents")
    out = [docs]
    for name, f in P.STAGES:
        out.append(C.materialise(f(spark, out[-1], SF), name))
    return [{r.doc_id: r for r in d.collect()} for d in out]


def test_stages_keep_the_columns(steps):
    for a in steps[1:-1]:
        assert set(next(iter(a.values())).__fields__) == {"doc_id", "text", "lang", "source", "n_chars"}


def test_language_keeps_what_has_letters(steps):
    assert {i for i, r in steps[0].items() if language.has_letter((r.text or "").encode())} == set(steps[1])


def test_near_dedup_against_all_pairs(steps):
    """The smallest id of every component of links at a similarity of 0.8 of the five-word shingle sets."""
    sets = {}
    for i in sorted(steps[1]):
        w = re.findall("[^\x20\x09-\x0d]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in steps[1][i].text))
        sets[i] = {tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))}
    ids, group = list(sets), {i: i for i in sets}

    def find(x):
        while group[x] != x:
            x = group[x]
        return x

    for n, i in enumerate(ids):
        for j in ids[n + 1 :]:
            if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]) - 1e-9:
                a, b = sorted((find(i), find(j)))
                group[b] = a
    assert {find(i) for i in ids} == set(steps[2])
    assert all(steps[2][i] == steps[1][i] for i in steps[2])


def test_substrings_against_all_windows(steps):
    least = {}
    words = {i: re.findall("[^\x20\x09-\x0d]+", r.text) for i, r in steps[2].items()}
    for i, w in words.items():
        for j in range(len(w) - 49):
            k = tuple(w[j : j + 50])
            least[k] = min(i, least.get(k, i))
    for i, w in words.items():
        gone = {x for j in range(len(w) - 49) if least[tuple(w[j : j + 50])] < i for x in range(j, j + 50)}
        if len(gone) == len(w) and w:
            assert i not in steps[3]
        else:
            assert steps[3][i].text.split() == [x for j, x in enumerate(w) if j not in gone]
            assert gone or steps[3][i] == steps[2][i]


def test_no_benchmark_window_is_left(spark, steps):
    word = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
    of = lambda t: word.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in t))
    windows = set()
    for r in C.load(spark, SF, "benchmark").collect():
        w = of(r.text)
        windows |= {tuple(w[j : j + 10]) for j in range(max(1, len(w) - 9))}
    for i, r in steps[3].items():
        w = of(r.text)
        dirty = any(tuple(w[j : j + 10]) in windows for j in range(len(w) - 9))
        if not dirty:
            assert steps[4][i] == r
        elif i in steps[4]:
            assert len(of(steps[4][i].text)) < len(w)


def test_tokens_are_the_library_s(steps):
    t = Tokenizer.from_file(bpe.default_path())
    t.no_truncation()
    t.no_padding()
    assert set(steps[5]) == set(steps[4])
    for i, r in steps[5].items():
        ids = t.encode(steps[4][i].text, add_special_tokens=False).ids
        assert r.ids == ids and r.n_tokens == len(ids)
        assert r.decoded_sha256 == C.sha256_hex(t.decode(ids, skip_special_tokens=False).encode())


def test_run_is_the_stages_in_order(spark, steps):
    assert {r.doc_id: r for r in P.run(spark, SF).collect()} == steps[5]


def test_stages_take_odd_rows(spark):
    """Null and empty texts, null ids, repeated rows, a long text, a clashing column, and no rows at all."""
    long = " ".join(f"the word{i % 977} of{i % 61}" for i in range(30_000))
    rows = [(1, None, "en", "a", 0), (2, "", "en", "a", 0), (3, "the and of that it is", None, None, None), (3, "the and of that it is", None, None, None), (None, "the house is of that and it", "en", "a", 3), (5, long, "en", "b", len(long)), (6, "12 34", "en", "b", 5)]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").withColumn("node", F.lit("clash"))
    learned = d.unionByName(C.load(spark, SF, "documents").withColumn("node", F.lit("clash")).select(*d.columns))
    kept = P.language_id(spark, learned, SF)
    kept = C.materialise(kept.filter("doc_id is null or doc_id in (1, 2, 3, 5, 6)").join(d.select("text").distinct(), "text", "left_semi").select(*d.columns), "odd")
    assert sorted((r.doc_id or 0, r.text[:7]) for r in kept.collect()) == [(0, "the hou"), (3, "the and"), (3, "the and"), (5, "the wor")]
    docs = kept
    for name, f in P.STAGES[1:]:
        docs = C.materialise(f(spark, docs, SF), name)
        assert sorted(r.doc_id or 0 for r in docs.collect()) == [0, 3, 5]
        if name != "tokens":
            assert set(docs.columns) == set(d.columns)
    empty = kept.limit(0)
    for name, f in P.STAGES:
        empty = C.materialise(f(spark, empty, SF), name)
        assert empty.count() == 0
