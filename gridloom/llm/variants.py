"""Spelling variants: words at edit distance one, found by their deletions, and the form each stands for.

Symmetric deletes: every word emits a 64-bit hash of itself and of each of its distinct single
deletions; two words at distance one share at least one of them, so an equi-join on the hashes finds all
candidates. Candidates are verified on the words themselves. A word's form is the most frequent near
word that is ten times as frequent; forms are followed to their roots by joins that double their
step each round.

Scale: words are counted in every task before they are shuffled, so a frequent word is a row for each
task. All later tables are as large as the vocabulary. The words that share a deletion of L code
points differ by one inserted character, so a group of the join has at most (L + 1) times as many
rows as there are characters (127 here), whatever the corpus. Words travel as ids until the candidates
are verified, so that a very long one isn't copied for each of its deletions. Tables that are read
twice are written to the shared folder.

Defined results: a null text has no words; a null doc_id is the empty string in front of the colon;
rows that repeat a doc_id count each; ties go as the contract says (largest n, then smallest word by
code points); an empty table has no words; other columns are not read.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm import common as C

#: What a word is made of, and how many code points and occurrences it has at least.
RUN = re.compile("[A-Za-zÀ-ÿ]+")
LEAST_LENGTH, LEAST_COUNT = 7, 2
#: One of so many occurrences (by a checksum) loses a code point.
DELETES = 31
#: How many times as frequent a form is.
FORM_FACTOR = 10
#: Different words that a task counts before it hands them on.
HELD = 200_000
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = np.uint64(pow(_BASE, -1, 1 << 64))


def noted(doc_id: int | None, text: bytes) -> Counter:
    """The words of one document that may count, with those that lose a code point, by their number."""
    out = Counter()
    start = zlib.crc32(b":" if doc_id is None else b"%d:" % doc_id)
    for run, n in Counter(RUN.findall(text.translate(C.LOWER).decode("utf-8", "replace"))).items():
        if len(run) < LEAST_LENGTH:
            continue
        h = zlib.crc32(run.encode(), start)
        if h % DELETES == 0:
            i = h % len(run)
            run = run[:i] + run[i + 1 :]
            if len(run) < LEAST_LENGTH:
                continue
        out[run] += n
    return out


def count_words(docs: DataFrame) -> DataFrame:
    """word, n of the words of docs (doc_id, text) that occur often enough."""
    schema = C.arrow_schema(docs.sparkSession, "word string, n long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()
        out = lambda: C.record_batch({"word": list(held), "n": list(held.values())}, schema)
        for b in batches:
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                if (t := text.as_py()) is not None:
                    held.update(noted(doc_id, t))
                if len(held) > HELD:
                    yield out()
                    held = Counter()
        if held:
            yield out()

    C.small_batches(docs.sparkSession)
    each = docs.select(F.col("doc_id").cast("long"), C.as_bytes(F.col("text").cast("string")).alias("text")).mapInArrow(run, "word string, n long")
    return each.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= LEAST_COUNT)


def deletion_keys(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Which word each key belongs to, and the key: a hash of the word and of each of its distinct deletions."""
    length = np.array([len(w) for w in words], dtype=np.int64)
    flat = np.frombuffer("".join(words).encode("utf-32-le"), dtype=np.uint32).astype(np.uint64)
    owner = np.repeat(np.arange(len(words)), length)
    start = np.cumsum(length) - length
    place = np.arange(len(flat)) - start[owner]
    sums = np.zeros(len(flat) + 1, dtype=np.uint64)
    np.cumsum(C.mix(flat) * C.powers(_BASE, int(length.max(initial=1)))[place], out=sums[1:])
    end = start + length
    last = np.ones(len(flat), dtype=bool)  # of a run of equal letters the last one is deleted
    last[:-1] = (flat[1:] != flat[:-1]) | (owner[1:] != owner[:-1])
    i, own = np.flatnonzero(last), owner[last]
    short = (sums[i] - sums[start[own]]) + (sums[end[own]] - sums[i + 1]) * _INVERSE
    whole = sums[end] - sums[start]
    return np.concatenate((np.arange(len(words)), own)), C.mix(np.concatenate((whole, short))).view(np.int64)


def keys(words: DataFrame) -> DataFrame:
    """key, id of words (id, word)."""

    def f(cols: dict) -> dict:
        owner, key = deletion_keys(cols["word"].to_pylist())
        return {"key": key, "id": cols["id"].to_numpy()[owner]}

    return C.arrow_map(words.select("id", "word"), f, "key long, id long")


def near_pairs(words: DataFrame) -> DataFrame:
    """word, n, other, other_n for both directions of every two words at distance one, of words (id, word, n)."""
    k = C.materialise(keys(words), "variant-keys")
    shared = k.join(k.withColumnRenamed("id", "other"), "key").filter("id < other").select("id", "other").distinct()
    o = words.select(F.col("id").alias("other"), F.col("word").alias("other_word"), F.col("n").alias("other_n"))
    pairs = shared.join(words, "id").join(o, "other").filter(F.levenshtein("word", "other_word", 1) == 1)
    both = F.explode(F.array(F.struct("word", "n", F.col("other_word").alias("other"), "other_n"), F.struct(F.col("other_word").alias("word"), F.col("other_n").alias("n"), F.col("word").alias("other"), F.col("n").alias("other_n"))))
    return pairs.select(both.alias("p")).select("p.*")


def roots(forms: DataFrame) -> DataFrame:
    """word, root of forms (word, form): each word's form, that one's form and so on to the last."""
    links = C.materialise(forms.select("word", F.col("form").alias("root")), "variant-roots")
    while True:
        onward = links.select(F.col("word").alias("root"), F.col("root").alias("next"))
        after = C.materialise(links.join(onward, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "variant-roots")
        C.discard(links)
        links = after
        if links.filter("moved").isEmpty():
            return links.select("word", "root")


def group(docs: DataFrame) -> DataFrame:
    """word, n, n_near, form, form_n, root of the words of docs (doc_id, text)."""
    words = C.materialise(count_words(docs).withColumn("id", F.monotonically_increasing_id()), "variant-words")
    best = F.min(F.struct((-F.col("other_n")).alias("m"), F.col("other").alias("form")))
    near = near_pairs(words).groupBy("word").agg(F.count("*").alias("n_near"), best.alias("best"))
    j = words.join(near, "word", "left")
    has = -F.col("best.m") >= FORM_FACTOR * F.col("n")
    j = C.materialise(j.select("word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(has, F.col("best.form")).alias("form"), F.when(has, -F.col("best.m")).alias("form_n")), "variant-forms")
    known = roots(j.filter(F.col("form").isNotNull()))
    return j.join(known, "word", "left").withColumn("root", F.coalesce("root", "word"))
