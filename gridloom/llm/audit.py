"""How filters interact: every order of five filters, from one Walsh-Hadamard transform of their failures.

A document's failures are a mask of five bits. For each of the 32 masks w a signed parity sum is
aggregated, (-1)**popcount(w & mask) over the documents of a part and label; the transform is its own
inverse but for a factor of 32, so the counts of all masks follow exactly, and with them what any order
of the filters keeps and removes. A document that fails k filters is removed first by each of them in
120 / k of the 120 orders, which gives the Shapley sums without walking through the orders.

DataFrame functions only. One pass reads the texts and leaves a mask and a digest of each (SHA-256 of
its UTF-8 bytes; equal digests are taken as equal texts). The smallest doc_id of each digest is an
aggregate that every task begins by itself, and the join that finds the copies is on (digest, doc_id),
so a text that a third of the table repeats is no hot key. Parity sums shrink to a row for each part
and label in every task.

Defined results: a null text is an empty one (no words, fails A only, and E where a smaller doc_id is
empty, too); a null lang is the part of the empty string; a null doc_id is neither smaller nor larger
than any other and has no label; rows that repeat a doc_id count each, and those with the smallest
doc_id of a text don't fail E; of several labels of a document any 1 counts; an empty table has no
part and no rows; other columns are not read.
"""

from __future__ import annotations

import itertools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.llm import common as C

#: The filters; the i-th owns bit i of a mask.
FILTERS = "ABCDE"
MASKS = 1 << len(FILTERS)
ORDERS = ["".join(p) for p in itertools.permutations(FILTERS)]
_SPACE = " \t\n\x0b\f\r"


def text_failures(text: Column) -> Column:
    """The mask of the filters that look at a text alone: A few words, B repeated words, C capitals, D symbols."""
    inner = F.btrim(text, F.lit(_SPACE))
    words = F.when(inner != "", F.split(inner, r"[\x20\x09-\x0D]+")).otherwise(F.array().cast("array<string>"))
    bits = [
        F.size(words) < 100,
        100 * F.size(F.array_distinct(words)) < 80 * F.size(words),
        100 * F.regexp_count(text, F.lit("[A-Z]")) > 10 * F.length(text),
        text.rlike(r"[#$%&*|]"),
    ]
    return sum((b.cast("int") * (1 << i) for i, b in enumerate(bits)), F.lit(0))


def failures(docs: DataFrame) -> DataFrame:
    """doc_id, part, mask of every document."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("part"), text_failures(text).alias("mask"), F.unhex(F.sha2(text, 256)).alias("digest"))
    rows = C.materialise(rows, "audit-rows")
    first = rows.groupBy("digest").agg(F.min("doc_id").alias("doc_id")).withColumn("first", F.lit(True))
    copy = F.col("first").isNull() & F.col("doc_id").isNotNull()
    return rows.join(first, ["digest", "doc_id"], "left").select("doc_id", "part", F.when(copy, F.col("mask") + 16).otherwise(F.col("mask")).alias("mask"))


def _sign(a: Column, b: Column) -> Column:
    return 1 - 2 * (F.bit_count(a.bitwiseAND(b)) % 2)


def parity_sums(masks: DataFrame) -> DataFrame:
    """part, good, toxic, sums: the 32 signed parity sums of the documents with these labels."""
    sums = [F.sum(_sign(F.col("mask"), F.lit(w)).cast("long")) for w in range(MASKS)]
    return masks.groupBy("part", "good", "toxic").agg(F.array(*sums).alias("sums"))


def invert(sums: Column) -> Column:
    """The counts of the 32 masks from their parity sums."""
    every = F.sequence(F.lit(0), F.lit(MASKS - 1))
    of = lambda m: F.aggregate(F.transform(every, lambda w: _sign(m, w) * F.element_at(sums, w + 1)), F.lit(0).cast("long"), lambda a, x: a + x)
    return F.transform(every, lambda m: (of(m) / MASKS).cast("long"))


def cells(masks: DataFrame) -> DataFrame:
    """part and the counts of its 32 masks: n of all documents, good and toxic of those with the label."""
    counted = parity_sums(masks).withColumn("counts", invert(F.col("sums")))
    each = counted.select("part", "good", "toxic", F.posexplode("counts").alias("mask", "n"))
    some = lambda label: F.sum(F.when(F.col(label), F.col("n")).otherwise(0))
    each = each.groupBy("part", "mask").agg(F.sum("n").alias("n"), some("good").alias("good"), some("toxic").alias("toxic"))
    in_order = lambda c: F.transform(F.array_sort(F.collect_list(F.struct("mask", c))), lambda x: x[c])
    return each.groupBy("part").agg(*[in_order(c).alias(c) for c in ("n", "good", "toxic")])  # 32 rows a part


def _total(counts: Column, chosen) -> Column:
    """The sum of the counts of the masks that chosen(mask) holds for."""
    picked = F.transform(counts, lambda n, m: F.when(chosen(m), n).otherwise(0))
    return F.aggregate(picked, F.lit(0).cast("long"), lambda a, x: a + x)


def evaluate(parts: DataFrame) -> DataFrame:
    """Every order and step of each part of cells()."""
    steps = [(o, k + 1, 1 << FILTERS.index(f), sum(1 << FILTERS.index(b) for b in o[:k])) for o in ORDERS for k, f in enumerate(o)]
    table = ", ".join(f"struct('{o}' AS filter_order, {k} AS step, {bit} AS bit, {before} AS before)" for o, k, bit, before in steps)
    rows = parts.withColumn("s", F.explode(F.expr(f"array({table})"))).select("part", "n", "good", "toxic", "s.*")
    bit, before = F.col("bit"), F.col("before")
    fails = lambda m: m.bitwiseAND(bit) > 0
    passed = lambda m: m.bitwiseAND(before) == 0
    removed = lambda m: fails(m) & passed(m)
    shares = F.transform("n", lambda n, m: F.when(fails(m), n * (F.lit(120) / F.greatest(F.bit_count(m), F.lit(1))).cast("long")).otherwise(0))
    return rows.select(
        "part", "filter_order", "step",
        _total(F.col("n"), lambda m: m.bitwiseAND(before.bitwiseOR(bit)) == 0).alias("kept"),
        _total(F.col("n"), removed).alias("removed"),
        _total(F.col("n"), lambda m: fails(m) & ~passed(m)).alias("redundant"),
        _total(F.col("n"), lambda m: m == bit).alias("unique_fails"),
        _total(F.col("good"), removed).alias("good_lost"),
        _total(F.col("toxic"), removed).alias("toxic_lost"),
        F.aggregate(shares, F.lit(0).cast("long"), lambda a, x: a + x).alias("shapley"),
    )


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs (doc_id, lang, text) and labels (doc_id, quality, toxic) as a row for each part, order and step."""
    one = lambda c: F.coalesce(F.max(F.col(c) == 1), F.lit(False))
    known = labels.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(one("quality").alias("good"), one("toxic").alias("toxic"))
    labelled = failures(docs).join(known, "doc_id", "left")
    return evaluate(cells(labelled.select("part", "mask", *[F.coalesce(c, F.lit(False)).alias(c) for c in ("good", "toxic")])))
