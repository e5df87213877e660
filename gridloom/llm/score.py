"""LM scoring by masked pseudo-likelihood: bidirectional window networks.

Every word is predicted from its neighbours on both sides, itself masked. A word is a class and a
member of it: the ``OWN`` most frequent words are classes of their own, all others share the classes
of their last two bytes. For each distance up to the window a small network (two embeddings of the
classes at that distance, a tanh layer, a softmax) gives the class; two distances are mixed in the
share that makes the corpus most likely. The member's probability is its count in its class, for
every word of the corpus; one count of a class is left for words that the corpus doesn't have. A
document's score is the sum of its words' conditional log-probabilities.

What the corpus gives are the counts of all words, which grow with it, and those of all class triples
(left, middle, right) at each distance, over all documents: each task counts its own and the counts
are summed. The networks are trained in numpy on the tables of triples, which hold at most
``CLASSES``**3 numbers each whatever the input, so every word of the corpus takes part in every step.

Scale: narrow passes that count, weigh the distances and score. Shuffled are counts, and the words
beyond the broadcast ``VOCABULARY`` with the table of their counts, which stays distributed and is
joined in. Also broadcast is a table of CLASSES**3 log-probabilities for each distance.

Defined results: a null or wordless text has 0 words, log_prob 0 and a null mean; an empty corpus
gives an untrained network; repeated rows count and are scored alike; other columns are kept, except
that n_words, log_prob and mean_log_prob are replaced.
"""

from __future__ import annotations

import zlib
from collections import Counter
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm import common as C

#: Words whose counts are broadcast; those of all others are joined in.
VOCABULARY = 30_000
#: Classes: 0 is the text's edge, 1 is free, then OWN words, then endings.
CLASSES, OWN = 128, 62
#: Words on each side that op7 looks at, one or two.
WINDOW = 2
#: Steps of a log ratio in which the distances are weighed, and the ratio's bound.
RATIO_STEPS, RATIO_MOST = 100, 20
#: Fractions of one in which joined logarithms are summed, so that their order doesn't matter.
FRACTION = 1 << 32
HIDDEN, STEPS, RATE, SEED = 32, 60, 0.05, 7


def class_of(rank: int, word: bytes) -> int:
    return 2 + rank if rank < OWN else ending(word)


def ending(word: bytes) -> int:
    return 2 + OWN + zlib.crc32(word[-2:]) % (CLASSES - 2 - OWN)


@dataclass
class Model:
    #: Of each word of the vocabulary its class and its log-probability within it.
    words: dict[bytes, tuple[int, float]]
    #: By class, the log-probability in it of a word counted once, or never.
    unknown: np.ndarray
    #: log P(middle | left, right), by [left, right, middle].
    table: np.ndarray
    #: The same for the second neighbours, and its share of the mixture.
    outer: np.ndarray | None = None
    share: float = 0.0
    #: word, n of all words beyond the vocabulary that the corpus has more than once.
    rest: DataFrame | None = None

    def classes(self, ws: list[bytes], window: int) -> np.ndarray:
        """The words' classes with window edges before and after."""
        c = np.zeros(len(ws) + 2 * window, dtype=np.int64)
        c[window:-window] = [self.words[w][0] if w in self.words else ending(w) for w in ws]
        return c

    def parts(self, text: bytes | None) -> tuple[int, float, Counter]:
        """Words, log-probability with words beyond the vocabulary as if counted once, and those words."""
        ws = C.alnum_words(text)
        if not ws:
            return 0, 0.0, Counter()
        c = self.classes(ws, 2)
        own = c[2:-2]
        p = self.table[c[1:-3], c[3:-1], own].astype(np.float64)
        if self.outer is not None:
            p = np.logaddexp(p + np.log1p(-self.share), self.outer[c[:-4], c[4:], own] + np.log(self.share))
        get = self.words.get
        members = [get(w) for w in ws]
        rest = Counter([w for w, m in zip(ws, members, strict=True) if m is None])
        within = sum([m[1] for m in members if m is not None]) + sum([k * self.unknown[ending(w)] for w, k in rest.items()])
        return len(ws), float(p.sum() + within), rest

    def score(self, text: bytes | None) -> tuple[int, float]:
        """Words and log-probability, for texts of the vocabulary's words."""
        return self.parts(text)[:2]


def count_words(docs: DataFrame, text: str) -> DataFrame:
    """word, n over all texts; each batch is summed before the shuffle."""

    def count(cols: dict) -> dict:
        n: Counter = Counter()
        for t in cols["text"].to_pylist():
            n.update(C.alnum_words(t))
        return {"word": list(n), "n": list(n.values())}

    return C.arrow_map(docs.select(C.as_bytes(text).alias("text")), count, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def count_triples(docs: DataFrame, classes: dict[bytes, int], text: str, window: int = 1) -> DataFrame:
    """triple ((left * CLASSES + right) * CLASSES + middle), n over all texts, summed in each task first.

    Triples of neighbours at distance d have (d - 1) * CLASSES**3 added.
    """
    spark = docs.sparkSession
    C.small_batches(spark)
    shared = spark.sparkContext.broadcast(classes)
    schema = "triple int, n long"
    arrow = C.arrow_schema(spark, schema)

    def run(batches):
        of = shared.value
        total = np.zeros(window * CLASSES**3, dtype=np.int64)
        for b in batches:
            for t in b.column(0).to_pylist():
                ws = C.alnum_words(t)
                if ws:
                    c = np.zeros(len(ws) + 2 * window, dtype=np.int64)
                    own = c[window:-window]
                    own[:] = [of[w] if w in of else ending(w) for w in ws]
                    for d in range(1, window + 1):
                        left, right = c[window - d :][: len(ws)], c[window + d :][: len(ws)]
                        k, n = np.unique(((d - 1) * CLASSES**2 + left * CLASSES + right) * CLASSES + own, return_counts=True)
                        total[k] += n
        k = np.flatnonzero(total)
        for at in range(0, len(k), 100_000):
            part = k[at : at + 100_000]
            yield pa.RecordBatch.from_arrays([pa.array(part.astype(np.int32)), pa.array(total[part])], schema=arrow)

    return docs.select(C.as_bytes(text)).mapInArrow(run, schema).groupBy("triple").agg(F.sum("n").alias("n"))


def train(counts: np.ndarray, steps: int = STEPS) -> np.ndarray:
    """log P(middle | left, right) after full steps of Adam on counts[left, right, middle]."""
    r = np.random.default_rng(SEED)
    n = CLASSES
    total = counts.sum()
    p = {"left": r.normal(0, 0.1, (n, HIDDEN)), "right": r.normal(0, 0.1, (n, HIDDEN)), "bias": np.zeros(HIDDEN), "out": r.normal(0, 0.1, (HIDDEN, n)), "prior": np.log((counts.sum(axis=(0, 1)) + 1) / (total + n))}
    p = {k: v.astype(np.float32) for k, v in p.items()}
    context = np.flatnonzero(counts.reshape(n * n, n).sum(axis=1))
    at_l, at_r = context // n, context % n
    seen = (counts.reshape(n * n, n)[context] / max(total, 1)).astype(np.float32)
    weight = seen.sum(axis=1, keepdims=True)
    m1, m2 = {k: np.zeros_like(v) for k, v in p.items()}, {k: np.zeros_like(v) for k, v in p.items()}
    for step in range(1, steps + 1 if len(context) else 1):
        h = np.tanh(p["left"][at_l] + p["right"][at_r] + p["bias"])
        z = h @ p["out"] + p["prior"]
        z -= z.max(axis=1, keepdims=True)
        np.exp(z, out=z)
        z /= z.sum(axis=1, keepdims=True)
        dz = z * weight - seen
        dh = (dz @ p["out"].T) * (1 - h * h)
        g = {"out": h.T @ dz, "prior": dz.sum(axis=0), "bias": dh.sum(axis=0), "left": np.zeros_like(p["left"]), "right": np.zeros_like(p["right"])}
        np.add.at(g["left"], at_l, dh)
        np.add.at(g["right"], at_r, dh)
        for k in p:
            m1[k] = 0.9 * m1[k] + 0.1 * g[k]
            m2[k] = 0.999 * m2[k] + 0.001 * g[k] ** 2
            p[k] = p[k] - RATE * (m1[k] / (1 - 0.9**step)) / (np.sqrt(m2[k] / (1 - 0.999**step)) + 1e-8)
    table = np.empty((n, n, n), dtype=np.float32)
    for l in range(n):
        z = np.tanh(p["left"][l] + p["right"] + p["bias"]) @ p["out"] + p["prior"]
        z -= z.max(axis=1, keepdims=True)
        table[l] = z - np.log(np.exp(z).sum(axis=1, keepdims=True))
    return table


def outer_share(docs: DataFrame, model: Model, text: str) -> float:
    """The share of model.outer under which the words of docs are most likely.

    Each task counts its words by the rounded log ratio of both predictions; the share is found on
    these counts.
    """
    spark = docs.sparkSession
    C.small_batches(spark)
    shared = spark.sparkContext.broadcast(replace(model, rest=None))
    schema = "ratio int, n long"
    arrow = C.arrow_schema(spark, schema)
    most = RATIO_STEPS * RATIO_MOST

    def run(batches):
        m = shared.value
        total = np.zeros(2 * most + 1, dtype=np.int64)
        for b in batches:
            for t in b.column(0).to_pylist():
                ws = C.alnum_words(t)
                if ws:
                    c = m.classes(ws, 2)
                    ratio = m.outer[c[:-4], c[4:], c[2:-2]] - m.table[c[1:-3], c[3:-1], c[2:-2]]
                    total += np.bincount(np.clip(np.rint(ratio * RATIO_STEPS).astype(np.int64), -most, most) + most, minlength=2 * most + 1)
        k = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array((k - most).astype(np.int32)), pa.array(total[k])], schema=arrow)

    rows = docs.select(C.as_bytes(text)).mapInArrow(run, schema).groupBy("ratio").agg(F.sum("n").alias("n")).orderBy("ratio").collect()
    if not rows:
        return 0.5
    ratio, n = np.exp(np.array([r[0] for r in rows]) / RATIO_STEPS), np.array([r[1] for r in rows], dtype=np.float64)
    share = 0.5
    for _ in range(200):  # EM
        share = float((n * share * ratio / (1 - share + share * ratio)).sum() / n.sum())
    return min(max(share, 1e-6), 1 - 1e-6)  # neither distance is ever ruled out


def fit(docs: DataFrame, text: str = "text", vocabulary: int = VOCABULARY, window: int = 1) -> Model:
    """The model of docs, with a window of one or two words on each side."""
    words = C.materialise(count_words(docs, text), "words")
    ranked = [(bytes(w), n) for w, n in words.orderBy(F.desc("n"), "word").limit(vocabulary).collect()]  # the vocabulary's bound
    classes = {w: class_of(i, w) for i, (w, _) in enumerate(ranked)}
    of_class = np.zeros(CLASSES)
    kind = 2 + OWN + F.crc32(F.expr("substring(word, greatest(1, length(word) - 1), 2)")) % (CLASSES - 2 - OWN)
    for c, n in words.groupBy(kind.alias("class")).agg(F.sum("n")).collect():
        of_class[c] = n
    for w, n in ranked[:OWN]:
        of_class[ending(w)] -= n
        of_class[classes[w]] = n
    of_class[2 + OWN :] += 1  # for words that the corpus doesn't have
    known = {w: (classes[w], float(np.log(n / of_class[classes[w]]))) for w, n in ranked}
    rest = None
    if len(ranked) == vocabulary:
        least, last = ranked[-1][1], bytearray(ranked[-1][0])
        rest = words.filter((F.col("n") > 1) & ((F.col("n") < least) | (F.col("n") == least) & (F.col("word") > F.lit(last))))
    else:
        C.discard(words)
    triples = count_triples(docs, classes, text, window).toArrow()  # at most window * CLASSES ** 3 rows
    counts = np.zeros(window * CLASSES**3, dtype=np.float64)
    counts[triples.column(0).to_numpy()] = triples.column(1).to_numpy()
    tables = [train(x) for x in counts.reshape(window, CLASSES, CLASSES, CLASSES)]
    model = Model(known, -np.log(np.maximum(1, of_class)), tables[0], rest=rest)
    if window == 1:
        return model
    model.outer = tables[1]
    model.share = outer_share(docs, model, text)
    return model


def score(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """docs with n_words, log_prob and mean_log_prob."""
    spark = docs.sparkSession
    C.small_batches(spark)
    docs = docs.drop("n_words", "log_prob", "mean_log_prob")
    columns = docs.columns
    shared = spark.sparkContext.broadcast(replace(model, rest=None))
    raw = docs.withColumn(text, C.as_bytes(text))
    schema = C.with_fields(raw, "n_words long, log_prob double, gl_words array<binary>, gl_times array<int>")
    arrow = C.arrow_schema(spark, schema.toDDL())

    def run(batches):
        m = shared.value
        for b in batches:
            cols = {n: b.column(i) for i, n in enumerate(b.schema.names)}
            got = [m.parts(t) for t in cols[text].to_pylist()]
            at = pa.array(np.cumsum([0] + [len(g[2]) for g in got]).astype(np.int32))
            words = pa.ListArray.from_arrays(at, pa.array([w for g in got for w in g[2]], type=pa.binary()))
            times = pa.ListArray.from_arrays(at, pa.array([k for g in got for k in g[2].values()], type=pa.int32()))
            yield C.record_batch(cols | {"n_words": [g[0] for g in got], "log_prob": [g[1] for g in got], "gl_words": words, "gl_times": times}, arrow)

    out = raw.mapInArrow(run, schema).select(*[F.col(c).cast("string") if c == text else F.col(c) for c in columns], "n_words", "log_prob", "gl_words", "gl_times")
    if model.rest is not None:
        # a word counted n times has log n more than one counted once
        out = C.materialise(out.withColumn("gl_row", F.monotonically_increasing_id()), "scored")
        pairs = out.select("gl_row", F.explode(F.arrays_zip("gl_words", "gl_times")).alias("w")).select("gl_row", F.col("w.gl_words").alias("word"), F.col("w.gl_times").alias("times"))
        more = model.rest.select("word", F.round(F.log("n") * FRACTION).cast("long").alias("more"))
        sums = pairs.join(more, "word").groupBy("gl_row").agg(F.sum(F.col("times") * F.col("more")).alias("gl_more"))
        out = out.drop("gl_words", "gl_times").join(sums, "gl_row", "left").withColumn("log_prob", F.col("log_prob") + F.coalesce(F.col("gl_more") / FRACTION, F.lit(0.0)))
    out = out.select(*columns, "n_words", "log_prob")
    return out.withColumn("mean_log_prob", F.when(F.col("n_words") > 0, F.col("log_prob") / F.col("n_words")))


def score_documents(docs: DataFrame) -> DataFrame:
    """Trained on all documents, the score of every document."""
    return score(docs.select("doc_id", "text"), fit(docs, window=WINDOW)).drop("text")
