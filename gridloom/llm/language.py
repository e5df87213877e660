"""Language ID by bit-sliced Bloom filters of n-grams.

One table of slots serves all languages: bit l of a slot is language l's Bloom filter there, so one
lookup (the AND of ``HASHES`` slots) gives the mask of all languages that may hold an n-gram. Over a
document, each bit is counted; a language's filter also answers yes by chance, at a rate that the
share of its set bits tells, and the counts are corrected for that before the largest decides.

Training counts the n-grams of a sample of each language's different texts (``SAMPLE_DOCS``, drawn by
a hash of the text; all of them where there are fewer) and keeps the ``TOP_GRAMS`` most frequent of
each language; the filters have a fixed size. Every language that occurs is learned: a slot has as
many words of 64 bits as they need.

Scale: prediction is a narrow map; what is broadcast is the slot table, ``SLOTS`` times a bit for each
language. In training copies are collapsed in each task before anything is shuffled, and so are counts.

Defined results: ``und`` with score 0 for a null text, one without a letter, or where nothing could
be learned; a text that hits no filter gets the most frequent learned language and score 0; equal
counts go to the language with more training documents, then to the smaller name. Only the text is
read in prediction; other columns are kept, except that lang_pred and score are replaced.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.llm import common as C

#: Different texts of a language that are sampled, about; the bound of the training sample.
SAMPLE_DOCS = 2_000
#: N-grams of a language in its filter.
TOP_GRAMS = 20_000
#: Byte lengths of the n-grams.
LENGTHS = (3, 4, 5)
#: Slots of the table, a power of two, and slots looked up for each n-gram.
SLOTS, HASHES = 1 << 20, 3
UNKNOWN = "und"

_LETTER_ASCII = re.compile(rb"[A-Za-z]")
_LETTER = regex.compile(r"\p{L}")
#: Every ASCII byte but a-z becomes a space; other bytes stay.
_FOLD = bytes(c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


@dataclass
class Filters:
    languages: list[str]
    slots: np.ndarray
    false_rate: np.ndarray


def has_letter(text: bytes | None) -> bool:
    return bool(text) and (_LETTER_ASCII.search(text) is not None or (not text.isascii() and _LETTER.search(text.decode("utf-8", "replace")) is not None))


def grams(text: bytes) -> np.ndarray:
    """Hashes of the text's n-grams of all lengths, over its folded bytes with a space at either end."""
    folded = text.lower() if text.isascii() else text.decode("utf-8", "replace").lower().encode()
    b = np.frombuffer(b" " + folded.translate(_FOLD) + b" ", dtype=np.uint8).astype(np.uint64) + np.uint64(1)
    return np.concatenate([C.gram_hashes(b, k, 0xA0761D6478BD642F + 2 * k) for k in LENGTHS])


def places(h: np.ndarray, slots: int) -> list[np.ndarray]:
    return [((h >> np.uint64(21 * i)) & np.uint64(slots - 1)).astype(np.int64) for i in range(HASHES)]


def build(counts: dict[str, np.ndarray], slots: int = SLOTS) -> Filters:
    """counts: the n-gram hashes of each language, the languages in order of preference."""
    kind = next((t for t in (np.uint8, np.uint16, np.uint32) if len(counts) <= t().itemsize * 8), np.uint64)
    bits = kind().itemsize * 8
    table = np.zeros((max(1, -(-len(counts) // bits)), slots), dtype=kind)
    rate = np.zeros(len(counts))
    for i, h in enumerate(counts.values()):
        word, bit = table[i // bits], kind(1 << i % bits)
        for p in places(h, slots):
            word[p] |= bit
        rate[i] = np.mean((word & bit) > 0) ** HASHES
    return Filters(list(counts), table, rate)


def hits(f: Filters, h: np.ndarray) -> np.ndarray:
    """For each language the number of hashes h that its filter holds."""
    n, at, out = len(f.languages), places(h, f.slots.shape[1]), []
    for word in f.slots:
        masks = word[at[0]]
        for p in at[1:]:
            masks = masks & word[p]
        bits = masks.dtype.itemsize * 8
        here = min(bits, n - len(out))
        if bits == 8:
            by_mask = np.bincount(masks, minlength=256)
            out += [by_mask[(np.arange(256) >> i) & 1 == 1].sum() for i in range(here)]
        else:
            out += [np.count_nonzero(masks & masks.dtype.type(1 << i)) for i in range(here)]
    return np.array(out)


def decide(f: Filters, text: bytes | None) -> tuple[str, float]:
    if not f.languages or not has_letter(text):
        return UNKNOWN, 0.0
    h = grams(text)
    share = np.clip((hits(f, h) / max(1, len(h)) - f.false_rate) / (1 - f.false_rate), 0, 1)
    best = int(np.argmax(share))
    return f.languages[best], float(share[best] / share.sum()) if share.sum() > 0 else 0.0


def held_out(doc_id: Column | str) -> Column:
    """Whether a document is kept from training: crc32 of its id as text is divisible by 5; null ids are."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.coalesce(F.crc32(c.cast("string")) % 5 == 0, F.lit(True))


def train(docs: DataFrame, text: str = "text", lang: str = "lang", sample_docs: int = SAMPLE_DOCS, top_grams: int = TOP_GRAMS) -> Filters:
    """Filters from rows with a text and a language."""
    spark = docs.sparkSession
    rows = docs.filter(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(lang).cast("string").alias("lang"), C.as_bytes(text).alias("text"))
    named = rows.withColumn("th", F.xxhash64("text"))
    texts = C.materialise(named.groupBy("lang", "th").agg(F.count("*").alias("n")), "texts")
    counts = texts.groupBy("lang").agg(F.sum("n").alias("rows"), F.count("*").alias("texts")).orderBy(F.desc("rows"), "lang").collect()
    if not counts:
        return Filters([], np.zeros((1, 1), dtype=np.uint8), np.zeros(0))
    share = F.element_at(F.create_map(*[F.lit(x) for r in counts for x in (r["lang"], min(1.0, sample_docs / r["texts"]))]), F.col("lang"))
    unit = F.shiftrightunsigned("th", 11).cast("double") / float(1 << 53)
    drawn = texts.filter(unit < share).select("lang", "th")
    # about sample_docs hashes a language, and of each text one row
    sample = named.join(F.broadcast(drawn), ["lang", "th"], "left_semi").groupBy("lang", "th").agg(F.any_value("text").alias("text")).select("lang", "text")
    schema = "lang string, gram long, n long"
    arrow = C.arrow_schema(spark, schema)
    C.small_batches(spark)

    def run(batches):
        for b in batches:
            by: dict[str, list[np.ndarray]] = {}
            for l, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if has_letter(t):
                    by.setdefault(l, []).append(np.unique(grams(t)))  # a document counts once
            for l, hs in by.items():
                g, n = np.unique(np.concatenate(hs), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([l] * len(g)), pa.array(g.view(np.int64)), pa.array(n.astype(np.int64))], schema=arrow)

    from pyspark.sql.window import Window

    summed = sample.mapInArrow(run, schema).groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    # the sample is bounded, and so are a language's n-grams that are ranked here
    ranked = summed.withColumn("r", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram")))
    top = ranked.filter(F.col("r") <= top_grams).select("lang", "gram").toPandas()
    found = {k: g["gram"].to_numpy().view(np.uint64) for k, g in top.groupby("lang")}
    C.discard(texts)
    return build({r["lang"]: found[r["lang"]] for r in counts if r["lang"] in found})


def predict(docs: DataFrame, filters: Filters, text: str = "text") -> DataFrame:
    """docs with lang_pred and score."""
    spark = docs.sparkSession
    C.small_batches(spark)
    docs = docs.drop("lang_pred", "score")
    shared = spark.sparkContext.broadcast(filters)
    columns = docs.columns
    raw = docs.withColumn(text, C.as_bytes(text))
    schema = C.with_fields(raw, "lang_pred string, score double")
    arrow = C.arrow_schema(spark, schema.toDDL())

    def run(batches):
        f = shared.value
        for b in batches:
            cols = {n: b.column(i) for i, n in enumerate(b.schema.names)}
            got = [decide(f, t) for t in cols[text].to_pylist()]
            yield C.record_batch(cols | {"lang_pred": [x[0] for x in got], "score": [x[1] for x in got]}, arrow)

    return raw.mapInArrow(run, schema).select(*[F.col(c).cast("string") if c == text else F.col(c) for c in columns], "lang_pred", "score")


def identify(docs: DataFrame) -> DataFrame:
    """Trained on the documents that are not held out, the language of every document."""
    filters = train(docs.filter(~held_out("doc_id")))
    out = docs.select("doc_id", "text", held_out("doc_id").alias("held_out"))
    return predict(out, filters).drop("text")
