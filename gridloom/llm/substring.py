"""Substring dedup with prefix-partitioned suffix trees.

A word goes if it lies in a window of ``WINDOW`` words whose sequence also starts in a document with
a smaller id. Only sparse suffixes are needed for this: in every window the run of ``PREFIX`` words
with the smallest hash is its anchor, and equal windows have equal anchors at equal places.

1. Prefix counts. A suffix whose first PREFIX words occur in one text only is a leaf on its own and
   takes no further part; most do.
2. Variable-length prefixes. The other suffixes are grouped by their first PREFIX words; groups too
   large for one task (``GROUP_ROWS``) are grouped by the longest prefix that matters, the whole
   window (128 bits of BLAKE2 of its words), for which an aggregate gives the smallest id without
   bringing the rows together.
3. Subtrees. A task sorts its groups' suffixes into a tree word by word: nodes are numbered level by
   level, and so are those of the texts before the suffixes, read backwards. Two suffixes share a
   window that starts o words before them if they are in the same node o words back and in the same
   node WINDOW - o words on. The smallest id of such a pair of nodes decides: these deep nodes are
   the maximal repeats, compared word by word, not by hash.

Equal texts are collapsed before: all but the smallest id's copy lose every word. So are, in the task
that reads a text, its suffixes whose words before and on are all the same, and its equal windows: one
row stands for them and carries their places. A line that a text says hundreds of times is a few rows.

Scale: shuffled are a hash for each different anchor (one word in twenty at most), contexts only of
those that repeat, and the texts once or twice, by document. Groups have bounded rows, each of at most
92 words and its places.

Defined results: a null or wordless text has no words; texts of fewer than WINDOW words stay; ids
that are null neither lose words nor make others lose them; rows with equal ids don't touch each
other; other columns are carried through by ``remove_repeats``.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm import common as C

WINDOW = 50
#: Words of the prefix that anchors a window.
PREFIX = 8
_BASE = 0xA0761D6478BD642F
_BASE_INV = pow(_BASE, -1, 1 << 64)
#: Different suffixes of one prefix that one task holds (1.2 MB of contexts), and suffixes that it works on at a time.
GROUP_ROWS, CHUNK_ROWS = 2_000, 20_000


def _slide(x: np.ndarray, n: int, f) -> np.ndarray:
    """f over every n consecutive entries, by doubling."""
    k = 1
    while 2 * k <= n:
        x = f(x[:-k], x[k:])
        k *= 2
    return f(x[: len(x) - (n - k)], x[n - k :]) if n > k else x


def anchors(h: np.ndarray, window: int, prefix: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of the anchors of all windows, and the hashes of the prefixes there, of word hashes h.

    Where a window has its smallest hash several times, each of them is an anchor.
    """
    if len(h) < window:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.uint64)
    g = C.gram_hashes(h, prefix)
    n = window - prefix + 1
    least = _slide(g, n, np.minimum)
    pad = np.zeros(n - 1, dtype=np.uint64)
    most = _slide(np.concatenate([pad, least, pad]), n, np.maximum)
    at = np.flatnonzero(most == g)
    return at, g[at]


def context_hashes(h: np.ndarray, at: np.ndarray, before: int, on: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where the contexts of places at begin and end, and a hash of their words and of the place in them."""
    lo, hi = np.maximum(at - before, 0), np.minimum(at + on, len(h))
    sums = np.zeros(len(h) + 1, dtype=np.uint64)
    np.cumsum(h * C.powers(_BASE, len(h)), out=sums[1:])
    return lo, hi, C.mix((sums[hi] - sums[lo]) * C.powers(_BASE_INV, len(h))[lo]) ^ C.mix((at - lo + 1).astype(np.uint64))


def alike(words: list[bytes], at: np.ndarray, lo: np.ndarray, hi: np.ndarray, hashes: np.ndarray) -> Iterator[list[tuple[int, int, int]]]:
    """The places (at, lo, hi) in lists whose words are equal; hashes find them, the words decide."""
    order = np.argsort(hashes, kind="stable")
    edges = np.flatnonzero(np.diff(hashes[order])) + 1
    places = list(zip(at[order].tolist(), lo[order].tolist(), hi[order].tolist(), strict=True))
    for i, j in zip([0, *edges.tolist()], [*edges.tolist(), len(places)], strict=True):
        left = places[i:j]
        while len(left) > 1:
            p, a, b = left[0]
            run = words[a:b]
            same = [x for x in left if x[0] - x[1] == p - a and words[x[1] : x[2]] == run]
            yield same
            left = [x for x in left if x not in set(same)] if len(same) < len(left) else []
        if left:
            yield left


def merged(first: np.ndarray, end: np.ndarray) -> tuple[list[int], list[int]]:
    """Spans of one length, by place, as the starts and ends of the stretches that they cover."""
    gap = np.flatnonzero(first[1:] > end[:-1])
    return first[np.concatenate(([0], gap + 1))].tolist(), end[np.concatenate((gap, [len(end) - 1]))].tolist()


def _keys(docs: DataFrame, text: str, key: str) -> list:
    """doc_id; th and tl, by which equal texts are known; the text's bytes."""
    raw = F.coalesce(F.col(text).cast("binary"), F.lit(b""))
    return [F.col(key).cast("long").alias("doc_id"), F.xxhash64(raw).alias("th"), (F.shiftleft(F.octet_length(raw).cast("long"), 32) + F.hash(raw)).alias("tl"), raw.alias("raw")]


#: at: the places of a suffix; of a window the stretches that its places cover, until ends.
_ROUTE = "prefix long, doc_id long, th long, at array<int>, ends array<int>, left binary, right binary, w1 long, w2 long"


def _contexts(rows: DataFrame, window: int, prefix: int) -> DataFrame:
    """For rows (doc_id, raw, small, large: prefixes): the contexts of the small ones, the windows of the large."""
    arrow = C.arrow_schema(rows.sparkSession, _ROUTE)
    back = window - prefix
    C.small_batches(rows.sparkSession)

    def of(doc, th, raw, small, large):
        h = C.word_hashes(raw)
        at, g = anchors(h, window, prefix)
        words = raw.split()
        cold = np.isin(g, small)
        if cold.any():
            prefixes = dict(zip(at[cold].tolist(), g[cold].view(np.int64).tolist(), strict=True))
            for same in alike(words, at[cold], *context_hashes(h, at[cold], back, window)):
                p, lo, hi = same[0]
                yield prefixes[p], doc, th, [x[0] for x in same], None, b" ".join(words[lo:p]), b" ".join(words[p:hi]), None, None
        hot = np.isin(g, large)
        if hot.any():
            starts = np.unique((at[hot][:, None] - np.arange(back + 1)).ravel())
            starts = starts[(starts >= 0) & (starts + window <= len(h))]
            for same in alike(words, starts, *context_hashes(h, starts, 0, window)):
                p = np.array([x[0] for x in same])
                x, y = struct.unpack("<qq", hashlib.blake2b(b" ".join(words[p[0] : p[0] + window]), digest_size=16).digest())
                yield None, doc, th, *merged(p, p + window), None, None, x, y

    def run(batches):
        for b in batches:
            held: list[tuple] = []
            for doc, th, raw, small, large in zip(*(c.to_pylist() for c in b.columns), strict=True):
                for r in of(doc, th, raw, *(np.array(x or [], dtype=np.int64).view(np.uint64) for x in (small, large))):
                    held.append(r)
                    if len(held) >= 5_000:
                        yield C.record_batch(dict(zip(arrow.names, zip(*held, strict=True), strict=True)), arrow)
                        held = []
            if held:
                yield C.record_batch(dict(zip(arrow.names, zip(*held, strict=True), strict=True)), arrow)

    return rows.select("doc_id", "th", "raw", "small", "large").mapInArrow(run, _ROUTE)


def _levels(group: np.ndarray, words: np.ndarray) -> list[np.ndarray]:
    """Node numbers at depth 0, 1, ... of the tree of the rows of words; -1 beyond a row's end.

    words: one row a suffix, numbers from 1, 0 after the end.
    """
    out = [group]
    node, base = group.astype(np.int64), int(words.max(initial=0)) + 1
    for d in range(words.shape[1]):
        w = words[:, d]
        live = (node >= 0) & (w > 0)
        new = np.full(len(node), -1, dtype=np.int64)
        _, new[live] = np.unique(node[live] * base + w[live], return_inverse=True)
        node = new
        out.append(node.astype(np.int32))
    return out


def repeats(group: np.ndarray, doc: np.ndarray, left: list[bytes], right: list[bytes], window: int, prefix: int) -> tuple[np.ndarray, np.ndarray]:
    """For each suffix how many words before and from its place repeat earlier text, as 0, 0 if none."""
    number: dict[bytes, int] = {}
    back = window - prefix
    ls, rs = np.zeros((len(doc), back), dtype=np.int32), np.zeros((len(doc), window), dtype=np.int32)
    for i, (a, b) in enumerate(zip(left, right, strict=True)):
        x = [number.setdefault(w, len(number) + 1) for w in reversed(a.split())]
        ls[i, : len(x)] = x
        x = [number.setdefault(w, len(number) + 1) for w in b.split()]
        rs[i, : len(x)] = x
    before, after = _levels(group, ls), _levels(group, rs)
    most_back, most_on = np.zeros(len(doc), dtype=np.int64), np.zeros(len(doc), dtype=np.int64)
    for o in range(back + 1):
        x, y = before[o], after[window - o]
        live = np.flatnonzero((x >= 0) & (y >= 0))
        if not len(live):
            continue
        _, node = np.unique(x[live].astype(np.int64) * (len(doc) + 1) + y[live], return_inverse=True)
        least = np.full(node.max() + 1, np.iinfo(np.int64).max)
        np.minimum.at(least, node, doc[live])
        hit = live[least[node] < doc[live]]
        most_back[hit] = o  # o grows
        most_on[hit] = np.maximum(most_on[hit], window - o)
    return most_back, most_on


_SPAN = "doc_id long, th long, at array<int>, ends array<int>"


def _subtrees(contexts: DataFrame, window: int, prefix: int) -> DataFrame:
    """Spans that repeat earlier text, of contexts sorted by prefix."""
    arrow = C.arrow_schema(contexts.sparkSession, _SPAN)

    def work(parts: list[tuple]) -> pa.RecordBatch:
        prefixes, doc, th = (np.concatenate([p[i] for p in parts]) for i in range(3))
        places, left, right = ([x for p in parts for x in p[i]] for i in (3, 4, 5))
        _, group = np.unique(prefixes, return_inverse=True)
        b, a = repeats(group, doc, left, right, window, prefix)
        hit = np.flatnonzero(a)
        spans = [merged(np.array(places[i]) - b[i], np.array(places[i]) + a[i]) for i in hit.tolist()]
        return C.record_batch({"doc_id": pa.array(doc[hit]), "th": pa.array(th[hit]), "at": [x for x, _ in spans], "ends": [y for _, y in spans]}, arrow)

    def run(batches):
        parts, n = [], 0
        for batch in batches:
            cols = [*(batch.column(i).to_numpy() for i in range(3)), *(batch.column(i).to_pylist() for i in (3, 4, 5))]
            parts.append(tuple(cols))
            n += batch.num_rows
            k = cols[0]
            if n >= CHUNK_ROWS and (k != k[-1]).any():
                cut = int(np.argmax(k == k[-1]))
                parts[-1] = tuple(c[:cut] for c in cols)
                yield work(parts)
                parts, n = [tuple(c[cut:] for c in cols)], len(k) - cut
        if n:
            yield work(parts)

    return contexts.mapInArrow(run, _SPAN)


def repeated(docs: DataFrame, window: int = WINDOW, prefix: int = PREFIX, text: str = "text", key: str = "doc_id", group_rows: int = GROUP_ROWS) -> DataFrame:
    """doc_id, th, spans, whole: what to remove of the texts that hold repeats (whole: all of it)."""
    spark = docs.sparkSession
    C.small_batches(spark)
    keyed = docs.select(*_keys(docs, text, key)).filter("doc_id is not null and octet_length(raw) > 0")
    schema = "doc_id long, th long, tl long, prefixes array<long>"
    arrow = C.arrow_schema(spark, schema)

    def different(raw):
        """The prefixes of the anchors of a text, once for each different context."""
        h = C.word_hashes(raw)
        at, g = anchors(h, window, prefix)
        return g[np.unique(context_hashes(h, at, window - prefix, window)[2], return_index=True)[1]] if len(at) else g

    def scan(batches):
        for b in batches:
            found = [different(t) for t in b.column(3).to_pylist()]
            offsets = np.concatenate(([0], np.cumsum([len(x) for x in found]))).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(found).view(np.int64)))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), lists], schema=arrow)

    scanned = C.materialise(keyed.mapInArrow(scan, schema).filter(F.size("prefixes") > 0), "prefixes")
    texts = C.materialise(scanned.groupBy("th", "tl").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most"), F.any_value("prefixes").alias("prefixes")), "texts")
    suffixes = texts.select(F.col("least").alias("doc_id"), "th", "tl", F.explode("prefixes").alias("prefix"))
    counts = suffixes.groupBy("prefix").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b"), F.count("*").alias("n"))
    counts = C.materialise(counts.filter("a < b").select("prefix", "n"), "counts")
    of = lambda large: F.collect_set(F.when((F.col("n") > group_rows) == F.lit(large), F.col("prefix")))
    mine = C.materialise(suffixes.join(counts, "prefix").groupBy("doc_id", "th", "tl").agg(of(False).alias("small"), of(True).alias("large")), "mine")
    routed = C.materialise(_contexts(keyed.join(mine, ["doc_id", "th", "tl"]), window, prefix), "contexts")
    C.discard(mine, counts)
    contexts = routed.filter("right is not null").select("prefix", "doc_id", "th", "at", "left", "right")
    spans = _subtrees(contexts.repartition("prefix").sortWithinPartitions("prefix"), window, prefix)
    windows = routed.filter("right is null").select("doc_id", "th", "at", "ends", "w1", "w2")
    least = C.materialise(windows.groupBy("w1", "w2").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most")).filter("least < most").drop("most"), "windows")
    late = windows.join(least, ["w1", "w2"]).filter("doc_id > least").select("doc_id", "th", "at", "ends")
    stretches = F.flatten(F.collect_list(F.arrays_zip("at", "ends"))).cast("array<struct<first:int,end:int>>")
    spans = spans.unionByName(late).groupBy("doc_id", "th").agg(stretches.alias("spans")).withColumn("whole", F.lit(False))
    copies = scanned.select("doc_id", "th", "tl").join(texts.filter("least < most").select("th", "tl", "least"), ["th", "tl"]).filter("least < doc_id")
    copies = copies.select("doc_id", "th").distinct().select("doc_id", "th", F.lit(None).cast("array<struct<first:int,end:int>>").alias("spans"), F.lit(True).alias("whole"))
    out = C.materialise(spans.unionByName(copies), "repeats")
    C.discard(routed, least, scanned, texts)
    return out


def remove_repeats(docs: DataFrame, window: int = WINDOW, prefix: int = PREFIX, text: str = "text", key: str = "doc_id", group_rows: int = GROUP_ROWS, joined: bool = False) -> DataFrame:
    """docs without repeated words, and gl_n_words, gl_n_removed.

    What is left of a text keeps its white space; joined: the kept words with one space between them.
    A null text stays null, unless joined.
    """
    spark = docs.sparkSession
    found = repeated(docs, window, prefix, text, key, group_rows).select(F.col("doc_id").alias("gl_id"), F.col("th").alias("gl_th"), F.col("spans").alias("gl_spans"), F.col("whole").alias("gl_whole"))
    docs = docs.drop("gl_n_words", "gl_n_removed")
    columns = docs.columns
    th = F.xxhash64(F.coalesce(F.col(text).cast("binary"), F.lit(b"")))
    raw = docs.withColumn("gl_text_th", th).withColumn(text, C.as_bytes(text))
    both = raw.join(found, (F.col(key).cast("long") == F.col("gl_id")) & (F.col("gl_text_th") == F.col("gl_th")), "left").select(*columns, "gl_spans", "gl_whole")
    schema = C.with_fields(both.select(*columns), "gl_n_words int, gl_n_removed int")
    arrow = C.arrow_schema(spark, schema.toDDL())

    def run(batches):
        for b in batches:
            cols = {n: b.column(i) for i, n in enumerate(b.schema.names)}
            out, n_words, n_removed = [], [], []
            for t, spans, whole in zip(cols[text].to_pylist(), cols["gl_spans"].to_pylist(), cols["gl_whole"].to_pylist(), strict=True):
                words = C.space_words(t)
                gone = np.full(len(words), bool(whole))
                for s in spans or ():
                    gone[s["first"] : s["end"]] = True
                n = int(gone.sum())
                if joined:
                    t = b" ".join([w for w, g in zip(words, gone.tolist(), strict=True) if not g] if n else words)
                elif n:
                    t = cut(t, gone)
                out.append(t)
                n_words.append(len(words))
                n_removed.append(n)
            yield C.record_batch(cols | {text: out, "gl_n_words": n_words, "gl_n_removed": n_removed}, arrow)

    return both.mapInArrow(run, schema).withColumn(text, F.col(text).cast("string"))


def cut(raw: bytes, gone: np.ndarray) -> bytes:
    """raw without the words that are gone; each leaves with the white space behind it."""
    edge = np.diff(np.concatenate(([True], C._SPACE[np.frombuffer(raw, dtype=np.uint8)], [True])).astype(np.int8))
    start = np.flatnonzero(edge == -1).tolist()
    parts, at = [raw[: start[0]]], start[0]
    for i, g in enumerate(gone.tolist()):
        end = start[i + 1] if i + 1 < len(start) else len(raw)
        if not g:
            parts.append(raw[at:end])
        at = end
    return b"".join(parts)


def digest(docs: DataFrame) -> DataFrame:
    out = remove_repeats(docs.select("doc_id", "text"), joined=True)
    return out.select("doc_id", F.col("gl_n_words").cast("long").alias("n_words"), F.col("gl_n_removed").cast("long").alias("n_removed"), F.sha2("text", 256).alias("kept_sha256"))
