"""SimHash near-duplicates with pigeonring filtering.

A 64-bit fingerprint is cut into segments on a ring. If two fingerprints differ in at most t bits in
all, then from some segment on every chain of l consecutive segments differs in at most l t / m bits
(m segments). So for each start the first segments must be equal and of the next few all but one;
these equal bits are the keys of that start's tables. Pairs that meet in a table must keep the
budget of every longer chain, segment by segment, and the chain of all segments is the full Hamming
check. No pair within t bits is lost, none beyond t is linked.

Scale: only distinct fingerprints are compared. A table's bucket gives a spanning set of links, not
all pairs: it grows one component at a time against what is not yet linked. Buckets beyond
``BUCKET_ROWS`` are dealt out again under longer keys, which cover all choices of differing bits.
Components are found by rounds of joins. Links and components stay distributed throughout.

Defined results: a null text has no words, like an empty one, and fingerprint zero, which links like
any other; repeated rows are rows of their own; a row with a null id takes its component's smallest
id, null if there is none; other columns are not read.
"""

from __future__ import annotations

import itertools
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm import common as C, setring
from gridloom.llm.graph import components

SEED = 42
#: Distinct fingerprints of one key that one task compares.
BUCKET_ROWS = 50_000
#: Groups up to this size are compared pair by pair, all groups of a batch at once.
SMALL = 48
#: By the most bits that may differ: segments, leading equal ones, and the next of which all but one are equal.
RINGS = {0: (1, 1, 0), 1: (2, 1, 0), 2: (8, 3, 0), 3: (8, 2, 3), 4: (16, 3, 4), 5: (16, 3, 3), 6: (16, 2, 3)}


def shingles(text: bytes | None, k: int) -> list[bytes]:
    words = C.space_words(text.translate(C.LOWER)) if text else []
    if len(words) <= k:
        return [b" ".join(words)] if words else []
    return [b" ".join(words[i : i + k]) for i in range(len(words) - k + 1)]


def majority(h: np.ndarray) -> int:
    """The 64 bits that are set in over half of the hashes."""
    n = len(h)
    if not n:
        return 0
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, n, 65_536):
        ones += np.unpackbits(h[at : at + 65_536].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big")


def fingerprint(text: bytes | None, k: int, n: int = 1) -> list[int]:
    """n fingerprints: the first from XXH64 of the shingles, the others from those hashes mixed anew."""
    digest = xxhash.xxh64_intdigest
    h = np.array([digest(s, SEED) for s in shingles(text, k)], dtype=np.uint64)
    return [majority(h if i == 0 else C.mix(h + np.uint64(i * 0x9E3779B97F4A7C15 & (1 << 64) - 1))) for i in range(n)]


def fingerprints(docs: DataFrame, k: int = 3, n: int = 1, text: str = "text", key: str = "doc_id") -> DataFrame:
    """doc_id, th (a hash of the text) and fps, n fingerprints as longs."""

    def make(cols: dict) -> dict:
        fps = np.array([fingerprint(t, k, n) for t in cols["text"].to_pylist()], dtype=np.uint64).reshape(-1).view(np.int64)
        return {"doc_id": cols["doc_id"], "th": cols["th"], "fps": pa.ListArray.from_arrays(pa.array(np.arange(0, len(fps) + 1, n, dtype=np.int32)), pa.array(fps))}

    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.xxhash64(text).alias("th"), C.as_bytes(text).alias("text"))
    return C.arrow_map(rows, make, "doc_id long, th long, fps array<long>")


def ring(bits: int) -> tuple[int, list[tuple[int, int]]]:
    """The number of segments, and the tables as (start segment, mask of key bits)."""
    m, equal, some = RINGS[bits]
    width = 64 // m
    segment = lambda i: ((1 << width) - 1) << (i % m * width)
    tables = []
    for start in range(m):
        head = [start + i for i in range(equal)]
        tail = [start + equal + i for i in range(some)]
        for left_out in tail or [None]:
            tables.append((start, reduce(lambda x, i: x | segment(i), head + [i for i in tail if i != left_out], 0)))
    return m, tables


def deeper(mask: int, bits: int) -> list[int]:
    """Longer keys for a bucket: whichever bits of a pair differ, some key avoids them all."""
    free = [i for i in range(64) if not mask >> i & 1]
    blocks = [free[i : i + 4] for i in range(0, len(free), 4)]
    every = (1 << 64) - 1
    return [every & ~sum(1 << b for i in out for b in blocks[i]) for out in itertools.combinations(range(len(blocks)), min(bits, len(blocks)))]


def within(x: np.ndarray, start: np.ndarray, m: int, bits: int) -> np.ndarray:
    """Which differences x keep the budgets of all chains from their start segment on."""
    width = 64 // m
    total = np.zeros(len(x), dtype=np.int64)
    alive = np.arange(len(x))
    low = np.uint64((1 << width) - 1) if width < 64 else np.uint64((1 << 64) - 1)
    for n in range(1, m + 1):
        seg = (x[alive] >> (((start[alive] + n - 1) % m) * width).astype(np.uint64)) & low
        total[alive] += np.bitwise_count(seg)
        alive = alive[total[alive] * m <= n * bits]
    out = np.zeros(len(x), dtype=bool)
    out[alive] = True
    return out


def small_groups(bucket: np.ndarray, fp: np.ndarray, start: np.ndarray, m: int, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Linked pairs (row numbers) inside groups of equal bucket, all pairs of the small groups."""
    a, b = [], []
    at = np.arange(len(bucket))
    for d in range(1, len(bucket)):
        at = at[at + d < len(bucket)]
        at = at[bucket[at] == bucket[at + d]]
        if not len(at):
            break
        good = at[within(fp[at] ^ fp[at + d], start[at], m, bits)]
        a.append(good)
        b.append(good + d)
    return (np.concatenate(a), np.concatenate(b)) if a else (at[:0], at[:0])


def large_group(fp: np.ndarray, start: int, m: int, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Links that span the components of one bucket: each is grown against what is not yet linked."""
    rest = np.arange(len(fp))
    a, b = [], []
    while len(rest) > 1:
        frontier, rest = [rest[0]], rest[1:]
        while frontier and len(rest):
            f = frontier.pop()
            hit = within(fp[rest] ^ fp[f], np.full(len(rest), start), m, bits)
            new = rest[hit]
            a.append(np.full(len(new), f))
            b.append(new)
            frontier.extend(new.tolist())
            rest = rest[~hit]
    return (np.concatenate(a), np.concatenate(b)) if a else (np.zeros(0, dtype=int), np.zeros(0, dtype=int))


_PAIR = "a long, b long, again int"


def _compare(bits: int, limit: int):
    """A map over rows (bucket, fp, node) sorted by bucket: links, and rows of larger buckets with their table."""
    m, tables = ring(bits)
    starts = np.array([s for s, _ in tables])

    def settle(bucket, fp, node, out):
        edge = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1], [True])))
        size = np.diff(edge)
        start = starts[(bucket & 63).astype(np.int64)]
        small = np.repeat(size <= SMALL, size)
        i, j = small_groups(bucket[small], fp[small], start[small], m, bits)
        out.append((node[small][i], node[small][j], -1))
        for g in np.flatnonzero(size > SMALL):
            lo, hi = edge[g], edge[g + 1]
            i, j = large_group(fp[lo:hi], int(start[lo]), m, bits)
            out.append((node[lo:hi][i], node[lo:hi][j], -1))

    def run(batches):
        held: list[tuple[np.ndarray, ...]] = []
        n, over = 0, None

        def flush(parts):
            out: list = []
            bucket, fp, node = (np.concatenate(x) for x in zip(*parts, strict=True))
            settle(bucket, fp, node, out)
            return [x for x in out if len(x[0])]

        def emit(parts):
            for x, y, again in parts:
                yield pa.RecordBatch.from_arrays([pa.array(x.view(np.int64)), pa.array(y.view(np.int64)), pa.array(np.full(len(x), again, dtype=np.int32))], names=["a", "b", "again"])

        for batch in batches:
            cols = tuple(c.to_numpy().view(np.uint64) for c in batch.columns)
            if over is not None:  # the rest of a bucket that is too large goes on
                k = int(np.searchsorted(cols[0] != over, True)) if (cols[0] != over).any() else len(cols[0])
                yield from emit([(cols[1][:k], cols[2][:k], int(over) & 63)] if k else [])
                cols = tuple(c[k:] for c in cols)
                if not len(cols[0]):
                    continue
                over = None
            held.append(cols)
            n += len(cols[0])
            if n < 20_000:
                continue
            bucket, fp, node = (np.concatenate(x) for x in zip(*held, strict=True))
            cut = int(np.argmax(bucket == bucket[-1])) if bucket[0] != bucket[-1] else 0
            if cut:
                yield from emit(flush([(bucket[:cut], fp[:cut], node[:cut])]))
            held, n = [(bucket[cut:], fp[cut:], node[cut:])], len(bucket) - cut
            if n > limit:
                over = bucket[-1]
                yield from emit([(fp[cut:], node[cut:], int(over) & 63)])
                held, n = [], 0
        if n:
            yield from emit(flush(held))

    return run


def _bucketed(rows: DataFrame, tables: list[tuple[int, int]]) -> DataFrame:
    """rows (fp, node) once for each table: bucket (its low 6 bits name the table), fp, node."""
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    keys = F.array(*[F.xxhash64(F.lit(i), F.col("fp").bitwiseAND(F.lit(signed(mask)))).bitwiseAND(F.lit(-64)).bitwiseOR(F.lit(t).cast("long")) for i, (t, mask) in enumerate(tables)])
    return rows.select(F.explode(keys).alias("bucket"), "fp", "node")


def links(rows: DataFrame, bits: int, limit: int = BUCKET_ROWS) -> DataFrame:
    """a, b: nodes whose fingerprints (rows: fp, node, distinct) differ in at most bits bits, spanning."""
    _, tables = ring(bits)
    numbered = [(t, mask) for t, (_, mask) in enumerate(tables)]
    found = C.materialise(_met(_bucketed(rows, numbered), bits, limit), "links")
    out = found.filter("again < 0").select("a", "b")
    large = found.filter("again >= 0").select(F.col("a").alias("fp"), F.col("b").alias("node"), F.col("again").alias("t"))
    again = [r[0] for r in large.select("t").distinct().collect()]  # tables, of which there are at most 64
    if not again:
        return out
    dealt = [_bucketed(large.filter(F.col("t") == t), [(t, x) for x in deeper(tables[t][1], bits)]) for t in again]
    more = _met(reduce(DataFrame.unionByName, dealt), bits, 1 << 62)  # keys that leave a few bits, so few rows
    return out.unionByName(C.materialise(more.select("a", "b"), "links"))


def _met(dealt: DataFrame, bits: int, limit: int) -> DataFrame:
    C.small_batches(dealt.sparkSession)
    # by node, so that a group's links start at the same nodes in all tables, and most are the same links
    return dealt.repartition("bucket").sortWithinPartitions("bucket", "node").mapInArrow(_compare(bits, limit), _PAIR)


def groups(fps: DataFrame, bits: int = 3, limit: int = BUCKET_ROWS) -> DataFrame:
    """fps with fingerprint, the first of them as a long, component_id and component, a label for joins.

    Rows are linked where any of their fingerprints differ in at most bits bits; rows of one first
    fingerprint are one node, so several fingerprints must be functions of the first or be one only.
    """
    fps = C.materialise(fps.withColumn("fingerprint", F.element_at("fps", 1)), "fingerprints")
    n = fps.select(F.max(F.size("fps"))).first()[0] or 0
    edges = None
    for i in range(1, n + 1):
        rows = fps.select(F.element_at("fps", i).alias("fp"), F.col("fingerprint").alias("node")).distinct()
        found = links(rows, bits, limit)
        edges = found if edges is None else edges.unionByName(found)
    least = fps.groupBy("fingerprint").agg(F.min("doc_id").alias("least"))
    if edges is None:
        return fps.withColumns({"component": F.col("fingerprint"), "component_id": F.col("doc_id")})
    labels = components(edges)
    named = least.join(labels.withColumnRenamed("node", "fingerprint"), "fingerprint", "left").withColumn("label", F.coalesce("label", "fingerprint"))
    named = C.materialise(named, "named")
    smallest = named.groupBy("label").agg(F.min("least").alias("component_id"))
    # written out, so that the joins have an exchange on both sides and large partitions can be split
    smallest = C.materialise(smallest, "smallest")
    of = C.materialise(named.join(smallest, "label").select("fingerprint", F.col("label").alias("component"), "component_id"), "classes")
    return fps.join(of, "fingerprint")


def digest(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint in hex, component_id at three words and three bits."""
    return groups(fingerprints(docs)).select("doc_id", C.hex_unsigned(F.col("fingerprint")).alias("fingerprint"), "component_id")


def deduplicate(docs: DataFrame, k: int = 5, similarity: float = 0.8, text: str = "text", key: str = "doc_id", **bounds: int) -> DataFrame:
    """docs with one document of each group: that with the smallest id (null ids last, then by text).

    Documents are linked where their sets of k-word shingles have the similarity (A-Z in lower case,
    a text of fewer words is one shingle; null, empty and wordless texts are all alike). A 64-bit
    fingerprint can't tell this bound, so the pigeonring filter works on the sets: see ``setring``.
    Repeated rows (id and text) are one document; other columns are kept; an empty table stays empty.
    """
    sets = C.materialise(setring.shingle_sets(docs, k, text, key), "sets")
    order = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "th")
    firsts = C.materialise(sets.groupBy("node").agg(F.min(order).alias("first")), "firsts")
    of = C.materialise(setring.classes_of(sets.select("node", "sh"), similarity, **bounds), "classes")
    stay = firsts.join(of, "node", "left").groupBy(F.coalesce("component", "node").alias("component")).agg(F.min("first").alias("first"))
    stay = C.materialise(stay.select(F.col("first.doc_id").alias("gl_id"), F.col("first.th").alias("gl_th")), "stay")
    again = not sets.groupBy("doc_id", "th").count().filter("count > 1").isEmpty()
    C.discard(sets, firsts, of)
    own, columns = docs.withColumn("gl_text", F.xxhash64(text)), docs.columns
    kept = own.join(stay, F.col(key).cast("long").eqNullSafe(F.col("gl_id")) & (F.col("gl_text") == F.col("gl_th")), "left_semi")
    if again:
        kept = kept.dropDuplicates([key, "gl_text"])
    return kept.select(*columns)
