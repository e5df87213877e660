"""Benchmark decontamination with a generalised suffix automaton of the test items.

The items' words (A-Z in lower case, punctuation gone) go into one generalised suffix automaton;
each document's words stream through it, which gives at every word the longest match that ends
there. A match of ``ngram`` words or more marks its words as hit; an item of fewer words counts
where it occurs whole.

Scale: no shuffle at all. Each task maps its own documents; the automaton is the only thing that is
broadcast, in blocks of at most ``block_words`` item words (longer items are cut into overlapping
pieces, which changes no window), and every document passes every block.

Defined results: a null or wordless text has no words and no hits; null or wordless items occur
nowhere; equal items all count, by their ids; an item without an id marks words but is not listed;
repeated rows are judged alike; other columns are carried through by ``decontaminate``.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm import common as C

#: Words of an item that are one window.
NGRAM = 10
#: Item words in one automaton: the bound of what is broadcast, some 50 MB.
BLOCK_WORDS = 100_000
#: Automata that one pass over the documents holds; more blocks take more passes.
BLOCKS_A_PASS = 2


class Automaton:
    """Generalised suffix automaton over word numbers; state 0 is the empty word sequence."""

    def __init__(self, items: list[tuple[str | None, list[bytes]]], ngram: int = NGRAM):
        self.ngram = ngram
        self.vocab: dict[bytes, int] = {}
        self.trans: list[dict[int, int]] = [{}]
        self.link = [-1]
        self.length = [0]
        tokens = []
        for item, words in items:
            ids = [self.vocab.setdefault(w, len(self.vocab) + 1) for w in words]
            tokens.append((item, ids))
            last = 0
            for t in ids:
                last = self._extend(last, t)
        n = len(self.link)
        order = sorted(range(n), key=self.length.__getitem__)
        #: For each state the suffix state that holds the sequence of its last ngram words, or -1.
        self.window = [-1] * n
        for s in order[1:]:
            p = self.link[s]
            self.window[s] = s if self.length[p] < ngram <= self.length[s] else self.window[p]
        self.items: dict[int, set] = {}
        short: dict[int, list[tuple[int, str | None]]] = {}
        self.least = ngram
        for item, ids in tokens:
            if not ids:
                continue
            k = min(len(ids), ngram)
            self.least = min(self.least, k)
            s = 0
            if len(ids) < ngram:
                for t in ids:
                    s = self.trans[s][t]
                short.setdefault(s, []).append((k, item))
                continue
            length = 0
            for t in ids:
                s, length = self.step(s, length, t)
                if length >= ngram:
                    self.items.setdefault(self.window[s], set()).add(item)
        #: For each state the short items that are suffixes of its sequences.
        self.short: list[tuple] = [()] * n
        if short:
            for s in order[1:]:
                self.short[s] = tuple(short.get(s, ())) + self.short[self.link[s]]

    def _extend(self, last: int, t: int) -> int:
        trans, link, length = self.trans, self.link, self.length
        if t in trans[last]:
            q = trans[last][t]
            return q if length[q] == length[last] + 1 else self._clone(last, t, q)
        cur = len(link)
        trans.append({})
        link.append(0)
        length.append(length[last] + 1)
        p = last
        while p != -1 and t not in trans[p]:
            trans[p][t] = cur
            p = link[p]
        if p != -1:
            q = trans[p][t]
            link[cur] = q if length[q] == length[p] + 1 else self._clone(p, t, q)
        return cur

    def _clone(self, p: int, t: int, q: int) -> int:
        trans, link, length = self.trans, self.link, self.length
        c = len(link)
        trans.append(dict(trans[q]))
        link.append(link[q])
        length.append(length[p] + 1)
        link[q] = c
        while p != -1 and trans[p].get(t) == q:
            trans[p][t] = c
            p = link[p]
        return c

    def step(self, s: int, n: int, t: int) -> tuple[int, int]:
        """From the state of the longest match and its length, those after one more word."""
        trans = self.trans
        while (to := trans[s].get(t)) is None:
            if s == 0:
                return 0, 0
            s = self.link[s]
            n = self.length[s]
        return to, n + 1

    def match(self, words: list[bytes]) -> tuple[np.ndarray, set]:
        """The words that an item's window covers, as a mask, and the items that occur."""
        hit = np.zeros(len(words), dtype=bool)
        found: set = set()
        ids = np.fromiter(map(self.vocab.get, words, itertools.repeat(0)), dtype=np.int32, count=len(words))
        edge = np.diff(np.concatenate(([0], (ids > 0).view(np.int8), [0])))
        start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        long = end - start >= self.least  # an unknown word ends every match, so shorter runs hold none
        for a, b in zip(start[long].tolist(), end[long].tolist(), strict=True):
            s = n = 0
            trans, link, length, ngram = self.trans, self.link, self.length, self.ngram
            for i, t in enumerate(ids[a:b].tolist(), a + 1):
                while (to := trans[s].get(t)) is None and s:
                    s = link[s]
                    n = length[s]
                if to is None:
                    continue
                s = to
                n += 1
                if n >= ngram:
                    hit[i - n : i] = True
                    found |= self.items[self.window[s]]
                for k, item in self.short[s]:
                    if k <= n:
                        hit[i - k : i] = True
                        found.add(item)
        return hit, found


def item_blocks(items: DataFrame, ngram: int, block_words: int) -> Iterator[list[tuple[str | None, list[bytes]]]]:
    """The items in blocks of at most block_words words; the driver holds one block at a time."""
    block, size = [], 0
    for item, text in items.select(F.col("item_id").cast("string"), C.as_bytes("text")).toLocalIterator():
        words = C.alnum_words(bytes(text) if text is not None else None)
        step = block_words - ngram + 1
        for at in range(0, max(1, len(words) - ngram + 1), step):
            piece = words[at : at + block_words]
            if not piece:
                continue
            if size + len(piece) > block_words and block:
                yield block
                block, size = [], 0
            block.append((item, piece))
            size += len(piece)
    if block:
        yield block


def spans(hit: np.ndarray) -> list[tuple[int, int]]:
    """The runs of True in hit, as (first, end)."""
    edge = np.diff(np.concatenate(([0], hit.view(np.int8), [0])))
    return list(zip(np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist(), strict=True))


_SPANS = "array<struct<first:int,end:int>>"


def match_items(docs: DataFrame, items: DataFrame, ngram: int = NGRAM, block_words: int = BLOCK_WORDS, text: str = "text", carry_text: bool = True) -> DataFrame:
    """docs with gl_n_words, gl_spans (hit runs of words) and gl_items (ids of occurring items, sorted).

    carry_text: whether the text comes back, too.
    """
    rest = [c for c in docs.columns if c not in ("gl_n_words", "gl_spans", "gl_items", text)]
    out = docs.select(*rest, C.as_bytes(text).alias(text), F.lit(0).alias("gl_n_words"), F.array().cast(_SPANS).alias("gl_spans"), F.array().cast("array<string>").alias("gl_items"))
    blocks = item_blocks(items, ngram, block_words)
    held = list(itertools.islice(blocks, BLOCKS_A_PASS))
    while True:
        following = list(itertools.islice(blocks, BLOCKS_A_PASS))
        out = _pass(out, [Automaton(b, ngram) for b in held], text, carry_text or bool(following))
        if not following:
            break
        out, held = C.materialise(out, "decontaminate"), following
    return out.withColumn(text, F.col(text).cast("string")) if carry_text else out


def _pass(docs: DataFrame, automata: list[Automaton], text: str, carry_text: bool) -> DataFrame:
    spark = docs.sparkSession
    C.small_batches(spark)
    schema = (docs if carry_text else docs.drop(text)).schema
    arrow = C.arrow_schema(spark, schema.toDDL())
    shared = spark.sparkContext.broadcast(automata)

    def run(batches):
        held = shared.value
        for b in batches:
            cols = {n: b.column(i) for i, n in enumerate(b.schema.names)}
            counts, all_spans, all_items = [], [], []
            before = zip(cols["gl_spans"].to_pylist(), cols["gl_items"].to_pylist(), strict=True)
            for t, (was, had) in zip(cols[text].to_pylist(), before, strict=True):
                words = C.alnum_words(t)
                hit, found = np.zeros(len(words), dtype=bool), set(had)
                for s in was:
                    hit[s["first"] : s["end"]] = True
                for a in held:
                    h, f = a.match(words)
                    hit |= h
                    found |= f
                counts.append(len(words))
                all_spans.append([{"first": x, "end": y} for x, y in spans(hit)])
                all_items.append(sorted(x for x in found if x is not None))
            cols |= {"gl_n_words": counts, "gl_spans": all_spans, "gl_items": all_items}
            yield C.record_batch(cols, arrow)

    return docs.mapInArrow(run, schema)


def digest(matched: DataFrame) -> DataFrame:
    """n_words, n_hit, n_items, items_sha256 and contaminated of what match_items returns."""
    n_hit = F.aggregate("gl_spans", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["first"])
    return matched.select(
        "doc_id",
        F.col("gl_n_words").cast("long").alias("n_words"),
        n_hit.alias("n_hit"),
        F.size("gl_items").cast("long").alias("n_items"),
        F.sha2(F.array_join("gl_items", ","), 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"),
    )


def decontaminate(docs: DataFrame, items: DataFrame, ngram: int = NGRAM, min_span: int = 1, max_coverage: float = 0.5, text: str = "text", block_words: int = BLOCK_WORDS) -> DataFrame:
    """docs without what they share with the items.

    Runs of hit words of min_span or more are cut out of the text, with the white space and
    punctuation between them; a document of which more than max_coverage is hit is dropped. The
    columns stay as they were; n_chars, where there is one, follows the text.
    """
    columns, name = docs.columns, text
    matched = match_items(docs, items, ngram, block_words, text)
    n_hit = F.aggregate("gl_spans", F.lit(0), lambda a, s: a + s["end"] - s["first"])
    kept = matched.filter(n_hit <= max_coverage * F.col("gl_n_words"))
    C.small_batches(docs.sparkSession)
    schema = C.arrow_schema(docs.sparkSession, docs.schema.toDDL())

    def run(batches):
        for b in batches:
            cols = {n: b.column(i) for i, n in enumerate(b.schema.names)}
            texts = []
            for t, runs in zip(cols[name].to_pylist(), cols["gl_spans"].to_pylist(), strict=True):
                runs = [(s["first"], s["end"]) for s in runs if s["end"] - s["first"] >= min_span]
                texts.append(cut(t, runs) if runs else t)
            if "n_chars" in cols:
                cols["n_chars"] = _lengths(cols["n_chars"], cols[name], texts)
            cols[name] = texts
            yield C.record_batch(cols, schema)

    return kept.mapInArrow(run, docs.schema).select(*columns)


def _lengths(given: pa.Array, old: pa.Array, new: list) -> list:
    return [n if a == b else len(b) for n, a, b in zip(given.to_pylist(), old.to_pylist(), new, strict=True)]


def cut(text: str, runs: list[tuple[int, int]]) -> str:
    """text without the given runs of its words; what stands between kept words stays as it is."""
    raw = text.encode()
    flat = np.frombuffer(raw.translate(C.ALNUM), dtype=np.uint8) != 32
    edge = np.diff(np.concatenate(([0], flat.view(np.int8), [0])))
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    parts, at = [], 0
    for first, stop in runs:
        parts.append(raw[at : start[first]])
        at = int(end[stop - 1])
    parts.append(raw[at:])
    return b"".join(parts).decode()
