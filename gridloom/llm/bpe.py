"""BPE encoding and decoding: speculate and verify.

A greedy longest match proposes the tokens of each new word. A proposal is the exact encoding if and
only if no merge could ever have crossed one of its token borders, which two adjacent tokens decide
by themselves: numpy walks the right spine of the left token against the left spine of the right one
for all pairs of a batch at once. Only words with a failing pair are merged exactly.

The vocabulary is a ``tokenizers`` file: byte-level BPE with word ends, text in NFC and lower case.
It is read on the driver from a path that is a parameter, and broadcast (its size is fixed, 2 MB).

Scale: a narrow map without any shuffle. Words repeat, so each Python worker keeps the encodings it
has made, of at most ``CACHE_WORDS`` words.

Defined results: a null text is an empty one and has no tokens; the strings of added tokens inside a
text are those tokens, as in the library; repeated rows give equal rows; other columns are kept,
except that ``ids`` and ``decoded`` are replaced.
"""

from __future__ import annotations

import heapq
import itertools
import json
import unicodedata

import numpy as np
import pyarrow as pa
import pyarrow.compute
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm import common as C

FILE = "word_bpe_49k.json"
#: Encoded words that a worker keeps before it starts anew.
CACHE_WORDS = 200_000
#: A rank beyond every merge.
NEVER = 1 << 30


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(FILE)


def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte: itself where it prints, else one from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out, more = {}, 256
    for b in range(256):
        if b in plain:
            out[b] = chr(b)
        else:
            out[b] = chr(more)
            more += 1
    return [out[b] for b in range(256)]


class Tokenizer:
    def __init__(self, spec: str):
        d = json.loads(spec)
        model = d["model"]
        self.end = model["end_of_word_suffix"] or ""
        self.vocab: dict[str, int] = model["vocab"]
        added = {t["content"]: t["id"] for t in d["added_tokens"]}
        size = 1 + max([*self.vocab.values(), *added.values()])
        self.tokens = spellings(spec)
        self.added = added
        self.added_split = regex.compile("(" + "|".join(map(regex.escape, sorted(added, key=len, reverse=True))) + ")") if added else None
        split = next(p for p in d["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")["pattern"]["Regex"]
        self.words = regex.compile(split.replace(r"\s", r"\p{White_Space}")).findall
        self.alphabet = byte_alphabet()
        #: Of each token the rank of its merge (-1 for the alphabet) and its two parts.
        self.rank = np.full(size, -1, dtype=np.int64)
        self.left = np.full(size, -1, dtype=np.int64)
        self.right = np.full(size, -1, dtype=np.int64)
        keys, ranks = [], []
        self.merges: dict[tuple[int, int], tuple[int, int]] = {}
        for r, (a, b) in enumerate(m if isinstance(m, list) else m.split(" ") for m in model["merges"]):
            i, j, k = self.vocab[a], self.vocab[b], self.vocab[a + b]
            self.merges[i, j] = (r, k)
            keys.append(i * size + j)
            ranks.append(r)
            self.rank[k], self.left[k], self.right[k] = r, i, j
        order = np.argsort(keys)
        self.pair_key, self.pair_rank, self.size = np.array(keys, dtype=np.int64)[order], np.array(ranks, dtype=np.int64)[order], size
        self.pair_token = np.full(len(keys) + 1, -1, dtype=np.int64)  # the last for pairs that don't merge
        self.pair_token[:-1] = np.array([self.merges[k // size, k % size][1] for k in self.pair_key.tolist()], dtype=np.int64)
        self._find_sound()
        self._forget()
        self.n_exact = self.n_words = 0

    def crossing(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The rank of the first merge that would cross the border of adjacent tokens a, b; NEVER if none.

        A merge of rank r joins x, of a's right spine, and y, of b's left spine, if both exist at the
        time r and are not joined to their own neighbours before. Where an inner merge has the same
        rank, the left one comes first.
        """
        first = np.full(len(a), NEVER, dtype=np.int64)
        x, x_until, at = a.copy(), np.full(len(a), NEVER, dtype=np.int64), np.arange(len(a))
        while len(at):
            y, y_until, on, xs, xu = b[at].copy(), np.full(len(at), NEVER, dtype=np.int64), at.copy(), x.copy(), x_until.copy()
            while len(on):
                key = xs * self.size + y
                i = np.minimum(np.searchsorted(self.pair_key, key), len(self.pair_key) - 1)
                r = np.where(self.pair_key[i] == key, self.pair_rank[i], NEVER)
                met = (r > self.rank[xs]) & (r > self.rank[y]) & (r < xu) & (r <= y_until) & (r < NEVER)
                first[on[met]] = np.minimum(first[on[met]], r[met])
                down = self.left[y] >= 0
                y_until, y, on, xs, xu = self.rank[y[down]], self.left[y[down]], on[down], xs[down], xu[down]
            down = self.right[x] >= 0
            x_until, x, at = self.rank[x[down]], self.right[x[down]], at[down]
        return first

    def _find_sound(self) -> None:
        """Which tokens encode to themselves: both parts do, and nothing crosses before their own merge."""
        merged = np.flatnonzero(self.rank >= 0)
        clear = self.crossing(self.left[merged], self.right[merged]) >= self.rank[merged]
        sound = self.rank < 0
        for k, ok in sorted(zip(merged.tolist(), clear.tolist(), strict=True), key=lambda x: self.rank[x[0]]):
            sound[k] = ok and sound[self.left[k]] and sound[self.right[k]]
        #: The sound tokens that end a word, without the mark, and the others as a trie ("" holds the token).
        self.endings: dict[str, int] = {}
        self.trie: dict = {}
        for t, i in self.vocab.items():
            if not sound[i]:
                continue
            if t.endswith(self.end):
                self.endings[t.removesuffix(self.end)] = i
            else:
                node = self.trie
                for c in t:
                    node = node.setdefault(c, {})
                node[""] = i

    def spell(self, word: str) -> str:
        return "".join([self.alphabet[b] for b in word.encode()])

    def propose(self, spelt: str) -> list[int]:
        """Greedy longest match over sound tokens; the last one carries the word end."""
        last, i, out, ending, root = len(spelt) - 1, 0, [], self.endings.get, self.trie
        while (t := ending(spelt[i:])) is None:
            node, found = root, None
            for j in range(i, last):
                node = node.get(spelt[j])
                if node is None:
                    break
                if (t := node.get("")) is not None:
                    found, stop = t, j
            if found is None:
                raise ValueError(f"no token for {spelt[i]!r}")
            out.append(found)
            i = stop + 1
        out.append(t)
        return out

    def merge(self, spelt: str) -> list[int]:
        """Exact merging: the pair of lowest rank first, the leftmost of equals."""
        ids = [self.vocab[c] for c in spelt[:-1]] + [self.vocab[spelt[-1] + self.end]]
        n = len(ids)
        after, before, merges = list(range(1, n + 1)), list(range(-1, n - 1)), self.merges
        heap = [(merges[p][0], i, merges[p][1], p) for i, p in enumerate(itertools.pairwise(ids)) if p in merges]
        heapq.heapify(heap)
        while heap:
            _, i, k, (a, b) = heapq.heappop(heap)
            j = after[i]
            if ids[i] != a or j >= n or ids[j] != b:
                continue
            ids[i], ids[j] = k, -1
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
            for x, y in ((before[i], i), (i, after[i])):
                if x >= 0 and y < n and (m := merges.get((ids[x], ids[y]))):
                    heapq.heappush(heap, (m[0], x, m[1], (ids[x], ids[y])))
        return [t for t in ids if t >= 0]

    def _pair(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The place of each pair in pair_key, or its length where the pair doesn't merge."""
        key = a * self.size + b
        i = np.minimum(np.searchsorted(self.pair_key, key), len(self.pair_key) - 1)
        return np.where(self.pair_key[i] == key, i, len(self.pair_key))

    def merge_all(self, spelt: list[str]) -> list[list[int]]:
        """Exact merging of many words at once: in each round every word merges one pair, its first by rank and place."""
        out: list[list[int]] = [[] for _ in spelt]
        chars = np.array(list("".join(spelt)))
        size = np.array([len(s) for s in spelt])
        symbols, at = np.unique(chars, return_inverse=True)
        plain, final = (np.array([self.vocab[c + e] for c in symbols.tolist()], dtype=np.int64) for e in ("", self.end))
        ids = plain[at]
        last = np.cumsum(size) - 1
        ids[last] = final[at[last]]
        word = np.repeat(np.arange(len(spelt)), size)
        none = len(self.pair_key)
        rank = np.append(self.pair_rank, NEVER)
        pair = np.full(len(ids), none)
        inside = np.flatnonzero(word[1:] == word[:-1])
        pair[inside] = self._pair(ids[inside], ids[inside + 1])
        while len(ids):
            start = np.flatnonzero(np.concatenate(([True], word[1:] != word[:-1])))
            size = np.diff(np.append(start, len(ids)))
            r = rank[pair]
            best = np.minimum.reduceat(r, start)
            done = best == NEVER
            if done.any():
                mine = np.repeat(done, size)
                flat = ids[mine].tolist()
                ends = np.cumsum(size[done]).tolist()
                for w, a, b in zip(word[start[done]].tolist(), [0, *ends[:-1]], ends, strict=True):
                    out[w] = flat[a:b]
                ids, word, pair = ids[~mine], word[~mine], pair[~mine]
                continue
            hit = np.flatnonzero(r == np.repeat(best, size))
            hit = hit[np.concatenate(([True], word[hit[1:]] != word[hit[:-1]]))]
            ids[hit] = self.pair_token[pair[hit]]
            keep = np.ones(len(ids), dtype=bool)
            keep[hit + 1] = False
            ids, word, pair = ids[keep], word[keep], pair[keep]
            hit = hit - np.arange(len(hit))
            pair[hit] = none
            for left in (hit, hit - 1):
                left = left[(left >= 0) & (left + 1 < len(ids))]
                left = left[word[left] == word[left + 1]]
                pair[left] = self._pair(ids[left], ids[left + 1])
        return out

    def encode_words(self, words: list[str]) -> list[list[int]]:
        """The tokens of each word."""
        spelt = [self.spell(w) for w in words]
        proposed = [self.propose(s) for s in spelt]
        flat = np.fromiter(itertools.chain.from_iterable(proposed), dtype=np.int64)
        owner = np.repeat(np.arange(len(words)), [len(p) for p in proposed])
        inside = np.flatnonzero(owner[1:] == owner[:-1])
        pairs, which = np.unique(flat[inside] * self.size + flat[inside + 1], return_inverse=True)
        bad = (self.crossing(pairs // self.size, pairs % self.size) < NEVER)[which]
        failed = set(owner[inside[bad]].tolist())
        self.n_words += len(words)
        self.n_exact += len(failed)
        long = [i for i in failed if len(spelt[i]) > 64]  # a round a token would be too many rounds
        short = [i for i in failed if len(spelt[i]) <= 64]
        for i, ids in itertools.chain(((i, self.merge(spelt[i])) for i in long), zip(short, self.merge_all([spelt[i] for i in short]) if short else [], strict=True)):
            proposed[i] = ids
        return proposed

    def split(self, text: str) -> list[str]:
        """The words of a text without added tokens."""
        if not text.isascii():
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")  # lower() would look at its neighbours
        return self.words(text.lower())

    def _units(self, text: str) -> list:
        """The words of a text, and its added tokens as tuples."""
        if self.added_split and any(a in text for a in self.added):
            return [x for part in self.added_split.split(text) if part for x in ([(part,)] if part in self.added else self.split(part))]
        return self.split(text)

    def _learn(self, units: list) -> None:
        """Put the tokens of new words and added tokens behind those known."""
        words = [u for u in units if isinstance(u, str)]
        added = [u for u in units if not isinstance(u, str)]
        ids = self.encode_words(words) + [[self.added[u[0]]] for u in added] if words else [[self.added[u[0]]] for u in added]
        n = len(self.index)
        self.index.update(zip(words + added, range(n, n + len(ids)), strict=True))
        self.sizes = np.concatenate([self.sizes, np.fromiter(map(len, ids), dtype=np.int64, count=len(ids))])
        self.values = np.concatenate([self.values, np.fromiter(itertools.chain.from_iterable(ids), dtype=np.int32)])
        self.starts = np.cumsum(self.sizes) - self.sizes

    def encode_arrays(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The tokens of all texts in one array, and where each text's begin and the last one's end."""
        if len(self.index) > CACHE_WORDS:
            self._forget()
        units = [self._units(t) for t in texts]
        every = list(itertools.chain.from_iterable(units))
        if new := set(every) - self.index.keys():
            self._learn(list(new))
        at = np.fromiter(map(self.index.__getitem__, every), dtype=np.int64, count=len(every))
        n = self.sizes[at]
        ends = np.concatenate(([0], np.cumsum(n)))
        values = self.values[np.repeat(self.starts[at] - ends[:-1], n) + np.arange(ends[-1])]
        return ends[np.concatenate(([0], np.cumsum([len(u) for u in units])))].astype(np.int32), values

    def _forget(self) -> None:
        self.index: dict = {}
        self.sizes, self.starts, self.values = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int32)

    def encode_batch(self, texts: list[str]) -> list[list[int]]:
        offsets, values = self.encode_arrays(texts)
        return [values[a:b].tolist() for a, b in itertools.pairwise(offsets)]

    def decode(self, ids: list[int]) -> str:
        """The tokens with one space between them, as the library does without a decoder."""
        return " ".join(map(self.tokens.__getitem__, ids))


def spellings(spec: str) -> list[str]:
    """Every token's string by its number, which is all that decoding needs."""
    d = json.loads(spec)
    every = d["model"]["vocab"] | {t["content"]: t["id"] for t in d["added_tokens"]}
    out = [""] * (1 + max(every.values()))
    for t, i in every.items():
        out[i] = t
    return out


def join_tokens(ids: pa.ListArray, tokens: pa.Array) -> pa.Array:
    """The texts of lists of tokens: the tokens with one space between them."""
    ids = pa.compute.fill_null(ids, []) if ids.null_count else ids
    return pa.compute.binary_join(pa.ListArray.from_arrays(ids.offsets, tokens.take(ids.values)), " ")


_made: dict[int, Tokenizer] = {}


def _tokenizer(spec: str) -> Tokenizer:
    """One tokenizer a Python worker."""
    key = hash(spec)
    if key not in _made:
        _made[key] = Tokenizer(spec)
    return _made[key]


def _spec(spark, path: str | None):
    with open(path or default_path(), encoding="utf-8") as f:
        return spark.sparkContext.broadcast(f.read())


def encode(docs: DataFrame, path: str | None = None, text: str = "text", keep_text: bool = True) -> DataFrame:
    """docs with ids, the tokens of the text."""
    spark = docs.sparkSession
    C.small_batches(spark)
    docs = docs.drop("ids")
    spec = _spec(spark, path)
    kept = docs if keep_text else docs.drop(text)
    schema = C.with_fields(kept, "ids array<int>")
    arrow = C.arrow_schema(spark, schema.toDDL())

    def run(batches):
        t = _tokenizer(spec.value)
        for b in batches:
            cols = {n: b.column(i) for i, n in enumerate(b.schema.names)}
            offsets, values = t.encode_arrays([x.decode("utf-8", "replace") if x else "" for x in cols["gl_raw"].to_pylist()])
            cols["ids"] = pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))
            yield C.record_batch(cols, arrow)
        t._forget()  # the worker lives on

    return docs.select(*kept.columns, C.as_bytes(text).alias("gl_raw")).mapInArrow(run, schema)


def decode(encoded: DataFrame, path: str | None = None, ids: str = "ids") -> DataFrame:
    """encoded with decoded, the text that its tokens give back; null ids give an empty text."""
    spark = encoded.sparkSession
    C.small_batches(spark)
    encoded = encoded.drop("decoded")
    with open(path or default_path(), encoding="utf-8") as f:
        shared = spark.sparkContext.broadcast(spellings(f.read()))
    schema = C.with_fields(encoded, "decoded string")
    arrow = C.arrow_schema(spark, schema.toDDL())

    def run(batches):
        tokens = pa.array(shared.value)
        for b in batches:
            cols = {n: b.column(i) for i, n in enumerate(b.schema.names)}
            cols["decoded"] = join_tokens(cols[ids], tokens)
            yield C.record_batch(cols, arrow)

    return encoded.mapInArrow(run, schema)


def digest(docs: DataFrame, path: str | None = None) -> DataFrame:
    """n_tokens and the digests of the ids and of the decoded text."""
    out = decode(encode(docs.select("doc_id", "text"), path, keep_text=False), path)
    return out.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
