import random

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from gridloom.llm import bpe


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    t.no_padding()
    t.no_truncation()
    return t


@pytest.fixture(scope="module")
def own():
    return bpe.Tokenizer(open(bpe.default_path(), encoding="utf-8").read())


def texts():
    r = random.Random(5)
    out = ["", " ", "Hello, World's best! I'LL they're 123 4½ x²", "<|startoftext|>Hi<|endoftext|>", "a<|endoftext|>B'S <|endoftext", "ΟΔΥΣΣΕΥΣ ΑΣ ΣΑΣ İstanbul ẞtraße ﬁn", "école É ä", "zero​width nbsp　wide\x1cfs\x85nel", "日本語のテキスト 한국어 ไทย हिन्दी", "🙂🙃👩‍👩‍👧 !!!'s", "aaaaaaaaaaaaaaaaaaa" * 30, "thethethethe" * 50, "\x00\x01 tab\tnew\nline", "x" * 5000]
    letters = "abcdefghijklmnopqrstuvwxyz"
    for _ in range(3000):
        out.append(" ".join("".join(r.choice(letters) for _ in range(r.randrange(1, 14))) for _ in range(6)))
    for _ in range(2000):
        out.append("".join(r.choice(["th", "er", "ing", "ion", "é", "ß", "1", "'", "ll", "re", "an", "S", " ", "est", "…", "ç"]) for _ in range(12)))
    for _ in range(1000):
        out.append("".join(chr(r.choice([r.randrange(32, 0x250), r.randrange(0x370, 0x500), r.randrange(0x3040, 0x30FF)])) for _ in range(10)))
    return out


def test_same_as_the_library(own, library):
    ts = texts()
    got = own.encode_batch(ts)
    want = [e.ids for e in library.encode_batch(ts, add_special_tokens=False)]
    bad = [(t, g, w) for t, g, w in zip(ts, got, want, strict=True) if g != w]
    assert not bad, bad[:3]
    assert [own.decode(i) for i in got] == [library.decode(i, skip_special_tokens=False) for i in want]
    assert 0 < own.n_exact < own.n_words


def test_exact_merging_agrees_with_verified_proposals(own, library):
    words = [w for t in texts()[:400] for w in own.split(t)]
    assert own.encode_words(words) == [own.merge(own.spell(w)) for w in words] == own.merge_all([own.spell(w) for w in words])


def test_frames(spark, library):
    rows = [(1, "Some text"), (2, None), (3, ""), (1, "Some text"), (4, "word " * 50_000)]
    d = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'x' as ids", "'y' as decoded")
    got = sorted((r.doc_id, r.ids, r.decoded) for r in bpe.decode(bpe.encode(d)).collect())
    want = sorted((i, e := library.encode(t or "", add_special_tokens=False).ids, library.decode(e, skip_special_tokens=False)) for i, t in rows)
    assert got == want
    assert bpe.digest(d.limit(0)).count() == 0
    assert [r.n_tokens for r in bpe.digest(d).orderBy("doc_id").collect()] == [2, 2, 0, 0, 50_000]


def test_null_ids_and_a_full_cache(spark, own, monkeypatch):
    d = spark.createDataFrame([(1, [320, 49407]), (2, None), (3, [])], "doc_id long, ids array<int>")
    assert {r.doc_id: r.decoded for r in bpe.decode(d).collect()} == {1: "a</w> <|endoftext|>", 2: "", 3: ""}
    want = own.encode_batch(texts()[:50])
    monkeypatch.setattr(bpe, "CACHE_WORDS", 3)
    assert [own.encode_batch([t])[0] for t in texts()[:50]] == want
