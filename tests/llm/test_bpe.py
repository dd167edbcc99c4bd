import os

import pytest
from tokenizers import Tokenizer

from cinegrid.llm import bpe

TEXTS = [None, "", " ", "\n\n  \t", "Hello world, don't we'LL 12345 ½ ²", "  lead and trail  ", "a" * 20_000, "ab" * 5000, "aaaa bbbb", "<|endoftext|> x", "　wide spaces   .", "\x1c\x1d\x1e\x1f\x85\xa0", "é é ß İ ﬃ Ǆ", "日本語テキスト、漢字。", "😀🏽‍♀️👩‍👩‍👧", "�� \u0000 \x07", "x" + "́" * 300,
         "مرحبا بالعالم", "for i in range(10):\n    print(i)\r\n\r\n", "https://a.b/c?d=e&f=%20", "1,234,567.89e-10", "word " * 3000, "​‌﻿", "’s 's 'S 'll"]


@pytest.fixture(scope="module")
def theirs():
    t = Tokenizer.from_file(os.path.join(bpe.TOKENIZERS, bpe.VOCABULARY))
    t.encode_special_tokens = True
    return lambda texts: [e.ids for e in t.encode_batch([x or "" for x in texts], add_special_tokens=False)]


def test_equals_the_public_tokenizer(spark, theirs):
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(99, "same"), (99, "same"), (None, "no key")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'c' as ids", "1 as key")
    got = bpe.encoded(df, "doc_id", "text").collect()
    want = [(i, ids) for (i, _), ids in zip(rows, theirs([t for _, t in rows]))]
    key = lambda r: (r[0] is None, r[0] or 0, list(r[1]))
    assert sorted(((r[0], list(r[1])) for r in got), key=key) == sorted(want, key=key)
    n = {r[0]: r[1] for r in bpe.counted(df, "doc_id", "text").collect()}
    assert all(n[i] == len(ids) for i, ids in want)


def test_merging_together_gives_the_same(theirs, monkeypatch):
    """All places of a rank at once, or one by one; rows of equal symbols too."""
    texts = [t for t in TEXTS if t] + ["a" * n for n in range(1, 40)] + ["abab" * 9 + "aab", "--" * 37, "the then them there theirs"]
    want = theirs(texts)
    for together, many in ((0, 0), (300, 0), (1 << 20, 0), (1 << 20, 1 << 40)):
        monkeypatch.setattr(bpe, "TOGETHER", together)
        monkeypatch.setattr(bpe, "MANY", many)
        v = bpe.Vocabulary(os.path.join(bpe.TOKENIZERS, bpe.VOCABULARY))
        ids, starts = v.encode(texts)
        assert [ids[a:b].tolist() for a, b in zip(starts, starts[1:])] == want


def test_corpus(spark, data, theirs):
    docs = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text")
    got = {r[0]: list(r[1]) for r in bpe.encoded(docs, "doc_id", "text").collect()}
    rows = docs.collect()
    assert got == {r[0]: ids for r, ids in zip(rows, theirs([r[1] for r in rows]))}


def test_forgotten_pieces_are_encoded_again(theirs, monkeypatch):
    monkeypatch.setattr(bpe, "MEMORY", 3)
    v = bpe.Vocabulary(os.path.join(bpe.TOKENIZERS, bpe.VOCABULARY))
    for _ in range(2):
        ids, starts = v.encode(TEXTS)
        assert [ids[a:b].tolist() for a, b in zip(starts, starts[1:])] == theirs(TEXTS)


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert bpe.encoded(df, "doc_id", "text").count() == 0 and bpe.counted(df, "doc_id", "text").count() == 0
