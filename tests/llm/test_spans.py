import random

from cinegrid.llm import spans


def brute(docs, n):
    """(pairs, intervals by document) from all stretches of n code points."""
    where = {}
    for i, t in docs:
        for p in range(len(t or "") - n + 1):
            where.setdefault(t[p : p + n], []).append((i, p))
    pairs, covered = set(), {}
    for places in where.values():
        ids = {i for i, _ in places}
        if len(ids) > 1:
            pairs |= {(a, b) for a in ids for b in ids if a < b}
            for i, p in places:
                covered.setdefault(i, set()).update(range(p, p + n))
    return pairs, {i: len(c) for i, c in covered.items()}


def corpus(words):
    r = random.Random(11)
    own = lambda n: " ".join(r.choice(words) for _ in range(n))
    docs = [own(60) for _ in range(30)]
    shared = [own(30) for _ in range(6)]
    for i in range(40):
        s = r.choice(shared)
        a = r.randrange(len(s) - 60)
        docs.append(own(r.randrange(10)) + s[a : a + r.randrange(30, 90)] + own(r.randrange(10)))
    docs += [docs[3], docs[3], "x" * 500, "x" * 41, "x" * 39, "ab" * 100, "y" + "ab" * 60, "😀é" * 60, "z" + "😀é" * 50, None, "", " ", "\u0000" * 45 + "q", "\u0000" * 45]
    return list(enumerate(docs))


def compare(spark, docs, n=40):
    df = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 as pos", "'h' as hash", "2 as doc")
    found = spans.Spans(df, "doc_id", "text", n)
    pairs, covered = brute(docs, n)
    assert {tuple(r) for r in found.pairs().collect()} == pairs
    report = {r.doc: r for r in found.report().collect()}
    assert len(report) == len(docs)
    for i, t in docs:
        assert report[i].shared_chars == covered.get(i, 0) and report[i].n_chars == len(t or "")


def test_against_all_stretches(spark, words):
    compare(spark, corpus(words))


def test_hot_stretch(spark, words, monkeypatch):
    """A stretch in most documents is re-keyed; classes beyond the block come out as stars, which join the same documents."""
    monkeypatch.setattr(spans, "BLOCK_ROWS", 8)
    docs = corpus(words)
    df = spark.createDataFrame(docs, "doc_id long, text string")
    found = spans.Spans(df, "doc_id", "text", 40)
    pairs, covered = brute(docs, 40)
    assert {tuple(r) for r in found.pairs().collect()} == pairs
    got = {tuple(r) for r in found.pairs(expand=1).collect()}
    assert got <= pairs and {i for p in got for i in p} == {i for p in pairs for i in p}
    assert {r.doc: r.shared_chars for r in found.report().collect() if r.spans} == covered
    monkeypatch.setattr(spans, "BLOCK_ROWS", 60)
    compare(spark, docs)


def test_shuffled_joins_give_the_same(spark, words, monkeypatch):
    monkeypatch.setattr(spans, "BROADCAST_ROWS", 0)
    monkeypatch.setattr(spans, "CHUNK_BYTES", 500)
    compare(spark, corpus(words))


def test_empty(spark):
    found = spans.Spans(spark.createDataFrame([], "doc_id long, text string"), "doc_id", "text")
    assert found.pairs().count() == 0 and found.report().count() == 0


def test_all_pairs_of_a_stretch_in_many_documents(spark, words):
    """One stretch in 720 different documents, and one document 720 times: every pair comes out."""
    r = random.Random(5)
    own = lambda n: " ".join(r.choice(words) for _ in range(n))
    shared = own(12)
    docs = list(enumerate([own(5) + shared + own(5) for _ in range(720)] + [own(20)] * 720))
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = spans.Spans(df, "doc_id", "text", 40).pairs()
    assert got.count() == got.distinct().count() == 720 * 719
    assert got.where("a < 720 and b >= 720").count() == 0
