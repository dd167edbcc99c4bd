import re
from collections import Counter

from hypothesis import given, settings
from hypothesis import strategies as st

from cinegrid.llm import terms


@given(st.lists(st.text("abé\U0001F600x", max_size=6), max_size=200), st.integers(1, 5))
@settings(max_examples=60, deadline=None)
def test_trie_counts_like_a_dictionary(found, limit):
    trie = terms.BurstTrie(limit)
    for t in found:
        trie.add(t, 1, 2)
    want = Counter(found)
    assert {t: (o, r) for t, o, r in trie.items()} == {t: (n, 2 * n) for t, n in want.items()} and trie.size == len(want)


def brute(texts):
    held = [re.findall(r"[^\W_]+", (t or "").lower()) for t in texts]
    occurrences, rows = Counter(w for h in held for w in h), Counter(w for h in held for w in set(h))
    n = sum(1 for h in held if h)
    return {w: (occurrences[w], rows[w], "rare" if rows[w] <= 2 else "common" if rows[w] > 0.1 * n else None) for w in occurrences}


@given(st.lists(st.text("abé\U0001F600x", min_size=1, max_size=6), max_size=80), st.integers(1, 9))
@settings(max_examples=60, deadline=None)
def test_routes_cut_the_terms_evenly(found, n):
    cuts, distinct = terms.routes(found, n), sorted(set(found))
    assert cuts == sorted(set(cuts)) and len(cuts) < n
    import bisect

    sizes = Counter(bisect.bisect_right(cuts, t) for t in distinct)
    assert all(v <= -(-len(distinct) // n) for v in sizes.values())


def test_terms_that_begin_alike(spark, monkeypatch):
    """More terms than a route takes have the same first thirty characters."""
    monkeypatch.setattr(terms, "ROUTE", 100)
    texts = [" ".join("prefix" * 5 + f"{i * 40 + j:05d}" for j in range(40)) for i in range(100)] + ["zebra apple"] * 3
    got = {r.term: (r.occurrences, r.rows, r.mark) for r in terms.frequencies(spark.createDataFrame([(t,) for t in texts], "caption string").repartition(4), "caption").collect()}
    assert got == brute(texts)


def test_frequencies(spark, words, monkeypatch):
    texts = [" ".join(words[i % 700 : i % 700 + 12]) for i in range(2000)] + [None, "", " - ", "Émile écrit; ÉMILE lit", "x" * 50_000, "the " * 5000, "a_b a-b"] * 3 + ["the hot term"] * 900
    df = spark.createDataFrame([(t, 1, 2) for t in texts], "caption string, rows int, term int").repartition(5)
    got = {r.term: (r.occurrences, r.rows, r.mark) for r in terms.frequencies(df, "caption").collect()}
    assert got == brute(texts)


def test_empty(spark):
    assert terms.frequencies(spark.createDataFrame([], "caption string"), "caption").count() == 0
    assert terms.frequencies(spark.createDataFrame([(None,), ("",)], "caption string"), "caption").count() == 0
