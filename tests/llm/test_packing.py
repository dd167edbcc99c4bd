from collections import defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from cinegrid.llm import packing


@given(st.dictionaries(st.integers(1, 40), st.integers(1, 30), max_size=20))
@settings(max_examples=100, deadline=None)
def test_plan_is_best_fit_decreasing(sizes):
    """As many containers as best fit one by one makes."""
    gaps = []
    for size in sorted(sizes, reverse=True):
        for _ in range(sizes[size]):
            fit = min((g for g in gaps if g >= size), default=None)
            if fit is None:
                gaps.append(40 - size)
            else:
                gaps.remove(fit)
                gaps.append(fit - size)
    steps = packing.plan(dict(sizes), 40)
    assert max((s[3] + s[2] for s in steps), default=0) == len(gaps)
    ranks = defaultdict(list)
    for size, rank, n, _, _ in steps:
        ranks[size] += range(rank, rank + n)
    assert {k: sorted(v) for k, v in ranks.items()} == {k: list(range(n)) for k, n in sizes.items()}


def check(rows, lengths, capacity):
    fill, parts = defaultdict(list), defaultdict(list)
    for r in rows:
        if r.n:
            fill[r.container].append((r.offset, r.n))
        parts[r.id].append((r.part, r.start, r.n))
    for spans in fill.values():
        at = 0
        for offset, n in sorted(spans):
            assert offset == at
            at += n
        assert at <= capacity
    for i, n in lengths:
        own = sorted(parts[i])
        n = max(n or 0, 0)
        assert sum(p[2] for p in own) == n * sum(1 for j, _ in lengths if j == i) or len({j for j, _ in lengths}) < len(lengths)
        assert len(own) == 1 or n > capacity or len({j for j, _ in lengths}) < len(lengths)
    return fill


def test_rows(spark):
    lengths = [(i, n) for i, n in enumerate([None, 0, 1, 99, 100, 101, 350, 50, 50, 50, 7, -3, *[30] * 40])]
    df = spark.createDataFrame(lengths, "id long, n int").selectExpr("*", "1 as container", "2 as part", "3 as size")
    fill = check(packing.packed(df, "id", "n", 100).collect(), lengths, 100)
    total = sum(max(n or 0, 0) for _, n in lengths)
    assert len(fill) <= -(-total // 100) * 1.15 + 1


def test_hot_length_is_spread(spark, monkeypatch):
    monkeypatch.setattr(packing, "BUCKET_ROWS", 50)
    lengths = [(i, 17 if i % 3 else i % 90) for i in range(1000)]
    check(packing.packed(spark.createDataFrame(lengths, "id long, n int"), "id", "n", 100).collect(), lengths, 100)


def test_repeated_and_null_keys(spark):
    df = spark.createDataFrame([(1, 5), (1, 5), (None, 5), (None, None)], "id long, n int")
    rows = packing.packed(df, "id", "n", 10).collect()
    assert len(rows) == 4 and sum(r.n for r in rows) == 15
    assert len({(r.container, r.offset) for r in rows if r.n}) == 3


def test_edges(spark):
    df = spark.createDataFrame([], "id long, n int")
    assert packing.packed(df, "id", "n").count() == 0
    zero = spark.createDataFrame([(1, 0), (2, None)], "id long, n int")
    assert {(r.id, r.container, r.n) for r in packing.packed(zero, "id", "n").collect()} == {(1, 0, 0), (2, 0, 0)}
    with pytest.raises(ValueError):
        packing.packed(df, "id", "n", 0)
