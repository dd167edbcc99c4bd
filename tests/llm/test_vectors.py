"""Neighbours, clusters and subsets on made vectors."""

import numpy as np
import pytest

from cinegrid.llm import clusters, neighbours, subset

W = 512
SCHEMA = "vec_id long, embedding array<float>, id int, v string, weight int, mark int"


def unit(x):
    return x / np.linalg.norm(x, axis=-1, keepdims=True)


def table(spark, rows, start=0):
    cells = [(i + start, None if v is None else [None if x is None else float(x) for x in v], 1, "v", 2, 3) for i, v in enumerate(rows)]
    return spark.createDataFrame(cells, SCHEMA)


@pytest.fixture(scope="module")
def made(rng):
    """Three clusters, groups of near copies, noise, and vectors that are not usable."""
    centres = unit(rng.normal(size=(3, W)))
    rows, label = [], []
    for c, n in enumerate((200, 80, 40)):
        rows += list(unit(centres[c] + 0.6 * unit(rng.normal(size=(n, W)))))
        label += [c] * n
    for k in range(20):
        base = unit(rng.normal(size=W))
        rows += list(unit(base + rng.uniform(0.05, 0.4) * unit(rng.normal(size=(5, W)))) * rng.uniform(0.1, 9))
        label += [10 + k] * 5
    rows += list(unit(rng.normal(size=(30, W))))
    label += [-1] * 30
    rows += [None, [], np.zeros(W), np.full(W, np.nan), np.r_[np.inf, np.zeros(W - 1)], rows[0][:511], [None] * W, np.full(W, 1e-30), np.full(W, 3e38)]
    label += [None] * 7 + [-2, -2]
    return rows, label


def exact(rows, k, least):
    ok = [i for i, v in enumerate(rows) if v is not None and len(v) == W and all(x is not None for x in v) and np.isfinite(np.float32(v)).all() and np.any(np.float32(v))]
    x = np.array([np.float32(rows[i]) for i in ok], np.float64)
    x = unit(x / np.abs(x).max(axis=1, keepdims=True))
    s = x @ x.T
    out = set()
    for a in range(len(ok)):
        order = sorted((b for b in range(len(ok)) if b != a and s[a, b] >= least), key=lambda b: (-s[a, b], ok[b]))
        out |= {(min(ok[a], ok[b]), max(ok[a], ok[b])) for b in order[:k]}
    return out


def test_neighbours(spark, made):
    rows, _ = made
    want = exact(rows, 3, 0.8)
    got = {tuple(r) for r in neighbours.similar_pairs(table(spark, rows), "vec_id", "embedding", k=3, min_cosine=0.8).collect()}
    assert len(want & got) >= 0.95 * len(want) and len(got - want) <= 0.05 * len(want)


def test_a_third_are_equal_and_a_third_nearly(spark, rng):
    one = np.float32(np.float16(unit(rng.normal(size=W))))
    rows = [one] * 200 + list(unit(one + 0.1 * unit(rng.normal(size=(200, W))))) + list(unit(rng.normal(size=(200, W))))
    found = neighbours.similar(table(spark, rows), "vec_id", "embedding", k=4, min_cosine=0.8, bucket=32).collect()
    by = {}
    for r in found:
        by.setdefault(r.id, []).append((r.rank, r.other, r.cosine))
    for i in range(200):  # of equal ones the smallest others
        assert [o for _, o, _ in sorted(by[i])] == [o for o in range(5) if o != i][:4]
    assert sum(len(by.get(i, [])) == 4 for i in range(200, 400)) >= 195
    assert not any(i in by for i in range(400, 600))


def test_queries_against_all_rows(spark, made):
    rows, _ = made
    df = table(spark, rows)
    asked = df.where("vec_id % 10 = 0").select("vec_id")
    ok, _ = links(rows, 0)
    x = unit(np.array([np.float32(rows[i]) / np.abs(rows[i]).max() for i in ok], np.float64))
    s = x @ x.T
    want = {}
    for p, i in enumerate(ok):
        if i % 10 == 0:
            want[i] = [ok[q] for q in sorted((q for q in range(len(ok)) if q != p), key=lambda q: (-s[p, q], ok[q]))[:5]]
    found = {}
    for r in neighbours.similar(df, "vec_id", "embedding", k=5, queries=asked).orderBy("id", "rank").collect():
        found.setdefault(r.id, []).append(r.other)
    assert found == want
    # with a least cosine only tables find what isn't crowded
    near = [r for r in neighbours.similar(df, "vec_id", "embedding", k=5, min_cosine=0.8, queries=asked).collect()]
    true = {(i, o) for i, others in want.items() for o in others if s[ok.index(i), ok.index(o)] >= 0.8}
    got = {(r.id, r.other) for r in near}
    assert got <= true and len(got) >= 0.9 * len(true)


def test_vectors_keep_their_values(rng):
    from cinegrid.functions.vectors import packed, unpacked

    import pyarrow as pa

    rows = np.float32(np.r_[np.float16(rng.normal(size=(3, 8))), rng.normal(size=(3, 8)), [[1e30] * 8], [[1e-30] * 8]])
    cells = packed(rows)
    assert [len(c) for c in cells] == [16] * 3 + [32] * 5 and (unpacked(pa.array(cells), 8) == rows).all()


def links(rows, least):
    ok = [i for i, v in enumerate(rows) if v is not None and len(v) == W and all(x is not None for x in v) and np.isfinite(np.float32(v)).all() and np.any(np.float32(v))]
    x = np.array([np.float32(rows[i]) for i in ok], np.float64)
    x = unit(x / np.abs(x).max(axis=1, keepdims=True))
    return ok, x @ x.T >= least


def test_chains_to_anchors(spark, made, rng):
    rows, label = made
    # a chain of thin links, and few landmarks, so that the second pass is needed
    a, b = unit(rng.normal(size=(2, W)))
    b = unit(b - a * (a @ b))
    chain = [np.cos(t) * a + np.sin(t) * b for t in np.arange(0, 6.0, 0.9)]
    rows = rows + chain
    anchors = [("first", rows[0]), ("second", rows[200]), ("chain", chain[0]), ("bad", np.zeros(W))]
    t = clusters.graph(table(spark, rows), "vec_id", "embedding", anchors, reach=0.42, landmarks=16, block=64)
    got = {r.id: r.label for r in clusters.joined_to_anchors(t).collect()}
    ok, near = links(rows, 0.42)
    want = {}
    for name, v in anchors[:3]:
        todo = [k for k, i in enumerate(ok) if rows[i] is v or (np.float32(rows[i]) == np.float32(v)).all()]
        while todo:
            k = todo.pop()
            if ok[k] not in want:
                want[ok[k]] = name
                todo += list(np.flatnonzero(near[k]))
    assert got == want


def weights(rng, n, decimals):
    w = np.round(rng.uniform(size=(n, n)), decimals)
    w = np.maximum(w, w.T)
    np.fill_diagonal(w, -np.inf)
    return w


def greatest_tree(w):
    done, total = {0}, 0.0
    while len(done) < len(w):
        x, y = max(((i, j) for i in done for j in range(len(w)) if j not in done), key=lambda p: w[p])
        total += w[x, y]
        done.add(y)
    return total


def test_spanning_trees_of_greatest_weight(rng):
    w = weights(rng, 40, 1)  # many ties
    a, b = clusters.spanning(w.astype(np.float32))
    assert len(a) == 39 and abs(w[a, b].sum() - greatest_tree(w)) < 1e-6
    i, j = np.triu_indices(40, 1)
    root, _, used = clusters.rounds(40, i, j, w[i, j])
    assert len(used) == 39 and len(set(root)) == 1 and abs(w[i[used], j[used]].sum() - greatest_tree(w)) < 1e-6
    assert clusters.spanning(np.zeros((1, 1)))[0].size == 0


def plain_hierarchy(rows, core, min_size):
    """(clusters as sets, noise excluded) of density clustering, written down as its definition says, over all pairs."""
    x = unit(np.array(rows, np.float64))
    s = x @ x.T
    np.fill_diagonal(s, -np.inf)
    of = np.sort(s, axis=1)[:, -core]
    w = np.floor(np.minimum(np.minimum(s, of[:, None]), of[None, :]) * clusters.GRID) / clusters.GRID
    density = lambda v: 1 / max(1 - v, 1e-3)

    def parts(inside, above):
        left, out = set(inside), []
        while left:
            todo, part = [left.pop()], []
            while todo:
                i = todo.pop()
                part.append(i)
                near = [j for j in left if w[i, j] > above]
                left -= set(near)
                todo += near
            out.append(part)
        return out

    def walk(inside, birth, top):
        """(stability, chosen sets) of a cluster and what is below it."""
        gone, level_of, now = 0.0, {}, list(inside)
        while True:
            level = max_min(now)
            found = parts(now, level)
            big = [p for p in found if len(p) >= min_size]
            if len(big) == 1:
                for p in found:
                    if p is not big[0]:
                        level_of.update(dict.fromkeys(p, level))
                now = big[0]
                continue
            level_of.update(dict.fromkeys(now, level))
            break
        gone = sum(density(min(v, 1)) - density(max(birth, -1)) for v in level_of.values())
        if not big:
            return gone, [set(inside)]
        below = [walk(p, level, False) for p in big]
        if top or sum(b[0] for b in below) > gone:
            return sum(b[0] for b in below), [c for b in below for c in b[1]]
        return gone, [set(inside)]

    def max_min(now):
        """The greatest weight at which all of ``now`` hang together (links of at least it)."""
        done, low, best = {now[0]}, np.inf, w[now[0]].copy()
        left = set(now[1:])
        while left:
            j = max(left, key=lambda q: best[q])
            low = min(low, best[j])
            left.remove(j)
            best = np.maximum(best, w[j])
        return low

    return [c for p in parts(range(len(rows)), -2) for c in walk(p, -2.0, True)[1]]


@pytest.fixture(scope="module")
def lumps(rng):
    """Two clusters, one of them of two lumps, and noise."""
    a, b, c = unit(rng.normal(size=(3, W)))
    near = unit(b + 0.8 * c)
    rows = [unit(m + s * unit(rng.normal(size=W))) for m, s, n in ((a, 0.7, 70), (b, 0.5, 50), (near, 0.5, 40)) for _ in range(n)]
    return rows + list(unit(rng.normal(size=(30, W))))


@pytest.mark.parametrize("core, min_size", [(1, 6), (3, 15)])
def test_clusters_equal_the_definition(spark, lumps, core, min_size):
    want = sorted(map(sorted, plain_hierarchy(np.float32(lumps), core, min_size)))
    df = table(spark, lumps)
    for local in (clusters.LOCAL, 1):  # in one task, and by rounds over tables
        found = clusters.clustered(clusters.graph(df, "vec_id", "embedding", core=core, local=local), min_size).collect()
        by = {}
        for r in found:
            by.setdefault(r.cluster, []).append(r.id)
        assert sorted(map(sorted, by.values())) == want and all(k == min(v) for k, v in by.items())


def test_clusters(spark, made):
    rows, label = made
    # blocks of a few rows, so that the graph is put together from many
    t = clusters.graph(table(spark, rows), "vec_id", "embedding", core=2, block=64)
    found = clusters.clustered(t, min_size=15).collect()
    for c, n in enumerate((200, 80, 40)):
        inside = [r.cluster for r in found if label[r.id] == c]
        assert len(inside) >= 0.9 * n and len(set(inside)) == 1
    sizes = {r["cluster"]: r for r in clusters.described(clusters.clustered(t, 15)).collect()}
    assert sorted((r["size"] for r in sizes.values()), reverse=True)[0] >= 180
    assert all(len(r["exemplars"]) == 5 and len(set(r["exemplars"])) == 5 for r in sizes.values())


def test_a_third_are_equal_clusters(spark, rng):
    """Equal vectors, more than a block holds, are one cluster; those of another length too."""
    one, two = unit(rng.normal(size=(2, W)))
    rows = [one * (1 + i % 3) for i in range(150)] + [unit(two + 0.3 * unit(rng.normal(size=W))) for _ in range(100)] + list(unit(rng.normal(size=(200, W))))
    found = clusters.clustered(clusters.graph(table(spark, rows), "vec_id", "embedding", core=2, block=32), 20).collect()
    by = {r.id: r.cluster for r in found}
    assert {by.get(i) for i in range(150)} == {0} and {by.get(i) for i in range(150, 250)} == {150}


def test_blocks_cover_all_rows(rng):
    path = np.sort(np.r_[rng.integers(0, 1 << 49, 500), np.full(300, 1 << 40)]).astype(np.uint64)
    cut = list(clusters.blocks(path, 6, 64))
    assert all(0 < b - a <= 64 for a, b in cut) and cut[0][0] == 0 and cut[-1][1] == 800
    assert all(y[0] in (x[1], x[1] - 1) for x, y in zip(cut, cut[1:]))
    assert all(np.ptp(path[a:b] >> np.uint64(48)) == 0 for a, b in cut)
    assert list(clusters.blocks(path[:0], 6, 64)) == []


def test_subset_covers_and_does_not_repeat(spark, made):
    rows, label = made
    df = table(spark, rows)
    picked = [r.id for r in subset.varied(df, "vec_id", "embedding", size=25, block=64, final=64).orderBy("rank").collect()]
    assert len(picked) == len(set(picked)) == 25
    got = [label[i] for i in picked]
    assert {0, 1, 2} <= set(got) and all(got.count(c) == 1 for c in set(got) if c >= 10) and None not in got
    some = df.where("vec_id between 200 and 300").select("vec_id")
    assert all(200 <= r.id <= 300 for r in subset.varied(df, "vec_id", "embedding", among=some, size=10).collect())


def test_lazy_greedy_equals_greedy(rng):
    x = unit(rng.normal(size=(60, 8))).astype(np.float32)
    w = rng.integers(1, 5, 60).astype(np.float64)
    chosen, gains, _ = subset.lazy_greedy(x, w, 12, np.arange(60))
    s, covered, mine = np.maximum(x @ x.T, 0), np.zeros(60, np.float32), []
    for _ in range(12):
        gain = [-1 if i in mine else float(np.maximum(s[i] - covered, 0) @ w) for i in range(60)]
        mine.append(int(np.argmax(gain)))
        covered = np.maximum(covered, s[mine[-1]])
    assert chosen == mine


def test_empty_tables(spark):
    df = table(spark, [])
    assert neighbours.similar(df, "vec_id", "embedding").count() == 0
    assert subset.varied(df, "vec_id", "embedding").count() == 0
    t = clusters.graph(df, "vec_id", "embedding")
    assert clusters.joined_to_anchors(t).count() == 0 and clusters.clustered(t, 5).count() == 0 and clusters.described(clusters.clustered(t, 5)).count() == 0
    only = clusters.graph(df, "vec_id", "embedding", [("a", np.ones(W))])
    assert clusters.joined_to_anchors(only).count() == 0
    bad = table(spark, [None, np.zeros(W)])
    assert neighbours.similar(bad, "vec_id", "embedding").count() == 0 and subset.varied(bad, "vec_id", "embedding").count() == 0


def test_nearest_of_near_copies_that_no_hash_cuts(spark, rng):
    """A third of the rows are near copies of one vector, or it in other lengths: their nearest are the true ones."""
    one = unit(rng.normal(size=W))
    near = [(one + 0.02 * unit(rng.normal(size=W))) * rng.uniform(0.5, 2) for _ in range(700)]
    rows = list(unit(rng.normal(size=(1400, W)))) + near
    rows = [np.float32(v) for v in rows]
    want = exact(rows, 4, 0.8)
    got = {tuple(r) for r in neighbours.similar_pairs(table(spark, rows), "vec_id", "embedding", k=4, min_cosine=0.8).collect()}
    assert len(want & got) >= 0.999 * len(want) and len(got - want) <= 0.001 * len(want)


def test_pairs_just_above_the_least_cosine(spark, rng):
    """500 pairs with cosines from 0.8 to 0.82: the filter by codes may not drop them."""
    rows = []
    for c in rng.uniform(0.8005, 0.82, 500):
        a, b = unit(rng.normal(size=(2, W)))
        rows += [a, c * a + np.sqrt(1 - c * c) * unit(b - a * (a @ b))]
    got = {tuple(r) for r in neighbours.similar_pairs(table(spark, rows), "vec_id", "embedding", min_cosine=0.8).collect()}
    want = {(i, i + 1) for i in range(0, 1000, 2)}
    assert not got - want and len(got) >= 0.97 * len(want), len(got)


@pytest.mark.parametrize("block, local", [(2048, clusters.LOCAL), (32, clusters.LOCAL), (32, 1)])
def test_chains_between_vectors_that_are_no_landmarks(spark, rng, block, local):
    """Chains of thin links, with two landmarks and small blocks."""
    axes = np.linalg.qr(rng.normal(size=(W, 200)))[0].T
    chain = [unit(axes[i] + axes[i + 1]) for i in range(12)]
    rows = chain + list(axes[20:])
    t = clusters.graph(table(spark, rows), "vec_id", "embedding", [("one", chain[0])], landmarks=2, block=block, local=local)
    assert {(r.id, r.label) for r in clusters.joined_to_anchors(t).collect()} == {(i, "one") for i in range(12)}


def test_many_chains(spark, rng):
    """400 chains of four, 0.9 apart, each with an anchor at one end; and 4,500 vectors that nothing reaches."""
    a, b = unit(rng.normal(size=(2, 400, W)))
    b = unit(b - a * np.einsum("ij,ij->i", a, b)[:, None])
    rows = [np.cos(t) * a[i] + np.sin(t) * b[i] for i in range(400) for t in (0, 0.9, 1.8, 2.7)]
    rows += list(unit(rng.normal(size=(4500, W))))
    g = clusters.graph(table(spark, rows), "vec_id", "embedding", [(str(i), a[i]) for i in range(400)])
    got = {r.id: r.label for r in clusters.joined_to_anchors(g).collect()}
    assert got == {i: str(i // 4) for i in range(1600)}
