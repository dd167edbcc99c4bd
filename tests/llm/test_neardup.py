import random
import re
import time
from pathlib import Path

import numpy as np

from cinegrid.llm import neardup


def brute(rows, least=0.7):
    sets = {i: frozenset(re.findall(r"[^\W_]+", (t or "").lower())) for i, t in rows}
    ids = sorted(i for i, w in sets.items() if len(w) >= 8)
    return {(a, b) for k, a in enumerate(ids) for b in ids[k + 1:] if len(sets[a] & sets[b]) >= least * len(sets[a] | sets[b])}


def rows(words):
    r = random.Random(2)
    out = []
    for _ in range(40):
        base = [r.choice(words) for _ in range(r.randrange(8, 40))]
        out.append(" ".join(base))
        for _ in range(r.randrange(4)):
            edit = [r.choice(words) if r.random() < 0.08 else w for w in base]
            r.shuffle(edit)
            out.append(", ".join(edit).title())
    out += [out[0], out[0].upper(), None, "", "  ", "one two three", "a b c d e f g h", "h g f e d c b a", "w " * 20_000 + "a b c d e f g h", "_".join(words[:12]), " ".join(words[:12])]
    return list(enumerate(out))


def test_against_all_pairs(spark, words):
    data = rows(words)
    df = spark.createDataFrame(data, "entry_id long, caption string").selectExpr("*", "1 as id", "2 as w", "3 as key")
    near = neardup.NearDuplicates(df, "entry_id", "caption")
    want = brute(data)
    got = {tuple(r) for r in near.pairs().collect()}
    assert got <= want and len(got) >= 0.99 * len(want)
    groups = {r.id: r.group for r in near.groups().collect()}
    assert set(groups) == {i for p in got for i in p}
    assert all(groups[a] == groups[b] for a, b in got)
    assert all(groups[g] == g and g <= i for i, g in groups.items())


def test_hot_bucket_takes_the_exact_way(spark, words, monkeypatch):
    """A third of the rows are variants of one text."""
    monkeypatch.setattr(neardup, "BUCKET", 4)
    for chunk in (8192, 16):  # hot in a chunk, and only over all of them
        monkeypatch.setattr(neardup, "CHUNK", chunk)
        hot_bucket(spark, words)


def hot_bucket(spark, words):
    base = words[:30]
    data = rows(words) + [(1000 + i, " ".join([*base, words[100 + i]])) for i in range(60)]
    got = {tuple(r) for r in neardup.NearDuplicates(spark.createDataFrame(data, "entry_id long, caption string"), "entry_id", "caption").pairs().collect()}
    want = brute(data)
    assert got <= want and len(got) >= 0.99 * len(want)


def test_signatures_estimate_the_similarity(rng):
    base = rng.integers(0, 2**62, 60)
    sets = [np.unique(np.concatenate([base[: 60 - k], rng.integers(0, 2**62, k)])) for k in (0, 6, 15, 30)]
    sig = neardup.signatures(np.concatenate(sets), np.concatenate([[0], np.cumsum([len(s) for s in sets])]), 500)
    assert (sig < neardup.NONE).all()
    for s, v in zip(sets[1:], sig[1:]):
        true = len(np.intersect1d(sets[0], s)) / len(np.union1d(sets[0], s))
        assert abs((sig[0] == v).mean() - true) < 0.07


def test_signatures_equal_the_definition(rng):
    """Each word takes its whole permutation; early stopping changes nothing."""
    sets = [rng.integers(0, 2**62, n) for n in (1, 2, 9, 40, 300)]
    slots = 48
    sig = neardup.signatures(np.concatenate(sets), np.concatenate([[0], np.cumsum([len(s) for s in sets])]), slots)
    for s, v in zip(sets, sig):
        whole = neardup._ranks(s, slots, slots)
        assert (np.sort(whole >> 7, axis=1) == np.arange(slots)).all()  # a permutation
        assert (whole.min(axis=0) == v).all()


def test_the_bound_drops_no_link(rng):
    pool = rng.integers(0, 2**62, 400)
    for _ in range(300):
        base = rng.choice(pool, rng.integers(8, 300), replace=False)
        keep = rng.integers(len(base) // 2, len(base) + 1)
        other = np.unique(np.concatenate([base[:keep], rng.choice(pool, rng.integers(0, 40), replace=False)]))
        base = np.unique(base)
        same = len(np.intersect1d(base, other)) / len(np.union1d(base, other))
        x, y = (neardup.sketches(w, np.array([0, len(w)])) for w in (base, other))
        assert neardup._may_link(x, y, 0.7)[0] or same < 0.7


def test_components(spark):
    chain = [(i, i + 1) for i in range(1, 40)] + [(100, 102), (102, 101), (200, 200)]
    got = {r.id: r.root for r in neardup.components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == {**{i: 1 for i in range(1, 41)}, 100: 100, 101: 100, 102: 100}


def test_empty(spark):
    near = neardup.NearDuplicates(spark.createDataFrame([], "entry_id long, caption string"), "entry_id", "caption")
    assert near.pairs().count() == 0 and near.groups().count() == 0


def test_all_pairs_of_equal_word_sets(spark, words):
    """720 different texts of the same words, and one that is near to them: every pair comes out."""
    some = words[:12]
    texts = [" ".join(some[i % 12 :] + some[: i % 12]) + "!" * (i // 12) for i in range(720)] + [" ".join(some[:11])]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    got = neardup.NearDuplicates(df, "id", "text").pairs()
    assert got.count() == got.distinct().count() == 721 * 720 // 2


def test_no_step_leaves_its_shuffle_on_disk(spark, words, monkeypatch):
    """After each written table, the shuffle files that are left are less than the texts; the keys of all bands would be several times as much."""
    r = random.Random(4)
    texts = [" ".join(r.choice(words) for _ in range(26)) for _ in range(3000)]
    dirs = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()

    def shuffles():
        return {str(f): f.stat().st_size for d in dirs for f in Path(d).rglob("shuffle_*.data") if f.exists()}

    before, left, write = shuffles(), {}, neardup.written

    def watched(df, name, *a, **k):
        out = write(df, name, *a, **k)
        for _ in range(20):  # the files go a little later
            left[name] = sum(n for f, n in shuffles().items() if f not in before)
            if left[name] == 0:
                break
            time.sleep(0.1)
        return out

    monkeypatch.setattr(neardup, "written", watched)
    df = spark.createDataFrame(list(enumerate([*texts, texts[0] + " more"])), "id long, text string")
    assert [tuple(p) for p in neardup.NearDuplicates(df, "id", "text").pairs().collect()] == [(0, 3000)]
    assert max(left.values()) < sum(map(len, texts)), left


def test_candidates_are_verified_in_parts(spark, words, monkeypatch):
    monkeypatch.setattr(neardup, "PAIRS", 1)
    names, write = [], neardup.written
    monkeypatch.setattr(neardup, "written", lambda df, name, *a, **k: names.append(name) or write(df, name, *a, **k))
    data = [(i, " ".join([*words[:30], words[100 + i]])) for i in range(8)]
    got = neardup.NearDuplicates(spark.createDataFrame(data, "entry_id long, caption string"), "entry_id", "caption").pairs()
    assert sorted(tuple(r) for r in got.collect()) == [(a, b) for a in range(8) for b in range(a + 1, 8)]
    assert names.count("links") == 2  # 28 pairs of 8 texts


def test_prefixes_give_no_pairs_too_unlike(spark, words):
    """Pairs that share a rare word and little else are no candidates; one that is near stays."""
    r = random.Random(6)
    data = [(i, " ".join([f"rare{i // 2}", *r.sample(words[:60], 12)])) for i in range(80)]
    data += [(80, " ".join(words[100:120])), (81, " ".join(words[100:121]))]
    near = neardup.NearDuplicates(spark.createDataFrame(data, "id long, text string"), "id", "text")
    got = {tuple(p) for p in near._by_prefix(near.sets.select("id")).collect()}
    assert brute(data) <= got and len(got) < 20
