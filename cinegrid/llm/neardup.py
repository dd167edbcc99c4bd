"""Near-duplicate texts: SuperMinHash signatures, banding, verification, grouping by union-find.

Each distinct word draws, step by step, a random permutation of the signature's slots; at step j it offers its j-th slot the
value j plus a fraction. A slot keeps the least value. Because a word gives each slot another step, the slots of a signature
are negatively correlated, which lowers the variance of the estimate; and since values of step j are at least j, a text
is done as soon as all its slots lie below the step (early stopping). Texts that agree in all slots of a band meet;
pairs that met are verified, first by bounds from 120-bit maps of their words, then by the words; verified pairs are the links,
and their components the groups. The bands are gone through in passes with signatures of their own, and what a pass
moved is removed after it, so that the disk holds the keys of one pass only.

Equal word sets are worked on once. The texts of a band that very many share are compared by the prefixes of their sets, an
exact way that needs no band.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cinegrid.functions.words import runs
from cinegrid.operators.copies import class_pairs
from cinegrid.scratch import discard, written

SIMILARITY = 0.7
MIN_WORDS = 8
SLOTS = 336
BANDS = 90
ROWS = 7
#: Parts of the bands whose keys are moved one after the other, each with its share of the slots.
PASSES = 6
#: Sets compared with each other in one bucket of a band; a larger one is compared by the prefixes of its sets.
BUCKET = 512
#: Texts whose keys are packed together, bytes of keys of a part, and parts of a task.
CHUNK = 8192
PART_BYTES = 4 << 20
PARTS = 8
#: Candidates verified together, or two for each text where that is more.
PAIRS = 1 << 20
#: No value yet.
NONE = 0xFFFF
SEED = 20260101


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x + np.uint64(0x9E3779B97F4A7C15)) & np.uint64(0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _ranks(words: np.ndarray, slots: int, steps: int) -> np.ndarray:
    """What each word offers each slot (words, slots) in the first ``steps`` steps of its permutation: the step above seven random bits."""
    steps = min(steps, slots)
    out = np.full((len(words), slots), NONE, np.uint16)
    j = np.arange(steps, dtype=np.uint64)[:, None]
    for lo in range(0, len(words), 1024):  # a part that stays in the cache
        seed, mine = _mix(words[lo : lo + 1024].view(np.uint64)), out[lo : lo + 1024].reshape(-1)
        r = _mix(seed[None, :] + j)
        base = np.arange(len(seed)) * slots
        swap = (j + ((r >> np.uint64(32)) * (np.uint64(slots) - j) >> np.uint64(32))).astype(np.int64) + base
        value = (j << np.uint64(7) | (r & np.uint64(0x7F))).astype(np.uint16)
        order = np.tile(np.arange(slots), len(seed)) + np.repeat(base, slots)
        for k in range(steps):
            at = swap[k]
            mine[order[at]] = value[k]
            order[at] = order[base + k]
    return out


def band_slots(slots: int, rows: int, bands: int) -> np.ndarray:
    """The slots of each band (bands, rows): the slots in turn, then in other orders, so that a slot serves several bands."""
    random, out = np.random.default_rng(SEED), [np.arange(slots)]
    while len(out) * (slots // rows) < bands:
        out.append(random.permutation(slots))
    return np.concatenate([o[: slots // rows * rows].reshape(-1, rows) for o in out])[:bands]


def signatures(words: np.ndarray, starts: np.ndarray, slots: int) -> np.ndarray:
    """SuperMinHash values (texts, slots) of texts given as 64-bit word hashes, one after the other; no text is empty.

    All texts take the first few steps of their words' permutations, most of them no more: once all slots of a text lie below
    the next step nothing can change. The others take twice as many, and so on."""
    n = len(starts) - 1
    out = np.empty((n, slots), np.uint16)
    live, steps = np.arange(n), max(16, slots // 3)
    while len(live):
        size = np.diff(starts)[live]
        first = np.concatenate([[0], np.cumsum(size)])
        mine = words[np.repeat(starts[live] - first[:-1], size) + np.arange(first[-1])]
        distinct, word = np.unique(mine, return_inverse=True)
        ranks = _ranks(distinct, slots, steps)
        for lo in range(0, len(live), 512):
            hi = min(lo + 512, len(live))
            out[live[lo:hi]] = np.minimum.reduceat(ranks[word[first[lo] : first[hi]]], first[lo:hi] - first[lo], axis=0)
        if steps >= slots:
            break
        live, steps = live[out[live].max(axis=1) >= steps << 7], 2 * steps
    return out


def sketches(words: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Of each text (texts, 2) a map of 120 bits, of which each word turns one over, and above it the number of its words (at most 255)."""
    size = np.diff(starts)
    at = _mix(words.view(np.uint64)) % np.uint64(120)
    bit = np.uint64(1) << at % np.uint64(60)
    low = np.bitwise_xor.reduceat(np.where(at < 60, bit, np.uint64(0)), starts[:-1])
    high = np.bitwise_xor.reduceat(np.where(at < 60, np.uint64(0), bit), starts[:-1])
    n = np.minimum(size, 255).astype(np.uint64)
    return np.stack([low | (n & np.uint64(15)) << np.uint64(60), high | n >> np.uint64(4) << np.uint64(60)], axis=1)


def _may_link(x: np.ndarray, y: np.ndarray, least: float) -> np.ndarray:
    """Whether two texts of these sketches can be as similar as ``least``. A bit that differs comes from a word that only one of them has, so
    a pair that is left out has too few words in common for sure."""
    a, b = ((z[:, 0] >> np.uint64(60) | z[:, 1] >> np.uint64(60) << np.uint64(4)).astype(np.int64) for z in (x, y))
    differ = np.bitwise_count((x ^ y) & np.uint64((1 << 60) - 1)).sum(axis=1, dtype=np.int64)
    common = np.ceil(least / (1 + least) * (a + b) - 1e-9).astype(np.int64)
    return (differ <= a + b - 2 * common) & (common <= np.minimum(a, b)) | (a == 255) | (b == 255)


def _planes(x: np.ndarray) -> bytes:
    """The numbers byte by byte, all first bytes before all second ones: equal high bytes stand together and are compressed away."""
    return np.ascontiguousarray(np.ascontiguousarray(x).view(np.uint8).reshape(-1, x.itemsize).T).tobytes()


def _whole(planes: bytes, kind: type) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(planes, np.uint8).reshape(np.dtype(kind).itemsize, -1).T).view(kind).ravel()


def _bands(slots: int, rows: int, bands: int, groups: int, bucket: int, chunk: int, nth: int = 0):
    """(part, keys, ids, sketches, hot): the band keys of pass ``nth`` of up to ``chunk`` texts, packed into one row for each of ``groups`` (a power of two) parts of the keys. Of
    a key that more than ``bucket`` texts of the chunk have only the key is sent, as hot, and the texts go on as they are: rows
    without keys."""
    of, shift = band_slots(slots, rows, bands), np.uint64(64 - (groups - 1).bit_length())
    salt = _mix(np.array([SEED + nth], np.uint64)).view(np.int64)[0]  # each pass has its own permutations

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _chunks(batches, chunk):
            words = t.column("w").combine_chunks()
            starts = words.offsets.to_numpy().astype(np.int64)
            values = words.values.to_numpy()[starts[0] : starts[-1]]
            starts = starts - starts[0]
            key = np.empty((len(starts) - 1, bands), np.uint64)
            for lo in range(0, len(key), 2048):
                hi = min(lo + 2048, len(key))
                sig = signatures(values[starts[lo] : starts[hi]] ^ salt, starts[lo : hi + 1] - starts[lo], slots).astype(np.uint64)
                part = np.zeros((hi - lo, bands), np.uint64) + np.arange(bands, dtype=np.uint64)
                for k in range(0, rows, 4):  # four slots make a word of 64 bits
                    word = np.zeros_like(part)
                    for r in range(k, min(k + 4, rows)):
                        word = word << np.uint64(16) | sig[:, of[:, r]]
                    part = _mix(part ^ word)
                key[lo:hi] = part
            key, out = key.ravel(), []
            texts, maps = t.column("id").to_numpy(), sketches(values, starts)
            which = np.repeat(np.arange(len(texts), dtype=np.int32), bands)
            ordered = np.sort(key)
            marks = np.unique(ordered[bucket:][ordered[bucket:] == ordered[: max(0, len(ordered) - bucket)]])
            if len(marks):
                alone = np.isin(key, marks)
                some = texts[np.unique(which[alone])]
                out += [(int(c[0]) % groups, b"", c.tobytes(), b"", b"") for c in np.array_split(some, -(-len(some) // 4096))]
                key, which = key[~alone], which[~alone]
            # the first bits of a key name its part, the last 32 go on
            part = (key >> shift).astype(np.uint16 if groups <= 1 << 16 else np.uint32)
            order = np.argsort(part, kind="stable")
            part, short, which = part[order], key[order].astype(np.uint32), which[order]
            cuts = np.searchsorted(part, np.arange(groups + 1))
            ids, sketch = texts[which], maps[which]
            to, marks = (marks >> shift).astype(np.int64), marks.astype(np.uint32)
            for g in np.union1d(np.flatnonzero(np.diff(cuts)), to):
                a, b = cuts[g], cuts[g + 1]
                out.append((int(g), short[a:b].tobytes(), _planes(ids[a:b]), sketch[a:b].tobytes(), marks[to == g].tobytes()))
            cells = [pa.array(c, kind) for c, kind in zip(zip(*out), (pa.int32(), *[pa.binary()] * 4))]
            yield from pa.Table.from_arrays(cells, names=["part", "keys", "ids", "sketches", "hot"]).to_batches(max_chunksize=64)

    return run


def _chunks(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.Table]:
    held, n = [], 0
    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n >= rows:
            yield pa.Table.from_batches(held)
            held, n = [], 0
    if n:
        yield pa.Table.from_batches(held)


def _met(least: float, bucket: int):
    """Of packed keys sorted by part: the pairs (a, b) of a key with at most ``bucket`` ids whose sketches let them be similar enough; of
    a larger or hot key, and of rows without keys, each id as (id, null)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        now = None

        def out(a: np.ndarray, b: np.ndarray | None) -> Iterator[pa.RecordBatch]:
            for lo in range(0, len(a), 65536):
                x = pa.array(a[lo : lo + 65536])
                yield pa.RecordBatch.from_arrays([x, pa.nulls(len(x), pa.int64()) if b is None else pa.array(b[lo : lo + 65536])], names=["a", "b"])

        def part() -> Iterator[pa.RecordBatch]:
            bare = [np.frombuffer(i, np.int64) for k, i, _, _ in held if not k and i]
            if bare:
                yield from out(np.unique(np.concatenate(bare)), None)
            key, sketch, hot = (np.frombuffer(b"".join(h[c] for h in held), kind) for c, kind in ((0, np.uint32), (2, np.uint64), (3, np.uint32)))
            sketch = sketch.reshape(-1, 2)
            ids = np.concatenate([np.empty(0, np.int64), *(_whole(h[1], np.int64) for h in held if h[0])])
            order = np.argsort(key)
            key, ids, sketch = key[order], ids[order], sketch[order]
            first = np.flatnonzero(np.concatenate([np.ones(min(1, len(key)), bool), key[1:] != key[:-1]]))
            size = np.diff(np.concatenate([first, [len(key)]]))
            large = (size > bucket) | np.isin(key[first], hot)
            if large.any():
                yield from out(np.unique(ids[np.repeat(large, size)]), None)
            for n in np.unique(size[(size > 1) & ~large]):
                i, j = np.triu_indices(n, 1)
                begins = first[(size == n) & ~large]
                for lo in range(0, len(begins), max(1, 1_000_000 // len(i))):
                    at = begins[lo : lo + max(1, 1_000_000 // len(i))][:, None]
                    x, y = (at + i).ravel(), (at + j).ravel()
                    good = _may_link(sketch[x], sketch[y], least)
                    x, y = ids[x[good]], ids[y[good]]
                    yield from out(np.minimum(x, y), np.maximum(x, y))

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if held and row[0] != now:
                    yield from part()
                    held = []
                now = row[0]
                held.append(row[1:])
        if held:
            yield from part()

    return run


def _similarity(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Jaccard of two sorted lists of distinct hashes per row."""
    for batch in batches:
        sides = []
        for at in (2, 3):
            c = batch.column(at)
            starts = c.offsets.to_numpy().astype(np.int64)
            row = np.repeat(np.arange(batch.num_rows), np.diff(starts))
            sides.append((row, c.values.to_numpy()[starts[0] : starts[-1]], np.diff(starts)))
        row = np.concatenate([sides[0][0], sides[1][0]])
        value = np.concatenate([sides[0][1], sides[1][1]])
        order = np.lexsort((value, row))
        row, value = row[order], value[order]
        same = (row[1:] == row[:-1]) & (value[1:] == value[:-1])
        both = np.bincount(row[1:][same], minlength=batch.num_rows)
        either = sides[0][2] + sides[1][2] - both
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(both / np.maximum(either, 1))], names=["a", "b", "similarity"])


class NearDuplicates:
    """The links between the texts of a table whose word sets have a Jaccard similarity of at least ``similarity``.

    Texts (null, empty and blank ones too) with fewer than ``min_words`` distinct words take no part. ``key`` is a unique
    integer; columns besides the two are ignored; an empty table gives no links. With 90 bands of 7 slots in six passes, each with 56
    slots in two bands, candidates are found with the probability 0.999 at a similarity of exactly 0.7 (simulated).
    """

    def __init__(self, df: DataFrame, key: str, text: str, similarity: float = SIMILARITY, min_words: int = MIN_WORDS, bands: int = BANDS, rows: int = ROWS, slots: int = SLOTS):
        if not rows <= slots <= 500:
            raise ValueError("slots must be between rows and 500")
        self.spark = df.sparkSession
        self.similarity, self.bands, self.rows, self.slots = similarity, bands, rows, slots
        words = df.select(F.col(key).cast("long").alias("id"), F.sort_array(F.array_distinct(F.transform(runs(F.col(text)), lambda w: F.xxhash64(w)))).alias("w"))
        words = words.where("id is not null").where(F.size("w") >= min_words)
        sets = written(words.withColumn("digest", F.xxhash64("w")), "texts")
        # equal sets: the smallest key stands for all
        classes = sets.groupBy("digest", F.size("w").alias("n_words")).agg(F.min("id").alias("rep"), F.count("*").alias("n")).where("n > 1")
        same = sets.select("id", "digest", F.size("w").alias("n_words")).join(classes, ["digest", "n_words"])
        self.members = written(same.select("rep", "id"), "members", tidy=True)
        others = self.members.where("id <> rep").select("id")
        self.sets = written(sets.join(others, "id", "left_anti").select("id", "w"), "sets", tidy=True)
        discard(sets)

    def candidates(self) -> DataFrame:
        """(a, b), a < b: pairs that share a band."""
        passes = max(1, min(PASSES, self.bands, self.slots // self.rows))
        slots, n = self.slots // passes, self.sets.count()
        met = []
        for nth in range(passes):
            bands = (self.bands + nth) // passes  # their sum over the passes is self.bands
            groups = 1 << (max(64, -(-n * bands * 28 // PART_BYTES)) - 1).bit_length()
            tasks = max(int(self.spark.conf.get("spark.sql.shuffle.partitions")), groups // PARTS)
            keys = self.sets.select("id", "w").mapInArrow(_bands(slots, self.rows, bands, groups, BUCKET, CHUNK, nth), "part int, keys binary, ids binary, sketches binary, hot binary")
            keys = keys.repartitionById(tasks, F.pmod("part", F.lit(tasks))).sortWithinPartitions("part")
            met.append(written(keys.mapInArrow(_met(self.similarity, BUCKET), "a long, b long").distinct(), "met", tidy=True))
        every = reduce(DataFrame.unionByName, met)
        hot = every.where("b is null").select(F.col("a").alias("id")).distinct()
        pairs = every.where("b is not null")
        if hot.limit(1).count():
            pairs = pairs.unionByName(written(self._by_prefix(hot), "prefixed", tidy=True))
        pairs = written(pairs.distinct(), "candidates", tidy=True)
        for m in met:
            discard(m)
        return pairs

    def _by_prefix(self, ids: DataFrame) -> DataFrame:
        """The exact way for the texts of hot buckets: two sets of n words that share the fraction s must share one of the
        first n - ceil(s n) + 1 words in the order of rarity. Such prefixes are short and made of rare words, and only sets
        of like size meet whose word maps let them be similar enough, see ``_may_link``."""
        sets = self.sets.join(ids, "id", "left_semi")
        flat = sets.select("id", F.size("w").alias("n"), F.explode("w").alias("word"))
        rarity = flat.groupBy("word").agg(F.count("*").alias("df"))
        order = flat.join(rarity, "word").groupBy("id", "n").agg(F.sort_array(F.collect_list(F.struct("df", "word"))).alias("w"))
        length = F.col("n") - F.ceil(F.lit(self.similarity) * F.col("n") - 1e-9).cast("int") + 1
        low, high = (F.expr(f"aggregate(w.word, 0L, (m, x) -> m ^ if(pmod(x, 120) {half}, shiftleft(1L, cast(pmod(x, 60) as int)), 0L))") for half in ("< 60", ">= 60"))
        prefix = order.select("id", "n", low.alias("low"), high.alias("high"), F.explode(F.slice("w", F.lit(1), length)).alias("p")).select("id", "n", "low", "high", "p.word")
        x, y = prefix.toDF("a", "n_a", "low_a", "high_a", "word"), prefix.toDF("b", "n_b", "low_b", "high_b", "word")
        fits = (F.col("n_a") >= F.lit(self.similarity) * F.col("n_b") - 1e-9) & (F.col("n_b") >= F.lit(self.similarity) * F.col("n_a") - 1e-9)
        differ = F.bit_count(F.col("low_a").bitwiseXOR(F.col("low_b"))) + F.bit_count(F.col("high_a").bitwiseXOR(F.col("high_b")))
        both = F.col("n_a") + F.col("n_b")
        fits = fits & (differ <= both - 2 * F.ceil(F.lit(self.similarity / (1 + self.similarity)) * both - 1e-9))
        return x.join(y, "word").where(F.col("a") < F.col("b")).where(fits).select("a", "b")

    def links(self) -> DataFrame:
        """(a, b, similarity) between representatives of different word sets, verified by the words; many candidates a part at a time, so
        that the words beside them don't stand on disk for all at once."""
        pairs, found = self.candidates(), []
        parts = max(1, -(-pairs.count() // max(PAIRS, 2 * self.sets.count())))
        a, b = (self.sets.select(F.col("id").alias(x), F.col("w").alias(f"w{x}")) for x in "ab")
        for k in range(parts):
            mine = F.pmod(F.xxhash64("a"), F.lit(parts)) == k if parts > 1 else F.lit(True)
            some = pairs.where(mine).join(a.where(mine), "a").join(b, "b")
            scored = some.select("a", "b", "wa", "wb").mapInArrow(_similarity, "a long, b long, similarity double")
            found.append(written(scored.where(F.col("similarity") >= self.similarity - 1e-12), "links", tidy=True))
        discard(pairs)
        return reduce(DataFrame.unionByName, found)

    def pairs(self, expand: int | None = None) -> DataFrame:
        """(a, b), a < b: rows linked, each pair once. Equal word sets may be different texts, so all their pairs come out unless
        ``expand`` is given: see ``class_pairs``."""
        links = self.links()
        return class_pairs(self.members, links.select(F.col("a").alias("rep_a"), F.col("b").alias("rep_b")), expand)

    def groups(self) -> DataFrame:
        """(id, group, links): every row that is in a group of two or more; ``group`` is the smallest key in it, ``links`` the number
        of other word sets that the row's is linked with."""
        links = self.links()
        both = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        degree = both.groupBy("a").agg(F.count("*").alias("links")).withColumnRenamed("a", "id")
        root = components(links.select("a", "b"))
        every = self.members.select("id", "rep").unionByName(root.select(F.col("id"), F.col("id").alias("rep")).join(self.members.select("id"), "id", "left_anti"))
        named = every.join(root.select(F.col("id").alias("rep"), "root"), "rep", "left").join(degree.select(F.col("id").alias("rep"), "links"), "rep", "left")
        return named.select("id", F.coalesce("root", "rep").alias("group"), F.coalesce("links", F.lit(0)).alias("links"))


def components(edges: DataFrame) -> DataFrame:
    """(id, root): the smallest id that a chain of edges (a, b) joins each id to.

    Union-find on tables: in every round each id hooks to the smallest root next to it and paths are halved, until nothing changes; a
    number of rounds that grows with the logarithm of the longest chain. Each round's table is written to the shared folder.
    """
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b")
    both = written(both.distinct(), "edges")
    state = written(both.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("m")).select("id", F.least("id", "m").alias("root")), "roots")
    while True:
        near = both.join(state.select(F.col("id").alias("b"), F.col("root").alias("r")), "b").groupBy("a").agg(F.min("r").alias("r"))
        hooked = state.join(near.withColumnRenamed("a", "id"), "id").select("id", "root", F.least("root", "r").alias("new"))
        # the least root seen by any member is offered to the old root too
        offers = hooked.groupBy("root").agg(F.min("new").alias("offer"))
        told = hooked.join(offers.select(F.col("root").alias("id"), "offer"), "id", "left")
        told = told.select("id", "root", F.least("new", F.coalesce("offer", "new")).alias("new"))
        told = written(told, "told")
        jump = told.select(F.col("id").alias("new"), F.col("new").alias("beyond"))
        after = told.join(jump, "new", "left").select("id", "root", F.least("new", F.coalesce("beyond", "new")).alias("to"))
        after = written(after, "roots")
        if not after.where("root <> to").limit(1).count():
            return after.select("id", F.col("to").alias("root"))
        state = after.select("id", F.col("to").alias("root"))
