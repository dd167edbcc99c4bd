"""The most similar vectors of every vector, by cross-polytope hashing.

A chain of fast Hadamard pseudo-rotations (random signs, then a Hadamard transform) turns each unit vector; in each block of
the turned vector the nearest signed axis is one hash. A table's key is a path of such hashes. Its buckets are as
deep as they must be: a bucket of more than BUCKET rows is cut by the next hash of the path, so that work per row
is bounded whatever the number of rows, and near copies, which share long paths, still meet. Each vector is also put in a
second bucket of each table, that of its least certain axis (multiprobe). Rows of a bucket are compared by the signs of a
turned vector; pairs that may be similar enough are reranked by the exact cosine, in double.

A row for which the tables find more candidates than are reranked may have nearer ones that the cut of a bucket or the rank by
codes left out (in a large group of near copies all differences are smaller than the code's error). Each such row is compared
with all rows, in blocks, by the exact cosine, with its k-th cosine so far as the bound; so its k nearest are the true ones.
Without a least cosine every asking row is such a row.

Only codes (some hundred bytes a vector) are shuffled for the search; vectors move only for pairs to be reranked. Equal
vectors are searched once and joined back.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cinegrid.functions.vectors import matrix, packed, unit, unpacked
from cinegrid.scratch import written

WIDTH = 512
K = 10
#: Tables, and the hashes of a path. A hash has 8 bits: one of 128 axes and its sign.
TABLES = 12
DEPTH = 6
#: A bucket is at least so many hashes deep; the second bucket differs in one of so many.
START = 1
PROBED = 2
AXES = 128
#: Rows of a bucket that are compared with each other.
BUCKET = 256
QUERY_BUCKET = 1024
#: Bits of the sign code.
BITS = 1024
#: Standard deviations of the code's estimate by which a pair may miss the least cosine and still be reranked: at the
#: least cosine itself 99.5 of 100 pairs pass (normal approximation).
SLACK = 2.6
#: Up to so many ids of vectors to be reranked (16 bytes each, so 8 MB) are broadcast, so that only those vectors are shuffled.
BROADCAST_IDS = 500_000
#: Rows that are compared with all rows in one pass over these; rows and asking rows that are multiplied at a time.
ASKED = 16_384
BLOCK = 8192
TILE = 512
#: More than the error of a cosine in single precision.
ROUNDING = 4e-6
SEED = 20260101


def rotations(width: int, blocks: int) -> tuple[int, np.ndarray]:
    """The padded width (a power of two, at least AXES) and the random signs of as many rounds as ``blocks`` hashes need.
    The first three rounds mix; after that every round gives new hashes."""
    size = max(AXES, 1 << max(0, (width - 1).bit_length()))
    rounds = 2 + -(-blocks // (size // AXES)) + -(-BITS // size)
    return size, np.random.default_rng(SEED).choice(np.array([-1, 1], np.float32), (rounds, size))


def _hadamard(n: int) -> np.ndarray:
    h = np.ones((1, 1), np.float32)
    while len(h) < n:
        h = np.block([[h, h], [h, -h]])
    return (h / np.sqrt(n)).astype(np.float32)


def turned(rows: np.ndarray, signs: np.ndarray) -> Iterator[np.ndarray]:
    """The rows after each round from the third on. The transform of a size n = a * b is done as one of a and one of b."""
    n, size = len(rows), signs.shape[1]
    a = 1 << (size.bit_length() - 1) // 2
    inner, outer = _hadamard(size // a), _hadamard(a)
    x = np.zeros((n, size), np.float32)
    x[:, : rows.shape[1]] = rows
    for i, s in enumerate(signs):
        x = ((x * s).reshape(-1, size // a) @ inner).reshape(n, a, size // a)
        x = np.matmul(outer, x).reshape(n, size)
        if i >= 2:
            yield x


def codes(rows: np.ndarray, tables: int = TABLES, depth: int = DEPTH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of unit vectors: the path of each table (n, tables) with 8 bits a hash, the other paths (multiprobe), and the sign
    codes (n, BITS / 64). The other path differs at the hash whose two greatest axes are nearest to each other, among the
    first PROBED hashes."""
    n, need = len(rows), tables * depth
    size, signs = rotations(rows.shape[1], need)
    hashes = np.empty((need, n), np.uint64)
    second = np.empty((need, n), np.uint64)
    gap = np.empty((need, n), np.float32)
    sketch, got, bits = [], 0, 0
    here = np.arange(n)
    for x in turned(rows, signs):
        if bits < BITS:
            sketch.append(np.packbits(x > 0, axis=1)[:, : (BITS - bits) // 8])
            bits += sketch[-1].shape[1] * 8
        for block in range(size // AXES):
            if got == need:
                break
            part = x[:, block * AXES : (block + 1) * AXES]
            size_of = np.abs(part)
            top = size_of.argmax(axis=1)
            best = size_of[here, top]
            hashes[got] = top * 2 + (part[here, top] < 0)
            if got % depth < PROBED:
                size_of[here, top] = -1
                next_ = size_of.argmax(axis=1)
                second[got] = next_ * 2 + (part[here, next_] < 0)
                gap[got] = best - size_of[here, next_]
            got += 1
    paths, others = np.empty((n, tables), np.int64), np.empty((n, tables), np.int64)
    for t in range(tables):
        own = hashes[t * depth : (t + 1) * depth]
        paths[:, t] = _path(own)
        weak = gap[t * depth : t * depth + PROBED].argmin(axis=0)
        probe = own.copy()
        probe[weak, here] = second[t * depth + weak, here]
        others[:, t] = _path(probe)
    return paths, others, np.concatenate(sketch, axis=1).copy().view(np.uint64)


def paths(rows: np.ndarray, tables: int, depth: int) -> np.ndarray:
    """Of unit vectors only the path of each table (n, tables)."""
    n, need, hashes = len(rows), tables * depth, []
    for x in turned(rows, rotations(rows.shape[1], need)[1]):
        for block in range(0, x.shape[1], AXES):
            part = x[:, block : block + AXES]
            top = np.abs(part).argmax(axis=1)
            hashes.append((top * 2 + (part[np.arange(n), top] < 0)).astype(np.uint64))
        if len(hashes) >= need:
            break
    return np.stack([_path(np.array(hashes[t * depth : (t + 1) * depth])) for t in range(tables)], axis=1)


def _path(hashes: np.ndarray) -> np.ndarray:
    out = np.zeros(hashes.shape[1], np.uint64)
    for h in hashes:
        out = out << np.uint64(8) | h
    return out.view(np.int64)


def _coded(width: int, tables: int, depth: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, at = matrix(batch.column(1), width)
            if not len(at):
                continue
            paths, others, sketch = codes(unit(rows), tables, depth)
            lists = [pa.FixedSizeListArray.from_arrays(pa.array(p.ravel()), tables).cast(pa.list_(pa.int64())) for p in (paths, others)]
            cells = [batch.column(0).take(pa.array(at)), *lists, pa.array([r.tobytes() for r in sketch], pa.binary()), batch.column(2).take(pa.array(at)), batch.column(3).take(pa.array(at))]
            yield from pa.Table.from_arrays(cells, names=["id", "paths", "others", "sketch", "h1", "h2"]).to_batches()

    return run


def _buckets(path: np.ndarray, lo: int, hi: int, depth: int, level: int, most: int) -> Iterator[tuple[int, int]]:
    """Cuts the sorted paths from lo to hi into buckets of at most ``most`` rows where a deeper hash can."""
    todo = [(lo, hi, level)]
    while todo:
        lo, hi, level = todo.pop()
        if hi - lo <= most or level == depth:
            if hi - lo > 1:
                yield lo, hi
            continue
        part = path[lo:hi] >> np.uint64(8 * (depth - level - 1))
        cuts = np.flatnonzero(part[1:] != part[:-1]) + 1 + lo
        todo += [(a, b, level + 1) for a, b in zip([lo, *cuts], [*cuts, hi]) if b - a > 1]


def _searched(depth: int, most_differ: int, keep: int, bucket: int, every: bool):
    """(x, y, differ): pairs of each bucket whose codes differ in at most ``most_differ`` bits, per asking row the ``keep`` nearest of
    them. If every row asks, a pair is given once; else x is the row that asks. A bucket that no hash cuts further is
    compared in overlapping stretches of its order."""

    def stretches(path: np.ndarray) -> Iterator[tuple[int, int, int]]:
        first = path >> np.uint64(8 * (depth - START))
        cuts = np.flatnonzero(first[1:] != first[:-1]) + 1
        for lo, hi in zip([0, *cuts], [*cuts, len(path)]):
            for a, b in _buckets(path, lo, hi, depth, START, bucket):
                for at in range(a, b, bucket):
                    yield at, min(b, at + bucket), min(b, at + 2 * bucket)
                    if at + 2 * bucket >= b:
                        break

    def pairs(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        path = table.column("path").to_numpy().view(np.uint64)
        ids, sketch = table.column("id").to_numpy(), np.frombuffer(b"".join(table.column("sketch").to_pylist()), np.uint64).reshape(len(path), -1)
        own, asks = (table.column(c).to_numpy(zero_copy_only=False) for c in ("own", "asks"))
        out = []
        for at, mid, end in stretches(path):
            if end - at < 2:
                continue
            rows = np.arange(at, mid) if every else at + np.flatnonzero(asks[at:end])
            for lo in range(0, len(rows), 256):
                r = rows[lo : lo + 256]
                differ = np.bitwise_count(sketch[r][:, None, :] ^ sketch[None, at:end, :]).sum(axis=2, dtype=np.int16)
                good = (differ <= most_differ) & (own[r][:, None] | own[None, at:end])
                if every:
                    good &= np.arange(at, end)[None, :] > r[:, None]
                elif end - at > 2 * keep:
                    good &= differ <= np.partition(np.where(good, differ, 9999), keep, axis=1)[:, keep : keep + 1]
                i, j = np.nonzero(good)
                out.append((ids[r[i]], ids[at + j], differ[i, j]))
        if not out:
            none = np.empty(0, np.int64)
            return none, none, none
        x, y, d = (np.concatenate(c) for c in zip(*out))
        if every:
            x, y = np.minimum(x, y), np.maximum(x, y)
        other = x != y
        return x[other], y[other], d[other].astype(np.int64)

    def nearest(x: np.ndarray, y: np.ndarray, d: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        _, one = np.unique(np.stack([x, y]), axis=1, return_index=True)
        x, y, d = x[one], y[one], d[one]
        kept = np.zeros(len(x), bool)
        for side in (x, y) if every else (x,):
            order = np.lexsort((d, side))
            s = side[order]
            new = np.concatenate([[True], s[1:] != s[:-1]]) if len(s) else np.empty(0, bool)
            rank = np.arange(len(s)) - np.maximum.accumulate(np.where(new, np.arange(len(s)), 0))
            kept[order[rank < keep]] = True
        return x[kept], y[kept], d[kept]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0

        def done() -> Iterator[pa.RecordBatch]:
            x, y, d = nearest(*pairs(pa.Table.from_batches(held)))
            cells = [pa.array(x), pa.array(y), pa.array(d.astype(np.int32))]
            return iter(pa.Table.from_arrays(cells, names=["x", "y", "differ"]).to_batches())

        for batch in batches:
            held.append(batch)
            rows += batch.num_rows
            # a piece ends where the first hashes change; where one of them fills half of it, at its end
            if rows >= 100_000:
                table = pa.Table.from_batches(held)
                path = table.column("path").to_numpy().view(np.uint64) >> np.uint64(8 * (depth - START))
                last = np.flatnonzero(path != path[-1])
                cut = int(last[-1]) + 1 if len(last) else len(path)
                if cut < len(path) // 2:
                    cut = len(path)
                rest = table.slice(cut)
                held = table.slice(0, cut).to_batches()
                yield from done()
                held, rows = rest.to_batches(), rest.num_rows
        if held:
            yield from done()

    return run


def _cosine(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    x, y = x.astype(np.float64), y.astype(np.float64)
    for m in (x, y):
        m /= np.abs(m).max(axis=1, keepdims=True)
    dot = np.einsum("ij,ij->i", x, y)
    return dot / (np.sqrt(np.einsum("ij,ij->i", x, x)) * np.sqrt(np.einsum("ij,ij->i", y, y)))


def _cosines(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cosine = _cosine(*(unpacked(batch.column(i), width) for i in (2, 3)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(cosine)], names=["a", "b", "cosine"])

    return run


def _top(group: np.ndarray, value: np.ndarray, tie: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The places of the k greatest values of each group, on a tie of the smaller ``tie``, and their ranks from 0."""
    order = np.lexsort((tie, -value, group))
    g = group[order]
    new = np.concatenate([[True], g[1:] != g[:-1]]) if len(g) else np.empty(0, bool)
    rank = np.arange(len(g)) - np.maximum.accumulate(np.where(new, np.arange(len(g)), 0))
    return order[rank < k], rank[rank < k]


def _blocks(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(ids, vectors) of up to about BLOCK usable rows."""
    held, n = [], 0
    for batch in batches:
        for lo in range(0, batch.num_rows, BLOCK):
            part = batch.slice(lo, BLOCK)
            rows, at = matrix(part.column(1), width)
            held.append((part.column(0).to_numpy()[at], rows))
            n += len(at)
            if n >= BLOCK:
                yield tuple(np.concatenate(c) for c in zip(*held))
                held, n = [], 0
    if n:
        yield tuple(np.concatenate(c) for c in zip(*held))


def _against(asked, width: int, k: int):
    """(x, y, cosine): of each asked row the k most similar rows of the partition among those with at least its bound."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, cells, bounds = asked.value
        vectors = unpacked(cells, width)
        turned_to, least = unit(vectors), bounds - ROUNDING
        x, y, c = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)
        for ids, rows in _blocks(batches, width):
            units = unit(rows)
            mine = np.searchsorted(keys, ids)
            mine[mine == len(keys)] = 0
            same = np.flatnonzero(keys[mine] == ids)
            found = [(x, y, c)]
            for lo in range(0, len(keys), TILE):
                sims = turned_to[lo : lo + TILE] @ units.T
                here = same[(mine[same] >= lo) & (mine[same] < lo + TILE)]
                sims[mine[here] - lo, here] = -np.inf
                floor = least[lo : lo + TILE].astype(np.float32)
                # the k-th greatest of the maxima of many parts is at most the k-th greatest of all
                parts = 16 * k
                if (size := len(ids) // parts) > 1:
                    maxima = sims[:, : parts * size].reshape(len(sims), parts, size).max(axis=2)
                    floor = np.maximum(floor, np.partition(maxima, -k, axis=1)[:, -k] - np.float32(2 * ROUNDING))
                i, j = np.nonzero(sims >= floor[:, None])
                if not len(i):
                    continue
                # of what is left, the k greatest and those within the error of the k-th
                s = sims[i, j]
                at, rank = _top(i, s, j, k)
                kth = np.full(len(sims), -np.inf, np.float32)
                kth[i[at[rank == k - 1]]] = s[at[rank == k - 1]]
                good = s >= kth[i] - np.float32(2 * ROUNDING)
                i, j = i[good] + lo, j[good]
                for p in range(0, len(i), 8192):
                    a, b = i[p : p + 8192], j[p : p + 8192]
                    found.append((a, ids[b], _cosine(vectors[a], rows[b])))
            x, y, c = (np.concatenate(m) for m in zip(*found))
            at, rank = _top(x, c, y, k)
            last = at[rank == k - 1]
            least[x[last]] = np.maximum(least[x[last]], c[last] - ROUNDING)
            x, y, c = x[at], y[at], c[at]
        good = c >= bounds[x]
        yield from pa.Table.from_arrays([pa.array(keys[x[good]]), pa.array(y[good]), pa.array(c[good])], names=["x", "y", "cosine"]).to_batches(max_chunksize=65536)

    return run


def _all_rows(rows: DataFrame, asked: DataFrame, k: int, width: int) -> DataFrame:
    """(x, y, cosine): the k most similar of ``rows`` (id, v) for each row of ``asked`` (id, least), of those with a cosine of
    at least ``least``. The asking rows are broadcast part by part; every part is multiplied with all rows."""
    spark = rows.sparkSession
    parts = max(1, -(-asked.count() // ASKED))
    schema, out = "x long, y long, cosine double", None
    for part in range(parts):
        some = asked.where(F.pmod(F.xxhash64("id"), F.lit(parts)) == part)
        got = rows.join(F.broadcast(some), "id").select("id", "v", "least").mapInArrow(_with_bounds(width), "id long, vector binary, least double").toArrow()
        if not got.num_rows:
            continue
        got = got.sort_by("id").combine_chunks()
        cells = [got.column(i).combine_chunks() for i in range(3)]
        shared = spark.sparkContext.broadcast((cells[0].to_numpy(), cells[1], cells[2].to_numpy()))
        found = written(rows.select("id", "v").mapInArrow(_against(shared, width, k), schema), "compared")
        shared.destroy()
        out = found if out is None else out.unionByName(found)
    if out is None:
        return spark.createDataFrame([], schema)
    best = Window.partitionBy("x").orderBy(F.desc("cosine"), "y")
    return out.withColumn("r", F.row_number().over(best)).where(F.col("r") <= k).drop("r")


def _with_bounds(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, at = matrix(batch.column(1), width)
            at = pa.array(at)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), pa.array(packed(rows), pa.binary()), batch.column(2).take(at)], names=["id", "vector", "least"])

    return run


def _packed(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, at = matrix(batch.column(1), width)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), pa.array(packed(rows), pa.binary())], names=["id", "vector"])

    return run


def similar(df: DataFrame, key: str, vector: str, k: int = K, min_cosine: float | None = None, queries: DataFrame | None = None, width: int = WIDTH, tables: int = TABLES, depth: int = DEPTH, bucket: int | None = None, rerank: int = 3) -> DataFrame:
    """(id, other, cosine, rank): for each usable vector the ``k`` most similar others, of those with a cosine of at least
    ``min_cosine`` if it is given; on a tie the smaller key. ``key`` is a unique integer.

    ``queries``: the keys (in its first column) that ask, against all rows; all if None. As few rows ask then, buckets may be
    larger (QUERY_BUCKET). ``rerank``: so many times k candidates of a row are reranked; a row with as many or more is compared
    with all rows, as is, without ``min_cosine``, each asking row: those have the true k most similar, and that work is the
    product of both numbers. The other rows rest on the tables alone. Unusable vectors (null, another length, a value that is
    null or not finite, all zero) take no part. Vectors of any length are compared by direction. Equal vectors are neighbours
    with cosine 1. An empty input gives no rows; columns besides the two are ignored. Recall against brute force is measured in
    the tests and stands in the README.
    """
    least = -1.0 if min_cosine is None else float(min_cosine)
    rows = df.select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<float>").alias("v"))
    coded = rows.where("id is not null and v is not null").where(F.size("v") == width)
    coded = coded.withColumns({"h1": F.xxhash64("v"), "h2": F.hash("v")})
    coded = coded.mapInArrow(_coded(width, tables, depth), "id long, paths array<long>, others array<long>, sketch binary, h1 long, h2 int")
    coded = written(coded, "codes")
    # equal vectors: the smallest key stands for all
    classes = coded.groupBy("h1", "h2").agg(F.min("id").alias("rep"), F.count("*").alias("n")).where("n > 1")
    members = written(coded.select("id", "h1", "h2").join(classes, ["h1", "h2"]).select("rep", "id", "n"), "members")
    if queries is None:
        coded = coded.withColumn("asks", F.lit(True))
    else:
        asking = queries.select(F.col(queries.columns[0]).cast("long").alias("id")).distinct()
        asking = asking.join(members.select("id", "rep"), "id", "left").select(F.coalesce("rep", "id").alias("id")).distinct()
        coded = coded.join(asking.withColumn("asks", F.lit(True)), "id", "left").withColumn("asks", F.coalesce("asks", F.lit(False)))
    bucket = bucket or (BUCKET if queries is None else QUERY_BUCKET)
    single = coded.join(members.where("id <> rep").select("id"), "id", "left_anti")
    reps = rows.where(F.size("v") == width).join(members.where("id <> rep").select("id"), "id", "left_anti")
    # only rows that ask look into a second bucket
    both = F.array(F.struct("paths", F.lit(True).alias("own")), F.struct(F.col("others").alias("paths"), F.lit(False).alias("own")))
    probes = single.select("id", "sketch", "asks", F.explode(both).alias("p")).where("asks or p.own")
    probes = probes.select("id", "sketch", "asks", "p.own", F.posexplode("p.paths").alias("table", "path"))
    # the table's number stands above the path's bits, so one order holds all tables; its ranges, with sampled bounds, split
    # a bucket that holds many rows, by the key in the end
    path = (F.col("table").cast("long") * (1 << 8 * depth) + F.col("path")).alias("path")
    probes = probes.select(path, "id", "sketch", "own", "asks").repartitionByRange("path", "id").sortWithinPartitions("path", "id")
    # the share of differing bits estimates the angle; its deviation sets the slack
    share = float(np.arccos(np.clip(least, -1, 1)) / np.pi)
    most = int(np.ceil(BITS * (share + SLACK * np.sqrt(share * (1 - share) / BITS))))
    found = probes.mapInArrow(_searched(depth, most, rerank * k, bucket, queries is None), "x long, y long, differ int")
    found = found.groupBy("x", "y").agg(F.min("differ").alias("differ"))
    # per vector the rerank * k pairs of least difference are reranked; both sides may keep a pair
    if queries is None:
        sides = F.explode(F.array(F.struct("x", "y"), F.struct(F.col("y").alias("x"), F.col("x").alias("y"))))
        found = found.select("differ", sides.alias("s")).select("s.x", "s.y", "differ")
    ranked = found.withColumn("r", F.row_number().over(Window.partitionBy("x").orderBy("differ", "y"))).where(F.col("r") <= rerank * k)
    ranked = written(ranked.select("x", "y", "r"), "ranked")
    asked = ranked.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
    needed = written(ranked.select(F.col("x").alias("id")).union(ranked.select("y")).distinct(), "needed")
    if needed.count() <= BROADCAST_IDS:
        rows = rows.join(F.broadcast(needed), "id", "left_semi")
    # both joins read one shuffle of the vectors
    vectors = rows.mapInArrow(_packed(width), "id long, vector binary")
    scored = asked.join(vectors.select(F.col("id").alias("a"), F.col("vector").alias("va")), "a").join(vectors.select(F.col("id").alias("b"), F.col("vector").alias("vb")), "b")
    scored = scored.select("a", "b", "va", "vb").mapInArrow(_cosines(width), "a long, b long, cosine double").where(F.col("cosine") >= least)
    scored = written(scored, "scored")
    # rows with as many candidates as are reranked, and the cosine of the k-th: nearer ones may have been left out
    if min_cosine is None:
        crowded = single.where("asks").select("id")
    else:
        crowded = ranked.where(F.col("r") == rerank * k).select(F.col("x").alias("id"))
    sides = scored.select("cosine", F.explode(F.array("a", "b")).alias("id")).join(crowded, "id", "left_semi")
    kth = sides.withColumn("r", F.row_number().over(Window.partitionBy("id").orderBy(F.desc("cosine")))).where(F.col("r") == k)
    crowded = written(crowded.distinct().join(kth.select("id", F.col("cosine").alias("kth")), "id", "left").select("id", F.coalesce("kth", F.lit(least)).alias("least")), "crowded")
    nearer = _all_rows(reps, crowded, k, width)
    nearer = nearer.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), "cosine")
    scored = scored.unionByName(nearer).groupBy("a", "b").agg(F.max("cosine").alias("cosine"))
    return _with_copies(scored, members, k, queries)


def _with_copies(scored: DataFrame, members: DataFrame, k: int, queries: DataFrame | None) -> DataFrame:
    """Puts the equal vectors back: of a class at most its k + 1 smallest keys can be among anyone's k nearest."""
    first = members.withColumn("r", F.row_number().over(Window.partitionBy("rep").orderBy("id"))).where(F.col("r") <= k + 1).select("rep", "id")
    one = F.explode(F.array(F.struct(F.col("a").alias("x"), F.col("b").alias("y")), F.struct(F.col("b").alias("x"), F.col("a").alias("y"))))
    links = scored.select("cosine", one.alias("s")).select("s.x", "s.y", "cosine")
    # towards the other side only its smallest keys; from this side every row
    links = links.join(first.select(F.col("rep").alias("y"), F.col("id").alias("o")), "y", "left").select("x", F.coalesce("o", "y").alias("other"), "cosine")
    links = links.join(members.select(F.col("rep").alias("x"), F.col("id").alias("o")), "x", "left").select(F.coalesce("o", "x").alias("id"), "other", "cosine")
    same = members.select("rep", "id").join(first.select("rep", F.col("id").alias("other")), "rep").where("id <> other")
    links = links.unionByName(same.select("id", "other", F.lit(1.0).alias("cosine")))
    if queries is not None:
        links = links.join(queries.select(F.col(queries.columns[0]).cast("long").alias("id")).distinct(), "id", "left_semi")
    best = Window.partitionBy("id").orderBy(F.desc("cosine"), "other")
    return links.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("id", "other", "cosine", "rank")


def similar_pairs(df: DataFrame, key: str, vector: str, **options) -> DataFrame:
    """(a, b), a < b: pairs of which at least one takes the other; each once."""
    found = similar(df, key, vector, **options)
    return found.select(F.least("id", "other").alias("a"), F.greatest("id", "other").alias("b")).distinct()
