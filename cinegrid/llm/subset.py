"""A varied subset: two-round lazy greedy maximisation of a facility-location objective.

The value of a subset is the sum, over all distinct vectors, of the greatest cosine with a member (at least 0). It is
submodular: a member near to what is there already adds little. In the first round every block of vectors nominates
as many candidates as the subset has members, by lazy greedy, and counts for each nominee the vectors it stands for. In the
final round one lazy greedy pass over the nominees, weighted by these counts, selects the subset. Where the blocks' nominees
are more than one pass can hold, blocks of nominees nominate again.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cinegrid.functions.vectors import matrix, packed, unit, unpacked
from cinegrid.scratch import written

WIDTH = 512
SIZE = 256
#: Vectors of one block, blocks of a task, and nominees of the final pass.
BLOCK = 4096
BLOCKS = 4
FINAL = 8192


def lazy_greedy(rows: np.ndarray, weight: np.ndarray, size: int, ids: np.ndarray) -> tuple[list[int], list[float], np.ndarray]:
    """The places of the selected rows in order, their gains, and of every row the place of the member that covers it.

    A gain only shrinks while the subset grows, so an old gain is a bound: only the candidate with the greatest bound
    is valued again. Ties go to the smaller id."""
    n = len(rows)
    if not n or size < 1:
        return [], [], np.full(n, -1)
    sims = rows @ rows.T
    np.maximum(sims, 0, out=sims)
    first = np.concatenate([sims[lo : lo + 512] @ weight for lo in range(0, n, 512)])  # in double, a part at a time
    heap = [(-g, int(i), p) for p, (g, i) in enumerate(zip(first, ids))]
    heapq.heapify(heap)
    covered, by = np.zeros(n, np.float32), np.full(n, -1)
    chosen, gains, fresh = [], [], np.zeros(n, np.int64)
    while heap and len(chosen) < min(size, n):
        bound, i, p = heapq.heappop(heap)
        if fresh[p] != len(chosen):
            gain = float(np.maximum(sims[p] - covered, 0) @ weight)
            fresh[p] = len(chosen)
            if heap and (-gain, i) > heap[0][:2]:
                heapq.heappush(heap, (-gain, i, p))
                continue
            bound = -gain
        chosen.append(p)
        gains.append(-bound)
        better = (sims[p] > covered) | (by < 0)
        by[better] = p
        covered = np.maximum(covered, sims[p])
    return chosen, gains, by


def _nominees(width: int, size: int):
    def run(key, vectors: pa.Table, wanted: pa.Table) -> pa.Table:
        weight_of = dict(zip(wanted.column("id").to_pylist(), wanted.column("weight").to_pylist()))
        ids = vectors.column("id").to_numpy()
        keep = np.array([i for i, k in enumerate(ids.tolist()) if k in weight_of], np.int64)
        keep = keep[np.argsort(ids[keep], kind="stable")]
        raw = vectors.column("vector").take(pa.array(keep))
        ids, rows = ids[keep], unit(unpacked(raw, width))
        weight = np.array([weight_of[i] for i in ids.tolist()], np.float64)
        chosen, _, by = lazy_greedy(rows, weight, size, ids)
        stands = np.bincount(by, weights=weight, minlength=len(ids)) if len(chosen) else np.zeros(0)
        at = np.array(chosen, np.int64)
        return pa.table({"id": pa.array(ids[at], pa.int64()), "vector": raw.take(pa.array(at)).combine_chunks().cast(pa.binary()), "weight": pa.array(stands[at], pa.float64())})

    return run


def _final(width: int, size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [b for b in batches if b.num_rows]
        if not parts:
            return
        t = pa.Table.from_batches(parts).sort_by("id")
        ids = t.column("id").to_numpy()
        rows = unit(unpacked(t.column("vector"), width))
        chosen, gains, by = lazy_greedy(rows, t.column("weight").to_numpy(), size, ids)
        stands = np.bincount(by, weights=t.column("weight").to_numpy(), minlength=len(ids))
        at = np.array(chosen)
        cells = [pa.array(np.arange(1, len(at) + 1, dtype=np.int32)), pa.array(ids[at]), pa.array(np.array(gains)), pa.array(np.rint(stands[at]).astype(np.int64))]
        yield pa.RecordBatch.from_arrays(cells, names=["rank", "id", "gain", "stands_for"])

    return run


def _packed(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, at = matrix(batch.column(1), width)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), pa.array(packed(rows), pa.binary())], names=["id", "vector"])

    return run


def varied(df: DataFrame, key: str, vector: str, among: DataFrame | None = None, size: int = SIZE, width: int = WIDTH, block: int = BLOCK, final: int = FINAL) -> DataFrame:
    """(rank, id, gain, stands_for): the subset in the order of selection, each member's gain and the number of distinct vectors
    that it covers best. Fewer than ``size`` distinct usable vectors come out all.

    ``among``: the keys (in its first column) that may be selected and count; all if None. Unusable vectors take no part; of
    equal vectors only the smallest key. ``key`` is a unique integer; columns besides the two are ignored; an empty input
    gives no rows.
    """
    if final < 2 * size or block < 2 * size:
        raise ValueError("block and final must be at least twice the size of the subset")
    rows = df.select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<float>").alias("v")).where("id is not null and v is not null").where(F.size("v") == width)
    good = rows.withColumns({"h1": F.xxhash64("v"), "h2": F.hash("v")})
    if among is not None:
        good = good.select("id", "h1", "h2").join(among.toDF("id", *among.columns[1:]).select("id").distinct(), "id", "left_semi")
    # one of equal vectors
    vectors = rows.mapInArrow(_packed(width), "id long, vector binary")
    wanted = written(good.groupBy("h1", "h2").agg(F.min("id").alias("id")).select("id", F.lit(1.0).alias("weight")), "wanted")
    n = wanted.count()
    while True:
        blocks = max(1, -(-n // (block * 3 // 4)))
        part = F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int").alias("part")
        if n <= final:
            break
        # as many tasks as the blocks ask for, whatever the session's number is
        tasks = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-blocks // BLOCKS))
        left = vectors.select("id", "vector", part).repartition(tasks, "part").groupBy("part")
        right = wanted.select("id", "weight", part).repartition(tasks, "part").groupBy("part")
        vectors = written(left.cogroup(right).applyInArrow(_nominees(width, size), "id long, vector binary, weight double"), "nominees")
        wanted = vectors.select("id", "weight")
        n = wanted.count()
    last = vectors if "weight" in vectors.columns else vectors.join(wanted, "id")
    return last.select("id", "vector", "weight").repartition(1).mapInArrow(_final(width, size), "rank int, id long, gain double, stands_for long")
