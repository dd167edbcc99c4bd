"""Filling containers of fixed capacity with items of varying length: bulk-synchronous best fit.

Lengths are whole numbers up to the capacity, so equal items are interchangeable, and so are containers with equal free space
(gaps). The state of the packing is therefore two sorted lists of runs, (length, how many items) and (gap, how many
containers), whose size the capacity bounds, whatever the number of rows. In each step one run of items, from the longest
down, meets its successors among the gaps: the smallest gap that holds it, then the next one. Where a run of items
is longer than a run of gaps can take, the items of lower rank win and the rest goes to the next gap, at last to new
containers; the gaps are updated; and so on. The steps give a plan of runs "items of this length with ranks from a to b
go to containers from c on". The rows are ranked by a distributed sort (per bucket, with offsets) and find their run in
the plan by their length and rank.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cinegrid.scratch import written

CAPACITY = 2048
#: Rows of one bucket of the distributed ranking.
BUCKET_ROWS = 200_000


def plan(sizes: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int]]:
    """Runs (length, first rank, how many, first container, where in the container the item starts).

    ``sizes``: how many items there are of each length from 1 to ``capacity``. Containers have ids from 0 on.
    """
    runs: dict[int, list[tuple[int, int]]] = {}  # gap -> runs of containers (first id, how many)
    gaps: list[int] = []  # the gaps that have runs, ascending
    steps, containers = [], 0

    def add(gap: int, first: int, n: int) -> None:
        if gap not in runs:
            runs[gap] = []
            bisect.insort(gaps, gap)
        runs[gap].append((first, n))

    for size in sorted(sizes, reverse=True):
        rank, left = 0, sizes[size]
        while left:
            at = bisect.bisect_left(gaps, size)
            if at < len(gaps):
                gap = gaps[at]
                first, n = runs[gap].pop()
                if not runs[gap]:
                    del runs[gap], gaps[at]
            else:  # no gap holds it: new containers, as many as the rest can need
                gap, first, n = capacity, containers, left
            # what is left in a container is the next item's best fit, so each is filled before the next one is begun
            each = gap // size
            full = min(n, left // each)
            rest = left - full * each if full < n else 0
            for some, items in ((full, each), (1, rest)):
                if not some or not items:
                    continue
                for k in range(items):
                    steps.append((size, rank, some, first, capacity - gap + k * size))
                    rank += some
                if gap > items * size:
                    add(gap - items * size, first, some)
                first, n, left = first + some, n - some, left - some * items
            if gap == capacity:
                containers = first
            elif n:
                add(gap, first, n)
    return steps


def packed(lengths: DataFrame, key: str, length: str, capacity: int = CAPACITY) -> DataFrame:
    """(key, part int, start, n, container, offset): the stretch of ``n`` units from ``start`` of the item lies in the
    container from ``offset`` on. An item is split only if it is longer than the capacity: then into full containers and a
    rest. Items of length 0 (null counts as 0) take no room and lie in container 0. Null keys are kept, repeated rows are
    items of their own; ties are ranked by key. An empty input gives no rows. Other columns are ignored.
    """
    if capacity < 1:
        raise ValueError("capacity must be at least 1")
    spark = lengths.sparkSession
    rows = lengths.select(F.col(key).alias("id"), F.greatest(F.coalesce(F.col(length), F.lit(0)), F.lit(0)).cast("long").alias("n"))
    parts = F.greatest(F.lit(1), F.ceil(F.col("n") / capacity)).cast("int")
    items = rows.select("id", F.explode(F.sequence(F.lit(0), parts - 1)).alias("part"), "n")
    start = F.col("part").cast("long") * capacity
    items = items.select("id", "part", start.alias("start"), F.least(F.col("n") - start, F.lit(capacity)).cast("int").alias("size"))
    items = written(items, "items")
    n_rows = items.count()
    buckets = max(1, -(-n_rows // BUCKET_ROWS))
    items = items.withColumn("bucket", F.pmod(F.xxhash64("id", "part"), F.lit(buckets)).cast("int"))
    runs = items.groupBy("size", "bucket").count()
    before = F.sum("count").over(Window.partitionBy("size").orderBy("bucket")) - F.col("count")
    runs = runs.select("size", "bucket", "count", before.alias("before"))
    # at most ``capacity`` lengths, whatever the number of rows
    sizes = {r["size"]: r["n"] for r in runs.groupBy("size").agg(F.sum("count").alias("n")).collect()}
    sizes.pop(0, None)
    steps = np.array(plan(sizes, capacity), np.int64).reshape(-1, 5)
    order = np.lexsort((steps[:, 1], steps[:, 0]))
    shared = spark.sparkContext.broadcast(steps[order])

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        steps = shared.value
        width = int(steps[:, 1].max(initial=0) + steps[:, 2].max(initial=0)) + 1
        keys = steps[:, 0] * width + steps[:, 1]
        for batch in batches:
            size, rank = batch.column(3).to_numpy().astype(np.int64), batch.column(4).to_numpy()
            zero = size == 0
            at = np.searchsorted(keys, size * width + rank, side="right") - 1
            run = steps[np.maximum(at, 0)] if len(steps) else np.zeros((len(size), 5), np.int64)
            container = np.where(zero, 0, run[:, 3] + rank - run[:, 1])
            offset = np.where(zero, 0, run[:, 4])
            columns = [*batch.columns[:3], pa.array(size), pa.array(container), pa.array(offset)]
            yield pa.RecordBatch.from_arrays(columns, names=[key, "part", "start", "n", "container", "offset"])

    within = F.row_number().over(Window.partitionBy("bucket", "size").orderBy("id", "part")) - 1
    ranked = items.where("size > 0").withColumn("within", within).join(runs.select("size", "bucket", "before"), ["size", "bucket"])
    ranked = ranked.select("id", "part", "start", "size", (F.col("before") + F.col("within")).cast("long").alias("rank"))
    ranked = ranked.unionByName(items.where("size = 0").select("id", "part", "start", "size", F.lit(0).cast("long").alias("rank")))
    kind = lengths.schema[key].dataType.simpleString()
    return ranked.mapInArrow(place, f"`{key}` {kind}, part int, start long, n long, container long, offset long")
