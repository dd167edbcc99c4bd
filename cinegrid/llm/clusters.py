"""Clusters of mutually similar vectors by hierarchical density clustering.

The neighbour graph: cross-polytope hashing puts every vector into one cell of each of TABLES tables; cells are cut into blocks
of at most BLOCK rows by ever deeper hashes. A block is compared in full. It gives the nearest ones of each of its rows,
from which the core cosines follow, and the spanning tree of greatest mutual reachability over its rows, which keeps whatever
the block's links join at any level. Each vector is also linked with the most similar one of a few hundred landmarks,
and the landmarks with each other, so the graph hangs together. A link's weight is the mutual reachability: the least of the
cosine and of both ends' core cosines (the cosine with the ``core``-th nearest; with ``core`` = 0 the plain cosine).

The spanning tree is built by Borůvka rounds on tables of links and members. In each round a component that has fewer than
``min_size`` vectors above its best link is contracted along it, its vectors remembering the weight at which they came. Such a
component could never be a cluster, so the condensed hierarchy loses nothing by it. What remains are components each of which
is a leaf of the condensed hierarchy; the tree over these, at most rows / min_size, is condensed on the driver: clusters
of greatest stability are selected, and of each the members that stay in it longest are its exemplars.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cinegrid.functions.vectors import matrix, packed, unit, unpacked
from cinegrid.llm.neighbours import _packed, paths
from cinegrid.scratch import written

WIDTH = 512
LANDMARKS = 384
ANCHORS = 4096
#: Tables of the neighbour graph, the hashes of a path, the rows of a block, about so many rows of a cell, and cells of a task.
TABLES = 2
DEPTH = 6
BLOCK = 4096
CELL = 8192
CELLS = 4
#: Sampled paths per cell, from which the cells' bounds are taken.
SAMPLED = 20
#: Tables of links of at most so many rows are contracted by one task; larger ones by rounds over tables. The result is the same.
LOCAL = 2_000_000
#: Steps of a weight in the hierarchy: one thousandth.
GRID = 1000
#: Vectors left over that are compared with the joined ones in one pass over these; more than the error of a cosine in single precision.
ASKED = 16_384
ROUNDING = 4e-6


def _exact(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Cosines of rows of ``x`` and ``y`` in double."""
    out = np.empty(len(x))
    for lo in range(0, len(x), 4096):
        a, b = (m[lo : lo + 4096].astype(np.float64) for m in (x, y))
        for m in (a, b):
            m /= np.abs(m).max(axis=1, keepdims=True)
        out[lo : lo + 4096] = np.einsum("ij,ij->i", a, b) / (np.sqrt(np.einsum("ij,ij->i", a, a)) * np.sqrt(np.einsum("ij,ij->i", b, b)))
    return out


def _reached(sims: np.ndarray, x: np.ndarray, y: np.ndarray, least: float) -> np.ndarray:
    """Where the cosines of ``x`` with ``y``, given in single precision, are at least ``least``; what is too near is taken in double."""
    good = sims >= least
    i, j = np.nonzero(np.abs(sims - least) < ROUNDING)
    good[i, j] = _exact(x[i], y[j]) >= least
    return good


def spanning(weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The ends of the spanning tree of greatest weights of a full symmetric matrix; the diagonal is not looked at."""
    n = len(weights)
    best, to, out = np.full(n, -np.inf, np.float32), np.zeros(n, np.int64), np.empty((max(n - 1, 0), 2), np.int64)
    outside, at = np.ones(n, bool), 0
    for step in range(n - 1):
        outside[at] = False
        best[at] = -np.inf
        better = outside & (weights[at] > best)
        best[better], to[better] = weights[at][better], at
        at = int(best.argmax())
        if not outside[at]:  # all that is left weighs -inf
            at = int(outside.argmax())
        out[step] = to[at], at
    return out[:, 0], out[:, 1]


def blocks(path: np.ndarray, depth: int, most: int) -> Iterator[tuple[int, int]]:
    """Cuts sorted paths into blocks of at most ``most`` rows, at the shallowest hash that will do; small neighbours share a block.
    A block has rows of one table. Rows that no hash tells apart are cut evenly, each part with the last row of the one before."""

    def cut(lo: int, hi: int, level: int) -> Iterator[tuple[int, int]]:
        if hi - lo <= most and level >= 0:
            yield lo, hi
            return
        if level == depth:
            edges = np.linspace(lo, hi, -(-(hi - lo) // (most - 1)) + 1).astype(int)
            yield from ((max(lo, int(a) - 1), int(b)) for a, b in zip(edges, edges[1:]))
            return
        part = path[lo:hi] >> np.uint64(8 * (depth - level - 1))
        starts = [lo, *(np.flatnonzero(part[1:] != part[:-1]) + 1 + lo).tolist()]
        begun = lo
        for a, b in zip(starts, [*starts[1:], hi]):
            if b - a > most or level < 0:
                if a > begun:
                    yield begun, a
                yield from cut(a, b, level + 1)
                begun = b
            elif b - begun > most:
                yield begun, a
                begun = a
        if hi > begun:
            yield begun, hi

    if len(path):
        yield from cut(0, len(path), -1)


def _paths_of(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, _ = matrix(batch.column(0), width)
            yield pa.RecordBatch.from_arrays([pa.array(_marked(paths(unit(rows), TABLES, DEPTH)).ravel())], names=["path"])

    return run


def _marked(found: np.ndarray) -> np.ndarray:
    """Paths with the table's number above their bits."""
    return found + (np.arange(TABLES, dtype=np.int64) << 8 * DEPTH)


def _placed(bounds, width: int):
    """(cell, path, id, vector): a row per table. Where several bounds are equal, many rows have that path, and the id spreads them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, at = matrix(batch.column(1), width)
            if not len(at):
                continue
            ids, cells = batch.column(0).to_numpy()[at], pa.array(packed(rows), pa.binary())
            for path in _marked(paths(unit(rows), TABLES, DEPTH)).T:
                lo, hi = (np.searchsorted(bounds.value, path, side) for side in ("left", "right"))
                spread = (ids.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)
                cell = lo + (spread % (hi - lo + 1).astype(np.uint64)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(cell.astype(np.int32)), pa.array(np.ascontiguousarray(path)), pa.array(ids), cells], names=["cell", "path", "id", "vector"])

    return run


#: Kinds of rows of the graph: links of blocks' trees, nearest ones, links with landmarks, links with anchors.
TREE, NEAR, STAR, ANCHOR = range(4)


def _compared(marks, width: int, core: int, reach: float, most: int):
    """(kind, a, b, weight) of rows sorted by cell and path; a nearest one has its owner as a, a link with an anchor its number as b."""

    def block(ids: np.ndarray, rows: np.ndarray) -> Iterator[tuple]:
        n = len(ids)
        if n < 2:
            return
        units = unit(rows)
        sims = units @ units.T
        np.fill_diagonal(sims, -np.inf)
        if core:
            some = min(core, n - 1)
            top = np.concatenate([np.argpartition(sims[lo : lo + 512], -some, axis=1)[:, -some:] for lo in range(0, n, 512)])
            at = np.repeat(np.arange(n), some)
            yield NEAR, ids[at], ids[top.ravel()], _exact(rows[at], rows[top.ravel()])
            of = np.take_along_axis(sims, top, axis=1).min(axis=1) if some == core else np.full(n, -1, np.float32)
            np.minimum(sims, of[:, None], out=sims)
            np.minimum(sims, of[None, :], out=sims)
        i, j = spanning(sims)
        yield TREE, np.minimum(ids[i], ids[j]), np.maximum(ids[i], ids[j]), _exact(rows[i], rows[j])

    def marked(ids: np.ndarray, rows: np.ndarray) -> Iterator[tuple]:
        """The links of the rows with landmarks and anchors."""
        keys, land, given = marks.value
        units = unit(rows)
        if len(keys):
            sims = units @ unit(land).T
            sims[ids[:, None] == keys[None, :]] = -np.inf
            to = sims.argmax(axis=1)
            good = np.isfinite(sims[np.arange(len(ids)), to])
            a, b = ids[good], keys[to[good]]
            yield STAR, np.minimum(a, b), np.maximum(a, b), _exact(rows[good], land[to[good]])
        if len(given):
            near = _reached(units @ unit(given).T, rows, given, reach)
            at = np.flatnonzero(near.any(axis=1))
            yield ANCHOR, ids[at], near[at].argmax(axis=1), np.full(len(at), reach)

    def piece(path: np.ndarray, ids: np.ndarray, cells: pa.Array) -> Iterator[pa.RecordBatch]:
        path = path.view(np.uint64)
        for lo, hi in blocks(path, DEPTH, most):
            rows, mine = unpacked(cells.slice(lo, hi - lo), width), ids[lo:hi]
            parts = list(block(mine, rows))
            first = path[lo:hi] >> np.uint64(8 * DEPTH) == 0
            if first.any():
                parts += marked(mine[first], rows[first])
            for kind, a, b, w in parts:
                cells_ = [pa.array(np.full(len(a), kind, np.int8)), pa.array(a), pa.array(b.astype(np.int64)), pa.array(w.astype(np.float64))]
                yield pa.RecordBatch.from_arrays(cells_, names=["kind", "a", "b", "weight"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        size, cell = 0, None

        def done() -> Iterator[pa.RecordBatch]:
            t = pa.concat_tables(held).combine_chunks()
            yield from piece(*(t.column(c).combine_chunks().to_numpy() for c in ("path", "id")), t.column("vector").combine_chunks())

        for batch in batches:
            t = pa.Table.from_batches([batch])
            of = batch.column(0).to_numpy()
            cuts = [0, *(np.flatnonzero(of[1:] != of[:-1]) + 1).tolist(), len(of)]
            for a, b in zip(cuts, cuts[1:]):
                if b == a:
                    continue
                if held and (cell != of[a] or size > 4 * CELL):
                    yield from done()
                    # a cell that is cut goes on with its last row
                    held, size = [held[-1].slice(held[-1].num_rows - 1)] if cell == of[a] else [], 0
                held.append(t.slice(a, b - a))
                size, cell = size + b - a, of[a]
        if held:
            yield from done()

    return run


@dataclass
class Graph:
    """The neighbour graph. ``anchored``: (id, label) of the rows with a link of at least ``reach`` to an anchor, the first given."""

    rows: DataFrame  # (id, v)
    edges: DataFrame  # (a, b, weight), a < b
    anchored: DataFrame
    names: list[tuple[int, str]]
    width: int
    reach: float
    local: int


def graph(df: DataFrame, key: str, vector: str, anchors: list[tuple[str, np.ndarray]] | None = None, core: int = 0, reach: float = 0.42, width: int = WIDTH, landmarks: int = LANDMARKS, block: int = BLOCK, local: int = LOCAL) -> Graph:
    """The neighbour graph of the usable vectors of ``df``, and their links with the anchors (label, vector).

    Unusable vectors and anchors take no part; of equal vectors one can be a landmark. Vectors of any length count by direction.
    ``key`` is a unique integer, null keys take no part; other columns are ignored. An empty input gives an empty graph.
    """
    spark = df.sparkSession
    rows = df.select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<float>").alias("v")).where("id is not null and v is not null").where(F.size("v") == width)
    anchors = [(l, v) for l, v in anchors or [] if v is not None and len(v) == width and np.isfinite(v).all() and np.any(v)]
    if len(anchors) > ANCHORS:
        raise ValueError(f"more than {ANCHORS} anchors")
    given = np.array([v for _, v in anchors], np.float32).reshape(-1, width)
    n = max(1, df.count())

    def sampled(column: str, share: float) -> Column:
        return F.pmod(F.xxhash64(column), F.lit(1 << 30)) < int(min(1.0, share) * (1 << 30))

    # about three times as many as are wanted reach the order by hash
    some = rows.where(sampled("v", 3 * landmarks / n)).withColumn("h", F.xxhash64("v"))
    some = some.groupBy("h").agg(F.min_by(F.struct("id", "v"), "id").alias("s")).orderBy("h").limit(landmarks).select("s.id", "s.v").toArrow()
    land, at = matrix(some.column(1), width)
    keys = some.column(0).to_numpy()[at]
    cells = -(-n * TABLES // CELL)
    bounds = np.empty(0, np.int64)
    if cells > 1:
        found = rows.where(sampled("id", SAMPLED * cells / n)).select("v").mapInArrow(_paths_of(width), "path long").toArrow().column(0).to_numpy()
        bounds = np.sort(found)[np.linspace(0, max(len(found) - 1, 0), cells + 1).astype(int)[1:-1]] if len(found) else bounds
    share = spark.sparkContext.broadcast
    made = rows.mapInArrow(_placed(share(bounds), width), "cell int, path long, id long, vector binary")
    # as many tasks as the rows ask for, whatever the session's number is
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-cells // CELLS))
    made = made.repartitionById(tasks, F.pmod("cell", F.lit(tasks))).sortWithinPartitions("cell", "path", "id")
    made = made.mapInArrow(_compared(share((keys, land, given)), width, core, reach, block), "kind byte, a long, b long, weight double")
    made = written(made, "graph")
    edges = made.where(F.col("kind").isin(TREE, STAR)).select("a", "b", "weight")
    if len(keys) > 1:
        sims = unit(land) @ unit(land).T
        i, j = spanning(sims)
        a, b = np.minimum(keys[i], keys[j]), np.maximum(keys[i], keys[j])
        among = zip(a.tolist(), b.tolist(), _exact(land[i], land[j]).tolist())
        edges = edges.unionByName(spark.createDataFrame(list(among), "a long, b long, weight double"))
    # two tables may give one link
    edges = edges.groupBy("a", "b").agg(F.max("weight").alias("weight"))
    if core:
        near = made.where(F.col("kind") == NEAR).groupBy("a", "b").agg(F.max("weight").alias("weight"))
        near = near.groupBy("a").agg(F.sort_array(F.collect_list("weight"), asc=False).alias("w"))  # at most core * TABLES values
        near = written(near.select(F.col("a").alias("id"), F.coalesce(F.get("w", F.lit(core - 1)), F.lit(-1.0)).alias("core")), "cores")
        for end in ("a", "b"):
            edges = edges.join(near.withColumnRenamed("id", end).withColumnRenamed("core", f"core_{end}"), end, "left")
        edges = edges.select("a", "b", F.least("weight", *(F.coalesce(f"core_{e}", F.lit(-1.0)) for e in ("a", "b"))).alias("weight"))
    anchored = made.where(F.col("kind") == ANCHOR).select(F.col("a").alias("id"), F.col("b").cast("int").alias("label"))
    return Graph(rows, written(edges, "edges"), anchored, [(i, l) for i, (l, _) in enumerate(anchors)], width, reach, local)


# -- Borůvka rounds

def rounds(n: int, a: np.ndarray, b: np.ndarray, w: np.ndarray, held: tuple[np.ndarray, np.ndarray, np.ndarray] | None = None, min_size: int | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Contracts nodes 0..n-1 along their best links, round by round: (root of each node, the weight at which it came, the links used).

    ``held``: (node, weight, how many): the vectors that each node holds and the weight at which they came. A node that holds at
    least ``min_size`` vectors above its best link stays; if it is None none stays. Links are ordered by weight, then by
    their ends, so that rounds can't close a cycle."""
    order = np.lexsort((b, a, -w))
    a, b, w = a[order].copy(), b[order].copy(), w[order]
    root, came, used = np.arange(n), np.full(n, np.inf), [np.empty(0, np.int64)]
    if held is not None:
        node, height, count = (np.array(x) for x in held)
    while True:
        open_ = np.flatnonzero(a != b)
        best = np.full(n, len(a))
        for end in (a, b):
            other = np.full(n, len(a))
            other[end[open_][::-1]] = open_[::-1]  # the last one assigned is the best
            best = np.minimum(best, other)
        light = best < len(a)
        top = np.where(light, w[np.minimum(best, len(a) - 1)], -np.inf) if len(a) else np.full(n, -np.inf)
        if min_size is not None:
            light &= np.bincount(node, count * (height > top[node]), n) < min_size
        x = np.flatnonzero(light)
        if not len(x):
            return root, came, order[np.concatenate(used)]
        parent = np.arange(n)
        parent[x] = np.where(a[best[x]] == x, b[best[x]], a[best[x]])
        twice = x[(parent[parent[x]] == x) & (x < parent[x])]
        parent[twice] = twice
        moved = parent != np.arange(n)
        used.append(best[np.flatnonzero(moved)])
        while (parent[parent] != parent).any():
            parent = parent[parent]
        came = np.where(moved[root], np.minimum(came, top[root]), came)
        root = parent[root]
        if held is not None:
            height = np.where(moved[node], np.minimum(height, top[node]), height)
            node = parent[node]
        a, b = parent[a], parent[b]


LINK, HELD, CAME = range(3)


def _local(min_size: int | None):
    """Rows (kind, a, b, weight): links and holdings in; where each node came to, and the links of the tree over what remains, out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [b for b in batches if b.num_rows]
        if not parts:
            return
        kind, a, b, w = (c.to_numpy() for c in pa.Table.from_batches(parts).columns)
        link, mine = kind == LINK, kind == HELD
        names = np.unique(np.concatenate([a, b[link]]))
        x, y = np.searchsorted(names, a[link]), np.searchsorted(names, b[link])
        held = (np.searchsorted(names, a[mine]), w[mine], b[mine].astype(np.float64)) if min_size is not None else None
        root, came, _ = rounds(len(names), x, y, w[link], held, min_size)
        _, _, used = rounds(len(names), root[x], root[y], w[link])
        out = [(np.full(len(names), CAME), names, names[root], came), (np.full(len(used), LINK), names[root[x][used]], names[root[y][used]], w[link][used])]
        for c in out:
            cells = [pa.array(c[0].astype(np.int8)), pa.array(c[1]), pa.array(c[2]), pa.array(c[3])]
            yield pa.RecordBatch.from_arrays(cells, names=["kind", "a", "b", "weight"])

    return run


def contracted(edges: DataFrame, members: DataFrame, min_size: int | None, local: int = LOCAL) -> tuple[DataFrame, DataFrame]:
    """((id, node, height), (a, b, weight)): the component of each vector when no light one is left, with the weight at which the vector
    came to it (infinite for the component's own), and the spanning tree over the components.

    ``members``: (id, node, height) to begin with. ``min_size`` None: all that hangs together becomes one component."""
    members = members.select("id", "node", "height")

    def holdings() -> DataFrame:
        return members.groupBy("node", "height").count()

    while True:
        size = edges.count() + (holdings().count() if min_size is not None else 0)
        if size <= local:
            break
        up = _best(edges, members, min_size)
        if not up.limit(1).count():
            break
        members, edges = _moved(members, up), _relabelled(edges, up)
    table = edges.select(F.lit(LINK).cast("byte").alias("kind"), "a", "b", "weight")
    if size > local:  # every component stays: only the tree over them is left to be found
        n = table.count()
        while n > local:
            table = written(table.repartition(-(-n // local)).mapInArrow(_tree, table.schema), "links")
            before, n = n, table.count()
            if 2 * n > before:
                break
        return members, written(table.repartition(1).mapInArrow(_tree, table.schema), "tree").select("a", "b", "weight")
    if min_size is not None:
        table = table.unionByName(holdings().select(F.lit(HELD).cast("byte").alias("kind"), F.col("node").alias("a"), F.col("count").alias("b"), F.col("height").alias("weight")))
    out = written(table.repartition(1).mapInArrow(_local(min_size), "kind byte, a long, b long, weight double"), "local")
    came = out.where(F.col("kind") == CAME).where("a <> b").select(F.col("a").alias("x"), F.col("b").alias("y"), "weight")
    return _moved(members, came), out.where(F.col("kind") == LINK).select("a", "b", "weight")


def _tree(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The spanning forest of the links of one partition."""
    parts = [b for b in batches if b.num_rows]
    if parts:
        t = pa.Table.from_batches(parts)
        a, b, w = (t.column(c).to_numpy() for c in ("a", "b", "weight"))
        names = np.unique(np.concatenate([a, b]))
        _, _, used = rounds(len(names), np.searchsorted(names, a), np.searchsorted(names, b), w)
        yield from t.take(pa.array(used)).to_batches()


def _best(edges: DataFrame, members: DataFrame, min_size: int | None) -> DataFrame:
    """(x, y, weight): each light component, where it comes to in this round, and the weight of its best link."""
    both = edges.select(F.col("a").alias("x"), F.col("b").alias("y"), "weight").unionByName(edges.select(F.col("b").alias("x"), F.col("a").alias("y"), "weight"))
    order = F.struct("weight", (-F.least("x", "y")).alias("s"), (-F.greatest("x", "y")).alias("t"))
    best = both.groupBy("x").agg(F.max_by(F.struct("y", "weight"), order).alias("s")).select("x", "s.y", "s.weight")
    if min_size is not None:
        best = written(best, "best")
        mass = members.join(best.select(F.col("x").alias("node"), "weight"), "node").groupBy("node").agg(F.count_if(F.col("height") > F.col("weight")).alias("mass"))
        best = best.join(mass.where(F.col("mass") < min_size).select(F.col("node").alias("x")), "x", "left_semi")
    up = written(best, "best")
    back = up.select(F.col("x").alias("y"), F.col("y").alias("back"))
    up = up.join(back, "y", "left").where("back is null or back <> x or x > y").select("x", "y", "weight")
    while True:
        up = written(up, "up")
        beyond = up.select(F.col("x").alias("y"), F.col("y").alias("beyond"))
        if not up.join(beyond, "y", "left_semi").limit(1).count():
            return up
        up = up.join(beyond, "y", "left").select("x", F.coalesce("beyond", "y").alias("y"), "weight")


def _moved(members: DataFrame, up: DataFrame) -> DataFrame:
    to = members.join(up.withColumnRenamed("x", "node"), "node", "left")
    return written(to.select("id", F.coalesce("y", "node").alias("node"), F.least("height", F.coalesce("weight", "height")).alias("height")), "members")


def _relabelled(edges: DataFrame, up: DataFrame) -> DataFrame:
    for end in ("a", "b"):
        edges = edges.join(up.select(F.col("x").alias(end), F.col("y").alias("to")), end, "left").withColumn(end, F.coalesce("to", end)).drop("to")
    edges = edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "weight")
    return written(edges.groupBy("a", "b").agg(F.max("weight").alias("weight")), "edges")


# -- chains to anchors

def joined_to_anchors(g: Graph) -> DataFrame:
    """(id, label): the vectors that a chain of links of at least ``reach`` joins to an anchor. If vectors next to each other
    are joined to two anchors, the one given first counts.

    The graph, cut at ``reach``, gives the chains that lead over its links. The vectors left over are then compared with all
    joined ones, in blocks; what is newly joined, with all of its component, is compared with the rest, and so on until
    nothing is added; so no chain is lost. That check's work is the left over times the joined vectors.
    """
    spark = g.rows.sparkSession
    start = g.rows.select("id", F.col("id").alias("node"), F.lit(float("inf")).alias("height"))
    nodes, _ = contracted(g.edges.where(F.col("weight") >= g.reach), start, None, g.local)
    label = F.min("label").alias("label")
    new = written(nodes.join(g.anchored.join(nodes.select("id", "node"), "id").groupBy("node").agg(label), "node").select("id", "label"), "joined")
    found = new
    size = new.count()
    while size:
        left = written(nodes.select("id").join(found.select("id"), "id", "left_anti"), "left")
        parts = -(-left.count() // ASKED)
        step = None
        for part in range(parts):
            asked = left.where(F.pmod(F.xxhash64("id"), F.lit(parts)) == part)
            got = g.rows.join(F.broadcast(asked), "id", "left_semi").select("id", "v").mapInArrow(_packed(g.width), "id long, vector binary").toArrow()
            if not got.num_rows:
                continue
            shared = spark.sparkContext.broadcast((got.column("id").to_numpy(), got.column("vector").combine_chunks()))
            near = g.rows.join(new, "id").select("id", "v", "label").mapInArrow(_next_to(shared, g.width, g.reach), "id long, label int")
            near = written(near.groupBy("id").agg(label), "near")
            shared.destroy()
            step = near if step is None else step.unionByName(near)
        if step is None or not step.limit(1).count():
            break
        # with a vector all of its component is joined
        of = step.join(nodes.select("id", "node"), "id").groupBy("node").agg(label)
        new = written(nodes.join(of, "node").select("id", "label"), "joined")
        found, size = found.unionByName(new), new.count()
    names = spark.createDataFrame(g.names, "label int, name string")
    return found.join(F.broadcast(names), "label").select("id", F.col("name").alias("label"))


def _next_to(shared, width: int, least: float):
    """(id, label): the broadcast vectors that have a link of at least ``least`` to a row, with the smallest label of such rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, cells = shared.value
        vectors = unpacked(cells, width)
        asked = unit(vectors)
        best = np.full(len(keys), np.iinfo(np.int32).max, np.int32)
        for batch in batches:
            rows, at = matrix(batch.column(1), width)
            label = batch.column(2).to_numpy()[at]
            for lo in range(0, len(rows), 2048):
                part, own = rows[lo : lo + 2048], label[lo : lo + 2048]
                units = unit(part)
                for q in range(0, len(keys), 2048):
                    linked = _reached(asked[q : q + 2048] @ units.T, vectors[q : q + 2048], part, least)
                    for l in np.unique(own):
                        hit = q + np.flatnonzero(linked[:, own == l].any(axis=1))
                        best[hit] = np.minimum(best[hit], l)
        hit = np.flatnonzero(best < np.iinfo(np.int32).max)
        yield pa.RecordBatch.from_arrays([pa.array(keys[hit]), pa.array(best[hit])], names=["id", "label"])

    return run


# -- the condensed hierarchy

def _density(s: np.ndarray | float):
    return 1 / np.maximum(1 - np.asarray(s, np.float64), 1e-3)


def condensed(links: tuple[np.ndarray, np.ndarray, np.ndarray], held: tuple[np.ndarray, np.ndarray, np.ndarray], n: int, min_size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each leaf 0..n-1 its selected cluster (-1: none), the weight at which that cluster is born, and the one at which it splits
    (of a leaf: up to which ``min_size`` of its vectors hang together). ``held``: (leaf, weight, how many): the vectors that came to
    the leaf at that weight.

    Every leaf holds ``min_size`` vectors above its best link, so each merge of the tree joins two clusters. A cluster that
    never merges is chosen only if it has no clusters below."""
    heights, at = np.unique(held[1], return_inverse=True)
    density = _density(heights)
    order = np.argsort(held[0], kind="stable")
    bounds = np.searchsorted(held[0][order], np.arange(n + 1))
    total = n + len(links[0])
    birth, split = np.full(total, -2.0), np.ones(total)
    kids, up = {}, np.full(total, -1)
    top = list(range(n))

    def root(x: int) -> int:
        while top[x] != x:
            top[x] = top[top[x]]
            x = top[x]
        return x

    for c, k in enumerate(np.argsort(-links[2], kind="stable"), n):
        a, b, s = root(int(links[0][k])), root(int(links[1][k])), float(links[2][k])
        top.append(c)
        top[a] = top[b] = c
        kids[c], split[c] = (a, b), s
        birth[[a, b]], up[[a, b]] = s, c
    stability, size, table = np.zeros(total), np.zeros(total), {}
    for c in range(total):
        if c < n:
            mine = order[bounds[c] : bounds[c + 1]]
            table[c] = np.bincount(at[mine], held[2][mine], len(heights))
            split[c] = heights[np.flatnonzero(np.cumsum(table[c][::-1])[::-1] >= min_size)[-1]]
        else:
            a, b = kids[c]
            table[c] = table.pop(a) + table.pop(b)
        stay = np.minimum(density, _density(split[c])) - _density(max(birth[c], -1.0))
        inside = heights > birth[c]
        stability[c] = (table[c] * np.maximum(stay, 0))[inside].sum()
        size[c] = table[c][inside].sum()
    chosen, value = np.zeros(total, bool), stability.copy()
    for c in range(total):
        below = value[list(kids[c])].sum() if c in kids else 0.0
        if c in kids and (below > stability[c] or up[c] < 0):
            value[c] = below
        else:
            chosen[c] = size[c] >= min_size
    cluster, born, stays = np.full(n, -1), np.full(n, np.inf), np.full(n, -np.inf)
    of = np.full(total, -1)
    for c in range(total - 1, -1, -1):
        of[c] = of[up[c]] if up[c] >= 0 and of[up[c]] >= 0 else c if chosen[c] else -1
        if c < n and of[c] >= 0:
            cluster[c], born[c], stays[c] = of[c], birth[of[c]], split[of[c]]
    return cluster, born, stays


def clustered(g: Graph, min_size: int) -> DataFrame:
    """(id, cluster, persistence, weight): the members of the selected clusters. ``weight`` is the weight at which the vector comes
    to its component, ``persistence`` the one up to which it stays in its cluster. A cluster's number is the smallest id in it.
    Vectors in no cluster (noise) have no row. The driver holds at most rows / min_size components."""
    spark = g.rows.sparkSession
    edges = written(g.edges.select("a", "b", (F.floor(F.least(F.col("weight"), F.lit(1.0)) * GRID) / GRID).alias("weight")), "steps")
    ends = edges.select(F.col("a").alias("id")).union(edges.select("b")).distinct()
    start = written(ends.select("id", F.col("id").alias("node"), F.lit(float("inf")).alias("height")), "members")
    members, tree = contracted(edges, start, min_size, g.local)
    members = members.withColumn("height", F.least("height", F.lit(1.0)))
    enough = members.groupBy("node").agg(F.count("*").alias("n")).where(F.col("n") >= min_size).select("node")
    held = members.join(enough, "node", "left_semi").groupBy("node", "height").count().toArrow()
    names = np.unique(held.column(0).to_numpy())
    links = tree.toArrow()
    a, b, w = (np.asarray(c.to_numpy()) for c in links.columns)
    kept = np.isin(a, names) & np.isin(b, names)
    ends_ = (np.searchsorted(names, a[kept]), np.searchsorted(names, b[kept]), w[kept])
    cluster, born, stays = condensed(ends_, (np.searchsorted(names, held.column(0).to_numpy()), held.column(1).to_numpy(), held.column(2).to_numpy()), len(names), min_size)
    rows = [(int(names[i]), int(cluster[i]), float(born[i]), float(stays[i])) for i in range(len(names)) if cluster[i] >= 0]
    of = spark.createDataFrame(rows, "node long, cluster int, born double, stays double")
    inside = written(members.join(of, "node").where("height > born"), "inside")
    named = inside.groupBy("cluster").agg(F.min("id").alias("name"))
    return inside.join(named, "cluster").select("id", F.col("name").alias("cluster"), F.least("height", "stays").alias("persistence"), F.col("height").alias("weight"))


def described(members: DataFrame, exemplars: int = 5) -> DataFrame:
    """(cluster, size, exemplars array<long>): the most persistent members first, ties by their own weight, then by id."""
    order = (F.desc("persistence"), F.desc("weight"), F.asc("id"))
    salted = members.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(64)))
    some = salted.withColumn("r", F.row_number().over(Window.partitionBy("cluster", "salt").orderBy(*order))).where(F.col("r") <= exemplars)
    best = some.withColumn("r", F.row_number().over(Window.partitionBy("cluster").orderBy(*order))).where(F.col("r") <= exemplars)
    best = best.groupBy("cluster").agg(F.transform(F.array_sort(F.collect_list(F.struct("r", "id"))), lambda x: x["id"]).alias("exemplars"))
    return members.groupBy("cluster").agg(F.count("*").alias("size")).join(best, "cluster").select("cluster", "size", "exemplars")
