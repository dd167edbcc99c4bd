"""How often every term occurs and in how many rows, by burst tries.

A worker counts its terms in a burst trie: small tables of suffixes with two counters each hang on a tree of prefixes, and a
table that outgrows its limit bursts into one table per next character. So the tree grows deep only where terms are many. A
sample of the distinct terms gives the routes: prefixes, as long as need be, between which about equally many distinct terms
lie, however many terms begin alike. Each worker sends its subtrees along the routes; who receives a route merges the
subtrees and reads off the terms. Counters are added up before the shuffle, so a term in a third of all rows is one row per worker.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cinegrid.functions.words import runs
from cinegrid.scratch import written

#: Suffixes in a table before it bursts; terms that a worker holds before it sends its trie on.
LIMIT = 256
HELD = 400_000
#: Distinct terms of a route at most (about), and sampled terms per route, from which the routes are cut.
ROUTE = 50_000
SAMPLED = 16
#: Above every character.
TOP = "\U0010ffff"


class BurstTrie:
    """Counters (occurrences, rows) of terms."""

    def __init__(self, limit: int = LIMIT):
        self.limit = limit
        self.size = 0
        # a node is [burst, table]: table maps a suffix to [occurrences, rows], or once burst a character to a node
        self.top: list = [False, {}]

    def add(self, term: str, occurrences: int, rows: int) -> None:
        node, rest = self.top, term
        while node[0]:
            head, rest = rest[:1], rest[1:]
            node = node[1].setdefault(head, [False, {}])
            if not head:
                break
        table = node[1]
        cell = table.get(rest)
        if cell is None:
            table[rest] = [occurrences, rows]
            self.size += 1
            if len(table) > self.limit:
                self._burst(node)
        else:
            cell[0] += occurrences
            cell[1] += rows

    def _burst(self, node: list) -> None:
        nodes: dict = {}
        for suffix, cell in node[1].items():
            nodes.setdefault(suffix[:1], [False, {}])[1][suffix[1:]] = cell
        node[0], node[1] = True, nodes

    def tables(self) -> Iterator[tuple[str, dict]]:
        """(prefix, table of suffixes) of all leaves, in the order of the prefixes."""
        todo = [("", self.top)]
        while todo:
            prefix, node = todo.pop()
            if node[0]:
                todo += [(prefix + c, n) for c, n in sorted(node[1].items(), reverse=True)]
            elif node[1]:
                yield prefix, node[1]

    def items(self) -> Iterator[tuple[str, int, int]]:
        for prefix, table in self.tables():
            for suffix, (occurrences, rows) in table.items():
                yield prefix + suffix, occurrences, rows


def _subtrees(trie: BurstTrie) -> Iterator[pa.RecordBatch]:
    columns: list[list] = [[], [], [], []]
    names = ["prefix", "suffixes", "occurrences", "rows"]
    types = [pa.string(), pa.list_(pa.string()), pa.list_(pa.int64()), pa.list_(pa.int64())]

    def batch() -> pa.RecordBatch:
        out = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=names)
        for c in columns:
            c.clear()
        return out

    for prefix, table in trie.tables():
        cells = list(table.values())
        for c, x in zip(columns, (prefix, list(table), [v[0] for v in cells], [v[1] for v in cells])):
            c.append(x)
        if len(columns[0]) >= 512:
            yield batch()
    if columns[0]:
        yield batch()


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Subtrees of one worker; the row with a null prefix counts the rows that hold a term."""
    trie, holding = BurstTrie(), 0
    for batch in batches:
        words = batch.column(0)
        starts = words.offsets.to_numpy().astype(np.int64)
        coded = words.values.slice(starts[0], starts[-1] - starts[0]).dictionary_encode()
        code, terms = coded.indices.to_numpy().astype(np.int64), coded.dictionary.to_pylist()
        if not len(terms):
            continue
        row = np.repeat(np.arange(batch.num_rows), np.diff(starts))
        holding += int((np.diff(starts) > 0).sum())
        occurrences = np.bincount(code, minlength=len(terms))
        rows = np.bincount(np.unique(row * len(terms) + code) % len(terms), minlength=len(terms))
        for term, o, r in zip(terms, occurrences.tolist(), rows.tolist()):
            trie.add(term, o, r)
        if trie.size >= HELD:
            yield from _subtrees(trie)
            trie = BurstTrie()
    yield from _subtrees(trie)
    if holding:
        cells = [pa.array([None], pa.string()), pa.array([[]], pa.list_(pa.string())), pa.array([[]], pa.list_(pa.int64())), pa.array([[holding]], pa.list_(pa.int64()))]
        yield pa.RecordBatch.from_arrays(cells, names=["prefix", "suffixes", "occurrences", "rows"])


def routes(sample: list[str], n: int) -> list[str]:
    """At most ``n`` prefixes at which the sorted terms are cut, so that the sampled ones are spread evenly; each is as short as it can be
    and still stand above the sampled term before it."""
    sample, out = sorted(set(sample)), []
    for at in np.linspace(0, len(sample), n + 1).astype(int)[1:-1].tolist():
        if not 0 < at < len(sample):
            continue
        term, before = sample[at], sample[at - 1]
        length = next(i for i in range(1, len(term) + 1) if term[:i] > before)
        if not out or term[:length] > out[-1]:
            out.append(term[:length])
    return out


def _routed(cuts):
    """(route, terms, occurrences, rows): a subtree that lies between two cuts goes on as a whole, another one in parts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = cuts.value
        for batch in batches:
            out: list[list] = [[], [], [], []]
            for prefix, suffixes, occurrences, rows in zip(*(c.to_pylist() for c in batch.columns)):
                lo, hi = bisect.bisect_right(at, prefix), bisect.bisect_right(at, prefix + TOP)
                terms = [prefix + s for s in suffixes]
                if lo == hi:
                    parts = {lo: (terms, occurrences, rows)}
                else:
                    parts = {}
                    for t, o, r in zip(terms, occurrences, rows):
                        to = parts.setdefault(bisect.bisect_right(at, t), ([], [], []))
                        to[0].append(t)
                        to[1].append(o)
                        to[2].append(r)
                for route, cells in parts.items():
                    for c, x in zip(out, (route, *cells)):
                        c.append(x)
            types = [pa.int32(), pa.list_(pa.string()), pa.list_(pa.int64()), pa.list_(pa.int64())]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types)], names=["route", "terms", "occurrences", "rows"])

    return run


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Subtrees of the same route stand together; they are merged and read off when the route ends."""

    def read(trie: BurstTrie) -> Iterator[pa.RecordBatch]:
        terms, occurrences, rows = zip(*trie.items())
        t = pa.table({"term": pa.array(terms, pa.string()), "occurrences": pa.array(occurrences, pa.int64()), "rows": pa.array(rows, pa.int64())})
        yield from t.to_batches(max_chunksize=10_000)

    trie, route = BurstTrie(), None
    for batch in batches:
        for to, terms, occurrences, rows in zip(*(c.to_pylist() for c in batch.columns)):
            if to != route and trie.size:
                yield from read(trie)
                trie = BurstTrie()
            route = to
            for t, o, r in zip(terms, occurrences, rows):
                trie.add(t, o, r)
    if trie.size:
        yield from read(trie)


def frequencies(df: DataFrame, text: str, rare: int = 2, common: float = 0.1) -> DataFrame:
    """(term, occurrences, rows, mark): for every term of the column how often it occurs, in how many rows, and ``rare`` if in at
    most ``rare`` rows, else ``common`` if in more than the fraction ``common`` of the rows that hold a term, else null.

    Terms are the maximal runs of letters and digits of the lower-cased text. Null, empty and blank texts hold none.
    Repeated rows count as rows. Other columns are ignored. An empty table gives no rows.
    """
    spark = df.sparkSession
    # as many workers as there are partitions to read; the words are cut in the JVM
    subtrees = df.select(runs(F.col(text)).alias("words")).mapInArrow(_counted, "prefix string, suffixes array<string>, occurrences array<long>, rows array<long>")
    subtrees = written(subtrees, "subtrees")
    holding = subtrees.where("prefix is null").agg(F.coalesce(F.sum(F.get("rows", F.lit(0))), F.lit(0))).first()[0]
    trees = subtrees.where("prefix is not null")
    total = trees.agg(F.coalesce(F.sum(F.size("suffixes")), F.lit(0))).first()[0]
    n = max(4 * int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // ROUTE))
    step = max(1, total // (SAMPLED * n))
    terms = trees.select(F.explode(F.transform("suffixes", lambda s: F.concat("prefix", s))).alias("term"))
    sample = [r[0] for r in terms.where(F.pmod(F.xxhash64("term"), F.lit(step)) == 0).distinct().collect()]  # about SAMPLED per route
    paths = spark.sparkContext.broadcast(routes(sample, n))
    routed = trees.mapInArrow(_routed(paths), "route int, terms array<string>, occurrences array<long>, rows array<long>")
    merged = routed.repartition("route").sortWithinPartitions("route").mapInArrow(_merged, "term string, occurrences long, rows long")
    mark = F.when(F.col("rows") <= rare, "rare").when(F.col("rows") > common * F.lit(float(holding)), "common")
    return merged.withColumn("mark", mark)
