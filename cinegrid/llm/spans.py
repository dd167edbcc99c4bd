"""Long stretches that stand, character for character, in more than one text.

A Rabin-Karp hash is taken of every window of half the wanted length. Of all windows within any stretch of the wanted
length the one with the smallest hash stands for it; two equal stretches choose the same window, wherever they stand. The
chosen hashes are counted in Spark; where one occurs again, the text around it is fetched, and the rows of one hash are
compared with each other, left and right of the window. So every shared stretch of the wanted length is found, and
nothing else. Stretches of a text are merged into maximal intervals.

The rows of a window that stands very often (boilerplate) are not compared with each other: each is re-keyed by the hashes
of all stretches of the wanted length around it, which spreads them, and rows with the same stretch form a class. Classes of
the same rows are one. A class comes out as all its pairs, a large one in parts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cinegrid.llm.bpe import chunks
from cinegrid.operators.copies import class_pairs, paired
from cinegrid.scratch import written

MIN_LENGTH = 200
CHUNK_BYTES = 2_000_000
#: Rows of one hash that are compared with each other; beyond it they are re-keyed by whole stretches.
BLOCK_ROWS = 128
#: Up to so many ids or hashes (16 bytes each, so 8 MB) are broadcast; a longer side is joined by a shuffle.
BROADCAST_ROWS = 500_000

BASE = 0x9E3779B97F4A7C15 | 1

def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def _power(n: int) -> np.uint64:
    return np.uint64(pow(BASE, n, 1 << 64))


def window_hashes(codes: np.ndarray, width: int) -> np.ndarray:
    """The hash of every window of ``width`` codes: hashes of windows of 1, 2, 4, ... codes put together."""
    n = len(codes) - width + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    part, length, whole, done = _mixed(codes.astype(np.uint64) + np.uint64(1)), 1, None, 0
    # from the lowest bit of width on, each piece goes to the left of what is there
    while True:
        if width & length:
            at = width - done - length
            piece = part[at : at + n]
            whole = piece.copy() if whole is None else piece * _power(done) + whole
            done += length
        if done == width:
            return _mixed(whole)
        part = part[:-length] * _power(length) + part[length:]
        length *= 2


def _sliding(values: np.ndarray, width: int, least) -> np.ndarray:
    """``least`` (minimum or maximum) over every window of ``width`` values."""
    out, length = values, 1
    while length * 2 <= width:
        out = least(out[:-length], out[length:])
        length *= 2
    rest = width - length
    return least(out[: len(out) - rest], out[rest:]) if rest else out


def chosen(texts: list[str], min_length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(which text, position in it, hash) of the windows that stand for the stretches of ``min_length`` code points."""
    width = max(1, min_length // 2)
    reach = min_length - width + 1
    codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    ends = np.cumsum(lengths)
    none = np.empty(0, np.int64)
    if len(codes) < min_length:
        return none, none, none
    hashes = window_hashes(codes, width)
    lowest = _sliding(hashes, reach, np.minimum)
    # a stretch that runs over the end of its text stands for nothing
    inside = np.zeros(len(codes) + 1, np.int32)
    long = lengths >= min_length
    np.add.at(inside, (ends - lengths)[long], 1)
    np.add.at(inside, ends[long] - min_length + 1, -1)
    lowest = np.where(np.cumsum(inside)[: len(lowest)] > 0, lowest, np.uint64(0))
    padded = np.concatenate([np.zeros(reach - 1, np.uint64), lowest, np.zeros(reach - 1, np.uint64)])
    highest = _sliding(padded, reach, np.maximum)[: len(hashes)]
    at = np.flatnonzero((highest == hashes) & (hashes > 0))
    which = np.searchsorted(ends, at, side="right")
    return which, at - (ends - lengths)[which], hashes[at].view(np.int64)


def _fingerprints(min_length: int):
    side = min_length - max(1, min_length // 2)
    width = min_length - side
    names = ["hash", "doc", "pos", "also"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in chunks(batches, 1, CHUNK_BYTES):
            texts = chunk.column(1).to_pylist()
            which, pos, value = chosen(texts, min_length)
            order = np.lexsort((pos, value, which))
            which, pos, value = which[order], pos[order], value[order]
            again = np.zeros(len(which), bool)
            again[1:] = (which[1:] == which[:-1]) & (value[1:] == value[:-1])
            also: list[list[int] | None] = [None] * len(which)
            kept = np.ones(len(which), bool)
            first: dict[tuple, int] = {}
            # a window that stands repeatedly in one text with the same surroundings is one row
            repeated = again | np.concatenate([again[1:], [False]]) if len(again) else again
            for i in np.flatnonzero(repeated):
                t, p = texts[which[i]], int(pos[i])
                key = (int(which[i]), int(value[i]), t[max(0, p - side) : p + width + side], min(p, side))
                j = first.setdefault(key, int(i))
                if j != i:
                    kept[i] = False
                    if also[j] is None:
                        also[j] = []
                    also[j].append(p)
            docs = chunk.column(0).combine_chunks().take(pa.array(which[kept]))
            cells = [pa.array(value[kept]), docs, pa.array(pos[kept].astype(np.int32)), pa.array([a for a, k in zip(also, kept) if k], pa.list_(pa.int32()))]
            yield from pa.Table.from_arrays(cells, names=names).to_batches()

    return run


def _contexts(min_length: int):
    side = min_length - max(1, min_length // 2)
    width = min_length - side

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            docs, texts, found = batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist()
            out: list[list] = [[], [], [], [], [], []]
            for doc, text, rows in zip(docs, texts, found):
                for r in rows:
                    p = r["pos"]
                    for cell, x in zip(out, (r["hash"], doc, p, min(p, side), text[max(0, p - side) : p + width + side], r["also"])):
                        cell.append(x)
            types = [pa.int64(), batch.column(0).type, pa.int32(), pa.int32(), pa.string(), pa.list_(pa.int32())]
            cells = [pa.array(c, t) for c, t in zip(out, types)]
            yield from pa.Table.from_arrays(cells, names=["hash", "doc", "pos", "lead", "around", "also"]).to_batches(max_chunksize=8192)

    return run


def _stretches(min_length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            docs, places, leads, around, also = (c.to_pylist() for c in batch.columns)
            keys, owners, starts = [], [], []
            for doc, pos, lead, text, more in zip(docs, places, leads, around, also):
                key = window_hashes(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32), min_length).view(np.int64)
                for p in [pos, *(more or [])]:
                    keys.append(key)
                    owners.append(np.full(len(key), doc, np.int64))
                    starts.append(np.arange(p - lead, p - lead + len(key), dtype=np.int64))
            cells = [pa.array(np.concatenate(c) if c else np.empty(0, np.int64)) for c in (keys, owners, starts)]
            yield from pa.Table.from_arrays(cells, names=["key", "doc", "start"]).to_batches(max_chunksize=65536)

    return run


def _pairs_within(group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All pairs of places with the same value of the sorted ``group``."""
    first = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
    size = np.diff(np.concatenate([first, [len(group)]]))
    left, right = [], []
    for n in np.unique(size[size > 1]):
        i, j = np.triu_indices(n, 1)
        starts = first[size == n][:, None]
        left.append((starts + i).ravel())
        right.append((starts + j).ravel())
    none = np.empty(0, np.int64)
    return (np.concatenate(left), np.concatenate(right)) if left else (none, none)


def _shared(codes: np.ndarray, start: np.ndarray, lead: np.ndarray, size: np.ndarray, i: np.ndarray, j: np.ndarray, width: int, side: int):
    """For pairs of contexts: how far they agree left and right of the window, and whether the windows are equal."""
    steps = np.arange(side)
    top = len(codes) - 1

    def run(at: np.ndarray, step: np.ndarray, most: np.ndarray) -> np.ndarray:
        a = codes[np.clip(at[0][:, None] + step, 0, top)]
        b = codes[np.clip(at[1][:, None] + step, 0, top)]
        differs = a != b
        first = np.where(differs.any(axis=1), differs.argmax(axis=1), len(step))
        return np.minimum(first, most)

    mid = (start[i] + lead[i], start[j] + lead[j])
    back = run(tuple(m - 1 for m in mid), -steps, np.minimum(lead[i], lead[j]))
    tail = size - lead - width
    ahead = run(tuple(m + width for m in mid), steps, np.minimum(tail[i], tail[j]))
    same = run(mid, np.arange(width), np.full(len(i), width)) == width
    return back, ahead, same


def _compared(min_length: int, intervals: bool):
    side = min_length - max(1, min_length // 2)
    width = min_length - side

    def work(rows: pa.Table) -> pa.Table:
        i, j = _pairs_within(rows.column("hash").to_numpy())
        docs = rows.column("doc").to_numpy()
        other = docs[i] != docs[j]
        i, j = i[other], j[other]
        around = rows.column("around").to_pylist()
        size = np.fromiter(map(len, around), np.int64, len(around))
        start = np.concatenate([[0], np.cumsum(size)[:-1]])
        codes = np.frombuffer("".join(around).encode("utf-32-le", "surrogatepass"), np.uint32)
        lead, pos = rows.column("lead").to_numpy().astype(np.int64), rows.column("pos").to_numpy().astype(np.int64)
        good, backs, aheads = [], [], []
        for at in range(0, len(i), 20_000):
            back, ahead, same = _shared(codes, start, lead, size, i[at : at + 20_000], j[at : at + 20_000], width, side)
            ok = same & (back + ahead + width >= min_length)
            good.append(at + np.flatnonzero(ok))
            backs.append(back[ok])
            aheads.append(ahead[ok])
        keep = np.concatenate(good) if good else np.empty(0, np.int64)
        i, j = i[keep], j[keep]
        if not intervals:
            pairs = np.unique(np.stack([np.minimum(docs[i], docs[j]), np.maximum(docs[i], docs[j])]), axis=1)
            return pa.Table.from_arrays([pa.array(pairs[0]), pa.array(pairs[1])], names=["rep_a", "rep_b"])
        back, ahead = (np.concatenate(x) if x else np.empty(0, np.int64) for x in (backs, aheads))
        row, back, ahead = np.concatenate([i, j]), np.tile(back, 2), np.tile(ahead, 2)
        row, back, ahead = np.unique(np.stack([row, back, ahead]), axis=1)
        also = rows.column("also").to_pylist()
        out: list[tuple] = []
        for r, b, a in zip(row.tolist(), back.tolist(), ahead.tolist()):
            out += [(docs[r], p - b, p + width + a) for p in [pos[r], *(also[r] or [])]]
        columns = list(zip(*out)) or [(), (), ()]
        return pa.Table.from_arrays([pa.array(np.array(c, np.int64)) for c in columns], names=["doc", "start", "end"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            value = batch.column(0).to_numpy()
            new = np.flatnonzero(value != value[-1])
            cut = int(new[-1]) + 1 if len(new) else 0
            if held and (cut or held[-1].column(0)[-1] != batch.column(0)[0]):
                done = pa.Table.from_batches([*held, batch.slice(0, cut)])
                yield from work(done).to_batches()
                held = [batch.slice(cut)]
            elif not held and cut:
                yield from work(pa.Table.from_batches([batch.slice(0, cut)])).to_batches()
                held = [batch.slice(cut)]
            else:
                held.append(batch)
        if held:
            yield from work(pa.Table.from_batches(held)).to_batches()

    return run


def _bounded(df: DataFrame, rows: int) -> DataFrame:
    """Broadcast only if it has at most BROADCAST_ROWS rows; ``rows`` is its counted size."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df.hint("shuffle_hash")


class Spans:
    """The shared stretches of one table of texts.

    Null, empty and short texts share nothing. Equal texts are worked on once. The texts are taken as they are written, code
    point by code point. ``key`` is a unique integer; other columns are ignored.
    """

    def __init__(self, df: DataFrame, key: str, text: str, min_length: int = MIN_LENGTH):
        if min_length < 2:
            raise ValueError("min_length must be at least 2")
        self.min_length = min_length
        docs = df.select(F.col(key).cast("long").alias("doc"), F.col(text).alias("text")).where(F.length("text") >= min_length).where("doc is not null")
        # equal texts: only digests are shuffled
        digests = docs.select("doc", F.md5("text").alias("digest"))
        classes = digests.groupBy("digest").agg(F.min("doc").alias("rep"), F.count("*").alias("n")).where("n > 1")
        self.members = written(digests.join(classes, "digest").select("rep", F.col("doc").alias("id")), "members")
        others = self.members.where("id <> rep").select(F.col("id").alias("doc"))
        docs = docs.join(_bounded(others, others.count()), "doc", "left_anti")
        prints = docs.mapInArrow(_fingerprints(min_length), "hash long, doc long, pos int, also array<int>")
        prints = written(prints, "prints")
        again = prints.groupBy("hash").agg(F.count("*").alias("n")).where("n > 1")
        again = written(again, "again")
        # these sides grow with the data, so they are shuffled at every size
        found = prints.join(again.hint("merge"), "hash")
        found = found.groupBy("doc").agg(F.collect_list(F.struct("hash", "pos", "also")).alias("found"))  # bounded by the text's length
        around = docs.join(found.hint("merge"), "doc").select("doc", "text", "found")
        around = around.mapInArrow(_contexts(min_length), "hash long, doc long, pos int, lead int, around string, also array<int>")
        hot = again.where(F.col("n") > BLOCK_ROWS).select("hash")
        n_hot = hot.count()
        self.hot = None
        if n_hot:
            around = written(around, "around")
            hot = _bounded(hot, n_hot)
            stretches = around.join(hot, "hash").select("doc", "pos", "lead", "around", "also")
            stretches = written(stretches.mapInArrow(_stretches(min_length), "key long, doc long, start long").distinct(), "stretches")
            classes = stretches.groupBy("key").agg(F.min("doc").alias("first"), F.max("doc").alias("last"), F.count("*").alias("n"))
            self.hot = stretches.join(classes.where("first < last").drop("last"), "key")
            around = around.join(hot, "hash", "left_anti")
        order = ["hash", "doc", "pos", "lead", "around", "also"]
        self.around = around.select(*order).repartition("hash").sortWithinPartitions("hash", "doc", "pos")
        self.docs = df.select(F.col(key).cast("long").alias("doc"), F.length(text).alias("n_chars"))

    def links(self) -> DataFrame:
        """(rep_a, rep_b): different texts, by their representatives, with a stretch in common; each pair once."""
        pairs = self.around.mapInArrow(_compared(self.min_length, False), "rep_a long, rep_b long")
        if self.hot is not None:
            rows = self.hot.select("key", "doc").distinct()
            # the stretches inside a longer one have the same rows, which two sums of hashes, the count and the ends tell
            sums = [F.sum(F.xxhash64("doc", F.lit(seed)).cast("decimal(20,0)")).alias(f"s{seed}") for seed in (1, 2)]
            same = rows.groupBy("key").agg(*sums, F.count("*").alias("n"), F.min("doc").alias("first"), F.max("doc").alias("last"))
            same = same.groupBy("s1", "s2", "n", "first", "last").agg(F.min("key").alias("key")).select("key", "n")
            rows = written(rows.join(same, "key"), "hot")
            every = paired(rows.withColumnRenamed("doc", "rep_a"), rows.withColumnRenamed("doc", "rep_b"), "key", "n")
            pairs = pairs.unionByName(every.where("rep_a < rep_b").select("rep_a", "rep_b"))
        return pairs.distinct()

    def pairs(self, expand: int | None = None) -> DataFrame:
        """(a, b): rows with a stretch in common. Copies come out as all their pairs unless ``expand`` is given: see ``class_pairs``."""
        return class_pairs(self.members, self.links(), expand)

    def intervals(self) -> DataFrame:
        """(doc, start, end): the maximal stretches of each text that also stand in another row, end exclusive."""
        parts = self.around.mapInArrow(_compared(self.min_length, True), "doc long, start long, end long")
        if self.hot is not None:
            parts = parts.unionByName(self.hot.select("doc", "start", (F.col("start") + self.min_length).alias("end")))
        parts = parts.distinct()
        w = Window.partitionBy("doc").orderBy("start", "end")
        parts = parts.withColumn("reach", F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1)))
        parts = parts.withColumn("run", F.sum(F.when(F.col("start") <= F.col("reach"), 0).otherwise(1)).over(w))
        merged = parts.groupBy("doc", "run").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("run")
        # a text with copies is shared as a whole
        copied = self.members.select(F.col("id").alias("doc"), "rep")
        whole = copied.join(self.docs, "doc").select("doc", F.lit(0).cast("long").alias("start"), F.col("n_chars").cast("long").alias("end"))
        return merged.join(copied, "doc", "left_anti").unionByName(whole)

    def report(self) -> DataFrame:
        """(doc, n_chars, spans, shared_chars, share) of every row; null texts have 0 characters, no spans and share 0."""
        per = self.intervals().groupBy("doc").agg(F.count("*").alias("spans"), F.sum(F.col("end") - F.col("start")).alias("shared_chars"))
        n = F.coalesce(F.col("n_chars"), F.lit(0)).cast("long")
        none = F.lit(0).cast("long")
        rows = self.docs.join(per, "doc", "left").select("doc", n.alias("n_chars"), F.coalesce("spans", none).alias("spans"), F.coalesce("shared_chars", none).alias("shared_chars"))
        return rows.withColumn("share", F.coalesce(F.try_divide("shared_chars", "n_chars"), F.lit(0.0)))
