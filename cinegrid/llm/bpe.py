"""Byte-pair encoding of a whole corpus with the vocabulary of a public tokenizer.

A partition's texts are cut into pieces by the tokenizer's pattern; its distinct pieces are encoded together through a pair
occurrence index: every pair that has a rank is mapped to all its places in the distinct pieces, the active ranks are applied
in ascending order, each to all its places at once, and every merge updates the lists of the pairs it touches. Texts
then gather the ids of their pieces. There is no shuffle: encoding is one pass over the rows.
"""

from __future__ import annotations

import heapq
import itertools
import json
import os
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Where the vocabulary files lie.
TOKENIZERS = os.environ.get("CINEGRID_TOKENIZERS", "/opt/tokenizers")
VOCABULARY = "byte_bpe_50k.json"

#: Fixed value: the pattern that cuts a text into pieces before any merge. {w} stands for the Unicode white spaces.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{w}\p{{L}}\p{{N}}]+|[{w}]+(?![^{w}])|[{w}]+"""
WHITE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"

#: Characters of text that are encoded together, and distinct pieces that a worker remembers between them.
CHUNK_CHARS = 6_000_000
MEMORY = 400_000
#: Ranks below this are applied to all their places at once, if the pieces have so many bytes.
TOGETHER = 30_000
MANY = 50_000


def _byte_signs() -> dict[str, int]:
    """The printable sign that stands for each byte in the vocabulary file: itself if it is printable and no space, else
    one from U+0100 on, in order."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(rest)}


class Vocabulary:
    """Ids of the single bytes, and of each pair of ids that merges: its rank and the id it becomes."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        ids, signs = model["vocab"], _byte_signs()
        self.of_byte = np.zeros(256, np.int32)
        for sign, byte in signs.items():
            self.of_byte[byte] = ids[sign]
        self.rank: dict[int, int] = {}
        self.becomes: list[int] = []
        for rank, (a, b) in enumerate(model["merges"]):
            self.rank[ids[a] << 20 | ids[b]] = rank
            self.becomes.append(ids[a + b])
        keys = np.fromiter(self.rank, np.int64, len(self.rank))
        order = np.argsort(keys)
        self.pair_keys, self.pair_ranks = keys[order], np.fromiter(self.rank.values(), np.int64, len(keys))[order]
        self.pairs = [(k >> 20, k & 0xFFFFF) for k in keys.tolist()]
        # for the first index all symbols are bytes, so ranks come from a table
        self.byte_rank = np.full((256, 256), -1, np.int32)
        back = {int(i): b for b, i in enumerate(self.of_byte)}
        for pair, rank in self.rank.items():
            a, b = back.get(pair >> 20), back.get(pair & 0xFFFFF)
            if a is not None and b is not None:
                self.byte_rank[a, b] = rank
        self.pattern = regex.compile(PATTERN.format(w=WHITE))
        self.remembered: dict[str, int] = {}
        self.tokens, self.starts = np.empty(0, np.int32), np.zeros(1, np.int64)

    def _merge(self, places: np.ndarray, rank: int, symbol: np.ndarray, right: np.ndarray, left: np.ndarray, now: np.ndarray, index: dict[int, list], active: list[int]) -> None:
        """Merges the pair of ``rank`` at all ``places`` at once, and enters the new pairs, whose ranks are greater, in the index."""
        j = right[places]
        k = right[j]
        symbol[places], symbol[j], now[j], right[places] = self.becomes[rank], -1, -1, k
        has = k >= 0
        left[k[has]] = places[has]
        now[places] = -1
        h = left[places]
        begins = np.concatenate([places[has], h[h >= 0]])
        key = symbol[begins] << 20 | symbol[right[begins]]
        at = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
        found = np.where(self.pair_keys[at] == key, self.pair_ranks[at], -1)
        now[begins] = found
        begins, found = begins[found >= 0], found[found >= 0]
        order = np.argsort(found)
        begins, found = begins[order], found[order]
        first = np.flatnonzero(np.concatenate([np.ones(min(1, len(found)), bool), found[1:] != found[:-1]]))
        for r, lo, hi in zip(found[first].tolist(), first.tolist(), [*first[1:].tolist(), len(found)]):
            some = begins[lo:hi]
            if r in index:
                index[r].append(some)
            else:
                index[r] = [some]
                heapq.heappush(active, r)

    def encode_pieces(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of distinct pieces, one after the other, and where each piece's ids start (with the end)."""
        raw = [p.encode("utf-8", "replace") for p in pieces]
        data = np.frombuffer(b"".join(raw), np.uint8)
        ends = np.cumsum(np.fromiter(map(len, raw), np.int64, len(raw)))
        if not len(data):
            return np.empty(0, np.int32), np.zeros(len(raw) + 1, np.int64)
        last = np.zeros(len(data), bool)
        last[ends - 1] = True
        pair_rank = np.full(len(data), -1, np.int32)
        pair_rank[:-1] = self.byte_rank[data[:-1], data[1:]]
        pair_rank[last] = -1
        # the index: rank -> places of the pair's left symbol
        at = np.flatnonzero(pair_rank >= 0)
        at = at[np.argsort(pair_rank[at], kind="stable")]
        ranks, first = np.unique(pair_rank[at], return_index=True)
        index = {r: [x] for r, x in zip(ranks.tolist(), np.split(at, first[1:]))}
        active = ranks.tolist()
        heapq.heapify(active)
        symbols = self.of_byte[data].astype(np.int64)
        after = np.arange(1, len(data) + 1)
        after[last] = -1
        before = np.arange(-1, len(data) - 1)
        before[1:][last[:-1]] = -1
        ranked = pair_rank.astype(np.int64)
        # the first ranks have very many places each, which are merged together; the others follow one by one
        while active and active[0] < TOGETHER and len(data) >= MANY:
            rank = heapq.heappop(active)
            places = np.concatenate(index.pop(rank))
            places = np.sort(places[ranked[places] == rank])
            places = places[np.concatenate([np.ones(min(1, len(places)), bool), places[1:] != places[:-1]])]
            if not len(places):
                continue
            left_, right_ = self.pairs[rank]
            if left_ == right_:  # in a row of equal symbols every other pair
                begins = np.concatenate([[True], after[places[:-1]] != places[1:]])
                run = np.maximum.accumulate(np.where(begins, np.arange(len(places)), 0))
                places = places[(np.arange(len(places)) - run) % 2 == 0]
            self._merge(places, rank, symbols, after, before, ranked, index, active)
        index = {r: np.concatenate(x).tolist() for r, x in index.items()}
        symbol, right, left, now = symbols.tolist(), after.tolist(), before.tolist(), ranked.tolist()
        rank_of, becomes = self.rank.get, self.becomes
        while active:
            rank = heapq.heappop(active)
            new = becomes[rank]
            places = index.pop(rank)
            places.sort()
            for i in places:
                if now[i] != rank:  # this place has merged into another since
                    continue
                j = right[i]
                k = right[j]
                symbol[i] = new
                symbol[j] = -1
                now[j] = -1
                right[i] = k
                if k >= 0:
                    left[k] = i
                    r = rank_of(new << 20 | symbol[k], -1)
                    now[i] = r
                    if r >= 0:
                        if r in index:
                            index[r].append(i)
                        else:
                            index[r] = [i]
                            heapq.heappush(active, r)
                else:
                    now[i] = -1
                h = left[i]
                if h >= 0:
                    r = rank_of(symbol[h] << 20 | new, -1)
                    now[h] = r
                    if r >= 0:
                        if r in index:
                            index[r].append(h)
                        else:
                            index[r] = [h]
                            heapq.heappush(active, r)
        symbols = np.array(symbol, np.int32)
        kept = symbols >= 0
        starts = np.zeros(len(raw) + 1, np.int64)
        starts[1:] = np.cumsum(kept)[ends - 1]
        return symbols[kept], starts

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, one after the other, and where each text's ids start (with the end)."""
        cut = self.pattern.findall
        pieces = [cut(t) if t else [] for t in texts]
        counts = np.fromiter(map(len, pieces), np.int64, len(pieces))
        known = self.remembered
        new = dict.fromkeys(p for p in itertools.chain.from_iterable(pieces) if p not in known)
        if new:
            tokens, starts = self.encode_pieces(list(new))
            known.update(zip(new, range(len(known), len(known) + len(new))))
            self.starts = np.concatenate([self.starts, starts[1:] + self.starts[-1]])
            self.tokens = np.concatenate([self.tokens, tokens])
        which = np.fromiter(map(known.__getitem__, itertools.chain.from_iterable(pieces)), np.int64, int(counts.sum()))
        begin, length = self.starts[which], self.starts[which + 1] - self.starts[which]
        total = np.concatenate([[0], np.cumsum(length)])
        ids = self.tokens[np.repeat(begin - total[:-1], length) + np.arange(total[-1])]
        out = total[np.concatenate([[0], np.cumsum(counts)])]
        if len(known) > MEMORY:  # forget all; a piece that comes again is encoded again
            self.remembered, self.tokens, self.starts = {}, np.empty(0, np.int32), np.zeros(1, np.int64)
        return ids, out


@lru_cache(maxsize=4)
def vocabulary(path: str) -> Vocabulary:
    """Loaded once per worker process."""
    return Vocabulary(path)


def chunks(batches: Iterator[pa.RecordBatch], text: int, most: int = CHUNK_CHARS) -> Iterator[pa.Table]:
    """Batches put together until their texts have about ``most`` bytes."""
    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += batch.column(text).nbytes
        if size >= most:
            yield pa.Table.from_batches(held)
            held, size = [], 0
    if held:
        yield pa.Table.from_batches(held)


def encoded(df: DataFrame, key: str, text: str, folder: str = TOKENIZERS, name: str = VOCABULARY) -> DataFrame:
    """(key, ids array<int>) of each row, without special tokens; their strings in a text are ordinary text.

    A null and an empty text both have no ids: an empty list, never null. A null key stays null; repeated rows stay. Columns
    besides the two are ignored. ``folder`` must hold the vocabulary on every executor.
    """
    path = os.path.join(folder, name)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in chunks(batches, 1):
            ids, starts = vocabulary(path).encode(chunk.column(1).to_pylist())
            cells = pa.ListArray.from_arrays(pa.array(starts.astype(np.int32)), pa.array(ids))
            out = pa.Table.from_arrays([chunk.column(0).combine_chunks(), cells], names=[key, "ids"])
            yield from out.to_batches(max_chunksize=4096)

    kind = df.schema[key].dataType.simpleString()
    return df.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text")).mapInArrow(run, f"`{key}` {kind}, ids array<int>")


def counted(df: DataFrame, key: str, text: str, folder: str = TOKENIZERS, name: str = VOCABULARY) -> DataFrame:
    """(key, n_tokens long): how many ids ``encoded`` gives; 0 for null and empty texts."""
    path = os.path.join(folder, name)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in chunks(batches, 1):
            _, starts = vocabulary(path).encode(chunk.column(1).to_pylist())
            out = pa.Table.from_arrays([chunk.column(0).combine_chunks(), pa.array(np.diff(starts))], names=[key, "n_tokens"])
            yield from out.to_batches()

    kind = df.schema[key].dataType.simpleString()
    return df.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text")).mapInArrow(run, f"`{key}` {kind}, n_tokens long")
