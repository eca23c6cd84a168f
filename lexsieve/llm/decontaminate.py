"""Benchmark decontamination by greedy string tiling (running Karp-Rabin)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import session, texts, whole_partitions
from .words import U, gram_hash, slabs, starts_within

LEAK = "doc_id bigint, item_id bigint, coverage double, matched_words int, item_words int, tiles int"
_MASK = (1 << 61) - 1
_BASE = 1_000_003


def tile(item: list[int], doc: list[int], least: int) -> list[tuple[int, int, int]]:
    """Greedy string tiling: (item position, document position, length) of the tiles, longest first.

    For each length from the longest down, unmarked stretches of both texts are compared through a Karp-Rabin hash that
    rolls along, equal hashes are checked word by word, and matches are marked in order of item and document position
    as long as they don't overlap a tile.
    """
    free_item, free_doc = [True] * len(item), [True] * len(doc)
    tiles: list[tuple[int, int, int]] = []

    def stretches(text: list[int], free: list[bool], size: int) -> Iterator[tuple[int, int]]:
        top = pow(_BASE, size - 1, _MASK)
        rolled = run = 0
        for i, word in enumerate(text):
            if not free[i]:
                rolled = run = 0
                continue
            if run >= size:
                rolled -= text[i - size] * top
            rolled = (rolled * _BASE + word) % _MASK
            run += 1
            if run >= size:
                yield rolled, i - size + 1

    size = longest(item, doc)
    while size >= least:
        table: dict[int, list[int]] = {}
        for hashed, at in stretches(item, free_item, size):
            table.setdefault(hashed, []).append(at)
        if not table:
            size = min(size - 1, max_run(free_item))
            continue
        found = [(p, q) for hashed, q in stretches(doc, free_doc, size) if hashed in table for p in table[hashed] if item[p : p + size] == doc[q : q + size]]
        for p, q in sorted(found):
            if all(free_item[p : p + size]) and all(free_doc[q : q + size]):
                free_item[p : p + size] = [False] * size
                free_doc[q : q + size] = [False] * size
                tiles.append((p, q, size))
        size = min(size - 1, max_run(free_item))
    return tiles


def max_run(free: list[bool]) -> int:
    best = run = 0
    for x in free:
        run = run + 1 if x else 0
        best = max(best, run)
    return best


def longest(item: list[int], doc: list[int]) -> int:
    """Length of the longest common stretch."""
    at: dict[int, list[int]] = {}
    for p, word in enumerate(item):
        at.setdefault(word, []).append(p)
    best, before = 0, {}
    for word in doc:
        now = {p: before.get(p - 1, 0) + 1 for p in at.get(word, ())}
        if now:
            best = max(best, max(now.values()))
        before = now
    return best


class Items:
    """The benchmark's words, and where each of its seeds stands."""

    def __init__(self, ids: np.ndarray, words: list[np.ndarray], seed: int):
        self.ids, self.words, self.seed = ids, words, seed
        self.sizes = np.array([len(w) for w in words], np.int64)
        grams = [gram_hash(w, seed) for w in words]
        key = np.concatenate([*grams, np.zeros(0, U)])
        item = np.repeat(np.arange(len(words)), [len(g) for g in grams])
        at = np.concatenate([*[np.arange(len(g)) for g in grams], np.zeros(0, np.int64)])
        order = np.argsort(key, kind="stable")
        self.item, self.at = item[order], at[order]
        self.keys, self.first, self.count = np.unique(key[order], return_index=True, return_counts=True)
        self.sieve = np.zeros(1 << 20, bool)
        self.sieve[(self.keys & U((1 << 20) - 1)).astype(np.int64)] = True

    def hits(self, grams: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of the document seeds at `at`: those that the benchmark has too, and their numbers in keys."""
        at = at[self.sieve[(grams[at] & U((1 << 20) - 1)).astype(np.int64)]]
        where = np.searchsorted(self.keys, grams[at])
        same = where < len(self.keys)
        same[same] = self.keys[where[same]] == grams[at[same]]
        return at[same], where[same]


def benchmark_items(benchmark: DataFrame, seed: int, id_col: str, text_col: str) -> Items:
    rows = texts(benchmark, id_col, text_col).orderBy("doc_id").toPandas()
    words: list[np.ndarray] = [np.zeros(0, U)] * len(rows)
    for s in slabs(pa.array(rows["text"], pa.string())):
        for i in range(len(s.offsets) - 1):
            words[s.row + i] = s.words[s.offsets[i] : s.offsets[i + 1]]
    return Items(rows["doc_id"].to_numpy(np.int64), words, seed)


def shared_extent(doc: np.ndarray, item: np.ndarray, at: np.ndarray, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each (document, item): how many item words the shared seeds at `at` cover; no tiling covers more."""
    order = np.lexsort((at, item, doc))
    doc, item, at = doc[order], item[order], at[order]
    new = np.append(True, (doc[1:] != doc[:-1]) | (item[1:] != item[:-1]))[: len(doc)]
    step = np.full(len(at), seed)
    step[1:][~new[1:]] = np.minimum(seed, at[1:] - at[:-1])[~new[1:]]
    head = np.flatnonzero(new)
    return doc[head], item[head], np.add.reduceat(step, head) if len(head) else head


def score(item_words: np.ndarray, doc_words: np.ndarray, hits: np.ndarray, seed: int) -> tuple[int, int]:
    """Words of the item that its tiles in the document cover, and the number of tiles. hits: places of seeds in the document."""
    inside = np.zeros(len(doc_words) + 1, np.int64)
    np.add.at(inside, hits, 1)
    np.add.at(inside, hits + seed, -1)
    live = np.cumsum(inside[:-1]) > 0
    ids = {int(w): i + 2 for i, w in enumerate(np.unique(item_words))}
    # Words outside of seed matches can be in no tile; one stop word stands for each gap.
    reduced: list[int] = []
    where = np.flatnonzero(live)
    for n, p in enumerate(where):
        if n and where[n - 1] != p - 1:
            reduced.append(1)
        reduced.append(ids.get(int(doc_words[p]), 1))
    tiles = tile([ids[int(w)] for w in item_words], reduced, seed)
    return sum(t[2] for t in tiles), len(tiles)


def _leaks(rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows)) if rows else [[]] * 6
    kinds = [pa.int64(), pa.int64(), pa.float64(), pa.int32(), pa.int32(), pa.int32()]
    return pa.record_batch([pa.array(c, k) for c, k in zip(cols, kinds)], names=["doc_id", "item_id", "coverage", "matched_words", "item_words", "tiles"])


def _search(items: Items, threshold: float):
    seed = items.seed

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            for s in slabs(batch.column(1)):
                grams = gram_hash(s.words, seed)
                at, key = items.hits(grams, np.flatnonzero(starts_within(s.offsets, seed, len(grams))))
                doc = np.searchsorted(s.offsets, at, "right") - 1
                pair = np.unique(np.stack([doc, key], 1), axis=0) if len(at) else np.zeros((0, 2), np.int64)
                n = items.count[pair[:, 1]]
                nth = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n) + np.repeat(items.first[pair[:, 1]], n)
                d, i, extent = shared_extent(np.repeat(pair[:, 0], n), items.item[nth], items.at[nth], seed)
                some = extent >= threshold * items.sizes[i]
                rows = []
                for doc_no, item_no in zip(d[some].tolist(), i[some].tolist()):
                    lo, hi = s.offsets[doc_no], s.offsets[doc_no + 1]
                    a, b = np.searchsorted(at, (lo, hi))
                    mine = np.isin(key[a:b], np.unique(np.searchsorted(items.keys, gram_hash(items.words[item_no], seed))))
                    got, tiles = score(items.words[item_no], s.words[lo:hi], at[a:b][mine] - lo, seed)
                    size = int(items.sizes[item_no])
                    if got >= threshold * size:
                        rows.append((int(ids[s.row + doc_no]), int(items.ids[item_no]), got / size, got, size, tiles))
                yield _leaks(rows)

    return run


def _seeds(seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            for s in slabs(batch.column(1)):
                grams = gram_hash(s.words, seed)
                at = np.flatnonzero(starts_within(s.offsets, seed, len(grams)))
                doc = np.searchsorted(s.offsets, at, "right") - 1
                size = np.diff(s.offsets)[doc].astype(np.int32)
                yield pa.record_batch([pa.array(grams[at].view(np.int64)), pa.array(ids[s.row + doc]), pa.array((at - s.offsets[doc]).astype(np.int32)), pa.array(size)], names=["seed", "doc_id", "at", "size"])

    return run


def _extents(seed: int, threshold: float):
    def make(t: pa.Table) -> pa.Table:
        doc, item, at, size = (t[c].to_numpy() for c in ("doc_id", "item_id", "at", "size"))
        cells = np.unique(np.stack([doc, item, at, size], 1).astype(np.int64), axis=0)
        d, i, extent = shared_extent(cells[:, 0], cells[:, 1], cells[:, 2], seed)
        first = np.flatnonzero(np.append(True, (cells[1:, :2] != cells[:-1, :2]).any(1)))
        some = extent >= threshold * cells[first, 3]
        return pa.table({"doc_id": pa.array(d[some], pa.int64()), "item_id": pa.array(i[some], pa.int64())})

    return make


def _score_pairs(seed: int, threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, items = (batch.column(i).to_pylist() for i in (0, 1))
            both = [[s.words[s.offsets[i] : s.offsets[i + 1]] for s in slabs(batch.column(c)) for i in range(len(s.offsets) - 1)] for c in (2, 3)]
            rows = []
            for doc_id, item_id, doc, item in zip(ids, items, *both):
                hits = np.flatnonzero(np.isin(gram_hash(doc, seed), gram_hash(item, seed)))
                got, tiles = score(item, doc, hits, seed)
                if got >= threshold * len(item):
                    rows.append((doc_id, item_id, got / len(item), got, len(item), tiles))
            yield _leaks(rows)

    return run


def leaks(
    docs: DataFrame,
    benchmark: DataFrame,
    min_match: int = 4,
    threshold: float = 0.5,
    broadcast_words: int = 1_000_000,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_id_col: str = "item_id",
    item_text_col: str = "text",
) -> DataFrame:
    """Documents that hold a benchmark item: doc_id, item_id, coverage, matched_words, item_words, tiles.

    Documents and items are joined on seeds of `min_match` words. A pair whose seeds cover `threshold` of the item's words is
    tiled greedily: the longest common stretches are marked one after another, none overlapping, down to `min_match` words, by
    running Karp-Rabin. The pair is reported when the tiles cover `threshold` of the item, in whatever order they stand.

    A benchmark of up to `broadcast_words` words (measured) goes to every task; beyond that, seeds are joined by a shuffle.
    A null id leaves a row out; a null or empty text, and an item of fewer than `min_match` words, match nothing; rows that share
    an id count once, see common.texts; equal items are reported each; ties between tiles go to the first place in
    the item, then in the document; an empty table gives an empty result; other columns are ignored.
    """
    if min_match < 1 or not 0 < threshold <= 1:
        raise ValueError("min_match is at least 1, threshold in (0, 1]")
    session(docs)
    rows = texts(docs, id_col, text_col)
    n_chars = benchmark.agg(F.sum(F.length(benchmark[item_text_col].cast("string")))).first()[0] or 0
    if n_chars <= broadcast_words * 6:
        items = benchmark_items(benchmark, min_match, item_id_col, item_text_col)
        return rows.mapInArrow(_search(items, threshold), LEAK)
    item_rows = texts(benchmark, item_id_col, item_text_col)
    part = "seed bigint, doc_id bigint, at int, size int"
    in_docs = rows.mapInArrow(_seeds(min_match), part).select("seed", "doc_id").distinct()
    in_items = item_rows.mapInArrow(_seeds(min_match), part).select("seed", F.col("doc_id").alias("item_id"), "at", "size")
    pairs = whole_partitions(in_docs.join(in_items, "seed").drop("seed"), ["doc_id", "item_id"], _extents(min_match, threshold), "doc_id bigint, item_id bigint")
    item_rows = item_rows.select(F.col("doc_id").alias("item_id"), F.col("text").alias("item_text"))
    return pairs.join(rows, "doc_id").join(item_rows, "item_id").select("doc_id", "item_id", "text", "item_text").mapInArrow(_score_pairs(min_match, threshold), LEAK)
