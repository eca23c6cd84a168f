"""Windows of words that may repeat, brought together by their least inner k-gram.

Every window of `min_words` words is represented by the least hash of its `seed_words`-grams (winnowing): equal
windows have equal representatives. Consecutive windows of one document with one representative form a *run*.
Only runs whose representative occurs again, in another run or at another place of its own, can hold a repeat, which a light exchange of (representative,
document, position) decides exactly; the words of those runs alone then travel, each run to its representative.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import session, texts, whole_partitions
from .words import U, gram_hash, sliding_min, slabs, starts_within

RUN = "anchor bigint, doc_id bigint, start int, size int"
MATCH = "doc_id bigint, start_word int, end_word int, first_doc_id bigint, first_start_word int"
#: Words that a task looks at together; the groups of one representative are never parted.
GROUP_WORDS = 1 << 20


def _runs(min_words: int, seed_words: int) -> Callable:
    window = min_words - seed_words + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            for s in slabs(batch.column(1)):
                grams = gram_hash(s.words, seed_words)
                least = sliding_min(grams, window)
                at = np.flatnonzero(starts_within(s.offsets, min_words, len(least)))
                if not len(at):
                    continue
                v = least[at]
                new = np.ones(len(at), bool)
                new[1:] = (v[1:] != v[:-1]) | (at[1:] != at[:-1] + 1)
                first = np.flatnonzero(new)
                last = np.append(first[1:], len(at)) - 1
                inner = np.arange(window)
                left = at[first] + grams[at[first, None] + inner].argmin(1)
                right = at[last] + window - 1 - grams[at[last, None] + inner[::-1]].argmin(1)
                doc = np.searchsorted(s.offsets, at[first], "right") - 1
                yield pa.record_batch(
                    [
                        pa.array(v[first].view(np.int64)),
                        pa.array(ids[s.row + doc]),
                        pa.array((at[first] - s.offsets[doc]).astype(np.int32)),
                        pa.array(np.diff(np.append(first, len(at))).astype(np.int32)),
                        pa.array(left != right),
                    ],
                    names=["anchor", "doc_id", "start", "size", "twice"],
                )

    return run


def _repeated(t: pa.Table) -> pa.Table:
    """Runs whose representative occurs more than once, here or in another run."""
    _, at, n = np.unique(t["anchor"].to_numpy(), return_inverse=True, return_counts=True)
    keep = (n[at] > 1) | t["twice"].to_numpy(zero_copy_only=False)
    return t.select(["anchor", "doc_id", "start", "size"]).filter(pa.array(keep))


def _words_of_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = batch.column(0).to_numpy(zero_copy_only=False)
        runs = batch.column(2)
        of = np.diff(runs.offsets.to_numpy())
        flat = runs.flatten()
        anchor, start, size, extent = (flat.field(i).to_numpy(zero_copy_only=False) for i in range(4))
        cuts = np.append(0, np.cumsum(of))
        for s in slabs(batch.column(1)):
            rows = len(s.offsets) - 1
            lo, hi = cuts[s.row], cuts[s.row + rows]
            doc = np.repeat(np.arange(rows), of[s.row : s.row + rows])
            begin = s.offsets[doc] + start[lo:hi]
            length = extent[lo:hi].astype(np.int64)
            ends = np.cumsum(length)
            pick = np.arange(int(ends[-1]) if len(ends) else 0) - np.repeat(ends - length, length) + np.repeat(begin, length)
            words = (s.words[pick] & U(0xFFFFFFFF)).astype(np.uint32)
            offsets = np.append(0, ends * 4).astype(np.int64)
            for a in range(0, hi - lo, 20_000):
                b = min(a + 20_000, hi - lo)
                body = pa.Array.from_buffers(
                    pa.binary(), b - a, [None, pa.py_buffer((offsets[a : b + 1] - offsets[a]).astype(np.int32)), pa.py_buffer(words[offsets[a] // 4 : offsets[b] // 4])]
                )
                yield pa.record_batch(
                    [pa.array(anchor[lo + a : lo + b]), pa.array(ids[s.row + doc[a:b]]), pa.array(start[lo + a : lo + b]), pa.array(size[lo + a : lo + b]), body],
                    names=["anchor", "doc_id", "start", "size", "words"],
                )


class Group:
    """Runs of some representatives: their words one after another, ordered by document and position."""

    def __init__(self, t: pa.Table):
        self.doc = t["doc_id"].to_numpy()
        self.start = t["start"].to_numpy().astype(np.int64)
        self.size = t["size"].to_numpy().astype(np.int64)
        body = t["words"].combine_chunks()
        raw = np.frombuffer(body.buffers()[2], np.uint8)
        cuts = np.frombuffer(body.buffers()[1], np.int32)[body.offset : body.offset + len(body) + 1].astype(np.int64)
        self.words = raw[cuts[0] : cuts[-1]].view(np.uint32).astype(U)
        self.offsets = (cuts - cuts[0]) // 4
        self.run_of = np.repeat(np.arange(len(self.doc)), np.diff(self.offsets))

    def where(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Document and word position of places in words."""
        run = self.run_of[at]
        return self.doc[run], self.start[run] + at - self.offsets[run]


def matches_table(doc: np.ndarray, start: np.ndarray, end: np.ndarray, first: np.ndarray, first_start: np.ndarray) -> pa.Table:
    return pa.table(
        {
            "doc_id": pa.array(doc, pa.int64()),
            "start_word": pa.array(start.astype(np.int32)),
            "end_word": pa.array(end.astype(np.int32)),
            "first_doc_id": pa.array(first, pa.int64()),
            "first_start_word": pa.array(first_start.astype(np.int32)),
        }
    )


def _grouped(find: Callable[[Group], pa.Table]) -> Callable:
    def make(t: pa.Table) -> Iterator[pa.RecordBatch]:
        t = t.sort_by([("anchor", "ascending"), ("doc_id", "ascending"), ("start", "ascending")])
        anchor = t["anchor"].to_numpy()
        edges = np.append(np.flatnonzero(np.append(True, anchor[1:] != anchor[:-1])), len(anchor))
        words = np.append(0, np.cumsum(pc.binary_length(t["words"]).to_numpy() // 4))
        a = 0
        while a < len(edges) - 1:
            b = int(np.searchsorted(words[edges], words[edges[a]] + GROUP_WORDS, "right")) - 1
            b = min(max(b, a + 1), len(edges) - 1)
            yield from find(Group(t.slice(edges[a], edges[b] - edges[a]))).to_batches()
            a = b

    return make


def _joined(t: pa.Table) -> pa.Table:
    """Overlapping or touching matches of one document on one diagonal with one earlier document become one."""
    doc, start, end, first, at = (t[c].to_numpy().astype(np.int64) for c in ("doc_id", "start_word", "end_word", "first_doc_id", "first_start_word"))
    shift = at - start
    order = np.lexsort((start, shift, first, doc))
    doc, start, end, first, shift = doc[order], start[order], end[order], first[order], shift[order]
    same = (doc[1:] == doc[:-1]) & (first[1:] == first[:-1]) & (shift[1:] == shift[:-1])
    group = np.cumsum(np.append(True, ~same))
    reach = np.maximum.accumulate(end + group * (1 << 32)) - group * (1 << 32)
    new = np.append(True, ~same | (start[1:] > reach[:-1]))
    head = np.flatnonzero(new)
    return matches_table(doc[head], start[head], np.maximum.reduceat(end, head), first[head], start[head] + shift[head])


def find_repeats(docs: DataFrame, find: Callable[[Group], pa.Table], min_words: int, seed_words: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Matches that find() makes out of the runs that may repeat, joined along their diagonals."""
    if not 1 <= seed_words <= min_words:
        raise ValueError("seed_words must be between 1 and min_words")
    rows = texts(docs, id_col, text_col)
    session(docs)
    runs = rows.mapInArrow(_runs(min_words, seed_words), RUN + ", twice boolean")
    again = whole_partitions(runs, ["anchor"], _repeated, RUN)
    item = F.struct("anchor", "start", "size", (F.col("size") + (min_words - 1)).alias("extent"))
    wanted = again.groupBy("doc_id").agg(F.collect_list(item).alias("runs"))
    held = rows.join(wanted.hint("shuffle_hash"), "doc_id").select("doc_id", "text", "runs")
    loaded = held.mapInArrow(_words_of_runs, RUN + ", words binary")
    found = whole_partitions(loaded, ["anchor"], _grouped(find), MATCH)
    return whole_partitions(found, ["doc_id"], _joined, MATCH)
