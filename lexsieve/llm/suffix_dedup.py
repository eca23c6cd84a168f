"""Suffix-array dedup: Burrows-Wheeler transforms of shards, merged by interleave refinement."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import texts
from .repeats import Group, find_repeats, matches_table
from .words import U, gram_hash, mix, slabs

SHARDS = 8


def stable_order(rank: np.ndarray) -> np.ndarray:
    """Stable counting order of non-negative ranks, by 16 bits at a time."""
    order = np.argsort((rank & 0xFFFF).astype(np.uint16), kind="stable")
    high = rank >> 16
    while high.any():
        order = order[np.argsort((high[order] & 0xFFFF).astype(np.uint16), kind="stable")]
        high = high >> 16
    return order


def shard_transform(symbol: np.ndarray, ahead: np.ndarray, before: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffix order of one shard's strings, to at least depth symbols, and its Burrows-Wheeler transform.

    symbol: first symbol of each suffix, 0 for an empty one; ahead: the suffix without it (itself if empty);
    before: the suffix with one symbol more, or -1.
    """
    rank, hop, known = symbol.astype(np.int64), ahead, 1
    order = np.argsort(rank, kind="stable")
    while known < depth:
        key = (rank << 32) | rank[hop]
        order = np.argsort(key, kind="stable")
        ranked = key[order]
        rank = np.empty(len(key), np.int64)
        rank[order] = np.cumsum(np.append(False, ranked[1:] != ranked[:-1])[: len(key)])
        hop, known = hop[hop], known * 2
    bwt = np.where(before[order] >= 0, symbol[before[order]], 0)
    return order, bwt


def merge_transforms(bwts: list[np.ndarray], depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Interleave of sorted shards by their transforms alone: (shard, row in shard, common prefix with the row above).

    Each round walks the interleave in order and deals every shard's next transform symbol to that
    symbol's bucket: rows then stand by one symbol more. A border that first shows in round d has a common prefix of
    d - 1 symbols; borders that never show within `depth` rounds have at least `depth`.
    """
    sizes = np.array([len(b) for b in bwts])
    base = np.append(0, np.cumsum(sizes))[:-1]
    bwt = np.concatenate(bwts)
    shard = np.repeat(np.arange(len(bwts)), sizes).astype(np.uint16)
    block = np.zeros(len(bwt), np.int64)
    prefix = np.full(len(bwt), depth, np.int16)
    if len(prefix):
        prefix[0] = 0
    for d in range(1, depth + 1):
        row = np.empty(len(bwt), np.int64)
        row[np.argsort(shard, kind="stable")] = np.arange(len(bwt))
        symbol = bwt[row]
        order = stable_order(symbol)
        shard = shard[order]
        dealt, held = symbol[order], block[order]
        border = np.append(True, (dealt[1:] != dealt[:-1]) | (held[1:] != held[:-1])) if len(dealt) else np.zeros(0, bool)
        fresh = border & (prefix == depth)
        fresh[:1] = False
        prefix[fresh] = d - 1
        block = np.cumsum(border)
    row = np.empty(len(bwt), np.int64)
    row[np.argsort(shard, kind="stable")] = np.arange(len(bwt))
    return shard, row - base[shard], prefix


def _intervals(min_words: int, stride: int):
    depth = min_words // stride

    def find(g: Group) -> pa.Table:
        lengths = np.diff(g.offsets)
        rows = lengths + 1  # one suffix more than there are words
        ends = np.cumsum(rows)
        run = np.repeat(np.arange(len(rows)), rows)
        at = np.arange(int(ends[-1])) - np.repeat(ends - rows, rows)
        full = at + stride <= lengths[run]
        blocks = gram_hash(g.words, stride)
        value = np.zeros(len(at), U)
        value[full] = blocks[(g.offsets[run] + at)[full]]
        seen, symbol = np.unique(value[full], return_inverse=True)
        names = np.zeros(len(at), np.int64)
        names[full] = symbol + 1
        here = np.arange(len(at))
        part = (mix(g.doc.astype(U)) % U(SHARDS)).astype(np.int64)[run]
        order_of, bwts, rows_of = [], [], []
        for s in range(SHARDS):
            mine = np.flatnonzero(part == s)
            if not len(mine):
                continue
            local = np.full(len(at), -1, np.int64)
            local[mine] = np.arange(len(mine))
            ahead = np.where(full[mine], local[np.minimum(here[mine] + stride, len(at) - 1)], np.arange(len(mine)))
            before = np.where(at[mine] >= stride, local[np.maximum(here[mine] - stride, 0)], -1)
            order, bwt = shard_transform(names[mine], ahead, before, depth)
            order_of.append(mine[order])
            bwts.append(bwt)
        shard, row, prefix = merge_transforms(bwts, depth)
        base = np.append(0, np.cumsum([len(b) for b in bwts]))
        suffix = np.concatenate(order_of)[base[shard] + row]
        interval = np.cumsum(prefix < depth)
        whole = at[suffix] + min_words <= lengths[run[suffix]]
        suffix, interval = suffix[whole], interval[whole]
        place = g.offsets[run[suffix]] + at[suffix]
        doc, word = g.where(place)
        order = np.lexsort((word, doc, interval))
        place, interval, doc, word = place[order], interval[order], doc[order], word[order]
        head = np.append(True, interval[1:] != interval[:-1])[: len(interval)]
        lead = np.maximum.accumulate(np.where(head, np.arange(len(head)), 0)) if len(head) else np.zeros(0, np.int64)
        again = np.flatnonzero(~head)
        again = again[np.argsort(place[again], kind="stable")]
        p, d, w, fd, fw = place[again], doc[again], word[again], doc[lead[again]], word[lead[again]]
        if not len(p):
            return matches_table(*[np.zeros(0, np.int64)] * 5)
        new = np.append(True, (p[1:] != p[:-1] + 1) | (g.run_of[p[1:]] != g.run_of[p[:-1]]) | (fd[1:] != fd[:-1]) | (fw[1:] != fw[:-1] + 1))
        a = np.flatnonzero(new)
        z = np.append(a[1:], len(p)) - 1
        return matches_table(d[a], w[a], w[z] + min_words, fd[a], fw[a])

    return find


def suffix_repeats(docs: DataFrame, min_words: int = 50, seed_words: int = 8, stride: int = 10, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every window of `min_words` words that occurs again, against its earliest occurrence.

    The runs of windows that share a representative (see repeats.py) are one small collection of strings over
    blocks of `stride` words, read at every phase, so that `min_words / stride` symbols are exactly `min_words` words. Each
    shard of its documents is sorted and transformed by itself; the transforms are merged by
    refining their interleave, one symbol a round, which also yields the common prefixes of neighbours; rows whose
    prefixes reach `min_words` words form the repeated intervals, whose earliest member is the original.

    Result: doc_id, start_word, end_word (exclusive), n_words, first_doc_id, first_start_word: maximal stretches of windows
    whose earliest occurrences follow one another in one document. `stride` must divide `min_words`.
    A null id leaves the row out, a null, empty or shorter text has no repeats; rows that share an id count once, see
    common.texts; ties go to the lowest id and position; repeats within one document count; an empty table gives an
    empty result; other columns are ignored.
    """
    if stride < 1 or min_words % stride:
        raise ValueError("stride must divide min_words")
    out = find_repeats(docs, _intervals(min_words, stride), min_words, seed_words, id_col, text_col)
    return out.select("doc_id", "start_word", "end_word", (F.col("end_word") - F.col("start_word")).alias("n_words"), "first_doc_id", "first_start_word")


def _cut(batches):
    for batch in batches:
        ids = batch.column(0).to_numpy(zero_copy_only=False)
        spans = batch.column(2)
        text = batch.column(1)
        for s in slabs(text):
            keep_ids, keep_text = [], []
            for i in range(len(s.offsets) - 1):
                row = s.row + i
                body = text[row].as_py().encode()
                begin, end = s.begin[s.offsets[i] : s.offsets[i + 1]], s.end[s.offsets[i] : s.offsets[i + 1]]
                gone = np.zeros(len(begin) + 1, np.int64)
                for a, b in ((x["start_word"], x["end_word"]) for x in spans[row].as_py()):
                    gone[a] += 1
                    gone[b] -= 1
                stays = np.flatnonzero(np.cumsum(gone[:-1]) == 0)
                parts = []
                if len(stays):
                    head = np.flatnonzero(np.append(True, stays[1:] != stays[:-1] + 1))
                    for a, b in zip(stays[head], stays[np.append(head[1:], len(stays)) - 1]):
                        stop = begin[b + 1] if b + 1 < len(begin) else len(body)
                        start = begin[a] if a else 0
                        parts.append(body[start:stop].decode().strip())
                if parts:
                    keep_ids.append(int(ids[row]))
                    keep_text.append("\n".join(parts))
            yield pa.record_batch([pa.array(keep_ids, pa.int64()), pa.array(keep_text, pa.string())], names=["doc_id", "__lexsieve_cut"])


def remove_repeats(docs: DataFrame, repeats: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without the words of the given repeats; n_chars, if there, is counted anew.

    What is left of a text stands in its order, pieces parted by line breaks. A document of which no word is left goes.
    Documents without repeats stay as they are, those with a null id or null text too. Rows that share an id get the
    same remaining text.
    """
    key = "__lexsieve_id"
    spans = repeats.groupBy("doc_id").agg(F.collect_list(F.struct("start_word", "end_word")).alias("spans"))
    held = texts(docs, id_col, text_col).join(spans.hint("shuffle_hash"), "doc_id").select("doc_id", "text", "spans")
    left = held.mapInArrow(_cut, "doc_id bigint, __lexsieve_cut string").withColumnRenamed("doc_id", key)
    hit = spans.select(F.col("doc_id").alias("__lexsieve_hit"))
    marked = docs.join(hit.hint("shuffle_hash"), docs[id_col].cast("bigint") == hit["__lexsieve_hit"], "left")
    joined = marked.join(left.hint("shuffle_hash"), docs[id_col].cast("bigint") == left[key], "left").filter("__lexsieve_hit is null or __lexsieve_cut is not null")
    new = F.coalesce(F.col("__lexsieve_cut"), docs[text_col])
    return joined.select(*[new.alias(c) if c == text_col else F.when(F.col("__lexsieve_cut").isNotNull(), F.length("__lexsieve_cut")).otherwise(docs[c]).cast(docs.schema[c].dataType).alias(c) if c == "n_chars" else docs[c] for c in docs.columns])
