"""Substring dedup by seed and extend."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .repeats import Group, find_repeats, matches_table
from .words import gram_hash


def _extend(min_words: int):
    def find(g: Group) -> pa.Table:
        hashed = gram_hash(g.words, min_words)
        inner = np.arange(len(hashed))
        inner = inner[inner + min_words <= g.offsets[g.run_of[inner] + 1]]
        key = hashed[inner]
        doc, at = g.where(inner)
        order = np.lexsort((at, doc, key))
        key, inner = key[order], inner[order]
        head = np.append(True, key[1:] != key[:-1])
        first = inner[np.maximum.accumulate(np.where(head, np.arange(len(key)), 0))]
        mine, theirs = inner[~head], first[~head]
        order = np.argsort(mine, kind="stable")
        mine, theirs = mine[order], theirs[order]
        shift = theirs - mine
        new = np.append(True, (mine[1:] != mine[:-1] + 1) | (shift[1:] != shift[:-1]) | (g.run_of[mine[1:]] != g.run_of[mine[:-1]])) if len(mine) else np.zeros(0, bool)
        seed = np.flatnonzero(new)
        if not len(seed):
            return matches_table(*[np.zeros(0, np.int64)] * 5)
        left, shift = mine[seed], shift[seed]
        right = mine[np.append(seed[1:], len(mine)) - 1] + min_words
        run, other = g.run_of[left], g.run_of[left + shift]
        low = np.maximum(g.offsets[run], g.offsets[other] - shift)
        high = np.minimum(g.offsets[run + 1], g.offsets[other + 1] - shift)
        live = np.flatnonzero(left > low)
        while len(live):
            at = left[live] - 1
            live = live[g.words[at] == g.words[at + shift[live]]]
            left[live] -= 1
            live = live[left[live] > low[live]]
        live = np.flatnonzero(right < high)
        while len(live):
            at = right[live]
            live = live[g.words[at] == g.words[at + shift[live]]]
            right[live] += 1
            live = live[right[live] < high[live]]
        doc, start = g.where(left)
        source, source_start = g.where(left + shift)
        return matches_table(doc, start, start + right - left, source, source_start)

    return find


def substring_repeats(docs: DataFrame, min_words: int = 50, seed_words: int = 8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Repeats of at least `min_words` words against the earliest occurrence, which cover every window of so many words that occurred earlier.

    Repeats between later documents are not listed by themselves: where an earlier document holds only a part of what two later ones share, the
    last gets pieces against both and not the whole passage against the second.

    Documents are joined on winnowed anchors (each window of `min_words` words keeps its least `seed_words`-gram).
    In each anchor's group, a window is paired with the earliest place, by document and position, that has the same words,
    and the pair is extended word by word both ways; pieces on one diagonal are joined, so that a
    repeat is as long as the two texts agree around the windows that the earlier document is the first to hold.

    Result: doc_id, start_word, end_word (exclusive), n_words, first_doc_id, first_start_word. Each word of a window that
    occurred earlier is covered. Words are compared without case and punctuation (see words.py).
    A null id leaves the row out, a null, empty or shorter text has no repeats; rows that share an id count once, see
    common.texts; ties go to the lowest id and position; repeats within one document count; an empty table gives an
    empty result; other columns are ignored.
    """
    out = find_repeats(docs, _extend(min_words), min_words, seed_words, id_col, text_col)
    return out.select("doc_id", "start_word", "end_word", (F.col("end_word") - F.col("start_word")).alias("n_words"), "first_doc_id", "first_start_word")
