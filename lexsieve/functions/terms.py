"""Which of many words a text holds, all asked at once by one automaton (Aho-Corasick), a batch of texts at a time.

The rule tables ask each text for over a thousand words, one after the other. Here a text is read once, whatever the number of words; rules then test bits.
"""

from __future__ import annotations

import re
from collections import deque
from functools import lru_cache
from hashlib import md5

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .dialect import _Spark

try:
    from re import _parser as _sre
except ImportError:  # before Python 3.11
    import sre_parse as _sre

#: Words told by one number.
BITS = 62
#: Texts of more bytes are asked for each word by itself: a batch takes as many steps as its longest text has bytes.
LONG = 8192


class Automaton:
    def __init__(self, words: tuple[str, ...]):
        self.words = [w.encode() for w in words]
        self.wide = -(-len(words) // BITS)
        used = sorted({c for w in self.words for c in w})
        self.codes = np.zeros(256, np.uint8 if len(used) < 255 else np.int16)
        self.codes[used] = np.arange(1, len(used) + 1)
        width, children, own = len(used) + 1, [{}], [[]]
        for n, w in enumerate(self.words):
            at = 0
            for c in w:
                if c not in children[at]:
                    children[at][c] = len(children)
                    children.append({})
                    own.append([])
                at = children[at][c]
            own[at].append(n)
        table, back, masks, queue = np.zeros((len(children), width), np.int32), [0] * len(children), np.zeros((len(children), self.wide), np.int64), deque([0])
        while queue:
            at = queue.popleft()
            for n in own[at]:
                masks[at, n // BITS] |= 1 << n % BITS
            if at:
                masks[at] |= masks[back[at]]
                table[at] = table[back[at]]
            for c, child in children[at].items():
                back[child] = int(table[at, self.codes[c]])
                table[at, self.codes[c]] = child
                queue.append(child)
        # States that tell of a word come last; a state is its place in the flat table.
        tells = masks.any(axis=1)
        order = np.argsort(tells, kind="stable")
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        self.table = (place[table[order]] * width).astype(np.int32).ravel()
        self.first, self.width, self.masks = int((~tells).sum()), width, masks[order]

    def seen(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """A row of numbers for each text data[start:end] of bytes: bit n % BITS of number n // BITS is set if it holds word n."""
        out = np.zeros((len(starts), self.wide), np.int64)
        sizes = ends - starts
        for i in np.flatnonzero(sizes > LONG):
            text = data[starts[i] : ends[i]].tobytes()
            for n, w in enumerate(self.words):
                if w in text:
                    out[i, n // BITS] |= 1 << n % BITS
        order = np.flatnonzero(sizes <= LONG)
        order = order[np.argsort(-sizes[order], kind="stable")]
        if not len(order):
            return out
        longest = sizes[order]
        live = len(order) - np.searchsorted(longest[::-1], np.arange(longest[0]), side="right")
        found, at, state = np.zeros((len(order), self.wide), np.int64), starts[order].astype(np.int64), np.zeros(len(order), np.int32)
        codes, least = self.codes[data], self.first * self.width
        for n in live.tolist():
            now = self.table[state[:n] + codes[at[:n]]]
            state[:n] = now
            at[:n] += 1
            hits = np.flatnonzero(now >= least)
            if len(hits):
                found[hits] |= self.masks[now[hits] // self.width]
        out[order] = found
        return out


@lru_cache(maxsize=64)
def automaton(words: tuple[str, ...]) -> Automaton:
    return Automaton(words)


def seen(texts: pa.Array, words: tuple[str, ...], groups: tuple[tuple[tuple[int, int], ...], ...] = ()) -> pa.Array:
    """Automaton.seen() of a column of strings, as lists, then how many words of each group there are, a group being (number, bits in it) pairs; null for null."""
    texts = texts.cast(pa.large_string())
    where = np.frombuffer(texts.buffers()[1], np.int64, len(texts) + 1, texts.offset * 8) if len(texts) else np.zeros(1, np.int64)
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8) if len(texts) else np.zeros(0, np.uint8)
    low, high = int(where[0]), int(where[-1])
    bits = automaton(words).seen(data[low:high], where[:-1] - low, where[1:] - low)
    if groups:
        counts = [sum(np.bitwise_count(bits[:, n] & b).astype(np.int64) for n, b in group) for group in groups]
        bits = np.ascontiguousarray(np.column_stack([bits, *counts]))
    offsets = pa.array(np.arange(len(texts) + 1, dtype=np.int32) * bits.shape[1])
    return pa.ListArray.from_arrays(offsets, pa.array(bits.ravel()), mask=texts.is_null() if texts.null_count else None)


@lru_cache
def needed(pattern: str) -> tuple[frozenset[str], ...]:
    """Of each of these sets of words, in lower case, every match of a regular expression holds at least one."""
    try:
        return tuple(_needed(_sre.parse(pattern)))
    except (re.error, OverflowError):
        return ()


def _needed(parsed) -> list[frozenset[str]]:
    out, run = [], ""
    for op, value in [*parsed, (None, None)]:
        if op is _sre.LITERAL and value < 128 and chr(value).isalpha():
            run += chr(value).lower()
            continue
        if len(run) > 2:
            out.append(frozenset([run]))
        run = ""
        if op is _sre.SUBPATTERN:
            out += _needed(value[3])
        elif op is _sre.BRANCH:
            best = [max(_needed(b), key=lambda s: min(map(len, s)), default=None) for b in value[1]]
            out += [frozenset().union(*best)] if all(best) else []
        elif op in (_sre.MAX_REPEAT, _sre.MIN_REPEAT) and value[0] > 0:
            out += _needed(value[2])
    return list(dict.fromkeys(out))


class Seeing(_Spark):
    """Spark SQL over clauses whose words have been looked up: `seen` beside `low`. One instance a plan, which collects the words that the plan asks for."""

    sees = True
    #: The clause in lower case: on one line (low), or with other blanks, which is the same for words without any.
    TEXTS = {"low": True, "lower(clause_text)": False, "small_": False, "lower(flat)": False}
    MARK = "lexsieve_seen_in_"
    GROUP = "lexsieve_group_"

    def __init__(self):
        self.places: dict[str, int] = {}
        self.groups: dict[tuple[tuple[int, int], ...], int] = {}

    def _bits(self, words) -> list[tuple[int, int]]:
        out: dict[int, int] = {}
        for w in words:
            n = self.places.setdefault(w, len(self.places))
            out[n // BITS] = out.get(n // BITS, 0) | 1 << n % BITS
        return sorted(out.items())

    def holds(self, words) -> str:
        """Whether low has one of the words."""
        return "(" + " OR ".join(f"(seen[{n}] & {b}L) <> 0L" for n, b in self._bits(words)) + ")"

    def any_of(self, x, words):
        words = list(dict.fromkeys(words))
        if x not in self.TEXTS or "" in words or not words:
            return super().any_of(x, words)
        plain = [w for w in words if self.TEXTS[x] or not re.search(r"\s", w)]
        rest = [f"({self.holds([w])} AND {super(Seeing, self).any_of(x, [w])})" for w in words if w not in plain]
        return "(" + " OR ".join([*([self.holds(plain)] if plain else []), *rest]) + ")"

    def count_in(self, x, words):
        if x != "low" or len(set(words)) < len(words) or "" in words or not words:
            return super().count_in(x, words)
        n = self.groups.setdefault(tuple(self._bits(words)), len(self.groups))
        return f"CAST(coalesce(seen[{self.GROUP}{n}], 0L) AS INT)"

    def _gate(self, x, pattern) -> str | None:
        sets = needed(pattern) if x in self.TEXTS or x in ("clause_text", "flat") else ()
        return " AND ".join(self.holds(sorted(s)) for s in sets) or None

    def matches(self, x, pattern):
        gate, test = self._gate(x, pattern), super().matches(x, pattern)
        return f"({gate} AND {test})" if gate else test

    def extract(self, x, pattern, group=0):
        gate, found = self._gate(x, pattern), super().extract(x, pattern, group)
        return f"CASE WHEN {gate} THEN {found} END" if gate else found

    def extract_all(self, x, pattern):
        gate, found = self._gate(x, pattern), super().extract_all(x, pattern)
        return f"CASE WHEN seen IS NULL OR {gate} THEN {found} ELSE {self.strings([])} END" if gate else found

    def look_up(self, x) -> str:
        return f"{self.MARK}({x})"

    def bound(self, spark: SparkSession, text: str) -> str:
        """The text of a plan, after all of it has been made, with its look-up registered in the session."""
        words, groups = tuple(self.places), tuple(self.groups)
        name = self.MARK + md5(repr((words, groups)).encode()).hexdigest()
        spark.udf.register(name, F.arrow_udf(_looker(words, groups), "array<bigint>").asNondeterministic())  # else the optimiser may repeat it
        wide = -(-len(words) // BITS)
        text = re.sub(rf"\b{self.GROUP}(\d+)", lambda m: str(wide + int(m[1])), text)
        return text.replace(f"{self.MARK}(", f"{name}(")


def _looker(words: tuple[str, ...], groups: tuple[tuple[tuple[int, int], ...], ...]):
    def look(texts: pa.Array) -> pa.Array:
        return seen(texts, words, groups)

    return look
