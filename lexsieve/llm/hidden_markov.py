"""Language-model scoring with a hidden Markov model over words."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import count, pairwise

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, session, texts, whole_partitions
from .words import U, mix, slab_bounds, slabs

ENCODED = "bucket bigint, doc_id bigint, symbols binary, rare binary"
SCORED = "doc_id bigint, n_words int, log_likelihood double, per_word double"
#: Words that are worked on in step; the messages between the segments of a longer text are exact, see boundaries().
SEGMENT = 256
#: Words of a bucket of documents that a task holds at once when scoring.
BUCKET = 1 << 22
_SLICE = 1 << 20
_ROWS = 512


class Vocabulary:
    """Symbols of words while training: the commonest have their own, all others share hashed classes until score() unties them."""

    def __init__(self, words: np.ndarray, classes: int):
        self.words, self.classes = np.sort(words.astype(U)), classes
        self.size = len(self.words) + classes

    def encode(self, words: np.ndarray) -> np.ndarray:
        rare = len(self.words) + (mix(words) % U(self.classes)).astype(np.int64)
        if not len(self.words):
            return rare.astype(np.uint16)
        if not hasattr(self, "_sieve"):
            self._sieve = np.zeros(1 << 20, bool)
            self._sieve[(self.words & U((1 << 20) - 1)).astype(np.int64)] = True
        may = np.flatnonzero(self._sieve[(words & U((1 << 20) - 1)).astype(np.int64)])
        at = np.minimum(np.searchsorted(self.words, words[may]), len(self.words) - 1)
        same = self.words[at] == words[may]
        rare[may[same]] = at[same]
        return rare.astype(np.uint16)


def _word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[tuple[np.ndarray, np.ndarray]] = []

    def merged() -> tuple[np.ndarray, np.ndarray]:
        words = np.concatenate([w for w, _ in held])
        n = np.concatenate([c for _, c in held])
        order = np.argsort(words)
        words, n = words[order], n[order]
        head = np.flatnonzero(np.append(True, words[1:] != words[:-1])[: len(words)])
        return words[head], np.add.reduceat(n, head) if len(head) else n

    size = 0
    for batch in batches:
        for s in slabs(batch.column(1)):
            w = np.sort(s.words)
            head = np.flatnonzero(np.append(True, w[1:] != w[:-1])[: len(w)])
            held.append((w[head], np.diff(np.append(head, len(w)))))
            size += len(head)
            if size > 1 << 21:
                held[:] = [merged()]
                size = len(held[0][0])
                if size > 1 << 20:
                    yield pa.record_batch([pa.array(held[0][0].view(np.int64)), pa.array(held[0][1])], names=["word", "n"])
                    held.clear()
                    size = 0
    if held:
        words, n = merged()
        yield pa.record_batch([pa.array(words.view(np.int64)), pa.array(n)], names=["word", "n"])


def vocabulary(rows: DataFrame, common: int, classes: int) -> Vocabulary:
    """Counts every word of the corpus; the `common` most frequent (of equals the least hash) get symbols of their own in training."""
    counts = rows.mapInArrow(_word_counts, "word bigint, n bigint").groupBy("word").agg(F.sum("n").alias("n"))
    top = counts.orderBy(F.desc("n"), "word").limit(common).toArrow()
    return Vocabulary(top["word"].to_numpy().astype(np.int64).view(U) if top.num_rows else np.zeros(0, U), classes)


def _binary(values: np.ndarray, offsets: np.ndarray) -> pa.Array:
    """Slices of values between offsets, as bytes."""
    size = values.dtype.itemsize
    return pa.Array.from_buffers(pa.binary(), len(offsets) - 1, [None, pa.py_buffer((offsets * size).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(values))])


def _encode(vocab: Vocabulary):
    """Symbols of each text, and the hashes of its words that have no symbol of their own; buckets are runs of documents of about BUCKET words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, held = TaskContext.get().partitionId() << 32, 0
        for batch in batches:
            for s in slabs(batch.column(1)):
                symbols = vocab.encode(s.words)
                rare = symbols >= len(vocab.words)
                rows = len(s.offsets) - 1
                yield pa.record_batch(
                    [pa.array(np.full(rows, bucket)), batch.column(0).slice(s.row, rows), _binary(symbols, s.offsets), _binary(s.words[rare], np.append(0, np.cumsum(rare))[s.offsets])],
                    names=["bucket", "doc_id", "symbols", "rare"],
                )
                held += len(s.words)
                if held >= BUCKET:
                    bucket, held = bucket + 1, 0

    return run


class Model:
    """start (states), move (states, states), emit (symbols, states)."""

    def __init__(self, start: np.ndarray, move: np.ndarray, emit: np.ndarray):
        self.start, self.move, self.emit = start, move, emit
        self.peak = emit.max(1)
        self.relative = (emit / self.peak[:, None]).astype(np.float32)

    @classmethod
    def initial(cls, states: int, frequency: np.ndarray, seed: int) -> Model:
        """States that already differ and last: each favours its own tenth or so of the symbols, and stays with a chance of about 0.96.

        From states that are nearly alike Baum-Welch hardly rises for some ten rounds, so that no test of convergence could tell the end from the start.
        """
        rng = np.random.default_rng(seed)
        emit = frequency[:, None] * (rng.gamma(0.1, 1, (len(frequency), states)) + 0.01)
        move = rng.uniform(0.5, 1.5, (states, states)) + 25 * states * np.eye(states)
        return cls(np.full(states, 1 / states), move / move.sum(1, keepdims=True), emit / emit.sum(0))


def flattened(column: pa.Array | pa.ChunkedArray, kind: type) -> tuple[np.ndarray, np.ndarray]:
    """All values of a binary column one after another, and where each row begins."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.binary())
    if not len(column):
        return np.zeros(0, kind), np.zeros(1, np.int64)
    cuts = np.frombuffer(column.buffers()[1], np.int64 if pa.types.is_large_binary(column.type) else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = column.buffers()[2]
    flat = np.frombuffer(raw, np.uint8)[cuts[0] : cuts[-1]].view(kind) if raw is not None and cuts[-1] > cuts[0] else np.zeros(0, kind)
    return flat, (cuts - cuts[0]) // np.dtype(kind).itemsize


def forward(model: Model, chance: np.ndarray, first: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Exact log likelihood of each sequence, by the scaled forward recursion, all in step.

    chance: of each word under each state; the words of a sequence are first .. first + length.
    """
    out = np.zeros(len(first))
    order = np.argsort(-length, kind="stable")
    begin, size = first[order], length[order]
    live = int((size > 0).sum())
    total = np.zeros(live)
    alpha = np.broadcast_to(model.start, (live, len(model.start)))
    for t in range(int(size[0]) if live else 0):
        now = int(np.searchsorted(-size, -t, "left"))
        alpha = (alpha[:now] if t == 0 else alpha[:now] @ model.move) * chance[begin[:now] + t]
        scale = alpha.sum(1)
        total[:now] += np.log(scale)
        alpha = alpha / scale[:, None]
    out[order[:live]] = total
    return out


def segments(cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Text, number within it, first word and length of each segment, in order."""
    size = np.diff(cuts)
    pieces = -(-size // SEGMENT)
    doc = np.repeat(np.arange(len(size)), pieces)
    nth = np.arange(len(doc)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    first = cuts[doc] + nth * SEGMENT
    return doc, nth, first, np.minimum(SEGMENT, cuts[doc + 1] - first)


def _live(length: np.ndarray) -> list[int]:
    return np.searchsorted(-length, -np.arange(int(length[0])), "left").tolist()


def _chances(model: Model, flat: np.ndarray, first: np.ndarray, steps: int) -> tuple[np.ndarray, np.ndarray]:
    """Words of segments by step and segment, and their chances by step, state and segment, the likeliest state's being 1; beyond a segment's end they mean nothing."""
    at = flat[np.minimum(first[None] + np.arange(steps)[:, None], len(flat) - 1)]
    return at, np.ascontiguousarray(np.take(model.relative, at, axis=0).transpose(0, 2, 1))


def products(model: Model, flat: np.ndarray, first: np.ndarray, length: np.ndarray, opening: np.ndarray) -> np.ndarray:
    """For segments sorted by falling length: the chance, up to a factor, to go from each state before the segment to each at its end and emit its words.

    An opening segment starts in its first state, without a move.
    """
    states, live = len(model.start), _live(length)
    out = np.empty((len(first), states, states))
    _, seen = _chances(model, flat, first, len(live))
    to = model.move.T.astype(np.float32)
    # state at the end, state before, segment
    now = np.where(opening, np.eye(states, dtype=np.float32)[:, :, None], to[:, :, None]) * seen[0][:, None]
    for t, n in enumerate(live[1:], 1):
        if n < now.shape[2]:
            out[n : now.shape[2]] = now[:, :, n:].transpose(2, 1, 0)
            now = np.ascontiguousarray(now[:, :, :n])
        now = (to @ now.reshape(states, -1)).reshape(states, states, n)
        now *= seen[t, :, None, :n]
        if t % 4 == 3:
            now /= now.sum((0, 1))
    out[: now.shape[2]] = now.transpose(2, 1, 0)
    return out / out.sum((1, 2))[:, None, None]


def boundaries(model: Model, flat: np.ndarray, doc: np.ndarray, nth: np.ndarray, first: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """What each segment hears from the rest of its text: the states before it given all earlier words, and how likely each state at its end makes all later ones.

    Both up to a factor; the segments of one text stand in order.
    """
    states = len(model.start)
    before, after = np.empty((len(doc), states)), np.ones((len(doc), states))
    before[nth == 0] = model.start
    pieces = np.bincount(doc)[doc] if len(doc) else nth
    many = np.flatnonzero(pieces > 1)
    if not len(many):
        return before, after
    order = many[np.argsort(-length[many], kind="stable")]
    through = np.empty((len(doc), states, states))
    for lo in range(0, len(order), _ROWS):
        at = order[lo : lo + _ROWS]
        through[at] = products(model, flat, first[at], length[at], nth[at] == 0)
    ranks = [many[nth[many] == j] for j in range(int(nth[many].max()) + 1)]
    for at in ranks[1:]:
        v = np.einsum("ns,nst->nt", before[at - 1], through[at - 1])
        before[at] = v / v.sum(1, keepdims=True)
    for at in ranks[:0:-1]:
        v = np.einsum("nst,nt->ns", through[at], after[at])
        after[at - 1] = v / v.sum(1, keepdims=True)
    return before, after


def _segment_counts(model: Model, flat: np.ndarray, first: np.ndarray, length: np.ndarray, opening: np.ndarray, before: np.ndarray, after: np.ndarray):
    """Of segments sorted by falling length: start and move counts, log likelihood, and by step, state and segment the chance of each state, 0 beyond an end."""
    live = _live(length)
    steps, rows = len(live), len(first)
    at, ahead = _chances(model, flat, first, steps)  # becomes emissions over scales
    alpha = np.zeros_like(ahead)
    scale = np.ones((steps, rows), np.float32)
    to, back = model.move.T.astype(np.float32), model.move.astype(np.float32)
    heard = before.T.astype(np.float32)
    now = np.where(opening, heard, to @ heard)
    for t, n in enumerate(live):
        if t:
            now = to @ now[:, :n]
        now *= ahead[t, :, :n]
        total = np.sum(now, 0, out=scale[t, :n])
        now /= total
        alpha[t, :, :n] = now
        ahead[t, :, :n] /= total
    fit = float(np.log(scale).sum(dtype=np.float64))
    beta = (after.T / np.einsum("ns,ns->n", alpha[length - 1, :, np.arange(rows)], after)).astype(np.float32)
    moves = np.zeros(model.move.shape)
    heard *= ~opening
    for t in range(steps - 1, -1, -1):
        n = live[t]
        now = ahead[t, :, :n] * beta[:, :n]
        alpha[t, :, :n] *= beta[:, :n]
        moves += (alpha[t - 1, :, :n] if t else heard[:, :n]) @ now.T  # alpha of the step before is still plain
        if t:
            beta[:, :n] = back @ now
    return alpha[0][:, opening].sum(1, dtype=np.float64), moves * model.move, fit, at, alpha


def expected(model: Model, flat: np.ndarray, cuts: np.ndarray, tell: Callable[[np.ndarray, np.ndarray, np.ndarray], None]) -> tuple[np.ndarray, np.ndarray, float]:
    """Baum-Welch statistics of whole texts: starts, moves, log likelihood. tell() gets places of words in flat, the words, and by step, state and segment their chances of each state.

    Texts are worked on in segments; by the messages of boundaries() that is the same as the recursion over each whole text.
    """
    doc, nth, first, length = segments(cuts)
    starts, moves, fit = np.zeros(len(model.start)), np.zeros_like(model.move), float(np.log(model.peak)[flat].sum())
    before, after = boundaries(model, flat, doc, nth, first, length)
    order = np.argsort(-length, kind="stable")
    for lo in range(0, len(order), _ROWS):
        at = order[lo : lo + _ROWS]
        a, b, c, words, gamma = _segment_counts(model, flat, first[at], length[at], nth[at] == 0, before[at], after[at])
        starts, moves, fit = starts + a, moves + b, fit + c
        steps = np.arange(len(words))[:, None]
        tell(np.where(steps < length[at], first[at] + steps, -1), words, gamma)
    return starts, moves, fit


def _batches_of_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Not more rows at a time than have about a megabyte of symbols; a longer text comes alone."""
    for batch in batches:
        if batch.num_rows:
            _, cuts = flattened(batch.column("symbols"), np.uint16)
            for lo, hi in slab_bounds(cuts, 1 << 19):
                yield batch.slice(lo, hi - lo)


def _expect(model: Model | None, symbols: int, states: int):
    """Statistics of a partition: rows -2 (log likelihood, texts), -1 (starts), 0.. (moves), then emissions by symbol. Without a model, symbol counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        starts, moves, emits, fit, n = np.zeros(states), np.zeros((states, states)), np.zeros((states, symbols)), 0.0, 0
        for batch in _batches_of_texts(batches):
            flat, cuts = flattened(batch.column("symbols"), np.uint16)
            if model is None:
                emits[0] += np.bincount(flat, minlength=symbols)
                continue

            def tell(place: np.ndarray, words: np.ndarray, gamma: np.ndarray) -> None:
                at = words.ravel()
                for s in range(states):
                    emits[s] += np.bincount(at, gamma[:, s].ravel(), minlength=symbols)

            a, b, c = expected(model, flat, cuts, tell)
            starts, moves, fit, n = starts + a, moves + b, fit + c, n + batch.num_rows
        head = np.zeros((2, states))
        head[0, :1], head[0, 1:2], head[1] = fit, n, starts
        rows = np.concatenate([head, moves, emits.T])
        some = np.flatnonzero(rows.any(1))
        yield pa.record_batch([pa.array(some - 2), *[pa.array(rows[some, s]) for s in range(states)]], names=["at", *[f"s{s}" for s in range(states)]])

    return run


def _totals(encoded: DataFrame, model: Model | None, symbols: int, states: int) -> np.ndarray:
    cols = [f"s{s}" for s in range(states)]
    part = encoded.select("symbols").mapInArrow(_expect(model, symbols, states), "at bigint, " + ", ".join(f"{c} double" for c in cols))
    got = part.groupBy("at").agg(*[F.sum(c).alias(c) for c in cols]).toArrow()
    out = np.zeros((2 + states + symbols, states))
    if got.num_rows:
        out[got["at"].to_numpy() + 2] = np.stack([got[c].to_numpy() for c in cols], 1)
    return out


def train(encoded: DataFrame, symbols: int, states: int, rounds: int | None, smooth: float, seed: int, tolerance: float = 1e-3, head: int = 8) -> tuple[Model, Model, np.ndarray, list[float]]:
    """Baum-Welch over all texts until a round raises the log likelihood a word by less than `tolerance`; rounds, if given, is the most.

    The start is found by the same rounds over one text in `head` (by hashed id); what is returned has been fitted to all texts. Each round's
    counts are added up across partitions; smooth is added to every count. Returns the model, that of the round before, the emission counts that led from this to that, and the
    log likelihood a word of every round over all texts.
    """
    counts = _totals(encoded, None, symbols, states)[2 + states :, 0] + smooth
    model = Model.initial(states, counts / counts.sum(), seed)
    fits: list[float] = []
    for part in [encoded.filter(F.pmod(F.xxhash64("doc_id"), F.lit(head)) == 0)] * (head > 1) + [encoded]:
        fits.clear()
        for _ in count() if rounds is None else range(rounds):
            total = _totals(part, model, symbols, states)
            words = total[2 + states :].sum()
            if not words:
                break
            start, move, emit = total[1] + smooth, total[2 : 2 + states] + smooth, total[2 + states :] + smooth / symbols
            old, model = model, Model(start / start.sum(), move / move.sum(1, keepdims=True), emit / emit.sum(0))
            fits.append(total[0, 0] / words)
            if len(fits) > 1 and fits[-1] - fits[-2] < tolerance:
                break
    return (model, old, total[2 + states :], fits) if fits else (model, model, np.zeros((symbols, states)), fits)


def _parted(words: np.ndarray, parts: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct words in order of their parts and then their hashes, the part of each, and where each of the given words stands among them."""
    seen, at = np.unique(words, return_inverse=True)
    part = ((mix(seen) >> U(20)) % U(parts)).astype(np.int64)
    order = np.argsort(part, kind="stable")
    place = np.empty(len(seen), np.int64)
    place[order] = np.arange(len(seen))
    return seen[order], part[order], place[at]


def _rare_states(model: Model, named: int, parts: int):
    """For each bucket and each of its words without a symbol of its own: the expected number of times in each state. One row for each part of the words."""
    states = len(model.start)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        bucket = None

        def out() -> pa.RecordBatch:
            seen, part, at = _parted(np.concatenate([w for w, _ in held]), parts)
            each = np.concatenate([g for _, g in held])
            gamma = np.stack([np.bincount(at, each[:, s], minlength=len(seen)) for s in range(states)], 1).astype(np.float32)
            cuts = np.append(np.flatnonzero(np.append(True, part[1:] != part[:-1])[: len(part)]), len(part))
            return pa.record_batch(
                [pa.array(np.full(len(cuts) - 1, bucket, np.int64)), pa.array(part[cuts[:-1]].astype(np.int32)), _binary(seen, cuts), _binary(gamma.ravel(), cuts * states)], names=["bucket", "part", "words", "states"]
            )

        for batch in _batches_of_texts(batches):
            flat, cuts = flattened(batch.column("symbols"), np.uint16)
            which = batch.column("bucket").to_numpy()
            gammas = np.zeros((len(flat), states), np.float32)

            def tell(place: np.ndarray, words: np.ndarray, gamma: np.ndarray, gammas: np.ndarray = gammas) -> None:
                some = (place >= 0) & (words >= named)
                gammas[place[some]] = gamma.transpose(0, 2, 1)[some]

            expected(model, flat, cuts, tell)
            gammas = gammas[flat >= named]
            words, at = flattened(batch.column("rare"), U)
            edges = np.append(np.flatnonzero(np.append(True, which[1:] != which[:-1])), len(which))
            for a, z in pairwise(edges.tolist()):
                if which[a] != bucket:
                    if held:
                        yield out()
                    held, bucket = [], int(which[a])
                if at[z] > at[a]:
                    held.append((words[at[a] : at[z]], gammas[at[a] : at[z]]))
        if held:
            yield out()

    return run


def _untied(total: np.ndarray, named: int, prior: float):
    """The chance of each word within its class, for each state: its expected counts over all buckets, the class's count shares worth `prior` words added."""
    states = total.shape[1]

    def make(t: pa.Table) -> Iterator[pa.RecordBatch]:
        word, cuts = flattened(t["words"], U)
        gamma = flattened(t["states"], np.float32)[0].reshape(-1, states)
        seen, at = np.unique(word, return_inverse=True)
        sums = np.stack([np.bincount(at, gamma[:, s], minlength=len(seen)) for s in range(states)], 1)
        of = total[named + (mix(seen) % U(len(total) - named)).astype(np.int64)]
        share = ((sums + prior * (sums.sum(1) / np.maximum(of.sum(1), 1e-12))[:, None]) / (of + prior)).astype(np.float32)
        step = max(1, int(np.searchsorted(cuts, _SLICE)))
        for lo in range(0, t.num_rows, step):
            hi = min(t.num_rows, lo + step)
            body = share[at[cuts[lo] : cuts[hi]]]
            yield pa.record_batch([*[t[c].slice(lo, hi - lo).combine_chunks() for c in ("bucket", "part")], _binary(body.ravel(), (cuts[lo : hi + 1] - cuts[lo]) * states)], names=["bucket", "part", "states"])

    return make


def _score(model: Model, named: int, parts: int):
    states = len(model.start)

    def make(texts_: pa.Table, words: pa.Table) -> pa.Table:
        rare, _ = flattened(texts_["rare"], U)
        if len(rare):
            _, _, at = _parted(rare, parts)
            share = flattened(words.sort_by("part")["states"], np.float32)[0].reshape(-1, states)
        flat, cuts = flattened(texts_["symbols"], np.uint16)
        value, known = np.zeros(texts_.num_rows), 0
        for lo, hi in slab_bounds(cuts, _SLICE):
            part = flat[cuts[lo] : cuts[hi]]
            chance, own = model.emit[part], part >= named
            n = int(own.sum())
            if n:
                chance[own] *= share[at[known : known + n]]
            known += n
            value[lo:hi] = forward(model, chance, cuts[lo:hi] - cuts[lo], np.diff(cuts[lo : hi + 1]))
        n = np.diff(cuts)
        return pa.table({"doc_id": texts_["doc_id"], "n_words": pa.array(n.astype(np.int32)), "log_likelihood": pa.array(value), "per_word": pa.array(value / np.maximum(1, n), mask=n == 0)})

    return make


def score(
    docs: DataFrame,
    states: int = 8,
    rounds: int | None = None,
    common: int = 8000,
    classes: int = 192,
    smooth: float = 0.01,
    prior: float = 1.0,
    seed: int = 1,
    id_col: str = "doc_id",
    text_col: str = "text",
    tolerance: float = 1e-3,
    head: int = 8,
) -> DataFrame:
    """doc_id, n_words, log_likelihood (natural log), per_word: how likely each document is under a hidden Markov model of the corpus.

    Baum-Welch over all whole texts trains `states` latent states until a round raises the log likelihood a word by less than `tolerance`
    (nats), or for at most `rounds` rounds if given (see train() for its start); the scaled forward recursion gives the exact likelihood of the
    whole sequence of words (see words.py), whatever its length. While the states are trained, all but the `common` most frequent words share `classes` hashed classes. The last
    round unties them: every word of the corpus gets emission chances of its own from its own expected counts (see _untied), kept as a table
    that grows with the corpus and is joined to the documents in buckets. For each state these chances sum to one over the corpus's words.

    A null id leaves the row out; a null or empty text and one without words has likelihood 1 (log 0) and no per_word;
    rows that share an id count once, see common.texts; words equally frequent at the border of `common` go by the lowest hash; an empty table gives an empty result; other
    columns are ignored.
    """
    if common + classes > 1 << 16:
        raise ValueError("there are at most 65536 symbols")
    session(docs)
    rows = texts(docs, id_col, text_col)
    vocab = vocabulary(rows, common, classes)
    named = len(vocab.words)
    encoded = cut(rows.mapInArrow(_encode(vocab), ENCODED))
    model, old, total, _ = train(encoded, vocab.size, states, rounds, smooth, seed, tolerance, head)
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    counts = encoded.mapInArrow(_rare_states(old, named, parts), "bucket bigint, part int, words binary, states binary")
    words = whole_partitions(counts, [F.col("part")], _untied(total, named, prior), "bucket bigint, part int, states binary", parts=parts, numbered=True)
    return encoded.groupBy("bucket").cogroup(words.groupBy("bucket")).applyInArrow(_score(model, named, parts), SCORED)
