"""Language identification with a blended-spectrum presence kernel, Nystroem landmarks and kernel ridge regression."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import keep_columns, session, texts
from .words import fold, slab_bounds, text_buffers

SLOTS = 1 << 16
SCORED = "doc_id bigint, language string, score double, margin double, known double, accepted boolean"
_BLOCK = 64


def presence(body: np.ndarray, offsets: np.ndarray, max_n: int) -> np.ndarray:
    """Which hashed n-grams (1 to max_n bytes, case folded, everything outside of words one blank) each text has: boolean (texts, SLOTS)."""
    n = len(offsets) - 1
    out = np.zeros((n, SLOTS), bool)
    if not len(body):
        return out
    low, inside = fold(body)
    blank = ~inside
    text = np.where(blank, np.uint8(32), low)
    keep = ~blank
    keep[1:] |= inside[:-1]
    keep[offsets[:-1][offsets[:-1] < len(body)]] |= True
    kept = np.append(0, np.cumsum(keep))
    text, cuts = text[keep].astype(np.uint32), kept[offsets]
    doc = np.repeat(np.arange(n, dtype=np.int64) * SLOTS, np.diff(cuts))
    end = np.repeat(cuts[1:], np.diff(cuts))
    flat, code = out.reshape(-1), np.zeros(len(text), np.uint32)
    for size in range(1, max_n + 1):
        if size > len(text):
            break
        code = (code[: len(text) - size + 1] << np.uint32(8)) | text[size - 1 :]
        slot = ((code + np.uint32(size << 28)) * np.uint32(2654435761)) >> np.uint32(16)
        whole = np.arange(len(code)) + size <= end[: len(code)]
        flat[(doc[: len(code)] + slot)[whole]] = True
    # A text of blanks alone has no n-grams.
    out[np.add.reduceat(np.append(inside, False), np.minimum(offsets[:-1], len(body)), dtype=np.int64) * (np.diff(offsets) > 0) == 0] = False
    return out


def blocks(text: pa.Array, max_n: int) -> Iterator[tuple[int, np.ndarray]]:
    """(first row, presence matrix) of a few texts at a time."""
    offsets, body = text_buffers(text)
    for lo, hi in slab_bounds(offsets, 1 << 18):
        for a in range(lo, hi, _BLOCK):
            b = min(a + _BLOCK, hi)
            yield a, presence(body[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], max_n)


class Model:
    """One-versus-rest kernel ridge regression over Nystroem features.

    kernel(x, y) = common n-grams / sqrt(n-grams of x * n-grams of y). With landmarks L, features are
    k(x, L) K(L, L)^(-1/2); both factors and the regression weights are kept as one matrix over the landmarks.
    """

    def __init__(self, samples: np.ndarray, labels: list[str], per_class: int, ridge: float, max_n: int):
        """samples: presence of each slot, as booleans or as packed bits."""
        self.max_n = max_n
        self.classes = sorted(set(labels))
        y = np.array([self.classes.index(x) for x in labels])
        marks = np.concatenate([np.flatnonzero(y == c)[:per_class] for c in range(len(self.classes))])
        bits = lambda rows: np.unpackbits(samples[rows], axis=1).astype(bool) if samples.dtype == np.uint8 else samples[rows]
        chosen = bits(marks)
        self.columns = np.flatnonzero(chosen.any(0))
        held = chosen[:, self.columns].astype(np.float32)
        size = np.sqrt(chosen.sum(1))
        self.table = (held / size[:, None].astype(np.float32)).T.copy()
        k = np.concatenate([self.kernel(bits(slice(a, a + 128))) for a in range(0, len(samples), 128)])
        value, vector = np.linalg.eigh(k[marks])
        some = value > 1e-6 * value.max()
        root = vector[:, some] / np.sqrt(value[some])
        features = np.concatenate([k @ root, np.ones((len(k), 1))], 1)
        target = np.where(y[:, None] == np.arange(len(self.classes)), 1.0, -1.0)
        penalty = ridge * len(k) * np.eye(features.shape[1])
        penalty[-1, -1] = 0
        weights = np.linalg.solve(features.T @ features + penalty, features.T @ target)
        self.weights, self.bias = root @ weights[:-1], weights[-1]

    def kernel(self, x: np.ndarray) -> np.ndarray:
        size = np.sqrt(np.maximum(1, x.sum(1)))
        return (x[:, self.columns].astype(np.float32) @ self.table).astype(np.float64) / size[:, None]

    def scores(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Regression values of each class, and the share of a text's n-grams that some landmark has."""
        return self.kernel(x) @ self.weights + self.bias, x[:, self.columns].sum(1) / np.maximum(1, x.sum(1))


def _presences(max_n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, x in blocks(batch.column(2), max_n):
                part = batch.slice(row, len(x))
                yield pa.record_batch([part.column(0), part.column(1), pa.array([v.tobytes() for v in np.packbits(x, axis=1)], pa.binary())], names=["doc_id", "label", "bits"])

    return run


def train(docs: DataFrame, per_language: int = 600, landmarks: int = 32, ridge: float = 1e-3, max_n: int = 3, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang") -> Model | None:
    """Fit on at most `per_language` labelled texts of each language, those whose ids hash lowest; `landmarks` of them are landmarks.

    Rows with a null id, label or text, or a text without words, don't count. None without any labelled row.
    """
    session(docs)
    keys = docs.select(docs[id_col].cast("bigint").alias("doc_id"), docs[label_col].cast("string").alias("label")).filter("doc_id is not null and label is not null")
    order = Window.partitionBy("label").orderBy(F.xxhash64("doc_id"), "doc_id")
    chosen = keys.withColumn("nth", F.row_number().over(order)).filter(F.col("nth") <= per_language).select(F.col("doc_id").alias("__lexsieve_id")).distinct()
    rows = docs.join(F.broadcast(chosen), docs[id_col].cast("bigint") == chosen["__lexsieve_id"], "left_semi")
    rows = rows.select(docs[id_col].cast("bigint").alias("doc_id"), docs[label_col].cast("string").alias("label"), docs[text_col].cast("string").alias("text")).filter("text is not null and label is not null")
    got = rows.mapInArrow(_presences(max_n), "doc_id bigint, label string, bits binary").toPandas()
    if not len(got):
        return None
    got["rank"] = [hash_rank(i) for i in got["doc_id"]]
    got = got.sort_values(["rank", "doc_id", "label", "bits"])
    samples = np.frombuffer(b"".join(got["bits"]), np.uint8).reshape(len(got), -1)
    some = samples.any(1)
    labels = [x for x, s in zip(got["label"], some) if s]
    return Model(samples[some], labels, landmarks, ridge, max_n) if labels else None


def hash_rank(key: int) -> int:
    return (key * 0x9E3779B97F4A7C15 ^ (key >> 7)) & 0xFFFFFFFFFFFFFFFF


def _score(model: Model, least_known: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, x in blocks(batch.column(1), model.max_n):
                value, known = model.scores(x)
                best = value.argmax(1)
                top = value[np.arange(len(x)), best]
                rest = value.copy()
                rest[np.arange(len(x)), best] = -np.inf
                margin = np.where(len(model.classes) > 1, top - rest.max(1, initial=-1e9), top)
                some = x.any(1)
                accepted = some & (known >= least_known)
                yield pa.record_batch(
                    [
                        batch.column(0).slice(row, len(x)),
                        pa.array(np.array(model.classes, object)[best], pa.string(), mask=~some),
                        pa.array(top, mask=~some),
                        pa.array(margin, mask=~some),
                        pa.array(known, mask=~some),
                        pa.array(accepted),
                    ],
                    names=["doc_id", "language", "score", "margin", "known", "accepted"],
                )

    return run


def identify(docs: DataFrame, model: Model | None, least_known: float = 0.5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, language, score, margin, known, accepted: one row for each document.

    The whole text counts. `language` has the highest one-versus-rest value (the first in alphabetical order, if tied), `margin` is its lead over the next.
    A document is rejected if fewer than `least_known` of its n-grams occur in any landmark: it is in none of the
    languages that the model knows.
    A null id leaves the row out; a null or empty text and one without words has no language and is rejected; rows that
    share an id count once, see common.texts; without a model (no labelled rows) every document is rejected; an empty
    table gives an empty result; other columns are ignored.
    """
    rows = texts(docs, id_col, text_col)
    if model is None:
        none = F.lit(None)
        return rows.select("doc_id", none.cast("string").alias("language"), *[none.cast("double").alias(c) for c in ("score", "margin", "known")], F.lit(False).alias("accepted"))
    return rows.mapInArrow(_score(model, least_known), SCORED)


def keep_accepted(docs: DataFrame, scored: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """docs without the rejected; rows with a null id go too."""
    return keep_columns(docs, scored.filter("accepted"), "left_semi", id_col)
