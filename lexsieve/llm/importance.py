"""Quality selection by importance resampling over hashed n-grams."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, session, texts, whole_partitions
from .words import U, mix, powers, slab_bounds, text_buffers

SCORED = "doc_id bigint, log_weight double, key double"
_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 28, 29, 30, 31, 32]] = True


def tokens(text: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, offsets, hashes) of the tokens between white space, as written: case and marks tell quality."""
    offsets, body = text_buffers(text)
    for lo, hi in slab_bounds(offsets):
        part, cuts = body[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        inside = ~_BLANK[part]
        first, last = inside.copy(), inside.copy()
        first[1:] &= ~inside[:-1]
        last[:-1] &= ~inside[1:]
        edge = cuts[:-1][cuts[:-1] < len(part)]
        first[edge] |= inside[edge]
        edge = cuts[1:][cuts[1:] > 0] - 1
        last[edge] |= inside[edge]
        start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
        total = np.zeros(len(part) + 1, U)
        value = mix((part.astype(U) + U(1)) * U(0x2545F4914F6CDD1D))
        np.cumsum(value * powers(len(part)), out=total[1:])
        inverse = pow(0x9E3779B97F4A7C15, -1, 1 << 64)
        hashed = mix((total[end] - total[start]) * powers(len(part) + 1, inverse)[start] + (end - start).astype(U))
        yield lo, np.searchsorted(start, cuts, "left"), hashed


def features(offsets: np.ndarray, hashed: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, bucket, occurrences) of its distinct hashed unigrams and bigrams."""
    doc = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    pair = mix(hashed[:-1] * U(0x9E3779B97F4A7C15) + hashed[1:])
    same = doc[1:] == doc[:-1]
    at = (np.concatenate([hashed, pair[same]]) % U(buckets)).astype(np.int64)
    key = np.sort(np.concatenate([doc, doc[1:][same]]) * buckets + at)
    head = np.flatnonzero(np.append(True, key[1:] != key[:-1])[: len(key)])
    return key[head] // buckets, key[head] % buckets, np.diff(np.append(head, len(key)))


_SLICE = 1 << 12


def _counts(buckets: int):
    """How often the n-grams of each bucket occur in a partition's documents, in the target and in all; in slices of buckets, compressed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        target, raw = np.zeros(buckets, np.uint32), np.zeros(buckets, np.uint32)
        for batch in batches:
            good = batch.column(2).to_numpy(zero_copy_only=False)
            for row, offsets, hashed in tokens(batch.column(1)):
                doc, bucket, n = features(offsets, hashed, buckets)
                raw += np.bincount(bucket, n, minlength=buckets).astype(np.uint32)
                mine = good[row + doc]
                target += np.bincount(bucket[mine], n[mine], minlength=buckets).astype(np.uint32)
        both = np.stack([target, raw]).view(np.uint8).reshape(2, buckets, 4)
        at = range(0, buckets, _SLICE)
        body = [zlib.compress(both[:, a : a + _SLICE].transpose(0, 2, 1).tobytes(), 1) for a in at]
        yield pa.record_batch([pa.array(list(at), pa.int64()), pa.array(body, pa.binary())], names=["at", "counts"])

    return run


def _added(t: pa.Table) -> pa.Table:
    total: dict[int, np.ndarray] = {}
    for at, body in zip(t["at"].to_pylist(), t["counts"].to_pylist()):
        planes = np.frombuffer(zlib.decompress(body), np.uint8).reshape(2, 4, -1)
        counts = np.ascontiguousarray(planes.transpose(0, 2, 1)).view(np.uint32)[..., 0].astype(np.int64)
        total[at] = total[at] + counts if at in total else counts
    bucket = np.concatenate([a + np.arange(c.shape[1]) for a, c in total.items()])
    target, raw = np.concatenate(list(total.values()), axis=1)
    some = raw > 0
    return pa.table({"bucket": pa.array(bucket[some]), "target": pa.array(target[some]), "raw": pa.array(raw[some])})


class Ratios:
    """Smoothed generative models of target and raw text over the buckets where the two differ.

    Both are counts of occurrences; raw counts are scaled to the target's mass, `prior` is added to each. A log
    ratio is drawn towards 0 by `errors` of its standard errors, so that the sampling noise of thousands of rare n-grams
    doesn't add up; buckets that noise alone explains are left out.
    """

    def __init__(self, bucket: np.ndarray, target: np.ndarray, raw: np.ndarray, scale: float, buckets: int, prior: float, errors: float):
        self.bucket, self.target, self.raw = bucket, target.astype(np.float64), raw.astype(np.float64)
        self.scale, self.buckets, self.prior, self.errors = scale, buckets, prior, errors

    def log_ratio(self, target: np.ndarray, raw: np.ndarray) -> np.ndarray:
        t, r = target + self.prior, np.maximum(raw, 0) * self.scale + self.prior
        full = np.log(t) - np.log(r)
        return np.sign(full) * np.maximum(0, np.abs(full) - self.errors * np.sqrt(1 / t + 1 / r))

    def weights(self, doc: np.ndarray, bucket: np.ndarray, n: np.ndarray, good: np.ndarray, docs: int, bound: float) -> np.ndarray:
        """Log importance weight of each document, a bag of n-grams; its own n-grams are not counted in the models.

        Raw text holds the target with a share of exp(-bound), so that no document can be more than exp(bound) times likelier in the target.
        """
        if not hasattr(self, "_place"):
            self._place = np.full(self.buckets, -1, np.int32)
            self._place[self.bucket] = np.arange(len(self.bucket), dtype=np.int32)
        at = self._place[bucket]
        some = at >= 0
        doc, at, n = doc[some], at[some], n[some]
        value = self.log_ratio(self.target[at] - n * good[doc], self.raw[at] - n)
        return np.minimum(np.bincount(doc, value * n, minlength=docs)[:docs], bound)


def _score(ratios: Ratios | None, bound: float, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            good = batch.column(2).to_numpy(zero_copy_only=False)
            weight = np.zeros(len(ids))
            if ratios:
                for row, offsets, hashed in tokens(batch.column(1)):
                    n = len(offsets) - 1
                    weight[row : row + n] = ratios.weights(*features(offsets, hashed, ratios.buckets), good[row : row + n], n, bound)
            unit = (mix(mix(ids.astype(np.int64).view(U) + U(1)) + U(seed)) >> U(11)).astype(np.float64) / float(1 << 53)
            noise = -np.log(-np.log(np.clip(unit, 1e-300, 1 - 1e-16)))
            yield pa.record_batch([batch.column(0), pa.array(weight), pa.array(weight + noise)], names=["doc_id", "log_weight", "key"])

    return run


def train(rows: DataFrame, buckets: int, prior: float, errors: float) -> Ratios | None:
    """Models of rows(doc_id, text, good); None without any target n-gram."""
    slices = rows.mapInArrow(_counts(buckets), "at bigint, counts binary")
    counts = cut(whole_partitions(slices, ["at"], _added, "bucket bigint, target bigint, raw bigint"))
    target, raw = counts.agg(F.sum("target"), F.sum("raw")).first()
    if not target:
        return None
    scale = target / raw
    t, r = F.col("target") + F.lit(prior), F.col("raw") * F.lit(scale) + F.lit(prior)
    differs = F.abs(F.log(t) - F.log(r)) > F.lit(errors) * F.sqrt(1 / t + 1 / r)
    got = counts.filter(differs).toArrow().sort_by("bucket")
    return Ratios(*(got[c].to_numpy() for c in ("bucket", "target", "raw")), scale, buckets, prior, errors)


def top_by_key(scored: DataFrame, k: int) -> DataFrame:
    """The k rows with the highest key, of equal keys those with the lowest doc_id, without a global sort.

    The k-th key is found by counting rows in ever narrower intervals.
    """
    n, lo, hi = scored.agg(F.count("*"), F.min("key"), F.max("key")).first()
    if k >= n:
        return scored
    if k <= 0:
        return scored.limit(0)
    above, bins = 0, 4096
    while hi > lo:
        width = (hi - lo) / bins
        if width == 0 or lo + width == lo:
            break
        inside = scored.filter(F.col("key").between(lo, hi))
        at = F.least(F.floor((F.col("key") - F.lit(lo)) / F.lit(width)), F.lit(bins - 1))
        got = sorted(((r["at"], r["n"], r["a"], r["z"]) for r in inside.groupBy(at.alias("at")).agg(F.count("*").alias("n"), F.min("key").alias("a"), F.max("key").alias("z")).collect()), reverse=True)
        for _, count, a, z in got:
            if above + count >= k:
                lo, hi, held = a, z, count
                break
            above += count
        if held <= 1024:
            break
    rest = k - above
    edge = scored.filter(F.col("key").between(lo, hi)).orderBy(F.desc("key"), "doc_id").limit(rest)
    return scored.filter(F.col("key") > hi).unionByName(edge)


def resample(
    docs: DataFrame,
    labels: DataFrame,
    keep: float | None = None,
    buckets: int = 1 << 20,
    prior: float = 0.5,
    errors: float = 2.0,
    target_docs: int = 100_000,
    seed: int = 7,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_id_col: str = "doc_id",
    quality_col: str = "quality",
    toxic_col: str = "toxic",
) -> DataFrame:
    """A sample, without replacement, of documents that look like the target: doc_id, log_weight, key.

    The target texts are the documents labelled quality 1 and toxic 0, at most `target_docs` of them, those whose ids hash
    lowest; the raw texts are all documents. Each document is the bag of its hashed unigrams and bigrams (tokens between white space, as written), each side
    the number of times that each occurs; see Ratios for the smoothing. A document's log weight sums the log ratios of all n-grams of its whole text and
    is at most -ln(share of the target). The k documents with
    the highest weight plus Gumbel noise are the sample; k is the share `keep` of the documents, by default the target's share among the
    labelled. The noise is a hash of the id and `seed`, so that a run can be repeated.

    A null id leaves a row out of docs and labels; a null or empty text has weight 0; rows that share an id count once, see
    common.texts; an id labelled more than once is a target if its lowest quality is 1 and its highest toxicity 0, nulls not counted;
    without any target text all weights are 0, and the share is 1 unless given; equal keys go to the lowest id; an empty
    table gives an empty result; other columns are ignored.
    """
    session(docs)
    rows = texts(docs, id_col, text_col)
    marks = labels.select(labels[label_id_col].cast("bigint").alias("doc_id"), labels[quality_col].cast("int").alias("q"), labels[toxic_col].cast("int").alias("t")).filter("doc_id is not null")
    marks = marks.groupBy("doc_id").agg((F.coalesce(F.min("q") == 1, F.lit(False)) & F.coalesce(F.max("t") == 0, F.lit(False))).alias("good"))
    marks = cut(rows.select("doc_id").join(marks, "doc_id"))
    known, good = marks.agg(F.count("*"), F.count_if("good")).first()
    share = good / known if good else 1.0
    ids = marks.filter("good").orderBy(F.xxhash64("doc_id"), "doc_id").limit(target_docs).select(F.col("doc_id").alias("__good"))
    marked = rows.join(F.broadcast(ids), rows["doc_id"] == ids["__good"], "left").select("doc_id", "text", F.col("__good").isNotNull().alias("good"))
    ratios = train(marked, buckets, prior, errors)
    scored = cut(marked.mapInArrow(_score(ratios, -float(np.log(share)), seed), SCORED))
    return top_by_key(scored, round((share if keep is None else keep) * scored.count()))
