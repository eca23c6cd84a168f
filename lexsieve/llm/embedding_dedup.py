"""Near-duplicate embeddings by product quantisation over inverted lists."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, cut, session, whole_partitions

UNIT = "vec_id bigint, vec binary"


def matrix(column: pa.Array, dim: int) -> np.ndarray:
    """Rows of equal length kept as float32 bytes."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return np.frombuffer(b"".join(column.to_pylist()), np.float32).reshape(-1, dim)


def _unit(dim: int, width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            flat = batch.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
            size = np.sqrt((flat**2).sum(1))
            ok = np.isfinite(size) & (size > 0)
            unit = np.pad(flat[ok] / size[ok, None], ((0, 0), (0, width - dim))).astype(np.float32)
            yield pa.record_batch([pa.array(ids[ok]), pa.array([v.tobytes() for v in unit], pa.binary())], names=["vec_id", "vec"])

    return run


def unit_vectors(vectors: DataFrame, id_col: str, vec_col: str, subspaces: int) -> tuple[DataFrame, int, int]:
    """(vec_id, unit vector as bytes), one row per id, the dimension, and the number of subspaces, one for each element at most.

    Zeros are appended up to a dimension that the number of subspaces divides.

    The length of the vectors is the commonest (the least, if tied). Ids that are null or no integers, null or empty vectors, vectors of another length or with a
    null, infinite or NaN element, and zero vectors are left out; of rows that share an id the least vector stays.
    """
    session(vectors)
    rows = vectors.select(vectors[id_col].try_cast("bigint").alias("vec_id"), vectors[vec_col].cast("array<double>").alias("v"))
    rows = rows.filter("vec_id is not null and size(v) > 0 and not exists(v, x -> x is null)")
    sizes = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    dim = sizes["n"] if sizes else 1
    one = rows.filter(F.size("v") == dim).groupBy("vec_id").agg(F.min("v").alias("v"))
    subspaces = min(subspaces, dim)
    width = -(-dim // subspaces) * subspaces
    return one.mapInArrow(_unit(dim, width), UNIT), width, subspaces


def nearest(x: np.ndarray, centres: np.ndarray, k: int = 1) -> np.ndarray:
    """Numbers of the k nearest centres of each row, nearest first."""
    out = np.empty((len(x), min(k, len(centres))), np.int64)
    norm = (centres**2).sum(1) / 2
    for lo in range(0, len(x), 4096):
        d = norm - x[lo : lo + 4096] @ centres.T
        if k == 1:
            out[lo : lo + 4096, 0] = d.argmin(1)
        else:
            out[lo : lo + 4096] = np.argsort(d, axis=1, kind="stable")[:, : out.shape[1]]
    return out


def groups_of(n: int, size: int) -> int:
    """How many coarse groups n vectors get: of `size` each, but not more than sqrt(96 n), beyond which comparing a vector with all centres, which every task
    holds, costs more than longer groups do; that begins at 25 million vectors for groups of 512."""
    return max(1, int(np.ceil(min(n / size, np.sqrt(96.0 * n)))))


def _sums(centres: np.ndarray, books: np.ndarray | None, dim: int):
    """Per cluster of this partition: sum and number of vectors. Without books of the coarse clusters, else of each subspace's residuals."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = len(centres) if books is None else books.shape[0] * books.shape[1]
        width = dim if books is None else books.shape[2]
        total, n = np.zeros((k, width)), np.zeros(k)
        for batch in batches:
            if not batch.num_rows:
                continue
            x = matrix(batch.column(1), dim)
            cell = nearest(x, centres)[:, 0]
            if books is None:
                parts = [(cell, x)]
            else:
                rest = (x - centres[cell]).reshape(len(x), books.shape[0], -1)
                parts = [(j * books.shape[1] + nearest(rest[:, j], books[j])[:, 0], rest[:, j]) for j in range(books.shape[0])]
            for at, v in parts:
                n += np.bincount(at, minlength=k)
                for c in range(width):
                    total[:, c] += np.bincount(at, v[:, c], minlength=k)
        some = np.flatnonzero(n)
        yield pa.record_batch([pa.array(some), pa.array([total[i].tobytes() for i in some], pa.binary()), pa.array(n[some])], names=["at", "total", "n"])

    return run


def _added(t: pa.Table) -> pa.Table:
    at, n = t["at"].to_numpy(), t["n"].to_numpy()
    raw = t["total"].to_pylist()
    rows = np.frombuffer(b"".join(raw)).reshape(len(raw), -1)
    keys, where = np.unique(at, return_inverse=True)
    total = np.zeros((len(keys), rows.shape[1]))
    np.add.at(total, where, rows)
    return pa.table({"at": pa.array(keys), "total": pa.array([v.tobytes() for v in total], pa.binary()), "n": pa.array(np.bincount(where, n))})


def _means(units: DataFrame, centres: np.ndarray, books: np.ndarray | None, dim: int, old: np.ndarray) -> np.ndarray:
    """Lloyd step over all vectors; an empty cluster keeps its centre."""
    schema = "at bigint, total binary, n double"
    rows = whole_partitions(units.mapInArrow(_sums(centres, books, dim), schema), ["at"], _added, schema).collect()
    new = old.copy()
    for r in rows:
        new[r["at"]] = np.frombuffer(r["total"]) / r["n"]
    return new


class Quantiser:
    """Coarse centres and, for each subspace of the residuals, a book of codewords."""

    def __init__(self, centres: np.ndarray, books: np.ndarray):
        self.centres, self.books = centres, books

    def codes(self, x: np.ndarray, cell: np.ndarray) -> np.ndarray:
        rest = (x - self.centres[cell]).reshape(len(x), self.books.shape[0], -1)
        return np.stack([nearest(rest[:, j], self.books[j])[:, 0] for j in range(self.books.shape[0])], 1).astype(np.uint8)

    def decoded(self, cell: int, codes: np.ndarray) -> np.ndarray:
        return self.centres[cell] + np.concatenate([self.books[j][codes[:, j]] for j in range(self.books.shape[0])], 1)

    def products(self, queries: np.ndarray, cell: int, codes: np.ndarray) -> np.ndarray:
        """Asymmetric estimates of vector . query for the coded vectors of one cell (rows) and queries (columns), by table lookups; single precision, right to 1e-5."""
        parts = queries.reshape(len(queries), self.books.shape[0], -1)
        out = np.repeat((queries @ self.centres[cell]).astype(np.float32)[None], len(codes), 0)
        for j in range(self.books.shape[0]):
            out += (self.books[j] @ parts[:, j].T).astype(np.float32)[codes[:, j]]
        return out


def train(units: DataFrame, dim: int, n: int, per_list: int, subspaces: int, words: int, rounds: int) -> Quantiser:
    """Lloyd's algorithm over all vectors, counts and sums added up across partitions; starts from the lowest hashed ids."""
    lists = groups_of(n, per_list)
    seeds = units.orderBy(F.xxhash64("vec_id"), "vec_id").limit(max(lists, words)).toPandas()
    x = np.frombuffer(b"".join(seeds["vec"]), np.float32).reshape(-1, dim).astype(np.float64)
    centres = x[:lists].copy()
    for _ in range(rounds):
        centres = _means(units, centres, None, dim, centres)
    rest = (x - centres[nearest(x, centres)[:, 0]]).reshape(len(x), subspaces, -1)[:words]
    books = np.ascontiguousarray(rest.transpose(1, 0, 2))
    for _ in range(rounds):
        flat = _means(units, centres, books, dim, books.reshape(-1, books.shape[2]))
        books = flat.reshape(books.shape)
    return Quantiser(centres, books)


def _probes(q: Quantiser, dim: int, probes: int):
    """Each vector to its own list, with its codes, and to the lists nearest to it as a query."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = matrix(batch.column(1), dim).astype(np.float64)
            near = nearest(x, q.centres, probes)
            codes = q.codes(x, near[:, 0])
            k = near.shape[1]
            where = np.repeat(np.arange(len(x)), k)
            own = np.tile(np.arange(k) == 0, len(x))
            body = [codes[i].tobytes() if o else None for i, o in zip(where, own)]
            yield pa.record_batch([pa.array(near.ravel()), batch.column(0).take(pa.array(where)), batch.column(1).take(pa.array(where)), pa.array(body, pa.binary())], names=["cell", "vec_id", "vec", "code"])

    return run


class Forest:
    """Edges that join what the pairs told so far join, one fewer than the nodes of each component."""

    def __init__(self):
        self.parent: dict[int, int] = {}

    def find(self, x: int) -> int:
        parent = self.parent
        parent.setdefault(x, x)
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    def add(self, a: np.ndarray, b: np.ndarray) -> None:
        for x, y in zip(a.tolist(), b.tolist()):
            lo, hi = sorted((self.find(x), self.find(y)))
            self.parent[hi] = lo

    def edges(self) -> np.ndarray:
        return np.array([(x, self.find(x)) for x in self.parent if self.find(x) != x], np.int64).reshape(-1, 2)


def floors(x: np.ndarray, decoded: np.ndarray, least: float | np.ndarray) -> np.ndarray:
    """For each unit vector and what its codes decode to: no unit vector with a cosine of at least `least` to x has a lower product with the latter.

    A query at angle t to x has at least a cos(t) - b sin(t), a and b being the parts of the decoded vector along and across x; for a >= 0
    that falls up to a right angle.
    """
    c = np.asarray(least) - 1e-6  # room for rounding
    along, square = np.einsum("ij,ij->i", x, decoded), (decoded**2).sum(1)
    across = np.sqrt(np.maximum(0, square - along**2))
    return np.where((along >= 0) & (c >= 0), along * c - across * np.sqrt(np.maximum(0, 1 - c * c)), -np.sqrt(square)) - 1e-6


def leaders_of(x: np.ndarray, least: float) -> np.ndarray:
    """For each row the number of the leader that it has a cosine of at least `least` to, or its own: the first such leader, rows being taken in order."""
    lead, chosen = np.empty(len(x), np.int64), np.zeros(0, np.int64)
    for lo in range(0, len(x), 512):
        block, rest = x[lo : lo + 512], np.arange(len(x[lo : lo + 512]))
        if len(chosen):
            like = block @ x[chosen].T
            best = like.argmax(1)
            near = like[rest, best] >= least
            lead[lo + rest[near]] = chosen[best[near]]
            rest = rest[~near]
        close = block[rest] @ block[rest].T >= least
        single = close.sum(1) == 1
        lead[lo + rest[single]] = lo + rest[single]
        new = [lo + rest[single]]
        left = np.flatnonzero(~single)
        while len(left):
            mine = left[close[left[0], left]]
            lead[lo + rest[mine]] = lo + rest[left[0]]
            new.append(lo + rest[left[:1]])
            left = left[~close[left[0], left]]
        chosen = np.concatenate([chosen, *new])
    return lead


def _scan(q: Quantiser, dim: int, least: float, pairs: bool):
    """What the queries of each list find in it: all pairs, or a forest that joins the same vectors.

    For the forest, vectors within half the angle of a leader are one with it, as any two of them are near enough. A query is compared with the leaders alone, by table
    lookups and then exactly, the angle being wider by that of the farthest member; with the members only where the leader leaves it open. So a crowd
    of near copies costs its number times its few leaders.
    """
    angle = np.arccos(min(1.0, least))

    def make(t: pa.Table) -> pa.Table:
        cell, ids = t["cell"].to_numpy(), t["vec_id"].to_numpy()
        everything = matrix(t["vec"], dim)
        coded = t["code"].is_valid().to_numpy(zero_copy_only=False)
        raw = t["code"].combine_chunks()
        found, step = [], max(1, (1 << 22) // dim)
        order = np.argsort(cell, kind="stable")
        edges = np.append(np.flatnonzero(np.append(True, cell[order][1:] != cell[order][:-1])[: len(cell)]), len(cell))
        for a, z in zip(edges[:-1], edges[1:]):
            here, c = order[a:z], int(cell[order[a]])
            own = here[coded[here]]
            if not len(own):
                continue
            base = everything[own].astype(np.float64)
            lead = np.arange(len(own)) if pairs else leaders_of(base, np.cos(angle / 2))
            heads, of = np.unique(lead, return_inverse=True)
            wide = np.zeros(len(heads))
            np.maximum.at(wide, of, np.arccos(np.clip(np.einsum("ij,ij->i", base, base[lead]), -1, 1)) * (lead != np.arange(len(own))))
            members = np.argsort(of, kind="stable")
            starts = np.searchsorted(of[members], np.arange(len(heads) + 1))
            codes = np.frombuffer(b"".join(raw.take(pa.array(own[heads])).to_pylist()), np.uint8).reshape(len(heads), -1)
            floor = floors(base[heads], q.decoded(c, codes), np.cos(np.minimum(np.pi, angle + wide)))
            forest, hits = Forest(), []
            if not pairs:
                forest.add(ids[own], ids[own[lead]])
            for lo in range(0, len(here), 512):
                asked = here[lo : lo + 512]
                x = everything[asked].astype(np.float64)
                n, r = np.nonzero(q.products(x, c, codes) >= (floor - 1e-5).astype(np.float32)[:, None])
                exact = np.concatenate([np.zeros(0), *[np.einsum("ij,ij->i", x[r[i : i + step]], base[heads[n[i : i + step]]]) for i in range(0, len(r), step)]])
                ok = exact >= least - 1e-7
                who, whom = [ids[asked[r[ok]]]], [ids[own[heads[n[ok]]]]]
                open_ = ~ok & (wide[n] > 0) & (exact >= np.cos(np.minimum(np.pi, angle + wide[n])) - 1e-7)
                for h in np.unique(n[open_]):
                    asking, there = r[open_ & (n == h)], members[starts[h] : starts[h + 1]]
                    for m in range(0, len(there), 4096):
                        like = x[asking] @ base[there[m : m + 4096]].T
                        at = like.argmax(1)
                        near = like[np.arange(len(asking)), at] >= least - 1e-7
                        who.append(ids[asked[asking[near]]])
                        whom.append(ids[own[there[m + at[near]]]])
                who, whom = np.concatenate(who), np.concatenate(whom)
                other = who != whom
                if pairs:
                    hits.append(np.stack([who[other], whom[other]], 1))
                else:
                    forest.add(who[other], whom[other])
            found.append(np.concatenate(hits) if pairs else forest.edges())
        got = np.concatenate(found) if found else np.zeros((0, 2), np.int64)
        return pa.table({"a": pa.array(got.max(1) if len(got) else got[:, 0], pa.int64()), "b": pa.array(got.min(1) if len(got) else got[:, 1], pa.int64())})

    return make


def near_embeddings(
    vectors: DataFrame,
    least_cosine: float = 0.9,
    per_list: int = 512,
    probes: int = 16,
    subspaces: int = 16,
    codewords: int = 64,
    rounds: int = 4,
    id_col: str = "vec_id",
    vec_col: str = "embedding",
) -> DataFrame:
    """Groups of vectors joined by cosines of at least `least_cosine`: keeper_vec_id (lowest id), vec_ids (sorted, keeper included), n_vecs.

    Every vector is coded in its inverted list (residual to the coarse centre, `subspaces` codes) and is a query to the
    `probes` nearest lists: table lookups estimate its product with the coded vectors there, and all estimates that a cosine of `least_cosine`
    allows, given each coded vector's own error (see floors), are checked by the exact cosine. Equal vectors are one from the start; near copies within a list are
    taken together (see _scan), and each list hands on a spanning forest of its pairs. Quantisers are trained on all distinct vectors; see groups_of for the number of lists.

    Which rows are left out is told at unit_vectors; zero vectors have no cosine. An empty table gives an empty
    result; equal vectors form one group; ties between lists and codewords go to the lower number; other columns are ignored.
    """
    units, dim, subspaces = unit_vectors(vectors, id_col, vec_col, subspaces)
    same = cut(units.groupBy("vec").agg(F.min("vec_id").alias("vec_id"), F.collect_list("vec_id").alias("ids")))
    units = same.select("vec_id", "vec")
    q = _trained(units, dim, per_list, subspaces, codewords, rounds)
    if q is None:
        return session(vectors).createDataFrame([], "keeper_vec_id bigint, vec_ids array<bigint>, n_vecs int")
    probed = units.mapInArrow(_probes(q, dim, probes), "cell bigint, vec_id bigint, vec binary, code binary")
    roots = components(whole_partitions(probed, ["cell"], _scan(q, dim, least_cosine, False), "a bigint, b bigint"))
    joined = same.select("vec_id", "ids").join(roots, F.col("vec_id") == F.col("node"), "left").select(F.coalesce("root", "vec_id").alias("keeper_vec_id"), "ids")
    groups = joined.groupBy("keeper_vec_id").agg(F.array_sort(F.flatten(F.collect_list("ids"))).alias("vec_ids"))
    return groups.withColumn("n_vecs", F.size("vec_ids")).filter("n_vecs > 1")


def _trained(units: DataFrame, dim: int, per_list: int, subspaces: int, codewords: int, rounds: int) -> Quantiser | None:
    n = units.count()
    if not n:
        return None
    return train(units, dim, n, per_list, subspaces, min(codewords, n, 256), rounds)


def near_pairs(vectors: DataFrame, least_cosine: float = 0.9, per_list: int = 512, probes: int = 16, subspaces: int = 16, codewords: int = 64, rounds: int = 4, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """The pairs (a > b) themselves, for audits of recall."""
    units, dim, subspaces = unit_vectors(vectors, id_col, vec_col, subspaces)
    units = cut(units)
    q = _trained(units, dim, per_list, subspaces, codewords, rounds)
    if q is None:
        return session(vectors).createDataFrame([], "a bigint, b bigint")
    probed = units.mapInArrow(_probes(q, dim, probes), "cell bigint, vec_id bigint, vec binary, code binary")
    return whole_partitions(probed, ["cell"], _scan(q, dim, least_cosine, True), "a bigint, b bigint").distinct()
