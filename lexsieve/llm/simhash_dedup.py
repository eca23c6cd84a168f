"""SimHash near-dedup with small-world graphs over Hamming distance."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, cut, keep_columns, one_row_per_id, session, texts, whole_partitions
from .small_world import SmallWorld
from .words import U, Slab, mix, slabs

CODE = "doc_id bigint, hi bigint, lo bigint, words bigint, n_words int"
GRAPH = "shard int, beam int, nodes binary, codes binary, links binary"
_LANES = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).astype(np.uint8).view(U).ravel()
_KEY_BITS = 44


def word_sets(s: Slab) -> tuple[np.ndarray, np.ndarray]:
    """Distinct words (44-bit hashes, sorted) of each document of a slab, and their offsets."""
    key = (s.doc_of.astype(U) << U(_KEY_BITS)) | (s.words & U((1 << _KEY_BITS) - 1))
    key.sort()
    if len(key):
        key = key[np.append(True, key[1:] != key[:-1])]
    doc = (key >> U(_KEY_BITS)).astype(np.int64)
    return key & U((1 << _KEY_BITS) - 1), np.searchsorted(doc, np.arange(len(s.offsets)))


def simhash(words: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """128-bit codes (rows of two 64-bit numbers): each bit is the majority of that bit over a document's distinct words."""
    n = len(offsets) - 1
    out = np.zeros((n, 2), U)
    sizes = np.diff(offsets)
    some = np.flatnonzero(sizes)
    if not len(some):
        return out
    size = sizes[some]
    pieces = -(-size // 255)  # eight counters of 8 bits are summed at once
    of = np.repeat(np.arange(len(some)), pieces)
    first = np.append(0, np.cumsum(pieces))[:-1]
    cuts = offsets[some][of] + 255 * (np.arange(len(of)) - first[of])
    a = mix(words)
    raw = np.stack([a, mix(a ^ U(0x5851F42D4C957F2D))], 1).view(np.uint8)
    bits = np.empty((len(some), 128), np.int32)
    for j in range(16):
        part = np.add.reduceat(_LANES[raw[:, j]], cuts).view(np.uint8).reshape(-1, 8)
        bits[:, j * 8 : j * 8 + 8] = np.add.reduceat(part, first, axis=0, dtype=np.int32)
    out[some] = np.packbits(bits * 2 > size[:, None], axis=1).view(U)
    return out


def _codes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The SimHash of each text's distinct words, a hash of all of them, and their number."""
    for batch in batches:
        ids = batch.column(0).to_numpy(zero_copy_only=False)
        for s in slabs(batch.column(1)):
            words, offsets = word_sets(s)
            n = np.diff(offsets)
            some = np.flatnonzero(n)
            code = simhash(words, offsets)[some].view(np.int64)
            whole = np.add.reduceat(mix(words ^ U(0x9E3779B97F4A7C15)), offsets[some]).view(np.int64) if len(some) else np.zeros(0, np.int64)
            yield pa.record_batch([pa.array(ids[s.row + some]), pa.array(code[:, 0].copy()), pa.array(code[:, 1].copy()), pa.array(whole), pa.array(n[some].astype(np.int32))], names=["doc_id", "hi", "lo", "words", "n_words"])


def _graphs(radius: int, beam: int, recall: float, audit: int):
    """The graph of each shard, and the beam that an audit of its own codes against exact search asks for."""

    def make(t: pa.Table) -> Iterator[pa.RecordBatch]:
        shard, node = t["shard"].to_numpy(), t["node"].to_numpy()
        codes = np.stack([t["hi"].to_numpy(), t["lo"].to_numpy()], 1).view(U)
        for s in np.unique(shard):
            own = np.flatnonzero(shard == s)
            own = own[np.argsort(mix(node[own].astype(U)), kind="stable")]
            graph = SmallWorld(codes[own])
            tried = np.argsort(mix(node[own].astype(U) ^ U(0x51)), kind="stable")[:audit]
            wide = graph.audited_beam(graph.codes[tried], tried, radius, beam, recall)
            yield pa.record_batch(
                [pa.array([s], pa.int32()), pa.array([wide], pa.int32()), *[pa.array([x.tobytes()], pa.binary()) for x in (node[own], graph.codes, graph.links)]], names=["shard", "beam", "nodes", "codes", "links"]
            )

    return make


def _search(radius: int, few: int | None, by_group: bool):
    """Pairs within radius of a block of codes and a shard's graph. The row of the graph has no node.

    few: of a code whose beam is half full of hits only so many, the nearest, and a row with its shard and no b. by_group: only pairs of two groups, or of which one is not whole;
    rows without a code give the groups of the graph's nodes, those that have none are one by themselves.
    """

    def make(t: pa.Table) -> Iterator[pa.RecordBatch]:
        key = t["shard"].to_numpy().astype(np.int64) << 32 | t["block"].to_numpy()
        drawn, coded = (t[c].is_valid().to_numpy(zero_copy_only=False) for c in ("codes", "hi"))

        def batch(a: np.ndarray, b: np.ndarray | None, shard: int | None = None) -> pa.RecordBatch:
            return pa.record_batch([pa.array(a, pa.int64()), pa.nulls(len(a), pa.int64()) if b is None else pa.array(b, pa.int64()), pa.array([shard] * len(a), pa.int32())], names=["a", "b", "shard"])

        for k in np.unique(key):
            row = np.flatnonzero((key == k) & drawn)
            if not len(row):
                continue
            here = t.take(pa.array(np.flatnonzero((key == k) & ~drawn & coded)))
            own = np.frombuffer(t["nodes"][int(row[0])].as_py(), np.int64)
            graph = SmallWorld.of_parts(np.frombuffer(t["codes"][int(row[0])].as_py(), U).reshape(-1, 2), np.frombuffer(t["links"][int(row[0])].as_py(), np.int32).reshape(len(own), -1))
            node, codes, beam = here["node"].to_numpy(), np.stack([here["hi"].to_numpy(), here["lo"].to_numpy()], 1).view(U), int(t["beam"][int(row[0])].as_py())
            if by_group:
                said = t.take(pa.array(np.flatnonzero((key == k) & ~drawn & ~coded)))
                at = np.argsort(own)
                at = at[np.searchsorted(own, said["node"].to_numpy(), sorter=at)]
                group, whole = own.copy(), np.ones(len(own), bool)
                group[at], whole[at] = said["group"].to_numpy(), said["whole"].to_numpy()
                mine, sound = here["group"].to_numpy(), here["whole"].to_numpy()
            for lo in range(0, len(node), 1 << 14):
                part = slice(lo, lo + (1 << 14))
                q, n, full = graph.hits(codes[part], radius, beam)
                crowded = np.isin(q, full)
                if few is not None and len(full):
                    nth = np.arange(len(q)) - np.maximum.accumulate(np.where(np.append(True, q[1:] != q[:-1]), np.arange(len(q)), 0))
                    yield batch(node[lo + full], None, int(k >> 32))
                    near = [(q[~crowded | (nth < few)], n[~crowded | (nth < few)])]
                else:
                    near = chain([(q[~crowded], n[~crowded])], graph.crowds(codes[part], full, q, n, radius, mine[part] if by_group else None))
                for q, n in near:
                    if by_group:
                        apart = (mine[lo + q] != group[n]) | ~sound[lo + q] | ~whole[n]
                        q, n = q[apart], n[apart]
                    a, b = node[lo + q], own[n]
                    pair = np.unique(np.stack([np.maximum(a, b), np.minimum(a, b)], 1)[a != b], axis=0)
                    yield batch(pair[:, 0].copy(), pair[:, 1].copy())

    return make


PAIR = "a bigint, b bigint, shard int"


def near_codes(codes: DataFrame, radius: int, shards: int, beam: int, recall: float, audit: int, blocks: int = 8) -> DataFrame:
    """Pairs (a > b) of nodes whose codes are within radius, some more than once. codes: node, hi, lo with distinct codes.

    Each shard's codes form one graph, and the codes are sent to their own shard and to the next half of the ring, so
    that any two shards meet once (those half a ring apart twice). What comes to a shard is searched in `blocks` tasks, each with a copy of its graph.
    """
    here = sharded(codes, shards)
    return searched(here, drawn_graphs(here, radius, shards, beam, recall, audit), radius, shards, blocks).select("a", "b")


def sharded(codes: DataFrame, shards: int) -> DataFrame:
    return codes.select("node", "hi", "lo", F.pmod(F.xxhash64("hi", "lo"), F.lit(shards)).cast("int").alias("shard"))


def drawn_graphs(here: DataFrame, radius: int, shards: int, beam: int, recall: float, audit: int) -> DataFrame:
    return cut(whole_partitions(here, [F.col("shard")], _graphs(radius, beam, recall, audit), GRAPH, parts=shards, numbered=True))


def searched(here: DataFrame, graphs: DataFrame, radius: int, shards: int, blocks: int, few: int | None = None) -> DataFrame:
    """Pairs of near_codes(), and rows without b for codes in a crowd, see _search()."""
    block = F.pmod(F.xxhash64("lo", "hi", F.lit(1)), F.lit(blocks)).cast("int").alias("block")
    step = F.explode(F.sequence(F.lit(0), F.lit(shards // 2)))
    sent = here.withColumn("step", step).select(F.pmod(F.col("shard") + F.col("step"), F.lit(shards)).cast("int").alias("shard"), block, "node", "hi", "lo")
    both = sent.unionByName(_copies(graphs, blocks), allowMissingColumns=True)
    return whole_partitions(both, [F.col("shard") * blocks + F.col("block")], _search(radius, few, False), PAIR, parts=shards * blocks, numbered=True)


def _copies(rows: DataFrame, blocks: int) -> DataFrame:
    return rows.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))


def crowd_pairs(crowd: DataFrame, here: DataFrame, graphs: DataFrame, groups: DataFrame, radius: int, shards: int, blocks: int = 4) -> DataFrame:
    """The pairs of the codes crowd(node, shard) in the graphs of those shards that join two groups, or of which one is not whole. groups: node, group, whole; a node that isn't there is one by itself."""
    block = F.pmod(F.xxhash64("group"), F.lit(blocks)).cast("int").alias("block")
    one = [F.coalesce("group", "node").alias("group"), F.coalesce("whole", F.lit(True)).alias("whole")]
    asked = crowd.join(here.drop("shard"), "node").join(groups, "node", "left").select("shard", "node", "hi", "lo", *one).select("*", block)
    told = _copies(groups.join(here, "node").select("shard", "node", "group", "whole"), blocks)
    both = asked.unionByName(told, allowMissingColumns=True).unionByName(_copies(graphs, blocks), allowMissingColumns=True)
    return whole_partitions(both, [F.col("shard") * blocks + F.col("block")], _search(radius, None, True), PAIR, parts=shards * blocks, numbered=True).select("a", "b")


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for s in slabs(batch.column(1)):
            words, offsets = word_sets(s)
            rows = len(offsets) - 1
            body = [words[offsets[i] : offsets[i + 1]].tobytes() for i in range(rows)]
            yield pa.record_batch([batch.column(0).slice(s.row, rows), pa.array(body, pa.binary())], names=["doc_id", "words"])


def common_words(a: list[bytes], b: list[bytes]) -> np.ndarray:
    """How many numbers each a[i] and b[i] share: sets of different numbers under 2**44, as bytes."""
    out = np.zeros(len(a), np.int64)
    for lo in range(0, len(a), 4096):
        parts = [x[lo : lo + 4096] for x in (a, b)]
        pair = np.concatenate([np.repeat(np.arange(len(x), dtype=U), [len(y) // 8 for y in x]) for x in parts])
        key = np.sort((pair << U(_KEY_BITS)) | np.frombuffer(b"".join([*parts[0], *parts[1]]), U))
        twin = key[1:][key[1:] == key[:-1]]
        out[lo : lo + 4096] = np.bincount((twin >> U(_KEY_BITS)).astype(np.int64), minlength=len(parts[0]))
    return out


def _close(least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = batch.column("x").to_pylist(), batch.column("y").to_pylist()
            both = common_words(x, y)
            size = np.array([len(p) + len(q) for p, q in zip(x, y)], np.int64) // 8
            yield batch.select(["a", "b"]).filter(pa.array(both >= least * np.maximum(1, size - both)))

    return run


def verified(pairs: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """The pairs (a, b) whose sets of words, sets(doc_id, words), have a Jaccard similarity of at least `least`."""
    first = sets.select(F.col("doc_id").alias("a"), F.col("words").alias("x"))
    second = sets.select(F.col("doc_id").alias("b"), F.col("words").alias("y"))
    return pairs.join(first, "a").join(second, "b").select("a", "b", "x", "y").mapInArrow(_close(least), "a bigint, b bigint")


def linked(pairs: DataFrame, size: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """Verified pairs that join whatever all verified ones of these pairs join. size: d, n, the number of words of each document."""
    bound = F.lit(least)
    pairs = pairs.join(size.withColumnRenamed("n", "p"), F.col("a") == F.col("d")).drop("d").join(size.withColumnRenamed("n", "q"), F.col("b") == F.col("d")).drop("d")
    pairs = cut(pairs.filter((F.col("p") >= bound * F.col("q")) & (F.col("q") >= bound * F.col("p"))).select("a", "b"))
    lowest = cut(verified(pairs.groupBy("a").agg(F.min("b").alias("b")), sets, least))
    head = lowest.union(lowest.select("b", "b")).groupBy("a").agg(F.min("b").alias("head"))
    left, right = head.select("a", F.col("head").alias("p")), head.select(F.col("a").alias("b"), F.col("head").alias("q"))
    open_ = pairs.join(pairs.groupBy("a").agg(F.min("b").alias("b")), ["a", "b"], "left_anti").join(left, "a", "left").join(right, "b", "left").filter("p is null or q is null or p <> q").select("a", "b")
    return lowest.union(verified(open_, sets, least))


def _ends(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.explode(F.array("a", "b")).alias("doc_id"))


def _sets_of(rows: DataFrame, ids: DataFrame) -> DataFrame:
    return cut(rows.join(ids.hint("shuffle_hash"), "doc_id").select("doc_id", "text").mapInArrow(_sets, "doc_id bigint, words binary"))


def _across(edges: DataFrame, every: DataFrame) -> DataFrame:
    """Edges between nodes as edges between all documents, every(node, doc), that stand for themselves there."""
    x, y = every.select(F.col("node").alias("a"), F.col("doc").alias("x")), every.select(F.col("node").alias("b"), F.col("doc").alias("y"))
    across = edges.join(x, "a", "left").join(y, "b", "left").select(F.coalesce("x", "a").alias("x"), F.coalesce("y", "b").alias("y"))
    return across.select(F.greatest("x", "y").alias("a"), F.least("x", "y").alias("b"))


def _within(every: DataFrame) -> DataFrame:
    x, y = every.select("node", F.col("doc").alias("a")), every.select("node", F.col("doc").alias("b"))
    return x.join(y, "node").filter("a > b").select("a", "b")


def near_duplicates(
    docs: DataFrame,
    radius: int = 24,
    least_jaccard: float = 0.7,
    shards: int = 12,
    beam: int = 32,
    recall: float = 0.95,
    audit: int = 1024,
    few: int = 8,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Groups of near-duplicate documents: keeper_doc_id (the lowest id), doc_ids (sorted, keeper included), n_docs.

    The 128-bit SimHash of a document's distinct words is searched within `radius` bits in a small-world graph
    for each shard of the codes; for each shard beams are as wide as an audit
    of `audit` queries against exact search asks for `recall`. Every code is a query. Candidate pairs are verified by the
    Jaccard similarity of their word sets (`least_jaccard`) before they are joined into groups.

    A code whose beam is half full of hits is in a crowd: first its `few` nearest codes of the shard are candidates. When groups have been made of these, all its codes within `radius` are looked at, and those in other
    groups become candidates, so that pairs within a group are never listed and no link to another is lost.

    Documents with the same set of words are one throughout. Of those with one code, the lowest id stands for all whose sets are close enough to its own; the
    others stand for themselves. First each is compared to its candidate of the lowest id; a pair whose two members are close to the same such candidate is in
    one group already and needs no comparison, every other pair is compared.

    A null id leaves the row out, and one that is no integer; a null text, an empty one and one without a word are in no group; rows that share an id
    count once, see common.texts; identical texts form one group whatever their number; the whole of a long text counts; equal distances and equal ids of candidates don't
    matter, as all pairs within `radius` count; an empty table gives an empty result; other columns are ignored.
    """
    rows = texts(docs, id_col, text_col)
    codes = cut(rows.mapInArrow(_codes, CODE))
    same = cut(codes.groupBy("hi", "lo", "words").agg(F.min("doc_id").alias("doc"), F.collect_list("doc_id").alias("ids"), F.first("n_words").alias("n")))
    nodes = cut(same.groupBy("hi", "lo").agg(F.min("doc").alias("node"), F.count("*").alias("sets")))
    here = cut(sharded(nodes, shards))
    graphs = drawn_graphs(here, radius, shards, beam, recall, audit)
    found = cut(searched(here, graphs, radius, shards, 8, few).distinct())
    edges = found.filter("b is not null").select("a", "b")
    # documents that share a code with one of a lower id
    under = cut(same.join(nodes.filter("sets > 1"), ["hi", "lo"]).filter("doc <> node").select(F.col("doc").alias("a"), F.col("node").alias("b")))
    needed = cut(_ends(edges).union(_ends(under)).distinct())
    sets = _sets_of(rows, needed)
    like = cut(verified(under, sets, least_jaccard))
    alone = cut(under.join(like, ["a", "b"], "left_anti").select(F.col("b").alias("node"), F.col("a").alias("doc")))
    every = None if alone.isEmpty() else alone.union(nodes.join(alone.select("node").distinct(), "node").select("node", F.col("node").alias("doc")))
    pairs = edges if every is None else _across(edges, every).union(_within(every)).distinct()
    size = same.select(F.col("doc").alias("d"), "n")
    roots = cut(components(like.union(linked(pairs, size, sets, least_jaccard))))
    crowd = found.filter("b is null").select(F.col("a").alias("node"), "shard")
    if not crowd.isEmpty():
        groups = roots.withColumnRenamed("root", "group").join(nodes.select("node"), "node")
        if every is None:
            groups = groups.withColumn("whole", F.lit(True))
        else:
            groups = groups.join(alone.select("node", F.lit(False).alias("whole")).distinct(), "node", "full").select("node", F.coalesce("group", "node").alias("group"), F.coalesce("whole", F.lit(True)).alias("whole"))
        more = cut(crowd_pairs(crowd, here, graphs, cut(groups), radius, shards).distinct())
        if not more.isEmpty():
            late = cut(_ends(more).distinct().join(needed, "doc_id", "left_anti"))
            if not late.isEmpty():
                sets = sets.union(_sets_of(rows, late))
            links = linked(more if every is None else _across(more, every).distinct(), size, sets, least_jaccard)
            old = [roots.select(F.col("node").alias(c), F.col("root").alias(r)) for c, r in (("a", "p"), ("b", "q"))]
            joined = components(links.join(old[0], "a", "left").join(old[1], "b", "left").select(F.coalesce("p", "a").alias("a"), F.coalesce("q", "b").alias("b")))
            last = joined.select(F.col("node").alias("root"), F.col("root").alias("last"))
            # a group's root is among the joined ones itself, or a document that was in no group
            roots = cut(roots.join(last, "root", "left").select("node", F.coalesce("last", "root").alias("root")).union(joined.join(roots.select("node"), "node", "left_anti").select("node", "root")))
    of = same.join(roots, same["doc"] == roots["node"], "left").select(F.coalesce("root", "doc").alias("keeper_doc_id"), "ids")
    groups = of.groupBy("keeper_doc_id").agg(F.array_sort(F.flatten(F.collect_list("ids"))).alias("doc_ids"))
    return groups.withColumn("n_docs", F.size("doc_ids")).filter("n_docs > 1")


def drop_near_duplicates(docs: DataFrame, groups: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with the keeper alone of each group, one row for each id. Rows in no group stay, null ids too."""
    gone = cut(groups.select(F.explode("doc_ids").alias("doc_id"), "keeper_doc_id").filter("doc_id <> keeper_doc_id").select("doc_id"))
    return one_row_per_id(keep_columns(docs, gone, "left_anti", id_col), id_col, text_col)
