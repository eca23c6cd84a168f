"""Near-duplicate groups against all pairs, graph search against exact search, edge cases."""

import random
import re

import numpy as np

from lexsieve.llm.simhash_dedup import common_words, drop_near_duplicates, near_codes, near_duplicates, simhash, word_sets
from lexsieve.llm.small_world import SmallWorld, distance
from lexsieve.llm.words import U, slabs


def corpus():
    rng = random.Random(5)
    words = [f"v{i}" for i in range(3000)]
    docs = []
    for i in range(150):
        text = rng.choices(words, k=rng.randint(20, 120))
        docs.append((len(docs), " ".join(text)))
        for _ in range(rng.choice([0, 0, 1, 3, 12]) if i % 10 else 25):
            near = list(text)
            for _ in range(rng.randint(0, len(text) // 25)):
                near[rng.randrange(len(near))] = rng.choice(words)
            docs.append((len(docs), " ".join(near)))
    rng.shuffle(docs)
    return docs


def brute(docs, least):
    """Groups joined by every pair of word sets that is close enough."""
    sets = {d: set(re.findall(r"\w+", t)) for d, t in docs}
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and len(sets[a] & sets[b]) >= least * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    groups = {}
    for d in sets:
        groups.setdefault(find(d), []).append(d)
    return sorted(sorted(g) for g in groups.values() if len(g) > 1)


def test_groups_equal_all_pairs(spark):
    docs = corpus()
    df = spark.createDataFrame(docs, "doc_id bigint, text string")
    groups = near_duplicates(df, shards=3)
    got = sorted(r.doc_ids for r in groups.collect())
    want = brute(docs, 0.7)
    pairs = lambda gs: {(a, b) for g in gs for a in g for b in g if a < b}
    assert pairs(got) <= pairs(want)
    assert len(pairs(got)) >= 0.95 * len(pairs(want))
    kept = {r.doc_id for r in drop_near_duplicates(df, groups).collect()}
    assert kept == {d for d, _ in docs} - {d for g in got for d in g[1:]}


def test_edge_cases(spark):
    empty = spark.createDataFrame([], "doc_id bigint, text string")
    assert near_duplicates(empty).count() == 0 and drop_near_duplicates(empty, near_duplicates(empty)).count() == 0
    long = " ".join(f"u{i}" for i in range(50_000))
    rows = [(None, "a b c"), (1, None), (2, ""), (3, "?!"), (4, ""), (5, "a b c"), (6, "A, b c!"), (7, "a b c"), (7, "a b c"), (8, long), (9, long + " more"), (11, "x")] + [(100 + i, "same text here") for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").selectExpr("*", "1 node", "2 hi", "'z' comp", "3 words", "4 root")
    groups = near_duplicates(df, shards=2)
    got = {r.keeper_doc_id: (r.doc_ids, r.n_docs) for r in groups.collect()}
    assert got == {5: ([5, 6, 7], 3), 8: ([8, 9], 2), 100: (list(range(100, 400)), 300)}
    out = drop_near_duplicates(df, groups)
    assert out.columns == df.columns
    assert sorted(r.doc_id or 0 for r in out.collect()) == [0, 1, 2, 3, 4, 5, 8, 11, 100]


def test_graph_recall_and_audit():
    rng = np.random.default_rng(1)
    base = rng.integers(0, 1 << 63, (3000, 2)).astype(U)
    near = base[:1000].copy()
    for _ in range(8):
        near[np.arange(1000), rng.integers(0, 2, 1000)] ^= U(1) << rng.integers(0, 63, 1000).astype(U)
    codes = np.unique(np.concatenate([base, near]), axis=0)
    codes = codes[rng.permutation(len(codes))]
    g = SmallWorld(codes)
    own = np.arange(500)
    wide = g.audited_beam(codes[:500], own, 24, 8, 0.95)
    q, n = g.within(codes, 24, wide)
    exact = {(a, b) for a in range(len(codes)) for b in np.flatnonzero(distance(codes[a][None], codes) <= 24) if a != b}
    assert exact and len(exact & set(zip(q.tolist(), n.tolist()))) >= 0.9 * len(exact)
    crowd = np.unique(codes[:1] ^ (U(1) << rng.integers(0, 63, (400, 2)).astype(U)), axis=0)
    q, n = SmallWorld(crowd).within(crowd, 24, 8)
    assert len(set(zip(q.tolist(), n.tolist()))) == len(crowd) ** 2  # no cap on partners


def test_simhash_is_the_majority_of_bits():
    import pyarrow as pa

    from lexsieve.llm.words import mix

    s = next(slabs(pa.array(["b a b " + " ".join(f"n{i}" for i in range(700)), "", "one"])))
    words, offsets = word_sets(s)
    assert np.diff(offsets).tolist() == [702, 0, 1]
    a = mix(words[:702])
    bits = np.unpackbits(np.stack([a, mix(a ^ U(0x5851F42D4C957F2D))], 1).view(np.uint8), axis=1).sum(0) * 2 > 702
    assert (np.unpackbits(simhash(words, offsets)[0].view(np.uint8)) == bits).all()


def test_common_words():
    body = lambda *x: np.array(sorted(x), U).tobytes()
    assert common_words([body(1, 2, 3), body(), body(7)], [body(3, 1, 9, 8), body(4), body(7)]).tolist() == [2, 0, 1]


def test_graphs_are_walked_and_find_the_pairs_of_exact_search(spark, monkeypatch):
    """Three shards of some 800 codes, none of them scanned: exact search is forbidden but in the audit."""
    rng = np.random.default_rng(9)
    base = rng.integers(0, 1 << 62, (1600, 2)).astype(U)
    near = base[:800] ^ (U(1) << rng.integers(0, 62, (800, 2)).astype(U))
    codes = np.unique(np.concatenate([base, near]), axis=0)
    assert len(codes) >= 2400 - 10
    rows = [(i, *c) for i, c in enumerate(codes.view(np.int64).tolist())]
    found = [(r.a, r.b) for r in near_codes(spark.createDataFrame(rows, "node bigint, hi bigint, lo bigint"), 24, 3, 32, 0.95, 256).collect()]
    exact = {(a, int(b)) for a in range(len(codes)) for b in np.flatnonzero(distance(codes[a][None], codes) <= 24) if b < a}
    assert set(found) <= exact and len(set(found)) >= 0.95 * len(exact) >= 700


def test_one_code_and_several_sets(spark):
    """A crowd of near copies, many with one code though their sets of words differ, is one group."""
    rng = random.Random(3)
    words = [f"w{i}" for i in range(400)]
    rows = []
    for i in range(120):
        near = list(words)
        for _ in range(i % 4):
            near[rng.randrange(400)] = f"other{rng.randrange(10**6)}"
        rows.append((i, " ".join(near)))
    got = near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string"), shards=2).collect()
    assert [r.doc_ids for r in got] == [list(range(120))]


def test_ids_that_are_no_integers_are_left_out(spark):
    df = spark.createDataFrame([("a1", "x y z"), ("2", "x y z"), ("3", "x y z"), (None, "x y z")], "doc_id string, text string")
    groups = near_duplicates(df, shards=2)
    assert [r.doc_ids for r in groups.collect()] == [[2, 3]]
    assert sorted(str(r.doc_id) for r in drop_near_duplicates(df, groups).collect()) == ["2", "None", "a1"]


def near_copies(rng, bodies):
    docs = []
    for text in bodies:
        near = list(text)
        for _ in range(2):
            near[rng.randrange(76)] = f"x{rng.randrange(10**6)}"
        docs.append((len(docs), " ".join(near)))
    return docs


def test_crowds_are_not_listed_pair_by_pair(spark, monkeypatch):
    """A crowd of near copies is one group, from tables that grow with the crowd and not with its square."""
    from lexsieve.llm import simhash_dedup

    docs, rows, plain = near_copies(random.Random(8), [[f"w{i}" for i in range(100)]] * 800), [], simhash_dedup.cut

    def counted(df):
        out = plain(df)
        rows.append(out.count())
        return out

    monkeypatch.setattr(simhash_dedup, "cut", counted)
    got = near_duplicates(spark.createDataFrame(docs, "doc_id bigint, text string"), shards=1).collect()
    assert [r.doc_ids for r in got] == [[d for d, _ in docs]]
    assert max(rows) < 20 * len(docs)


def test_crowds_keep_their_only_link(spark):
    """Two crowds that one document joins, whose nearest codes are all in one of them."""
    first = [f"w{i}" for i in range(100)]
    docs = near_copies(random.Random(8), [first] * 400 + [first[:76] + [f"z{i}" for i in range(24)]] * 400)
    assert [len(g) for g in brute(docs, 0.7)] == [400, 400]
    docs.append((len(docs), " ".join(first[:88] + [f"z{i}" for i in range(12)])))
    got = near_duplicates(spark.createDataFrame(docs, "doc_id bigint, text string"), shards=1).collect()
    assert [r.doc_ids for r in got] == [[d for d, _ in docs]]


def test_small_groups_are_found_beside_crowds():
    """Pairs and small groups among a crowd's codes are reached from any entry, at the narrow beam."""
    rng = np.random.default_rng(4)
    flip = lambda codes, n: codes ^ np.packbits(rng.random((len(codes), 128)).argsort(1).argsort(1) < n, axis=1).view(U)
    topics = flip(np.repeat(rng.integers(0, 1 << 63, (40, 2)).astype(U), 100, axis=0), 30)
    codes = np.concatenate([topics, flip(np.repeat(topics[:250], 36, axis=0), 9), flip(topics[250:3000], 9)])
    codes = codes[rng.permutation(len(codes))]
    graph, tried = SmallWorld(codes), np.arange(1000)
    q, n = graph.within(codes[tried], 24, 32)
    exact = {(a, int(b)) for a in tried.tolist() for b in np.flatnonzero(distance(codes[a][None], codes) <= 24)}
    found = set(zip(q.tolist(), n.tolist()))
    assert len(found) == len(q) and found <= exact and len(found) >= 0.99 * len(exact)
