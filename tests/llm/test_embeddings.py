"""Groups and pairs of embeddings against all cosines; edge cases."""

import numpy as np
import pytest

from lexsieve.llm.embedding_dedup import groups_of, leaders_of, near_embeddings, near_pairs


def test_recall_and_groups(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(1500, 32))
    x[700:1000] = x[:300] + 0.15 * rng.normal(size=(300, 32))
    x[1000:1200] = x[7] + 0.05 * rng.normal(size=(200, 32))
    x[1200:1260] = x[8]
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id bigint, embedding array<float>").repartition(3)
    s = unit @ unit.T
    exact = {(a, b) for a, b in zip(*np.nonzero(np.tril(s >= 0.9, -1)))}
    got = {(r.a, r.b) for r in near_pairs(df, per_list=64, probes=8).collect()}
    assert len(exact) > 20_000 and got <= exact and len(got) >= 0.97 * len(exact)
    root = list(range(1500))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in exact:
        p, q = sorted((find(a), find(b)))
        root[q] = p
    want = {}
    for i in range(1500):
        want.setdefault(find(i), []).append(i)
    want = sorted(g for g in want.values() if len(g) > 1)
    groups = sorted(r.vec_ids for r in near_embeddings(df, per_list=64, probes=8).collect())
    same = {tuple(g) for g in want} & {tuple(g) for g in groups}
    assert len(same) >= 0.95 * len(want)


def test_edge_cases(spark):
    schema = "vec_id bigint, embedding array<double>"
    assert near_embeddings(spark.createDataFrame([], schema)).count() == 0
    nan = float("nan")
    rows = [(None, [1.0, 0.0]), (1, None), (2, []), (3, [0.0, 0.0]), (4, [nan, 1.0]), (5, [1.0, None]), (6, [1.0, 2.0, 3.0]), (7, [2.0, 0.0]), (8, [5.0, 0.1]), (8, [5.0, 0.1]), (9, [0.0, -3.0])]
    rows += [(20 + i, [0.0, 1.0]) for i in range(50)]
    df = spark.createDataFrame(rows, schema).selectExpr("*", "1 cell", "2 code", "3 a", "'x' vec")
    got = {r.keeper_vec_id: (r.vec_ids, r.n_vecs) for r in near_embeddings(df, per_list=8, probes=4).collect()}
    assert got == {7: ([7, 8], 2), 20: (list(range(20, 70)), 50)}
    assert near_embeddings(df.filter("vec_id < 6")).count() == 0


@pytest.mark.parametrize("dim", [67, 128, 384])
def test_long_vectors_and_lengths_that_do_not_divide(spark, dim):
    rng = np.random.default_rng(dim)
    x = rng.normal(size=(1000, dim))
    x[700:850] = x[:150]
    x[850:] = x[150:300] + 0.3 * rng.normal(size=(150, dim))
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    exact = {(int(a), int(b)) for a, b in zip(*np.nonzero(np.tril(unit @ unit.T >= 0.9, -1)))}
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id bigint, embedding array<double>")
    got = {(r.a, r.b) for r in near_pairs(df, per_list=64, probes=8).collect()}
    assert len(exact) >= 290 and got <= exact and {(700 + i, i) for i in range(150)} <= got and len(got) >= 0.97 * len(exact)


def groups_by(pairs, n):
    root = list(range(n))

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for a, b in pairs:
        p, q = sorted((find(a), find(b)))
        root[q] = p
    out = {}
    for i in range(n):
        out.setdefault(find(i), []).append(i)
    return sorted(g for g in out.values() if len(g) > 1)


def test_production_parameters_on_crowds_and_pairs(spark):
    """Default parameters against all cosines: a crowd of near copies, copies, chains of copies of copies, and pairs near the threshold."""
    rng = np.random.default_rng(11)
    x = rng.normal(size=(3000, 64))
    x[1000:1800] = x[0] + 0.1 * rng.normal(size=(800, 64))
    x[1800:1900] = x[1]
    for i in range(1900, 1960):
        x[i] = x[i - 1] + 0.35 * rng.normal(size=64)
    x[2000:2400] = x[2:402] + rng.uniform(0.1, 0.6, (400, 1)) * rng.normal(size=(400, 64))
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    want = groups_by(zip(*np.nonzero(np.tril(unit @ unit.T >= 0.9, -1))), 3000)
    got = sorted(r.vec_ids for r in near_embeddings(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id bigint, embedding array<double>").repartition(4)).collect())
    pairs = lambda gs: {(a, b) for g in gs for a in g for b in g if a < b}
    assert pairs(got) <= pairs(want) and len(pairs(got)) >= 0.97 * len(pairs(want)) > 300_000


def test_leaders():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(1300, 16))
    x[600:1200] = x[5] + 0.05 * rng.normal(size=(600, 16))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    lead = leaders_of(x, 0.97)
    assert (np.einsum("ij,ij->i", x, x[lead]) >= 0.97 - 1e-9).all() and (lead[lead] == lead).all() and (lead <= np.arange(1300)).all()
    heads = np.unique(lead)
    assert len(heads) < 750 and (np.tril(x[heads] @ x[heads].T, -1) < 0.97).all()


def test_number_of_lists():
    assert groups_of(0, 512) == 1 and groups_of(51_200, 512) == 100 and groups_of(10**9, 512) == int(np.ceil(np.sqrt(96e9)))


def test_many_equal_vectors_in_one_list_are_quick(spark):
    import time

    began = time.time()
    df = spark.range(100_000).selectExpr("id vec_id", "array(1D, 2D, 3D) embedding")
    got = near_embeddings(df).collect()
    assert [r.n_vecs for r in got] == [100_000] and time.time() - began < 60
