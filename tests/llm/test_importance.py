"""Planted quality, the ratios against plain counts, exact top-k, edge cases."""

import random
from collections import Counter

import numpy as np

from lexsieve.llm.importance import resample, top_by_key


def test_planted_bad_documents_go(spark):
    rng = random.Random(2)
    words = [f"w{i}" for i in range(300)]
    rows, labels = [], []
    for i in range(2000):
        text = rng.choices(words, k=rng.randint(5, 200))
        bad = i % 10 == 0
        if bad:
            for _ in range(max(2, len(text) // 20)):
                text.insert(rng.randrange(len(text)), rng.choice(["awful", "rotten"]))
        rows.append((i, " ".join(text)))
        if i % 3:
            labels.append((i, 1, int(bad)))
    out = {r.doc_id for r in resample(spark.createDataFrame(rows, "doc_id bigint, text string"), spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int"), target_docs=5000).collect()}
    good = [i for i in range(2000) if i % 10]
    assert sum(i in out for i in good) > 0.96 * len(good)
    assert sum(i in out for i in range(0, 2000, 10)) < 0.2 * 200
    assert len(out) == round(sum(1 for x in labels if not x[2]) / len(labels) * 2000)


def test_top_by_key_is_exact(spark):
    rng = np.random.default_rng(3)
    key = np.concatenate([rng.normal(size=3000), np.full(500, 0.25), rng.exponential(1e6, 20), [-1e12]]).round(3)
    df = spark.createDataFrame([(i, 0.0, float(k)) for i, k in enumerate(key)], "doc_id bigint, log_weight double, key double")
    order = sorted(range(len(key)), key=lambda i: (-key[i], i))
    for k in (0, 1, 7, 1000, 1300, 1700, 3500, len(key) - 1, len(key), len(key) + 5):
        assert {r.doc_id for r in top_by_key(df, k).collect()} == set(order[:k])


def test_models_are_plain_counts(spark):
    from lexsieve.llm.importance import train

    rows = [(1, "a b a", True), (2, "a c", True), (3, "d d", False), (4, "d a", False), (5, "", False), (6, "d e", False)]
    got = train(spark.createDataFrame(rows, "doc_id bigint, text string, good boolean"), 1 << 20, 0.5, 0.0)
    counts = sorted(zip(got.target.tolist(), got.raw.tolist()))
    plain = {"a": (3, 4), "b": (1, 1), "c": (1, 1), "d": (0, 4), "e": (0, 1), "a b": (1, 1), "b a": (1, 1), "a c": (1, 1), "d d": (0, 1), "d a": (0, 1), "d e": (0, 1)}
    assert counts == sorted(plain.values())
    assert np.isclose(got.scale, 8 / 17)


def test_weights_are_plain_log_ratios(spark):
    import math

    rng = random.Random(4)
    words = [f"w{i}" for i in range(40)]
    texts, good = [], []
    for i in range(300):
        bad = i % 4 == 0
        texts.append(" ".join(rng.choices(words, k=rng.randint(0, 30)) + ["vile", "mean"] * (bad and i % 8 == 0)))
        good.append(not bad)
    grams = []
    for t in texts:
        w = t.split()
        grams.append(Counter([*w, *zip(w, w[1:])]))
    target, raw = Counter(), Counter()
    for g, ok in zip(grams, good):
        raw.update(g)
        target.update(g if ok else {})
    scale, share = sum(target.values()) / sum(raw.values()), sum(good) / len(good)

    def ratio(t, r):
        t, r = t + 0.5, max(r, 0) * scale + 0.5
        full = math.log(t) - math.log(r)
        return math.copysign(max(0.0, abs(full) - 2 * math.sqrt(1 / t + 1 / r)), full)

    want = []
    for g, ok in zip(grams, good):
        want.append(min(sum(n * ratio(target[x] - n * ok, raw[x] - n) for x, n in g.items() if ratio(target[x], raw[x])), -math.log(share)))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, 1, int(not ok)) for i, ok in enumerate(good)], "doc_id bigint, quality int, toxic int")
    got = {r.doc_id: r.log_weight for r in resample(docs, labels, keep=1.0).collect()}
    assert np.allclose([got[i] for i in range(300)], want) and min(want) < -3


def test_edge_cases(spark):
    docs, labels = "doc_id bigint, text string", "doc_id bigint, quality int, toxic int"
    some = spark.createDataFrame([(1, "a b"), (2, None), (3, ""), (None, "x"), (4, "a b"), (4, "a b"), (5, "z " * 50_000)], docs).selectExpr("*", "1 quality", "2 `key`", "'x' good", "3 log_weight")
    none = spark.createDataFrame([], labels)
    assert sorted(r.doc_id for r in resample(some, none).collect()) == [1, 2, 3, 4, 5]
    assert all(r.log_weight == 0 for r in resample(some, none).collect())
    marks = spark.createDataFrame([(1, 1, 0), (1, None, None), (2, None, 1), (None, 1, 0), (4, 1, 0), (4, 1, 1), (77, 1, 0)], labels).selectExpr("*", "'t' text")
    assert resample(some, marks, keep=1.0).count() == 5
    assert resample(some, marks).count() == round(5 / 3)
    assert resample(some.limit(0), marks).count() == 0
