"""Tiling against a plain greedy search, both join strategies, planted and reordered leaks, edge cases."""

import random

import pytest

from lexsieve.llm.decontaminate import leaks, tile


def plain_tiling(a, b, least):
    """The longest common unmarked stretch, first in a, then in b, marked until none is left."""
    fa, fb, tiles = [True] * len(a), [True] * len(b), []
    while True:
        best = (0, 0, 0)
        for p in range(len(a)):
            for q in range(len(b)):
                n = 0
                while p + n < len(a) and q + n < len(b) and a[p + n] == b[q + n] and fa[p + n] and fb[q + n]:
                    n += 1
                if n > best[0]:
                    best = (n, p, q)
        n, p, q = best
        if n < least:
            return tiles
        fa[p : p + n] = [False] * n
        fb[q : q + n] = [False] * n
        tiles.append((p, q, n))


@pytest.mark.parametrize("seed", range(60))
def test_tiles_equal_plain_search(seed):
    rng = random.Random(seed)
    a = [rng.randint(0, 3) for _ in range(rng.randint(0, 25))]
    b = [rng.randint(0, 3) for _ in range(rng.randint(0, 40))]
    assert tile(a, b, 2) == plain_tiling(a, b, 2)


def texts(rng, n):
    return " ".join(rng.choices([f"t{i}" for i in range(500)], k=n))


def made():
    rng = random.Random(9)
    items = [(i, texts(rng, rng.randint(10, 40))) for i in range(20)] + [(90, "a b"), (91, None), (None, texts(rng, 20))]
    docs = []
    for i in range(200):
        body = texts(rng, rng.randint(0, 300)).split()
        if i % 4 == 0:
            words = items[i // 4 % 20][1].upper().split()
            if i % 8 == 0:
                half = len(words) // 2
                words = words[half:] + ["--", "x1"] + words[:half]
            at = rng.randint(0, len(body))
            body[at:at] = words
        docs.append((i, " ".join(body)))
    return docs, items


@pytest.mark.parametrize("limit", [1_000_000, 0])
def test_leaks_equal_tiling_every_pair(spark, limit):
    docs, items = made()
    d = spark.createDataFrame(docs, "doc_id bigint, text string")
    b = spark.createDataFrame(items, "item_id bigint, text string")
    got = {(r.doc_id, r.item_id): (r.matched_words, r.tiles, r.item_words) for r in leaks(d, b, broadcast_words=limit).collect()}
    want = {}
    for i, text in docs:
        for j, item in items[:20]:
            words = item.lower().split()
            tiles = plain_tiling(words, [w for w in text.lower().split() if w != "--"], 4) if i % 4 == 0 and i // 4 % 20 == j else []
            size = sum(t[2] for t in tiles)
            if size >= 0.5 * len(words):
                want[i, j] = (size, len(tiles), len(words))
    assert got == want and len(want) == 50


@pytest.mark.parametrize("limit", [1_000_000, 0])
def test_edge_cases(spark, limit):
    b = spark.createDataFrame([(1, "one two three four five six"), (2, "one two three four five six"), (3, "one"), (4, ""), (5, None)], "item_id bigint, text string").selectExpr("*", "1 doc_id", "2 seed")
    long = "x " * 60_000 + "four five six seven ONE two, three four five six"
    rows = [(1, None), (None, "one two three four five six"), (2, ""), (3, "one two three"), (4, long), (5, "three four five six one two"), (5, "three four five six one two")]
    d = spark.createDataFrame(rows, "doc_id bigint, text string").selectExpr("*", "1 item_id", "2 at", "3 size")
    got = sorted((r.doc_id, r.item_id, r.matched_words, r.tiles) for r in leaks(d, b, broadcast_words=limit).collect())
    assert got == [(4, 1, 6, 1), (4, 2, 6, 1), (5, 1, 4, 1), (5, 2, 4, 1)]
    assert leaks(d.limit(0), b, broadcast_words=limit).count() == 0
    assert leaks(d, b.limit(0), broadcast_words=limit).count() == 0
