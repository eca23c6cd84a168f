"""Repeats against a plain search over all windows, and the edge cases that the docstrings name."""

import random
import re

import pytest

from lexsieve.llm.substring_dedup import substring_repeats
from lexsieve.llm.suffix_dedup import merge_transforms, remove_repeats, suffix_repeats

MIN, SEED, STRIDE = 10, 3, 5


def corpus(seed: int) -> list[tuple[int, str]]:
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(4000)]
    passages = [" ".join(rng.choices(words, k=rng.randint(5, 30))) for _ in range(12)]
    docs = []
    for i in range(60):
        parts = []
        for _ in range(rng.randint(0, 5)):
            parts.append(rng.choice(passages) if rng.random() < 0.5 else " ".join(rng.choices(words, k=rng.randint(1, 40))))
        docs.append((i * 3, ", ".join(parts)))
    for i in range(1, 30):  # short periods in the midst of other words
        docs.append((2000 + i, " ".join(rng.choices(words, k=9) + ["p", "q", "p"][: 1 + i % 3] * (4 + i % 7) + rng.choices(words, k=8))))
    docs += [(1000, "la " * 60), (1001, "LA la. " * 30), (1002, docs[5][1]), (1003, docs[5][1]), (1004, "ab " * 9)]
    return docs


def brute(docs):
    """Runs of windows whose earliest occurrences follow one another."""
    first, spans = {}, []
    for d, text in sorted(docs):
        words = re.findall(r"\w+", text.lower())
        run = None
        for p in range(len(words) - MIN + 1):
            at = first.setdefault(tuple(words[p : p + MIN]), (d, p))
            if at == (d, p):
                run = None
            elif run and run[3] == at[0] and run[4] + p - run[1] == at[1]:
                run[2] = p + MIN
            else:
                run = [d, p, p + MIN, *at]
                spans.append(run)
    return sorted(map(tuple, spans))


def frame(spark, docs):
    return spark.createDataFrame(docs, "doc_id bigint, text string")


def covered(rows):
    return {(r[0], w) for r in rows for w in range(r[1], r[2])}


@pytest.mark.parametrize("seed", [1, 2])
def test_suffix_equals_plain_search(spark, seed):
    docs = corpus(seed)
    got = suffix_repeats(frame(spark, docs), MIN, SEED, STRIDE).collect()
    joined = sorted((r.doc_id, r.start_word, r.end_word, r.first_doc_id, r.first_start_word) for r in got)
    assert joined == brute(docs) and joined


@pytest.mark.parametrize("seed", [1, 2])
def test_substring_covers_plain_search(spark, seed):
    docs = corpus(seed)
    words = {d: re.findall(r"\w+", t.lower()) for d, t in docs}
    got = substring_repeats(frame(spark, docs), MIN, SEED).collect()
    want = brute(docs)
    assert covered(want) <= covered(got) and len(got)
    for r in got:
        n = r.end_word - r.start_word
        assert n >= MIN and (r.first_doc_id, r.first_start_word) < (r.doc_id, r.start_word)
        assert words[r.doc_id][r.start_word : r.end_word] == words[r.first_doc_id][r.first_start_word : r.first_start_word + n]
    for d, s, e, fd, fs in want:
        assert any(r.doc_id == d and r.start_word <= s and r.end_word >= e and r.first_doc_id == fd and r.first_start_word - r.start_word == fs - s for r in got)


@pytest.mark.parametrize("find", [lambda d: suffix_repeats(d, MIN, SEED, STRIDE), lambda d: substring_repeats(d, MIN, SEED)])
def test_edge_cases(spark, find):
    assert find(frame(spark, [])).count() == 0
    rows = [(1, None), (None, "x " * 30), (2, ""), (3, "a b c d e f g h i j k l"), (3, "a b c d e f g h i j k l"), (4, "..."), (5, "z " * 3)]
    assert find(frame(spark, rows)).count() == 0
    rows.append((9, "q A-B c D e f. g h i j k l m"))
    wide = frame(spark, rows).selectExpr("*", "1 anchor", "'x' start", "2 size", "3 words", "4 first_doc_id", "5 runs")
    assert [(r.doc_id, r.start_word, r.end_word, r.first_doc_id, r.first_start_word) for r in find(wide).collect()] == [(9, 1, 13, 3, 0)]
    long = " ".join(f"u{i}" for i in range(60_000))
    got = find(frame(spark, [(1, long), (2, "start " + long)])).collect()
    assert [(r.doc_id, r.start_word, r.end_word) for r in got] == [(2, 1, 60_001)]


def test_remove_repeats(spark):
    docs = frame(spark, [(1, "One two three four five six seven eight nine ten."), (2, "Pre, One two three four five six seven eight nine ten. Post."), (3, "one two three four five six seven eight nine ten"), (4, None), (None, "keep")])
    docs = docs.selectExpr("*", "'en' lang", "length(text) n_chars", "7 cut", "8 spans")
    out = remove_repeats(docs, suffix_repeats(docs, MIN, SEED, STRIDE))
    assert out.columns == docs.columns and out.dtypes == docs.dtypes
    got = {r.doc_id: (r.text, r.n_chars) for r in out.collect()}
    assert got == {1: ("One two three four five six seven eight nine ten.", 49), 2: ("Pre,\nPost.", 10), 4: (None, None), None: ("keep", 4)}


def test_merge_is_the_transform_of_the_union():
    import numpy as np

    rng = random.Random(3)
    shards = [[[rng.randint(1, 3) for _ in range(rng.randint(1, 9))] for _ in range(5)] for _ in range(3)]
    rows = [sorted((tuple(s[i:]), s[i - 1] if i else 0) for s in shard for i in range(len(s) + 1)) for shard in shards]
    shard, row, prefix = merge_transforms([np.array([b for _, b in r]) for r in rows], 12)
    merged = [rows[s][r][0] for s, r in zip(shard, row)]
    assert merged == sorted(merged)
    for a, b, p in zip(merged, merged[1:], prefix[1:]):
        same = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
        if a != b:
            assert p == same
