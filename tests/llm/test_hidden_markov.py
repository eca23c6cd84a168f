"""Forward recursion and Baum-Welch against sums over all state paths and a plain single-process version; probabilities sum to one; edge cases."""

from itertools import product

import numpy as np
import pytest

from lexsieve.llm import hidden_markov
from lexsieve.llm.common import cut
from lexsieve.llm.hidden_markov import ENCODED, Model, Vocabulary, _encode, expected, forward, score, segments, train, vocabulary
from lexsieve.llm.words import U


def tiny(symbols=4):
    rng = np.random.default_rng(0)
    norm = lambda x, a: x / x.sum(a, keepdims=True)
    return Model(norm(rng.random(3), 0), norm(rng.random((3, 3)), 1), norm(rng.random((symbols, 3)), 0))


def paths(m, seq):
    for path in product(range(3), repeat=len(seq)):
        p = m.start[path[0]] * m.emit[seq[0], path[0]]
        for t in range(1, len(seq)):
            p *= m.move[path[t - 1], path[t]] * m.emit[seq[t], path[t]]
        yield path, p


def counted(m, flat, cuts):
    emits = np.zeros_like(m.emit)

    def tell(place, words, gamma):
        assert (words[place >= 0] == flat[place[place >= 0]]).all() and np.allclose(gamma.sum(1)[place >= 0], 1, atol=1e-4)
        for s in range(emits.shape[1]):
            emits[:, s] += np.bincount(words.ravel(), gamma[:, s].ravel(), minlength=len(emits))

    starts, moves, fit = expected(m, flat, cuts, tell)
    return starts, moves, emits, fit


def plain(m, seqs):
    """Scaled forward and backward over each whole text, one by one."""
    starts, moves, emits, fit = np.zeros_like(m.start), np.zeros_like(m.move), np.zeros_like(m.emit), 0.0
    for x in seqs:
        if not len(x):
            continue
        alpha, scale = np.zeros((len(x), len(m.start))), np.zeros(len(x))
        for t, w in enumerate(x):
            alpha[t] = (m.start if t == 0 else alpha[t - 1] @ m.move) * m.emit[w]
            scale[t] = alpha[t].sum()
            alpha[t] /= scale[t]
        beta = np.ones(len(m.start))
        for t in range(len(x) - 1, -1, -1):
            emits[x[t]] += alpha[t] * beta
            if t:
                now = m.emit[x[t]] * beta / scale[t]
                moves += np.outer(alpha[t - 1], now) * m.move
                beta = m.move @ now
            else:
                starts += alpha[0] * beta
        fit += np.log(scale).sum()
    return starts, moves, emits, fit


def test_forward_is_the_sum_over_paths():
    m, seqs = tiny(), [[0, 1, 3, 2], [2], [], [1, 1, 0]]
    flat, cuts = np.array(sum(seqs, [])), np.cumsum([0] + [len(s) for s in seqs])
    got = forward(m, m.emit[flat], cuts[:-1], np.diff(cuts))
    want = [np.log(sum(p for _, p in paths(m, s))) if s else 0.0 for s in seqs]
    assert np.allclose(got, want)
    assert np.isclose(sum(np.exp(forward(m, m.emit[list(s)], np.array([0]), np.array([3]))[0]) for s in product(range(4), repeat=3)), 1)


@pytest.mark.parametrize("segment", [1, 2, 3, 512])
def test_expected_counts_are_sums_over_paths(monkeypatch, segment):
    monkeypatch.setattr(hidden_markov, "SEGMENT", segment)
    m, seqs = tiny(), [[0, 1, 3, 2, 2], [1, 1, 0], [], [2]]
    flat, cuts = np.array(sum(seqs, []), np.uint16), np.cumsum([0] + [len(s) for s in seqs])
    starts, moves, emits, fit = counted(m, flat, cuts)
    a, b, c, f = np.zeros(3), np.zeros((3, 3)), np.zeros((4, 3)), 0.0
    for s in seqs:
        every = list(paths(m, s)) if s else []
        total = sum(p for _, p in every)
        f += np.log(total) if s else 0
        for path, p in every:
            a[path[0]] += p / total
            for t, x in enumerate(s):
                c[x, path[t]] += p / total
                if t:
                    b[path[t - 1], path[t]] += p / total
    assert np.allclose(starts, a, atol=1e-5) and np.allclose(moves, b, atol=1e-5) and np.allclose(emits, c, atol=1e-5) and np.isclose(fit, f, atol=1e-5)


def test_long_texts_are_not_cut():
    rng, m = np.random.default_rng(3), tiny(50)
    seqs = [rng.integers(0, 50, n) for n in (3000, 1, 0, 700, 256, 257, 512)]
    flat, cuts = np.concatenate(seqs).astype(np.uint16), np.cumsum([0] + [len(s) for s in seqs])
    for got, want in zip(counted(m, flat, cuts), plain(m, seqs)):
        assert np.allclose(got, want, rtol=1e-4, atol=1e-4)


def test_segments_cover_everything():
    got = [x.tolist() for x in segments(np.array([0, 0, 600, 603]))]
    assert got == [[1, 1, 1, 2], [0, 1, 2, 0], [0, 256, 512, 600], [256, 256, 88, 3]]


def test_vocabulary():
    v = Vocabulary(np.array([5, 9], U), 3)
    assert v.encode(np.array([9, 5, 9, 77], U))[:3].tolist() == [1, 0, 1] and 2 <= v.encode(np.array([77], U))[0] < 5


def mixed(n=240, length=50):
    rng = np.random.default_rng(2)
    return [(i, " ".join(f"{'abcd'[i % 4]}{w}" for w in rng.integers(0, 60, length))) for i in range(n)]


def test_training_is_plain_baum_welch_and_the_likelihood_rises(spark):
    docs = spark.createDataFrame(mixed(60, 30) + [(100, ""), (101, " ".join(f"a{i % 7}" for i in range(900)))], "doc_id bigint, text string").repartition(3)
    vocab = vocabulary(docs, 100, 20)
    encoded = cut(docs.mapInArrow(_encode(vocab), ENCODED))
    model, old, total, fits = train(encoded, vocab.size, 4, 6, 0.01, 1, tolerance=-1.0, head=1)
    seqs = [np.frombuffer(r.symbols, np.uint16) for r in encoded.collect()]
    counts = np.bincount(np.concatenate(seqs), minlength=vocab.size) + 0.01
    m, want = Model.initial(4, counts / counts.sum(), 1), []
    for _ in range(6):
        a, b, c, f = plain(m, seqs)
        want.append(f / sum(map(len, seqs)))
        a, b, c = a + 0.01, b + 0.01, c + 0.01 / vocab.size
        m = Model(a / a.sum(), b / b.sum(1, keepdims=True), c / c.sum(0))
    assert len(fits) == 6 and np.allclose(fits, want, atol=1e-4) and (np.diff(fits) > 0).all()
    assert np.allclose(model.move, m.move, atol=1e-3) and np.allclose(model.emit, m.emit, atol=1e-3)


def test_untied_words_have_chances_that_sum_to_one(spark):
    from lexsieve.llm.hidden_markov import _rare_states, _untied, flattened

    docs = spark.createDataFrame(mixed(), "doc_id bigint, text string").repartition(3)
    vocab = vocabulary(docs, 30, 5)
    encoded = cut(docs.mapInArrow(_encode(vocab), ENCODED))
    model, old, total, _ = train(encoded, vocab.size, 4, 3, 0.01, 1)
    counts = encoded.mapInArrow(_rare_states(old, 30, 2), "bucket bigint, part int, words binary, states binary").toArrow()
    words = flattened(counts["words"], U)[0]
    share = np.concatenate([flattened(b.column("states"), np.float32)[0] for b in _untied(total, 30, 1.0)(counts)]).reshape(-1, 4)
    each = dict(zip(words.view(np.int64).tolist(), share))
    assert len(each) == 210 and len(words) == len(share) > 210
    classes = vocab.encode(np.array(list(each), np.int64).view(U)) - 30
    sums = np.zeros((5, 4))
    np.add.at(sums, classes, np.array(list(each.values())))
    assert np.allclose(sums, 1, atol=1e-4)


def test_score_prefers_the_corpus_and_handles_edges(spark):
    rows = [(i, "one two three four " * 20) for i in range(40)] + [(100, "four one three two four two " * 5), (101, "novel words never seen before"), (102, None), (103, ""), (None, "one"), (104, "one two"), (104, "one two"), (105, "one two three four " * 20_000)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").selectExpr("*", "1 symbols", "2 word", "3 n")
    got = {r.doc_id: r for r in score(docs, states=4, rounds=4, common=4, classes=3).collect()}
    assert len(got) == 46 and got[102].log_likelihood == got[103].log_likelihood == 0 and got[103].per_word is None
    assert got[0].per_word > got[100].per_word > got[101].per_word
    assert got[105].n_words == 80_000 and got[104].n_words == 2 and np.isfinite(got[105].log_likelihood)
    assert score(docs.limit(0)).count() == 0


def test_states_separate_before_training_ends(spark):
    rng = np.random.default_rng(2)
    rows = [(i, " ".join(f"{'abcd'[i % 4]}{w}" for w in rng.integers(0, 60, 50))) for i in range(240)]
    got = score(spark.createDataFrame(rows, "doc_id bigint, text string")).agg({"log_likelihood": "sum", "n_words": "sum"}).first()
    _, n = np.unique(" ".join(t for _, t in rows).split(), return_counts=True)
    unigram = (n * np.log(n / n.sum())).sum() / n.sum()
    assert got["sum(log_likelihood)"] / got["sum(n_words)"] - unigram > 1  # ln 4, less the changes of state


def test_every_word_of_the_corpus_has_chances_of_its_own(spark):
    rng = np.random.default_rng(5)
    rows = [(i, " ".join(f"{'abcd'[i % 4]}{w}" for w in rng.integers(0, 400, 60))) for i in range(300)]
    twice = rows + [(1000 + i, " ".join(f"once{i}x{j}" for j in range(60))) for i in range(20)] + [(2000 + i, " ".join(f"twice{i % 20}x{j}" for j in range(60))) for i in range(40)]
    docs = spark.createDataFrame(twice, "doc_id bigint, text string").repartition(4)
    got = {r.doc_id: r.per_word for r in score(docs, states=4, common=40, classes=8).collect()}
    assert len(got) == 360
    assert max(got[1000 + i] for i in range(20)) < min(got[2000 + i] for i in range(40))  # what occurs twice is likelier
    _, n = np.unique(" ".join(t for _, t in twice).split(), return_counts=True)
    unigram = (n * np.log(n / n.sum())).sum() / n.sum()
    assert np.mean([got[d] for d, _ in twice]) - unigram > 0.2  # though only 40 words have symbols in training


def test_empty_texts_only(spark):
    got = score(spark.createDataFrame([(1, ""), (2, None)], "doc_id bigint, text string")).collect()
    assert sorted((r.doc_id, r.n_words, r.log_likelihood, r.per_word) for r in got) == [(1, 0, 0.0, None), (2, 0, 0.0, None)]
