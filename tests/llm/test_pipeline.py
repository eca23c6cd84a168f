"""The stages against brute force over sf0.001, the chain of columns, nulls and an empty table."""

import re

import pytest

import corpus_pipeline as P
from lexsieve.llm.decontaminate import tile

SF = "/root/testdata/sf0.001"


def words(text):
    return re.findall(r"[^\W_]+", text.lower())


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """(input, output) of each stage as rows."""
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), []
    folder = tmp_path_factory.mktemp("stages")
    for n, (_, stage) in enumerate(P.STAGES):
        stage(spark, docs, SF).write.parquet(f"{folder}/{n}")
        after = spark.read.parquet(f"{folder}/{n}")
        assert n == 4 or after.dtypes == docs.dtypes
        out.append((docs.collect(), after.collect()))
        docs = after
    return out


def test_language_keeps_clean_documents(stages):
    before, after = stages[0]
    assert [r.doc_id for r in sorted(after)] == [r.doc_id for r in sorted(before)]


def test_one_near_copy_stays(stages):
    before, after = stages[1]
    sets = {r.doc_id: set(words(r.text)) for r in before}
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and len(sets[a] & sets[b]) >= 0.7 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    kept, want = {r.doc_id for r in after}, {find(d) for d in sets}
    assert want <= kept and len(kept - want) <= 0.1 * (len(sets) - len(want))


def test_repeats_go_and_all_else_stays(stages):
    before, after = stages[2]
    left, seen = {r.doc_id: r for r in after}, {}
    for r in sorted(before):
        w = words(r.text)
        gone = set()
        for p in range(len(w) - 49):
            if seen.setdefault(tuple(w[p : p + 50]), (r.doc_id, p)) != (r.doc_id, p):
                gone.update(range(p, p + 50))
        rest = [x for i, x in enumerate(w) if i not in gone]
        assert (words(left[r.doc_id].text) if r.doc_id in left else []) == rest
        if r.doc_id in left:
            assert left[r.doc_id].n_chars == len(left[r.doc_id].text)


def test_leaks_go(spark, stages):
    before, after = stages[3]
    items = [words(r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    grams = [{tuple(i[p : p + 4]) for p in range(len(i) - 3)} for i in items]
    kept = set()
    for r in before:
        w = words(r.text)
        mine = {tuple(w[p : p + 4]) for p in range(len(w) - 3)}
        names = {x: n for n, x in enumerate(set(w).union(*items))}
        leak = any(len(mine & g) and sum(t[2] for t in tile([names[x] for x in i], [names[x] for x in w], 4)) >= 0.5 * len(i) for i, g in zip(items, grams))
        if not leak:
            kept.add(r.doc_id)
    assert {r.doc_id for r in after} == kept and len(kept) < len(before)


def test_windows_hold_what_is_left(stages):
    before, after = stages[4]
    spans = {}
    for r in after:
        for s in r.segments:
            spans.setdefault(s.doc_id, []).append((s.start_word, s.end_word))
    for r in before:
        s = sorted(spans.get(r.doc_id, [(0, 0)]))
        assert s[0][0] == 0 and s[-1][1] == len(words(r.text)) and all(a[1] == b[0] for a, b in zip(s, s[1:]))


def test_run_and_edge_cases(spark, tmp_path):
    spark.read.parquet(f"{SF}/benchmark.parquet").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    odd = spark.createDataFrame([(9001, None, "en", "x", None), (None, "the and of", "en", None, 1), (9002, "", None, "x", 0), (9003, "A tail, the and of and it.", "en", "x", 3), (9003, "A tail, the and of and it.", "en", "x", 3)], docs.schema)
    docs.unionByName(odd).write.parquet(f"{tmp_path}/documents.parquet")
    out = P.run(spark, str(tmp_path))
    found = [s.doc_id for r in out.collect() for s in r.segments]
    assert found.count(9003) == 1 and not {9001, 9002, None} & set(found)
    (tmp_path / "none").mkdir()
    docs.limit(0).write.parquet(f"{tmp_path}/none/documents.parquet")
    spark.read.parquet(f"{SF}/benchmark.parquet").write.parquet(f"{tmp_path}/none/benchmark.parquet")
    assert P.run(spark, str(tmp_path / "none")).count() == 0


def test_clashing_columns_and_a_very_long_text(spark, tmp_path):
    import glob

    # no items: the long text is made of many, some of which hold one
    spark.read.parquet(f"{SF}/benchmark.parquet").limit(0).write.parquet(f"{tmp_path}/benchmark.parquet")
    every = spark.read.parquet(f"{SF}/documents.parquet")
    docs = every.filter("doc_id < 60")
    whole = "doc_id text lang source n_chars".split()
    long = "\n".join(r.text for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").filter("doc_id >= 300 and lang = 'en'").collect())
    assert len(long) > 400_000
    odd = spark.createDataFrame([(9001, long, "en", "x", len(long))], docs.schema)
    wide = docs.unionByName(odd).selectExpr(*whole, "1 node", "'w' words", "2 region", "3 hi", "null cell", "array(4) ids", "5 label")
    wide.withColumn("cell", wide["cell"].cast("int")).write.parquet(f"{tmp_path}/documents.parquet")
    found = {s.doc_id: s.end_word for r in P.run(spark, str(tmp_path)).collect() for s in r.segments}
    assert 9001 in found and len(found) > 40
    left = glob.glob(f"{P.checkpoint_folder(spark).removeprefix('file:')}/corpus-pipeline-*/*")
    assert left and all(x.endswith("/4") for x in left)  # what earlier stages wrote is gone


def test_packing_stage_keeps_links_between_regions(spark, monkeypatch):
    """The stage's paths follow the links of all documents: with many regions as with one."""
    import random

    rng, plain = random.Random(12), P.pack
    rows = [(i, " ".join(rng.choices([f"{'abcdef'[i % 6]}{n}" for n in range(60)], k=rng.randint(5, 90)))) for i in range(500)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    runs = []
    for most in (10_000, 50):
        monkeypatch.setattr(P, "pack", lambda docs, most=most: plain(docs, window=10**6, per_cell=20, region_docs=most))
        out = P.packing(spark, df, "").collect()
        runs.append({frozenset((a.doc_id, b.doc_id)) for r in out for a, b in zip(r.segments, r.segments[1:])})
    assert len(runs[0] & runs[1]) > 0.8 * len(runs[0])


def test_packing_stage_links_the_nearest_by_whole_word_vectors(spark, monkeypatch):
    """Of the 6 nearest of each document, found by comparing all, at least 0.9 are linked."""
    import numpy as np
    import pyarrow as pa

    from lexsieve.llm import packing

    told = []
    plain = packing.joined_paths
    monkeypatch.setattr(packing, "joined_paths", lambda links, placed: told.append(links) or plain(links, placed))
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    P.packing(spark, docs, "")
    linked = {(r.a, r.b) for r in told[0].collect()}
    rows = [(r.doc_id, r.text) for r in docs.collect() if words(r.text)]
    ids, x = np.array([i for i, _ in rows]), np.concatenate([v for _, v, _ in packing.hashed_words(pa.array([t for _, t in rows]))])
    like = x @ x.T
    np.fill_diagonal(like, -1)
    near = np.argsort(-like, axis=1, kind="stable")[:, :6]
    found = [(min(a, b), max(a, b)) in linked for i, a in enumerate(ids) for b in ids[near[i]]]
    assert np.mean(found) >= 0.9
