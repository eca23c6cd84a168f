"""Held-out accuracy, the kernel against plain sets, edge cases."""

import numpy as np
import pyarrow as pa

from lexsieve.llm.language_id import Model, blocks, identify, keep_accepted, presence, train

DATA = "/root/testdata/sf0.01/documents.parquet"


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(DATA)
    half = docs.filter("doc_id % 2 = 0")
    got = identify(docs.filter("doc_id % 2 = 1"), train(half, per_language=100)).join(docs.select("doc_id", "lang"), "doc_id").toPandas()
    assert (got.language == got.lang).mean() > 0.97
    assert got.accepted.mean() > 0.99


def test_kernel_is_that_of_presence_sets():
    texts = ["abc, ABD", "ab", "zz  top", "été ÉTÉ"]
    offsets, body = np.cumsum([0] + [len(t.encode()) for t in texts]), np.frombuffer("".join(texts).encode(), np.uint8)
    bits = presence(body, offsets, 3)

    def grams(t):
        b = " ".join("".join(c.lower() if c.isalnum() else " " for c in t).split() if t[0] != " " else t).encode()
        return {b[i : i + n] for n in (1, 2, 3) for i in range(len(b) - n + 1)}

    assert bits.sum(1).tolist() == [len(grams(t)) for t in texts]
    assert (bits[0] & bits[1]).sum() == len(grams(texts[0]) & grams(texts[1]))
    model = Model(bits, ["x", "x", "y", "y"], 2, 1e-6, 3)
    k = model.kernel(bits)
    assert np.isclose(k[0, 1], len(grams(texts[0]) & grams(texts[1])) / np.sqrt(len(grams(texts[0])) * len(grams(texts[1]))))
    assert [model.classes[i] for i in model.scores(bits)[0].argmax(1)] == ["x", "x", "y", "y"]


def test_whole_text_counts():
    text = pa.array(["a" * 3 + " b" * 400_000 + " zq"])
    assert sum(x.sum() for _, x in blocks(text, 2)) == len({"a", "aa", " ", " b", "b", "b ", "a ", "z", " z", "zq", "q"})


def test_edge_cases(spark):
    schema = "doc_id bigint, text string, lang string"
    empty = spark.createDataFrame([], schema)
    assert train(empty) is None and identify(empty, None).count() == 0
    rows = [(1, "the cat and the dog", "en"), (2, "der Hund und die Katze", "de"), (3, None, "en"), (4, "", None), (None, "x", "en"), (5, "?? --", "de"), (6, "the dog", None), (7, "日本語の文章です", None), (8, "und der Hund", "de"), (8, "und der Hund", "de"), (9, "the dog " * 40_000, None)]
    docs = spark.createDataFrame(rows, schema).selectExpr("*", "1 language", "2 score", "3 nth", "4 label")
    scored = identify(docs, train(docs))
    got = {r.doc_id: (r.language, r.accepted) for r in scored.collect()}
    assert got.pop(7)[1] is False
    assert got == {1: ("en", True), 2: ("de", True), 3: (None, False), 4: (None, False), 5: (None, False), 6: ("en", True), 8: ("de", True), 9: ("en", True)}
    kept = keep_accepted(docs, scored)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [1, 2, 6, 8, 8, 9]
    assert not any(r.accepted for r in identify(docs, None).collect())
