import json

from lexsieve.functions.providers import Limiter, ask, enrich, offline, rewritten, salvage
from lexsieve.sources.pages import document_formats, full_texts, read_pages
from lexsieve.sources.store import parse_selection, read_structured, split_new, write_structured
from lexsieve.streaming.ingest import ingest


def test_pages_and_formats(spark, tmp_path):
    def reader(body: bytes):
        if body == b"bad":
            raise ValueError("broken")
        return [(t, "test") for t in body.decode().split("\f")]

    (tmp_path / "sub").mkdir()
    (tmp_path / "a.pdf").write_bytes(("x" * 60 + "\f" + "| a | b | c |\nAnnexure " + "y" * 60).encode())
    (tmp_path / "sub" / "b.pdf").write_bytes(("tiny\f" + "क" * 80).encode())
    (tmp_path / "c.pdf").write_bytes(b"bad")
    (tmp_path / "d.txt").write_bytes(b"no")
    pages = read_pages(spark, str(tmp_path), reader).cache()
    got = {r.path.rsplit("/", 1)[1]: r for r in document_formats(pages).collect()}
    assert set(got) == {"a.pdf", "b.pdf", "c.pdf"}
    assert (got["a.pdf"].kind, got["a.pdf"].has_tables, got["a.pdf"].has_annexures, got["a.pdf"].language) == ("digital", True, True, "en")
    assert (got["b.pdf"].kind, got["b.pdf"].language) == ("mixed", "hi") and got["c.pdf"].kind == "scanned"
    seen = read_pages(spark, str(tmp_path / "sub"), reader, lambda b: [("seen " * 20, "ocr")]).filter("page_number = 1").first()
    assert seen.method == "ocr"
    text = {r.path.rsplit("/", 1)[1]: r for r in full_texts(pages).collect()}["b.pdf"]
    assert text.full_text == "tiny\n\n" + "क" * 80 and text.total_chars == 84


def test_store_is_idempotent(spark, tmp_path):
    docs = spark.createDataFrame([("d1", "RBI", "a"), ("d2", "SEBI", "b"), ("d2", "SEBI", "b")], "doc_id string, source string, body string")
    path = str(tmp_path / "store")
    fresh, cached = split_new(docs, path)
    assert (fresh.count(), cached.count()) == (2, 0)
    write_structured(fresh, path)
    fresh, cached = split_new(docs, path)
    assert (fresh.count(), cached.count()) == (0, 2)
    (tmp_path / "store" / "source=RBI" / "x.json").write_text("not json\n")
    assert [r.doc_id for r in read_structured(spark, path, docs.schema, source="RBI").collect() if r.doc_id] == ["d1"]
    assert read_structured(spark, path, docs.schema, doc_id="d2").count() == 1


def test_stream_equals_batch(spark, tmp_path):
    inbox, store, mark = (str(tmp_path / n) for n in ("in", "store", "mark"))
    (tmp_path / "in").mkdir()
    put = lambda name, ids: (tmp_path / "in" / name).write_text("\n".join(json.dumps({"doc_id": i, "source": "RBI"}) for i in ids))
    put("1.json", ["a", "b"])
    run = lambda: ingest(spark, inbox, store, mark, "doc_id string, source string").awaitTermination()
    run()
    put("2.json", ["b", "c", "c"])
    run()
    run()
    assert sorted(r.doc_id for r in spark.read.json(store).collect()) == ["a", "b", "c"]


def test_selection():
    assert parse_selection("1,3, 5-7", 6) == [1, 3, 5, 6] and parse_selection("9,x,0-2", 3) == [1, 2, 9] and parse_selection("", 3) == []


def test_salvage_and_providers(spark):
    assert salvage('```json\n{"a": [1, 2,],}\n```') == {"a": [1, 2]} and salvage('Sure: [{"x": "line\nbreak"}] ok') == [{"x": "line\nbreak"}] and salvage("none") is None and salvage(None) is None
    replies = iter(["oops", '{"items": [{"action": "x"}]}'])
    assert ask("obligations", "t", lambda p: next(replies)) == ('[{"action": "x"}]', False)
    assert ask("domain", "t", offline) == ('{"domain": "Other"}', True)
    assert rewritten("x", lambda p: '"Submit the return"') == "Submit the return." and rewritten("x", offline) is None
    df = spark.createDataFrame([("a",), (None,)], "text string")
    assert [r.failed for r in enrich(df, "domain", "text").collect()] == [True, True]
    slept, now = [], [0.0]
    limit = Limiter(30, clock=lambda: now[0], sleep=slept.append)
    limit.wait()
    limit.wait()
    assert slept == [2.0]
